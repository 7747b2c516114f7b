"""Mixing sources to target weights by hierarchical budgets.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

LEVELS = ["domain", "lang", "source"]
#: Hex digits of the seeded order that are told apart at a time: 16**BIN_DIGITS bins a leaf.
BIN_DIGITS = 2
#: Rows of a leaf that are added up one by one, where its budget ends; a bin of more is cut into bins again.
LAST_ROWS = 1000
#: Largest plan (one row per leaf, about 100 bytes) that is broadcast.
BROADCAST_LEAVES = 200_000


def token_estimate(text: Column, lang: Column | None = None, bytes_per_token: dict[str | None, float] | None = None) -> Column:
    """The UTF-8 bytes by those that a token of the language has (the one under None for others), rounded up; 0 for null and empty texts."""
    rates = {None: 4.0} | (bytes_per_token or {})
    rate = F.lit(float(rates[None]))
    for name, r in rates.items():
        if name is not None:
            rate = F.when(lang == name, float(r)).otherwise(rate)
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / rate).cast("long")


def weight(name: Column, weights: dict[str, float]) -> Column:
    """The stated weight of a name, 1 for one that is not stated or null."""
    if any(v < 0 for v in weights.values()):
        raise ValueError("weights must not be negative")
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(name == k, float(v)).otherwise(out)
    return out


def poured(children: DataFrame, parents: list[str], child: str, budget: Column) -> DataFrame:
    """``children`` (parents, child, cap, weight and a budget for all) with the budget of each.

    A parent's budget is divided by weight.  What a child cannot take, for its
    capacity, goes to its siblings by their weights.  Sorted by capacity per
    weight, the full children come first, so one running sum finds the level
    of the others.  A child without weight has no capacity and gets nothing.
    """
    children = children.withColumn("ratio", F.coalesce(F.try_divide(F.col("cap").cast("double"), F.col("weight")), F.lit(0.0)))
    order = Window.partitionBy(*[F.col(p) for p in parents]).orderBy(F.col("ratio"), F.col(child))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.try_divide((budget - before).cast("double"), rest)
    every = Window.partitionBy(*[F.col(p) for p in parents])
    run = children.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    run = run.withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("ratio").alias("r"), F.col(child).alias("c"), F.col("level").alias("l")))).over(every)["l"])
    # greatest: a budget that runs out leaves no negative share
    own = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(F.greatest(F.col("final"), F.lit(0.0)) * F.col("weight"))))
    return run.withColumn("budget", own.cast("long")).drop("ratio", "level", "open", "final")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], share: float, max_epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with each leaf's token budget.

    Budgets go from the root to domains, to their languages, to their sources.
    A node's capacity is that of its subtree, ``max_epochs`` readings of each
    leaf.  So a shortage stays with siblings as long as they have room, and
    only then reaches the parent's siblings.
    """

    def weighed(nodes: DataFrame, name: str) -> DataFrame:
        out = nodes.withColumn("weight", weight(F.col(name), weights.get(name, {})))
        return out.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0).cast("long"))

    caps = weighed(leaves.withColumn("cap", F.col("tokens") * max_epochs), "source")
    langs = weighed(caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")), "lang")
    domains = weighed(langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")), "domain")
    total = F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * share).cast("long")
    domains = poured(domains.withColumn("total", total), [], "domain", F.col("total"))
    up = domains.select(F.col("domain").alias("_d"), F.col("budget").alias("_budget"))
    langs = poured(langs.drop("tokens").join(up, langs["domain"].eqNullSafe(up["_d"])).drop("_d"), ["domain"], "lang", F.col("_budget"))
    up = langs.select(F.col("domain").alias("_d"), F.col("lang").alias("_l"), F.col("budget").alias("_budget"))
    out = caps.join(up, caps["domain"].eqNullSafe(up["_d"]) & caps["lang"].eqNullSafe(up["_l"])).drop("_d", "_l")
    return poured(out, ["domain", "lang"], "source", F.col("_budget")).select(*LEVELS, "tokens", "budget")


def _order(id_: Column, epoch: Column, seed: int) -> Column:
    """Place of a document in a leaf's reading order of one epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))))


def plan(slim: DataFrame, weights: dict[str, dict[str, float]], share: float, max_epochs: int, seed: int) -> DataFrame:
    """One row per leaf: its budget, whole epochs, and the last document (place, id) of the prefix of one more.

    Sums by bins of the reading order find the bin where the prefix ends, sums
    by finer bins of its documents the finer bin, and so on: no task ever
    sorts a leaf, only 16**BIN_DIGITS bins of it or LAST_ROWS documents.
    """
    leaves = budgets(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), weights, share, max_epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    leaves = written(leaves.withColumn("epochs", full).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "leaves")

    inside = _joined(slim, leaves.where("rest > 0").select(*LEVELS, "epochs", "rest")).withColumn("place", _order(F.col("id"), F.col("epochs"), seed))
    inside = inside.select(*LEVELS, "rest", "place", "id", "n_tokens")
    below = None  # the prefix as far as bins that are taken as a whole go
    for digit in range(1, 33, BIN_DIGITS):
        # rest: what is left of the budget at the start of the bin that is being cut
        sums = inside.groupBy(*LEVELS, "rest", F.substring("place", digit, BIN_DIGITS).alias("bin")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"), F.max(F.struct("place", "id")).alias("last"))
        upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bin"))
        run = written(sums.select("*", upto.alias("upto")), "bins")
        taken = run.where("upto <= rest").groupBy(*LEVELS).agg(F.max("last").alias("last"))
        below = taken if below is None else below.union(taken)
        cut = run.where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("bin", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"), "rows")).alias("cut"))
        cut = written(cut, "cuts")
        own = _joined(inside.drop("rest"), cut).where(F.substring("place", digit, BIN_DIGITS) == F.col("cut.bin"))
        inside = written(own.select(*LEVELS, F.col("cut.left").alias("rest"), "place", "id", "n_tokens"), "inside")
        if cut.where(F.col("cut.rows") > LAST_ROWS).isEmpty():
            break
    # rows that repeat an id have one place
    each = inside.groupBy(*LEVELS, "rest", "place", "id").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("place", "id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = each.select(*LEVELS, F.struct("place", "id").alias("last"), upto.alias("upto"), "rest").where("upto <= rest").select(*LEVELS, "last")
    last = below.union(last).groupBy(*LEVELS).agg(F.max("last").alias("last"))
    return _joined(leaves, last, "left").select(*LEVELS, "tokens", "budget", "epochs", "last")


def _joined(rows: DataFrame, leaves: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with their leaf's columns; nulls are names like any other."""
    own = [c for c in leaves.columns if c not in LEVELS]
    other = leaves.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], *own)
    on = None
    for c in LEVELS:
        on = rows[c].eqNullSafe(other[f"_{c}"]) if on is None else on & rows[c].eqNullSafe(other[f"_{c}"])
    return rows.join(other, on, how).drop(*[f"_{c}" for c in LEVELS])


def _copies() -> Column:
    """How often a document of a planned leaf is read: whole epochs, and one more inside the last one's prefix."""
    within = F.coalesce(F.struct(F.col("place").alias("place"), F.col("id")) <= F.col("last"), F.lit(False))
    return (F.col("epochs") + within.cast("long")).alias("copies")


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], share: float, max_epochs: int, seed: int = 1, keep: list[str] | None = None, bytes_per_token: dict[str | None, float] | None = None) -> DataFrame:
    """Every document with its leaf (domain, lang, source), n_tokens and copies.

    ``n_tokens`` is ``token_estimate``: bytes by the ``bytes_per_token`` of the
    language, measured with a tokenizer beforehand.

    ``share`` is the part of all tokens that the mixture has in total.  Of a
    leaf, ``copies`` readings are the whole epochs of its budget and the
    longest prefix of one more that fits, in an order seeded by the epoch.
    ``keep`` names columns of ``docs`` to carry along (default: doc_id).

    A name of weight 0 is left out, with all below it; a negative weight is an
    error.  Null and empty texts have 0 tokens.  A null domain, language or source is
    a name of its own with weight 1; a null id counts as empty in the order.
    Rows that repeat an id have one place and are taken or left together;
    extra columns are not read; an empty table gives none.
    """
    row = F.struct(*[docs[c] for c in (keep or ["doc_id"])]).alias("row")
    every = docs.select(row, docs["doc_id"].alias("id"), domain.alias("domain"), docs["lang"].alias("lang"), docs["source"].alias("source"), token_estimate(docs["text"], docs["lang"], bytes_per_token).alias("n_tokens"))
    slim = written(every.drop("row"), "sizes")
    leaves = written(plan(slim, weights, share, max_epochs, seed), "plan")
    few = leaves.count() <= BROADCAST_LEAVES
    out = _joined(every, F.broadcast(leaves) if few else leaves).withColumn("place", _order(F.col("id"), F.col("epochs"), seed))
    return out.select("row.*" if keep is None else "row", *LEVELS, "n_tokens", _copies())


def mixed_documents(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], share: float, max_epochs: int, seed: int = 1, bytes_per_token: dict[str | None, float] | None = None) -> DataFrame:
    """The documents that the mixture reads, each as often as it does, all columns as they were.

    Nulls, ties, repeated rows, extra columns and empty tables as in ``mix``.
    """
    out = mix(docs, domain, weights, share, max_epochs, seed, keep=docs.columns, bytes_per_token=bytes_per_token).where("copies > 0")
    if max_epochs > 1:
        out = out.withColumn("_reading", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("row.*")
