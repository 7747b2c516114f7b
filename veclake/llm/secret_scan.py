"""Secret scan: base patterns, and weak candidates linked by their parts.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

#: Parts that belong together have at most so many code points between them.
SCOPE = 200

#: kind: (quick test, pattern, group to measure, least length of the group)
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12}", r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32}", r"[0-9a-f]{32,}", 0, 32),
}
#: Parts that are reported only with their complement: identifiers, secrets and endpoints.
WEAK = {
    "linked_id": (r"""(?i)\b(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""", "id"),
    "linked_secret": (r"""(?i)\b(?:pwd|pass|pass_?phrase|private_?key|credentials?|auth|password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#$%^&*-]{4,}""", "secret"),
    "linked_endpoint": (r"""(?i)\b(?:https?|ftps?|sftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s"'<>]+""", "endpoint"),
}
KINDS = [*BASE, *WEAK]
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _starts(gaps: Column, matches: Column) -> Column:
    """Start of each match from the texts between them.

    Prefix sums in blocks of about the square root of their number, as arrays
    have no running sum.
    """
    n = F.size(matches)
    side = F.ceil(F.sqrt(n.cast("double"))).cast("int")

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def with_lengths(v: Column) -> Column:
        lengths, b = v["lengths"], v["side"]
        blocks = F.transform(F.sequence(F.lit(0), b), lambda j: total(F.slice(lengths, j * b + 1, b)))
        heads = let(blocks, lambda s: F.transform(F.sequence(F.lit(0), b), lambda j: total(F.slice(s, F.lit(1), j))))
        return let(
            F.struct(heads.alias("heads"), lengths.alias("lengths"), b.alias("side")),
            lambda w: F.transform(matches, lambda _, i: F.get(w["heads"], (i / w["side"]).cast("int")) + total(F.slice(w["lengths"], (i / w["side"]).cast("int") * w["side"] + 1, i % w["side"])) + F.length(F.get(gaps, i))),
        )

    lengths = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
    return let(F.struct(lengths.alias("lengths"), side.alias("side")), with_lengths)


def found(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost matches that do not overlap, those with a shorter group dropped."""

    def spans(v: Column) -> Column:
        whole = F.arrays_zip(v["starts"].alias("start"), v["matches"].alias("match"), v["groups"].alias("group"))
        kept = F.filter(whole, lambda x: F.length(x["group"]) >= least)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["match"])).alias("end")))

    def with_matches(v: Column) -> Column:
        return let(F.struct(_starts(v["gaps"], v["matches"]).alias("starts"), v["matches"].alias("matches"), v["groups"].alias("groups")), spans)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), matches.alias("matches"), groups.alias("groups")), with_matches).cast(SPAN)


def _spelled(spans: Column) -> Column:
    """kind:start:end, by start and then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, base spans, weak parts): one pass over the texts.  key, the id and a hash of the text, tells rows apart."""
    text = F.coalesce(docs[text_col], F.lit(""))
    none = F.array().cast(SPAN)
    base = [F.when(text.rlike(quick), found(text, pattern, k, group, least)).otherwise(none).alias(f"b{k}") for k, (quick, pattern, group, least) in enumerate(BASE.values())]
    weak = [F.when(text.rlike(pattern), found(text, pattern, len(BASE) + k)).otherwise(none) for k, (pattern, _) in enumerate(WEAK.values())]
    return docs.select(docs[id_col].alias("id"), F.struct(docs[id_col].alias("id"), F.xxhash64(text).alias("hash")).alias("key"), *base, F.concat(*weak).alias("weak"))


def linked(scan: DataFrame) -> DataFrame:
    """(key, spans): the weak parts whose complement stands within SCOPE of them.

    An identifier needs a secret, a secret an identifier or an endpoint, and
    an endpoint a secret.  Strong access keys count as identifiers and other
    base spans as secrets.  Parts meet in an interval join on the text and on
    cells of SCOPE code points, as semi-joins: no pairs are made.  The gap
    between two parts counts, so a part lies in all cells that it covers, and
    its partner in those and the next to them.
    """
    rank = {k: i for i, k in enumerate(KINDS)}
    part = F.explode(F.concat("b0", "b1", "b2", "weak")).alias("s")
    parts = written(scan.where(F.size("weak") > 0).select("key", part).select("key", "s.*").distinct(), "parts")
    ids = parts.where(F.col("rank").isin(rank["access"], rank["linked_id"]))
    secrets = parts.where(F.col("rank").isin(rank["assign"], rank["hex"], rank["linked_secret"]))
    ends = parts.where(F.col("rank") == rank["linked_endpoint"])

    def cells(more: int) -> Column:
        return F.explode(F.sequence(F.floor(F.col("start") / SCOPE) - more, F.floor(F.col("end") / SCOPE) + more)).alias("_cell")

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        mine = left.select("key", "start", "rank", "end", cells(0))
        other = right.select(F.col("key").alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"), cells(1).alias("_other")).distinct()
        gap = F.greatest(mine["start"] - other["_end"], other["_start"] - mine["end"])
        close = (gap >= 0) & (gap <= SCOPE)
        return mine.join(other, (mine["key"] == other["_key"]) & (mine["_cell"] == other["_other"]) & close, "left_semi").select("key", "start", "rank", "end")

    every = reduce(DataFrame.unionByName, (near(secrets, ids), near(secrets, ends), near(ids, secrets), near(ends, secrets))).where(F.col("rank") >= len(BASE))
    return every.groupBy("key").agg(F.collect_set(F.struct("start", "rank", "end")).alias("spans"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans stay as they are; spans has linked_id, linked_secret and
    linked_endpoint besides, unless a base span covers the same place.
    Positions are code points, ends exclusive.

    Null text counts as empty: no spans, the hash of an empty string.  Null
    ids, ties and repeated rows get one row each; extra columns are not read;
    an empty table gives none.
    """
    scan = written(scanned(docs, id_col, text_col), "scan")
    more = linked(scan).select(F.col("key").alias("_key"), "spans")
    out = scan.join(more, scan["key"] == more["_key"], "left")
    base = F.concat("b0", "b1", "b2")

    def fresh(b: Column) -> Column:
        weak = F.filter(F.coalesce(F.col("spans").cast(SPAN), F.array().cast(SPAN)), lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))
        return F.concat(b, weak)

    return out.select(
        F.col("id").alias(id_col),
        *[F.size(f"b{k}").cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.sha2(_spelled(base), 256).alias("base_sha256"),
        _spelled(let(base, fresh)).alias("spans"),
    )
