"""Quality rules whose thresholds adapt to each language and source.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, words, written

#: Characters that count as symbols, as a pattern.
SYMBOLS = r"[#*$%&|<>]"
#: Position bits of a packed window: texts of more words take the plain comparison.
POSITION_BITS = 24
#: Bins of a sketch for each doubling of a value: a relative error of 1/64.
OCTAVE = 64
#: Documents that a parent's quartile counts as when it is blended into that of a language or of a source.
PRIOR = 30
#: Largest threshold table that is broadcast, in rows of about 100 bytes.
BROADCAST_ROWS = 200_000

#: metric: (spreads below the lower quartile or None, spreads above the upper one, least spread), a spread being the bins between the quartiles.
#: The first three are shares, word_len is in hundredths of a character.
RULES = {"symbols": (None, 2, OCTAVE), "dup_lines": (None, 2, OCTAVE), "repeat_words": (None, 3, OCTAVE), "word_len": (6, 6, OCTAVE // 16)}


def repeated_positions(ws: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more.

    Windows are hashed and sorted together with their positions; equal
    neighbours are compared word by word.  If two different windows share a
    hash, or positions do not fit, whole windows are sorted instead.
    """
    low = (1 << POSITION_BITS) - 1
    n = F.size(ws)

    def covered(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    def prefix(x: Column) -> Column:
        return F.shiftright(x, POSITION_BITS)

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(low).cast("long")).cast("int")

    def same(a: Column, b: Column) -> Column:
        return (ws[a] == ws[b]) & (ws[a + 1] == ws[b + 1]) & (ws[a + 2] == ws[b + 2])

    def plain(_: Column) -> Column:
        full = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(ws[i].alias("a"), ws[i + 1].alias("b"), ws[i + 2].alias("c"), i.alias("i"))))

        def key(x: Column) -> Column:
            return F.struct(x["a"], x["b"], x["c"])

        return let(full, lambda s: covered(F.transform(F.filter(s, lambda x, i: F.coalesce(key(F.get(s, i - 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(s, i + 1)) == key(x), F.lit(False))), lambda x: x["i"])))

    def from_candidates(c: Column) -> Column:
        clash = F.exists(F.sequence(F.lit(1), F.size(c) - 1), lambda i: (prefix(c[i]) == prefix(c[i - 1])) & ~same(place(c[i]), place(c[i - 1])))
        return F.when(F.size(c) == 0, 0).when(clash, plain(c)).otherwise(covered(F.transform(c, place)))

    def candidates(s: Column) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(prefix(F.get(s, i - 1)) == prefix(x), F.lit(False)) | F.coalesce(prefix(F.get(s, i + 1)) == prefix(x), F.lit(False)))

    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2]).bitwiseAND(F.lit(~low).cast("long")).bitwiseOR(i.cast("long")))
    return F.when(n < 4, 0).when(n > low, plain(n)).otherwise(let(F.sort_array(packed), lambda s: let(candidates(s), from_candidates)))


def measures(text: Column) -> Column:
    """A struct of the base measures of a whole text; all zero for null."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeated_positions(ws).cast("long").alias("n_repeat_words"),
        ),
    )
    return let(
        F.struct(out.alias("w"), lines.alias("lines"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols")),
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"),
            m["w"]["word_chars"].alias("word_chars"),
            m["n_symbols"].alias("n_symbols"),
            F.size(m["lines"]).cast("long").alias("n_lines"),
            (F.size(m["lines"]) - F.size(F.array_distinct(m["lines"]))).cast("long").alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def metrics(m: Column) -> dict[str, Column]:
    """Whole numbers whose quantiles set the thresholds; word_len of a text without words is 0.

    Shares are parts per million of (n + 1) / (total + 1): one more of each
    keeps the share of a text that has none apart from zero, by its length.
    """

    def share(a: str, b: str) -> Column:
        return _div((m[a] + 1) * 1_000_000, m[b] + 1)

    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeat_words": share("n_repeat_words", "n_words"),
        "word_len": F.coalesce(F.try_divide(100 * m["word_chars"], m["n_words"]).cast("long"), F.lit(0).cast("long")),
    }


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def bin_of(value: Column) -> Column:
    """A value's place in a sketch: itself up to 2 * OCTAVE, from there OCTAVE bins for each doubling."""
    drop = F.greatest(F.length(F.bin(value)) - OCTAVE.bit_length(), F.lit(0))
    return (drop * OCTAVE).cast("long") + F.call_function("shiftright", value, drop)


def sketches(measured: DataFrame) -> DataFrame:
    """Quantile sketches: (language, source, metric, bin, n), summed to merge.

    A sketch of any number of documents has some 1,300 rows at most, merging is
    adding counts, and the outcome does not depend on the order of merging.
    Documents that fail the base rules do not count.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bin_of(v).alias("bin")) for k, v in metrics(measured["m"]).items()]))
    rows = measured.where(~base_failed(measured["m"])).select("lang", "source", each.alias("x"))
    return rows.groupBy("lang", "source", F.col("x.metric").alias("metric"), F.col("x.bin").alias("bin")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(language, source, the bins that bound each metric) from merged sketches.

    A source has the quartiles of its own sketch, blended with those of its
    language, and these with those of the corpus: a parent counts as PRIOR
    documents, so a small group leans on its parent, a large one hardly does,
    and no size switches from one to the other.  Quartiles are bins, so
    blending and spreads are by ratio.
    """

    def quartiles(keys: list[str]) -> DataFrame:
        by = Window.partitionBy(*keys, "metric")
        merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
        run = merged.select(*keys, "metric", "bin", F.sum("n").over(by.orderBy("bin")).alias("upto"), F.sum("n").over(by).alias("total"))
        return run.groupBy(*keys, "metric").agg(
            F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bin"))).alias("q1"),
            F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bin"))).alias("q3"),
            F.max("total").alias("total"),
        )

    leaf, lang, every = quartiles(["lang", "source"]), quartiles(["lang"]), quartiles([])
    joined = (
        leaf.alias("a")
        .join(lang.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.metric") == F.col("b.metric")))
        .join(every.alias("c"), F.col("a.metric") == F.col("c.metric"))
    )

    def blended(own: str, q: str, parent: Column) -> Column:
        return _div(F.col(f"{own}.total") * F.col(f"{own}.{q}") + PRIOR * parent, F.col(f"{own}.total") + PRIOR)

    rows = joined.select("a.lang", "a.source", "a.metric", *[blended("a", q, blended("b", q, F.col(f"c.{q}"))).alias(q) for q in ("q1", "q3")])
    aggs = []
    for name, (down, up, least) in RULES.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        for side, bound in (("low", None if down is None else F.col("q1") - down * spread), ("high", F.col("q3") + up * spread)):
            if bound is not None:
                aggs.append(F.max(F.when(F.col("metric") == name, bound)).alias(f"{name}_{side}"))
    return rows.groupBy("lang", "source").agg(*aggs)


def judged(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """``measured`` (lang, source, m and more) with its ``kept``.

    Bounds are broadcast if they are few, else both sides are shuffled by
    language and source, which Spark splits where one source is large.
    """
    bounds = written(bounds, "thresholds")
    few = bounds.count() <= BROADCAST_ROWS
    b = bounds.select(F.col("lang").alias("_b_lang"), F.col("source").alias("_b_source"), F.struct(*bounds.columns[2:]).alias("_b"))
    out = measured.join(F.broadcast(b) if few else b, measured["lang"].eqNullSafe(b["_b_lang"]) & measured["source"].eqNullSafe(b["_b_source"]), "left")

    def verdict(v: Column) -> Column:
        fine = ~base_failed(v["m"])
        for name, value in metrics(v["m"]).items():
            fine &= F.coalesce(bin_of(value) <= v["b"][f"{name}_high"], F.lit(True))
            if RULES[name][0] is not None:
                fine &= F.coalesce(bin_of(value) >= v["b"][f"{name}_low"], F.lit(True))
        return fine

    # one expression over both sides: split up, its parts would go below the join and measure each text again
    return out.withColumn("kept", let(F.struct(out["m"].alias("m"), F.col("_b").alias("b")), verdict)).drop("_b_lang", "_b_source", "_b")


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base measures, base_failed and kept.

    The texts are read once: measures go to a written table, whose sketches
    give each language and source its thresholds (quartile fences, no fixed
    bounds), joined back for the verdict.  Null text has no words and fails the base rules; a
    null language or source is a group of its own; a null id stays null; ties
    and repeated rows are judged each on its own; extra columns are not read;
    an empty table gives none.
    """
    slim = docs.select(docs["doc_id"], docs["lang"], docs["source"], measures(docs["text"]).alias("m"))
    measured = written(slim, "measures")
    out = judged(measured, thresholds(sketches(measured)))
    m = F.col("m")
    return out.select(
        "doc_id", m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["n_dup_lines"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"), base_failed(m).alias("base_failed"), "kept", "lang", "source", m["n_lines"].alias("n_lines"),
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, all their columns as they were.

    The texts are measured once: whole rows are written with their measures,
    and read again for the verdict.  Nulls, ties, repeated rows, extra columns
    and empty tables as in ``quality_rules``.
    """
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["lang"].alias("lang"), docs["source"].alias("source"), measures(docs["text"]).alias("m"))
    measured = written(whole, "measured")
    return judged(measured, thresholds(sketches(measured.drop("row")))).where("kept").select("row.*")
