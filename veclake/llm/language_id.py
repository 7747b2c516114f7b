"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import arrow, shuffle_width, written

#: Lengths of the n-grams, buckets they are hashed to, buckets that travel together.
LENGTHS, BUCKETS, BLOCK = (1, 2, 3), 1 << 15, 256
#: Added to each count.
SMOOTHING = 0.5
#: Languages whose matrix is collected and broadcast at once (4 bytes * BUCKETS each); more are scored block by block.
AT_ONCE = 500
#: Languages that a task counts at once (8 bytes * BUCKETS each).
COUNTED = 200
#: Characters that are worked on at once.
CHARS = 1_000_000

_letter = regex.compile(r"\p{L}").search
_plain = np.arange(128, dtype=np.uint64)
_plain[[c for c in range(128) if not chr(c).isalpha()]] = 32


def buckets_of(texts: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each n-gram length the bucket of every n-gram, and the texts' bounds.

    Characters are lower-cased; ASCII ones that are no letters count as a space.
    """
    raw = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
    code = np.frombuffer(b"".join(raw), "<u4").astype(np.uint64)
    small = code < 128
    code[small] = _plain[code[small]]
    out, bounds, key = [], [], np.zeros(len(code), np.uint64)
    of = np.repeat(np.arange(len(texts)), lengths)
    for n in LENGTHS:
        size = max(len(code) - n + 1, 0)
        key = key[:size] * np.uint64(0x100000001B3) + code[n - 1 :][:size]
        mixed = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(49)).astype(np.int32)
        own = of[:size] == of[n - 1 :][:size] if size else np.zeros(0, bool)
        out.append(bucket[own])
        bounds.append(np.maximum(lengths - n + 1, 0))
    return out, bounds


def _count(batches):
    """(lang, text) -> (lang, block, docs, counts): a task's sums."""
    total: dict = {}
    docs: dict = {}

    def sums():
        rows = [(x, k, docs[x] if k == 0 else 0, v[k * BLOCK : (k + 1) * BLOCK].tobytes()) for x, v in total.items() for k in range(BUCKETS // BLOCK)]
        total.clear()
        docs.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["lang", "block", "docs", "counts"])

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices(texts, CHARS):
            grams, bounds = buckets_of(texts[a:b])
            names = {}
            of = np.array([names.setdefault(x, len(names)) for x in langs[a:b]])
            for x, k in names.items():
                docs[x] = docs.get(x, 0) + int((of == k).sum())
                mine = total.setdefault(x, np.zeros(BUCKETS, np.int64))
                for g, n in zip(grams, bounds, strict=True):
                    mine += np.bincount(g[np.repeat(of == k, n)], minlength=BUCKETS)
                if len(total) >= COUNTED:
                    yield sums()
    if total:
        yield sums()


def _merge(batches):
    total: dict = {}
    for batch in batches:
        for lang, block, docs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = total.setdefault((lang, block), [0, np.zeros(BLOCK, np.int64)])
            held[0] += docs
            held[1] += np.frombuffer(counts, np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total], pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1].tobytes() for v in total.values()], pa.binary())], ["lang", "block", "docs", "counts"])


def fit(labelled: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(lang, block, docs, counts) sums over all (lang, text) rows, written, and the documents of each language."""
    schema = "lang string, block int, docs long, counts binary"
    sums = arrow(labelled.select("lang", "text"), _count, schema).repartition(shuffle_width(labelled.sparkSession), "lang", "block")
    sums = written(arrow(sums, _merge, schema), "language-counts")
    rows = sums.where("block = 0").select("lang", "docs").toArrow()
    return sums, dict(sorted(zip(rows["lang"].to_pylist(), rows["docs"].to_pylist(), strict=True)))


def matrix_of(sums: DataFrame, names: list[str]) -> np.ndarray:
    """Log-probabilities (language, bucket) of some languages."""
    rows = sums.where(F.col("lang").isin(names)).toArrow()
    at, counts = {x: k for k, x in enumerate(names)}, np.zeros((len(names), BUCKETS))
    for lang, block, c in zip(*(rows[x].to_pylist() for x in ("lang", "block", "counts")), strict=True):
        counts[at[lang], block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(c, np.int64)
    return np.log((counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)).astype(np.float32)


def logits(matrix: np.ndarray, prior: np.ndarray, texts: list) -> np.ndarray:
    """(text, language): log-probability of the language and the text together."""
    out = np.tile(prior, (len(texts), 1))
    for a, b in slices(texts, CHARS):
        grams, bounds = buckets_of(texts[a:b])
        for g, n in zip(grams, bounds, strict=True):
            some = np.flatnonzero(n)
            if len(some):
                start = (np.cumsum(n) - n)[some]
                for k in range(len(prior)):
                    out[a + some, k] += np.add.reduceat(matrix[k][g], start, dtype=np.float64)
    return out


def language_id(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    The model learns from the whole texts of all rows that are not held out
    and have a language; only the text is an input of a prediction.  Tasks sum
    their n-gram counts; blocks of buckets are summed apart, so that a
    language with most of the texts is not one task's work.

    ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned.  Ties go to the language that sorts first.  A null id stays null;
    repeated rows count and are answered each; extra columns are not read; an
    empty table gives none.
    """
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"), held_out.alias("held_out"))
    sums, learned = fit(slim.where("not held_out and lang is not null and text is not null").select("lang", "text"))
    names, total = list(learned), max(sum(learned.values()), 1)
    kind = dict(slim.dtypes)["id"]
    # the best language so far, its log-probability, and the sum of all by its own
    out = slim.select("id", "held_out", "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("sum"))
    for at in range(0, len(names), AT_ONCE):
        part = names[at : at + AT_ONCE]
        shared = docs.sparkSession.sparkContext.broadcast((part, matrix_of(sums, part), np.log([learned[x] / total for x in part])))

        last = at + AT_ONCE >= len(names)
        passed = ["id", "held_out"] if last else ["id", "held_out", "text"]  # the text goes on to the next block only

        def run(batches, shared=shared, passed=passed):
            names, matrix, prior = shared.value
            for batch in batches:
                texts, langs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                top, total = batch.column(4).to_numpy(), batch.column(5).to_numpy()
                x = logits(matrix, prior, texts)
                best = x.argmax(1)
                mine = x[np.arange(len(texts)), best]
                high = np.maximum(top, mine)
                total = total * np.exp(top - high) + np.exp(x - high[:, None]).sum(1)
                langs = [names[k] if m > t else old for k, m, t, old in zip(best.tolist(), mine.tolist(), top.tolist(), langs, strict=True)]
                langs = ["und" if t is None or not _letter(t) else x for t, x in zip(texts, langs, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], pa.array(langs, pa.string()), pa.array(high), pa.array(total)], [*passed, "lang_pred", "top", "sum"])

        out = arrow(out, run, f"id {kind}, held_out boolean, {'' if last else 'text string, '}lang_pred string, top double, sum double")
    lang = F.coalesce("lang_pred", F.lit("und"))
    return out.select(F.col("id").alias(id_col), "held_out", lang.alias("lang_pred"), F.when(lang == "und", 0.0).otherwise(1 / F.col("sum")).alias("score"))


def by_id(id_: Column, of: int = 4, part: int = 2) -> Column:
    """True where the CRC-32 of the id as text leaves ``part``; a null id counts as empty."""
    return F.crc32(F.encode(F.coalesce(id_.cast("string"), F.lit("")), "UTF-8")) % of == part
