"""URL filter: rules, and a character language-model ratio where no rule fits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, ascii_lower, written

#: Characters (bytes) of context at most; every order from 0 up is used.
ORDER = 4
#: Weight of the next shorter context in counts.
BACK_OFF = 4.0
#: One labelled URL in so many sets the threshold for a model of the others; the final model counts all.
CALIBRATION = 5
#: Bins of the score histogram, which spans -SPAN to SPAN nats a character.
BINS, SPAN = 2001, 5.0
#: Counts of the model that are broadcast at once, 24 bytes each; a larger model is sent in slices.
MODEL_KEYS = 4_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule, null where none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(action)
    return rule, action


def _grams(urls: list) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the keys of (context, byte) and of the context, and the URL of each place.

    Each URL is its bytes with zeros before, and a zero as its end.  A key has
    the bytes themselves, the order and the kind: no two share one.
    """
    raw = [(u or "").encode("utf-8", "surrogatepass") for u in urls]
    data = np.frombuffer(b"".join(bytes(ORDER) + r + b"\0" for r in raw) or b"", np.uint8).astype(np.int64)
    lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    ends = np.cumsum(lengths + ORDER)
    of = np.repeat(np.arange(len(raw)), lengths)
    at = np.arange(int(lengths.sum())) + np.repeat(ends - np.cumsum(lengths), lengths)
    pairs, contexts, context = [], [], np.zeros(len(at), np.int64)
    for k in range(ORDER + 1):
        if k:
            context = context | (data[at - k] << 8 * k)
        tag = 2 * k << 8 * (ORDER + 1)
        pairs.append((context | data[at]) + tag)
        contexts.append(context + tag + (1 << 8 * (ORDER + 1)))
    return pairs, contexts, of


def _count(batches):
    """(accepted, held, url) -> (key, class, n): a task's counts; class is 2 * held + accepted."""
    for batch in batches:
        class_ = 2 * np.array(batch.column(1).to_pylist(), np.int64) + np.array(batch.column(0).to_pylist(), np.int64)
        urls = batch.column(2).to_pylist()
        for c in np.unique(class_).tolist():
            pairs, contexts, _ = _grams([urls[k] for k in np.flatnonzero(class_ == c)])
            key, n = np.unique(np.concatenate([*pairs, *contexts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), c)), pa.array(n.astype(np.int64))], ["key", "class", "n"])


def slice_of(before: np.ndarray, slices: int) -> np.ndarray:
    """The slice of the model for a place in a URL, by the two bytes before it."""
    return (before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % slices


def ratio(model: tuple[np.ndarray, np.ndarray], urls: list, part: int = 0, slices: int = 1) -> np.ndarray:
    """Accepted minus rejected log-likelihood of each URL (its end included), summed over the places of one slice.

    The model: sorted keys, and a row of counts for each class.
    """
    keys, counts = model
    pairs, contexts, of = _grams(urls)
    mine = np.flatnonzero(slice_of(contexts[2] >> 8 & 0xFFFF, slices) == part)
    of = of[mine]

    def seen(key: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros((2, len(key)))
        own, back = np.unique(key, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        return np.where(keys[at] == own, counts[:, at], 0)[:, back]

    p = np.full((2, len(of)), 1.0 / 256)
    for k in range(ORDER + 1):
        p = (seen(pairs[k][mine]) + BACK_OFF * p) / (seen(contexts[k][mine]) + BACK_OFF)
    total = np.log(p)
    return np.bincount(of, total[1] - total[0], len(urls))


def counted(labelled: DataFrame) -> DataFrame:
    """(key, n0 to n3): how often each context, and each byte after it, stands in (accepted, held, url) rows, by 2 * held + accepted."""
    sums = [F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(4)]
    return written(arrow(labelled.select("accepted", "held", "url"), _count, "key long, class long, n long").groupBy("key").agg(*sums), "url-model")


def scored(rows: DataFrame, counts: DataFrame, held_too: bool) -> DataFrame:
    """``rows``, which have a url, with the score of each: the length-normalised log-likelihood ratio.

    Every place of a URL needs the counts of one slice only, so a model of any
    size is broadcast slice by slice, and rows add them up as they pass.
    """
    slices = max(1, -(-counts.count() // MODEL_KEYS))
    columns, kinds = rows.columns, ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    # contexts of one byte or none belong to all slices
    order = F.shiftright("key", 8 * (ORDER + 1) + 1)
    before = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF).cast("long"))
    out = rows.withColumn("score", F.lit(0.0))
    for part in range(slices):
        mine = counts if slices == 1 else counts.where((order < 2) | (_slice(before, slices) == part))
        table = mine.toArrow()
        keys = table["key"].to_numpy()
        by = np.argsort(keys)
        n = [table[f"n{c}"].to_numpy()[by] for c in range(4)]
        model = keys[by], np.stack([n[0] + held_too * n[2], n[1] + held_too * n[3]])
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def add(batches, shared=shared, part=part):
            for batch in batches:
                more = ratio(shared.value, batch.column(columns.index("url")).to_pylist(), part, slices)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(batch.column(len(columns)).to_numpy() + more)], batch.schema.names)

        out = arrow(out, add, f"{kinds}, score double")
    length = F.coalesce(F.octet_length("url"), F.lit(0)) + 1
    return out.withColumn("score", F.col("score") / length)


def _slice(before: Column, slices: int) -> Column:
    """``slice_of`` as an expression: the product's upper bits, put together from halves that do not overflow."""
    low, high = 0x7F4A7C15, 0x9E3779B9
    carry = F.shiftright(before * F.lit(low).cast("long"), 32)
    upper = (before * F.lit(high).cast("long") + carry).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.shiftright(upper, 1) % slices


def fit(labelled: DataFrame) -> tuple[DataFrame, float]:
    """Counts and threshold from all (accepted, url) rows.

    Counts of the real contexts are summed over all rows of the corpus.  The
    threshold separates the held-out URLs best under a model without them;
    what comes to the driver is a histogram of BINS scores a class.  Without a
    held-out URL of each class it is 0, and without a rejected URL nothing is
    below it.
    """
    rows = labelled.select("accepted", (F.crc32(F.encode("url", "UTF-8")) % CALIBRATION == 0).alias("held"), "url")
    counts = counted(rows)
    place = F.rint((F.col("score") / SPAN + 1) / 2 * (BINS - 1))
    bins = F.least(F.greatest(place, F.lit(0.0)), F.lit(float(BINS - 1))).cast("int")
    seen = np.zeros((2, BINS))
    for row in scored(rows.where("held"), counts, False).groupBy("accepted", bins.alias("bin")).count().collect():
        seen[int(row["accepted"]), row["bin"]] = row["count"]
    if not seen.sum(1).all():
        none = counts.where("n0 + n2 > 0").isEmpty()
        return counts, -np.inf if none else 0.0
    # a threshold before bin t rejects the bins below it
    share = seen / seen.sum(1, keepdims=True)
    below = np.c_[np.zeros(2), np.cumsum(share, 1)]
    error = below[1] + 1 - below[0]
    best = np.flatnonzero(error <= error.min() + 1e-12)
    cut = best[len(best) // 2]
    return counts, ((cut - 0.5) / (BINS - 1) * 2 - 1) * SPAN


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score.

    The longest rule that fits a host or its parent domain, and the start of
    its path, decides.  Other URLs are blocked if their length-normalised
    log-likelihood ratio between a model of accepted and one of rejected URLs
    (those that rules decide) is below the threshold that separates held-out
    labelled URLs best: 0 if one class has none held out.  Without any
    rejected URL to learn from all are allowed.

    A null URL or one without ``://`` has an empty host and path, fits no rule
    and is scored by its characters (null: as empty).  Null ids, ties and
    repeated rows pass through, one row each; extra columns are not read; an
    empty table gives none.
    """
    slim = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
    host, path = host_and_path(F.col("url"))
    split = slim.select("id", "url", host.alias("host"), path.alias("path"))
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", rule.alias("rule"), action.alias("action"))
    counts, threshold = fit(ruled.where("action is not null").select((F.col("action") == "allow").alias("accepted"), "url"))
    out = scored(ruled, counts, True)
    verdict = F.coalesce("action", F.when(F.col("score") < threshold, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
