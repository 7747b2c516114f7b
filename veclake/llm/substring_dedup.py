"""Substring deduplication: windows of words that repeat, found level by level.

The first level looks at all windows of WINDOW words.  Those that repeat, and
they alone, are extended to twice their length where the window behind them
repeats too, and so on until none is left.  Texts are written once, dealt to
buckets by parcel, and never shuffled: only coded windows and bitmaps move.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import arrow, forget, scratch_root, shuffle_width, written
from .golomb import decode, encode

#: Words of a window that counts as repeated.
WINDOW = 13
#: Characters of the texts of one parcel.
PARCEL_CHARS = 4_000_000
#: Hash bits that find candidates, beyond those that number the windows: one in so many powers of two is a candidate by chance.
SPARE_BITS = 5
#: What a row of a parcel is.
DOCUMENT, FIRST, EXACT, ENTRIES, GONE, LONGEST = range(6)
_FIELDS = {"parcel": pa.int64(), "kind": pa.int32(), "n": pa.int32(), "starts": pa.binary(), "lengths": pa.binary(), "hashes": pa.binary(), "ids": pa.binary()}
_ROWS = "parcel long, kind int, n int, starts binary, lengths binary, hashes binary, ids binary"
_ASKED = {"parcel": pa.int64(), "bucket": pa.int32(), "n": pa.int32(), "codes": pa.binary(), "rest": pa.binary(), "base": pa.int64(), "least": pa.binary(), "more": pa.binary()}
_ASK = "parcel long, bucket int, n int, codes binary, rest binary, base long, least binary, more binary"
_FOUND = "parcel long, kind int, bucket int, first binary, second binary"


def words_of(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return (text or b"").split()


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def window_hashes(word: np.ndarray) -> np.ndarray:
    """Hash of the windows of 13 words that start at each word, by doubling."""
    two = pair(word[:-1], word[1:])
    four = pair(two[:-2], two[2:])
    eight = pair(four[:-4], four[4:])
    twelve = pair(eight[:-4], four[8:])
    return pair(twelve[:-1], word[12:])


def _windows(texts: list, parts: int = 2) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """64-bit hashes of the windows of all texts in a row, by one or two independent functions, the text of each and its place there."""
    hash_ = xxhash.xxh3_128_digest
    each = [words_of(t) for t in texts]
    n = np.fromiter(map(len, each), np.int64, len(each))
    word = np.frombuffer(b"".join([hash_(w) for ws in each for w in ws]), "<u8").reshape(-1, 2)
    if len(word) < WINDOW:
        return [np.zeros(0, np.uint64)] * parts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(each)), n)
    place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    at = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :])
    return [window_hashes(word[:, k].copy())[at] for k in range(parts)], doc[at], place[at]


def _table(rows: list[dict], fields: dict = _FIELDS) -> pa.Table:
    return pa.table({k: pa.array([r.get(k) for r in rows], t) for k, t in fields.items()})


def _runs(of: np.ndarray, place: np.ndarray) -> dict:
    """Places of texts, in order, as runs."""
    at = (of << 32) | place
    first = np.flatnonzero(np.r_[True, np.diff(at) != 1]) if len(at) else np.zeros(0, np.int64)
    return {"starts": at[first].astype("<i8").tobytes(), "lengths": np.diff(np.r_[first, len(at)]).astype("<u4").tobytes()}


def _unrun(row: dict) -> tuple[np.ndarray, np.ndarray]:
    starts, n = np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    at = np.repeat(starts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return at >> 32, at & 0xFFFFFFFF


class Codes:
    """The leading bits of hashes, dealt to buckets by ranges."""

    def __init__(self, bits: int, buckets: int):
        self.bits, self.buckets, self.span = bits, buckets, -(-(1 << bits) // buckets)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def parts(self, codes: np.ndarray):
        """(bucket, start, end) in sorted codes."""
        cuts = np.searchsorted(codes, np.arange(self.buckets + 1) * self.span).tolist()
        return [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]

    def coded(self, codes: np.ndarray, bucket: int) -> bytes:
        return encode(codes - bucket * self.span, self.span)

    def asking(self, parcel: int, hashes: np.ndarray, of: np.ndarray, ids: np.ndarray) -> list[dict]:
        """A row for each bucket: a parcel's distinct codes, and which of them texts of different ids have."""
        order = np.argsort(hashes)
        code, own = self.of(hashes[order]), ids[of[order]]
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        code = code[start]
        more = np.maximum.reduceat(own, start) != np.minimum.reduceat(own, start) if len(start) else np.zeros(0, bool)
        return [{"parcel": parcel, "bucket": k, "n": b - a, "codes": self.coded(code[a:b], k), "more": np.packbits(more[a:b]).tobytes()} for k, a, b in self.parts(code)]

    def answers(self, hashes: np.ndarray, found: list[dict]) -> np.ndarray:
        """Which of a parcel's hashes the buckets have marked."""
        order = np.argsort(hashes)
        code = self.of(hashes[order])
        new = np.r_[True, code[1:] != code[:-1]][: len(code)]
        flags, parts = np.zeros(int(new.sum()), bool), {k: (a, b) for k, a, b in self.parts(code[new])}
        for r in found:
            a, b = parts[r["bucket"]]
            flags[a:b] = np.unpackbits(np.frombuffer(r["first"], np.uint8), count=b - a)
        out = np.empty(len(code), bool)
        out[order] = flags[np.cumsum(new) - 1]
        return out


def _deal(batches):
    """(id, text) -> the documents of parcels, numbered in each."""
    parcel = TaskContext.get().partitionId() << 24
    for batch in batches:
        for a, b in slices(batch.column(1).to_pylist(), PARCEL_CHARS):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, parcel)), pa.array(np.arange(b - a, dtype=np.int32)), *batch.slice(a, b - a).columns], ["parcel", "at", "id", "text"])
            parcel += 1


def _send(codes: Codes):
    """A parcel's documents -> the codes of all their windows."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        (hashes,), of, _ = _windows(rows["text"].to_pylist(), 1)
        return _table(codes.asking(rows["parcel"][0].as_py(), hashes, of, rows["id"].to_numpy()), _ASKED)

    return run


def _find(codes: Codes, kind: int):
    """All parcels' codes of some buckets -> for each parcel a bitmap of those that another has too, or two ids of this one."""

    def run(batches):
        got: dict[int, list] = {}
        for batch in batches:
            for parcel, bucket, n, blob, more in zip(*(batch.column(c).to_pylist() for c in ("parcel", "bucket", "n", "codes", "more")), strict=True):
                got.setdefault(bucket, []).append((parcel, n, blob, more))
        for bucket, own in got.items():
            code = np.concatenate([decode(c, n, codes.span) for _, n, c, _ in own])
            more = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for _, n, _, m in own]).astype(bool)
            order = np.argsort(code, kind="stable")
            same = code[order][1:] == code[order][:-1]
            more[order[1:][same]] = more[order[:-1][same]] = True
            flags = np.split(more, np.cumsum([n for _, n, *_ in own])[:-1])
            yield _answer(kind, bucket, [p for p, *_ in own], flags, [None] * len(own))

    return run


def _answer(kind: int, bucket: int, parcels: list, first: list, second: list) -> pa.RecordBatch:
    bits = [pa.array([None if f is None else np.packbits(f).tobytes() for f in flags], pa.binary()) for flags in (first, second)]
    return pa.RecordBatch.from_arrays([pa.array(parcels, pa.int64()), pa.array([kind] * len(parcels), pa.int32()), pa.array([bucket] * len(parcels), pa.int32()), *bits], ["parcel", "kind", "bucket", "first", "second"])


def _candidates(codes: Codes, rows: pa.Table, found: list[dict]) -> tuple:
    """A parcel's windows that the first answers have marked, distinct hashes of them in order, and the place of each in these."""
    rows = rows.sort_by("at")
    (a, b), of, place = _windows(rows["text"].to_pylist())
    keep = np.flatnonzero(codes.answers(a, [r for r in found if r["kind"] == FIRST]))
    a, b, of, place = a[keep], b[keep] >> np.uint64(32), of[keep], place[keep]
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])][: len(a)]
    rank = np.empty(len(a), np.int64)
    rank[order] = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    return a, of, place, rank, order, start, a[order][start], b[order][start], rows["id"].to_numpy()


def _ask_exactly(codes: Codes):
    """A parcel's documents and the first answers -> the 96-bit hashes of its candidates for each bucket, with the least id that has each here."""
    wide = Codes(62, codes.buckets)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows or not found.num_rows:
            return _table([], _ASKED)
        _, of, _, _, order, start, a, b, ids = _candidates(codes, rows, found.to_pylist())
        if not len(a):
            return _table([], _ASKED)
        own = ids[of[order]]
        least = np.minimum.reduceat(own, start)
        more, base = np.maximum.reduceat(own, start) != least, int(ids.min())
        above = (least - base).astype(np.uint64)
        # 62 bits are coded, the last two go with the 32 of the other hash
        code, rest = wide.of(a), (a & np.uint64(3)) << np.uint64(32) | b
        kind = "<u4" if int(above.max()) < 1 << 32 else "<u8"
        out = []
        for k, x, y in wide.parts(code):
            out.append({"parcel": rows["parcel"][0].as_py(), "bucket": k, "n": y - x, "codes": wide.coded(code[x:y], k), "rest": rest[x:y].view("u1").reshape(-1, 8)[:, :5].tobytes(), "base": base, "least": above[x:y].astype(kind).tobytes(), "more": np.packbits(more[x:y]).tobytes()})
        return _table(out, _ASKED)

    return run


def _find_exactly(codes: Codes):
    """Parcels' hashes of some buckets -> bitmaps: first, a smaller id than the least here has it; second, another id has it."""
    wide = Codes(62, codes.buckets)

    def run(batches):
        got: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                got.setdefault(r["bucket"], []).append(r)
        for bucket, own in got.items():
            n = [r["n"] for r in own]
            code = np.concatenate([decode(r["codes"], r["n"], wide.span) for r in own])
            rest = np.zeros((len(code), 8), "u1")
            rest[:, :5] = np.frombuffer(b"".join(r["rest"] for r in own), "u1").reshape(-1, 5)
            rest = rest.view("<u8")[:, 0]
            least = np.concatenate([np.frombuffer(r["least"], "<u4" if len(r["least"]) == 4 * r["n"] else "<u8").astype(np.int64) + r["base"] for r in own])
            more = np.concatenate([np.unpackbits(np.frombuffer(r["more"], np.uint8), count=r["n"]) for r in own]).astype(bool)
            order = np.lexsort((rest, code))
            new = np.r_[True, (code[order][1:] != code[order][:-1]) | (rest[order][1:] != rest[order][:-1])]
            start, group = np.flatnonzero(new), np.empty(len(code), np.int64)
            group[order] = np.cumsum(new) - 1
            low, high = np.minimum.reduceat(least[order], start)[group], np.maximum.reduceat(least[order], start)[group]
            some = np.logical_or.reduceat(more[order], start)[group]
            ends = np.cumsum(n)[:-1]
            yield _answer(EXACT, bucket, [r["parcel"] for r in own], np.split(low < least, ends), np.split((low < high) | some, ends))

    return run


def _next_level(parcel: int, hashes: np.ndarray, of: np.ndarray, place: np.ndarray, ids: np.ndarray, length: int) -> list[dict]:
    """Rows of a parcel's repeated windows of a length: the texts that have one, and those windows of twice the length whose halves both repeat."""
    if not len(hashes):
        return []
    texts = np.unique(of)
    out = [{"parcel": parcel, "kind": LONGEST, "n": length, **_runs(texts, np.zeros_like(texts))}]
    at = (of << 32) | place
    second = np.minimum(np.searchsorted(at, at + length), len(at) - 1)
    both = np.flatnonzero(at[second] == at + length)
    if len(both):
        out.append({"parcel": parcel, "kind": ENTRIES, "hashes": pair(hashes[both], hashes[second[both]]).tobytes(), "ids": ids.astype("<i8").tobytes(), **_runs(of[both], place[both])})
    return out


def _settle(codes: Codes):
    """A parcel's documents and all answers of the first length -> the windows to remove, and the next level."""
    wide = Codes(62, codes.buckets)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows or not found.num_rows:
            return _table([])
        parcel, told = rows["parcel"][0].as_py(), found.to_pylist()
        hashes, of, place, rank, _, _, a, _, ids = _candidates(codes, rows, told)
        if not len(hashes):
            return _table([])
        below, repeated = np.zeros(len(a), bool), np.zeros(len(a), bool)
        parts = {k: (x, y) for k, x, y in wide.parts(wide.of(a))}
        for r in told:
            if r["kind"] == EXACT:
                x, y = parts[r["bucket"]]
                below[x:y], repeated[x:y] = (np.unpackbits(np.frombuffer(r[c], np.uint8), count=y - x) for c in ("first", "second"))
        least = np.full(len(a), np.iinfo(np.int64).max)
        np.minimum.at(least, rank, ids[of])
        gone = below[rank] | (ids[of] > least[rank])
        keep = np.flatnonzero(repeated[rank])
        return _table([{"parcel": parcel, "kind": GONE, **_runs(of[gone], place[gone])}, *_next_level(parcel, hashes[keep], of[keep], place[keep], ids, WINDOW)])

    return run


def _held(row: dict) -> tuple:
    return np.frombuffer(row["hashes"], "<u8"), *_unrun(row), np.frombuffer(row["ids"], "<i8")


def _ask(codes: Codes):
    """Windows of a later level -> their codes."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hashes, of, _, ids = _held(row)
                yield from _table(codes.asking(row["parcel"], hashes, of, ids), _ASKED).to_batches()

    return run


def _extend(codes: Codes, length: int):
    """A parcel's windows of a length and the answers -> the next level of those that repeat."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows or not found.num_rows:
            return _table([])
        row = rows.to_pylist()[0]
        hashes, of, place, ids = _held(row)
        keep = np.flatnonzero(codes.answers(hashes, found.to_pylist()))
        return _table(_next_level(row["parcel"], hashes[keep], of[keep], place[keep], ids, length))

    return run


def _finish(with_text: bool):
    """A parcel's documents and what was found of them -> the result's rows."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        texts, n = rows["text"].to_pylist(), rows.num_rows
        longest, gone = np.zeros(n, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for r in found.to_pylist():
            if r["kind"] == GONE:
                gone = _unrun(r)
            else:
                docs = _unrun(r)[0]
                longest[docs] = np.maximum(longest[docs], r["n"])
        at, out = np.searchsorted(gone[0], np.arange(n + 1)), []
        for k, t in enumerate(texts):
            kept = ws = words_of(t)
            places = gone[1][at[k] : at[k + 1]]
            if len(places):
                near = np.zeros(len(ws) + 1, np.int64)
                np.add.at(near, places, 1)
                np.add.at(near, places + WINDOW, -1)
                kept = [w for w, g in zip(ws, (np.cumsum(near[:-1]) > 0).tolist(), strict=True) if not g]
            text = b" ".join(kept)
            out.append((len(ws), len(ws) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if with_text and len(places) else None))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"id": rows["id"], "n_words": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()), "kept_sha256": pa.array(columns[2], pa.string()), "longest_repeat": pa.array(longest), "kept_text": pa.array(columns[3], pa.string())})

    return run


class _Parcels:
    """Tables of parcels in the shared folder, dealt to buckets, so that joining them by parcel moves the smaller side alone."""

    def __init__(self, spark):
        self.spark, self.width = spark, shuffle_width(spark)

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        name = f"parcels_{uuid.uuid4().hex}"
        path = f"{scratch_root(self.spark).rstrip('/')}/{self.spark.sparkContext.applicationId}/{name}"
        df.write.bucketBy(self.width, "parcel").format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
        return self.spark.table(name), name

    def drop(self, name: str) -> None:
        """Forget a table that nothing reads any more, files included."""
        path = f"{scratch_root(self.spark).rstrip('/')}/{self.spark.sparkContext.applicationId}/{name}"
        self.spark.sql(f"DROP TABLE {name}")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def told(self, asked: DataFrame, run) -> DataFrame:
        """What the buckets answer."""
        return written(arrow(asked.repartition(self.width, "bucket"), run, _FOUND), "answers")

    def joined(self, rows: DataFrame, found: DataFrame, run, schema: str = _ROWS) -> DataFrame:
        """Each parcel's own rows beside what was found of it."""
        return rows.groupBy("parcel").cogroup(found.groupBy("parcel")).applyInArrow(run, schema)


def substring_dedup(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, longest_repeat (and kept_text, where words went).

    A word goes if a window of 13 words that covers it also starts in a
    document with a smaller id; windows are judged on the input.
    ``longest_repeat`` is the length of the last level, 13, 26, 52 and so on,
    at which a window of the document stands under another id too; 0 without.

    1. Each task writes its texts in parcels, which send each bucket the coded
       hashes of their windows, and get a bitmap of the repeated back.
    2. Those windows alone are told equal by 96 bits and by the least id.
    3. Windows that repeat, with the window right behind them, make windows of
       twice the length, which are asked for like the first, until none is left.

    Every parcel sends a hash once, so a passage that most documents share
    costs one entry for each parcel; no text moves, whatever the input.

    Ids are whole numbers.  Null text has no words.  A null id counts as the
    smallest; rows with one id do not remove each other's words, whether
    repeated or not; extra columns are not read; an empty table gives none.
    """
    parcels = _Parcels(docs.sparkSession)
    slim = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("id"), F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8").alias("text"))
    texts, _ = parcels.write(arrow(slim, _deal, "parcel long, at int, id long, text binary"))
    # every window has a word of a byte and a blank at least
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    codes = Codes(min(62, max(20, (size // 2).bit_length() - 2 + SPARE_BITS)), parcels.width)
    first = parcels.told(texts.groupBy("parcel").applyInArrow(_send(codes), _ASK), _find(codes, FIRST))
    exact = parcels.told(texts.groupBy("parcel").cogroup(first.groupBy("parcel")).applyInArrow(_ask_exactly(codes), _ASK), _find_exactly(codes))
    table, name = parcels.write(parcels.joined(texts, first.union(exact), _settle(codes)))
    length, found = WINDOW, None
    while True:
        told = written(table.where(F.col("kind").isin(GONE, LONGEST)).select("parcel", "kind", "n", "starts", "lengths"), "repeats")
        found = told if found is None else found.union(told)
        entries = table.where(f"kind = {ENTRIES}")
        if entries.isEmpty():
            parcels.drop(name)
            break
        length *= 2
        answers = parcels.told(arrow(entries, _ask(codes), _ASK), _find(codes, ENTRIES))
        old = name
        table, name = parcels.write(parcels.joined(entries, answers, _extend(codes, length)))
        parcels.drop(old)
        forget(answers)
    out = parcels.joined(texts, found, _finish(with_text), "id long, n_words long, n_removed long, kept_sha256 string, longest_repeat long, kept_text string")
    return out.select(F.nullif("id", F.lit(-(1 << 63))).alias(id_col), "n_words", "n_removed", "kept_sha256", "longest_repeat", *["kept_text"] * with_text)
