"""Exact deduplication by a Golomb-coded exchange of fingerprints."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, keyed, shuffle_width, without, written
from .golomb import decode, encode

#: Fingerprint bits in the exchange.  Of n documents a share n / 2**BITS are suspects without a copy, which verification clears.
BITS = 40
#: Rows of a task that go into one parcel: bounds a sender's memory.
PARCEL_ROWS = 200_000
#: Cells of the bitmaps for each repeated fingerprint: one text in so many moves for nothing.
CELLS = 16
#: Bytes of bitmaps that are broadcast at once; more are sent in rounds, each for a range of fingerprints and one reading of the texts.
#: Where even the last round would not do, cells are coarser, and more texts move.
BITMAP_BYTES, ROUNDS = 128 << 20, 4
#: Tasks of a group's first round, so that a text that most tasks have is not gathered from all of them at once.
SALTS = 64
#: Groups that are broadcast to their members, about 100 bytes each; more are joined by a shuffle.
BROADCAST_GROUPS = 500_000


def normal(text: str | None) -> bytes:
    """The bytes that are compared: UTF-8 with A-Z in lower case; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def prints_of(shas: np.ndarray) -> np.ndarray:
    """The leading BITS of digests, 32 bytes a row."""
    return (shas[:, :8].copy().view(">u8")[:, 0] >> np.uint64(64 - BITS)).astype(np.int64)


def _send(owners: int):
    """Texts -> one row for each parcel and owner: sorted distinct fingerprints, coded, and which of them this parcel has twice."""
    span = (1 << BITS) // owners

    def rows(digests):
        shas = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
        prints, n = np.unique(prints_of(shas), return_counts=True)
        cuts = np.searchsorted(prints, np.arange(owners + 1) * span).tolist()
        out = [(o, b - a, encode(prints[a:b] - o * span, span), np.packbits(n[a:b] > 1).tobytes()) for o, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["owner", "n", "code", "twice"])

    def run(batches):
        digests = []
        for batch in batches:
            digests += [hashlib.sha256(normal(t)).digest() for t in batch.column(0).to_pylist()]
            if len(digests) >= PARCEL_ROWS:
                yield rows(digests)
                digests = []
        if digests:
            yield rows(digests)

    return run


def _find(owners: int):
    """All parcels of some owners -> the fingerprints of each owner's range that the corpus has twice, coded."""
    span = (1 << BITS) // owners

    def run(batches):
        got = defaultdict(list)
        for batch in batches:
            for owner, n, code, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got[owner].append((n, code, twice))
        for owner, own in got.items():
            every = np.concatenate([decode(code, n, span) for n, code, _ in own])
            twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for n, _, t in own])
            value, at, n = np.unique(every, return_inverse=True, return_counts=True)
            value = value[(n > 1) | (np.bincount(at, twice) > 0)]
            if len(value):
                yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int32()), pa.array([len(value)], pa.int64()), pa.array([encode(value, span)], pa.binary())], ["owner", "n", "code"])

    return run


def _bitmaps(owners: int, cells: int):
    """Repeated fingerprints of each owner -> a bitmap over the cells of its range."""
    span, width = (1 << BITS) // owners, (1 << BITS) // cells

    def run(batches):
        for batch in batches:
            for owner, n, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                marked = np.zeros(cells // owners, bool)
                marked[decode(code, n, span) // width] = True
                yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int32()), pa.array([np.packbits(marked).tobytes()], pa.binary())], ["owner", "bitmap"])

    return run


def _read(shared, low: int, high: int, cells: int):
    """Documents -> (id, sha, suspect, bytes) of those with a fingerprint in the range; the bytes of suspects only."""
    width = (1 << BITS) // cells

    def run(batches):
        marked = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            texts = [normal(t) for t in batch.column(1).to_pylist()]
            if not texts:
                continue
            digests = [hashlib.sha256(t).digest() for t in texts]
            prints = prints_of(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32))
            own = np.flatnonzero((prints >= low) & (prints < high))
            suspect = marked[(prints[own] - low) // width]
            some = own.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own)), pa.array([digests[j] for j in some], pa.binary()), pa.array(suspect), pa.array([texts[j] if s else None for j, s in zip(some, suspect.tolist(), strict=True)], pa.binary())],
                ["id", "sha", "suspect", "bytes"],
            )

    return run


def _told(slim: DataFrame) -> DataFrame:
    """(id, sha, suspect, bytes) of every document: the exchange, and a second reading that knows its outcome."""
    spark, kind = slim.sparkSession, dict(slim.dtypes)["id"]
    owners = 1 << max(3, (shuffle_width(spark) - 1).bit_length())
    sent = arrow(slim.select("text"), _send(owners), "owner int, n int, code binary, twice binary")
    found = written(arrow(sent.repartition(owners, "owner"), _find(owners), "owner int, n long, code binary"), "repeated")
    n = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cells = max(owners * 8, min(1 << (CELLS * n).bit_length(), ROUNDS * BITMAP_BYTES * 8, 1 << BITS))
    rounds = min(max(1, cells // 8 // BITMAP_BYTES), owners)
    each, out = owners // rounds, None
    for r in range(rounds):
        mine = np.zeros((each, cells // owners // 8), np.uint8)
        answers = arrow(found.where(F.col("owner").between(r * each, (r + 1) * each - 1)), _bitmaps(owners, cells), "owner int, bitmap binary").toArrow()
        for owner, bitmap in zip(answers["owner"].to_pylist(), answers["bitmap"].to_pylist(), strict=True):
            mine[owner - r * each] = np.frombuffer(bitmap, np.uint8)
        shared = spark.sparkContext.broadcast(mine.ravel())
        part = arrow(slim, _read(shared, (r * each) * ((1 << BITS) // owners), (r + 1) * each * ((1 << BITS) // owners), cells), f"id {kind}, sha binary, suspect boolean, bytes binary")
        out = part if out is None else out.union(part)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    1. Tasks send each owner of a fingerprint range their sorted fingerprints,
       Golomb-coded.  2. Owners answer with bitmaps over their ranges, which
       mark what the corpus has twice.  3. Tasks read the texts again; those
       that are not marked are alone and stay where they are.  Only the texts
       of suspects move, and are grouped by their bytes: in each task, then by
       SALTS parts of the tasks, then whole.

    The bitmaps have CELLS bits or more for each repeated fingerprint.  More
    than BITMAP_BYTES of them are broadcast in up to ROUNDS rounds, one range
    of fingerprints and one reading of the texts after the other; beyond that
    a bit stands for more fingerprints, and more texts move for nothing.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty.  The largest id of a group stays.  Rows that repeat an id and its
    text are one document: each counts in group_size and all are kept.  A null
    id is smaller than any other; in a group of null ids all rows are kept.
    Extra columns are not read; an empty table gives none.
    """
    told = written(_told(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))), "told")
    salted = told.where("suspect").withColumn("salt", F.spark_partition_id() % SALTS)
    parts = salted.groupBy("sha", "bytes", "salt").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    # the bytes decide; the digest of the bytes then names the group
    groups = parts.groupBy("sha", "bytes").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).where("group_size > 1")
    groups = written(groups.select(F.col("sha").alias("_sha"), "keep_id", "group_size"), "groups")
    few = groups.count() <= BROADCAST_GROUPS
    members = told.where("suspect").select("id", "sha")
    members = members.join(F.broadcast(groups) if few else groups, members["sha"] == groups["_sha"], "left").select("id", "sha", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    out = told.where("not suspect").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).union(members)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The documents that exact deduplication keeps, all their columns as they were.

    Rows that repeat id and text stay together; of rows that share an id but
    not the case of their letters one stays.  Nulls, extra columns and empty
    tables as in ``exact_dedup``.
    """
    return without(docs, exact_dedup(keyed(docs)).where("not kept"))
