"""Cost-balanced packing of documents into fixed-length training sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, slices
from .common import arrow

#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, attention staying inside the piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Sequences that are filled together; with their pieces they are all that a task holds.
BLOCK = 256


def balance(lengths: np.ndarray, sequences: int, size: int) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of pieces that fill ``sequences`` to ``size`` each.

    Documents go in descending order, each to the lowest-cost sequence that
    has room for all of it.  One that fits nowhere is cut: its first part
    fills the lowest-cost sequence that has any room, its rest goes on.  What
    no sequence had room for is not in the result.
    """
    room, cost, out = np.full(sequences, size), np.zeros(sequences), []
    for d in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[d])
        while left:
            fits = room >= left
            s = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
            n = min(left, int(room[s]))
            if not n:
                break
            out.append((d, start, n, s))
            room[s] -= n
            cost[s] += LINEAR * n + QUADRATIC * n * n
            start, left = start + n, left - n
    return out


class Packer:
    """Fills sequences from a stream of documents, block by block."""

    def __init__(self, size: int, first_id: int):
        self.size, self.next = size, first_id
        self.docs: list[tuple] = []  # (id, its ids, tokens before)
        self.tokens = 0

    def add(self, key, ids: bytes):
        total, start, whole = len(ids) // 4, 0, self.size
        while total - start > whole * BLOCK:  # more than a block holds: whole sequences of its own, one by one
            part = ids[4 * start : 4 * (start + whole)]
            yield key, start, whole, zlib.crc32(part), total, self.next, 0, part
            start, self.next = start + whole, self.next + 1
        self.docs.append((key, ids[4 * start :], start, total))
        self.tokens += total - start
        if self.tokens >= self.size * BLOCK:
            yield from self._fill(self.tokens // self.size, self.size)

    def rest(self):
        """What is left at the end: full sequences, then one for each power of two in the remainder."""
        if n := self.tokens // self.size:
            yield from self._fill(n, self.size)
        power = 1 << (self.size - 1).bit_length()
        while self.tokens:
            power >>= 1
            if self.tokens >= power:
                yield from self._fill(1, power)

    def _fill(self, sequences: int, size: int):
        pieces = balance(np.array([len(i) // 4 for _, i, *_ in self.docs]), sequences, size)
        used, offset = [0] * len(self.docs), [0] * sequences
        for d, start, n, s in pieces:
            key, ids, before, total = self.docs[d]
            yield key, before + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, self.next + s, offset[s], ids[4 * start : 4 * (start + n)]
            used[d], offset[s] = start + n, offset[s] + n
        self.docs = [(k, i[4 * u :], b + u, t) for (k, i, b, t), u in zip(self.docs, used, strict=True) if 4 * u < len(i)]
        self.tokens -= sequences * size
        self.next += sequences


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it comes from and its place in a sequence.

    A document is its token ids and then ``end_id``; each id lies in exactly
    one piece.  Every task packs the documents that it reads in blocks of
    ``BLOCK`` sequences, by ``balance``; what a block leaves over joins the
    next one.  All sequences of a block are full, and a task's remainder goes
    into sequences whose lengths are powers of two, which need no padding.
    A document of
    more tokens than a block fills whole sequences by itself first, so the work
    grows with its length and no faster.  Nothing is shuffled or gathered,
    memory is that of one block and one document, and a task that runs again gives the same sequences: their
    numbers are its partition's number and a count.

    Null text counts as empty and gives the piece ``[end_id]``.  Ties go to
    the earlier row; repeated rows are packed each on its own; a null id stays
    null; extra columns are not read; an empty table gives no row.
    ``with_ids`` adds the piece's ids as a column.
    """
    end = int(end_id).to_bytes(4, "little")
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        e = encoder(vocabulary, ids=True)
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        key_type = None

        def batch_of(rows):
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], key_type)] + [pa.array(c, pa.int64()) for c in columns[1:7]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        rows: list = []
        for batch in batches:
            key_type = batch.column(0).type
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for key, ids in zip(keys[a:b], e.batch(texts[a:b]), strict=True):
                    rows += packer.add(key, ids + end)
                if rows:
                    yield batch_of(rows)
                    rows = []
        if rows := list(packer.rest()):
            yield batch_of(rows)

    schema = f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:]) + ", ids array<int>" * with_ids
    out = arrow(slim, run, schema)
    return out.select(F.col("id").alias(id_col), *names[1:], *["ids"] * with_ids)
