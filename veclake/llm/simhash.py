"""SimHash near-deduplication: BK-trees over shards of fingerprints."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, keyed, without, written
from .components import components

#: Rows of sorted shards that a task works on at once.
CHUNK_ROWS = 400_000
#: Steps of the frontier of a search: bounds its arrays.
FRONTIER = 2_000_000
#: Shards (or classes) of more nodes are searched by all tasks, which get trees of a part of them by broadcast.
LARGE = 16_384
#: Nodes of a large shard that the others are held against first.
LEADERS = 16
#: Nodes whose trees are broadcast at once, and elements of their sets.
BLOCK_NODES, BLOCK_ELEMENTS = 200_000, 2_000_000
#: Rows of a table of large shards or of their nodes that is broadcast.
BROADCAST_ROWS = 500_000


def fingerprints(shingle: int):
    """(id, text) batches -> (id, print): bit set where over half of the shingle hashes have it."""

    def run(batches):
        hash_ = xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                if not words:
                    out.append(0)
                    continue
                joined = b" ".join(words)
                n = max(1, len(words) - shingle + 1)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.r_[0, ends[:-1] + 1]
                hashes = np.array([hash_(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)], "<u8")
                ones = np.zeros(64, np.int64)
                for k in range(0, n, 65536):
                    ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                out.append(int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["id", "print"])

    return run


def shard_masks(radius: int) -> list[int]:
    """Masks of three blocks of bits out of radius + 3: prints within the radius agree on one of them at least."""
    blocks, at, out = radius + 3, 0, []
    for k in range(blocks):
        width = 64 // blocks + (k < 64 % blocks)
        out.append(((1 << width) - 1) << at)
        at += width
    return [a | b | c for a, b, c in combinations(out, 3)]


class Forest:
    """BK-trees of many shards in flat arrays.

    A node's child hangs on the edge of their Hamming distance, and what lies
    at an edge that is taken goes down to the child there.  All nodes of all
    shards descend together, one level a round.
    """

    def __init__(self, prints: np.ndarray, root: np.ndarray):
        """``prints``: a row of 64-bit parts for each node; ``root``: index of the first node of its shard."""
        self.prints = prints
        n, self.step = len(prints), 64 * prints.shape[1] + 1
        at, active = root.copy(), np.flatnonzero(root != np.arange(n))
        keys, children = [], []
        while len(active):
            key = at[active] * self.step + np.bitwise_count(prints[active] ^ prints[at[active]]).sum(1, dtype=np.int64)
            order = np.argsort(key, kind="stable")
            key, active = key[order], active[order]
            new = np.r_[True, key[1:] != key[:-1]]
            keys.append(key[new])
            children.append(active[new])
            at[active] = np.repeat(active[new], np.diff(np.r_[np.flatnonzero(new), len(key)]))
            active = active[~new]
        key, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, children))
        order = np.argsort(key)
        self.keys, self.child = key[order], child[order]

    def links(self, prints: np.ndarray, roots: np.ndarray, radius: int):
        """Arrays (query, node) of nodes within the radius of each query in its own tree, following only edges within it."""
        query, node = np.arange(len(prints)), roots
        while len(query):
            d = np.bitwise_count(prints[query] ^ self.prints[node]).sum(1, dtype=np.int64)
            hit = d <= radius
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.keys, node * self.step + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, node * self.step + np.minimum(d + radius, self.step - 1), "right") - low
            total = int(n.sum())
            query = np.repeat(query, n)
            node = self.child[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least index of each class) after joining the pairs."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (a, b)], ["a", "b"])


def _in_shards(radius: int):
    """Sorted (group, node, print's parts) -> (a, b): a spanning forest of the links in each shard."""

    def solve(group, node, *parts):
        new = np.r_[True, group[1:] != group[:-1]]
        size = np.diff(np.r_[np.flatnonzero(new), len(node)])
        keep = np.repeat(size > 1, size)
        node, size = node[keep], size[size > 1]
        if not len(node):
            return None
        prints = np.stack([c[keep] for c in parts], axis=1).view(np.uint64)
        root = np.repeat(np.cumsum(size) - size, size)
        forest, label = Forest(prints, root), np.arange(len(prints))
        work = np.cumsum(np.repeat(size, size)) // FRONTIER
        for own in np.split(np.arange(len(prints)), np.flatnonzero(np.diff(work)) + 1):
            for a, b in forest.links(prints[own], root[own], radius):
                label = merge(label, own[a], b)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return _pairs([node[linked]], [node[label[linked]]]) if len(linked) else None

    def run(batches):
        held: list = []
        rows = 0

        def flush(last: bool):
            nonlocal held, rows
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            end = len(columns[0])
            if not last:  # the last shard may go on
                end = int(np.argmax(columns[0] == columns[0][-1]))
            held, rows = [[c[end:] for c in columns]], len(columns[0]) - end
            return solve(*(c[:end] for c in columns)) if end else None

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= CHUNK_ROWS and (out := flush(False)) is not None:
                yield out
        if rows and (out := flush(True)) is not None:
            yield out

    return run


def _tree_of(block: pa.Table, parts: int) -> tuple:
    """What a broadcast holds of a block of rows: groups, the root of each, nodes, their trees, and their sets if they have some."""
    block = block.combine_chunks().sort_by("group")
    group, node, *prints = (block.column(k).to_numpy().astype(np.int64, copy=False) for k in range(2 + parts))
    names, first = np.unique(group, return_index=True)
    root = np.repeat(first, np.diff(np.r_[first, len(group)]))
    sets = None
    if block.num_columns > 2 + parts:
        lists = block.column(2 + parts).combine_chunks()
        sets = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))], lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return names, first, node, Forest(np.stack(prints, axis=1).view(np.uint64), root), sets


class _Found:
    """The links between passing rows and a block's nodes, as a spanning forest: one edge a row, and what joins the block's nodes."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.label, self.a, self.b = nodes, np.arange(len(nodes)), [], []

    def start(self, rows: np.ndarray) -> None:
        self.rows, self.first = rows, np.full(len(rows), -1)

    def add(self, row: np.ndarray, node: np.ndarray) -> None:
        fresh = np.flatnonzero(self.first[row] < 0)
        who, at = np.unique(row[fresh], return_index=True)
        self.first[who] = node[fresh[at]]
        self.a.append(self.rows[who])
        self.b.append(self.nodes[self.first[who]])
        x, y = self.first[row], node
        open_ = np.flatnonzero(self.label[x] != self.label[y])
        if len(open_):
            x, y = x[open_], y[open_]
            _, at = np.unique(self.label[x] * len(self.nodes) + self.label[y], return_index=True)
            self.a.append(self.nodes[x[at]])
            self.b.append(self.nodes[y[at]])
            self.label = merge(self.label, x[at], y[at])

    def take(self) -> pa.RecordBatch:
        out = _pairs(self.a, self.b)
        self.a, self.b = [], []
        return out


def _past_trees(shared, radius: int, similarity: float | None):
    """Rows that pass a block's trees -> (a, b) of links; with a similarity the sets of both ends must bear them out."""

    def run(batches):
        names, roots, nodes, forest, sets = shared.value
        found, parts = _Found(nodes), forest.prints.shape[1]
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                group, node, *prints = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for k in range(2 + parts))
                place = np.minimum(np.searchsorted(names, group), max(len(names) - 1, 0))
                own = np.flatnonzero(names[place] == group)
                if not len(own):
                    continue
                found.start(node[own])
                hits = forest.links(np.stack(prints, axis=1).view(np.uint64)[own], roots[place[own]], radius)
                if similarity is None:
                    for row, other in hits:
                        found.add(row, other)
                else:
                    lists = batch.column(2 + parts).take(pa.array(own))
                    _bear_out(found, list(hits), sets, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), similarity)
                yield found.take()

    return run


def _bear_out(found: _Found, hits: list, sets: tuple, n: np.ndarray, flat: np.ndarray, similarity: float) -> None:
    """Test candidate links exactly, but those that join what is joined."""
    row, other = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tuple(zip(*hits, strict=True)) or ((), ())))
    start = np.cumsum(n) - n
    for b in np.unique(other).tolist():
        mine = row[other == b]
        known = found.first[mine]
        mine = mine[((known < 0) | (found.label[known] != found.label[b])) & (n[mine] > 0)]
        own = sets[1][sets[0][b] : sets[0][b + 1]]
        if not len(mine) or not len(own):
            continue
        size = n[mine]
        first = np.cumsum(size) - size
        values = flat[np.arange(int(size.sum())) + np.repeat(start[mine] - first, size)]
        both = np.add.reduceat((own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values).astype(np.int64), first)
        good = mine[both >= similarity * (size + len(own) - both) - 1e-9]
        if len(good):
            found.add(good, np.full(len(good), b))


def _few(df: DataFrame) -> DataFrame:
    """``df``, a written table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _through_blocks(rows: DataFrame, asked: DataFrame, parts: int, radius: int, similarity: float | None) -> list[DataFrame]:
    """Links between all ``rows`` of large groups and those of ``asked``, whose trees are broadcast in blocks of a bounded size."""
    elements = F.sum(F.size("shingles")) if similarity is not None else F.lit(0)
    size = asked.agg(F.count("*").alias("n"), F.coalesce(elements, F.lit(0)).alias("elements")).first()
    blocks, out = max(-(-size["n"] // BLOCK_NODES), -(-size["elements"] // BLOCK_ELEMENTS)), []
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(blocks)) == k).toArrow()
        if block.num_rows:
            shared = rows.sparkSession.sparkContext.broadcast(_tree_of(block, parts))
            out.append(written(arrow(rows, _past_trees(shared, radius, similarity), "a long, b long"), "swept"))
            shared.unpersist()
    return out


def _swept(rows: DataFrame, large: DataFrame, parts: int, radius: int, similarity: float | None = None) -> DataFrame:
    """Pairs that connect all linked nodes of large groups, none of which is gathered or copied.

    First all rows pass the trees of a few leaders of each group.  What they
    link is one class for most groups of near copies.  Any link that is still
    open has an end outside the class that most of its group belongs to, so
    then all rows pass the trees of those nodes, block by block.
    """
    rows = written(rows, "large-groups")
    sizes = large.withColumnRenamed("group", "_group")
    some = F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.floor(F.col("n") / LEADERS), F.lit(1)))
    edges = _through_blocks(rows, rows.join(_few(sizes), rows["group"] == sizes["_group"]).where(some == 0).select(rows.columns), parts, radius, similarity)
    none = rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    classes = components(_union(edges, none)).select(F.col("node").alias("_node"), "root")
    named = rows.select("group", "node").join(classes, rows["node"] == classes["_node"], "left").select("group", "node", F.coalesce("root", "node").alias("root"))
    named = written(named, "named")
    most = named.groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("root", "n").alias("most"))
    most = written(most.select(F.col("group").alias("_group"), "most"), "most")
    rest = named.join(_few(most), named["group"] == most["_group"]).where("root <> most").select(F.col("group").alias("_group"), F.col("node").alias("_node"))
    rest = written(rest, "rest")
    asked = rows.join(_few(rest), (rows["group"] == rest["_group"]) & (rows["node"] == rest["_node"]), "left_semi")
    return _union([*edges, *_through_blocks(rows, asked, parts, radius, similarity)], none)


def _union(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    out = none
    for part in parts:
        out = out.union(part)
    return out


def _searched(rows: DataFrame, radius: int, parts: int) -> DataFrame:
    """(group, node and the print's parts) -> pairs (a, b) of nodes that connect all that are linked in a shard."""
    large = written(rows.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > LARGE), "large")
    if large.isEmpty():
        return arrow(rows.repartition("group").sortWithinPartitions("group"), _in_shards(radius), "a long, b long")
    few, names = _few(large), large.select(F.col("group").alias("_group"))
    names = _few(names) if few is not large else names
    small = rows.join(names, rows["group"] == names["_group"], "left_anti")
    found = arrow(small.repartition("group").sortWithinPartitions("group"), _in_shards(radius), "a long, b long")
    return found.union(_swept(rows.join(names, rows["group"] == names["_group"], "left_semi"), large, parts, radius))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Distinct 64-bit ``print`` values -> pairs (a, b) that connect all within the radius.

    A shard holds the prints that agree on one of ``shard_masks``.
    """
    each = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("print").bitwiseAND(F.lit(_signed(m)).cast("long"))) for k, m in enumerate(shard_masks(radius))])).alias("group")
    return _searched(prints.select(each, F.col("print").alias("node"), F.col("print").alias("p0")), radius, 1)


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; shingles of
    ``shingle`` words are hashed by XXH64 with seed 42.  Documents whose
    prints differ in ``radius`` bits at most are linked; component_id is the
    smallest id that is reachable.  Equal prints are one tree node, however
    many documents have them.

    Fewer words than a shingle: their whole sequence; no word or null text:
    print zero, linked like any other.  A null id takes part, but is no
    component's id unless all its ids are null.  Repeated rows share their
    print; extra columns are not read; an empty table gives none.
    """
    kind = dict(docs.dtypes)[id_col]
    printed = written(arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), fingerprints(shingle), f"id {kind}, print long"), "prints")
    nodes = written(printed.groupBy("print").agg(F.min("id").alias("id")), "nodes").withColumnRenamed("print", "node")
    classes = components(links(nodes.select(F.col("node").alias("print")), radius))
    out = _named(printed.withColumn("node", F.col("print")), nodes, classes)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


#: A longer print's bits, in parts of 64, and the bits that two prints of a candidate pair may differ in.
WIDE_PARTS, WIDE_RADIUS = 4, 56
#: Shards of a document for the longer prints, and the least shingle hashes, each of its own range, that a shard's key is made of.
BANDS, BAND = 8, 3
_PRINTS = [f"p{k}" for k in range(WIDE_PARTS)]
WIDE_SCHEMA = "node long, size long, " + ", ".join(f"{p} long" for p in _PRINTS) + ", bands array<long>"
#: Elements of a class of candidates that one task compares.
SHINGLES = 1 << 21


def shingle_set(text, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    hash_, joined = xxhash.xxh64_intdigest, b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return np.unique(np.array([hash_(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)], "<u8"))


def _set_node(h: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(h.tobytes(), 42))


def bands_of(h: np.ndarray) -> list[int]:
    """Keys of the shards of a sorted set: BANDS hashes of BAND elements, each the first at or after the start of its own range.

    An element is the least one of a range for two sets alike with the
    probability of their similarity, and two sets meet if one band agrees in
    all of its elements.  Sets with little in common share no key, whatever
    the size of the corpus.
    """
    if not len(h):
        return []
    starts = np.arange(BANDS * BAND, dtype=np.uint64) * np.uint64((1 << 64) // (BANDS * BAND))
    least = h[np.searchsorted(h, starts) % len(h)].astype("<u8").reshape(BANDS, BAND)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(least)]


def expected_recall(similarity: float) -> float:
    """Share of pairs of sets with this Jaccard similarity that meet in a shard within WIDE_RADIUS.

    Such sets have cosine 2s / (1 + s), and their prints differ in each bit
    with the angle's share of a half turn, so their distance is binomial.
    """
    n, differ = 64 * WIDE_PARTS, math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    within = sum(math.comb(n, d) * differ**d * (1 - differ) ** (n - d) for d in range(WIDE_RADIUS + 1))
    return within * (1 - (1 - similarity**BAND) ** BANDS)


def wide_fingerprints(shingle: int):
    """(id, text) batches -> (id, node, size, p0..p3, bands): hash and size of the set of shingles, its print of WIDE_PARTS * 64 bits, its shards."""

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, WIDE_PARTS), np.int64)
            nodes, sizes, bands = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                h = shingle_set(text, shingle)
                nodes.append(_set_node(h))
                sizes.append(len(h))
                bands.append(bands_of(h))
                for part in range(WIDE_PARTS if len(h) else 0):
                    if part:
                        h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part)
                        h ^= h >> np.uint64(32)
                        h *= np.uint64(0xD6E8FEB86659FD93)
                        h ^= h >> np.uint64(29)
                    ones = np.zeros(64, np.int64)
                    for k in range(0, len(h), 65536):
                        ones += np.unpackbits(h[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                    out[row, part] = np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *[pa.array(c) for c in out.T], pa.array(bands, pa.list_(pa.int64()))], ["id", "node", "size", *_PRINTS, "bands"])

    return run


def similar_pairs(prints: np.ndarray, sizes: np.ndarray, flat: np.ndarray, similarity: float):
    """Pairs of sets (their elements one after the other in ``flat``) that connect all within WIDE_RADIUS whose Jaccard similarity reaches the least one."""
    _, flat = np.unique(flat, return_inverse=True)
    at = np.cumsum(sizes) - sizes
    label, mark, left, right = np.arange(len(sizes)), np.zeros(len(flat), bool), [], []
    for i in range(len(sizes) - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        j = j[np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]) - 1e-9]
        j = j[np.bitwise_count(prints[j] ^ prints[i]).sum(1, dtype=np.int64) <= WIDE_RADIUS]
        if not len(j) or not sizes[i]:
            continue
        own, n = flat[at[i] : at[i] + sizes[i]], sizes[j]
        first = np.cumsum(n) - n
        mark[own] = True
        both = np.add.reduceat(mark[flat[np.arange(n.sum()) + np.repeat(at[j] - first, n)]].astype(np.int64), first)
        mark[own] = False
        j = j[both >= similarity * (sizes[i] + n - both) - 1e-9]
        if len(j):
            left.append(np.full(len(j), i))
            right.append(j)
            label[np.isin(label, label[j])] = label[i]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _verified(similarity: float):
    """Sorted (class, node, p0..p3, shingles) -> (a, b): links of a class that its sets of shingles bear out."""

    def solve(held):
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        class_, node, sizes, flat = *columns[:2], columns[-2], columns[-1]
        prints = np.stack(columns[2:-2], axis=1).view(np.uint64)
        edge = np.r_[np.flatnonzero(np.r_[True, class_[1:] != class_[:-1]]), len(node)]
        at = np.r_[0, np.cumsum(sizes)]
        a, b = [], []
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if y - x > 1:
                i, j = similar_pairs(prints[x:y], sizes[x:y], flat[at[x] : at[y]], similarity)
                a.append(node[x + i])
                b.append(node[x + j])
        return _pairs(a, b)

    def rows_of(batch):
        fixed = [c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns[:-1]]
        lists = batch.columns[-1]
        return [*fixed, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)]

    def run(batches):
        held, n = [], 0
        for batch in batches:
            class_ = batch.column(0).to_numpy(zero_copy_only=False)
            last = int(np.argmax(class_ == class_[-1])) if len(class_) else 0
            if held and n >= SHINGLES:  # what is held ends where another class starts
                if len(class_) and held[-1][0][-1] != class_[0]:
                    yield solve(held)
                    held, n = [], 0
                elif last:
                    yield solve([*held, rows_of(batch.slice(0, last))])
                    held, n, batch = [], 0, batch.slice(last)
            if batch.num_rows:
                held.append(rows_of(batch))
                n += len(held[-1][-1])
        if held:
            yield solve(held)

    return run


def _borne_out(texts: DataFrame, sets: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between sets of shingles in one candidate class, by their exact similarity.

    ``sets``: one row (node, id, size, print, p0..p3) a set; ``classes``: (node, root)
    of prints.  Only texts in a class of two sets or more are read again, and
    their sets move once.  A class of more than SHINGLES elements stays where it is and passes
    the sets of others of its nodes in blocks.
    """
    c = classes.select(F.col("node").alias("_print"), F.col("root").alias("_root"))
    classed = written(sets.join(c, sets["print"] == c["_print"], "left").select(F.coalesce("_root", "print").alias("class"), "node", "id", "size", *_PRINTS), "candidates")
    sizes = classed.groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("elements")).where("n > 1")
    sizes = written(sizes.withColumn("large", (F.col("elements") > SHINGLES) | (F.col("n") > LARGE)), "class-sizes")
    many = sizes.select(F.col("class").alias("_class"), "large")
    asked = written(classed.join(many, classed["class"] == many["_class"]).select(F.col("id").alias("_id"), F.col("class").alias("group"), "node", *_PRINTS, "large"), "asked")
    a = _few(asked)
    again = texts.join(a, texts["id"].eqNullSafe(a["_id"])).select("text", "group", "node", *_PRINTS, "large")

    def sets_of(batches):
        for batch in batches:
            found = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            # an id may stand at other texts too
            same = np.flatnonzero([_set_node(h) == n for h, n in zip(found, batch.column(2).to_pylist(), strict=True)])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(found[k]) for k in same]]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *[found[k] for k in same]]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[x.take(pa.array(same)) for x in batch.columns[1:]], lists], [*batch.schema.names[1:], "shingles"])

    rows = arrow(again, sets_of, "group long, node long, " + ", ".join(f"{n} long" for n in _PRINTS) + ", large boolean, shingles array<long>")
    columns = ["group", "node", *_PRINTS, "shingles"]
    large = sizes.where("large").select(F.col("class").alias("group"), "n")
    if large.isEmpty():
        return arrow(rows.select(columns).repartition("group").sortWithinPartitions("group"), _verified(similarity), "a long, b long")
    rows = written(rows, "sets")
    small = arrow(rows.where("not large").select(columns).repartition("group").sortWithinPartitions("group"), _verified(similarity), "a long, b long")
    return small.union(_swept(rows.where("large").select(columns), large, WIDE_PARTS, WIDE_RADIUS, similarity))


def _similar(texts: DataFrame, printed: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows of ``wide_fingerprints`` -> (one row a node, links between nodes): nodes are distinct sets of shingles."""
    sets = printed.groupBy("node").agg(F.min("id").alias("id"), *[F.first(n).alias(n) for n in ("size", *_PRINTS, "bands")])
    sets = written(sets.withColumn("print", F.xxhash64(*_PRINTS)), "wide-nodes")
    rows = sets.select(F.explode("bands").alias("group"), F.col("print").alias("node"), *_PRINTS).dropDuplicates(["group", "node"])
    candidates = components(_searched(written(rows, "shards"), WIDE_RADIUS, WIDE_PARTS))
    return sets.drop("bands"), _borne_out(texts, sets.drop("bands"), candidates, shingle, similarity)


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and component_id, by prints of 256 bits and exact similarity.

    For shingle sets whose Jaccard similarity is ``similarity`` or more: their
    prints are 39 bits apart on average at 0.8, with a deviation of 6, so
    WIDE_RADIUS takes nearly all, while texts that have little in common are
    about 110 bits apart.  Prints meet in BANDS shards a document, whatever
    the corpus (``bands_of``), and are searched there by BK-trees.  They only
    make candidates: a link is kept if the sets of shingles themselves are
    similar enough, so documents are never joined by less than that.
    ``expected_recall`` is the share of pairs that are found.

    Null texts, ids, repeated rows, extra columns and empty tables as in
    ``near_duplicates``, but texts without words are alike only among
    themselves.  Very long texts are whole sets like any other.
    """
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    printed = written(arrow(texts, wide_fingerprints(shingle), f"id {kind}, {WIDE_SCHEMA}"), "wide-prints")
    sets, pairs = _similar(texts, printed, shingle, similarity)
    return _named(printed, sets, components(pairs)).select(F.col("id").alias(id_col), "component_id")


def _named(printed: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, node, ...) rows with the smallest id of their node's class."""
    c = classes.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    rooted = written(nodes.join(c, nodes["node"] == c["_node"], "left").select("node", "id", F.coalesce("_root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("node").alias("_node"), "component_id")
    return printed.join(named, printed["node"] == named["_node"], "left")


def distinct_groups(docs: DataFrame, shingle: int = 5, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """One document of each group (that with the smallest id; null is smallest), all its columns as they were.

    Groups of ``near_duplicates``, or of ``similar_groups`` with a
    ``similarity``.  Rows that repeat id and text are one document and stay
    together.
    """
    slim = keyed(docs)
    labelled = near_duplicates(slim, shingle, radius) if similarity is None else similar_groups(slim, shingle, similarity)
    return without(docs, labelled.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def distinct_by_both(docs: DataFrame, shingle: int, radius: int, wide_shingle: int, similarity: float) -> DataFrame:
    """As ``distinct_groups``, for the groups that the links of ``near_duplicates`` and ``similar_groups`` make together.

    Both searches read all documents; a document joins its 64-bit print with
    its set of shingles.
    """
    slim = keyed(docs)
    texts = slim.select(F.col("doc_id").alias("id"), "text")

    def both(batches):
        narrow, wide = fingerprints(shingle), wide_fingerprints(wide_shingle)
        for batch in batches:
            (a,), (b,) = narrow([batch]), wide([batch])
            yield pa.RecordBatch.from_arrays([*b.columns, a.column(1)], [*b.schema.names, "narrow"])

    printed = written(arrow(texts, both, f"id {dict(texts.dtypes)['id']}, {WIDE_SCHEMA}, narrow long"), "both-prints")
    near = links(written(printed.select(F.col("narrow").alias("print")).distinct(), "nodes"), radius)
    sets, pairs = _similar(texts, printed, wide_shingle, similarity)

    def end(column: str) -> Column:
        return F.xxhash64(F.lit("print"), F.col(column))

    edges = near.select(end("a").alias("a"), end("b").alias("b")).union(pairs).union(printed.select("node", end("narrow")).distinct())
    labelled = _named(printed, sets, components(edges)).select(F.col("id").alias("doc_id"), "component_id")
    return without(docs, labelled.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))
