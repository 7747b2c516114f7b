"""Byte-level BPE for whole texts: chunks that cannot affect each other, cached.

The pre-token pattern of the vocabulary starts a new pre-token at each single
space between two non-blank characters, whatever stands before it.  A text
therefore splits there into chunks whose tokens do not depend on each other,
and the tokens of a chunk that was seen before are looked up.
"""

from __future__ import annotations

import gc
import json
import re
from array import array

import numpy as np
import regex

#: The pre-token pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a worker's cache holds before it is emptied.
CACHE_ENTRIES = 600_000
#: Longer chunks are not cached: they hardly ever come again.
CACHE_CHARS = 64
#: Above the rank of any pair.
NO_RANK = np.int32(2**31 - 1)

_beside_blank = re.compile(r" \s|\s ")
_cut = re.compile(r"(?<=\S) (?=\S)")


def chunks(text: str) -> list[str]:
    """The chunks of a text, all but the first without the space that they begin with."""
    regular = text[0] != " " and text[-1] != " " and not _beside_blank.search(text)
    return text.split(" ") if regular else _cut.split(text)


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Merge table of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.size = max(ids.values()) + 1
        key = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        new = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.byte_ids = np.zeros(256, np.int32)
        for ch, b in byte_chars().items():
            self.byte_ids[b] = ids[ch]
        # open addressing in numpy: a power of two of slots, linear probing
        self.mask = (1 << 18) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.zeros(self.mask + 1, np.int32)
        self.news = np.array(new, np.int32)  # by rank
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = self.keys[at[left]] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(at[left], return_index=True)[1]] = True
            put = left[free & first]
            self.keys[at[put]], self.ranks[at[put]] = key[put], put
            left = left[~(free & first)]
            at[left] = (at[left] + 1) & self.mask
        self.split_specials = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pre_tokens = regex.compile(PATTERN).findall

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or ``NO_RANK``."""
        key = left.astype(np.int64) * self.size + right
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], NO_RANK)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def merge_ragged(vocabulary: Vocabulary, pre_tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rank-synchronous merging: (surviving ids of all sequences, count of each).

    All sequences are one ragged array.  Each round finds every sequence's
    lowest-rank pair and merges all its occurrences in all sequences at once,
    from the left where they overlap.  Sequences without a pair leave.
    """
    n = len(pre_tokens)
    lengths = np.fromiter(map(len, pre_tokens), np.int64, n)
    ids = vocabulary.byte_ids[np.frombuffer(b"".join(pre_tokens), np.uint8)]
    seq = np.repeat(np.arange(n, dtype=np.int32), lengths)
    lengths = lengths[lengths > 0]
    rank = np.full(len(ids), NO_RANK, np.int32)  # of a symbol with its right neighbour
    inside = np.flatnonzero(seq[1:] == seq[:-1])
    rank[inside] = vocabulary.lookup(ids[inside], ids[inside + 1])
    done_ids, done_seq = [], []
    while len(ids):
        start = np.cumsum(lengths) - lengths
        low = np.minimum.reduceat(rank, start)
        live = low < NO_RANK
        if not live.all():
            each = np.repeat(live, lengths)
            done_ids.append(ids[~each])
            done_seq.append(seq[~each])
            ids, seq, rank, lengths, low = ids[each], seq[each], rank[each], lengths[live], low[live]
            if not len(ids):
                break
        run = np.flatnonzero(rank == np.repeat(low, lengths))
        near = np.diff(run) == 1
        if near.any():  # aaa: every second one of adjacent hits is void
            k = np.arange(len(run))
            since = k - np.maximum.accumulate(np.where(np.r_[True, ~near], k, 0))
            run = run[since % 2 == 0]
        ids[run] = vocabulary.news[rank[run]]
        keep = np.ones(len(ids), bool)
        keep[run + 1] = False
        lengths -= np.bincount(np.searchsorted(np.cumsum(lengths), run, "right"), minlength=len(lengths))
        at = run - np.arange(len(run))  # one symbol went for each merge before this one
        ids, seq, rank = ids[keep], seq[keep], rank[keep]
        rank[at] = NO_RANK
        for left in (at[at < len(ids) - 1], at[at > 0] - 1):
            left = left[seq[left] == seq[left + 1]]
            rank[left] = vocabulary.lookup(ids[left], ids[left + 1])
    ids, seq = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_ids, done_seq))
    order = np.argsort(seq, kind="stable")
    return ids[order], np.bincount(seq, minlength=n).astype(np.int64)


_encoders: dict = {}


def encoder(path: str, ids: bool) -> Encoder:
    """The worker's encoder for a file: read once, its cache kept between tasks."""
    if (path, ids) not in _encoders:
        _encoders[path, ids] = (IdEncoder if ids else Encoder)(path)
    return _encoders[path, ids]


def slices(texts: list, limit: int = 4_000_000):
    """Consecutive (start, end) with about ``limit`` characters each, one text at least."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Encoder:
    """Token counts of whole texts; unseen chunks of a batch are merged together."""

    ids = False

    #: Unseen characters that are merged at once: bounds the ragged arrays.
    BATCH_CHARS = 2_000_000

    def __init__(self, path: str):
        self.vocabulary, self.cache = Vocabulary(path), {}

    def learn(self, unseen: list, own: dict) -> None:
        """Fill ``own`` with the tokens (or their number) of each chunk."""
        joined, alone = [], []
        for c in unseen:
            (alone if isinstance(c, tuple) or " " in c else joined).append(c)
        size = 0
        last = 0
        for k, c in enumerate(joined, 1):
            size += len(c)
            if size >= self.BATCH_CHARS or k == len(joined):
                part = joined[last:k]
                # one call for all: each chunk begins with the only space in it
                found = self.vocabulary.pre_tokens(" " + " ".join(part))
                self._learn(part, found, np.cumsum([p[0] == " " for p in found]) - 1, own)
                size, last = 0, k
        for k in range(0, len(alone), 1000):
            part, found, of = alone[k : k + 1000], [], []
            for j, c in enumerate(part):
                mine = self.vocabulary.pre_tokens(c[0] if isinstance(c, tuple) else " " + c)
                found += mine
                of += [j] * len(mine)
            self._learn(part, found, np.array(of, np.int64), own)

    def _learn(self, part: list, found: list[str], of_chunk: np.ndarray, own: dict) -> None:
        each: dict[str, int] = dict.fromkeys(found, 0)
        each.update(zip(each, range(len(each)), strict=True))
        index = np.fromiter(map(each.__getitem__, found), np.int64, len(found))
        merged, counts = merge_ragged(self.vocabulary, [p.encode("utf-8", "replace") for p in each])
        own.update(zip(part, np.bincount(of_chunk, counts[index], len(part)).astype(int).tolist(), strict=True))

    def _parts(self, text: str | None) -> tuple[list[list], list[str]]:
        """The chunks of each part between special strings, and those strings."""
        text, split = text or "", self.vocabulary.split_specials
        found = split.findall(text) if split else []
        out = []
        for part in split.split(text) if found else [text]:
            own = chunks(part) if part else []
            if own:
                own[0] = (own[0],)
            out.append(own)
        return out, found

    def batch(self, texts: list[str | None]) -> list:
        """For each text its ids as little-endian 32-bit bytes, or their number; null counts as empty."""
        paused = gc.isenabled()
        gc.disable()  # many short-lived strings, no cycles
        try:
            return self._batch(texts)
        finally:
            if paused:
                gc.enable()

    def _batch(self, texts: list[str | None]) -> list:
        cache, docs, unseen, open_ = self.cache, [], set(), []
        get = cache.get
        for t in texts:
            parts, found = self._parts(t)
            values = [list(map(get, p)) for p in parts]
            for v, p in zip(values, parts, strict=True):
                if None in v:
                    gaps = [(k, p[k]) for k, x in enumerate(v) if x is None]
                    unseen.update([c for _, c in gaps])
                    open_.append((v, gaps))
            docs.append((values, found))
        own: dict = {}
        self.learn(list(unseen), own)
        for v, gaps in open_:
            for k, c in gaps:
                v[k] = own[c]
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        cache.update([(c, x) for c, x in own.items() if len(c if isinstance(c, str) else c[0]) <= CACHE_CHARS])
        return [self.total(values, found) for values, found in docs]

    def total(self, values: list[list], found: list[str]) -> int:
        return sum(map(sum, values)) + len(found)


class IdEncoder(Encoder):
    """Token ids of whole texts.

    Unseen chunks go through the same vocabulary as ranks in ``tiktoken``,
    whose ids are those of the ``tokenizers`` file (tests hold them together).
    """

    ids = True

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        v = self.vocabulary
        stand_in = byte_chars()
        with open(path, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        ranks = {bytes(stand_in[ch] for ch in token): k for token, k in ids.items() if token not in v.specials}
        self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        self.spaced = np.zeros(v.size, bool)
        self.spaced[[k for token, k in ranks.items() if token[:1] == b" "]] = True

    def learn(self, unseen: list, own: dict) -> None:
        joined = []
        for c in unseen:
            if isinstance(c, tuple) or " " in c:
                own[c] = array("I", self.encode(" " + c if isinstance(c, str) else c[0])).tobytes()
            else:
                joined.append(c)
        for a, b in slices(joined, self.BATCH_CHARS):
            # one call for all: each chunk begins with the only space in it
            ids = np.array(self.encode(" " + " ".join(joined[a:b])), "<u4")
            starts = (4 * np.flatnonzero(self.spaced[ids])).tolist()
            blob = ids.tobytes()
            own.update(zip(joined[a:b], [blob[x:y] for x, y in zip(starts, [*starts[1:], len(blob)], strict=True)], strict=True))

    def total(self, values: list[list], found: list[str]) -> bytes:
        if not found:
            return b"".join(values[0])
        specials = [self.vocabulary.specials[s].to_bytes(4, "little") for s in found]
        return b"".join(x for k, v in enumerate(values) for x in (*v, *specials[k : k + 1]))
