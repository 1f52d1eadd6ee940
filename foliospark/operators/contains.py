"""Which spans stand in a text of their own group, without a pair of a span and a text.

Spans and texts meet in parts of a group, the spans first; a group with much text has
several parts, each with all spans of the group. The bytes of the texts stream past the
spans: where the first bytes of a span stand (a table of hashes tells), a polynomial hash
of as many bytes as such a span has is looked up among the hashes of the spans. Work is in
proportion to the text, however many spans a group has. The hashes only propose: what is
given is confirmed byte by byte, and two spans of one hash are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Bytes of text in a part, about.
PART = 32_000_000
#: Bytes hashed at once.
CHUNK = 1_000_000
#: Windows looked up at once.
WINDOWS = 4_000_000
#: Most bytes of a span's beginning that its place is proposed by; a power of two.
HEAD = 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** i, modulo 2 ** 64, for i below n."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        held = _powers[base] = np.multiply.accumulate(p)
    return held[:n]


def _sums(data: np.ndarray) -> np.ndarray:
    """What ``_hash`` needs of ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(7)) * _power(_BASE, len(data)), dtype=np.uint64, out=sums[1:])
    return sums


def _hash(sums: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Polynomial hashes of the windows of ``n`` bytes at ``at``."""
    return (sums[at + n] - sums[at]) * _power(_INVERSE, len(sums))[at]


def _mix(h: np.ndarray, group: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """One key of a hash, a group and a length."""
    h = h ^ (group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.atleast_1d(np.asarray(n, np.uint64)) * np.uint64(0xA0761D6478BD642F))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are in the sorted ``keys``, and where."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == wanted)
    return hit, at[hit]


class _Heads:
    """The beginnings of ``k`` bytes of the spans, and the lengths of the spans that begin so."""

    def __init__(self, k: int, plain: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> None:
        self.k = k
        self.bits = max(16, int(len(plain) * 16).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slots(plain)] = True
        order = np.lexsort((sizes, keys))
        keys, sizes = keys[order], sizes[order]
        other = np.ones(len(keys), bool)
        other[1:] = (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1])
        self.sizes = sizes[other]
        self.keys, self.first, self.count = np.unique(keys[other], return_index=True, return_counts=True)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(64 - self.bits)

    def starts(self, sums: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The places below ``m`` where a beginning may stand, with the hash there."""
        m = min(m, len(sums) - self.k)
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = (sums[self.k : self.k + m] - sums[:m]) * _power(_INVERSE, len(sums))[:m]
        at = np.flatnonzero(self.table[self._slots(h)])
        return at, h[at]

    def windows(self, at: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers in ``at`` and a length, for each length of the beginning there."""
        step = max(1, WINDOWS // int(self.count.max()))
        for i in range(0, len(at), step):
            w = which[i : i + step]
            count = self.count[w]
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield np.repeat(np.arange(i, i + len(w)), count), self.sizes[np.repeat(self.first[w], count) + nth]


class Spans:
    """Spans to be looked for in texts: span i, of ``group[i]``, is ``data[at[i] : at[i + 1]]`` and not empty."""

    def __init__(self, group: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
        self.group, self.data, self.at = group, data, at
        size = np.diff(at)
        head = np.minimum(1 << np.frexp(size)[1].astype(np.int64) - 1, HEAD)
        whole, begin = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
            sums = _sums(data[at[i] : at[j]])
            whole[i:j], begin[i:j] = _hash(sums, at[i:j] - at[i], size[i:j]), _hash(sums, at[i:j] - at[i], head[i:j])
            i = j
        self.longest = int(size.max())
        self.heads = [_Heads(int(k), begin[head == k], _mix(begin[head == k], group[head == k], k), size[head == k]) for k in np.unique(head)]
        key = _mix(whole, group, size)
        self.order = np.argsort(key, kind="stable")
        self.keys, self.first, self.count = np.unique(key[self.order], return_index=True, return_counts=True)
        self.open = np.ones(len(self.keys), bool)
        self.found = np.zeros(len(size), bool)

    def search(self, data: np.ndarray, at: np.ndarray, group: np.ndarray) -> Iterator[int]:
        """Numbers of the spans that stand in a text of their group and were not given before.

        Text i is ``data[at[i] : at[i + 1]]``.
        """
        step = max(CHUNK, self.longest)
        for low in range(0, len(data), step):
            piece = data[low : low + step + self.longest - 1]
            sums = _sums(piece)
            for heads in self.heads:
                a, h = heads.starts(sums, step)
                row = np.searchsorted(at, a + low, "right") - 1
                hit, which = _find(heads.keys, _mix(h, group[row], heads.k))
                a, row = a[hit], row[hit]
                for nth, n in heads.windows(a, which):
                    inside = a[nth] + low + n <= at[row[nth] + 1]
                    nth, n = nth[inside], n[inside]
                    hit, key = _find(self.keys, _mix(_hash(sums, a[nth], n), group[row[nth]], n))
                    yield from self._confirmed(piece, a[nth[hit]], group[row[nth[hit]]], key)

    def _confirmed(self, piece: np.ndarray, a: np.ndarray, group: np.ndarray, key: np.ndarray) -> Iterator[int]:
        while len(key):
            left = self.open[key]
            a, group, key = a[left], group[left], key[left]
            _, one = np.unique(key, return_index=True)
            for i in one.tolist():
                k = key[i]
                held = self.order[self.first[k] : self.first[k] + self.count[k]]
                for s in held[~self.found[held]].tolist():
                    span = self.data[self.at[s] : self.at[s + 1]]
                    if self.group[s] == group[i] and np.array_equal(piece[a[i] : a[i] + len(span)], span):
                        self.found[s] = True
                        yield s
                self.open[k] = not self.found[held].all()
            a, group, key = (np.delete(x, one) for x in (a, group, key))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after another, and where each row begins, with the end."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data if data is not None else b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the spans found. Rows lie by group, and within a group the spans (those with an id) come first."""
    number, last = 0, None
    held: list[tuple[np.ndarray, pa.RecordBatch]] = []
    index = None
    for batch in batches:
        if not batch.num_rows:
            continue
        named = batch.column(0).dictionary_encode()
        names = named.dictionary.to_pylist()
        if names[0] != last:
            number += 1
        group = named.indices.to_numpy().astype(np.int64) + number
        last, number = names[-1], number + len(names) - 1
        is_span = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        if is_span.any():
            held.append((group[is_span], batch.filter(pa.array(is_span))))
            index = None
        searched = ~is_span & np.isin(group, np.concatenate([np.unique(g) for g, _ in held])) if held else is_span & False
        if searched.any():
            if index is None:
                ids = pa.concat_arrays([b.column(1) for _, b in held])
                index = Spans(np.concatenate([g for g, _ in held]), *_bytes(pa.concat_arrays([b.column(2) for _, b in held])))
            found = list(index.search(*_bytes(batch.column(2).filter(pa.array(searched))), group[searched]))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(found, pa.int64()))], ["id"])
        if any(g[0] != number for g, _ in held):
            held = [(g[g == number], b.filter(pa.array(g == number))) for g, b in held if g[-1] == number]
            index = None


def contained(spans: DataFrame, texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The ``id`` of each span that stands, byte for byte, in a text of its group; each once.

    ``spans``: id (string), group, span; ``texts``: id (any), group, text; ``sizes``: one row
    per group that has both, with the bytes of its texts and of its spans. Nothing is null. An
    empty span is in no text. The spans of a group are copied to its parts, which are no smaller
    than they, so the copies are never more than the texts; a task holds the spans of one group.
    """
    part = F.greatest(F.lit(PART), "spans")
    several = written(sizes.where(F.col("bytes") > part).select("group", F.ceil(F.col("bytes") / part).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    texts = texts.join(several, "group", "left").select("group", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(None).cast("binary").alias("id"), F.col("text").cast("binary").alias("text"))
    spans = spans.where("span <> ''").join(several, "group", "left").select("group", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("id").cast("binary").alias("id"), F.col("span").cast("binary").alias("text"))
    rows = spans.unionByName(texts).repartition("group", "part").sortWithinPartitions("group", F.col("id").isNull())
    return rows.select(F.col("group").cast("binary"), "id", "text").mapInArrow(_search, "id binary").select(F.col("id").cast("string").alias("id")).distinct()
