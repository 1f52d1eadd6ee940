"""Long exact spans shared between records.

A run of at least ``span`` characters that two records share holds, in both, the
same phrase of half that length: the one of least hash (winnowing). A text has one
such phrase for about every 31 characters, and no shared run escapes. Hashes of
phrases that occur in more than one record are found by grouping, which combines
before the shuffle, so that a phrase of a third of all records is no hot group. What a
hash proposes is then confirmed by the text: the phrases themselves are taken from the
texts and kept if they recur, letter for letter.

The confirmed phrases are divided into shards by the least record that holds them, so
that the phrases of one passage lie together and a text has to meet few shards. Each
shard is compiled into an Aho-Corasick automaton, and the texts that may hold its
phrases stream through it; a shard met by much text is compiled in several tasks, each
with its part of the texts. Only windows around the occurrences located can be shared;
a 96-bit digest of the whole window (BLAKE2) tells which are. The polynomial hashes
only propose, so a collision of theirs costs time and changes nothing. Records are told
apart by a 64-bit hash of their key, and only where they hold the same phrase or window:
a pair of records that share text is taken for one with a chance of 2 to the -64, however
many records there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

SPAN = 120
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[tuple[int, int], np.ndarray] = {}
_ONES = np.uint64(2**64 - 1)
#: Characters hashed at once.
CHUNK = 1_000_000
#: Phrases in a shard, about.
SHARD = 20_000
#: Characters of the texts that one automaton is compiled for, about.
STREAM = 8_000_000


def _power(base: int, n: int) -> np.ndarray:
    """base ** i, modulo 2 ** 64, for i below n."""
    held = _powers.get((base, 0))
    if held is None or len(held) < n:
        size = max(n, CHUNK * 2)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        held = _powers[base, 0] = np.multiply.accumulate(p)
    return held[:n]


def _grams(codes: np.ndarray, k: int, base: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of every k consecutive codes."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes + np.uint64(7)) * _power(pow(base, -1, 1 << 64), n), dtype=np.uint64, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _power(base, n)[k - 1 :]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    m = len(h)
    if m < w:
        return np.zeros(0, np.uint64)
    x = np.concatenate([h, np.full((-m) % w, _ONES)]).reshape(-1, w)
    head = np.minimum.accumulate(x, 1).ravel()
    tail = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[: m - w + 1], head[w - 1 : m])


class Joined:
    """Texts laid end to end; windows that cross from one into the next are left out."""

    def __init__(self, texts: list[str], span: int):
        self.lens = np.array([len(t) for t in texts], np.int64)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.k = k = span // 2
        self.grams = _grams(self.codes, k, _BASES[0])
        self.mark = _least(self.grams, span - k + 1)
        of = np.repeat(np.arange(len(texts)), self.lens)[: len(self.mark)]
        inside = np.arange(len(self.mark)) + span <= (self.starts + self.lens)[of]
        self.at = np.flatnonzero(inside)
        self.of = of[inside]
        self.span = span


def _packed(lens: list[int], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    start = held = 0
    for k, n in enumerate(lens):
        if held and held + n > most:
            yield start, k
            start = k
            held = 0
        held += n
    if start < len(lens):
        yield start, len(lens)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _marks(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _packed([len(t) for t in texts]):
                j = Joined(texts[a:b], span)
                mark = j.mark[j.at]
                first = np.ones(len(mark), bool)
                first[1:] = (mark[1:] != mark[:-1]) | (j.of[1:] != j.of[:-1])
                pairs = np.unique(np.stack([j.of[first].astype(np.uint64), mark[first]]), axis=1) if first.any() else np.zeros((2, 0), np.uint64)
                of = pa.array(pairs[0].astype(np.int64) + a)
                yield pa.RecordBatch.from_arrays([_signed(np.ascontiguousarray(pairs[1])), batch.column(0).take(of)], ["mark", "rec"])

    return run


def _phrases(span: int):
    """shard, phrase, rec: the phrases of a text at places with a recurring hash, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = span // 2
        for batch in batches:
            row, shard, phrase = [], [], []
            for i, (text, marks) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                wanted = marks.values.field("mark").to_numpy().view(np.uint64)
                homes = marks.values.field("shard").to_numpy()
                order = np.argsort(wanted)
                grams = Joined([text], span).grams
                at = np.flatnonzero(np.isin(grams, wanted))
                found = {(text[p : p + k], h) for p, h in zip(at.tolist(), homes[order][np.searchsorted(wanted[order], grams[at])].tolist())}
                row += [i] * len(found)
                phrase += [p for p, _ in found]
                shard += [h for _, h in found]
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([p.encode("utf-16-le", "surrogatepass") for p in phrase], pa.binary()), batch.column(0).take(at)], ["shard", "phrase", "rec"])

    return run


def _windows(span: int):
    """w, v (digest), rec, tid, pos of the windows around located phrases. Of each shard the phrases come before the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = span // 2
        home, automaton, ready = None, None, False
        for batch in batches:
            row, pos, digests = [], [np.zeros(0, np.int32)], []
            for i, (shard, salt, phrase, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if (shard, salt) != home:
                    home, automaton, ready = (shard, salt), ahocorasick.Automaton(ahocorasick.STORE_LENGTH), False
                if phrase is not None:
                    automaton.add_word(phrase.decode("utf-16-le", "surrogatepass"))
                    continue
                if not len(automaton):
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                at = np.fromiter((end for end, _ in automaton.iter(text)), np.int64) - (k - 1)
                cover = np.zeros(len(text) + 1, np.int32)
                np.add.at(cover, np.maximum(at - (span - k), 0), 1)
                np.add.at(cover, at + 1, -1)
                near = np.flatnonzero(np.cumsum(cover)[: len(text) - span + 1] > 0)
                codes = memoryview(text.encode("utf-32-le", "surrogatepass"))
                row += [i] * len(near)
                pos.append(near.astype(np.int32))
                digests += [hashlib.blake2b(codes[4 * p : 4 * (p + span)], digest_size=12).digest() for p in near.tolist()]
            w = np.frombuffer(b"".join(digests), np.dtype([("w", "<i8"), ("v", "<i4")]))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w["w"])), pa.array(np.ascontiguousarray(w["v"])), *(batch.column(c).take(at) for c in (4, 5)), pa.array(np.concatenate(pos))], ["w", "v", "rec", "tid", "pos"])

    return run


def _several(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one record has, with the least of these (lo)."""
    return df.groupBy(*keys).agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo <> hi").drop("hi")


def shared_windows(records: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(windows, carriers): tid, pos of the windows of ``span`` characters that stand in another record too, some more than once; and tid, table_name, record_key, text of the texts that may hold any."""
    r = records.select("table_name", "record_key", "text").where((F.length("text") >= span) & F.col("record_key").isNotNull())
    r = r.withColumn("rec", F.xxhash64("table_name", "record_key"))
    marks = written(r.select("rec", "text").mapInArrow(_marks(span), "mark bigint, rec bigint"))
    several = written(_several(marks, "mark"))
    shards = max(1, -(-several.count() // SHARD))
    near = several.select("mark", F.pmod(F.hash("lo"), F.lit(shards)).cast("int").alias("shard"))
    per = marks.join(near, "mark").groupBy("rec").agg(F.collect_set(F.struct("mark", "shard")).alias("marks"))
    carriers = written(r.join(per, "rec").withColumn("tid", F.monotonically_increasing_id()))
    phrases = carriers.select("rec", "text", "marks").mapInArrow(_phrases(span), "shard int, phrase binary, rec bigint")
    phrases = _several(phrases, "shard", "phrase").drop("lo")
    sent = carriers.select("rec", "tid", "text", F.explode(F.array_distinct("marks.shard")).alias("shard"))
    # one row per shard
    salts = written(sent.groupBy("shard").agg(F.ceil(F.sum(F.length("text")) / STREAM).cast("int").alias("salts")))
    known = phrases.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "phrase", F.lit(None).cast("string").alias("text"), F.lit(None).cast("bigint").alias("rec"), F.lit(None).cast("bigint").alias("tid"))
    sent = sent.join(salts, "shard").select("shard", F.pmod(F.hash("tid"), F.col("salts")).alias("salt"), F.lit(None).cast("binary").alias("phrase"), "text", "rec", "tid")
    stream = known.unionByName(sent).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("phrase").isNull())
    w = written(stream.mapInArrow(_windows(span), "w bigint, v int, rec bigint, tid bigint, pos int"))
    common = _several(w, "w", "v").drop("lo")
    return w.join(common, ["w", "v"], "left_semi").select("tid", "pos"), carriers.select("tid", "table_name", "record_key", "text")


def shared(records: DataFrame, span: int = SPAN) -> DataFrame:
    """table_name, record_key, n_chars, shared_chars, share, for records with a shared run.

    ``records``: table_name, record_key, text. A run counts if it has at least
    ``span`` characters and stands, exactly equal, in a record of another key.
    Rows with one key are one record: their texts share nothing with each other, and
    of different texts under one key that with most shared characters is reported.
    Null and shorter texts share nothing. Records without a key are left out.
    """
    windows, carriers = shared_windows(records, span)
    before = F.lag("pos").over(Window.partitionBy("tid").orderBy("pos"))
    gained = windows.select("tid", F.least(F.lit(span), F.coalesce(F.col("pos") - before, F.lit(span))).alias("gain"))
    covered = gained.groupBy("tid").agg(F.sum("gain").alias("shared_chars"))
    out = carriers.select("tid", "table_name", "record_key", F.length("text").alias("n_chars")).join(covered, "tid")
    best = F.max(F.struct("shared_chars", F.col("n_chars")))
    out = out.groupBy("table_name", "record_key").agg(best.alias("b"))
    return out.select("table_name", "record_key", "b.n_chars", "b.shared_chars", F.round(F.col("b.shared_chars") / F.col("b.n_chars"), 6).alias("share"))
