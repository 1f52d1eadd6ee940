"""Chunkers: from texts or blocks to chunks. The registry names them; each is a function on DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import stats as S
from ..session import written


def fixed_token(docs: DataFrame, key: str = "doc_id", size: int = 256, overlap: int = 32) -> DataFrame:
    """Windows of ``size`` words, ``overlap`` of them shared with the next; the last window reaches the end."""
    step = size - overlap
    w = docs.where("text is not null").select(key, T.words(T.lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step)).cast("int")
    w = w.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    return w.select(key, F.col("k").alias("chunk_index"), F.array_join(F.slice("w", F.col("k") * step + 1, size), " ").alias("text"))


def recursive_split(text: str, size: int = 1500, overlap: int = 150, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Split by the coarsest separator that occurs, finer where a part is too long, and merge parts up to ``size``."""
    sep, rest = separators[-1], ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1 :]
            break
    parts = [p for p in (text.split(sep) if sep else list(text)) if p]
    out: list[str] = []
    held: list[str] = []
    total = 0

    def flush() -> None:
        if held and (joined := sep.join(held).strip()):
            out.append(joined)

    for p in parts:
        if len(p) > size and rest:
            flush()
            held, total = [], 0
            out.extend(recursive_split(p, size, overlap, rest))
            continue
        extra = len(p) + (len(sep) if held else 0)
        if held and total + extra > size:
            flush()
            while held and (total > overlap or total + len(p) + len(sep) > size):
                total -= len(held.pop(0)) + (len(sep) if held else 0)
        held.append(p)
        total += len(p) + (len(sep) if len(held) > 1 else 0)
    flush()
    return out


def _chunk_rows(docs: DataFrame, key: str, f: Callable[[str], list[str]]) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, ix, out = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for i, c in enumerate(f(t)):
                    row.append(k), ix.append(i), out.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(ix, pa.int32()), pa.array(out, pa.string())], [key, "chunk_index", "text"])

    return docs.where("text is not null").select(key, "text").mapInArrow(run, f"`{key}` {kind}, chunk_index int, text string")


def recursive_char(docs: DataFrame, key: str = "doc_id", size: int = 1500, overlap: int = 150) -> DataFrame:
    return _chunk_rows(docs, key, lambda t: recursive_split(t, size, overlap))


def hashed_embedding(sentences: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic stand-in for a sentence model: hashed words, normalised."""
    import xxhash

    out = np.zeros((len(sentences), dim))
    for i, s in enumerate(sentences):
        for w in re.findall(r"\w+", s.lower()):
            h = xxhash.xxh64_intdigest(w)
            out[i, h % dim] += 1 if h >> 32 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def semantic_split(text: str, embed: Callable[[list[str]], np.ndarray] = hashed_embedding, cutoff: str = "percentile", most: int = 2000) -> list[str]:
    """Cut between sentences whose neighbours differ most, or before a chunk would exceed ``most``. Fenced blocks stay whole; under three units the text is one chunk."""
    units: list[str] = []
    for k, part in enumerate(re.split(r"(?ms)^(~~~(?:table|formula)\n.*?^~~~$)", text)):
        units += [part] if k % 2 else T.split_sentences_py(part)
    if len(units) < 3:
        return [text.strip()] if text.strip() else []
    v = embed(units)
    d = 1 - (v[1:] * v[:-1]).sum(1)
    if cutoff == "percentile":
        limit = np.percentile(d, 95)
    elif cutoff == "deviation":
        limit = d.mean() + 3 * d.std()
    else:
        q1, q3 = np.percentile(d, [25, 75])
        limit = q3 + 1.5 * (q3 - q1)
    out, held, size = [], [units[0]], len(units[0]) + 1
    for u, gap in zip(units[1:], d):
        if gap > limit or size + len(u) + 1 > most:
            out.append(rejoin(held))
            held, size = [], 0
        held.append(u)
        size += len(u) + 1
    out.append(rejoin(held))
    return [c for c in out if c]


def rejoin(parts: list[str]) -> str:
    """Blanks between sentences, line ends around fences and many-line parts."""
    out = ""
    for p in parts:
        sep = "\n" if out and ("\n" in p or p.startswith("~~~") or out.endswith("~~~")) else " " if out else ""
        out += sep + p
    return out.strip()


def semantic(docs: DataFrame, key: str = "doc_id", cutoff: str = "percentile", most: int = 2000) -> DataFrame:
    return _chunk_rows(docs, key, lambda t: semantic_split(t, cutoff=cutoff, most=most))


def grow(blocks: Iterable[tuple[str, int | None, str]], stem: str, target: int = 1500, most: int = 2000, heading: bool = True) -> list[dict]:
    """Chunks of one paper's blocks (type, page, text), in order; see ``growing``."""
    return list(growing(blocks, stem, target, most, heading))


def growing(blocks: Iterable[tuple[str, int | None, str]], stem: str, target: int = 1500, most: int = 2000, heading: bool = True, title: str | None = None, section: str | None = None) -> Iterator[dict]:
    """Chunks of one paper's blocks (type, page, text), in order, as they get full; ``title`` and ``section`` are those before the first block.

    Title and section give the heading path and are no chunks. Blocks are packed up
    to ``target`` and never across a section. A block above ``most`` is divided at
    sentences (lists at items), one sentence repeated. Tables stand alone, with the
    caption beside them. Formulas stay with the text before; formulas without
    letters or under ten characters, authors and footnotes are left out.
    """
    ready: list[dict] = []
    made = 0
    held: list[tuple[str, int | None, str]] = []

    def emit(parts: list[tuple[str, int | None, str]]) -> None:
        nonlocal made
        body = "\n".join(t for _, _, t in parts)
        if not body.strip():
            return
        path = " › ".join(x for x in (title or stem, section) if x)
        pages = [p for _, p, _ in parts if p is not None]
        ready.append({"text": f"{path}\n\n{body}" if heading else body, "body": body, "title": title or stem, "section": section or "", "page_start": min(pages, default=None), "page_end": max(pages, default=None), "block_types": ",".join(dict.fromkeys(k for k, _, _ in parts)), "chunk_index": made, "n_chars": len(body)})
        made += 1

    def flush() -> None:
        nonlocal held
        if held:
            emit(held)
        held = []

    size = lambda: sum(len(t) + 1 for _, _, t in held)
    rows = ((k, p, t.strip()) for k, p, t in blocks if t and t.strip())
    ahead = next(rows, None)
    while ahead:
        yield from ready
        ready.clear()
        (kind, page, text), ahead = ahead, next(rows, None)
        if kind in ("authors", "footnote"):
            continue
        if kind == "title":
            flush()
            title = title or text
        elif kind == "section":
            flush()
            section = text
        elif kind in ("table", "caption"):
            nxt = ahead[0] if ahead else None
            if kind == "caption" and nxt == "table" or kind == "table" and nxt == "caption":
                flush()
                emit([(kind, page, T_fence(text, kind)), (ahead[0], ahead[1], T_fence(ahead[2], ahead[0]))])
                ahead = next(rows, None)
            elif kind == "table":
                flush()
                emit([(kind, page, T_fence(text, kind))])
            else:
                if held and size() + len(text) > target:
                    flush()
                held.append((kind, page, text))
        elif kind == "formula":
            if len(text) < 10 or not re.search(r"[^\W\d_]", text):
                continue
            if held and size() + len(text) > most:
                flush()
            held.append((kind, page, T_fence(text, kind)))
        elif len(text) > most:
            flush()
            units = re.split(r"\n(?=\s*(?:[-•*–]|\d+[.)]))", text) if kind == "list" else T.split_sentences_py(text)
            part: list[str] = []
            for u in units:
                while len(u) > most:
                    if part:
                        emit([(kind, page, " ".join(part))])
                        part = []
                    emit([(kind, page, u[:most])])
                    u = u[most:]
                if part and sum(map(len, part)) + len(part) + len(u) > target:
                    emit([(kind, page, ("\n" if kind == "list" else " ").join(part))])
                    part = part[-1:] if kind != "list" and len(part[-1]) + len(u) < target else []
                part.append(u)
            if part:
                emit([(kind, page, ("\n" if kind == "list" else " ").join(part))])
        else:
            if held and size() + len(text) > target:
                flush()
            held.append((kind, page, text))
    flush()
    yield from ready


def T_fence(text: str, kind: str) -> str:
    return f"~~~{kind}\n{text}\n~~~" if kind in ("table", "formula") else text


GROWN = "stem string, part int, chunk_index int, title string, section string, page_start int, page_end int, block_types string, n_chars int, body string, text string"
#: Longer papers are packed in parts that begin at the first break after every so many blocks; the chunks are the same.
PART = 20_000


def _parts(b: DataFrame, most: int, part: int) -> DataFrame:
    """stem, bucket, start, before, title, section: where a paper's part may begin in each range of ``part`` blocks but the first.

    ``grow`` has nothing in hand before a title, a section or a text above ``most``,
    so ``start`` is the first of these in the range (null: none); ``before`` is the
    part that blocks ahead of it belong to; title and section are those in force.
    """
    blank = F.regexp_replace("text", r"[\s\p{Z}\x1c-\x1f\x85]", "")
    kind, said = F.coalesce("type", F.lit("paragraph")), F.length(blank) > 0
    plain = ~kind.isin("authors", "footnote", "title", "section", "table", "caption", "formula")
    here = lambda k: F.when((kind == k) & said, F.struct("block_ix", "text"))
    rest = (kind.isin("title", "section") & said) | (plain & (F.length(blank) > most))
    g = b.groupBy("stem", F.greatest(F.lit(0), F.floor(F.col("block_ix") / part)).cast("int").alias("bucket")).agg(F.min(F.when(rest, F.col("block_ix"))).alias("start"), F.min(here("title")).alias("title"), F.max(here("section")).alias("section"))
    w = Window.partitionBy("stem").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last(F.when(F.col("start").isNotNull() & (F.col("bucket") > 0), F.col("bucket")), ignorenulls=True).over(w), F.lit(0))
    g = g.select("stem", "bucket", "start", before.alias("before"), F.first("title", ignorenulls=True).over(w)["text"].alias("title"), F.last("section", ignorenulls=True).over(w)["text"].alias("section"))
    return g.where("bucket > 0")


def grain_growth(blocks: DataFrame, target: int = 1500, most: int = 2000, heading: bool = True, part: int = PART) -> DataFrame:
    """Chunks of every paper. Blocks: stem, block_ix, type, page, text, one row per key.

    A paper of more than ``part`` blocks is packed in parts that begin where nothing
    is in hand, with the title and section in force there; chunk_index counts over
    the paper. Chunks come out as they get full, so a paper without such a place is
    one part, but never in memory as a whole.
    """
    b = written(blocks.select("stem", "block_ix", "type", "page", "text"))
    parts = written(_parts(b, most, part))
    src = b.withColumn("bucket", F.greatest(F.lit(0), F.floor(F.col("block_ix") / part)).cast("int")).join(parts, ["stem", "bucket"], "left")
    of = F.when(F.col("block_ix") >= F.col("start"), F.col("bucket")).otherwise(F.coalesce("before", F.lit(0)))
    src = src.select("stem", of.alias("part"), "block_ix", "type", "page", "text", *[F.when(F.col("block_ix") == F.col("start"), F.trim(c)).alias(c) for c in ("title", "section")])
    src = src.repartition("stem", "part").sortWithinPartitions("stem", "part", "block_ix")
    kinds = {"string": pa.string(), "int": pa.int32()}
    names = [x.split()[0] for x in GROWN.split(", ")]
    fields = [x.split() for x in GROWN.split(", ")[:-1]]  # text repeats body: made of it at the end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[dict]:
            rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("stem", "part", "title", "section", "type", "page", "text"))))
            for (stem, part), group in groupby(rows, lambda r: r[:2]):
                head = next(group)
                state = [x.strip() if x else None for x in head[2:4]]
                for c in growing(((k or "paragraph", p, t) for *_, k, p, t in chain([head], group)), stem, target, most, heading, *state):
                    yield {"stem": stem, "part": part, **c}

        out = chunks()
        while some := list(islice(out, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in some], kinds[t]) for n, t in fields], [n for n, _ in fields])

    got = written(src.mapInArrow(run, GROWN.rsplit(", ", 1)[0]))
    w = Window.partitionBy("stem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = got.groupBy("stem", "part").count().select("stem", "part", F.sum("count").over(w).alias("first")).where("part > 0 and first > 0")
    got = got.join(written(first), ["stem", "part"], "left").withColumn("chunk_index", (F.col("chunk_index") + F.coalesce("first", F.lit(0))).cast("int"))
    path = F.concat_ws(" › ", *[F.when(F.col(c) != "", F.col(c)) for c in ("title", "section")])
    return got.withColumn("text", F.concat(path, F.lit("\n\n"), "body") if heading else F.col("body")).select(*names)


CHUNKERS: dict[str, Callable[..., DataFrame]] = {"fixed_token": fixed_token, "recursive_char": recursive_char, "semantic": semantic, "grain_growth": grain_growth}


def overlap_py(a: str, b: str, cap: int = 800) -> int:
    """The longest end of a that b starts with, white space collapsed, at most cap characters (prefix function, linear time)."""
    a, b = " ".join((a or "").split())[-cap:], " ".join((b or "").split())[:cap]
    s = f"{b}\x00{a}"
    fail = [0] * len(s)
    for i in range(1, len(s)):
        k = fail[i - 1]
        while k and s[i] != s[k]:
            k = fail[k - 1]
        fail[i] = k + (s[i] == s[k])
    return fail[-1] if a and b else 0


def overlaps(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlap of each chunk with the next of its text."""
    nxt = F.lead("text").over(Window.partitionBy(key).orderBy("chunk_index"))
    return chunks.withColumn("next", nxt).where("next is not null").select(key, "chunk_index", T._pair(overlap_py, "int")("text", "next").alias("overlap"))


def shape(chunks: DataFrame, size: Column = None) -> DataFrame:
    """Mean, median, least and most characters, and shares of chunks that start or end within a sentence."""
    n = F.length("text")
    one = chunks.agg(F.count("*").alias("chunks"), F.round(F.avg(n), 4).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg((~T.starts_cleanly(F.col("text"))).cast("double")), 6).alias("mid_start"), F.round(F.avg((~T.ends_terminally(F.col("text"))).cast("double")), 6).alias("mid_end"))
    return one.join(F.broadcast(S.quantiles(chunks.select(n.alias("n")), "n", {"median": 0.5})), F.lit(True))  # one row each
