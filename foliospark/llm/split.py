"""Cutting oversized texts at natural boundaries, with overlap.

The text is divided by a hierarchy of separators: section, paragraph, line,
sentence, word, character. A part above the limit is divided by the next finer
separator, a part below it is kept; parts are packed greedily into pieces up to the
limit. A piece starts with the end of the piece before it, from the first sentence
(else word) that begins within the last ``overlap`` characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION = re.compile(r"\n(?=#{1,6} |={2,6} ?[^=\s]|\\(?:sub)*section\*?\{|<[hH][1-6]|\d{1,2}(?:\.\d+)* [^\W\d_a-z][^\n]{0,80}\n)")
PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
LINE = re.compile(r"\n")
SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？][”』」）]*\s*")
WORD = re.compile(r"\s+")
LEVELS = (SECTION, PARAGRAPH, LINE, SENTENCE, WORD)


def _safe(text: str, start: int, at: int) -> int:
    """``at``, or a place shortly before it that parts no letter from its marks or joiners."""
    k = at
    while k > start + 1 and k < len(text) and (unicodedata.combining(text[k]) or text[k] in "‍️" or text[k - 1] == "‍"):
        k -= 1
        if at - k > 32:
            return at
    return k


def _parts(text: str, start: int, end: int, limit: int) -> list[int]:
    """Ends of the parts of text[start:end], each part at most ``limit`` long."""
    out: list[int] = []
    todo = [(start, end, 0)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= limit:
            out.append(b)
        elif level == len(LEVELS):
            at = a
            while b - at > limit:
                at = _safe(text, at, at + limit)
                out.append(at)
            out.append(b)
        else:
            cuts = [c for m in LEVELS[level].finditer(text, a, b) if a < (c := m.end()) < b]
            edges = [a, *cuts, b]
            todo.extend((x, y, level + 1) for x, y in zip(edges[-2::-1], edges[:0:-1]))
    return out


def cut(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Start and end of every piece. Pieces follow each other; each begins at most ``overlap`` before the last one's end."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if len(text) <= limit:
        return [(0, len(text))]
    overlap = min(overlap, limit - 1)
    room = limit - overlap if overlap * 2 <= limit else max(1, limit // 2)
    ends = _parts(text, 0, len(text), room)
    sentences = words = None
    if overlap:
        sentences = [m.end() for m in SENTENCE.finditer(text)]
        words = [m.end() for m in WORD.finditer(text)]
    out: list[tuple[int, int]] = []
    start = done = k = 0
    while k < len(ends):
        while k < len(ends) and ends[k] - start <= limit:
            k += 1
        end = ends[k - 1]
        out.append((start, end))
        if k == len(ends):
            break
        done, start = end, end
        if overlap:
            least = max(end - overlap, ends[k] - limit, out[-1][0] + 1)
            for marks in (sentences, words):
                i = bisect_left(marks, least)
                if i < len(marks) and marks[i] < done:
                    start = marks[i]
                    break
            else:
                if least < done and not any(x in text[least:done] for x in " \n\t"):
                    start = _safe(text, out[-1][0], least)
                    start = start if start >= least else done
    return out


def pieces(items: DataFrame, keep: list[str], max_col: str = "max_chars", overlap_col: str = "overlap_chars", text: str = "text") -> DataFrame:
    """Pieces of the items above their limit: ``keep``, piece_no (from 1), n_pieces, start_char, end_char, piece.

    Sizes are Unicode characters. The filter runs before Python, so short and null
    texts never leave the JVM. A repeated row gives repeated pieces.
    """
    src = items.where(F.length(text) > F.col(max_col)).select(*keep, F.col(text).alias("text__"), F.col(max_col).alias("max__"), F.col(overlap_col).alias("overlap__"))
    fields = [f for f in src.schema if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keep)
            texts, limits, overlaps = (batch.column(n + k).to_pylist() for k in range(3))
            row, no, of, start, end, piece = [], [], [], [], [], []
            for k, (t, m, o) in enumerate(zip(texts, limits, overlaps)):
                found = cut(t, m, o or 0)
                for i, (a, b) in enumerate(found, 1):
                    row.append(k), no.append(i), of.append(len(found)), start.append(a), end.append(b), piece.append(t[a:b])
            kept = batch.select(keep).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(no, pa.int32()), pa.array(of, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(piece, pa.string())], [*keep, "piece_no", "n_pieces", "start_char", "end_char", "piece"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return src.mapInArrow(run, f"{schema}, piece_no int, n_pieces int, start_char bigint, end_char bigint, piece string")


def limits(budgets: DataFrame, purpose: str) -> DataFrame:
    """table_name, max_chars, overlap_chars of one purpose; a table has one row."""
    b = budgets.where(F.col("purpose") == purpose).groupBy(F.col("item_table").alias("table_name"))
    return b.agg(F.max("max_chars").alias("max_chars"), F.coalesce(F.max("overlap_chars"), F.lit(0)).alias("overlap_chars"))


def oversized(blocks: DataFrame, documents: DataFrame, budgets: DataFrame) -> DataFrame:
    """Pieces of blocks (key stem/block_ix, repeated rows once) and documents (key doc_id) above the 'cut' limits."""
    small = F.broadcast(limits(budgets, "cut"))  # a row per table
    b = blocks.select(F.lit("blocks").alias("table_name"), F.concat(F.coalesce("stem", F.lit("")), F.lit("/"), F.coalesce(F.col("block_ix").cast("string"), F.lit(""))).alias("item_key"), "text")
    d = documents.select(F.lit("documents").alias("table_name"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("item_key"), "text")
    items = b.unionByName(d).join(small, "table_name").where(F.length("text") > F.col("max_chars"))
    return pieces(items.dropDuplicates(["table_name", "item_key"]), ["table_name", "item_key"])
