"""Token ids of a whole corpus, and token counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe

#: Characters encoded at once in a worker.
CHUNK = 2_000_000


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= CHUNK:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``ids``, the byte-level BPE ids of every text, without special tokens.

    One narrow stage: no shuffle, only the two columns are read. Text that spells a
    special token is ordinary text. An empty text gives an empty list, a null text
    null; rows are kept as they are, repeated keys included. Other columns, whatever
    their names, are not looked at.
    """
    path = path or bpe.default_path("byte_bpe_50k")
    src = df.select(df[key].alias("k"), df[text].alias("t"))
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.load(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            null = texts.is_null()
            values = texts.fill_null("").to_pylist()
            for a, b in _chunks(values):
                ids, offsets = enc.encode_batch(values[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=null[a:b])
                yield pa.RecordBatch.from_arrays([keys[a:b], lists], ["k", "ids"])

    return src.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count(df: DataFrame, text: str = "text", name: str = "n_tokens", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text`` (null for a null text)."""
    path = path or bpe.default_path("byte_bpe_50k")
    keep = keep or ["doc_id"]
    src = df.select(*keep, text) if text not in keep else df.select(*keep)
    at = src.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.load(path)
        for batch in batches:
            texts = batch.column(at)
            values = texts.fill_null("").to_pylist()
            n = np.concatenate([np.zeros(0, np.int64), *(enc.count_batch(values[a:b]) for a, b in _chunks(values))])
            counted = pa.array(n, pa.int64(), mask=np.asarray(texts.is_null()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), counted], [*keep, name])

    return src.mapInArrow(run, f"{fields}, `{name}` bigint")
