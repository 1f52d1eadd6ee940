"""The queries of this subpackage: name -> (spark, data directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import chats, garble, markup, mix, pack, pairs, spans, split, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "dataset"), table(spark, d, "rag_round2_rows"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.found(table(spark, d, "documents"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.cleaned(table(spark, d, "documents"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "dataset").select(F.lit("dataset").alias("table_name"), F.col("qid").alias("record_key"), F.col("answer_span").alias("text"))
    t = table(spark, d, "documents").select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("record_key"), "text")
    return q.unionByName(t)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_shared(spark, d).select("table_name", "record_key")


def p3_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared(_records(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_turns(spark, d).select("chat_id", "turn_no", "id")


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    return chats.conversations(table(spark, d, "chats"), table(spark, d, "messages"))


def p4_clocks(spark: SparkSession, d: str) -> DataFrame:
    return chats.clock_offsets(table(spark, d, "chats"), table(spark, d, "messages"))


#: Sources that the documents of one container may come from, at most.
SOURCES = 4


def _packed(spark: SparkSession, d: str, strict: bool = False) -> DataFrame:
    return pack.containers(table(spark, d, "blocks"), table(spark, d, "documents"), table(spark, d, "budgets"), SOURCES, strict)


def p5_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, with copies beside copies where nothing else has room, and without."""
    return pack.fill_report(_packed(spark, d)).withColumn("rule", F.lit("copies give way")).unionByName(pack.fill_report(_packed(spark, d, True)).withColumn("rule", F.lit("strict")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pieces(spark, d).where("piece_no = 1 and n_pieces > 1").select("table_name", "item_key")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized(table(spark, d, "blocks"), table(spark, d, "documents"), table(spark, d, "budgets"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garble.garbled(table(spark, d, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garble.restored(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p2_found, p2_clean, p3_found, p3_shared, p4_found, p4_turns, p4_clocks, p5_pack, p5_fill, p7_found, p7_pieces, p8_ids, p9_mix, p9_shares, p10_found, p10_restored)
    return {f.__name__: f for f in every}
