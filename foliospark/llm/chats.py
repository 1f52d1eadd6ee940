"""Conversations from message rows.

Order within a chat comes from a range partitioning by chat, instant and id: a very
long chat spans several partitions, and what crosses a boundary (the row before,
the turns so far) is carried by one summary row per chat and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?\s*(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
OFFSET = r"(?:Z|[+-]\d{2}(?::?\d{2})?)$"
SPEAKERS = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant"}


def stripped(c: Column) -> Column:
    """Without blanks and invisible characters around it, in lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""))


def instant(c: Column) -> Column:
    """Microseconds of an ISO text; without an offset it is UTC. Null if it can't be read."""
    t = F.upper(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    t = F.when(t.rlike(ISO), F.regexp_replace(F.regexp_replace(t, ",", "."), r"\s+(?=(?:Z|[+-])[\d:]*$)", ""))
    t = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    t = F.when(F.length(t) > 10, F.regexp_replace(t, r"([ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)([+-]\d{2})$", "$1$2:00")).otherwise(t)
    t = F.when((F.length(t) > 10) & ~t.rlike(OFFSET), F.concat(t, F.lit("Z"))).when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00Z"))).otherwise(t)
    return F.unix_micros(t.try_cast("timestamp"))


def _rows(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per message id: chat (chats.id), id, t, speaker, digest, broken."""
    one = messages.select("id", F.struct("chat_id", "role", "content", "created_at").alias("m")).groupBy("id").agg(F.min("m").alias("m")).select("id", "m.*")
    home = chats.where("id is not null").select(stripped(F.col("id")).alias("k"), F.col("id").alias("chat")).groupBy("k").agg(F.min("chat").alias("chat"))
    role = stripped(F.col("role"))
    speaker = F.coalesce(*[F.when(role == k, F.lit(v)) for k, v in SPEAKERS.items()])
    m = one.select(stripped(F.col("chat_id")).alias("k"), "id", instant(F.col("created_at")).alias("t"), speaker.alias("speaker"), F.sha2("content", 256).alias("digest"), F.coalesce(F.col("content").rlike(r"[^\s\p{Z}\x{85}]"), F.lit(False)).alias("said"))
    m = m.withColumn("broken", F.col("t").isNull() | F.col("speaker").isNull() | ~F.col("said") | F.col("id").isNull())
    return m.join(home, "k").select("chat", "id", "t", "speaker", "digest", "broken")


def conversations(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """chat_id, turn_no, id, role of the turns of the conversations kept.

    Messages are ordered by the instant of created_at, then id. A message with the
    speaker and content of the one right before it is left out. A conversation is
    kept if its chat is in chats, every message can be read (instant, speaker,
    content that isn't blank, id), and the turns left alternate from user to
    assistant and end with the assistant. Rows of one id are one message (of
    different rows the least). Chats without messages give nothing.
    """
    rows = written(_rows(chats, messages).repartitionByRange(F.col("chat"), F.col("t"), F.col("id")).withColumn("b", F.spark_partition_id()))
    within = Window.partitionBy("chat", "b").orderBy("t", "id")
    prev = rows.withColumn("was", F.lag(F.struct("speaker", "digest")).over(within))
    edges = rows.groupBy("chat", "b").agg(F.max(F.struct("t", "id", "speaker", "digest")).alias("end"), F.max("broken").alias("broken"))
    by_part = Window.partitionBy("chat").orderBy("b")
    edges = edges.select("chat", "b", F.lag(F.struct("end.speaker", "end.digest")).over(by_part).alias("carried"), F.max("broken").over(Window.partitionBy("chat")).alias("chat_broken"), F.last("end.speaker").over(Window.partitionBy("chat").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("closing"))
    rows = prev.join(edges.where(~F.col("chat_broken") & (F.col("closing") == "assistant")), ["chat", "b"]).withColumn("was", F.coalesce("was", "carried"))
    left = rows.where(F.col("was").isNull() | (F.col("was.speaker") != F.col("speaker")) | (F.col("was.digest") != F.col("digest")))
    left = left.withColumn("wrong", F.when(F.col("was").isNull(), F.col("speaker") != "user").otherwise(F.col("was.speaker") == F.col("speaker")))
    counts = left.groupBy("chat", "b").agg(F.count("*").alias("n"), F.max("wrong").alias("wrong"))
    counts = counts.select("chat", "b", (F.sum("n").over(by_part) - F.col("n")).alias("before"), F.max("wrong").over(Window.partitionBy("chat")).alias("wrong_chat")).where(~F.col("wrong_chat"))
    turns = left.withColumn("no", F.row_number().over(within)).join(counts, ["chat", "b"])
    return turns.select(F.col("chat").alias("chat_id"), (F.col("no") + F.col("before")).cast("int").alias("turn_no"), "id", F.col("speaker").alias("role"))


def _followed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows (chat, speaker, t, ...) with ``was``: speaker, t and shift of the row before in the chat, in the order given.

    As in ``conversations``: a range partitioning, and one row per chat and partition that carries its end.
    """
    rows = written(rows.repartitionByRange("chat", *order).withColumn("b", F.spark_partition_id()))
    here = F.struct("speaker", "t", "shift")
    ends = rows.groupBy("chat", "b").agg(F.max_by(here, F.struct(*order)).alias("end"))
    ends = ends.select("chat", "b", F.lag("end").over(Window.partitionBy("chat").orderBy("b")).alias("carried"))
    prev = rows.withColumn("was", F.lag(here).over(Window.partitionBy("chat", "b").orderBy(*order)))
    return prev.join(ends, ["chat", "b"]).withColumn("was", F.coalesce("was", "carried"))


def clock_offsets(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """chat_id, replies, offset_s, error_s, infeasible, moved: how far the assistant's clock is off from the user's in each chat.

    In the order of arrival (id) a message stands after the one of the other speaker
    right before it. A reply bounds the offset from above by its distance to the
    question and tells it, less duration_ms; a question bounds it from below by what it
    is early against the reply before. The offset is the least squares fit of all
    replies within the bounds of all messages: their mean, or the bound next to it. A
    chat is infeasible if the bounds exclude each other by more than a second. moved
    counts the messages that, with the offset taken off, change places with the one
    before them in the order of created_at. Chats without a readable reply are left out.
    """
    rows = _rows(chats, messages).where("not broken")
    took = messages.groupBy("id").agg(F.min("duration_ms").alias("ms"))
    rows = rows.join(took, "id").select("chat", "id", "t", "speaker", F.coalesce("ms", F.lit(0)).alias("ms"), F.lit(0).cast("bigint").alias("shift"))
    seen = _followed(rows, "id").where("was.speaker <> speaker").withColumn("gap", (F.col("t") - F.col("was.t")) / 1e6)
    reply = F.col("speaker") == "assistant"
    fit = seen.groupBy("chat").agg(
        F.count_if(reply).alias("replies"), F.avg(F.when(reply, F.col("gap") - F.col("ms") / 1e3)).alias("told"), F.stddev_pop(F.when(reply, F.col("gap") - F.col("ms") / 1e3)).alias("error_s"),
        F.min(F.when(reply, F.col("gap"))).alias("most"), F.max(F.when(~reply, -F.col("gap"))).alias("least"),
    ).where("replies > 0")
    fit = fit.withColumn("offset_s", F.least("most", F.greatest("told", F.coalesce("least", "told")))).withColumn("infeasible", F.coalesce(F.col("least") > F.col("most") + 1, F.lit(False)))
    fit = written(fit)
    moved = rows.join(fit.where("not infeasible").select("chat", "offset_s"), "chat").withColumn("shift", F.when(reply, (F.col("offset_s") * 1e6).cast("bigint")).otherwise(0))
    moved = _followed(moved, "t", "id").where("t - shift < was.t - was.shift").groupBy("chat").agg(F.count("*").alias("moved"))
    out = fit.join(moved, "chat", "left")
    return out.select(F.col("chat").alias("chat_id"), "replies", F.round("offset_s", 3).alias("offset_s"), F.round("error_s", 3).alias("error_s"), "infeasible", F.coalesce("moved", F.lit(0)).alias("moved"))
