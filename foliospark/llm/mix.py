"""Mixing sources to target shares by weighted sampling without replacement.

Every document has the key -ln(u) / w, with u from a hash of its id and w its
quality (Efraimidis and Spirakis): the smallest keys are a weighted sample. Each
source gets whole epochs of all its documents first, and then, for the rest of its
budget, the documents of smallest key whose tokens still fit.

The running token sum within a source is made in two steps, so that no task holds
a source: the documents are range-partitioned by source and key (by quantiles, so
whatever the weights, the parts are alike), and sums per part, a window over those few
sums, and a window within each part give the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import tokens

SEED = 20_240_501


def quality(text: Column) -> Column:
    """A weight between 0.2 and 1: the share of letters, and a full mark from 400 characters on."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    n = F.length(text)
    return F.round(0.2 + 0.5 * F.try_divide(letters, n) + 0.3 * F.least(n, F.lit(400)) / 400.0, 6)


def _plan(spark, stats: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: share, epochs and rest. The total is the largest that every source with documents can fill."""
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    s = t.join(F.broadcast(stats), "source", "left").withColumn("has", (F.coalesce("tokens", F.lit(0)) > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("goal", F.when(F.col("has"), F.col("target_share") / F.sum(F.when(F.col("has"), F.col("target_share"))).over(every)).otherwise(0.0))
    s = s.withColumn("total", F.min(F.when(F.col("has"), F.col("tokens") * F.col("max_repeats") / F.col("goal"))).over(every))
    s = s.withColumn("budget", F.when(F.col("has"), F.floor(F.col("goal") * F.col("total") + 1e-6)).otherwise(0))
    s = s.withColumn("epochs", F.when(F.col("has"), F.least(F.floor(F.col("budget") / F.col("tokens")), F.col("max_repeats"))).otherwise(0).cast("int"))
    return s.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.coalesce("tokens", F.lit(0))).otherwise(0))


def mix(docs: DataFrame, targets: DataFrame, path: str | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) for documents (doc_id, source, text) and targets (source, target_share, max_repeats).

    chosen: doc_id, source, n_tokens, copies (at least 1). shares: one row per
    target source with target_share, goal_share (over the sources that have
    documents), docs, tokens, copies, used_tokens and actual_share.

    Documents without a source, with a source that has no target, or with a null or
    empty text are not used. A source without documents gets 0. Repeated rows are
    rows of their own; rows that share a doc_id share their key and order by size.
    """
    src = docs.select("doc_id", "source", "text").where("source is not null and text is not null")
    src = src.join(F.broadcast(targets.select("source").where("source is not null").distinct()), "source", "left_semi")
    src = src.withColumn("w", quality(F.col("text")))
    counted = tokens.count(src, keep=["doc_id", "source", "w"], path=path).where("n_tokens > 0")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    base = written(counted.withColumn("key", -F.log(u) / F.col("w")).drop("w"))
    stats = base.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    plan = written(_plan(docs.sparkSession, stats, targets).coalesce(1))
    small = F.broadcast(plan.select("source", "epochs", "rest"))  # a row per target
    order = ["key", "n_tokens", "doc_id"]
    d = written(base.repartitionByRange("source", *order).withColumn("at", F.spark_partition_id()))
    sums = d.groupBy("source", "at").agg(F.sum("n_tokens").alias("s"))
    before = sums.select("source", "at", (F.sum("s").over(Window.partitionBy("source").orderBy("at")) - F.col("s")).alias("before"))
    within = Window.partitionBy("source", "at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("within", F.sum("n_tokens").over(within)).join(F.broadcast(before), ["source", "at"]).join(small, "source")  # a row per part and source
    d = d.withColumn("copies", F.col("epochs") + (F.col("before") + F.col("within") <= F.col("rest")).cast("int"))
    chosen = written(d.where("copies > 0").select("doc_id", "source", "n_tokens", "copies"))
    used = chosen.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("used_tokens"), F.max("copies").alias("most"))
    s = plan.join(F.broadcast(used), "source", "left").fillna(0, ["copies", "used_tokens", "most", "docs", "tokens"])
    share = F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(Window.partitionBy(F.lit(0))))
    shares = s.select("source", "target_share", F.col("goal").alias("goal_share"), "max_repeats", "docs", "tokens", "copies", "used_tokens", F.col("most").alias("most_repeats"), F.coalesce(share, F.lit(0.0)).alias("actual_share"))
    return chosen, shares
