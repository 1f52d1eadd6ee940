"""The ingestion registry: folding readings and events, counts, medians, windows, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats as S

STATUSES = ("downloaded", "parsed", "processed", "embedded", "error")
PENDING = ("downloaded", "parsed", "processed")
#: Events of the status machine: what creates a paper, what advances it.
EVENT_STATUS = {"signup": "downloaded", "view": "parsed", "click": "processed", "purchase": "embedded", "error": "error"}


def current(readings: DataFrame) -> DataFrame:
    """The latest reading of each paper (by exported_at, then load_no). One partial aggregation: hot papers combine before the shuffle."""
    rest = [c for c in readings.columns if c not in ("filename", "exported_at", "load_no")]
    latest = F.max(F.struct("exported_at", "load_no", *rest)).alias("r")
    return readings.where("filename is not null").groupBy("filename").agg(latest).select("filename", "r.*")


def status_counts(papers: DataFrame) -> DataFrame:
    """n per status, zero where there are none, and their total."""
    spark = papers.sparkSession
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    n = papers.groupBy("status").agg(F.count("*").alias("n"))
    out = every.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))


def seconds(a: str, b: str) -> Column:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return (micros(b) - micros(a)) / 1e6


def stage_medians(papers: DataFrame) -> DataFrame:
    """Median seconds of each stage; null without samples. An even number of samples averages the two in the middle."""
    stages = (("parse", "downloaded_at", "parsed_at"), ("process", "parsed_at", "processed_at"), ("embed", "processed_at", "embedded_at"), ("total", "downloaded_at", "embedded_at"))
    long = papers.select(F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), seconds(a, b).alias("s")) for n, a, b in stages])).alias("x")).select("x.*")
    m = S.quantiles(long, "s", {"median": 0.5}, by="stage").join(long.groupBy("stage").agg(F.count("s").alias("n")), "stage")  # a row per stage
    return m.agg(*[F.max(F.when(F.col("stage") == n, F.col("median"))).alias(f"{n}_s") for n, *_ in stages], *[F.coalesce(F.max(F.when(F.col("stage") == n, F.col("n"))), F.lit(0)).alias(f"{n}_n") for n, *_ in stages])


def domain_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def checkpoints(papers: DataFrame) -> DataFrame:
    """Per domain the latest publication among papers without error: where the next crawl starts."""
    return papers.where("status <> 'error' and domain is not null").groupBy(domain_name(F.col("domain")).alias("domain")).agg(F.max("published_at").alias("published_at"))


def last_embedded(papers: DataFrame, n: int = 40) -> DataFrame:
    """The n latest embedding times, in order."""
    return papers.where("embedded_at is not null").select("filename", "embedded_at").orderBy(F.desc("embedded_at"), "filename").limit(n).orderBy("embedded_at", "filename")


def throughput(papers: DataFrame, now: Column) -> DataFrame:
    """Rate and ETA over the first of 15 minutes, 1 hour, 6 hours that saw two completions; a span of 0 counts as 1 s."""
    at = F.unix_micros(F.col("embedded_at").cast("timestamp")) / 1e6
    end = F.unix_micros(now) / 1e6
    age = end - at
    agg = [F.count_if(F.col("status").isin(*PENDING)).alias("pending")]
    for k, w in enumerate((900, 3600, 21600)):
        inside = (age <= w) & (age >= 0)
        agg += [F.count_if(inside).alias(f"n{k}"), F.max(F.when(inside, at)).alias(f"hi{k}"), F.min(F.when(inside, at)).alias(f"lo{k}")]
    a = papers.agg(*agg)
    pick = lambda f: F.coalesce(*[F.when(F.col(f"n{k}") >= 2, f(k)) for k in range(3)])
    a = a.select("pending", pick(lambda k: F.lit((900, 3600, 21600)[k])).alias("window_s"), pick(lambda k: F.col(f"n{k}")).alias("n"), pick(lambda k: F.greatest(F.col(f"hi{k}") - F.col(f"lo{k}"), F.lit(1.0))).alias("span_s"))
    return a.select("pending", "window_s", "n", F.round(F.col("n") / F.col("span_s"), 6).alias("per_s"), F.round(F.col("pending") / (F.col("n") / F.col("span_s")), 3).alias("eta_s"))


def keep_n(papers: DataFrame, n: int, newest: bool = True) -> DataFrame:
    """The n newest or oldest papers by downloaded_at."""
    order = F.desc_nulls_last("downloaded_at") if newest else F.asc_nulls_last("downloaded_at")
    return papers.where("downloaded_at is not null").orderBy(order, "filename").limit(n)


def prune_plan(files: DataFrame, papers: DataFrame) -> DataFrame:
    """For files (stem, stage): delete a parsed file once the paper is processed or embedded, a processed one once it is embedded; a file of no known paper is kept."""
    done = F.when(F.col("stage") == "parsed", F.col("status").isin("processed", "embedded")).when(F.col("stage") == "processed", F.col("status") == "embedded")
    out = files.join(papers.select(F.col("filename").alias("stem"), "status"), "stem", "left")
    return out.withColumn("action", F.when(F.col("status").isNull(), "unknown").when(F.coalesce(done, F.lit(False)), "delete").otherwise("keep"))


def fold_events(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The status machine over an event log: status and error_count per key.

    ``downloaded`` creates a paper and is ignored once it exists; ``error`` creates or
    marks it and counts up; any other status counts only if the paper exists, and
    resets the count. Two combining aggregations, so no key is collected anywhere.
    """
    status = F.create_map(*[F.lit(x) for kv in EVENT_STATUS.items() for x in kv])[F.col("event_type")]
    e = events.select(F.col(key).alias("k"), "event_id", status.alias("s")).where("s is not null and k is not null")
    first = e.where("s in ('downloaded', 'error')").groupBy("k").agg(F.min("event_id").alias("born"))
    live = e.join(first, "k").where("event_id = born or (event_id > born and s <> 'downloaded')")
    # the errors that count are those after the last advance
    adv = live.groupBy("k").agg(F.max(F.when(F.col("s") != "error", F.col("event_id"))).alias("last_ok"), F.max(F.struct("event_id", "s")).alias("end"))
    n = live.join(adv, "k").groupBy("k").agg(F.count_if((F.col("s") == "error") & (F.col("event_id") > F.coalesce("last_ok", F.lit(-1)))).alias("error_count"), F.max("end.s").alias("status"))
    return n.select(F.col("k").alias(key), "status", "error_count")


def capped_per_domain(papers: DataFrame, cap: int) -> DataFrame:
    """Per domain the newest papers, at most cap (each domain's turn of a crawl)."""
    d = domain_name(F.col("domain"))
    w = Window.partitionBy("d").orderBy(F.desc("published_at"), "filename")
    return papers.where("domain is not null and published_at is not null").withColumn("d", d).withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.greatest(F.lit(1), F.least(F.lit(cap), F.lit(200)))).select(F.col("d").alias("domain"), "n", "filename", "published_at")
