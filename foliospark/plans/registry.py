"""Queries over the paper registry and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry as R
from ..operators.incremental import changed_per_run
from ..session import table

NOW = "2026-03-17 00:00:00"


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return changed_per_run(table(spark, d, "file_status_table"), table(spark, d, "ingest_runs"))


def papers(spark: SparkSession, d: str) -> DataFrame:
    return R.current(table(spark, d, "file_status_table"))


def registry_current(spark, d):
    return papers(spark, d).select("filename", "status", "error_count", "downloaded_at", "embedded_at")


def status_counts(spark, d):
    return R.status_counts(papers(spark, d))


def stage_medians(spark, d):
    return R.stage_medians(papers(spark, d))


def crawl_checkpoints(spark, d):
    return R.checkpoints(papers(spark, d))


def last_embedded(spark, d):
    return R.last_embedded(papers(spark, d))


def registry_errors(spark, d):
    return papers(spark, d).where("status = 'error'").select("filename", "error_count", "last_error")


def pending_papers(spark, d):
    return papers(spark, d).where(F.col("status").isin(*R.PENDING)).select("filename", "status").orderBy("filename")


def recent_papers(spark, d):
    at = F.coalesce("embedded_at", "downloaded_at")
    return papers(spark, d).select("filename", at.alias("at")).where(F.col("at") >= F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 7 days")).orderBy(F.desc("at"), "filename")


def throughput_window(spark, d):
    return R.throughput(papers(spark, d), F.lit(NOW).cast("timestamp"))


def keep_newest(spark, d):
    return R.keep_n(papers(spark, d), 100).select("filename", "downloaded_at")


def keep_oldest(spark, d):
    return R.keep_n(papers(spark, d), 50, newest=False).select("filename", "downloaded_at")


def prune_plan(spark, d):
    files = table(spark, d, "documents").where("stem is not null").select("stem").distinct()
    files = files.withColumn("stage", F.explode(F.array(F.lit("parsed"), F.lit("processed"))))
    return R.prune_plan(files, papers(spark, d)).select("stem", "stage", "status", "action")


def prune_counters(spark, d):
    return prune_plan(spark, d).agg(F.count("*").alias("checked"), F.count_if(F.col("action") == "delete").alias("removed"), F.count_if(F.col("action") == "keep").alias("kept"), F.count_if(F.col("action") == "unknown").alias("unknown"))


def already_known(spark, d):
    p = papers(spark, d).select(F.col("filename").alias("stem"), F.lit(True).alias("hit"))
    return table(spark, d, "documents").select("doc_id", "stem").join(p, "stem", "left").select("doc_id", F.col("hit").isNotNull().alias("already_have"))


def unregistered_stems(spark, d):
    return table(spark, d, "documents").where("stem is not null").select("stem").distinct().join(papers(spark, d).select(F.col("filename").alias("stem")), "stem", "left_anti")


def embedded_with_blocks(spark, d):
    p = papers(spark, d).where("status = 'embedded'").select(F.col("filename").alias("stem"))
    return p.join(table(spark, d, "blocks").select("stem"), "stem", "left_semi").orderBy("stem")


def domain_cycle(spark, d):
    return R.capped_per_domain(papers(spark, d), 5)


def terminal_progress(spark, d):
    return papers(spark, d).agg(F.count_if(F.col("status") == "embedded").alias("embedded"), F.count_if(F.col("status") == "error").alias("error"), F.count_if(F.col("status").isin(*R.PENDING)).alias("pending"))


def status_fold(spark, d):
    return R.fold_events(table(spark, d, "events"))


def events_tumbling(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def events_sliding(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "6 hours", "3 hours")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("from_ts"), "n", "errors")


def events_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return s.select("user_id", F.col("a").cast("timestamp_ntz").alias("first_ts"), F.col("b").cast("timestamp_ntz").alias("last_ts"), "n")


def events_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"))


_FUNCS = (p6_found, registry_current, status_counts, stage_medians, crawl_checkpoints, last_embedded, registry_errors, pending_papers, recent_papers, throughput_window, keep_newest, keep_oldest, prune_plan, prune_counters, already_known, unregistered_stems, embedded_with_blocks, domain_cycle, terminal_progress, status_fold, events_tumbling, events_sliding, events_sessions, events_props)
QUERIES = {f.__name__: f for f in _FUNCS}

_CUR = "WITH p AS (SELECT * FROM file_status_table WHERE filename IS NOT NULL QUALIFY row_number() OVER (PARTITION BY filename ORDER BY exported_at DESC NULLS LAST, load_no DESC NULLS LAST, domain DESC NULLS LAST, status DESC NULLS LAST) = 1)"
_SEC = "(epoch_us({b}) - epoch_us({a})) / 1e6"
_STAGES = (("parse", "downloaded_at", "parsed_at"), ("process", "parsed_at", "processed_at"), ("embed", "processed_at", "embedded_at"), ("total", "downloaded_at", "embedded_at"))
_PEND = "('downloaded', 'parsed', 'processed')"
_PRUNE = f"""{_CUR}, f AS (SELECT DISTINCT stem FROM documents WHERE stem IS NOT NULL), g AS (SELECT stem, unnest(['parsed', 'processed']) AS stage FROM f),
 r AS (SELECT g.stem, g.stage, p.status, CASE WHEN p.status IS NULL THEN 'unknown' WHEN (stage = 'parsed' AND p.status IN ('processed', 'embedded')) OR (stage = 'processed' AND p.status = 'embedded') THEN 'delete' ELSE 'keep' END AS action FROM g LEFT JOIN p ON p.filename = g.stem)"""

SQL = {
    "p6_found": """
WITH ok AS (SELECT run_no, last_load, lag(run_no) OVER (ORDER BY run_no) AS prev FROM ingest_runs WHERE outcome = 'ok'),
s AS (SELECT run_no, filename, status, downloaded_at, parsed_at, processed_at, embedded_at FROM ok JOIN file_status_table f ON f.load_no <= ok.last_load
 QUALIFY row_number() OVER (PARTITION BY run_no, filename ORDER BY exported_at DESC NULLS LAST, load_no DESC, status DESC) = 1)
SELECT a.run_no, a.filename FROM s a JOIN ok ON ok.run_no = a.run_no LEFT JOIN s b ON b.run_no = ok.prev AND b.filename = a.filename
WHERE b.filename IS NULL OR a.status IS DISTINCT FROM b.status OR a.downloaded_at IS DISTINCT FROM b.downloaded_at OR a.parsed_at IS DISTINCT FROM b.parsed_at OR a.processed_at IS DISTINCT FROM b.processed_at OR a.embedded_at IS DISTINCT FROM b.embedded_at""",
    "registry_current": f"{_CUR} SELECT filename, status, error_count, downloaded_at, embedded_at FROM p",
    "status_counts": f"{_CUR} SELECT s AS status, count(p.filename) AS n, CAST(sum(count(p.filename)) OVER () AS BIGINT) AS total FROM unnest(['downloaded', 'parsed', 'processed', 'embedded', 'error']) t(s) LEFT JOIN p ON p.status = s GROUP BY s",
    "stage_medians": f"{_CUR} SELECT " + ", ".join(f"median({_SEC.format(a=a, b=b)}) AS {n}_s, count({_SEC.format(a=a, b=b)}) AS {n}_n" for n, a, b in _STAGES) + " FROM p",
    "crawl_checkpoints": f"{_CUR} SELECT lower(trim(regexp_replace(domain, '\\s+', ' ', 'g'))) AS domain, max(published_at) AS published_at FROM p WHERE status <> 'error' AND domain IS NOT NULL GROUP BY 1",
    "last_embedded": f"{_CUR} SELECT filename, embedded_at FROM p WHERE embedded_at IS NOT NULL ORDER BY embedded_at DESC, filename LIMIT 40",
    "registry_errors": f"{_CUR} SELECT filename, error_count, last_error FROM p WHERE status = 'error'",
    "pending_papers": f"{_CUR} SELECT filename, status FROM p WHERE status IN {_PEND}",
    "recent_papers": f"{_CUR} SELECT filename, coalesce(embedded_at, downloaded_at) AS at FROM p WHERE coalesce(embedded_at, downloaded_at) >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY",
    "throughput_window": f"""{_CUR}, a AS (SELECT status, epoch_us(embedded_at) / 1e6 AS done, epoch_us(TIMESTAMP '{NOW}') / 1e6 - epoch_us(embedded_at) / 1e6 AS age FROM p),
 w AS (SELECT w, count(*) AS n, greatest(max(done) - min(done), 1.0) AS span FROM a JOIN unnest([900, 3600, 21600]) t(w) ON age BETWEEN 0 AND w GROUP BY w HAVING count(*) >= 2 ORDER BY w LIMIT 1),
 q AS (SELECT count(*) FILTER (status IN {_PEND}) AS pending FROM p)
 SELECT pending, CAST(w AS INTEGER) AS window_s, n, round(n / span, 6) AS per_s, round(pending / (n / span), 3) AS eta_s FROM q LEFT JOIN w ON true""",
    "keep_newest": f"{_CUR} SELECT filename, downloaded_at FROM p WHERE downloaded_at IS NOT NULL ORDER BY downloaded_at DESC, filename LIMIT 100",
    "keep_oldest": f"{_CUR} SELECT filename, downloaded_at FROM p WHERE downloaded_at IS NOT NULL ORDER BY downloaded_at, filename LIMIT 50",
    "prune_plan": f"{_PRUNE} SELECT * FROM r",
    "prune_counters": f"{_PRUNE} SELECT count(*) AS checked, count(*) FILTER (action = 'delete') AS removed, count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action = 'unknown') AS unknown FROM r",
    "already_known": "SELECT doc_id, coalesce(stem IN (SELECT filename FROM file_status_table WHERE filename IS NOT NULL), false) AS already_have FROM documents",
    "unregistered_stems": "SELECT DISTINCT stem FROM documents WHERE stem IS NOT NULL AND stem NOT IN (SELECT filename FROM file_status_table WHERE filename IS NOT NULL)",
    "embedded_with_blocks": f"{_CUR} SELECT filename AS stem FROM p WHERE status = 'embedded' AND EXISTS (SELECT 1 FROM blocks b WHERE b.stem = filename)",
    "domain_cycle": f"{_CUR} SELECT lower(trim(regexp_replace(domain, '\\s+', ' ', 'g'))) AS domain, CAST(row_number() OVER (PARTITION BY lower(trim(regexp_replace(domain, '\\s+', ' ', 'g'))) ORDER BY published_at DESC, filename) AS INTEGER) AS n, filename, published_at FROM p WHERE domain IS NOT NULL AND published_at IS NOT NULL QUALIFY n <= 5",
    "terminal_progress": f"{_CUR} SELECT count(*) FILTER (status = 'embedded') AS embedded, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status IN {_PEND}) AS pending FROM p",
    "status_fold": """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'downloaded' WHEN 'view' THEN 'parsed' WHEN 'click' THEN 'processed' WHEN 'purchase' THEN 'embedded' WHEN 'error' THEN 'error' END AS s FROM events),
 b AS (SELECT *, min(event_id) FILTER (s IN ('downloaded', 'error')) OVER (PARTITION BY user_id) AS born FROM e),
 l AS (SELECT *, max(event_id) FILTER (s <> 'error') OVER (PARTITION BY user_id) AS ok FROM b WHERE event_id = born OR (event_id > born AND s <> 'downloaded'))
 SELECT user_id, arg_max(s, event_id) AS status, count(*) FILTER (s = 'error' AND event_id > coalesce(ok, -1)) AS error_count FROM l GROUP BY user_id""",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL (3 * k) HOUR AS from_ts, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events, range(2) t(k) GROUP BY 1",
    "events_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k",
    "events_props": "SELECT event_type, count(json_extract_string(props, '$.k')) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS k_max FROM events GROUP BY 1",
}
