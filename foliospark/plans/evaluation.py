"""Queries of the evaluation harness: tables within chunks, number preservation, recency, grids, constrained draws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import chunkers as C
from ..session import table
from .answers import hit_ranks, questions, rows
from .documents import blocks


def tables_whole(spark, d):
    """Tables of which one chunk of the paper holds most distinctive cells (at least two, 80 %): cells meet chunks of their paper only."""
    sig = blocks(spark, d).where("type = 'table' and text is not null").select("stem", "block_ix", B.table_signature(F.col("text")).alias("cells")).where("cells is not null")
    chunks = C.grain_growth(blocks(spark, d)).select("stem", "part", "chunk_index", T.norm(F.col("body")).alias("body")).where(F.contains("body", F.lit("~~~table")))
    cell = sig.select("stem", "block_ix", F.size("cells").alias("n"), F.explode("cells").alias("cell"))
    got = cell.join(chunks, "stem").where(F.contains("body", T.norm(F.col("cell")))).groupBy("stem", "block_ix", "n", "part", "chunk_index").agg(F.count_distinct("cell").alias("k"))
    need = F.greatest(F.lit(2), F.floor(0.8 * F.col("n")))
    whole = got.groupBy("stem", "block_ix").agg(F.bool_or(F.col("k") >= need).alias("whole"))
    return sig.select("stem", "block_ix").join(whole, ["stem", "block_ix"], "left").select("stem", "block_ix", F.coalesce("whole", F.lit(False)).alias("whole"))


def number_preservation(spark, d):
    """Numbers of a paper's tables that its paragraphs and captions also name."""
    b = blocks(spark, d)
    n = b.where("text is not null").select("stem", (F.col("type") == "table").alias("in_table"), F.explode(T.numbers(F.col("text"))).alias("x")).distinct()
    g = n.groupBy("stem", "x").agg(F.bool_or("in_table").alias("t"), F.bool_or(~F.col("in_table")).alias("o"))
    return g.where("t").groupBy("stem").agg(F.count("*").alias("numbers"), F.count_if(F.col("o")).alias("named"))


def opening_blocks(spark, d):
    """The most descriptive block of each paper: abstract, introduction, anything, references; long ones first."""
    b = B.carry(blocks(spark, d)).where((F.col("type") == "paragraph") & B.said(F.col("text")))
    s = F.coalesce("section", F.lit(""))
    bad = T.OPENING_BAD
    kind = F.when(s.rlike(T.OPENING_GOOD), 0).when(s.rlike(T.OPENING_OK), 1).when(s.rlike(bad) | F.substring("text", 1, 200).rlike(bad), 9).otherwise(3)
    key = F.struct(kind.alias("kind"), F.when(F.length("text") >= 400, 0).otherwise(1).alias("short"), F.coalesce("page", F.lit(0)).alias("page"), (-F.length("text")).alias("len"), "block_ix")
    return b.groupBy("stem").agg(F.min(key).alias("k")).select("stem", "k.block_ix", "k.kind")


def recency_questions(spark, d):
    m = table(spark, d, "messages").where("content is not null").select("id", "content").distinct()
    return m.select("id", T.recency_window(F.col("content")).alias("days"), T.how_many(F.col("content")).alias("n"))


def arrival_days(spark, d):
    """Documents by day of arrival, with the label of the day as seen on the last one."""
    day = F.to_date("added_at")
    g = table(spark, d, "documents").groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    last = F.max("day").over(Window.partitionBy(F.lit(0)))  # one row per day
    return g.select("day", "n", T.day_label(F.col("day"), last).alias("label"))


def parser_chunker_grid(spark, d):
    """Every cell of the evaluation, also one without rows."""
    r = rows(spark, d)
    p, c = r.select("parser").distinct(), r.agg(F.array_sort(F.collect_set("chunker")).alias("cs"))
    grid = p.join(F.broadcast(c), F.lit(True)).select("parser", F.explode("cs").alias("chunker"))  # a row of names
    return grid.join(r.groupBy("parser", "chunker").agg(F.count("*").alias("n")), ["parser", "chunker"], "left").fillna(0, ["n"])


def upper_median_hits(spark, d):
    """The upper of the two middle hit lengths per cell (not the mean of both)."""
    h = hit_ranks(spark, d).where("text is not null").groupBy("parser", "chunker", F.length("text").alias("len")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("parser", "chunker").orderBy("len")
    h = h.withColumn("upto", F.sum("c").over(w)).withColumn("all", F.sum("c").over(Window.partitionBy("parser", "chunker")))
    return h.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("parser", "chunker").agg(F.min("len").alias("upper_median"))


def distinct_papers_in_context(spark, d):
    return hit_ranks(spark, d).where("rank <= 6").groupBy("parser", "chunker", "qid").agg(F.count_distinct("filename").alias("papers"))


def retrieval_arms(spark, d):
    """Recall and reciprocal rank per cell, with the 95 % margin of a share."""
    key = ["parser", "chunker"]
    q = hit_ranks(spark, d).groupBy(*key, "qid").agg(F.min(F.when(F.col("filename") == F.col("paper"), F.col("rank"))).alias("r"))
    g = q.groupBy(*key).agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in (1, 3, 5)], F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))
    return g.withColumn("margin", F.round(1.96 * F.sqrt(0.25 / F.col("n")), 6))


def near_span_hits(spark, d):
    """Hits that hold nine tenths of a span's words in one window of its length."""
    h = hit_ranks(spark, d).join(questions(spark, d).where("answer_span is not null").select("qid", "answer_span"), "qid").where("text is not null")
    o = h.withColumn("o", T.span_overlap(T.text_key("answer_span"), T.text_key("text")))
    return o.groupBy("parser", "chunker", "qid").agg(F.round(F.max("o"), 6).alias("overlap"), F.min(F.when(F.col("o") >= 0.9, F.col("rank"))).alias("near_rank"))


def fact_grid(spark, d, label=None):
    """Facts against the windows of the answer they should be in: recall of facts. ``label(fact, window)`` is the entailment model; stands in: all words of the fact occur."""
    f = questions(spark, d).where("facts is not null").select("qid", F.posexplode("facts").alias("fact_ix", "fact")).where(F.length(F.trim("fact")) > 0)
    w = rows(spark, d).where("error is null and answer is not null").select("parser", "chunker", "qid", F.explode(T.windows(F.col("answer"))).alias("window"))
    held = label(F.col("fact"), F.col("window")) if label else F.size(F.array_except(T.words(F.lower("fact")), T.words(F.lower("window")))) == 0
    g = f.join(w, "qid").withColumn("held", held).groupBy("parser", "chunker", "qid", "fact_ix").agg(F.bool_or("held").alias("held"))
    return g.groupBy("parser", "chunker", "qid").agg(F.round(F.avg(F.col("held").cast("double")), 6).alias("fact_recall"), F.count("*").alias("facts"))


def constrained_draw(spark, d):
    """The first of seeded draws of ten papers whose characters pass a bound (the acceptance rule of a sample)."""
    c = B.coverage(blocks(spark, d)).select("stem", "chars")
    draws = c.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("at", F.xxhash64("stem", "draw"))
    pick = draws.withColumn("n", F.row_number().over(Window.partitionBy("draw").orderBy("at", "stem"))).where("n <= 10")
    ok = pick.groupBy("draw").agg(F.sum("chars").alias("chars")).where("chars > 20000")
    return ok.agg(F.min("draw").alias("draw"), F.count("*").alias("accepted"))


def prefix_anti(spark, d):
    """Papers of no document, where a document's stem may also be the beginning of the paper's name: the lengths that stems have make the prefix an equality."""
    used = table(spark, d, "documents").where("stem is not null").select("stem").distinct()
    b = blocks(spark, d).select("stem").distinct().withColumnRenamed("stem", "paper")
    heads = b.select("paper", F.explode(F.sequence(F.lit(1), F.length("paper"))).alias("n")).select("paper", F.expr("substring(paper, 1, n)").alias("stem"))
    hit = heads.join(used, "stem", "left_semi").select("paper").distinct()
    return b.join(hit, "paper", "left_anti")


def judge_scores(spark, d):
    """Judge values (0..2, rounded half to even) as shares: the similarity metric stands in for the judge."""
    r = rows(spark, d).where("error is null and answer_similarity is not null")
    return r.select("parser", "chunker", "qid", T.judge_value(F.col("answer_similarity") * 2).alias("score"))


_FUNCS = (tables_whole, number_preservation, opening_blocks, recency_questions, arrival_days, parser_chunker_grid, upper_median_hits, distinct_papers_in_context, retrieval_arms, near_span_hits, fact_grid, constrained_draw, prefix_anti, judge_scores)
QUERIES = {f.__name__: f for f in _FUNCS}

from .answers import _H, _Q, _R  # noqa: E402
from .documents import _B, _CARRY  # noqa: E402

_BAD = T.OPENING_BAD
SQL = {
    "number_preservation": f"WITH {_B}, n AS (SELECT DISTINCT stem, type = 'table' AS t, unnest(list_distinct(list_transform(regexp_extract_all(text, '({T.NUMBER})', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)))) AS x FROM b WHERE text IS NOT NULL AND type IS NOT NULL UNION SELECT DISTINCT stem, NULL, unnest(list_distinct(list_transform(regexp_extract_all(text, '({T.NUMBER})', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)))) FROM b WHERE text IS NOT NULL AND type IS NULL), g AS (SELECT stem, x, bool_or(t) AS t, bool_or(NOT t) AS o FROM n GROUP BY ALL) SELECT stem, count(*) AS numbers, count(*) FILTER (o) AS named FROM g WHERE t GROUP BY stem",
    "opening_blocks": f"WITH {_CARRY}, o AS (SELECT stem, block_ix, CASE WHEN regexp_matches(coalesce(section, ''), '(?i)abstract') THEN 0 WHEN regexp_matches(coalesce(section, ''), '(?i)introduction|overview|background') THEN 1 WHEN regexp_matches(coalesce(section, ''), '{_BAD}') OR regexp_matches(substring(text, 1, 200), '{_BAD}') THEN 9 ELSE 3 END AS kind, CASE WHEN length(text) >= 400 THEN 0 ELSE 1 END AS short, coalesce(page, 0) AS pg, length(text) AS len FROM k WHERE type = 'paragraph' AND trim(coalesce(text, '')) <> '') SELECT stem, block_ix, kind FROM o QUALIFY row_number() OVER (PARTITION BY stem ORDER BY kind, short, pg, len DESC, block_ix) = 1",
    "arrival_days": "WITH g AS (SELECT CAST(added_at AS DATE) AS day, count(*) AS n FROM documents GROUP BY 1) SELECT day, n, CASE WHEN day IS NULL THEN 'an unknown date' WHEN (SELECT max(day) FROM g) - day = 0 THEN 'today' WHEN (SELECT max(day) FROM g) - day = 1 THEN 'yesterday' ELSE strftime(day, '%Y-%m-%d') END AS label FROM g",
    "parser_chunker_grid": f"WITH {_R} SELECT p.parser, c.chunker, count(r.qid) AS n FROM (SELECT DISTINCT parser FROM r) p CROSS JOIN (SELECT DISTINCT chunker FROM r) c LEFT JOIN r ON r.parser = p.parser AND r.chunker = c.chunker GROUP BY ALL",
    "upper_median_hits": f"WITH {_H}, s AS (SELECT parser, chunker, list_sort(list(length(text))) AS l FROM h WHERE text IS NOT NULL GROUP BY ALL) SELECT parser, chunker, CAST(l[len(l) // 2 + 1] AS INTEGER) AS upper_median FROM s",
    "distinct_papers_in_context": f"WITH {_H} SELECT parser, chunker, qid, count(DISTINCT filename) AS papers FROM h WHERE rank <= 6 GROUP BY ALL",
    "retrieval_arms": f"WITH {_H}, q1 AS (SELECT parser, chunker, qid, min(rank) FILTER (filename = paper) AS r FROM h GROUP BY ALL) SELECT parser, chunker, count(*) AS n, round(avg(CAST(coalesce(r <= 1, false) AS DOUBLE)), 6) AS recall_1, round(avg(CAST(coalesce(r <= 3, false) AS DOUBLE)), 6) AS recall_3, round(avg(CAST(coalesce(r <= 5, false) AS DOUBLE)), 6) AS recall_5, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, round(1.96 * sqrt(0.25 / count(*)), 6) AS margin FROM q1 GROUP BY ALL",
    "prefix_anti": f"WITH {_B}, u AS (SELECT DISTINCT stem FROM documents WHERE stem IS NOT NULL AND stem <> ''), p AS (SELECT DISTINCT stem AS paper FROM b) SELECT paper FROM p WHERE NOT EXISTS (SELECT 1 FROM u WHERE starts_with(p.paper, u.stem))",
    "judge_scores": f"WITH {_R} SELECT parser, chunker, qid, greatest(0, least(2, round_even(answer_similarity * 2, 0))) / 2 AS score FROM r WHERE error IS NULL AND answer_similarity IS NOT NULL",
    "fact_grid": f"""WITH {_Q}, {_R}, f AS (SELECT qid, generate_subscripts(facts, 1) - 1 AS fact_ix, unnest(facts) AS fact FROM q WHERE facts IS NOT NULL),
      w0 AS (SELECT parser, chunker, qid, list_filter(string_split(trim(regexp_replace(lower(answer), '[\\s\\p{{Z}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM r WHERE error IS NULL AND answer IS NOT NULL),
      w AS (SELECT parser, chunker, qid, CASE WHEN len(w) <= 300 THEN [w] ELSE list_transform(range(0, greatest(len(w) - 251, 0) + 1, 250), lambda i: list_slice(w, i + 1, i + 300)) END AS ws FROM w0),
      h AS (SELECT parser, chunker, w.qid, fact_ix, len(list_filter(ws, lambda x: list_has_all(x, list_filter(string_split(trim(regexp_replace(lower(fact), '[\\s\\p{{Z}}]+', ' ', 'g')), ' '), lambda y: y <> '')))) > 0 AS held FROM f JOIN w ON f.qid = w.qid WHERE length(trim(fact)) > 0)
      SELECT parser, chunker, qid, round(avg(CAST(held AS DOUBLE)), 6) AS fact_recall, count(*) AS facts FROM h GROUP BY ALL""",
}
