"""Queries over questions, generated answers and their scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats as S
from ..operators.contains import contained
from ..session import table, written

METRICS = ("paper_hit_5", "mrr_near", "answer_similarity", "answer_keyword_recall")
BASELINE = "recursive_char"


def questions(spark, d):
    """One row per qid; the rows of one qid are exact copies."""
    q = table(spark, d, "dataset").where("qid is not null")
    rest = [c for c in q.columns if c != "qid"]
    return q.groupBy("qid").agg(*[F.first(c).alias(c) for c in rest])


def rows(spark, d):
    """One row per cell and question."""
    r = table(spark, d, "rag_round2_rows")
    key = ["parser", "chunker", "qid"]
    return r.groupBy(*key).agg(*[F.first(c).alias(c) for c in r.columns if c not in key])


def question_stems(spark, d):
    return questions(spark, d).select("qid", T.sanitize_filename(F.col("question")).alias("stem"))


def question_complexity(spark, d):
    return questions(spark, d).select("qid", T.complexity(F.col("question"), F.coalesce(F.size("keywords"), F.lit(0)), F.col("answer_span")).alias("score"))


def question_checks(spark, d):
    q = questions(spark, d)
    n = lambda c: F.size(T.words(F.coalesce(F.col(c), F.lit(""))))
    reason = F.when(n("answer_span") < 6, "span too short to be evidence").when(n("question") < 8, "question too short").when(F.coalesce("short_answer", F.lit("")).rlike(r"^\s*\[\d+\]\s*$"), "answer is a citation").when((F.coalesce("short_answer", F.lit("")) == "") | F.col("facts").isNull() | (F.size("facts") < 1), "missing short answer or facts")
    return q.select("qid", reason.alias("reason"))


def candidate_completeness(spark, d):
    full = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    return questions(spark, d).where(full("question") & full("ideal_answer") & full("answer_span")).select("qid")


def question_counts(spark, d):
    return questions(spark, d).groupBy("source", "served_model").agg(F.count("*").alias("n"))


def shortlist(spark, d):
    """One question per paper first, by complexity; then the others, up to 150 (a report)."""
    from pyspark.sql import Window

    w = Window.partitionBy("paper").orderBy(F.desc_nulls_last("complexity"), "qid")
    q = questions(spark, d).where("paper is not null").withColumn("first", (F.row_number().over(w) > 1).cast("int"))
    return q.orderBy("first", F.desc_nulls_last("complexity"), "qid").limit(150).select("qid", "paper", "first")


def usable_rows(spark, d):
    return rows(spark, d).where("error is null and gen_error is null and answer is not null").groupBy("parser", "chunker").agg(F.count("*").alias("n"))


def answer_refusals(spark, d):
    return rows(spark, d).where("error is null").groupBy("parser", "chunker").agg(F.count_if(T.is_refusal(F.col("answer"))).alias("refusals"), F.count("*").alias("n"))


def answer_numbers(spark, d):
    return questions(spark, d).select("qid", T.numbers(F.col("ideal_answer")).alias("numbers"))


def answer_sentences(spark, d):
    return questions(spark, d).select("qid", F.posexplode(T.answer_sentences(F.col("ideal_answer"))).alias("ix", "sentence"))


def answer_windows(spark, d):
    w = T.windows(F.col("answer"))
    return rows(spark, d).where("answer is not null").select("parser", "chunker", "qid", F.size(w).alias("n_windows"), F.length(w[0]).alias("first_chars"))


def string_metrics(spark, d):
    r = rows(spark, d).where("error is null and answer is not null").join(questions(spark, d).select("qid", "ideal_answer", "short_answer"), "qid")
    r = r.withColumn("no", T.is_refusal(F.col("answer"))).withColumn("s", T.string_scores("answer", "ideal_answer", "short_answer"))
    match = T.short_answer_match(F.col("short_answer"), F.col("answer"), F.col("s.held"))
    score = lambda c: F.round(F.when(F.col("no"), 0.0).otherwise(c), 6)
    return r.select("parser", "chunker", "qid", F.col("no").alias("refusal"), *[score(F.col(f"s.{c}")).alias(c) for c in ("token_f1", "rouge_l", "chrf")], score(match).alias("short_match"))


def token_scores(spark, d):
    """The metrics of ``string_metrics`` that SQL can express."""
    return string_metrics(spark, d).drop("rouge_l")


def long_metrics(spark, d):
    """cell, source, paper, qid, metric, value: absent metrics are missing rows, null ones nulls."""
    r = rows(spark, d).where("error is null").withColumn("cell", F.concat_ws("|", "parser", "chunker"))
    return r.unpivot(["cell", "parser", "chunker", "source", "paper", "qid"], list(METRICS), "metric", "value")


def cell_means(spark, d):
    return long_metrics(spark, d).groupBy("cell", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def exact_mean(c: str) -> Column:
    """The mean to six places, half up, from whole numbers of 1e-12: the order of the sum can't tell."""
    total, n = F.sum(F.round(F.col(c) * 1e12).cast("decimal(38,0)")), F.count(c)
    return F.when(n > 0, F.floor(total / (n * 1_000_000) + F.lit("0.5").cast("decimal(2,1)")).cast("double") / 1e6)


def cell_means_by_source(spark, d):
    return long_metrics(spark, d).groupBy("cell", "source", "metric").agg(exact_mean("value").alias("mean"))


def metric_spread(spark, d):
    m = long_metrics(spark, d).groupBy("cell", "metric").agg(F.avg("value").alias("m"))
    return m.groupBy("metric").agg(F.round(F.max("m") - F.min("m"), 6).alias("spread"))


def paired_tests(spark, d):
    return S.paired_tests(long_metrics(spark, d), BASELINE)


def holm_survivors(spark, d):
    return S.holm(paired_tests(spark, d), ["metric"], "p").select("metric", "parser", "chunker", "p", "holm")


def parser_verdicts(spark, d):
    return S.verdicts(S.holm(paired_tests(spark, d), ["metric", "chunker"], "p"), ["metric", "chunker"], 0.05)


def fixed_sequence(spark, d):
    return S.fixed_sequence(parser_verdicts(spark, d), list(METRICS), ["chunker"])


def wilcoxon_tests(spark, d):
    return S.wilcoxon(S.paired(long_metrics(spark, d), BASELINE), ["metric", "parser", "chunker"])


def bootstrap_intervals(spark, d):
    return S.cluster_bootstrap(S.paired(long_metrics(spark, d), BASELINE), ["metric", "parser", "chunker"], "paper")


def metric_correlation(spark, d):
    r = rows(spark, d).where("error is null and answer_similarity is not null and answer_keyword_recall is not null")
    return S.correlations(r, "answer_similarity", "answer_keyword_recall")


def hit_ranks(spark, d):
    """Hits as rows: cell, qid, rank, filename, text."""
    return rows(spark, d).where("error is null").select("parser", "chunker", "qid", "paper", F.posexplode("hits").alias("ix", "hit")).select("parser", "chunker", "qid", "paper", (F.col("ix") + 1).alias("rank"), "hit.filename", "hit.text")


def ir_paper_metrics(spark, d):
    """Paper hits, reciprocal rank and precision; nothing but the ranks of each question is grouped."""
    key = ["parser", "chunker", "qid"]
    right = F.col("filename") == F.col("paper")
    g = hit_ranks(spark, d).groupBy(*key).agg(F.min(F.when(right, F.col("rank"))).alias("r"), *[F.count_if(right & (F.col("rank") <= k)).alias(f"c{k}") for k in (1, 3, 5)])
    return g.select(*key, *[F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0)).alias(f"paper_hit_{k}") for k in (1, 3, 5)], F.round(F.coalesce(1 / F.col("r"), F.lit(0.0)), 6).alias("mrr_paper"), *[F.round(F.col(f"c{k}") / k, 6).alias(f"precision_{k}") for k in (1, 3, 5)])


def ir_span_metrics(spark, d):
    """Span hit, nDCG@10 and hits within a character budget: graded 2 for the span, 1 for the right paper."""
    from pyspark.sql import Window

    key = ["parser", "chunker", "qid"]
    h = hit_ranks(spark, d).join(questions(spark, d).select("qid", "answer_span"), "qid").withColumn("found", F.coalesce(F.contains(T.norm(F.col("text"), True), T.norm(F.col("answer_span"), True)), F.lit(False)))
    used = F.sum(F.length("text")).over(Window.partitionBy(*key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    h = h.withColumn("used", F.coalesce(used, F.lit(0))).withColumn("grade", F.when(F.col("found"), 2).when(F.col("filename") == F.col("paper"), 1).otherwise(0))
    import math

    ideal = sum((2 if i == 0 else 1) / math.log2(i + 2) for i in range(10))
    return h.groupBy(*key).agg(
        F.round(F.coalesce(1 / F.min(F.when(F.col("found"), F.col("rank"))), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.sum(F.when(F.col("rank") <= 10, F.col("grade") / F.log2(F.col("rank") + 1)).otherwise(0.0)) / ideal, 6).alias("ndcg_10"),
        *[F.bool_or(F.col("found") & (F.col("used") < b)).alias(f"span_hit_{b}ch") for b in (200, 400, 2000)],
    )


def keyword_recall(spark, d):
    """Share of a question's keywords in its first six hits; null without keywords."""
    q = questions(spark, d).select("qid", F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.length(F.trim(k)) > 0).alias("kws"))
    r = rows(spark, d).where("error is null").select("parser", "chunker", "qid", F.array_join(F.transform(F.slice(F.coalesce("hits", F.array().cast("array<struct<filename:string,text:string>>")), 1, 6), lambda h: h["text"]), " ").alias("ctx")).join(q, "qid")
    ctx = T.norm(F.col("ctx"), True)
    got = F.size(F.filter("kws", lambda k: F.contains(ctx, T.norm(k, True))))
    return r.select("parser", "chunker", "qid", F.round(F.when(F.size("kws") > 0, got / F.size("kws")), 6).alias("keyword_recall"), F.length("ctx").alias("context_chars"))


def span_in_document(spark, d):
    """Does the answer span stand in a document of the question's paper? Equal stems only, spans by containment."""
    q = written(questions(spark, d).where("paper is not null and length(answer_span) >= 15").select("qid", "paper", T.norm(F.col("answer_span")).alias("span")))
    docs = table(spark, d, "documents").where("stem is not null and text is not null").withColumnRenamed("stem", "paper")
    sizes = written(docs.groupBy("paper").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes")).join(q.groupBy("paper").agg(F.sum(F.octet_length("span")).alias("spans")), "paper"))
    found = contained(
        q.select(F.col("qid").alias("id"), F.col("paper").alias("group"), "span"),
        docs.select(F.col("doc_id").alias("id"), F.col("paper").alias("group"), T.norm(F.col("text")).alias("text")),
        sizes.select(F.col("paper").alias("group"), "bytes", "spans"),
    )
    hit = q.join(sizes.select("paper", "docs"), "paper", "left").join(found.select(F.col("id").alias("qid"), F.lit(True).alias("hit")), "qid", "left")
    return hit.select("qid", F.coalesce("hit", (F.col("span") == "") & F.col("docs").isNotNull(), F.lit(False)).alias("found"), F.coalesce("docs", F.lit(0)).alias("docs"))


def numbered_context(spark, d):
    """The first six hits as numbered excerpts."""
    one = F.transform(F.slice("hits", 1, 6), lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["filename"], F.lit("\n"), h["text"]))
    return rows(spark, d).where("error is null and hits is not null").select("parser", "chunker", "qid", F.array_join(one, "\n\n").alias("context"))


_FUNCS = (question_stems, question_complexity, question_checks, candidate_completeness, question_counts, shortlist, usable_rows, answer_refusals, answer_numbers, answer_sentences, answer_windows, string_metrics, token_scores, cell_means, cell_means_by_source, metric_spread, paired_tests, holm_survivors, parser_verdicts, fixed_sequence, wilcoxon_tests, bootstrap_intervals, metric_correlation, ir_paper_metrics, ir_span_metrics, keyword_recall, span_in_document, numbered_context)
QUERIES = {f.__name__: f for f in _FUNCS}

_Q = "q AS (SELECT * FROM dataset WHERE qid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid) = 1)"
_R = "r AS (SELECT * FROM rag_round2_rows QUALIFY row_number() OVER (PARTITION BY parser, chunker, qid) = 1)"
_W = r"len(list_filter(string_split(trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g')), ' '), lambda x: x <> ''))"
_N = r"lower(trim(regexp_replace(translate({}, 'İΣ', 'Iσ'), '[\s\p{{Z}}]+', ' ', 'g')))"
_L = f"{_R}, l AS (SELECT parser || '|' || chunker AS cell, parser, chunker, source, paper, qid, metric, value FROM (SELECT *, unnest(['paper_hit_5', 'mrr_near', 'answer_similarity', 'answer_keyword_recall']) AS metric, unnest([paper_hit_5, mrr_near, answer_similarity, answer_keyword_recall]) AS value FROM r WHERE error IS NULL))"
_P = f"""{_L}, pr AS (SELECT a.metric, a.parser, a.chunker, a.qid, a.paper, a.value AS a, b.value AS b FROM l a JOIN l b ON a.metric = b.metric AND a.parser = b.parser AND a.qid = b.qid AND b.chunker = '{BASELINE}' AND a.chunker <> '{BASELINE}' WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
 ag AS (SELECT metric, parser, chunker, count(*) AS n, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS diff, stddev_samp(a - b) AS sd FROM pr GROUP BY ALL),
 t AS (SELECT *, CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) FROM range(0, 2000) g(i) WHERE i <= least(wins, losses))) END AS p0 FROM ag),
 pt AS (SELECT metric, parser, chunker, n, wins, losses, round(p0, 6) AS p, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(diff, 6) AS diff, CASE WHEN n < 2 THEN 0.0 WHEN sd > 0 THEN round(diff / sd, 6) WHEN diff = 0 THEN 0.0 ELSE sign(diff) * 1e308 END AS dz, n < 50 AS pending FROM t)"""


def _holm(keys: str) -> str:
    return f"hk AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY p, parser, chunker) - 1 AS rk, count(*) OVER (PARTITION BY {keys}) AS m FROM pt), hs AS (SELECT *, bool_and(p <= 0.05 / (m - rk)) OVER (PARTITION BY {keys} ORDER BY rk) AS holm FROM hk)"


_V = f"""{_P}, {_holm('metric, chunker')}, v AS (SELECT metric, chunker, count(*) FILTER (holm AND diff > 0) AS wins, count(*) FILTER (holm AND diff < 0) AS losses, round(avg(diff), 6) AS pooled, count(*) AS units FROM hs GROUP BY ALL),
 vd AS (SELECT *, CASE WHEN wins >= 2 AND losses = 0 AND abs(pooled) >= 0.05 - 1e-9 AND pooled > 0 THEN 'better' WHEN losses >= 2 AND wins = 0 AND abs(pooled) >= 0.05 - 1e-9 AND pooled < 0 THEN 'worse' ELSE 'no established difference' END AS verdict FROM v)"""
_H = f"{_R}, h0 AS (SELECT parser, chunker, qid, paper, unnest(hits) AS hit, generate_subscripts(hits, 1) AS rank FROM r WHERE error IS NULL), h AS (SELECT parser, chunker, qid, paper, CAST(rank AS INTEGER) AS rank, hit.filename AS filename, hit.text AS text FROM h0)"
_IDEAL = sum((2 if i == 0 else 1) / __import__("math").log2(i + 2) for i in range(10))

SQL = {
    "question_stems": f"WITH {_Q} SELECT qid, substring(replace(trim(regexp_replace(question, '[^A-Za-z0-9_\\- ]', '', 'g')), ' ', '_'), 1, 100) AS stem FROM q",
    "question_complexity": f"""WITH {_Q}, c AS (SELECT *, {_W.format("question")} AS n FROM q) SELECT qid, round(least(n / 12.0, 2.0) + CASE WHEN regexp_matches(question, '[0-9]') THEN 1.5 ELSE 0 END + CASE WHEN regexp_matches(question, '\\b[A-Z]{{2,}}\\b|\\b[A-Z][a-z]+[A-Z]\\w*') THEN 1.0 ELSE 0 END
      + CASE WHEN regexp_matches(question, '(?i)\\b(compare|versus|vs\\.?|differ|outperform|improvement|trade-?off|ablation)\\b') THEN 1.0 ELSE 0 END + least(coalesce(len(keywords), 0) / 3.0, 1.5) + least({_W.format("coalesce(answer_span, '')")} / 15.0, 1.0) - CASE WHEN n < 8 THEN 1.5 ELSE 0 END, 3) AS score FROM c""",
    "question_checks": f"""WITH {_Q} SELECT qid, CASE WHEN {_W.format("coalesce(answer_span, '')")} < 6 THEN 'span too short to be evidence' WHEN {_W.format("coalesce(question, '')")} < 8 THEN 'question too short' WHEN regexp_matches(coalesce(short_answer, ''), '^\\s*\\[\\d+\\]\\s*$') THEN 'answer is a citation' WHEN coalesce(short_answer, '') = '' OR facts IS NULL OR len(facts) < 1 THEN 'missing short answer or facts' END AS reason FROM q""",
    "candidate_completeness": f"WITH {_Q} SELECT qid FROM q WHERE trim(coalesce(question, '')) <> '' AND trim(coalesce(ideal_answer, '')) <> '' AND trim(coalesce(answer_span, '')) <> ''",
    "question_counts": f"WITH {_Q} SELECT source, served_model, count(*) AS n FROM q GROUP BY ALL",
    "shortlist": f"WITH {_Q}, f AS (SELECT qid, paper, complexity, CAST(row_number() OVER (PARTITION BY paper ORDER BY complexity DESC NULLS LAST, qid) > 1 AS INTEGER) AS first FROM q WHERE paper IS NOT NULL) SELECT qid, paper, first FROM f ORDER BY first, complexity DESC NULLS LAST, qid LIMIT 150",
    "usable_rows": f"WITH {_R} SELECT parser, chunker, count(*) AS n FROM r WHERE error IS NULL AND gen_error IS NULL AND answer IS NOT NULL GROUP BY ALL",
    "answer_refusals": f"WITH {_R}, a AS (SELECT parser, chunker, regexp_replace(coalesce(answer, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS a FROM r WHERE error IS NULL), m AS (SELECT *, regexp_extract(a, '(?is)^(.*?)(?:{T.REFUSAL[4:]})', 1) AS pre, regexp_matches(a, '{T.REFUSAL.replace(chr(39), chr(39) * 2)}') AS hit FROM a) SELECT parser, chunker, count(*) FILTER (a = '' OR (hit AND (length(pre) < 160 OR {_W.format('a')} <= 40))) AS refusals, count(*) AS n FROM m GROUP BY ALL".replace("can't|can not|unable to) (be )?(find|answer|determine|provide|locate)|(context|documents?|text|excerpts?) (does not|doesn't|", "can''t|can not|unable to) (be )?(find|answer|determine|provide|locate)|(context|documents?|text|excerpts?) (does not|doesn''t|"),
    "answer_numbers": f"WITH {_Q} SELECT qid, list_sort(list_distinct(list_transform(regexp_extract_all(ideal_answer, '({T.NUMBER})', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)))) AS numbers FROM q",
    "cell_means": f"WITH {_L} SELECT cell, metric, round(avg(value), 6) AS mean, count(value) AS n FROM l GROUP BY ALL",
    "cell_means_by_source": f"WITH {_L} SELECT cell, source, metric, CASE WHEN count(value) > 0 THEN CAST((2 * sum(CAST(round(value * 1e12) AS HUGEINT)) + count(value) * 1000000) // (2 * count(value) * 1000000) AS DOUBLE) / 1e6 END AS mean FROM l GROUP BY ALL",
    "metric_spread": f"WITH {_L}, m AS (SELECT cell, metric, avg(value) AS m FROM l GROUP BY ALL) SELECT metric, round(max(m) - min(m), 6) AS spread FROM m GROUP BY 1",
    "paired_tests": f"WITH {_P} SELECT * FROM pt",
    "holm_survivors": f"WITH {_P}, {_holm('metric')} SELECT metric, parser, chunker, p, holm FROM hs",
    "parser_verdicts": f"WITH {_V} SELECT * FROM vd",
    "fixed_sequence": f"WITH {_V}, s AS (SELECT chunker, metric, verdict, list_position(['paper_hit_5', 'mrr_near', 'answer_similarity', 'answer_keyword_recall'], metric) AS step FROM vd), o AS (SELECT *, coalesce(bool_and(verdict <> 'no established difference') OVER (PARTITION BY chunker ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS tested FROM s) SELECT chunker, metric, verdict, CAST(step AS INTEGER) AS step FROM o WHERE tested",
    "metric_correlation": f"WITH {_R}, x AS (SELECT answer_similarity AS a, answer_keyword_recall AS b FROM r WHERE error IS NULL AND answer_similarity IS NOT NULL AND answer_keyword_recall IS NOT NULL), k AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x) SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM k",
    "ir_paper_metrics": f"WITH {_H}, g AS (SELECT parser, chunker, qid, min(rank) FILTER (filename = paper) AS r, count(*) FILTER (filename = paper AND rank <= 1) AS c1, count(*) FILTER (filename = paper AND rank <= 3) AS c3, count(*) FILTER (filename = paper AND rank <= 5) AS c5 FROM h GROUP BY ALL) SELECT parser, chunker, qid, CAST(coalesce(r <= 1, false) AS DOUBLE) AS paper_hit_1, CAST(coalesce(r <= 3, false) AS DOUBLE) AS paper_hit_3, CAST(coalesce(r <= 5, false) AS DOUBLE) AS paper_hit_5, round(coalesce(1.0 / r, 0), 6) AS mrr_paper, round(c1 / 1, 6) AS precision_1, round(c3 / 3, 6) AS precision_3, round(c5 / 5, 6) AS precision_5 FROM g",
    "ir_span_metrics": f"WITH {_Q}, {_H}, f AS (SELECT h.*, coalesce(contains({_N.format('text')}, {_N.format('q.answer_span')}), false) AS found FROM h JOIN q USING (qid)), u AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY parser, chunker, qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, CASE WHEN found THEN 2 WHEN filename = paper THEN 1 ELSE 0 END AS grade FROM f) SELECT parser, chunker, qid, round(coalesce(1.0 / min(rank) FILTER (found), 0), 6) AS mrr, round(sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) ELSE 0 END) / {_IDEAL!r}, 6) AS ndcg_10, bool_or(found AND used < 200) AS span_hit_200ch, bool_or(found AND used < 400) AS span_hit_400ch, bool_or(found AND used < 2000) AS span_hit_2000ch FROM u GROUP BY ALL",
    "keyword_recall": f"WITH {_Q}, {_R}, c AS (SELECT parser, chunker, qid, coalesce(array_to_string(list_transform(list_slice(hits, 1, 6), lambda x: x.text), ' '), '') AS ctx FROM r WHERE error IS NULL), k AS (SELECT c.*, list_filter(coalesce(keywords, []), lambda x: trim(x) <> '') AS kws FROM c JOIN q USING (qid)) SELECT parser, chunker, qid, round(CASE WHEN len(kws) > 0 THEN len(list_filter(kws, lambda x: contains({_N.format('ctx')}, {_N.format('x')}))) / len(kws) END, 6) AS keyword_recall, CAST(length(ctx) AS INTEGER) AS context_chars FROM k",
    "span_in_document": f"WITH {_Q}, s AS (SELECT qid, paper, trim(regexp_replace(answer_span, '[\\s\\p{{Z}}]+', ' ', 'g')) AS span FROM q WHERE paper IS NOT NULL AND length(answer_span) >= 15) SELECT qid, coalesce(bool_or(contains(trim(regexp_replace(d.text, '[\\s\\p{{Z}}]+', ' ', 'g')), span)), false) AS found, count(d.text) AS docs FROM s LEFT JOIN documents d ON d.stem = s.paper AND d.text IS NOT NULL GROUP BY qid",
    "numbered_context": f"WITH {_R} SELECT parser, chunker, qid, array_to_string(list_transform(list_slice(hits, 1, 6), lambda x, i: '[' || i || '] ' || x.filename || chr(10) || x.text), chr(10) || chr(10)) AS context FROM r WHERE error IS NULL AND hits IS NOT NULL",
    "answer_windows": f"WITH {_R}, w AS (SELECT parser, chunker, qid, list_filter(string_split(trim(regexp_replace(answer, '[\\s\\p{{Z}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM r WHERE answer IS NOT NULL) SELECT parser, chunker, qid, CAST(CASE WHEN len(w) <= 300 THEN 1 ELSE len(range(0, greatest(len(w) - 251, 0) + 1, 250)) END AS INTEGER) AS n_windows, CAST(length(array_to_string(list_slice(w, 1, 300), ' ')) AS INTEGER) AS first_chars FROM w",
    "answer_sentences": f"WITH {_Q}, s AS (SELECT qid, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(ideal_answer, '[*_#`>]+', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda x: trim(x)), lambda x: len(string_split_regex(x, '\\s+')) >= 4) AS l FROM q WHERE ideal_answer IS NOT NULL) SELECT qid, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS ix, unnest(l) AS sentence FROM s",
}
