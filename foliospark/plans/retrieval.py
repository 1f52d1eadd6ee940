"""Queries of the question router, retrieval scores, list groups, chunk edges and parse loss."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import retrieval as Q
from ..operators import stats as S
from ..session import table
from .answers import BASELINE, _H, _holm, _Q, hit_ranks, long_metrics, questions
from .documents import _B, blocks
from .registry import _CUR, papers
from .search import _M, _messages

TODAY = "2026-03-17"


def routed_questions(spark, d):
    """Each user message with the way it goes, the days it asks for and how many papers."""
    return Q.routed(_messages(spark, d).where("role = 'user' and content is not null")).select("id", "branch", "days", "wanted")


def arrivals_context(spark, d):
    asked = Q.routed(_messages(spark, d).where("role = 'user' and content is not null")).select("id", "branch", "days", "wanted")
    return Q.arrivals(asked, papers(spark, d), F.lit(TODAY).cast("date"))


def search_sources(spark, d):
    """Papers (labels below 8) and then chats (8 and 9) for every vector whose id is divisible by 20."""
    e = table(spark, d, "embeddings").withColumn("kind", F.when(F.col("label") < 8, "papers").otherwise("chats"))
    return Q.search(e, e.where("vec_id % 20 = 0")).withColumn("distance", F.round("distance", 6))


def score_question(spark, d):
    return Q.score_questions(hit_ranks(spark, d), questions(spark, d))


def list_groups(spark, d):
    return B.list_groups(blocks(spark, d)).select("stem", "block_ix", "n_items", "text")


def edge_shares(spark, d):
    """Blocks as chunks: prose that starts or ends within a sentence, fenced chunks, broken fences, chunks over the model's length."""
    c = blocks(spark, d).where(B.said(F.col("text"))).select(T.fence(F.trim("text"), F.col("type")).alias("text"))
    c = c.withColumn("fenced", T.has_fence(F.col("text")))
    share = lambda c, of: F.round(F.avg(F.when(of, c.cast("double"))), 6)
    t, prose = F.col("text"), ~F.col("fenced")
    return c.agg(F.count("*").alias("chunks"), share(~T.starts_cleanly(t), prose).alias("prose_mid_start"), share(~T.ends_cleanly(t), prose).alias("prose_mid_end"), share(F.col("fenced"), F.lit(True)).alias("fenced"), share(~T.fences_balanced(t), F.col("fenced")).alias("broken"), F.count_if(T.over_length(t)).alias("over_length"))


def _missing(spark, d):
    """Per parser and question whether the span, in its key form, is in no text that the parser's cells found."""
    h = hit_ranks(spark, d).where("text is not null").select("parser", "qid", "paper", "text").distinct()
    h = h.join(questions(spark, d).where("length(answer_span) > 0").select("qid", "answer_span"), "qid")
    g = h.withColumn("o", Q._overlaps(F.col("answer_span"), F.col("text"))).groupBy("parser", "qid", "paper").agg(F.bool_or("o.exact").alias("exact"), F.max("o.overlap").alias("overlap"))
    return g.select("parser", "qid", "paper", (~F.col("exact")).cast("double").alias("exact"), (~F.col("exact") & (F.col("overlap") < Q.NEAR)).cast("double").alias("near"))


def parse_loss(spark, d):
    """Spans missing per parser, exactly and by nine tenths of their words."""
    return _missing(spark, d).groupBy("parser").agg(F.sum("exact").cast("bigint").alias("missing_exact"), F.sum("near").cast("bigint").alias("missing_near"), F.count("*").alias("questions"))


def parse_loss_tests(spark, d):
    """Parsers pair by pair: questions only one of them misses, the exact test, and what holds among the pairs."""
    m = _missing(spark, d)
    a, b = m.select("parser", "qid", F.col("near").alias("x")), m.select(F.col("parser").alias("other"), "qid", F.col("near").alias("y"))
    g = a.join(b, "qid").where("parser < other").groupBy("parser", "other").agg(F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") < F.col("y")).alias("losses"))
    g = g.withColumn("p", F.round(S._sign("wins", "losses"), 6)).select(F.lit("near").alias("metric"), F.col("parser"), F.col("other").alias("chunker"), "wins", "losses", "p")
    return S.holm(g, ["metric"], "p").select("parser", F.col("chunker").alias("other"), F.col("wins").alias("only_first"), F.col("losses").alias("only_second"), "p", "holm")


def bootstrap_plain(spark, d):
    """Intervals of the mean differences, every question drawn by itself (2,000 draws, as for the report)."""
    return S.cluster_bootstrap(S.paired(long_metrics(spark, d), BASELINE), ["metric", "parser", "chunker"], "qid", draws=2000)


_FUNCS = (routed_questions, arrivals_context, search_sources, score_question, list_groups, edge_shares, parse_loss, parse_loss_tests, bootstrap_plain)
QUERIES = {f.__name__: f for f in _FUNCS}

_RE = T.RECENCY.replace("'", "''")
_ROUTE = f"""{_M}, u AS (SELECT id, content, list_transform(regexp_extract_all(content, '{_RE}', 1), lambda x: lower(x)) AS ph, regexp_extract(content, '{T.HOW_MANY}', 1) AS hm FROM m WHERE role = 'user' AND content IS NOT NULL),
 w AS (SELECT id, list_min(list_transform(ph, lambda p: CASE WHEN regexp_matches(p, '^last \\d+ days?$') THEN greatest(1, CAST(regexp_extract(p, '(\\d+)', 1) AS INTEGER)) {' '.join(f"WHEN p = '{k}' THEN {v}" for k, v in T.WINDOW_DAYS.items())} ELSE 7 END)) AS days, CASE WHEN hm <> '' THEN least(12, greatest(1, CAST(hm AS INTEGER))) ELSE {Q.ARRIVALS} END AS wanted FROM u),
 rt AS (SELECT id, CASE WHEN days IS NOT NULL THEN 'recency' ELSE 'vector' END AS branch, days, wanted FROM w)"""
#: Signs whose compatibility decomposition holds ASCII letters or digits; a letter with accents falls apart into the letter and marks, which are no letters.
_COMPAT = {"¼": "1⁄4", "½": "1⁄2", "¾": "3⁄4", "ª": "a", "º": "o", "¹": "1", "²": "2", "³": "3", "™": "TM", "ſ": "s", "№": "No", "ﬁ": "fi", "ﬂ": "fl", "⁰": "0", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9", "₂": "2"}
_PLAIN = "array_to_string(list_transform(string_split(coalesce({}, ''), ''), lambda ch: CASE ch " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _COMPAT.items()) + " WHEN strip_accents(ch) THEN ch ELSE strip_accents(ch) || '´' END), '')"
_KEY = f"lower(trim(regexp_replace(regexp_replace(replace({_PLAIN}, chr(173), ''), '-\\s+', '', 'g'), '[^0-9A-Za-z]+', ' ', 'g')))"
_WORDS = "list_filter(string_split({}, ' '), lambda x: x <> '')"
#: The best share of the span's words in a window of its length; 1 if it stands in the text.
_OV = """CASE WHEN contains(tk, sk) THEN 1.0 WHEN len(sw) = 0 OR len(tw) = 0 THEN 0.0 ELSE list_max(list_transform(range(1, greatest(len(tw) - len(sw) + 1, 1) + 1), lambda i: list_sum(list_transform(list_distinct(sw), lambda x: least(len(list_filter(sw, lambda y: y = x)), len(list_filter(list_slice(tw, i, i + len(sw) - 1), lambda y: y = x))))))) / len(sw) END"""
_SCORED = f"""{_Q}, {_H}, k0 AS (SELECT h.*, {_KEY.format('q.answer_span')} AS sk, {_KEY.format('h.text')} AS tk FROM h JOIN q USING (qid)),
 pr0 AS (SELECT DISTINCT sk, tk FROM k0), k1 AS (SELECT sk, tk, {_WORDS.format('sk')} AS sw, {_WORDS.format('tk')} AS tw FROM pr0), ov AS (SELECT sk, tk, contains(tk, sk) AS f, {_OV} AS o FROM k1),
 sc AS (SELECT k0.*, ov.f, ov.o, ov.o >= {Q.NEAR} AS f_near, coalesce(filename = paper, false) AS own, coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY parser, chunker, qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM k0 JOIN ov USING (sk, tk))"""
_IDEAL = sum((2 if i == 0 else 1) / math.log2(i + 2) for i in range(10))


def _score_columns() -> str:
    hit = lambda c, k: f"CAST(coalesce(min(rank) FILTER ({c}) <= {k}, false) AS DOUBLE)"
    out = [f"{hit('own', k)} AS paper_hit_{k}" for k in Q.KS] + ["round(coalesce(1.0 / min(rank) FILTER (own), 0), 6) AS mrr_paper"]
    for s, f in (("", "f"), ("_near", "f_near")):
        out += [f"{hit(f, k)} AS span_hit{s}_{k}" for k in Q.KS] + [f"round(count(*) FILTER (rank <= {k} AND ({f} OR own)) / {k}, 6) AS precision{s}_{k}" for k in Q.KS]
        out += [f"round(coalesce(1.0 / min(rank) FILTER ({f}), 0), 6) AS mrr{s}", f"round(sum(CASE WHEN rank <= 10 THEN (CASE WHEN {f} THEN 2 WHEN own THEN 1 ELSE 0 END) / log2(rank + 1) ELSE 0 END) / {_IDEAL!r}, 6) AS ndcg{s}_10"]
        out += [f"CAST(bool_or({f} AND used < {b}) AS DOUBLE) AS span_hit{s}_{b}ch" for b in Q.BUDGETS]
    return ", ".join(out)


_MISS = f"""{_SCORED}, ms AS (SELECT parser, qid, CAST(NOT bool_or(f) AS INTEGER) AS exact, CAST(NOT bool_or(f) AND NOT coalesce(bool_or(f_near), false) AS INTEGER) AS near FROM sc JOIN q USING (qid) WHERE text IS NOT NULL AND length(q.answer_span) > 0 GROUP BY ALL)"""
_FENCED = f"{_B}, c AS (SELECT CASE WHEN type IN ('table', 'formula') THEN '~~~' || type || chr(10) || trim(text) || chr(10) || '~~~' ELSE trim(text) END AS text FROM b WHERE trim(coalesce(text, '')) <> ''), e AS (SELECT text, regexp_matches(text, '(?m)^~~~(table|formula)') AS fenced, len(regexp_extract_all(text, '(?m)^~~~(?:table|formula)[ \\t]*$')) AS opened, len(regexp_extract_all(text, '(?m)^~~~[ \\t]*$')) AS closed FROM c)"



def _common(a: str, b: str) -> str:
    """Size of the intersection of two lists as multisets."""
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)"


_GRAMS = ", ".join(f"list_transform(range(1, greatest(length({{0}}) - {n - 1}, 0) + 1), lambda pos: substr({{0}}, CAST(pos AS INTEGER), {n}))" for n in range(1, 7))
_NUMS = "list_distinct(list_transform(regexp_extract_all(translate(coalesce({}, ''), '" + T.DIGITS[0] + "', '" + T.DIGITS[1] + "'), '(" + T.NUMBER + ")', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)))"
_REF = T.REFUSAL.replace("'", "''")
_STRING = f"""{_Q}, r AS (SELECT * FROM rag_round2_rows QUALIFY row_number() OVER (PARTITION BY parser, chunker, qid) = 1),
 sa AS (SELECT parser, chunker, qid, answer, ideal_answer, short_answer, regexp_replace(answer, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS st, {_KEY.format('answer')} AS ak, {_KEY.format('ideal_answer')} AS ik, {_KEY.format('short_answer')} AS shk, {_NUMS.replace('{}', 'short_answer', 1)} AS need, {_NUMS.replace('{}', 'answer', 1)} AS have,
  regexp_replace(answer, '[\\s\\p{{Z}}]+', '', 'g') AS h, regexp_replace(coalesce(ideal_answer, ''), '[\\s\\p{{Z}}]+', '', 'g') AS i FROM r JOIN q USING (qid) WHERE r.error IS NULL AND answer IS NOT NULL),
 sb AS (SELECT *, list_filter(string_split(ak, ' '), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS aw, list_filter(string_split(ik, ' '), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS iw, [{_GRAMS.format('h')}] AS hg, [{_GRAMS.format('i')}] AS ig,
  st = '' OR (regexp_matches(st, '{_REF}') AND (length(regexp_extract(st, '(?is)^(.*?)(?:{_REF[4:]})', 1)) < 160 OR len(list_filter(string_split(trim(regexp_replace(st, '[\\s\\p{{Z}}]+', ' ', 'g')), ' '), lambda x: x <> '')) <= 40)) AS no FROM sa),
 sx AS (SELECT *, {_common('aw', 'iw')} AS c, list_filter(list_transform(range(1, 7), lambda n: CASE WHEN len(hg[n]) > 0 AND len(ig[n]) > 0 THEN [{_common('hg[n]', 'ig[n]')} / len(hg[n]), {_common('hg[n]', 'ig[n]')} / len(ig[n])] END), lambda z: z IS NOT NULL) AS sh FROM sb),
 sy AS (SELECT *, CASE WHEN len(sh) > 0 THEN list_avg(list_transform(sh, lambda z: z[1])) ELSE 0 END AS pr, CASE WHEN len(sh) > 0 THEN list_avg(list_transform(sh, lambda z: z[2])) ELSE 0 END AS rc FROM sx)"""

SQL = {
    "token_scores": f"WITH {_STRING} SELECT parser, chunker, qid, no AS refusal, round(CASE WHEN no OR c = 0 THEN 0.0 ELSE 2.0 * c / (len(aw) + len(iw)) END, 6) AS token_f1, round(CASE WHEN no OR pr = 0 OR rc = 0 THEN 0.0 ELSE 5 * pr * rc / (4 * pr + rc) END, 6) AS chrf, round(CASE WHEN no THEN 0.0 WHEN len(need) > 0 THEN CAST(len(list_filter(need, lambda n: len(list_filter(have, lambda v: abs(n - v) <= 1e-9 * greatest(1.0, abs(n)))) = 0)) = 0 AS DOUBLE) ELSE CAST(shk <> '' AND contains(ak, shk) AS DOUBLE) END, 6) AS short_match FROM sy",
    "routed_questions": f"WITH {_ROUTE} SELECT id, branch, CAST(days AS INTEGER) AS days, CAST(wanted AS INTEGER) AS wanted FROM rt",
    "arrivals_context": f"{_CUR}, {_ROUTE}, nw AS (SELECT filename, embedded_at, row_number() OVER (ORDER BY embedded_at DESC, filename) AS rank, DATE '{TODAY}' - CAST(embedded_at AS DATE) AS age FROM p WHERE status = 'embedded' AND embedded_at IS NOT NULL QUALIFY rank <= {Q.MOST}), sh AS (SELECT rt.*, nw.*, age < days AS inside, count(*) FILTER (age < days) OVER (PARTITION BY id) AS n FROM rt JOIN nw ON rank <= wanted WHERE branch = 'recency') SELECT id, CAST(rank AS INTEGER) AS rank, filename, CASE WHEN age = 0 THEN 'today' WHEN age = 1 THEN 'yesterday' ELSE strftime(embedded_at, '%Y-%m-%d') END AS arrived, CASE WHEN n = 0 THEN 'nothing new in the last ' || days || ' day(s)' WHEN n < wanted THEN 'only ' || n || ' paper(s) arrived' END AS warning FROM sh WHERE inside OR n = 0",
    "search_sources": "WITH e AS (SELECT *, CASE WHEN label < 8 THEN 'papers' ELSE 'chats' END AS kind FROM embeddings), x AS (SELECT a.vec_id AS query_id, b.kind, b.vec_id AS id, list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY d, id) AS rk FROM x) SELECT query_id, kind, CAST(CASE WHEN kind = 'papers' THEN rk ELSE rk + 6 END AS INTEGER) AS rank, id, round(d, 6) AS distance FROM r WHERE rk <= CASE WHEN kind = 'papers' THEN 6 ELSE 2 END",
    "score_question": f"WITH {_SCORED} SELECT parser, chunker, qid, {_score_columns()} FROM sc GROUP BY ALL",
    "list_groups": f"WITH {_B}, s AS (SELECT stem, block_ix, trim(text) AS text, CAST(type = 'list' AS INTEGER) AS l, coalesce(lag(type) OVER (PARTITION BY stem ORDER BY block_ix), '') AS was, type FROM b WHERE trim(coalesce(text, '')) <> ''), g AS (SELECT *, sum(CASE WHEN l = 1 AND was <> 'list' THEN 1 ELSE 0 END) OVER (PARTITION BY stem ORDER BY block_ix) AS grp FROM s) SELECT stem, min(block_ix) AS block_ix, count(*) AS n_items, string_agg(text, chr(10) ORDER BY block_ix) AS text FROM g WHERE l = 1 GROUP BY stem, grp",
    "edge_shares": f"WITH {_FENCED} SELECT count(*) AS chunks, round(avg(CAST(regexp_matches(ltrim(text), '^[a-z,;)\\]]') AS DOUBLE)) FILTER (NOT fenced), 6) AS prose_mid_start, round(avg(CAST(NOT regexp_matches(rtrim(text), '([.!?][\"''”’)\\]]*|~~~)$') AS DOUBLE)) FILTER (NOT fenced), 6) AS prose_mid_end, round(avg(CAST(fenced AS DOUBLE)), 6) AS fenced, round(avg(CAST(opened <> closed AS DOUBLE)) FILTER (fenced), 6) AS broken, count(*) FILTER (length(text) / 5.1 > 0.95 * 512) AS over_length FROM e",
    "parse_loss": f"WITH {_MISS} SELECT parser, CAST(sum(exact) AS BIGINT) AS missing_exact, CAST(sum(near) AS BIGINT) AS missing_near, count(*) AS questions FROM ms GROUP BY parser",
    "parse_loss_tests": f"WITH {_MISS}, ag AS (SELECT 'near' AS metric, a.parser, b.parser AS chunker, count(*) FILTER (a.near > b.near) AS wins, count(*) FILTER (a.near < b.near) AS losses FROM ms a JOIN ms b ON a.qid = b.qid AND a.parser < b.parser GROUP BY ALL), pt AS (SELECT *, round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) FROM range(0, 2000) g(i) WHERE i <= least(wins, losses))) END, 6) AS p FROM ag), {_holm('metric')} SELECT parser, chunker AS other, wins AS only_first, losses AS only_second, p, holm FROM hs",
    "near_span_hits": f"WITH {_SCORED} SELECT parser, chunker, qid, round(max(o), 6) AS overlap, min(rank) FILTER (f_near) AS near_rank FROM sc JOIN q USING (qid) WHERE text IS NOT NULL AND q.answer_span IS NOT NULL GROUP BY ALL",
    "recency_questions": f"WITH {_ROUTE.replace(_M, 'm AS (SELECT DISTINCT id, content, chr(117) AS role FROM messages)').replace(chr(39) + 'user' + chr(39), 'chr(117)').replace(f'ELSE {Q.ARRIVALS} END AS wanted', 'END AS wanted')} SELECT id, CAST(days AS INTEGER) AS days, CAST(wanted AS INTEGER) AS n FROM rt",
    "text_keys": f"SELECT doc_id, md5({_KEY.format('text')}) AS key FROM documents",
}
