"""Queries over the vector store and the chats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import order as O
from ..operators import vectors as V
from ..session import table

K = 10


def _search(spark, d, metric="cosine", same_label=False):
    """Queries: every vector whose id is divisible by 20, against all."""
    e = table(spark, d, "embeddings")
    return V.knn(e, e.where("vec_id % 20 = 0"), K, metric=metric, label="label", same_label=same_label)


def knn_topk(spark, d):
    return _search(spark, d).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def knn_euclidean(spark, d):
    return _search(spark, d, "l2").select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def knn_filtered(spark, d):
    return _search(spark, d, same_label=True).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def knn_cells_recall(spark, d):
    """How much of the exact result the inverted file finds; the vectors of this table lie without clusters, so it takes 40 of 64 cells."""
    e = table(spark, d, "embeddings")
    near = V.knn_cells(e, e.where("vec_id % 20 = 0"), K, 64, 40).select("query_id", "id", F.lit(1).alias("got"))
    return _search(spark, d).join(near, ["query_id", "id"], "left").agg(F.count("*").alias("pairs"), F.round(F.count("got") / F.count("*"), 6).alias("recall"))


def ir_metrics(spark, d):
    """The label plays the paper: hit, precision, reciprocal rank and nDCG (grade 1, ideal of ten) per query and distance."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    q = e.select(F.col("id").alias("query_id"), F.col("label").alias("want"))
    hits = _search(spark, d).withColumn("cell", F.lit("cosine")).unionByName(_search(spark, d, "l2").withColumn("cell", F.lit("l2")))
    h = hits.join(e, "id").join(q, "query_id").withColumn("ok", (F.col("label") == F.col("want")).cast("int"))
    import math

    ideal = sum(1 / math.log2(i + 2) for i in range(10))
    g = h.groupBy("cell", "query_id").agg(
        *[F.max(F.when(F.col("rank") <= k, F.col("ok")).otherwise(0)).cast("double").alias(f"hit_{k}") for k in (1, 3, 10)],
        F.round(F.sum(F.when(F.col("rank") <= 5, F.col("ok")).otherwise(0)) / 5, 6).alias("precision_5"),
        F.round(F.coalesce(1 / F.min(F.when(F.col("ok") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.sum(F.col("ok") / F.log2(F.col("rank") + 1)) / ideal, 6).alias("ndcg_10"),
    )
    return g


def ir_cell_means(spark, d):
    return ir_metrics(spark, d).groupBy("cell").agg(*[F.round(F.avg(c), 5).alias(c) for c in ("hit_1", "hit_3", "hit_10", "precision_5", "mrr", "ndcg_10")])


def stems_in_store(spark, d):
    return table(spark, d, "embeddings").select("label").distinct().orderBy("label")


def _messages(spark, d):
    """One row per message id."""
    m = table(spark, d, "messages").where("id is not null and chat_id is not null")
    one = m.groupBy("id").agg(F.min(F.struct("chat_id", "role", "content", "created_at", "sources")).alias("m")).select("id", "m.*")
    clean = lambda c: F.lower(F.trim(c))
    role = clean(F.col("role"))
    return one.select(clean(F.col("chat_id")).alias("chat_id"), "id", F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "ai"), "assistant").otherwise(role).alias("role"), "content", "sources")


def _chats(spark, d):
    c = table(spark, d, "chats").where("id is not null")
    return c.groupBy(F.lower(F.trim("id")).alias("chat_id")).agg(F.min("title").alias("title"), F.max("updated_at").alias("updated_at"))


def chat_counts(spark, d):
    n = _messages(spark, d).groupBy("chat_id").agg(F.count("*").alias("n"))
    return _chats(spark, d).join(n, "chat_id", "left").select("chat_id", F.coalesce("n", F.lit(0)).alias("messages"), "updated_at").orderBy(F.desc("updated_at"), "chat_id")


def unanswered_chats(spark, d):
    return _chats(spark, d).join(_messages(spark, d).where("role = 'assistant'"), "chat_id", "left_anti").select("chat_id")


def qa_pairs(spark, d):
    """The user turn right before an assistant turn (by id), each used once; other roles don't count."""
    m = O.parts(_messages(spark, d).where("role in ('user', 'assistant')"), "chat_id", "id")
    m = O.before(m, "chat_id", "id", "b", F.struct("role", "id", "content")).select("*", F.col("b.role").alias("was"), F.col("b.id").alias("q_id"), F.col("b.content").alias("q"))
    return m.where("role = 'assistant' and was = 'user'").select("chat_id", "q_id", F.col("id").alias("a_id"), F.md5(F.concat(F.lit("Q: "), F.coalesce("q", F.lit("")), F.lit("\nA: "), F.coalesce("content", F.lit("")))).alias("doc"))


def history_window(spark, d):
    """The last four turns of a chat; long assistant turns are cut at a word."""
    w = Window.partitionBy("chat_id").orderBy(F.desc("id"))  # the limit on the rank is applied before the shuffle
    m = _messages(spark, d).where("role in ('user', 'assistant')").withColumn("k", F.row_number().over(w)).where("k <= 4")
    return m.select("chat_id", "k", "role", F.when(F.col("role") == "assistant", T.truncate_words(F.col("content"), 1200)).otherwise(F.col("content")).alias("content"))


def previous_question(spark, d):
    """Each user turn with the user turn before it: the text a follow-up is searched with."""
    u = O.before(O.parts(_messages(spark, d).where("role = 'user'"), "chat_id", "id"), "chat_id", "id", "prev", F.col("content"))
    return u.select("chat_id", "id", F.concat_ws("\n", "prev", "content").alias("query"))


def message_sources(spark, d):
    """How many sources a message names (a JSON array; null and unreadable count as none)."""
    n = F.size(F.from_json("sources", "array<string>"))
    return _messages(spark, d).select("id", F.when(n > 0, n).otherwise(0).alias("n_sources")).groupBy("n_sources").agg(F.count("*").alias("messages"))


_FUNCS = (knn_topk, knn_euclidean, knn_filtered, knn_cells_recall, ir_metrics, ir_cell_means, stems_in_store, chat_counts, unanswered_chats, qa_pairs, history_window, previous_question, message_sources)
QUERIES = {f.__name__: f for f in _FUNCS}


def _knn(metric: str, extra: str = "") -> str:
    f = {"cosine": "list_cosine_distance", "l2": "list_distance"}[metric]
    return f"SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {f}(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS rank, {f}(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance, a.label AS want, b.label AS label FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0 {extra} QUALIFY rank <= {K}"


_IR = f"h AS (SELECT 'cosine' AS cell, *, CAST(want = label AS INTEGER) AS ok FROM ({_knn('cosine')}) UNION ALL SELECT 'l2', *, CAST(want = label AS INTEGER) FROM ({_knn('l2')})), g AS (SELECT cell, query_id, CAST(max(CASE WHEN rank <= 1 THEN ok ELSE 0 END) AS DOUBLE) AS hit_1, CAST(max(CASE WHEN rank <= 3 THEN ok ELSE 0 END) AS DOUBLE) AS hit_3, CAST(max(CASE WHEN rank <= 10 THEN ok ELSE 0 END) AS DOUBLE) AS hit_10, round(sum(CASE WHEN rank <= 5 THEN ok ELSE 0 END) / 5, 6) AS precision_5, round(coalesce(1.0 / min(rank) FILTER (ok = 1), 0), 6) AS mrr, round(sum(ok / log2(rank + 1)) / {sum(1 / __import__('math').log2(i + 2) for i in range(10))!r}, 6) AS ndcg_10 FROM h GROUP BY cell, query_id)"
_M = "m AS (SELECT id, lower(trim(chat_id, ' ')) AS chat_id, CASE WHEN lower(trim(role, ' ')) IN ('user', 'human') THEN 'user' WHEN lower(trim(role, ' ')) IN ('assistant', 'ai') THEN 'assistant' ELSE lower(trim(role, ' ')) END AS role, content, sources FROM messages WHERE id IS NOT NULL AND chat_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id) = 1)"
_C = "c AS (SELECT lower(trim(id, ' ')) AS chat_id, max(updated_at) AS updated_at FROM chats WHERE id IS NOT NULL GROUP BY 1)"

SQL = {
    "knn_topk": f"SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM ({_knn('cosine')})",
    "knn_euclidean": f"SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM ({_knn('l2')})",
    "knn_filtered": f"SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM ({_knn('cosine', 'AND a.label = b.label')})",
    "ir_metrics": f"WITH {_IR} SELECT * FROM g",
    "ir_cell_means": f"WITH {_IR} SELECT cell, round(avg(hit_1), 5) AS hit_1, round(avg(hit_3), 5) AS hit_3, round(avg(hit_10), 5) AS hit_10, round(avg(precision_5), 5) AS precision_5, round(avg(mrr), 5) AS mrr, round(avg(ndcg_10), 5) AS ndcg_10 FROM g GROUP BY cell",
    "stems_in_store": "SELECT DISTINCT label FROM embeddings",
    "chat_counts": f"WITH {_M}, {_C} SELECT c.chat_id, count(m.id) AS messages, updated_at FROM c LEFT JOIN m USING (chat_id) GROUP BY ALL",
    "unanswered_chats": f"WITH {_M}, {_C} SELECT chat_id FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.chat_id = c.chat_id AND m.role = 'assistant')",
    "qa_pairs": f"WITH {_M}, w AS (SELECT *, lag(role) OVER o AS was, lag(id) OVER o AS q_id, lag(content) OVER o AS q FROM m WHERE role IN ('user', 'assistant') WINDOW o AS (PARTITION BY chat_id ORDER BY id)) SELECT chat_id, q_id, id AS a_id, md5('Q: ' || coalesce(q, '') || chr(10) || 'A: ' || coalesce(content, '')) AS doc FROM w WHERE role = 'assistant' AND was = 'user'",
    "history_window": f"WITH {_M}, w AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) AS k FROM m WHERE role IN ('user', 'assistant')) SELECT chat_id, CAST(k AS INTEGER) AS k, role, CASE WHEN role = 'assistant' AND length(content) > 1200 THEN regexp_replace(substring(content, 1, 1200), ' [^ ]*$', '') || ' …' ELSE content END AS content FROM w WHERE k <= 4",
    "previous_question": f"WITH {_M} SELECT chat_id, id, concat_ws(chr(10), lag(content) OVER (PARTITION BY chat_id ORDER BY id), content) AS query FROM m WHERE role = 'user'",
    "message_sources": f"WITH {_M} SELECT CAST(CASE WHEN sources IS NULL OR NOT json_valid(sources) OR json_type(sources) <> 'ARRAY' THEN 0 ELSE json_array_length(sources) END AS INTEGER) AS n_sources, count(*) AS messages FROM m GROUP BY 1",
}
