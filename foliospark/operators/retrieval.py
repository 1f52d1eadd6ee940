"""Retrieval: which way a question goes, what arrived lately, search over papers and chats, and its scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import vectors as V

#: Papers shown for a question about arrivals that names no number, and the most it can name.
ARRIVALS, MOST = 5, 12
NEAR = 0.9
KS, BUDGETS = (1, 3, 5, 10), (2000, 4000, 8000)


def routed(questions: DataFrame, text: str = "content", explicit: Column | None = None) -> DataFrame:
    """Adds days, wanted and branch: recency if the question asks for what is new and names no paper itself, else vector."""
    q = questions.withColumn("days", T.recency_window(F.col(text))).withColumn("wanted", F.coalesce(T.how_many(F.col(text)), F.lit(ARRIVALS)))
    new = F.col("days").isNotNull() if explicit is None else F.col("days").isNotNull() & ~explicit
    return q.withColumn("branch", F.when(new, "recency").otherwise("vector"))


def arrivals(asked: DataFrame, papers: DataFrame, today: Column, key: str = "id") -> DataFrame:
    """key, rank, filename, arrived, warning for routed questions of the recency branch.

    The newest embedded papers within the days asked for, at most as many as wanted; if
    none arrived, the newest of all, with a warning; fewer than wanted gives a warning
    too. Whatever the window, these are the first of the newest ``MOST`` papers.
    """
    newest = papers.where("status = 'embedded' and embedded_at is not null").select("filename", "embedded_at").orderBy(F.desc("embedded_at"), "filename").limit(MOST)
    newest = newest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("embedded_at"), "filename"))).withColumn("age", F.datediff(today, F.to_date("embedded_at")))
    shown = asked.where("branch = 'recency'").join(F.broadcast(newest), F.col("rank") <= F.col("wanted"))  # at most MOST rows
    shown = shown.withColumn("inside", F.col("age") < F.col("days"))
    per = shown.groupBy(key).agg(F.count_if("inside").alias("n"))
    shown = shown.join(per, key).where("inside or n = 0")
    warning = F.when(F.col("n") == 0, F.concat(F.lit("nothing new in the last "), F.col("days").cast("string"), F.lit(" day(s)"))).when(F.col("n") < F.col("wanted"), F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(" paper(s) arrived")))
    return shown.select(key, "rank", "filename", T.day_label(F.to_date("embedded_at"), today).alias("arrived"), warning.alias("warning"))


def search(store: DataFrame, queries: DataFrame, n: int = 6, n_chats: int = 2, kinds: tuple[str, ...] = ("papers", "chats"), names: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, kind, rank, id, distance: the n nearest papers of each query (of those named, if any are), then the n_chats nearest chats.

    ``store`` has a column kind. Chats are left out with n_chats of 0 or less, and if
    the store holds none the papers come alone.
    """
    papers = store.where("kind = 'papers'")
    found = V.knn(papers if names is None else papers.where(names), queries, n, key, vector).withColumn("kind", F.lit("papers"))
    if "chats" in kinds and n_chats > 0:
        found = found.unionByName(V.knn(store.where("kind = 'chats'"), queries, n_chats, key, vector).withColumn("kind", F.lit("chats")).withColumn("rank", F.col("rank") + n))
    return found.where(F.col("kind").isin(*kinds)).select("query_id", "kind", "rank", "id", "distance")


def _overlaps(span: Column, text: Column) -> Column:
    """Struct of key forms compared: exact (the span's key stands in the text's) and overlap (best share of its words in a window)."""

    @F.pandas_udf("exact boolean, overlap double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for spans, texts in batches:
            keys = [(T.text_key_py(s), T.text_key_py(t)) for s, t in zip(spans, texts)]
            yield pd.DataFrame([(s in t, T.span_overlap_py(s, t)) for s, t in keys], columns=["exact", "overlap"])

    return run(span, text)


def score_questions(hits: DataFrame, questions: DataFrame, key: tuple[str, ...] = ("parser", "chunker", "qid")) -> DataFrame:
    """All retrieval scores of a question in a cell.

    ``hits``: key, paper, rank, filename, text, ranks from 1 without gaps. ``questions``:
    qid, answer_span. For the exact span and, suffixed _near, for nine tenths of its words
    within a window: hit and precision at ``KS``, reciprocal rank, nDCG at 10 (2 the span,
    1 the paper), and whether the span comes before a budget of characters is used up.
    A question without hits has no row; a null span or text is an empty one.
    """
    h = hits.join(questions.select("qid", "answer_span"), "qid").withColumn("o", _overlaps(F.col("answer_span"), F.col("text")))
    own = F.coalesce(F.col("filename") == F.col("paper"), F.lit(False))
    length = F.coalesce(F.length("text"), F.lit(0))
    used = F.sum(length).over(Window.partitionBy(*key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    h = h.withColumn("own", own).withColumn("used", F.coalesce(used, F.lit(0))).withColumn("f", F.col("o.exact")).withColumn("f_near", F.col("o.overlap") >= NEAR)
    ideal = sum((2 if i == 0 else 1) / math.log2(i + 2) for i in range(10))
    first = lambda c: F.min(F.when(c, F.col("rank")))
    hit = lambda c, k: F.coalesce((first(c) <= k).cast("double"), F.lit(0.0))
    out = [hit(F.col("own"), k).alias(f"paper_hit_{k}") for k in KS] + [F.round(F.coalesce(1 / first(F.col("own")), F.lit(0.0)), 6).alias("mrr_paper")]
    for suffix, f in (("", F.col("f")), ("_near", F.col("f_near"))):
        grade = F.when(f, 2).when(F.col("own"), 1).otherwise(0)
        out += [hit(f, k).alias(f"span_hit{suffix}_{k}") for k in KS]
        out += [F.round(F.count_if((F.col("rank") <= k) & (f | F.col("own"))) / k, 6).alias(f"precision{suffix}_{k}") for k in KS]
        out += [F.round(F.coalesce(1 / first(f), F.lit(0.0)), 6).alias(f"mrr{suffix}"), F.round(F.sum(F.when(F.col("rank") <= 10, grade / F.log2(F.col("rank") + 1)).otherwise(0.0)) / ideal, 6).alias(f"ndcg{suffix}_10")]
        out += [F.bool_or(f & (F.col("used") < b)).cast("double").alias(f"span_hit{suffix}_{b}ch") for b in BUDGETS]
    return h.groupBy(*key).agg(*out)
