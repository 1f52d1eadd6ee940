import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import blocks as B
from foliospark.operators import order as O
from foliospark.operators import retrieval as Q
from foliospark.operators import stats as S
from foliospark.operators import vectors as V


@pytest.fixture(autouse=True)
def several_parts(spark):
    """Small data would be put together into one part."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = [("hot" if rnd.random() < 0.6 else f"s{rnd.randint(0, 5)}", k, rnd.choice([None, rnd.randint(0, 9)])) for k in range(600)]
    rnd.shuffle(out)
    return out


def grouped(rows):
    out = {}
    for key, at, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(key, []).append((at, v))
    return out


def test_order_over_parts_against_brute_force(spark, rows):
    """A group of most rows lies in several parts and comes out as if it lay in one."""
    df = O.parts(spark.createDataFrame(rows, "k string, at int, v int"), "k", "at")
    assert df.where("k = 'hot'").select(O.PART).distinct().count() > 1
    v = F.col("v")
    got = O.before(df, "k", "at", "b", v)
    got = O.after(got, "k", "at", "a", v)
    got = O.latest(got, "k", "at", "l", v)
    got = O.running(got, "k", "at", "r", F.coalesce(v, F.lit(0)))
    have = {(r.k, r["at"]): (r.b, r.a, r.l, r.r) for r in got.collect()}
    want = {}
    for key, seq in grouped(rows).items():
        last, total = None, 0
        for i, (at, x) in enumerate(seq):
            last, total = (last if x is None else x), total + (x or 0)
            want[key, at] = (seq[i - 1][1] if i else None, seq[i + 1][1] if i + 1 < len(seq) else None, last, total)
    assert have == want
    empty = O.parts(spark.createDataFrame([], "k string, at int, v int"), "k", "at")
    assert O.running(O.latest(O.before(empty, "k", "at", "b", v), "k", "at", "l", v), "k", "at", "r", v).count() == 0


def test_quantiles_against_numpy(spark, rows):
    df = spark.createDataFrame(rows, "k string, at int, v int")
    got = {r.k: r for r in S.quantiles(df, "v", {"q": 0.3, "m": 0.5, "low": 0.5}, by="k", disc=("low",)).collect()}
    for key, seq in grouped(rows).items():
        x = sorted(v for _, v in seq if v is not None)
        assert got[key].q == pytest.approx(np.quantile(x, 0.3)) and got[key].m == pytest.approx(np.median(x)) and got[key].low == x[(len(x) + 1) // 2 - 1]
    none = S.quantiles(df.where("false"), "v", {"m": 0.5}).collect()
    assert len(none) == 1 and none[0].m is None


def test_list_groups(spark):
    b = [("a", 0, "list", 0, " x "), ("a", 1, "list", 0, "y"), ("a", 2, "caption", 0, "c"), ("a", 3, "list", 0, "z"), ("a", 4, "paragraph", 0, " "), ("a", 5, "list", 0, "w"), ("b", 0, None, 0, "p"), ("b", 1, "list", 0, None)]
    got = B.list_groups(spark.createDataFrame(b, "stem string, block_ix int, type string, page int, text string")).collect()
    assert sorted((r.stem, r.block_ix, r.n_items, r.text) for r in got) == [("a", 0, 2, "x\ny"), ("a", 3, 2, "z\nw")]


def test_router_and_arrivals(spark):
    q = [(1, "What's new today?"), (2, "Show the latest 2 papers"), (3, "How does it work?"), (4, "what arrived in the last 30 days"), (5, None)]
    asked = Q.routed(spark.createDataFrame(q, "id int, content string"))
    assert {r.id: r.branch for r in asked.collect()} == {1: "recency", 2: "recency", 3: "vector", 4: "recency", 5: "vector"}
    named = Q.routed(spark.createDataFrame(q, "id int, content string"), explicit=F.lit(True))
    assert {r.branch for r in named.collect()} == {"vector"}
    day = lambda n: dt.datetime(2024, 5, 20) - dt.timedelta(days=n)
    papers = spark.createDataFrame([(f"p{n}", "embedded", day(n)) for n in (3, 5, 29, 40)] + [("raw", "parsed", day(0)), ("none", "embedded", None)], "filename string, status string, embedded_at timestamp")
    got = {}
    for r in Q.arrivals(asked, papers, F.lit("2024-05-20").cast("date")).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.filename, r.warning))
    assert [f for f, _ in got[1]] == ["p3", "p5", "p29", "p40"] and got[1][0][1].startswith("nothing new")
    assert got[2] == [("p3", None), ("p5", None)]
    assert [f for f, _ in got[4]] == ["p3", "p5", "p29"] and got[4][0][1].startswith("only 3")
    assert Q.arrivals(asked, papers.where("false"), F.lit("2024-05-20").cast("date")).count() == 0


def test_scores_of_a_question(spark):
    words = [f"word{'abcdefghijkl'[k]}" for k in range(12)]
    near = " ".join(words[:11] + ["other"])
    hits = [("p", "c", "q", "paper", 1, "wrong", "nothing here"), ("p", "c", "q", "paper", 2, "paper", "so: " + " ".join(words) + "."), ("p", "n", "q", "paper", 1, "paper", near), ("p", "z", "q", "paper", 1, None, None)]
    h = spark.createDataFrame(hits, "parser string, chunker string, qid string, paper string, rank int, filename string, text string")
    got = {r.chunker: r for r in Q.score_questions(h, spark.createDataFrame([("q", " ".join(words))], "qid string, answer_span string")).collect()}
    assert got["c"].mrr == 0.5 and got["c"].span_hit_1 == 0 and got["c"].span_hit_3 == 1 and got["c"].paper_hit_1 == 0 and got["c"].precision_3 == pytest.approx(1 / 3, abs=1e-6) and got["c"].span_hit_2000ch == 1
    assert got["n"].mrr == 0 and got["n"].mrr_near == 1 and got["n"].ndcg_near_10 > got["n"].ndcg_10 > 0
    assert got["z"].mrr_near == 0 and got["z"].paper_hit_10 == 0


def _vectors(spark, n, seed, hot=False):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(20, 16))
    x = c[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, 16))
    if hot:
        x[: n // 3] = c[0]
    return spark.createDataFrame([(i * 37 + 5, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


def test_search_over_papers_and_chats(spark):
    e = _vectors(spark, 200, 1).withColumn("kind", F.when(F.col("vec_id") % 4 == 0, "chats").otherwise("papers"))
    got = Q.search(e, e.limit(3), 4, 2).collect()
    kind = {r.vec_id: r.kind for r in e.collect()}
    assert len(got) == 18 and all(kind[r.id] == r.kind for r in got) and {r["rank"] for r in got if r.kind == "chats"} == {5, 6}
    assert {r.kind for r in Q.search(e, e.limit(3), 4, 0).collect()} == {"papers"}
    assert {r.kind for r in Q.search(e.where("kind = 'papers'"), e.limit(3), 4, 2).collect()} == {"papers"}


@pytest.mark.parametrize("hot", [False, True])
def test_cells_find_nine_tenths(spark, hot):
    e = _vectors(spark, 3000, 2, hot)
    q = e.where("vec_id % 20 = 0")
    exact, near = V.knn(e, q, 10).collect(), V.knn_cells(e, q, 10, cells=16, probes=6).collect()
    edge = {}
    for r in exact:
        edge[r.query_id] = max(edge.get(r.query_id, 0.0), r.distance)
    assert len(near) == len(exact) and sum(r.distance <= edge[r.query_id] + 1e-9 for r in near) >= 0.9 * len(exact)
    assert V.knn_cells(e.where("false"), q, 10).count() == 0
