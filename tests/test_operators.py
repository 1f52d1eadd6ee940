import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import blocks as B
from foliospark.operators import chunkers as C
from foliospark.operators import layout as L
from foliospark.operators import registry as R
from foliospark.operators import stats as S
from foliospark.operators import vectors as V

BLOCK = "stem string, block_ix int, type string, page int, text string"


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr).first()[0]


def test_text_functions(spark):
    assert one(spark, T.sanitize_filename(F.col("a")), a="A: b/c (2)_d-é") == "A_bc_2_d-"
    assert one(spark, T.recency_window(F.col("a")), a="the latest updates today") == 1
    assert one(spark, T.recency_window(F.col("a")), a="papers of the last 3 days") == 3
    assert one(spark, T.recency_window(F.col("a")), a="what is attention?") is None
    assert one(spark, T.how_many(F.col("a")), a="the 10 new updates") == 10
    assert one(spark, T.how_many(F.col("a")), a="top 99 papers") == 12
    assert one(spark, T.how_many(F.col("a")), a="last 3 days") is None
    assert one(spark, T.truncate_words(F.col("a"), 7), a="one two three") == "one …"
    assert one(spark, T.strip_thinking(F.col("a")), a="<think>x</think> y") == "y"
    assert one(spark, T.is_refusal(F.col("a")), a="The context does not contain this.") is True
    assert one(spark, T.is_refusal(F.col("a")), a=None) is True
    assert one(spark, T.is_refusal(F.col("a")), a="It is 4.") is False
    assert one(spark, T.numbers(F.col("a")), a="1,234.5 and 7 and 7") == [7.0, 1234.5]
    assert one(spark, F.size(T.windows(F.col("a"))), a=" ".join("x" * 1 for _ in range(700))) == 2
    assert one(spark, T.source_label(F.col("t"), F.col("f"), F.col("a"), F.col("b")), t="", f="A_b", a=0, b=2) == "A b pp.1-3"
    assert T.text_key_py("Con-\nstruc­tion é!") == "construction e"
    assert T.split_sentences_py("See Smith et al. They did. It works (Fig. 2 shows). Yes!") == ["See Smith et al. They did.", "It works (Fig. 2 shows).", "Yes!"]
    assert T.join_lines_py(["a construc-", "tion of non-", "Euclidean edge-", "centric sets"], {"edge-centric"}) == "a construction of non-Euclidean edge-centric sets"
    assert T.hyphen_vocabulary_py(["an edge-centric view of non-"]) == {"edge-centric"}


def test_text_metrics():
    assert T.token_f1_py("the cat sat", "a cat sat down") == pytest.approx(0.8)
    assert T.rouge_l_py("a b c d", "a c d") == pytest.approx(2 * 3 / 7)
    assert T.chrf_py("same", "same") == pytest.approx(1.0) and T.chrf_py("", "x") == 0.0
    assert T.span_overlap_py("a b c d", "x a b z d y") == 0.75 and T.span_overlap_py("", "x") == 1.0


def test_statistics(spark):
    assert S.sign_p(10, 0) == pytest.approx(2 / 2**10) and S.sign_p(3, 1) == 0.625 and S.sign_p(0, 0) == 1.0
    rnd = random.Random(2)
    rows = [("m", "p", c, f"q{i}", f"paper{i % 7}", round(rnd.random(), 1)) for c in ("base", "x") for i in range(60)]
    long = spark.createDataFrame(rows, "metric string, parser string, chunker string, qid string, paper string, value double")
    p = S.paired_tests(long, "base").first()
    a, b = [[v for *_, c, q, _, v in [(r[0], r[1], r[2], r[3], r[4], r[5])] if c == k][0] if False else [r[5] for r in rows if r[2] == k] for k in ("x", "base")]
    d = [u - v for u, v in zip(a, b)]
    m = sum(d) / 60
    assert (p.wins, p.losses) == (sum(x > 0 for x in d), sum(x < 0 for x in d)) and p.diff == pytest.approx(m, abs=1e-6)
    assert p.dz == pytest.approx(m / math.sqrt(sum((x - m) ** 2 for x in d) / 59), abs=1e-5)
    w = S.wilcoxon(S.paired(long, "base"), ["metric", "chunker"]).first()
    nz = [round(x, 12) for x in d if round(x, 12)]
    rank = lambda x: sum(abs(y) < abs(x) for y in nz) + (sum(abs(y) == abs(x) for y in nz) + 1) / 2
    assert w.n == len(nz) and w.w == pytest.approx(min(sum(rank(x) for x in nz if x > 0), sum(rank(x) for x in nz if x < 0)))
    ci = S.cluster_bootstrap(S.paired(long, "base"), ["metric"], "paper", draws=500).first()
    assert ci.lo <= ci["diff"] <= ci.hi
    ps = spark.createDataFrame([("f", "p", c, x) for c, x in (("a", 0.001), ("b", 0.02), ("c", 0.04), ("d", 0.5))], "fam string, parser string, chunker string, p double")
    assert [r.holm for r in S.holm(ps, ["fam"]).orderBy("p").collect()] == [True, False, False, False]
    ranks = S.average_rank(spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0)], "v double"), "v", "r")
    assert sorted((r.v, r.r) for r in ranks.collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_bootstrap_query_takes_all_draws(spark):
    from foliospark.plans import answers as A

    d, key = "/root/testdata/sf0.001", ["metric", "parser", "chunker"]
    want = S.cluster_bootstrap(S.paired(A.long_metrics(spark, d), A.BASELINE), key, "paper", draws=10_000)
    assert sorted(A.bootstrap_intervals(spark, d).collect()) == sorted(want.collect())


def test_status_machine(spark):
    from foliospark.streaming.jobs import step

    ev = [(1, 1, "view"), (2, 1, "signup"), (3, 1, "error"), (4, 1, "error"), (5, 1, "signup"), (6, 2, "view"), (7, 3, "error"), (8, 3, "click"), (9, 3, "error")]
    got = {r.user_id: (r.status, r.error_count) for r in R.fold_events(spark.createDataFrame(ev, "event_id long, user_id long, event_type string")).collect()}
    assert got == {1: ("error", 2), 3: ("error", 1)}
    want: dict = {}
    for _, u, e in ev:
        want[u] = step(want.get(u, (None, 0)), R.EVENT_STATUS[e])
    assert {u: s for u, s in want.items() if s[0]} == got


def test_paragraphs_and_rendering(spark):
    rows = [("s", 0, "title", 0, "T"), ("s", 1, "paragraph", 0, "It goes"), ("s", 2, "caption", 0, "Table 1 x"), ("s", 3, "table", 0, "a|b"), ("s", 4, "paragraph", 1, "on here."), ("s", 5, "paragraph", 1, "Next."), ("s", 6, "Section", 1, "Two"), ("s", 7, "paragraph", 2, None), ("s", 7, "paragraph", 2, None), (None, 1, "paragraph", 0, "x")]
    b = B.distinct_blocks(spark.createDataFrame(rows, BLOCK))
    assert [(r.block_ix, r.n_parts, r.text) for r in B.merge_paragraphs(b).orderBy("block_ix").collect()] == [(1, 2, "It goes on here."), (5, 1, "Next.")]
    text = B.joined(b, B.rendered(F.col("text"), F.col("type"))).first().text
    assert text == "# T\n\nIt goes\n\n[CAPTION] Table 1 x\n\n[TABLE]\na|b\n[/TABLE]\n\non here.\n\nNext.\n\n## Two"
    assert B.caption_pairs(b).first().table_ix == 3
    assert B.merge_paragraphs(B.distinct_blocks(spark.createDataFrame([], BLOCK))).count() == 0


def test_chunkers(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500))), (2, None), (3, " "), (4, "a b")], "doc_id long, text string")
    rows = C.fixed_token(docs).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, len(r.text.split())) for r in rows] == [(1, 0, 256), (1, 1, 256), (1, 2, 52), (4, 0, 2)]
    parts = C.recursive_split("a" * 90 + "\n\n" + "b " * 60, 100, 20)
    assert all(len(p) <= 100 for p in parts) and parts[0] == "a" * 90
    g = C.grow([("title", 0, "T"), ("section", 0, "S"), ("paragraph", 0, "x " * 300), ("paragraph", 1, "y " * 600), ("table", 1, "a|b"), ("authors", 1, "A"), ("section", 2, "S2"), ("paragraph", 2, "Long one. " * 400), ("formula", 2, "1+1")], "stem")
    assert all(c["n_chars"] <= 2000 for c in g) and {c["section"] for c in g} == {"S", "S2"} and g[0]["text"].startswith("T › S\n\n")
    assert not any("A" == c["body"] for c in g)
    assert C.overlap_py("one two three", "two three four") == len("two three")
    assert C.grow([], "s") == [] and C.semantic_split("One. Two.") == ["One. Two."]


@pytest.mark.parametrize("kinds", [("paragraph", "section", "caption", "table", "list", "formula", "footnote", "paragraph", "title", None), ("paragraph", "caption", "table")])
def test_parts_of_a_long_paper_change_nothing(spark, kinds):
    r = random.Random(4)
    rows = []
    for k in range(900):
        text = r.choice(["", "\u00a0", "x = y + z + 1", f"Sentence {k} is here. " * r.choice([1, 9, 30, 200])])
        rows.append(("s", k, r.choice(kinds), k // 9, text if k else f"Block {k}."))
    rows[3] = ("s", 3, "title", 0, " The title ")
    want = C.grow([(t or "paragraph", p, x) for _, _, t, p, x in rows], "s")
    d = spark.createDataFrame(rows, "stem string, block_ix int, type string, page int, text string")
    got = C.grain_growth(d, part=40)
    assert got.select("part").distinct().count() > 3
    fields = ["chunk_index", "title", "section", "page_start", "page_end", "block_types", "n_chars", "body", "text"]
    assert [tuple(x) for x in got.orderBy("chunk_index").select(fields).collect()] == [tuple(c[f] for f in fields) for c in want]
    assert C.grain_growth(d.where("false")).count() == 0


def test_knn_blocks_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[7] = v[8]
    rows = [(i * 37, [float(x) for x in v[i]], i % 3) for i in range(300)] + [(5, None, 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in V.knn(e, e.where("vec_id % 20 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    v32 = v.astype(np.float32).astype(float)
    n = v32 / np.linalg.norm(v32, axis=1, keepdims=True)
    for i in range(300):
        if i * 37 % 20 == 0:
            d = 1 - n @ n[i]
            want = [j * 37 for j in sorted((j for j in range(300) if j != i), key=lambda j: (round(d[j], 12), j))[:5]]
            assert [x for _, x in sorted(got[i * 37])] == want
    assert V.knn(e.where("false"), e.where("false"), 3).count() == 0


REGION = "doc string, page int, region_ix int, label string, x0 double, y0 double, x1 double, y1 double, page_w double, has_text boolean"


def test_reading_order(spark):
    def order(rows):
        df = spark.createDataFrame([("d", 0, i, label, *box, 612.0, label != "Picture") for i, (label, *box) in enumerate(rows)], REGION)
        return [r.region_ix for r in L.reading_order(df).orderBy("order").collect()]

    left, right = (40.0, 290.0), (320.0, 570.0)
    two = [("Text", right[0], 100.0, right[1], 200.0), ("Text", left[0], 110.0, left[1], 200.0), ("Text", left[0], 210.0, left[1], 300.0), ("Page-header", 50.0, 10.0, 560.0, 20.0)]
    assert order(two) == [1, 2, 0]
    band = [("Text", left[0], 100.0, left[1], 150.0), ("Text", right[0], 100.0, right[1], 150.0), ("Picture", 50.0, 160.0, 560.0, 300.0), ("Text", left[0], 310.0, left[1], 400.0), ("Text", right[0], 305.0, right[1], 400.0)]
    assert order(band) == [0, 1, 2, 3, 4]
    single = [("Text", 50.0, 200.0, 560.0, 250.0), ("Text", 50.0, 100.0, 560.0, 150.0)]
    assert order(single) == [1, 0]
    authors = [("Title", 50.0, 50.0, 560.0, 70.0), ("Authors", 400.0, 80.0, 560.0, 100.0), ("Authors", 50.0, 82.0, 200.0, 101.0), ("Text", left[0], 120.0, left[1], 200.0), ("Text", right[0], 120.0, right[1], 200.0)]
    assert order(authors) == [0, 2, 1, 3, 4]


def test_words_to_regions_and_lines(spark):
    words = spark.createDataFrame([("d", 0, 0, 10.0, 10.0, 20.0, 20.0, "in", 0), ("d", 0, 1, 22.0, 11.5, 30.0, 21.5, "box", 0), ("d", 0, 2, 10.0, 40.0, 20.0, 50.0, "below", 0), ("d", 0, 3, 300.0, 300.0, 310.0, 310.0, "stray", 3)], "doc string, page int, word_ix int, x0 double, y0 double, x1 double, y1 double, text string, block_no int")
    regions = spark.createDataFrame([("d", 0, 0, "Text", 0.0, 0.0, 100.0, 100.0), ("d", 0, 1, "Caption", 5.0, 35.0, 50.0, 60.0)], "doc string, page int, region_ix int, label string, x0 double, y0 double, x1 double, y1 double")
    got = {r.text: (r.region_ix, r.label, r.fallback) for r in L.assign_words(words, regions).collect()}
    assert got == {"in": (0, "Text", False), "box": (0, "Text", False), "below": (1, "Caption", False), "stray": (None, "Text", True)}
    assert [r.text for r in L.lines(words.where("word_ix < 3"), ["doc", "page"]).orderBy("line_ix").collect()] == ["in box", "below"]
    rows = [(40.0 + 70 * k, 10.0 * r, 100.0 + 70 * k, 10.0 * r + 8, "w") for r in range(5) for k in (0, 4)]
    assert len(L.split_columns(rows, 40.0, 400.0, 612.0, "Text")) == 2
    assert len(L.split_columns(rows, 40.0, 400.0, 612.0, "Table")) == 1
    box = "doc string, page int, ix int, text string, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([("d", 0, 0, "w", 0.0, 0.0, 10.0, 10.0), ("d", 0, 1, "w", 1.0, 0.0, 11.0, 10.0)], box)
    b = spark.createDataFrame([("d", 0, 0, "w", 0.0, 0.0, 10.0, 10.0)], box)
    assert [(r.a_ix, r.b_ix) for r in L.match_boxes(a, b).collect()] == [(0, 0)]


def test_sources_and_sinks(spark, tmp_path):
    import sqlite3

    from foliospark.sources import readers, writers

    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "p" / "b.pdf").write_bytes(b"<html>")
    assert [r.stem for r in readers.pdf_files(spark, str(tmp_path / "p")).collect()] == ["a"]
    db = str(tmp_path / "r.db")
    with sqlite3.connect(db) as con:
        con.execute("create table t (filename text, n int)")
        con.executemany("insert into t values (?, ?)", [("x", 1), (None, None)])
    assert sorted((r.filename or "", r.n) for r in readers.sqlite_table(spark, db, "t").collect()) == [("", None), ("x", "1")]
    page = spark.createDataFrame([("<html><script>x</script><p>Main  text</p></html>", "s"), ("<p> </p>", "snippet")], "html string, s string")
    assert [r[0] for r in page.select(readers.page_text(F.col("html"), F.col("s"), 100)).collect()] == ["Main text", "snippet"]
    out = str(tmp_path / "v")
    writers.upsert(spark, out, spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int"), "k")
    writers.upsert(spark, out, spark.createDataFrame([("a", 9)], "k string, v int"), "k")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 9), ("b", 3)]
    with pytest.raises(ValueError):
        writers.upsert(spark, out, spark.createDataFrame([], "k string, v int"), "k")
    assert writers.delete(spark, out, spark.createDataFrame([("b",), ("z",)], "k string"), "k") == 1


def test_streams(spark, tmp_path):
    from foliospark.streaming import jobs

    src = "/root/testdata/sf0.001/"
    ev = spark.read.parquet(src + "events.parquet")
    (tmp_path / "in").mkdir()
    ev.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = jobs.windowed_counts(stream, size="1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counts").first()[0] == ev.count()
    q = jobs.status_stream(stream).writeStream.format("memory").queryName("status").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.user_id: (r.status, r.error_count) for r in spark.table("status").collect()}
    want = {r.user_id: (r.status, r.error_count) for r in R.fold_events(ev).collect()}
    assert got == want
    p = spark.createDataFrame([("2026-01-01 00:00:00", 1), ("2026-01-01 00:20:00", 1), ("2026-01-01 00:25:00", 2)], "at string, done int").withColumn("at", F.col("at").cast("timestamp"))
    assert jobs.stalled(p, 15).count() == 1


def test_chrf_against_counters():
    import random
    from collections import Counter

    rnd = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rnd.choice("abcé 你") for _ in range(rnd.randint(0, 30))) for _ in range(2))
        x, y = "".join(a.split()), "".join(b.split())
        got = []
        for n in range(1, 7):
            p, q = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (x, y))
            if p and q:
                got.append(((p & q).total() / p.total(), (p & q).total() / q.total()))
        p, q = (sum(c) / len(got) for c in zip(*got)) if got else (0, 0)
        want = 5 * p * q / (4 * p + q) if p and q else 0.0
        assert T.chrf_py(a, b) == pytest.approx(want)


def test_short_answers(spark):
    rows = [("5.0 %", "it is 5 percent", 1.0), ("Adam", "it uses SGD", 0.0), ("Adam", "trained with ADAM.", 1.0), ("1,200", "1200 pages", 1.0), ("10⁻³", "the rate is 10⁻³", 1.0), ("3 and 4", "only 3", 0.0), (None, "x", 0.0), ("", "x", 0.0), ("7", None, 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "s string, a string").withColumn("r", T.string_scores("a", "a", "s"))
    got = df.select(T.short_answer_match(F.col("s"), F.col("a"), F.col("r.held")).alias("m")).collect()
    assert [x.m for x in got] == [m for _, _, m in rows]
