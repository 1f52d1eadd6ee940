import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import bpe, chats, garble, markup, mix, pack, pairs, spans, split, tokens

DOC = "doc_id long, text string"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOC)


# ---- 8


def reference_encoder():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "a" * 3000, "x\x1cy \x1f z", "  \x85 a", "é" * 400, " <|endoftext|> it's", "　　a\u2003b", "👩‍🔬 你好\r\n\tdon't 12345 ２３", "\ufeff\u200b", "tab\t\tnew\n\n\nline  "]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_public_encoder(text):
    enc = bpe.load(bpe.default_path("byte_bpe_50k"))
    ids, off = enc.encode_batch([text])
    assert ids.tolist() == reference().encode_ordinary(text) and off.tolist() == [0, len(ids)]
    assert enc.count_batch([text]).tolist() == [len(ids)]


_held = []


def reference():
    if not _held:
        _held.append(reference_encoder())
    return _held[0]


def test_encode_table(spark):
    df = docs(spark, [None, *ODD]).withColumn("ids", F.lit("clash")).withColumn("k", F.lit(1)).union(spark.createDataFrame([(0, None, "x", 1)], "doc_id long, text string, ids string, k int"))
    rows = tokens.encode(df).collect()
    assert len(rows) == len(ODD) + 2 and sum(r.ids is None for r in rows) == 2
    assert {r.doc_id: list(r.ids) for r in rows if r.doc_id} == {i: reference().encode_ordinary(t) for i, t in enumerate(ODD, 1)}
    assert tokens.encode(docs(spark, [])).count() == 0


# ---- 9


def test_mix_reaches_shares(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a"] * 12 + ["b"] * 3 + ["c"]), "word " * rnd.randint(1, 60)) for i in range(3000)]
    rows += [(9000, None, "x y"), (9001, "a", None), (9002, "b", ""), (9003, "other", "x")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("copies", F.lit(7))
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("none", 0.05, 3)], "source string, target_share double, max_repeats int")
    chosen, shares = mix.mix(d, t)
    c, s = chosen.collect(), {r.source: r for r in shares.collect()}
    assert s["none"].actual_share == 0 and set(s) == {"a", "b", "c", "none"}
    for k in "abc":
        assert abs(s[k].actual_share - s[k].target_share / 0.95) < 0.01
    most = {"a": 1, "b": 2, "c": 4}
    assert all(1 <= r.copies <= most[r.source] for r in c) and len({r.doc_id for r in c}) == len(c)
    assert sum(r.copies * r.n_tokens for r in c) == sum(r.used_tokens for r in s.values())
    # complete epochs come before the fractional selection
    per = {k: {r.copies for r in c if r.source == k} for k in "abc"}
    assert all(max(v) - min(v) <= 1 for v in per.values())
    assert mix.mix(d.where("false"), t)[0].count() == 0


# ---- 3


def brute_shared(rows, span):
    from collections import defaultdict

    where = defaultdict(set)
    for key, text in rows:
        for i in range(len(text or "") - span + 1):
            where[text[i : i + span]].add(key)
    out = {}
    for key, text in rows:
        hit = [i for i in range(len(text or "") - span + 1) if len(where[text[i : i + span]]) > 1]
        if hit:
            covered = len({j for i in hit for j in range(i, i + span)})
            out[key] = max(out.get(key, 0), covered)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_spans_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcd é你") for _ in range(n))
    common = [word(200), word(120), word(119), "z" * 300]
    rows = []
    for i in range(40):
        t = word(rnd.randint(0, 400))
        for _ in range(rnd.randint(0, 2)):
            c = rnd.choice(common)
            a = rnd.randint(0, max(0, len(c) - 121))
            t = t[: rnd.randint(0, len(t))] + c[a : a + rnd.randint(100, 300)] + word(rnd.randint(0, 50))
        rows.append((str(i), t))
    rows += [("dup", rows[0][1]), ("dup", rows[0][1]), ("self", common[0] + "|" + common[0][:10]), ("self", common[0]), ("null", None), ("empty", "")]
    df = spark.createDataFrame([("t", k, t, 5) for k, t in rows], "table_name string, record_key string, text string, rec int")
    assert {r.record_key: r.shared_chars for r in spans.shared(df).collect()} == brute_shared(rows, 120)
    assert spans.shared(df.where("false")).count() == 0


def test_a_text_under_one_key_shares_nothing_with_itself(spark):
    t = "".join(random.Random(4).choice("abcdef") for _ in range(500))
    df = spark.createDataFrame([("t", "a", t), ("t", "a", t), ("t", "a", t[50:])], "table_name string, record_key string, text string")
    assert spans.shared(df).count() == 0


# ---- 7 and 5

TEXT = st.text(alphabet=st.sampled_from("ab .\n!é。  "), max_size=400)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 60), st.integers(0, 30))
def test_pieces_cover_the_text(text, limit, overlap):
    p = split.cut(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(b - a <= limit for a, b in p)
    for (a, b), (c, e) in zip(p, p[1:]):
        assert a < c <= b < e and b - c <= overlap


def test_pieces_end_at_boundaries():
    text = "First part here. Second one there.\n\nNew paragraph begins. It ends."
    assert [text[a:b] for a, b in split.cut(text, 36)] == ["First part here. Second one there.\n\n", "New paragraph begins. It ends."]
    assert split.cut("", 5) == [(0, 0)] and len(split.cut("x" * 100_000, 100)) == 1000
    assert all(text[b - 1] in " \n." for _, b in split.cut(text, 20))


BLOCKS = "stem string, block_ix int, type string, text string"
BUDGETS = "purpose string, item_table string, max_chars int, overlap_chars int"


def tables(spark):
    rnd = random.Random(6)
    b = [(rnd.choice(["s", "s", "t", None]), i, "paragraph", "w " * rnd.randint(0, 30)) for i in range(200)]
    b += b[:20] + [("s", 900, None, None), ("s", 901, "list", ""), ("s", 902, "list", "long " * 100)]
    d = [(i, "src", "y " * rnd.randint(0, 80)) for i in range(100)] + [(500, None, "z" * 1000), (501, "src", None), (502, "src", "")]
    g = [("pack", "blocks", 100, 0), ("pack", "documents", 300, 0), ("cut", "blocks", 60, 9), ("cut", "documents", 120, 10)]
    return spark.createDataFrame(b, BLOCKS).withColumn("size", F.lit(1)), spark.createDataFrame(d, "doc_id long, source string, text string").withColumn("shard", F.lit("q")), spark.createDataFrame(g, BUDGETS)


def test_containers(spark):
    b, d, g = tables(spark)
    rows = pack.containers(b, d, g).collect()
    used: dict = {}
    for r in rows:
        used.setdefault((r.table_name, r.stem, r["shard"], r.container_no), []).append(r)
    assert all(sum(x["size"] for x in v) <= v[0].capacity for v in used.values())
    keys = [(r.table_name, r.item_key, r.part) for r in rows]
    assert len(keys) == len(set(keys))
    whole = {(r.table_name, r.item_key): r["size"] for r in rows if r.part == 0}
    want = {("blocks", f"{r.stem or ''}/{r.block_ix}"): len(r.text) for r in b.collect() if r.text is not None and len(r.text) <= 100}
    want |= {("documents", str(r.doc_id)): len(r.text) for r in d.collect() if r.text is not None and len(r.text) <= 300}
    assert whole == want
    assert sum(r["size"] for r in rows if r.item_key == "500") == 1000 and sum(r["size"] for r in rows if r.item_key == "s/902") == 500
    for t, stem in {(r.table_name, r.stem) for r in rows}:
        mine = [v for k, v in used.items() if k[:2] == (t, stem)]
        least = -(-sum(x["size"] for v in mine for x in v) // mine[0][0].capacity)
        assert len(mine) <= least * 11 / 9 + 2
    assert pack.containers(b.where("false"), d.where("false"), g).count() == 0


def test_best_fit_prefers_compatible_containers():
    placed = pack.fill([6, 6, 4, 4], [1, 2, 1, 2], ["a"] * 4, 10)
    assert placed[2][0] == placed[1][0] and placed[3][0] == placed[0][0] and all(ok for _, ok in placed)
    assert pack.fill([5, 5], [1, 1], ["a", "a"], 10) == [(0, True), (0, False)]
    many = pack.fill([3] * 5000, [7] * 5000, ["a"] * 5000, 9)
    assert len({b for b, _ in many}) == -(-5000 // 3)


def test_oversized(spark):
    b, d, g = tables(spark)
    rows = split.oversized(b, d, g).collect()
    want = {f"{r.stem or ''}/{r.block_ix}" for r in b.collect() if r.text and len(r.text) > 60} | {str(r.doc_id) for r in d.collect() if r.text and len(r.text) > 120}
    assert {r.item_key for r in rows} == want
    text = {str(r.doc_id): r.text for r in d.collect()}
    for key in ("500",):
        p = sorted((r.piece_no, r.start_char, r.end_char, r.piece) for r in rows if r.item_key == key)
        assert all(text[key][a:z] == t for _, a, z, t in p) and p[-1][2] == 1000


# ---- 4


def test_conversations(spark):
    c = spark.createDataFrame([("A1", "x"), ("A1", "x"), ("b2", "y"), ("c3", "z"), ("d4", "z"), (None, "n")], "id string, title string")
    m = [
        (2, " a1", "AI ", "r1", "2026-01-01T01:00:05+01:00", 1), (1, "A1", "User", "q1", "2026-01-01 00:00:00", 1), (1, "A1", "User", "q1", "2026-01-01 00:00:00", 1),
        (3, "a1 ", "human", "q2", "2026-01-01T00:01:00Z", 1), (7, "a1", "user", "q2", "2026-01-01T00:01:00Z", 1), (4, "A1", "assistant", "r2", "2026-01-01T00:02:00.250000+00:00", 1),
        (5, "b2", "user", "q", "2026-01-01T00:00:00Z", 1), (6, "b2", "assistant", "\u00a0", "2026-01-01T00:00:01Z", 1),
        (8, "c3", "user", "q", "yesterday", 1), (9, "c3", "assistant", "r", "2026-01-01T00:00:01Z", 1),
        (10, "d4", "user", "q", "2026-01-01T00:00:01Z", 1), (11, "zz", "user", "q", "2026-01-01T00:00:01Z", 1), (12, None, "user", None, None, None), (None, "d4", "user", "q", "2026-01-01T00:00:01Z", 1),
    ]
    df = spark.createDataFrame(m, "id long, chat_id string, role string, content string, created_at string, duration_ms int").withColumn("speaker", F.lit(0)).withColumn("t", F.lit(0))
    got = sorted((r.chat_id, r.turn_no, r.id, r.role) for r in chats.conversations(c, df).collect())
    assert got == [("A1", 1, 1, "user"), ("A1", 2, 2, "assistant"), ("A1", 3, 3, "user"), ("A1", 4, 4, "assistant")]
    assert chats.conversations(c, df.where("false")).count() == 0 and chats.conversations(c.where("false"), df).count() == 0
    assert {r.chat_id: r.replies for r in chats.clock_offsets(c, df).collect()}["A1"] >= 1


def test_a_chat_that_spans_partitions(spark):
    rows = [(i, "big", "user" if i % 2 == 0 else "assistant", f"m{i}", f"2026-01-{1 + i // 1440:02d}T{i // 60 % 24:02d}:{i % 60:02d}:00Z", 1) for i in range(4000)]
    rows += [(10_000 + i, *r[1:]) for i, r in enumerate(rows) if i % 97 == 0]
    # a copy stands right behind its original only if no other row has its instant
    df = spark.createDataFrame(rows, "id long, chat_id string, role string, content string, created_at string, duration_ms int")
    got = chats.conversations(spark.createDataFrame([("big", "t")], "id string, title string"), df).orderBy("turn_no").collect()
    assert [r.id for r in got] == list(range(4000)) and [r.turn_no for r in got] == list(range(1, 4001))


# ---- 2


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("plain, p < 0.05 and List<Foo> at C:\\runs\\sections\\a", []), ("it costs $55 per run and b costs $70.", []), ("a matrix [[1, 2], [3, 4]] and <|endoftext|>", []),
        ("• one\n– two\n(1) three\n1 INTRODUCTION\n\nφ = 3·α + β² / 2", []), ("def __init__(self): snake_case * 2", []), ("", []), (None, []),
        ("10<sup>5</sup>", ["html"]), ("a &amp; b", ["html"]), ("&#8220;x&#8221;", ["html"]), ("<!-- c --> x", ["html"]),
        ("# Title\n\n- a\n- b", ["markdown"]), ("see **this** one", ["markdown"]), ("[a](http://b)", ["markdown"]), ("```\n<b>x</b> \\cite{a}\n```", ["markdown"]), ("Head\n====\n\ntext", ["markdown"]),
        ("== Head ==\n\n* a\n# b", ["wiki"]), ("an ''apt'' [[link]]", ["wiki"]), ("{{cite|a}}", ["wiki"]),
        ("x\\cite{a2} and \\emph{b}", ["latex"]), ("so $\\alpha^2 = 3$ holds", ["latex"]), ("\\begin{verbatim}\n<b>**x**</b>\n\\end{verbatim}", ["latex"]),
        ("<p>x</p>\n\n**y**", ["html", "markdown"]), ("<pre><code>a **b** [[c]]</code></pre>", ["html"]),
    ],
)
def test_kinds(text, kinds):
    assert markup.kinds(text) == kinds


def test_indented_lines_are_code_after_a_blank_line_only():
    assert markup.kinds("text\n  see **this** one") == ["markdown"] and markup.kinds("text\n    x\\cite{a2} and \\emph{b}") == ["latex"]
    assert markup.kinds("text\n\n    see **this** one\n    and [a](http://b)\n\n\tan **x** y\nend") == []


def test_clean():
    assert markup.clean("<h2>A</h2><p>b &amp; <b>c</b></p><ul><li>x<li>y</ul><pre><code>if a &lt; b:\n  c</code></pre>") == "## A\n\nb & c\n\n- x\n- y\n\n```\nif a < b:\n  c\n```"
    assert markup.clean("\\section{A}\n\nx\\cite{q} \\emph{y} and $a^2$.\n\\begin{itemize}\n\\item one\n\\end{itemize}") == "# A\n\nx y and $a^2$.\n\n- one"
    assert markup.clean("== A ==\n\n'''b''' [[c|d]] {{cite|e}}\n* f").split() == ["##", "A", "b", "d", "-", "f"]
    assert markup.clean("A\n===\n\n**b** [c](d) ~~e~~\n\n| x | y |\n|---|---|\n| 1 | 2 |") == "# A\n\nb c e\n\nx | y\n1 | 2"
    assert markup.clean("plain < text") == "plain < text" and markup.clean(None) is None
    page = "<html><body><nav><a href='x'>Home</a></nav><div><a>About</a></div><p>" + "word " * 50 + "</p><div><div><div><a>c</a></div></div></div></body></html>"
    assert markup.clean(page) == ("word " * 50).strip()
    markup.clean("<p>" * 20_000), markup.clean("\\emph{" * 5_000), markup.clean("**a" * 20_000)


def test_content_region_is_the_maximum():
    rnd = random.Random(1)
    worth = dict(zip(markup.CLASSES, markup.WEIGHTS))
    for _ in range(50):
        t = [rnd.choice(("word", "word", "link", "text_tag", "page_tag")) for _ in range(30)]
        score = lambda a, b: sum(worth[c] for c in t[a:b])
        a, b = markup.content_region(t)
        assert score(a, b) == pytest.approx(max(score(i, j) for i in range(31) for j in range(i, 31)))


def _page(rnd):
    """A page that says where its content is, and the content."""
    words = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    links = lambda n: "".join(f"<div><a href='x'>{words(2)}</a></div>" for _ in range(n))
    inner = "".join(f"<p>{words(rnd.randint(5, 40))} <b>{words(1)}</b></p>" for _ in range(rnd.randint(2, 6))) + f"<ul><li>{words(2)}</li><li>{words(1)}</li></ul>"
    return f"<html><body><div class='top'>{links(rnd.randint(3, 12))}<span></span>{'<span></span>' * 60}</div>", inner, f"<div>{links(rnd.randint(3, 9))}</div></body></html>"


def test_weights_from_labelled_pages(spark):
    rnd = random.Random(2)
    pages = [_page(rnd) for _ in range(40)]
    w = markup.weights(docs(spark, [f"{a}<main>{c}</main>{z}" for a, c, z in pages[:30]] + ["no page"]))
    assert w[0] == 1.0 and w[1] < 0 and w[2] < 0 and w[3] < 0
    for a, c, z in pages[30:]:
        for worth in (w, markup.WEIGHTS):
            assert markup.clean(f"{a}<div>{c}</div>{z}", worth).split() == markup.clean(c).split()
    assert markup.weights(docs(spark, ["<html><body>x</body></html>", None])) == markup.WEIGHTS


def test_marks_of_any_length():
    long = "x_1 + " * 200
    assert markup.kinds(f"see ${long}y$ there") == ["latex"]
    assert markup.clean("\\emph{" + "word " * 10_000 + "} end").split() == ["word"] * 10_000 + ["end"]
    deep = "\\emph{" * 60 + "word" + "}" * 60
    assert markup.clean(f"a {deep} b") == "a word b"
    assert markup.clean("[[a]] " + "{{x|" * 30 + "y" + "}}" * 30 + " b").split() == ["a", "b"]
    assert markup.kinds("*" + "word " * 60 + "word*") == ["markdown"]


def test_markup_table(spark):
    d = docs(spark, [None, "", "x", "<b>x</b> **y**", "<b>x</b> **y**"]).withColumn("markup", F.lit(1)).union(docs(spark, ["x"]).select(F.lit(3).cast("long"), F.lit("<b>x</b> **y**"), F.lit(2)))
    assert sorted(map(tuple, markup.found(d).collect())) == [(3, "html"), (3, "markdown"), (4, "html"), (4, "markdown")]
    assert markup.found(d.where("false")).count() == 0 and markup.cleaned(d).count() == 3


# ---- 10

SOUND = ["Ünïcödé and 你好 by Kéreño, Łubæk; § 5 ¶ 40", "The label «Разметка 5» holds", "Авторы сравнили 5 абзацев и показали", "│ Name │ 86 │ • – ’é √(3) ≤ 2 × 4", "L’équipe “Übung” – 10 µm ± 3 °C", "实验表明，准确率为8", "🙂 👩‍🔬 naïve café İstanbul"]


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "mac_roman", "cp437", "cp850", "cp866"])
def test_round_trips(codec):
    text = "L’équipe de Pérez a évalué 5 pages – prüften"
    read = "".join(bytes([b]).decode(codec, "replace") if b < 128 else {v: k for k, v in garble.table(codec).items()}.get(b, chr(b)) for b in text.encode())
    out, n = garble.mend(f"fine {read} fine", (codec,), ())
    assert n > 0 and out == f"fine {text} fine"


def test_cyrillic_in_another_cyrillic_encoding():
    text = "Метод теряет около 5 процента заголовков. Мы проверили страницы"
    assert garble.mend("x " + text.encode("koi8-r").decode("cp1251"))[0] == "x " + text
    assert garble.mend("x " + text.encode("cp1251").decode("koi8-r"))[0] == "x " + text


@pytest.mark.parametrize("text", [*SOUND, "Метод теряет ОКОЛО; 5 процента ЗАГОЛОВКОВ. мЕТОД; и", "1 ВВЕДЕНИЕ В МЕТОДЫ ОЦЕНКИ ПОИСКА"])
def test_sound_texts_stay(text):
    assert garble.mend(text) == (text, 0)


def test_garbled_passage_far_down():
    sound = " ".join(f"модель{k} 数据" for k in range(600))
    bad = "naïve façade".encode().decode("cp1252")
    assert garble.mend(f"{sound} {bad}") == (f"{sound} naïve façade", 2)
    head, word = "ÀÉÎ " * 150 + "être " * 100, "модель данные обучение точность ".encode("cp1251").decode("cp1252")
    assert "модель данные" in garble.mend(head + word * 150)[0]


def test_garbled_table(spark):
    good = ["El equipo comparó párrafos é então", "Авторы сравнили абзацев и показали что метод достигает точности на корпусе", "sólo párrafos"]
    bad = ["El equipo comparÃ³ pÃ¡rrafos", "Ìåòîä äîñòèãàåò òî÷íîñòè ÷òî ìåòîä", "El equipo compar\ufffd p\ufffdrrafos", "sÃƒÂ³lo pÃƒÂ¡rrafos"]
    good[1] += " Метод достигает"
    d = docs(spark, [*good, *bad, None, "", "ascii", *SOUND]).withColumn("restored", F.lit(1)).withColumn("form", F.lit(""))
    rows = {r.doc_id: r for r in garble.restored(d).collect()}
    assert set(rows) == {3, 4, 5, 6}
    assert rows[3].restored == "El equipo comparó párrafos" and rows[4].restored == "Метод достигает точности что метод" and rows[5].restored == "El equipo comparó párrafos" and rows[6].restored == "sólo párrafos"
    assert garble.garbled(d.where("false")).count() == 0


@pytest.mark.parametrize("read, real", [("cp1251", "cp1252"), ("cp1250", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp1250")])
def test_one_byte_misreadings_are_learned_from_twins(spark, read, real):
    text = "więc się który także dłużej między później" if real == "cp1250" else "duração não última divisão método iterações Blöcke fällt über größer même pequeña"
    bad = "".join(garble.reading(real, read).get(c, c) for c in text)
    sound = ["Модель обучена на BERTа и pdfом", "λ(x) γ(x) max(η) max(α)", "côté esté", "cóté está"]
    d = spark.createDataFrame([(0, bad)] + [(k, text) for k in range(1, 13)] + [(20 + k, t) for k, t in enumerate(sound)], "doc_id bigint, text string")
    assert [(r.doc_id, r.restored) for r in garble.restored(d).collect()] == [(0, text)]



# ---- 1


def test_defects(spark):
    q = [(f"q{i}", "Which accuracy does Foo reach on the Bar benchmark?", "Foo reaches 5.1 accuracy on the Bar benchmark.", "Foo is shown in the table of the appendix.") for i in range(4)]
    q.append(("q9", "¿Qué precisión alcanza Foo en la colección Bar?", "Foo alcanza una precisión de 5 en la colección Bar.", None))
    d = spark.createDataFrame([*q, q[0]], "qid string, question string, ideal_answer string, answer_span string").withColumn("answer", F.lit("clash"))
    answers = {"empty": [None, "", " \u200b", "N/A", "<answer></answer>", "...", "Answer:"], "copied_question": ["which accuracy does foo reach on the bar benchmark", "> Which accuracy does Foo reach on the Bar benchmark?", "Q: Which accuracy does Foo reach on the Bar benchmark?\nA:"], "refusal": ["I don't know.", "The excerpts do not say.", "Thank you for the question about Foo. I am unable to verify that from the text. Is there anything else?"], "other_language": ["El método alcanza una precisión de 5 en la colección.", "Метод Foo достигает точности 5 на корпусе."], "truncated": ["Foo reaches 5.1 accuracy on the", "Foo reaches 5.1 accuracy on the Bar benchmark. It was [1", "Foo reaches 5.1 accuracy.\n\n```python\ndef f("], None: ["No", "45.5", "Foo reaches 7 accuracy on the Baz benchmark", "Foo reaches 5 accuracy [3]", "No. Foo declines to answer only 5 of the 9 queries in Bar.", "The authors could not reproduce Foo, yet Bar still gained 5 points."]}
    rows, want, n = [], {}, 0
    for kind, texts in answers.items():
        for t in texts:
            n += 1
            rows.append((f"p{n}", "c", f"q{n % 4}", t, None))
            if kind:
                want[f"p{n}|c|q{n % 4}"] = kind
    rows += [rows[0], ("px", "c", "q0", None, "query timed out"), ("py", None, "nope", "I don't know.", None)]
    want["py||nope"] = "refusal"
    # the refusals recur under prompts of other patterns
    for k, question in enumerate(["How was Foo trained in the study?", "Why does the filter of Foo fail on long texts?", "In which setting is Foo slower than Bar?"]):
        q.append((f"u{k}", question, f"It was shown on {k + 7} pages.", f"Table {k} shows it."))
        for m, t in enumerate(answers["refusal"]):
            rows.append((f"u{m}", "c", f"u{k}", t, None))
            want[f"u{m}|c|u{k}"] = "refusal"
    d = spark.createDataFrame([*q, q[0]], "qid string, question string, ideal_answer string, answer_span string").withColumn("answer", F.lit("clash"))
    r = spark.createDataFrame(rows, "parser string, chunker string, qid string, answer string, error string").withColumn("question", F.lit(1))
    got = pairs.defects(d, r).collect()
    assert {x.record_key: x.defect for x in got if x.table_name == "rag_round2_rows"} == want
    assert {(x.record_key, x.field_name, x.defect) for x in got if x.table_name == "dataset"} == {("q9", "answer_span", "empty")}
    assert pairs.defects(d.where("false"), r.where("false")).count() == 0


def test_a_frequent_pattern_does_not_make_fragments_whole(spark):
    said = ["The Foo model reaches 5 accuracy on the Bar benchmark.", "The filter of Bar left 7 papers in the collection."]
    once = "Results\nThe sentence is shown in this answer."
    full = [(f"q{k}", "Which accuracy does Foo reach on the Bar benchmark?", said[k % 2] if k else once, "Foo is shown in the table.") for k in range(30)]
    d = spark.createDataFrame(full, "qid string, question string, ideal_answer string, answer_span string")
    ends = {"The Foo model reaches 8 accuracy on the Bar benchmark": None, "The Foo model reaches 8 accuracy on the Bar": "truncated", "The Foo model reaches 8 accuracy on the Bar bench": "truncated", "The filter of Foo left 9 pap": "truncated", "The filter of Foo left 9 papers in the collection": None}
    r = spark.createDataFrame([(f"p{k}", "c", f"q{k}", t, None) for k, t in enumerate(ends)], "parser string, chunker string, qid string, answer string, error string")
    got = {x.record_key.split("|")[0]: x.defect for x in pairs.defects(d, r).collect() if x.table_name == "rag_round2_rows"}
    assert got == {f"p{k}": v for k, v in enumerate(ends.values()) if v}


PROMPTS = ["How was {} trained?", "Why does {} fail on long texts?", "In which setting is {} slower?", "Which score does {} reach on the set?"]


def _answers(spark, made):
    """Defects of answers made(k, name) under four unrelated prompts each, by answer number."""
    names = [f"Gra{c}velt" for c in "bcdfghkl"]
    q = [(f"q{k}", PROMPTS[k % 4].format(n), f"It took {k} steps on Zorvlimp{k}.", f"{n} is shown in {k} tables.") for k, n in enumerate(names)]
    rows = [(f"p{j}", "c", f"q{k}", t, None) for k, n in enumerate(names) for j, t in enumerate(made(k, n))]
    d = spark.createDataFrame(q, "qid string, question string, ideal_answer string, answer_span string")
    r = spark.createDataFrame(rows, "parser string, chunker string, qid string, answer string, error string")
    return {(x.record_key.split("|")[0], x.record_key.split("|")[2]): x.defect for x in pairs.defects(d, r).collect() if x.table_name == "rag_round2_rows"}


def test_refusals_of_any_wording_are_found_by_recurrence(spark):
    """No list holds these words; what answers the prompt, even in one wording, is none."""
    made = lambda k, n: [f"Beyond my ken lies {n}, alas.", "Mum is the word here. Beyond my ken lies the rest, alas.", f"Mum is the word here. It took {k} steps.", "Yes.", f"The cause is Zorvlimp{k}, as they write.", f"{n} is fine in its green way {'abcdefgh'[k] * 3}."]
    got = _answers(spark, made)
    assert got == {(p, f"q{k}"): "refusal" for k in range(8) for p in ("p0", "p1")}


def test_a_wording_under_one_pattern_of_prompts_is_an_answer(spark):
    got = _answers(spark, lambda k, n: ["The green filter was left out there." if k % 4 == 2 else f"It is {k}."])
    assert got == {}


def test_long_openings_that_differ_by_a_word_are_one_cluster(spark):
    words = ["word" + "abcdefghij"[k // 10] + "abcdefghij"[k % 10] for k in range(60)]
    other = " ".join(words[:-1] + ["changed"])
    one = spark.createDataFrame([(" ".join(words),), (other,), ("z " + other,), ("quite another thing",)], "template string")
    got = {r.template: r.cluster for r in pairs.clusters(one).collect()}
    assert len(set(got.values())) == 2 and got["quite another thing"] == "quite another thing"
    assert pairs.clusters(one.where("false")).count() == 0


def test_links_that_miss_the_least_of_their_bucket_count(spark):
    """A chain: each member resembles the next, the ends do not resemble each other."""
    words = ["w" + "abcdefghij"[k // 10] + "abcdefghij"[k % 10] for k in range(100)]
    chain = [" ".join(words[k : k + 50]) for k in range(0, 50, 4)]
    got = {r.cluster for r in pairs.clusters(spark.createDataFrame([(c,) for c in chain], "template string")).collect()}
    assert got == {min(chain)}


def test_quotations_of_any_length_have_no_language():
    assert pairs.language("This is the title of the paper: „" + "der die das und nicht ist " * 400 + "“") == "en"


RUSSIAN = "Метод достигает точности на корпусе после проходов обучения. Мы проверили страницы и заметили, что модель теряет около процента заголовков. Авторы сравнили абзацев и показали, что работает быстрее. Ошибка модели снизилась, тогда как по-прежнему пропускает подписи."
WESTERN = "duração não última divisão método iterações Blöcke fällt über größer même pequeña après réseau très"


def _bad(text, read, real):
    """Text in ``real`` as ``read`` (an encoding or a map of bytes) shows it."""
    if isinstance(read, dict):
        of = read
    else:
        of = {b: ch for ch, b in garble.table(read).items()}
    return "".join(chr(b) if b < 128 else of[b] for b in (text.encode(real) if real == "utf-8" else bytes(ord(c) if c.isascii() else garble.table(real)[c] for c in text)))


@pytest.mark.parametrize("read, real", [("cp1251", "cp866"), ("cp1252", "cp1251"), ("cp1251", "koi8-r"), ("cp1252", "koi8-r"), ("cp850", "cp1251"), ("mac_roman", "cp866")])
def test_cyrillic_misreadings_are_learned_from_patterns(spark, read, real):
    d = spark.createDataFrame([(0, _bad(RUSSIAN, read, real))] + [(k, RUSSIAN) for k in range(1, 5)], "doc_id bigint, text string")
    assert [(r.doc_id, r.restored) for r in garble.restored(d).collect()] == [(0, RUSSIAN)]


def test_an_encoding_that_no_library_knows_is_learned(spark):
    signs = [chr(0x2200 + 3 * k) for k in range(128)]
    random.Random(5).shuffle(signs)
    d = spark.createDataFrame([(0, _bad(WESTERN, dict(zip(range(128, 256), signs)), "utf-8"))] + [(k, WESTERN) for k in range(1, 5)], "doc_id bigint, text string")
    assert [(r.doc_id, r.restored) for r in garble.restored(d).collect()] == [(0, WESTERN)]


def test_share_of_texts_restored(spark):
    """Texts of three languages read wrongly in eight ways, once or twice, as a whole or in part."""
    rnd = random.Random(8)
    lines = [*RUSSIAN.split(". "), WESTERN, "więc się który także dłużej między później", "实验表明，准确率为8，共使用5个样本"]
    ways = [*(("utf-8", c) for c in ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "mac_roman", "cp437", "cp850")), ("cp1251", "cp1252"), ("cp866", "cp1251")]
    rows, want = [], {}
    for k in range(400):
        text = rnd.sample(lines, 3)
        want[k] = "\n".join(text)
        if k % 4 == 0:
            real, read = rnd.choice(ways)
            at = [j for j in range(3) if rnd.random() < 0.7 and (real == "utf-8" or text[j] in RUSSIAN)]
            for j in at:
                text[j] = _bad(text[j], read, real)
                if real == "utf-8" and read == "cp1252" and rnd.random() < 0.2:
                    text[j] = _bad(text[j], read, real)
        rows.append((k, "\n".join(text)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    bad = {k for k, t in rows if t != want[k]}
    got = {r.doc_id: r.restored for r in garble.restored(d).collect()}
    assert len(bad) > 50 and len(set(got) & bad) >= 0.97 * len(bad) and set(got) <= bad
    assert sum(got[k] == want[k] for k in got) >= 0.95 * len(bad)


def test_words_of_any_length_are_learned_from(spark):
    long = "duraçãonãoúltima" * 10
    d = docs(spark, [_bad(long, "cp437", "utf-8") + " x", _bad("é" + long, "cp437", "utf-8") + " x", long + " y", "é" + long])
    assert {r.doc_id for r in garble.garbled(d).collect()} == {0, 1}


# ---- 3, again


def _shared_rows(seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcd é你") for _ in range(n))
    common = [word(260) for _ in range(6)]
    rows = []
    for i in range(60):
        c = rnd.choice(common)
        a = rnd.randint(0, 60)
        rows.append((str(i), word(rnd.randint(0, 200)) + (c[a : a + rnd.randint(60, 200)] if i % 3 else "") + word(rnd.randint(0, 100))))
    return rows


def test_hashes_that_collide_change_nothing(spark, monkeypatch):
    """All phrases of a text get one of three hashes: every one is proposed, the text decides."""
    weak = spans._grams

    def few(codes, k, base):
        return weak(codes, k, base) % np.uint64(3)

    rows = _shared_rows(5)
    df = spark.createDataFrame([("t", k, t) for k, t in rows], "table_name string, record_key string, text string")
    run, phrases = spans._marks(120), spans._phrases(120)

    def patched(f):
        def go(batches):
            spans._grams = few
            try:
                yield from f(batches)
            finally:
                spans._grams = weak

        return go

    monkeypatch.setattr(spans, "_marks", lambda span: patched(run))
    monkeypatch.setattr(spans, "_phrases", lambda span: patched(phrases))
    assert {r.record_key: r.shared_chars for r in spans.shared(df).collect()} == brute_shared(rows, 120)


def test_many_shards_and_parts_of_a_shard(spark, monkeypatch):
    rows = _shared_rows(6)
    df = spark.createDataFrame([("t", k, t) for k, t in rows], "table_name string, record_key string, text string")
    monkeypatch.setattr(spans, "SHARD", 3)
    monkeypatch.setattr(spans, "STREAM", 900)
    assert {r.record_key: r.shared_chars for r in spans.shared(df).collect()} == brute_shared(rows, 120)


def test_clocks(spark):
    """The assistant's clock is ten seconds behind in a, right in b; in c no offset fits; d has one speaker."""
    at = lambda s: f"2024-05-01T10:{s // 60:02d}:{s % 60:02d}Z"
    rows = [(c, r, t) for c, off in (("a", -10), ("b", 0)) for r, t in (("user", 0), ("assistant", 5 + off), ("user", 20), ("assistant", 25 + off))]
    rows += [("c", "user", 0), ("c", "assistant", 100), ("c", "user", 200), ("c", "assistant", 150), ("c", "user", 40), ("d", "user", 0)]
    m = spark.createDataFrame([(k, c, r, f"text {k}", None, at(t + 60), 5000 if r == "assistant" else None) for k, (c, r, t) in enumerate(rows)], "id long, chat_id string, role string, content string, sources string, created_at string, duration_ms int")
    c = spark.createDataFrame([(x, None, None, None, 0) for x in "abcd"], "id string, title string, created_at string, updated_at string, embedded int")
    got = {r.chat_id: r for r in chats.clock_offsets(c, m).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"].offset_s == -10 and got["a"].moved == 2 and not got["a"].infeasible
    assert got["b"].offset_s == 0 and got["b"].moved == 0 and got["c"].infeasible
    assert chats.clock_offsets(c, m.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 5), st.sampled_from("abcdef")), max_size=40), st.sampled_from([None, 1, 2, 3]), st.booleans())
def test_containers_keep_what_they_promise(items, most, strict):
    items = sorted(items, key=lambda x: (-x[0], x[1], x[2]))
    got = pack.fill([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], 60, most, strict)
    per = {}
    for (size, cluster, source), (b, fits) in zip(items, got):
        held = per.setdefault(b, [])
        assert not fits or cluster not in [c for _, c, _ in held]
        assert not strict or fits
        held.append((size, cluster, source))
    for held in per.values():
        assert sum(s for s, _, _ in held) <= 60 and (most is None or len({s for _, _, s in held}) <= most)


def test_mix_parts_are_even_for_small_weights(spark):
    """Poor documents have large keys; parts by quantile stay alike."""
    rows = [(i, "a", ("w" if i % 3 else "1") * (1 + i % 7)) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mix.mix(d, t)
    assert chosen.count() == 4000 and shares.collect()[0].actual_share == 1.0
