import random
import time

import numpy as np
import pyarrow as pa
import pytest

from foliospark.operators import contains as K
from foliospark.plans import answers as A

RND = random.Random(5)


def batches(rows, size):
    """``rows`` (group, id or null, text) as they reach the operator, ``size`` to a batch."""
    rows = sorted(rows, key=lambda r: (r[0], r[1] is None))
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows[i : i + size])], ["group", "id", "text"])


@pytest.mark.parametrize("size,chunk,collide", [(7, 50, False), (1000, 1_000_000, False), (11, 64, True)])
def test_spans_against_brute_force(monkeypatch, size, chunk, collide):
    monkeypatch.setattr(K, "CHUNK", chunk)
    monkeypatch.setattr(K, "WINDOWS", 100)
    if collide:  # every hash says no more than two bits; windows of other groups and lengths are proposed too
        monkeypatch.setattr(K, "_mix", lambda h, group, n: h & np.uint64(3))
    word = lambda lo, hi: "".join(RND.choice("ab é") for _ in range(RND.randint(lo, hi))).encode()
    rows, expected = [], set()
    for g in range(30):
        texts = [word(0, 400) for _ in range(RND.randint(0, 9))]
        cut = [t[(p := RND.randrange(len(t))) : p + RND.choice([1, 2, 5, 16, 31, 32, 33, 90, 400])] for t in texts * 3 if t]
        spans = cut + [c[:-1] + b"a" for c in cut if len(c) > 1] + [word(1, 60) for _ in range(20)] + cut[:3]
        if spans and g % 3 == 0:
            spans += [b"x" * 300, b"a" * 40]
            texts.append(b"b" + b"a" * 400)
        ids = [f"{g}-{i}".encode() for i in range(len(spans))]
        expected |= {i for i, s in zip(ids, spans) if any(s in t for t in texts)}
        rows += [(str(g % 30).encode(), i, s) for i, s in zip(ids, spans)] + [(str(g).encode(), None, t) for t in texts]
    got = [i for b in K._search(batches(rows, size)) for i in b.column(0).to_pylist()]
    assert set(got) == expected and 0 < len(expected) < len(rows)


def tables(spark, path, questions, documents):
    spark.createDataFrame(questions, "qid string, paper string, answer_span string").write.parquet(f"{path}/dataset.parquet")
    spark.createDataFrame(documents, "doc_id bigint, stem string, text string").repartition(4).write.parquet(f"{path}/documents.parquet")
    return {r.qid: (r.found, r.docs) for r in A.span_in_document(spark, str(path)).collect()}


def test_span_in_document_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "PART", 40)  # several parts
    questions = [("a", "p", "one  two three\tfour"), ("a", "p", "one  two three\tfour"), ("b", "p", " " * 20), ("c", "empty", " " * 20), ("d", "q", "stands in another paper"), ("e", "p", "ends  with  the  text"), ("f", "p", "x" + " " * 20), ("g", "p", "too short"), ("l", "p", "ж" + " " * 20), ("h", None, "a question without paper"), (None, "p", "one  two three\tfour"), ("i", "p", "one two three four five six"), ("j", "nulls", "one  two three\tfour"), ("k", "p", "длинный ответ на русском языке")]
    documents = [(1, "p", "zero one two\n three four five"), (2, "p", "it ends with the text"), (3, "p", "stands in another paper"), (4, "p", None), (5, "p", ""), (6, None, "one two three four"), (7, "nulls", None), (8, "q", "six"), (9, "p", "вот длинный ответ на  русском языке."), (10, "p", "zero one two\n three four five")]
    assert tables(spark, tmp_path, questions, documents) == {"a": (True, 6), "b": (True, 6), "c": (False, 0), "d": (False, 1), "e": (True, 6), "f": (True, 6), "l": (False, 6), "i": (False, 6), "j": (False, 0), "k": (True, 6)}


def test_span_in_document_hot_paper(spark, tmp_path):
    """20,000 spans and 20,000 texts of one paper: 400 million pairs, none of which may be looked at."""
    text = lambda r, n: " ".join(r.choice(("deep", "graph", "sparse", "loss", "kernel", "field")) + str(r.randrange(99)) for _ in range(n))
    docs = [text(RND, 50) for _ in range(20_000)]
    spans = [docs[i][20:150].strip() if i % 2 else text(RND, 18) for i in range(20_000)]
    began = time.perf_counter()
    got = tables(spark, tmp_path, [(str(i), "hot", s) for i, s in enumerate(spans)], [(i, "hot", t) for i, t in enumerate(docs)])
    assert got == {str(i): (bool(i % 2), 20_000) for i in range(20_000)}
    assert time.perf_counter() - began < 60
