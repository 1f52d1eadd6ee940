import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from foliospark.operators.incremental import IncrementalJob, changed_per_run

READ = "load_no int, exported_at timestamp_ntz, filename string, domain string, status string, downloaded_at timestamp_ntz, parsed_at timestamp_ntz, processed_at timestamp_ntz, embedded_at timestamp_ntz"
RUN = "run_no int, outcome string, last_load int"
T = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)


def reading(load, at, name, status, **kw):
    return (load, T(at), name, "d", status, *[T(kw[c]) if c in kw else None for c in ("downloaded_at", "parsed_at", "processed_at", "embedded_at")])


def brute(readings, runs):
    """Every run over everything it sees."""
    out, before = [], None
    for run, outcome, last in sorted(runs):
        if outcome != "ok":
            continue
        now = {}
        for r in readings:
            if r[2] is not None and r[0] <= last and (r[2] not in now or (r[1], r[0]) >= (now[r[2]][1], now[r[2]][0])):
                now[r[2]] = r
        state = {k: (v[4], *v[5:]) for k, v in now.items()}
        out += [(run, k) for k, v in state.items() if before is None or before.get(k) != v or k not in before]
        before = state
    return sorted(out)


def test_runs_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    readings = [reading(rnd.randint(1, 12), rnd.random() * 50, f"p{rnd.choice([0, 0, 0, 1, 2, 3, 4])}", rnd.choice(["downloaded", "parsed", "error"]), downloaded_at=rnd.choice([1, 2])) for _ in range(120)]
    readings += readings[:20] + [reading(3, 1, None, "parsed")]
    runs = [(1, "failed", 2), (2, "ok", 3), (3, None, 5), (4, "ok", 6), (5, "killed", 9), (6, "ok", 9), (7, "ok", 9), (8, "ok", 10)]
    rows = changed_per_run(spark.createDataFrame(readings, READ), spark.createDataFrame(runs, RUN)).collect()
    assert sorted(map(tuple, rows)) == brute(readings, runs)


def test_empty_and_extra_columns(spark):
    runs = spark.createDataFrame([(1, "ok", 3)], RUN).withColumn("filename", F.lit("clash"))
    assert changed_per_run(spark.createDataFrame([], READ), runs).count() == 0
    one = spark.createDataFrame([reading(1, 1, "a", None)], READ).withColumn("run_no", F.lit(9)).withColumn("n", F.lit(1))
    assert [tuple(r) for r in changed_per_run(one, runs).collect()] == [(1, "a")]
    assert changed_per_run(one, spark.createDataFrame([], RUN)).count() == 0


def test_job_survives_failures(spark, tmp_path):
    src, out, man = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "man")
    src.mkdir()
    job = IncrementalJob(spark, str(src), out, man)
    names = lambda: sorted(os.path.basename(r[0]) for r in job.results().select("path").collect())
    (src / "a").write_text("1")
    (src / "b").write_text("2")
    with pytest.raises(RuntimeError):
        job.run(lambda f: (_ for _ in ()).throw(RuntimeError("lost")))
    assert job.run(lambda f: f.select("path")) == 0
    assert names() == ["a", "b"]
    assert job.run(lambda f: f.select("path")) is None
    (src / "b").write_text("22")
    (src / "c").write_text("3")
    # an attempt that wrote its batch but died before the commit
    job.pending().select("path").write.parquet(f"{out}/batch=1")
    assert job.run(lambda f: f.select("path")) == 1
    assert names() == ["a", "b", "b", "c"]


def test_a_file_that_changes_while_it_is_processed_comes_again(spark, tmp_path, monkeypatch):
    src, out, man = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "man")
    src.mkdir()
    monkeypatch.setattr(IncrementalJob, "COMPACT", 2)
    job = IncrementalJob(spark, str(src), out, man)
    (src / "a").write_text("old")

    def make(files):
        (src / "a").write_text("newer")
        return files.select("path", F.col("content").cast("string").alias("said"))

    assert job.run(make) == 0 and [r.said for r in job.results().collect()] == ["old"]
    assert job.run(lambda f: f.select("path", F.col("content").cast("string").alias("said"))) == 1
    assert sorted(r.said for r in job.results().collect()) == ["newer", "old"]
    assert job.run(make) is None and job._done("whole") == [1] and job.committed().count() == 2
    (src / "b").write_text("third")
    assert job.run(lambda f: f.select("path", F.lit("x").alias("said"))) == 2 and job.committed().count() == 3


def test_written_tables_are_released(spark):
    import os as _os

    from foliospark import session

    df = session.written(spark.range(3))
    path = session._written[spark.sparkContext.applicationId][-1]
    assert df.count() == 3 and _os.path.isdir(path)
    assert session.release(spark) > 0 and not _os.path.isdir(path)
