"""Processing only what is new or changed: a manifest, an anti-join, idempotent batches.

``changed_per_run`` replays the recorded runs of a registry. ``IncrementalJob`` runs
such a job over files: list, anti-join with the manifest, write under the batch's
own name, and only then commit the manifest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

STATE = ("status", "downloaded_at", "parsed_at", "processed_at", "embedded_at")


def changed_per_run(readings: DataFrame, runs: DataFrame) -> DataFrame:
    """run_no, filename for each successful run and each paper that is new or changed since the one before.

    The current state at a run is that of the reading with the latest exported_at
    among the loads it sees (of equals the later load, then the greater values).
    Only ``ok`` runs commit; failed runs leave no trace, so their papers come with
    the next success, once. Readings beyond the last successful run don't come yet.
    A null filename or load is no reading; a null exported_at is older than any.

    Readings are reduced to one row per paper and run that sees them first, before the
    shuffle; then the listing of each run is anti-joined with the manifest of the
    run before it, on a checksum of the state. Hot papers combine map-side, and no
    paper has more rows than there are runs.
    """
    ok = runs.where("outcome = 'ok' and run_no is not null and last_load is not null").groupBy("run_no").agg(F.max("last_load").alias("last_load"))
    reach = F.max("last_load").over(Window.orderBy("run_no"))
    bounds = ok.select("run_no", reach.alias("to")).withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("run_no")), F.lit(-(2**31))))
    slots = F.broadcast(bounds.where(F.col("to") > F.col("from")))  # a row per run of a small table
    readings = readings.select("filename", "load_no", "exported_at", *STATE)
    seen = readings.where("filename is not null and load_no is not null").join(slots, (F.col("load_no") > F.col("from")) & (F.col("load_no") <= F.col("to")))
    latest = F.max(F.struct("exported_at", "load_no", *STATE))
    listing = seen.groupBy("filename", "run_no").agg(latest.alias("r"))
    by_run = Window.partitionBy("filename").orderBy("run_no")
    listing = listing.select("filename", "run_no", F.max("r").over(by_run).alias("r"), F.row_number().over(by_run).alias("n"))
    listing = listing.select("filename", "run_no", "n", F.sha2(F.to_json(F.struct(*[F.col(f"r.{c}").alias(c) for c in STATE])), 256).alias("checksum"))
    manifest = listing.select("filename", (F.col("n") + 1).alias("n"), "checksum")
    return listing.join(manifest, ["filename", "n", "checksum"], "left_anti").select("run_no", "filename")


class IncrementalJob:
    """A job over the files of a folder that handles each version of each file once.

    ``run`` lists the files. Those whose size and time the manifest holds are known and
    not read; of the others size and checksum are anti-joined with the manifest. What is
    left is written once, content included, as the snapshot of this batch: ``make`` gets
    the snapshot, and the same snapshot enters the manifest, so a file that changes
    meanwhile comes again with the next run instead of being taken for processed. The
    output goes to ``out/batch=<id>`` (replacing what a failed attempt left there), and
    only then the manifest is committed. The batch id follows from the number of
    commits, so a repeated attempt writes to the same place. Every ``COMPACT`` commits
    the manifest is written as a whole, so that reading it does not grow with the runs.
    """

    SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("modified", T.TimestampType()), T.StructField("size", T.LongType()), T.StructField("checksum", T.StringType())])
    COMPACT = 50

    def __init__(self, spark: SparkSession, source: str, out: str, manifest: str, glob: str = "*"):
        self.spark, self.source, self.out, self.manifest, self.glob = spark, source, out.rstrip("/"), manifest.rstrip("/"), glob

    def _done(self, kind: str) -> list[int]:
        fs, path, jvm = self._fs(self.manifest)
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        done = [p for p in names if p.getName().startswith(f"{kind}=") and fs.exists(jvm.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def _fs(self, at: str):
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = jvm.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path, jvm

    def listing(self) -> DataFrame:
        """path, modified, size, content. What does not select the content does not read it."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", self.glob).option("recursiveFileLookup", "true").load(self.source)
        return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")

    def committed(self) -> DataFrame:
        """The manifest: the last whole one and the commits since."""
        whole, commits = self._done("whole"), self._done("commit")
        last = whole[-1] if whole else -1
        paths = [f"{self.manifest}/whole={last}"] * bool(whole) + [f"{self.manifest}/commit={k}" for k in commits if k > last]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*paths)

    def pending(self) -> DataFrame:
        """path, modified, size, checksum, content of the files that are new or changed."""
        known = self.committed()
        fresh = self.listing().select("path", "modified", "size").join(known, ["path", "modified", "size"], "left_anti").select("path")
        # the paths that are left are read; others are pruned by the join before their content is hashed
        files = self.listing().join(fresh, "path", "left_semi").withColumn("checksum", F.sha2("content", 256))
        return files.join(known, ["path", "size", "checksum"], "left_anti").select("path", "modified", "size", "checksum", "content")

    def run(self, make: Callable[[DataFrame], DataFrame]) -> int | None:
        """The batch id, or None if nothing is new. An exception in ``make`` or in writing commits nothing."""
        done = self._done("commit")
        batch = done[-1] + 1 if done else 0
        todo = written(self.pending())
        if todo.isEmpty():
            return None
        make(todo).write.mode("overwrite").parquet(f"{self.out}/batch={batch}")
        todo.drop("content").write.mode("overwrite").parquet(f"{self.manifest}/commit={batch}")
        if (batch + 1) % self.COMPACT == 0:
            self.committed().write.mode("overwrite").parquet(f"{self.manifest}/whole={batch}")
        return batch

    def results(self) -> DataFrame:
        """The output of committed batches only."""
        return self.spark.read.option("basePath", self.out).parquet(*[f"{self.out}/batch={k}" for k in self._done("commit")])
