"""Session helpers: reading tables, the shared working folder, cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local session without that setting (a test) gets a temporary one; on a
    cluster a folder of one machine is none that all share, so it must be set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_written: dict[str, list[str]] = {}


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read by all, and kept if executors are lost.

    It stays until ``release``, at the latest until the application ends.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(release, spark, app)
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    _written[app].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, app: str | None = None) -> int:
    """Delete the tables that ``written`` made in this application; call it when the results that need them are stored. Returns how many there were."""
    paths = _written.get(app or spark.sparkContext.applicationId, [])
    done = 0
    while paths:
        at = paths.pop()
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; a folder that this machine sees can still be deleted
            shutil.rmtree(at.removeprefix("file:"), ignore_errors=True)
        done += 1
    return done


def written_in(spark: SparkSession, df: DataFrame, partitions: int) -> DataFrame:
    """As ``written``, in about ``partitions`` files, without a shuffle if there are more now."""
    return written(df.coalesce(partitions))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="foliospark-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)
