"""Nearest neighbours: exact by blocks, or within the cells of an inverted file.

Exact: queries and base vectors lie in blocks, a task multiplies two blocks and keeps
the best k per query. Inverted file: every vector lies in the cell of its nearest
centre, a query searches the cells of its nearest centres only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a base block and of a query block.
BASE, QUERY = 4096, 1024


def _blocks(df: DataFrame, key: str, vector: str, size: int, label: str | None, prefix: str) -> DataFrame:
    """One row per block of at most about ``size`` vectors: ids, labels and the vectors laid end to end."""
    cols = [F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(label).cast("long") if label else F.lit(None).cast("long")).alias("l")]
    b = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(*cols).withColumn("b", F.floor(F.col("id") / size))
    g = b.groupBy("b").agg(F.collect_list(F.struct("id", "l", "v")).alias("r"))
    return g.select(F.col("b").alias(f"{prefix}b"), F.col("r.id").alias(f"{prefix}id"), F.col("r.l").alias(f"{prefix}l"), F.flatten("r.v").alias(f"{prefix}v"), F.size("r").alias(f"{prefix}n"))


def knn(base: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine", label: str | None = None, same_label: bool = False) -> DataFrame:
    """query_id, id, distance, rank: the k nearest base vectors of every query, itself left out; ties by id.

    Every query meets every base vector: the work is the product of the two tables by
    the statement of the search, done in blocks as matrix products, and only k rows
    per query and base block are shuffled. A vector of length 0 has cosine distance 1.
    Null vectors are left out.
    """
    b = _blocks(base, key, vector, BASE, label, "x")
    q = _blocks(queries, key, vector, QUERY, label, "q")
    # a base block goes to the query blocks there are: one row holds their numbers
    there = q.agg(F.collect_set("qb").alias("qbs"))
    pairs = b.join(F.broadcast(there), F.lit(True)).withColumn("qb", F.explode("qbs")).drop("qbs").join(q, "qb")
    return _ranked(pairs, k, metric, same_label)


def _ranked(pairs: DataFrame, k: int, metric: str, same_label: bool) -> DataFrame:
    """The best k per query over pairs of blocks (xid, xl, xv, qid, ql, qv)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in ("xid", "xl", "xv", "qid", "ql", "qv")}
            for i in range(batch.num_rows):
                xid, xl, x, qid, ql, y = (cols[n][i].values.to_numpy(zero_copy_only=False) for n in ("xid", "xl", "xv", "qid", "ql", "qv"))
                if not len(xid) or not len(qid):
                    continue
                x, y = x.reshape(len(xid), -1), y.reshape(len(qid), -1)
                if metric == "cosine":
                    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        dist = 1 - np.nan_to_num((y @ x.T) / ny[:, None] / nx[None, :])
                else:
                    dist = np.sqrt(np.maximum(0, (y**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * y @ x.T))
                dist[qid[:, None] == xid[None, :]] = np.inf
                if same_label:
                    dist[ql[:, None] != xl[None, :]] = np.inf
                most = min(k, len(xid))
                edge = np.partition(dist, most - 1, axis=1)[:, most - 1]
                row, col = np.nonzero((dist <= edge[:, None]) & np.isfinite(dist))
                order = np.lexsort((xid[col], dist[row, col], row))
                row, col = row[order], col[order]
                first = np.searchsorted(row, np.arange(len(qid)))
                keep = np.arange(len(row)) - first[row] < k
                row, col = row[keep], col[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(xid[col]), pa.array(dist[row, col])], ["query_id", "id", "distance"])

    best = pairs.select("xid", "xl", "xv", "qid", "ql", "qv").mapInArrow(run, "query_id bigint, id bigint, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centres(base: DataFrame, cells: int, vector: str = "embedding", sample: int = 20_000, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of cells by k-means on directions, fitted on at most ``sample`` vectors."""
    held = [r[0] for r in base.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).orderBy(F.xxhash64(vector)).limit(sample).toLocalIterator()]
    if not held:
        return np.zeros((0, 1))
    x = np.array(held, float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        for j in range(len(c)):
            mine = x[home == j]
            c[j] = mine.mean(0) if len(mine) else x[rng.integers(len(x))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def knn_cells(base: DataFrame, queries: DataFrame, k: int = 10, cells: int = 64, probes: int = 16, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """As ``knn``, for each query over the ``probes`` cells nearest to it: approximate, all rows are indexed.

    The centres are fitted on a bounded sample (``centres``) and are of a fixed size,
    so they go to every task. A cell is cut into blocks by id, so a cell of a third of
    all vectors is many tasks; the exact search is ``knn``.
    """
    c = centres(base, cells, vector)

    def near(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                got = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, : min(n, len(c))]
                at = pa.array(np.repeat(np.arange(batch.num_rows), got.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(got.ravel().astype(np.int32))], ["id", "v", "cell"])

        return run

    def placed(df: DataFrame, n: int, size: int, p: str) -> DataFrame:
        src = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        g = src.mapInArrow(near(n), "id bigint, v array<double>, cell int").groupBy("cell", F.floor(F.col("id") / size).alias("b")).agg(F.collect_list(F.struct("id", "v")).alias("r"))
        return g.select("cell", F.col("r.id").alias(f"{p}id"), F.transform("r.id", lambda _: F.lit(0).cast("long")).alias(f"{p}l"), F.flatten("r.v").alias(f"{p}v"))

    if not len(c):
        return knn(base.where("false"), queries.where("false"), k, key, vector, metric)
    # blocks are narrower in a cell by the number of cells, so those by id are as full as without
    b, q = placed(base, 1, BASE * cells, "x"), placed(queries, probes, QUERY * max(1, cells // probes), "q")
    return _ranked(b.join(q, "cell"), k, metric, False)
