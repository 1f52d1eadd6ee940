"""Paired statistics over a long metric table (cell keys, qid, metric, value)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import order as O

ALPHA = 0.05
PENDING_BELOW = 50
_TOL = 1e-9


def sign_p(wins: int, losses: int) -> float:
    """Exact two-sided sign test; ties are left out; 1 if nothing differs."""
    n, k = wins + losses, min(wins, losses)
    if n == 0:
        return 1.0
    if n <= 2000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / (1 << n))
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * sum(math.exp(x - top) for x in logs))


@F.pandas_udf(DoubleType())
def _sign(w: pd.Series, l: pd.Series) -> pd.Series:  # noqa: E741
    return pd.Series([sign_p(int(a), int(b)) for a, b in zip(w, l)])


@F.pandas_udf(DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: max(0.0, min(1.0, 1 + math.erf(x / math.sqrt(2)))))


def paired(long: DataFrame, baseline: str) -> DataFrame:
    """a and b per (metric, parser, chunker, qid): each chunker against the baseline chunker, where both have a value."""
    a = long.where((F.col("chunker") != baseline) & F.col("value").isNotNull()).select("metric", "parser", "chunker", "qid", "paper", F.col("value").alias("a"))
    b = long.where((F.col("chunker") == baseline) & F.col("value").isNotNull()).select("metric", "parser", "qid", F.col("value").alias("b"))
    return a.join(b, ["metric", "parser", "qid"])


def cohens_dz(mean, sd, n):
    return F.when(n < 2, 0.0).when(sd > 0, F.round(mean / sd, 6)).when(mean == 0, 0.0).otherwise(F.signum(mean) * 1e308)


def paired_tests(long: DataFrame, baseline: str) -> DataFrame:
    """wins, losses, exact p, means, difference and effect size of each cell against the baseline; few pairs are pending."""
    key = ["metric", "parser", "chunker"]
    delta = F.col("a") - F.col("b")
    g = paired(long, baseline).groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg(delta).alias("d"), F.stddev_samp(delta).alias("sd"))
    return g.select(*key, "n", "wins", "losses", F.round(_sign("wins", "losses"), 6).alias("p"), F.round("ma", 6).alias("mean_a"), F.round("mb", 6).alias("mean_b"), F.round("d", 6).alias("diff"), cohens_dz(F.col("d"), F.col("sd"), F.col("n")).alias("dz"), (F.col("n") < PENDING_BELOW).alias("pending"))


def holm(tests: DataFrame, family: list[str], p: str = "p", alpha: float = ALPHA) -> DataFrame:
    """Step-down within each family: a test holds while every smaller p passed its own bound."""
    order = Window.partitionBy(*family).orderBy(p, "parser", "chunker")
    t = tests.withColumn("rk__", F.row_number().over(order) - 1).withColumn("m__", F.count("*").over(Window.partitionBy(*family)))
    t = t.withColumn("ok__", F.col(p) <= alpha / (F.col("m__") - F.col("rk__")))
    return t.withColumn("holm", F.min("ok__").over(Window.partitionBy(*family).orderBy("rk__"))).drop("rk__", "m__", "ok__")


def wilcoxon(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Signed ranks, normal approximation with corrections for ties and continuity. Ranks come from counts per distinct difference, which combine map-side."""
    d = pairs.select(*key, F.round(F.col("a") - F.col("b"), 12).alias("d")).where("d <> 0")
    g = d.groupBy(*key, F.abs("d").alias("v")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("rank", before + (F.col("t") + 1) / 2)
    s = g.groupBy(*key).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("minus"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    w = F.least("plus", "minus")
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48
    z = (w - F.col("n") * (F.col("n") + 1) / 4 + 0.5) / F.sqrt(var)
    return s.select(*key, "n", w.alias("w"), F.when(var <= 0, 1.0).otherwise(F.round(_two_sided(F.coalesce(z, F.lit(0.0))), 6)).alias("p"))


def verdicts(tests: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """better or worse if at least two units win (lose) after Holm, none the other way, and the pooled difference is large enough."""
    g = tests.groupBy(*key).agg(F.count_if(F.col("holm") & (F.col("diff") > 0)).alias("wins"), F.count_if(F.col("holm") & (F.col("diff") < 0)).alias("losses"), F.round(F.avg("diff"), 6).alias("pooled"), F.count("*").alias("units"))
    big = F.abs("pooled") >= threshold - _TOL
    v = F.when((F.col("wins") >= 2) & (F.col("losses") == 0) & big & (F.col("pooled") > 0), "better").when((F.col("losses") >= 2) & (F.col("wins") == 0) & big & (F.col("pooled") < 0), "worse").otherwise("no established difference")
    return g.withColumn("verdict", v)


def fixed_sequence(v: DataFrame, metrics: list[str], key: list[str]) -> DataFrame:
    """The metrics tested in order of priority, up to and including the first without a difference."""
    step = F.create_map(*[F.lit(x) for i, m in enumerate(metrics, 1) for x in (m, i)])
    s = v.withColumn("step", step[F.col("metric")])
    passed = F.min(F.col("verdict") != "no established difference").over(Window.partitionBy(*key).orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn("ok__", F.coalesce(passed, F.lit(True))).where("ok__").select(*key, "metric", "verdict", "step")


def cluster_bootstrap(pairs: DataFrame, key: list[str], cluster: str, draws: int = 10_000, seed: int = 1) -> DataFrame:
    """Difference of means with a 95 % percentile interval, whole clusters drawn with replacement.

    Pairs are reduced to sum and count per cluster first; a task then holds one
    number pair per cluster of a cell, never the pairs.
    """
    g = pairs.where(F.col(cluster).isNotNull()).groupBy(*key, cluster).agg(F.sum(F.col("a") - F.col("b")).alias("s"), F.count("*").cast("double").alias("c"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in g.schema if f.name in key)

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster)
        s, c = pdf["s"].to_numpy(), pdf["c"].to_numpy()
        rng = np.random.default_rng(seed)
        means = np.empty(draws)
        step = max(1, 2_000_000 // len(s))
        for a in range(0, draws, step):
            pick = rng.integers(0, len(s), (min(step, draws - a), len(s)))
            means[a : a + len(pick)] = s[pick].sum(1) / c[pick].sum(1)
        means.sort()
        return pd.DataFrame([[*k, s.sum() / c.sum(), means[int(0.025 * draws)], means[min(draws - 1, int(0.975 * draws))]]], columns=[*key, "diff", "lo", "hi"])

    out = g.groupBy(*key).applyInPandas(run, f"{kinds}, diff double, lo double, hi double")
    return out.select(*key, *[F.round(c, 6).alias(c) for c in ("diff", "lo", "hi")])


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks with ties averaged, from counts per distinct value: distinct values are range-partitioned and their counts summed per part, so no task sorts all rows."""
    g = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("t__")).withColumn("k__", F.lit(0))
    g = O.running(O.parts(g, "k__", value), "k__", value, "upto__", F.col("t__"))
    return df.join(g.select(value, (F.col("upto__") - F.col("t__") + (F.col("t__") + 1) / 2).alias(name)), value)


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman (Pearson of average ranks)."""
    d = average_rank(average_rank(df.select(x, y), x, "rx"), y, "ry")
    return d.agg(F.round(F.corr(x, y), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"), F.count("*").alias("n"))


def quantiles(df: DataFrame, value: str, ps: dict[str, float], by: str | None = None, disc: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles per group: linear between the two values around the place, or (``disc``) the first value that reaches the share.

    Equal values are counted before the shuffle, and the counts are summed over parts
    (``order``), so no task holds a group. Nulls are left out; without a value there is
    no row (``by`` None: one row of nulls).
    """
    g = df.where(F.col(value).isNotNull()).select((F.col(by) if by else F.lit(0)).alias("_k"), F.col(value).alias("_v")).groupBy("_k", "_v").agg(F.count("*").alias("_t"))
    g = O.running(O.parts(g, "_k", "_v"), "_k", "_v", "_upto", F.col("_t"))
    g = g.join(g.groupBy("_k").agg(F.sum("_t").alias("_n")), "_k")
    first = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
    aggs = [F.max("_n").alias("_n")]
    for name, p in ps.items():
        at = F.lit(p) * (F.col("_n") - 1)
        aggs += [first(F.ceil(F.lit(p) * F.col("_n")) - 1).alias(name)] if name in disc else [first(F.floor(at)).alias(f"{name}_lo"), first(F.ceil(at)).alias(f"{name}_hi")]
    out = (g.groupBy("_k") if by else g).agg(*aggs)
    part = lambda p: F.lit(p) * (F.col("_n") - 1) - F.floor(F.lit(p) * (F.col("_n") - 1))
    cols = [(F.col(n) if n in disc else F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * part(p)).alias(n) for n, p in ps.items()]
    return out.select(*([F.col("_k").alias(by)] if by else []), *cols)


def outlier_cutoffs(df: DataFrame, value: str) -> DataFrame:
    """Percentile 95, mean + 3 population deviations, and Q3 + 1.5 IQR."""
    q = quantiles(df, value, {"p95": 0.95, "q1": 0.25, "q3": 0.75})
    m = df.agg((F.avg(value) + 3 * F.stddev_pop(value)).alias("m"))
    return q.join(F.broadcast(m), F.lit(True)).select(F.round("p95", 6).alias("p95"), F.round("m", 6).alias("mean_3sd"), F.round(F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")), 6).alias("q3_iqr"))  # one row each
