"""Joins, set operations, ranking and grouping the engine inherits, over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats as S
from ..session import table


def priority_medians(spark, d):
    """Median and upper median (the element in the middle) of order totals by priority."""
    o = table(spark, d, "orders")
    q = S.quantiles(o, "o_totalprice", {"median": 0.5, "lower_median": 0.5}, by="o_orderpriority", disc=("lower_median",))
    return q.join(o.groupBy("o_orderpriority").agg(F.count("*").alias("n")), "o_orderpriority").select("o_orderpriority", F.round("median", 4).alias("median"), F.round("lower_median", 4).alias("lower_median"), "n")


def customers_without_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def customers_with_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def newest_orders(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, d, "orders").withColumn("n", F.row_number().over(w)).where("n <= 3").select("o_custkey", "n", "o_orderkey")


def revenue_by_nation(spark, d):
    """Star join with filters pushed to the scans; amounts are summed before names are looked up."""
    l = table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz '1995-01-01'").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))  # noqa: E741
    s = l.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.sum("rev").alias("rev"))
    n = s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("r_name", "n_name", F.round("rev", 2).alias("revenue"))


def line_summary(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")  # noqa: E741
    return l.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def grouping_sets(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return o.rollup("o_orderstatus", "y").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("int").alias("level"))


def pivot_flags(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count("l_orderkey")).fillna(0)


def set_difference(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    b = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return b.distinct().join(a, "k", "left_anti").unionByName(a.intersect(b).select((F.col("k") + 1000).alias("k")))


def multiset_overlap(spark, d):
    """Size of the overlap of two bags: the sum of the lesser counts."""
    p = table(spark, d, "part")
    a = p.where("p_size <= 25").groupBy("p_brand").agg(F.count("*").alias("a"))
    b = p.where("p_size > 25").groupBy("p_brand").agg(F.count("*").alias("b"))
    return a.join(b, "p_brand").agg(F.sum(F.least("a", "b")).alias("common"))


def price_correlation(spark, d):
    return S.correlations(table(spark, d, "part").select(F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r")), "s", "r")


def price_outliers(spark, d):
    return S.outlier_cutoffs(table(spark, d, "lineitem").select("l_extendedprice"), "l_extendedprice")


def union_with_gaps(spark, d):
    """Sources of unlike columns under one schema, missing columns null."""
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("balance"))
    p = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_name").alias("label"), F.col("p_size").alias("size"))
    return c.unionByName(p, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"), F.count("balance").alias("balances"), F.sum("size").alias("sizes"))


def pair_grid(spark, d):
    """Unordered pairs of the regions: a grid of a table of fixed size."""
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n"))
    later = r.agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("all"))
    one = later.select(F.explode("all").alias("a"), "all").select("a", F.explode(F.filter("all", lambda x: x["k"] > F.col("a.k"))).alias("b"))
    return one.select(F.col("a.n").alias("a"), F.col("b.n").alias("b"))


_FUNCS = (priority_medians, customers_without_orders, customers_with_orders, newest_orders, revenue_by_nation, line_summary, grouping_sets, pivot_flags, set_difference, multiset_overlap, price_correlation, price_outliers, union_with_gaps, pair_grid)
QUERIES = {f.__name__: f for f in _FUNCS}
SQL = {
    "priority_medians": "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median, round(quantile_disc(o_totalprice, 0.5), 4) AS lower_median, count(*) AS n FROM orders GROUP BY 1",
    "customers_without_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "customers_with_orders": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1",
    "newest_orders": "SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS n, o_orderkey FROM orders QUALIFY n <= 3",
    "revenue_by_nation": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2",
    "line_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "grouping_sets": "SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping(o_orderstatus, year(o_orderdate)) AS INTEGER) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, year(o_orderdate))",
    "pivot_flags": "SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS \"A\", count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1",
    "set_difference": "WITH a AS (SELECT DISTINCT s_nationkey AS k FROM supplier), b AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000) (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT k + 1000 FROM (SELECT k FROM a INTERSECT SELECT k FROM b)",
    "multiset_overlap": "SELECT CAST(sum(least(a, b)) AS BIGINT) AS common FROM (SELECT p_brand, count(*) AS a FROM part WHERE p_size <= 25 GROUP BY 1) JOIN (SELECT p_brand, count(*) AS b FROM part WHERE p_size > 25 GROUP BY 1) USING (p_brand)",
    "price_correlation": "WITH k AS (SELECT CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS ra, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS rb FROM part) SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM k",
    "price_outliers": "SELECT round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(avg(l_extendedprice) + 3 * stddev_pop(l_extendedprice), 6) AS mean_3sd, round(quantile_cont(l_extendedprice, 0.75) + 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)), 6) AS q3_iqr FROM lineitem",
    "union_with_gaps": "SELECT 'customer' AS kind, count(*) AS n, count(c_acctbal) AS balances, CAST(NULL AS BIGINT) AS sizes FROM customer UNION ALL SELECT 'part', count(*), 0, CAST(sum(p_size) AS BIGINT) FROM part",
    "pair_grid": "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey",
}
