"""Page layout: words to regions and lines, reading order, column splits, box matching.

Boxes are x0, y0, x1, y1 in points from the top left. All joins and windows are
within a page (doc, page), so nothing grows beyond a page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc", "page"]
FURNITURE = ("Page-header", "Page-footer")
SWALLOW = ("Picture",)
SPLITTABLE = ("Text", "Authors", "List-item", "Caption", "Footnote")
WIDE, SINGLE_SHARE = 0.6, 0.7
BOX = "x0 double, y0 double, x1 double, y1 double"


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes in columns a_x0.. and b_x0.."""
    c = lambda p, k: F.col(f"{p}_{k}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    area = lambda p: (c(p, "x1") - c(p, "x0")) * (c(p, "y1") - c(p, "y0"))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def assign_words(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Each word (doc, page, word_ix, box, text, block_no) with its region: the smallest that holds its centre.

    Columns added: region_ix, label, swallowed. A word in no region goes to a fallback
    region of its text block (region_ix null, label Text); a word whose smallest
    region swallows text (a picture) is marked swallowed.
    """
    r = regions.select(*PAGE, "region_ix", "label", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")]).withColumn("area", (F.col("r_x1") - F.col("r_x0")) * (F.col("r_y1") - F.col("r_y0")))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(F.col("r_x0"), F.col("r_x1")) & cy.between(F.col("r_y0"), F.col("r_y1"))
    hits = words.join(r, PAGE).where(inside).groupBy(*PAGE, "word_ix").agg(F.min(F.struct("area", "region_ix", "label")).alias("m"))
    out = words.join(hits.select(*PAGE, "word_ix", "m.region_ix", "m.label"), [*PAGE, "word_ix"], "left")
    return out.withColumn("swallowed", F.coalesce(F.col("label").isin(*SWALLOW), F.lit(False))).withColumn("label", F.coalesce("label", F.lit("Text"))).withColumn("fallback", F.col("region_ix").isNull())


def lines(words: DataFrame, key: list[str]) -> DataFrame:
    """Lines of words within ``key``: a new line begins where the centre lies more than 0.6 of the median height below the one before."""
    cy = (F.col("y0") + F.col("y1")) / 2
    h = words.groupBy(*key).agg(F.median(F.col("y1") - F.col("y0")).alias("h"))
    w = Window.partitionBy(*key).orderBy("cy", "x0")
    t = words.join(h, key).withColumn("cy", cy).withColumn("new", F.coalesce((F.col("cy") - F.lag("cy").over(w)) > 0.6 * F.col("h"), F.lit(True)).cast("int"))
    t = t.withColumn("line_ix", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    g = t.groupBy(*key, "line_ix").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("ws"))
    return g.select(*key, "line_ix", F.array_join(F.col("ws.text"), " ").alias("text"))


def reading_order(regions: DataFrame) -> DataFrame:
    """Regions (doc, page, region_ix, label, box, page_w, has_text) with their place in reading order, headers and footers left out.

    A page whose text regions are mostly wide is one column. Else wide regions and
    authors separate bands; within a band the left column goes before the right.
    Separators that overlap vertically go from left to right.
    """
    r = regions.where(~F.col("label").isin(*FURNITURE)).withColumn("wide", (F.col("x1") - F.col("x0")) > WIDE * F.col("page_w"))
    page = Window.partitionBy(*PAGE)
    texts = F.sum(F.when(F.col("has_text"), 1)).over(page)
    r = r.withColumn("single", F.coalesce(F.sum(F.when(F.col("has_text") & F.col("wide"), 1)).over(page) >= SINGLE_SHARE * texts, F.lit(False)))
    r = r.withColumn("sep", ~F.col("single") & (F.col("wide") | (F.col("label") == "Authors")))
    down = Window.partitionBy(*PAGE).orderBy("y0", "x0", "region_ix")
    seps = Window.partitionBy(*PAGE, "sep").orderBy("y0", "x0", "region_ix")
    # a run of separators that overlap vertically shares one place
    r = r.withColumn("run_new", (F.col("sep") & F.coalesce(F.col("y0") >= F.max("y1").over(seps.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))).cast("int"))
    r = r.withColumn("band", F.when(F.col("single"), 0).otherwise(F.sum("run_new").over(down.rowsBetween(Window.unboundedPreceding, 0))))
    right = ((F.col("x0") + F.col("x1")) / 2 > F.col("page_w") / 2).cast("int")
    key = F.when(F.col("single"), F.struct(F.lit(0.0).alias("b"), F.lit(0).alias("s"), F.col("y0").alias("p"), F.col("x0").alias("q"))).when(F.col("sep"), F.struct(F.col("band").cast("double").alias("b"), F.lit(0).alias("s"), F.lit(0.0).alias("p"), F.col("x0").alias("q"))).otherwise(F.struct(F.col("band").cast("double").alias("b"), (right + 1).alias("s"), F.col("y0").alias("p"), F.col("x0").alias("q")))
    out = r.withColumn("order", F.row_number().over(Window.partitionBy(*PAGE).orderBy(key, "region_ix")) - 1)
    return out.drop("wide", "single", "sep", "run_new", "band")


def split_columns(rows: list[tuple[float, float, float, float, str]], x0: float, x1: float, page_w: float, label: str, min_gap: float | None = None) -> list[list[tuple]]:
    """The words of a wide region, by column; one list if there is no clear gutter.

    A gutter is at least a line high in width, crossed by no word, with words on both
    sides in three rows or more; every column takes at least 15 % of the region.
    """
    if label not in SPLITTABLE or x1 - x0 < page_w / 2 or len(rows) < 6:
        return [rows]
    heights = sorted(b[3] - b[1] for b in rows)
    line = heights[len(heights) // 2]
    gap = min_gap if min_gap is not None else line
    spans: list[list[float]] = []
    for a, b in sorted((r[0], r[2]) for r in rows):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    cuts = []
    for left, right in zip(spans, spans[1:]):
        if right[0] - left[1] < gap:
            continue
        mid = (left[1] + right[0]) / 2
        by_row: dict[int, set[bool]] = {}
        for r in rows:
            by_row.setdefault(round((r[1] + r[3]) / 2 / max(line, 1e-6)), set()).add((r[0] + r[2]) / 2 > mid)
        if sum(len(s) == 2 for s in by_row.values()) >= 3:
            cuts.append(mid)
    edges = [x0, *cuts, x1]
    if not cuts or any(b - a < 0.15 * (x1 - x0) for a, b in zip(edges, edges[1:])):
        return [rows]
    return [[r for r in rows if a <= (r[0] + r[2]) / 2 < b or (b == x1 and (r[0] + r[2]) / 2 >= a)] for a, b in zip(edges, edges[1:])]


def match_boxes(reference: DataFrame, candidate: DataFrame, on: str = "text", least: float = 0.5) -> DataFrame:
    """One-to-one matches of boxes with equal ``on`` on a page: each reference in order takes the free candidate of best IoU above ``least``."""
    a = reference.select(*PAGE, F.col("ix").alias("a_ix"), F.col(on).alias("key"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    b = candidate.select(*PAGE, F.col("ix").alias("b_ix"), F.col(on).alias("key"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = a.join(b, [*PAGE, "key"]).withColumn("iou", iou("a", "b")).where(F.col("iou") > least).select(*PAGE, "a_ix", "b_ix", "iou")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        keep = []
        for _, g in pdf.sort_values(["a_ix", "iou", "b_ix"], ascending=[True, False, True]).groupby("a_ix", sort=True):
            for row in g.itertuples(index=False):
                if row.b_ix not in used:
                    used.add(row.b_ix)
                    keep.append(row)
                    break
        return pd.DataFrame(keep, columns=pdf.columns)

    return pairs.groupBy(*PAGE).applyInPandas(take, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def column_count(words: DataFrame) -> DataFrame:
    """1 or 2 columns per page: two if under 1 % of the words cross the middle; the mode over pages is the paper's."""
    mid = F.col("page_w") / 2
    per = words.groupBy(*PAGE).agg(F.when(F.avg(((F.col("x0") < mid) & (mid < F.col("x1"))).cast("double")) < 0.01, 2).otherwise(1).alias("columns"))
    n = per.groupBy("doc", "columns").agg(F.count("*").alias("n"))
    return n.groupBy("doc").agg(F.max(F.struct("n", (-F.col("columns")).alias("c"))).alias("m")).select("doc", (-F.col("m.c")).alias("columns"))
