"""Document blocks: building, carrying sections, merging paragraphs, rendering, auditing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import order as O

TYPES = ("title", "authors", "section", "paragraph", "list", "caption", "table", "formula", "footnote")


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """One row per (stem, block_ix), types in lower case; rows without a key are left out."""
    b = blocks.where("stem is not null and block_ix is not null")
    least = F.min(F.struct("type", "page", "text")).alias("b")
    return b.groupBy("stem", "block_ix").agg(least).select("stem", "block_ix", F.lower("b.type").alias("type"), "b.page", "b.text")


def said(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) > 0


def carry(b: DataFrame) -> DataFrame:
    """Each block with its paper's title (else the stem) and the section it stands in."""
    titles = b.where((F.col("type") == "title") & said(F.col("text"))).groupBy("stem").agg(F.min(F.struct("block_ix", "text")).alias("t")).select("stem", F.trim("t.text").alias("title"))
    b = O.latest(O.parts(b, "stem", "block_ix"), "stem", "block_ix", "section", F.when(F.col("type") == "section", F.trim("text"))).drop(O.PART)
    return b.join(titles, "stem", "left").withColumn("title", F.coalesce("title", "stem"))


def merge_paragraphs(b: DataFrame) -> DataFrame:
    """Paragraphs put together again: a paragraph that does not end a sentence goes on in the next one.

    Captions, tables, formulas and footnotes in between do not close it; titles,
    sections, authors and lists do. One open paragraph per paper, so whether one
    goes on depends on the wall or paragraph before it alone: no state machine. A
    paper of any length is split (``order``).
    """
    wall = F.col("type").isin("title", "section", "authors", "list")
    p = O.parts(b.where(said(F.col("text")) & (wall | (F.col("type") == "paragraph"))), "stem", "block_ix")
    p = O.before(p, "stem", "block_ix", "closed", wall | T.ends_terminally(F.col("text")))
    p = O.running(p, "stem", "block_ix", "para", (~wall & F.coalesce("closed", F.lit(True))).cast("int")).where("type = 'paragraph'")
    parts = F.array_sort(F.collect_list(F.struct("block_ix", "page", F.trim("text").alias("text")))).alias("parts")
    g = p.groupBy("stem", "para").agg(parts)
    return g.select("stem", F.col("parts")[0]["block_ix"].alias("block_ix"), F.col("parts")[0]["page"].alias("page"), F.size("parts").alias("n_parts"), F.array_join(F.col("parts.text"), " ").alias("text"))


def rendered(c: Column, kind: Column) -> Column:
    wrap = lambda a, z="": F.concat(F.lit(a), c, F.lit(z))
    return F.when(kind == "title", wrap("# ")).when(kind == "section", wrap("## ")).when(kind == "authors", wrap("[AUTHORS] ")).when(kind == "caption", wrap("[CAPTION] ")).when(kind == "table", wrap("[TABLE]\n", "\n[/TABLE]")).when(kind == "formula", wrap("[FORMULA] ")).when(kind == "footnote", wrap("[FOOTNOTE] ")).otherwise(c)


def joined(b: DataFrame, line: Column, sep: str = "\n\n") -> DataFrame:
    """The texts of a paper in block order, joined (a paper's text is one value, as in any document table)."""
    g = b.where(said(F.col("text"))).groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("block_ix", line.alias("t")))).alias("p"))
    return g.select("stem", F.array_join(F.col("p.t"), sep).alias("text"))


def raw_pages(b: DataFrame) -> DataFrame:
    """The pages of a paper as one text each: blocks of a page in order, blank ones left out."""
    g = b.where(said(F.col("text")) & F.col("page").isNotNull()).groupBy("stem", "page").agg(F.array_sort(F.collect_list(F.struct("block_ix", F.trim("text").alias("t")))).alias("p"))
    return g.select("stem", "page", F.array_join(F.col("p.t"), "\n").alias("text"))


def coverage(b: DataFrame) -> DataFrame:
    """Per paper: blocks, characters, pages seen and real pages, and what is wrong with it."""
    g = b.groupBy("stem").agg(F.count_if(said(F.col("text"))).alias("blocks"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.count_distinct("page").alias("pages"), (F.max("page") + 1).alias("last_page"))
    wrong = F.array_compact(F.array(F.when(F.col("pages") < F.col("last_page"), "pages missing"), F.when(F.col("blocks") < 3, "few blocks"), F.when(F.col("chars") < 200 * F.col("pages"), "little text")))
    return g.withColumn("problems", F.array_join(wrong, "; "))


def markdown_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Markdown lines as typed blocks: headings are sections, runs of | rows tables, other runs paragraphs; a blank line closes a run.

    Lines are numbered before they part, so order never depends on partitions.
    """
    lines = docs.where("text is not null").select(key, F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    kind = F.when(F.col("line").rlike(r"^#{1,6}\s+\S"), "section").when(F.col("line").rlike(r"^\s*\|"), "table").when(F.trim("line") == "", "blank").otherwise("paragraph")
    w = Window.partitionBy(key).orderBy("ln")
    lines = lines.withColumn("type", kind).withColumn("was", F.lag("type").over(w))
    new = (F.col("type") == "section") | F.col("was").isNull() | (F.col("was") != F.col("type"))
    runs = lines.withColumn("run", F.sum(new.cast("int")).over(w)).where("type <> 'blank'")
    g = runs.groupBy(key, "run", "type").agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("p"))
    body = F.array_join(F.transform("p.line", lambda x: F.trim(x)), "\n")
    text = F.when(F.col("type") == "section", F.trim(F.regexp_replace(F.col("p")[0]["line"], r"^#{1,6}\s+", ""))).when(F.col("type") == "table", body).otherwise(F.array_join(F.transform("p.line", lambda x: F.trim(x)), " "))
    order = Window.partitionBy(key).orderBy("run")
    return g.select(key, (F.row_number().over(order) - 1).alias("block_ix"), "type", text.alias("text"))


def caption_pairs(b: DataFrame) -> DataFrame:
    """Captions of tables with the table right before or after them."""
    here = F.struct(F.col("type").alias("type"), F.col("block_ix").alias("ix"))
    n = O.parts(b, "stem", "block_ix")
    n = O.after(O.before(n, "stem", "block_ix", "prev", here), "stem", "block_ix", "next", here)
    c = n.where("type = 'caption'").withColumn("table_ix", F.when(F.col("next.type") == "table", F.col("next.ix")).when(F.col("prev.type") == "table", F.col("prev.ix")))
    return c.select("stem", "block_ix", "table_ix", F.coalesce(F.col("text").rlike(r"(?i)^\s*table\s+\d+"), F.lit(False)).alias("names_table"))


def list_groups(b: DataFrame) -> DataFrame:
    """Runs of list items right after each other as one block: any other block with text closes a run. stem, block_ix (of the first), n_items, text."""
    p = O.parts(b.where(said(F.col("text"))), "stem", "block_ix")
    item = F.coalesce(F.col("type") == "list", F.lit(False))
    p = O.before(p, "stem", "block_ix", "was", item)
    p = O.running(p, "stem", "block_ix", "run", (item & ~F.coalesce("was", F.lit(False))).cast("int")).where(item)
    g = p.groupBy("stem", "run").agg(F.array_sort(F.collect_list(F.struct("block_ix", F.trim("text").alias("text")))).alias("parts"))
    return g.select("stem", F.col("parts")[0]["block_ix"].alias("block_ix"), F.size("parts").cast("bigint").alias("n_items"), F.array_join(F.col("parts.text"), "\n").alias("text"))


def table_signature(c: Column) -> Column:
    """Three to eight distinctive cells of a table: at least six characters, not numeric, cut to 40; null if there are fewer than three."""
    cells = F.transform(F.split(c, r"[|\n\t]+"), lambda x: F.trim(x))
    keep = F.filter(cells, lambda x: (F.length(x) >= 6) & ~x.rlike(r"^[\d.,%±()\s-]+$"))
    sig = F.slice(F.array_distinct(F.transform(keep, lambda x: F.substring(x, 1, 40))), 1, 8)
    return F.when(F.size(sig) >= 3, sig)
