"""Sources: folders of PDFs and JSON, a registry in SQLite, web pages, logs, feeds."""

from __future__ import annotations

import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

QUESTION = "qid string, question string, ideal_answer string, short_answer string, facts array<string>, answer_span string, keywords array<string>, paper string, source string, served_model string, complexity double"
LAYOUT = "source_pdf string, backend string, num_pages int, pdf_pages int, pages array<struct<page:int,width:double,height:double,regions:array<struct<label:string,conf:double,bbox:array<double>,lines:array<string>>>>>"


def pdf_files(spark: SparkSession, folder: str, least: int = 0) -> DataFrame:
    """stem, path, size and sha256 of the files that are PDFs by their first bytes; others (an HTML error page) are left out."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    magic = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    stem = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
    return f.where(magic & (F.col("length") > least)).select(stem.alias("stem"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, the same for a seed whatever the order or partitions of the input."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def json_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON document per file, with a fixed schema; stem is the file's name."""
    d = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(folder)
    return d.withColumn("stem", F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.json$", ""))


def sqlite_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a SQLite file, read by rowid ranges, a task each; every column comes as text, null stays null."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        names = [r[1] for r in con.execute(f'pragma table_info("{table}")')]
        lo, hi = con.execute(f'select min(rowid), max(rowid) from "{table}"').fetchone()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if lo is None:
        return spark.createDataFrame([], schema)
    step = 100_000
    cols = ", ".join(f'cast("{n}" as text)' for n in names)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for a in b.column(0).to_pylist():
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                    rows = con.execute(f'select {cols} from "{table}" where rowid >= ? and rowid < ?', (a, a + step)).fetchall()
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names)

    return spark.range(lo, hi + 1, step).mapInArrow(run, schema)


def page_text(html: Column, snippet: Column, most: int) -> Column:
    """Main text of a page, white space collapsed, cut at a word; the snippet where nothing is left."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    plain = text.norm(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"&nbsp;|&#160;", " "))
    return text.truncate_words(F.coalesce(F.nullif(plain, F.lit("")), snippet), most)


def url_stem(url: Column, disposition: Column, fallback: Column) -> Column:
    """File stem of a download: content-disposition, else the end of the URL, else the fallback; preprint ids are recognised."""
    named = F.regexp_extract(disposition, r'filename="?([^";]+)"?', 1)
    arxiv = F.regexp_extract(url, r"/(?:abs|pdf)/(\d{4}\.\d{4,5})(?:v\d+)?", 1)
    tail = F.regexp_extract(url, r"/([^/?#]+?)(?:\.pdf)?(?:[?#].*)?$", 1)
    pick = F.coalesce(F.nullif(arxiv, F.lit("")), F.nullif(F.regexp_replace(named, r"\.pdf$", ""), F.lit("")), F.nullif(tail, F.lit("")), fallback)
    return text.sanitize_filename(F.regexp_replace(pick, r"\.", "_"))


def new_feed_items(feed: DataFrame, known: DataFrame, since: DataFrame, most: int) -> DataFrame:
    """Feed rows (domain, stem, published_at) after the domain's checkpoint, not known yet, the newest ``most`` per domain."""
    from pyspark.sql import Window

    f = feed.join(since.select("domain", F.col("published_at").alias("cutoff")), "domain", "left").where(F.col("cutoff").isNull() | (F.col("published_at") >= F.col("cutoff")))
    f = f.join(known.select("stem"), "stem", "left_anti")
    w = Window.partitionBy("domain").orderBy(F.desc("published_at"), "stem")
    return f.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n", "cutoff")


def log_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as they are appended to the log files of a folder."""
    return spark.readStream.format("text").option("wholetext", "false").load(folder).withColumnRenamed("value", "line")
