"""Queries over documents and their blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import chunkers as C
from ..operators import stats as S
from ..session import table


def blocks(spark, d):
    return B.distinct_blocks(table(spark, d, "blocks"))


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def block_type_counts(spark, d):
    return blocks(spark, d).groupBy("stem").pivot("type", list(B.TYPES)).count().fillna(0)


def section_carry_forward(spark, d):
    return B.carry(blocks(spark, d)).where("type = 'paragraph'").select("stem", "block_ix", "title", "section")


def title_fallback(spark, d):
    c = B.carry(blocks(spark, d)).groupBy("stem").agg(F.max((F.col("title") == F.col("stem")).cast("double")).alias("x"))
    return c.agg(F.round(F.avg("x"), 6).alias("share"), F.count("*").alias("papers"))


def paragraph_merge(spark, d):
    return B.merge_paragraphs(blocks(spark, d)).select("stem", "block_ix", "page", "n_parts", "text")


def render_text(spark, d):
    b = blocks(spark, d)
    return B.joined(b, B.rendered(F.trim("text"), F.col("type"))).select("stem", F.concat("text", F.lit("\n")).alias("text"))


def flat_text(spark, d):
    return B.joined(blocks(spark, d), T.fence(F.trim("text"), F.col("type")))


def raw_pages(spark, d):
    return B.raw_pages(blocks(spark, d))


def coverage_audit(spark, d):
    return B.coverage(blocks(spark, d))


def coverage_summary(spark, d):
    return B.coverage(blocks(spark, d)).agg(F.count("*").alias("checked"), F.count_if(F.col("problems") != "").alias("affected"), F.sum("chars").alias("chars"))


def embeddable_blocks(spark, d):
    letters = F.col("text").rlike(r"[A-Za-z]") & (F.length(F.trim("text")) >= 10)
    keep = B.said(F.col("text")) & ~F.coalesce(F.col("type").isin("authors", "footnote"), F.lit(False)) & ((F.coalesce("type", F.lit("paragraph")) != "formula") | letters)
    return blocks(spark, d).where(keep).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def parser_quality(spark, d):
    p = blocks(spark, d).where((F.col("type") == "paragraph") & (F.length(F.trim("text")) > 40))
    low = F.count_if(F.trim("text").rlike(r"^[a-z]"))
    return p.groupBy("stem").agg(F.count("*").alias("paragraphs"), low.alias("lower_starts"), F.round(low / F.count("*"), 6).alias("share"))


def table_captions(spark, d):
    return B.caption_pairs(blocks(spark, d))


def table_signatures(spark, d):
    return blocks(spark, d).where("type = 'table' and text is not null").select("stem", "block_ix", B.table_signature(F.col("text")).alias("cells"))


def corpus_totals(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.count("text").alias("texts"), F.sum(F.octet_length("text")).alias("bytes"), F.max(F.length("text")).alias("longest"))
    return g


def corpus_by_month(spark, d):
    return table(spark, d, "documents").groupBy("source", F.date_format("added_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def label_distribution(spark, d):
    return blocks(spark, d).groupBy("type").agg(F.count("*").alias("n"))


def column_mode(spark, d):
    """The most frequent page number of each block type (least of equals)."""
    n = blocks(spark, d).where("page is not null and type is not null").groupBy("type", "page").agg(F.count("*").alias("n"))
    return n.groupBy("type").agg(F.max(F.struct("n", (-F.col("page")).alias("p"))).alias("m")).select("type", (-F.col("m.p")).alias("page"), "m.n")


def markdown_blocks(spark, d):
    return B.markdown_blocks(docs(spark, d)).select("doc_id", "block_ix", "type", "text")


def chunks_fixed_token(spark, d):
    return C.fixed_token(docs(spark, d))


def chunks_recursive_char(spark, d):
    return C.recursive_char(docs(spark, d))


def chunks_semantic(spark, d):
    return C.semantic(docs(spark, d))


def chunks_grain_growth(spark, d):
    return C.grain_growth(blocks(spark, d))


def chunk_shape(spark, d):
    return C.shape(C.fixed_token(docs(spark, d)))


def chunk_overlap(spark, d):
    o = C.overlaps(C.recursive_char(docs(spark, d)))
    one = o.agg(F.round(F.avg((F.col("overlap") == 0).cast("double")), 6).alias("none"), F.max("overlap").alias("most"))
    return one.join(F.broadcast(S.quantiles(o.where("overlap > 0"), "overlap", {"median": 0.5})), F.lit(True))  # one row each


def normalized_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.norm(F.col("text"), True)).alias("md5"))


def truncated_text(spark, d):
    return docs(spark, d).select("doc_id", T.truncate_words(T.norm(F.col("text")), 200).alias("text"))


def text_keys(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.text_key("text")).alias("key"))


def sentence_counts(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.size(T.split_sentences("text")).alias("sentences"))


def size_outliers(spark, d):
    from ..operators import stats as S

    return S.outlier_cutoffs(docs(spark, d).where("text is not null").select(F.length("text").cast("double").alias("n")), "n")


_FUNCS = (block_type_counts, section_carry_forward, title_fallback, paragraph_merge, render_text, flat_text, raw_pages, coverage_audit, coverage_summary, embeddable_blocks, parser_quality, table_captions, table_signatures, corpus_totals, corpus_by_month, label_distribution, column_mode, markdown_blocks, chunks_fixed_token, chunks_recursive_char, chunks_semantic, chunks_grain_growth, chunk_shape, chunk_overlap, normalized_text, truncated_text, text_keys, sentence_counts, size_outliers)
QUERIES = {f.__name__: f for f in _FUNCS}

_B = "b AS (SELECT stem, block_ix, lower(type) AS type, page, text FROM blocks WHERE stem IS NOT NULL AND block_ix IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stem, block_ix) = 1)"
_SAID = "trim(coalesce(text, '')) <> ''"
_CARRY = f"{_B}, c AS (SELECT b.*, last_value(CASE WHEN type = 'section' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY stem ORDER BY block_ix) AS section FROM b), tt AS (SELECT stem, arg_min(trim(text), block_ix) AS title FROM b WHERE type = 'title' AND {_SAID} GROUP BY 1), k AS (SELECT c.*, coalesce(tt.title, c.stem) AS title FROM c LEFT JOIN tt USING (stem))"
_COV = f"{_B}, g AS (SELECT stem, count(*) FILTER ({_SAID}) AS blocks, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, count(DISTINCT page) AS pages, max(page) + 1 AS last_page FROM b GROUP BY 1), cv AS (SELECT *, array_to_string(list_filter([CASE WHEN pages < last_page THEN 'pages missing' END, CASE WHEN blocks < 3 THEN 'few blocks' END, CASE WHEN chars < 200 * pages THEN 'little text' END], lambda x: x IS NOT NULL), '; ') AS problems FROM g)"
_TERM = "coalesce(regexp_matches(rtrim({}), '[.!?][\"''”’)\\]]*$'), false)"
_WORDS = r"list_filter(string_split(trim(regexp_replace(lower(translate(text, 'İΣ', 'Iσ')), '[\s\p{Z}]+', ' ', 'g')), ' '), lambda x: x <> '')"
_FIX = f"w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 256) / 224.0)) AS BIGINT) + 1)) AS k FROM w WHERE len(w) > 0), fx AS (SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, array_to_string(list_slice(w, k * 224 + 1, k * 224 + 256), ' ') AS text FROM f)"

SQL = {
    "block_type_counts": f"WITH {_B} SELECT stem, " + ", ".join(f"count(*) FILTER (type = '{t}') AS \"{t}\"" for t in B.TYPES) + " FROM b GROUP BY stem",
    "section_carry_forward": f"WITH {_CARRY} SELECT stem, block_ix, title, section FROM k WHERE type = 'paragraph'",
    "title_fallback": f"WITH {_CARRY}, s AS (SELECT stem, max(CAST(title = stem AS DOUBLE)) AS x FROM k GROUP BY 1) SELECT round(avg(x), 6) AS share, count(*) AS papers FROM s",
    "paragraph_merge": f"WITH {_B}, p0 AS (SELECT *, coalesce(sum(CAST(type IN ('title', 'section', 'authors', 'list') AS INTEGER)) OVER (PARTITION BY stem ORDER BY block_ix), 0) AS wall FROM b WHERE {_SAID}), p1 AS (SELECT *, lag(text) OVER (PARTITION BY stem, wall ORDER BY block_ix) AS was FROM p0 WHERE type = 'paragraph'), p2 AS (SELECT *, sum(CASE WHEN was IS NULL OR {_TERM.format('was')} THEN 1 ELSE 0 END) OVER (PARTITION BY stem, wall ORDER BY block_ix) AS para FROM p1) SELECT stem, min(block_ix) AS block_ix, arg_min(page, block_ix) AS page, CAST(count(*) AS INTEGER) AS n_parts, string_agg(trim(text), ' ' ORDER BY block_ix) AS text FROM p2 GROUP BY stem, wall, para",
    "render_text": f"WITH {_B} SELECT stem, string_agg(CASE type WHEN 'title' THEN '# ' || trim(text) WHEN 'section' THEN '## ' || trim(text) WHEN 'authors' THEN '[AUTHORS] ' || trim(text) WHEN 'caption' THEN '[CAPTION] ' || trim(text) WHEN 'table' THEN '[TABLE]' || chr(10) || trim(text) || chr(10) || '[/TABLE]' WHEN 'formula' THEN '[FORMULA] ' || trim(text) WHEN 'footnote' THEN '[FOOTNOTE] ' || trim(text) ELSE trim(text) END, chr(10) || chr(10) ORDER BY block_ix) || chr(10) AS text FROM b WHERE {_SAID} GROUP BY stem",
    "flat_text": f"WITH {_B} SELECT stem, string_agg(CASE WHEN type IN ('table', 'formula') THEN '~~~' || type || chr(10) || trim(text) || chr(10) || '~~~' ELSE trim(text) END, chr(10) || chr(10) ORDER BY block_ix) AS text FROM b WHERE {_SAID} GROUP BY stem",
    "raw_pages": f"WITH {_B} SELECT stem, page, string_agg(trim(text), chr(10) ORDER BY block_ix) AS text FROM b WHERE {_SAID} AND page IS NOT NULL GROUP BY stem, page",
    "coverage_audit": f"WITH {_COV} SELECT * FROM cv",
    "coverage_summary": f"WITH {_COV} SELECT count(*) AS checked, count(*) FILTER (problems <> '') AS affected, CAST(sum(chars) AS BIGINT) AS chars FROM cv",
    "embeddable_blocks": f"WITH {_B} SELECT type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM b WHERE {_SAID} AND coalesce(type, 'paragraph') NOT IN ('authors', 'footnote') AND (coalesce(type, 'paragraph') <> 'formula' OR (regexp_matches(text, '[A-Za-z]') AND length(trim(text)) >= 10)) GROUP BY type",
    "parser_quality": f"WITH {_B} SELECT stem, count(*) AS paragraphs, count(*) FILTER (regexp_matches(trim(text), '^[a-z]')) AS lower_starts, round(count(*) FILTER (regexp_matches(trim(text), '^[a-z]')) / count(*), 6) AS share FROM b WHERE type = 'paragraph' AND length(trim(text)) > 40 GROUP BY stem",
    "table_captions": f"WITH {_B}, n AS (SELECT *, lag(type) OVER w AS pt, lag(block_ix) OVER w AS pi, lead(type) OVER w AS nt, lead(block_ix) OVER w AS ni FROM b WINDOW w AS (PARTITION BY stem ORDER BY block_ix)) SELECT stem, block_ix, CASE WHEN nt = 'table' THEN ni WHEN pt = 'table' THEN pi END AS table_ix, coalesce(regexp_matches(text, '(?i)^\\s*table\\s+\\d+'), false) AS names_table FROM n WHERE type = 'caption'",
    "corpus_totals": "SELECT source, count(*) AS docs, count(text) AS texts, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(max(length(text)) AS INTEGER) AS longest FROM documents GROUP BY source",
    "corpus_by_month": "SELECT source, strftime(added_at, '%Y-%m') AS month, count(*) AS n FROM documents GROUP BY ALL",
    "label_distribution": f"WITH {_B} SELECT type, count(*) AS n FROM b GROUP BY type",
    "column_mode": f"WITH {_B}, n AS (SELECT type, page, count(*) AS n FROM b WHERE page IS NOT NULL AND type IS NOT NULL GROUP BY ALL) SELECT type, page, n FROM n QUALIFY row_number() OVER (PARTITION BY type ORDER BY n DESC, page) = 1",
    "chunks_fixed_token": f"WITH {_FIX} SELECT * FROM fx",
    "chunk_shape": f"WITH {_FIX} SELECT count(*) AS chunks, round(avg(length(text)), 4) AS mean, median(length(text)) AS median, CAST(min(length(text)) AS INTEGER) AS least, CAST(max(length(text)) AS INTEGER) AS most, round(avg(CAST(regexp_matches(ltrim(text), '^[a-z,;)\\]]') AS DOUBLE)), 6) AS mid_start, round(avg(CAST(NOT {_TERM.format('text')} AS DOUBLE)), 6) AS mid_end FROM fx",
    "size_outliers": "WITH n AS (SELECT CAST(length(text) AS DOUBLE) AS n FROM documents WHERE text IS NOT NULL) SELECT round(quantile_cont(n, 0.95), 6) AS p95, round(avg(n) + 3 * stddev_pop(n), 6) AS mean_3sd, round(quantile_cont(n, 0.75) + 1.5 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25)), 6) AS q3_iqr FROM n",
    "normalized_text": r"SELECT doc_id, md5(lower(trim(regexp_replace(translate(text, 'İΣ', 'Iσ'), '[\s\p{Z}]+', ' ', 'g')))) AS md5 FROM documents",
    "truncated_text": r"WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(substring(t, 1, 200), ' [^ ]*$', '') || ' …' END AS text FROM t",
    "table_signatures": f"WITH {_B}, t AS (SELECT stem, block_ix, list_slice(list_distinct_ordered, 1, 8) AS cells FROM (SELECT stem, block_ix, list_filter(kept, lambda x, i: list_position(kept, x) = i) AS list_distinct_ordered FROM (SELECT stem, block_ix, list_transform(list_filter(list_transform(string_split_regex(text, '[|\\n\\t]+'), lambda x: trim(x)), lambda x: length(x) >= 6 AND NOT regexp_matches(x, '^[\\d.,%±()\\s-]+$')), lambda x: substring(x, 1, 40)) AS kept FROM b WHERE type = 'table' AND text IS NOT NULL))) SELECT stem, block_ix, CASE WHEN len(cells) >= 3 THEN cells END AS cells FROM t",
    "markdown_blocks": r"""WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, generate_subscripts(ls, 1) AS ln, unnest(ls) AS line FROM l0),
      k AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}[ \t\r\f\v]+[^\s]') THEN 'section' WHEN regexp_matches(line, '^\s*\|') THEN 'table' WHEN trim(line, ' ') = '' THEN 'blank' ELSE 'paragraph' END AS type FROM l),
      r AS (SELECT *, sum(CASE WHEN type = 'section' OR was IS NULL OR was <> type THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS run FROM (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY ln) AS was FROM k)),
      g AS (SELECT doc_id, run, type, string_agg(trim(line, ' '), chr(10) ORDER BY ln) AS body, string_agg(trim(line, ' '), ' ' ORDER BY ln) AS flow, arg_min(line, ln) AS head FROM r WHERE type <> 'blank' GROUP BY ALL)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INTEGER) AS block_ix, type, CASE type WHEN 'section' THEN trim(regexp_replace(head, '^#{1,6}\s+', ''), ' ') WHEN 'table' THEN body ELSE flow END AS text FROM g""".replace("\\\\", "\\"),
}
