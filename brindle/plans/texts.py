"""Queries on texts and their chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.files import checksum, extension, file_name, masked_key, safe_name
from brindle.functions.text import clean_text, word_count
from brindle.operators.chunking import count_windows, fixed_size_chunks, running_spans, token_chunks, word_chunks
from brindle.sources.html import parse_html, plain_text
from brindle.sources.tables import table

WS = r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _chunks(spark, d, size, overlap):
    c = fixed_size_chunks(table(spark, d, "documents"), "doc_id", "text", size, overlap)
    return c.select(F.col("id").alias("doc_id"), "chunk_index", "chunk_id", "text", F.col("char_count").cast("bigint").alias("char_count"), F.col("span_start").cast("bigint").alias("span_start"), F.col("span_end").cast("bigint").alias("span_end"))


def chunk_fixed_size(spark, d):
    return _chunks(spark, d, 1000, 100)


def chunk_fixed_no_overlap(spark, d):
    return _chunks(spark, d, 500, 0)


def chunk_fixed_small(spark, d):
    return _chunks(spark, d, 64, 16)


def chunk_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", count_windows(F.length("text"), 1000, 100).alias("n_chunks"))


def chunk_totals(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    c = _chunks(spark, d, 1000, 100).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("char_count").alias("chars"))
    return docs.join(c, "doc_id", "left").groupBy("source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("chars"), F.lit(0)).alias("n_chars"))


def chunk_overlap_check(spark, d):
    from pyspark.sql import Window as W

    c = _chunks(spark, d, 1000, 100).select("doc_id", "chunk_index", "span_end", "span_start")
    nxt = F.lead("span_start").over(W.partitionBy("doc_id").orderBy("chunk_index"))
    return c.withColumn("shared", F.col("span_end") - nxt).filter("shared is not null").select("doc_id", "chunk_index", "shared")


def chunk_words(spark, d):
    c = word_chunks(table(spark, d, "documents"), "doc_id", "text", 50, 10)
    return c.select(F.col("id").alias("doc_id"), "chunk_index", "text", "token_count")


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def chunk_tokens(spark, d):
    c = token_chunks(table(spark, d, "documents"), "doc_id", "text", VOCABULARY, 128, 16)
    return c.select(F.col("id").alias("doc_id"), "chunk_index", "text", "token_count", "span_start", "span_end")


def clean_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", clean_text("text").alias("text"))


def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", word_count("text").alias("n_words"))


def text_spans(spark, d):
    rows = table(spark, d, "parsed_chunks").filter("chunk_id is not null").dropDuplicates(["chunk_id"]).select("source", "ordinal", "chunk_id", "text")
    out = running_spans(rows, "source", ["ordinal", "chunk_id"], "text")
    return out.select("chunk_id", F.col("span_from").cast("bigint").alias("span_from"), F.col("span_to").cast("bigint").alias("span_to"))


def file_names(spark, d):
    rows = table(spark, d, "parsed_chunks").filter("source is not null").select("source").distinct()
    name = file_name(F.col("source"), F.lit(1))
    return rows.select("source", extension(F.col("source")).alias("ext"), safe_name(F.substring_index("source", "/", -1)).alias("safe_name"), name.alias("name"))


def checksums(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", checksum(F.col("text")).alias("sha256"), F.octet_length("text").cast("bigint").alias("n_bytes"))


def masked_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", masked_key(F.col("user_id")).alias("masked"))


HEAD = '<html><head><meta name="author" content="The writer"><meta property="og:type" content="article"></head><nav>skip</nav><script>no()</script>'


def _markup(spark, d):
    """Pages put together from all their parsed elements with text, as an HTML source would give them."""
    rows = table(spark, d, "parsed_chunks").filter("metadata['parser'] = 'html' and text is not null").dropDuplicates(["chunk_id"])
    meta, escaped = lambda k: F.col("metadata")[k], lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    tag = F.when(meta("type") == "title", "title").when(meta("type") == "heading", F.concat(F.lit("h"), F.coalesce(meta("level"), F.lit("2")))).when(meta("type") == "link", "a").otherwise("p")
    href = F.when((tag == "a") & meta("href").isNotNull(), F.concat(F.lit(' href="'), escaped(meta("href")), F.lit('"'))).otherwise("")
    part = F.struct("ordinal", "chunk_id", F.concat(F.lit("<"), tag, href, F.lit(">"), escaped(F.col("text")), F.lit("</"), tag, F.lit(">\n")).alias("html"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["html"]), "")
    return rows.filter("source is not null").groupBy("source").agg(F.concat(F.lit(HEAD), body, F.lit("</html>")).alias("html"))


def html_elements(spark, d):
    return parse_html(_markup(spark, d), "source", "html").select(F.col("id").alias("source"), "ordinal", "type", "level", "href", "text", "span_start", "span_end")


def html_plaintext(spark, d):
    text = F.udf(plain_text, "string", useArrow=True)
    return _markup(spark, d).select("source", text("html").alias("text"))


QUERIES = {f.__name__: f for f in (
    chunk_fixed_size, chunk_fixed_no_overlap, chunk_fixed_small, chunk_estimate, chunk_totals, chunk_overlap_check, chunk_words, chunk_tokens, clean_texts, word_counts,
    text_spans, file_names, checksums, masked_ids, html_elements, html_plaintext,
)}


def _n(size, overlap):
    return f"CASE WHEN coalesce(length(text), 0) = 0 THEN 0 WHEN length(text) <= {size} THEN 1 ELSE (length(text) - {overlap} + {size - overlap - 1}) // {size - overlap} END"


def _fixed(size, overlap):
    step = size - overlap
    return f"""SELECT doc_id, i AS chunk_index, 'chunk_' || i AS chunk_id, substring(text, i * {step} + 1, {size}) AS text,
  least(i * {step} + {size}, length(text)) - i * {step} AS char_count, i * {step} AS span_start, least(i * {step} + {size}, length(text)) AS span_end
FROM (SELECT doc_id, text, unnest(range(0, {_n(size, overlap)})) AS i FROM documents)"""


_WORDS = f"list_filter(regexp_split_to_array(text, '[{WS}]+'), lambda x: x <> '')"
_UNSAFE = "regexp_replace(regexp_replace(string_split(source, '/')[-1], '[<>:\"/\\\\|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g')"
_LAST = "CASE WHEN source LIKE '%://%' THEN string_split(regexp_extract(source, '://[^/?#]*([^?#]*)', 1), '/')[-1] ELSE string_split(source, '/')[-1] END"
SQL = {
    "chunk_fixed_size": _fixed(1000, 100),
    "chunk_fixed_no_overlap": _fixed(500, 0),
    "chunk_fixed_small": _fixed(64, 16),
    "chunk_estimate": f"SELECT doc_id, CAST({_n(1000, 100)} AS BIGINT) AS n_chunks FROM documents",
    "chunk_totals": f"""WITH c AS ({_fixed(1000, 100)}), g AS (SELECT doc_id, count(*) AS n, sum(char_count) AS chars FROM c GROUP BY doc_id)
SELECT source, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_chunks, CAST(coalesce(sum(chars), 0) AS BIGINT) AS n_chars FROM documents LEFT JOIN g USING (doc_id) GROUP BY source""",
    "chunk_overlap_check": f"""SELECT doc_id, chunk_index, shared FROM (SELECT doc_id, chunk_index,
  span_end - lead(span_start) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS shared FROM ({_fixed(1000, 100)})) WHERE shared IS NOT NULL""",
    "chunk_words": f"""WITH w AS (SELECT doc_id, {_WORDS} AS t FROM documents WHERE text IS NOT NULL), n AS (SELECT *, len(t) AS n FROM w WHERE len(t) > 0),
c AS (SELECT doc_id, t, unnest(range(0, CASE WHEN n <= 50 THEN 1 ELSE (n - 10 + 39) // 40 END)) AS i FROM n)
SELECT doc_id, i AS chunk_index, array_to_string(t[i * 40 + 1 : i * 40 + 50], ' ') AS text, CAST(len(t[i * 40 + 1 : i * 40 + 50]) AS BIGINT) AS token_count FROM c""",
    "clean_texts": f"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\\n[{WS}]*\\n[{WS}]*\\n+', chr(10) || chr(10), 'g') AS t FROM documents)
SELECT doc_id, {strip_sql(f"array_to_string(list_transform(string_split(t, chr(10)), lambda x: {strip_sql('x')}), chr(10))")} AS text FROM a""",
    "word_counts": f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words FROM documents",
    "text_spans": """WITH r AS (SELECT DISTINCT chunk_id, source, ordinal, text FROM parsed_chunks WHERE chunk_id IS NOT NULL),
s AS (SELECT chunk_id, coalesce(length(text), 0) AS n, coalesce(sum(coalesce(length(text), 0) + 1) OVER (PARTITION BY source ORDER BY ordinal, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM r)
SELECT chunk_id, CAST(a AS BIGINT) AS span_from, CAST(a + n AS BIGINT) AS span_to FROM s""",
    "checksums": "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL",
    "masked_ids": "SELECT doc_id, CASE WHEN coalesce(user_id, '') = '' THEN '' WHEN length(user_id) <= 8 THEN '***' ELSE left(user_id, 4) || '***' || right(user_id, 4) END AS masked FROM documents",
    "file_names": f"""SELECT DISTINCT source, lower(regexp_extract(source, '(\\.[^./\\\\]+)$', 1)) AS ext, CASE WHEN {_UNSAFE} = '' THEN 'unnamed_file' ELSE {_UNSAFE} END AS safe_name,
  CASE WHEN contains(url_decode({_LAST}), '.') THEN url_decode({_LAST}) ELSE 'download_1' END AS name
FROM parsed_chunks WHERE source IS NOT NULL""",
}

_ELEMENTS = f"""r AS (SELECT DISTINCT ON (chunk_id) source, ordinal, chunk_id, metadata['type'] AS kind, coalesce(TRY_CAST(metadata['level'] AS INT), 2) AS level, metadata['href'] AS href, text
  FROM parsed_chunks WHERE metadata['parser'] = 'html' AND text IS NOT NULL AND source IS NOT NULL),
x AS (SELECT source, ordinal, chunk_id, CASE WHEN kind IN ('title', 'heading', 'link') THEN kind ELSE 'paragraph' END AS type, level, href, text FROM r)"""
SQL["html_elements"] = f"""WITH {_ELEMENTS},
y AS (SELECT source, ordinal AS o, chunk_id AS c, type, CASE WHEN type = 'heading' THEN level END AS level, CASE WHEN type = 'link' THEN href END AS href,
  CASE WHEN type = 'paragraph' THEN {strip_sql(f"regexp_replace(text, '[{WS}]+', ' ', 'g')")} ELSE {strip_sql('text')} END AS text,
  CASE type WHEN 'title' THEN 0 WHEN 'heading' THEN level WHEN 'paragraph' THEN 10 ELSE 11 END AS place, row_number() OVER (PARTITION BY source, type ORDER BY ordinal NULLS FIRST, chunk_id) AS nth FROM x),
z AS (SELECT source, o, c, type, level, href, text, place FROM y WHERE text <> '' AND (type <> 'title' OR nth = 1) AND (type <> 'link' OR href <> '')
  UNION ALL SELECT DISTINCT source, 0, '', 'metadata', CAST(NULL AS INT), NULL, 'author: The writer' || chr(10) || 'og_type: article', 12 FROM x)
SELECT source, CAST(row_number() OVER w - 1 AS INT) AS ordinal, type, level, href, text, CAST(coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start,
  CAST(coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS BIGINT) AS span_end FROM z WINDOW w AS (PARTITION BY source ORDER BY place, o NULLS FIRST, c)"""
SQL["html_plaintext"] = f"""WITH {_ELEMENTS}, j AS (SELECT source, string_agg({strip_sql('text')}, chr(10) ORDER BY ordinal NULLS FIRST, chunk_id) FILTER ({strip_sql('text')} <> '') AS t FROM x GROUP BY source),
a AS (SELECT source, regexp_replace(regexp_replace(coalesce(t, ''), ' +', ' ', 'g'), '\\n[{WS}]*\\n[{WS}]*\\n+', chr(10) || chr(10), 'g') AS t FROM j)
SELECT source, {strip_sql(f"array_to_string(list_transform(string_split(t, chr(10)), lambda x: {strip_sql('x')}), chr(10))")} AS text FROM a"""
