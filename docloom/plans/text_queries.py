"""Queries over text: search, words, lines, direction, digests, page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import bytes as by
from docloom.functions import text as tx
from docloom.operators import grouping, lookup
from docloom.plans.registry import query, table

_WORDS = r"list_filter(list_transform(regexp_split_to_array(%s, '[ \t\n\v\f\r]+'), lambda w: lower(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g'))), lambda w: w <> '')"


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CAST(sum((length(line) - length(replace(lower(line), 'the', ''))) // 3) AS BIGINT) AS hits,
  count(*) FILTER (contains(lower(line), 'the')) AS lines_hit
FROM l GROUP BY doc_id HAVING sum((length(line) - length(replace(lower(line), 'the', ''))) // 3) > 0
""")
def text_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a phrase per document, line by line, without regard to case."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.split_lines(F.col("text"))).alias("line"))
    hits = lines.select("doc_id", tx.hit_count(F.col("line"), "the").alias("hits"))
    return hits.groupBy("doc_id").agg(F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("lines_hit")).where("hits > 0")


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT doc_id, line_no, lower(line) AS line, unnest(range(1, length(line))) AS p FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(p - 1 AS INTEGER) AS first_char, CAST(p + 6 AS INTEGER) AS end_char
FROM h WHERE substr(line, p, 7) = 'license'
""")
def text_search_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a word stands in its line. (Its ends differ, so hits can't overlap and the plain SQL finds the same.)"""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.split_lines(F.col("text"))).alias("line_no", "line"))
    hits = lines.where(F.contains(F.lower("line"), F.lit("license"))).select("doc_id", "line_no", F.explode(tx.hit_spans(F.col("line"), "license")).alias("s"))
    return hits.select("doc_id", "line_no", F.col("s.start").alias("first_char"), F.col("s.end").alias("end_char"))


@query(f"""
SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, coalesce(array_to_string(w[1:5], ' '), '') AS preview
FROM (SELECT doc_id, {_WORDS % 'text'} AS w FROM documents)
""")
def word_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised words of each document: how many, how many distinct, the first ones."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), tx.preview(F.col("w")).alias("preview"))


@query(f"""
WITH d AS (SELECT doc_id, unnest({_WORDS % 'text'}) AS word FROM documents),
b AS (SELECT item_id AS doc_id, unnest({_WORDS % 'text'}) AS word FROM benchmark),
x AS (SELECT doc_id, word, count(*) AS n FROM d GROUP BY ALL), y AS (SELECT doc_id, word, count(*) AS n FROM b GROUP BY ALL),
z AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b FROM x FULL JOIN y USING (doc_id, word))
SELECT doc_id, round(sum(least(a, b)) / greatest(sum(a), sum(b)), 9) AS similarity FROM z GROUP BY doc_id
""")
def word_similarity_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared words, with repeats, of the document and the benchmark item of one number."""
    words = lambda df: df.select("doc_id", F.explode(tx.words(F.col("text"))).alias("word"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    # Documents without an item have nothing in common with one: their words needn't be taken apart nor counted.
    alone = docs.join(items, "doc_id", "left_anti").where(F.size(tx.words(F.col("text"))) > 0).select("doc_id", F.lit(0.0).alias("similarity"))
    both = lookup.multiset_similarity(words(docs.join(items.select("doc_id"), "doc_id", "left_semi")), words(items), ["doc_id"])
    return both.withColumn("similarity", F.round("similarity", 9)).union(alone)


@query(f"""
SELECT word, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({_WORDS % 'text'}) AS word FROM documents)
WHERE word NOT IN (SELECT unnest({_WORDS % 'text'}) FROM benchmark) GROUP BY word
""")
def words_only_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that no benchmark item has, with the number of documents that have them."""
    items = table(spark, sf_dir, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("word"))
    return docs.groupBy("word").agg(F.count("*").alias("documents")).transform(lambda rows: lookup.only_in(rows, items, "word"))


_RTL = r"\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0700}-\x{074F}\x{0780}-\x{07BF}\x{08A0}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}"


@query(rf"""
SELECT doc_id, length(regexp_replace(text, '[^{_RTL}]', '', 'g')) AS rtl, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS ltr,
  length(regexp_replace(text, '[^{_RTL}]', '', 'g')) > length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS is_rtl FROM documents
""")
def rtl_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each direction, and which prevails."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.rtl_letters(t).cast("long").alias("rtl"), tx.ltr_letters(t).cast("long").alias("ltr"), tx.is_rtl(t).alias("is_rtl"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CAST(sum(length(trim(regexp_replace(line, '[ \t\n\r\f]+', ' ', 'g'), ' '))) AS BIGINT) AS kept_chars, count(*) AS lines,
  md5(string_agg(trim(regexp_replace(line, '[ \t\n\r\f]+', ' ', 'g'), ' '), chr(10) ORDER BY trim(regexp_replace(line, '[ \t\n\r\f]+', ' ', 'g'), ' '))) AS digest
FROM l GROUP BY doc_id
""")
def collapse_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space of each line collapsed and trimmed."""
    lines = F.transform(tx.split_lines(F.col("text")), lambda x: tx.trim_line(tx.collapse(x)))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(lines).alias("l"))
    return rows.select("doc_id", F.length(F.array_join("l", "")).cast("long").alias("kept_chars"), F.size("l").cast("long").alias("lines"), F.md5(F.array_join("l", "\n").cast("binary")).alias("digest"))


@query(r"""
SELECT doc_id, left(trim(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), ' '), 200) AS head,
  left(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[-1], 200) AS last_line FROM documents
""")
def one_line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document in one line, of which 200 characters are shown, and its last line that isn't blank."""
    return table(spark, sf_dir, "documents").select("doc_id", F.left(tx.one_line(F.col("text")), F.lit(200)).alias("head"), tx.last_meaningful_line(F.col("text")).alias("last_line"))


@query(r"""
SELECT doc_id, length(line) AS chars, md5(line) AS digest
FROM (SELECT doc_id, trim(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), ' ') AS line FROM documents)
""")
def one_line_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of each document in one line: its length and digest."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.one_line(F.col("text")).alias("line"))
    return rows.select("doc_id", F.length("line").cast("long").alias("chars"), F.md5(F.col("line").cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", by.digests(F.col("text").cast("binary")).alias("d"))
    return rows.select("doc_id", "d.md5", "d.sha1", "d.sha256")


@query()
def hashes_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-384, SHA-512 and CRC-32 of each document (the tests hold them against Python's)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", by.digests(F.col("text").cast("binary")).alias("d"))
    return rows.select("doc_id", "d.sha384", "d.sha512", "d.crc32")


_SNIFFED = """
WITH f AS (
  SELECT page_id AS id, 'page' AS kind, html AS body FROM pages
  UNION ALL SELECT p_partkey, 'part', concat(CASE p_size % 7 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN 'GIF89a' WHEN 2 THEN 'PK' || chr(3) || chr(4) WHEN 3 THEN '7z' WHEN 4 THEN 'BM' WHEN 5 THEN 'RIFF0000WEBP' ELSE ' %PDF-' END, p_name, '.', p_brand) FROM part)
"""


@query(_SNIFFED + """
SELECT id, kind, contains(substr(body, 1, 1024), '%PDF-') AS is_pdf, CASE WHEN starts_with(body, 'PK' || chr(3) || chr(4)) THEN 'zip' END AS container,
  CASE WHEN starts_with(body, 'GIF89a') OR starts_with(body, 'GIF87a') THEN 'gif' WHEN starts_with(body, 'RIFF') AND substr(body, 9, 4) = 'WEBP' THEN 'webp'
  WHEN starts_with(body, 'BM') AND strlen(body) >= 26 THEN 'bmp' END AS image FROM f
""")
def container_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages, and parts behind made-up magic bytes, are by their first bytes."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.col("html").alias("body"))
    heads = F.array(*[F.lit(x) for x in ("%PDF-1.7", "GIF89a", "PK\x03\x04", "7z", "BM", "RIFF0000WEBP", " %PDF-")])
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lit("part"), F.concat(F.element_at(heads, F.pmod("p_size", F.lit(7)) + 1), F.col("p_name"), F.lit("."), F.col("p_brand")))
    rows = pages.union(parts).withColumn("body", F.col("body").cast("binary"))
    b = F.col("body")
    return rows.select("id", "kind", by.is_pdf(b).alias("is_pdf"), by.container(b).alias("container"), by.image_format(b).alias("image"))


@query("SELECT doc_id, sum(length(replace(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), ''), chr(13), '')))::BIGINT AS source_chars, sum(length(replace(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), ''), chr(13), '')))::BIGINT AS laid_chars FROM documents GROUP BY doc_id")
def paginate_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-pitch pages of each document hold all its characters but white space."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", grouping.paginate(F.col("text"), 80, 50).alias("p"))
    inked = lambda c: F.length(F.translate(c, " \t\n\r\f", "")).cast("long")
    return rows.select("doc_id", inked(F.col("text")).alias("source_chars"), inked(F.array_join(F.col("p.text"), "")).alias("laid_chars"))


@query()
def paginate_fixed_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and pages of each document at 80 columns and 50 lines."""
    rows = table(spark, sf_dir, "documents").select("doc_id", grouping.paginate(F.col("text"), 80, 50).alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("lines"), (F.element_at("p", -1)["page"] + 1).cast("long").alias("pages"), F.array_max(F.transform("p", lambda r: F.length(r["text"]))).alias("widest"))


@query(r"""
WITH t AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages)
SELECT page_id, name, regexp_matches(name, '^[ -~]+$') AS uri_legal,
  name <> '' AND NOT regexp_matches(name, '[/"*:<>?\\|\x00-\x1F\x7F-\x{9F}]') AND NOT ends_with(name, '.') AS segment_legal FROM t
""")
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the last segments of urls are legal in links and as names in a container."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "[^/]*$", 0).alias("name"))
    return rows.select("page_id", "name", by.is_writable_uri(F.col("name")).alias("uri_legal"), by.segment_is_legal(F.col("name")).alias("segment_legal"))
