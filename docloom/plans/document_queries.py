"""Queries of document semantics on the star schema: editing, forms, layers, media types, geometry, records of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import geometry, maps
from docloom.functions import text as tx
from docloom.operators import editing, files, layout, lookup
from docloom.plans.fixtures import spread
from docloom.plans.registry import query, table


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS place FROM part")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each part among those of its brand by the natural order of page names."""
    name = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "/Page").otherwise("/page"), F.col("p_size").cast("string"), F.lit(".png"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", name.alias("name"))
    order = Window.partitionBy("p_brand").orderBy(tx.natural_key(F.col("name")), "p_partkey")
    return rows.select("p_partkey", F.row_number().over(order).cast("long").alias("place"))


_TO_PAGES = """
p AS (SELECT o_custkey AS doc_id, o_orderkey AS num, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n, (o_orderkey % 4) * 90 AS r FROM orders)
"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("num"), i.cast("int").alias("page_index"), (F.col("o_orderkey") % 4 * 90).cast("int").alias("rotation"))


@query(f"WITH {_TO_PAGES} SELECT doc_id, num, CAST(CASE WHEN n <= 2 THEN i WHEN i = 0 THEN 2 WHEN i <= 2 THEN i - 1 ELSE i END AS INTEGER) AS page_index FROM p")
def move_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page moved to be the third, where there are three."""
    return editing.move_page(_pages(spark, sf_dir), 0, 2).select("doc_id", "num", "page_index")


@query(f"WITH {_TO_PAGES}, k AS (SELECT * FROM p WHERE i % 3 <> 1) SELECT doc_id, num, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS page_index, CAST((r + 270) % 360 AS INTEGER) AS rotation FROM k")
def delete_and_rotate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page deleted, the rest turned back by a quarter."""
    pages = _pages(spark, sf_dir)
    out = editing.delete_pages(pages, pages.where("page_index % 3 = 1"))
    return editing.rotate_pages(out, F.lit(-90)).select("doc_id", "num", "page_index", "rotation")


_FORM = """
f AS (SELECT l_orderkey AS doc_id, 'f' || l_linenumber || '.' || l_partkey || '.' || l_suppkey || '.' || CAST(CAST(l_extendedprice * 100 AS BIGINT) AS VARCHAR) AS name, l_returnflag AS value, l_linestatus = 'F' AND l_linenumber = 1 AS ro, l_quantity AS q FROM lineitem),
v AS (SELECT *, q > 45 AS too_long FROM f)
"""


@query(f"""
WITH {_FORM}, b AS (SELECT doc_id, bool_or(ro OR too_long) AS refused FROM v GROUP BY 1)
SELECT doc_id, name, CASE WHEN refused THEN value ELSE CASE WHEN too_long THEN 'longer' ELSE 'new' END END AS value FROM v JOIN b USING (doc_id)
""")
def fill_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a form that takes a value for every field, or for none where one is read-only or a value too long."""
    t = table(spark, sf_dir, "lineitem")
    dot = F.lit(".")
    name = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), dot, F.col("l_partkey").cast("string"), dot, F.col("l_suppkey").cast("string"), dot, F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))
    read_only = (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)
    fields = t.select(F.col("l_orderkey").alias("doc_id"), name.alias("name"), F.lit("text").alias("kind"), F.col("l_returnflag").alias("value"), read_only.cast("long").alias("flags"), F.expr("cast(array() as array<string>)").alias("options"), F.lit(5).alias("max_len"))
    values = t.select(F.col("l_orderkey").alias("doc_id"), name.alias("name"), F.when(F.col("l_quantity") > 45, "longer").otherwise("new").alias("new"))
    return editing.fill_fields(fields, values)[0].select("doc_id", "name", "value")


@query("""
WITH g AS (SELECT s_suppkey AS num, s_nationkey AS doc FROM supplier), o AS (SELECT num, num % 4 = 0 AS listed_off, num % 3 = 0 AS listed_on, doc % 2 = 0 AS base FROM g)
SELECT num, CASE WHEN listed_off THEN false WHEN listed_on THEN true ELSE base END AS visible FROM o
""")
def layer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether layers show: off goes before on, on before the document's base state. Three joins."""
    groups = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("num"), F.col("s_nationkey").alias("doc"))
    on = groups.where("num % 3 = 0").select("num", F.lit(True).alias("visible"))
    off = groups.where("num % 4 = 0").select("num", F.lit(False).alias("visible"))
    base = groups.select("doc").distinct().select("doc", (F.col("doc") % 2 == 0).alias("visible"))
    return lookup.prioritised(groups, [(off, "num"), (on, "num"), (base, "doc")], "visible").select("num", "visible")


@query("""
WITH p AS (SELECT p_partkey, '/' || replace(p_name, ' ', '/') || '.' || CASE p_size % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'xml' WHEN 2 THEN 'bin' ELSE 'Rels' END AS part, p_size FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'application/special' WHEN p_size % 4 = 0 THEN 'image/png' WHEN p_size % 4 = 1 THEN 'text/xml' WHEN p_size % 4 = 3 THEN 'application/rels' END AS media_type FROM p
""")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of package parts: an override by name goes before the default of the extension."""
    end = F.element_at(F.array(*[F.lit(x) for x in ("PNG", "xml", "bin", "Rels")]), F.col("p_size") % 4 + 1)
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("."), end, F.lit("?"), F.col("p_partkey").cast("string")).alias("part"))
    extension = F.lower(F.regexp_extract("part", r"\.([^.?]*)\?", 1))
    overrides = parts.where("p_partkey % 10 = 0").select("part", F.lit("application/special").alias("media_type"))
    defaults = spark.createDataFrame([("png", "image/png"), ("xml", "text/xml"), ("rels", "application/rels")], "extension string, media_type string")
    rows = parts.withColumn("extension", extension)
    return lookup.prioritised(rows, [(overrides, "part"), (defaults, "extension")], "media_type").select("p_partkey", "media_type")


@query("""
WITH m AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings)
SELECT vec_id, round(2 * a + 10, 6) AS x, round(2 * b + 20, 6) AS y, round(d / (a * d - b * c), 6) AS ia, round(-b / (a * d - b * c), 6) AS ib FROM m WHERE abs(a * d - b * c) > 1e-3
""")
def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points through matrices, and their inverses."""
    at = lambda i: F.col("embedding")[i].cast("double")
    m = geometry.matrix(at(0), at(1), at(2), at(3), F.lit(5.0), F.lit(10.0))
    rows = table(spark, sf_dir, "embeddings").where(F.abs(at(0) * at(3) - at(1) * at(2)) > 1e-3)
    both = geometry.then(m, geometry.matrix(2, 0, 0, 2, 0, 0))
    rows = rows.select("vec_id", geometry.apply(both, F.lit(1.0), F.lit(0.0)).alias("p"), geometry.invert(m).alias("i"))
    return rows.select("vec_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), F.round("i.a", 6).alias("ia"), F.round("i.b", 6).alias("ib"))


@query("""
WITH r AS (SELECT label, least(embedding[1], embedding[3]) AS x0, least(embedding[2], embedding[4]) AS y0, greatest(embedding[1], embedding[3]) AS x1, greatest(embedding[2], embedding[4]) AS y1 FROM embeddings)
SELECT label, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) FILTER (x0 < 0.1 AND 0 < x1 AND y0 < 0.1 AND 0 < y1) AS touching FROM r GROUP BY label
""")
def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around rectangles, and how many of them share area with another."""
    rows = table(spark, sf_dir, "embeddings").select("label", geometry.rect_of(F.slice("embedding", 1, 4)).alias("r"))
    other = geometry.rect(F.lit(0.0), F.lit(0.0), F.lit(0.1), F.lit(0.1))
    return rows.groupBy("label").agg(F.min("r.x0").alias("x0"), F.min("r.y0").alias("y0"), F.max("r.x1").alias("x1"), F.max("r.y1").alias("y1"), F.count_if(geometry.overlaps(F.col("r"), other)).alias("touching"))


@query(r"SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'object' AS kind FROM events")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property of each event's JSON, by path."""
    return table(spark, sf_dir, "events").select("event_id", maps.json_get(F.col("props"), "$.k").try_cast("long").alias("k"), maps.json_kind(F.col("props")).alias("kind"))


@query("""
SELECT lang AS corpus, CASE WHEN doc_id % 17 = 0 THEN 'timed_out' WHEN doc_id % 11 = 0 THEN 'crashed' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'passed' END AS outcome, count(*) AS files,
  count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 5 = 0) AS degraded FROM documents GROUP BY ALL
""")
def probe_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of files from the records that probing them left."""
    d = F.col("doc_id")
    opened = F.when(d % 7 == 0, "no damaged").otherwise("yes")
    warn = F.when(d % 5 == 0, "warn font missing 2\n").otherwise("")
    end = F.when(d % 11 == 0, "").otherwise("ms 4\ndone\n")
    record = F.concat(F.lit("probe 1\nfile "), d.cast("string"), F.lit("\nopened "), opened, F.lit("\npages 1\nrendered 1\n"), warn, end)
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), d.cast("string").alias("path"), record.alias("record"), (d % 17 == 0).alias("late"))
    found = files.results(rows, timed_out_col="late")
    return found.groupBy("corpus", "outcome").agg(F.count("*").alias("files"), F.count_if(files.degraded(F.col("warnings"))).alias("degraded"))


@query("""
WITH u AS (SELECT page_id, list_transform(range(1, length(url) + 1), lambda i: ord(substr(url, i, 1))::HUGEINT) AS codes FROM pages)
SELECT page_id, lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, codes), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)::UBIGINT)), 16, '0') AS hash FROM u
""")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of page urls (the tests hold it against known values)."""
    return spread(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", maps.fnv1a(F.col("url")).alias("hash"))


@query(r"SELECT doc_id, CAST(sum(length(regexp_replace(text, '[ \t\n\r\f]', '', 'g'))) AS BIGINT) AS chars FROM documents GROUP BY doc_id HAVING sum(length(regexp_replace(text, '[ \t\n\r\f]', '', 'g'))) > 0")
def layout_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each document's runs after line breaking and pagination."""
    runs = layout.lay_out(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).where("not generated")
    return runs.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("text", r"[ \t\n\r\f]", ""))).alias("chars"))
