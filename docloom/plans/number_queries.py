"""Queries over numbers, dates, labels and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import colour, dates, geometry, numbers
from docloom.functions import text as tx
from docloom.operators import lookup
from docloom.plans.registry import query, table

_ROMAN = "CASE WHEN n <= 0 THEN '' ELSE repeat('m', n // 1000) || ['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'][n % 1000 // 100 + 1] || ['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'][n % 100 // 10 + 1] || ['','i','ii','iii','iv','v','vi','vii','viii','ix'][n % 10 + 1] END"


_RANGES = ((0, "r", "", 1), (2, "D", "", 1), (4, "A", "App-", 25), (6, "", "Plate", 1), (7, "R", "x", 7), (9, "a", "", 3))


@query(f"""
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page FROM orders),
r(lo, style, prefix, start) AS (VALUES {", ".join(str(r) for r in _RANGES)}),
j AS (SELECT o_orderkey, page, max(lo) AS lo FROM o JOIN r ON lo <= page GROUP BY ALL),
k AS (SELECT o_orderkey, page, style, prefix, start + page - lo AS n FROM j JOIN r USING (lo)),
l AS (SELECT *, {_ROMAN} AS roman, repeat(chr(97 + CAST((n - 1) % 26 AS INTEGER)), least((n - 1) // 26 + 1, 64)) AS letters FROM k)
SELECT o_orderkey, prefix || CASE style WHEN 'D' THEN CAST(n AS VARCHAR) WHEN 'r' THEN roman WHEN 'R' THEN upper(roman) WHEN 'a' THEN letters WHEN 'A' THEN upper(letters) ELSE '' END AS label FROM l
""")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pages, where a customer's orders are a document's pages: the range that starts last before a page numbers it."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey")
    pages = orders.withColumn("page", (F.row_number().over(Window.partitionBy("doc").orderBy("o_orderkey")) - 1).cast("long"))
    each = F.explode(F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(style).alias("style"), F.lit(prefix).alias("prefix"), F.lit(start).cast("long").alias("start")) for lo, style, prefix, start in _RANGES]))
    ranges = orders.select("doc").distinct().select("doc", each.alias("range")).select("doc", F.col("range.lo").alias("page"), "range")
    found = lookup.asof(pages, ranges, ["doc"], "page", "range").select("o_orderkey", "page", "range.*")
    n = F.col("start") + F.col("page") - F.col("lo")
    return found.select("o_orderkey", F.concat("prefix", tx.label_number(F.col("style"), n)).alias("label"))


@query("""
SELECT l_orderkey, sum(l_quantity) AS total, round(avg(l_quantity), 9) AS mean, product(l_quantity) AS product, min(l_quantity) AS least, max(l_quantity) AS most
FROM lineitem GROUP BY l_orderkey
""")
def form_calculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUM, AVG, PRD, MIN and MAX over each order's quantities (whole numbers, so products are exact)."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(q).alias("total"), F.round(F.avg(q), 9).alias("mean"), F.product(q).alias("product"), F.min(q).alias("least"), F.max(q).alias("most"))


@query(r"""
WITH v AS (SELECT p_partkey, p_retailprice - 1000 AS x FROM part),
r AS (SELECT p_partkey, x, sign(x) * (floor(abs(x * 100)) + (abs(x * 100) - floor(abs(x * 100)) >= 0.5)::INT) / 100 AS y FROM v),
s AS (SELECT *, format('{:,.2f}', abs(y)) AS plain FROM r)
SELECT p_partkey, CASE WHEN y < 0 THEN '-' || plain ELSE plain END AS style0,
  CASE WHEN y < 0 THEN '(' || '$' || translate(plain, ',.', '.,') || ')' ELSE '$' || translate(plain, ',.', '.,') END AS style2,
  CASE WHEN y < 0 THEN '-' ELSE '' END || replace(plain, ',', '') || ' EUR' AS style1 FROM s
""")
def af_number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as fields show them, in three styles."""
    x = F.col("p_retailprice") - 1000
    return table(spark, sf_dir, "part").select("p_partkey", numbers.format_number(x).alias("style0"), numbers.format_number(x, 2, 2, 2, "$").alias("style2"), numbers.format_number(x, 2, 1, 0, " EUR", False).alias("style1"))


@query(r"""
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0 THEN '-' ELSE '' END || format('{:,.1f}', floor(abs(l_discount * 100.0) * 10 + 0.5) / 10) || '%' AS discount FROM lineitem
""")
def af_percent_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.percent_format(F.col("l_discount"), 1).alias("discount"))


@query(r"""
WITH d AS (SELECT c_custkey, CAST(c_custkey * 7919 + 100000000 AS VARCHAR) AS n9, CAST(c_custkey * 7919 + 2000000000 AS VARCHAR) AS n10, 'x' || CAST(c_custkey % 100000 + 10000 AS VARCHAR) AS n5 FROM customer)
SELECT c_custkey, CASE WHEN length(n5) = 6 THEN substr(n5, 2) ELSE n5 END AS zip, CASE WHEN length(n9) = 9 THEN n9[1:5] || '-' || n9[6:9] ELSE n9 END AS zip4,
  CASE WHEN length(n10) = 10 THEN '(' || n10[1:3] || ') ' || n10[4:6] || '-' || n10[7:10] ELSE n10 END AS phone,
  CASE WHEN length(n9) = 9 THEN n9[1:3] || '-' || n9[4:5] || '-' || n9[6:9] ELSE n9 END AS ssn FROM d
""")
def af_special_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zip codes, phone numbers and the like from digits."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (k * 7919 + 100000000).cast("string").alias("n9"), (k * 7919 + 2000000000).cast("string").alias("n10"), F.concat(F.lit("x"), (k % 100000 + 10000).cast("string")).alias("n5"))
    return rows.select("c_custkey", numbers.format_special(F.col("n5"), 0).alias("zip"), numbers.format_special(F.col("n9"), 1).alias("zip4"), numbers.format_special(F.col("n10"), 2).alias("phone"), numbers.format_special(F.col("n9"), 3).alias("ssn"))


@query(r"""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '$' || CAST(CAST(o_orderkey AS BIGINT) AS VARCHAR) || ',5' WHEN 1 THEN '' WHEN 2 THEN ' 12 345.5 ' ELSE 'n/a' END AS s FROM orders)
SELECT o_orderkey, coalesce(TRY_CAST(regexp_replace(s, '[ ,$]', '', 'g') AS DOUBLE), 0) AS n FROM t
""")
def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read from what people type."""
    k = F.col("o_orderkey")
    s = F.when(k % 4 == 0, F.concat(F.lit("$"), k.cast("string"), F.lit(",5"))).when(k % 4 == 1, "").when(k % 4 == 2, " 12 345.5 ").otherwise("n/a")
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.text_number(s).alias("n"))


@query(r"""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(23 AS INTEGER) AS h, CAST(CASE o_orderkey % 3 WHEN 0 THEN 90 WHEN 1 THEN -330 ELSE 0 END AS INTEGER) AS zone FROM orders
""")
def pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of documents, with hours out of range and offsets with and without apostrophes."""
    k = F.col("o_orderkey")
    zone = F.when(k % 3 == 0, "+01'30'").when(k % 3 == 1, "-0530").otherwise("Z")
    s = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("990060"), zone)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_pdf_date(s).alias("p"))
    return rows.select("o_orderkey", F.col("p.year").alias("y"), F.col("p.month").alias("m"), F.col("p.day").alias("d"), F.col("p.hour").alias("h"), F.col("p.offset_minutes").alias("zone"))


@query(r"""
SELECT o_orderkey, strftime(o_orderdate, '%-m/%-d') AS f0, strftime(o_orderdate, '%-m/%-d/%y') AS f1, strftime(o_orderdate, '%m/%d/%Y') AS f4, strftime(o_orderdate, '%-d-%b-%Y') AS f7, strftime(o_orderdate, '%Y-%m-%d') AS f11, 'soon' AS other FROM orders
""")
def af_date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed dates in five of the twelve output forms."""
    k = F.col("o_orderkey")
    s = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-M-d")).when(k % 3 == 1, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "d MMM yyyy"))
    forms = (0, 1, 4, 7, 11)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", dates.format_date_texts(F.col("s"), forms).alias("f"))
    return rows.select("o_orderkey", *[f"f.f{i}" for i in forms], dates.format_date_text(F.lit("soon"), 4).alias("other"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(CAST(round(((CAST(l_quantity * 37 AS INTEGER) - 900) % 360 + 360) % 360 / 90.0) AS INTEGER) % 4 * 90 AS INTEGER) AS rotation FROM lineitem
""")
def rotate_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.normalize_rotation((F.col("l_quantity") * 37).cast("int") - 900).alias("rotation"))


@query("""
WITH p AS (SELECT p_partkey, p_size * 20.0 AS w, p_size * 30.0 + 7 AS h, CASE WHEN p_size % 2 = 0 THEN 150 / 72.0 ELSE 40.0 END AS s FROM part),
q AS (SELECT p_partkey, w, h, CASE WHEN w * h * s * s > 67108864 THEN sqrt(67108864 / (w * h)) ELSE s END AS s FROM p)
SELECT p_partkey, CAST(greatest(1, ceil(w * s - 1e-6)) AS BIGINT) AS width, CAST(greatest(1, ceil(h * s - 1e-6)) AS BIGINT) AS height FROM q
""")
def page_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of pages, the scale lowered where there would be too many."""
    w, h = F.col("p_size") * 20.0, F.col("p_size") * 30.0 + 7
    scale = geometry.page_scale(w, h, F.when(F.col("p_size") % 2 == 0, 150 / 72.0).otherwise(40.0))
    return table(spark, sf_dir, "part").select("p_partkey", geometry.page_pixels(w, h, scale).alias("p")).select("p_partkey", "p.width", "p.height")


_E = "list_transform(embedding[1:4], lambda x: round(abs(CAST(x AS DOUBLE)), 3))"


@query(f"""
WITH e AS (SELECT vec_id, {_E} AS v FROM embeddings),
c AS (SELECT vec_id, least(1, v[1]) AS c, least(1, v[2]) AS m, least(1, v[3]) AS y, least(1, v[4]) AS k FROM e)
SELECT vec_id, CAST(floor((1 - c) * (1 - k) * 255 + 0.5) AS INTEGER) AS r, CAST(floor((1 - m) * (1 - k) * 255 + 0.5) AS INTEGER) AS g, CAST(floor((1 - y) * (1 - k) * 255 + 0.5) AS INTEGER) AS b,
  CAST(floor(c * 255 + 0.5) AS INTEGER) AS gray FROM c
""")
def color_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components of vectors as CMYK and as gray."""
    v = F.transform(F.slice("embedding", 1, 4), lambda x: F.round(F.abs(x.cast("double")), 3))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    rows = rows.select("vec_id", colour.components_to_rgb(F.col("v")).alias("c"), colour.components_to_rgb(F.slice("v", 1, 1)).alias("w"))
    return rows.select("vec_id", "c.r", "c.g", "c.b", F.col("w.r").alias("gray"))


@query("""
WITH e AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) * 300 % 100 AS l, CAST(embedding[2] AS DOUBLE) * 300 AS a, CAST(embedding[3] AS DOUBLE) * 300 AS b FROM embeddings),
f AS (SELECT vec_id, (l + 16) / 116 + a / 500 AS fx, (l + 16) / 116 AS fy, (l + 16) / 116 - b / 200 AS fz FROM e),
x AS (SELECT vec_id, list_transform([fx, fy, fz], lambda t: CASE WHEN t > 6 / 29 THEN t * t * t ELSE 3 * pow(6 / 29, 2) * (t - 4 / 29) END) AS v FROM f),
y AS (SELECT vec_id, v[1] * 0.964212 AS x, v[2] AS y, v[3] * 0.825188 AS z FROM x),
s AS (SELECT vec_id, list_transform([3.134136 * x - 1.617036 * y - 0.490662 * z, -0.978755 * x + 1.916143 * y + 0.033454 * z, 0.07195 * x - 0.228988 * y + 1.405386 * z],
  lambda t: least(1, greatest(0, t))) AS c FROM y)
SELECT vec_id, list_transform(c, lambda t: CAST(floor(CASE WHEN t <= 0.0031308 THEN 12.92 * t ELSE 1.055 * pow(t, 1 / 2.4) - 0.055 END * 255 + 0.5) AS INTEGER)) AS rgb FROM s
""")
def lab_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", colour.lab_to_rgb(F.abs(at(0)) * 300 % 100, at(1) * 300, at(2) * 300).alias("c"))
    return rows.select("vec_id", F.array("c.r", "c.g", "c.b").alias("rgb"))


_M = "((%s) + 127) // 255"


@query(f"""
WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 5 AS INTEGER) AS cb, CAST(floor(l_extendedprice) AS INTEGER) % 256 AS cs FROM lineitem),
h AS (SELECT *, CASE WHEN cs <= 127 THEN {_M % 'cb * 2 * cs'} ELSE cb + (2 * cs - 255) - {_M % 'cb * (2 * cs - 255)'} END AS hard,
  CASE WHEN cb <= 127 THEN {_M % 'cs * 2 * cb'} ELSE cs + (2 * cb - 255) - {_M % 'cs * (2 * cb - 255)'} END AS over FROM p)
SELECT l_orderkey, l_linenumber, {_M % 'cb * cs'} AS multiply, cb + cs - {_M % 'cb * cs'} AS screen, over AS overlay, least(cb, cs) AS darken, greatest(cb, cs) AS lighten,
  CASE WHEN cb = 0 THEN 0 WHEN cs >= 255 THEN 255 ELSE least(255, cb * 255 // (255 - cs)) END AS dodge,
  CASE WHEN cb >= 255 THEN 255 WHEN cs = 0 THEN 0 ELSE 255 - least(255, (255 - cb) * 255 // cs) END AS burn,
  hard AS hardlight, abs(cb - cs) AS difference, cb + cs - 2 * ({_M % 'cb * cs'}) AS exclusion FROM h
""")
def blend_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separable blend modes on bytes."""
    cb, cs = (F.col("l_quantity") * 5).cast("int"), F.floor("l_extendedprice").cast("int") % 256
    names = {"multiply": "Multiply", "screen": "Screen", "overlay": "Overlay", "darken": "Darken", "lighten": "Lighten", "dodge": "ColorDodge", "burn": "ColorBurn", "hardlight": "HardLight", "difference": "Difference", "exclusion": "Exclusion"}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cb.alias("cb"), cs.alias("cs"))
    return rows.select("l_orderkey", "l_linenumber", *[colour.blend(mode, F.col("cb"), F.col("cs")).cast("int").alias(name) for name, mode in names.items()])


@query("""
WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), c AS (SELECT vec_id, least(1, greatest(0, x)) AS x FROM e)
SELECT vec_id, round(0.25 + pow(x, 1.8) * 0.5, 9) AS exponential,
  round(CASE WHEN x < 0.1 THEN pow(x / 0.1, 2) WHEN x < 0.3 THEN 1 - (x - 0.1) / 0.2 ELSE 0.5 * (x - 0.3) / 0.7 END, 9) AS stitching FROM c
""")
def colour_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential and stitching functions of a vector's first component."""
    x = F.col("embedding")[0].cast("double")
    parts = [lambda v: colour.exponential(v, [0.0], [1.0], 2.0), lambda v: colour.exponential(v, [1.0], [0.0], 1.0), lambda v: colour.exponential(v, [0.0], [0.5], 1.0)]
    stitched = colour.stitching(x, (0.0, 1.0), [0.1, 0.3], [(0.0, 1.0)] * 3, parts)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(colour.exponential(x, [0.25], [0.75], 1.8)[0], 9).alias("exponential"), F.round(stitched[0], 9).alias("stitching"))


@query("""
WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: CAST(floor(least(1, abs(CAST(x AS DOUBLE))) * 255 + 0.5) AS INTEGER)) AS a,
  list_transform(b.embedding, lambda x: CAST(floor(least(1, abs(CAST(x AS DOUBLE))) * 255 + 0.5) AS INTEGER)) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
d AS (SELECT vec_id, list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])) AS d FROM p)
SELECT vec_id, round(list_avg(d), 9) AS mean, list_max(d) AS worst, CAST(list_position(d, list_max(d)) AS INTEGER) AS worst_at, round(len(list_filter(d, lambda x: x > 8)) / len(d), 9) AS over, round(len(list_filter(d, lambda x: x > 0)) / len(d), 9) AS differing FROM d
""")
def pixel_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the next as pixels: mean and worst difference, and shares over thresholds."""
    pixels = F.transform("embedding", lambda x: colour.to_byte(F.abs(x.cast("double"))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", pixels.alias("a"))
    both = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    rows = both.select("vec_id", F.zip_with("a", "b", lambda x, y: F.abs(x - y)).alias("d"))
    share = lambda t: F.round(F.size(F.filter("d", lambda x: x > t)) / F.size("d"), 9)
    mean = F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.size("d")
    return rows.select("vec_id", F.round(mean, 9).alias("mean"), F.array_max("d").alias("worst"), F.array_position("d", F.array_max("d")).cast("int").alias("worst_at"), share(8).alias("over"), share(0).alias("differing"))


@query(r"""
WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '#' || lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0') WHEN 1 THEN ' #80' || lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0') ELSE 'red' END AS c, p_partkey * 7919 % 16777216 AS n FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 255 WHEN 1 THEN 128 END AS a, CASE WHEN p_partkey % 3 < 2 THEN CAST(n // 65536 AS INTEGER) END AS r, CASE WHEN p_partkey % 3 < 2 THEN CAST(n // 256 % 256 AS INTEGER) END AS g, CASE WHEN p_partkey % 3 < 2 THEN CAST(n % 256 AS INTEGER) END AS b,
 CASE WHEN p_partkey % 3 < 2 THEN CAST(((n // 65536) * 299 + (n // 256 % 256) * 587 + (n % 256) * 114 + 500) // 1000 AS INTEGER) END AS luma FROM t
""")
def colour_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal colours, and their luma."""
    k = F.col("p_partkey")
    digits = F.lower(F.lpad(F.hex(k * 7919 % 16777216), 6, "0"))
    text = F.when(k % 3 == 0, F.concat(F.lit("#"), digits)).when(k % 3 == 1, F.concat(F.lit(" #80"), digits)).otherwise("red")
    rows = table(spark, sf_dir, "part").select("p_partkey", colour.parse_colour(text).alias("c")).select("p_partkey", "c.*")
    return rows.withColumn("luma", F.when(F.col("r").isNotNull(), colour.luma(F.col("r"), F.col("g"), F.col("b"))))
