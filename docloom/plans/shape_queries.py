"""Queries of relational shape: lookups, overlays, closures, groupings, reports, pages of HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import cascade, closure, grouping, lookup, report
from docloom.plans.registry import query, table
from docloom.sources import html


@query("""
SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest event."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return lookup.newest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts", "event_type", "value")


@query("""
WITH c AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderkey % 10 = 0 AS deleted FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT -o_orderkey, o_custkey, 'N', o_totalprice, false FROM orders WHERE o_orderkey % 100 = 1)
SELECT coalesce(c.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(c.o_custkey, o.o_custkey) AS o_custkey, coalesce(c.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(c.o_totalprice, o.o_totalprice) AS o_totalprice
FROM orders o FULL JOIN c USING (o_orderkey) WHERE NOT coalesce(deleted, false)
""")
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under an overlay of changed, new and deleted ones."""
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    changed = base.where(k % 5 == 0).select("o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"), (k % 10 == 0).alias("deleted"))
    new = base.where(k % 100 == 1).select((-k).alias("o_orderkey"), "o_custkey", F.lit("N"), "o_totalprice", F.lit(False))
    return lookup.overlay(base, changed.union(new), "o_orderkey")


_EDGES = """
e(src, dst) AS (SELECT 'r' || r_regionkey, 'n' || n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 'r' || (s_suppkey % 3) FROM supplier)
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), (F.col(c) if isinstance(c, str) else c).cast("string"))
    out = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(name("r", "r_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    out = out.union(t("customer").select(name("n", "c_nationkey"), name("c", "c_custkey"))).union(t("supplier").select(name("n", "s_nationkey"), name("s", "s_suppkey")))
    return out.union(t("supplier").select(name("s", "s_suppkey"), name("r", F.col("s_suppkey") % 3)))


@query(f"WITH RECURSIVE {_EDGES}, x(node) AS (SELECT 'r1' UNION SELECT dst FROM x JOIN e ON src = node) SELECT node FROM x")
def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects that one region reaches, over edges with circles."""
    return closure.reachable(_edges(spark, sf_dir), spark.createDataFrame([("r1",)], "node string"))


@query(f"WITH RECURSIVE {_EDGES}, x(node) AS (SELECT 'r1' UNION SELECT dst FROM x JOIN e ON src = node WHERE dst NOT IN ('r0', 'r2', 'n3')) SELECT node FROM x")
def reachable_avoiding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without entering three of the objects."""
    avoid = spark.createDataFrame([("r0",), ("r2",), ("n3",)], "node string")
    return closure.reachable(_edges(spark, sf_dir), spark.createDataFrame([("r1",)], "node string"), avoid)


@query("""
SELECT 's' || s_suppkey AS node, 2 AS depth, CASE WHEN s_suppkey % 4 = 0 THEN 'S' || s_suppkey WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS label
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'n' || n_nationkey, 1, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'r' || r_regionkey, 0, r_name FROM region
""")
def inherited_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of regions, nations and suppliers; what has none takes its parent's."""
    t = lambda n: table(spark, sf_dir, n)
    tree = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("seq"), F.col("r_name").alias("label"))
    tree = tree.union(t("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey").cast("long"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))))
    tree = tree.union(t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), "s_nationkey"), "s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("S"), F.col("s_suppkey").cast("string")))))
    return closure.inherit(tree, ["label"]).select("node", "depth", "label")


@query("""
WITH l AS (SELECT *, lag(ts) OVER w AS t0, lag(event_type) OVER w AS k0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum((coalesce(epoch(ts) - epoch(t0) > 3600 * 24 OR (event_type = 'signup' AND k0 <> 'signup'), false))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS events, min(event_id) AS least_event, max(event_id) AS greatest_event, round(sum(value), 6) AS value FROM b GROUP BY ALL
""")
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each user's events, broken by a day's gap or a sign-up: the shape in which glyphs become lines."""
    by, order = ["user_id"], ["ts", "event_id"]
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(grouping.before("ts", by, order).cast("timestamp")) > 86_400_000_000
    breaks = gap | ((F.col("event_type") == "signup") & (grouping.before("event_type", by, order) != "signup"))
    runs = grouping.islands(table(spark, sf_dir, "events"), by, order, breaks)
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("events"), F.min("event_id").alias("least_event"), F.max("event_id").alias("greatest_event"), F.round(F.sum("value"), 6).alias("value"))


@query("SELECT l_orderkey, greatest(max(CASE WHEN l_linenumber % 2 = 0 THEN -l_quantity ELSE l_quantity END), 0) + least(min(CASE WHEN l_linenumber % 2 = 0 THEN -l_quantity ELSE l_quantity END), 0) AS margin FROM lineitem GROUP BY l_orderkey")
def collapse_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    margin = F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return grouping.collapse_margins(table(spark, sf_dir, "lineitem").select("l_orderkey", margin.alias("margin")), ["l_orderkey"], "margin")


@query("SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pen, l_extendedprice FROM lineitem")
def pen_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line of an order starts if quantities are advances."""
    rows = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return grouping.pen_positions(rows, ["l_orderkey"], "at", "l_quantity").select("l_orderkey", "l_linenumber", "pen", "l_extendedprice")


@query("""
WITH e AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type <> 'purchase'), p AS (SELECT user_id, ts, max(value) AS price FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT event_id, e.user_id, p.price FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts
""")
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the user's last purchase before it."""
    rows = table(spark, sf_dir, "events")
    left = rows.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    right = rows.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("price"))
    return lookup.asof(left, right, ["user_id"], "ts", "price").select("event_id", "user_id", "price")


@query("""
WITH r(lo, hi, band) AS (VALUES (0, 999, 'low'), (1000, 49999, 'mid'), (60000, 199999, 'high'), (200000, 300000, 'top'))
SELECT o_orderkey, band FROM orders LEFT JOIN r ON CAST(floor(o_totalprice) AS BIGINT) BETWEEN lo AND hi
""")
def code_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range that holds each order's price, as codes find theirs in a character map."""
    ranges = spark.createDataFrame([(0, 999, "low"), (1000, 49999, "mid"), (60000, 199999, "high"), (200000, 300000, "top")], "lo long, hi long, band string")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("code"))
    return lookup.range_lookup(rows, "code", ranges, value="band").select("o_orderkey", "band")


@query("""
WITH w AS (SELECT doc_id, generate_subscripts(string_split(text, ' '), 1) AS k, unnest(string_split(text, ' ')) AS word FROM documents),
p AS (SELECT doc_id, k, word, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0, length(word) AS n FROM w),
a(doc, a0, a1) AS (SELECT doc_id, n_chars * f, n_chars * f + 40 FROM documents, (VALUES (0.2), (0.5), (0.51)) AS t(f))
SELECT doc_id, count(*) AS glyph_runs, CAST(sum(n) AS BIGINT) AS chars FROM p WHERE EXISTS (SELECT 1 FROM a WHERE doc = doc_id AND a0 < x0 + n AND x0 < a1) GROUP BY doc_id
""")
def redact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that three areas of it touch, as words of a line of fixed pitch."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("k", "word"))
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    spans = words.withColumn("x0", F.coalesce(F.sum(F.length("word") + 1).over(w), F.lit(0)).cast("double")).withColumn("x1", F.col("x0") + F.length("word"))
    areas = docs.select("doc_id", "n_chars", F.explode(F.array(*[F.lit(f) for f in (0.2, 0.5, 0.51)])).alias("f")).select("doc_id", (F.col("n_chars") * F.col("f")).alias("a0"), (F.col("n_chars") * F.col("f") + 40).alias("a1"))
    return lookup.intervals_hit(spans, areas, ["doc_id"], "x0", "x1").groupBy("doc_id").agg(F.count("*").alias("glyph_runs"), F.sum(F.length("word")).alias("chars"))


_FILES = """
f AS (SELECT lang AS corpus, doc_id AS path, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'crashed' ELSE 'passed' END AS outcome,
  list_filter(['long', 'license', 'digits'], lambda x: CASE x WHEN 'long' THEN n_chars > 3000 WHEN 'license' THEN contains(lower(text), 'license') ELSE regexp_matches(text, '[0-9]') END) AS capabilities
  FROM documents LEFT JOIN labels USING (doc_id))
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    outcome = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "crashed").otherwise("passed")
    found = F.array_compact(F.array(F.when(F.col("n_chars") > 3000, "long"), F.when(F.contains(F.lower("text"), F.lit("license")), "license"), F.when(F.col("text").rlike("[0-9]"), "digits")))
    return rows.select(F.col("lang").alias("corpus"), F.col("doc_id").alias("path"), outcome.alias("outcome"), found.alias("capabilities"), found.alias("warnings"))


@query(f"""
WITH {_FILES}, o(outcome) AS (VALUES ('passed'), ('failed'), ('crashed'), ('timed_out'))
SELECT corpus, o.outcome, count(f.path) AS files FROM (SELECT DISTINCT corpus FROM f) AS c CROSS JOIN o LEFT JOIN f USING (corpus, outcome) GROUP BY ALL
""")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by outcome, those that never happened included."""
    return report.outcomes(_files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT corpus, capability, count(DISTINCT path) AS files FROM (SELECT corpus, path, unnest(capabilities) AS capability FROM f) GROUP BY ALL")
def capability_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.files_per(_files(spark, sf_dir), "capabilities", "capability")


@query(f"""
WITH {_FILES} SELECT corpus, count(*) FILTER ('long' IN capabilities) AS long, count(*) FILTER ('license' IN capabilities) AS license, count(*) FILTER ('digits' IN capabilities) AS digits
FROM f WHERE len(capabilities) > 0 GROUP BY ROLLUP (corpus)
""")
def capability_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora against capabilities, with a row of totals."""
    return report.pivot(_files(spark, sf_dir), "capabilities", ["long", "license", "digits"])


@query(f"WITH {_FILES} SELECT corpus, count(*) AS total, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (len(capabilities) > 0) AS degraded FROM f GROUP BY ROLLUP (corpus)")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_files(spark, sf_dir))


@query(f"""
WITH {_FILES}, b AS (SELECT corpus, count(*)::HUGEINT AS tb, count(*) FILTER (outcome = 'passed') AS pb FROM f WHERE path % 2 = 0 AND corpus <> 'de' GROUP BY 1),
n AS (SELECT corpus, count(*)::HUGEINT AS tn, count(*) FILTER (outcome = 'passed') AS pn FROM f WHERE path % 2 = 1 AND corpus <> 'es' GROUP BY 1)
SELECT coalesce(b.corpus, n.corpus) AS corpus, CASE WHEN tb IS NULL THEN 'new' WHEN tn IS NULL THEN 'missing' WHEN tn = 0 THEN 'empty' WHEN pn * tb < pb * tn THEN 'fell' ELSE 'holds' END AS verdict FROM b FULL JOIN n USING (corpus)
""")
def ratchet_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pass rates of one half of the corpus hold in the other."""
    files = _files(spark, sf_dir)
    before = report.summary(files.where("path % 2 = 0 and corpus <> 'de'")).where("corpus is not null")
    now = report.summary(files.where("path % 2 = 1 and corpus <> 'es'")).where("corpus is not null")
    return report.gate(before, now)


@query(f"""
WITH {_FILES}, w AS (SELECT corpus, unnest(capabilities) AS label FROM f), c AS (SELECT label, count(*) AS files FROM w GROUP BY 1)
SELECT label, files, row_number() OVER (ORDER BY files DESC, label) AS place FROM c
""")
def warning_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings by the number of files, names breaking ties."""
    counts = report.files_per(_files(spark, sf_dir), "warnings", "label", ())
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.col("files").desc(), "label")).cast("long"))


@query(f"WITH {_FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY path) AS n FROM f) SELECT corpus, list(path ORDER BY path) FILTER (n <= 10) AS items, count(*) FILTER (n > 10) AS dropped FROM r GROUP BY 1")
def capped_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten files of each corpus, and how many more there are."""
    return report.capped(_files(spark, sf_dir), ["corpus"], "path", "path", 10)


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ') AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(r"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["'']', 1) AS a FROM pages)
SELECT page_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS seq, unnest(a) AS target FROM l
""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page in order."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.links(F.col("html"))).alias("seq", "target"))


@query(r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS a FROM pages)
SELECT page_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS seq, CAST(substr(unnest(a), 3, 1) AS INTEGER) AS level, trim(regexp_replace(unnest(a), '(?s)<[^>]*>', '', 'g'), ' ') AS title FROM h
""")
def html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of each page in order."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.headings(F.col("html"))).alias("seq", "h"))
    return rows.select("page_id", "seq", "h.level", "h.title")


@query(r"""
WITH c AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|(<(script|style)[^>]*>).*?</(script|style)>', '\1', 'g') AS html FROM pages)
SELECT page_id, tag, count(*) AS elements FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM c) GROUP BY ALL
""")
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of each page by tag, from the parsed tree."""
    return html.dom_nodes(table(spark, sf_dir, "pages")).groupBy("page_id", "tag").agg(F.count("*").alias("elements"))


_CSS = (
    (1, "p", None, None, None, "ua", False, "color", "black", 0),
    (2, "p", None, None, "article", "author", False, "color", "navy", 1),
    (3, "p", None, None, None, "author", False, "color", "gray", 2),
    (4, "div", None, "ad", None, "author", True, "display", "none", 3),
    (5, "div", None, None, None, "author", False, "display", "block", 4),
    (6, "a", None, None, "li", "user", False, "color", "blue", 5),
    (7, "a", None, None, None, "ua", True, "color", "purple", 6),
    (8, "b", None, None, "p", "author", False, "font-weight", "700", 7),
    (9, "b", None, None, None, "author", False, "font-weight", "600", 8),
)


@query()
def css_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each page get each value, after rules of three origins with and without importance."""
    rules = spark.createDataFrame(_CSS, "sel int, tag string, sel_id string, sel_class string, parent_tag string, origin string, important boolean, property string, value string, `order` int")
    part = lambda c: F.col(c).isNotNull().cast("int")
    declared = rules.select("sel", cascade.rank(F.col("origin"), F.col("important")).alias("rank"), part("sel_id").alias("a"), part("sel_class").alias("b"), (part("tag") + part("parent_tag")).alias("c"), "order", "property", "value")
    nodes = html.dom_nodes(table(spark, sf_dir, "pages"))
    matched = cascade.matches(nodes, rules.select("sel", "tag", "sel_id", "sel_class", "parent_tag"))
    return cascade.winners(matched, declared).groupBy("page_id", "property", "value").agg(F.count("*").alias("elements"))


@query("""
WITH r(rule, k, origin_rank, spec, ord, value) AS (VALUES (1, 0, 1, 1, 0, 'a'), (2, 0, 3, 2, 1, 'b'), (3, 1, 3, 2, 2, 'c'), (4, 1, 5, 1, 3, 'd'), (5, 2, 3, 1, 4, 'e'), (6, 2, 3, 1, 5, 'f'))
SELECT p_partkey, arg_max(value, row(origin_rank, spec, ord)) AS value FROM part JOIN r ON p_size % 3 = k OR (p_size % 5 = 0 AND rule = 1) GROUP BY p_partkey
""")
def css_cascade_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declaration with the greatest rank, specificity and order, on made-up matches."""
    rules = spark.createDataFrame([(1, 0, 1, 1, 0, "a"), (2, 0, 3, 2, 1, "b"), (3, 1, 3, 2, 2, "c"), (4, 1, 5, 1, 3, "d"), (5, 2, 3, 1, 4, "e"), (6, 2, 3, 1, 5, "f")], "sel int, k int, rank int, c int, `order` int, value string")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    matched = parts.join(rules.select("sel", "k"), (F.col("p_size") % 3 == F.col("k")) | ((F.col("p_size") % 5 == 0) & (F.col("sel") == 1))).select("p_partkey", "sel")
    declared = rules.select("sel", "rank", F.lit(0).alias("a"), F.lit(0).alias("b"), "c", "order", F.lit("x").alias("property"), "value")
    return cascade.winners(matched, declared, ["p_partkey"]).select("p_partkey", "value")


@query("""
WITH f(face, family, weight, style) AS (VALUES ('A', 0, 400, 0), ('B', 0, 700, 0), ('C', 1, 300, 1), ('D', 1, 500, 0), ('E', 2, 900, 2)),
r AS (SELECT p_partkey, p_size % 3 AS family, (p_size % 9 + 1) * 100 AS weight, p_size % 2 AS style FROM part),
d AS (SELECT p_partkey, face, abs(f.style - r.style) AS sd, abs(f.weight - r.weight) + CASE WHEN r.weight <= 450 AND f.weight > r.weight OR r.weight > 450 AND f.weight < r.weight THEN 10000 ELSE 0 END AS wd FROM r JOIN f USING (family))
SELECT p_partkey, arg_min(face, row(sd, wd, face)) AS face FROM d GROUP BY p_partkey
""")
def nearest_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The face of a family that comes nearest in style and weight."""
    faces = spark.createDataFrame([("A", 0, 400, 0), ("B", 0, 700, 0), ("C", 1, 300, 1), ("D", 1, 500, 0), ("E", 2, 900, 2)], "face string, f_family int, f_weight int, f_style int")
    wanted = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).alias("family"), ((F.col("p_size") % 9 + 1) * 100).alias("weight"), (F.col("p_size") % 2).alias("style"))
    w, f = F.col("weight"), F.col("f_weight")
    away = F.abs(f - w) + F.when(((w <= 450) & (f > w)) | ((w > 450) & (f < w)), 10000).otherwise(0)
    distance = F.struct(F.abs(F.col("f_style") - F.col("style")), away, "face")
    return lookup.nearest(wanted, faces, F.col("family") == F.col("f_family"), distance, "p_partkey", "face")


@query("SELECT o_orderstatus AS outcome, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per group merged from partial counts in maps."""
    parts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 4).alias("part")).agg(F.count("*").alias("n"))
    maps = parts.groupBy(F.col("o_orderstatus").alias("outcome"), "part").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("counts"))
    return report.merge_counts(maps, ["outcome"], "counts").select("outcome", F.col("key").alias("label"), "n")
