"""Queries over values: dictionaries, objects of files, reports, colours, chains, forms and whatever a file is."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import colour, maps, scripts
from docloom.operators import closure, editing, files, layout
from docloom.plans import archive_queries
from docloom.plans.fixtures import Row, files_of, gathered, mapped, spread
from docloom.plans.registry import query, table, typed
from docloom.sources import open as any_file
from docloom.sources.pdf import tables as pdf
from docloom.sources.pdf import writer
from docloom.sources.pdf.objects import Name, Ref
from docloom.sources.pdf.writer import Builder


@query(typed("""
SELECT p_partkey, p_size AS size, CAST(p_retailprice AS DOUBLE) AS price, NULL AS no_number, true AS has, 'brand,new,price,size' AS keys, 'x' AS replaced, 2 AS left_over FROM part
""", no_number="BIGINT"))
def dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries read by kind, put, replaced and taken out (survey Y1 to Y4)."""
    m = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), F.col("p_retailprice").cast("string"), F.lit("brand"), F.col("p_brand"))
    more = maps.insert(maps.insert(m, "new", F.lit("n")), "brand", F.lit("x"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        maps.get_int(m, "size").cast("int").alias("size"),
        maps.get_real(m, "price").alias("price"),
        maps.get_int(m, "brand").alias("no_number"),
        (maps.contains(m, "size") & ~maps.contains(m, "other")).alias("has"),
        F.array_join(F.sort_array(F.map_keys(more)), ",").alias("keys"),
        maps.get(more, "brand").alias("replaced"),
        F.size(maps.without(m, "size")).alias("left_over"),
    )


@query("""
WITH a AS (SELECT o_custkey, map_from_entries(list((o_orderpriority, n))) AS m FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey)
SELECT o_custkey, o_orderpriority AS label, 2 * count(*) AS n FROM orders GROUP BY ALL
""")
def absorbed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of counts as one."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    m = counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    return m.select("o_custkey", F.explode(maps.absorb(F.col("m"), F.col("m"))).alias("label", "n"))


def _valued(row: Row) -> bytes:
    """A file with an object of the row's values, and others that it leads to."""
    n, name = row["n"], row["name"]
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2), "Own": Ref(3)},
        2: {"Type": Name("Pages"), "Kids": [], "Count": 0},
        3: {"Whole": n - 20, "Real": n / 4, "Text": name.encode(), "Name": Name(name + "#"), "Yes": n % 2 == 0, "None": None, "List": [n, [Ref(4)], Name("a b")], "Ref": Ref(4)},
        4: [n, n + 1],
    }
    return writer.rewrite(objects, {"Root": Ref(1)}, packed=n % 3 == 0)


@query("""
SELECT p_partkey AS doc_id, p_size - 20 AS whole, p_size / 4.0 AS "real", lower(hex(p_name)) AS text, p_name || '#' AS name, p_size % 2 = 0 AS yes, 'a b' AS inner_name, 4 AS ref, p_size + 1 AS beyond, 'array' AS kind FROM part
""")
def object_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of objects of every kind, written and read, and what a reference leads to."""
    rows = pdf.read(files_of(_named(spark, sf_dir), _valued), "objects")
    own = rows.where(F.get_json_object("value", "$.Whole").isNotNull()).select("doc_id", F.col("value").alias("own"))
    other = rows.select("doc_id", "num", F.col("value").alias("other"), "kind")
    at = lambda p, c="own": F.get_json_object(c, p)
    own = own.withColumn("num", at("$.Ref.ref").cast("long"))
    return own.join(other, ["doc_id", "num"]).select(
        "doc_id", at("$.Whole").cast("int").alias("whole"), at("$.Real").cast("double").alias("real"), at("$.Text.hex").alias("text"), at("$.Name").alias("name"), at("$.Yes").cast("boolean").alias("yes"),
        at("$.List[2]").alias("inner_name"), F.col("num").cast("int").alias("ref"), at("$[1]", "other").cast("int").alias("beyond"), "kind",
    )


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("n"), F.col("p_name").alias("name"))


_FILES = """
f AS (SELECT o_orderstatus AS corpus, CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'passed' END AS outcome, CAST(o_orderkey % 5 AS INTEGER) AS pages,
  CASE WHEN o_orderkey % 3 = 0 THEN ['jbig2'] ELSE [] END AS capabilities, o_orderkey % 7 = 0 AS warned FROM orders)
"""


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("corpus"),
        k.cast("string").alias("path"),
        F.when(k % 11 == 0, "failed").otherwise("passed").alias("outcome"),
        (k % 5).cast("int").alias("pages"),
        F.when(k % 3 == 0, F.array(F.lit("jbig2"))).otherwise(F.expr("cast(array() as array<string>)")).alias("capabilities"),
        F.when(k % 7 == 0, F.create_map(F.lit("font"), F.lit(1))).otherwise(F.expr("cast(map() as map<string,int>)")).alias("warnings"),
    )


@query(f"""
WITH {_FILES}
SELECT path, corpus, outcome, pages, 'corpus,path,outcome,pages,warnings,capabilities' AS keys, len(capabilities) AS n_capabilities FROM f
""")
def file_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object a file, its keys in a fixed order, read back."""
    rows = files.report_json(_probed(spark, sf_dir))
    at = lambda p: F.get_json_object("json", p)
    keys = F.array_join(F.json_object_keys("json"), ",")
    n = F.size(F.from_json(at("$.capabilities"), "array<string>"))
    return rows.select("path", at("$.corpus").alias("corpus"), at("$.outcome").alias("outcome"), at("$.pages").cast("int").alias("pages"), keys.alias("keys"), n.cast("long").alias("n_capabilities"))


@query(f"""
WITH {_FILES}
SELECT corpus, count(*) AS total, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (warned) AS degraded, count(*) FILTER (len(capabilities) > 0) AS jbig2 FROM f GROUP BY corpus
""")
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact bar of each corpus, written and read."""
    rows = files.ratchet(_probed(spark, sf_dir))
    caps = rows.select("corpus", F.get_json_object("json", "$.degraded").cast("long").alias("degraded"), F.coalesce(F.get_json_object("json", "$.capabilities.jbig2").cast("long"), F.lit(0)).alias("jbig2"))
    return files.read_ratchet(rows).join(caps, "corpus")


@query("""
SELECT p_name AS name, 'http://x.test/' || p_partkey AS url, CASE WHEN p_size % 3 <> 0 THEN md5(p_name) END AS "commit", CASE WHEN p_size % 3 <> 0 THEN sha256(p_name) END AS sha256 FROM part WHERE p_size % 5 <> 0
""")
def lock_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name corpora, with comments, blanks and lines that are cut short."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    whole = F.concat_ws(" ", name, F.concat(F.lit("http://x.test/"), F.col("p_partkey").cast("string")), F.md5(F.col("p_name").cast("binary")), F.sha2("p_name", 256))
    short = F.concat_ws("\t", name, F.concat(F.lit("http://x.test/"), F.col("p_partkey").cast("string")))
    line = F.when(F.col("p_size") % 5 == 0, "# a note").when(F.col("p_size") % 3 == 0, short).otherwise(F.concat(whole, F.lit("  # kept")))
    rows = files.lock_entries(table(spark, sf_dir, "part").select(line.alias("value")))
    return rows.withColumn("name", F.replace("name", F.lit("_"), F.lit(" ")))


@query("""
WITH p AS (SELECT p_partkey, p_partkey * 31 % 16 AS r, p_partkey * 17 % 16 AS g, p_size % 16 AS b, p_size % 101 AS n FROM part)
SELECT p_partkey, CAST(r * 17 AS INTEGER) AS r, CAST(g * 17 AS INTEGER) AS g, CAST(b * 17 AS INTEGER) AS b, CAST(b * 17 AS INTEGER) AS a,
  CAST(floor(CASE WHEN n / 100.0 <= 0.0031308 THEN 12.92 * n / 100.0 ELSE 1.055 * pow(n / 100.0, 1 / 2.4) - 0.055 END * 255 + 0.5) AS INTEGER) AS light, 128 AS half, true AS refused FROM p
""")
def colour_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of one digit a channel, and of reals in linear light."""
    digit = lambda c: F.lower(F.hex(c))
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", (k * 31 % 16).alias("r"), (k * 17 % 16).alias("g"), (F.col("p_size") % 16).cast("long").alias("b"), (F.col("p_size") % 101).alias("n"))
    short = F.concat(F.lit("#"), digit(F.col("b")), digit(F.col("r")), digit(F.col("g")), digit(F.col("b")))
    real = F.concat(F.lit("sc# 0.5, "), (F.col("n") / 100).cast("string"), F.lit(",0,7"))
    refused = colour.parse_colour(F.lit("sc#1,2")).isNull() & colour.parse_colour(F.lit("sc#a,b,c")).isNull() & colour.parse_colour(F.lit("#12345")).isNull()
    rows = rows.select("p_partkey", colour.parse_colour(short).alias("c"), colour.parse_colour(real).alias("d"), refused.alias("refused"))
    return rows.select("p_partkey", "c.r", "c.g", "c.b", "c.a", F.col("d.r").alias("light"), F.col("d.a").alias("half"), "refused")


_MUL = "((%s) + 127) // 255"


@query(f"""
WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 5 AS BIGINT) AS cb, CAST(floor(l_extendedprice) AS BIGINT) % 256 AS cs FROM lineitem),
d AS (SELECT *, CASE WHEN cb <= 63 THEN {_MUL % (('(' + _MUL % 'greatest(0, cb * 16 - 3060) * cb' + ' + 1020) * cb'))} ELSE CAST(floor(sqrt(cb * 255)) AS BIGINT) END AS d FROM p)
SELECT l_orderkey, l_linenumber, CASE WHEN cs <= 127 THEN greatest(0, cb - {_MUL % ('(' + _MUL % '(255 - 2 * cs) * cb' + ') * (255 - cb)')}) ELSE cb + {_MUL % '(2 * cs - 255) * greatest(0, d - cb)'} END AS soft,
  round((cs / 255.0) * 3 - 1, 9) AS mapped FROM d
""")
def soft_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The soft light of bytes, and a linear map."""
    cb, cs = (F.col("l_quantity") * 5).cast("int"), F.floor("l_extendedprice").cast("int") % 256
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cb.alias("cb"), cs.alias("cs"))
    return rows.select("l_orderkey", "l_linenumber", colour.blend("SoftLight", F.col("cb"), F.col("cs")).cast("long").alias("soft"), F.round(colour.interpolate(F.col("cs").cast("double"), 0.0, 255.0, -1.0, 2.0), 9).alias("mapped"))


_LUM = "((%s[1] * 77 + %s[2] * 150 + %s[3] * 29) // 256)"


def _lum(c: str) -> str:
    return _LUM % (c, c, c)


@query(f"""
WITH p AS (SELECT p_partkey, [p_partkey * 31 % 256, p_partkey * 17 % 256, p_size * 5 % 256] AS b, [p_size * 3 % 256, p_partkey * 7 % 256, p_partkey * 13 % 256] AS s FROM part),
m AS (SELECT p_partkey, mode, CASE mode WHEN 'Color' THEN s ELSE b END AS c, CASE mode WHEN 'Color' THEN {_lum('b')} ELSE {_lum('s')} END AS light FROM p, (VALUES ('Color'), ('Luminosity')) AS t(mode)),
n AS (SELECT p_partkey, mode, list_transform(c, lambda v: v + light - {_lum('c')}) AS c FROM m),
u AS (SELECT p_partkey, mode, c, {_lum('c')} AS l, list_min(c) AS lo, list_max(c) AS hi FROM n),
w AS (SELECT p_partkey, mode, l, hi, CASE WHEN lo < 0 THEN list_transform(c, lambda v: l + CAST(floor((v - l) * l / (l - lo)::DOUBLE) AS BIGINT)) ELSE c END AS c FROM u),
x AS (SELECT p_partkey, mode, CASE WHEN hi > 255 THEN list_transform(c, lambda v: l + CAST(floor((v - l) * (255 - l) / (hi - l)::DOUBLE) AS BIGINT)) ELSE c END AS c FROM w)
SELECT p_partkey, mode, list_transform(c, lambda v: CAST(least(255, greatest(0, v)) AS INTEGER)) AS colour FROM x
""")
def whole_colour_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blend modes that look at all channels at once."""
    k, n = F.col("p_partkey"), F.col("p_size")
    b, s = F.array(k * 31 % 256, k * 17 % 256, n * 5 % 256), F.array(n * 3 % 256, k * 7 % 256, k * 13 % 256)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.transform(b, lambda x: x.cast("int")).alias("b"), F.transform(s, lambda x: x.cast("int")).alias("s"))
    out = None
    for mode in ("Color", "Luminosity"):
        part = rows.select("p_partkey", F.lit(mode).alias("mode"), colour.blend_nonseparable(mode, F.col("b"), F.col("s")).alias("colour"))
        out = part if out is None else out.union(part)
    return out


@query("""
WITH RECURSIVE l AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey + 1 END AS target FROM part),
w(node, "end", hops) AS (SELECT node, node, 0 FROM l UNION ALL SELECT w.node, l.target, hops + 1 FROM w JOIN l ON l.node = w."end" WHERE l.target IS NOT NULL AND hops < 32)
SELECT node, arg_max("end", hops) AS "end", max(hops) AS hops FROM w GROUP BY node
""")
def followed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where chains of references end."""
    k = F.col("p_partkey")
    links = table(spark, sf_dir, "part").select(k.alias("node"), F.when(k % 5 != 0, k + 1).alias("target"))
    return closure.follow(links, links.select("node"))


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text", "checkbox", "radio", "combo")]), (k % 4 + 1).cast("int"))
    name = F.when(k % 4 == 2, F.concat(F.lit("g."), k.cast("string"))).otherwise(F.concat(F.lit("f"), (k % 4).cast("string")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), k.alias("seq"), name.alias("name"), kind.alias("kind"), F.col("o_orderstatus").alias("value"), F.when(k % 8 == 0, "d").alias("default"), F.lit(0).cast("long").alias("flags"),
        F.expr("cast(array() as array<string>)").alias("options"), F.lit(None).cast("int").alias("max_len"), F.when(k % 3 == 0, -k).alias("calculated"),
    )


@query("""
WITH f AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, o_orderkey % 4 AS kind, o_orderstatus AS value, CASE WHEN o_orderkey % 8 = 0 THEN 'd' END AS "default", CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey END AS calculated FROM orders)
SELECT doc_id, seq, CASE WHEN kind = 1 THEN 'Yes' ELSE value END AS checked, CASE WHEN kind = 2 THEN CASE WHEN seq = 6 THEN '6' ELSE 'Off' END ELSE value END AS chosen,
  CASE WHEN kind IN (1, 2) THEN coalesce("default", 'Off') ELSE "default" END AS reset, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY calculated NULLS LAST, seq) AS INTEGER) AS turn FROM f
""")
def form_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes checked, one radio button of a group chosen, defaults restored, the order of calculation."""
    rows = _forms(spark, sf_dir)
    keys = ["doc_id", "seq"]
    checked = editing.set_checkbox(rows, "f1", True).select(*keys, F.col("value").alias("checked"))
    chosen = editing.select_radio(rows, "g", "6").select(*keys, F.col("value").alias("chosen"))
    reset = editing.reset_form(rows).select(*keys, F.col("value").alias("reset"))
    return editing.calculation_order(rows).select(*keys, "turn").join(checked, keys).join(chosen, keys).join(reset, keys)


@query("""
WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS num, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
n AS (SELECT doc_id, num, i + (i >= 1)::INT AS i FROM p UNION ALL SELECT DISTINCT doc_id, NULL, least(1, max(i) + 1) FROM p GROUP BY doc_id)
SELECT doc_id, num, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS page_index FROM n WHERE i % 2 = 1 OR i = 0
""")
def inserted_and_kept_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank page put in as the second one; then the first and every other page kept."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("num"), i.cast("int").alias("page_index"))
    pages = editing.insert_page(pages, 1, 100, 100)
    return editing.keep_pages(pages, pages.where("page_index % 2 = 1 or page_index = 0")).select("doc_id", "num", "page_index")


@query("""
SELECT l_orderkey AS doc_id, round(sum(l_quantity), 6) AS total, round(sum(l_quantity) * 2, 6) AS twice, sum(l_quantity) AS summed, round(avg(l_quantity), 9) AS mean, product(l_quantity) AS product, min(l_quantity) AS least, max(l_quantity) AS most, '€' || format('{:,.2f}', sum(l_quantity)) AS shown
FROM lineitem GROUP BY l_orderkey
""")
def recalculated_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that scripts calculate from others, in their order, all or nothing."""

    def make(row: Row) -> Any:
        inputs = [{"name": f"q{i}", "value": str(r["l_quantity"]), "seq": i, "calculated": None} for i, r in enumerate(row["rows"])]
        names = json.dumps([f["name"] for f in inputs])
        made = [
            {"name": "twice", "value": "", "seq": 98, "calculated": 1, "scripts": {"C": "event.value = getField('total').value * 2;"}},
            {"name": "total", "value": "", "seq": 99, "calculated": 0, "scripts": {"C": f"AFSimple_Calculate('SUM', {names.replace(chr(34), chr(39))});"}},
        ]
        values = scripts.recalculate(inputs + made)["values"]
        q = [r["l_quantity"] for r in row["rows"]]
        of = lambda what: scripts.calculate(what, q)
        yield {"doc_id": row["doc_id"], "total": round(float(values["total"]), 6), "twice": round(float(values["twice"]), 6), "summed": of("SUM"), "mean": round(of("AVG"), 9), "product": of("PRD"), "least": of("MIN"), "most": of("MAX"), "shown": scripts.format_number(of("SUM"), 2, 0, 0, "€", True)}

    rows = gathered(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")
    return mapped(rows, "doc_id long, total double, twice double, summed double, mean double, product double, least double, most double, shown string", make)


@query("""
WITH RECURSIVE p AS (SELECT p_partkey, p_size AS n, 10 AS room FROM part),
s(p_partkey, page, first, rest, n) AS (
  SELECT p_partkey, 0, 0, n, n FROM p
  UNION ALL
  SELECT p_partkey, page + 1, n - rest + t, rest - t, n FROM (SELECT *, CASE WHEN rest <= 10 THEN rest WHEN rest - 10 < 2 THEN rest - 2 ELSE 10 END AS t FROM s) WHERE rest > t)
SELECT p_partkey, page, CASE WHEN rest <= 10 THEN rest WHEN rest - 10 < 2 THEN rest - 2 ELSE 10 END AS "lines" FROM s
""")
def broken_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of as many lines as a part is large, over pages of ten: two lines at least go on to a page."""
    options = layout.Options(width=172.0, height=192.0, margin=36.0, size=10.0, leading=1.2)

    def make(row: Row) -> Any:
        text = "\n".join(f"line {k}" for k in range(row["p_size"]))
        runs = layout.paginate([layout.Box(text, white_space="pre")], options)
        pages: dict[int, int] = {}
        for r in runs:
            pages[r["page"]] = pages.get(r["page"], 0) + 1
        yield from ({"p_partkey": row["p_partkey"], "page": p, "lines": n} for p, n in pages.items())

    return mapped(spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")), "p_partkey long, page int, lines int", make)


@query("""
WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS n, c_custkey AS k, c_name AS name, c_mktsegment AS segment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT n AS doc_id, CAST(i AS INTEGER) AS part, 0 AS line, name AS text FROM c UNION ALL SELECT n, CAST(i AS INTEGER), 1, 'of the ' || segment || ' segment' FROM c
UNION ALL SELECT n + 1000, CAST(i AS INTEGER), 0, name FROM c UNION ALL SELECT n + 1000, CAST(i AS INTEGER), 1, segment FROM c
UNION ALL SELECT p_partkey + 10000, 0, 0, p_name FROM part UNION ALL SELECT p_partkey + 10000, 0, 1, 'a b' FROM part
UNION ALL SELECT p_partkey + 1000000, 0, 0, p_name FROM part
""")
def any_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of files whatever they are: books, fixed documents, pages of HTML and PDF files in one table."""

    def page(row: Row) -> bytes:
        b = Builder()
        b.page()
        b.text(50, 700, row["name"])
        return b.finish()

    customers = archive_queries._customers(spark, sf_dir)
    books = files_of(customers, archive_queries.catalogue)
    fixed = files_of(customers, archive_queries.fixed_document).withColumn("doc_id", F.col("doc_id") + 1000)
    parts = _named(spark, sf_dir)
    html = F.concat(F.lit("<!DOCTYPE html><html><head><title>x</title></head><body><p>"), "name", F.lit("</p><div>a <b>b</b></div><script>no</script></body></html>"))
    htmls = parts.select((F.col("doc_id") + 10000).alias("doc_id"), html.cast("binary").alias("content"))
    pdfs = files_of(parts, page).withColumn("doc_id", F.col("doc_id") + 1000000)
    junk = parts.select((-F.col("doc_id")).alias("doc_id"), F.lit("nothing").cast("binary").alias("content"))
    return any_file.text(books.union(fixed).union(spread(htmls)).union(pdfs).union(spread(junk))).drop("error")
