"""Queries over layout: boxes, tables, flexible boxes, floats, text and books as pages."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import breaking, geometry
from docloom.functions import bytes as by
from docloom.functions import text as tx
from docloom.operators import grouping, layout
from docloom.plans import archive_queries
from docloom.plans.fixtures import Row, files_of, gathered, inside, mapped, spread
from docloom.plans.registry import query, table, typed
from docloom.sources import raster, synthesis, truetype
from docloom.sources.pdf import semantics
from docloom.sources.pdf import tables as pdf
from docloom.sources.pdf.document import Document
from docloom.sources.pdf.writer import Builder


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gathered(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", "l_partkey")


_LINES = """
l AS (SELECT l_orderkey AS doc_id, l_linenumber AS k, l_quantity AS q, l_partkey AS p, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey))
"""


@query(typed(f"""
WITH {_LINES}, s AS (SELECT *, sum(q) OVER d AS basis, sum(1 + k % 3) OVER d AS growth FROM l WINDOW d AS (PARTITION BY doc_id))
SELECT doc_id, i AS item, round(q + (1000 - basis) * (1 + k % 3) / growth, 6) AS grown, round(q / 2, 6) AS shrunk, CASE WHEN n = 1 THEN 20.0 WHEN i = 0 THEN 20.0 ELSE round((1000.0 - 20) / (n - 1), 6) END AS capped FROM s
""", item="INTEGER"))
def flex_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flexible boxes that grow by their shares, shrink by their sizes, and freeze at a bound (survey M30, L2)."""

    def make(row: Row) -> Any:
        items = row["rows"]
        q, wide = [r["l_quantity"] for r in items], (0.0, 1e9)
        grown = layout.flex([(r["l_quantity"], 1 + r["l_linenumber"] % 3, 1, *wide) for r in items], 1000)
        shrunk = layout.flex([(x, 0, 1, *wide) for x in q], sum(q) / 2)
        capped = layout.flex([(0.0, 1, 1, 0.0, 20.0 if i == 0 else 1e9) for i in range(len(q))], 1000)
        yield from ({"doc_id": row["doc_id"], "item": i, "grown": round(a, 6), "shrunk": round(b, 6), "capped": round(c, 6)} for i, (a, b, c) in enumerate(zip(grown, shrunk, capped, strict=True)))

    return mapped(_lines(spark, sf_dir), "doc_id long, item int, grown double, shrunk double, capped double", make)


@query("""
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS free, 1 + p_partkey % 4 AS n FROM part)
SELECT p_partkey, kind, CASE kind WHEN 'end' THEN free WHEN 'center' THEN free / 2 WHEN 'space-around' THEN free / n / 2 WHEN 'space-evenly' THEN free / (n + 1) ELSE 0 END AS "offset",
  CASE WHEN kind = 'space-between' AND n > 1 THEN free / (n - 1) WHEN kind = 'space-around' THEN free / n WHEN kind = 'space-evenly' THEN free / (n + 1) ELSE 0 END AS gap
FROM p, (VALUES ('start'), ('end'), ('center'), ('space-between'), ('space-around'), ('space-evenly')) AS k(kind)
""")
def justified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where free space goes between boxes."""

    def make(row: Row) -> Any:
        for kind in ("start", "end", "center", "space-between", "space-around", "space-evenly"):
            offset, gap = layout.justify(kind, float(row["p_size"]), 1 + row["p_partkey"] % 4)
            yield {"p_partkey": row["p_partkey"], "kind": kind, "offset": offset, "gap": gap}

    return mapped(spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")), "p_partkey long, kind string, offset double, gap double", make)


@query(f"""
WITH {_LINES}, c AS (SELECT doc_id, k % 3 AS col, max(q) AS lo, max(q) + 10 AS hi FROM l GROUP BY ALL),
a AS (SELECT doc_id, t.col, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi FROM (SELECT DISTINCT doc_id FROM l) d CROSS JOIN (VALUES (0), (1), (2)) AS t(col) LEFT JOIN c USING (doc_id, col)),
s AS (SELECT *, sum(lo) OVER d AS low, sum(hi) OVER d AS high FROM a WINDOW d AS (PARTITION BY doc_id))
SELECT doc_id, col AS "column", round(lo + (hi - lo) * 0.5, 6) AS half, round(hi + 100 * hi / high, 6) AS wide, round(least(high, 60), 6) AS automatic FROM s WHERE low <= 60
UNION ALL SELECT doc_id, col, round(lo + (hi - lo) * 0.5, 6), round(hi + 100 * hi / high, 6), round(low, 6) FROM s WHERE low > 60
""")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of tables from their cells: least and greatest widths, what is left shared, the table's own width."""

    def make(row: Row) -> Any:
        found = layout.column_constraints(3, [(r["l_linenumber"] % 3, 1, r["l_quantity"], r["l_quantity"] + 10) for r in row["rows"]])
        low, high = sum(c[0] for c in found), sum(c[1] for c in found)
        half, wide = layout.distribute(found, (low + high) / 2), layout.distribute(found, high + 100)
        yield from ({"doc_id": row["doc_id"], "column": i, "half": round(half[i], 6), "wide": round(wide[i], 6), "automatic": round(layout.automatic_width(found, 60), 6)} for i in range(3))

    return mapped(_lines(spark, sf_dir), "doc_id long, column int, half double, wide double, automatic double", make)


@query(f"""
WITH {_LINES}, a AS (SELECT *, 1 + CAST(q AS INTEGER) % 2 AS across, 1 + p % 2 AS down FROM l),
b AS (SELECT *, coalesce(sum(across) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a0 FROM a),
u AS (SELECT doc_id, unnest(range(a0, a0 + across)) AS col FROM b WHERE down = 1 UNION ALL SELECT doc_id, unnest(range(m, m + n)) FROM (SELECT doc_id, max(a0 + across) AS m, max(n) AS n FROM b GROUP BY doc_id)),
f AS (SELECT doc_id, col, row_number() OVER (PARTITION BY doc_id ORDER BY col) - 1 AS i FROM u)
SELECT doc_id, 0 AS "row", i AS cell, a0 AS "column" FROM b UNION ALL SELECT f.doc_id, 1, f.i, f.col FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i
""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of cells under cells that reach down into their row."""

    def make(row: Row) -> Any:
        cells = row["rows"]
        above = [(1 + int(r["l_quantity"]) % 2, 1 + r["l_partkey"] % 2) for r in cells]
        for r, places in enumerate(layout.place_cells([above, [(1, 1)] * len(cells)])):
            yield from ({"doc_id": row["doc_id"], "row": r, "cell": i, "column": at} for i, at in enumerate(places))

    return mapped(_lines(spark, sf_dir), "doc_id long, row int, cell long, column long", make)


@query(f"""
WITH {_LINES}, s(style, rank) AS (VALUES ('none', 0), ('inset', 1), ('dotted', 5), ('dashed', 6), ('solid', 7)),
e AS (SELECT doc_id, CAST(q AS INTEGER) % 5 AS width, (['none', 'inset', 'dotted', 'dashed', 'solid'])[p % 5 + 1] AS style, i AS source FROM l)
SELECT doc_id, CAST(width AS DOUBLE) AS width, style, source FROM e JOIN s USING (style) WHERE style <> 'none' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY width DESC, rank DESC, source) = 1
""")
def collapsed_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The border that wins where several meet."""

    def make(row: Row) -> Any:
        edges = [(float(int(r["l_quantity"]) % 5), ("none", "inset", "dotted", "dashed", "solid")[r["l_partkey"] % 5], i) for i, r in enumerate(row["rows"])]
        if (won := layout.collapse_borders(edges)) is not None:
            yield {"doc_id": row["doc_id"], "width": won[0], "style": won[1], "source": won[2]}

    return mapped(_lines(spark, sf_dir), "doc_id long, width double, style string, source long", make)


@query(typed(f"""
WITH {_LINES}
SELECT doc_id, i AS item, CASE WHEN i % 3 = 2 THEN 70.0 ELSE 30.0 * (i % 3) END AS x, CAST(20 * (i // 3) AS DOUBLE) AS y, CAST(20 * ((n + 2) // 3) AS DOUBLE) AS cleared FROM l
""", x="DOUBLE"))
def float_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that float to either side, and where what clears them goes on (L4)."""

    def make(row: Row) -> Any:
        floats = layout.Floats(100.0, [])
        places = [floats.place("right" if i % 3 == 2 else "left", 30.0, 20.0, 0.0) for i in range(len(row["rows"]))]
        cleared = floats.clear("both", 0.0)
        yield from ({"doc_id": row["doc_id"], "item": i, "x": x, "y": y, "cleared": cleared} for i, (x, y) in enumerate(places))

    return mapped(_lines(spark, sf_dir), "doc_id long, item long, x double, y double, cleared double", make)


@query(typed("""
WITH w AS (SELECT p_partkey, p_name || ' ' || p_type || chr(10) || p_brand AS text FROM part)
SELECT p_partkey, i AS place, i = length(text) OR text[i:i] = chr(10) AS mandatory FROM (SELECT p_partkey, text, unnest(range(1, length(text) + 1)) AS i FROM w)
WHERE i = length(text) OR text[i:i] = chr(10) OR (text[i:i] = ' ' AND text[i + 1:i + 1] <> ' ')
""", place="INTEGER"))
def line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where lines of plain words may end and where they have to."""

    def make(row: Row) -> Any:
        yield from ({"p_partkey": row["p_partkey"], "place": at, "mandatory": must} for at, must in breaking.opportunities(row["text"]))

    words = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_type", F.lit("\n"), "p_brand").alias("text"))
    return mapped(words, "p_partkey long, place int, mandatory boolean", make)


@query(r"""
SELECT doc_id, string_split(text, chr(10))[1] AS first, len(string_split(text, chr(10))) AS lines, md5(text || chr(10)) AS digest FROM documents
""")
def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines taken apart and joined again, each with its line feed."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.split_lines(F.col("text")).alias("lines"))
    return rows.select("doc_id", F.col("lines")[0].alias("first"), F.size("lines").cast("long").alias("lines"), F.md5(tx.plain_text(F.col("lines"))).alias("digest"))


_ROMAN = "['','i','ii','iii','iv','v','vi','vii','viii','ix'][n % 10 + 1]"


@query(f"""
WITH p AS (SELECT p_partkey, p_size AS n FROM part)
SELECT p_partkey, n || '.' AS "decimal", ['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'][n // 10 + 1] || {_ROMAN} || '.' AS roman,
  CASE WHEN n <= 26 THEN chr(64 + n) ELSE chr(64 + (n - 1) // 26) || chr(65 + (n - 1) % 26) END || '.' AS letters, '•' AS disc, '' AS nothing, '◦' AS circle FROM p
""")
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of list items by kind and number."""
    n = F.col("p_size")
    kinds = {"decimal": "decimal", "roman": "lower-roman", "letters": "upper-alpha", "disc": "unheard-of", "nothing": "none", "circle": "circle"}
    return table(spark, sf_dir, "part").select("p_partkey", *[tx.list_marker(F.lit(kind), n).alias(name) for name, kind in kinds.items()])


@query("""
SELECT p_partkey, mode, mode IN ('normal', 'nowrap', 'pre-line') AS collapses, mode IN ('pre', 'pre-wrap', 'pre-line') AS breaks, mode IN ('normal', 'pre-wrap', 'pre-line') AS wraps
FROM part, (VALUES ('normal'), ('nowrap'), ('pre'), ('pre-wrap'), ('pre-line')) AS m(mode)
""")
def white_space_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each way to treat white space does."""
    modes = F.explode(F.array(*[F.lit(x) for x in ("normal", "nowrap", "pre", "pre-wrap", "pre-line")]))
    rows = table(spark, sf_dir, "part").select("p_partkey", modes.alias("mode"))
    m = F.col("mode")
    return rows.select("p_partkey", "mode", tx.collapses(m).alias("collapses"), tx.preserves_breaks(m).alias("breaks"), tx.wraps(m).alias("wraps"))


@query(r"""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '<' || lower(hex(c_name || 'é')) || '>' ELSE '(' || c_name || ')' END AS shown, c_name || ' é+' AS percent, c_name || 'é' AS utf16, c_name || 'é' AS utf8, c_name || '•' AS plain, c_mktsegment || chr(10) AS fold FROM customer
""")
def byte_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as they are shown, percent signs and text strings of three encodings decoded."""
    name = F.col("c_name")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.encode(F.concat(name, F.lit("é")), "UTF-8")).otherwise(F.encode(name, "UTF-8"))
    coded = F.concat(F.replace(name, F.lit("#"), F.lit("%23")), F.lit("%20%C3%A9+"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        tx.show_bytes(raw).alias("shown"),
        tx.percent_decode(coded).alias("percent"),
        tx.decode_text_string(F.concat(F.unhex(F.lit("FEFF")), F.encode(F.concat(name, F.lit("é")), "UTF-16BE"))).alias("utf16"),
        tx.decode_text_string(F.concat(F.unhex(F.lit("EFBBBF")), F.encode(F.concat(name, F.lit("é")), "UTF-8"))).alias("utf8"),
        tx.decode_text_string(F.concat(F.encode(name, "UTF-8"), F.unhex(F.lit("80")))).alias("plain"),
        tx.fold_case(F.concat(F.lower("c_mktsegment"), F.lit("\n"))).alias("fold"),
    ).withColumn("fold", F.upper("fold"))


@query("""
SELECT page_id, regexp_matches(lower(url), '/[^/]+\\.(jpg|jpeg|png|gif)$') AS claims, 'Ω/' || page_id AS name FROM pages
""")
def claimed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ends of names claim, where there are no bytes to see."""
    return table(spark, sf_dir, "pages").select("page_id", by.claims_image(F.col("url")).alias("claims"), F.concat(F.lit("Ω/"), F.col("page_id").cast("string")).alias("name"))


@query("""
SELECT p_partkey, part, regexp_matches(part, '^(/[A-Za-z0-9_%.-]*[A-Za-z0-9_%-])+$') AND NOT regexp_matches(lower(part), '%2f|%5c') AS legal FROM (
  SELECT p_partkey, '/' || replace(p_name, ' ', '/') || (['', '.', '/', '%2F', '.xml', '%41'])[p_size % 6 + 1] AS part FROM part)
""")
def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that parts of a package may have."""
    ends = F.element_at(F.array(*[F.lit(x) for x in ("", ".", "/", "%2F", ".xml", "%41")]), F.col("p_size") % 6 + 1)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), ends).alias("part"))
    return rows.select("p_partkey", "part", by.part_name_is_legal(F.col("part")).alias("legal"))


@query("""
SELECT l_orderkey, CAST(min(l_quantity) AS DOUBLE) AS x0, CAST(max(l_quantity) AS DOUBLE) AS x1, CAST(min(l_linenumber) AS DOUBLE) AS y0, CAST(max(l_linenumber) AS DOUBLE) AS y1,
  CASE WHEN l_orderkey % 4 IN (1, 3) THEN max(l_linenumber) - min(l_linenumber) ELSE max(l_quantity) - min(l_quantity) END AS shown_width FROM lineitem GROUP BY l_orderkey
""")
def path_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of points, those that aren't finite left out, and how wide they are shown when turned."""
    nan = F.lit(float("nan"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("xs"), F.collect_list(F.col("l_linenumber").cast("double")).alias("ys"))
    box = geometry.path_bounds(F.concat("xs", F.array(nan)), F.concat("ys", F.array(F.lit(float("inf")))))
    shown = geometry.display_size(box, F.col("l_orderkey") % 4 * 90)
    return rows.select("l_orderkey", *[box[c].alias(c) for c in ("x0", "x1", "y0", "y1")], shown["width"].alias("shown_width"))


@query("""
WITH e AS (SELECT user_id AS doc_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line, CAST(event_id % 50 AS DOUBLE) AS y FROM events)
SELECT doc_id, line, CAST(sum(b) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS block FROM (SELECT *, coalesce((abs(lag(y) OVER (PARTITION BY doc_id ORDER BY line) - y) > 15)::INT, 0) AS b FROM e)
""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of lines: a step of over one and a half lines ends one."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit(0).alias("page_index"), (F.row_number().over(w) - 1).cast("long").alias("line"), (F.col("event_id") % 50).cast("double").alias("y"), F.lit(10.0).alias("size"))
    return grouping.text_blocks(rows).select("doc_id", "line", "block")


# --- books as pages ---


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.to_pdf(archive_queries._catalogues(spark, sf_dir))


@query("""
WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer)
SELECT doc_id, 'epub' AS kind, count(*) AS chapters, 'Nation ' || doc_id AS title, CAST(sum(length(replace(name || 'ofthe' || segment || 'segment', ' ', ''))) AS BIGINT) AS chars FROM c GROUP BY doc_id
""")
def books_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-books as PDF files: pages of every chapter, and all characters of all of them."""

    def look(row: Row) -> Any:
        doc = Document(row["content"])
        chars = sum(len(re.sub(r"\s", "", r["text"], flags=re.ASCII)) for r in pdf.TABLES["text_lines"][1](doc))
        yield {"doc_id": row["doc_id"], "kind": row["kind"], "chapters": len({o["source"] for o in row["origins"]}), "chars": chars, "title": semantics.metadata(doc)["Title"]}

    return mapped(_converted(spark, sf_dir).select("doc_id", "kind", "content", "origins"), "doc_id long, kind string, chapters long, chars long, title string", look)


@query("""
WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS k, c_name AS name, c_mktsegment AS segment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS page FROM customer)
SELECT doc_id, name AS title, 'b/text/c ' || k || '.xhtml' AS source FROM c
""")
def book_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a table of contents lead to the page where their target is laid out."""

    def look(row: Row) -> Any:
        for entry in pdf.TABLES["outline"][1](Document(row["content"])):
            page = entry["page"]
            yield {"doc_id": row["doc_id"], "title": entry["title"], "source": row["origins"][page]["source"] if page is not None else None}

    return mapped(_converted(spark, sf_dir).select("doc_id", "content", "origins"), "doc_id long, title string, source string", look)


@query(typed("""
WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS k, c_name AS name, c_mktsegment AS segment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS page FROM customer)
SELECT doc_id, CAST(page AS INTEGER) AS page_index, line, text, y FROM (
  SELECT doc_id, page, 0 AS line, name AS text, 750 - (100 + k % 7) * 0.75 AS y FROM c UNION ALL SELECT doc_id, page, 1, segment, 600.0 FROM c)
""", y="DOUBLE"))
def fixed_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed documents as PDF files, their runs where they were."""
    files = synthesis.to_pdf(files_of(archive_queries._customers(spark, sf_dir), archive_queries.fixed_document))
    rows = pdf.read(files.select("doc_id", "content"), "text_lines")
    return rows.select("doc_id", "page_index", "line", "text", F.round("y0", 4).alias("y"))


@query(typed("""
SELECT CAST(substr(p_brand, 7) AS BIGINT) AS doc_id, 'comic' AS kind, count(*) AS pages, 4.0 AS width, 2.0 AS height FROM part GROUP BY ALL
""", width="DOUBLE", height="DOUBLE"))
def comics_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comics as PDF files, pages of their pictures' sizes."""
    import numpy as np

    picture = raster.images.png_encode(np.zeros((2, 4, 1), np.uint8))

    def make(row: Row) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for r in row["rows"]:
                z.writestr(f"{r['p_partkey']}.png", picture)
        return out.getvalue()

    rows = table(spark, sf_dir, "part").withColumn("brand", F.substring("p_brand", 7, 9).cast("long"))
    files = synthesis.to_pdf(files_of(gathered(rows, "brand", "p_partkey", "p_size"), make))

    def look(row: Row) -> Any:
        boxes = [r["media_box"] for r in pdf.TABLES["pages"][1](Document(row["content"]))]
        yield {k: row[k] for k in ("doc_id", "kind", "pages")} | {"width": max(b["x1"] for b in boxes), "height": max(b["y1"] for b in boxes)}

    return mapped(files.select("doc_id", "kind", "pages", "content"), "doc_id long, kind string, pages long, width double, height double", look)


@query("""
WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT doc_id, CAST(i AS INTEGER) AS page, CASE WHEN i + 1 < n THEN 'GoTo' ELSE 'URI' END AS action, CASE WHEN i + 1 < n THEN NULL ELSE 'http://shop.test/' || k END AS target, CAST(CASE WHEN i + 1 < n THEN i + 1 END AS INTEGER) AS to_page FROM c
""")
def book_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of chapters lead to the pages of other chapters, and out of the book."""

    def make(row: Row) -> bytes:
        raw, rows = archive_queries.catalogue(row | {"doc_id": 1}), row["rows"]
        out = io.BytesIO()
        following = {r["c_custkey"]: (f"c%20{s['c_custkey']}.xhtml#top") for r, s in zip(rows, rows[1:], strict=False)}
        with zipfile.ZipFile(io.BytesIO(raw)) as old, zipfile.ZipFile(out, "w") as new:
            for name in old.namelist():
                body = old.read(name)
                if m := re.fullmatch(r"b/text/c (\d+)\.xhtml", name):
                    k = int(m[1])
                    body = body.replace(b"</body>", f'<p><a href="{following.get(k, f"http://shop.test/{k}")}">on</a></p></body>'.encode())
                new.writestr(name, body)
        return out.getvalue()

    files = synthesis.to_pdf(files_of(archive_queries._customers(spark, sf_dir), make))
    return pdf.read(files.select("doc_id", "content"), "links").select("doc_id", "page", "action", "target", "to_page")


# --- font programs ---


def _square(width: int) -> bytes:
    """A glyph of one contour: a square as wide as that."""
    points = [(0, 0), (width, 0), (0, width), (-width, 0)]
    return struct.pack(">hhhhh", 1, 0, 0, width, width) + struct.pack(">HH", 3, 0) + b"\1" * 4 + b"".join(struct.pack(">h", x) for x, _ in points) + b"".join(struct.pack(">h", y) for _, y in points)


def _program(width: int) -> bytes:
    """A font of A, a square, B, two of them, and C, a square of its own."""
    pair = struct.pack(">hhhhh", -1, 0, 0, 0, 0) + struct.pack(">HHbb", 0x22, 1, 0, 0) + struct.pack(">HHbb", 0x02, 1, 100, 0)
    glyphs, glyf, loca = [b"", _square(width), pair, _square(width // 2)], b"", [0]
    for g in glyphs:
        glyf += g + b"\0" * (-len(g) % 4)
        loca.append(len(glyf))
    cmap = struct.pack(">HHHHI", 0, 1, 1, 0, 12) + struct.pack(">HHH", 0, 262, 0) + bytes(65) + bytes([1, 2, 3]) + bytes(188)
    head = bytearray(54)
    struct.pack_into(">H", head, 18, 1000)
    struct.pack_into(">h", head, 50, 1)
    return truetype.assemble({"head": bytes(head), "glyf": glyf, "loca": struct.pack(">5I", *loca), "cmap": cmap, "hhea": struct.pack(">I hh 26x H", 0x10000, 800, -200, 2), "hmtx": struct.pack(">HhHh", 250, 0, 600, 0)})


@query(typed("""
SELECT p_partkey AS doc_id, 'ABC' AS text, 3 AS kept, 600.0 AS width, 0 AS missing, true AS smaller, CAST(ceil((p_size * 10 + 100) / 50.0) * ceil((p_size * 10 + 100) / 50.0) AS INTEGER) // 1000 AS dark FROM part
""", width="DOUBLE"))
def font_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts embedded whole and as subsets with the parts that glyphs are made of, shown and read back."""

    def make(row: Row) -> Any:
        f = truetype.Font(_program(row["n"] * 10 + 100))
        small = truetype.Font(f.subset([2]))
        b = Builder()
        b.page(100, 100)
        truetype.embed(b, "E", "Mine", f.program)
        truetype.embed_cid(b, "C", "Mine", f.program, "ABC")
        missing = truetype.show(b, "C", f, 10, 50, "ABC", 20)
        doc = Document(b.finish())
        pixels, _ = raster.render(doc, doc.pages()[0][1])
        kept = sum(bool(small.outline(g)) for g in (1, 2)) + (not small.outline(3))
        yield {"doc_id": row["doc_id"], "text": next(pdf.TABLES["text_lines"][1](doc))["text"], "kept": kept, "width": f.width(1), "missing": missing, "smaller": len(small.program) < len(f.program), "dark": int((pixels[..., 0] < 128).sum()) // 10000}

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("n"))
    return mapped(spread(rows), "doc_id long, text string, kept int, width double, missing int, smaller boolean, dark int", make)


@query("SELECT p_partkey AS doc_id, md5(p_name) AS digest, length(p_name) AS size, 'a.txt' AS name, 2 AS n_pages, p_name AS title FROM part")
def built_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the builder writes, packed and not, with the same in them."""

    def make(row: Row) -> bytes:
        b = Builder(info={"Title": row["name"]}, attachments=[("a.txt", row["name"].encode())])
        b.page()
        b.page()
        return b.finish(packed=row["n"] % 2 == 0)

    def look(doc: Document) -> Any:
        a = semantics.attachments(doc)[0]
        yield {"digest": hashlib.md5(semantics.payload(doc, a["num"]) or b"").hexdigest(), "size": a["size"], "name": a["name"], "n_pages": len(doc.pages()), "title": semantics.metadata(doc)["Title"]}

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("n"), F.col("p_name").alias("name"))
    return inside(files_of(rows, make), "digest string, size long, name string, n_pages int, title string", look)


@query("""
SELECT p_partkey, true AS same, p_size % 2 = 0 AS other FROM part
""")
def font_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of families that quotes, spaces and case don't tell apart."""
    brand = F.col("p_brand")
    quoted = F.concat(F.lit(' "'), F.upper(F.replace(brand, F.lit("#"), F.lit("  "))), F.lit('"'))
    plain = F.replace(brand, F.lit("#"), F.lit(" "))
    other = F.when(F.col("p_size") % 2 == 0, F.lower(plain)).otherwise(F.concat(plain, F.lit("x")))
    return table(spark, sf_dir, "part").select("p_partkey", tx.same_family(plain, quoted).alias("same"), tx.same_family(plain, other).alias("other"))


@query("SELECT p_partkey, p_size % 3 = 0 AS skipped FROM part")
def table_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space between a table's parts makes no box; text there and white space elsewhere does."""
    n = F.col("p_size") % 3
    parent = F.when(n == 2, "p").otherwise("tr")
    text = F.when(n == 1, F.concat(F.lit(" "), "p_name")).otherwise(" \n\t")
    return table(spark, sf_dir, "part").select("p_partkey", tx.between_rows(parent, text).alias("skipped"))


@query(f"""
WITH {_LINES}, d AS (SELECT doc_id, i, CAST(q AS INTEGER) % 2 AS is_cell FROM l),
b AS (SELECT doc_id, i, is_cell, CASE WHEN is_cell = 1 OR lag(is_cell) OVER w IS NULL OR lag(is_cell) OVER w = 1 THEN 1 ELSE 0 END AS opens FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, 1 AS table_rows, CAST(sum(opens) AS BIGINT) AS cells, count(*) AS boxes FROM b GROUP BY doc_id
""")
def anonymous_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose children are no rows, and partly no cells, get the boxes that are missing."""

    def make(row: Row) -> Any:
        rows = layout.whole_table([("table-cell" if int(r["l_quantity"]) % 2 else "inline", i) for i, r in enumerate(row["rows"])])
        yield {"doc_id": row["doc_id"], "table_rows": len(rows), "cells": sum(map(len, rows)), "boxes": sum(len(c) for r in rows for c in r)}

    return mapped(_lines(spark, sf_dir), "doc_id long, table_rows int, cells long, boxes long", make)


@query("""
SELECT p_partkey, replace(p_brand, '#', '') AS family, p_size % 2 = 0 OR p_size % 5 = 0 AS bold, p_size % 3 = 0 AS italic, false AS serif, p_size % 7 = 0 AS fixed FROM part
""")
def face_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fonts ask of a host, by their names and flags."""
    from docloom.sources.pdf.fonts import face_request

    def make(row: Row) -> Any:
        n = row["p_size"]
        name = "ABCDEF+" + row["p_brand"].replace("#", "") + ("-Bold" if n % 2 == 0 else "-") + ("Italic" if n % 3 == 0 else "")
        yield {"p_partkey": row["p_partkey"], **face_request(name, (1 if n % 7 == 0 else 0) | (1 << 18 if n % 5 == 0 else 0))}

    return mapped(spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")), "p_partkey long, family string, bold boolean, italic boolean, serif boolean, fixed boolean", make)


@query("""
WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, count(*) AS n FROM customer GROUP BY ALL)
SELECT doc_id, property, n AS elements FROM c, (VALUES ('color'), ('margin'), ('font-weight')) AS p(property)
""")
def property_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each book have each property declared."""
    from docloom.sources import archive

    def make(row: Row) -> Any:
        raw = archive_queries.catalogue(row | {"doc_id": 1})
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(raw)) as old, zipfile.ZipFile(out, "w") as new:
            for name in old.namelist():
                body = old.read(name).replace(b"<p>", b'<p style="color: red; margin: 0">').replace(b"</head>", b"<style>b { font-weight: bold } i { color: blue }</style></head>")
                new.writestr(name, body)
        yield from ({"doc_id": row["doc_id"], "property": k, "elements": v} for k, v in synthesis.census(archive.Archive(out.getvalue())).items())

    customers = archive_queries._customers(spark, sf_dir)
    return mapped(customers.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id long, property string, elements long", make)


@query("""
SELECT p_partkey, 6 AS operators, p_size % 2 = 0 AS even_odd, CAST(p_size AS DOUBLE) AS width, CAST(p_size AS DOUBLE) / 2 AS height FROM part
""")
def path_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in the short syntax, absolute and relative, with half circles."""
    from docloom.sources import paths

    def make(row: Row) -> Any:
        n = row["p_size"]
        even_odd, found = paths.parse(f"F{0 if n % 2 == 0 else 1} M0,{n / 2} a{n / 2},{n / 2} 0 0 1 {n},0 l-{n},0 h0 z")
        points = [p for line, _ in raster.flatten(found) for p in line]
        xs, ys = [x for x, _ in points], [y for _, y in points]
        yield {"p_partkey": row["p_partkey"], "operators": len(found), "even_odd": even_odd, "width": round(max(xs) - min(xs), 3), "height": round(max(ys) - min(ys), 3)}

    return mapped(spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")), "p_partkey long, operators int, even_odd boolean, width double, height double", make)
