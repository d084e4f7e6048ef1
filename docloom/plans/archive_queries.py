"""Queries over e-books, fixed documents, comics and markup that are written from customers and parts, and read back."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.fixtures import Row, files_of, gathered, mapped, spread
from docloom.plans.registry import query, table, typed
from docloom.sources import archive, css, images, xml

_CUSTOMERS = """
c AS (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS k, c_name AS name, c_mktsegment AS segment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer)
"""


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gathered(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_name", "c_mktsegment")


def _font(doc_id: int) -> bytes:
    return (b"font of %d " % doc_id) * 200


def _uuid(doc_id: int) -> str:
    d = hashlib.md5(b"%d" % doc_id).hexdigest()
    return f"urn:uuid:{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:]}"


def _zip(parts: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, body) in enumerate(parts):
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED if i else zipfile.ZIP_STORED)
    return out.getvalue()


def catalogue(row: Row) -> bytes:
    """An e-book of a nation: a chapter a customer, with navigation of either kind, a hidden font, fallbacks and layouts."""
    doc_id, rows = row["doc_id"], row["rows"]
    even = doc_id % 2 == 0
    chapter = lambda r: f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title><meta name="viewport" content="width={100 + r["c_custkey"] % 50}, height=200"/></head><body><h1 id="top">{r["c_name"]}</h1><p>of  the\n{r["c_mktsegment"]} <b>segment</b></p></body></html>'
    items, refs, parts = "", "", []
    for r in rows:
        k = r["c_custkey"]
        odd = k % 5 == 0  # a kind that no reader shows, with the chapter as its fallback
        items += (f'<item id="x{k}" href="x{k}.bin" media-type="application/x-odd" fallback="c{k}"/>' if odd else "") + f'<item id="c{k}" href="text/c%20{k}.xhtml" media-type="application/xhtml+xml"/>'
        refs += f'<itemref idref="{"x" if odd else "c"}{k}"' + (' linear="no"' if k % 7 == 0 else "") + (' properties="rendition:layout-reflowable"' if k % 4 == 0 else "") + "/>"
        parts.append((f"b/text/c {k}.xhtml", chapter(r).encode()))
    segments: dict[str, list[Row]] = {}
    for r in rows:
        segments.setdefault(r["c_mktsegment"], []).append(r)
    if even:
        lists = "".join(f"<li><span>{s}</span><ol>" + "".join(f'<li><a href="text/c%20{r["c_custkey"]}.xhtml#top">{r["c_name"]}</a></li>' for r in some) + "</ol></li>" for s, some in sorted(segments.items()))
        nav = ("b/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{lists}</ol></nav></body></html>'.encode())
        items += '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
    else:
        point = lambda text, src, inner="": f"<navPoint><navLabel><text>{text}</text></navLabel>{src}{inner}</navPoint>"
        lists = "".join(point(s, "", "".join(point(r["c_name"], f'<content src="text/c%20{r["c_custkey"]}.xhtml#top"/>') for r in some)) for s, some in sorted(segments.items()))
        nav = ("b/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{lists}</navMap></ncx>'.encode())
        items += '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
    method = "http://www.idpf.org/2008/embedding" if even else "http://ns.adobe.com/pdf/enc#RC"
    layout = '<meta property="rendition:layout">pre-paginated</meta>' if doc_id % 3 == 0 else ""
    package = f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" unique-identifier="uid"><metadata><dc:identifier id="uid">{_uuid(doc_id)}</dc:identifier><dc:title>Nation {doc_id}</dc:title>{layout}</metadata><manifest>{items}</manifest><spine{"" if even else " toc=" + chr(34) + "ncx" + chr(34)}>{refs}</spine></package>'
    hidden = archive.deobfuscate("idpf" if even else "adobe", _uuid(doc_id), _font(doc_id)) or b""  # undoes itself
    sealed = f'<encryption xmlns="urn:oasis:names:tc:opendocument:xmlns:container" xmlns:e="http://www.w3.org/2001/04/xmlenc#"><e:EncryptedData><e:EncryptionMethod Algorithm="{method}"/><e:CipherData><e:CipherReference URI="b/f.otf"/></e:CipherData></e:EncryptedData></encryption>'
    head = [
        ("mimetype", b"application/epub+zip"),
        ("META-INF/container.xml", b'<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="b/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
        ("META-INF/encryption.xml", sealed.encode()),
        ("b/book.opf", package.encode()),
        nav,
        ("b/f.otf", hidden),
    ]
    raw = _zip(head + parts)
    # Some have lost their directory.
    return raw[: raw.rfind(b"PK\x01\x02", 0, raw.find(b"PK\x01\x02") + 4)] if doc_id % 5 == 0 else raw


def _catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(_customers(spark, sf_dir), catalogue)


@query(f"""
WITH {_CUSTOMERS}
SELECT doc_id, CAST(i AS INTEGER) AS seq, CASE WHEN k % 5 = 0 THEN 'x' ELSE 'c' END || k AS idref, 'b/text/c ' || k || '.xhtml' AS path, k % 7 <> 0 AS linear,
  CASE WHEN k % 4 = 0 OR doc_id % 3 <> 0 THEN 'reflowable' ELSE 'pre-paginated' END AS layout, name || chr(10) || 'of the ' || segment || ' segment' AS text, CAST(100 + k % 50 AS DOUBLE) AS width FROM c
""")
def catalogue_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters by the spine, through fallbacks, with their own layouts and viewports (survey S21, S31, S33, P39, P40, P42, T32, T33)."""
    rows = archive.read(_catalogues(spark, sf_dir), "chapters")
    return rows.select("doc_id", "seq", "idref", "path", "linear", "layout", "text", F.col("viewport.width").alias("width"))


@query(f"""
WITH {_CUSTOMERS}
SELECT doc_id, 0 AS depth, segment AS title, NULL AS path, NULL AS fragment FROM c GROUP BY doc_id, segment
UNION ALL SELECT doc_id, 1, name, 'b/text/c ' || k || '.xhtml', 'top' FROM c
""")
def catalogue_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents from navigation documents and from the older kind."""
    return archive.read(_catalogues(spark, sf_dir), "navigation").drop("error")


@query(f"""
WITH {_CUSTOMERS}, h AS (SELECT DISTINCT doc_id, md5(CAST(doc_id AS VARCHAR)) AS d FROM c)
SELECT doc_id, md5(repeat('font of ' || doc_id || ' ', 200)) AS digest, CASE WHEN doc_id % 2 = 0 THEN 'idpf' ELSE 'adobe' END AS how,
  'urn:uuid:' || d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20] || '-' || d[21:32] AS identifier,
  sha1('urn:uuid:' || d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20] || '-' || d[21:32]) AS long_key, d AS short_key FROM h
""")
def catalogue_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts with their obfuscation taken off, by either key."""
    from docloom.functions import bytes as by

    def make(row: Row) -> Any:
        book = archive.Book(archive.Archive(row["content"]))
        yield {"doc_id": row["doc_id"], "digest": hashlib.md5(book.font("b/f.otf") or b"").hexdigest(), "how": book.obfuscated.get("b/f.otf"), "identifier": book.unique_id}

    rows = mapped(_catalogues(spark, sf_dir), "doc_id long, digest string, how string, identifier string", make)
    return rows.withColumns({"long_key": F.lower(F.hex(by.idpf_key(F.col("identifier")))), "short_key": F.lower(F.hex(by.adobe_key(F.col("identifier"))))})


@query(f"""
WITH {_CUSTOMERS}
SELECT doc_id, 'epub' AS kind, count(*) + 6 AS entries, doc_id % 5 = 0 AS scanned, 'Nation ' || doc_id AS title, CAST(count(*) AS INTEGER) AS spine_items, CAST(0 AS BIGINT) AS defects FROM c GROUP BY doc_id
""")
def catalogue_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives with their directory and without, all entries whole."""
    files = _catalogues(spark, sf_dir)
    broken = archive.read(files, "entries").groupBy("doc_id").agg(F.count_if(F.col("defect").isNotNull()).alias("broken"))
    rows = archive.read(files, "archives").join(broken, "doc_id")
    return rows.select("doc_id", "kind", F.col("entries").cast("long").alias("entries"), "scanned", F.try_element_at("metadata", F.lit("title")).alias("title"), "spine_items", F.col("broken").alias("defects"))


@query("SELECT p_partkey AS doc_id, p_name || 'ü' AS name, 'stored' AS method, length(p_type) AS uncompressed, CASE WHEN p_partkey % 3 = 0 THEN 'checksum' END AS defect, true AS scanned, 'extra' || p_size AS extra FROM part")
def entry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without a directory, with names of the old code page, extra fields and wrong checksums."""

    def make(row: Row) -> Any:
        name, body, extra = row["p_name"].encode() + b"\x81", row["p_type"].encode(), b"extra%d" % row["p_size"]
        crc = zlib.crc32(body) ^ (row["doc_id"] % 3 == 0)
        file = archive.Archive(b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 0, crc, len(body), len(body), len(name), len(extra)) + name + extra + body)
        for e in file.entries:
            yield {"doc_id": row["doc_id"], "name": e.name, "method": e.method, "uncompressed": e.uncompressed, "defect": file.read(e)[1], "scanned": file.scanned, "extra": (file.local_extra(e) or b"").decode()}

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_type", "p_size")
    return mapped(spread(rows), "doc_id long, name string, method string, uncompressed long, defect string, scanned boolean, extra string", make)


def fixed_document(row: Row) -> bytes:
    """A fixed document of a nation: a page a customer, with two runs of glyphs."""
    rows, base = row["rows"], "http://schemas.microsoft.com/xps/2005/06"
    page = lambda r: f'<FixedPage xmlns="{base}" Width="{800 + r["c_custkey"] % 10}" Height="1000"><Canvas><Glyphs OriginX="96" OriginY="{100 + r["c_custkey"] % 7}" FontRenderingEmSize="16" UnicodeString="{r["c_name"]}"/><Glyphs OriginX="48" OriginY="200" FontRenderingEmSize="12" UnicodeString="{{}}{r["c_mktsegment"]}"/></Canvas></FixedPage>'
    references = "".join(f'<PageContent Source="Pages/{r["c_custkey"]}.fpage"/>' for r in rows)
    return _zip(
        [
            ("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="fpage" ContentType="application/vnd.ms-package.xps-fixedpage+xml"/><Default Extension="RELS" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/D/Pages/{rows[0]["c_custkey"]}.fpage" ContentType="application/special"/></Types>'.encode()),
            ("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{base}/fixedrepresentation" Target="/seq.fdseq"/><Relationship Id="r2" Type="http://x.test/more" Target="http://x.test/{row["doc_id"]}" TargetMode="External"/></Relationships>'.encode()),
            ("seq.fdseq", f'<FixedDocumentSequence xmlns="{base}"><DocumentReference Source="D/doc.fdoc"/></FixedDocumentSequence>'.encode()),
            ("D/doc.fdoc", f'<FixedDocument xmlns="{base}">{references}</FixedDocument>'.encode()),
            *[(f"D/Pages/{r['c_custkey']}.fpage", page(r).encode()) for r in rows],
        ]
    )


@query(typed(f"""
WITH {_CUSTOMERS}
SELECT doc_id, CAST(i AS INTEGER) AS page, '/D/Pages/' || k || '.fpage' AS part, (800 + k % 10) * 0.75 AS width, 750.0 AS height, 72.0 AS x, (100 + k % 7) * 0.75 AS y, 12.0 AS size, name || '|' || segment AS text FROM c
""", width="DOUBLE", height="DOUBLE", x="DOUBLE", y="DOUBLE", size="DOUBLE"))
def fixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of fixed documents, in points, with their runs."""
    rows = archive.read(files_of(_customers(spark, sf_dir), fixed_document), "fixed_pages")
    first = F.col("runs")[0]
    return rows.select("doc_id", "page", "part", "width", "height", first["x"].alias("x"), first["y"].alias("y"), first["size"].alias("size"), F.array_join(F.transform("runs", lambda r: r["text"]), "|").alias("text"))


@query(typed(f"""
WITH {_CUSTOMERS}, p AS (SELECT *, i = 0 AS first FROM c)
SELECT doc_id, '/D/Pages/' || k || '.fpage' AS part, CASE WHEN first THEN 'application/special' ELSE 'application/vnd.ms-package.xps-fixedpage+xml' END AS media_type,
  'application/vnd.openxmlformats-package.relationships+xml' AS of_relations, NULL AS of_nothing, 'http://x.test/' || doc_id AS external FROM p
""", of_nothing="VARCHAR"))
def package_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts, by name before extension, and relationships to the outside."""

    def make(row: Row) -> Any:
        p = archive.Package(archive.Archive(row["content"]))
        external = next(r["target"] for r in p.relationships() if r["external"])
        for page in p.pages():
            yield {"doc_id": row["doc_id"], "part": page["part"], "media_type": p.media_type(page["part"]), "of_relations": p.media_type("/_rels/.rels"), "of_nothing": p.media_type("/x.none"), "external": external}

    return mapped(files_of(_customers(spark, sf_dir), fixed_document), "doc_id long, part string, media_type string, of_relations string, of_nothing string, external string", make)


@query("SELECT p_partkey, md5(p_name || p_type || p_brand || repeat('#', 40)) AS digest, 3 AS runs, p_size AS glyph, CAST(p_size AS DOUBLE) / 2 AS advance, 2 AS codes FROM part")
def fixed_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts hidden by the GUID of their name, and the short form of glyph indices."""

    def make(row: Row) -> Any:
        body = (row["p_name"] + row["p_type"] + row["p_brand"] + "#" * 40).encode()
        name = "/Fonts/" + _uuid(row["p_partkey"]).removeprefix("urn:uuid:").upper() + ".odttf"
        glyphs = archive.indices(f"{row['p_size']},{row['p_size'] / 2};(2:1)7;,,3")
        yield {"p_partkey": row["p_partkey"], "digest": hashlib.md5(archive.odttf(name, archive.odttf(name, body) or b"") or b"").hexdigest(), "runs": len(glyphs), "glyph": glyphs[0]["glyph"], "advance": glyphs[0]["advance"], "codes": glyphs[1]["codes"]}

    return mapped(spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")), "p_partkey long, digest string, runs int, glyph int, advance double, codes int", make)


@query("""
WITH p AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS doc_id, p_partkey, p_size FROM part)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p_size, p_partkey) - 1 AS INTEGER) AS page, 'Page' || p_size || '/' || p_partkey || '.png' AS entry, 'png' AS format FROM p
""")
def comic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of a comic in reading order, whatever their order in the file."""
    picture = images.png_encode(np.zeros((1, 1, 1), np.uint8))

    def make(row: Row) -> bytes:
        parts = [(f"Page{r['p_size']}/{r['p_partkey']}.png", picture) for r in row["rows"]]
        return _zip([("notes.txt", b"x"), *sorted(parts, reverse=True)])

    rows = table(spark, sf_dir, "part").withColumn("brand", F.substring("p_brand", 7, 9).cast("long"))
    return archive.read(files_of(gathered(rows, "brand", "p_partkey", "p_size"), make), "comic_pages").select("doc_id", "page", "entry", "format")


@query("""
WITH p AS (SELECT p_partkey AS doc_id, p_name, p_type, p_size % 4 AS how FROM part)
SELECT doc_id, 0 AS seq, 'start' AS kind, 0 AS depth, 'urn:x' AS namespace, 'part' AS name, p_type AS attr, NULL AS text FROM p WHERE how < 3
UNION ALL SELECT doc_id, 1, 'text', 1, NULL, NULL, NULL, p_name || ' <é>' FROM p WHERE how < 3
UNION ALL SELECT doc_id, 2, 'comment', 1, NULL, NULL, NULL, ' c ' FROM p WHERE how < 3
UNION ALL SELECT doc_id, 3, 'end', 0, 'urn:x', 'part', NULL, NULL FROM p WHERE how < 3
UNION ALL SELECT doc_id, 0, 'defect', 0, NULL, NULL, NULL, 'document type' FROM p WHERE how = 3
""")
def xml_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of small documents in three encodings; those with a document type are refused by name."""
    body = F.concat(F.lit('<x:part xmlns:x="urn:x" of="'), "p_type", F.lit('">'), "p_name", F.lit(" &lt;é&gt;<!-- c --></x:part>"))
    how = F.col("p_size") % 4
    raw = F.when(how == 0, F.encode(body, "UTF-8")).when(how == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(body, "UTF-16LE"))).when(how == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode(body, "UTF-16BE"))).otherwise(F.encode(F.concat(F.lit('<!DOCTYPE a [<!ENTITY b "c">]>'), body), "UTF-8"))
    rows = xml.read(spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), raw.alias("content"))))
    return rows.select("doc_id", F.col("seq").cast("int").alias("seq"), "kind", "depth", "namespace", "name", F.try_element_at("attrs", F.lit("of")).alias("attr"), "text")


@query("SELECT p_partkey AS doc_id, CASE p_size % 3 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-16LE' ELSE 'UTF-16BE' END AS encoding, p_size % 3 = 2 AS defect FROM part")
def xml_doctypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodings by the first bytes, and document types that declare nothing, let through."""
    how = F.col("p_size") % 3
    body = F.concat(F.lit('<!DOCTYPE html SYSTEM "about:x"'), F.when(how == 2, ' [<!ENTITY b "c">]').otherwise(""), F.lit("><html>"), F.col("p_name"), F.lit("</html>"))
    raw = F.when(how == 0, F.encode(body, "UTF-8")).when(how == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(body, "UTF-16LE"))).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(body, "UTF-16BE")))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), raw.alias("content"))
    defects = xml.read(spread(files), doctype=True).groupBy("doc_id").agg((F.count_if(F.col("kind") == "defect") > 0).alias("defect"))
    return files.select("doc_id", xml.encoding(F.col("content")).alias("encoding")).join(defects, "doc_id")


_SHEET = """
@import "none.css"; @media print { li { color: never } } @media screen and (min-width: 700px) { .wide { order: 1 } }
/* c */ ul > li:first-child { color: first } ul li { color: li } li + li { margin: 1px 2px } li ~ li.gold { weight: bold !important }
#x3 { color: id } li.gold { weight: thin; color: gold } li[data-k="4"] { color: attribute } bad{ { color: never } } li:not(.gold):last-child { color: last }
"""


@query("""
WITH p AS (SELECT p_partkey // 10 AS page, p_partkey AS k, p_size % 3 = 0 AS gold, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY p_partkey // 10) AS n FROM part WINDOW w AS (PARTITION BY p_partkey // 10 ORDER BY p_partkey))
SELECT page AS page_id, CAST(i + 1 AS INTEGER) AS node, property, value FROM (
  SELECT page, i, 'color' AS property, CASE WHEN k = 3 THEN 'id' WHEN NOT gold AND i = n - 1 THEN 'last' WHEN i = 0 THEN 'first' WHEN k = 4 THEN 'attribute' WHEN gold THEN 'gold' ELSE 'li' END AS value FROM p
  UNION ALL SELECT page, i, 'weight', CASE WHEN i > 0 THEN 'bold' ELSE 'thin' END FROM p WHERE gold
  UNION ALL SELECT page, i, 'order', '1' FROM p WHERE gold
  UNION ALL SELECT page, i, 'margin', '1px 2px' FROM p WHERE i > 0)
""")
def style_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sheet gives each item of lists: combinators, media, importance, specificity, positions, errors passed over."""

    def make(row: Row) -> Any:
        yield {"page_id": row["doc_id"], "node": 0, "parent": -1, "prev": -1, "tag": "ul", "attrs": []}
        for i, r in enumerate(row["rows"]):
            gold = r["p_size"] % 3 == 0
            attrs = {"id": f"x{r['p_partkey']}", "data-k": str(r["p_partkey"])} | ({"class": "gold wide"} if gold else {})
            yield {"page_id": row["doc_id"], "node": i + 1, "parent": 0, "prev": i if i else -1, "tag": "li", "attrs": list(attrs.items())}

    parts = table(spark, sf_dir, "part").withColumn("page", F.floor(F.col("p_partkey") / 10))
    nodes = mapped(gathered(parts, "page", "p_partkey", "p_size"), "page_id long, node int, parent int, prev int, tag string, attrs map<string,string>", make)
    return css.winners(nodes, _SHEET).select("page_id", "node", "property", "value")
