"""Queries over files: documents written as PDF files and e-books and read back, and programs that files carry."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import programs, scripts
from docloom.operators import grouping
from docloom.plans.fixtures import spread
from docloom.plans.registry import query, table
from docloom.sources import archive
from docloom.sources.pdf import tables as pdf
from docloom.sources.pdf.writer import Builder

_INK = r"regexp_replace(text, '[ \t\n\r\f]', '', 'g')"


def pdf_files(pages: DataFrame) -> DataFrame:
    """(doc_id, content): a PDF file of each (doc_id, lines ARRAY<STRUCT<page, line, text>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, rows in zip(batch.column(0), batch.column(1), strict=True):
                b, i = Builder(info={"Title": f"Document {doc_id}"}), -1
                for row in rows.as_py() or [{"page": 0, "line": 0, "text": ""}]:
                    if row["page"] != i:
                        b.page()
                        i = row["page"]
                    b.text(36, 750 - 14 * row["line"], row["text"], 10)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.array([b.finish(packed=True)], pa.binary())], names=["doc_id", "content"])

    return pages.select(F.col("doc_id").cast("long"), "lines").mapInArrow(run, "doc_id long, content binary")


def _documents_as_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf_files(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", grouping.paginate(F.col("text"), 90, 50).alias("lines")))


@query(f"SELECT doc_id, length({_INK}) AS chars, md5({_INK}) AS digest FROM documents")
def pdf_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All characters of each document but white space, in order, read back from a PDF file of it."""
    lines = pdf.read(_documents_as_pdf(spark, sf_dir), "text_lines")
    ordered = F.sort_array(F.collect_list(F.struct("page_index", "line", "text")))
    text = F.regexp_replace(F.array_join(ordered.getField("text"), ""), r"[ \t\n\r\f]", "")
    rows = lines.groupBy("doc_id").agg(text.alias("t"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(rows, "doc_id", "left").select("doc_id", F.coalesce("t", F.lit("")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("SELECT doc_id, true AS opened, '2.0' AS version, false AS encrypted, 'Document ' || doc_id AS title FROM documents")
def pdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What PDF files of the documents say of themselves."""
    rows = pdf.read(_documents_as_pdf(spark, sf_dir), "documents")
    return rows.select("doc_id", "opened", "version", "encrypted", F.col("metadata")["Title"].alias("title"))


def ebooks(docs: DataFrame) -> DataFrame:
    """(doc_id, content): an e-book of each document, a chapter a line, with a navigation document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, files = [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines, out = (text.as_py() or "").split("\n"), io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
                    z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="b/book.opf"/></rootfiles></container>')
                    items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(lines)))
                    refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(lines)))
                    z.writestr("b/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{doc_id}</dc:title></metadata><manifest>{items}<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine>{refs}</spine></package>')
                    z.writestr("b/nav.xhtml", '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>' + "".join(f'<li><a href="c{i}.xhtml">{i}</a></li>' for i in range(len(lines))) + "</ol></nav></body></html>")
                    for i, line in enumerate(lines):
                        clean = "".join(c for c in line if c >= " " or c == "\t")
                        z.writestr(f"b/c{i}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>x</title></head><body><p>{escape(clean)}</p></body></html>')
                ids.append(doc_id)
                files.append(out.getvalue())
                if sum(map(len, files[-8:])) > 1 << 22 or len(files) >= 200:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "content"])
                    ids, files = [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "content"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, content binary")


@query(r"""
WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t\r\f]+', ' ', 'g'), ' ') AS line FROM documents)
SELECT doc_id, count(*) AS chapters, CAST(sum(length(line)) AS BIGINT) AS chars FROM l GROUP BY doc_id
""")
def ebook_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters and characters of each document, read back from an e-book of it."""
    chapters = archive.read(ebooks(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), "chapters")
    return chapters.groupBy("doc_id").agg(F.count("*").alias("chapters"), F.sum(F.length("text")).alias("chars"))


@query(r"""
SELECT doc_id, len(string_split(text, chr(10))) + 4 AS entries, 'epub' AS kind FROM documents
""")
def archive_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What e-books of the documents hold."""
    rows = archive.read(ebooks(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), "archives")
    return rows.select("doc_id", F.col("entries").cast("long").alias("entries"), "kind")


@query("""
WITH e AS (SELECT vec_id, least(1, greatest(0, CAST(embedding[1] AS DOUBLE))) AS x, least(1, greatest(0, CAST(embedding[2] AS DOUBLE))) AS y FROM embeddings)
SELECT vec_id, round(CASE WHEN x > y THEN x - y ELSE (y - x) / 2 END, 9) AS a, round(least(1, sqrt(x) * 0.5 + y * y), 9) AS b FROM e
""")
def postscript_calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calculator of two inputs and two outputs."""
    f = programs.calculator("{ 2 copy 2 copy gt { sub } { exch sub 2 div } ifelse 3 1 roll dup mul exch sqrt .5 mul add }", [(0, 1)] * 2, [(0, 1)] * 2)
    v = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", f(v).alias("r"))
    return rows.select("vec_id", F.round(F.col("r")[0], 9).alias("a"), F.round(F.col("r")[1], 9).alias("b"))


@query("""
WITH e AS (SELECT vec_id, least(1, greatest(0, CAST(embedding[1] AS DOUBLE))) * 2 AS e FROM embeddings)
SELECT vec_id, round((CASE WHEN e < 1 THEN e * 128 ELSE 128 + (e - 1) * 127 END) / 255, 9) AS a FROM e
""")
def sampled_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of three samples, interpolated."""
    f = programs.table_function([(0, 1)], [(0, 1)], [3], 8, bytes([0, 128, 255]))
    v = F.transform(F.slice("embedding", 1, 1), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(f(v)[0], 9).alias("a"))


_SCRIPT = """
var names = ['price', 'tax']; var i, sum = 0;
for (i = 0; i < names.length; i++) { sum += getField(names[i]).value * 1; }
if (sum > 1000 && event.target.name == 'total') { event.value = sum * 0.9; } else event.value = sum; // large orders cost less
"""


@query("""
WITH t AS (SELECT p_partkey, p_retailprice, CASE WHEN p_retailprice + p_size > 1000 THEN (p_retailprice + p_size) * 0.9 ELSE p_retailprice + p_size END AS total FROM part)
SELECT p_partkey, round(total, 6) AS total, CASE WHEN p_partkey % 10 = 0 THEN 'field tax' END AS refused FROM t
""")
def form_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field's calculation script on each part's price and tax; a form without one of the fields refuses its helper."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            totals, refused = [], []
            for key, price, tax in rows.itertuples(index=False):
                out = scripts.run(_SCRIPT, "total", "", {"price": price, "tax": str(tax)})
                totals.append(round(scripts.number(out.value), 6))
                refused.append(scripts.run("AFSimple_Calculate('SUM', ['price', 'tax'])", "total", "", {"price": price} | ({"tax": tax} if key % 10 else {})).refused)
            yield pd.DataFrame({"p_partkey": rows["p_partkey"], "total": totals, "refused": refused})

    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size").mapInPandas(run, "p_partkey long, total double, refused string")
