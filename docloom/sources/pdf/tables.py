"""PDF files as tables: one pass of mapInArrow over (doc_id, content) for each table, with its columns declared."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.pdf import semantics
from docloom.sources.pdf.content import Interpreter, lines
from docloom.sources.pdf.document import Document
from docloom.sources.pdf.objects import Keyword, Name, Ref, Stream

Rows = Iterator[dict[str, Any]]
#: Rows that leave at once, whatever files they are of.
BATCH_ROWS = 2000


def _plain(value: Any) -> Any:
    """An object for JSON: references as {"ref": n}, strings as hexadecimal, streams by their dictionary."""
    if isinstance(value, Ref):
        return {"ref": value.num, "gen": value.gen}
    if isinstance(value, Stream):
        return {"stream": _plain(value.dict), "length": len(value.raw)}
    if isinstance(value, bytes):
        return {"hex": value.hex()}
    if isinstance(value, dict):
        return {str(k).encode("utf-8", "replace").decode(): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return str(value).encode("utf-8", "replace").decode() if isinstance(value, (Name, Keyword)) else value


def kind_of(value: Any) -> str:
    for types, name in ((bool, "bool"), (Ref, "ref"), (Stream, "stream"), (Name, "name"), (bytes, "string"), (int, "int"), (float, "real"), (dict, "dict"), (list, "array")):
        if isinstance(value, types):
            return name
    return "null"


def _summary(doc: Document) -> Rows:
    meta = semantics.metadata(doc) if doc.readable else {}
    pages = len(doc.pages()) if doc.readable else 0
    tree = doc.get(doc.catalog().get("Pages"))
    count = doc.get(tree.get("Count")) if isinstance(tree, dict) else None
    if isinstance(count, int) and count != pages and doc.readable:
        doc.warnings.add("page count")
    yield {"opened": doc.opened, "version": doc.version(), "encrypted": doc.encrypted, "level": doc.handler.level if doc.handler else "none", "permissions": doc.handler.permissions if doc.handler else None, "n_pages": pages, "revisions": len(doc.revisions), "repaired": doc.repaired, "metadata": {k: v for k, v in meta.items() if v is not None}, "capabilities": semantics.capabilities(doc) if doc.readable else [], "warnings": doc.warnings.found}


def _objects(doc: Document) -> Rows:
    for num, entry, value in doc.objects():
        yield {"num": num, "gen": entry.gen, "kind": kind_of(value), "value": json.dumps(_plain(value)), "offset": entry.offset if entry.kind == "offset" else None, "stream_num": entry.offset if entry.kind == "packed" else None}


def _xref(doc: Document) -> Rows:
    for num, e in doc.all_entries:
        yield {"num": num, "revision": e.revision, "kind": e.kind, "offset": e.offset, "gen": e.gen, "idx": e.index}


def _pages(doc: Document) -> Rows:
    box = lambda b: dict(zip(("x0", "y0", "x1", "y1"), b, strict=True))
    for i, (ref, page) in enumerate(doc.pages()):
        media, crop = doc.boxes(page)
        yield {"page_index": i, "num": ref.num if ref else None, "media_box": box(media), "crop_box": box(crop), "rotation": doc.rotation(page)}


def _glyphs(doc: Document) -> Rows:
    for i, (_, page) in enumerate(doc.pages()):
        run = Interpreter(doc)
        run.run(doc.contents(page), page.get("Resources"))
        for seq, g in enumerate(run.glyphs):
            yield {"page_index": i, "seq": seq, "code": g.code, "text": g.text, **dict(zip("abcdef", g.matrix, strict=True)), "advance": g.advance, "size": g.size, "vertical": g.vertical, "font": g.font, "artifact": g.artifact}


def _lines(doc: Document) -> Rows:
    for i, (_, page) in enumerate(doc.pages()):
        run = Interpreter(doc)
        run.run(doc.contents(page), page.get("Resources"))
        for k, line in enumerate(lines(run.glyphs)):
            yield {"page_index": i, "block": line.block, "line": k, "text": line.text, "size": line.size, "vertical": line.vertical, "x0": line.x0, "y0": line.y0, "x1": line.x1, "y1": line.y1}


_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
#: What each table has besides doc_id, and what gives its rows. Files that need a password give rows to documents, objects and xref only.
TABLES: dict[str, tuple[str, Callable[[Document], Any], bool]] = {
    "documents": ("opened boolean, version string, encrypted boolean, level string, permissions long, n_pages int, revisions int, repaired boolean, metadata map<string,string>, capabilities array<string>, warnings map<string,int>", _summary, False),
    "objects": ("num long, gen int, kind string, value string, offset long, stream_num long", _objects, False),
    "xref": ("num long, revision int, kind string, offset long, gen int, idx int", _xref, False),
    "pages": (f"page_index int, num long, media_box {_BOX}, crop_box {_BOX}, rotation int", _pages, True),
    "glyphs": ("page_index int, seq long, code long, text string, a double, b double, c double, d double, e double, f double, advance double, size double, vertical boolean, font string, artifact boolean", _glyphs, True),
    "text_lines": ("page_index int, block int, line int, text string, size double, vertical boolean, x0 double, y0 double, x1 double, y1 double", _lines, True),
    "outline": ("node int, parent int, depth int, title string, page int", semantics.outline, True),
    "label_ranges": ("page long, style string, prefix string, start long", semantics.label_ranges, True),
    "links": ("page int, seq int, x0 double, y0 double, x1 double, y1 double, action string, target string, to_page int", semantics.links, True),
    "fields": ("seq int, num long, name string, kind string, value string, many array<string>, default string, flags long, options array<string>, max_len int, calculated int, scripts map<string,string>", semantics.fields, True),
    "scripts": ("place string, name string, source string", semantics.scripts, True),
    "attachments": ("name string, file string, description string, mime string, size long, num long", semantics.attachments, True),
    "layers": ("num long, name string, visible boolean", semantics.layers, True),
}


def read(files: DataFrame, table: str, password: str = "", id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(id_col, ..., error) of a table of TABLES from files. A file that isn't one, or is damaged, gives what it gives; none ends the job.

    error is null, but in a last row of a file whose rows ended early: that row has the kind of error and nothing else.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    columns, make, needs_key = TABLES[table]
    columns += ", error string"
    id_type = dict(files.dtypes)[id_col]
    schema = to_arrow_schema(files.sparkSession.createDataFrame([], f"id {id_type}, {columns}").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of many files leave together: a batch costs far more than the few rows that most files have.
        held: list[dict[str, Any]] = []
        for batch in batches:
            for doc_id, content in zip(batch.column(0), batch.column(1), strict=True):
                i = doc_id.as_py()
                for row in _safe(content.as_py(), make, needs_key, password):
                    row["id"] = i
                    held.append(row)
                    if len(held) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    rows = files.select(F.col(id_col).alias("id"), F.col(content_col).alias("content"))
    return rows.mapInArrow(run, f"id {id_type}, {columns}").withColumnRenamed("id", id_col)


def _safe(content: bytes | None, make: Callable[[Document], Any], needs_key: bool, password: str = "") -> Rows:
    """Rows up to the first thing that no rule of leniency covers, and one that names it."""
    try:
        doc = Document(content or b"")
        if password and doc.encrypted:
            doc.authenticate(password)
        if doc.opened and (doc.readable or not needs_key) or make is _summary:
            yield from make(doc)
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, OverflowError, MemoryError) as e:
        yield {"error": f"{type(e).__name__}: {e}"[:200]}


def files(spark: Any, path: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """(doc_id, length, content) of all files under a folder; doc_id is the path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select(F.col("path").alias("doc_id"), "length", "content")


def search(text_lines: DataFrame, needle: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, page_index, line, hits) of lines with hits: native, on the lines table."""
    from docloom.functions.text import hit_count

    return text_lines.select(id_col, "page_index", "line", hit_count(F.col("text"), needle).alias("hits")).where("hits > 0")
