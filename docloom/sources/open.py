"""Files of any supported kind: what each is by its first bytes, and its text whatever it is."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import bytes as by
from docloom.sources import archive, html
from docloom.sources.pdf import tables as pdf
from docloom.sources.pdf.document import Document


def classify(files: DataFrame, content_col: str = "content") -> DataFrame:
    """files with kind: pdf, zip, rar, 7z, tar, an image's format, html, or null. Native: the bytes stay in the JVM."""
    c = F.col(content_col)
    head = F.lower(F.decode(F.substring(c, 1, 512), "ISO-8859-1"))
    kind = F.when(by.is_pdf(c), "pdf").otherwise(F.coalesce(by.container(c), by.image_format(c), F.when(head.rlike(r"<!doctype html|<html"), "html")))
    return files.withColumn("kind", kind)


_DROPPED = re.compile(r"(?is)<!--.*?-->|<(head|script|style)\b.*?</\1\s*>")
_BLOCK = re.compile(r"(?i)<(?:p|div|h[1-6]|li|br|tr|article|section)\b[^>]*>")


def _lines(content: bytes, password: str) -> Iterator[tuple[int, int, str | None]]:
    """(part, line, text) by the reader of the file's kind."""
    if b"%PDF-" in content[:1024]:
        doc = Document(content)
        if password and doc.encrypted:
            doc.authenticate(password)
        if doc.opened and doc.readable:
            for row in pdf.TABLES["text_lines"][1](doc):
                yield row["page_index"], row["line"], row["text"]
    elif content[:4] == b"PK\3\4":
        a = archive.Archive(content)
        kind = archive._kind(a) if a.entries else "zip"
        if kind == "xps":
            for page in archive.Package(a).pages():
                for k, run in enumerate(page["runs"]):
                    yield page["page"], k, run["text"]
        elif kind == "epub":
            for chapter in archive.Book(a).chapters():
                for k, line in enumerate((chapter["text"] or "").split("\n")):
                    yield chapter["seq"], k, line
    elif re.search(rb"(?i)<!doctype html|<html", content[:512]):
        body = _BLOCK.sub("\n", _DROPPED.sub(" ", content.decode("utf-8", "replace")))
        plain = (" ".join(re.sub(r"<[^>]*>", "", x).split()) for x in body.split("\n"))
        for k, line in enumerate(x for x in plain if x):
            yield 0, k, line


def text(files: DataFrame, password: str = "", id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(id_col, part, line, text, error) of all files that have any: pages of PDF and fixed documents, chapters of books, HTML as one part.

    One pass reads each file by its kind; what is of none gives no rows. error is null, but in a last row of a file whose text ended early.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    id_type = dict(files.dtypes)[id_col]
    columns = f"id {id_type}, part int, line int, text string, error string"
    schema = to_arrow_schema(T.StructType.fromDDL(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, object]] = []
        for batch in batches:
            for doc_id, content in zip(batch.column(0), batch.column(1), strict=True):
                i = doc_id.as_py()
                try:
                    for part, line, words in _lines(content.as_py() or b"", password):
                        held.append({"id": i, "part": part, "line": line, "text": words})
                        if len(held) >= 20_000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, OverflowError, MemoryError, struct.error) as e:
                    held.append({"id": i, "error": f"{type(e).__name__}: {e}"[:200]})
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    rows = files.select(F.col(id_col).alias("id"), F.col(content_col).alias("content"))
    return rows.mapInArrow(run, columns).withColumnRenamed("id", id_col)


__all__ = ["classify", "html", "text"]
