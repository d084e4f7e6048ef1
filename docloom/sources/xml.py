"""XML as events: elements with resolved namespaces, text, comments and instructions, in order, with a document type refused."""

from __future__ import annotations

import xml.parsers.expat as expat
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 256
MAX_EVENTS = 1_000_000
MAX_ATTRIBUTES = 512
#: Rows that leave at once, whatever documents they are of.
BATCH_ROWS = 2000


class Refused(ValueError):
    pass


def encoding(value: Column) -> Column:
    """UTF-8, UTF-16LE or UTF-16BE by the first bytes. Native."""
    start = F.hex(F.substring(value, 1, 4))
    return F.when(start.rlike("^(FEFF|003C00)"), "UTF-16BE").when(start.rlike("^(FFFE|3C00[0-9A-F]{2}00)"), "UTF-16LE").otherwise("UTF-8")


def events(body: bytes, doctype: bool = False) -> Iterator[dict[str, Any]]:
    """(kind, depth, namespace, name, attrs, text): start, end, text, comment, pi; a defect is the last event.

    A document type is refused by name, or with `doctype` passed over if it declares nothing; entities never expand.
    """
    out: list[dict[str, Any]] = []
    p = expat.ParserCreate(namespace_separator="\n")
    p.buffer_text = True
    state = {"depth": 0}

    def add(kind: str, name: str | None = None, attrs: dict[str, str] | None = None, text: str | None = None) -> None:
        if len(out) >= MAX_EVENTS:
            raise Refused("too many events")
        space, _, local = (name or "").rpartition("\n")
        out.append({"kind": kind, "depth": state["depth"], "namespace": space or None, "name": local or None, "attrs": attrs or {}, "text": text})

    def start(name: str, attrs: dict[str, str]) -> None:
        if state["depth"] >= MAX_DEPTH or len(attrs) > MAX_ATTRIBUTES:
            raise Refused("too deep" if state["depth"] >= MAX_DEPTH else "too many attributes")
        add("start", name, {k.replace("\n", "|"): v for k, v in attrs.items()})
        state["depth"] += 1

    def end(name: str) -> None:
        state["depth"] -= 1
        add("end", name)

    def refuse(*_: Any) -> None:
        raise Refused("document type")

    def declared(name: str, system: str | None, public: str | None, internal: int) -> None:
        if not doctype or internal:
            raise Refused("document type")

    p.StartElementHandler, p.EndElementHandler = start, end
    p.CharacterDataHandler = lambda t: add("text", text=t)
    p.CommentHandler = lambda t: add("comment", text=t)
    p.ProcessingInstructionHandler = lambda target, t: add("pi", target, text=t)
    p.StartDoctypeDeclHandler, p.EntityDeclHandler, p.ExternalEntityRefHandler = declared, refuse, refuse
    try:
        p.Parse(body, True)
    except Refused as e:
        add("defect", text=str(e)) if len(out) < MAX_EVENTS else None
    except (expat.ExpatError, ValueError, LookupError) as e:
        add("defect", text=str(e).split(":")[0])
    yield from out


_COLUMNS = "seq long, kind string, depth int, namespace string, name string, attrs map<string,string>, text string"


def read(files: DataFrame, doctype: bool = False, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(id_col, seq, kind, depth, namespace, name, attrs, text): the events of each document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    id_type = dict(files.dtypes)[id_col]
    schema = to_arrow_schema(files.sparkSession.createDataFrame([], f"id {id_type}, {_COLUMNS}").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, Any]] = []
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for seq, e in enumerate(events(content.as_py() or b"", doctype)):
                    held.append({"id": doc_id, "seq": seq, **e})
                    if len(held) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    rows = files.select(F.col(id_col).alias("id"), F.col(content_col).alias("content"))
    return rows.mapInArrow(run, f"id {id_type}, {_COLUMNS}").withColumnRenamed("id", id_col)
