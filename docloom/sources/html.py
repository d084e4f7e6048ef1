"""HTML pages as rows: a table of elements in document order, and what can be read of it with JVM expressions alone."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that never have content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MAX_DEPTH = 512
NODE_SCHEMA = "id long, node int, parent int, prev int, tag string, attrs map<string,string>, text string, depth int"
_ARROW = pa.schema([("id", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("prev", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("depth", pa.int32())])


class _Tree(HTMLParser):
    """Elements as they open; one that is never closed ends with its parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.last_child: dict[int, int] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        parent = self.open[-1] if self.open else -1
        seen = {k: v or "" for k, v in reversed(attrs)}
        self.nodes.append([len(self.nodes), parent, self.last_child.get(parent, -1), tag, list(seen.items())[::-1], [], len(self.open)])
        self.last_child[parent] = len(self.nodes) - 1
        if tag not in VOID and len(self.open) < MAX_DEPTH:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]][3] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.nodes[self.open[-1]][5].append(data)


def dom_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, node, parent, prev, tag, attrs, text, depth): a row for each element; text is what stands directly in it.

    Damaged mark-up gives the elements that can be told; a null page has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tree = _Tree()
                tree.feed(x.as_py() or "")
                tree.close()
                rows += [(i, n, p, q, t, a, "".join(d), e) for n, p, q, t, a, d, e in tree.nodes]
                if len(rows) >= 50_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, NODE_SCHEMA).withColumnRenamed("id", id_col)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    """ARRAY<STRING> of the targets of a elements in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"']"), F.lit(1))


def headings(html: Column) -> Column:
    """ARRAY<STRUCT<level, title>> in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<(h[1-6])[^>]*>.*?</\1>"), F.lit(0))
    inner = lambda h: F.trim(F.regexp_replace(h, r"(?s)<[^>]*>", ""))
    return F.transform(found, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), inner(h).alias("title")))


def tags(html: Column) -> Column:
    """ARRAY<STRING> of the names of elements as they open."""
    return F.regexp_extract_all(html, F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1))
