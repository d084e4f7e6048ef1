"""The short way in: a folder of files as a set of tables, and their functions and views for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import lookup
from docloom.sources import archive, open as opened
from docloom.sources.pdf import tables as pdf


class Documents:
    """Files (doc_id, content) and what each reader makes of them; nothing is read before a table is used."""

    def __init__(self, files: DataFrame, password: str = ""):
        self.files, self.password = files, password

    @classmethod
    def of(cls, spark: SparkSession, path: str, pattern: str = "*", password: str = "") -> Documents:
        return cls(pdf.files(spark, path, pattern), password)

    def table(self, name: str) -> DataFrame:
        """A table of a reader: those of PDF files and of archives, or kinds and text of all files."""
        if name == "kinds":
            return opened.classify(self.files).drop("content")
        if name == "text":
            return opened.text(self.files, self.password)
        if name in pdf.TABLES:
            return pdf.read(self.files, name, self.password)
        if name in archive.TABLES:
            return archive.read(self.files, name)
        raise KeyError(name)

    def register(self, prefix: str = "doc_") -> list[str]:
        """A temporary view for each table; their names."""
        names = ["kinds", "text", *pdf.TABLES, *archive.TABLES]
        for name in names:
            self.table(name).createOrReplaceTempView(prefix + name)
        return [prefix + n for n in names]

    def page_labels(self) -> DataFrame:
        """(doc_id, page_index, label) of PDF files: the range that starts last before a page numbers it; without any, from 1."""
        pages = self.table("pages").select("doc_id", "page_index", F.col("page_index").cast("long").alias("page"))
        ranges = self.table("label_ranges").select("doc_id", "page", F.struct(F.col("page").alias("lo"), "style", "prefix", "start").alias("range"))
        found = lookup.asof(pages, ranges, ["doc_id"], "page", "range")
        number = F.col("range.start") + F.col("page") - F.col("range.lo")
        label = F.concat("range.prefix", tx.label_number(F.col("range.style"), number))
        return found.select("doc_id", "page_index", F.coalesce(label, (F.col("page") + 1).cast("string")).alias("label"))

    def search(self, needle: str) -> DataFrame:
        """(doc_id, part, line, hits) of the lines with hits."""
        return self.table("text").select("doc_id", "part", "line", tx.hit_count(F.col("text"), needle).alias("hits")).where("hits > 0")
