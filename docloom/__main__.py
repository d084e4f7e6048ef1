"""python -m docloom VERB PATH [--password P] [--dpi N] [--out FOLDER]: tables of a file or folder, as JSON lines.

info, text, outline, fields, links, objects, attachments, layers, scripts, kinds: rows of that table. check: files with their
warnings. probe: a record a file. search NEEDLE: lines with hits. render: PNG files in --out. pdf: archives as PDF files in --out.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.api import Documents

TABLES = {"info": "documents", "text": "text", "outline": "outline", "fields": "fields", "links": "links", "objects": "objects", "attachments": "attachments", "layers": "layers", "scripts": "scripts", "kinds": "kinds"}


def probe(docs: Documents) -> DataFrame:
    """(record): lines of a key and its values, done last."""
    d = docs.table("documents")
    line = lambda *c: F.concat_ws(" ", *[x if not isinstance(x, str) else F.lit(x) for x in c])
    readable = F.col("opened") & (~F.col("encrypted") | (F.col("level") != "none"))
    opened = F.when(readable, "yes").when(F.col("opened"), "no password").otherwise("no header")
    ladder = F.when(F.col("repaired"), "rescan").otherwise("trust")
    caps = F.transform("capabilities", lambda c: F.concat(F.lit("cap "), c))
    warns = F.transform(F.array_sort(F.map_entries("warnings")), lambda w: F.concat(F.lit("warn "), w["key"], F.lit(" "), w["value"].cast("string")))
    pages = F.col("n_pages").cast("string")
    rows = F.concat(F.array(F.lit("probe 1"), line("file", F.col("doc_id")), line("opened", opened), line("ladder", ladder), line("pages", pages)), caps, F.array(line("rendered", pages)), warns, F.array(F.lit("ms 0"), F.lit("done")))
    return d.select(F.array_join(rows, "\n").alias("record"))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="docloom", description=__doc__)
    p.add_argument("verb", choices=[*TABLES, "check", "probe", "search", "render", "pdf"])
    p.add_argument("path")
    p.add_argument("needle", nargs="?")
    p.add_argument("--password", default="")
    p.add_argument("--dpi", type=float, default=72.0)
    p.add_argument("--out", type=Path, default=Path())
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    docs = Documents.of(spark, a.path, password=a.password)
    if a.verb in ("render", "pdf"):
        from docloom.sources import raster, synthesis

        a.out.mkdir(parents=True, exist_ok=True)
        made = raster.render_pages(docs.files, a.dpi, a.password).select("doc_id", "page_index", "png") if a.verb == "render" else synthesis.to_pdf(docs.files).select("doc_id", F.lit(0).alias("page_index"), "content")
        for row in made.toLocalIterator():  # files for a person, one at a time
            stem = Path(row[0]).name.rsplit(".", 1)[0]
            name = f"{stem}-{row[1] + 1}.png" if a.verb == "render" else f"{stem}.pdf"
            if row[2] is not None:
                (a.out / name).write_bytes(row[2])
                print(a.out / name)
        return 0
    if a.verb == "probe":
        out = probe(docs).select(F.col("record").alias("line"))
    elif a.verb == "search":
        out = docs.search(a.needle or "").select(F.to_json(F.struct("*")).alias("line"))
    elif a.verb == "check":
        found = docs.table("documents").where(~F.col("opened") | F.col("repaired") | (F.size("warnings") > 0))
        out = found.select(F.to_json(F.struct("doc_id", "opened", "repaired", "warnings")).alias("line"))
    else:
        out = docs.table(TABLES[a.verb]).select(F.to_json(F.struct("*")).alias("line"))
    for row in out.toLocalIterator():
        print(row.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
