"""Reports of probing files: outcomes per file, and the documents that keep them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.maps import probe_record
from docloom.operators import report

SCHEMA_VERSION = 1


def results(records: DataFrame, text_col: str = "record", timed_out_col: str | None = None) -> DataFrame:
    """records with outcome, reason, pages, capabilities, warnings and millis: no whole record is a crash, or a time out."""
    parsed = records.withColumn("__p", probe_record(F.col(text_col)))
    late = F.coalesce(F.col(timed_out_col), F.lit(False)) if timed_out_col else F.lit(False)
    p = F.col("__p")
    failed = ~p["opened"] | (F.coalesce(p["rendered"], F.lit(0)) < F.coalesce(p["pages"], F.lit(0)))
    outcome = F.when(late, "timed_out").when(p.isNull(), "crashed").when(failed, "failed").otherwise("passed")
    out = parsed.withColumn("outcome", outcome)
    for name in ("reason", "pages", "rendered", "capabilities", "warnings", "millis"):
        out = out.withColumn(name, p[name])
    empty = F.expr("cast(map() as map<string,int>)")
    return out.withColumn("warnings", F.coalesce("warnings", empty)).withColumn("capabilities", F.coalesce("capabilities", F.expr("cast(array() as array<string>)"))).drop("__p")


def degraded(warnings: Column) -> Column:
    return F.size(F.map_keys(warnings)) > 0


def report_json(files: DataFrame) -> DataFrame:
    """(path, json): a JSON object for each file, keys in a fixed order."""
    cols = [c for c in ("corpus", "path", "outcome", "reason", "pages", "rendered", "warnings", "capabilities", "millis") if c in files.columns]
    return files.select("path", F.to_json(F.struct(*cols)).alias("json"))


def ratchet(files: DataFrame) -> DataFrame:
    """(corpus, json): the bar that the next run is held against, a row per corpus."""
    rows = files.withColumn("warnings", F.map_keys("warnings"))
    sums = report.summary(rows).where("corpus is not null")
    counts = report.outcomes(files).groupBy("corpus").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("outcome", "files")))).alias("outcomes"))
    caps = report.files_per(files, "capabilities", "capability").groupBy("corpus").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("capability", "files")))).alias("capabilities"))
    joined = sums.join(counts, "corpus").join(caps, "corpus", "left")
    return joined.select("corpus", F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema"), F.col("corpus").alias("name"), "total", "passed", "degraded", "outcomes", "capabilities")).alias("json"))


RATCHET_SCHEMA = "schema int, name string, total long, passed long, degraded long, outcomes map<string,long>, capabilities map<string,long>"


def read_ratchet(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """(corpus, total, passed) of documents that ratchet() wrote; those of another version are left out."""
    parsed = rows.select(F.from_json(json_col, RATCHET_SCHEMA).alias("r")).select("r.*")
    return parsed.where(F.col("schema") == SCHEMA_VERSION).select(F.col("name").alias("corpus"), "total", "passed")


def lock_entries(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(name, url, commit, sha256) of lines of four fields; comments and blank lines don't count, other lines have null fields."""
    text = F.trim(F.regexp_replace(line_col, "#.*$", ""))
    part = F.split(text, r"\s+")
    return lines.where(text != "").select(*[F.get(part, i).alias(n) for i, n in enumerate(("name", "url", "commit", "sha256"))])
