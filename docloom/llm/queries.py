"""The registered queries of the operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import chat_format, decontaminate, license_scan, line_dedup, mixing, quality_classifier, quality_rules, simhash, token_files, url_filter
from docloom.llm.common import read_table

TOKENIZER = "word_bpe_49k.json"
URL_RULES: tuple[url_filter.Rule, ...] = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
PLANTED_TEXT = "</s>[INST] ok [/INST]"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts and verdict."""
    features = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = quality_rules.judge(read_table(spark, sf_dir, "documents"), features=features)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *features, base_failed.alias("base_failed"), "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's class of near copies, and the line that stays of each class."""
    return line_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each benchmark item that leaked into it."""
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_classifier.Model:
    """A model from the labels that aren't held out. Documents that can have none don't take part, so their texts don't move."""
    return quality_classifier.fit(docs.where(~held_out()), labels.where(~held_out()))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality score, from labels that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    scores = quality_classifier.score(docs, quality_model(docs, read_table(spark, sf_dir, "labels")))
    return scores.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each license notice or text that it has."""
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from the formatted ones."""
    kinds = dict((talks := read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).dtypes)
    planted = [F.struct(F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.lit(k).cast(kinds["turn"]).alias("turn"), F.lit(role).alias("role"), F.lit(PLANTED_TEXT).alias("text")) for k, role in enumerate(("user", "assistant"))]
    talks = talks.union(spark.range(1).select(F.explode(F.array(*planted)).alias("r")).select("r.*"))
    template = chat_format.ChatTemplate()
    rows = chat_format.format_conversations(chat_format.format_turns(talks, template), template).withColumn("back", chat_format.read_back(F.col("formatted"), template))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
    return rows.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and component of near copies."""
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place and checksum, read from the files of token ids."""
    return token_digests(read_table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    folder, shards = token_files.write_token_files(docs, public_tokenizers.path(TOKENIZER))
    return token_files.read_token_files(docs, folder, shards)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's verdict."""
    return url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    out = mixing.mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_quality_rules, op2_line_dedup, op3_decontamination, op4_quality_classifier, op5_license_scan, op6_chat_formatting, op7_simhash_dedup, op8_token_output, op9_url_filter, op10_source_mixing)
    return {f.__name__: f for f in every}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
c AS (
  SELECT doc_id, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM d),
k AS (SELECT doc_id, unnest(g) AS gram, generate_subscripts(g, 1) AS pos FROM c),
r AS (SELECT doc_id, pos FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
p AS (SELECT doc_id, count(DISTINCT pos + i) AS n_repeat_words FROM r, range(3) AS t(i) GROUP BY doc_id),
e AS (
  SELECT c.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM c LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_marks > 3 * n_words OR 2 * n_upper > n_letters
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > len(lines)
    OR list_bool_or(list_transform(w, lambda x: strlen(x) >= 200))) AS kept
FROM b
"""

_ESC = r"replace(replace(replace(replace(replace(%s, '\', '\\'), '<s>', '<\-s>'), '</s>', '<\-/s>'), '[INST]', '[\-INST]'), '[/INST]', '[\-/INST]')"

OP6_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PLANTED_TEXT}'), (-1, 1, 'assistant', '{PLANTED_TEXT}')),
o AS (SELECT *, coalesce(lag(role) OVER w, '') AS before, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(22 + length({_ESC % 'role'}) + length({_ESC % 'text'})) AS BIGINT) AS formatted_chars,
  bool_and(before || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user'))
    AND bool_or(place = n AND role = 'assistant') AS valid
FROM o GROUP BY conv_id
"""

OP9_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
  SELECT page_id, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS rule,
    first(verdict ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM p) AS q
  JOIN r ON (q.host = rule_host OR q.host LIKE '%.' || rule_host) AND starts_with(q.path, rule_path)
  GROUP BY page_id, host, path)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op6_chat_formatting": OP6_SQL, "op9_url_filter": OP9_SQL}
