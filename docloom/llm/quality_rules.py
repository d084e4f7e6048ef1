"""Quality rules as a short-circuit cascade.

Each rule's cost and share of rejections is estimated on a sample; the rules then run in the order of rejections per cost, and
a document that one rejects isn't put to the rest. What a rule needs of a text is worked out when first asked for and kept
while the document is judged, so a cheap rule never pays for a dear one. The order has no bearing on what is kept.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACES

_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_LONG_RUN = re.compile(rb"[^ \t\n\x0b\x0c\r]{200,}")


class Text:
    """What rules ask about one text, in UTF-8; null counts as empty."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words."""
        return len(self.raw.translate(None, SPACES + _CONTINUATION))

    def count(self, of: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, of))

    @cached_property
    def n_symbols(self) -> int:
        return self.count(_SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that have a word."""
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        """Lines with a word that equal an earlier one."""
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that the text has twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), np.int64, n)
        size = len(ids)
        pair = code[:-1] * size + code[1:]
        if size > 2_000_000:  # three ids don't fit into one number
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * size + code[2:]
        _, which, times = np.unique(window, return_inverse=True, return_counts=True)
        again = times[which] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        return int(covered.sum())

    @cached_property
    def n_upper(self) -> int:
        return self.count(_UPPER)

    @cached_property
    def n_letters(self) -> int:
        return self.count(_UPPER + _LOWER)


@dataclass(frozen=True)
class Rule:
    """rejects(text) says whether the document goes. A base rule is told apart in the result."""

    name: str
    rejects: Callable[[Text], bool]
    base: bool = False


#: All thresholds are in whole numbers, so no rounding decides.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", lambda t: t.n_words < 50, base=True),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words, base=True),
    Rule("symbols_per_word", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("exclamations_per_word", lambda t: 10 * t.count(b"!") > 3 * t.n_words),
    Rule("capitals", lambda t: 2 * t.n_upper > t.n_letters),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("duplicate_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("long_run", lambda t: _LONG_RUN.search(t.raw) is not None),
)


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = 256, seed: int = 42, features: Sequence[str] = ()) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a document, share rejected) for each rule, on a random sample of about `sample_rows` documents of the table.

    Each rule is timed alone on each sampled text; what `features` give is worked out before, since it is paid for anyway.
    The driver gets two numbers a rule and sampled row. An empty table gives zeros.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).cast(pa.binary()):
                raw, spent, out = x.as_py(), [], []
                for rule in rules:
                    text = Text(raw)
                    for name in features:
                        getattr(text, name)
                    began = time.perf_counter()
                    out.append(bool(rule.rejects(text)))
                    spent.append(time.perf_counter() - began)
                yield pa.RecordBatch.from_arrays([pa.array([spent], pa.list_(pa.float64())), pa.array([out], pa.list_(pa.bool_()))], names=["spent", "out"])

    # The share of rows is such that the sample is of the whole table, not of its first files.
    total = docs.count()
    texts = docs.select(F.col(text_col).cast("string").alias("text")).sample(False, min(1.0, sample_rows / max(1, total)), seed)
    rows = texts.mapInArrow(measure, "spent array<double>, out array<boolean>").limit(4 * sample_rows).collect()
    n = max(1, len(rows))
    return [(rule, sum(r["spent"][i] for r in rows) / n, sum(r["out"][i] for r in rows) / n) for i, rule in enumerate(rules)]


def order(estimates: Sequence[tuple[Rule, float, float]]) -> list[Rule]:
    """By rejections per cost, most first; rules that rejected nothing come last, the cheapest first."""
    return [rule for rule, cost, share in sorted(estimates, key=lambda x: (-x[2] / max(x[1], 1e-9), x[1], x[0].name))]


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", features: Sequence[str] = (), sample_rows: int = 256) -> DataFrame:
    """(id_col, kept, rejected_by, rules_run, *features): a row for each row of docs.

    rejected_by names the rule that ended the cascade, null if kept; which of several fitting rules that is, and rules_run,
    depend on the order that the sample gave. features are attributes of Text (long) to return besides, for every row: rules on
    those alone cost next to nothing and come early. Null
    and empty texts are judged as texts without words; rows that repeat are judged alike; other columns are ignored.
    """
    cascade = order(estimate(docs, rules, text_col, sample_rows, features=features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by, ran, extra = [], [], [[] for _ in features]
            for x in batch.column(1).cast(pa.binary()):
                text, n = Text(x.as_py()), 0
                for n, rule in enumerate(cascade, 1):  # noqa: B007
                    if rule.rejects(text):
                        by.append(rule.name)
                        break
                else:
                    by.append(None)
                ran.append(n)
                for values, name in zip(extra, features, strict=True):
                    values.append(getattr(text, name))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(by, pa.string()), pa.array(ran, pa.int32()), *[pa.array(v, pa.int64()) for v in extra]], names=["id", "rejected_by", "rules_run", *features])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([f"id {dict(docs.dtypes)[id_col]}", "rejected_by string", "rules_run int", *[f"{x} long" for x in features]])
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), F.col("rejected_by").isNull().alias("kept"), "rejected_by", "rules_run", *features)
