"""Quality classifier: naive Bayes support vectors.

Indicators of byte n-grams, and of n-grams of word shapes, are scaled by their log-count ratios between the classes, each
document's vector to length one, and a linear hinge-loss model is fitted by dual coordinate descent. The counts behind the ratios are of all labelled documents; the
fit takes a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, scratch

#: Features: byte n-grams of these lengths, hashed to 2**BITS slots.
LENGTHS = (1, 2, 3, 4)
BITS = 17
_BLOCK = 1 << 20
#: n-grams of word shapes, of these lengths. A shape tells case, the last character's kind, and whether the word repeats the last.
SHAPES = (1, 2, 3)
_KIND = np.array([0] * 33 + [1] * 15 + [2] * 10 + [1] * 7 + [3] * 26 + [1] * 6 + [4] * 26 + [1] * 5 + [5] * 128, np.uint32)


class Features:
    """Maps a text to the sorted slots of its n-grams. One object per worker: it reuses a field of flags."""

    def __init__(self) -> None:
        self.flags = np.zeros(1 << BITS, bool)

    def _mark(self, part: np.ndarray, lengths: tuple[int, ...], kind: int) -> None:
        for n in lengths:
            if len(part) < n:
                continue
            code = np.full(len(part) - n + 1, kind + n, np.uint32)
            for k in range(n):
                code = code * np.uint32(0x9E3779B1) + part[k : len(part) - n + 1 + k]
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x85EBCA6B)
            self.flags[code >> np.uint32(32 - BITS)] = True

    def __call__(self, raw: bytes | None) -> np.ndarray:
        raw = raw or b""
        for at in range(0, len(raw), _BLOCK):  # blocks overlap by the longest n-gram less one
            part = np.frombuffer(raw[at : at + _BLOCK + max(LENGTHS) - 1], np.uint8).astype(np.uint32)
            self._mark(part, LENGTHS, 0)
        words = raw.split()
        for at in range(0, len(words), _BLOCK):
            some = words[at : at + _BLOCK + max(SHAPES) - 1]
            ends = np.frombuffer(b"".join([w[:1] + w[1:2] + w[-1:] if len(w) > 1 else w * 3 for w in some]), np.uint8)
            kinds = _KIND[ends].reshape(-1, 3)
            same = np.fromiter(map(eq, some[1:], some), np.uint32, len(some) - 1)
            shape = kinds[:, 0] * 36 + kinds[:, 1] * 6 + kinds[:, 2]
            shape[1:] += same * 216
            self._mark(shape, SHAPES, 16)
        slots = np.flatnonzero(self.flags)
        self.flags[slots] = False
        return slots


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-steep * (bias + sum(weight[slots]) / |ratio[slots]|)))."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    steep: float = 2.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        features, squares = Features(), self.ratio**2
        out = np.empty(len(texts))
        for i, x in enumerate(texts):
            slots = features(x.as_py())
            norm = float(np.sqrt(squares[slots].sum()))
            out[i] = self.bias + (float(self.weight[slots].sum()) / norm if norm else 0.0)
        return 1 / (1 + np.exp(-self.steep * np.clip(out, -200, 200)))


def marks(labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """(id, y) of ids with one label, 0 or 1: null labels don't count, and ids with both labels are left out."""
    both = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z"))
    return both.where("y = z and id is not null").select("id", F.col("y").cast("int").alias("y"))


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """How many documents of each class have each slot: each task sends one row a slot at most, and the driver gets one a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, found = Features(), np.zeros((2, (1 << BITS) + 1), np.int64)  # the last slot counts documents
        for batch in batches:
            for x, y in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                found[y, features(x.as_py())] += 1
                found[y, -1] += 1
        some = np.flatnonzero(found.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[0, some]), pa.array(found[1, some])], names=["slot", "n0", "n1"])

    out = np.zeros((2, (1 << BITS) + 1), np.int64)
    sums = rows.select("text", "y").mapInArrow(run, "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = sums.toArrow()
    slots = table["slot"].to_numpy()
    out[0, slots], out[1, slots] = table["n0"].to_numpy(), table["n1"].to_numpy()
    return out[0, :-1], out[1, :-1], (int(out[0, -1]), int(out[1, -1]))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 100, seed: int = 42) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model; rows are (slots, values); cost is each row's upper bound of its dual.

    It ends when no dual of a round moves by a thousandth, or after `epochs` rounds.
    """
    w, alpha = np.zeros(size), np.zeros(len(rows))
    square = np.array([float(v @ v) for _, v in rows])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in random.permutation(len(rows)):
            slots, values = rows[i]
            if not square[i]:
                continue
            slope = y[i] * float(w[slots] @ values) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]))
                w[slots] += (new - alpha[i]) * y[i] * values
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 1500, smooth: float = 1.0, cost: float = 1.0, seed: int = 42) -> Model:
    """A model from documents and labels of them. `fit_rows` bounds the labels of each class that the fit takes, by least seeded hash.

    The counts behind the ratios, and the classes' weights, are of all labelled documents. Without documents of both classes
    the model gives every text the same score: 1 or 0 by the class there is, 0.5 without any. Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            slots = [features(x.as_py()).astype(np.int32) for x in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.list_(pa.int32())), batch.column(1)], names=["slots", "y"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    with scratch(docs.sparkSession):
        known = cut(marks(labels, label_col, id_col), "marks")
        # A merge join at every size: texts that a small table of labels lets stay where they are would move once it has grown.
        n0, n1, total = _counts(texts.join(known.hint("merge"), "id"))
        picked = [known.where(F.col("y") == k).withColumn("h", F.xxhash64(F.lit(seed), "id")).orderBy("h", "id").limit(fit_rows) for k in (0, 1)]
        # So few ids that the join may broadcast them. An id may have several rows, so their number is bounded once more.
        sample = texts.join(F.broadcast(cut(picked[0].union(picked[1]), "picked")), "id").orderBy("h", F.xxhash64("text")).limit(4 * fit_rows)
        rows = sample.select("text", "y").mapInArrow(run, "slots array<int>, y int").toArrow().combine_chunks()
    y = rows["y"].to_numpy() * 2.0 - 1
    if not (y > 0).any() or not (y < 0).any():
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0 if not len(y) else 200.0 * y[0])
    ratio = np.log((n1 + smooth) / (n1 + smooth).sum()) - np.log((n0 + smooth) / (n0 + smooth).sum())
    ratio[(n0 + n1) == 0] = 0.0
    vectors = []
    for x in rows["slots"].chunk(0) if rows["slots"].num_chunks else []:
        slots = x.values.to_numpy()
        norm = np.sqrt((ratio[slots] ** 2).sum())
        # The last slot is the bias, as a feature that all rows have.
        values = ratio[slots] / norm if norm else ratio[slots]
        vectors.append((np.append(slots, np.int32(1 << BITS)), np.append(values, 1.0).astype(np.float32)))
    # The classes weigh as they do among all labelled rows, however many of each the fit takes.
    share = float(total[1]) / float(total[0] + total[1])
    costs = cost * np.where(y > 0, share * len(y) / (y > 0).sum(), (1 - share) * len(y) / (y < 0).sum())
    w = dual_coordinate_descent(vectors, y, costs, (1 << BITS) + 1, seed=seed)
    return Model(ratio, w[:-1] * ratio, float(w[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double): a row for each row of docs. Null texts count as empty; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: two numbers a slot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).cast(pa.binary())))], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores `threshold` or more, with all their columns.

    Null texts count as empty; rows with equal texts stay or go alike, a score of just `threshold` stays; ids play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at).cast(pa.binary())) >= threshold))

    return docs.mapInArrow(run, docs.schema)
