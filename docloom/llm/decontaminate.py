"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

An alignment that scores `min_score` of a whole copy's has few errors for its matches, so some of the item's word pairs stand
side by side in it: (2 * min_score - 1) * words - 1 of them at least. All pairs of an item but its most frequent ones, one fewer than
that, are therefore seeds that no such copy can do without; how frequent they are is counted over all documents. Items too short
for a sure pair have single words as seeds in the same way. A document that has a seed of an item is aligned with it in the
stretches around its seeds, unless pairs or words there are too few to reach the score. So no copy that scores enough is lost, however it was edited; and a long enough passage of an item word for word counts, whatever its share.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut

#: Case and punctuation don't tell words apart.
_WORD = re.compile(r"\w+")

MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
#: So many words of an item in a row are a leak, however long the item is.
PASSAGE = 50


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Ids(dict):
    """Words' numbers; -1 for others."""

    def __missing__(self, word: str) -> int:
        return -1


def sure_seeds(size: int, min_score: float) -> tuple[int, int]:
    """(words in a seed, how many of an item's such seeds any alignment with this score has, one at least) for an item of `size` words.

    Of M matches, E errors part E + 1 runs at most, so M - E - 1 pairs stand side by side; 2 * M - E >= 2 * min_score * size and M <= size.
    """
    pairs = math.ceil((2 * min_score - 1) * size - 1 - 1e-9)
    return (2, pairs) if pairs >= 1 else (1, max(1, math.ceil(min_score * size - 1e-9)))


@dataclass
class Block:
    """Some benchmark items in flat arrays: their words as ids, and where each seed stands in them."""

    ids: list[object]
    vocabulary: dict[str, int]
    flat: np.ndarray  # the items' words, one item after the other
    ends: np.ndarray
    grams: np.ndarray  # distinct seeds, sorted
    first: np.ndarray  # of each, where its places begin
    places: np.ndarray  # in flat
    paired: np.ndarray  # of each item, whether its seeds are pairs, not words
    least: np.ndarray  # of each item, how many of its pairs or words a text has to have
    min_score: float

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]], min_score: float) -> Block:
        vocabulary, flat, ends = _Ids(), [], []
        for _, text in rows:
            flat.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int32))
            ends.append(len(flat[-1]))
        sure = [sure_seeds(size, min_score) if size else (1, 1) for size in ends]
        least = np.array([min(m, PASSAGE - 1) if size >= PASSAGE else m for (_, m), size in zip(sure, ends, strict=True)], np.int64)
        none = np.empty(0, np.int64)
        block = cls([i for i, _ in rows], vocabulary, np.concatenate(flat), np.cumsum(ends), none, none, none, np.array([n == 2 for n, _ in sure]), least, min_score)
        codes = block.codes_of(np.arange(len(ends)))
        places = np.flatnonzero(codes >= 0)
        return block.keep(places, codes[places])

    def keep(self, at: np.ndarray, codes: np.ndarray) -> Block:
        """The block with only these places of seeds."""
        order = np.argsort(codes, kind="stable")
        grams, first = np.unique(codes[order], return_index=True)
        return replace(self, grams=grams, first=np.append(first, len(at)), places=at[order].astype(np.int32))

    def item(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k - 1] if k else 0 : self.ends[k]]

    def codes(self, ids: np.ndarray, n: int) -> np.ndarray:
        """A number for each run of n words, n 1 or 2; -1 where a word isn't in the vocabulary."""
        if n == 1:
            return ids.astype(np.int64)
        a, b, size = ids[:-1].astype(np.int64), ids[1:], max(1, len(self.vocabulary))
        return np.where((a >= 0) & (b >= 0), size + a * size + b, -1)

    def codes_of(self, items: np.ndarray) -> np.ndarray:
        """For each word of the items one after the other the code of the seed that begins there, -1 for none."""
        sizes = np.diff(self.ends, prepend=0)[items]
        starts = np.cumsum(sizes) - sizes
        places = np.repeat(self.ends[items] - sizes - starts, sizes) + np.arange(sizes.sum())
        one = self.flat[places].astype(np.int64)
        paired = np.repeat(self.paired[items], sizes)
        last = places == np.repeat(self.ends[items] - 1, sizes)
        size = max(1, len(self.vocabulary))
        return np.where(paired, np.where(last, -1, size + one * size + self.flat[np.minimum(places + 1, len(self.flat) - 1)]), one)

    def text(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words))

    def hits(self, every: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(places in the text of seeds, which seeds) from the codes of its words and pairs."""
        at, which = [], []
        for codes in every:
            some = np.flatnonzero(codes >= 0)
            found = np.searchsorted(self.grams, codes[some])
            ok = found < len(self.grams)
            some, found = some[ok], found[ok]
            ok = self.grams[found] == codes[some]
            at.append(some[ok])
            which.append(found[ok])
        return np.concatenate(at), np.concatenate(which)

    def likely(self, items: np.ndarray, every: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Those of the items of whose pairs or words the text has as many as any copy or passage."""
        known = np.sort(np.concatenate(every))
        sizes = np.diff(self.ends, prepend=0)[items]
        starts = np.cumsum(sizes) - sizes
        codes = self.codes_of(items)
        there = (codes >= 0) & (known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes)
        return items[np.add.reduceat(there.astype(np.int64), starts) >= self.least[items]]

    def rare(self, frequency: np.ndarray) -> Block:
        """The block with the seeds that are left when each item gives up its most frequent places.

        It gives up one fewer than any copy has, and fewer than a passage of PASSAGE words has.
        """
        which = np.repeat(np.arange(len(self.grams)), np.diff(self.first))
        item = np.searchsorted(self.ends, self.places, side="right")
        order = np.lexsort((self.places, -frequency[which], item))
        rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        sizes = np.diff(np.append(0, self.ends))
        spare = np.array([min(sure_seeds(int(s), self.min_score)[1] - 1, PASSAGE - 2) if s else 0 for s in sizes])
        kept = order[rank >= spare[item[order]]]
        return self.keep(self.places[kept], self.grams[which[kept]])


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """(score, end in text) of the best local alignment with linear gaps, one row of the matrix at a time."""
    steps = np.arange(len(text) + 1) * GAP
    row, best, end = np.zeros(len(text) + 1), 0.0, 0
    for w in item:
        new = np.maximum(row + GAP, 0.0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(new - steps) + steps  # gaps in the item
        if (top := row.max()) > best:
            best, end = float(top), int(row.argmax())
    return best, end


def _passage(item: np.ndarray, ids: np.ndarray) -> tuple[int, int] | None:
    """(first word, end word) in the text of the longest run of the item's words, the first of equals; null below PASSAGE words."""
    if len(item) < PASSAGE:
        return None
    size = np.int64(max(item.max(), ids.max()) + 1)
    mine, its = item[:-1] * size + item[1:], np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * size + ids[1:], -1)
    order = np.argsort(mine, kind="stable")
    at = np.flatnonzero(np.isin(its, mine))
    lo, hi = np.searchsorted(mine[order], its[at]), np.searchsorted(mine[order], its[at], side="right")
    offsets: Counter[int] = Counter()
    for p, i, j in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
        offsets.update((p - order[i:j]).tolist())
    best = (0, 0)
    for o, hits in sorted(offsets.items()):
        if hits < PASSAGE - 1:  # such a run has that many pairs, all of them as far from the item's
            continue
        lo_, hi_ = max(0, o), min(len(ids), o + len(item))
        breaks = np.concatenate(([-1], np.flatnonzero(ids[lo_:hi_] != item[lo_ - o : hi_ - o]), [hi_ - lo_]))
        at_ = int(np.diff(breaks).argmax())
        run = lo_ + int(breaks[at_]) + 1, lo_ + int(breaks[at_ + 1])
        if run[1] - run[0] > best[1] - best[0]:
            best = run
    return best if best[1] - best[0] >= PASSAGE else None


def _matches(block: Block, text: str | None) -> Iterator[tuple[object, float, int, int]]:
    """(item id, score, first word, end word) of each item that leaked into the text."""
    ids = block.text(text)
    every = block.codes(ids, 1), block.codes(ids, 2)
    at, which = block.hits(every)
    if not len(at):
        return
    many = block.first[which + 1] - block.first[which]
    spots = block.places[np.repeat(block.first[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    item_of = np.searchsorted(block.ends, spots, side="right")
    offsets = np.repeat(at, many) - (spots - np.append(0, block.ends)[item_of])
    kept = np.isin(item_of, block.likely(np.unique(item_of), every))
    item_of, offsets = item_of[kept], offsets[kept]
    if not len(item_of):
        return
    order = np.lexsort((offsets, item_of))
    item_of, offsets = item_of[order], offsets[order]
    firsts = np.flatnonzero(np.append(True, item_of[1:] != item_of[:-1])).tolist()
    for i, j in zip(firsts, [*firsts[1:], len(item_of)], strict=True):
        k = int(item_of[i])
        item = block.item(k).astype(np.int64)
        slack = math.floor((2 - 2 * block.min_score) * len(item)) + 1  # no alignment has more errors
        n, needed = sure_seeds(len(item), block.min_score)
        mine, want = block.codes(item, n), None
        near, found = np.unique(offsets[i:j]), None
        breaks = np.flatnonzero(np.diff(near) > len(item) + 2 * slack) + 1
        for part in np.split(near, breaks):
            lo, hi = max(0, int(part[0]) - slack), min(len(ids), int(part[-1]) + len(item) + slack)
            some = ids[lo:hi]
            if np.isin(mine, every[n - 1][lo : hi + 1 - n]).sum() < needed:
                continue
            if want is None:
                words, want = np.unique(item, return_counts=True)
            known = np.sort(some[some >= 0])
            have = np.searchsorted(known, words, side="right") - np.searchsorted(known, words)
            # No alignment matches more words than the two have in common.
            if np.minimum(have, want).sum() < block.min_score * len(item):
                continue
            score, end = align(item, some)
            if (score := score / (MATCH * len(item))) >= block.min_score and (found is None or score > found[0]):
                found = (score, lo, lo + end)
        if found:
            yield block.ids[k], found[0], max(found[1], found[2] - len(item) - slack), found[2]
        elif (passage := _passage(item, ids.astype(np.int64))) is not None:
            yield block.ids[k], (passage[1] - passage[0]) / len(item), *passage


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in blocks of up to `block_chars` characters (one item at least), one at a time through the driver."""
    rows, size = [], 0
    for r in benchmark.select(id_col, F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        if rows and size + len(r[1]) > block_chars:
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len(r[1])
    if rows:
        yield rows


def _seeded(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, min_score: float, block_chars: int) -> Iterator[Broadcast]:
    """Each block of the benchmark with its rare seeds, by their counts over all documents."""
    spark = docs.sparkSession
    for items in _blocks(benchmark, item_col, item_text_col, block_chars):
        whole = Block.of(items, min_score)
        sent = spark.sparkContext.broadcast(whole)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            found = np.zeros(len(block.grams), np.int64)
            for batch in batches:
                for x in batch.column(0):
                    ids = block.text(x.as_py())
                    found[np.unique(block.hits((block.codes(ids, 1), block.codes(ids, 2)))[1])] += 1
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some])], names=["gram", "docs"])

        texts = docs.select(F.col(text_col).cast("string").alias("text"))
        table = texts.mapInArrow(count, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs")).toArrow()
        sent.destroy()
        frequency = np.zeros(len(whole.grams), np.int64)
        frequency[table["gram"].to_numpy()] = table["docs"].to_numpy()
        yield spark.sparkContext.broadcast(whole.rare(frequency))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = 0.6, block_chars: int = 16_000_000) -> DataFrame:
    """(id_col, item_col, score, first_word, end_word): a row for each document and item that leaked into it.

    score is the best local alignment's share of a whole copy's score; all with `min_score` or more are found. PASSAGE words of an
    item in a row are a leak too, where no alignment reaches min_score; score is then the longest such passage's share of
    the item. An item of a word or two has leaked wherever they stand (two with a word between at most). The benchmark
    passes in blocks of bounded size, each against all documents, whole texts, in two passes; what was found is written to the
    shared folder (drop_cut() deletes it). Null texts have no words; documents that repeat give a row each; items without words are never found, items
    that repeat are found each; without documents or items the result is empty; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item_kind = pa.string() if dict(benchmark.dtypes)[item_col] == "string" else pa.int64()
    schema = f"id {dict(docs.dtypes)[id_col]}, item {'string' if item_kind == pa.string() else 'long'}, score double, first_word long, end_word long"
    out, found_in = docs.sparkSession.createDataFrame([], schema), []
    for sent in _seeded(docs, benchmark, text_col, item_col, item_text_col, min_score, block_chars):

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = [], []
                for doc_id, x in zip(batch.column(0), batch.column(1), strict=True):
                    for m in _matches(sent.value, x.as_py()):
                        ids.append(doc_id.as_py())
                        found.append(m)
                cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
                kinds = (item_kind, pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["id", "item", "score", "first_word", "end_word"])

        found_in.append(cut(rows.mapInArrow(match, schema), "leaks"))
        out = out.union(found_in[-1])
        sent.destroy()
    out = out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score", "first_word", "end_word")
    out.cut_paths = [t.cut_path for t in found_in]
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = 0.6, block_chars: int = 16_000_000) -> DataFrame:
    """The rows of docs, with all their columns, that find_leaks() has no row for.

    Null and empty texts stay; rows that repeat stay or go alike; ids play no part, so null and equal ones do no harm.
    """
    at, out = docs.columns.index(text_col), docs
    for sent in _seeded(docs, benchmark, text_col, item_col, item_text_col, min_score, block_chars):

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).cast(pa.string())
                yield batch.filter(pa.array([next(_matches(sent.value, x.as_py()), None) is None for x in texts], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
