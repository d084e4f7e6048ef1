"""SimHash near-duplicates by deletion-variant signatures.

The fingerprint of 64 bits is cut into two segments of 32, so that of two fingerprints at three or fewer differing bits one
segment differs by at most one. Each segment is indexed once as it is and once for each of its bits with that bit deleted;
an equality join on these signatures, verified by the number of differing bits inside the join, finds every link. A link by
a deletion variant joins only fingerprints that differ in the deleted bit, so each pair meets at most twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import sketches
from docloom.llm.common import components, cut, scratch, unused

SEED = 42
#: Two segments with one deletion each hold for three differing bits, no more.
MAX_BITS = 3
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None, shingle_words: int = 3) -> int:
    """The SimHash of a text in UTF-8: bit i is set if it is set in over half of the XXH64 of the text's word shingles.

    Repeated shingles count each time. A text of fewer words is one shingle; one without words, or null, has fingerprint 0.
    """
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-shingle_words] + 1)).tolist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # in blocks, so that a very long text takes no more memory
        ones += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id_col, fp long): a row for each row of docs. Null texts count as empty; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(x.as_py(), shingle_words) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, fp long").withColumnRenamed("id", id_col)


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _variants(segment: int) -> Column:
    """Of one segment: its value, and 32 values with one bit deleted and that bit beside them."""
    value = F.shiftrightunsigned("fp", 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF))
    whole = F.struct(value.bitwiseOR(F.lit((2 * segment) << 32)).alias("v"), F.lit(-1).alias("w"), F.lit(0).alias("bit"))

    def without(w: Column) -> Column:
        rest = value.bitwiseAND(F.bitwise_not(_bit(w))).bitwiseOR(F.lit((2 * segment + 1) << 32))
        return F.struct(rest.alias("v"), w.alias("w"), F.call_function("shiftrightunsigned", value, w).bitwiseAND(F.lit(1)).cast("int").alias("bit"))

    return F.concat(F.array(whole), F.transform(F.sequence(F.lit(0), F.lit(31)), without))


def _signatures(fps: DataFrame) -> DataFrame:
    """(key, bit, fp): the segments as they are (their key is below 1 << 40) and with one bit deleted, which is `bit`."""
    # A row becomes 66, so the rows are dealt out before, whatever few files they come from.
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = spread.select("fp", F.explode(F.concat(_variants(0), _variants(1))).alias("s"))
    return rows.select(F.col("s.v").bitwiseOR(F.call_function("shiftleft", (F.col("s.w") + 1).cast("long"), F.lit(40))).alias("key"), F.col("s.bit").alias("bit"), "fp")


def _ball(distance_two: bool) -> Column:
    """All values at Hamming distance 0 and 1 of fp, or at exactly 2."""
    if not distance_two:
        return F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(_bit(i))))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: F.transform(F.sequence(F.lit(0), i - 1), lambda j: F.col("fp").bitwiseXOR(_bit(i)).bitwiseXOR(_bit(j)))))


def _links_of_crowds(fps: DataFrame) -> DataFrame:
    """Links that connect whatever lies within three bits among `fps`, without comparing pairs.

    Two fingerprints at three bits or fewer have a point within one bit of the first and two of the second. Each fingerprint
    goes to all 2081 points within two bits; a point that some fingerprint reaches within one bit links all that reach it to
    the least of those. No point gets over 2081 distinct fingerprints, so no group of copies is ever crowded.
    """
    near = fps.select("fp", F.explode(_ball(False)).alias("z"), F.lit(True).alias("near"))
    far = fps.select("fp", F.explode(_ball(True)).alias("z"), F.lit(False).alias("near"))
    points = near.union(far).groupBy("z").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("least"), F.collect_list("fp").alias("all"))
    return points.where(F.col("least").isNotNull() & (F.size("all") > 1)).select(F.col("least").alias("a"), F.explode("all").alias("b")).where("a != b").distinct()


def links(fps: DataFrame, crowd: int = 512) -> DataFrame:
    """(a, b): links between distinct fingerprints of `fps` (a column fp, without repeats) at MAX_BITS or fewer.

    Signatures that up to `crowd` fingerprints share are joined and verified. Fingerprints that share a signature with more
    go by _links_of_crowds() instead, which gives links that connect the same fingerprints. `crowd` thus only chooses the way.
    """
    rows = _signatures(fps)
    shared = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("bit").alias("lo"), F.max("bit").alias("hi")).where((F.col("n") > 1) & ((F.shiftrightunsigned("key", 40) == 0) | (F.col("lo") != F.col("hi")))).select("key", "n"), "keys")
    some = cut(rows.join(shared, "key"), "signatures")
    left = some.where(F.col("n") <= crowd)
    right = left.select(F.col("key").alias("key_b"), F.col("bit").alias("bit_b"), F.col("fp").alias("b"))
    whole = F.shiftrightunsigned("key", 40) == 0
    pairs = left.join(
        right,
        (F.col("key") == F.col("key_b")) & ((whole & (F.col("fp") < F.col("b"))) | (~whole & (F.col("bit") < F.col("bit_b")))) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= MAX_BITS),
    ).select(F.col("fp").alias("a"), "b")
    if some.where(F.col("n") > crowd).isEmpty():
        return pairs.distinct()
    crowded = some.where(F.col("n") > crowd).select("fp").distinct()
    return pairs.union(_links_of_crowds(crowded)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, crowd: int = 512) -> DataFrame:
    """(id_col, fp long, root long, component_id): a row for each row of docs.

    root is the least fingerprint and component_id the smallest id of the component. Null and empty texts have fingerprint 0
    and are linked like any other; a null id takes no part in the smallest id. Rows that repeat are kept. Columns of docs
    other than the two named are ignored. An empty table gives an empty result. The result reads two tables in the shared
    folder: drop_cut() deletes them.
    """
    with scratch(docs.sparkSession) as keep:
        rows = cut(fingerprints(docs.select(id_col, text_col), id_col, text_col, shingle_words).withColumnRenamed(id_col, "id"), "fingerprints")
        least = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
        roots = components(links(least.select("fp"), crowd=crowd))
        rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        # The components with links only: all other fingerprints are their own.
        smallest = roots.withColumnRenamed("node", "fp").join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
        # As a table of its own, so that the join shuffles both sides and Spark may split a common fingerprint's.
        named = cut(rooted.join(smallest, "root", "left").select("fp", "root", F.coalesce("component_id", "least").alias("component_id")), "named")
        return keep(rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "root", "component_id"), rows, named)


def _signed(n: int) -> int:
    return n - ((n >> 63) << 64)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """One row of docs of each component, with all its columns: that of the smallest id (null first), then fingerprint.

    Where an id stands for one row, which the counts tell, a semi join on ids does it. Rows that share an id, and those
    without, are told apart by their fingerprints.
    """
    with scratch(docs.sparkSession) as keep:
        found = near_duplicates(docs, id_col, text_col, shingle_words)
        return _firsts(docs, found, lambda raw: _signed(fingerprint(raw, shingle_words)), id_col, text_col, keep)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The same for documents whose sets of `words`-word shingles have a Jaccard similarity of `similarity` or more: see sketches."""
    with scratch(docs.sparkSession) as keep:
        found = sketches.near_copies(docs, id_col, text_col, words, similarity)
        return _firsts(docs, found, lambda raw: sketches.set_id(sketches.shingles(raw, words)), id_col, text_col, keep)


def _firsts(docs: DataFrame, found: DataFrame, number: Callable[[bytes | None], int], id_col: str, text_col: str, keep: Callable[..., DataFrame]) -> DataFrame:
    """The first row of docs of each root of found (id_col, fp, root, ...); number() gives a text's fp."""
    found = found.withColumnRenamed(id_col, "id")
    first = cut(found.groupBy("root").agg(F.min(F.struct("id", "fp")).alias("first")).select("first.id", "first.fp"), "first")
    shared = cut(found.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id"), "shared")
    names = docs.columns
    once = first.join(shared, first["id"].eqNullSafe(shared["id"]), "left_anti").select("id")
    out = docs.join(once, docs[id_col] == once["id"], "left_semi")
    if shared.isEmpty():
        return keep(out, first, shared)
    (mark,) = unused(docs, "fp")
    some = docs.join(shared, docs[id_col].eqNullSafe(shared["id"]), "left_semi")
    at = names.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [number(x.as_py()) for x in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], names=[*names, mark])

    some = some.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(mark, T.LongType())])).dropDuplicates([id_col, mark])
    return keep(out.union(some.join(first, some[id_col].eqNullSafe(first["id"]) & (some[mark] == first["fp"]), "left_semi").select(*names)), first, shared)
