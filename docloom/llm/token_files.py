"""Token ids in Arrow files of fixed-size-list batches.

Documents are dealt out by ranges of their id and sorted; each partition tokenises its own and writes one shard, an Arrow file
whose rows are sequences of `sequence` ids with two masks of the same length, of bits (valid: no padding; last: a document's last
id), and beside it an Arrow file with each document's id, start within the shard and number of ids. Ids take two bytes where
the vocabulary allows it, else four. All rows of a shard but its last
are full, so id k of a shard stands in row k // sequence: a reader maps the file into memory and copies nothing.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import fresh_path

END_ID = 1
_BATCH_ROWS = 256
#: So many words, and as many letter runs, a worker keeps; beyond, it starts anew.
_CACHE_WORDS = 200_000
#: A run of letters that lower-case one by one to themselves in composed form, then ASCII marks other than the apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder:
    """Ids of a text from the tokenizers library, with the ids of what occurs again kept.

    This holds for tokenizers that lower-case, drop white space, never join characters across it, and split letters from marks:
    the ids of a text are those of its words one after the other, and the ids of a plain word those of its letters, for which
    the library's model is asked directly, and of its marks. The constructor refuses a tokenizer that fails this on a text
    made for it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.to_bytes = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()})
        probe = "It's  3 cafés,\n'll ́a <|x|>\tİ end.\x0b\x0c\r Å" + " ".join(f"{c}a{c.lower()}Zz{c}!?," for c in map(chr, range(0x41, 0x100)) if c.isalpha())
        if self(probe.encode()).tolist() != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path}: words can't be encoded one by one")

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, run: str) -> bytes:
        if (found := self.letters.get(run)) is None:
            plain = run if run.isascii() else run.translate(self.to_bytes)
            found = self.letters[run] = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
        return found

    def _learn(self, new: set[bytes]) -> None:
        rest: list[bytes] = []
        for w in new:
            if plain := _PLAIN.fullmatch(w.decode("utf-8", "replace")):
                run, marks = plain.groups()
                if marks not in self.marks:
                    self.marks[marks] = self._library([marks])[0]
                self.words[w] = self._letters(run.lower()) + self.marks[marks]
            else:
                rest.append(w)
        for at in range(0, len(rest), 10_000):
            some = rest[at : at + 10_000]
            self.words.update(zip(some, self._library([w.decode("utf-8", "replace") for w in some]), strict=True))

    def __call__(self, raw: bytes | None) -> np.ndarray:
        words = (raw or b"").split()
        if new := set(words).difference(self.words):
            for kept in (self.words, self.letters, self.marks):
                if len(kept) + len(new) > _CACHE_WORDS:
                    kept.clear()
                    self.marks[""] = b""
                    new = set(words)
            self._learn(new.difference(self.words))
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4")


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each worker process, which runs many tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


@dataclass(frozen=True)
class Shard:
    path: str
    part: int
    docs: int
    tokens: int


class ShardWriter:
    """Writes one shard under a name of its own and moves it to its place when whole, so a task that runs again does no harm."""

    def __init__(self, folder: str, part: int, sequence: int, id_type: pa.DataType, token_type: pa.DataType):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.part, self.sequence, self.mark = part, sequence, uuid.uuid4().hex
        self.dtype = token_type.to_pandas_dtype()
        self.schema = pa.schema([("ids", pa.list_(token_type, sequence)), ("valid", pa.list_(pa.bool_(), sequence)), ("last", pa.list_(pa.bool_(), sequence))])
        self.index_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = {kind: self.fs.open_output_stream(f"{self.base}/.{self.mark}.{kind}") for kind in ("ids", "index")}
        self.ids = pa.ipc.new_file(self.sinks["ids"], self.schema)
        self.index = pa.ipc.new_file(self.sinks["index"], self.index_schema)
        self.rows: list[np.ndarray] = []
        self.lasts: list[np.ndarray] = []
        self.waiting, self.tokens, self.docs = 0, 0, 0
        self.entries: list[list[Any]] = [[], [], []]

    def add(self, doc_id: Any, ids: np.ndarray) -> None:
        last = np.zeros(len(ids), bool)
        last[-1] = True
        for values, x in zip(self.entries, (doc_id, self.tokens, len(ids)), strict=True):
            values.append(x)
        self.rows.append(ids.astype(self.dtype))
        self.lasts.append(last)
        self.waiting += len(ids)
        self.tokens += len(ids)
        self.docs += 1
        if self.waiting >= self.sequence * _BATCH_ROWS:
            self._flush(self.waiting // self.sequence * self.sequence)
        if len(self.entries[0]) >= 65536:
            self._flush_index()

    def _flush(self, n: int) -> None:
        ids, last = np.concatenate([*self.rows, np.empty(0, self.dtype)]), np.concatenate([*self.lasts, np.empty(0, bool)])
        self.rows, self.lasts, self.waiting = [ids[n:]], [last[n:]], len(ids) - n
        self._write(ids[:n], np.ones(n, bool), last[:n])

    def _write(self, *columns: np.ndarray) -> None:
        for at in range(0, len(columns[0]), self.sequence * _BATCH_ROWS):
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(c[at : at + self.sequence * _BATCH_ROWS]), self.sequence) for c in columns]
            self.ids.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def _flush_index(self) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(self.entries, self.index_schema, strict=True)], schema=self.index_schema))
        self.entries = [[], [], []]

    def close(self) -> Shard:
        self._flush(self.waiting // self.sequence * self.sequence)
        if self.waiting:
            ids, valid, last = np.zeros(self.sequence, self.dtype), np.zeros(self.sequence, bool), np.zeros(self.sequence, bool)
            ids[: self.waiting], valid[: self.waiting], last[: self.waiting] = self.rows[0], True, self.lasts[0]
            self._write(ids, valid, last)
        self._flush_index()
        for kind, writer in (("ids", self.ids), ("index", self.index)):
            writer.close()
            self.sinks[kind].close()
            self.fs.move(f"{self.base}/.{self.mark}.{kind}", f"{self.base}/shard-{self.part:06d}-{self.mark}.{kind}.arrow")
        return Shard(f"shard-{self.part:06d}-{self.mark}", self.part, self.docs, self.tokens)


def read_shard(folder: str, shard: str) -> Iterator[tuple[pa.RecordBatch, Callable[[int, int], np.ndarray]]]:
    """The index batches of a shard, each with a function from (start, n_tokens) to the document's ids.

    In a local file system the file is mapped, and ids that lie within one batch are a view of it.
    """
    fs, base = pafs.FileSystem.from_uri(folder)
    local = isinstance(fs, pafs.LocalFileSystem)

    def opened(kind: str) -> pa.ipc.RecordBatchFileReader:
        path = f"{base}/{shard}.{kind}.arrow"
        return pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))

    ids, index = opened("ids"), opened("index")
    sequence = ids.schema.field("ids").type.list_size
    firsts: list[int] = [0]  # the first id of each batch; few numbers, as a batch has many rows
    for k in range(ids.num_record_batches):
        firsts.append(firsts[-1] + ids.get_batch(k).num_rows * sequence)
    starts = np.array(firsts)
    held: dict[int, np.ndarray] = {}

    def batch(k: int) -> np.ndarray:
        if k not in held:
            held.clear()
            held[k] = ids.get_batch(k).column(0).flatten().to_numpy()
        return held[k]

    def get(start: int, n: int) -> np.ndarray:
        out, k = [], int(np.searchsorted(starts, start, "right")) - 1
        while n > 0:
            at = start - firsts[k]
            out.append(batch(k)[at : at + n])
            start, n, k = start + len(out[-1]), n - len(out[-1]), k + 1
        return out[0] if len(out) == 1 else np.concatenate(out)

    for k in range(index.num_record_batches):
        yield index.get_batch(k), get


def _vocabulary(path: str) -> int:
    """One more than the greatest id."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values(), default=0) + 1


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence: int = 2048, end_id: int = END_ID, parts: int | None = None) -> tuple[str, list[Shard]]:
    """Writes docs in ascending id order and returns the folder and its shards, whose number is that of the partitions.

    Null ids come first, rows of one id follow each other by text, null texts are empty: they have the end id only. An empty
    table gives no shard. The folder must be one that the executors share and Arrow can write to (file, hdfs, s3, gs); its
    default is a new one in spark.checkpoint.dir. A manifest.json names the shards that count: those of tasks that ran twice
    stay unnamed.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = pa.int64() if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") else pa.string()

    token_type = pa.uint16() if max(_vocabulary(tokenizer), end_id + 1) <= 1 << 16 else pa.uint32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = encode = None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                writer = writer or ShardWriter(folder, TaskContext.get().partitionId(), sequence, id_type, token_type)
                encode = encode or _encoder(tokenizer)
                writer.add(doc_id.as_py(), np.concatenate((encode(text.as_py()), end)))
        if writer:
            done = writer.close()
            yield pa.RecordBatch.from_pylist([{"path": done.path, "part": done.part, "docs": done.docs, "tokens": done.tokens}], schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long" if id_type == pa.int64() else "string").alias("id"), F.col(text_col).cast("string").alias("text"))
    # By the start of the text too, so that many rows of one id aren't one task.
    ordered = rows.repartitionByRange(parts, F.col("id").asc_nulls_first(), F.left("text", F.lit(32)).asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    shards = [Shard(**r.asDict()) for r in ordered.mapInArrow(run, "path string, part int, docs long, tokens long").collect()]
    shards.sort(key=lambda s: s.part)
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"sequence": sequence, "end_id": end_id, "shards": [vars(s) for s in shards]}).encode())
    return folder, shards


def read_token_files(docs: DataFrame, folder: str, shards: list[Shard], id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document, read from the files; start counts all ids before it.

    docs only gives the type of the id and the session.
    """
    spark, rows, before = docs.sparkSession, [], 0
    for s in shards:
        rows.append((s.path, before))
        before += s.tokens
    kind = "long" if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for index, get in read_shard(folder, path):
                    starts, counts = index.column(1).to_pylist(), index.column(2).to_pylist()
                    sums = [zlib.crc32(get(s, n).astype("<u4", copy=False).tobytes()) for s, n in zip(starts, counts, strict=True)]
                    yield pa.RecordBatch.from_arrays([index.column(0), pa.array([base + s for s in starts], pa.int64()), index.column(2), pa.array(sums, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    names = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return names.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
