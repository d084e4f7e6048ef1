import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODE = token_files.WordEncoder(PATH)
PIECES = st.sampled_from(["The", "the", "don't", "'s", "É", "ß", "İ", "ǅ", "Σ", "́", "a" * 30, "3", "½", "...", "<|endoftext|>", "!!", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "　", "日本", "𝄞", "\x00", "_", "|"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(PIECES, max_size=12).map("".join)))
def test_words_encode_as_whole_texts(text):
    text = text.encode("utf-8", "replace").decode()
    assert ENCODE(text.encode()).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_files, "_CACHE_WORDS", 5)
    encode = token_files.WordEncoder(PATH)
    for text in ("one two three four", "five six, seven eight nine ten!", "one 2 one two"):
        assert encode(text.encode()).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


ROWS = [(7, "Some text, here."), (3, None), (3, "twice the id"), (3, "twice the id"), (None, "no id"), (12, ""), (-4, "word " * 700), (5, '"quoted" "marks"')]


@pytest.mark.parametrize("sequence", [1, 16, 2048])
def test_round_trip(spark, sequence):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, start int").repartition(3)
    folder, shards = token_files.write_token_files(docs, PATH, sequence=sequence, parts=3)
    rows = sorted(token_files.read_token_files(docs, folder, shards).collect(), key=lambda r: r.start)
    want, at = [], 0
    for i, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = WHOLE.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in rows] == want
    fs, base = pafs.FileSystem.from_uri(folder)
    ids, total = [], 0
    for s in shards:
        table = pa.ipc.open_file(fs.open_input_file(f"{base}/{s.path}.ids.arrow")).read_all()
        assert table.schema.field("ids").type == pa.list_(pa.uint16(), sequence)
        valid, last = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[m].chunks]) for m in ("valid", "last"))
        assert valid[: s.tokens].all() and not valid[s.tokens :].any() and last.sum() == s.docs and last[s.tokens - 1]
        assert table.num_rows == -(-s.tokens // sequence)
        ids += np.concatenate([c.flatten().to_numpy() for c in table["ids"].chunks])[: s.tokens].tolist()
        total += s.docs
    assert total == len(ROWS) and len(ids) == at


def test_empty_and_string_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_token_files(none, *token_files.write_token_files(none, PATH)).count() == 0
    named = spark.createDataFrame([("b", "x"), ("a", "y z")], "doc_id string, text string")
    out = token_files.read_token_files(named, *token_files.write_token_files(named, PATH)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in out] == [("a", 0, 3), ("b", 3, 2)]
