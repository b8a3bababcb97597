"""Byte-level BPE against the tiktoken library, and the perfect hash against its own promise."""

import base64
import hashlib
import random

import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from logvars.llm import byte_bpe
from logvars.llm.queries import op11_byte_bpe, tokenizer_path

PATH, PATTERN = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [
    "", " ", "a  b\n\nc \n d\t", "a\x85\n b", "İI ́x é", "don't we'll 'S x's", "<|endoftext|> hi", "x\x1c y", "12 34 5a,b.c!?",
    "日本 語 テ", "\r\n a", "a" * 5000, "ab" * 3000, " " * 3000, "\U0001f600\U0001f601" * 300, "\x00\x01\x7f\xad",
]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_has_a_slot_for_each_key():
    rng = random.Random(1)
    for n in (1, 2, 3, 50, 2000):
        keys = list({rng.randbytes(rng.randint(0, 6)) for _ in range(n)})
        table = byte_bpe.PerfectHash(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
        strangers = table.slots([rng.randbytes(9) for _ in range(50)])
        assert 0 <= strangers.min() and strangers.max() < len(keys)


def test_ids_equal_the_library(library):
    codec = byte_bpe.codec(PATH, PATTERN)
    rng = random.Random(2)
    made = ["".join(rng.choice("abcé 日1'\n.") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts = ODD + made
    assert codec.encode([*texts, None]).to_pylist() == [*map(library.encode_ordinary, texts), []]


def test_heap_merges_as_the_library_does_where_ranks_tie(library):
    codec = byte_bpe.codec(PATH, PATTERN)
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("aeth") for _ in range(rng.randint(1, 40)))
        assert codec.merge(word.encode()) == library.encode_ordinary(word)


def test_long_texts_are_encoded_in_steps(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 50)
    monkeypatch.setattr(byte_bpe, "LONG", 7)
    texts = ["some words of text, " * n for n in (0, 1, 2, 3, 40)] + [None, "end"]
    got = byte_bpe.Codec(PATH, PATTERN).encode(texts).to_pylist()
    assert got == [library.encode_ordinary(t or "") for t in texts]


def test_decoding_of_strange_ids():
    lists = pa.array([None, [], [0, None, -1, 10**6], [65]], pa.list_(pa.int32()))
    codec = byte_bpe.codec(PATH, PATTERN)
    unknown, tokens = byte_bpe.UNKNOWN, codec.by_rank
    want = [None, b"", tokens[0].as_py() + unknown * 3, tokens[65].as_py()]
    assert codec.decode(lists).to_pylist() == want and codec.decode(lists[2:]).to_pylist() == want[2:]


def test_whole_table(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_byte_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, odd_docs, no_docs, library):
    got = byte_bpe.decode(byte_bpe.encode(odd_docs, PATH, PATTERN), PATH, PATTERN)
    assert got.columns == [*odd_docs.columns, "ids", "decoded"] and got.count() == odd_docs.count()
    for r in got.collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode(no_docs, PATH, PATTERN).count() == 0
    with pytest.raises(ValueError, match="START"):
        byte_bpe.encode(odd_docs, PATH, PATTERN, out="START")
