"""Token files and packing against the tokenizers library itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from logvars.llm import packing
from logvars.llm.queries import op2_packing, op8_token_files, tokenizer_path
from logvars.llm.token_files import TokenFile, read_token_files, write_token_files
from logvars.llm.tokens import Encoder

ODD = ["", " ", "a  b\n\nc \n d\t", "  x", "a\x85\n b", "İI ́x é é", "don't we'll 'S x's", "<|endoftext|> hi", "x\x1c y", "12 34 5a,b.c!?", "日本 語 テ", "\r\n a"]


def library(name):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name, chunks", [("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "words")])
def test_chunks_give_the_ids_of_the_whole_text(name, chunks):
    ids, encoder = library(name), Encoder(tokenizer_path(name), chunks, cached=5)
    for text, found in zip(ODD * 2, encoder.encode(ODD * 2), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == ids(text), text


def test_token_files_hold_every_text(spark, sf):
    ids = library("word_bpe_49k.json")
    docs = {r.doc_id: [*ids(r.text), 2] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op8_token_files(spark, sf).collect()}
    assert got.keys() == docs.keys()
    start = 0
    for doc in sorted(docs):
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(docs[doc]), crc(docs[doc]))
        start += len(docs[doc])


def test_token_files_with_odd_rows(spark, odd_docs, no_docs):
    args = (tokenizer_path("word_bpe_49k.json"), "words", 2)
    index = write_token_files(odd_docs, *args, length=16)
    rows = read_token_files(index).collect()
    ids = library("word_bpe_49k.json")
    assert sorted(r.ids for r in rows) == sorted(np.asarray([*ids(r.text), 2], "<u4").tobytes() for r in odd_docs.collect())
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    assert [r.doc_id for r in ordered][0] is None
    file = TokenFile(rows[0].folder, ordered[-1].file)
    ids_of, mask = file.sequence(0)
    assert len(ids_of) == len(mask) == 16 and not ids_of.flags.owndata and not ids_of.flags.writeable
    assert write_token_files(no_docs, *args).count() == 0


def check_packing(pieces, docs, capacity=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert sum(len(x) for x in docs) == sum(p.length for p in pieces)
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        assert sum(p.length for p in parts) <= capacity
    return by_doc, by_sequence


def test_packing_covers_every_id_once(spark, sf):
    ids = library("byte_bpe_50k.json")
    docs = {r.doc_id: [*ids(r.text), 0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by_doc, by_sequence = check_packing(op2_packing(spark, sf).collect(), docs.values())
    assert by_doc.keys() == docs.keys()
    for doc, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(docs[doc])
            assert p.ids_crc32 == crc(docs[doc][at : at + p.length])
            at += p.length
        assert at == len(docs[doc])
    assert sum(map(len, docs.values())) / (len(by_sequence) * 1024) > 0.98


def test_packing_with_odd_rows(spark, odd_docs, no_docs):
    ids = library("byte_bpe_50k.json")
    args = (tokenizer_path("byte_bpe_50k.json"), "byte_level")
    got = packing.pack(odd_docs, *args, capacity=64, quantum=4).collect()
    check_packing(got, [[*ids(r.text), 0] for r in odd_docs.collect()], 64)
    assert packing.pack(no_docs, *args).count() == 0


def test_patterns_reach_the_optimum():
    demand = np.zeros(10, dtype=np.int64)
    demand[[2, 3, 4, 6]] = 30, 20, 10, 40
    found = packing.patterns(demand)
    # Forty sequences hold a 7 each and room for a 3; twenty 4s and ten 5s fill fifteen more.
    assert abs(sum(x for _, x in found) - 55) < 1e-6
    assert np.allclose(sum(p * x for p, x in found), demand)


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        values = rng.random(8)
        best = [0.0] * 9
        for room in range(1, 9):
            best[room] = max([best[room - 1], *(values[s - 1] + best[room - s] for s in range(1, room + 1))])
        worth, counts = packing.price(values, 8)
        assert abs(worth - best[8]) < 1e-9 and abs(counts @ values - worth) < 1e-9 and counts @ np.arange(1, 9) <= 8
