"""Ranked lexical search against a plain loop over all documents and items."""

import math
import random
import re
from collections import Counter

import numpy as np

from logvars.llm import lexical
from logvars.llm.queries import op12_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    """(item, rank, doc, score) by scoring every document for every item; docs: (id, text) rows."""
    counts = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, words in items.items():
        scored = []
        for doc, c in counts:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // total
            score = 0
            for t in words:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        best = sorted(scored)[:k]
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(best, 1)]
    return sorted(out, key=str)


def found(rows):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows.collect()), key=str)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = {r.item_id: terms(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert found(op12_lexical_search(spark, sf)) == plain(docs, items)


def test_odd_rows_and_blocks(spark, odd_docs, no_docs):
    rows = [(1, "some words, AND more of them"), (1, "plain text"), (1, "plain text"), (2, None), (3, ""), (4, "12 34 12"), (None, "no id"), (5, "straße")]
    items = spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as score")
    want = plain(
        [(r.doc_id, r.text) for r in odd_docs.collect()],
        {1: terms("some words, AND more of them plain text"), 4: terms("12 34 12"), 5: ["straße"]},
        k=3,
    )
    for block_words in (3, 500_000):
        got = lexical.search(odd_docs, items, k=3, block_words=block_words)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and found(got) == want
    assert len([r for r in want if r[0] == 4]) == 1  # only one document holds such terms
    assert lexical.search(no_docs, items).count() == 0 and lexical.search(odd_docs, items.where("item_id = 2")).count() == 0


def test_ties_are_ranked_by_id_over_all_tasks(spark):
    docs = [(i, "same text here") for i in range(500)] + [(1000 + i, f"other {i}") for i in range(500)]
    random.Random(0).shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "same"), (2, "other 7 7")], "item_id long, text string")
    got = lexical.search(table, items, k=5)
    assert found(got) == plain(docs, {1: ["same"], 2: ["other", "7", "7"]}, k=5)


def test_bounded_steps_give_the_same(monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(200)]
    index = lexical.ItemIndex([(i, [w.encode() for w in rng.choices(words, k=6)]) for i in range(9)])
    whole = [index.count(t) for _, t in docs]
    monkeypatch.setattr(lexical, "PIECE", 7)
    for (n, a, b), (_, text) in zip(whole, docs, strict=True):
        parts = list(lexical.term_lists(text))
        assert [t for p in parts for t in p] == text.encode().split() and (len(parts) > 1 or len(text) < 12)
        m, c, d = index.count(text)
        assert n == m and np.array_equal(a, c) and np.array_equal(b, d)


def test_heaps_keep_the_best_whatever_the_batches():
    rng = np.random.default_rng(1)
    ids, scores = rng.permutation(400) - 100, rng.integers(0, 6, (400, 3))
    heaps = lexical.Heaps(3, 20)
    for at in range(0, 400, 37):
        heaps.update(ids[at : at + 37], scores[at : at + 37])
    for item in range(3):
        want = sorted((-s, d) for s, d in zip(scores[:, item].tolist(), ids.tolist(), strict=True) if s > 0)[:20]
        assert sorted((-s, -d) for s, d in heaps.heaps[item]) == want
