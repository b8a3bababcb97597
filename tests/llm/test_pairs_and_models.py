"""Near duplicates, fingerprints, shards, archives, quality, language model and pipeline: brute force and odd rows."""

import base64
import hashlib
import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logvars.llm import decontaminate, hmm, langid, minhash, quality, sharding, warc, winnow
from logvars.llm import queries as q
from logvars.llm.common import fold


def ids(rows, column="doc_id"):
    return sorted((r[column] is None, r[column] or 0) for r in rows)


# --- near duplicates

def word_sets(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(docs, percent):
    """By comparing all pairs."""
    sets = {i: word_sets(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(docs), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in docs}


def test_near_duplicates_against_all_pairs(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in q.op9_minhash(spark, sf).collect()}
    assert got == components(docs, 85)


def test_many_near_copies_are_one_component_where_hubs_fall_short(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(140)]
    docs = {}
    for i in range(400):  # two or three edits of a base that is not there itself: many pairs lie below the threshold
        words = list(base)
        for k in rng.sample(range(140), rng.choice([1, 2, 2, 3])):
            words[k] = f"x{i}_{k}"
        docs[i] = " ".join(words)
    docs |= {400 + i: " ".join(base[: 70 + i]) + " " + " ".join(f"y{i}_{k}" for k in range(70)) for i in range(20)}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table, percent=85, rows=10).collect()}
    assert got == components(docs, 85)


def test_near_duplicates_with_odd_rows(spark, odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert ids(rows) == ids(odd_docs.collect())
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[8].component_id, by_id[8].kept, by_id[1].kept) == (1, False, True)
    for i in (2, 3, 4):
        assert (by_id[i].n_shingles, by_id[i].component_id, by_id[i].kept) == (0, i, True)
    assert by_id[None].component_id is None and by_id[None].kept
    assert minhash.near_duplicates(no_docs).count() == 0
    left = minhash.deduplicate(odd_docs)
    assert left.columns == odd_docs.columns
    assert ids(left.collect()) == sorted([(True, 0), *((False, i) for i in (1, 2, 3, 4, 5, 6, 7))])


def test_stars_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.component for r in minhash.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


# --- fingerprints

def kept_by_hand(hashes, window):
    """Positions kept by looking at every window."""
    window = min(window, len(hashes))
    kept = set()
    for at in range(len(hashes) - window + 1):
        part = hashes[at : at + window]
        kept.add(at + max(i for i in range(window) if part[i] == min(part)))
    return sorted(kept)


@pytest.mark.parametrize("k, window", [(1, 1), (3, 4), (16, 32), (5, 7)])
def test_winnowing_against_every_window(k, window):
    rng = random.Random(k)
    for length in (0, 1, 2, 15, 16, 17, 60, 300):
        text = "".join(rng.choice("ab é\U0001f600") for _ in range(length))
        hashes, positions = winnow.winnow(text, k, window)
        if not text:
            assert not len(hashes)
            continue
        grams = {}
        n = min(k, length)
        every = [int(winnow.gram_hashes(np.array([ord(c) for c in text[i : i + n]], np.uint32), n)[0]) >> 20 for i in range(length - n + 1)]
        for i, h in enumerate(every):  # rolling and direct hashes agree, equal grams have equal hashes
            assert grams.setdefault(text[i : i + n], h) == h
        assert positions.tolist() == kept_by_hand(every, window)
        assert hashes.tolist() == [every[p] for p in positions]


def test_long_texts_are_winnowed_in_stretches(monkeypatch):
    text = "".join(random.Random(1).choice("abcd") for _ in range(5000))
    whole = winnow.winnow(text, 4, 9)
    monkeypatch.setattr(winnow, "_STRETCH", 128)
    parts = winnow.winnow(text, 4, 9)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_edited_texts(spark, sf, odd_docs, no_docs):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in q.op5_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    for a, b in zip(docs, [*docs[1:], docs[0]], strict=True):
        half = len(a.text) // 2
        edited = a.text[: len(a.text) - half] + b.text[:half]
        r = got[a.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(a.text), hashlib.sha256(edited.encode()).hexdigest())
        hashes = [winnow.winnow(t)[0] for t in (a.text, edited, b.text)]
        assert r.fingerprint == winnow.as_text(hashes[0]) and r.edited_fingerprint == winnow.as_text(hashes[1])
        assert (r.near_edited, r.near_next) == (winnow.likeness(hashes[0], hashes[1]), winnow.likeness(hashes[0], hashes[2]))
    assert sum(r.near_edited for r in got.values()) > 10 * sum(r.near_next for r in got.values())
    odd = winnow.edited_likeness(odd_docs).collect()
    assert ids(odd) == ids(odd_docs.collect())
    assert {r.fingerprint for r in odd if r.doc_id in (2, 3)} == {""}
    assert winnow.edited_likeness(no_docs).count() == 0
    one = winnow.edited_likeness(odd_docs.where("doc_id = 7")).first()
    assert one.near_next == 1.0
    assert winnow.fingerprints(odd_docs).columns == [*odd_docs.columns, "fingerprint"]


# --- shards

def test_shards_are_even_and_keep_equal_texts_together(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = q.op1_sharding(spark, sf).collect()
    assert ids(rows) == ids([{"doc_id": i} for i in docs])
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        by_shard[r.shard].append(r)
        by_text[docs[r.doc_id]].add(r.shard)
    assert sorted(by_shard) == list(range(40))
    for part in by_shard.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    weights = [sum(r.size for r in part) for part in by_shard.values()]
    assert max(weights) - min(weights) <= max(r.size for r in rows)
    assert sum(len(s) > 1 for s in by_text.values()) <= 39


def test_a_group_of_copies_larger_than_a_shard_is_split(spark):
    rows = [(i, "the same long text " * 20, "en", "a") for i in range(600)] + [(1000 + i, f"text {i} " * 30, "en", "b") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = [r.w for r in sharding.shard(docs, shards=8).groupBy("shard").agg(F.sum("size").alias("w")).collect()]
    assert len(weights) == 8 and max(weights) < 1.1 * min(weights)
    by_bytes = sharding.shard(docs, target_bytes=50_000)
    assert by_bytes.groupBy("shard").agg(F.sum("size").alias("w")).agg(F.max("w")).first()[0] < 55_000


def test_shards_with_odd_rows(spark, odd_docs, no_docs):
    rows = sharding.shard(odd_docs, shards=3).collect()
    assert ids(rows) == ids(odd_docs.collect())
    assert {r["size"] for r in rows if r.doc_id in (2, 3)} == {16}
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard(no_docs, shards=3).count() == 0
    assert {r.shard for r in sharding.shard(odd_docs, shards=1).collect()} == {0}


# --- archives

PAGES = [(1, "http://a", "<p>one</p>"), (2, "http://b\r\nX: y", "<p>one</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e", "é\r\n\r\n" * 9),
         (5, "http://e", "é\r\n\r\n" * 9), (None, "http://f", "<p>one</p>"), (0, "http://g", "x" * 300_000), (-7, "http://h", "<p>two</p>")]


@pytest.fixture(scope="module")
def manifest(spark):
    rows = [(*r, "clash") for r in PAGES]
    return warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(2)).cache()


def test_archives_hold_every_page(spark, manifest):
    rows = warc.read_archives(spark, manifest).withColumn("page_id", warc.number_column("record_id")).withColumn("first", warc.number_column("refers_to")).collect()
    assert sorted(((r.page_id is None, r.page_id or 0, r.record_type, r.first) for r in rows), key=str) == sorted(
        [(False, 1, "response", None), (False, 2, "revisit", 1), (False, 3, "response", None), (False, 4, "revisit", 3), (False, 5, "response", None),
         (False, 5, "response", None), (True, 0, "response", None), (False, 0, "response", None), (False, -7, "response", None)], key=str)
    pages = {i: (h or "").encode() for i, _, h in PAGES}
    for r in rows:
        raw = pages[r.page_id]
        assert r.payload_bytes == len(raw)
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r.payload == (None if r.record_type == "revisit" else raw)
    assert {r.target_uri for r in rows if r.page_id == 2} == {"http://b X: y"}


def test_predicates_reach_the_reader_and_payloads_stay_unread(spark, manifest):
    records = warc.read_archives(spark, manifest, payload=False)
    some = records.where("record_type = 'revisit'")
    assert "record_type" not in some._jdf.queryExecution().executedPlan().toString().split("Filter")[-1] or some.count() == 2
    assert some.count() == 2 and records.where("payload is not null").count() == 0
    reader = warc.WarcReader({"ranges": "[]"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    filters = [EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]
    assert list(reader.pushFilters(filters)) == filters[1:] and reader.tests == [("warc-type", frozenset(["revisit"]))]


def test_archives_of_other_writers_and_byte_ranges(tmp_path):
    import gzip

    records = [warc.record("response", warc.record_id(i), "u", warc.digest(b"x" * i), i, b"x" * i, None, "d") for i in range(5)]
    plain, ours = b"".join(map(gzip.compress, records)), [warc.gzip_member(r) for r in records]
    assert all(gzip.decompress(m) == r for m, r in zip(ours, records, strict=True))
    for name, content, ranges in (("a", plain, [(0, len(plain))]), ("b", b"".join(ours), [(0, len(ours[0])), (len(ours[0]), sum(map(len, ours)))])):
        (tmp_path / name).write_bytes(content)
        got = []
        for begin, end in ranges:
            with open(tmp_path / name, "rb") as f:
                for m in warc.members(f, begin, end):
                    m.head()
                    got.append(m.payload(m.http_length()))
        assert got == [b"x" * i for i in range(5)]


def test_no_pages_give_no_records(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(none)).count() == 0


# --- quality

def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = q.op3_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held_out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held_out) >= 0.95 * len(held_out)


def test_votes_against_plain_loops():
    rng = np.random.default_rng(0)
    weights = rng.random((30, quality.TERMS)).astype(np.float32)
    labels = rng.integers(0, 2, 30)
    model = quality.fit(weights, labels, rank=5, nearest=4, sharpness=2)
    probe = rng.random((6, quality.TERMS)).astype(np.float32)
    for vector, score in zip(model.latent(probe), model.scores(probe), strict=True):
        near = sorted(range(30), key=lambda i: -float(vector @ model.vectors[i]))[:4]
        votes = [max(0, float(vector @ model.vectors[i])) ** 2 for i in near]
        assert abs(score - sum(v * labels[i] for v, i in zip(votes, near, strict=True)) / sum(votes)) < 1e-4


def test_quality_with_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 1), (2, 1), (None, 1), (8, None), (99, 0)], "doc_id long, quality int")
    model = quality.learn(odd_docs, labels)
    rows = quality.rate(odd_docs, model, out="score").collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (2, 3)} == {model.prior}
    assert quality.rate(no_docs, model).count() == 0
    assert {r.score for r in quality.rate(odd_docs, quality.learn(no_docs, labels), out="score").collect()} == {0.5}


# --- language model

def test_forward_and_expected_counts_against_all_paths():
    rng = np.random.default_rng(4)
    start, move, emit = rng.random(2), rng.random((2, 2)), rng.random((5, 2))
    model = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    texts = [np.array(t) for t in ([0], [1, 4, 2], [3, 3], [2, 1, 0, 4])]
    counts = np.zeros((5, 2)), np.zeros((2, 2)), np.zeros(2)
    for text, got in zip(texts, model.log10_probability(texts, width=3), strict=True):
        paths = {}
        for path in itertools.product(range(2), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for i in range(1, len(text)):
                p *= model.move[path[i - 1], path[i]] * model.emit[text[i], path[i]]
            paths[path] = p
        total = sum(paths.values())
        assert abs(got - math.log10(total)) < 1e-9
        for path, p in paths.items():
            counts[2][path[0]] += p / total
            for i, s in enumerate(path):
                counts[0][text[i], s] += p / total
                if i:
                    counts[1][path[i - 1], s] += p / total
    found = hmm.Expected(model)
    found.add(texts)
    assert np.allclose(found.emit, counts[0]) and np.allclose(found.move, counts[1]) and np.allclose(found.start, counts[2])


def test_stretches_and_time_order():
    lengths = np.array([1, 3 * hmm.STRETCH, 2, hmm.STRETCH + 1])
    assert hmm.stretch_lengths(lengths).tolist() == [1, *[hmm.STRETCH] * 3, 2, hmm.STRETCH, 1]
    order, times, texts = hmm.time_major(np.array([1, 3, 2]))
    assert texts.tolist() == [1, 2, 0] and times.tolist() == [0, 3, 5, 6] and order.tolist() == [1, 4, 0, 2, 5, 3]


def test_forward_over_a_very_long_text_beside_short_ones():
    """Memory is that of all words, not of a rectangle as long as the longest text."""
    rng = np.random.default_rng(5)
    model = hmm.Model(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.2, 0.8]]), rng.dirichlet(np.ones(6), 2).T)
    texts = [rng.integers(0, 6, n) for n in (100_000, *[40] * 600)]
    tracemalloc.start()
    found = model.log10_probability(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    for i in (1, 600):
        now = model.start * model.emit[texts[i][0]]
        for s in texts[i][1:]:
            now = (now @ model.move) * model.emit[s]
        assert abs(found[i] - math.log10(now.sum())) < 1e-9
    assert np.isfinite(found).all() and found[0] < 1000 * found[1:].max() / 40


def check_language_model(rows, docs, learn):
    count = Counter()
    for i, text in docs:
        if learn(i):
            count.update([*(text or "").encode().lower().split(), "end"])
    n, v = sum(count.values()), len(count)
    texts = defaultdict(list)
    for i, text in docs:
        texts[i].append([*(text or "").encode().lower().split(), "end"])
    for r in rows:
        options = []
        for t in texts[r.doc_id]:
            base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
            options.append((len(t), sum(count[w] > 0 for w in t), round(base, 4)))
        assert (r.n_tokens, r.n_known, round(r.base_score, 4)) in options and r.train_tokens == n
        assert math.isfinite(r.score)


@pytest.mark.parametrize("head", [49_152, 40])
def test_language_model(spark, sf, head):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = hmm.language_model_scores(docs, fold(F.col("doc_id")) == 1, head=head).collect()
    check_language_model(rows, [(r.doc_id, r.text) for r in docs.collect()], lambda i: zlib.crc32(str(i).encode()) % 5 != 1)
    held_out = [r for r in rows if r.held_out]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)


def test_words_outside_the_head_keep_their_emissions(spark, sf):
    """Wherever the head ends, the model and its scores are the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole, cut = ({r.doc_id: r.score for r in hmm.language_model_scores(docs, fold(F.col("doc_id")) == 1, head=h).collect()} for h in (49_152, 600))
    assert whole.keys() == cut.keys() and all(abs(cut[i] - s) < 1e-3 for i, s in whole.items())


def test_language_model_is_a_distribution(spark):
    """Over all words and lengths the probabilities of short texts add up to the model's share of them."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a", "b b a", "c"] * 5)], "doc_id long, text string")
    every = [" ".join(t) for n in range(4) for t in itertools.product(["a", "b", "c", "zzz"], repeat=n)]
    probe = spark.createDataFrame([(100 + i, t) for i, t in enumerate(every)], "doc_id long, text string")
    rows = hmm.language_model_scores(docs.union(probe), F.col("doc_id") >= 100, states=2, head=2).collect()
    assert 0 < sum(10**r.score for r in rows if r.held_out) <= 1 + 1e-9


def test_language_model_with_odd_rows(spark, odd_docs, no_docs):
    rows = hmm.language_model_scores(odd_docs, F.col("doc_id") == 7, states=2).collect()
    assert ids(rows) == ids(odd_docs.collect())
    check_language_model(rows, [(r.doc_id, r.text) for r in odd_docs.collect()], lambda i: i != 7)
    assert hmm.language_model_scores(no_docs, F.lit(False), states=2).count() == 0
    untrained = hmm.language_model_scores(odd_docs, F.lit(True), states=2).collect()
    assert {r.train_tokens for r in untrained} == {0} and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in untrained)


# --- pipeline

def test_pipeline_stages_do_their_work(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_duplicates", "decontamination", "packing"]
    for name, function in corpus_pipeline.STAGES[:-1]:
        model = {"language": lambda: langid.learn(docs), "quality": lambda: quality.learn(docs, q.table(spark, sf, "labels"))}.get(name, lambda: None)()
        out = function(spark, docs, sf).cache()
        rows = {r.doc_id: r for r in out.collect()}
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(rows) == out.count()
        if name == "language":
            sure = langid._Model(model).predict
            assert set(rows) == {i for i, r in kept.items() if sure(r.text)[2]} and len(rows) >= 0.98 * len(kept)
        elif name == "quality":
            buckets = quality._Buckets()
            assert set(rows) == {i for i, r in kept.items() if model.scores(quality.term_weights(r.text, buckets)[None])[0] >= 0.3}
        elif name == "near_duplicates":
            assert set(rows) == {i for i, (_, c) in components({i: r.text for i, r in kept.items()}, 80).items() if c == i}
        else:
            found = decontaminate.find_contamination(out, q.table(spark, sf, "benchmark")).select("contamination.n_hit").collect()
            assert sum(r.n_hit for r in found) == 0 and all(r.n_chars == len(r.text) for r in rows.values())
            untouched = [i for i in rows if rows[i].text == kept[i].text]
            assert len(untouched) > 0.8 * len(kept)
        docs, kept = out, rows
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == set(kept)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
