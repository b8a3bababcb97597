"""Language ID and decontamination: odd rows, brute force, held-out accuracy."""

import random
import re

import pytest

from logvars.llm import decontaminate, langid
from logvars.llm.queries import QUERIES, op7_language

WORD = re.compile(decontaminate.WORD)


def brute_force(text, items, window):
    """Hit words and items, window by window."""
    fold = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    text, hit, found = fold(text), set(), set()
    for item, content in items:
        content = fold(content)
        n = min(window, len(content))
        windows = {tuple(content[i : i + n]) for i in range(len(content) - n + 1)} if n else set()
        for p in range(len(text) - n + 1):
            if tuple(text[p : p + n]) in windows:
                hit.update(range(p, p + n))
                found.add(item)
    return len(text), len(hit), sorted(found)


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for case in range(300):
        words = "a b c d".split()[: rng.randint(1, 4)]
        text = lambda n: " ".join(rng.choice(words) for _ in range(n))
        items = [(i, text(rng.randint(0, 9))) for i in range(rng.randint(1, 5))]
        window = rng.randint(1, 5)
        automaton = decontaminate.Automaton([(i, decontaminate.words(t)) for i, t in items], window)
        for _ in range(5):
            doc = text(rng.randint(0, 25)) + rng.choice(["", " x ", " a"]) + text(rng.randint(0, 9))
            found = decontaminate.words(doc)
            starts, ends, got = automaton.match(found)
            hits = {i for a, b in zip(starts, ends, strict=True) for i in range(a, b)}
            assert (len(found), len(hits), sorted(got)) == brute_force(doc, items, window), (case, doc, items, window)


@pytest.mark.parametrize("block_words", [10, 1_000_000])
def test_contamination_with_odd_rows(spark, odd_docs, no_docs, block_words):
    rows = [(1, "some words, AND more of them"), (1, "plain text"), (2, None), (3, ""), (4, "12 34"), (None, "no id here"), (5, "straße")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    got = decontaminate.find_contamination(odd_docs, items, window=4, block_words=block_words)
    assert got.columns == [*odd_docs.columns, "contamination"]
    for r in got.collect():
        c = r.contamination
        assert (c.n_words, c.n_hit, c.items) == brute_force(r.text, [x for x in rows if x[0] is not None], 4)
    assert decontaminate.find_contamination(no_docs, items).count() == 0
    none = decontaminate.find_contamination(odd_docs, items.where("item_id = 2")).select("contamination.n_hit").collect()
    assert [r.n_hit for r in none] == [0] * odd_docs.count()


def test_spans_are_cut_and_covered_documents_go(spark):
    text = "before it, some words AND more of them; after"
    docs = spark.createDataFrame([(1, text), (2, "words and more"), (3, None), (4, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "words and more")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, window=3).collect()}
    assert got == {1: "before it, some  of them; after", 3: None, 4: "clean"}


def test_languages_are_found_on_held_out_documents(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_language(spark, sf).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    held_out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held_out) >= 0.93 * len(held_out)


def test_languages_with_odd_rows(spark, odd_docs, no_docs):
    languages = langid.learn(odd_docs)
    assert languages.names == ["de", "en"]
    got = langid.identify(odd_docs, languages)
    assert got.columns == [*odd_docs.columns, "language"]
    for r in got.collect():
        letters = re.search(r"[^\W\d_]", r.text or "")
        assert (r.language.lang == langid.UNKNOWN) == (letters is None)
        assert r.language.lang != langid.UNKNOWN or (r.language.score, r.language.accepted) == (0.0, False)
    assert langid.identify(no_docs, languages).count() == 0
    empty = langid.learn(no_docs)
    assert {r.language.lang for r in langid.identify(odd_docs, empty).collect()} == {langid.UNKNOWN}


def test_every_chosen_text_teaches_from_any_of_its_places(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(i, f"{name(i)}é" * 900, "aa") for i in range(300)] + [(i, "1 " * 4000 + "late letters", "bb") for i in range(300, 303)]
    rows += [(1000 + i, rows[0][1], "aa") for i in range(2000)]
    languages = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert languages.names == ["aa", "bb"] and languages.dictionaries[1] == b"late letters"
    parts = languages.dictionaries[0].split(b"\n")
    assert len(parts) == 300 and len(languages.dictionaries[0]) <= 200_000 and min(map(len, parts)) > 600
    text = "".join(f"{name(i)} " for i in range(4000))
    part = langid.lesson(text, 500)
    assert len(part) <= 500 and text.encode().index(part) > 0


def test_narrow_margins_are_rejected():
    french, german = "le chat et la souris dans une maison " * 9, "der Hund und die Katze in einem Haus " * 9
    model = langid._Model(langid.Languages(["de", "fr"], [german.encode(), french.encode()], judged=20))
    assert model.predict(french)[0] == "fr" and model.predict(french)[2]
    assert not model.predict("xq zv wk jy qx vz kw yj bg mh fp dl nr sc")[2]


def test_queries_have_names_of_operators():
    assert all(re.fullmatch(r"op\d+_\w+", n) for n in QUERIES)
