"""Formats against values, and a proposer in rounds, by plain loops."""

import json
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from logvars.functions import formats as fm
from logvars.operators import induce, match


def pattern(fmt):
    """Java's ``$`` and a dot that stops at line feeds only."""
    return re.compile("^" + "([^\n]*)".join(re.escape(p) for p in fmt.split("<D>")) + "$")


def in_order(fmts):
    wider = {f: sum(bool(pattern(g).search(f)) and not pattern(f).search(g) for g in fmts) for f in fmts}
    return sorted(fmts, key=lambda f: (-wider[f], -len(f), f))


def merged(fmt):
    return re.sub(r"(?:<D>\s*){2,}", "<D>", fmt)


def first_fits(values, formats):
    """{(group, value): format} by trying the formats of a group one after the other."""
    by_group = defaultdict(set)
    for g, f in formats:
        by_group[g].add(merged(f))
    ordered = {g: in_order(fs) for g, fs in by_group.items()}
    return {(g, v): next((f for f in ordered.get(g, []) if pattern(f).search(v)), None) for g, v in values}


def test_index_finds_what_a_loop_over_all_formats_finds(spark):
    rnd = random.Random(3)
    pieces = ["<D>", "a", "_", "b", ".", "longer_text_than_a_stretch", "::", "x.y.z", " ", "é"]
    text = lambda n: "".join(rnd.choice(pieces) for _ in range(n))
    formats = [(rnd.choice("gh"), text(rnd.randint(1, 5))) for _ in range(150)] + [(None, "a<D>"), ("g", "<D><D>")]
    values = [(rnd.choice("ghi"), text(rnd.randint(0, 6)).replace("<D>", rnd.choice(["1", "", "22"]))) for _ in range(600)]
    values += [("g", "a.b\n"), ("g", "a\nb"), (None, "a1"), (None, "b"), ("g", "")]
    values += values[:20]
    table = spark.createDataFrame(values, "GroupKey string, value string")
    found = match.match_formats(table, spark.createDataFrame(formats, "GroupKey string, Format string")).collect()
    assert sorted(map(str, ((r.GroupKey, r.value) for r in found))) == sorted(map(str, values))
    want = first_fits(values, formats)
    for r in found:
        assert r.Format == want[r.GroupKey, r.value], r
        assert r.matched == (r.Format is not None)
        if r.matched:
            assert r.Parts == list(pattern(r.Format).search(r.value).groups())


def test_order_of_thousands_of_formats(spark):
    rnd = random.Random(4)
    formats = {f"k{rnd.choice('abc')}_{i}_<D>" for i in range(3000)} | {"k<D>", "ka_<D>", "<D>", "<D>_7_<D>"}
    table = spark.createDataFrame([("g", f) for f in formats], "GroupKey string, Format string")
    rows = {r.Format: r for r in match.order_formats(table).collect()}
    for f in rnd.sample(sorted(formats), 30):
        wider = [g for g in formats if pattern(g).search(f) and not pattern(f).search(g)]
        assert rows[f].n_more_general == len(wider)
    assert rows["<D>"].format_rank == len(formats) and rows["<D>"].n_more_general == 0


def test_index_takes_the_stretch_that_few_formats_share(spark):
    formats = ["task_<D>_x1", "task_<D>_x2", "task_<D>", "<D>", "<D>-<D>", "<D>.mid.<D>", "<D>ab<D>", "done"]
    table = spark.createDataFrame([("g", f) for f in formats], "GroupKey string, Format string")
    got = {r.Format: (r.kind, r.text) for r in match.format_index(table, "GroupKey").collect()}
    assert got == {
        "task_<D>_x1": ("tail", "_x1"), "task_<D>_x2": ("tail", "_x2"), "task_<D>": ("head", "task_"), "<D>": ("any", ""),
        "<D>-<D>": ("mark", "-"), "<D>.mid.<D>": ("word", "mid"), "<D>ab<D>": ("middle", "ab"), "done": ("whole", "done"),
    }


VALUES = "GroupID long, ValueType string, value string, first_line long"


def undecided(spark, *groups):
    rows = [(g, "Undecided", v, i) for g, vs in enumerate(groups, 1) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, VALUES)


def test_proposer_sees_what_is_left_and_its_faults_are_kept(spark):
    values = [f"rdd_{i}" for i in range(6)] + [f"broadcast_{i}_piece{i}" for i in range(4)] + ["odd", "even", "strange-1"]
    seen = []

    def proposer(samples, attempt):
        rows = samples.collect()
        seen.append({r.bucket: r.samples for r in rows})
        answers = {1: {"rdd_": ['["rdd_<D"]', "not json"], "broadcast_": ['["broadcast_D>_piece<D>", "unused<D>"]', '{"a": 1}']},
                   2: {"(other)": ['["strange-<D> <D>", "odd", null]']}}
        out = [(r.GroupID, r.bucket, a) for r in rows for a in answers.get(attempt, {}).get(r.bucket, [])]
        return samples.sparkSession.createDataFrame(out, "GroupID long, bucket string, answer string")

    found, rejected = induce.proposed_formats(undecided(spark, values), proposer, ["rdd_", "broadcast_"], rounds=3)
    got = {r.value: (r.Format, r.Parts) for r in found.collect()}
    want = {f"rdd_{i}": ("rdd_<D>", [str(i)]) for i in range(6)}
    want |= {f"broadcast_{i}_piece{i}": ("broadcast_<D>_piece<D>", [str(i), str(i)]) for i in range(4)}
    want |= {"odd": ("odd", []), "even": ("<D>", ["even"]), "strange-1": ("strange-<D>", ["1"])}
    assert got == want
    assert {(r.bucket, r.attempt, r.text, r.reason) for r in rejected.collect()} == {
        ("rdd_", 1, "not json", induce.NOT_A_LIST), ("broadcast_", 1, '{"a": 1}', induce.NOT_A_LIST),
        ("broadcast_", 1, "unused<D>", induce.UNUSED),
    }
    assert [set(s) for s in seen] == [{"rdd_", "broadcast_", "(other)"}, {"(other)"}, {"(other)"}]
    assert seen[0]["(other)"] == ["odd", "even", "strange-1"] and seen[2]["(other)"] == ["even"]


def test_proposer_rounds_end_and_budget_holds(spark):
    values = [f"v{'x' * (i % 40)}{i}" for i in range(300)]

    def proposer(samples, attempt):
        assert max(sum(max(1, len(v) // 4) for v in r.samples) for r in samples.collect()) <= 50
        answer = F.to_json(F.array_distinct(F.col("samples")))
        return samples.select("GroupID", "bucket", answer.alias("answer"))

    found, rejected = induce.proposed_formats(undecided(spark, values), proposer, rounds=3, max_tokens=50)
    rows = found.collect()
    assert len(rows) == 300 and rejected.count() == 0
    whole = [r for r in rows if r.Format == r.value]
    assert 0 < len(whole) < 300 and all(r.Format == "<D>" and r.Parts == [r.value] for r in rows if r.Format != r.value)
    nothing = induce.proposed_formats(undecided(spark), proposer)
    assert nothing.formats.count() == 0 and nothing.rejected.count() == 0


def test_samples_are_json_lists_only(spark):
    table = undecided(spark, ["a1", "a2"])
    keys = ["GroupID", "bucket"]
    for answer, kept in ((json.dumps(["a<D>"]), "a<D>"), ("[]", "<D>"), (None, "<D>"), ("[1, 2", "<D>")):
        found, rejected = induce.proposed_formats(
            table, lambda s, n, a=answer: s.select(*keys, F.lit(a).cast("string").alias("answer")), rounds=1
        )
        assert {r.Format for r in found.collect()} == {kept}
        assert rejected.count() == (answer is None or answer == "[1, 2")


def test_literal_texts_in_order_are_what_the_pattern_matches(spark):
    rnd = random.Random(5)
    pieces = ["<D>", "<D>", "a", "b", "ab", "\n", "é", "$", "\r"]
    text = lambda: "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 5)))
    formats = spark.createDataFrame([(f,) for f in {merged(text()) for _ in range(60)}], "Format string")
    values = spark.createDataFrame([(v,) for v in {text() for _ in range(120)}], "value string")
    pairs = formats.withColumn("regex", fm.to_regex(F.col("Format"))).crossJoin(values)
    fit = fm.fits(F.col("value"), F.col("regex"), F.split("Format", fm.SLOT, -1))
    rows = pairs.select("Format", "value", F.regexp_like("value", "regex").alias("want"), fit.alias("got")).collect()
    assert any(r.want for r in rows) and [r for r in rows if r.want != r.got] == []


def test_characters_of_a_part_are_a_part_of_the_mask(spark):
    rows = spark.createDataFrame([("xaab", "axbab"), ("xaaab", "axbab"), ("", "axbab"), ("ééé", "aé<D>éé")], "part string, whole string")
    part, whole = fm.character_mask(F.col("part")), fm.character_mask(F.col("whole"))
    assert [r[0] for r in rows.select(part.bitwiseAND(whole) == part).collect()] == [True, False, True, True]


def test_a_stretch_that_many_formats_share_is_not_chosen_for_its_kind(spark):
    table = spark.createDataFrame([("g", f"<D>word{i}word<D>b") for i in range(200)], "GroupKey string, Format string")
    kinds = {r.kind for r in match.format_index(table, "GroupKey").collect()}
    assert kinds == {"middle"}


def test_texts_of_one_partition_are_dealt_out(spark):
    values = spark.createDataFrame([("g", f"a{i}") for i in range(400)], "GroupKey string, value string").coalesce(1)
    formats = spark.createDataFrame([("g", "a<D>")], "GroupKey string, Format string").withColumn("regex", fm.to_regex(F.col("Format")))
    found = match.fitting_formats(values, formats, "GroupKey")
    assert found.where("_fit is not null").count() == 400
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_only_stretches_that_formats_may_have_become_rows(spark):
    words = " ".join(f"w{i}" for i in range(500))
    values = spark.createDataFrame([("g", words + " key end"), ("g", words + " lock end"), ("h", "key"), (None, words)], "GroupKey string, value string")
    formats = spark.createDataFrame([("g", "<D> key <D>"), (None, "<D> w7 <D>")], "GroupKey string, Format string")
    formats = formats.withColumn("regex", fm.to_regex(F.col("Format")))
    met = match.candidate_formats(values, formats, "GroupKey").collect()
    assert {(r.GroupKey, r.value) for r in met} == {(r.GroupKey, r.value) for r in values.collect()}
    assert {(r.GroupKey, r._fit.Format) for r in met if r._fit} == {("g", "<D> key <D>"), (None, "<D> w7 <D>")}
    assert len(met) < 100  # 500 words each, most of them in no format
