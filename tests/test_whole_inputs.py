"""Rows that used to be lost or doubled: lines without parameters, repeated numbers, null texts, uneven sheets, long values."""

import time

from pyspark.sql import functions as F

from logvars.operators import analysis, classify, drift, extract, groups, labels, variables
from logvars.operators.staging import stage

FORMATS = "DynamicID long, Template string, ParameterIndex int, TokenFormat string, Token string, ComponentFormat string, Value string, Parts array<string>, ValueType string, GroupID long, FirstLine long"


def log(spark, rows):
    return spark.createDataFrame(rows, "LineId long, Content string, EventTemplate string")


def test_every_line_has_one_record(spark):
    lines = log(spark, [(1, "a", "a <*> b"), (2, "a x b", "a <*> b"), (2, "a y b", "a <*> b"), (3, None, "a <*> b"), (None, "a z b", "a <*> b")])
    extracted = stage(extract.extract_parameters(lines), "lines")
    formats = spark.createDataFrame([(0, "a <*> b", 0, "<C>", "x", "<D>", "x", ["x"], "Undecided", 1, 2)], FORMATS)
    looked_up = analysis.analysis_ready(extracted, formats).collect()
    assert sorted((r.LineId or 0, [p.value for p in r.params]) for r in looked_up) == [(0, ["z"]), (1, []), (2, ["x"]), (2, ["y"]), (3, [])]


def test_repeated_line_numbers_keep_one_variable(spark):
    lines = log(spark, [(1, "k one", "k <*>"), (1, "k two", "k <*>"), (2, "k three", "k <*>")])
    values = stage(variables.variable_values(extract.extract_parameters(lines)), "values")
    found = classify.classify(values)
    assert found.variables.count() == 1 and found.values.count() == 3


def test_null_texts_are_one_empty_token(spark):
    lines = log(spark, [(1, None, "k <*>"), (2, "k x", "k <*>"), (3, None, "k <*>")])
    for extracted in (extract.extract_parameters(lines), drift.extract_with_drift(lines)):
        rows = {r.LineId: r.ParameterList for r in extracted.collect()}
        assert set(rows) == {1, 2, 3} and all(v is not None for v in rows.values())
    assert sorted(r.LineId for r in extract.unaligned_lines(lines).collect()) == [1, 3]


def test_sheets_of_different_length(spark):
    a = spark.createDataFrame([(1, "Value"), (2, None), (3, "Path"), (None, "Unit")], "row_id long, Type string")
    b = spark.createDataFrame([(1, "Value"), (3, None), (4, "Unit"), (5, None)], "row_id long, Type string")
    assert labels.agreement(a, b).first().asDict() == {"n_total": 4, "n_inconsistent": 3, "percent": 25.0}
    got = {(r.row_id, r.type_a, r.type_b) for r in labels.disagreements(a, b).collect()}
    assert got == {(3, "Path", None), (4, None, "Unit"), (None, "Unit", None)}


def test_samples_use_one_plan_for_any_size(spark):
    lines = log(spark, [(i, f"k {i}", "k <*>") for i in range(3000)])
    few = {r.LineId for r in labels.sample_lines(lines, 10).collect()}
    many = {r.LineId for r in labels.sample_lines(lines, 2000).collect()}
    assert len(few) == 10 and len(many) == 2000 and few < many


def test_containment_of_a_long_value_grows_with_its_pieces(spark):
    def seconds(pieces):
        long = "/".join(f"p{i}" for i in range(pieces))
        shorts = ["p7/p8", "p3", f"p{pieces - 2}/p{pieces - 1}", "p0/p1/p2", "7/p8", "p8/p7"]
        values = spark.createDataFrame([(v,) for v in [long, *shorts]], "value string")
        start = time.perf_counter()
        got = {(r.short, len(r.long)) for r in groups.contained_pairs(values).collect()}
        took = time.perf_counter() - start
        assert {s for s, n in got if n == len(long)} == {"p7/p8", "p3", f"p{pieces - 2}/p{pieces - 1}", "p0/p1/p2"}
        return took

    seconds(50)
    assert seconds(2000) < 20


def test_keep_equals_reaches_the_records(spark):
    lines = log(spark, [(1, "k h=1", "k <*>"), (2, "k h=22", "k <*>")])
    from logvars.plans.workflow import run

    records = run(lines, until="analysis", keep_equals=True)["analysis"].collect()
    assert sorted(r.params[0].value for r in records) == ["=1", "=22"]
