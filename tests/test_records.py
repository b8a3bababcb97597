"""Records of lines: many shapes in one group, hot tokens, and the two ways to the same records."""

from pyspark.sql import functions as F

from logvars.operators import analysis, induce, labels, staging
from logvars.operators.staging import stage
from logvars.plans.workflow import run

FORMATS = "DynamicID long, Template string, ParameterIndex int, TokenFormat string, Token string, ComponentFormat string, Value string, Parts array<string>, ValueType string, GroupID long, FirstLine long"


def records(rows):
    return sorted((r.LineId, r.NewTemplate, [tuple(p) for p in r.params]) for r in rows.collect())


def test_a_group_of_many_shapes_is_applied_without_one_row_for_all(spark):
    marks = ["".join("_-"[i >> b & 1] for b in range(15)) for i in range(20_000)]
    values = ["a".join(["x", *m, str(i)]) for i, m in enumerate(marks)]
    lines = spark.createDataFrame([(i, f"set k {v} of {i % 7}", "set k <*> of <*>") for i, v in enumerate(values)],
                                  "LineId long, Content string, EventTemplate string")
    result = run(lines, until="analysis", prefixes=["xaa", "xa_"])
    want = analysis.analysis_ready(result["structured"], result["formats"])
    assert records(result["analysis"]) == records(want)
    assert result["analysis"].where("size(params[0].parts) > 0").count() == 20_000


def test_a_token_in_half_of_all_rows_is_spread(spark):
    settings = {
        "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
    }
    params = spark.range(40_000).select(
        F.col("id").alias("_line"), F.lit("t").alias("NewTemplate"), F.lit(0).alias("pos"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("value"),
    )
    known = [(0, "t", 0, "<C>", "hot", "<D>", "hot", ["hot"], "Macro", 1, 1), (0, "t", 0, "<C>", "v7", "v<D>", "v7", ["7"], "Undecided", 1, 2)]
    formats = stage(spark.createDataFrame(known, FORMATS), "formats")
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = analysis.lookup_formats(stage(params, "params"), formats)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and max(sizes) <= 3 * sorted(sizes)[8]
        totals = found.groupBy("format", "matched").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.format, r.matched, r["count"]) for r in totals} == {("<D>", True, 20_000), ("v<D>", True, 1), ("<D>", False, 19_999)}


def test_hot_keys_are_few_and_cut_by_their_size(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 10_000, 1).when(F.col("id") < 10_100, 2).otherwise(F.col("id")).alias("k"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = {r.k: r["_copies"] for r in analysis.hot_keys(rows, "k").collect()}
    assert found == {1: 2 * parts}
    assert analysis.hot_keys(rows.where("k < 0"), "k").count() == 0


def logs_of(spark, names):
    """Log sets that share templates, values and line numbers."""
    rows = []
    for k, name in enumerate(names):
        rows += [(name, i, f"open rdd_{i % 5} at 10.0.0.{(i + k) % 7}:80 took {i} {'X-' if i % 2 else 7}", "open <*> at <*> took <*> <*>") for i in range(40 + k)]
        rows += [(name, 100 + i, f"close rdd_{i % 9} of a_{k}_{i % 3}", "close <*> of <*>") for i in range(20)]
        rows += [(name, 200 + i, "shut " + "x " * (i % 3) + f"rdd_{i}", "shut <*>") for i in range(9)]
    return spark.createDataFrame(rows, "dataset string, LineId long, Content string, EventTemplate string")


def rows_of(table):
    return sorted(map(str, (r.asDict(recursive=True) for r in table.select(*sorted(table.columns)).collect())))


def test_many_log_sets_in_one_job_are_what_each_is_alone(spark):
    lines = logs_of(spark, ["Spark", "BGL", "Other"])
    for alone_too, options in ((["Spark", "BGL"], {"until": "analysis", "drift": True}), (["Spark"], {"proposer": by_digits})):
        together = run(lines, by="dataset", **options)
        for name in alone_too:
            alone = run(lines.where(F.col("dataset") == name).drop("dataset"), dataset=name, **options)
            assert set(alone) == set(together)
            for table, rows in alone.items():
                of_set = together[table].where(F.col("dataset") == name).drop("dataset")
                kept = [c for c in rows.columns if c != "bucket"]  # sets without prefixes name their only bucket otherwise
                assert rows_of(of_set.select(*kept)) == rows_of(rows.select(*kept)), (name, table)


def by_digits(samples, attempt):
    made = F.transform("samples", lambda v: F.regexp_replace(v, "[0-9]+", "<D"))
    return samples.select("GroupID", "bucket", F.to_json(F.array_append(F.array_distinct(made), F.lit("no<D>"))).alias("answer"))


def test_lines_of_no_set_are_a_set(spark):
    lines = logs_of(spark, ["Spark"]).withColumn("dataset", F.lit(None).cast("string"))
    found = run(lines, by="dataset")["formats"]
    assert {r.dataset for r in found.collect()} == {""} and found.count() > 0


def test_lines_travel_once_and_lists_are_gathered_after_the_shuffle(spark):
    rows = [(None, "t", ["a", "b"]), (3, "t", []), (3, "t", None), (3, "u", [None, "a"])]
    extracted = stage(spark.createDataFrame(rows, "LineId long, NewTemplate string, ParameterList array<string>"), "lines")
    known = [(0, "t", 0, "<C>", "a", "<D>", "a", ["a"], "Macro", 1, 1), (0, "t", 1, "<C>", "b", "<D>_<D>", "b_1", ["b", "1"], "Undecided", 1, 2)]
    found = analysis.analysis_ready(extracted, stage(spark.createDataFrame(known, FORMATS), "formats"))
    got = {(r.LineId, r.NewTemplate, tuple((p.pos, p.value, tuple(p.parts), p.format, p.type, p.matched) for p in r.params)) for r in found.collect()}
    none = (0, None, (None,), "<D>", None, False), (1, "a", ("a",), "<D>", None, False)
    first = (0, "a", ("a",), "<D>", "Macro", True), (1, "b_1", ("b", "1"), "<D>_<D>", "Undecided", True)
    assert got == {(None, "t", first), (3, "t", ()), (3, "u", none)} and found.count() == 4
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [_line" in plan


def test_list_columns_are_gathered_after_a_narrow_shuffle(spark):
    rows = [
        (1, "t", 0, "<C>", "b", "<D>", "b", ["b"], "Macro", 1, 5), (1, "t", 0, "<C>", "a", "<D>", "a", None, "Macro", 1, 5),
        (1, "t", 0, "<C>", "(a)", "<D>", "a", ["a"], "Macro", 1, 2), (1, None, None, "<C>", None, "<D>", "a", ["a"], "Macro", 1, 1),
        (2, "t", 1, "<C>", "a_1", "a_<D>", "a_1", ["1"], "Undecided", None, 3), (2, "t", 1, "<C>", "a_1", "a_<D>", "a_1", ["1"], "Undecided", None, 3),
        (None, "t", 1, "<C>", "x", "<D>", "x", ["x"], "Macro", 1, 1),
    ]
    given = spark.createDataFrame(rows, FORMATS)
    written = induce.stage_format_rows(given)
    assert sorted(map(repr, written.collect())) == sorted(map(repr, given.collect()))
    found = induce.nested_formats(written)
    got = {(r.DynamicID, r.Template, r.GroupID, r.Chunk, tuple(r.Tokens), tuple(p and tuple(p) for p in r.ValueList)) for r in found.collect()}
    assert got == {
        (1, "t", 1, 0, ("(a)", "a", "b"), (("a",), None, ("b",))), (1, None, 1, 0, (None,), (("a",),)),
        (2, "t", None, 0, ("a_1", "a_1"), (("1",), ("1",))),
    } and found.count() == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [_owner" in plan


def test_staged_columns_that_others_tell_are_not_written(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", None), (None, "c"), (None, None), ("d", "e")], "token string, value string")
    found = staging.stage_narrow(rows, "narrow", {"value": F.col("token")})
    assert found.columns == rows.columns and sorted(map(repr, found.collect())) == sorted(map(repr, rows.collect()))
    kept = spark.read.parquet(*found.inputFiles())
    assert kept.where("value is not null").count() == 2


def test_label_sheet_needs_no_texts_of_lines(spark):
    lines = [(2, "b <*>", "b <*>", ["x"]), (1, "b =<*>", "b <*>", ["y"]), (3, "c", "c", None)]
    extracted = stage(spark.createDataFrame(lines, "LineId long, EventTemplate string, NewTemplate string, ParameterList array<string>"), "lines")
    known = [(0, "b <*>", 0, "<C>", "x", "<D>", "x", ["x"], "Macro", 1, 2), (0, "b <*>", 0, "<C>", "y", "<D>", "y", ["y"], "Macro", 1, 1)]
    sheet = labels.format_label_sheet(extracted, spark.createDataFrame(known, FORMATS)).collect()
    assert [(r.OldTemplate, r.Content, r.Token, r.ValueList) for r in sheet] == [("b =<*>", "b y", "y", ["y"])]


def test_parameters_without_format_are_counted_by_length(spark):
    lines = [("t", ["a", "b"]), ("t", ["a", None]), ("t", ["a"]), ("t", []), ("t", None), (None, ["a"]), ("u", ["a"])]
    extracted = spark.createDataFrame(lines, "NewTemplate string, ParameterList array<string>")
    known = spark.createDataFrame([("u", 0)], "Template string, ParameterIndex int")
    found = analysis.parameters_without_format(extracted, known)
    assert {tuple(r) for r in found.select("NewTemplate", "pos", "n_lines").collect()} == {("t", 0, 3), ("t", 1, 2), (None, 0, 1)}
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_format_rows_are_shuffled_once_without_what_tokens_tell(spark):
    lines = [(i, "a <*> b <*>", [f"x{i}_{i}", "hot"]) for i in range(300)]
    extracted = stage(spark.createDataFrame(lines, "LineId long, NewTemplate string, ParameterList array<string>"), "lines")
    known = [(0, "a <*> b <*>", 0, "<C>", f"x{i}_{i}", "x<D>_<D>", f"x{i}_{i}", [str(i), str(i)], "Undecided", 1, i) for i in range(299)]
    # A later row of a token does not count, in any copy of a hot key.
    known += [(1, "a <*> b <*>", 1, "<C>,", "hot", "<D>", "HOT", ["HOT"], "Macro", 2, 0), (2, "a <*> b <*>", 1, "<C>", "hot", "z", "z", ["z"], "Macro", 2, 0)]
    formats = stage(spark.createDataFrame(known, FORMATS), "formats")
    found = {r.LineId: [(p.value, p.parts, p.format, p.type, p.matched) for p in r.params] for r in analysis.analysis_ready(extracted, formats).collect()}
    hot = ("HOT", ["HOT"], "<D>,", "Macro", True)
    want = {i: [(f"x{i}_{i}", [str(i), str(i)], "x<D>_<D>", "Undecided", True), hot] for i in range(299)}
    assert found == {**want, 299: [("x299_299", ["x299_299"], "<D>", None, False), hot]}
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = analysis.analysis_ready(extracted, formats)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # Parameters and format rows by token, and lines.
    assert plan.count("Exchange hashpartitioning") == 3, plan
