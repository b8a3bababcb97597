"""Files in and out, and the whole job on them."""

import os

import pytest
from pyspark.sql import functions as F

from logvars import schemas
from logvars.operators import staging
from logvars.operators.compare import adapt_positional, adapt_regex_templates
from logvars.plans.workflow import run, run_log_sets
from logvars.sources import logs

LOG = """LineId,Time,Content,EventId,EventTemplate,ParameterList
1,t0,"open session_1, ok",E1,"open <*> ok","['session_1,']"
2,t1,NA,E2,<*>,"['NA']"
3,t2,"say ""hi"" now",E3,say <*> now,"['""hi""']"
"""


def test_parsed_log_csv(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(LOG)
    got = logs.with_parameter_arrays(logs.read_parsed_log(spark, str(path), "csv")).orderBy("LineId").collect()
    assert [r.Content for r in got] == ["open session_1, ok", "NA", 'say "hi" now']
    assert [r.ParameterList for r in got] == [["session_1,"], ["NA"], ['"hi"']]
    assert got[0].LineId == 1


def test_adapters_read_files(spark, tmp_path):
    (tmp_path / "regex.csv").write_text("RegexTemplate,Content\n" + "".join(f"a (.*?)$,a {i}\n" for i in range(50)))
    numbered = adapt_regex_templates(logs.read_regex_log(spark, str(tmp_path / "regex.csv")), number_lines=True)
    got = numbered.orderBy("LineId").collect()
    assert [(r.LineId, r.Content, r.EventTemplate) for r in got] == [(i + 1, f"a {i}", "a <*>") for i in range(50)]
    (tmp_path / "pos.csv").write_text("w,x,y,z\n0,E1,a 1,a <*>\n1,E1,a 2,a <*>\n")
    rows = adapt_positional(logs.read_positional_log(spark, str(tmp_path / "pos.csv"))).orderBy("LineId").collect()
    assert [(r.LineId, r.EventId) for r in rows] == [(1, "E1"), (2, "E1")]


def test_sheet_writes_lists_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", 'b"c'])], "i int, xs array<string>")
    logs.write_sheet(df, str(tmp_path / "sheet"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "sheet")).first()
    assert back.xs == '["a","b\\"c"]'


def lines(spark, dataset):
    rows = [(dataset, i, f"open session_{i % 5} at 10.0.0.{i % 7}:80 took {i} KB", "open <*> at <*> took <*> <*>") for i in range(40)]
    rows += [(dataset, 100 + i, f"close session_{i % 9}", "close <*>") for i in range(20)]
    return spark.createDataFrame(rows, "dataset string, LineId long, Content string, EventTemplate string")


def test_run_writes_every_stage(spark, tmp_path):
    result = run(lines(spark, "x").drop("dataset"), out=str(tmp_path / "out"), until="analysis", drift=True)
    assert set(result) == {"structured", "variables", "values", "formats", "analysis"}
    formats = logs.read_formats(spark, str(tmp_path / "out" / "formats"))
    sessions = formats.where(F.col("Token").startswith("session_"))
    assert {r.ComponentFormat for r in sessions.collect()} == {"session_<D>"}
    assert sessions.select("GroupID").distinct().count() == 1
    scaled = spark.read.parquet(str(tmp_path / "out" / "analysis")).where("LineId = 7").first()
    assert scaled.params[2].num == 7.0 and scaled.params[1].type == "Identifier"


def test_run_options(spark):
    with pytest.raises(ValueError):
        run(lines(spark, "x"), until="never")
    assert "formats" not in run(lines(spark, "x").drop("dataset"), until="grouped")


def test_log_sets(spark, tmp_path):
    both = lines(spark, "Spark").unionByName(lines(spark, "BGL"))
    run_log_sets(both, str(tmp_path / "sets"), ["Spark", "BGL"])
    found = spark.read.parquet(*[str(tmp_path / "sets" / f"dataset={n}" / "formats") for n in ("Spark", "BGL")])
    assert found.count() > 0


def test_rejected_records_are_counted(spark, tmp_path):
    (tmp_path / "log.csv").write_text(
        'LineId,Content,EventTemplate\n1,"a ""b"", c",a <*>\n2,short\nx,not a number,t\n3,"broken\nline",t\n4,too,many,cells\n5,,t\n'
    )
    whole = logs.read_csv_checked(spark, str(tmp_path / "log.csv"), schemas.PARSED_LOG, multi_line=True)
    assert sorted((r.LineId, r.Content) for r in whole.rows.collect() if r.Content) == [(1, 'a "b", c'), (3, "broken\nline")]
    assert [r.Content for r in whole.rows.where("LineId = 5").collect()] == [None]
    reasons = sorted(r.reason for r in whole.rejected.collect())
    assert reasons == [logs.NO_NUMBER, logs.WRONG_WIDTH, logs.WRONG_WIDTH]
    # Without multi-line reading a quoted line break is seen, not swallowed.
    split = logs.read_csv_checked(spark, str(tmp_path / "log.csv"), schemas.PARSED_LOG)
    assert split.rejected.count() > 3


def test_committed_tables_are_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, ["a"]), (2, None), (2, None)], "i int, xs array<string>")
    logs.write_committed(rows, path)
    assert sorted(map(str, logs.read_committed(spark, path).collect())) == sorted(map(str, rows.collect()))
    rows.limit(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="committed"):
        logs.read_committed(spark, path)
    empty, there = rows.where("i > 5"), str(tmp_path / "empty")
    logs.write_committed(empty, there)
    assert logs.read_committed(spark, there).count() == 0


def test_run_folder_goes_after_success_only(spark, tmp_path):
    with staging.run_folder(spark) as folder:
        held = staging.stage(spark.range(3), "x")
        assert held.count() == 3 and os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))
    with pytest.raises(RuntimeError), staging.run_folder(spark) as folder:
        staging.stage(spark.range(3), "x")
        raise RuntimeError
    assert os.path.isdir(folder.removeprefix("file:"))
    result = run(lines(spark, "x").drop("dataset"), out=str(tmp_path / "out"))
    assert all(rows.count() > 0 for rows in result.values())  # nothing depends on the removed folder
