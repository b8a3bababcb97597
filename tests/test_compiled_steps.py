"""Steps over lines and values are compiled, and give what their interpreted forms give."""

import re

from pyspark.sql import functions as F

from logvars.functions import templates as tpl
from logvars.operators import analysis, classify, extract, groups, induce, variables
from logvars.operators.staging import stage
from logvars.plans import catalog
from logvars.plans.workflow import run

LINES = "LineId long, Content string, EventTemplate string"
#: Methods with more bytecode are left to the JVM's interpreter.
COMPILED = 8000


def code_sizes(df):
    """The largest method of each compiled part of a plan."""
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        text = df.select("*")._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set(key, before)
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def test_normalised_values_are_cut_by_code_that_is_compiled(spark):
    rows = [(i, f"run ({i}) of wait....{i} at h{i}.x.y:80 url=http://q{i} n=0x{i:08x} a=1{i} p10.0.0.{i}", "run <*> of <*> at <*> <*> <*> <*> <*>")
            for i in range(1, 30)]
    lines = spark.createDataFrame(rows, LINES)
    found = classify.classify(stage(variables.variable_values(extract.extract_parameters(lines)), "values"))
    sizes = code_sizes(found.values)
    assert sizes and max(sizes) < COMPILED, sizes
    cut = {r.token: r.value for r in found.values.collect()}
    assert cut["(7)"] == "7" and cut["wait....7"] == "7" and cut["url=http://q7"] == "http://q7" and cut["h7.x.y:80"] == "h7.x.y:80"
    assert cut["n=0x00000007"] == "0x00000007" and cut["a=17"] == "17" and cut["p10.0.0.7"] == "p10.0.0.7"


def staged_names(monkeypatch, modules):
    """Names of the tables that the modules stage from now on."""
    names = []

    def keep(df, name, *how):
        names.append(name)
        return stage(df, name, *how)

    for module in modules:
        monkeypatch.setattr(module, "stage", keep)
    return names


def test_values_are_shaped_once_for_formats_and_records(spark, monkeypatch):
    names = staged_names(monkeypatch, [induce])
    lines = spark.createDataFrame([(i, f"run rdd_{i}_{i % 3} of u{i}-x", "run <*> of <*>") for i in range(30)], LINES)
    result = run(lines, "Spark", until="analysis")
    formats = {(r.Template, r.ParameterIndex, r.Token): r.ComponentFormat for r in result["formats"].collect()}
    assert len(formats) == 60 and {formats["run <*> of <*>", 0, "rdd_7_1"], formats["run <*> of <*>", 1, "u7-x"]} == {"rdd_<D>_<D>", "u<D>-x"}
    assert names.count("shaped") == names.count("models") == 1


def test_contained_pairs_are_found_once_for_groups_and_texts(spark, sf, monkeypatch):
    names = staged_names(monkeypatch, [groups])
    assert catalog.containment_texts(spark, sf).count() > 0
    assert names.count("prefix-hashes") == 1


def test_items_of_short_and_long_lists_are_made_alike(spark):
    lists = [None, [], ["a"], ["a", None, "c"], list("abcdefgh"), list("abcdefghi"), list("abcdefghijklmnop")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, v array<string>")

    def body(x, i):
        return F.struct(F.upper(x).alias("u"), (i + 1).alias("n"), F.get(F.col("v"), i + 1).alias("after"))

    for r in df.select("v", tpl.each(F.col("v"), body).alias("got"), F.transform("v", body).alias("want")).collect():
        assert r.got == r.want, r


def test_records_of_few_and_of_many_holes_are_those_of_the_format_table(spark, monkeypatch):
    def line(i, holes):
        words = [f"broadcast_{i}_piece{i % 3}", f"{i}.5", "KB,", f"u{i}@h{i}:x", f"/var/l{i}/p", f"h{i}.a.b:{i}", f"wait....{i}", f"=1{i}", f"c-{i % 4}-d"]
        words = (words * 2)[:holes]
        return " ".join(w for j, x in enumerate(words) for w in (f"k{holes}", x)), " ".join([f"k{holes} <*>"] * holes)

    rows = [(i, *line(i, holes)) for i in range(40) for holes in (1, 3, 8, 9, 14)]
    rows = [(n, content, template) for n, (_, content, template) in enumerate(rows)]
    rows += [(900, "k3 one k3 two words k3 three", "k3 <*> k3 <*> k3 <*>"), (901, "k1", "k1 <*>")]
    written = {}

    def keep(df, name, *how):
        written[name] = stage(df, name, *how)
        return written[name]

    monkeypatch.setattr(analysis, "stage", keep)
    result = run(spark.createDataFrame(rows, LINES), "Spark", until="analysis")
    want = analysis.analysis_ready(result["structured"], stage(result["formats"], "formats"))
    both = [{(r.LineId, r.NewTemplate): [tuple(x) for x in r.params] for r in df.collect()} for df in (result["analysis"], want)]
    assert len(both[0]) == len(rows) and both[0] == both[1]
    # A part that is the value is not written again, and keys lie apart from items.
    cut = written["cut-lines"]
    assert "_keys" in cut.columns and cut.where(F.exists("items", lambda x: x["parts"] == F.array(x["value"]))).isEmpty()


def test_holes_are_found_from_the_first_character_of_a_token(spark):
    texts = ["a <*> b", "x<*>y:<*>", "<*>", "a<*> <*>b  <*>", " <*>\t<*> c", "no hole", "<*", "a\n<*>b c<*>", "<*><*> d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tpl.recut(F.col("t")).alias("got"), F.regexp_replace("t", r"[^ ]*<\*>[^ ]*", "<*>").alias("want")).collect():
        assert r.got == r.want, r


def test_lines_are_extracted_by_columns(spark):
    lines = spark.createDataFrame([(1, "a 1 b", "a <*> b"), (2, "a 1 2 b", "a <*> b")], LINES)
    plan = extract.extract_parameters(lines)._jdf.queryExecution().optimizedPlan().toString()
    split = [x for x in plan.split("\n") if "split(" in x]
    # Both token lists are made once, outside of lambdas.
    assert len(split) == 1 and split[0].count("split(") == 2 and "lambda" not in split[0], plan
