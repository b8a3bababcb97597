"""Column expressions on tables of edge cases."""

import ast
import random
import time

import pytest
from pyspark.sql import functions as F

from logvars.functions import formats as fm
from logvars.functions import literals
from logvars.functions import predicates as p
from logvars.functions import similarity
from logvars.functions import templates as tpl
from logvars.operators import analysis, induce


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", *[e.alias(f"c{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()
    return [r[1] if len(exprs) == 1 else tuple(r[1:]) for r in rows]


V = F.col("v")


def test_number(spark):
    yes = ["1", ".5", "5.", "1e5", "-2", "+3", " 7 ", "NaN", "inf", "-Infinity", "1_000", "0x1F", "+nan", "1e1_0"]
    no = ["1d", "1f", "0x1p3", "1__0", "_1", "", ".", "1e", "1,000", "1.0D"]
    assert all(column(spark, yes, p.is_number(V)))
    assert not any(column(spark, no, p.is_number(V)))
    assert column(spark, ["X-", "Q"], p.is_number(V, ["X-"])) == [True, False]


def test_number_agrees_with_python(spark):
    texts = ["1", "1.", "1_0", "1_0.0_1e1_0", "e5", "1e+5", "--1", "infinity", "Infinit", "1 2", "\t3\t", "0b1", "nan1", "1_"]

    def python(text):
        try:
            float(text)
        except ValueError:
            return False
        return True

    assert column(spark, texts, p.is_number(V)) == [python(t) for t in texts]


def test_marks_of_first_value(spark):
    cases = {"(a),": (1, 2), "(((": (1, 2), ".": (0, 1), "": (0, 0), "[x]": (1, 1), "ab": (0, 0), "()": (1, 1)}
    got = column(spark, list(cases), p.leading_marks(V), p.trailing_marks(V))
    assert got == list(cases.values())


def test_host_path_macro_unit(spark):
    hosts = {"10.0.0.1:80": True, "a.b:1": True, "a:1": False, "a.b:": False, "a..b:1": False, "999.1.1.1:2": True}
    assert column(spark, list(hosts), p.is_host_port(V)) == list(hosts.values())
    paths = {"/a/b": True, "/a": False, "C:\\x": True, "\\\\a\\\\b": True, "\\a\\b": False, "a/b/c": True}
    assert column(spark, list(paths), p.is_path(V)) == list(paths.values())
    macros = {"A_B": True, "FETCH": True, "A__B": False, "_A": False, "Ab": False, "": False}
    assert column(spark, list(macros), p.is_macro(V)) == list(macros.values())
    units = {"KB,": "kb", "(ms)": "ms", "x": None, "MB).": "mb", "..": None}
    assert column(spark, list(units), p.unit_of(V)) == list(units.values())


def test_list_literals(spark):
    lists = [["a", "b"], ["it's", "b"], ['q"x', "y"], [], ["a\\b", "\t", "\n"], ["\x01é", "both ' and \""], ["\\x41"]]
    assert column(spark, [repr(x) for x in lists], literals.parse_list(V)) == lists
    assert [ast.literal_eval(repr(x)) for x in lists] == lists


def test_json_lists(spark):
    texts = ['["a", "b"]', '{"a": 1}', "x", "[1]", " []"]
    assert column(spark, texts, fm.json_list(V)) == [["a", "b"], None, None, ["1"], []]


def test_format_regex_and_captures(spark):
    fmt = "a{<D>}.b[<D>]$"
    regex = fm.to_regex(F.lit(fmt))
    got = column(spark, ["a{1}.b[x]$", "a{1}xb[x]$"], F.regexp_like(V, regex), fm.captures(V, regex, F.lit(2)))
    assert got[0] == (True, ["1", "x"]) and got[1][0] is False
    assert column(spark, ["k"], fm.captures(V, fm.to_regex(F.lit("k")), F.lit(0))) == [[]]


def test_format_repair(spark):
    cases = {"a<D_<D>": "a<D>_<D>", "aD>": "a<D>", "<D>": "<D>", "<D <D>": "<D> <D>"}
    assert column(spark, list(cases), fm.repair(V)) == list(cases.values())
    merged = {"<D> <D>x": "<D>x", "<D><D><D>": "<D>", "<D>-<D>": "<D>-<D>"}
    assert column(spark, list(merged), fm.merge_slots(V)) == list(merged.values())
    entity = {"<D>.<D>.<D>.<D>": True, "/a/<D>": True, "a/<D>": False, "C:/x": True, "<D>.<D>": False}
    assert column(spark, list(entity), fm.is_single_entity(V)) == list(entity.values())


def test_templates(spark):
    assert column(spark, ["a b<*>c  <*>", "x"], tpl.recut(V)) == ["a <*>  <*>", "x"]
    assert column(spark, ["a <*> b <*>c"], tpl.count_holes(V)) == [2]
    nth = [tpl.replace_nth_hole(V, F.lit("Z"), F.lit(n)) for n in (1, 2, 3)]
    assert column(spark, ["<*> a <*>"], *nth) == [("Z a <*>", "<*> a Z", "<*> a <*>")]
    regex = {r"a \(.*\) (.*?)$": "a (.*) <*>", r"x\:(.*?)\$": "x:<*>", "p": "p"}
    assert column(spark, list(regex), tpl.from_regex_template(V)) == list(regex.values())


def test_similarity(spark):
    from difflib import SequenceMatcher

    df = spark.createDataFrame([("abcd", "bcde"), ("same", "same"), ("", "x")], "a string, b string")
    got = [r[0] for r in df.select(similarity.text_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([SequenceMatcher(None, a, b).ratio() for a, b in [("abcd", "bcde"), ("same", "same"), ("", "x")]])


def test_regex_templates_by_pieces(spark):
    cases = {
        "\\\\(.*?)x$": "\\<*>x", "\\(.*?)(.*?)": "(.*?)<*>", "a\\\\$": "a\\", "a\\$": "a", "a$\n": "a$\n", "\\d\\.": "\\d.", "$": "", "": "", None: None,
    }
    assert column(spark, list(cases), tpl.from_regex_template(V)) == list(cases.values())


def test_regex_templates_cost_little_per_line(spark):
    """A text is cut into pieces once, not once for each of its pieces."""
    texts = [r"\(.*?)" + r"(.*?) in memory on \(x\)\: " * 200, r"(.*?) in memory on \(x\)\: " * 200]
    lines = spark.range(0, 2000, 1, 4).select(F.when(F.col("id") % 20 == 0, texts[0]).otherwise(texts[1]).alias("v"))
    start = time.monotonic()
    n = lines.select(tpl.from_regex_template(V).alias("t")).agg(F.sum(F.length("t")).alias("n")).first()["n"]
    assert n == 2000 * 200 * len("<*> in memory on (x): ") + 100 * len("(.*?)")
    assert time.monotonic() - start < 20


def test_parts_are_the_captures(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(400):
        pieces = [rnd.choice(["", "a", "_", "ab", "aa", "é", ".", "$"]) for _ in range(rnd.randint(1, 5))]
        value = "".join(p + rnd.choice(["", "a", "1", "_a_", "aab", "é.", "x\ny"]) * (i + 1 < len(pieces)) for i, p in enumerate(pieces))
        rows.append((value, "<D>".join(pieces)))
    rows += [("a\n", "a"), ("ab\n", "a<D>"), ("", ""), ("", "<D>")]
    regex, pieces = fm.to_regex(F.col("f")), F.split("f", fm.SLOT, -1)
    found = spark.createDataFrame(rows, "v string, f string").where(F.regexp_like(V, regex)).select(
        "v", "f", fm.parts(V, regex, pieces).alias("parts"), fm.captures(V, regex, fm.count_slots(F.col("f"))).alias("want")
    ).collect()
    assert len(found) > 200
    for r in found:
        assert r.parts == r.want, r


def test_scans_before_patterns_change_no_outcome(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["a", "B", "1", ".", "..", "/", "\\", ":", "://", "<D", ">", "-", "_", " ", "=", "é", "\n"])
                     for _ in range(rnd.randint(0, 7))) for _ in range(1500)]
    texts += ["h.x:80", "a.b.c", "C:/x", "00:1b:44:11:3a:b7", "wait....7", "http://x", None]
    plain = {"host": V.rlike(p.HOST_PORT), "path": V.rlike(p.PATH), "dot": V.rlike(p.DOT_SUFFIX), "segments": F.split(V, "[_-]", -1)}
    whole = V.rlike("<D|D>") | V.rlike(induce.URL) | V.rlike(induce.DOTTED) | V.rlike(induce.MAC) | V.rlike(p.PATH) | (V == "")
    plain["kind"] = F.when(V.rlike(p.HOST_PORT), "joined").when(whole, "whole").when(V.rlike(induce.JOINED), "joined").otherwise("parts")
    made = {"host": p.is_host_port(V), "path": p.is_path(V), "dot": p.is_dot_suffix(V), "segments": induce.segments(V), "kind": induce.kind_of(V)}
    columns = [c.alias(f"{k}_{n}") for n, cs in enumerate([plain, made]) for k, c in cs.items()]
    for r in spark.createDataFrame([(t,) for t in texts], "v string").select("v", *columns).collect():
        for k in plain:
            assert r[f"{k}_0"] == r[f"{k}_1"], (k, r)
    # Patterns come after a scan, and formats of lines are not tested again.
    assert "contains" in str(made["host"]) and "contains" in str(made["path"])
    assert "RLIKE" not in str(analysis._settled(F.col("x"), F.col("r"))).upper()
