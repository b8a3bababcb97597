"""Operators against plain restatements of their rules on small random inputs."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from logvars.operators import (
    analysis, classify, compare, components, drift, extract, groups, induce, labels, match, numbering, ranking, sampling, variables,
)
from logvars.operators.staging import stage

HOLE = "<*>"


def align_by_hand(template, content):
    if len(template.split(" ")) == len(content.split(" ")):
        return template
    anchors, out, k = [t for t in template.split(" ") if t != HOLE], [], 0
    for tok in content.split(" "):
        if k < len(anchors) and tok == anchors[k]:
            out.append(tok)
            k += 1
        else:
            out.append("" if tok == "" else HOLE)
    return " ".join(out)


def recut_by_hand(template):
    return " ".join(HOLE if HOLE in t else t for t in template.split(" "))


def random_lines(n, seed):
    rnd = random.Random(seed)
    templates = ["a <*> b", "<*> c", "a b <*>x c <*>", "a <*> a <*> b c"]
    rows = []
    for i in range(n):
        content = " ".join(rnd.choice(["a", "b", "c", "", "x", "y"]) for _ in range(rnd.randint(1, 7)))
        rows.append((i + 1, content, rnd.choice(templates)))
    return rows


LINES = "LineId long, Content string, EventTemplate string"


def test_alignment(spark):
    rows = random_lines(600, 1) + [(1001, "a x y b", "a <*> b"), (1002, "a", "a <*> b"), (1003, "a  x b", "a <*> b"), (1004, "a  b", "a <*> b")]
    got = {r.LineId: r for r in extract.extract_parameters(spark.createDataFrame(rows, LINES)).collect()}
    for line, content, template in rows:
        want = align_by_hand(recut_by_hand(template), content)
        tokens = content.split(" ")
        assert got[line].NewTemplate == want
        assert got[line].ParameterList == [t for t, w in zip(tokens, want.split(" ")) if w == HOLE]
    assert got[1001].NewTemplate == "a <*> <*> b" and got[1003].NewTemplate == "a  <*> b"


@pytest.mark.parametrize("chunk_rows", [7, 40, 10_000])
def test_drift_equals_sequential_replay(spark, chunk_rows):
    rows = random_lines(400, 2)
    state, want = {}, {}
    for line, content, template in rows:
        state[template] = align_by_hand(state.get(template, recut_by_hand(template)), content)
        want[line] = state[template]
    got = drift.extract_with_drift(spark.createDataFrame(rows, LINES), chunk_rows).collect()
    assert {r.LineId: r.NewTemplate for r in got} == want


def test_extraction_runs_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame(random_lines(20, 3), LINES)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    job = extract.extract_parameters(stream).writeStream.format("memory").queryName("extracted").trigger(availableNow=True)
    started = job.option("checkpointLocation", str(tmp_path / "cp")).start()
    started.awaitTermination()
    assert spark.table("extracted").count() == 20


def test_numbering(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = numbering.number_by_order(df, ["k"], "n", start=1).collect()
    assert sorted((r.n, r.k) for r in rows) == [(k + 1, k) for k in range(1000)]
    text = "\n".join(["name", *[f"line {i:05d} {'x' * (i % 50)}" for i in range(5000)]]) + "\n"
    (tmp_path / "log.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scan = spark.read.option("header", True).csv(str(tmp_path / "log.csv"))
        got = numbering.number_by_file_order(scan).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r.name.split(" ")[1]) for r in sorted(got, key=lambda r: r.LineId)] == list(range(5000))
    assert sorted(r.LineId for r in got) == list(range(1, 5001))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {i: i for i in range(500)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = spark.range(500)
    got = components.connected_components(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.id: r.component for r in got} == {i: find(i) for i in range(500)}


def contained_by_hand(short, long):
    edge = set("._:-/\\,;|[](){}<>@#=+?")
    if not short or short.isdigit() or short == long or short not in long:
        return False
    start = long.find(short)
    end = start + len(short)
    return (start == 0 or long[start - 1] in edge) and (end == len(long) or long[end] in edge)


def test_containment(spark):
    rnd = random.Random(5)
    texts = {"".join(rnd.choice("ab1.-:") for _ in range(rnd.randint(0, 7))) for _ in range(400)}
    texts |= {"a.b", "ab", "1.b", "xa.a", "a.a.a", "\\a", "[a]", "a" + ".b" * 90}
    values = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(texts))], "DynamicID long, value string")
    got = {(r.short, r.long) for r in groups.contained_pairs(values).collect()}
    want = {(s, t) for s, t in itertools.permutations(texts, 2) if contained_by_hand(s, t)}
    assert got == want


def test_prefix_rows(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("gggh") if i < 900 else None, i, rnd.randint(1, 9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, i long, w int")
    got = ranking.prefix_rows(df, ["g"], [F.floor(F.col("i") / 64)], ["i"], F.lit(700), F.col("w"), at_least=3).collect()
    want = set()
    for g in ("g", "h", None):
        total = 0
        for r, (_, i, w) in enumerate([x for x in rows if x[0] == g], 1):
            total += w
            if total <= 700 or r <= 3:
                want.add(i)
    assert {r.i for r in got} == want


def test_token_budget(spark):
    rows = [("hot", "v" * (i % 9) + str(i), i) for i in range(3000)] + [("few", "w" * 400, i) for i in range(7)]
    values = spark.createDataFrame(rows, "g string, value string, first_line long")
    got = {(r.g, r.value, r.first_line) for r in sampling.token_budget_sample(values, ["g"], 500, 5).collect()}
    want = set()
    for g in ("hot", "few"):
        total = 0
        for r, row in enumerate(sorted([x for x in rows if x[0] == g], key=lambda x: (len(x[1]), x[2])), 1):
            total += max(1, len(row[1]) // 4)
            if total <= 500 or r <= 5:
                want.add(row)
    assert got == want


def test_mark_share_is_exact(spark):
    rows = spark.range(1003).withColumnRenamed("id", "LineId")
    assert labels.mark_share(rows, "LineId", 0.2).where("selected").count() == int(1003 * 0.2)
    assert labels.mark_share(rows, "LineId", 0.0005).where("selected").count() == 0


def variable(spark, *value_lists):
    rows = [("t%d" % k, 0, v, i) for k, vs in enumerate(value_lists) for i, v in enumerate(vs)]
    return stage(spark.createDataFrame(rows, "NewTemplate string, pos int, value string, first_line long"), "values")


def types_of(spark, *value_lists, **options):
    table, rows, _ = classify.classify(variable(spark, *value_lists), **options)
    found = {}
    for r in table.orderBy("DynamicID").collect():
        found.setdefault(int(r.NewTemplate[1:]), []).append((r.ValueType, r.TokenFormat, r.ComponentFormat))
    return found, rows


def test_types(spark):
    found, rows = types_of(
        spark, ["1", "0x1F"], ["1024)", "7)"], ["KB,", "MB,"], ["10.0.0.1:80", "a.b:2"], ["/a/b", "/c/d/e"], ["A_B", "C"],
        ["url=http://x", "url=y"], ["wait....3", "hold....1"], ["h=1", "h=22"], ["n10.0.0.1", "n1.2.3.4"], ["k_deadbeef", "k_00000000a"],
        ["foo1", "bar"], ["x-10.0.0.1", "x-10.0.0.2"],
    )
    assert found[0] == [("Value", "<C>", "<D>")]
    assert found[1] == [("Value", "<C>)", "<D>")]
    assert found[2] == [("Unit", "<C>,", "<D>")]
    assert found[3] == [("Identifier", "<C>", "<D>:<D>")]
    assert found[4] == [("Undecided", "/<C>", "<D>")]  # the shared first slash is cut, `a/b` alone is no path
    assert found[5] == [("Macro", "<C>", "<D>")]
    assert found[6] == [("Path", "url=<C>", "<D>")]
    assert sorted(found[7]) == [("Value", "<C>", "hold....<D>"), ("Value", "<C>", "wait....<D>")]
    assert found[8] == [("Value", "h=<C>", "<D>")]
    assert found[11] == [("Undecided", "<C>", "<D>")]
    assert found[12] == [("Undecided", "x-<C>", "<D>")]
    assert {r.value for r in rows.where("token = 'h=22'").collect()} == {"22"}
    _, kept = types_of(spark, ["h=1", "h=22"], keep_equals=True)
    assert {r.value for r in kept.where("token = 'h=22'").collect()} == {"=22"}


def test_lossy_strip_is_reported(spark):
    table, _, _ = classify.classify(variable(spark, ["(a)", "bcd"]))
    assert [r.strip_lossy for r in table.collect()] == [True]


def induced(spark, values):
    rows = [(1, "Undecided", v, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "GroupID long, ValueType string, value string, first_line long")
    return {r.value: (r.Format, r.Parts) for r in induce.group_formats(df).collect()}


def test_induced_formats(spark):
    assert induced(spark, ["65020ms", "48957ms"]) == {"65020ms": ("<D>ms", ["65020"]), "48957ms": ("<D>ms", ["48957"])}
    attempts = induced(spark, ["attempt_1445_0005_m_000000_0", "attempt_1445_0006_r_000001_0"])
    assert {f for f, _ in attempts.values()} == {"attempt_<D>_<D>_<D>_<D>_<D>"}
    assert {f for f, _ in induced(spark, ["183.62.156.108:22", "linux13.cse.edu.hk:22"]).values()} == {"<D>:<D>"}
    assert {f for f, _ in induced(spark, ["proxy.cse.edu.hk", "FF:F2:9F:16:BF:44", "org.apache.Foo"]).values()} == {"<D>"}
    assert {f for f, _ in induced(spark, ["org.a.B@5d61"]).values()} == {"<D>@<D>"}


def test_every_value_is_covered_and_reassembles(spark):
    rnd = random.Random(7)
    texts = {"".join(rnd.choice("ab12_-.:@<D>/") for _ in range(rnd.randint(0, 9))) for _ in range(500)}
    found = induced(spark, texts)
    assert set(found) == texts
    for value, (fmt, parts) in found.items():
        pieces = fmt.split("<D>")
        assert len(parts) == len(pieces) - 1
        assert pieces[0] + "".join(p + t for p, t in zip(parts, pieces[1:])) == value


def test_single_member_buckets_keep_their_value(spark):
    rows = [(1, "Undecided", v, i) for i, v in enumerate(["rdd_1", "broadcast_1", "broadcast_2"])]
    df = spark.createDataFrame(rows, "GroupID long, ValueType string, value string, first_line long")
    got = {r.value: r.Format for r in induce.group_formats(df, ["rdd_", "broadcast_"]).collect()}
    assert got == {"rdd_1": "<D>", "broadcast_1": "broadcast_<D>", "broadcast_2": "broadcast_<D>"}


def test_custom_proposer(spark):
    rows = [(1, "Undecided", v, i) for i, v in enumerate(["a1", "b2", "a.b"])]
    df = spark.createDataFrame(rows, "GroupID long, ValueType string, value string, first_line long")

    def proposer(merged):
        return merged.select("GroupID", F.lit("a<D>").alias("Format")).distinct()

    got = {r.value: (r.Format, r.Parts) for r in induce.group_formats(df, proposer=proposer).collect()}
    assert got == {"a1": ("a<D>", ["1"]), "b2": ("<D>", ["b2"]), "a.b": ("a<D>", [".b"])}


def test_order_never_puts_general_before_specific(spark):
    rnd = random.Random(8)
    fmts = {"".join(rnd.choice(["<D>", "a", "_", "b", "."]) for _ in range(rnd.randint(1, 5))) for _ in range(60)}
    df = spark.createDataFrame([("g", f) for f in fmts], "GroupKey string, Format string")
    ordered = [r.Format for r in match.order_formats(df).orderBy("format_rank").collect()]

    def covers(general, text):
        return re.fullmatch("(.*)".join(re.escape(x) for x in general.split("<D>")), text) is not None

    for earlier, later in itertools.combinations(ordered, 2):
        assert not (covers(earlier, later) and not covers(later, earlier))


def test_units(spark):
    rows = [("2", "KB"), ("2", "MB"), ("2", "GB"), ("2", "kb"), ("2", "ms"), ("2", "B"), ("x", "MB"), ("1_0", "KB")]
    df = spark.createDataFrame(rows, "v string, u string")
    got = [r[0] for r in df.select(analysis.scaled(F.col("v"), F.col("u"))).collect()]
    assert got == [2.0, 2048.0, 2097152.0, 2.0, 2.0, 0.0, None, 10.0]


def test_unknown_tokens_keep_their_text(spark):
    params = spark.createDataFrame([(1, "t", 0, "a"), (1, "t", 1, "zz")], "LineId long, NewTemplate string, pos int, value string")
    formats = spark.createDataFrame(
        [(0, "t", 0, "<C>", "a", "<D>", "a", ["a"], "Macro", 1, 1)],
        "DynamicID long, Template string, ParameterIndex int, TokenFormat string, Token string, ComponentFormat string,"
        "Value string, Parts array<string>, ValueType string, GroupID long, FirstLine long",
    )
    got = {r.pos: (r.value, r.format, r.matched) for r in analysis.lookup_formats(params, formats).collect()}
    assert got == {0: ("a", "<D>", True), 1: ("zz", "<D>", False)}


def test_exact_clusters(spark):
    base = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "LineId long, EventTemplate string")
    other = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, "q")], "LineId long, EventTemplate string")
    got = [(r.BaseTemplate, r.EventTemplate, r.n_lines) for r in compare.exact_clusters(base, other).collect()]
    assert got == [("x", "p", 2)]


def test_agreement_of_empty_sheets_is_null(spark):
    empty = spark.createDataFrame([(1, None)], "row_id long, Type string")
    assert labels.agreement(empty, empty).first()["percent"] is None


def test_result_does_not_depend_on_partitions(spark):
    lines = spark.createDataFrame(random_lines(200, 9), LINES)
    results = []
    for df in (lines.repartition(1), lines.repartition(17), lines.orderBy(F.desc("LineId"))):
        values = stage(variables.variable_values(extract.extract_parameters(df)), "values")
        table, rows, _ = classify.classify(values)
        grouped = groups.same_value_groups(table, stage(rows, "rows"))
        joined = table.join(grouped, "DynamicID").select("DynamicID", "NewTemplate", "pos", "ValueType", "GroupID")
        results.append(sorted(map(tuple, joined.collect())))
    assert results[0] == results[1] == results[2]


def replayed(rows):
    state, out = {}, {}
    for line, content, template in rows:
        state[template] = align_by_hand(state.get(template, recut_by_hand(template)), content)
        out[line] = state[template]
    return out


def test_a_change_in_the_first_of_many_chunks_reaches_the_last_in_few_rounds(spark, monkeypatch):
    rows = [(1, "a b x c", "a b <*>")] + [(i, f"a b {i}" if i % 50 else f"a  {i} q", "a b <*>") for i in range(2, 641)]
    rounds = []
    monkeypatch.setattr(drift, "stage", lambda df, name: rounds.append(name) or stage(df, name))
    got = drift.extract_with_drift(spark.createDataFrame(rows, LINES), chunk_rows=10)
    assert {r.LineId: r.NewTemplate for r in got.collect()} == replayed(rows)
    # One round for each depth of templates, and one for each power of the block among 64 chunks.
    assert rounds.count("drift-moves") + rounds.count("drift-entering") <= 8


def test_drift_over_outlying_repeated_and_missing_line_numbers(spark):
    rows = random_lines(300, 5)
    rows = [(i * (1 if i < 250 else 10**12), c, t) for i, c, t in rows] + [(1 << 62, "a b c", "a <*> b")]
    got = drift.extract_with_drift(spark.createDataFrame(rows, LINES), chunk_rows=10).collect()
    assert {r.LineId: r.NewTemplate for r in got} == replayed(rows)
    # Lines that share a number, or have none, follow each other in one fixed order.
    odd = [(None if i % 3 else 7, c, t) for i, c, t in random_lines(200, 6)]
    table = spark.createDataFrame(odd, LINES)
    by_hash = [tuple(r)[:3] for r in table.orderBy(F.asc_nulls_first("LineId"), F.xxhash64("Content")).collect()]
    state, want = {}, []
    for line, content, template in by_hash:
        state[template] = align_by_hand(state.get(template, recut_by_hand(template)), content)
        want.append((line or -1, content, template, state[template]))
    for chunk_rows in (9, 1000):
        found = drift.extract_with_drift(table, chunk_rows).collect()
        assert sorted((r.LineId or -1, r.Content, r.EventTemplate, r.NewTemplate) for r in found) == sorted(want)


def test_prefix_states_against_a_walk(spark):
    rnd = random.Random(9)
    maps = [(t, c, [rnd.randrange(4) for _ in range(4)]) for t in (1, 2) for c in sorted(rnd.sample(range(700), 90))]
    table = stage(spark.createDataFrame(maps, "tid int, chunk long, map array<int>"), "maps")
    want, state = {}, {}
    for t, c, step in maps:
        want[t, c] = state.get(t, 0)
        state[t] = step[want[t, c]]
    for block in (3, 64, 1000):
        assert {(r.tid, r.chunk): r.state for r in drift.prefix_states(table, block).collect()} == want


def plain_prefix(rows, order, budget, at_least=0):
    """{group: ids} of (group, weight, id, …) rows."""
    want = set()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=order)
        total, limit = 0, budget(len(mine))
        for k, r in enumerate(mine, 1):
            total += r[1]
            if total <= limit or k <= at_least:
                want.add(r[2])
    return want


@pytest.mark.parametrize("limit", [1, 3, 40, 10_000])
def test_prefix_rows_cut_again_until_the_edge_is_small(spark, limit):
    rnd = random.Random(limit)
    rows = [(rnd.choice("ab"), rnd.choice([0, 1, 1, 5]), i, rnd.choice([7, 7, 7, rnd.randrange(50), 10**17]), rnd.randrange(4)) for i in range(700)]
    rows += [(None, 1, 1000, 5, 5), ("one", 9, 1001, -3, 2)]
    df = stage(spark.createDataFrame(rows, "g string, w int, i long, a long, b long"), "rows")
    keys, order = [F.col("a"), F.col("b"), F.col("i")], ["a", "b", "i"]
    for share in (0.0, 0.3, 0.9, 5.0):
        got = ranking.prefix_rows(df, ["g"], keys, order, F.floor(F.col("_total") * share), F.col("w"), at_least=2, limit=limit)
        want = plain_prefix(rows, lambda r: (r[3], r[4], r[2]), lambda n, s=share: int(n * s), 2)
        found = [r.i for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_an_outlier_and_equal_lengths_leave_a_small_edge(spark):
    values = spark.range(1_000_000).select(
        F.lit("g").alias("g"), F.lit("abcd").alias("value"), F.when(F.col("id") == 999_999, 1 << 60).otherwise(F.col("id")).alias("first_line")
    )
    rows = ranking.with_keys(stage(values, "values"), [F.length("value"), F.col("first_line")])
    edges = ranking.prefix_edges(rows, ["g"], F.lit(400_123), limit=1000).collect()
    assert len(edges) == 1 and edges[0]["_n"] <= 1000 and edges[0]["_n0"] <= 400_123 < edges[0]["_n0"] + edges[0]["_n"]
    kept = sampling.token_budget_sample(stage(values, "values"), ["g"], 400_123, 5)
    found = kept.agg(F.count(F.lit(1)).alias("n"), F.max("first_line").alias("last")).first()
    assert (found["n"], found["last"]) == (400_123, 400_122)


def test_clusters_are_compared_in_parts_of_bounded_size(spark, monkeypatch):
    lines = spark.range(1000).select(F.col("id").alias("LineId"), F.concat(F.lit("t"), F.col("id") % 3).alias("EventTemplate"))
    monkeypatch.setattr(compare, "PART_LINES", 10, raising=False)
    found = compare.exact_clusters(lines, lines)
    assert "hashpartitioning(LineId" in (plan := found._jdf.queryExecution().toString()) and ", 100)" in plan
    assert sorted(map(tuple, found.collect())) == [("t0", "t0", 334), ("t1", "t1", 333), ("t2", "t2", 333)]


def test_buckets_are_joined_with_written_tables(spark, sf):
    from logvars.plans.catalog import QUERIES

    # Neither values nor groups are made again below the join, so that no group is sorted as one key.
    assert "Aggregate" not in QUERIES["prefix_buckets"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
