"""Registered queries: name -> (Spark function, SQL text to check it with or None)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import formats as fm
from ..functions import literals as lit
from ..functions import predicates as p
from ..functions import templates as tpl
from ..operators import analysis, classify, compare, drift, extract, groups, induce, labels, match, numbering, sampling, variables
from ..operators.staging import shared_dir, stage, stage_narrow
from ..sources import logs
from . import fixtures as fx
from . import check_sql as tests
from .check_sql import GROUP_PROPOSAL, VARIABLE_PROPOSAL, format_regex, number, one_set, sql
from .workflow import SPECIAL_MARKERS, SPLIT_PREFIXES, run

MARKERS = SPECIAL_MARKERS["BGL"]
PREFIXES = SPLIT_PREFIXES["Spark"]
MEMORY_TEMPLATE = "<*> <*> in memory on <*> (size: <*> <*> free: <*> <*>"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if check is not None:
            CHECKS[fn.__name__] = check
        return fn

    return register


# ---- shared steps -------------------------------------------------------------------


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_parameters(fx.parsed_logs(spark, sf))


def _values(spark: SparkSession, sf: str) -> DataFrame:
    return variables.variable_values(_extracted(spark, sf))


def _templates(spark: SparkSession, sf: str) -> DataFrame:
    found = fx.parsed_logs(spark, sf).groupBy("EventId", "EventTemplate").agg(F.count(F.lit(1)).alias("Occurrences"))
    return stage(found, "templates")


def _structured(spark: SparkSession, sf: str, codec: str | None = None) -> DataFrame:
    """Extracted parameters as a written table, for jobs that read them more than once."""
    return stage(_extracted(spark, sf).select("LineId", "NewTemplate", "ParameterList"), "structured", codec)


def _classified(spark: SparkSession, sf: str, extracted: DataFrame | None = None) -> classify.Classified:
    values = variables.variable_values(_extracted(spark, sf) if extracted is None else extracted)
    return classify.classify(stage(values, "values", "zstd"), MARKERS)


def _grouped(spark: SparkSession, sf: str, extracted: DataFrame | None = None) -> classify.Classified:
    """Variables with GroupID, written values, and facts."""
    table, rows, facts = _classified(spark, sf, extracted)
    rows = stage_narrow(rows, "rows", {"value": F.col("token")})
    grouped = stage(groups.attach_groups(table, groups.same_value_groups(table, rows)), "grouped")
    return classify.Classified(grouped, rows, facts)


def _members(spark: SparkSession, sf: str) -> DataFrame:
    table, rows, _ = _grouped(spark, sf)
    return _with_groups(table, rows)


def _with_groups(table: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(table.select("DynamicID", "GroupID"), "DynamicID")


def _format_rows(spark: SparkSession, sf: str, extracted: DataFrame | None = None) -> DataFrame:
    table, rows, _ = _grouped(spark, sf, extracted)
    return induce.format_rows(table, rows, induce.group_formats(_with_groups(table, rows), PREFIXES))


def _keyed_values(spark: SparkSession, sf: str) -> DataFrame:
    key = (
        F.when(F.col("value").startswith("session_"), "session")
        .when(F.col("value").startswith("broadcast_"), "block")
        .when(F.col("value").contains(".example.org:"), "peer")
        .otherwise("rest")
    )
    return _values(spark, sf).select(key.alias("GroupKey"), "value").distinct()


_KEYED = """(select distinct case when starts_with(value, 'session_') then 'session' when starts_with(value, 'broadcast_') then 'block'
  when contains(value, '.example.org:') then 'peer' else 'rest' end as GroupKey, value from vals)"""
# Formats to try: given ones, and those that values have when words with digits (or digits alone) become slots.
_WORDS_WITH_DIGITS, _DIGITS = "[A-Za-z0-9]*[0-9][A-Za-z0-9]*", "[0-9]+"


def _candidate_sql(*generalised: str) -> str:
    made = " ".join(f"union select GroupKey, regexp_replace(value, '{g}', '<D>', 'g') from {_KEYED}" for g in generalised)
    return f"""(select distinct GroupKey, regexp_replace(Format, '(?:<D>\\s*){{2,}}', '<D>', 'g') as Format from (
      select GroupKey, Format from formats_fixed where GroupKey in (select GroupKey from {_KEYED}) {made}))"""


def _candidates(spark: SparkSession, sf: str, values: DataFrame, *generalised: str) -> DataFrame:
    made = fx.formats_fixed(spark).join(values.select("GroupKey").distinct(), "GroupKey", "left_semi").select("GroupKey", "Format")
    for g in generalised:
        made = made.union(values.select("GroupKey", F.regexp_replace("value", g, fm.SLOT)))
    return stage(made.distinct(), "candidates")


def _text(parts) -> "F.Column":
    return F.array_join(parts, "|")


# ---- templates and parameters -------------------------------------------------------


@query(sql("""
select EventTemplate, count(*) as Occurrences, array_to_string(list_transform(string_split(EventTemplate, ' '),
  lambda x: case when contains(x, '<*>') then '<*>' else x end), ' ') as NewTemplate,
  cast(len(string_split(EventTemplate, '<*>')) - 1 as bigint) as n_holes
from parsed_logs where contains(EventTemplate, '<*>') group by EventTemplate"""))
def recut_templates(spark, sf):
    return extract.recut_templates(_templates(spark, sf)).select(
        "EventTemplate", "Occurrences", "NewTemplate", tpl.count_holes(F.col("EventTemplate")).cast("long").alias("n_holes")
    )


@query(sql("""
select NewTemplate, row_number() over (partition by NewTemplate order by i) - 1 as Hole, i - 1 as TokenIndex
from (select NewTemplate, unnest(string_split(NewTemplate, ' ')) as tok, unnest(generate_series(1, len(string_split(NewTemplate, ' ')))) as i
  from (select distinct array_to_string(list_transform(string_split(EventTemplate, ' '),
    lambda x: case when contains(x, '<*>') then '<*>' else x end), ' ') as NewTemplate from parsed_logs))
where tok = '<*>'"""))
def hole_positions(spark, sf):
    recut = extract.recut_templates(_templates(spark, sf)).select("NewTemplate").distinct()
    found = extract.hole_positions(recut)
    return found.select("NewTemplate", F.col("Hole").cast("long"), F.col("TokenIndex").cast("long"))


@query(sql("""
select LineId, NewTemplate, cast(pos as bigint) as pos, value from (
  select LineId, array_to_string(t, ' ') as NewTemplate, list_filter(c, lambda x, i: t[i] = '<*>') as ps,
    unnest(generate_series(0, len(ps) - 1)) as pos, unnest(ps) as value
  from (select LineId, string_split(Content, ' ') as c, list_transform(string_split(EventTemplate, ' '),
    lambda x: case when contains(x, '<*>') then '<*>' else x end) as t from parsed_logs) where len(c) = len(t))"""))
def extract_params(spark, sf):
    fitted = extract.extract_parameters(fx.parsed_logs(spark, sf), realign=False)
    return extract.explode_parameters(fitted, "LineId").withColumn("pos", F.col("pos").cast("long"))


@query(sql("select LineId, NewTemplate, cast(pos as bigint) as pos, value from params"))
def all_params(spark, sf):
    """Every parameter, those of realigned lines too."""
    return extract.explode_parameters(_extracted(spark, sf), "LineId").withColumn("pos", F.col("pos").cast("long"))


@query(sql("""
select LineId, NewTemplate, array_to_string(params, '|') as params from ext
where len(string_split(Content, ' ')) <> len(string_split(EventTemplate, ' '))"""))
def align_params(spark, sf):
    odd = extract.unaligned_lines(fx.parsed_logs(spark, sf))
    return extract.extract_parameters(odd).select("LineId", "NewTemplate", _text("ParameterList").alias("params"))


@query(sql("""
select LineId, NewTemplate, array_to_string(list_filter(string_split(Content, ' '), lambda x, i: f[i] = '<*>'), '|') as params
from (select LineId, Content, s as NewTemplate, string_split(s, ' ') as f from (
  select unnest(ids) as LineId, unnest(contents) as Content, unnest(list_append(r.done[2:], r.cur)) as s from (
    select ids, contents, list_reduce(contents, lambda st, c: struct_pack(
        cur := case when len(string_split(c, ' ')) = len(string_split(st.cur, ' ')) then st.cur else array_to_string(list_reduce(string_split(c, ' '),
          lambda s, x: struct_pack(
            k := case when x = list_filter(string_split(st.cur, ' '), lambda w: w <> '<*>')[s.k + 1] then s.k + 1 else s.k end,
            o := list_append(s.o, case when x = list_filter(string_split(st.cur, ' '), lambda w: w <> '<*>')[s.k + 1] then x when x = '' then '' else '<*>' end)),
          {'k': 0, 'o': []::varchar[]}).o, ' ') end,
        done := list_append(st.done, st.cur)), {'cur': base, 'done': []::varchar[]}) as r
    from (select list(LineId order by LineId) as ids, list(Content order by LineId) as contents,
        array_to_string(list_transform(string_split(EventTemplate, ' '), lambda x: case when contains(x, '<*>') then '<*>' else x end), ' ') as base
      from parsed_logs group by EventTemplate having bool_or(len(string_split(Content, ' ')) <> len(string_split(EventTemplate, ' ')))))
  union all select LineId, Content, NewTemplate from ext where EventTemplate not in (
    select EventTemplate from parsed_logs where len(string_split(Content, ' ')) <> len(string_split(EventTemplate, ' ')))))"""))
def drift_templates(spark, sf):
    found = drift.extract_with_drift(fx.parsed_logs(spark, sf))
    return found.select("LineId", "NewTemplate", _text("ParameterList").alias("params"))


@query(sql("""
select EventTemplate, count(*) as n_lines from parsed_logs_b
where EventTemplate not in (select EventTemplate from parsed_logs) group by EventTemplate"""))
def lines_without_template(spark, sf):
    missing = extract.lines_without_template(fx.parsed_logs_b(spark, sf), _templates(spark, sf))
    return missing.groupBy("EventTemplate").agg(F.count(F.lit(1)).alias("n_lines"))


@query(sql("select NewTemplate, Content, min(LineId) as first_line from ext group by NewTemplate, Content"))
def distinct_contents(spark, sf):
    return variables.distinct_contents(_extracted(spark, sf))


@query(sql("""
select NewTemplate, min(LineId) as LineId, arg_min(EventTemplate, LineId) as EventTemplate, arg_min(Content, LineId) as Content
from ext group by NewTemplate"""))
def first_lines(spark, sf):
    return variables.first_lines(_extracted(spark, sf)).select("NewTemplate", "LineId", "EventTemplate", "Content")


@query(sql("select NewTemplate, cast(pos as bigint) as pos, value, first_line from vals"))
def variable_values(spark, sf):
    return _values(spark, sf).withColumn("pos", F.col("pos").cast("long"))


@query(sql("""
select NewTemplate, cast(pos as bigint) as pos, value, min(first_line) as first_line from (
  select NewTemplate, first_line, unnest(generate_series(0, len(ps) - 1)) as pos, unnest(ps) as value from (
    select *, list_filter(string_split(Content, ' '), lambda x, i: string_split(NewTemplate, ' ')[i] = '<*>') as ps from (
      select *, row_number() over (partition by NewTemplate order by md5('line-sample-' || first_line), first_line) as r
      from (select NewTemplate, Content, min(LineId) as first_line from ext group by NewTemplate, Content)) where r <= 20))
group by NewTemplate, pos, value"""))
def representative_values(spark, sf):
    found = variables.representative_values(_extracted(spark, sf), 20, labels.SEED)
    return found.withColumn("pos", F.col("pos").cast("long"))


@query(sql("""
select case when EventId in ('E1', 'E2') then 'tasks' else 'hosts' end as dataset, NewTemplate, cast(pos as bigint) as pos, value,
  min(LineId) as first_line from params group by all"""))
def log_set_values(spark, sf):
    lines = fx.parsed_logs(spark, sf).withColumn("dataset", F.when(F.col("EventId").isin("E1", "E2"), "tasks").otherwise("hosts"))
    found = variables.variable_values(extract.extract_parameters(lines), ["dataset"])
    return found.withColumn("pos", F.col("pos").cast("long"))


@query(sql("""
select LineId, row_number() over (order by EventId, Content, LineId) as n from parsed_logs"""))
def numbered_lines(spark, sf):
    lines = fx.parsed_logs(spark, sf).select("EventId", "Content", "LineId")
    return numbering.number_by_order(lines, ["EventId", "Content", "LineId"], "n", start=1).select("LineId", "n")


# ---- value tests and types ----------------------------------------------------------

_WORDS = """(select distinct value from vals union select distinct unnest(string_split(text, ' ')) from conversations)"""


def _words(spark, sf):
    words = fx.scan(spark, sf, "conversations").select(F.explode(tpl.tokens(F.col("text"))).alias("value"))
    return _values(spark, sf).select("value").union(words).distinct()


@query(sql(f"""
select value, {number('value')} as is_number, lower(value) in ('kb', 'mb', 'gb', 'ms') as is_unit,
  {tests.host_port('value')} as is_host, {tests.path('value')} as is_path,
  {tests.macro('value')} as is_macro, {tests.dot_suffix('value')} as is_dot
from {_WORDS}"""))
def value_tests(spark, sf):
    v = F.col("value")
    return _words(spark, sf).select(
        "value", p.is_number(v, MARKERS).alias("is_number"), p.is_unit(v).alias("is_unit"), p.is_host_port(v).alias("is_host"),
        p.is_path(v).alias("is_path"), p.is_macro(v).alias("is_macro"), p.is_dot_suffix(v).alias("is_dot"),
    )


@query(sql("""
select value, unit from (select value, lower(trim(value, ',.:;)([]{}''/"<>')) as unit from vals group by value)
where unit in ('kb', 'mb', 'gb', 'ms')"""))
def unit_tokens(spark, sf):
    return _values(spark, sf).select("value", p.unit_of(F.col("value")).alias("unit")).where("unit is not null").distinct()


@query(sql("select NewTemplate, cast(pos as bigint) as pos, value, marks, s as bare from stripped"))
def punct_strip(spark, sf):
    values = stage(_values(spark, sf), "values")
    marks = stage(classify.punctuation(classify.first_values(values)), "marks")
    found = classify.strip_marks(values, marks)
    return found.select("NewTemplate", F.col("pos").cast("long"), "value", "marks", "bare")


@query(sql("select NewTemplate, cast(pos as bigint) as pos, affix, TokenFormat from formatted"))
def affix_normal(spark, sf):
    values = stage(_values(spark, sf), "values")
    marks = stage(classify.punctuation(classify.first_values(values)), "marks")
    return classify.variable_facts(values, marks, MARKERS).select("NewTemplate", F.col("pos").cast("long"), "affix", "TokenFormat")


@query(sql("""
select NewTemplate, cast(pos as bigint) as pos, ComponentFormat, value, count(*) as n_tokens from named
where ComponentFormat like '%...%' group by NewTemplate, pos, ComponentFormat, value"""))
def dot_suffix(spark, sf):
    table, rows, _ = _classified(spark, sf)
    dotted = table.where(F.col("ComponentFormat").contains("...")).select("DynamicID", "NewTemplate", "pos", "ComponentFormat")
    found = rows.join(dotted, "DynamicID").groupBy("NewTemplate", "pos", "ComponentFormat", "value")
    return found.agg(F.count(F.lit(1)).alias("n_tokens")).withColumn("pos", F.col("pos").cast("long"))


@query(sql("""
select DynamicID, NewTemplate, cast(pos as bigint) as pos, TokenFormat, ComponentFormat, ValueType, n_values, format_line from variables"""))
def variable_types(spark, sf):
    return _classified(spark, sf).variables.select(
        "DynamicID", "NewTemplate", F.col("pos").cast("long"), "TokenFormat", "ComponentFormat", "ValueType", "n_values", "format_line"
    )


@query(sql("select DynamicID, token, value, first_line from numbered"))
def normalised_values(spark, sf):
    return _classified(spark, sf).values.select("DynamicID", "token", "value", "first_line")


# ---- groups -------------------------------------------------------------------------


@query(sql("select DynamicID, NewTemplate, cast(pos as bigint) as pos, ValueType, GroupID from grouped"))
def same_value_groups(spark, sf):
    return _grouped(spark, sf)[0].select("DynamicID", "NewTemplate", F.col("pos").cast("long"), "ValueType", "GroupID")


# Undecided values of the logs, and made-up ones of which many contain each other, under numbers of their own.
_OWNERS = """owners as (select distinct DynamicID, value from numbered where ValueType = 'Undecided'
  union select DynamicID + 1000000, value from contain_values), texts as (select distinct value from owners)"""

# Fixed values in this text: the characters that may border a contained value.
_PAIRS = r"""cut as (select value, [0] || [i for i in range(1, length(value) + 1) if contains('._:-/\,;|[](){}<>@#=+?', value[i])] || [length(value) + 1] as b
    from texts),
  opened as (select value, b, unnest(b) as lo from cut), closed as (select value, lo, unnest(b) as hi from opened),
  pairs as (select s.value as short, l.value as long from closed l join texts s on s.value = l.value[l.lo + 1:l.hi - 1]
    where l.hi > l.lo + 1 and s.value <> l.value and not regexp_matches(s.value, '^\d*$') and strpos(l.value, s.value) = l.lo + 1)"""


def _owners(spark, sf):
    _, rows, _ = _classified(spark, sf)
    found = rows.where("ValueType = 'Undecided'").select(F.col("DynamicID").cast("long"), "value")
    made = fx.contain_values(spark, sf).select((F.col("DynamicID") + 1000000).cast("long").alias("DynamicID"), "value")
    return stage(found.union(made).distinct(), "owners")


@query(sql(f"""
select cast(DynamicID as bigint) as DynamicID, long, short, replace(long, short, '<sub>') as sub from (
  with {_OWNERS}, {_PAIRS} select v.DynamicID, long, short from owners v join pairs on v.value = long)""", "numbered", "contain_values"))
def contained_values(spark, sf):
    return groups.contained_values(_owners(spark, sf))


_CONTAINMENT = f"""(select DynamicID, dense_rank() over (order by root) as GroupID from (
  with recursive {_OWNERS}, {_PAIRS},
  links as (select distinct a.DynamicID as s, b.DynamicID as d from pairs join owners a on a.value = short join owners b on b.value = long),
  both_ways as (select s, d from links union select d, s from links),
  reached as (select distinct DynamicID as id, DynamicID as r from owners union select id, d from reached join both_ways on r = s)
  select cast(id as bigint) as DynamicID, min(r) as root from reached group by id))"""


@query(sql(f"select DynamicID, GroupID from {_CONTAINMENT}", "numbered", "contain_values"))
def containment_groups(spark, sf):
    values = _owners(spark, sf)
    return groups.containment_groups(values.select("DynamicID").distinct(), values)


@query(sql(f"""
select distinct GroupID, DynamicID, sub from {_CONTAINMENT} join (
  with {_OWNERS}, {_PAIRS} select cast(v.DynamicID as bigint) as DynamicID, replace(long, short, '<sub>') as sub
  from owners v join pairs on v.value = long) using (DynamicID)""", "numbered", "contain_values"))
def containment_texts(spark, sf):
    values = _owners(spark, sf)
    pairs = stage(groups.contained_pairs(values), "pairs")  # found once for groups and texts
    found = groups.containment_groups(values.select("DynamicID").distinct(), values, pairs)
    texts = groups.group_texts(found, groups.contained_values(values, pairs))
    return texts.select("GroupID", "DynamicID", F.explode("subs").alias("sub"))


# ---- samples ------------------------------------------------------------------------


@query(sql("select GroupID, value, bucket, used from buckets"))
def prefix_buckets(spark, sf):
    members = _members(spark, sf)
    # Written, so that a few groups are not a key to sort all values by, and values are merged once.
    opened = stage(induce.open_groups(members), "open")
    merged = stage(induce.merged_values(members.join(opened, "GroupID")), "merged")
    return induce.prefix_buckets(merged, PREFIXES).select("GroupID", "value", "bucket", "used")


@query(sql("""
select NewTemplate, cast(pos as bigint) as pos, value from (
  select *, sum(greatest(1, length(value) // 4)) over w as cum, row_number() over w as r from vals
  window w as (partition by NewTemplate, pos order by length(value), first_line, value rows unbounded preceding))
where cum <= 30000 or r <= 5"""))
def token_budget(spark, sf):
    kept = sampling.token_budget_sample(stage(_values(spark, sf), "values"), variables.VARIABLE)
    return kept.select("NewTemplate", F.col("pos").cast("long"), "value")


@query(sql("""
select NewTemplate, cast(pos as bigint) as pos, value from (
  select *, row_number() over (partition by NewTemplate, pos order by md5('line-sample-' || value), value) as r,
    count(*) over (partition by NewTemplate, pos) as n from vals)
where r <= greatest(5, floor(n * 0.25::double))"""))
def uniform_values(spark, sf):
    kept = sampling.uniform_sample(stage(_values(spark, sf), "values"), variables.VARIABLE, 0.25)
    return kept.select("NewTemplate", F.col("pos").cast("long"), "value")


# ---- given formats ------------------------------------------------------------------

def _rx(fmt: str) -> str:
    return "(" + format_regex(fmt) + ")"


def _ordered(formats: str, name: str = "") -> str:
    """Pairs are tested where the one begins and ends like the other's text; other pairs cannot match."""
    return f"""tried{name} as (select *, split_part(Format, '<D>', 1) as head, string_split(Format, '<D>')[-1] as tail from {formats}),
ordered{name} as (
  select f.GroupKey, f.Format, cast(count(g.Format) as bigint) as n_more_general, len(string_split(f.Format, '<D>')) - 1 as slots,
    row_number() over (partition by f.GroupKey order by count(g.Format) desc, length(f.Format) desc, f.Format) as format_rank
  from tried{name} f left join tried{name} g on f.GroupKey = g.GroupKey and f.Format <> g.Format
    and starts_with(f.Format, g.head) and ends_with(f.Format, g.tail)
    and regexp_matches(f.Format, {_rx('g.Format')}) and not regexp_matches(g.Format, {_rx('f.Format')})
  group by f.GroupKey, f.Format)"""


_COARSE = _candidate_sql(_WORDS_WITH_DIGITS)
_MATCHED = f"""{_ordered(_COARSE)}, matched as (
  select k.GroupKey, k.value, arg_min(o.Format, format_rank) as Format, arg_min(slots, format_rank) as slots
  from {_KEYED} k left join ordered o on k.GroupKey = o.GroupKey and regexp_matches(k.value, {_rx('o.Format')})
  where k.GroupKey is not null group by k.GroupKey, k.value)"""


def _parts(value: str, fmt: str, most: int = 6) -> str:
    groups = [f"regexp_extract({value}, {_rx(fmt)}, {i})" for i in range(1, most + 1)]
    cases = " ".join(f"when {n} then concat_ws('|', {', '.join(groups[:n])})" for n in range(1, most + 1))
    return f"case when {fmt} is null then null else case len(string_split({fmt}, '<D>')) - 1 when 0 then '' {cases} end end"


@query(sql(f"select * from (with {_ordered(_candidate_sql(_WORDS_WITH_DIGITS, _DIGITS))} select GroupKey, Format, n_more_general, format_rank from ordered)", "vals", "formats_fixed"))
def format_order(spark, sf):
    values = stage(_keyed_values(spark, sf), "keyed")
    found = match.order_formats(_candidates(spark, sf, values, _WORDS_WITH_DIGITS, _DIGITS))
    return found.select("GroupKey", "Format", F.col("n_more_general").cast("long"), F.col("format_rank").cast("long"))


def _matched(spark, sf) -> tuple[DataFrame, DataFrame]:
    values = stage(_keyed_values(spark, sf), "keyed")
    candidates = _candidates(spark, sf, values, _WORDS_WITH_DIGITS)
    return match.match_formats(values, candidates), candidates


@query(sql(f"select * from (with {_MATCHED} select GroupKey, value, Format, {_parts('value', 'Format')} as parts from matched)", "vals", "formats_fixed"))
def format_match(spark, sf):
    found, _ = _matched(spark, sf)
    return found.select("GroupKey", "value", "Format", _text("Parts").alias("parts"))


@query(sql(f"select * from (with {_MATCHED} select GroupKey, Format, count(*) as n_values from matched group by GroupKey, Format)", "vals", "formats_fixed"))
def format_cover(spark, sf):
    found = stage(_matched(spark, sf)[0], "matched")
    left = match.unmatched_values(found).groupBy("GroupKey").agg(F.count(F.lit(1)).alias("n_values"))
    none = left.select("GroupKey", F.lit(None).cast("string").alias("Format"), "n_values")
    return match.used_formats(found).unionByName(none)


@query(sql(f"""select * from (with {_MATCHED} select GroupKey, Format from {_COARSE} f
  where not exists (select 1 from matched m where m.GroupKey = f.GroupKey and m.Format = f.Format))""", "vals", "formats_fixed"))
def rejected_formats(spark, sf):
    found, candidates = _matched(spark, sf)
    return match.rejected_formats(found, candidates)


_BROKEN = "(select distinct regexp_replace(value, '[0-9]+', case when length(value) % 3 = 0 then '<D' when length(value) % 3 = 1 then 'D>' else '<D> <D>' end, 'g') as broken from vals)"


@query(sql(f"""
select broken, fixed, regexp_replace(fixed, '(?:<D>\\s*){{2,}}', '<D>', 'g') as merged from (
  select broken, replace(replace(replace(replace(replace(replace(broken, '<D>', chr(1)), '<D', '<D>'), '<D>', chr(1)), 'D>', '<D>'), '<D>', chr(1)), chr(1), '<D>') as fixed
  from {_BROKEN})"""))
def format_repair(spark, sf):
    size = F.length("value") % 3
    broken = F.regexp_replace(
        F.col("value"), F.lit("[0-9]+"), F.when(size == 0, "<D").when(size == 1, "D>").otherwise("<D> <D>")
    )
    fixed = fm.repair(F.col("broken"))
    return (
        _values(spark, sf).select(broken.alias("broken")).distinct()
        .select("broken", fixed.alias("fixed"), fm.merge_slots(fixed).alias("merged"))
    )


@query(sql(f"""
select * from (with generalised as (select distinct regexp_replace(value, '[0-9]+', '<D>', 'g') as Format from vals)
select Format, regexp_matches(Format, '^(<D>\\.){{3}}<D>$') or regexp_matches(Format, '^[A-Za-z]:[\\\\/]')
  or length(Format) - length(replace(Format, '/', '')) >= 2 or length(Format) - length(replace(Format, '\\\\', '')) >= 4 as is_entity from generalised)""", "vals"))
def entity_formats(spark, sf):
    made = _values(spark, sf).select(F.regexp_replace("value", "[0-9]+", "<D>").alias("Format")).distinct()
    return made.select("Format", fm.is_single_entity(F.col("Format")).alias("is_entity"))


@query("""
select conv_id, turn, cast(len(string_split(text, ' ')) as bigint) as n_items,
  array_to_string(string_split(text, ' '), '|') as items, turn % 3 <> 1 as is_list from conversations""")
def json_lists(spark, sf):
    talk = fx.scan(spark, sf, "conversations")
    made = F.to_json(tpl.tokens(F.col("text")))
    broken = F.when(F.col("turn") % 3 == 1, F.concat(F.lit('{"a": '), made, F.lit("}"))).otherwise(made)
    parsed = talk.select("conv_id", "turn", made.alias("good"), broken.alias("raw"))
    return parsed.select(
        "conv_id", "turn", F.size(fm.json_list(F.col("good"))).cast("long").alias("n_items"),
        _text(fm.json_list(F.col("good"))).alias("items"), fm.json_list(F.col("raw")).isNotNull().alias("is_list"),
    )


@query("""
select conv_id, turn, cast(len(string_split(text, ' ')) as bigint) as n_items, array_to_string(string_split(text, ' '), '|') as items
from conversations""")
def list_literals(spark, sf):
    talk = fx.scan(spark, sf, "conversations")

    def quoted(item):
        plain = F.replace(F.replace(item, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
        single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
        double = F.concat(F.lit('"'), plain, F.lit('"'))
        return F.when(item.contains("'") & ~item.contains('"'), double).otherwise(single)

    text = F.concat(F.lit("["), F.array_join(F.transform(tpl.tokens(F.col("text")), quoted), ", "), F.lit("]"))
    parsed = talk.select("conv_id", "turn", lit.parse_list(text).alias("items"))
    return parsed.select("conv_id", "turn", F.size("items").cast("long").alias("n_items"), _text("items").alias("items"))


# ---- formats found by rule ----------------------------------------------------------

_GROUP_FORMATS = "(select GroupID, value, Format from proposed union all select GroupID, value, '<D>' from buckets where not used)"
_JOIN_PARTS = "array_to_string(regexp_extract_all(value, '[^@:=$#]+'), '|')"


def _found_parts(value: str, fmt: str) -> str:
    return f"case when regexp_matches({value}, {_rx(fmt)}) then {_parts(value, fmt)} else {value} end"


@query(sql(f"select GroupID, value, Format, {_found_parts('value', 'Format')} as parts from {_GROUP_FORMATS}", extra=GROUP_PROPOSAL))
def induced_formats(spark, sf):
    found = induce.group_formats(_members(spark, sf), PREFIXES)
    return found.select("GroupID", "value", "Format", _text("Parts").alias("parts"))


# A proposer that answers by samples: their digits as slots that lost a bracket, one format that fits nothing, and a refusal.
PROPOSAL = {"rounds": 2, "max_tokens": 200}
_NO_LIST, _NO_FIT = "no formats found", "no_such_<D>"


def _propose(samples: DataFrame, attempt: int) -> DataFrame:
    made = F.array_distinct(F.transform("samples", lambda v: F.regexp_replace(v, _DIGITS, "<D")))
    keys = ["GroupID", "bucket"]
    lists = samples.select(*keys, F.to_json(F.array_append(made, F.lit(_NO_FIT))).alias("answer"))
    return lists.union(samples.select(*keys, F.lit(_NO_LIST)))


def _round(n: int, source: str) -> str:
    """Sample, formats, order and first fits of one round over ``source`` (GroupKey, GroupID, bucket, value, first_line)."""
    general = f"regexp_replace(regexp_replace(value, '{_DIGITS}', '<D>', 'g'), '(?:<D>\\s*){{2,}}', '<D>', 'g')"
    return f"""sample{n} as (select * from (
  select *, sum(greatest(1, length(value) // 4)) over w as cum, row_number() over w as r from {source}
  window w as (partition by GroupKey order by length(value), first_line, value rows unbounded preceding)) where cum <= 200 or r <= 5),
formats{n} as (select GroupKey, {general} as Format from sample{n} union select GroupKey, '{_NO_FIT}' from sample{n}),
{_ordered(f"formats{n}", str(n))},
fits{n} as (select s.GroupKey, GroupID, bucket, s.value, first_line, arg_min(o.Format, format_rank) as Format
  from {source} s left join ordered{n} o on s.GroupKey = o.GroupKey and starts_with(s.value, split_part(o.Format, '<D>', 1))
    and regexp_matches(s.value, {_rx('o.Format')}) group by all),
rest{n} as (select GroupKey, GroupID, bucket, value, first_line from fits{n} where Format is null)"""


_ROUNDS = f"""begun as (select GroupID || '/' || bucket as GroupKey, GroupID, bucket, value, first_line from buckets where used),
{_round(1, "begun")}, {_round(2, "rest1")}"""
_IS_ENTITY = f"({tests.path('Format')} or Format = '<D>.<D>.<D>.<D>')"
_PROPOSED = f"""select * from (with {_ROUNDS},
verified as (select distinct cast(GroupID as varchar) as GroupKey, Format from (select * from fits1 union all select * from fits2) where Format is not null),
{_ordered("verified", "_all")},
chosen as (select m.GroupID, m.value, coalesce(arg_min(o.Format, format_rank), '<D>') as Format from merged m
  left join ordered_all o on o.GroupKey = cast(m.GroupID as varchar) and starts_with(m.value, split_part(o.Format, '<D>', 1))
    and regexp_matches(m.value, {_rx('o.Format')}) group by m.GroupID, m.value)
select GroupID, value, case when {_IS_ENTITY} then '<D>' else Format end as Format,
  case when {_IS_ENTITY} then value else {_parts('value', 'Format', 9)} end as parts from chosen)"""
_REFUSED = "select GroupID, bucket, {n} as attempt, '" + _NO_LIST + "' as text, 'not a list' as reason from sample{n}"
_UNUSED = """select distinct s.GroupID, s.bucket, {n}, f.Format, 'fits no value' from formats{n} f join sample{n} s on s.GroupKey = f.GroupKey
  where not exists (select 1 from fits{n} x where x.GroupKey = f.GroupKey and x.Format = f.Format)"""


@query(sql(_PROPOSED, "merged", "buckets"))
def proposed_formats(spark, sf):
    found, _ = induce.proposed_formats(_members(spark, sf), _propose, PREFIXES, **PROPOSAL)
    return found.select("GroupID", "value", "Format", _text("Parts").alias("parts"))


@query(sql(f"select * from (with {_ROUNDS} " + " union ".join(t.format(n=n) for n in (1, 2) for t in (_REFUSED, _UNUSED)) + ")", "buckets"))
def rejected_proposals(spark, sf):
    result = run(fx.parsed_logs(spark, sf), "Spark", markers=MARKERS, proposer=_propose, proposal=PROPOSAL)
    return result["rejected"].select("GroupID", "bucket", F.col("attempt").cast("long"), "text", "reason")


_FORMAT_TABLE = f"""(select v.DynamicID, v.NewTemplate as Template, v.pos as ParameterIndex, v.TokenFormat, n.token as Token,
    case when v.ValueType = 'Undecided' then g.Format else v.ComponentFormat end as ComponentFormat, n.value as Value,
    v.ValueType, v.GroupID, n.first_line as FirstLine
  from grouped v join numbered n on v.DynamicID = n.DynamicID
  left join {_GROUP_FORMATS} g on v.ValueType = 'Undecided' and g.GroupID = v.GroupID and g.value = n.value)"""


@query(sql(f"""
select DynamicID, Template, cast(ParameterIndex as bigint) as ParameterIndex, TokenFormat, Token, ComponentFormat, Value,
  case when ValueType = 'Undecided' then {_found_parts('Value', 'ComponentFormat')} else Value end as Parts, ValueType, GroupID
from {_FORMAT_TABLE}""", extra=GROUP_PROPOSAL))
def format_table(spark, sf):
    return _format_rows(spark, sf).select(
        "DynamicID", "Template", F.col("ParameterIndex").cast("long"), "TokenFormat", "Token", "ComponentFormat", "Value",
        _text("Parts").alias("Parts"), "ValueType", "GroupID",
    )


@query(sql(f"""
select DynamicID, ComponentFormat, count(*) as n_values, min(Token) as min_token, max(Token) as max_token
from {_FORMAT_TABLE} group by DynamicID, ComponentFormat""", extra=GROUP_PROPOSAL))
def nested_formats(spark, sf):
    nested = induce.nested_formats(induce.stage_format_rows(_format_rows(spark, sf)), chunk_rows=1000)
    return nested.groupBy("DynamicID", "ComponentFormat").agg(
        F.sum(F.size("ValueList")).alias("n_values"),
        F.min(F.array_min("Tokens")).alias("min_token"), F.max(F.array_max("Tokens")).alias("max_token"),
    )


@query(sql("""
select v.DynamicID, n.token as Token, case when v.ValueType = 'Undecided' then p.Format else v.ComponentFormat end as ComponentFormat
from variables v join numbered n on v.DynamicID = n.DynamicID
left join proposed p on v.ValueType = 'Undecided' and p.DynamicID = v.DynamicID and p.value = n.value""", extra=VARIABLE_PROPOSAL))
def variable_formats(spark, sf):
    table, rows, _ = _classified(spark, sf)
    return induce.variable_formats(table, stage(rows, "rows")).select("DynamicID", "Token", "ComponentFormat")


# ---- analysis-ready records ---------------------------------------------------------

@query(sql(f"""
select p.NewTemplate, cast(p.pos as bigint) as pos, count(*) as n_lines from params p
where not exists (select 1 from variables v where v.NewTemplate = p.NewTemplate and v.pos = p.pos and v.ValueType <> 'Undecided')
group by p.NewTemplate, p.pos"""))
def params_without_format(spark, sf):
    """Variables still undecided after typing have no format yet."""
    table, rows, _ = _classified(spark, sf)
    typed = table.where("ValueType <> 'Undecided'").select(F.col("NewTemplate").alias("Template"), F.col("pos").alias("ParameterIndex"))
    found = analysis.parameters_without_format(_extracted(spark, sf), typed)
    return found.withColumn("pos", F.col("pos").cast("long"))


_RECORDS = f"""(select p.LineId, p.NewTemplate, p.pos, coalesce(f.Value, p.value) as value,
    case when f.ValueType = 'Undecided' then {_found_parts('f.Value', 'f.ComponentFormat')} else coalesce(f.Value, p.value) end as parts,
    coalesce(replace(f.TokenFormat, '<C>', f.ComponentFormat), '<D>') as format, f.ValueType as type,
    lead(f.ValueType) over line as next_type, lead(f.Value) over line as next_value
  from params p left join {_FORMAT_TABLE} f on f.Template = p.NewTemplate and f.ParameterIndex = p.pos and f.Token = p.value
  window line as (partition by p.LineId order by p.pos))"""
_NUM = """case when next_type = 'Unit' then try_cast(value as double) * case next_value when 'MB' then 1024 when 'GB' then 1048576 when 'B' then 0 else 1 end end"""


def _records(spark, sf):
    extracted = _structured(spark, sf, "zstd")
    return analysis.analysis_ready(extracted, induce.stage_format_rows(_format_rows(spark, sf, extracted)))


def _applied(spark, sf, template: str | None = None, only: tuple[int, ...] | None = None):
    """The same records without looking up tokens: lines meet per-template rules, and combinations of shapes.

    With ``template`` and ``only``, its lines alone become records of these parameters; the rules still follow from all lines.
    """
    extracted = _structured(spark, sf)
    table, rows, facts = _grouped(spark, sf, extracted)
    rules = induce.group_rules(_with_groups(table, rows), PREFIXES)
    wanted = extracted if template is None else extracted.where(F.col("NewTemplate") == template)
    return analysis.apply_formats(wanted, analysis.template_rules(facts, table, rules), rules.shapes, PREFIXES, only=only)


def _items(records):
    return records.select("LineId", "NewTemplate", F.explode_outer("params").alias("p")).select(
        "LineId", "NewTemplate", F.col("p.pos").cast("long").alias("pos"), "p.value", _text("p.parts").alias("parts"),
        "p.format", "p.type", "p.num",
    )


_ITEMS = sql(f"""
select LineId, NewTemplate, cast(pos as bigint) as pos, value, parts, format, type, {_NUM} as num from {_RECORDS}
union all select LineId, NewTemplate, null, null, null, null, null, null from ext where coalesce(len(params), 0) = 0""", extra=GROUP_PROPOSAL)


@query(_ITEMS)
def analysis_ready(spark, sf):
    return _items(_records(spark, sf))


@query(_ITEMS)
def applied_formats(spark, sf):
    return _items(_applied(spark, sf))


@query(sql(f"select * from (select LineId, cast(pos as bigint) as pos, value, next_value as unit, {_NUM} as kb from {_RECORDS}) where kb is not null", extra=GROUP_PROPOSAL))
def unit_scaled(spark, sf):
    rows = _applied(spark, sf).select(
        "LineId",
        F.explode(F.transform("params", lambda x, i: F.struct(x.alias("it"), F.get("params", i + 1)["value"].alias("unit")))).alias("r"),
    )
    return rows.select("LineId", F.col("r.it.pos").cast("long").alias("pos"), F.col("r.it.value").alias("value"), "r.unit",
                       F.col("r.it.num").alias("kb")).where("kb is not null")


@query(sql(f"""
select split_part(h.value, ':', 1) as host, count(*) as n_lines,
  cast(sum(cast(m.num as decimal(20,4))) as double) as total_kb, cast(max(cast(m.num as decimal(20,4))) as double) as max_kb
from (select * from {_RECORDS} where pos = 2 and NewTemplate = '{MEMORY_TEMPLATE}') h
join (select LineId, {_NUM} as num from {_RECORDS} where pos = 5) m on h.LineId = m.LineId group by 1""", extra=GROUP_PROPOSAL))
def free_memory_by_host(spark, sf):
    # The amount's unit is the parameter after it.
    return analysis.free_memory_by_host(_applied(spark, sf, MEMORY_TEMPLATE, (2, 5, 6)), MEMORY_TEMPLATE, 2, 5)


# ---- readers and writers ----------------------------------------------------------

_AWKWARD = """case LineId % 4 when 0 then '"' || Content || '", ' || chr(10) || 'and "more"' when 1 then ' ' || Content || chr(13) || chr(10)
  when 2 then '"' else Content || ',NA' end"""


def _awkward(lines: DataFrame) -> DataFrame:
    """Texts with quotes, commas and line breaks."""
    content = F.col("Content")
    quoted = F.concat(F.lit('"'), content, F.lit('", \nand "more"'))
    made = F.when(F.col("LineId") % 4 == 0, quoted).when(F.col("LineId") % 4 == 1, F.concat(F.lit(" "), content, F.lit("\r\n")))
    return lines.withColumn("Content", made.when(F.col("LineId") % 4 == 2, '"').otherwise(F.concat(content, F.lit(",NA"))))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/logvars-{name}-{uuid.uuid4().hex}"


@query(sql(f"select LineId, {_AWKWARD} as Content, EventTemplate, 0 as n_rejected from parsed_logs"))
def csv_round_trip(spark, sf):
    """The log written as CSV for people, and read back with its rejected records counted."""
    path = _folder(spark, "csv")
    logs.write_sheet(_awkward(fx.parsed_logs(spark, sf).select("LineId", "Content", "EventTemplate")), path)
    read = logs.read_csv_checked(spark, path, schemas.PARSED_LOG, multi_line=True)
    return read.rows.select("LineId", "Content", "EventTemplate").withColumn("n_rejected", F.lit(read.rejected.count()))


@query(sql("select reason, count(*) as n from (select case when LineId % 7 = 3 then 'wrong number of cells' else 'not a number' end as reason from parsed_logs where LineId % 7 > 2 and LineId % 7 < 5) group by reason union all select 'read', count(*) from parsed_logs where LineId % 7 < 3 or LineId % 7 > 4"))
def rejected_records(spark, sf):
    """Lines of a file with missing cells and with texts in place of numbers."""
    path = _folder(spark, "broken")
    lines = fx.parsed_logs(spark, sf)
    cells = F.when(F.col("LineId") % 7 == 3, F.col("LineId").cast("string")).when(F.col("LineId") % 7 == 4, F.lit("x,a b,a <*>"))
    text = cells.otherwise(F.concat(F.col("LineId").cast("string"), F.lit(",a b,a <*>")))
    lines.select(text.alias("LineId,Content,EventTemplate")).write.option("header", True).option("quote", "").option("sep", "\x01").csv(path)
    read = logs.read_csv_checked(spark, path, schemas.PARSED_LOG)
    good = read.rows.agg(F.lit("read").alias("reason"), F.count(F.lit(1)).alias("n"))
    return read.rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(good)


@query(sql(f"select LineId, {_AWKWARD} as Content, array_to_string(string_split(EventTemplate, ' '), '|') as tokens from parsed_logs"))
def table_round_trip(spark, sf):
    """The log as a table with a manifest, checked when it is read."""
    path = _folder(spark, "table")
    lines = _awkward(fx.parsed_logs(spark, sf)).select("LineId", "Content", tpl.tokens(F.col("EventTemplate")).alias("tokens"))
    logs.write_committed(lines, path)
    return logs.read_committed(spark, path).withColumn("tokens", _text("tokens"))


@query(sql(f"select LineId, {_AWKWARD} as Content, EventTemplate from parsed_logs"))
def adapted_csv(spark, sf):
    """Regex templates from a CSV file whose texts hold line breaks."""
    path = _folder(spark, "regex")
    logs.write_sheet(_awkward(fx.regex_logs(spark, sf)), path)
    found = compare.adapt_regex_templates(logs.read_regex_log(spark, path, multi_line=True))
    return found.select(F.col("LineId").cast("long"), "Content", "EventTemplate")


# ---- other parsers ------------------------------------------------------------------


@query(sql("""
select LineId, Content, replace(replace(replace(replace(left(RegexTemplate, -1), '(.*?)', '<*>'), chr(92) || '(', '('), chr(92) || ')', ')'),
  chr(92) || ':', ':') as EventTemplate from regex_logs"""))
def regex_template_adapter(spark, sf):
    return compare.adapt_regex_templates(fx.regex_logs(spark, sf))


@query(sql("select LineId + 1 as LineId, EventId, Content, EventTemplate from parsed_logs"))
def positional_adapter(spark, sf):
    return compare.adapt_positional(fx.parsed_logs(spark, sf).select(F.col("LineId").cast("string"), "EventId", "Content", "EventTemplate"))


_SAME = """(select a.EventTemplate as BaseTemplate, b.EventTemplate, count(*) as n_lines from parsed_logs a join parsed_logs_b b using (LineId)
  group by a.EventTemplate, b.EventTemplate
  having count(*) = (select count(*) from parsed_logs x where x.EventTemplate = a.EventTemplate)
    and count(*) = (select count(*) from parsed_logs_b y where y.EventTemplate = b.EventTemplate))"""


@query(sql(f"select BaseTemplate, EventTemplate, n_lines from {_SAME}"))
def exact_clusters(spark, sf):
    return compare.exact_clusters(fx.parsed_logs(spark, sf), fx.parsed_logs_b(spark, sf))


@query()
def template_similarity(spark, sf):
    pairs = compare.exact_clusters(fx.parsed_logs(spark, sf), fx.parsed_logs_b(spark, sf))
    return compare.compare_templates(pairs)


@query(sql(f"""
select Template, Content, unnest(generate_series(0, len(string_split(Template, '<*>')) - 2)) as ParameterIndex from (
  select b.EventTemplate as Template, arg_min(b.Content, b.LineId) as Content from parsed_logs_b b
  where b.EventTemplate in (select EventTemplate from {_SAME} where BaseTemplate <> EventTemplate) group by b.EventTemplate)"""))
def parser_difference_sheet(spark, sf):
    sheet = compare.parser_difference_sheet(fx.parsed_logs(spark, sf), fx.parsed_logs_b(spark, sf))
    return sheet.select("Template", "Content", F.col("ParameterIndex").cast("long"))


# Parameters of the other parser's log that the format table of the first one's does not know.
_UNKNOWN = sql("select NewTemplate, cast(pos as bigint) as pos, count(*) as n_lines from params group by NewTemplate, pos", "parsed_logs_b")
_UNKNOWN = _UNKNOWN.replace("from parsed_logs where contains(EventTemplate", "from parsed_logs_b where contains(EventTemplate")
_KNOWN = sql(f"select distinct Template, ParameterIndex from {_FORMAT_TABLE}", extra=GROUP_PROPOSAL)


@query(f"select u.* from ({_UNKNOWN}) u where not exists (select 1 from ({_KNOWN}) k where k.Template = u.NewTemplate and k.ParameterIndex = u.pos)")
def params_of_other_log(spark, sf):
    other = extract.extract_parameters(fx.parsed_logs_b(spark, sf))
    found = analysis.parameters_without_format(other, induce.stage_format_rows(_format_rows(spark, sf)))
    return found.withColumn("pos", F.col("pos").cast("long"))


# ---- labels -------------------------------------------------------------------------


@query(sql("""
select EventTemplate as Template, LineId, Content as Log, cast(unnest(generate_series(0, len(params) - 1)) as bigint) as Index, unnest(params) as Value
from (select *, row_number() over (partition by EventTemplate order by md5('line-sample-' || LineId), LineId) as r from ext) where r <= 10"""))
def parameter_label_sheet(spark, sf):
    sheet = labels.parameter_label_sheet(fx.parsed_logs(spark, sf), _templates(spark, sf), 10)
    return sheet.withColumn("Index", F.col("Index").cast("long"))


@query(sql("""
select LineId, EventTemplate, row_number() over (order by md5('line-sample-' || LineId), LineId) <= floor(count(*) over () * 0.2::double) as selected
from parsed_logs"""))
def marked_share(spark, sf):
    return labels.mark_share(fx.parsed_logs(spark, sf).select("LineId", "EventTemplate"), "LineId", 0.2)


@query(sql(f"""
select o.EventTemplate as OldTemplate, Template as NewTemplate,
  list_reduce(list_transform(string_split(Template, '<*>'), lambda x, i: case when i = 1 then x when i = ParameterIndex + 2 then Token || x else '<*>' || x end), lambda a, b: a || b) as Content,
  cast(ParameterIndex as bigint) as ParameterIndex, TokenFormat, Token, ComponentFormat,
  case when ValueType = 'Undecided' then {_found_parts('Value', 'ComponentFormat')} else Value end as ValueList
from (select *, row_number() over (partition by DynamicID, ComponentFormat order by FirstLine) as r from {_FORMAT_TABLE})
join (select NewTemplate, arg_min(EventTemplate, LineId) as EventTemplate from ext group by NewTemplate) o on o.NewTemplate = Template
where r = 1""", extra=GROUP_PROPOSAL))
def format_label_sheet(spark, sf):
    extracted = _extracted(spark, sf).select("LineId", "EventTemplate", "NewTemplate", "ParameterList")
    extracted = stage(extracted, "structured")
    sheet = labels.format_label_sheet(extracted, induce.stage_format_rows(_format_rows(spark, sf, extracted)))
    return sheet.withColumn("ParameterIndex", F.col("ParameterIndex").cast("long")).withColumn("ValueList", _text("ValueList"))


def _annotators(spark, sf):
    return fx.annotations(spark, sf, "a"), fx.annotations(spark, sf, "b")


@query(sql("""
select count(*) filter (type_a is not null or type_b is not null) as n_total,
  count(*) filter (type_a is distinct from type_b) as n_inconsistent,
  cast(count(*) filter (type_a is not null or type_b is not null) - count(*) filter (type_a is distinct from type_b) as double)
    / count(*) filter (type_a is not null or type_b is not null) * 100 as percent from annotations"""))
def annotator_agreement(spark, sf):
    return labels.agreement(*_annotators(spark, sf))


@query(sql("select row_id, type_a, type_b from annotations where type_a is distinct from type_b"))
def annotator_disagreements(spark, sf):
    return labels.disagreements(*_annotators(spark, sf))


_SET_FORMATS = sql(f"""
select DynamicID, Template, cast(ParameterIndex as bigint) as ParameterIndex, TokenFormat, Token, ComponentFormat, Value, ValueType, GroupID
from {_FORMAT_TABLE}""", extra=GROUP_PROPOSAL)


# Two sets that share their templates and, by chance, line numbers' order; one has markers, the other prefixes.
@query(f"""
select 'Spark' as dataset, * from ({one_set(_SET_FORMATS, "LineId % 3 > 0", markers=False, prefixes=True)})
union all select 'BGL' as dataset, * from ({one_set(_SET_FORMATS, "LineId % 3 = 0", markers=True, prefixes=False)})""")
def log_set_formats(spark, sf):
    lines = fx.parsed_logs(spark, sf).withColumn("dataset", F.when(F.col("LineId") % 3 > 0, "Spark").otherwise("BGL"))
    return run(lines, by="dataset")["formats"].select(
        "dataset", "DynamicID", "Template", F.col("ParameterIndex").cast("long"), "TokenFormat", "Token", "ComponentFormat", "Value",
        "ValueType", "GroupID",
    )


# ---- whole job ----------------------------------------------------------------------


@query(sql(f"""
select Template, ValueType, count(distinct DynamicID) as n_variables, count(distinct GroupID) as n_groups, count(*) as n_values,
  count(distinct ComponentFormat) as n_formats from {_FORMAT_TABLE} group by Template, ValueType""", extra=GROUP_PROPOSAL))
def full_run(spark, sf):
    result = run(fx.parsed_logs(spark, sf), "Spark", markers=MARKERS)
    return result["formats"].groupBy("Template", "ValueType").agg(
        F.count_distinct("DynamicID").alias("n_variables"), F.count_distinct("GroupID").alias("n_groups"),
        F.count(F.lit(1)).alias("n_values"), F.count_distinct("ComponentFormat").alias("n_formats"),
    )


@query(_ITEMS)
def full_run_records(spark, sf):
    """The whole job down to the records of lines."""
    return _items(run(fx.parsed_logs(spark, sf), "Spark", until="analysis", markers=MARKERS)["analysis"])
