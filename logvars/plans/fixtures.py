"""Test logs derived from the given tables, by one SQL text for Spark and for checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Line numbers are hashes of a row's key: unique, the same in both engines, and made
# without sorting the table.
SPARK_LINE_ID = "coalesce(cast(conv(substring(md5(line_key), 1, 15), 16, 10) as bigint), 0)"
CHECK_LINE_ID = "cast('0x' || substring(md5(line_key), 1, 15) as bigint)"

_RAW = """
  select
    concat_ws('|', 'l', cast(l_orderkey as varchar(20)), cast(l_linenumber as varchar(20)), cast(l_partkey as varchar(20)),
      cast(l_suppkey as varchar(20)), cast(cast(l_shipdate as date) as varchar(20)),
      cast(cast(l_quantity as decimal(18,1)) as varchar(20)), cast(cast(l_extendedprice as decimal(18,2)) as varchar(30))) as line_key,
    case when l_linenumber % 3 = 0 then 'E2' else 'E1' end as EventId,
    case when l_linenumber % 3 = 0
      then concat('Running task ', cast(l_linenumber as varchar(20)), '.0 in stage ', cast(l_suppkey as varchar(20)), '.0 (TID ', cast(l_orderkey as varchar(20)), ')')
      else concat(case when l_returnflag = 'R' then 'Removed' else 'Added' end, ' broadcast_', cast(l_orderkey as varchar(20)), '_piece', cast(l_linenumber as varchar(20)),
        ' in memory on 10.', cast(l_suppkey % 256 as varchar(20)), '.', cast(l_partkey % 256 as varchar(20)), '.', cast(l_linenumber as varchar(20)), ':', cast(40000 + l_orderkey % 1000 as varchar(20)),
        ' (size: ', cast(cast(l_quantity as decimal(18,1)) as varchar(20)), case when l_partkey % 2 = 0 then ' KB, free: ' else ' MB, free: ' end, cast(cast(l_extendedprice as decimal(18,2)) as varchar(30)), ' MB)')
    end as Content
  from {lineitem}
  union all
  select concat_ws('|', 'e', cast(event_id as varchar(20))) as line_key,
    case event_type when 'view' then 'E3' when 'click' then 'E4' when 'error' then 'E5' when 'signup' then 'E6' else 'E7' end as EventId,
    case event_type
      when 'view' then concat('reading file:/var/log/app_', cast(user_id as varchar(20)), '/part-', cast(event_id % 100 as varchar(20)), '.log status ', case when event_id % 2 = 0 then 'FETCH_OK' else 'FETCH_FAIL' end)
      when 'click' then concat('GET url=http://h', cast(user_id as varchar(20)), '.example.org/p/', cast(event_id as varchar(20)), ' session_', cast(user_id as varchar(20)))
      when 'error' then concat('core', cast(user_id as varchar(20)), ' machine check ', case when event_id % 4 = 0 then 'retry twice ' when event_id % 4 = 1 then 'retry  ' else 'retry ' end, 'addr 0x', substring(md5(cast(event_id as varchar(20))), 1, 8))
      when 'signup' then concat('probe ', case when event_id % 2 = 0 then 'wait' else 'hold' end, '....', cast(event_id % 10 as varchar(20)), ' X- owner=', cast(user_id as varchar(20)))
      else concat('proxy peer', cast(user_id as varchar(20)), '.example.org:', cast(8000 + user_id % 10 as varchar(20)), ' closed session_', cast(user_id as varchar(20)))
    end as Content
  from {events}
"""

_LOGS = """
select {line_id} as LineId, Content, EventId,
  case EventId
    when 'E1' then '<*> <*> in memory on <*> (size: <*> <*> free: <*> <*>'
    when 'E2' then 'Running task <*> in stage <*> (TID <*>)'
    when 'E3' then 'reading <*> status <*>'
    when 'E4' then 'GET url=<*> session_<*>'
    when 'E5' then '<*> machine check retry addr 0x<*>'
    when 'E6' then 'probe <*> <*> owner=<*>'
    else 'proxy <*>:<*> closed session_<*>' end as EventTemplate
from ({raw}) raw
"""

_LOGS_B = """
select LineId, Content, EventId,
  case when EventId = 'E1' then '<*> broadcast_<*> in memory on <*>:<*> (size: <*> <*> free: <*> <*>'
       when EventId = 'E2' and LineId % 2 = 0 then 'Running task <*> in stage <*> <*>'
       else EventTemplate end as EventTemplate
from {parsed_logs}
"""

_REGEX_LOGS = """
select LineId, Content,
  concat(replace(replace(replace(replace(EventTemplate, '(', concat(chr(92), '(')), ')', concat(chr(92), ')')), ':', concat(chr(92), ':')), '<*>', '(.*?)'), '$') as RegexTemplate
from {parsed_logs}
"""

_CONTAIN = """
select distinct 0 as DynamicID, concat('session_', cast(user_id as varchar(20)), 's') as value from {events}
union all select distinct 1, concat('user:session_', cast(user_id as varchar(20)), 's/open') from {events}
union all select distinct 2, concat('h', cast(user_id as varchar(20)), 'n') from {events}
union all select distinct 3, concat('h', cast(user_id as varchar(20)), 'n.example') from {events}
union all select distinct 4, concat('xh', cast(user_id as varchar(20)), 'n') from {events}
union all select distinct 5, cast(user_id as varchar(20)) from {events}
"""

_ANNOTATIONS = """
select doc_id as row_id,
  case when doc_id % 11 = 0 then null when quality = 1 then 'Value' else 'Identifier' end as type_a,
  case when doc_id % 11 = 0 and doc_id % 2 = 0 then null when toxic = 1 then 'Path' when quality = 1 then 'Value' else 'Identifier' end as type_b
from {labels}
"""

# The two sheets do not hold the same rows.
_IN_SHEET = {"a": "row_id % 13 <> 1", "b": "row_id % 7 <> 2"}

FORMATS = """
select * from (values ('session', '<D>'), ('session', 'session_<D>'), ('block', 'broadcast_<D>_piece<D>'), ('block', 'broadcast_<D>'),
  ('block', 'rdd_<D>'), ('peer', '<D>:<D>'), ('peer', '<D>.example.org:<D>'), ('peer', '<D> <D>'),
  ('rest', 'file:/var/log/app_<D>/part-<D>.log'), ('rest', '<D>.0'), ('rest', 'core<D>')) as t(GroupKey, Format)
"""


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parsed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _RAW.format(lineitem="{lineitem}", events="{events}")
    text = _LOGS.replace("{raw}", raw).replace("{line_id}", SPARK_LINE_ID)
    return spark.sql(text, lineitem=scan(spark, sf_dir, "lineitem"), events=scan(spark, sf_dir, "events"))


def parsed_logs_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LOGS_B, parsed_logs=parsed_logs(spark, sf_dir))


def regex_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_REGEX_LOGS, parsed_logs=parsed_logs(spark, sf_dir))


def contain_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CONTAIN, events=scan(spark, sf_dir, "events"))


def annotations(spark: SparkSession, sf_dir: str, sheet: str) -> DataFrame:
    """(row_id, Type) of annotator a or b."""
    rows = spark.sql(_ANNOTATIONS, labels=scan(spark, sf_dir, "labels")).where(_IN_SHEET[sheet])
    return rows.selectExpr("row_id", f"type_{sheet} as Type")


def formats_fixed(spark: SparkSession) -> DataFrame:
    return spark.sql(FORMATS)


CHECK_TABLES = {
    "parsed_logs": _LOGS.replace("{raw}", _RAW.format(lineitem="lineitem", events="events")).replace("{line_id}", CHECK_LINE_ID),
    "parsed_logs_b": _LOGS_B.format(parsed_logs="parsed_logs"),
    "regex_logs": _REGEX_LOGS.format(parsed_logs="parsed_logs"),
    "contain_values": _CONTAIN.format(events="events"),
    "annotations": f"""
select coalesce(a.row_id, b.row_id) as row_id, a.type_a, b.type_b
from (select * from ({_ANNOTATIONS.format(labels="labels")}) where {_IN_SHEET["a"]}) a
full join (select * from ({_ANNOTATIONS.format(labels="labels")}) where {_IN_SHEET["b"]}) b on a.row_id is not distinct from b.row_id
""",
    "formats_fixed": FORMATS,
}
