"""SQL texts that compute the registered queries independently, for comparison."""

from __future__ import annotations

from .fixtures import CHECK_TABLES

# The tests below say by splitting, trimming and counting what the library says by patterns.
# The markers of the set BGL.
_MARKERS = "('X-', 'X+', 'Y-', 'Y+', 'Z-', 'Z+', 'x+', 'x-', 'y+', 'y-', 'z+', 'z-')"
_DIGIT, _HEX, _UPPER = "0123456789", "0123456789abcdefABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = _UPPER + _UPPER.lower() + _DIGIT + "_"
# Fixed set of marks that are stripped, as a character class.
MARKS = r"[,.:;)(\[\]{}'/" + '"' + r"<>]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _only(v: str, letters: str) -> str:
    """Not empty, and of these characters only."""
    return f"({v} <> '' and translate({v}, {_q(letters)}, '') = '')"


def _every(pieces: str, test: str) -> str:
    return f"list_bool_and([{test} for piece in {pieces}])"


def _grouped_digits(v: str) -> str:
    return _every(f"string_split({v}, '_')", _only("piece", _DIGIT))


def _unsigned(v: str) -> str:
    return f"(case when left({v}, 1) in ('+', '-') then substring({v}, 2) else {v} end)"


def plain_number(v: str) -> str:
    """A decimal number with an exponent, nan, inf, infinity, or a hexadecimal number."""
    bare = f"lower(trim({v}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
    body = _unsigned("n")
    parts = f"string_split({body}, 'e')"
    mantissa = f"string_split({parts}[1], '.')"
    whole, fraction = f"{mantissa}[1]", f"coalesce({mantissa}[2], '')"
    digits = (
        f"(len({mantissa}) <= 2 and ({whole} <> '' or {fraction} <> '')"
        f" and ({whole} = '' or {_grouped_digits(whole)}) and ({fraction} = '' or {_grouped_digits(fraction)}))"
    )
    exponent = f"(len({parts}) = 1 or len({parts}) = 2 and {_grouped_digits(_unsigned(f'{parts}[2]'))})"
    decimal = f"({body} in ('nan', 'inf', 'infinity') or {digits} and {exponent})"
    hexadecimal = f"(lower(left({_unsigned(v)}, 2)) = '0x' and {_only(f'substring({_unsigned(v)}, 3)', _HEX)})"
    return f"([{decimal} for n in [{bare}]][1] or {hexadecimal})"


def number(v: str) -> str:
    return f"coalesce({plain_number(v)} or {v} in {_MARKERS}, false)"


def host_port(v: str) -> str:
    """Two or more labels of letters, digits and hyphens, a colon, digits."""
    labels = f"string_split(string_split({v}, ':')[1], '.')"
    label = _only("piece", _UPPER + _UPPER.lower() + _DIGIT + "-")
    return f"(len(string_split({v}, ':')) = 2 and {_only(f'string_split({v}, chr(58))[2]', _DIGIT)} and len({labels}) >= 2 and {_every(labels, label)})"


def path(v: str) -> str:
    """A drive, or two slashes, or two pairs of backslashes."""
    pair = "chr(92) || chr(92)"
    drive = f"({_only(f'left({v}, 1)', _UPPER + _UPPER.lower())} and substring({v}, 2, 1) = ':' and substring({v}, 3, 1) in ('/', chr(92)))"
    pairs = f"(contains({v}, {pair}) and contains(substring({v}, strpos({v}, {pair}) + 2), {pair}))"
    return f"({drive} or length({v}) - length(replace({v}, '/', '')) >= 2 or {pairs})"


def macro(v: str) -> str:
    return _every(f"string_split({v}, '_')", _only("piece", _UPPER))


def dot_suffix(v: str) -> str:
    """A word, perhaps in brackets, three or more dots, digits."""
    pieces = f"string_split({v}, '.')"
    word = f"(case when left({pieces}[1], 1) = '(' then substring({pieces}[1], 2) else {pieces}[1] end)"
    bare = f"(case when right({word}, 1) = ')' then left({word}, -1) else {word} end)"
    return (
        f"(len({pieces}) >= 4 and {_only(bare, _UPPER + _UPPER.lower())} and {_only(f'{pieces}[-1]', _DIGIT)}"
        f" and array_to_string({pieces}[2:-2], '') = '')"
    )


def dot_head(v: str) -> str:
    return f"left({v}, length(rtrim({v}, {_q(_DIGIT)})))"


def dot_tail(v: str) -> str:
    return f"substring({v}, length(rtrim({v}, {_q(_DIGIT)})) + 1)"


def _run(v: str, letters: str) -> str:
    """The characters of ``letters`` that end a text."""
    return f"substring({v}, length(rtrim({v}, {_q(letters)})) + 1)"


def tail_ip(v: str) -> str:
    pieces = f"string_split({v}, '.')"
    first = _run(f"{pieces}[-4]", _DIGIT)
    before = f"right(rtrim({pieces}[-4], {_q(_DIGIT)}), 1)"
    short = " and ".join(f"{_only(x, _DIGIT)} and length({x}) <= 3" for x in (first, f"{pieces}[-3]", f"{pieces}[-2]", f"{pieces}[-1]"))
    edge = f"({before} = '' or translate({before}, {_q(_WORD)}, '') <> '')"
    return f"(case when len({pieces}) >= 4 and {short} and {edge} then {first} || '.' || array_to_string({pieces}[-3:], '.') else '' end)"


def tail_hex(v: str) -> str:
    run = _run(v, _HEX)
    before = f"rtrim({v}, {_q(_HEX)})"
    return f"(case when {run} <> '' and right({before}, 2) = '0x' then '0x' || {run} when length({run}) >= 8 then {run} else '' end)"


def tail_eq(v: str) -> str:
    return f"(case when {_run(v, _DIGIT)} <> '' and right(rtrim({v}, {_q(_DIGIT)}), 1) = '=' then {_run(v, _DIGIT)} else '' end)"


# Named tables in the order in which they may refer to each other.
TABLES: dict[str, str] = dict(CHECK_TABLES)
TABLES |= {
    "ext": """
select LineId, EventId, EventTemplate, Content, array_to_string(f, ' ') as NewTemplate,
  list_filter(c, lambda x, i: f[i] = '<*>') as params
from (
  select *, case when len(c) = len(t) then t else list_reduce(c,
      lambda s, x: struct_pack(k := case when x = a[s.k + 1] then s.k + 1 else s.k end,
        o := list_append(s.o, case when x = a[s.k + 1] then x when x = '' then '' else '<*>' end)),
      {'k': 0, 'o': []::varchar[]}).o end as f
  from (select *, list_filter(t, lambda x: x <> '<*>') as a from (
    select *, string_split(Content, ' ') as c,
      list_transform(string_split(EventTemplate, ' '), lambda x: case when contains(x, '<*>') then '<*>' else x end) as t
    from parsed_logs where contains(EventTemplate, '<*>'))))""",
    "params": """
select LineId, EventId, NewTemplate, unnest(generate_series(0, len(params) - 1)) as pos, unnest(params) as value
from ext where len(params) > 0""",
    "vals": """
select NewTemplate, pos, value, min(LineId) as first_line from params group by NewTemplate, pos, value""",
    "firsts": """
select NewTemplate, pos, min(first_line) as template_line, arg_min(value, first_line) as v from vals group by NewTemplate, pos""",
    "marks": f"""
select NewTemplate, pos, template_line, v,
  case when a = length(v) then length(v) // 2 else a end as b,
  case when a = length(v) then length(v) - length(v) // 2 else z end as e
from (select *, length(regexp_extract(v, {_q('^' + MARKS + '*')})) as a, length(regexp_extract(v, {_q(MARKS + '*$')})) as z from firsts)""",
    "stripped": """
select vals.*, template_line, b, e, substring(v, 1, b) || '<C>' || substring(v, length(v) - e + 1, e) as marks,
  substring(value, b + 1, greatest(length(value) - b - e, 0)) as s
from vals join marks using (NewTemplate, pos)""",
    "tails": f"""
select *, {tail_ip('s')} as ip, {tail_hex('s')} as hx,
  {tail_eq('s')} as eq from stripped""",
    "affix": f"""
select NewTemplate, pos, template_line, min(marks) as marks,
  case when bool_and({number('value')}) then 'raw'
    when bool_and(starts_with(s, 'url=')) then 'url'
    when bool_and(ip <> '') and count(distinct left(s, length(s) - length(ip))) = 1 then 'ip'
    when bool_and(hx <> '') and count(distinct left(s, length(s) - length(hx))) = 1 then 'hex'
    when bool_and(eq <> '') and count(distinct left(s, length(s) - length(eq))) = 1 then 'eq'
    else 'none' end as affix,
  min(left(s, length(s) - length(ip))) as p_ip, min(left(s, length(s) - length(hx))) as p_hx, min(left(s, length(s) - length(eq))) as p_eq
from tails group by NewTemplate, pos, template_line""",
    "formatted": """
select NewTemplate, pos, template_line, affix, case affix when 'raw' then '<C>' when 'none' then marks
  else replace(marks, '<C>', case affix when 'url' then 'url=' when 'ip' then p_ip when 'hex' then p_hx else p_eq end || '<C>') end as TokenFormat
from affix""",
    "normal": """
select t.NewTemplate, t.pos, t.template_line, f.affix, f.TokenFormat, t.value as token, t.first_line,
  case f.affix when 'raw' then t.value when 'url' then substring(s, 5) when 'ip' then ip when 'hex' then hx when 'eq' then eq else s end as v
from tails t join formatted f using (NewTemplate, pos)""",
    "typed": f"""
select NewTemplate, pos, template_line, affix, TokenFormat,
  affix <> 'raw' and bool_and({dot_suffix('v')}) as is_dot,
  case when affix = 'raw' or bool_and({dot_suffix('v')}) or bool_and({number('v')}) then 'Value'
    when bool_and(lower(v) in ('kb', 'mb', 'gb', 'ms')) then 'Unit'
    when bool_and({host_port('v')}) then 'Identifier'
    when bool_and({path('v')}) then 'Path'
    when bool_and({macro('v')}) then 'Macro'
    when contains(TokenFormat, 'url=') then 'Path' else 'Undecided' end as ValueType
from normal group by NewTemplate, pos, template_line, affix, TokenFormat""",
    "named": f"""
select n.NewTemplate, n.pos, n.template_line, n.TokenFormat, y.ValueType, n.token, n.first_line,
  case when is_dot then {dot_head('v')} || '<D>'
    when ValueType = 'Identifier' then '<D>:<D>' else '<D>' end as ComponentFormat,
  case when is_dot then {dot_tail('v')} else v end as value
from normal n join typed y using (NewTemplate, pos)""",
    "variables": """
select row_number() over (order by template_line, pos, min(first_line), ComponentFormat) - 1 as DynamicID,
  NewTemplate, pos, TokenFormat, ComponentFormat, ValueType, count(*) as n_values, min(first_line) as format_line
from named group by NewTemplate, pos, template_line, TokenFormat, ComponentFormat, ValueType""",
    "numbered": """
select DynamicID, ValueType, token, value, first_line
from named join (select DynamicID, NewTemplate, pos, ComponentFormat from variables) using (NewTemplate, pos, ComponentFormat)""",
    "edges": """
select distinct a.DynamicID as s, b.DynamicID as d from numbered a join numbered b using (value)
where a.ValueType not in ('Value', 'Unit') and b.ValueType not in ('Value', 'Unit')""",
    "reach": """
select DynamicID as id, DynamicID as r from variables union select id, d from reach join edges on r = s""",
    "same_groups": """
select id as DynamicID, dense_rank() over (order by root) as GroupID from (select id, min(r) as root from reach group by id)""",
    "grouped": """
select variables.*, GroupID from variables join same_groups using (DynamicID)""",
    "members": """
select GroupID, n.* from numbered n join same_groups using (DynamicID)""",
    "merged": """
select GroupID, value, min(first_line) as first_line from members
where GroupID in (select GroupID from members where ValueType = 'Undecided') group by GroupID, value""",
    "placed": """
select *, case when starts_with(value, 'rdd_') then 'rdd_' when starts_with(value, 'broadcast_') then 'broadcast_'
  when starts_with(value, 'mesos-slave-') then 'mesos-slave-' when starts_with(value, 'mesos-master-') then 'mesos-master-'
  else '(other)' end as b0 from merged""",
    "buckets": """
select GroupID, value, first_line, case when split then b0 else '(all)' end as bucket, used or not split as used from (
  select *, bool_or(used) over (partition by GroupID) as split from (
    select *, count(*) over (partition by GroupID, b0) >= 2 as used from placed))""",
}

_DIGITS = r"regexp_replace(%s, '\d+', '<D>', 'g')"


def _proposal(source: str, keys: str) -> dict[str, str]:
    """Tables shaped / agreed / proposed over ``source`` (keys, value)."""
    whole = " or ".join(
        f"regexp_matches(value, {_q(rx)})"
        for rx in [r"<D|D>", r"^[A-Za-z][A-Za-z0-9+.-]*://", r"^[A-Za-z0-9_$-]+(?:\.[A-Za-z0-9_$-]+)+$",
                   r"^[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5,}$"]
    ) + " or " + path("value")
    return {
        "shaped": f"""
select *, case when {host_port('value')} then 'joined' when {whole} or value = '' then 'whole'
  when regexp_matches(value, '[@:=$#]') then 'joined' else 'parts' end as kind,
  regexp_replace(value, '[^_-]+', '', 'g') as shape from {source}""",
        "segments": f"""
select {keys}, shape, unnest(generate_series(1, length(shape) + 1)) as i,
  unnest(string_split({_DIGITS.replace('%s', "replace(value, '-', '_')")}, '_')) as seg
from shaped where kind = 'parts'""",
        "agreed": f"""
select {keys}, shape, i, case when count(distinct seg) = 1 then min(seg) else '<D>' end as piece
from segments group by {keys}, shape, i""",
        "shape_formats": f"""
select {keys}, shape, string_agg(piece || coalesce(substring(shape, cast(i as integer), 1), ''), '' order by i) as fmt
from agreed group by {keys}, shape""",
        "proposed": f"""
select s.*, case kind when 'whole' then '<D>' when 'joined' then regexp_replace(value, '[^@:=$#]+', '<D>', 'g') else fmt end as Format
from shaped s left join shape_formats f on kind = 'parts' and s.shape = f.shape and """
        + " and ".join(f"s.{k} = f.{k}" for k in keys.split(", ")),
    }


def format_regex(fmt: str) -> str:
    """SQL text of the anchored pattern of a format column."""
    return rf"'^' || replace(regexp_replace({fmt}, '([^A-Za-z0-9_ <>])', '\\\1', 'g'), '<D>', '(.*)') || '$'"


def sql(body: str, *tables: str, extra: dict[str, str] | None = None) -> str:
    """``body`` over the named tables and all tables these need."""
    pool = {**TABLES, **(extra or {})}
    order = list(pool)
    need: list[str] = []

    def add(name: str) -> None:
        if name in need:
            return
        words = set(_words(pool[name]))
        for other in order[: order.index(name)]:
            if other in words:
                add(other)
        need.append(name)

    for word in order:
        if word in set(_words(body)) or word in tables:
            add(word)
    need.sort(key=order.index)
    return "with recursive " + ",\n".join(f"{n} as ({pool[n]})" for n in need) + "\n" + body if need else body


def one_set(text: str, lines: str, markers: bool, prefixes: bool) -> str:
    """``text`` over the lines of one log set only, with its own settings."""
    known, own = f"parsed_logs as ({TABLES['parsed_logs']})", f"parsed_logs as (select * from ({TABLES['parsed_logs']}) where {lines})"
    assert text.count(known) == 1
    text = text.replace(known, own)
    if not markers:
        text = text.replace(f"in {_MARKERS}", "in ('')")
    return text if prefixes else text.replace(TABLES["buckets"], "select GroupID, value, first_line, '(all)' as bucket, true as used from merged")


def _words(text: str) -> list[str]:
    return "".join(ch if ch.isalnum() or ch == "_" else " " for ch in text).split()


GROUP_PROPOSAL = _proposal("(select GroupID, bucket, value from buckets where used)", "GroupID, bucket")
VARIABLE_PROPOSAL = _proposal(
    "(select distinct DynamicID, value from numbered where ValueType = 'Undecided')", "DynamicID"
)
