"""DuckDB SQL text for the oracle side of every checked query.

The oracle is deliberately a second formulation (joins where the engine uses
CASE, CASE where it uses arrays, correlated sums where it uses windows), so a
mistake shared by both sides is unlikely. Only fixed values come from
``taxonomy``; nothing here runs in Spark.
"""

from __future__ import annotations

from .. import taxonomy as tx
from ..fixtures import IMAGES_SQL, PAIRS_SQL

PY_WS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}"
         r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def bind(expr: str, var: str, body: str) -> str:
    """Evaluate ``body`` with ``var`` bound to ``expr`` (a one-element list map)."""
    return f"(list_transform([{expr}], lambda {var}: {body}))[1]"


def with_views(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


PAIRS_CTE = f"pairs as ({PAIRS_SQL})"
IMAGES_CTE = f"images as ({IMAGES_SQL})"


def singularize(expr: str) -> str:
    body = ("CASE WHEN w IS NULL THEN NULL "
            "WHEN suffix(w, 'ies') AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' "
            "WHEN suffix(w, 'ses') OR suffix(w, 'xes') OR suffix(w, 'hes') THEN left(w, length(w) - 2) "
            "WHEN suffix(w, 's') AND NOT suffix(w, 'ss') AND length(w) > 3 THEN left(w, length(w) - 1) "
            "ELSE w END")
    return bind(expr, "w", body)


def add_object(x: str) -> str:
    head = (r"(?i)^\s*(?:" + "|".join(tx.ADD_VERBS) + r")\s+(?:" + "|".join(tx.ADD_ARTICLES)
            + r")?\s*(.+)$")
    boundary = r"\b(?:" + "|".join(tx.ADD_BOUNDARY_WORDS) + r")\b[\s\S]*"
    rest = f"nullif(regexp_extract(coalesce({x}, ''), {q(head)}, 1), '')"
    phrase = f"regexp_replace(lower({rest}), {q(boundary)}, '')"
    words = (f"list_filter(string_split_regex({phrase}, '[^a-z]+'), lambda v: v <> '' AND NOT "
             f"list_contains({str_list(tx.NOT_AN_OBJECT)}, v))")
    return singularize(f"({words})[-1]")


def classify_tune(x: str) -> str:
    case = "CASE t " + " ".join(f"WHEN {q(w)} THEN {q(n)}" for w, n in tx.TUNE_WORD_TO_TYPE.items()) + " END"
    words = f"list_reverse(string_split_regex(lower(coalesce({x}, '')), '[^a-z]+'))"
    return f"(list_filter(list_transform({words}, lambda t: {case}), lambda u: u IS NOT NULL))[1]"


def classify_real_case(x: str) -> str:
    """C1 as a CASE (used as the oracle of the rule-table form J3)."""
    parts = []
    for name, needles in tx.REAL_RULES:
        cond = " OR ".join(f"contains(lower({x}), {q(n)})" for n in needles)
        parts.append(f"WHEN {cond} THEN {q(name)}")
    return "CASE " + " ".join(parts) + " END"


NEEDLES_CTE = ("needles(prio, name, needle) as (values "
               + ", ".join(f"({p}, {q(n)}, {q(s)})" for p, n, s in tx.REAL_NEEDLES) + ")")


def classify_edit(et: str, x: str) -> str:
    obj = add_object(x)
    return (f"CASE WHEN {et} = 'add' THEN (CASE WHEN list_contains({str_list(tx.ADD_OBJECTS)}, {obj}) "
            f"THEN 'add_' || {obj} END) "
            f"WHEN {et} = 'tune_transfer' THEN {classify_tune(x)} "
            f"WHEN {et} IN ({', '.join(q(t) for t in tx.WHOLE_TYPES)}) THEN {et} END")


TYPES_CTE = ("types(type_id, name, family) as (values "
             + ", ".join(f"({i}::BIGINT, {q(n)}, {q(f)})" for i, n, f in tx.TYPE_ROWS) + ")")


def quota_cte(name: str, quota: dict) -> str:
    return (f"{name}(edit_type, quota) as (values "
            + ", ".join(f"({q(t)}, {int(n)}::BIGINT)" for t, n in quota.items()) + ")")


def head_v1(x: str, pattern: str) -> str:
    grp = f"nullif(regexp_extract(coalesce({x}, ''), {q('(?i)' + pattern)}, 1), '')"
    return f"(list_filter(string_split_regex(lower({grp}), {q(PY_WS + '+')}), lambda v: v <> ''))[-1]"


def addition_head(x: str) -> str:
    grp = f"nullif(regexp_extract(coalesce({x}, ''), {q('(?i)' + tx.ADDITION_PATTERN)}, 1), '')"
    words = f"list_filter(string_split_regex(lower({grp}), {q(PY_WS + '+')}), lambda v: v <> '')"
    preps = ", ".join(q(p) for p in tx.ADDITION_TRAILING_PREPOSITIONS)
    return bind(words, "ws", f"CASE WHEN ws[-1] IN ({preps}) THEN ws[1] ELSE ws[-1] END")


def looks_like_addition(x: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), {q('(?i)' + tx.ADDITION_PATTERN)})"


def raw_words(x: str) -> str:
    return (f"list_transform(list_filter(string_split_regex(lower({x}), {q(PY_WS + '+')}), "
            f"lambda v: v <> ''), lambda v: trim(v, {q(tx.PROFILE_STRIP_CHARS)}))")


def profile_word(w: str) -> str:
    return f"(length({w}) > 2 AND {w} NOT IN ({', '.join(q(s) for s in tx.PROFILE_STOP_WORDS)}))"


def md5_uniform(seed: str, draw: str, k: str) -> str:
    """Portable uniform in [0, 1): 13 hex digits of md5('seed:draw:k') / 2^52."""
    key = f"md5(cast({seed} as varchar) || ':' || cast({draw} as varchar) || ':' || cast({k} as varchar))"
    return f"(cast(('0x' || substr({key}, 1, 13)) as bigint) / 4503599627370496.0::double)"


def pick_shards_sql(quota: dict, skip: int, smap: str = "smap", name: str = "picked") -> str:
    """R1 oracle as CTEs: correlated running sums over a cut-off shard list."""
    qn = f"{name}_quota"
    cut = (f"(select max(shard) from (select distinct shard from {name}_wanted order by shard "
           f"limit {int(skip)}))") if skip > 0 else "-1"
    enough = (f"(select count(distinct shard) from {name}_wanted) >= {int(skip)}")
    return ",\n".join([
        quota_cte(qn, quota),
        f"{name}_wanted as (select s.shard, s.edit_type, s.n, k.quota from {smap} s "
        f"join {qn} k on s.edit_type = k.edit_type where k.quota > 0)",
        f"{name}_post as (select * from {name}_wanted where shard > {cut} and {enough})",
        f"{name}_all as (select w.shard, w.edit_type, w.n, cast((select coalesce(sum(p.n), 0) "
        f"from {name}_post p where p.edit_type = w.edit_type and p.shard < w.shard) as bigint) "
        f"as taken_before, w.quota from {name}_post w)",
        f"{name} as (select * from {name}_all where taken_before < quota)",
    ])


SMAP_CTE = "smap as (select shard, edit_type, count(*)::BIGINT as n from pairs group by 1, 2)"


def quota_rows_sql(name: str, picked: str, quota_name: str) -> str:
    return (f"{name} as (select * from (select p.*, k.quota, row_number() over (partition by p.edit_type "
            f"order by p.shard, p.row_id)::BIGINT as type_pos from pairs p join {quota_name} k "
            f"on p.edit_type = k.edit_type where p.decodable and p.shard in (select shard from {picked}))"
            f" where type_pos <= quota)")
