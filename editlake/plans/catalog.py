"""The query catalog: every operator of the inventory as a (Spark query,
DuckDB oracle) pair over the driver tables.

Each Spark query takes ``(spark, sf_dir)`` and returns a lazy DataFrame; each
oracle is one SQL string over the pre-registered driver views. Column names
and types agree on both sides (BIGINT, DOUBLE rounded to 6 places, VARCHAR,
BOOLEAN). Queries without an oracle are the non-SQL jobs; they are checked by
row count here and by their own tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import taxonomy as tx
from ..functions import text as T
from ..operators import profile as P
from ..operators import select as S
from ..operators import shards as SH
from . import duck as D

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


W = D.with_views
PAIRS = D.PAIRS_CTE

# Quota plans used by the planning queries (two overlapping prep slices, as
# when two prep runs both start at the first `add` shards, and a skipped one).
PLAN_A = ({"add": 1000, "tune_transfer": 1000}, 0)
PLAN_B = ({"add": 500, "style_change": 500, "background_change": 500, "replace": 400}, 0)
PLAN_SKIP = ({"add": 600, "tune_transfer": 300}, 3)


def _pairs(spark, sf_dir):
    return fx.pairs(spark, sf_dir)


def _plan(spark, sf_dir, plan):
    quota, skip = plan
    smap = SH.shard_type_counts(_pairs(spark, sf_dir))
    return SH.pick_shards(smap, SH.quota_table(spark, quota), skip)


def _slice(spark, sf_dir, plan):
    quota, skip = plan
    picked = _plan(spark, sf_dir, plan)
    return S.quota_rows(_pairs(spark, sf_dir), SH.quota_table(spark, quota),
                        SH.taken_shards(picked))


# ---------------------------------------------------------------- text (2.3)

@register("add_object", W(PAIRS) + f"""
select row_id, instruction, {D.add_object('instruction')} as head from pairs where edit_type = 'add'""")
def q_add_object(spark, sf_dir):
    """C3 + C4 over every add instruction."""
    return (_pairs(spark, sf_dir).where(F.col("edit_type") == "add")
            .select("row_id", "instruction", T.add_object(F.col("instruction")).alias("head")))


@register("singularize", W(PAIRS) + f"""
select word, {D.singularize('word')} as singular from (select distinct unnest(string_split_regex(lower(instruction), '[^a-z]+')) as word from pairs) where word <> ''""")
def q_singularize(spark, sf_dir):
    """C4 over every distinct instruction word."""
    words = (_pairs(spark, sf_dir)
             .select(F.explode(F.split(F.lower("instruction"), "[^a-z]+")).alias("word"))
             .where(F.col("word") != "").distinct())
    return words.select("word", T.singularize(F.col("word")).alias("singular"))


@register("classify_real", W(PAIRS, D.NEEDLES_CTE) + """
select p.row_id, p.caption, arg_min(n.name, n.prio) as type_name
from pairs p left join needles n on contains(lower(p.caption), n.needle)
group by p.row_id, p.caption""")
def q_classify_real(spark, sf_dir):
    """C1 over every caption (CASE form); the oracle joins the needle table."""
    return _pairs(spark, sf_dir).select("row_id", "caption",
                                        T.classify_real(F.col("caption")).alias("type_name"))


@register("rule_join", W(PAIRS) + f"""
select row_id, {D.classify_real_case('caption')} as type_name from pairs""")
def q_rule_join(spark, sf_dir):
    """Rule table lookup (ordered needle array) over every caption."""
    return _pairs(spark, sf_dir).select(
        "row_id", T.classify_real_by_rule_table(F.col("caption")).alias("type_name"))


@register("classify_tune", W(PAIRS) + f"""
select row_id, {D.classify_tune('instruction')} as type_name from pairs where edit_type = 'tune_transfer'""")
def q_classify_tune(spark, sf_dir):
    """C2 over every tune_transfer instruction."""
    return (_pairs(spark, sf_dir).where(F.col("edit_type") == "tune_transfer")
            .select("row_id", T.classify_tune(F.col("instruction")).alias("type_name")))


@register("classify_edit", W(PAIRS, D.TYPES_CTE) + f"""
select c.row_id, c.edit_type, c.type_name, t.type_id from
 (select row_id, edit_type, {D.classify_edit('edit_type', 'instruction')} as type_name from pairs) c
 left join types t on t.name = c.type_name""")
def q_classify_edit(spark, sf_dir):
    """C5 + J2 over the whole corpus: type name and id, null when unnamed."""
    return S.classified(_pairs(spark, sf_dir)).select("row_id", "edit_type", "type_name", "type_id")


@register("type_lookup", W(PAIRS, D.TYPES_CTE) + f"""
select t.type_id, t.name as type_name, t.family, count(c.row_id)::BIGINT as n_rows
from types t left join (select row_id, {D.classify_edit('edit_type', 'instruction')} as type_name from pairs) c
 on c.type_name = t.name group by 1, 2, 3""")
def q_type_lookup(spark, sf_dir):
    """C9 + J2: the type dimension with the corpus rows each type names."""
    named = (S.classified(_pairs(spark, sf_dir)).where(F.col("type_id").isNotNull())
             .groupBy("type_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")))
    dim = tx.type_dimension(spark).select("type_id", F.col("name").alias("type_name"), "family")
    return (dim.join(F.broadcast(named), "type_id", "left")
            .select("type_id", "type_name", "family",
                    F.coalesce(F.col("n_rows"), F.lit(0)).cast("bigint").alias("n_rows")))


@register("head_noun_v1", W(PAIRS) + f"""
select row_id, edit_type, CASE edit_type WHEN 'add' THEN {D.head_v1('instruction', tx.HEAD_V1_ADD_PATTERN)}
 ELSE {D.head_v1('instruction', tx.HEAD_V1_TUNE_PATTERN)} END as head
from pairs where edit_type in ('add', 'tune_transfer')""")
def q_head_noun_v1(spark, sf_dir):
    """C6 over every add and tune_transfer instruction."""
    p = _pairs(spark, sf_dir).where(F.col("edit_type").isin("add", "tune_transfer"))
    head = (F.when(F.col("edit_type") == "add", T.head_noun_v1(F.col("instruction"), "add"))
            .otherwise(T.head_noun_v1(F.col("instruction"), "tune_transfer")))
    return p.select("row_id", "edit_type", head.alias("head"))


@register("addition_head", W(PAIRS) + f"""
select row_id, {D.addition_head('caption')} as head from pairs where {D.looks_like_addition('caption')}""")
def q_addition_head(spark, sf_dir):
    """C7 over every caption that looks like an addition."""
    return P.addition_heads(_pairs(spark, sf_dir))


def _conversations(spark, sf_dir):
    return fx.table(spark, sf_dir, "conversations")


@register("classify_real_documents", f"select doc_id, {D.classify_real_case('text')} as type_name from documents")
def q_classify_real_documents(spark, sf_dir):
    """C1 over every whole document text."""
    return fx.documents(spark, sf_dir).select("doc_id", T.classify_real(F.col("text")).alias("type_name"))


@register("classify_tune_documents", f"select doc_id, {D.classify_tune('text')} as type_name from documents")
def q_classify_tune_documents(spark, sf_dir):
    """C2 over every whole document text."""
    return fx.documents(spark, sf_dir).select("doc_id", T.classify_tune(F.col("text")).alias("type_name"))


@register("add_object_conversations", f"select conv_id, turn, {D.add_object('text')} as head from conversations")
def q_add_object_conversations(spark, sf_dir):
    """C3 + C4 over every conversation turn."""
    return _conversations(spark, sf_dir).select("conv_id", "turn", T.add_object(F.col("text")).alias("head"))


@register("addition_head_conversations", f"select conv_id, turn, {D.addition_head('text')} as head from conversations")
def q_addition_head_conversations(spark, sf_dir):
    """C7 over every conversation turn."""
    return _conversations(spark, sf_dir).select("conv_id", "turn", T.addition_head(F.col("text")).alias("head"))


@register("word_tokens", f"""
select word, count(*)::BIGINT as n from (select unnest({D.raw_words('text')}) as word from documents)
where {D.profile_word('word')} group by word""")
def q_word_tokens(spark, sf_dir):
    """C8 over every whole document text: profile-word counts."""
    return P.word_counts(fx.documents(spark, sf_dir))


@register("null_safe_text", W(PAIRS) + """
select row_id, coalesce(case when row_id % 7 = 3 then null else instruction end, '') as instruction
from pairs""")
def q_null_safe_text(spark, sf_dir):
    """Instructions with missing entries (same rows as the missing types
    sidecar) read back as ''."""
    p = _pairs(spark, sf_dir)
    missing = F.when(F.col("edit_type_nullable").isNull(), F.lit(None).cast("string")).otherwise(
        F.col("instruction"))
    return p.select("row_id", T.null_safe_text(missing).alias("instruction"))


# ------------------------------------------------------------- profiles (2.4)

@register("coverage", W(PAIRS, D.NEEDLES_CTE) + """
select count(*)::BIGINT as total, count(t)::BIGINT as matched, (count(*) - count(t))::BIGINT as unmatched,
 round(100.0 * count(t) / count(*), 6) as pct_matched
from (select p.row_id, arg_min(n.name, n.prio) as t from pairs p
      left join needles n on contains(lower(p.caption), n.needle) group by p.row_id)""")
def q_coverage(spark, sf_dir):
    """A1 over all captions."""
    return P.coverage(_pairs(spark, sf_dir))


@register("type_counts", W(PAIRS) + f"""
select r.rule_order, r.type_name, coalesce(c.n, 0)::BIGINT as n from
 (values {', '.join(f"({i}::BIGINT, {D.q(n)})" for i, n in enumerate(tx.REAL_TYPES))}) r(rule_order, type_name)
 left join (select {D.classify_real_case('caption')} as t, count(*) as n from pairs group by 1) c on c.t = r.type_name""")
def q_type_counts(spark, sf_dir):
    """A2: rows per real type including zeros, in rule order."""
    return P.type_counts(_pairs(spark, sf_dir))


@register("type_counts_total", W(PAIRS) + """
select shard, coalesce(edit_type_nullable, '?') as edit_type, count(*)::BIGINT as n,
 grouping(shard, coalesce(edit_type_nullable, '?'))::BIGINT as level
from pairs group by rollup (shard, coalesce(edit_type_nullable, '?'))""")
def q_type_counts_total(spark, sf_dir):
    """A3 (+ S9 default label '?'): rollup of rows by shard and type."""
    p = _pairs(spark, sf_dir).withColumn("edit_type", F.coalesce("edit_type_nullable", F.lit("?")))
    return P.type_counts_total(p)


_OBJECT_HISTOGRAM = (W(PAIRS) + f"""
select head, n, n >= {tx.OWN_TYPE_THRESHOLD} as own_type from
 (select head, count(*)::BIGINT as n from (select {D.add_object('instruction')} as head from pairs where edit_type = 'add')
  where head is not null group by head) order by n desc, head asc limit 80""")


@register("object_histogram", _OBJECT_HISTOGRAM)
def q_object_histogram(spark, sf_dir):
    """A4: top 80 add-object heads with the own-type flag."""
    return P.object_histogram(_pairs(spark, sf_dir))


@register("object_histogram_sketched", _OBJECT_HISTOGRAM)
def q_object_histogram_sketched(spark, sf_dir):
    """A4 from one frequent-items sketch per shard and an exact recount of the heads they name."""
    from ..operators import sketches as SK
    heads = _pairs(spark, sf_dir).where(F.col("edit_type") == "add").select("shard", T.add_object(F.col("instruction")).alias("head"))
    top = SK.top_heads(heads, "head", 80)
    return top.select("head", "n", (F.col("n") >= tx.OWN_TYPE_THRESHOLD).alias("own_type"))


@register("threshold_winners", W(PAIRS) + f"""
, heads as (select head, count(*)::BIGINT as n from (select {D.add_object('instruction')} as head from pairs where edit_type = 'add')
  where head is not null group by head)
select th::BIGINT as threshold, (select count(*) from heads where n >= th)::BIGINT as n_winners,
 (select coalesce(sum(n), 0) from heads where n >= th)::BIGINT as rows_covered
from (values ({tx.OWN_TYPE_THRESHOLD}), ({tx.TRAINABLE_THRESHOLD})) t(th)""")
def q_threshold_winners(spark, sf_dir):
    """A5 at the two thresholds (1000 own type, 400 trainable)."""
    return P.threshold_winners(_pairs(spark, sf_dir))


@register("threshold_winner_names", W(PAIRS) + f"""
, heads as (select head, count(*)::BIGINT as n from (select {D.add_object('instruction')} as head from pairs where edit_type = 'add')
  where head is not null group by head)
select t.th::BIGINT as threshold, h.head, h.n from heads h join
 (values ({tx.OWN_TYPE_THRESHOLD}), ({tx.TRAINABLE_THRESHOLD}), (50)) t(th) on h.n >= t.th""")
def q_threshold_winner_names(spark, sf_dir):
    """A5 names: every head at or over 1000, 400 and 50 rows, one row each."""
    return P.threshold_winner_names(_pairs(spark, sf_dir), P.THRESHOLDS + (50,))


@register("addition_share", W(PAIRS) + f"""
select count(*)::BIGINT as prompts, count(*) filter (where {D.looks_like_addition('caption')})::BIGINT as additions,
 round(100.0 * count(*) filter (where {D.looks_like_addition('caption')}) / count(*), 6) as pct_additions from pairs""")
def q_addition_share(spark, sf_dir):
    """A6 (share): prompts that look like additions."""
    return P.addition_share(_pairs(spark, sf_dir))


@register("addition_histogram", W(PAIRS) + f"""
select head, n, n >= {tx.TRAINABLE_THRESHOLD} as trainable from
 (select head, count(*)::BIGINT as n from (select {D.addition_head('caption')} as head from pairs where {D.looks_like_addition('caption')})
  where head is not null group by head) order by n desc, head asc limit 50""")
def q_addition_histogram(spark, sf_dir):
    """Top 50 addition heads with the trainable flag."""
    return P.addition_histogram(_pairs(spark, sf_dir))


_UNMATCHED_SQL = """
select word, n from (select word, count(*)::BIGINT as n from
 (select unnest({words}) as word from {src} where ({case}) is null) group by word order by n desc, word asc limit 60)
where word <> '' and {keep}"""


@register("unmatched_words", W(PAIRS) + _UNMATCHED_SQL.format(
    words=D.raw_words("caption"), src="pairs", case=D.classify_real_case("caption"),
    keep=D.profile_word("word")))
def q_unmatched_words(spark, sf_dir):
    """A7 over the captions: top 60 words of unmatched prompts, then filtered."""
    return P.unmatched_words(_pairs(spark, sf_dir))


@register("unmatched_words_documents", _UNMATCHED_SQL.format(
    words=D.raw_words("text"), src="documents", case=D.classify_real_case("text"),
    keep=D.profile_word("word")))
def q_unmatched_words_documents(spark, sf_dir):
    """A7 over every whole document text."""
    return P.unmatched_words(fx.documents(spark, sf_dir), prompt_col="text")


_HEAD_HIST = (W(PAIRS) + f"""
select edit_type, head, n, rank from (select edit_type, head, n,
 row_number() over (partition by edit_type order by n desc, head asc)::BIGINT as rank from
 (select edit_type, head, count(*)::BIGINT as n from
  (select edit_type, CASE edit_type WHEN 'add' THEN {D.head_v1('instruction', tx.HEAD_V1_ADD_PATTERN)}
    ELSE {D.head_v1('instruction', tx.HEAD_V1_TUNE_PATTERN)} END as head
   from pairs where edit_type in ('add', 'tune_transfer')) where head is not null group by 1, 2))
where rank <= 60""")


@register("head_hist_per_type", _HEAD_HIST)
def q_head_hist_per_type(spark, sf_dir):
    """Top 60 earlier-pattern heads per type."""
    return P.head_hist_per_type(_pairs(spark, sf_dir))


@register("head_hist_per_type_sketched", _HEAD_HIST)
def q_head_hist_per_type_sketched(spark, sf_dir):
    """A8 from one frequent-items sketch per shard and type and an exact recount."""
    from ..operators import sketches as SK
    p = _pairs(spark, sf_dir).where(F.col("edit_type").isin("add", "tune_transfer"))
    head = F.when(F.col("edit_type") == "add", T.head_noun_v1(F.col("instruction"), "add")).otherwise(
        T.head_noun_v1(F.col("instruction"), "tune_transfer"))
    return SK.top_heads(p.select("shard", "edit_type", head.alias("head")), "head", 60, groups=["edit_type"])


@register("sample_rows", W(PAIRS) + f"""
select row_id, caption from pairs where ({D.classify_real_case('caption')}) is null order by row_id limit 40""")
def q_sample_rows(spark, sf_dir):
    """The first 40 unmatched captions in corpus order."""
    p = _pairs(spark, sf_dir).where(T.classify_real(F.col("caption")).isNull())
    return P.sample_rows(p.select("row_id", "caption"), 40)


@register("lookup_count", W(PAIRS) + f"""
select 'hat' as head, count(*) filter (where h = 'hat')::BIGINT as n
from (select {D.add_object('instruction')} as h from pairs where edit_type = 'add')""")
def q_lookup_count(spark, sf_dir):
    """The count of one head ('hat'), 0 when absent."""
    return P.lookup_count(P.head_counts(P.add_objects(_pairs(spark, sf_dir))), "hat")


# --------------------------------------------------- shards and slices (2.1-2.2)

@register("build_shard_map", W(PAIRS) + """
select shard, sum(n)::BIGINT as rows, count(*)::BIGINT as n_types,
 '{"rows":' || sum(n)::VARCHAR || ',"types":{' || string_agg('"' || edit_type || '":' || n::VARCHAR, ',' order by edit_type) || '}}' as entry_json
from (select shard, edit_type, count(*) as n from pairs group by 1, 2) group by shard""")
def q_build_shard_map(spark, sf_dir):
    """S3: per-shard JSON entries of the corpus."""
    return SH.build_shard_map(_pairs(spark, sf_dir))


@register("read_shard_map", W(PAIRS, D.SMAP_CTE) + "select shard, edit_type, n from smap")
def q_read_shard_map(spark, sf_dir):
    """Per-shard JSON entries parsed back to (shard, type, n)."""
    return SH.read_shard_map(SH.build_shard_map(_pairs(spark, sf_dir)))


def _pick_sql(plan, name="picked"):
    quota, skip = plan
    return D.pick_shards_sql(quota, skip, name=name)


@register("pick_shards", W(PAIRS, D.SMAP_CTE, _pick_sql(PLAN_A)) + "select * from picked")
def q_pick_shards(spark, sf_dir):
    """Shards (and their useful types) for plan A."""
    return _plan(spark, sf_dir, PLAN_A)


@register("pick_shards_skip", W(PAIRS, D.SMAP_CTE, _pick_sql(PLAN_SKIP)) + "select * from picked")
def q_pick_shards_skip(spark, sf_dir):
    """R1 with skipped useful shards."""
    return _plan(spark, sf_dir, PLAN_SKIP)


@register("projected_rows", W(PAIRS, D.SMAP_CTE, _pick_sql(PLAN_B)) + """
select edit_type, sum(n)::BIGINT as projected, count(*)::BIGINT as n_shards from picked group by 1""")
def q_projected_rows(spark, sf_dir):
    """R1 + R8: projected rows per type of plan B (the walk's totals)."""
    return SH.projected_rows(_plan(spark, sf_dir, PLAN_B))


def _quota_rows_sql(plan, name="taken"):
    return D.quota_rows_sql(name, "picked", "picked_quota")


@register("quota_rows", W(PAIRS, D.SMAP_CTE, _pick_sql(PLAN_A), _quota_rows_sql(PLAN_A)) + """
select row_id, shard, edit_type, type_pos, quota from taken""")
def q_quota_rows(spark, sf_dir):
    """R2 (+ J5): the first quota decodable rows per type from the picked shards."""
    return _slice(spark, sf_dir, PLAN_A).select("row_id", "shard", "edit_type", "type_pos", "quota")


@register("shard_semi_join", W(PAIRS, D.SMAP_CTE, _pick_sql(PLAN_B)) + """
select row_id, shard, edit_type from pairs where shard in (select shard from picked)""")
def q_shard_semi_join(spark, sf_dir):
    """Every row of the shards picked by plan B."""
    p = _pairs(spark, sf_dir)
    return SH.shard_semi_join(p, SH.taken_shards(_plan(spark, sf_dir, PLAN_B))).select(
        "row_id", "shard", "edit_type")


@register("counts_progress", W(PAIRS, D.SMAP_CTE, _pick_sql(PLAN_A), _quota_rows_sql(PLAN_A)) + """
select shard, edit_type, n, sum(n) over (partition by edit_type order by shard rows between unbounded preceding and current row)::BIGINT as running
from (select shard, edit_type, count(*)::BIGINT as n from taken group by 1, 2)""")
def q_counts_progress(spark, sf_dir):
    """Running per-type totals of plan A's taken rows, shard by shard."""
    return SH.counts_progress(_slice(spark, sf_dir, PLAN_A))


@register("wanted_not_consumed", W(PAIRS, D.SMAP_CTE, _pick_sql(PLAN_A),
                                   D.quota_cte("next_quota", PLAN_B[0])) + """
select s.shard, s.edit_type, s.n from smap s join next_quota k on s.edit_type = k.edit_type
where s.shard not in (select shard from picked)""")
def q_wanted_not_consumed(spark, sf_dir):
    """Plan B's wanted stock left after plan A consumed its shards."""
    smap = SH.shard_type_counts(_pairs(spark, sf_dir))
    return SH.remaining_stock(smap, SH.quota_table(spark, PLAN_B[0]), _plan(spark, sf_dir, PLAN_A))


@register("slice_rows", W(PAIRS) + """
select row_id, shard, edit_type, (row_id // 4000)::BIGINT as k from pairs where decodable""")
def q_slice_rows(spark, sf_dir):
    """Every row with its 4000-row slice index, bad rows dropped after the cut."""
    return S.slice_index(_pairs(spark, sf_dir), 4000).select("row_id", "shard", "edit_type", "k")


@register("split_train_val", W(PAIRS) + """
select row_id, shard, shard_rows, case when shard_pos - 1 < shard_rows - least(30, shard_rows // 10) then 'train' else 'val' end as split
from (select row_id, shard, row_number() over (partition by shard order by row_id)::BIGINT as shard_pos,
 count(*) over (partition by shard)::BIGINT as shard_rows from pairs)""")
def q_split_train_val(spark, sf_dir):
    """Per-shard train/val split with val_n = least(30, n div 10)."""
    return S.split_train_val(_pairs(spark, sf_dir), 30).select("row_id", "shard", "shard_rows", "split")


_SPLIT_SQL = ("split as (select *, case when row_number() over (partition by shard order by row_id) - 1 < "
              "count(*) over (partition by shard) - least(30, count(*) over (partition by shard) // 10) "
              "then 'train' else 'val' end as split from pairs)")


@register("drop_unnamed", W(PAIRS) + f"""
select row_id, type_name from (select row_id, {D.classify_edit('edit_type', 'instruction')} as type_name from pairs)
where type_name is not null""")
def q_drop_unnamed(spark, sf_dir):
    """Only rows the taxonomy names."""
    return S.drop_unnamed(S.classified(_pairs(spark, sf_dir))).select("row_id", "type_name")


@register("min_support", W(PAIRS, _SPLIT_SQL) + f"""
, named as (select row_id, split, {D.classify_edit('edit_type', 'instruction')} as type_name from split)
select row_id, split, type_name from named where type_name is not null and (split, type_name) in
 (select split, type_name from named where type_name is not null group by 1, 2 having count(*) >= 50)""")
def q_min_support(spark, sf_dir):
    """Types with at least 50 rows, counted per split."""
    named = S.drop_unnamed(S.classified(S.split_train_val(_pairs(spark, sf_dir), 30)))
    return S.min_support(named).select("row_id", "split", "type_name")


# ----------------------------------------------------- joins and set ops (2.5-2.6)

_TWO_SLICES = (W(PAIRS, D.SMAP_CTE, _pick_sql(PLAN_A, "pa"), _pick_sql(PLAN_B, "pb"),
                 D.quota_rows_sql("sa", "pa", "pa_quota"), D.quota_rows_sql("sb", "pb", "pb_quota")))


@register("overlap_anti", _TWO_SLICES + "select row_id, edit_type from sa where row_id not in (select row_id from sb)")
def q_overlap_anti(spark, sf_dir):
    """Rows of slice A that slice B does not hold."""
    return S.overlap_anti(_slice(spark, sf_dir, PLAN_A), _slice(spark, sf_dir, PLAN_B)).select(
        "row_id", "edit_type")


@register("shard_union", _TWO_SLICES + """
select row_id, shard, edit_type, 'a' as slice from sa union all select row_id, shard, edit_type, 'b' from sb""")
def q_shard_union(spark, sf_dir):
    """Two prep slices concatenated, tagged by slice."""
    cols = ["row_id", "shard", "edit_type"]
    return S.slice_union({"a": _slice(spark, sf_dir, PLAN_A).select(*cols),
                          "b": _slice(spark, sf_dir, PLAN_B).select(*cols)})


@register("slice_overlap", _TWO_SLICES + """
select (select count(*) from sa)::BIGINT as rows_a, (select count(*) from sb)::BIGINT as rows_b,
 (select count(distinct instruction) from sa)::BIGINT as distinct_a, (select count(distinct instruction) from sb)::BIGINT as distinct_b,
 (select count(*) from (select instruction from sa intersect select instruction from sb))::BIGINT as shared,
 round((select count(*) from (select instruction from sa intersect select instruction from sb)) /
  least((select count(distinct instruction) from sa), (select count(distinct instruction) from sb)), 6) as share_of_smaller,
 ((select count(*) from sa) + (select count(*) from sb))::BIGINT as total_rows,
 (select count(*) from (select row_id from sa union select row_id from sb))::BIGINT as unique_rows""")
def q_slice_overlap(spark, sf_dir):
    """Shared instructions of two overlapping prep slices."""
    return S.slice_overlap(_slice(spark, sf_dir, PLAN_A), _slice(spark, sf_dir, PLAN_B))


@register("slice_overlap_sketched", _TWO_SLICES + """
, a as (select distinct instruction from sa), b as (select distinct instruction from sb), s as (select * from a intersect select * from b)
select 'a' as slice_a, 'b' as slice_b, (select count(*) from a)::BIGINT as distinct_a, (select count(*) from b)::BIGINT as distinct_b,
 (select count(*) from s)::BIGINT as shared, round((select count(*) from s) / least((select count(*) from a), (select count(*) from b)), 6) as share_of_smaller,
 0.0::DOUBLE as shared_error, (select count(*) from s)::BIGINT as exact_shared""")
def q_slice_overlap_sketched(spark, sf_dir):
    """U2 from stored theta sketches of two slices, beside the exact count
    (below 2^14 distinct values a sketch is exact)."""
    from ..operators import sketches as SK
    from .catalog_more import _scratch
    slices = {"a": _slice(spark, sf_dir, PLAN_A), "b": _slice(spark, sf_dir, PLAN_B)}
    folder = _scratch(spark, "sketches")
    for name, df in slices.items():  # each slice's sketch is stored when the slice is made
        SK.store_sketches(SK.slice_sketches({name: df}), folder)
    exact = S.slice_overlap(slices["a"], slices["b"]).select(F.col("shared").alias("exact_shared"), F.lit("a").alias("slice_a"))
    return SK.sketch_overlap(SK.stored_sketches(spark, folder), [("a", "b")]).join(exact, "slice_a")


@register("slice_except", _TWO_SLICES + """
select row_id, edit_type, instruction from sb except all select row_id, edit_type, instruction from sa""")
def q_slice_except(spark, sf_dir):
    """Rows of the newer slice B not already in slice A."""
    cols = ["row_id", "edit_type", "instruction"]
    return S.slice_except(_slice(spark, sf_dir, PLAN_B).select(*cols),
                          _slice(spark, sf_dir, PLAN_A).select(*cols))


def queries() -> dict[str, Query]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)


def _load_all():
    """Import the modules that register the remaining query groups."""
    from . import catalog_more  # noqa: F401
