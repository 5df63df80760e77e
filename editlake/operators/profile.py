"""Coverage profiles, histograms and top-k: A1-A12.

All counting is ``groupBy().agg()`` (partial aggregate before the shuffle, so
hot keys are combined map-side) and all top-k is ``orderBy().limit()``
(TakeOrderedAndProject) or ``row_number() <= k`` over already-aggregated
counts. Ties are broken by count desc, then key asc.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions import text as T
from ..functions.literal import literal_table


def coverage(prompts: DataFrame, prompt_col: str = "caption") -> DataFrame:
    """A1: matched, unmatched and percent matched of a prompt set (C1 rules)."""
    t = prompts.select(T.classify_real(F.col(prompt_col)).alias("t"))
    agg = t.agg(F.count(F.lit(1)).alias("total"), F.count("t").alias("matched"))
    return agg.select(
        F.col("total").cast("bigint"), F.col("matched").cast("bigint"),
        (F.col("total") - F.col("matched")).cast("bigint").alias("unmatched"),
        F.round(F.when(F.col("total") > 0, 100.0 * F.col("matched") / F.col("total")), 6)
        .alias("pct_matched"))


def type_counts(prompts: DataFrame, prompt_col: str = "caption") -> DataFrame:
    """A2: rows per real type, zero for types never hit, in rule order.

    The per-type counts are grouped to at most ten rows before they meet the
    ten-row rule list, so both sides of the join are tiny.
    """
    spark = prompts.sparkSession
    counts = (prompts.select(T.classify_real(F.col(prompt_col)).alias("type_name"))
              .where(F.col("type_name").isNotNull())
              .groupBy("type_name").agg(F.count(F.lit(1)).alias("n")))
    rules = literal_table(spark, [(i, name) for i, name in enumerate(tx.REAL_TYPES)],
                          "rule_order bigint, type_name string")
    return (rules.join(F.broadcast(counts), "type_name", "left")
            .select("rule_order", "type_name",
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def type_counts_total(corpus: DataFrame, type_col: str = "edit_type") -> DataFrame:
    """A3: total, rows per shard and rows per (shard, type) as one rollup.

    ``level`` is the grouping id: 0 = (shard, type), 1 = shard, 3 = total.
    """
    return (corpus.rollup("shard", type_col)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.grouping_id().cast("bigint").alias("level")))


def head_counts(heads: DataFrame, head_col: str = "head") -> DataFrame:
    return (heads.where(F.col(head_col).isNotNull())
            .groupBy(head_col).agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def top_k(counts: DataFrame, k: int, key: str = "head") -> DataFrame:
    return counts.orderBy(F.col("n").desc(), F.col(key).asc()).limit(k)


def add_objects(corpus: DataFrame, strict_article: bool = False) -> DataFrame:
    """(row_id, head) for every ``add`` row (head null when none is found)."""
    return (corpus.where(F.col("edit_type") == "add")
            .select("row_id", T.add_object(F.col("instruction"), strict_article).alias("head")))


def object_histogram(corpus: DataFrame, k: int = 80,
                     threshold: int = tx.OWN_TYPE_THRESHOLD) -> DataFrame:
    """A4: top ``k`` add-object heads, flagged when they reach ``threshold``."""
    top = top_k(head_counts(add_objects(corpus)), k)
    return top.select("head", "n", (F.col("n") >= threshold).alias("own_type"))


THRESHOLDS = (tx.OWN_TYPE_THRESHOLD, tx.TRAINABLE_THRESHOLD)


def _at_thresholds(counts: DataFrame, thresholds) -> DataFrame:
    """(threshold, head, n) for every head at or over each threshold: the
    thresholds are a literal array exploded beside each count row."""
    ths = F.array(*[F.lit(int(t)).cast("bigint") for t in thresholds])
    return (counts.withColumn("threshold", F.explode(ths))
            .where(F.col("n") >= F.col("threshold")))


def threshold_winners(corpus: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """A5: per threshold, how many heads reach it and the rows they cover.
    (The names themselves are ``threshold_winner_names``, one row each, so no
    single row has to hold an unbounded list.)"""
    spark = corpus.sparkSession
    hits = _at_thresholds(head_counts(add_objects(corpus)), thresholds)
    agg = hits.groupBy("threshold").agg(F.count(F.lit(1)).cast("bigint").alias("n_winners"),
                                        F.sum("n").cast("bigint").alias("rows_covered"))
    all_th = literal_table(spark, [(int(t),) for t in thresholds], "threshold bigint")
    return all_th.join(agg, "threshold", "left").select(
        "threshold", F.coalesce("n_winners", F.lit(0)).cast("bigint").alias("n_winners"),
        F.coalesce("rows_covered", F.lit(0)).cast("bigint").alias("rows_covered"))


def threshold_winner_names(corpus: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """A5 names: (threshold, head, n) for every head at or over a threshold."""
    return _at_thresholds(head_counts(add_objects(corpus)), thresholds).select("threshold", "head", "n")


def addition_heads(prompts: DataFrame, prompt_col: str = "caption") -> DataFrame:
    """C7 over a prompt set: (row_id, head) for prompts that look like additions."""
    return (prompts.where(T.looks_like_addition(F.col(prompt_col)))
            .select("row_id", T.addition_head(F.col(prompt_col)).alias("head")))


def addition_share(prompts: DataFrame, prompt_col: str = "caption") -> DataFrame:
    """A6 (first half): how many prompts look like an addition."""
    flag = T.looks_like_addition(F.col(prompt_col))
    agg = prompts.agg(F.count(F.lit(1)).alias("prompts"), F.count_if(flag).alias("additions"))
    return agg.select(F.col("prompts").cast("bigint"), F.col("additions").cast("bigint"),
                      F.round(F.when(F.col("prompts") > 0,
                                     100.0 * F.col("additions") / F.col("prompts")), 6)
                      .alias("pct_additions"))


def addition_histogram(prompts: DataFrame, prompt_col: str = "caption", k: int = 50,
                       threshold: int = tx.TRAINABLE_THRESHOLD) -> DataFrame:
    """Top ``k`` addition heads, flagged as trainable at ``threshold``."""
    top = top_k(head_counts(addition_heads(prompts, prompt_col)), k)
    return top.select("head", "n", (F.col("n") >= threshold).alias("trainable"))


def unmatched_words(prompts: DataFrame, prompt_col: str = "caption", k: int = 60) -> DataFrame:
    """The ``k`` most common stripped words of prompts no rule matches,
    and only then the stop-word and length filter (so fewer than ``k`` can
    remain; the order of the two steps is part of the definition)."""
    unmatched = prompts.where(T.classify_real(F.col(prompt_col)).isNull())
    counts = exploded_words(unmatched, prompt_col).groupBy("word").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))
    top = top_k(counts, k, key="word")
    return top.where((F.col("word") != "") & T.is_profile_word(F.col("word")))


def exploded_words(texts: DataFrame, text_col: str) -> DataFrame:
    """One row per stripped word of every whole text (C8 before its filter).

    The split array is exploded first, so emptiness, stripping and filters run
    as codegen'd column expressions, not as per-element array lambdas.
    """
    w = texts.select(F.explode(F.split(F.lower(F.col(text_col)), T.PY_WHITESPACE_CLASS + "+"))
                     .alias("w")).where(F.col("w") != "")
    return w.select(F.btrim("w", F.lit(tx.PROFILE_STRIP_CHARS)).alias("word"))


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """C8 profile: counts of profile words over whole texts."""
    words = exploded_words(texts, text_col).where(T.is_profile_word(F.col("word")))
    return words.groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def head_hist_per_type(corpus: DataFrame, k: int = 60) -> DataFrame:
    """Earlier-pattern heads (C6), top ``k`` per type for add and tune_transfer.

    The window runs over (type, head) counts, never over rows; the literal
    bound lets Spark plan a partial WindowGroupLimit.
    """
    head = (F.when(F.col("edit_type") == "add", T.head_noun_v1(F.col("instruction"), "add"))
            .otherwise(T.head_noun_v1(F.col("instruction"), "tune_transfer")))
    heads = (corpus.where(F.col("edit_type").isin("add", "tune_transfer"))
             .select("edit_type", head.alias("head")))   # one scan, one pattern per row
    counts = (heads.where(F.col("head").isNotNull())
              .groupBy("edit_type", "head").agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    w = Window.partitionBy("edit_type").orderBy(F.col("n").desc(), F.col("head").asc())
    return (counts.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("rank") <= k))


def smallest_types(index: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` types with the fewest rows (ties by type id)."""
    counts = index.groupBy("type_id").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return counts.orderBy(F.col("n").asc(), F.col("type_id").asc()).limit(k)


def sample_rows(df: DataFrame, k: int, order_col: str = "row_id") -> DataFrame:
    """The first ``k`` rows in corpus order (a sampling feature)."""
    return df.orderBy(F.col(order_col).asc()).limit(k)


def lookup_count(counts: DataFrame, key: str, key_col: str = "head") -> DataFrame:
    """One key's count, 0 when absent (always one row)."""
    return counts.agg(F.coalesce(F.max(F.when(F.col(key_col) == key, F.col("n"))), F.lit(0))
                      .cast("bigint").alias("n")).select(F.lit(key).alias(key_col), "n")
