"""Corpus preparation as one Spark job (shard planning -> pruned read ->
decoded quota -> resize), composed from the operators.

R1 runs on the shard map (metadata) and its shard list prunes the read
(J5); only quota + slack candidates are decoded (two-phase quota); both
images are resized in Arrow batches; the rows can then go to Parquet or to
the packed export (S5).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import images as IM
from ..operators import select as S
from ..operators import shards as SH


def prepare_slice(corpus: DataFrame, quota: Mapping[str, int], *, skip_shards: int = 0,
                  res: int = 128, slack: float = 0.02, decoder=None, shard_map: DataFrame | None = None,
                  keep: tuple[str, ...] = ("row_id", "shard", "edit_type", "instruction")) -> DataFrame:
    """One prep slice: (keep..., type_pos, before, after, res).

    ``corpus`` has ``image_file`` and ``edited_file`` cells
    (struct<bytes, path>). ``shard_map`` defaults to counts of the corpus.
    """
    spark = corpus.sparkSession
    qt = SH.quota_table(spark, quota)
    smap = shard_map if shard_map is not None else SH.shard_type_counts(corpus)
    picked = SH.pick_shards(smap, qt, skip_shards)
    rows = SH.shard_semi_join(corpus, SH.taken_shards(picked))
    out = S.quota_rows_decoded(
        rows, qt, ("image_file", "edited_file"), keep=keep, slack=slack, decoder=decoder,
        finish=lambda dec, kept: IM.resize_columns(dec, res, {"before": ("c0_px", "c0_height", "c0_width"),
                                                              "after": ("c1_px", "c1_height", "c1_width")}, keep=kept))
    return out.select(*keep, "type_pos", "before", "after", "res")


def prepare_untyped(corpus: DataFrame, k: int, n: int, *, res: int = 128, decoder=None,
                    prompt_col: str = "edit_instruction",
                    cells: tuple[str, str] = ("image_file", "edited_file"), shard_rows: DataFrame | None = None) -> DataFrame:
    """The prep of a corpus without types: rows ``[k*n, (k+1)*n)`` in (shard,
    row) order, rows with an unreadable image dropped, both images resized:
    (shard, row_id, prompt, before, after, res). ``shard_rows`` (shard, rows) spares
    a count of the corpus."""
    rows = S.slice_of_shards(corpus.select("shard", "row_id", F.col(prompt_col).alias("prompt"), *cells), k, n, F.lit(True), shard_rows)
    dec, keep, made = rows, ("shard", "row_id", "prompt"), ()
    for i, cell in enumerate(cells):
        dec = IM.decode_images(dec, cell, keep=keep + made + cells[i + 1:], decoder=decoder, prefix=f"c{i}_")
        dec = dec.where(F.col(f"c{i}_ok")).drop(f"c{i}_ok")
        made += tuple(f"c{i}_{x}" for x in ("height", "width", "px"))
    return IM.resize_columns(dec, res, {"before": ("c0_px", "c0_height", "c0_width"),
                                        "after": ("c1_px", "c1_height", "c1_width")}, keep=keep)


def untyped_meta(prepared: DataFrame, want_val: int, sample: int = 20) -> DataFrame:
    """One meta record of an untyped slice: n, val_n, res and its first
    ``sample`` prompts in (shard, row) order (a top-k, never a sort of the slice)."""
    first = (prepared.select("shard", "row_id", "prompt").orderBy("shard", "row_id").limit(sample)
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "row_id", "prompt"))),
                              lambda p: p["prompt"]).alias("prompts_sample")))
    n = prepared.agg(F.count(F.lit(1)).alias("n"), F.max("res").cast("bigint").alias("res"))
    return n.crossJoin(first).select(  # one row each
        "n", F.least(F.lit(want_val).cast("bigint"), F.expr("n div 10")).alias("val_n"), "res", "prompts_sample")
