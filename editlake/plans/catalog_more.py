"""Query groups beyond text, profiles and planning: images (2.8), assembly
(2.9), vectors (2.10), validators (2.11), sources (2.1) and streaming (2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import taxonomy as tx
from ..functions import hashing as H
from ..functions import pixels as PX
from ..operators import images as IM
from . import duck as D
from .catalog import W, register

SIDE = fx.IMAGE_SIDE
HW = SIDE * SIDE
SEED = 1234
IMAGES = D.IMAGES_CTE

# Long-form pixels and their coordinates in DuckDB.
PX_LONG = ("pxl as (select img_id, generate_subscripts(px, 1) - 1 as pos, unnest(px) as v from images)")
PX_COORD = (f"pxc as (select img_id, pos, v, pos // {HW} as c, (pos % {HW}) // {SIDE} as y, "
            f"pos % {SIDE} as x, v / 127.5 - 1 as n from pxl)")


def _images(spark, sf_dir):
    return fx.images(spark, sf_dir)


def _images_binary(spark, sf_dir):
    return fx.images_binary(spark, sf_dir)


def _each(df, arr_col, value_name):
    """(img_id, pos, value) of a made array. ``posexplode`` would let the planner
    infer two filters on the array (not null, not empty), each of which makes the
    whole array once more; the outer form infers none."""
    return (df.select("img_id", F.posexplode_outer(arr_col).alias("pos", value_name)).where(F.col("pos").isNotNull())
            .withColumn("pos", F.col("pos").cast("bigint")))


def _long(df, arr_col, value_name="value"):
    return _each(df, arr_col, value_name)


# ------------------------------------------------------------------ images

@register("pack_chw", W(IMAGES, PX_LONG) + f"""
select img_id, ((pos % 3) * {HW} + pos // 3)::BIGINT as pos, v::BIGINT as value from pxl""")
def q_pack_chw(spark, sf_dir):
    """Interleaved HWC pixels repacked as planar CHW (long form)."""
    img = _images(spark, sf_dir)
    return _long(img.select("img_id", PX.hwc_to_chw(F.col("px"), SIDE).alias("chw")), "chw").select(
        "img_id", "pos", F.col("value").cast("bigint"))


@register("normalize", W(IMAGES, PX_LONG) + """
select img_id, pos::BIGINT as pos, v::BIGINT as value, round(v / 127.5 - 1, 6) as norm,
 floor((least(greatest(v / 127.5 - 1, -1.0), 1.0) + 1) * 127.5)::BIGINT as back from pxl""")
def q_normalize(spark, sf_dir):
    """I4: u8 -> [-1, 1] -> u8 round trip, per pixel."""
    img = _images(spark, sf_dir)
    # pixels and their normalized form are bound: each is made once per image
    both = img.select("img_id", PX.bind(F.col("px"), lambda px: PX.bind(PX.normalize(px), lambda n: F.arrays_zip(
        px.alias("px"), n.alias("norm"), PX.denormalize(n).alias("back")))).alias("z"))
    return _each(both, "z", "t").select(
        "img_id", "pos", F.col("t.px").cast("bigint").alias("value"),
        PX.rounded(F.col("t.norm"), 6).alias("norm"), F.col("t.back").cast("bigint").alias("back"))


@register("flip_pairs", W(IMAGES, PX_LONG) + f"""
select img_id, (pos - pos % {SIDE} + {SIDE - 1} - pos % {SIDE})::BIGINT as pos, v::BIGINT as value from pxl""")
def q_flip_pairs(spark, sf_dir):
    """Each image mirrored on its last axis (long form)."""
    img = _images(spark, sf_dir)
    return _long(img.select("img_id", PX.flip(F.col("px"), SIDE).alias("f")), "f").select(
        "img_id", "pos", F.col("value").cast("bigint"))


@register("synthetic_cross", W(IMAGES) + f"""
select i.img_id, t.edit_type, t.type_id from images i cross join
 (values {', '.join(f"({D.q(n)}, {tx.TYPE_ID[n]}::BIGINT)" for n in tx.SYNTHETIC_TYPES)}) t(edit_type, type_id)""")
def q_synthetic_cross(spark, sf_dir):
    """Every image x the 13 synthetic types."""
    return IM.synthetic_cross(_images(spark, sf_dir).select("img_id"))


def _blur_sql(src: str, name: str, sigma: float) -> str:
    r = max(1, int(3 * sigma))
    refl = lambda e: f"(case when {e} < 0 then -({e}) when {e} > {SIDE - 1} then {2 * (SIDE - 1)} - ({e}) else {e} end)"
    return ",\n".join([
        f"{name}_k as (select d, exp(-(d * d) / (2 * {sigma} * {sigma})) / "
        f"(select sum(exp(-(e * e) / (2 * {sigma} * {sigma}))) from range(-{r}, {r + 1}) t(e)) as w "
        f"from range(-{r}, {r + 1}) t(d))",
        f"{name}_h as (select a.img_id, a.c, a.y, a.x, sum(k.w * b.n) as n from {src} a, {name}_k k, {src} b "
        f"where b.img_id = a.img_id and b.c = a.c and b.y = a.y and b.x = {refl('a.x + k.d')} "
        f"group by 1, 2, 3, 4)",
        f"{name} as (select a.img_id, a.c, a.y, a.x, sum(k.w * b.n) as n from {name}_h a, {name}_k k, {name}_h b "
        f"where b.img_id = a.img_id and b.c = a.c and b.x = a.x and b.y = {refl('a.y + k.d')} "
        f"group by 1, 2, 3, 4)",
    ])


def _clamp_sql(e):
    return f"least(greatest({e}, -1.0), 1.0)"


def _edits_sql() -> str:
    """Per-pixel results of all 13 edits in long form: (img_id, edit_type, pos, r)."""
    L = "(0.299 * l.r + 0.587 * l.g + 0.114 * l.b)"
    tint = lambda t: f"(case p.c when 0 then {t[0]} when 1 then {t[1]} else {t[2]} end)"
    per_pixel = {
        "black_and_white": L,
        "sepia_vintage": _clamp_sql(f"{L} * {tint(PX.SEPIA_TINT)}"),
        "brighter": _clamp_sql(f"p.n * {PX.BRIGHTER[0]} + {PX.BRIGHTER[1]}"),
        "darker": _clamp_sql(f"p.n * {PX.DARKER[0]} + ({PX.DARKER[1]})"),
        "more_colorful": _clamp_sql(f"{L} + (p.n - {L}) * {PX.MORE_COLORFUL}"),
        "less_colorful": _clamp_sql(f"{L} + (p.n - {L}) * {PX.LESS_COLORFUL}"),
        "warmer": _clamp_sql(f"p.n * {tint(PX.WARM_TINT)}"),
        "cooler": _clamp_sql(f"p.n * {tint(PX.COOL_TINT)}"),
        "inverted": "-p.n",
        "high_contrast": _clamp_sql(f"p.n * {PX.HIGH_CONTRAST}"),
        "low_contrast": f"p.n * {PX.LOW_CONTRAST}",
    }
    cols = ", ".join(f"{e} as {k}" for k, e in per_pixel.items())
    names = ", ".join(per_pixel)
    return ",\n".join([
        "luma as (select img_id, y, x, sum(case when c = 0 then n end) as r, sum(case when c = 1 then n end) as g, "
        "sum(case when c = 2 then n end) as b from pxc group by 1, 2, 3)",
        f"wide as (select p.img_id, p.pos, {cols} from pxc p join luma l on l.img_id = p.img_id and l.y = p.y and l.x = p.x)",
        f"sql_edits as (unpivot wide on {names} into name edit_type value r)",
        _blur_sql("pxc", "blur25", PX.BLUR_SIGMA),
        _blur_sql("pxc", "blur15", PX.SHARPEN_SIGMA),
        f"all_edits as (select img_id, edit_type, pos, r from sql_edits "
        f"union all select img_id, 'blur_background', c * {HW} + y * {SIDE} + x, n from blur25 "
        f"union all select p.img_id, 'sharper', p.pos, {_clamp_sql(f'p.n + (p.n - s.n) * {PX.SHARPEN_AMOUNT}')} "
        f"from pxc p join blur15 s on s.img_id = p.img_id and s.c = p.c and s.y = p.y and s.x = p.x)",
    ])


@register("synthetic_pairs", W(IMAGES, PX_LONG, PX_COORD, _edits_sql()) + """
select img_id, edit_type, sum(round(r * 1e6)::BIGINT)::BIGINT as s1,
 sum(round(r * 1e6)::BIGINT * (pos + 1))::BIGINT as s2 from all_edits group by 1, 2""")
def q_synthetic_pairs(spark, sf_dir):
    """All 13 exact edits of every image by the Arrow/NumPy job, as an
    exact integer digest per (image, edit)."""
    cross = IM.synthetic_cross(_images_binary(spark, sf_dir))
    return IM.synthetic_pairs(cross, out="digest")


@register("synthetic_pairs_sql", W(IMAGES, PX_LONG, PX_COORD, _edits_sql()) + f"""
select img_id, edit_type, sum(round(r * 1e6)::BIGINT)::BIGINT as s1,
 sum(round(r * 1e6)::BIGINT * (pos + 1))::BIGINT as s2 from all_edits
where edit_type not in ('blur_background', 'sharper') group by 1, 2""")
def q_synthetic_pairs_sql(spark, sf_dir):
    """I5, SQL form: the 11 per-pixel edits as array ``transform`` expressions."""
    img = _images(spark, sf_dir).select("img_id", PX.normalize(F.col("px")).alias("x"))
    # One scan: each image fans out to the 11 edit names, and a CASE on the
    # name evaluates exactly one transform per row.
    fan = img.withColumn("edit_type", F.explode(F.array(*[F.lit(e) for e in PX.SQL_EDITS])))
    after = None
    for e in PX.SQL_EDITS:
        t = PX.synthetic_sql(F.col("x"), e, SIDE)
        after = F.when(F.col("edit_type") == e, t) if after is None else after.when(F.col("edit_type") == e, t)
    d = fan.select("img_id", "edit_type", IM.pixel_digest()(after).alias("d"))
    return d.select("img_id", "edit_type", "d.s1", "d.s2")


@register("pair_error", W(IMAGES, PX_LONG, PX_COORD, _edits_sql()) + """
, stored as (select img_id - 1 as img_id, pos, v / 127.5 - 1 as a from pxl)
select e.edit_type, round(avg((s.a - e.r) * (s.a - e.r)), 6) as mse_truth,
 round(avg((s.a - p.n) * (s.a - p.n)), 6) as mse_input
from all_edits e join stored s on s.img_id = e.img_id and s.pos = e.pos
 join pxc p on p.img_id = e.img_id and p.pos = e.pos group by 1""")
def q_pair_error(spark, sf_dir):
    """I8: per type, mean squared error of the stored after-image (the next
    image) against the exact edit, and against the unedited input."""
    img = _images_binary(spark, sf_dir)
    stored = img.select((F.col("img_id") - 1).alias("img_id"), F.col("px").alias("stored"))
    pairs = img.join(stored.hint("merge"), "img_id")  # 192-byte images, before the x13 fan-out; never broadcast
    per = IM.synthetic_pairs(IM.synthetic_cross(pairs), out="error", compare_col="stored",
                             keep=()).withColumnRenamed("e_truth", "e_t").withColumnRenamed("e_input", "e_i")
    return per.groupBy("edit_type").agg(
        F.round(F.sum("e_t") / F.sum("n"), 6).alias("mse_truth"),
        F.round(F.sum("e_i") / F.sum("n"), 6).alias("mse_input"))


@register("drop_image", W(IMAGES, PX_LONG) + f"""
select img_id, d as dropped, case when d then 0 else sum(round((v / 127.5 - 1) * 1e6)::BIGINT) end::BIGINT as s1
from (select *, {D.md5_uniform(str(SEED), 'img_id', '7')} < 0.1 as d from pxl) group by img_id, d""")
def q_drop_image(spark, sf_dir):
    """``before`` replaced by zeros (mid-grey) for a hash-chosen 10%."""
    img = _images(spark, sf_dir).select("img_id", PX.normalize(F.col("px")).alias("x"))
    dropped = H.uniform(SEED, F.col("img_id"), 7) < 0.1
    zeros = F.array_repeat(F.lit(0.0), 3 * HW)
    x = F.when(dropped, zeros).otherwise(F.col("x"))
    s1, _ = PX.digest(x)
    return img.select("img_id", dropped.alias("dropped"), s1.alias("s1"))


@register("image_stats", W(IMAGES) + """
select img_id, round(list_aggregate(list_transform(px, lambda v: v / 127.5 - 1), 'stddev_samp'), 6) as std,
 round(list_sort(list_transform(px, lambda v: abs(v / 127.5 - 1)))[round_even(0.995 * (len(px) - 1), 0)::INT + 1], 6) as q_abs
from images""")
def q_image_stats(spark, sf_dir):
    """Per image, sample standard deviation and the 0.995 quantile of |x|."""
    img = _images(spark, sf_dir).select("img_id", PX.normalize(F.col("px")).alias("x"))
    return img.select("img_id", F.round(PX.array_std(F.col("x")), 6).alias("std"),
                      F.round(PX.abs_quantile(F.col("x"), 0.995), 6).alias("q_abs"))


def _cells(spark, sf_dir):
    """Image cells as the corpus stores them: struct<bytes, path>; the bytes are
    raw interleaved RGB, and one image in 97 is cut short (unreadable)."""
    img = _images(spark, sf_dir)
    raw = PX.u8_to_binary(F.col("px"))
    data = F.when(F.col("img_id") % 97 == 0, F.substring(raw, 1, 100)).otherwise(raw)
    return img.select("img_id", F.struct(data.alias("bytes"), F.lit(None).cast("string").alias("path"))
                      .alias("image_file"))


def _binary_digest(b):
    vals = F.transform(F.sequence(F.lit(1), F.octet_length(b)),
                       lambda i: F.conv(F.hex(F.substring(b, i, 1)), 16, 10).cast("bigint"))
    return F.aggregate(F.zip_with(vals, F.sequence(F.lit(1), F.size(vals)), lambda v, i: v * i),
                       F.lit(0).cast("bigint"), lambda a, v: a + v)


@register("decode_images", W(IMAGES, PX_LONG) + f"""
select img_id, ok, case when ok then {SIDE} end::BIGINT as height, case when ok then {SIDE} end::BIGINT as width,
 case when ok then sum(v * ((pos % 3) * {HW} + pos // 3 + 1)) end::BIGINT as s1
from (select *, img_id % 97 <> 0 as ok from pxl) group by img_id, ok""")
def q_decode_images(spark, sf_dir):
    """I1 (+ I3): raw RGB cells decoded to CHW; bad cells flagged, not fatal."""
    dec = IM.decode_images(_cells(spark, sf_dir), "image_file")
    return dec.select("img_id", "ok", F.col("height").cast("bigint"), F.col("width").cast("bigint"),
                      F.when(F.col("ok"), _binary_digest(F.col("px"))).alias("s1"))


@register("decode_png", W(IMAGES) + f"""
select img_id, img_id % 97 <> 0 as ok, case when img_id % 97 <> 0 then {SIDE} end::BIGINT as height,
 case when img_id % 97 <> 0 then {SIDE} end::BIGINT as width,
 case when img_id % 97 <> 0 then md5(unhex(array_to_string(list_transform(px, lambda x: printf('%02x', x)), ''))) end as px_md5,
 case when img_id % 97 = 0 then 'PNG cut short' end as error from images""")
def q_decode_png(spark, sf_dir):
    """Compressed cells (PNG files that use all five row filters) decoded to
    CHW; files cut short are flagged with the reason."""
    img = _images_binary(spark, sf_dir).select("img_id", "px", F.col("res").alias("height"), F.col("res").alias("width"))
    cells = IM.png_cells(img, kinds=(4, 3, 2, 1, 0))
    short = F.struct(F.expr("substring(image_file.bytes, 1, octet_length(image_file.bytes) - 20)").alias("bytes"),
                     F.lit(None).cast("string").alias("path"))
    cells = cells.withColumn("image_file", F.when(F.col("img_id") % 97 == 0, short).otherwise(F.col("image_file")))
    dec = IM.decode_images(cells, "image_file", errors=True)
    return dec.select("img_id", "ok", F.col("height").cast("bigint"), F.col("width").cast("bigint"), F.md5("px").alias("px_md5"), "error")


def _resize_sql(n_in: int, n_out: int) -> str:
    """Two Lanczos passes (a = 3, rounded and clipped after each) over ``pxc``."""
    scale = n_in / n_out
    sinc = lambda e: f"(case when {e} = 0 then 1 else sin(pi() * {e}) / (pi() * {e}) end)"
    byte = "least(greatest(floor(sum(w.w * p.v) + 0.5), 0), 255)"
    return ",\n".join([
        f"taps as (select o, i, (i - (o + 0.5) * {scale} + 0.5) / {scale} as d from range(0, {n_out}) t(o), range(0, {n_in}) u(i) "
        f"where i >= greatest(floor((o + 0.5) * {scale} - {3 * scale} + 0.5), 0) and i < least(floor((o + 0.5) * {scale} + {3 * scale} + 0.5), {n_in}))",
        f"raw_w as (select o, i, case when abs(d) < 3 then {sinc('d')} * {sinc('(d / 3)')} else 0 end as w from taps)",
        "weights as (select o, i, w / sum(w) over (partition by o) as w from raw_w)",
        f"wide_px as (select p.img_id, p.c, p.y, w.o as x, {byte} as v from pxc p join weights w on w.i = p.x group by 1, 2, 3, 4)",
        f"small_px as (select p.img_id, p.c, w.o as y, p.x, {byte} as v from wide_px p join weights w on w.i = p.y group by 1, 2, 3, 4)",
    ])


@register("resize_images", W(IMAGES, PX_LONG, PX_COORD, _resize_sql(SIDE, 4)) + """
select img_id, 4::BIGINT as res, md5(unhex(string_agg(printf('%02x', v::INTEGER), '' order by c, y, x))) as px_md5
from small_px group by 1""")
def q_resize_images(spark, sf_dir):
    """Every image resized 8 -> 4 px (Lanczos, a = 3) by the NumPy job."""
    r = IM.resize_images(_images_binary(spark, sf_dir), 4)
    return r.select("img_id", F.col("res").cast("bigint").alias("res"), F.md5("px").alias("px_md5"))


@register("register_edits", W(IMAGES, PX_LONG, PX_COORD, _edits_sql()) + """
, digest as (select img_id, edit_type, sum(round(r * 1e6)::BIGINT)::BIGINT as s1,
 sum(round(r * 1e6)::BIGINT * (pos + 1))::BIGINT as s2 from all_edits group by 1, 2)
select 'function' as form, * from digest union all select 'table' as form, * from digest""")
def q_register_edits(spark, sf_dir):
    """All 13 edits called by name as SQL functions, and the table function."""
    IM.register_edits(spark)
    IM.register_edit_rows(spark)
    img = _images(spark, sf_dir).select("img_id", PX.normalize(F.col("px")).alias("x"))
    digest = IM.pixel_digest()  # in the worker that made the edit: the pixels do not travel
    stacked = F.array(*[F.struct(F.lit(n).alias("edit_type"), digest(F.call_function(f"edit_{n}", F.col("x"), F.lit(SIDE))).alias("d"))
                        for n in tx.SYNTHETIC_TYPES])
    by_function = img.select(F.lit("function").alias("form"), "img_id", F.inline(stacked))
    img.createOrReplaceTempView("edit_inputs")
    by_table = spark.sql("select 'table' as form, id as img_id, edit_type, after from "
                         f"synthetic_edit_rows(table(select img_id as id, x as px, {SIDE} as side from edit_inputs))")
    by_table = by_table.select("form", "img_id", "edit_type", digest("after").alias("d"))
    return by_function.unionByName(by_table).select("form", "img_id", "edit_type", "d.s1", "d.s2")


# ---------------------------------------------------------------- assembly (2.9)

from ..operators import assemble as AS  # noqa: E402
from .catalog import PAIRS  # noqa: E402

SHARE = 0.25


def _pools_sql(split: str, rows: str = "pairs", min_rows: int = 50) -> str:
    return ",\n".join([
        D.TYPES_CTE,
        f"prep as (select * from {rows} where decodable)",
        "splitted as (select *, case when row_number() over (partition by shard order by row_id) - 1 < "
        "count(*) over (partition by shard) - least(30, count(*) over (partition by shard) // 10) "
        "then 'train' else 'val' end as split from prep)",
        f"srows as (select * from splitted where split = '{split}')",
        f"named as (select r.shard, r.row_id, t.type_id from (select shard, row_id, "
        f"{D.classify_edit('edit_type', 'instruction')} as type_name from srows) r join types t on t.name = r.type_name)",
        f"keep as (select type_id from named group by 1 having count(*) >= {min_rows})",
        "pools as (select -1::BIGINT as pool_id, shard, row_id, (row_number() over (order by shard, row_id) - 1)::BIGINT as pos, "
        "count(*) over ()::BIGINT as pool_size from srows union all "
        "select type_id, shard, row_id, (row_number() over (partition by type_id order by shard, row_id) - 1)::BIGINT, "
        "count(*) over (partition by type_id)::BIGINT from named where type_id in (select type_id from keep))",
        "sizes as (select pool_id, max(pool_size) as size from pools group by 1)",
        "choices as (select 0 as kind, s.i::BIGINT as idx, s.type_id::BIGINT as type_id, -1::BIGINT as pool_id, "
        "(select size from sizes where pool_id = -1) as size, s.i::BIGINT as slot from (values "
        + ", ".join(f"({i}, {t})" for i, t in enumerate(AS.SYNTH_IDS)) + ") s(i, type_id) union all "
        f"select 1, (row_number() over (order by pool_id) - 1)::BIGINT, pool_id, pool_id, size, "
        f"({len(AS.SYNTH_IDS)} + row_number() over (order by pool_id) - 1)::BIGINT from sizes where pool_id >= 0)",
    ])


def _draws_sql(seed: int) -> str:
    u = lambda k: D.md5_uniform(str(seed), "draw_id", str(k))
    kreal = "(select count(*) from sizes where pool_id >= 0)"
    return ",\n".join([
        f"d1 as (select pos as draw_id, {u(0)} as u0, {u(1)} as u1, {u(2)} as u2 from pools where pool_id = -1)",
        f"d2 as (select *, case when {kreal} > 0 and u0 >= {SHARE} then 1 else 0 end as kind from d1)",
        f"d3 as (select *, floor(u1 * case when kind = 1 then {kreal} else {len(AS.SYNTH_IDS)} end)::BIGINT as idx from d2)",
        "draws as (select d3.draw_id, c.type_id, c.pool_id, p.shard, p.row_id from d3 join choices c "
        "on c.kind = d3.kind and c.idx = d3.idx join pools p on p.pool_id = c.pool_id and p.pos = floor(d3.u2 * c.size)::BIGINT)",
    ])


def _prepared(spark, sf_dir):
    return fx.pairs(spark, sf_dir).where(F.col("decodable"))


def _train_pools(spark, sf_dir, materialize=True):
    return AS.build_pools(_prepared(spark, sf_dir), "train", 30, materialize=materialize)


def _draws(spark, sf_dir):
    pools = _train_pools(spark, sf_dir, materialize=True)
    ids = pools.where(F.col("pool_id") == AS.IMAGE_POOL).select(F.col("pos").alias("draw_id"))
    return AS.mixture_sample(pools, ids, SEED, SHARE), pools


@register("build_pools", W(PAIRS, _pools_sql("train")) + "select pool_id, shard, row_id, pos, pool_size from pools")
def q_build_pools(spark, sf_dir):
    """Train image pool and per-type index (after the 50-row support filter)."""
    return _train_pools(spark, sf_dir)


@register("type_index", W(PAIRS, _pools_sql("train")) + "select pool_id as type_id, shard, row_id, pos from pools where pool_id >= 0")
def q_type_index(spark, sf_dir):
    """A10: type -> ordered row refs, long form with a dense position."""
    p = _train_pools(spark, sf_dir).where(F.col("pool_id") >= 0)
    return p.select(F.col("pool_id").alias("type_id"), "shard", "row_id", "pos")


@register("smallest_types", W(PAIRS, _pools_sql("train")) + """
select pool_id as type_id, max(pool_size)::BIGINT as n from pools where pool_id >= 0 group by 1 order by n asc, type_id asc limit 5""")
def q_smallest_types(spark, sf_dir):
    """The five indexed types with the fewest train rows."""
    from ..operators import profile as P
    idx = _train_pools(spark, sf_dir).where(F.col("pool_id") >= 0).select(F.col("pool_id").alias("type_id"))
    return P.smallest_types(idx, 5)


@register("mixture_sample", W(PAIRS, _pools_sql("train"), _draws_sql(SEED)) + "select * from draws")
def q_mixture_sample(spark, sf_dir):
    """One draw per train image: type mixture, then a row of its pool."""
    return _draws(spark, sf_dir)[0]


def _train_index(spark, sf_dir):
    from ..session import cut_lineage
    return cut_lineage(AS.build_index(_prepared(spark, sf_dir), "train", 30))


@register("mixture_sample_indexed", W(PAIRS, _pools_sql("train"), _draws_sql(SEED)) + "select * from draws")
def q_mixture_sample_indexed(spark, sf_dir):
    """T2 from the bitmap index of types: the same draws, without a pool table."""
    index = _train_index(spark, sf_dir)
    n = AS.pool_sizes(index)[AS.IMAGE_POOL]
    return AS.mixture_sample_indexed(index, n, SEED, SHARE)


@register("type_bitmaps", W(PAIRS, _pools_sql("train")) + f"""
select pool_id, shard, row_id // {AS.BLOCK_BITS} as block, count(*)::BIGINT as n, min(pos)::BIGINT as off, max(pool_size)::BIGINT as pool_size
from pools group by 1, 2, 3""")
def q_type_bitmaps(spark, sf_dir):
    """A10 as bitmaps: rows of each pool, shard and block, and the rows before them."""
    return _train_index(spark, sf_dir).select("pool_id", "at.shard", "block", F.bitmap_count("bits").alias("n"), "off", "pool_size")


@register("val_items", W(PAIRS, _pools_sql("val")) + """
select k.k::BIGINT as k, c.slot, c.type_id, c.pool_id, p.shard, p.row_id from choices c, range(0, 4) k(k)
join pools p on p.pool_id = c.pool_id and p.pos = k.k % c.size""")
def q_val_items(spark, sf_dir):
    """Fixed validation items, 4 per sampleable type (val split pools)."""
    pools = AS.build_pools(_prepared(spark, sf_dir), "val", 30, materialize=True)
    return AS.val_items(pools, 4)


@register("cond_dropout", W(PAIRS, _pools_sql("train"), _draws_sql(SEED)) + f"""
select draw_id, type_id as type_in, case when td then 0 else type_id end::BIGINT as type_id, td as type_dropped, idr as image_dropped
from (select *, {D.md5_uniform(str(SEED), 'draw_id', '3')} < 0.1 as td, {D.md5_uniform(str(SEED), 'draw_id', '4')} < 0.1 as idr from draws)""")
def q_cond_dropout(spark, sf_dir):
    """T4: type and image dropout masks on the sampled draws."""
    d = AS.cond_dropout(_draws(spark, sf_dir)[0], SEED, 0.1, 0.1)
    return d.select("draw_id", "type_in", "type_id", "type_dropped", "image_dropped")


@register("flip_augment", W(PAIRS, _pools_sql("train"), _draws_sql(SEED)) + f"""
select draw_id, {D.md5_uniform(str(SEED), 'draw_id', '5')} < 0.5 as flipped from draws""")
def q_flip_augment(spark, sf_dir):
    """T5: train-split flip flags of the sampled draws."""
    return AS.flip_augment(_draws(spark, sf_dir)[0], SEED).select("draw_id", "flipped")


@register("exposure_report", W(PAIRS, _pools_sql("train"), _draws_sql(SEED)) + f"""
, expected as (select type_id, case when (select count(*) from sizes where pool_id >= 0) = 0 then 1.0 / {len(AS.SYNTH_IDS)}
  when kind = 1 then (1 - {SHARE}) / (select count(*) from sizes where pool_id >= 0) else {SHARE} / {len(AS.SYNTH_IDS)} end as expected from choices)
, actual as (select type_id, count(*) as n, count(*) / sum(count(*)) over () as actual from draws group by 1)
select coalesce(e.type_id, a.type_id) as type_id, round(coalesce(e.expected, 0), 6) as expected,
 round(coalesce(a.actual, 0), 6) as actual, coalesce(a.n, 0)::BIGINT as n
from expected e full join actual a on a.type_id = e.type_id""")
def q_exposure_report(spark, sf_dir):
    """Expected vs actual share per type of the sampled draws."""
    draws, pools = _draws(spark, sf_dir)
    return AS.exposure_report(draws, pools, SHARE)


def _beside_images(spark, sf_dir, pairs, before, after):
    """Every pair with its images: pair k holds image ``k mod n`` before and image
    ``k + 1 mod n`` after. ``before`` and ``after`` are tables of ``img_id`` and more,
    which grow with the corpus: the planner takes made pixels for a few bytes, so
    the hints keep it from broadcasting every image through the driver."""
    n = fx.table(spark, sf_dir, "part").count()
    return (pairs.withColumn("_before", F.col("row_id") % n).withColumn("_after", (F.col("row_id") + 1) % n)
            .join(before.withColumnRenamed("img_id", "_before").hint("merge"), "_before")
            .join(after.withColumnRenamed("img_id", "_after").hint("merge"), "_after")
            .drop("_before", "_after"))


def corpus_images(spark, sf_dir):
    """The typed corpus with pixels: every pair with its before- and after-image."""
    imgs = fx.images_binary(spark, sf_dir)
    return _beside_images(spark, sf_dir, fx.pairs(spark, sf_dir), imgs.select("img_id", "px", "res"),
                          imgs.select("img_id", F.col("px").alias("after_px")))


def _hex_md5(px: str, flipped: str = "false") -> str:
    """md5 of the bytes of an integer list, mirrored per image row where ``flipped``."""
    mirrored = f"list_transform(range(0, len({px})), lambda i: {px}[((i // {SIDE}) * {SIDE} + {SIDE - 1} - i % {SIDE} + 1)::INTEGER])"
    text = lambda e: f"array_to_string(list_transform({e}, lambda v: printf('%02x', v::INTEGER)), '')"
    return f"md5(unhex(case when {flipped} then {text(mirrored)} else {text(px)} end))"


_NAMES = ", ".join(f"({tx.TYPE_ID[n]}, '{n}')" for n in tx.SYNTHETIC_TYPES)


@register("materialize_examples", W(PAIRS, IMAGES) + ", ci as (select * from pairs), " + ", ".join([
              _pools_sql("train", "ci", 5), _draws_sql(SEED), PX_LONG, PX_COORD, _edits_sql()]) + f"""
, flags as (select *, {D.md5_uniform(str(SEED), 'draw_id', '3')} < 0.1 as td, {D.md5_uniform(str(SEED), 'draw_id', '4')} < 0.1 as idr,
  {D.md5_uniform(str(SEED), 'draw_id', '5')} < 0.5 as flipped from draws)
, names as (select * from (values {_NAMES}) t(type_id, name))
, edited as (select img_id, edit_type, list(floor((least(greatest(r, -1.0), 1.0) + 1.0) * 127.5 + 0.5) order by pos) as px
  from all_edits group by 1, 2)
select f.draw_id, case when td then 0 else f.type_id end::BIGINT as type_id, 8::BIGINT as res,
 case when idr then md5(unhex(repeat('80', 192))) else {_hex_md5('a.px', 'f.flipped')} end as before_md5,
 case when n.name is not null then {_hex_md5('e.px', 'f.flipped')} else {_hex_md5('b.px', 'f.flipped')} end as after_md5,
 f.flipped, idr as image_dropped
from flags f join images a on a.img_id = f.row_id % (select count(*) from part) join images b on b.img_id = (f.row_id + 1) % (select count(*) from part)
 left join names n on n.type_id = f.type_id left join edited e on e.img_id = f.row_id % (select count(*) from part) and e.edit_type = n.name""")
def q_materialize_examples(spark, sf_dir):
    """Sampled refs turned into (before, after, type) training rows."""
    ci = corpus_images(spark, sf_dir)
    prepared = ci.where(F.col("decodable")).select(*fx.PAIRS_COLUMNS)
    pools = AS.build_pools(prepared, "train", 30, min_rows=5, materialize=True)
    ids = pools.where(F.col("pool_id") == AS.IMAGE_POOL).select(F.col("pos").alias("draw_id"))
    draws = AS.flip_augment(AS.cond_dropout(AS.mixture_sample(pools, ids, SEED, SHARE),
                                            SEED, 0.1, 0.1), SEED)
    ex = AS.materialize_examples(draws, ci)
    return ex.select("draw_id", "type_id", F.col("res").cast("bigint").alias("res"), F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"),
                     "flipped", "image_dropped")


# ------------------------------------------------------------- vectors (2.10)

from ..operators import checks as CK  # noqa: E402
from ..operators import select as S  # noqa: E402
from ..operators import shards as SH  # noqa: E402
from ..operators import vectors as V  # noqa: E402
from ..session import cut_lineage, ensure_checkpoint_dir, shuffles_freed  # noqa: E402
from ..sources import corpus as SC  # noqa: E402
from .catalog import PLAN_A, PLAN_B, _pick_sql, _slice  # noqa: E402


def _scratch(spark, name: str) -> str:
    """A fresh folder under the session's shared checkpoint location."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("cond_sensitivity", """
with l as (select vec_id, label, generate_subscripts(embedding, 1) as pos, unnest(embedding)::DOUBLE as v from embeddings),
c as (select label, pos, avg(v) as m from l group by 1, 2),
s as (select l.vec_id, l.label, sum(l.v * c.m) as dot, sum(l.v * l.v) as aa, sum(c.m * c.m) as bb,
  sum((l.v - c.m) * (l.v - c.m)) as dd from l join c on c.label = l.label and c.pos = l.pos group by 1, 2)
select vec_id, label::BIGINT as label, round(dot / (sqrt(aa) * sqrt(bb)), 6) as cosine,
 round(sqrt(dd) / sqrt(bb), 6) as rel_diff from s""")
def q_cond_sensitivity(spark, sf_dir):
    """Each embedding against its label centroid: cosine, relative difference."""
    e = fx.table(spark, sf_dir, "embeddings")
    return V.cond_sensitivity(e).withColumn("label", F.col("label").cast("bigint"))


@register("vector_health", """
select vec_id, len(list_filter(embedding, lambda x: isnan(x) or isinf(x)))::BIGINT as n_nonfinite,
 list_bool_and(list_transform(embedding, lambda x: x = 0)) as all_zero,
 round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) as norm,
 sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) < 1e-6 as tiny from embeddings""")
def q_vector_health(spark, sf_dir):
    """Non-finite, all-zero and tiny-norm vectors."""
    return V.vector_health(fx.table(spark, sf_dir, "embeddings"))


_TOKENS = "len(regexp_extract_all(lower(coalesce(instruction, '')), '\\w+|[^\\w\\s]'))"
_ALIKE = "count(*) over (partition by lower(instruction))::BIGINT as alike"


def _vector_facts(df, *keep):
    """Per row: shape, slots that hold something, and rows with equal vectors. The
    narrow facts are kept, so the wide vectors are made or read once."""
    filled = F.size(F.filter("vectors", lambda v: F.exists(v, lambda x: x != 0)))
    facts = df.select(*keep, F.size("vectors").cast("bigint").alias("seq_len"), F.size(F.element_at("vectors", 1)).cast("bigint").alias("dim"),
                      filled.cast("bigint").alias("filled"), F.xxhash64("vectors").alias("_h"))
    facts = cut_lineage(facts)
    return facts.join(facts.groupBy("_h").agg(F.count(F.lit(1)).alias("alike")), "_h").drop("_h")


@register("embed_text", W(PAIRS) + f"select row_id, 32::BIGINT as seq_len, 64::BIGINT as dim, least({_TOKENS}, 32)::BIGINT as filled, {_ALIKE} from pairs")
def q_embed_text(spark, sf_dir):
    """Every instruction encoded (32 x 64 per row): one slot a token, equal
    vectors for equal texts and for no others."""
    p = fx.pairs(spark, sf_dir).select("row_id", "instruction")
    return _vector_facts(V.embed_text(p, "instruction"), "row_id")


@register("refresh_embeddings", W(PAIRS) + f"""
, meta as (select shard, count(*) as n from pairs group by 1)
select p.shard, row_id, 32::BIGINT as seq_len, 64::BIGINT as dim, least({_TOKENS}, 32)::BIGINT as filled, {_ALIKE}, m.n::BIGINT as meta_n,
 64::BIGINT as meta_dim, 32::BIGINT as meta_seq_len, 'second' as meta_encoder, 'orders' as meta_source
from pairs p join meta m on m.shard = p.shard""")
def q_refresh_embeddings(spark, sf_dir):
    """Prompts re-embedded twice; the second version of vectors and meta
    records replaces the first in one step."""
    p = fx.pairs(spark, sf_dir).select("shard", "row_id", "instruction")
    meta = SC.write_meta(fx.pairs(spark, sf_dir), 30, 8, "orders")
    root = _scratch(spark, "vectors")
    V.refresh_version(p, meta, root, dim=8, encoder="first")
    V.refresh_version(p, meta, root, encoder="second")
    vectors, records = V.read_version(spark, root)
    m = F.from_json("meta_json", "n bigint, source string, text_dim bigint, seq_len bigint, encoder string")
    records = records.select(F.col("shard"), m.alias("m")).select(
        "shard", F.col("m.n").alias("meta_n"), F.col("m.text_dim").alias("meta_dim"), F.col("m.seq_len").alias("meta_seq_len"),
        F.col("m.encoder").alias("meta_encoder"), F.col("m.source").alias("meta_source"))
    return _vector_facts(vectors.withColumn("shard", F.col("shard").cast("bigint")), "shard", "row_id").join(records, "shard")


# ----------------------------------------------------------- validators (2.11)

@register("check_lengths", W(PAIRS) + """
, per as (select shard, count(*) as n, count(instruction) as prompts, count(edit_type_nullable) as types,
  count(*) filter (where decodable) as images from pairs group by shard)
select 'lengths:' || part as check, shard, actual = n as ok, n::BIGINT as expected, actual::BIGINT as actual
from (unpivot per on prompts, types, images into name part value actual)""")
def q_check_lengths(spark, sf_dir):
    """V1: per shard, the prompt, type and image counts against meta n."""
    p = fx.pairs(spark, sf_dir)
    return CK.check_lengths(p, SC.write_meta(p, 30, 8, "orders"))


PLAN_SHORT = ({"add": 4000, "replace": 100}, 0)


@register("check_nonempty", W(PAIRS, D.SMAP_CTE, _pick_sql(PLAN_SHORT), D.quota_rows_sql("taken", "picked", "picked_quota")) + """
select 'nonempty:' || q.edit_type as check, null::BIGINT as shard,
 coalesce(t.n, 0) >= q.quota and coalesce(t.n, 0) > 0 as ok, q.quota as expected, coalesce(t.n, 0)::BIGINT as actual
from picked_quota q left join (select edit_type, count(*) as n from taken group by 1) t on t.edit_type = q.edit_type""")
def q_check_nonempty(spark, sf_dir):
    """V3: a plan whose add quota exceeds the stock must report the shortfall."""
    quota = SH.quota_table(spark, PLAN_SHORT[0])
    return CK.check_nonempty(quota, _slice(spark, sf_dir, PLAN_SHORT))


@register("check_uniform_res", W(IMAGES) + """
select 'uniform_res' as check, null::BIGINT as shard, count(distinct res) = 1 as ok, 1::BIGINT as expected,
 count(distinct res)::BIGINT as actual from (select img_id // 100 as shard, sqrt(len(px) / 3)::BIGINT as res from images)""")
def q_check_uniform_res(spark, sf_dir):
    """V4: one resolution over all image shards."""
    img = _images(spark, sf_dir).select((F.col("img_id") / 100).cast("bigint").alias("shard"),
                                        F.sqrt(F.size("px") / 3).cast("bigint").alias("res"))
    return CK.check_uniform_res(img)


@register("check_disjoint", W(PAIRS, D.SMAP_CTE, _pick_sql(PLAN_A, "pa"), _pick_sql(PLAN_B, "pb"),
                              D.quota_rows_sql("sa", "pa", "pa_quota"), D.quota_rows_sql("sb", "pb", "pb_quota")) + """
select 'disjoint' as check, shard, false as ok, 0::BIGINT as expected, count(*)::BIGINT as actual
from (select row_id, shard from sa intersect select row_id, shard from sb) group by shard""")
def q_check_disjoint(spark, sf_dir):
    """V5: rows held by both overlapping prep slices, per shard."""
    cols = ["row_id", "shard"]
    both = S.slice_union({"a": _slice(spark, sf_dir, PLAN_A).select(*cols),
                          "b": _slice(spark, sf_dir, PLAN_B).select(*cols)})
    return CK.check_disjoint(both)


@register("check_taxonomy_append_only", W(PAIRS, D.TYPES_CTE) + f"""
, stored as (select distinct (list_position({D.str_list(tx.TAXONOMY_V3)}, t) - 1)::BIGINT as type_id, t as type_name
  from (select {D.classify_real_case('caption')} as t from pairs) where t is not null)
select 'taxonomy_append_only' as check, s.type_id, s.type_name as stored_name, n.name as current_name,
 coalesce(n.name = s.type_name, false) as ok from stored s left join types n on n.type_id = s.type_id""")
def q_check_taxonomy_append_only(spark, sf_dir):
    """V6: type ids stored under the first taxonomy still mean the same names."""
    from ..functions import text as T
    v3 = F.array(*[F.lit(n) for n in tx.TAXONOMY_V3])
    name = T.classify_real(F.col("caption"))
    stored = fx.pairs(spark, sf_dir).select(
        (F.array_position(v3, name) - 1).cast("bigint").alias("type_id"), name.alias("type_name")).where(
        F.col("type_name").isNotNull())
    return CK.check_taxonomy_append_only(stored)


# -------------------------------------------------------------- sources (2.1)

def _md5_sql(px: str) -> str:
    """md5 of the bytes of an integer list."""
    return f"md5(unhex(array_to_string(list_transform({px}, lambda x: printf('%02x', x)), '')))"


def _cells_corpus(spark, sf_dir):
    """Typed corpus rows with struct<bytes, path> image cells."""
    img = _images(spark, sf_dir).select("img_id", PX.u8_to_binary(F.col("px")).alias("b"))
    cell = F.struct(F.col("b").alias("bytes"), F.lit(None).cast("string").alias("path"))
    p = fx.pairs(spark, sf_dir).select("row_id", "shard", "edit_type",
                                       F.col("instruction").alias("edit_instruction"), "caption")
    return _beside_images(spark, sf_dir, p, img.select("img_id", cell.alias("image_file")), img.select("img_id", cell.alias("edited_file")))


def _corpus_files(spark, sf_dir):
    """The typed corpus as one file per shard, named ``train-NNNNN-of-MMMMM``;
    row ids then count within a file."""
    path = _scratch(spark, "corpus")
    c = _cells_corpus(spark, sf_dir)
    name = F.format_string("train-%05d-of-%05d", F.col("shard"), F.lit(99999))
    rows = (c.withColumn("file", name).repartition("file").sortWithinPartitions("file", "row_id")
            .select("file", "caption", *SC.CORPUS_COLUMNS))
    SC.write_files(rows, path, "file")
    return path


@register("scan_corpus", W(PAIRS, IMAGES) + f"""
select p.shard, (row_number() over (partition by p.shard order by p.row_id) - 1)::BIGINT as row_id, p.edit_type, p.instruction,
 {_md5_sql('a.px')} as before_md5, {_md5_sql('b.px')} as after_md5
from pairs p join images a on a.img_id = p.row_id % (select count(*) from part) join images b on b.img_id = (p.row_id + 1) % (select count(*) from part)""")
def q_scan_corpus(spark, sf_dir):
    """Corpus files read as type, instruction and the two image cells only,
    keyed by (shard, position in the file)."""
    c = SC.scan_corpus(spark, _corpus_files(spark, sf_dir))
    return c.select("shard", "row_id", "edit_type", F.col("edit_instruction").alias("instruction"),
                    F.md5("image_file.bytes").alias("before_md5"), F.md5("edited_file.bytes").alias("after_md5"))


@register("slice_of_shards", W(PAIRS) + """
, c as (select shard, (row_number() over (partition by shard order by row_id) - 1)::BIGINT as row_id, instruction, decodable,
 row_number() over (order by shard, row_id) - 1 as pos from pairs)
select shard, row_id, instruction from c where pos >= 300 and pos < 600 and decodable""")
def q_slice_of_shards(spark, sf_dir):
    """R3 on ids counted per file: the second slice of 300 rows."""
    from ..operators.ordering import ordered_position
    c = ordered_position(fx.pairs(spark, sf_dir), ["shard"], [], "row_id", name="pos")
    c = c.withColumn("row_id", F.col("pos") - 1).drop("pos")
    return S.slice_of_shards(c, 1, 300).select("shard", "row_id", "instruction")


# Raw cells hold interleaved RGB: the fixture's bytes are read as rows of pixels.
_CELL_COORD = f"pxc as (select img_id, v, pos % 3 as c, pos // 3 // {SIDE} as y, pos // 3 % {SIDE} as x from pxl)"

_UNTYPED = (W(PAIRS, IMAGES, PX_LONG, _CELL_COORD, _resize_sql(SIDE, 4)) + """
, tiny as (select img_id, md5(unhex(string_agg(printf('%02x', v::INTEGER), '' order by c, y, x))) as h from small_px group by 1)
, c as (select p.shard, (row_number() over (partition by p.shard order by p.row_id) - 1)::BIGINT as row_id, p.instruction,
  row_number() over (order by p.shard, p.row_id) - 1 as pos, a.h as before_md5, b.h as after_md5
  from pairs p join tiny a on a.img_id = p.row_id % (select count(*) from part) join tiny b on b.img_id = (p.row_id + 1) % (select count(*) from part))
, s as (select * from c where pos >= 250 and pos < 500)
""")


@register("prepare_untyped", _UNTYPED + "select shard, row_id, instruction as prompt, before_md5, after_md5, 4::BIGINT as res from s")
def q_prepare_untyped(spark, sf_dir):
    """The untyped prep over corpus files: the second slice of 250 rows, both
    images resized 8 -> 4 px."""
    from .prep import prepare_untyped
    corpus = SC.scan_corpus(spark, _corpus_files(spark, sf_dir))
    out = prepare_untyped(corpus, 1, 250, res=4, shard_rows=SC.shard_rows(corpus))
    return out.select("shard", "row_id", "prompt", F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"),
                      F.col("res").cast("bigint").alias("res"))


@register("untyped_meta", _UNTYPED + """
select count(*)::BIGINT as n, least(30, count(*) // 10)::BIGINT as val_n, 4::BIGINT as res,
 array_to_string((select list(instruction order by shard, row_id) from (select * from s order by shard, row_id limit 20)), '|') as prompts
from s""")
def q_untyped_meta(spark, sf_dir):
    """S7 of an untyped slice: counts and a sample of its first prompts."""
    from .prep import prepare_untyped, untyped_meta
    corpus = SC.scan_corpus(spark, _corpus_files(spark, sf_dir))
    out = prepare_untyped(corpus, 1, 250, res=4, shard_rows=SC.shard_rows(corpus))
    return untyped_meta(out, 30).select("n", "val_n", "res", F.array_join("prompts_sample", "|").alias("prompts"))


@register("slices_overlap", W(PAIRS) + """
, h as (select distinct instruction, case row_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as slice from pairs)
, v as (select instruction, string_agg(slice, ',' order by slice) as slices from h group by 1)
select slices, count(*)::BIGINT as distinct_values from v group by 1""")
def q_slices_overlap(spark, sf_dir):
    """U2 over three slices: distinct instructions per set of slices that hold them."""
    p = fx.pairs(spark, sf_dir)
    return S.slices_overlap({name: p.where(F.col("row_id") % 3 == i) for i, name in enumerate("abc")})


@register("read_sidecars", W(PAIRS) + """
, pr as (select shard, (row_number() over (partition by shard order by row_id) - 1)::BIGINT as pos, instruction from pairs)
, ty as (select shard, (row_number() over (partition by shard order by row_id) - 1)::BIGINT as pos, edit_type_nullable as edit_type
  from pairs)
select pr.shard, pr.pos, pr.instruction, coalesce(ty.edit_type, '') as edit_type
from pr left join ty on ty.shard = pr.shard and ty.pos = pr.pos""")
def q_read_sidecars(spark, sf_dir):
    """S6 + J1: per-shard prompt and type sidecars joined by position (a short
    types list pads with '')."""
    p = fx.pairs(spark, sf_dir)
    prompts = SC.read_sidecar(SC.sidecar_arrays(p, "instruction"), "instruction")
    types = SC.read_sidecar(SC.sidecar_arrays(p, "edit_type_nullable"), "edit_type")
    return SC.join_sidecars(prompts, types, "train")


@register("write_meta", W(PAIRS) + """
select shard, sum(c)::BIGINT as n, least(30, sum(c) // 10)::BIGINT as val_n, 8::BIGINT as res, 'orders' as source,
 '{"n":' || sum(c)::VARCHAR || ',"val_n":' || least(30, sum(c) // 10)::VARCHAR || ',"res":8,"source":"orders","counts":{'
 || string_agg('"' || edit_type || '":' || c::VARCHAR, ',' order by edit_type) || '}}' as meta_json
from (select shard, edit_type, count(*) as c from pairs where decodable group by 1, 2) group by shard""")
def q_write_meta(spark, sf_dir):
    """The meta record of every shard of decodable rows."""
    return SC.write_meta(fx.pairs(spark, sf_dir).where(F.col("decodable")), 30, 8, "orders")


@register("sidecar_default", W(PAIRS) + "select row_id, coalesce(edit_type_nullable, '?') as label from pairs")
def q_sidecar_default(spark, sf_dir):
    """Missing type labels read as '?'."""
    return SC.sidecar_default(fx.pairs(spark, sf_dir)).select("row_id", "label")


@register("tolerant_scan", W(IMAGES) + """
select img_id // 100 as shard, count(*)::BIGINT as rows, count(*) filter (where img_id % 97 = 0)::BIGINT as bad,
 count(*) filter (where img_id % 97 <> 0)::BIGINT as good from images group by 1""")
def q_tolerant_scan(spark, sf_dir):
    """Unreadable image cells are dropped and counted per shard."""
    dec = IM.decode_images(_cells(spark, sf_dir), "image_file")
    return (dec.groupBy((F.col("img_id") / 100).cast("bigint").alias("shard"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                 F.count_if(~F.col("ok")).cast("bigint").alias("bad"),
                 F.count_if(F.col("ok")).cast("bigint").alias("good")))


def _packed(spark, sf_dir, shards=4):
    """Corpus pairs (decodable, with pixels) written as packed shards into a
    fresh folder under the shared checkpoint location; returns the folder."""
    from ..sources import packed as PK
    ci = corpus_images(spark, sf_dir).where(F.col("decodable"))
    rows = ci.select("row_id", F.col("px").alias("before"), F.col("after_px").alias("after"), "res",
                     "instruction", "edit_type")
    path = _scratch(spark, "packed")
    for half in (0, 1):  # appended twice: nothing written earlier is lost
        PK.write_packed_pairs(rows.where(F.col("row_id") % 2 == half), path, shards=shards, want_val=30, source="orders")
    return path


_PACKED = W(PAIRS, IMAGES) + ", packed as (select p.*, a.px as b, c.px as a from pairs p join images a on a.img_id = p.row_id % (select count(*) from part) "\
    "join images c on c.img_id = (p.row_id + 1) % (select count(*) from part) where p.decodable) "


@register("write_packed_pairs", _PACKED + """
select count(*)::BIGINT as n, max(8)::BIGINT as res, 'orders' as source, true as published, true as val_rule,
 count(*) filter (where edit_type = 'add')::BIGINT as n_add from packed""")
def q_write_packed_pairs(spark, sf_dir):
    """Packed export, one shard per task; the meta records of all shards
    (appended twice as two halves: both stay)."""
    path = _packed(spark, sf_dir)
    from ..sources import packed as PK
    meta = spark.read.json([p + "_meta.json" for p in PK.find_prefixes(path)])
    return meta.agg(F.sum("n").alias("n"), F.max("res").alias("res"), F.max("source").alias("source"),
                    (F.count(F.lit(1)) == 8).alias("published"),
                    F.bool_and(F.col("val_n") == F.least(F.lit(30), F.expr("n div 10"))).alias("val_rule"),
                    F.sum("counts.add").alias("n_add"))


@register("read_packed_pairs", _PACKED + f"""
select {_md5_sql('b')} as before_md5, {_md5_sql('a')} as after_md5, 8::BIGINT as res, instruction, edit_type from packed""")
def q_read_packed_pairs(spark, sf_dir):
    """Packed shards read back lazily, one partition per record range."""
    from ..sources import packed as PK
    back = PK.read_packed_pairs(spark, _packed(spark, sf_dir), records_per_partition=256)
    return back.select(F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"),
                       F.col("res").cast("bigint").alias("res"), "instruction", "edit_type")


@register("check_sizes", _PACKED + "select 'sizes' as check, true as ok, count(*)::BIGINT as records, 8::BIGINT as files from packed")
def q_check_sizes(spark, sf_dir):
    """V2: every packed images file holds whole records of the stated size."""
    found = CK.check_sizes(spark, _packed(spark, sf_dir), fx.IMAGE_SIDE)
    return found.groupBy("check").agg(F.bool_and("ok").alias("ok"), F.sum("records").alias("records"),
                                      F.count(F.lit(1)).alias("files"))


_SLICE_A = (W(PAIRS, D.SMAP_CTE, _pick_sql(PLAN_A, "pa"), D.quota_rows_sql("sa", "pa", "pa_quota")))


@register("union_shards", _SLICE_A + "select row_id, edit_type, shard as source_shard from sa")
def q_union_shards(spark, sf_dir):
    """Per-shard outputs under one root, read as one tagged table."""
    root = _scratch(spark, "shards")
    taken = _slice(spark, sf_dir, PLAN_A).select("row_id", "shard", "edit_type", "instruction")
    taken.write.partitionBy("shard").parquet(root)
    return SC.union_shards(spark, root).select("row_id", "edit_type", "source_shard")


@register("skip_if_complete", _SLICE_A + "select row_id, edit_type from sa")
def q_skip_if_complete(spark, sf_dir):
    """A slice is written once; the rerun finds it complete and does not
    make it again (the second ``make`` would fail)."""
    target = _scratch(spark, "slice")
    rows = _slice(spark, sf_dir, PLAN_A).select("row_id", "edit_type")
    have = SC.run_unless_complete(spark, target, 1, lambda: rows).count()

    def again():
        raise RuntimeError("a complete slice was made again")

    return SC.run_unless_complete(spark, target, have, again)


IMAGES_PER_BUCKET = 1 << 17


def _bucketed_images(spark, sf_dir):
    """Image pixels made once and kept by image, for joins that shuffle no image."""
    from ..sources import bucketed as BK
    folder, buckets = _scratch(spark, "images"), max(8, fx.table(spark, sf_dir, "part").count() // IMAGES_PER_BUCKET)
    imgs = fx.images_binary(spark, sf_dir).where(F.col("img_id").isNotNull())
    BK.write_bucketed(imgs, folder, buckets, ["img_id"])
    return BK.read_bucketed(spark, folder, buckets, ["img_id"], imgs.schema)


def _with_vectors(spark, sf_dir):
    """Packed pairs with the vector of embedding ``row_id mod n`` as 8 x 8 text vectors beside them,
    written slice by slice of row ids: beyond the files, disk holds the shuffles of one slice."""
    from ..sources import packed as PK
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", cut.alias("vectors"))
    pairs = fx.pairs(spark, sf_dir).where(F.col("decodable"))
    path = _scratch(spark, "packed")
    with shuffles_freed(spark):
        n, imgs = e.count(), _bucketed_images(spark, sf_dir)
        ci = _beside_images(spark, sf_dir, pairs, imgs, imgs.select("img_id", F.col("px").alias("after_px")))
        rows = ci.withColumn("vec_id", F.col("row_id") % n).join(e, "vec_id").select(
            "row_id", F.col("px").alias("before"), F.col("after_px").alias("after"), "res", "instruction", "edit_type", "vectors")
        for part in PK.row_slices(pairs):
            PK.write_packed_pairs(rows.where(part), path, shards=4, want_val=30, source="orders")
    return path


_WITH_VECTORS = (", v as (select vec_id, embedding as e, (select count(*) from embeddings) as n from embeddings), "
                 "facts as (select p.instruction, p.edit_type, v.e[1]::DOUBLE as first, v.e[37]::DOUBLE as middle, v.e[64]::DOUBLE as last "
                 "from packed p join v on v.vec_id = p.row_id % v.n) ")


@register("read_vectors", _PACKED + _WITH_VECTORS + """
select 8::BIGINT as seq_len, 8::BIGINT as dim, first, middle, last from facts""")
def q_read_vectors(spark, sf_dir):
    """The text vectors beside packed pairs, read range by range without the pixels."""
    from ..sources import packed as PK
    back = PK.read_vectors(spark, _with_vectors(spark, sf_dir), records_per_partition=512)
    return back.select(F.size("vectors").cast("bigint").alias("seq_len"), F.size(F.element_at("vectors", 1)).cast("bigint").alias("dim"),
                       *_three_values())


def _three_values():
    at = lambda i, j, name: F.element_at(F.element_at("vectors", i), j).cast("double").alias(name)
    return at(1, 1, "first"), at(5, 5, "middle"), at(8, 8, "last")


@register("read_packed_typed", _PACKED + _WITH_VECTORS + """
select instruction, edit_type, first, middle, last from facts where edit_type in ('add', 'replace')""")
def q_read_packed_typed(spark, sf_dir):
    """S4 + S10: packed pairs of some edit types with their vectors; where the
    session hands filters down, ranges without these types are not planned."""
    from ..sources import packed as PK
    back = PK.read_packed_pairs(spark, _with_vectors(spark, sf_dir), records_per_partition=512, vectors=True)
    return back.where(F.col("edit_type").isin("add", "replace")).select("instruction", "edit_type", *_three_values())


_POSITIONAL = (W(PAIRS, IMAGES) + """
, pr as (select shard, (row_number() over (partition by shard order by row_id) - 1)::BIGINT as pos, instruction from pairs)
, ty as (select shard, (row_number() over (partition by shard order by row_id) - 1)::BIGINT as pos, edit_type_nullable as edit_type
  from pairs)
, im as (select shard, (row_number() over (partition by shard order by row_id) - 1)::BIGINT as pos, row_id % (select count(*) from part) as img_id from pairs)
select im.shard::BIGINT as shard, im.pos, im.img_id, pr.instruction, coalesce(ty.edit_type, '') as edit_type
from im join pr on pr.shard = im.shard and pr.pos = im.pos left join ty on ty.shard = im.shard and ty.pos = im.pos""")


@register("positional_join", _POSITIONAL)
def q_positional_join(spark, sf_dir):
    """Images, prompts and types of each shard joined by position."""
    from ..operators.ordering import ordered_position
    p = fx.pairs(spark, sf_dir)
    prompts = SC.read_sidecar(SC.sidecar_arrays(p, "instruction"), "instruction")
    types = SC.read_sidecar(SC.sidecar_arrays(p, "edit_type_nullable"), "edit_type")
    img = p.select("shard", "row_id", (F.col("row_id") % fx.table(spark, sf_dir, "part").count()).alias("img_id"))
    img = ordered_position(img, ["shard"], [], "row_id", name="pos").withColumn("pos", F.col("pos") - 1)
    j = img.join(prompts, ["shard", "pos"]).join(types, ["shard", "pos"], "left")
    return j.select("shard", "pos", "img_id", "instruction",
                    F.coalesce("edit_type", F.lit("")).alias("edit_type"))


@register("positional_join_bucketed", _POSITIONAL)
def q_positional_join_bucketed(spark, sf_dir):
    """J1 repeated: the three tables bucketed once by (shard, position); their join has no exchange."""
    from ..operators.ordering import ordered_position
    from ..sources import bucketed as BK
    p = fx.pairs(spark, sf_dir)
    place = lambda df, order, *cols: ordered_position(df, ["shard"], [], order, name="pos").select(
        "shard", (F.col("pos") - 1).alias("pos"), *cols)
    n = fx.table(spark, sf_dir, "part").count()
    tables = {"images": place(p, "row_id", (F.col("row_id") % n).alias("img_id")), "prompts": place(p, "row_id", "instruction"),
              "types": place(p, "row_id", F.col("edit_type_nullable").alias("edit_type"))}
    read = {}
    for name, df in tables.items():
        folder = _scratch(spark, f"bucketed-{name}")
        BK.write_bucketed(df, folder, 8)
        read[name] = BK.read_bucketed(spark, folder, 8)
    return BK.join_by_position(**read).select("shard", "pos", "img_id", "instruction", "edit_type")


# ------------------------------------------------------------ streaming (2.12)

@register("stream_ingest", _SLICE_A + "select row_id, shard, edit_type from sa")
def q_stream_ingest(spark, sf_dir):
    """G1: shards arriving as files, ingested under plan A; equals the batch
    ``quota_rows`` of the planned shards."""
    from ..streaming import ingest as G
    from .catalog import _plan
    base = _scratch(spark, "stream")
    p = fx.pairs(spark, sf_dir)
    # a file holds the whole shards of a range, at most about a million rows: files grow with the corpus, not with the shards
    p.repartitionByRange(32, "shard").write.option("maxRecordsPerFile", 1 << 20).parquet(f"{base}/in")
    out = G.stream_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", PLAN_A[0], p.schema,
                          files_per_trigger=8, shards=SH.taken_shards(_plan(spark, sf_dir, PLAN_A)))
    return out.select("row_id", "shard", "edit_type")


@register("stream_ingest_stateful", _SLICE_A + "select row_id, shard, edit_type from sa")
def q_stream_ingest_stateful(spark, sf_dir):
    """G1 with keyed state: planned shards arrive in two runs of the stream; the
    second goes on with the quotas left in the state store."""
    from ..streaming.quota_state import stateful_ingest
    from .catalog import _plan
    base = _scratch(spark, "stream")
    p = fx.pairs(spark, sf_dir)
    shards = _as_files(spark, SH.taken_shards(_plan(spark, sf_dir, PLAN_A)), "plan")
    middle = shards.agg(F.percentile_approx("shard", 0.5)).first()[0] or 0
    for first in (True, False):
        part = p.where((F.col("shard") <= middle) == first)
        part.coalesce(4).write.mode("append").parquet(f"{base}/in")
        out = stateful_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", PLAN_A[0], p.schema, files_per_trigger=8, shards=shards)
    return out.select("row_id", "shard", "edit_type")


@register("quota_rows_decoded", W(PAIRS, IMAGES) + """
select row_id, shard, edit_type, type_pos from (select p.row_id, p.shard, p.edit_type,
 row_number() over (partition by p.edit_type order by p.shard, p.row_id)::BIGINT as type_pos
 from pairs p join images i on i.img_id = p.row_id % (select count(*) from part)
 where p.edit_type in ('add', 'tune_transfer', 'style_change') and i.img_id % 97 <> 0)
where type_pos <= case edit_type when 'add' then 150 when 'tune_transfer' then 100 else 60 end""")
def q_quota_rows_decoded(spark, sf_dir):
    """R2, two-phase: quota rows whose images must decode, decoding only the
    candidates (quota + slack) and widening the slack for short types."""
    from ..operators import shards as SHD
    cells = _cells(spark, sf_dir)
    pairs = fx.pairs(spark, sf_dir).select("row_id", "shard", "edit_type")
    corpus = _as_files(spark, _beside_images(spark, sf_dir, pairs, cells, cells.select("img_id")), "cells")
    quota = SHD.quota_table(spark, {"add": 150, "tune_transfer": 100, "style_change": 60})
    out = S.quota_rows_decoded(corpus, quota, "image_file", slack=0.02)
    return out.select("row_id", "shard", "edit_type", "type_pos")


def _as_files(spark, df, name: str):
    """A fixture as a written corpus, so that later passes prune its columns."""
    path = _scratch(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


PLAN_PREP = ({"add": 150, "tune_transfer": 100, "style_change": 60}, 1)


def _prep_corpus(spark, sf_dir):
    """Corpus rows with before/after cells (one image in 97 is cut short)."""
    cells = _cells(spark, sf_dir)
    return _beside_images(spark, sf_dir, fx.pairs(spark, sf_dir), cells, cells.withColumnRenamed("image_file", "edited_file"))


@register("prepare_slice", W(PAIRS, IMAGES, D.quota_cte("pq", PLAN_PREP[0])) + """
, corpus as (select * from pairs)
, smap2 as (select shard, edit_type, count(*)::BIGINT as n from corpus group by 1, 2)
, wanted as (select s.shard, s.edit_type, s.n, k.quota from smap2 s join pq k on k.edit_type = s.edit_type)
, cut as (select max(shard) as c from (select distinct shard from wanted order by shard limit 1))
, post as (select * from wanted where shard > (select c from cut))
, picked as (select w.shard from post w where (select coalesce(sum(p.n), 0) from post p
   where p.edit_type = w.edit_type and p.shard < w.shard) < w.quota)
, ranked as (select c.row_id, c.shard, c.edit_type, c.instruction, k.quota,
   row_number() over (partition by c.edit_type order by c.shard, c.row_id)::BIGINT as type_pos
   from corpus c join pq k on k.edit_type = c.edit_type
   where c.shard in (select shard from picked) and c.row_id % (select count(*) from part) % 97 <> 0 and (c.row_id + 1) % (select count(*) from part) % 97 <> 0)
select row_id, shard, edit_type, instruction, type_pos, 48::BIGINT as before_bytes, 48::BIGINT as after_bytes, 4::BIGINT as res
from ranked where type_pos <= quota""")
def q_prepare_slice(spark, sf_dir):
    """The prep job: shards for a quota (skipping one), pruned read, decoded
    quota over both images, both resized 8 -> 4 px."""
    from .prep import prepare_slice
    out = prepare_slice(_as_files(spark, _prep_corpus(spark, sf_dir), "corpus"), PLAN_PREP[0], skip_shards=PLAN_PREP[1], res=4)
    return out.select("row_id", "shard", "edit_type", "instruction", "type_pos",
                      F.octet_length("before").cast("bigint").alias("before_bytes"),
                      F.octet_length("after").cast("bigint").alias("after_bytes"),
                      F.col("res").cast("bigint"))
