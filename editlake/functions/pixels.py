"""Pixel work as Spark SQL array expressions (``transform``/``aggregate``).

Images are CHW arrays of length ``3*side*side``. These forms are exact and
stay JVM-side; they are practical at small sides (fixtures, thumbnails,
checks). The production path for large images is the Arrow-batched NumPy job
in ``operators.images``; tests assert the two agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the source project's exact edits)
# ---------------------------------------------------------------------------
LUMA = (0.299, 0.587, 0.114)
SEPIA_TINT = (1.07, 0.94, 0.72)
WARM_TINT = (1.12, 1.0, 0.85)
COOL_TINT = (0.85, 0.98, 1.15)
BRIGHTER = (0.75, 0.35)         # x * a + b
DARKER = (0.75, -0.3)           # x * a + b  (written x * .75 - .3)
MORE_COLORFUL = 1.9             # L + k (x - L)
LESS_COLORFUL = 0.35
HIGH_CONTRAST = 1.7
LOW_CONTRAST = 0.5
BLUR_SIGMA = 2.5
SHARPEN_SIGMA = 1.5
SHARPEN_AMOUNT = 1.2

SQL_EDITS = ["black_and_white", "sepia_vintage", "brighter", "darker", "more_colorful",
             "less_colorful", "warmer", "cooler", "inverted", "high_contrast", "low_contrast"]


def normalize(px: Column) -> Column:
    """I4: uint8 -> [-1, 1] as ``v / 127.5 - 1`` (double)."""
    return F.transform(px, lambda v: v / F.lit(127.5) - F.lit(1.0))


def denormalize(x: Column) -> Column:
    """I4 back: clamp, +1, * 127.5, truncate."""
    return F.transform(x, lambda v: F.floor((F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0))
                                             + F.lit(1.0)) * F.lit(127.5)).cast("int"))


def _clamp(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0))


def _at(x: Column, idx: Column) -> Column:
    return F.element_at(x, (idx + F.lit(1)).cast("int"))


def bind(x: Column, body) -> Column:
    """Evaluate ``x`` once and pass it to ``body`` as a lambda variable.

    Catalyst inlines a projected array into every reference of it; when the
    array is itself computed (a view, another ``transform``), indexing it
    192 times would recompute it 192 times. Binding through a one-element
    ``transform`` evaluates it once per row.
    """
    return F.element_at(F.transform(F.array(x), body), 1)


def half_away(y: Column) -> Column:
    """``y`` (double) rounded to the nearest whole number, halves away from zero,
    as bigint. Exact like ``F.round(y, 0)``, which makes a decimal of every value."""
    whole = y.cast("bigint")
    return whole + ((y - whole) * F.lit(2.0)).cast("bigint")


def rounded(x: Column, digits: int) -> Column:
    """``F.round(x, digits)``, which makes a decimal of every value, only for the
    values where plain arithmetic might differ: near a half, huge or not finite."""
    unit = F.lit(float(10 ** digits))
    y = x * unit
    plain = (F.abs(y) < 1e9) & (F.abs(F.abs(y) % F.lit(1.0) - F.lit(0.5)) > 1e-6)
    return F.when(plain, half_away(y) / unit).otherwise(F.round(x, digits))


def synthetic_sql(x: Column, edit: str, side: int) -> Column:
    """One of the 11 per-pixel exact edits over a normalized CHW array."""
    return bind(x, lambda a: _synthetic_sql(a, edit, side))


def _synthetic_sql(x: Column, edit: str, side: int) -> Column:
    """The edit over the three planes of ``x``: arrays are cut, zipped and put
    together whole, so the lambda of a pixel holds its arithmetic alone."""
    hw = side * side
    planes = [F.slice(x, c * hw + 1, hw) for c in range(3)]
    luma = F.zip_with(F.zip_with(planes[0], planes[1], lambda r, g: F.lit(LUMA[0]) * r + F.lit(LUMA[1]) * g),
                      planes[2], lambda rg, b: rg + F.lit(LUMA[2]) * b)
    grey = bind(luma, lambda g: F.concat(g, g, g))
    scaled = lambda p, k: F.transform(p, lambda v: _clamp(v * F.lit(k)))
    tint = lambda per_plane, coeffs: F.concat(*map(scaled, per_plane, coeffs))
    colour = lambda k: F.zip_with(F.slice(x, 1, 3 * hw), grey, lambda v, g: _clamp(g + (v - g) * F.lit(k)))
    scale = lambda body: F.transform(F.slice(x, 1, 3 * hw), body)
    return {
        "black_and_white": lambda: grey,
        "sepia_vintage": lambda: bind(luma, lambda g: tint([g, g, g], SEPIA_TINT)),
        "brighter": lambda: scale(lambda v: _clamp(v * F.lit(BRIGHTER[0]) + F.lit(BRIGHTER[1]))),
        "darker": lambda: scale(lambda v: _clamp(v * F.lit(DARKER[0]) + F.lit(DARKER[1]))),
        "more_colorful": lambda: colour(MORE_COLORFUL),
        "less_colorful": lambda: colour(LESS_COLORFUL),
        "warmer": lambda: tint(planes, WARM_TINT),
        "cooler": lambda: tint(planes, COOL_TINT),
        "inverted": lambda: scale(lambda v: -v),
        "high_contrast": lambda: scale(lambda v: _clamp(v * F.lit(HIGH_CONTRAST))),
        "low_contrast": lambda: scale(lambda v: v * F.lit(LOW_CONTRAST)),
    }[edit]()


def flip(x: Column, side: int) -> Column:
    """Mirror the last axis of a CHW array: out[c,y,x] = in[c,y,w-1-x]."""
    n = 3 * side * side
    return bind(x, lambda a: F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: _at(a, i - i % F.lit(side) + F.lit(side - 1) - i % F.lit(side))))


def hwc_to_chw(x: Column, side: int) -> Column:
    """Interleaved HWC -> planar CHW: out[c*hw + s] = in[s*3 + c]."""
    hw = side * side
    places = F.array(*[F.lit(s * 3 + c + 1) for c in range(3) for s in range(hw)])  # folded to one literal
    return bind(x, lambda a: F.transform(places, lambda i: F.element_at(a, i)))



def array_mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)


def array_std(x: Column) -> Column:
    """Sample standard deviation (n - 1), two passes."""
    def body(a, m):
        ss = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m))
        return F.sqrt(ss / (F.size(a) - 1))
    # the mean is bound too: inside the second pass it would be taken anew for every value
    return bind(x, lambda a: bind(array_mean(a), lambda m: body(a, m)))


def abs_quantile(x: Column, q: float) -> Column:
    """Nearest-rank quantile of |x|, index = round-half-even(q * (n - 1))."""
    def body(a):
        k = F.bround(F.lit(q) * (F.size(a) - 1), 0).cast("int")
        # sort_array sorts without a comparator in SQL; nulls come last, as in array_sort
        return F.get(F.sort_array(F.array_compact(F.transform(a, lambda v: F.abs(v)))), k)
    return bind(x, body)


def digest(x: Column) -> tuple[Column, Column]:
    """Exact integer digest of a [-1,1] array: values rounded to 1e-6, their
    sum and their position-weighted sum (order-independent, exact to compare)."""
    qv = F.transform(x, lambda v: half_away(v * F.lit(1e6)))
    s1 = F.aggregate(qv, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    s2 = F.aggregate(F.zip_with(qv, F.sequence(F.lit(1), F.size(qv)), lambda v, i: v * i),
                     F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    return s1, s2


def digest_struct(x: Column) -> Column:
    """``digest`` with ``x`` evaluated once: struct(s1, s2). Select the struct
    into a column first, then its fields."""
    def body(a):
        s1, s2 = digest(a)
        return F.struct(s1.alias("s1"), s2.alias("s2"))
    return bind(x, body)


def u8_to_binary(px: Column) -> Column:
    """array<int 0..255> -> BINARY, JVM-side (hex pairs, then unhex)."""
    return F.unhex(F.concat_ws("", F.transform(px, lambda v: F.lpad(F.hex(v), 2, "0"))))
