"""Portable, partition-independent randomness.

``rand(seed)`` depends on partitioning, so a retried task or a different
cluster size draws differently and no oracle can repeat it. Here a uniform
in [0, 1) is the first 13 hex digits of ``md5('<seed>:<id>:<k>')`` over 2^52,
which any engine can recompute from the key alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = 4503599627370496.0


def uniform(seed: int | Column, key: Column, k: int | Column) -> Column:
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    k_c = k if isinstance(k, Column) else F.lit(str(k))
    text = F.concat_ws(":", seed_c.cast("string"), key.cast("string"), k_c.cast("string"))
    digits = F.substring(F.md5(text.cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(TWO_52)
