"""Hash draws: the same row gets the same number under any partitioning, and in any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def draw(seed: int | Column | str, *keys: Column) -> Column:
    """Number in [0, 1) from the first 32 bits of md5 over ``seed:key:key...``."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws(":", seed_col.cast("string"), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def digest(seed: int | Column | str, *keys: Column) -> Column:
    """Full md5 text over ``seed:key:key...``, used as a shuffling order."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed_col.cast("string"), *[k.cast("string") for k in keys]))
