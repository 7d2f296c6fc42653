"""Column functions on positions and Morton keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 16


def _axis(c: Column, low: float, high: float) -> Column:
    if low is None or high is None or high == low:  # no rows, or an axis without width
        return F.lit(0).cast("long")
    cells = 1 << BITS
    at = F.floor((c - F.lit(low)) / F.lit(high - low) * F.lit(float(cells))).cast("long")
    return F.least(F.greatest(at, F.lit(0).cast("long")), F.lit(cells - 1).cast("long"))


def _spread(c: Column) -> Column:
    """Bit k of a 16-bit number to bit 2k; the masks are those of Morton codes."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def morton(x: Column, y: Column, bounds) -> Column:
    """32-bit key as a bigint, x on the odd bits; bounds is (min_x, max_x, min_y, max_y)."""
    x0, x1, y0, y1 = bounds
    return F.shiftleft(_spread(_axis(x, x0, x1)), 1).bitwiseOR(_spread(_axis(y, y0, y1)))


def common_prefix(a: Column, b: Column) -> Column:
    """Leading bits that two 32-bit keys share; 32 for equal keys."""
    return F.when(a == b, F.lit(32)).otherwise(32 - F.length(F.bin(a.bitwiseXOR(b))))


def uniform(key: Column, seed: int, salt: str) -> Column:
    """A number in [0, 1) that depends on the key alone, however rows are partitioned."""
    text = F.concat(key.cast("string"), F.lit(f":{seed}:{salt}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
