"""Space-filling curves over quantised coordinates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .scalar import clamp

#: Codes are signed 64-bit numbers, so a curve has 63 bits at most.
MAX_BITS = 63


def bits_for(dims: int) -> int:
    """Bits for each dimension: 21, or as many as fit."""
    return min(21, MAX_BITS // dims)


def grid_resolution(spread: float, largest: int = 1 << 16) -> int:
    """A power of two near ten times the spread, between 256 and ``largest``."""
    power = 256
    while power < min(largest, spread * 10):
        power *= 2
    return min(power, largest)


def quantise(x: Column, low: Column | float, high: Column | float, resolution: int) -> Column:
    """Grid coordinate 0..resolution-1, truncated; a range of zero counts as one."""
    low, high = F.lit(low), F.lit(high)
    span = F.when(high > low, high - low).otherwise(1.0)
    return (clamp((x - low) / span, 0.0, 1.0) * (resolution - 1)).cast("bigint")


def morton(coords: Sequence[Column], bits: int) -> Column:
    """Bit b of dimension d is bit b * n + d of the code."""
    n = len(coords)
    if n * bits > MAX_BITS:
        raise ValueError(f"{n} dimensions of {bits} bits exceed {MAX_BITS} bits")
    code: Column = F.lit(0).cast("bigint")
    for d, c in enumerate(coords):
        for b in range(bits):
            bit = F.shiftright(c.cast("bigint"), b).bitwiseAND(F.lit(1).cast("bigint"))
            code = code.bitwiseOR(F.shiftleft(bit, b * n + d))
    return code


def morton_wide(coords: Sequence[Column], bits: int) -> tuple[Column, Column]:
    """(high, low) halves of a Z-order code whose bits do not fit one number; sort by both."""
    low_bits = MAX_BITS // len(coords)
    low = morton([c.cast("bigint").bitwiseAND(F.lit((1 << low_bits) - 1)) for c in coords], low_bits)
    high = morton([F.shiftright(c.cast("bigint"), low_bits) for c in coords], max(1, bits - low_bits))
    return high, low


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Distances along the Hilbert curve of rows of grid coordinates, by Skilling's transform; dimension 0 is the most significant."""
    x = coords.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, p = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] >> np.uint64(b)) & one, flip ^ np.uint64((1 << b) - 1), flip)
    x ^= flip
    code = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            code = (code << one) | ((x[i] >> np.uint64(b)) & one)
    return code.astype(np.int64)


def hilbert(coords: Sequence[Column], bits: int) -> Column:
    """The Hilbert index as a vectorised function: its bit rotations depend on all earlier bits, which no closed form expresses."""
    if len(coords) * bits > MAX_BITS:
        raise ValueError(f"{len(coords)} dimensions of {bits} bits exceed {MAX_BITS} bits")

    @F.pandas_udf(LongType())
    def index(*parts: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([p.to_numpy() for p in parts], 1), bits))

    return index(*coords)
