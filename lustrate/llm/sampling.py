"""Samples by the hash of a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sampled(key: str, share: Column | float) -> Column:
    """True for about ``share`` of all keys, the same ones each time; shares down to 2 ** -53 are told
    apart, so a bounded sample of any table that memory and disk can hold is not empty."""
    whole = share if isinstance(share, Column) else F.lit(float(share))
    return F.shiftrightunsigned(F.xxhash64(key), 11).cast("double") < whole * 2.0**53
