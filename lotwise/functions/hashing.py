"""Portable randomness: order and draws from md5, the same in every engine and under every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts) -> Column:
    """md5 of the parts joined by colons; strings are literals, columns are cast."""
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def draw(h: Column, n) -> Column:
    """The digest's first 48 bits modulo n."""
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint") % n


def unit_interval(h: Column) -> Column:
    """The digest's first 48 bits as a number above 0 and below 1."""
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def normal(h: Column) -> Column:
    """A standard normal number from a digest, by Box and Muller."""
    u = (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    v = (F.conv(F.substring(h, 13, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)
