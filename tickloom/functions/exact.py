"""Exact decimal arithmetic with half-even results at scale 8, and deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unscaled(c: Column, scale: int) -> Column:
    """A non-negative decimal times 10^scale as an integer of up to 38 digits, whole part and rest apart, so that no type in between loses digits."""
    whole, rest = F.floor(c).cast(f"decimal({38 - scale},0)"), c % F.lit(1).cast("decimal(1,0)")
    up = F.lit(10**scale).cast(f"decimal({scale + 1},0)")
    return (whole * up).cast("decimal(38,0)") + (rest * up).cast("decimal(38,0)")


def half_even(num: Column, den: Column) -> Column:
    """num / den of integers (num >= 0, den > 0) to the nearest integer, ties to even."""
    q, rest = F.call_function("div", num, den).cast("decimal(20,0)"), num % den
    twice = rest.cast("decimal(37,0)") * F.lit(2)
    return q + F.when((twice > den) | ((twice == den) & (q % 2 == 1)), 1).otherwise(0)


def ratio8(num: Column, den: Column) -> Column:
    """num / den, exactly half-even at scale 8: num below 10^22 with 16 digits after the point, den positive below 10^20 with 8.

    A plain division has 12 digits after the point, rounded. Rounding them again, half-even, is wrong only where they say a tie that they were
    rounded to; such rows, and numbers too long for it, are divided as integers.
    """
    n, d = num.cast("decimal(38,16)"), den.cast("decimal(28,8)")
    long = half_even(_unscaled(F.abs(n), 16), _unscaled(d, 8)).cast("decimal(20,0)") * F.lit("0.00000001").cast("decimal(8,8)")
    long = F.when(n < 0, -long).otherwise(long).cast("decimal(28,8)")
    short = n.cast("decimal(34,16)") / d
    tie = F.abs(short % F.lit("0.00000001").cast("decimal(8,8)")) == F.lit("0.000000005").cast("decimal(12,12)")
    fits = F.abs(n) < F.lit(10**18).cast("decimal(19,0)")
    return F.when(fits & ~tie, F.bround(short, 8).cast("decimal(28,8)")).otherwise(long)


def event_id(*parts: Column) -> Column:
    """An id that depends on what it names only."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def uuid7_millis(c: Column) -> Column:
    """The time in a version 7 UUID: its first 48 bits."""
    return F.conv(F.substring(F.regexp_replace(c, "-", ""), 1, 12), 16, 10).cast("bigint")


def topic(name: Column, version: Column, prefix: str = "features.") -> Column:
    return F.concat(F.lit(prefix), name, F.lit("."), version)


def table_name(name: Column) -> Column:
    return F.concat(F.lit("features_"), F.regexp_replace(F.lower(name), "[.-]", "_"))


def path_segment(c: Column) -> Column:
    """Only [A-Za-z0-9._-]; blank or dots alone become _unknown."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9._-]", "_")
    return F.when(F.regexp_replace(clean, "[.]", "") == "", F.lit("_unknown")).otherwise(clean)
