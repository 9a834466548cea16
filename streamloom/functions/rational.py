"""Exact time arithmetic and media formulas as columns."""

from __future__ import annotations

from pyspark.sql import functions as F


def rescale(value, from_num: int, from_den: int, to_num: int, to_den: int):
    """value in units of from_num/from_den seconds, in units of to_num/to_den: exact, truncating toward
    zero, null where a base is invalid or the result leaves 64 bits."""
    if min(from_num, from_den, to_num, to_den) <= 0:
        return F.lit(None).cast("long")
    up, down = from_num * to_den, from_den * to_num
    wide = value.cast("decimal(38,0)")
    exact = F.floor(F.abs(wide * F.lit(up).cast("decimal(19,0)")) / F.lit(down).cast("decimal(19,0)"))
    return (exact * F.signum(wide).cast("int")).try_cast("long")


def whole_div(a, b):
    """Integer quotient toward zero of two integer columns."""
    return F.when(b != 0, (a - a % b) / b).cast("long")


def samples_ns(samples, rate):
    return whole_div(samples * F.lit(1_000_000_000), rate)


def ntp(micros):
    """64-bit NTP time of microseconds since 1970, as seconds and fraction."""
    seconds = F.floor(micros / 1_000_000)
    return (seconds + 2208988800).alias("ntp_seconds"), F.floor((micros - seconds * 1_000_000).cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(10,0)") / F.lit(1000000)).cast("long").alias("ntp_fraction")


def up_to(value, step: int):
    """value rounded up to a multiple of step."""
    return (F.ceil(value / step) * step).cast("long")
