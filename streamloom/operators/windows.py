"""Operators over one stream in order: gaps, unwrapping, epochs, runs, drop and limit policies.

All are window functions partitioned by stream, so a plan has one shuffle on the stream key, and several
of them on one DataFrame share it. ``order`` must be total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by(key, order, desc: bool = False):
    cols = order if isinstance(order, (list, tuple)) else [order]
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*(F.desc(c) if desc else F.asc(c) for c in cols))


def upto(key, order):
    return by(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(key, order):
    return by(key, order).rowsBetween(Window.unboundedPreceding, -1)


def first_n(df: DataFrame, key, order, n: int) -> DataFrame:
    """The first n rows of each key (a full queue refuses what comes)."""
    return df.withColumn("_n", F.row_number().over(by(key, order))).where(F.col("_n") <= n).drop("_n")


def last_n(df: DataFrame, key, order, n: int) -> DataFrame:
    """The last n rows of each key (a full queue evicts its head)."""
    return df.withColumn("_n", F.row_number().over(by(key, order, desc=True))).where(F.col("_n") <= n).drop("_n")


def unwrap(df: DataFrame, key: str, order: str, value: str, bits: int, out: str) -> DataFrame:
    """df with ``out``: the modular counter made monotone by adding signed steps to the first value."""
    size, half = 1 << bits, 1 << (bits - 1)
    step = (F.col(value) - F.lag(value).over(by(key, order)) + size) % size
    step = F.when(step >= half, step - size).otherwise(step)
    df = df.withColumn("_step", F.coalesce(step, F.col(value)))
    return df.withColumn(out, F.sum("_step").over(upto(key, order))).drop("_step")


def epochs(df: DataFrame, key: str, order: str, flag: str, out: str = "epoch") -> DataFrame:
    """df with the number of flagged rows so far in its stream, its own included."""
    return df.withColumn(out, F.sum(F.col(flag).cast("long")).over(upto(key, order)))


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, run, value, n, first): runs of equal values; nulls equal each other."""
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(by(key, order)))
    df = df.withColumn("_c", F.when(F.row_number().over(by(key, order)) == 1, 1).otherwise(changed.cast("int")))
    df = df.withColumn("run", F.sum("_c").over(upto(key, order)))
    return df.groupBy(key, "run").agg(F.first(value).alias("value"), F.count("*").alias("n"), F.min(order).alias("first"))


def expand_runs(df: DataFrame, key: str, order: str, count: str, value: str) -> DataFrame:
    """(key, at, value): one row for each of a run's count, ``at`` running over the runs of a key."""
    start = F.coalesce(F.sum(count).over(before(key, order)), F.lit(0))
    df = df.where(F.col(count) > 0).withColumn("_start", start)
    return df.select(key, F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col(count) - 1)).alias("at"), value)


def open_after(df: DataFrame, key: str, order: str, boundary, always) -> DataFrame:
    """Rows from the first boundary row of a stream on, and those for which ``always`` holds."""
    opened = F.max(boundary.cast("int")).over(upto(key, order)) == 1
    return df.withColumn("_o", opened).where(F.col("_o") | always).drop("_o")


def running_max(df: DataFrame, key: str, order, value: str, out: str) -> DataFrame:
    """df with the largest value of the rows before."""
    return df.withColumn(out, F.max(value).over(before(key, order)))


def nack_pairs(numbers, bits: int = 16):
    """Array of (first, mask) from an array of missing numbers in order: a mask has the sixteen numbers after its first;
    one that is told again adds nothing; numbers go round."""
    empty = F.array().cast("array<struct<first:bigint,mask:bigint>>")

    def add(pairs, x):
        last = F.element_at(pairs, -1)
        ahead = F.pmod(x - last.first, F.lit(1 << bits))
        new = F.concat(pairs, F.array(F.struct(x.cast("long").alias("first"), F.lit(0).cast("long").alias("mask"))))
        bit = F.lit(1).cast("long") * F.pow(F.lit(2), ahead - 1).cast("long")
        marked = F.concat(F.slice(pairs, 1, F.size(pairs) - 1), F.array(F.struct(last.first.alias("first"), last.mask.bitwiseOR(bit).alias("mask"))))
        return F.when((F.size(pairs) == 0) | (ahead > 16), new).when(ahead == 0, pairs).otherwise(marked)

    return F.aggregate(numbers, empty, add)
