"""Joins of streams: as-of, tolerance band, arrival zip, active arm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import by


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, out: str, forward: bool = False) -> DataFrame:
    """left with ``out``: value of the right row at or before (forward: at or after) its time, by key.

    One union and one window: no join condition on a range, so no row is compared with many.
    At equal times the right row counts; of right rows at one time the largest value does.
    """
    right = right.groupBy(key, ts).agg(F.max(value).alias("_v"))
    both = left.withColumn("_v", F.lit(None).cast(right.schema["_v"].dataType)).withColumn("_l", F.lit(1)).unionByName(right.withColumn("_l", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(ts) if forward else F.asc(ts), "_l").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_l = 1").drop("_v", "_l")


def band(left: DataFrame, right: DataFrame, key: str, ts: str, tolerance: int) -> DataFrame:
    """Pairs (key, l_ts, l_id, r_ts, r_id) of the nearest right row within tolerance of each left row.

    Inputs have key, ts and id. Times are cut into slots of the tolerance; a left row looks into its own
    slot and both neighbours, so the join is on equality. Ties go to the earlier time, then the smaller id.
    """
    slot = F.floor(F.col(ts) / tolerance)
    a = left.select(key, F.col(ts).alias("l_ts"), F.col("id").alias("l_id"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("_slot"))
    b = right.select(key, F.col(ts).alias("r_ts"), F.col("id").alias("r_id"), slot.alias("_slot"))
    near = a.join(b, [key, "_slot"]).where(F.abs(F.col("l_ts") - F.col("r_ts")) <= tolerance)
    best = F.min(F.struct(F.abs(F.col("l_ts") - F.col("r_ts")).alias("d"), "r_ts", "r_id"))
    return near.groupBy(key, "l_ts", "l_id").agg(best.alias("b")).select(key, "l_ts", "l_id", "b.r_ts", "b.r_id")


def arrival_zip(arms: DataFrame, key: str, arm: str, order: str, value: str, names: list[str]) -> DataFrame:
    """(key, step, one column per arm): the n-th rows of all arms together; an ended arm gives null."""
    numbered = arms.where(F.col(arm).isin(*names)).withColumn("step", F.row_number().over(by([key, arm], order)))
    return numbered.groupBy(key, "step").agg(*(F.max(F.when(F.col(arm) == n, F.col(value))).alias(n) for n in names))


def mix(zipped: DataFrame, names: list[str], low: int = -32768, high: int = 32767) -> "F.Column":
    """Saturated sum of the arms of a step that are there."""
    total = sum((F.coalesce(F.col(n), F.lit(0)) for n in names[1:]), F.coalesce(F.col(names[0]), F.lit(0)))
    return F.greatest(F.lit(low), F.least(F.lit(high), total))


def active_arm(df: DataFrame, key: str, order: str, command, arm: str) -> DataFrame:
    """Rows of the arm that the last command before or at them names (``command``: null on other rows)."""
    now = F.last(command, ignorenulls=True).over(by(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("active", now).where(F.col("active") == F.col(arm))
