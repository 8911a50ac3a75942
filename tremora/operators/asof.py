"""As-of joins between two series over their union, with or without keys.

Rows are range-partitioned by key and date, so neither a long series nor a crowded
date ends in one task: a partition looks among its own rows, and what it needs from
before or after its borders comes from one row per partition and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora.session import materialize


def _stack(left: DataFrame, right: DataFrame, keys, left_first: bool):
    lf, rf = (0, 1) if left_first else (1, 0)
    l = left.select(*keys, "date", F.lit(lf).alias("ord"), F.lit(True).alias("is_left"),
                    F.struct(*[c for c in left.columns if c not in keys]).alias("l"))
    r = right.select(*keys, "date", F.lit(rf).alias("ord"), F.lit(False).alias("is_left"),
                     F.struct(F.col("date").alias("date"), *[c for c in right.columns if c not in keys and c != "date"]).alias("r"))
    return l.unionByName(r, allowMissingColumns=True)


def _around(both: DataFrame, keys, ahead: bool = False) -> DataFrame:
    """``both`` with the last ``r`` before each row as ``lo`` and, where asked for, the first after it as ``hi``."""
    k = list(keys)
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*k, "date", "ord", "seen"]
    cut = both.withColumn("seen", F.monotonically_increasing_id()).repartitionByRange(n, *order)
    cut = materialize(cut.withColumn("part", F.spark_partition_id()), "asof")
    at = F.when(F.col("r").isNotNull(), F.struct("date", "ord", "seen"))
    edge = cut.groupBy(*k, "part").agg(F.max_by("r", at).alias("last_r"), F.min_by("r", at).alias("first_r"))
    over = Window.partitionBy(*k).orderBy("part") if k else Window.orderBy("part")  # a row per partition that holds the key
    edge = edge.select(*k, "part", F.last("last_r", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("from_before"),
                       F.first("first_r", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("from_after"))
    w = Window.partitionBy(*k, "part").orderBy("date", "ord", "seen")
    lo = F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = cut.withColumn("lo", lo)
    if ahead:
        out = out.withColumn("hi", F.first("r", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    out = out.join(edge, [*k, "part"]).withColumn("lo", F.coalesce("lo", "from_before"))
    return out.withColumn("hi", F.coalesce("hi", "from_after")) if ahead else out


def backward(left: DataFrame, right: DataFrame, keys=(), strict: bool = False, tolerance_days: int | None = None) -> DataFrame:
    """Latest right row at or before (``strict``: before) each left row, as struct ``m``."""
    out = _around(_stack(left, right, keys, left_first=strict), keys).withColumn("m", F.col("lo")).where("is_left")
    if tolerance_days is not None:
        out = out.withColumn("m", F.when(F.datediff("date", "m.date") <= tolerance_days, F.col("m")))
    return out.select(*keys, "l.*", "m")


def nearest(left: DataFrame, right: DataFrame, keys=()) -> DataFrame:
    """Right row closest in days to each left row, the later one on a tie."""
    out = _around(_stack(left, right, keys, left_first=False), keys, ahead=True).where("is_left")
    back, ahead = F.datediff("date", "lo.date"), F.datediff("hi.date", "date")
    exact = F.col("lo.date") == F.col("date")
    pick = (F.when(F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull() | exact, F.col("lo"))
            .when(ahead <= back, F.col("hi")).otherwise(F.col("lo")))
    return out.withColumn("m", pick).select(*keys, "l.*", "m")
