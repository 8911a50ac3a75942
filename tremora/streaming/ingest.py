"""Incremental upkeep of the panel from daily files as they land.

The batch operators read a complete history; these queries keep their inputs
current: cleaned log returns per row, and per-asset coverage by month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tremora.operators.panel import simple_to_log
from tremora.session import shared_dir
from tremora.sources.daily import DAILY


def daily_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(DAILY)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def returns_stream(daily: DataFrame, late: str = "7 days") -> DataFrame:
    """Log returns, each asset and day once even if a file is delivered again."""
    rows = daily.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late)
    return simple_to_log(rows.dropDuplicatesWithinWatermark(["permno", "date"])).select("permno", "date", "x")


def coverage_stream(daily: DataFrame, late: str = "7 days") -> DataFrame:
    """Observed returns and dollar volume per asset over 30-day windows."""
    rows = daily.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late)
    return (
        rows.where("ret IS NOT NULL").groupBy("permno", F.window("ts", "30 days"))
        .agg(F.count("ret").alias("n_obs"), F.avg(F.abs("prc") * F.col("vol")).alias("adv"))
        .select("permno", F.col("window.start").cast("date").alias("start"), "n_obs", "adv")
    )


def append_to(stream: DataFrame, path: str, name: str, mode: str = "append") -> StreamingQuery:
    """Run over everything available, exactly once, and stop; progress lives in the shared folder."""
    return (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", f"{shared_dir(stream.sparkSession)}/streams/{name}")
        .trigger(availableNow=True).start()
    )
