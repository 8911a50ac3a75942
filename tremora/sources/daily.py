"""Readers and relational extracts for the daily record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAILY = ("permno BIGINT, date DATE, ret DOUBLE, retx DOUBLE, prc DOUBLE, openprc DOUBLE, askhi DOUBLE, "
         "bidlo DOUBLE, vol DOUBLE, shrout DOUBLE, cfacpr DOUBLE, cfacshr DOUBLE")
NAMES = "permno BIGINT, ticker STRING, comnam STRING, namedt DATE, nameenddt DATE, siccd INT"
MEMBERSHIP = "permno BIGINT, start DATE, ending DATE"
DELISTING = "permno BIGINT, dlstdt DATE, dlstcd INT, dlret STRING, dlretx STRING"


def daily(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily file with the date range pushed into the scan."""
    df = spark.read.parquet(path)
    df = df.withColumn("date", F.col("date").cast("date")) if dict(df.dtypes)["date"] != "date" else df
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def csv(spark: SparkSession, path: str, schema: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("dateFormat", date_format).csv(path)


def series(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Two-column benchmark file ``(Date, value)``, missing markers dropped."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        F.to_date("Date").alias("date"), F.col(value).try_cast("double").alias("close")).where("close IS NOT NULL")


def jdbc_daily(spark: SparkSession, url: str, table: str, start: str, end: str, lo: int, hi: int,
               partitions: int = 64, **options: str) -> DataFrame:
    """Daily table of a SQL source, read in parallel key ranges with the dates pushed down."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="permno", lowerBound=str(lo),
                                          upperBound=str(hi), numPartitions=str(partitions), **options).load()
        .where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    )


def overlapping(spells: DataFrame, start: str, end: str) -> DataFrame:
    """Membership spells that touch the closed range."""
    return spells.where((F.col("start") <= F.lit(end).cast("date")) & (F.col("ending") >= F.lit(start).cast("date")))


def valid_at(names: DataFrame, day: str) -> DataFrame:
    """Name rows valid on the day."""
    d = F.lit(day).cast("date")
    return names.where((F.col("namedt") <= d) & (F.col("nameenddt") >= d))


def for_members(facts: DataFrame, members: DataFrame) -> DataFrame:
    """Facts of listed keys; a semi join replaces batched IN lists."""
    return facts.join(members.select("permno").distinct(), "permno", "left_semi")


def explode_codes(cells: DataFrame, cell: str, key: str) -> DataFrame:
    """Distinct codes of a pipe- or comma-delimited list cell."""
    return (
        cells.select(key, F.explode(F.split(cell, r"[|,]")).alias("code"))
        .withColumn("code", F.trim("code")).where("code <> ''").distinct()
    )


def write_by_year(df: DataFrame, path: str) -> None:
    """Parquet partitioned by year so date ranges prune directories."""
    df.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(path)


def tidy_quotes(daily_rows: DataFrame, names: DataFrame, delisting: DataFrame) -> DataFrame:
    """Per-label quote rows with the delisting return as a last observation."""
    base = for_members(daily_rows, names).join(names.select("permno", "ticker"), "permno").select(
        F.upper("ticker").alias("ticker"), "date", F.abs("prc").alias("close"), F.col("vol").alias("volume"), "ret")
    gone = (
        for_members(delisting, names).join(names.select("permno", "ticker"), "permno")
        .select(F.upper("ticker").alias("ticker"), F.col("dlstdt").alias("date"),
                F.col("dlret").try_cast("double").alias("dlret")).where("dlret IS NOT NULL")
    )
    return (
        base.join(gone, ["ticker", "date"], "full")
        .withColumn("ret", F.when(F.col("dlret").isNull(), F.col("ret"))
                    .otherwise((1 + F.coalesce("ret", F.lit(0.0))) * (1 + F.col("dlret")) - 1))
        .drop("dlret")
    )
