"""Stand-in panels over the given tables: who plays asset, price, volume, sector and benchmark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.operators import panel as P
from tremora.session import materialize, values

# Twenty overlapping forty-week windows, seven of them crises.
N_WINDOWS, STEP_DAYS, SPAN_DAYS, FIRST_DAY = 20, 112, 279, "1995-01-02"
REGIMES = ["baseline", "stress", "crisis", "recovery", "crisis", "baseline", "crisis", "stress", "baseline",
           "crisis", "recovery", "stress", "crisis", "baseline", "stress", "crisis", "baseline", "recovery",
           "crisis", "stress"]


def window_rows():
    import datetime as dt

    d0 = dt.date.fromisoformat(FIRST_DAY)
    out = []
    for i in range(N_WINDOWS):
        s = d0 + dt.timedelta(days=STEP_DAYS * i)
        out.append((f"W{i + 1:02d}", str(s), str(s + dt.timedelta(days=SPAN_DAYS)), REGIMES[i]))
    return out


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def snapshots(spark: SparkSession) -> DataFrame:
    return values(spark, window_rows(), ["snapshot", "start", "end", "regime"], ["STRING", "DATE", "DATE", "STRING"])


def week(c: str):
    return F.date_trunc("week", c).cast("date")


def scan_supplier_weeks(spark, sf) -> DataFrame:
    """Weekly turnover and quantity per supplier."""
    return P.to_panel(table(spark, sf, "lineitem"), "l_suppkey", week("l_shipdate"),
                      price=F.sum("l_extendedprice"), volume=F.sum("l_quantity"))


def supplier_weeks(spark, sf) -> DataFrame:
    return stage(spark, sf, "weekly", scan_supplier_weeks)


def scan_nation_weeks(spark, sf) -> DataFrame:
    """Weekly turnover per nation: tasks sum line items per nation and week before the shuffle, suppliers have almost as many weeks as items."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return P.to_panel(table(spark, sf, "lineitem").join(s, "l_suppkey"), "s_nationkey", week("l_shipdate"),
                      price=F.sum("l_extendedprice"), volume=F.sum("l_quantity"))


def nation_weeks(spark, sf) -> DataFrame:
    """A row per nation and week, written once: no later step reads line items for it again."""
    return stage(spark, sf, "nation_weeks", scan_nation_weeks)


def weeks(spark, sf) -> DataFrame:
    """Calendar of weeks, written once."""
    return stage(spark, sf, "weeks", lambda s, f: P.calendar(table(s, f, "lineitem").select(week("l_shipdate").alias("date"))))


def nation_returns(spark, sf) -> DataFrame:
    cal = weeks(spark, sf)
    return P.log_diff(P.forward_fill(nation_weeks(spark, sf), cal))


def supplier_returns(spark, sf) -> DataFrame:
    cal = weeks(spark, sf)
    return P.log_diff(P.forward_fill(supplier_weeks(spark, sf), cal))


def sectors(spark, sf) -> DataFrame:
    """Sector of a nation: its region."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("asset"), F.col("r_name").alias("sector"))


def supplier_sectors(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.join(sectors(spark, sf), F.col("s_nationkey") == F.col("asset")).select(F.col("s_suppkey").alias("asset"), "sector")


def scan_benchmark(spark, sf) -> DataFrame:
    """Daily benchmark series: mean order value."""
    return (
        table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.avg("o_totalprice").alias("close"))
    )


def benchmark_daily(spark, sf) -> DataFrame:
    return stage(spark, sf, "benchmark", scan_benchmark)


_STAGES: dict[tuple, DataFrame] = {}


def stage(spark: SparkSession, sf: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Stage table written once per application and read by every later consumer."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGES:
        _STAGES[key] = materialize(build(spark, sf), name)
    return _STAGES[key]


def returns(spark, sf) -> DataFrame:
    return stage(spark, sf, "returns", nation_returns)


def window_panel(spark, sf) -> DataFrame:
    def build(spark, sf):
        return P.complete_cases(returns(spark, sf), snapshots(spark), weeks(spark, sf))

    return stage(spark, sf, "window_panel", build)
