"""Command line: raw files in, stage tables and report out.

    spark-submit tremora/plans/run.py --daily ... --names ... --delisting ... --out ...
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora import config as C
from tremora.operators import panel as P
from tremora.operators import quality, stress
from tremora.plans import ledger
from tremora.plans.pipeline import Settings, StressPipeline, build_panel
from tremora.session import values
from tremora.sources import daily as S
from tremora.sources.store import StageStore, write_table


def study_windows(spark: SparkSession) -> DataFrame:
    return values(spark, C.SNAPSHOTS, ["snapshot", "start", "end", "regime"], ["STRING", "DATE", "DATE", "STRING"])


def study_cutoffs(spark: SparkSession) -> DataFrame:
    return values(spark, list(C.CUTOFFS.items()), ["asset", "cutoff"], ["STRING", "DATE"])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--daily", required=True)
    p.add_argument("--names", required=True)
    p.add_argument("--delisting", required=True)
    p.add_argument("--out", required=True, help="shared folder for stage tables and results")
    p.add_argument("--windows", help="CSV snapshot,start,end,regime; the built-in table otherwise")
    p.add_argument("--n-assets", type=int)
    p.add_argument("--force", action="store_true", help="rebuild stage tables")
    p.add_argument("--every-window", action="store_true", help="stop when a window has too few assets or rows")
    p.add_argument("--rolling-assets", type=int, default=50, help="best covered assets of the rolling index")
    p.add_argument("--parameters", help="parquet of pooled parameters that stay in force unless they moved")
    p.add_argument("--sweep", action="store_true", help="all selection rules and panel sizes instead of one run; resumes what is not done")
    p.add_argument("--extras", action="store_true", help="also the volume-weighted and rolling index")
    p.add_argument("--benchmark-old")
    p.add_argument("--benchmark-new")
    p.add_argument("--benchmark-cut", default="2003-09-22")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tremora").getOrCreate()
    info, _, returns, cal = build_panel(spark, a.daily, a.names, a.delisting)
    returns = P.mask_before(returns, study_cutoffs(spark))
    rows = S.daily(spark, a.daily).join(info.select("permno", "asset"), "permno")
    adv = P.dollar_volume(rows, F.col("prc"), F.col("vol"))
    snaps = S.csv(spark, a.windows, "snapshot STRING, start DATE, end DATE, regime STRING") if a.windows else study_windows(spark)
    s = Settings(n_assets=a.n_assets, every_window=a.every_window)
    if a.sweep:
        ledger.sweep(spark, f"{a.out}/sweep", returns, cal, snaps, info.select("asset", "sector"), adv, settings=s).orderBy("kind", "n").show(100, truncate=False)
        return
    before = spark.read.parquet(a.parameters) if a.parameters else None
    pipe = StressPipeline(spark, returns, cal, snaps, info.select("asset", "sector"), adv, s, StageStore(spark, f"{a.out}/stages", a.force), before)
    tables = pipe.run()
    if a.extras:
        tables["volume_weighted"] = pipe.volume_weighted()
        roll = stress.rolling_index(P.keep_assets(pipe.returns, _top(pipe.returns, a.rolling_assets)), cal)
        tables["rolling"] = roll
        if a.benchmark_old and a.benchmark_new:
            bench = P.splice_series(S.series(spark, a.benchmark_old, "VXOCLS"), S.series(spark, a.benchmark_new, "VIXCLS"), a.benchmark_cut)
            tables["backtest"] = stress.backtest(roll, bench)
    for name, df in tables.items():
        write_table(df, f"{a.out}/results/{name}", "parquet")
    write_table(quality.failures(spark.read.parquet(f"{a.out}/results/checks")), f"{a.out}/results/failures", "parquet")
    text = quality.markdown(spark.read.parquet(f"{a.out}/results/checks"))
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{a.out}/results/report")
    for name in ("network", "stress", "tests"):
        spark.read.parquet(f"{a.out}/results/{name}").show(50, truncate=False)


def _top(returns: DataFrame, n: int) -> DataFrame:
    from tremora.operators.selection import top_by

    return top_by(P.coverage(returns, "x"), n, "n_obs").select("asset")


if __name__ == "__main__":
    main()
