"""Asset selection: rankings by coverage or dollar volume, quintiles and stratified subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora.session import attach, global_rank


def top_by(ranking: DataFrame, n: int, measure: str, largest: bool = True) -> DataFrame:
    """The ``n`` assets with the largest (or smallest) measure, ties by asset.

    ``orderBy().limit()`` is a distributed top-k: tasks keep ``n`` rows each.
    """
    order = F.desc(measure) if largest else F.asc(measure)
    return ranking.orderBy(order, "asset").limit(n)


def adv_quintile(adv: DataFrame, n: int, which: int) -> DataFrame:
    """Slice ``which`` (1 = most liquid) of five; the last slice takes the remainder.
    """
    if which not in (1, 2, 3, 4, 5):
        raise ValueError(f"quintile must be 1..5, got {which}")
    total = adv.agg(F.count("*").alias("total"))
    size = F.greatest(F.lit(1), F.expr("total DIV 5"))
    start = F.lit(which - 1) * size
    end = start + size if which < 5 else F.col("total")
    stop = F.least(end, start + F.lit(n))
    return (
        attach(global_rank(adv, F.desc("adv"), F.asc("asset")), total)
        .where((F.col("rank0") >= start) & (F.col("rank0") < stop)).select("asset", "adv", "rank0")
    )


def select_assets(returns: DataFrame, adv: DataFrame | None, n: int, kind: str) -> DataFrame:
    """Dispatch by selection rule; volume rules only see assets of the panel."""
    if kind in ("coverage", "bottom_coverage"):
        cov = returns.groupBy("asset").agg(F.count("x").alias("n_obs"))
        return top_by(cov, n, "n_obs", kind == "coverage").select("asset")
    if adv is None:
        raise ValueError(f"{kind} needs a dollar-volume table")
    known = adv.join(returns.select("asset").distinct(), "asset", "left_semi")
    if kind in ("adv", "bottom_adv"):
        return top_by(known, n, "adv", kind == "adv").select("asset")
    if kind.startswith("decile") and kind[6:].isdigit():
        return adv_quintile(known, n, int(kind[6:])).select("asset")
    raise ValueError(f"unknown selection kind {kind!r}")


def mle_subset(returns: DataFrame, cal: DataFrame, size: int = 100, full: float = 0.99) -> DataFrame:
    """Alphabetically first ``size`` assets with near-full coverage.

    Without any such asset the best covered ones are taken instead.
    """
    n = cal.agg(F.count("*").alias("n_days"))
    cov = attach(returns.groupBy("asset").agg(F.count("x").alias("n_obs")), n).withColumn(
        "good", F.col("n_obs") >= F.col("n_days") * full)
    return (
        attach(cov, cov.agg(F.max("good").alias("found"))).where("good OR NOT found")
        .orderBy(F.when(~F.col("found"), -F.col("n_obs")), "asset").limit(size).select("asset")
    )


def sector_quotas(sizes: DataFrame, k: int) -> DataFrame:
    """``sector, size, quota``: shares of ``k`` by size, at least one and at most the size each.

    A shortfall goes to sectors with room in order of their fractional share, each
    filled up before the next. A surplus is taken off the tallest quotas one at a
    time, never below one. The quotas add up to ``k`` if ``k`` assets exist and no
    more sectors than ``k``.
    """
    one = Window.partitionBy(F.lit(1))  # one row per sector
    q = sizes.withColumn("share", F.col("size") * F.lit(float(k)) / F.sum("size").over(one))
    q = q.withColumn("base", F.least(F.col("size"), F.greatest(F.lit(1), F.floor("share"))))
    q = q.withColumn("over", F.sum("base").over(one) - F.lit(k)).withColumn("room", F.col("size") - F.col("base"))
    up = one.orderBy(F.desc(F.col("share") - F.floor("share")), F.desc("size"), "sector").rowsBetween(Window.unboundedPreceding, -1)
    q = q.withColumn("add", F.greatest(F.lit(0), F.least(F.col("room"), -F.col("over") - F.coalesce(F.sum("room").over(up), F.lit(0)))))
    slots = q.where("over > 0 AND base > 1").select("sector", "size", "over", F.explode(F.sequence(F.lit(2).cast("long"), F.col("base"))).alias("height"))
    tall = Window.partitionBy(F.lit(1)).orderBy(F.desc("height"), F.desc("size"), "sector")  # at most k rows
    cut = slots.withColumn("n", F.row_number().over(tall)).where("n <= over").groupBy("sector").agg(F.count(F.lit(1)).alias("cut"))
    return q.join(cut, "sector", "left").select("sector", "size", (F.col("base") + F.col("add") - F.coalesce("cut", F.lit(0))).alias("quota"))


def stratified_subset(assets: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` assets by sector quota; the draw orders each sector by a seeded hash, free of partitioning."""
    q = sector_quotas(assets.groupBy("sector").agg(F.count("*").alias("size")), k)
    draw = Window.partitionBy("sector").orderBy(F.xxhash64("asset", F.lit(seed)), "asset")
    return (
        assets.join(q.select("sector", "quota"), "sector")
        .withColumn("draw", F.row_number().over(draw)).where("draw <= quota").select("sector", "asset")
    )


def jaccard(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap of two selections per key: ``|A & B| / |A | B|``."""
    both = (
        a.select(*keys, "asset").withColumn("a", F.lit(1))
        .join(b.select(*keys, "asset").withColumn("b", F.lit(1)), keys + ["asset"], "full")
    )
    return both.groupBy(*keys).agg(
        F.count(F.expr("a + b")).alias("n_both"), F.count("*").alias("n_union"),
        F.count(F.expr("CASE WHEN b IS NULL THEN 1 END")).alias("only_a"),
        F.count(F.expr("CASE WHEN a IS NULL THEN 1 END")).alias("only_b"),
    ).withColumn("jaccard", F.col("n_both") / F.col("n_union"))
