"""Inference over window metrics in long form ``(snapshot, regime, metric, value)``."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora.session import attach, global_rank, materialize

SLACK = 1e-12


def unpivot(wide: DataFrame, metrics: list[str]) -> DataFrame:
    return wide.unpivot(["snapshot", "regime"], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def permutation_test(metrics: DataFrame, keys=("metric",), slack: float = SLACK) -> DataFrame:
    """Exact one-sided test that the crisis mean exceeds the mean of the rest.

    All ``C(n, k)`` assignments are visited. Subset sums of each half of the
    windows are listed once (``2^(n/2)`` rows), then halves are joined on the
    matching number of chosen windows, so the work is an equi join followed by
    a partial aggregate.
    """
    g = list(keys)
    idx = Window.partitionBy(*g).orderBy("snapshot")
    is_c = (F.col("regime") == "crisis").cast("int")
    rows = metrics.withColumn("idx", F.row_number().over(idx) - 1).withColumn("c", is_c)
    per = rows.groupBy(*g).agg(
        F.count("*").cast("int").alias("n"), F.sum("c").cast("int").alias("k"), F.sum("value").alias("total"),
        F.sum(F.when(F.col("c") == 1, F.col("value"))).alias("c_obs"),
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("v"))
    per = per.withColumn("h", F.expr("n DIV 2"))

    def half(name: str, lo, size):
        part = F.slice("v", lo + 1, size)
        masks = F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), size).cast("int") - 1))
        return (
            per.select(*g, "n", "k", part.alias("part"), masks.alias("mask"))
            .withColumn(f"s_{name}", F.aggregate(
                F.transform("part", lambda x, i: F.when(F.expr("mask").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0, x).otherwise(F.lit(0.0))),
                F.lit(0.0), lambda acc, x: acc + x))
            .withColumn("chosen", F.bit_count("mask").cast("int")).select(*g, "k", "chosen", f"s_{name}")
        )

    low = half("lo", F.lit(0), F.col("h")).withColumn("need", F.col("k") - F.col("chosen")).drop("chosen", "k")
    high = half("hi", F.col("h"), F.col("n") - F.col("h")).withColumnRenamed("chosen", "need").drop("k")
    scale = per.select(*g, "n", "k", "total", "c_obs")
    both = low.join(high, g + ["need"]).join(scale, g)

    def diff(c):
        return c / F.col("k") - (F.col("total") - c) / (F.col("n") - F.col("k"))

    sums = F.col("s_lo") + F.col("s_hi")
    return both.groupBy(*g, "n", "k").agg(
        F.count("*").alias("n_perm"), F.count(F.when(diff(sums) >= diff(F.col("c_obs")) - slack, 1)).alias("n_ge"),
        F.first(diff(F.col("c_obs"))).alias("observed"),
    ).withColumn("p_value", F.col("n_ge") / F.col("n_perm"))


def adjust(pvals: DataFrame, family=()) -> DataFrame:
    """Benjamini-Hochberg, Benjamini-Yekutieli and Hochberg adjusted p-values."""
    f = list(family)
    part = Window.partitionBy(*f) if f else Window.partitionBy(F.lit(1))
    up = part.orderBy("p_value", "metric")
    down = up.rowsBetween(0, Window.unboundedFollowing)
    m = F.count("*").over(part)
    t = pvals.withColumn("rank", F.row_number().over(up)).withColumn("m", m)
    harmonic = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col("m")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    bh_raw = F.col("p_value") * F.col("m") / F.col("rank")
    t = t.withColumn("bh", F.least(F.lit(1.0), F.min(bh_raw).over(down)))
    t = t.withColumn("hochberg", F.least(F.lit(1.0), F.min((F.col("m") - F.col("rank") + 1) * F.col("p_value")).over(down)))
    return t.withColumn("by", F.least(F.lit(1.0), F.min(bh_raw * harmonic).over(down))).drop("rank", "m")


def cohen_d(metrics: DataFrame) -> DataFrame:
    """Pooled effect size of crisis against the rest; infinite without spread."""
    c = F.col("regime") == "crisis"
    a, b = F.when(c, F.col("value")), F.when(~c, F.col("value"))
    t = metrics.groupBy("metric").agg(
        F.avg(a).alias("mc"), F.avg(b).alias("mo"), F.var_samp(a).alias("vc"), F.var_samp(b).alias("vo"),
        F.count(a).alias("nc"), F.count(b).alias("no"))
    pooled = F.sqrt(((F.col("nc") - 1) * F.col("vc") + (F.col("no") - 1) * F.col("vo")) / (F.col("nc") + F.col("no") - 2))
    gap = F.col("mc") - F.col("mo")
    inf = F.when(gap > 0, F.lit(float("inf"))).when(gap < 0, F.lit(float("-inf"))).otherwise(0.0)
    return t.withColumn("d", F.when(pooled < 1e-12, inf).otherwise(gap / F.nullif(pooled, F.lit(0.0)))).select(
        "metric", F.col("mc").alias("crisis_mean"), F.col("mo").alias("other_mean"), "d")


def regime_means(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("metric", "regime").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))


def power_lattice(effects: DataFrame, pvals: DataFrame) -> DataFrame:
    """Metrics with a positive effect, ordered by p-value."""
    return effects.where("d > 0").join(pvals, "metric").orderBy("p_value", "metric")


def bonferroni_threshold(m: int, alpha: float = 0.05) -> float:
    return NormalDist().inv_cdf(1 - alpha / (2 * m))


def bonferroni_scan(z: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Absolute z per axis and window against the per-axis and pooled thresholds.

    ``z`` is ``(snapshot, axis, z)``; thresholds depend on the number of tests,
    counted here and turned into quantiles by a small lookup of that count.
    """
    axis = Window.partitionBy("axis")
    every = Window.partitionBy(F.lit(1))
    t = z.where("z IS NOT NULL").withColumn("m_axis", F.count("*").over(axis)).withColumn("m_all", F.count("*").over(every))

    @F.pandas_udf("double")
    def threshold(m: pd.Series) -> pd.Series:
        table = {int(v): NormalDist().inv_cdf(1 - alpha / (2 * int(v))) for v in m.unique()}
        return m.map(table)

    return (
        t.withColumn("th_axis", threshold("m_axis")).withColumn("th_all", threshold("m_all"))
        .withColumn("hit_axis", F.abs("z") > F.col("th_axis")).withColumn("hit_all", F.abs("z") > F.col("th_all"))
        .groupBy("axis").agg(
            F.count("*").alias("n"), F.count(F.when(F.col("hit_axis"), 1)).alias("n_axis"), F.count(F.when(F.col("hit_all"), 1)).alias("n_pooled"),
            F.max(F.abs("z")).alias("max_abs_z"), F.max_by("snapshot", F.abs("z")).alias("at"), F.first("th_axis").alias("th_axis"), F.first("th_all").alias("th_all"))
    )


def average_rank(x: str, *keys):
    """Rank with ties averaged."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return F.rank().over(part.orderBy(x)) + (F.count("*").over(part.orderBy(x).rangeBetween(0, 0)) - 1) / 2


def spearman(pairs: DataFrame, x: str, y: str, *keys) -> DataFrame:
    t = pairs.withColumn("rx", average_rank(x, *keys)).withColumn("ry", average_rank(y, *keys))
    return t.groupBy(*keys).agg(F.corr(x, y).alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.count("*").alias("n"))


def rank_correlations(metrics: DataFrame) -> DataFrame:
    """Rank correlation of every two metrics over the windows (ordinal ranks)."""
    r = metrics.withColumn("rk", F.row_number().over(Window.partitionBy("metric").orderBy("value", "snapshot")))
    a = r.select("snapshot", F.col("metric").alias("m1"), F.col("rk").alias("r1"))
    b = r.select("snapshot", F.col("metric").alias("m2"), F.col("rk").alias("r2"))
    return a.join(b, "snapshot").where("m1 < m2").groupBy("m1", "m2").agg(F.corr("r1", "r2").alias("rho"))


def dependence_evidence(rho: DataFrame) -> DataFrame:
    return rho.agg(F.count("*").alias("n_pairs"), F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho"),
                   F.count(F.when(F.col("rho") < 0, 1)).alias("n_negative"))


def leave_one_out(metrics: DataFrame) -> DataFrame:
    """The permutation test with each non-crisis window dropped in turn, adjusted per drop."""
    w = metrics.groupBy("metric").agg(F.collect_list(F.struct("snapshot", "regime", "value")).alias("rows"))
    out = F.filter("rows", lambda r: r["regime"] != "crisis")
    dropped = w.withColumn("gone", F.explode(out)).withColumn("dropped", F.col("gone.snapshot"))
    kept = dropped.withColumn("r", F.explode("rows")).where("r.snapshot <> dropped").select(
        "dropped", "metric", "r.snapshot", "r.regime", "r.value")
    p = permutation_test(kept, ("dropped", "metric"))
    return adjust(p.select("dropped", "metric", "p_value"), ("dropped",))


def merge_windows(metrics: DataFrame, first: str, second: str, label: str) -> DataFrame:
    """Two windows averaged into one."""
    name = F.when(F.col("snapshot").isin(first, second), F.lit(label)).otherwise(F.col("snapshot"))
    return metrics.groupBy(name.alias("snapshot"), "metric").agg(F.max_by("regime", "snapshot").alias("regime"), F.avg("value").alias("value"))


def ols_band(points: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line with the standard error of the fitted mean at each point."""
    t = points.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"),
                   F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("xbar"), F.count("*").alias("n"))
    s2 = (F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2)
    se = F.sqrt(s2 * (1 / F.col("n") + F.pow(F.col(x) - F.col("xbar"), 2) / F.col("sxx")))
    return attach(points, t).withColumn("fit", F.col("intercept") + F.col("slope") * F.col(x)).withColumn(
        "se", se).drop("sxx", "syy", "sxy", "xbar")


# ------------------------------------------------------------------ resampling


def cluster_bootstrap(points: DataFrame, n_draws: int = 10_000, seed: int = 2026) -> DataFrame:
    """Percentile intervals of both correlations under resampling of whole clusters.

    ``points`` is ``(cluster, x, y)``. Draws come from a hash of draw, slot and
    seed; slots join clusters by number. Draws without variance are dropped.
    """
    cl = points.select("cluster").distinct().withColumn("no", F.row_number().over(Window.orderBy("cluster")) - 1)
    size = cl.agg(F.count("*").cast("int").alias("n_cl"))
    slots = (
        attach(points.sparkSession.range(n_draws).withColumnRenamed("id", "draw"), size)
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n_cl") - 1)))
        .withColumn("no", F.pmod(F.xxhash64("draw", "slot", F.lit(seed)), F.col("n_cl")).cast("int")).select("draw", "slot", "no")
    )
    sample = slots.join(points.join(cl, "cluster").select("no", "x", "y"), "no")
    by = spearman(sample, "x", "y", "draw").where("pearson IS NOT NULL AND NOT isnan(pearson)")
    return by.agg(F.count("*").alias("n_draws"),
                  *[F.percentile(c, q).alias(f"{c}_{n}") for c in ("pearson", "spearman") for n, q in (("lo", 0.025), ("hi", 0.975))])


def label_shuffle(points: DataFrame, n_draws: int = 100_000, seed: int = 2026) -> DataFrame:
    """Two-sided permutation p-value of the correlation.

    Draws are index rows: every point gets a place in every draw by a seeded hash, and
    the y value of that place comes from the points numbered once, so a draw is a
    group of rows and never an array. Products fold into one sum per draw.
    """
    whole = points.agg(F.corr("x", "y").alias("r"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
                       F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.count("*").alias("n"))
    base = materialize(global_rank(points.select("x", "y"), "x", "y", name="i"), "shuffle")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draw = points.sparkSession.range(0, n_draws, 1, parts).withColumnRenamed("id", "draw")
    n = base.agg(F.count("*").alias("n_points"))
    index = attach(draw, n).withColumn("i", F.explode(F.expr("sequence(0, int(n_points) - 1)"))).drop("n_points")
    place = F.row_number().over(Window.partitionBy("draw").orderBy(F.xxhash64("draw", "i", F.lit(seed)), "i")) - 1
    index = index.withColumn("j", place)
    paired = index.join(base.select("i", "x"), "i").join(base.select(F.col("i").alias("j"), "y"), "j")
    dots = attach(paired.groupBy("draw").agg(F.sum(F.col("x") * F.col("y")).alias("dot")), whole)
    r0 = (F.col("dot") / F.col("n") - F.col("mx") * F.col("my")) / (F.col("sx") * F.col("sy"))
    return dots.withColumn("hit", (F.abs(r0) >= F.abs("r") - SLACK).cast("int")).agg(
        F.first("r").alias("r"), F.count("*").alias("n_draws"), F.avg("hit").alias("p_value"))


PREFIX_ROWS = 65_536
_MOMENTS = {"x": "x", "y": "y", "xx": "x * x", "yy": "y * y", "xy": "x * y"}


def running_moments(series: DataFrame) -> DataFrame:
    """``(at, x, y, xx, yy, xy)``: sums over the first ``at`` rows of ``(pos, x, y)``, ``at`` from 0 to the length.

    Values are taken less their means first, which keeps differences of sums exact
    enough. Chunks of consecutive rows are summed each for itself and start from the
    total of the chunks before.
    """
    mean = series.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    rows = attach(global_rank(series.select("pos", "x", "y"), "pos", name="at"), mean).select(
        "at", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    rows = rows.select("at", F.expr(f"at DIV {PREFIX_ROWS}").alias("chunk"), *[F.expr(e).alias(c) for c, e in _MOMENTS.items()])
    inside = Window.partitionBy("chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    total = rows.groupBy("chunk").agg(*[F.sum(c).alias(c) for c in _MOMENTS])
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    base = total.select("chunk", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}0") for c in _MOMENTS])
    part = rows.select("at", "chunk", *[F.sum(c).over(inside).alias(c) for c in _MOMENTS])
    out = part.join(base, "chunk").select((F.col("at").cast("bigint") + 1).alias("at"), *[(F.col(c) + F.col(f"{c}0")).alias(c) for c in _MOMENTS])
    zero = series.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("at"), *[F.lit(0.0).alias(c) for c in _MOMENTS])
    return materialize(zero.unionByName(out), "moments")


def block_bootstrap(series: DataFrame, mean_blocks=(6, 12, 24), n_draws: int = 5_000, seed: int = 2026) -> DataFrame:
    """Stationary bootstrap of the correlation of two aligned series ``(pos, x, y)``.

    A draw is a list of blocks of geometric length with random starts, one row each;
    a block that runs over the end of the series goes on at its beginning. The sums of
    a block are differences of running sums at its two ends, so a block costs two
    lookups however long it is, and no row carries the series.
    """
    moments = running_moments(series)
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = moments.agg(F.max("at").alias("n"))
    means = F.explode(F.array(*[F.lit(int(b)) for b in mean_blocks]))
    draw = attach(series.sparkSession.range(0, n_draws, 1, parts).withColumnRenamed("id", "draw").withColumn("block", means), n).where("n > 0")

    def uniform(*what):
        return (F.shiftrightunsigned(F.xxhash64(*what, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(2**53))

    # enough blocks for any draw: lengths are at least one
    length = F.when(F.col("block") <= 1, F.lit(1.0)).otherwise(F.floor(F.log(uniform("draw", "block", "k", F.lit("length"))) / F.log(1 - 1 / F.col("block"))) + 1)
    w = Window.partitionBy("draw", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = draw.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("len", length.cast("bigint"))
    rows = rows.withColumn("used", F.coalesce(F.sum("len").over(w), F.lit(0))).where("used < n")
    start = F.floor(uniform("draw", "block", "k", F.lit("start")) * F.col("n")).cast("bigint")
    rows = rows.select("draw", "block", "n", start.alias("lo"), (start + F.least("len", F.col("n") - F.col("used"))).alias("hi"))
    pieces = F.array(F.struct(F.col("lo").alias("lo"), F.least("hi", "n").alias("hi")), F.struct(F.lit(0).cast("bigint").alias("lo"), (F.col("hi") - F.col("n")).alias("hi")))
    ends = rows.select("draw", "block", "n", F.explode(pieces).alias("p")).where("p.hi > p.lo").select(
        "draw", "block", "n", F.explode(F.array(F.struct(F.col("p.lo").alias("at"), F.lit(-1.0).alias("sign")), F.struct(F.col("p.hi").alias("at"), F.lit(1.0).alias("sign")))).alias("e"))
    ends = ends.select("draw", "block", "n", "e.at", "e.sign").groupBy("draw", "block", "n", "at").agg(F.sum("sign").alias("sign"))
    s = ends.join(moments, "at").groupBy("draw", "block", "n").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in _MOMENTS])
    vx, vy = F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    r = s.withColumn("r", (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(vx * vy)).where(
        (vx > 1e-12 * F.col("xx")) & (vy > 1e-12 * F.col("yy")))
    return r.groupBy("block").agg(F.count("*").alias("n_draws"), F.avg("r").alias("mean_r"),
                                  F.percentile("r", 0.025).alias("lo"), F.percentile("r", 0.975).alias("hi"))


def dissolution_test(quality: DataFrame) -> DataFrame:
    """One-sided test that crisis windows fall apart less clearly: crisis ``q`` lies below the rest.

    ``quality`` is ``(snapshot, regime, q)``; the exact permutation test runs on the
    negated values. One row with both means, their difference, effect size and p.
    """
    neg = quality.select("snapshot", "regime", F.lit("q").alias("metric"), (-F.col("q")).alias("value"))
    d = cohen_d(quality.select("snapshot", "regime", F.lit("q").alias("metric"), F.col("q").alias("value")))
    return permutation_test(neg).join(d, "metric").select(
        "n_perm", "n_ge", F.col("p_value").alias("p_dissolution"), (F.col("crisis_mean") - F.col("other_mean")).alias("observed"), "crisis_mean", "other_mean", "d")


def null_axes(clustering: DataFrame, motifs: DataFrame) -> DataFrame:
    """``(snapshot, axis, z)`` of the four null-model axes: clustering and three triad classes."""
    t = clustering.select("snapshot", "z_c").join(motifs.select("snapshot", "z_030t", "z_111d", "z_021d"), "snapshot", "full")
    return t.unpivot(["snapshot"], [F.col(c).cast("double").alias(c) for c in ("z_c", "z_030t", "z_111d", "z_021d")], "axis", "z")


def axis_report(z: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Scan of the axes with the range of ``|z|`` and the windows that stay below either threshold."""
    scan = bonferroni_scan(z, alpha)
    low = z.groupBy("axis").agg(F.min(F.abs("z")).alias("min_abs_z"))
    return scan.join(low, "axis").withColumn("below_axis", F.col("n") - F.col("n_axis")).withColumn("below_pooled", F.col("n") - F.col("n_pooled"))
