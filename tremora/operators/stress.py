"""Composite stress index: snapshot, volume-weighted and rolling forms, ablation, weights and back-test.

Tables here have one row per window (or per rolling step), so their windows
without a key see at most the calendar.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora import config as C
from tremora.functions.exprs import finite_or_zero
from tremora.operators import asof
from tremora.operators import graph as G
from tremora.operators import pairs as A
from tremora.operators import sparse
from tremora.operators.community import louvain
from tremora.session import attach, materialize


def everywhere(*by):
    """Window over a whole per-window summary table, or over each of its ``by`` groups."""
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def minmax(x, *by) -> Column:
    """Min-max position; a constant column gives zero."""
    over = everywhere(*by)
    c = F.col(x) if isinstance(x, str) else x
    lo, hi = F.min(c).over(over), F.max(c).over(over)
    return F.coalesce((c - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0))


def motif_shift(table: DataFrame, z: str = "z_ffl", by=()) -> DataFrame:
    """Motif channel: z over the absolute mean baseline z, missing values count as zero."""
    v = finite_or_zero(z)
    base = F.avg(F.when(F.col("regime") == "baseline", v)).over(everywhere(*by))
    return table.withColumn("motif_shift", finite_or_zero(v / F.nullif(F.abs(base), F.lit(0.0))))


def index(channels: DataFrame, weights: dict[str, float] = C.NSI_WEIGHTS, name: str = "nsi", suffix: str = "", by=()) -> DataFrame:
    """Weighted sum of min-max normalised channels."""
    if abs(sum(weights.values()) - 1) > 1e-9 or min(weights.values()) < 0:
        raise ValueError("weights must be non-negative and sum to one")
    out = channels
    for c in weights:
        out = out.withColumn(c + suffix, finite_or_zero(c + suffix)).withColumn(f"{c}{suffix}_norm", minmax(c + suffix, *by))
    total = sum((F.lit(float(w)) * F.col(f"{c}{suffix}_norm") for c, w in weights.items()), F.lit(0.0))
    return out.withColumn(name, total)


def snapshot_index(metrics: DataFrame, weights: dict[str, float] = C.NSI_WEIGHTS, by=()) -> DataFrame:
    """Index from ``n_nodes, n_edges, hhi_top10, mean_corr, z_ffl`` per window.

    Density sets directed edges against unordered pairs, so mutual edges count
    twice and sparsity may be negative.
    """
    dens = F.col("n_edges") / F.nullif(F.col("n_nodes") * (F.col("n_nodes") - 1) / 2, F.lit(0.0))
    ch = motif_shift(metrics.withColumn("density", dens).withColumn("network_sparsity", 1 - F.col("density")), by=by)
    return index(ch, weights, by=by)


def log_volume_weights(members: DataFrame, adv: DataFrame) -> DataFrame:
    """``log1p(adv)`` shares per window; uniform when no member has volume."""
    w = Window.partitionBy("snapshot")
    lv = F.log1p(F.coalesce("adv", F.lit(0.0)))
    return (
        members.select("snapshot", F.col("node").alias("asset")).join(adv, "asset", "left").withColumn("lv", lv)
        .withColumn("w", F.coalesce(F.col("lv") / F.nullif(F.sum("lv").over(w), F.lit(0.0)), 1.0 / F.count("*").over(w)))
        .select("snapshot", F.col("asset").alias("node"), "w")
    )


def weighted_correlation(vecs: DataFrame, weights: DataFrame, block_fn=A.corr_block, extra=(), block: int = A.BLOCK) -> DataFrame:
    """``sum w_i w_j r_ij / sum w_i w_j`` over distinct pairs, reduced inside the block tasks."""
    v = vecs.join(weights.withColumnRenamed("node", "asset"), ["snapshot", "asset"])

    def task(a, b, same):
        r = block_fn(a, b)
        w = np.outer(a["w"].to_numpy(), b["w"].to_numpy())
        i, j = A._pairs_of(a, b, same)
        return pd.DataFrame({"num": [float((w[i, j] * r[i, j]).sum())], "den": [float(w[i, j].sum())]})

    part = A.blocked(v, task, "num double, den double", block=block, extra=["w", *extra])
    return part.groupBy("snapshot").agg((F.sum("num") / F.nullif(F.sum("den"), F.lit(0.0))).alias("mean_corr_vw"))


def volume_weighted_channels(vecs: DataFrame, arcs: DataFrame, ranks: DataFrame, weights: DataFrame,
                             block_fn=A.corr_block, extra=()) -> DataFrame:
    """Volume-weighted sparsity, concentration and correlation per window."""
    sq = weights.groupBy("snapshot").agg((0.5 * (F.sum("w") * F.sum("w") - F.sum(F.col("w") * F.col("w")))).alias("pairs_w"))
    src = weights.select("snapshot", F.col("node").alias("src"), F.col("w").alias("wu"))
    dst = weights.select("snapshot", F.col("node").alias("dst"), F.col("w").alias("wv"))
    dens = (
        arcs.join(src, ["snapshot", "src"]).join(dst, ["snapshot", "dst"]).groupBy("snapshot")
        .agg(F.sum(F.col("wu") * F.col("wv")).alias("edge_w"))
    )
    conc = ranks.join(weights, ["snapshot", "node"]).groupBy("snapshot").agg(
        F.sum(F.col("w") * F.col("pagerank") * F.col("pagerank")).alias("hhi_vw"))
    return (
        sq.join(dens, "snapshot", "left").join(conc, "snapshot").join(weighted_correlation(vecs, weights, block_fn, extra), "snapshot", "left")
        .withColumn("network_sparsity_vw", 1 - F.coalesce("edge_w", F.lit(0.0)) / F.nullif("pairs_w", F.lit(0.0)))
        .withColumn("mean_corr_vw", F.coalesce("mean_corr_vw", F.lit(0.0)))
        .select("snapshot", "network_sparsity_vw", "hhi_vw", "mean_corr_vw")
    )


def volume_weighted_index(channels: DataFrame, motif: DataFrame) -> DataFrame:
    """Index of the volume-weighted channels with the unweighted motif channel (``snapshot, regime, z_ffl``)."""
    t = motif_shift(channels.join(motif, "snapshot")).withColumnRenamed("motif_shift", "motif_shift_vw")
    t = t.withColumnRenamed("hhi_vw", "hhi_top10_vw")
    return index(t, C.NSI_WEIGHTS, "nsi_vw", "_vw").withColumnRenamed("hhi_top10_vw", "hhi_vw")


# ------------------------------------------------------------------ weights


def ablations(weights: dict[str, float] = C.NSI_WEIGHTS) -> list[tuple[str, dict[str, float]]]:
    """All channels, then each channel dropped with the rest rescaled."""
    out = [("all", dict(weights))]
    for c in weights:
        rest = sum(w for n, w in weights.items() if n != c)
        out.append((f"drop_{c}", {n: (0.0 if n == c else w / rest) for n, w in weights.items()}))
    return out


def perturbed(weights: dict[str, float], channel: str, delta: float) -> dict[str, float] | None:
    """Shift one weight and rescale the others to keep their proportions."""
    new = weights[channel] + delta
    if new < 0:
        return None
    rest = sum(w for n, w in weights.items() if n != channel)
    return {n: (new if n == channel else w * (1 - new) / rest) for n, w in weights.items()}


# Named weight settings (sparsity, concentration, correlation, motif).
MANUAL = [
    ("Baseline", (0.25, 0.20, 0.35, 0.20)), ("Equal", (0.25, 0.25, 0.25, 0.25)), ("rho-heavy", (0.10, 0.10, 0.70, 0.10)),
    ("rho-light", (0.30, 0.30, 0.10, 0.30)), ("Sparsity-heavy", (0.50, 0.10, 0.30, 0.10)), ("HHI-heavy", (0.10, 0.50, 0.30, 0.10)),
    ("Motif-heavy", (0.10, 0.10, 0.30, 0.50)), ("rho+mu only", (0.00, 0.00, 0.50, 0.50)),
]


def weight_settings() -> list[tuple[str, dict[str, float]]]:
    names = list(C.NSI_WEIGHTS)
    out = [(n, dict(zip(names, w))) for n, w in MANUAL]
    for c in names:
        for d in (0.05, -0.05):
            w = perturbed(C.NSI_WEIGHTS, c, d)
            if w is not None:
                out.append((f"{c} {d:+.2f}", w))
    return out


def reweighted(normalised: DataFrame, settings: list[tuple[str, dict[str, float]]]) -> DataFrame:
    """Index per window and weight setting from the ``*_norm`` channels."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("config"), *[F.lit(float(v)).alias(c) for c, v in w.items()]) for n, w in settings]))
    t = normalised.withColumn("s", rows)
    total = sum((F.col(f"s.{c}") * F.col(f"{c}_norm") for c in C.NSI_WEIGHTS), F.lit(0.0))
    return t.select("snapshot", "regime", F.col("s.config").alias("config"), total.alias("nsi"))


def ranked_settings(scores: DataFrame) -> DataFrame:
    """Per setting: first two windows, whether both are crises, and the crisis contrast."""
    w = Window.partitionBy("config").orderBy(F.desc("nsi"), "snapshot")
    crisis = F.col("regime") == "crisis"
    return scores.withColumn("rank", F.row_number().over(w)).groupBy("config").agg(
        F.max(F.when(F.col("rank") == 1, F.col("snapshot"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("snapshot"))).alias("second"),
        F.min(F.when(F.col("rank") <= 2, crisis)).alias("top2_crises"),
        F.avg(F.when(crisis, F.col("nsi"))).alias("crisis_mean"), F.avg(F.when(~crisis, F.col("nsi"))).alias("other_mean"),
    ).withColumn("delta", F.col("crisis_mean") - F.col("other_mean"))


def simplex_fit(normalised: DataFrame, target: str) -> dict[str, float]:
    """Weights on the simplex closest in squares to the min-max target.

    The normal equations are aggregates; only that 4-by-4 summary reaches the
    driver, where every active set is solved and the best feasible one kept.
    """
    names = list(C.NSI_WEIGHTS)
    t = normalised.withColumn("y", minmax(target))
    x = [F.col(f"{c}_norm") for c in names]
    row = t.agg(*[F.sum(p * q) for p in x for q in x], *[F.sum(p * F.col("y")) for p in x]).head()
    g, b = np.array(row[:16], float).reshape(4, 4), np.array(row[16:], float)
    best, best_val = None, np.inf
    for size in range(1, 5):
        for on in itertools.combinations(range(4), size):
            kkt = np.block([[g[np.ix_(on, on)], np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
            w = np.zeros(4)
            w[list(on)] = np.linalg.lstsq(kkt, np.append(b[list(on)], 1.0), rcond=None)[0][:size]
            val = float(w @ g @ w - 2 * b @ w)
            if w.min() >= -1e-12 and abs(w.sum() - 1) < 1e-8 and val < best_val:
                best, best_val = np.maximum(w, 0), val
    return dict(zip(names, (float(v) for v in best / best.sum())))


def dirichlet_scores(normalised: DataFrame, n_draws: int = 10_000, concentration: float | None = 50.0, seed: int = 2026) -> DataFrame:
    """Index under random weights; draws are rows, gamma variates come per draw from its own stream."""
    names = list(C.NSI_WEIGHTS)
    alpha = np.array([concentration * w for w in C.NSI_WEIGHTS.values()]) if concentration else np.ones(4)
    spark = normalised.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = np.array([np.random.Generator(np.random.Philox(key=[seed, int(d)])).dirichlet(alpha) for d in pdf["id"]]).reshape(-1, 4)
            yield pd.DataFrame({"draw": pdf["id"], **{n: w[:, i] for i, n in enumerate(names)}})

    draws = spark.range(n_draws).mapInPandas(run, "draw bigint, " + ", ".join(f"{n} double" for n in names))
    cell = F.struct("snapshot", "regime", *[F.col(f"{c}_norm").alias(c) for c in names])
    table = normalised.agg(F.collect_list(cell).alias("cells"))
    t = attach(draws, table).select("draw", *[F.col(c).alias(f"w_{c}") for c in names], F.explode("cells").alias("c"))
    total = sum((F.col(f"w_{c}") * F.col(f"c.{c}") for c in names), F.lit(0.0))
    return t.select("draw", "c.snapshot", "c.regime", total.alias("nsi"))


def dirichlet_summary(scores: DataFrame) -> DataFrame:
    """How often each window ranks first, and the spread of the crisis contrast."""
    crisis = F.col("regime") == "crisis"
    per = scores.groupBy("draw").agg(
        F.max_by("snapshot", F.struct("nsi", "snapshot")).alias("first"),
        (F.avg(F.when(crisis, F.col("nsi"))) - F.avg(F.when(~crisis, F.col("nsi")))).alias("delta"))
    q = per.agg(F.count("*").alias("n_draws"), F.avg("delta").alias("delta_mean"),
                F.percentile("delta", 0.025).alias("delta_q025"), F.percentile("delta", 0.975).alias("delta_q975"))
    return attach(per.groupBy("first").agg(F.count("*").alias("n_first")), q).select(
        F.col("first").alias("snapshot"), (100.0 * F.col("n_first") / F.col("n_draws")).alias("first_pct"),
        "delta_mean", "delta_q025", "delta_q975")


# ------------------------------------------------------------------ rolling index


def rolling_panel(returns: DataFrame, cal: DataFrame, window: int = C.ROLLING_WINDOW, step: int = C.ROLLING_STEP) -> DataFrame:
    """Rows of every count-based window, keyed ``snapshot`` = first position.

    Starts run over ``0, step, ...`` strictly below ``T - window``. A row joins
    its ``window / step`` windows by arithmetic on its position.
    """
    last = cal.agg((F.count("*") - window).alias("end"))
    hi = F.least(F.expr(f"pos DIV {step}"), F.expr(f"(end - 1) DIV {step}"))
    lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - (window - 1)) / step).cast("int"))
    return (
        attach(returns, last).withColumn("hi", hi.cast("int")).withColumn("lo", lo)
        .where("end > 0 AND hi >= lo")
        .select("asset", "date", "pos", "x", F.explode(F.sequence(F.col("lo") * step, F.col("hi") * step, F.lit(step))).alias("snapshot"))
    )


def rolling_complete(rows: DataFrame, cal: DataFrame, window: int, min_assets: int) -> DataFrame:
    """Keep assets observed on all window positions, and windows with enough of them."""
    by = Window.partitionBy("snapshot", "asset")
    full = rows.withColumn("k", F.count("x").over(by)).where(F.col("k") == window).drop("k")
    ok = full.groupBy("snapshot").agg(F.countDistinct("asset").alias("p")).where(F.col("p") >= min_assets).select("snapshot")
    return full.join(ok, "snapshot", "left_semi")


def window_ends(cal: DataFrame, window: int) -> DataFrame:
    return cal.select((F.col("pos") - (window - 1)).alias("snapshot"), "date")


def rolling_mean_corr(rows: DataFrame, cal: DataFrame, window: int) -> DataFrame:
    """Mean upper-triangle correlation per rolling window, dated at its last day."""
    return A.mean_correlation(A.vectors(rows)).join(window_ends(cal, window), "snapshot").select("date", "mean_corr", "n_pairs")


def rolling_index(returns: DataFrame, cal: DataFrame, window: int = C.ROLLING_WINDOW, step: int = C.ROLLING_STEP,
                  lam: float = C.ROLLING_LAMBDA, min_assets: int = C.ROLLING_MIN_ASSETS, min_edges: int = 5) -> DataFrame:
    """Rolling index from sparse-network modularity, mean correlation and density.

    All windows share every job: correlations, penalised fits and communities
    are keyed by window.
    """
    rows = materialize(rolling_complete(rolling_panel(returns, cal, window, step), cal, window, min_assets), "roll")
    vec = A.vectors(rows)
    pairs = materialize(A.pair_values(vec), "roll-pairs")
    nodes = rows.select(F.col("snapshot").cast("string").alias("snapshot"), F.col("asset").alias("node")).distinct()
    nodes = materialize(nodes, "roll-nodes")
    corr = pairs.select(F.col("snapshot").cast("string").alias("snapshot"), "i", "j", F.col("v").alias("s"))
    entries, _ = sparse.fit_grid(corr, nodes, [lam])
    und = materialize(
        sparse.partial_correlations(entries).select("snapshot", F.col("i").alias("a"), F.col("j").alias("b"), F.abs("partial_corr").alias("weight")), "roll-und")
    q = G.modularity(und, louvain(und, nodes))
    size = nodes.groupBy("snapshot").agg(F.count("*").alias("p"))
    m = und.groupBy("snapshot").agg(F.count("*").alias("n_edges"))
    rho = corr.groupBy("snapshot").agg(F.avg("s").alias("mean_corr"))
    t = (
        size.join(m, "snapshot").where(F.col("n_edges") >= min_edges).join(q, "snapshot").join(rho, "snapshot")
        .withColumn("density", F.col("n_edges") / (F.col("p") * (F.col("p") - 1) / 2))
        .withColumn("one_minus_q", 1 - minmax("modularity"))
        .withColumn("rho_norm", minmax("mean_corr")).withColumn("density_norm", minmax("density"))
    )
    w = C.ROLLING_WEIGHTS
    nsi = w["one_minus_q"] * F.col("one_minus_q") + w["mean_corr"] * F.col("rho_norm") + w["density"] * F.col("density_norm")
    ends = window_ends(cal, window).withColumn("snapshot", F.col("snapshot").cast("string"))
    return t.join(ends, "snapshot").select("date", "p", "n_edges", "modularity", "mean_corr", "density", nsi.alias("nsi"))


# ------------------------------------------------------------------ back-test


def common_dates(index_: DataFrame, bench: DataFrame) -> DataFrame:
    """Index and benchmark on their shared dates, numbered in order."""
    return index_.select("date", "nsi").join(bench.select("date", "close"), "date").withColumn(
        "pos", F.row_number().over(Window.orderBy("date")) - 1)


def spikes(both: DataFrame, q: float = 0.9) -> DataFrame:
    """Flag values above the interpolated percentile of either series."""
    th = both.agg(F.percentile("nsi", q).alias("nsi_th"), F.percentile("close", q).alias("close_th"))
    return attach(both, th).withColumn(
        "nsi_spike", F.col("nsi") > F.col("nsi_th")).withColumn("bench_spike", F.col("close") > F.col("close_th"))


def lead_times(flagged: DataFrame, tolerance: int = 90) -> DataFrame:
    """For each benchmark spike the days since the latest strictly earlier index spike, within tolerance."""
    left = flagged.where("bench_spike").select("date")
    right = flagged.where("nsi_spike").select("date")
    m = asof.backward(left, right, strict=True, tolerance_days=tolerance)
    return m.select("date", F.col("m.date").alias("signal_date"), F.datediff("date", "m.date").alias("lead_days"))


def lagged_correlations(both: DataFrame, lags=tuple(C.BACKTEST_LAGS), min_common: int = 21) -> DataFrame:
    """Correlation of the benchmark with the index shifted by grid steps."""
    lag = F.explode(F.array(*[F.lit(int(v)) for v in lags]))
    shifted = both.select(lag.alias("lag"), "nsi", "pos").select("lag", (F.col("pos") + F.col("lag")).alias("pos"), "nsi")
    return shifted.join(both.select("pos", "close"), "pos").groupBy("lag").agg(
        F.count("*").alias("n"), F.corr("nsi", "close").alias("r")).where(F.col("n") >= min_common)


def backtest(index_: DataFrame, bench: DataFrame, q: float = 0.9) -> DataFrame:
    """One-row summary of the concordance with the benchmark."""
    both = materialize(common_dates(index_, bench), "backtest")
    f = spikes(both, q)
    lead = lead_times(f).agg(F.count("*").alias("n_bench_spikes"), F.count("lead_days").alias("n_signals"),
                             F.avg("lead_days").alias("mean_lead"), F.percentile("lead_days", 0.5).alias("median_lead"))
    base = both.agg(F.count("*").alias("n_common"), F.corr("nsi", "close").alias("r"))
    return attach(lead, base).withColumn(
        "signal_rate", F.coalesce(F.col("n_signals") / F.nullif("n_bench_spikes", F.lit(0)), F.lit(0.0)))


def cross_correlogram(both: DataFrame, max_lag: int = 24, min_common: int = 5) -> DataFrame:
    """Correlation at every lag in ``-max_lag..max_lag`` (positive: index leads)."""
    return lagged_correlations(both, range(-max_lag, max_lag + 1), min_common)
