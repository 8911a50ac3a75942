"""End-to-end pipeline, panel sweep, checks and report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremora import config as C
from tremora.functions import exprs as X
from tremora.operators import direction as E
from tremora.operators import graph as G
from tremora.operators import pairs as A
from tremora.operators import panel as P
from tremora.operators import quality as Q
from tremora.operators import stress as T
from tremora.plans import catalogue_inference as I
from tremora.plans import catalogue_network as N
from tremora.plans import standin as D
from tremora.plans import sweep
from tremora.plans.pipeline import Settings, StressPipeline
from tremora.plans.registry import query

_PIPES: dict = {}


def pipeline(spark, sf) -> StressPipeline:
    """Pipeline over the stand-in panel with looser direction tests."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PIPES:
        adv = P.dollar_volume(D.nation_weeks(spark, sf), F.col("price"), F.col("volume"))
        _PIPES[key] = StressPipeline(spark, D.returns(spark, sf), D.weeks(spark, sf), D.snapshots(spark), D.sectors(spark, sf), adv,
                                     Settings(alpha=0.3))
    return _PIPES[key]


@query("pipeline_network")
def pipeline_network(spark, sf):
    return pipeline(spark, sf).network()


@query("pipeline_stress")
def pipeline_stress(spark, sf):
    return pipeline(spark, sf).stress().select("snapshot", "regime", "network_sparsity", "hhi_top10", "mean_corr", "motif_shift", "nsi")


@query("pipeline_tests")
def pipeline_tests(spark, sf):
    return pipeline(spark, sf).tests()


@query("pipeline_checks")
def pipeline_checks(spark, sf):
    return Q.summary(pipeline(spark, sf).checks())


@query("pipeline_volume_weighted")
def pipeline_volume_weighted(spark, sf):
    return pipeline(spark, sf).volume_weighted()


@query("panel_sweep")
def panel_sweep(spark, sf):
    """Threshold networks and index for panel sizes and selection rules, all jobs in one plan."""
    def build(s, f):
        return sweep.run(D.returns(s, f), D.weeks(s, f), D.snapshots(s), D.sectors(s, f), sweep_adv(s, f),
                         sizes=(12, 20, 25), kinds=("coverage", "adv", "bottom_adv", "bottom_coverage"))

    return D.stage(spark, sf, "sweep", build)


def sweep_adv(spark, sf):
    return P.dollar_volume(D.nation_weeks(spark, sf), F.col("price"), F.col("volume"))


@query("sweep_max_gap")
def sweep_max_gap(spark, sf):
    """Largest index gap between coverage and volume panels of equal size, with its window."""
    return sweep.largest_gap(panel_sweep(spark, sf))


@query("sweep_decile_summary")
def sweep_decile_summary(spark, sf):
    return sweep.decile_summary(panel_sweep(spark, sf))


@query("invariant_checks", """
SELECT 'stage1' AS stage, 'corr_bounded' AS name, count(DISTINCT snapshot)::BIGINT AS n, count(DISTINCT snapshot)::BIGINT AS n_passed FROM pair WHERE abs(r) <= 1
UNION ALL SELECT 'stage1', 'corr_finite', count(DISTINCT snapshot), count(DISTINCT CASE WHEN NOT isnan(r) THEN snapshot END) FROM pair
UNION ALL SELECT 'stage1', 'corr_ordered', count(DISTINCT snapshot), count(DISTINCT CASE WHEN i < j THEN snapshot END) FROM pair
UNION ALL SELECT 'stage3', 'weights_non_negative', count(DISTINCT snapshot), count(DISTINCT CASE WHEN weight >= 0 THEN snapshot END) FROM arcs
UNION ALL SELECT 'stage3', 'no_self_loops', count(DISTINCT snapshot), count(DISTINCT CASE WHEN src <> dst THEN snapshot END) FROM arcs
UNION ALL SELECT 'stage3', 'edges_conserved', count(DISTINCT snapshot), count(DISTINCT snapshot) FROM decided
UNION ALL SELECT 'stage3', 'arc_count', count(DISTINCT snapshot), count(DISTINCT snapshot) FROM decided
UNION ALL SELECT 'stage4', 'pagerank_sums_to_one', count(*), count(CASE WHEN abs(s - 1) < 1e-6 THEN 1 END) FROM (SELECT snapshot, sum(pagerank) AS s FROM ranks GROUP BY 1)
UNION ALL SELECT 'stage4', 'pagerank_positive', count(*), count(CASE WHEN lo > 0 THEN 1 END) FROM (SELECT snapshot, min(pagerank) AS lo FROM ranks GROUP BY 1)
UNION ALL SELECT 'stage5', 'index_in_range', count(*), count(CASE WHEN nsi BETWEEN -1e-9 AND 1 + 1e-9 THEN 1 END) FROM nsi
UNION ALL SELECT 'cross', 'members_equal', count(DISTINCT snapshot), count(DISTINCT snapshot) FROM nodes""", ["pair", "arcs", "decided", "ranks", "nsi", "nodes"])
def invariant_checks(spark, sf):
    dec = E.decide(E.with_rule(N.simple_evidence(spark, sf).where("granger_lag = 1"), alpha=N.ALPHA))
    stress = Q.stress(I.indexed(spark, sf)).where("name = 'index_in_range'")
    cross = Q.same_members(D.window_panel(spark, sf), N.nodes(spark, sf).withColumnRenamed("node", "asset"), "cross", "members_equal")
    return Q.summary(Q.union(Q.correlations(A.pair_values(N.vecs(spark, sf))), Q.directions(N.arcs(spark, sf), E.tally(dec)),
                             Q.network(N.ranks(spark, sf), None, None), stress, cross))


# ------------------------------------------------------------------ report tables
@query("report_dashboard")
def report_dashboard(spark, sf):
    """Per window: edges, clustering z, concentration, modularity, purity and triad z scores."""
    return pipeline(spark, sf).network().select(
        "snapshot", "regime", "n_edges", F.abs("z_c").alias("abs_z_c"), "gini", "hhi_top10", "modularity", "purity", "z_030t", "z_021d", "z_111d")


@query("report_motif_profile")
def report_motif_profile(spark, sf):
    """Significance profile in long form, one row per window and triad class."""
    t = pipeline(spark, sf).network().select("snapshot", "regime", "sp_030t", "sp_021d", "sp_111d")
    return t.unpivot(["snapshot", "regime"], ["sp_030t", "sp_021d", "sp_111d"], "motif", "profile")


@query("report_robustness")
def report_robustness(spark, sf):
    return N.er_null_z(spark, sf).select("snapshot", "z_c").join(
        N.density_matched(spark, sf).select("snapshot", "q", "q_random", "q_rel"), "snapshot")


@query("report_lambda_diagnostic")
def report_lambda_diagnostic(spark, sf):
    return pipeline(spark, sf).sparse()[1].select("snapshot", "lam_unconstrained", "k_unconstrained", "lam", "k", "fallback_fired")


@query("report_run_summary")
def report_run_summary(spark, sf):
    p = pipeline(spark, sf)
    return p.snapshots.select("snapshot", "regime").join(p.sparse()[1].select("snapshot", "p", "n", "lam", "k"), "snapshot").join(
        E.tally(p.decisions()).select("snapshot", "n_directed", "n_mutual", "n_dropped"), "snapshot").join(p.stress().select("snapshot", "nsi"), "snapshot")


@query("report_ordered_corr", """
SELECT snapshot, least(a.ord, b.ord)::INT AS row_no, greatest(a.ord, b.ord)::INT AS col_no, round(r, 6) + 0.0::DOUBLE AS r FROM pair
JOIN (SELECT asset, row_number() OVER (ORDER BY sector, asset) AS ord FROM sector) a ON a.asset = i
JOIN (SELECT asset, row_number() OVER (ORDER BY sector, asset) AS ord FROM sector) b ON b.asset = j""", ["pair", "sector"])
def report_ordered_corr(spark, sf):
    """Correlations with rows and columns ordered by sector, then asset."""
    s = D.sectors(spark, sf).withColumn("ord", F.row_number().over(Window.orderBy("sector", "asset")))
    i, j = s.select(F.col("asset").alias("i"), F.col("ord").alias("oi")), s.select(F.col("asset").alias("j"), F.col("ord").alias("oj"))
    return A.pair_values(N.vecs(spark, sf)).join(i, "i").join(j, "j").select(
        "snapshot", F.least("oi", "oj").alias("row_no"), F.greatest("oi", "oj").alias("col_no"), X.rnd("v").alias("r"))


@query("report_leader_matrix", """
SELECT l.node, s.snapshot, round(coalesce(round(r.pagerank, 9), 0), 7) AS pagerank FROM (
  SELECT DISTINCT node FROM (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY round(pagerank, 9) DESC, node) AS rn FROM ranks) WHERE rn <= 3) l
CROSS JOIN (SELECT DISTINCT snapshot FROM ranks) s LEFT JOIN ranks r ON r.node = l.node AND r.snapshot = s.snapshot""", ["ranks"])
def report_leader_matrix(spark, sf):
    """PageRank of every top-three asset in every window, zero where absent."""
    r = N.ranks(spark, sf).select("snapshot", "node", F.round("pagerank", 9).alias("pagerank"))
    snaps = r.agg(F.collect_set("snapshot").alias("all"))
    from tremora.session import attach

    grid = attach(G.leaders(r, 3).select("node").distinct(), snaps).select("node", F.explode("all").alias("snapshot"))
    return grid.join(r, ["snapshot", "node"], "left").select("node", "snapshot", F.round(F.coalesce("pagerank", F.lit(0.0)), 7).alias("pagerank"))


@query("report_window_timeline", """
SELECT snapshot, regime, date_diff('day', d_from, d_to)::INT AS n_days, round(max(close), 4) AS peak,
  round(date_diff('day', d_from, d_to) / min(date_diff('day', d_from, d_to)) OVER (), 6) AS length_ratio
FROM snap JOIN bench ON date BETWEEN d_from AND d_to GROUP BY snapshot, regime, d_from, d_to""", ["snap", "bench"])
def report_window_timeline(spark, sf):
    """Length of each window, its ratio to the shortest, and the benchmark peak inside."""
    peak = P.in_windows(D.benchmark_daily(spark, sf), D.snapshots(spark)).groupBy("snapshot").agg(F.max("close").alias("peak"))
    t = D.snapshots(spark).join(peak, "snapshot").withColumn("n_days", F.datediff("end", "start"))
    return t.select("snapshot", "regime", "n_days", F.round("peak", 4).alias("peak"),
                    F.round(F.col("n_days") / F.min("n_days").over(Window.partitionBy(F.lit(1))), 6).alias("length_ratio"))


@query("report_contamination", """
SELECT asset, round(avg(CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_share, count(*)::BIGINT AS n_obs FROM nret GROUP BY 1""", ["nret"])
def report_contamination(spark, sf):
    return P.zero_runs(D.returns(spark, sf)).select("asset", X.rnd("zero_frac").alias("zero_share"), "n_obs")


@query("report_nsi_at_midpoint", """
SELECT snapshot, d_from + (date_diff('day', d_from, d_to) // 2)::INT AS midpoint, round(nsi, 6) AS nsi, round(bench, 4) AS bench FROM nsi JOIN snap USING (snapshot) JOIN wbench USING (snapshot)""",
       ["nsi", "snap", "wbench"])
def report_nsi_at_midpoint(spark, sf):
    mid = F.expr("date_add(start, int(datediff(end, start) DIV 2))")
    return I.window_bench(spark, sf).join(I.indexed(spark, sf).select("snapshot", "nsi"), "snapshot").select(
        "snapshot", mid.alias("midpoint"), F.round("nsi", 6).alias("nsi"), F.round("bench", 4).alias("bench"))


@query("report_raw_channels", """
SELECT snapshot, round(1 - n_edges / (n_nodes * (n_nodes - 1) / 2), 6) AS network_sparsity, round(hhi_top, 6) AS hhi_top10, round(mean_corr, 6) + 0.0::DOUBLE AS mean_corr,
  round(n_030t / abs(avg(CASE WHEN regime = 'baseline' THEN n_030t END) OVER ()), 6) AS motif_shift FROM wide""", ["wide"])
def report_raw_channels(spark, sf):
    return I.indexed(spark, sf).select("snapshot", *[X.rnd(c).alias(c) for c in C.NSI_WEIGHTS])


@query("report_sweep_grid")
def report_sweep_grid(spark, sf):
    """Index by window with one column per selection rule and size."""
    t = panel_sweep(spark, sf).withColumn("job", F.concat_ws("_", "kind", F.col("n").cast("string")))
    return t.groupBy("snapshot").pivot("job", [f"{k}_{n}" for k in ("coverage", "adv") for n in (12, 20, 25)]).agg(F.first("nsi"))


@query("report_cross_sector_pooled", """
SELECT s_src, s_dst, n_edges::BIGINT AS n_edges, round(n_edges / sum(n_edges) OVER (PARTITION BY s_src), 6) AS row_share FROM (
  SELECT a.sector AS s_src, b.sector AS s_dst, count(*) AS n_edges FROM arcs JOIN sector a ON a.asset = src JOIN sector b ON b.asset = dst GROUP BY 1, 2)""", ["arcs", "sector"])
def report_cross_sector_pooled(spark, sf):
    pooled = N.arcs(spark, sf).withColumn("all", F.lit("all"))
    return G.sector_incidence(pooled, D.sectors(spark, sf), ("all",)).select("s_src", "s_dst", "n_edges", X.rnd("row_share").alias("row_share"))


@query("rolling_channel_diagnostics")
def rolling_channel_diagnostics(spark, sf):
    """Each rolling channel against the benchmark at its nearest date, contemporaneous and lagged."""
    from tremora.operators import asof

    roll = I.rolling_nsi(spark, sf).select("date", "nsi", "modularity", "mean_corr", "density")
    m = asof.nearest(roll, D.benchmark_daily(spark, sf)).withColumn("close", F.col("m.close"))
    m = m.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    out = None
    for c in ("nsi", "modularity", "mean_corr", "density"):
        r = T.lagged_correlations(m.select("pos", "close", F.col(c).cast("double").alias("nsi")), (0, *C.BACKTEST_LAGS)).withColumn("channel", F.lit(c))
        out = r if out is None else out.unionByName(r)
    return out
