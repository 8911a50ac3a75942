"""Stress-index and inference queries on the stand-in windows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tremora import config as C
from tremora.functions import exprs as X
from tremora.operators import graph as G
from tremora.operators import inference as I
from tremora.operators import pairs as A
from tremora.operators import panel as P
from tremora.operators import stress as T
from tremora.plans import catalogue_network as N
from tremora.plans import standin as D
from tremora.plans.registry import cte, query
from tremora.session import attach

METRICS = ["nsi", "gini", "hhi", "mutual_dyad_pct", "cross_sector", "mean_rho"]
WINDOW, STEP = 52, 4  # weekly rolling windows of one year

cte("trip", "SELECT g.snapshot, count(a.src) AS n_030t FROM (SELECT DISTINCT snapshot FROM arcs) g LEFT JOIN "
            "(SELECT a.snapshot, a.src FROM asym a JOIN asym b ON b.snapshot = a.snapshot AND a.dst = b.src "
            "JOIN asym c ON c.snapshot = a.snapshot AND c.src = a.src AND c.dst = b.dst) a ON a.snapshot = g.snapshot GROUP BY 1", ["arcs", "asym"])
cte("wide", """
SELECT snap.snapshot, regime, n_nodes, n_edges, mean_corr, cs, mutual, hhi, gini, hhi_top, n_030t FROM snap
JOIN conc USING (snapshot) JOIN trip USING (snapshot) JOIN (SELECT snapshot, avg(r) AS mean_corr FROM pair GROUP BY 1) USING (snapshot)
JOIN (SELECT snapshot, count(*) AS n_edges FROM arcs GROUP BY 1) USING (snapshot)
JOIN (SELECT snapshot, 100.0::DOUBLE * avg(CASE WHEN n = 2 THEN 1.0::DOUBLE ELSE 0 END) AS mutual FROM (
  SELECT snapshot, least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM arcs GROUP BY 1, 2, 3) GROUP BY 1) USING (snapshot)
JOIN (SELECT snapshot, avg(CASE WHEN a.sector <> b.sector THEN 1.0::DOUBLE ELSE 0 END) AS cs FROM strong JOIN sector a ON a.asset = i JOIN sector b ON b.asset = j GROUP BY 1) USING (snapshot)""",
    ["snap", "conc", "trip", "pair", "arcs", "strong", "sector"])
cte("chan", """
SELECT snapshot, regime, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s, (h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()) AS h,
  (rho - min(rho) OVER ()) / (max(rho) OVER () - min(rho) OVER ()) AS rho, (mu - min(mu) OVER ()) / (max(mu) OVER () - min(mu) OVER ()) AS mu, raw_rho
FROM (SELECT snapshot, regime, 1 - n_edges / (n_nodes * (n_nodes - 1) / 2) AS s, hhi_top AS h, mean_corr AS rho, mean_corr AS raw_rho,
  n_030t / abs(avg(CASE WHEN regime = 'baseline' THEN n_030t END) OVER ()) AS mu FROM wide)""", ["wide"])
cte("nsi", "SELECT *, 0.25::DOUBLE * s + 0.2::DOUBLE * h + 0.35::DOUBLE * rho + 0.2::DOUBLE * mu AS nsi FROM chan", ["chan"])
cte("metrics", """
SELECT snapshot, regime, 'nsi' AS metric, nsi::DOUBLE AS value FROM nsi UNION ALL SELECT snapshot, regime, 'gini', gini FROM wide
UNION ALL SELECT snapshot, regime, 'hhi', hhi FROM wide UNION ALL SELECT snapshot, regime, 'mutual_dyad_pct', mutual FROM wide
UNION ALL SELECT snapshot, regime, 'cross_sector', cs FROM wide UNION ALL SELECT snapshot, regime, 'mean_rho', mean_corr FROM wide""", ["nsi", "wide"])


def wide(spark, sf):
    """One row per window with the raw network metrics."""
    def build(s, f):
        a, n = N.arcs(s, f), N.nodes(s, f)
        conc = G.concentration(N.ranks(s, f)).withColumnRenamed("hhi_top", "hhi_top10").drop("n_nodes")
        return (
            D.snapshots(s).select("snapshot", "regime").join(G.mean_degree(a, n).select("snapshot", "n_nodes", "n_edges"), "snapshot")
            .join(A.mean_correlation(N.vecs(s, f)).select("snapshot", "mean_corr"), "snapshot")
            .join(G.cross_sector(N.strong(s, f), D.sectors(s, f)).select("snapshot", F.col("cs_fraction").alias("cross_sector")), "snapshot")
            .join(G.reciprocity(a).select("snapshot", (100 * F.coalesce("mutual_fraction", F.lit(0.0))).alias("mutual_dyad_pct")), "snapshot")
            .join(conc, "snapshot").join(G.triad_counts(a).select("snapshot", F.col("n_030t").cast("double").alias("z_ffl")), "snapshot")
        )

    return D.stage(spark, sf, "wide", build)


def indexed(spark, sf):
    return D.stage(spark, sf, "indexed", lambda s, f: T.snapshot_index(wide(s, f)))


def metrics(spark, sf):
    def build(s, f):
        t = indexed(s, f).withColumn("mean_rho", F.col("mean_corr"))
        return I.unpivot(t, METRICS)

    return D.stage(spark, sf, "metrics", build)


@query("window_metrics", "SELECT snapshot, regime, metric, round(value, 6) + 0.0::DOUBLE AS value FROM metrics", ["metrics"])
def window_metrics(spark, sf):
    return metrics(spark, sf).withColumn("value", X.rnd("value"))


@query("minmax_nsi", "SELECT snapshot, regime, round(s, 6) AS network_sparsity_norm, round(h, 6) AS hhi_top10_norm, round(rho, 6) AS mean_corr_norm, "
       "round(mu, 6) AS motif_shift_norm, round(nsi, 6) AS nsi FROM nsi", ["nsi"])
def minmax_nsi(spark, sf):
    cols = [f"{c}_norm" for c in C.NSI_WEIGHTS] + ["nsi"]
    return T.snapshot_index(wide(spark, sf)).select("snapshot", "regime", *[F.round(c, 6).alias(c) for c in cols])


_ABL = ", ".join(f"('{n}', {w['network_sparsity']!r}::DOUBLE, {w['hhi_top10']!r}::DOUBLE, {w['mean_corr']!r}::DOUBLE, {w['motif_shift']!r}::DOUBLE)"
                 for n, w in T.ablations() + T.weight_settings())


@query("nsi_ablation", f"""
SELECT config, first(snapshot ORDER BY nsi DESC, snapshot) AS first, list(snapshot ORDER BY nsi DESC, snapshot)[2] AS second,
  bool_and(regime = 'crisis') FILTER (WHERE rn <= 2) AS top2_crises, round(avg(nsi) FILTER (WHERE regime = 'crisis'), 6) AS crisis_mean,
  round(avg(nsi) FILTER (WHERE regime <> 'crisis'), 6) AS other_mean
FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY nsi DESC, snapshot) AS rn FROM (
  SELECT config, snapshot, regime, ws * s + wh * h + wr * rho + wm * mu AS nsi FROM chan, (VALUES {_ABL}) v(config, ws, wh, wr, wm))) GROUP BY 1""", ["chan"])
def nsi_ablation(spark, sf):
    s = T.reweighted(indexed(spark, sf), T.ablations() + T.weight_settings())
    return T.ranked_settings(s).select("config", "first", "second", "top2_crises", F.round("crisis_mean", 6).alias("crisis_mean"), F.round("other_mean", 6).alias("other_mean"))


@query("nsi_ablation_perm")
def nsi_ablation_perm(spark, sf):
    """Exact permutation p of the index under every ablation and weight setting."""
    s = T.reweighted(indexed(spark, sf), T.ablations() + T.weight_settings()).withColumnRenamed("config", "metric").withColumnRenamed("nsi", "value")
    return I.permutation_test(s)


@query("nsi_weight_fit")
def nsi_weight_fit(spark, sf):
    """Index under the simplex weights closest to the window-mean benchmark."""
    t = indexed(spark, sf).join(window_bench(spark, sf).select("snapshot", "bench"), "snapshot")
    return T.reweighted(t, [("benchmark-fit", T.simplex_fit(t, "bench"))])


@query("nsi_dirichlet")
def nsi_dirichlet(spark, sf):
    return T.dirichlet_summary(T.dirichlet_scores(indexed(spark, sf)))


cte("vw", """
SELECT n.snapshot, n.node, coalesce(lv / nullif(sum(lv) OVER (PARTITION BY n.snapshot), 0), 1.0::DOUBLE / count(*) OVER (PARTITION BY n.snapshot)) AS w
FROM nodes n LEFT JOIN (SELECT asset, ln(1 + avg(price * volume)) AS lv FROM nweek GROUP BY 1) v ON v.asset = n.node""", ["nodes", "nweek"])


@query("volume_weighted_nsi", """
SELECT snapshot, round(1 - ew / pw, 6) AS network_sparsity_vw, round(h, 8) AS hhi_vw, round(num / den, 6) + 0.0::DOUBLE AS mean_corr_vw FROM
(SELECT snapshot, (pow(sum(w), 2) - sum(w * w)) / 2 AS pw FROM vw GROUP BY 1)
JOIN (SELECT a.snapshot, sum(x.w * y.w) AS ew FROM arcs a JOIN vw x ON x.snapshot = a.snapshot AND x.node = a.src JOIN vw y ON y.snapshot = a.snapshot AND y.node = a.dst GROUP BY 1) USING (snapshot)
JOIN (SELECT r.snapshot, sum(w * pagerank * pagerank) AS h FROM ranks r JOIN vw ON vw.snapshot = r.snapshot AND vw.node = r.node GROUP BY 1) USING (snapshot)
JOIN (SELECT p.snapshot, sum(x.w * y.w * r) AS num, sum(x.w * y.w) AS den FROM pair p JOIN vw x ON x.snapshot = p.snapshot AND x.node = i JOIN vw y ON y.snapshot = p.snapshot AND y.node = j GROUP BY 1) USING (snapshot)""",
       ["vw", "arcs", "ranks", "pair"])
def volume_weighted_nsi(spark, sf):
    adv = P.dollar_volume(D.nation_weeks(spark, sf), F.col("price"), F.col("volume"))
    w = T.log_volume_weights(N.nodes(spark, sf), adv)
    ch = T.volume_weighted_channels(N.vecs(spark, sf), N.arcs(spark, sf), N.ranks(spark, sf), w)
    return ch.select("snapshot", F.round("network_sparsity_vw", 6).alias("network_sparsity_vw"), F.round("hhi_vw", 8).alias("hhi_vw"), X.rnd("mean_corr_vw").alias("mean_corr_vw"))


@query("weighted_vs_plain")
def weighted_vs_plain(spark, sf):
    """Volume-weighted against plain index, largest plain first."""
    adv = P.dollar_volume(D.nation_weeks(spark, sf), F.col("price"), F.col("volume"))
    w = T.log_volume_weights(N.nodes(spark, sf), adv)
    ch = T.volume_weighted_channels(N.vecs(spark, sf), N.arcs(spark, sf), N.ranks(spark, sf), w)
    plain = indexed(spark, sf).select("snapshot", "regime", "z_ffl", "nsi")
    vw = T.volume_weighted_index(ch, plain.select("snapshot", "regime", "z_ffl")).select("snapshot", "nsi_vw")
    return plain.join(vw, "snapshot").select("snapshot", "regime", "nsi", "nsi_vw", (F.col("nsi_vw") - F.col("nsi")).alias("delta")).orderBy(F.desc("nsi"))


# ------------------------------------------------------------------ rolling and back-test
cte("rollw", f"SELECT s AS w, n.asset, n.pos, n.x FROM (SELECT unnest(range(0, (SELECT count(*) FROM cal) - {WINDOW}, {STEP})) AS s) JOIN nret n ON n.pos BETWEEN s AND s + {WINDOW - 1}", ["cal", "nret"])
cte("rollc", f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY w, asset) AS k FROM rollw) WHERE k = {WINDOW}", ["rollw"])
cte("roll", f"""SELECT c.date, m.mean_corr, m.n_pairs FROM (SELECT w, avg(r) AS mean_corr, count(*) AS n_pairs FROM (
  SELECT a.w, a.asset AS i, b.asset AS j, corr(a.x, b.x) AS r FROM rollc a JOIN rollc b ON a.w = b.w AND a.pos = b.pos AND a.asset < b.asset GROUP BY 1, 2, 3) GROUP BY 1) m
  JOIN cal c ON c.pos = m.w + {WINDOW - 1} WHERE n_pairs >= 20 * 19 / 2""", ["rollc", "cal"])


def rolling(spark, sf):
    def build(s, f):
        cal = D.weeks(s, f)
        rows = T.rolling_complete(T.rolling_panel(D.returns(s, f), cal, WINDOW, STEP), cal, WINDOW, 20)
        return T.rolling_mean_corr(rows, cal, WINDOW)

    return D.stage(spark, sf, "rolling", build)


@query("rolling_window_corr", "SELECT date, round(mean_corr, 6) + 0.0::DOUBLE AS mean_corr, n_pairs::BIGINT AS n_pairs FROM roll", ["roll"])
def rolling_window_corr(spark, sf):
    cal = D.weeks(spark, sf)
    rows = T.rolling_complete(T.rolling_panel(D.returns(spark, sf), cal, WINDOW, STEP), cal, WINDOW, 20)
    return T.rolling_mean_corr(rows, cal, WINDOW).withColumn("mean_corr", X.rnd("mean_corr"))


@query("rolling_nsi")
def rolling_nsi(spark, sf):
    return D.stage(spark, sf, "rolling_nsi", lambda s, f: T.rolling_index(D.returns(s, f), D.weeks(s, f), WINDOW, STEP))


cte("joint", "SELECT date, mean_corr AS nsi, close, row_number() OVER (ORDER BY date) - 1 AS pos FROM roll JOIN bench USING (date)", ["roll", "bench"])
cte("flag", "SELECT *, nsi > quantile_cont(nsi, 0.9) OVER () AS ns, close > quantile_cont(close, 0.9) OVER () AS bs FROM joint", ["joint"])


def _both(spark, sf):
    return T.common_dates(rolling(spark, sf).withColumnRenamed("mean_corr", "nsi"), D.benchmark_daily(spark, sf))


@query("spike_lead_asof", """
SELECT date, CASE WHEN date_diff('day', sig, date) <= 90 THEN sig END AS signal_date, CASE WHEN date_diff('day', sig, date) <= 90 THEN date_diff('day', sig, date) END::INT AS lead_days
FROM (SELECT b.date, max(a.date) AS sig FROM flag b LEFT JOIN flag a ON a.ns AND a.date < b.date WHERE b.bs GROUP BY 1)""", ["flag"])
def spike_lead_asof(spark, sf):
    return T.lead_times(T.spikes(_both(spark, sf)))


@query("backtest_summary", """
SELECT (SELECT count(*) FROM joint)::BIGINT AS n_common, (SELECT round(corr(nsi, close), 6) FROM joint) AS r, count(*)::BIGINT AS n_bench_spikes, count(lead)::BIGINT AS n_signals,
  avg(lead) AS mean_lead, quantile_cont(lead, 0.5)::DOUBLE AS median_lead, round(count(lead) / count(*), 6) AS signal_rate FROM (
  SELECT CASE WHEN date_diff('day', sig, date) <= 90 THEN date_diff('day', sig, date) END AS lead FROM (
    SELECT b.date, max(a.date) AS sig FROM flag b LEFT JOIN flag a ON a.ns AND a.date < b.date WHERE b.bs GROUP BY 1))""", ["flag", "joint"])
def backtest_summary(spark, sf):
    t = T.backtest(rolling(spark, sf).withColumnRenamed("mean_corr", "nsi"), D.benchmark_daily(spark, sf))
    return t.withColumn("r", F.round("r", 6)).withColumn("signal_rate", F.round("signal_rate", 6))


@query("lagged_corr", "SELECT lag::INT AS lag, count(*)::BIGINT AS n, round(corr(a.nsi, b.close), 6) AS r FROM (VALUES (5), (10), (15), (21), (42), (63)) v(lag) "
       "JOIN joint b ON true JOIN joint a ON a.pos = b.pos - lag GROUP BY 1 HAVING count(*) > 20", ["joint"])
def lagged_corr(spark, sf):
    return T.lagged_correlations(_both(spark, sf)).withColumn("r", F.round("r", 6))


@query("cross_correlogram", "SELECT lag::INT AS lag, count(*)::BIGINT AS n, round(corr(a.nsi, b.close), 6) AS r FROM (SELECT unnest(range(-24, 25)) AS lag) v "
       "JOIN joint b ON true JOIN joint a ON a.pos = b.pos - lag GROUP BY 1 HAVING count(*) >= 5", ["joint"])
def cross_correlogram(spark, sf):
    return T.cross_correlogram(_both(spark, sf)).withColumn("r", F.round("r", 6))


def window_bench(spark, sf):
    b = P.in_windows(D.benchmark_daily(spark, sf), D.snapshots(spark)).groupBy("snapshot").agg(F.avg("close").alias("bench"), F.count("*").alias("n_days"))
    return D.snapshots(spark).join(b, "snapshot")


cte("wbench", "SELECT snapshot, avg(close) AS bench, count(*) AS n_days FROM snap JOIN bench ON date BETWEEN d_from AND d_to GROUP BY 1", ["snap", "bench"])


@query("window_mean_benchmark", """
SELECT snapshot, regime, n_days::BIGINT AS n_days, round(bench, 4) AS bench, d_from + (date_diff('day', d_from, d_to) // 2)::INT AS midpoint FROM snap JOIN wbench USING (snapshot)""", ["snap", "wbench"])
def window_mean_benchmark(spark, sf):
    mid = F.expr("date_add(start, int(datediff(end, start) DIV 2))")
    return window_bench(spark, sf).select("snapshot", "regime", "n_days", F.round("bench", 4).alias("bench"), mid.alias("midpoint"))


# ------------------------------------------------------------------ inference
K, NW = sum(r == "crisis" for r in D.REGIMES), D.N_WINDOWS


def _perm_sql(src: str, keys: str, n: int) -> str:
    return f"""
SELECT {keys}, count(*) AS n_perm, count(CASE WHEN c / {K} - (tot - c) / {n - K} >= obs - 1e-12 THEN 1 END) AS n_ge, any_value(obs) AS obs
FROM (SELECT {keys}, m, sum(value) AS c FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY snapshot) - 1 AS idx FROM {src})
      JOIN (SELECT m FROM range({1 << n}) t(m) WHERE bit_count(m) = {K}) ON (m >> idx) & 1 = 1 GROUP BY ALL)
JOIN (SELECT {keys}, sum(value) AS tot, avg(CASE WHEN regime = 'crisis' THEN value END) - avg(CASE WHEN regime <> 'crisis' THEN value END) AS obs FROM {src} GROUP BY ALL) USING ({keys})
GROUP BY {keys}"""


cte("perm", _perm_sql("metrics", "metric", NW), ["metrics"])
cte("ablm", f"SELECT config AS metric, snapshot, regime, ws * s + wh * h + wr * rho + wm * mu AS value FROM chan, (VALUES {_ABL}) v(config, ws, wh, wr, wm)", ["chan"])


@query("perm_exact", "SELECT metric, n_perm::BIGINT AS n_perm, n_ge::BIGINT AS n_ge, round(obs, 6) AS observed, round(n_ge / n_perm, 8) AS p_value FROM perm", ["perm"])
def perm_exact(spark, sf):
    return I.permutation_test(metrics(spark, sf)).select("metric", "n_perm", "n_ge", F.round("observed", 6).alias("observed"), F.round("p_value", 8).alias("p_value"))


def _adj_sql(src: str, part: str) -> str:
    over = f"OVER (PARTITION BY {part} ORDER BY p, metric ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""
SELECT *, least(1, min(p * m / rk) {over}) AS bh, least(1, min((m - rk + 1) * p) {over}) AS hochberg, least(1, min(p * m / rk * hm) {over}) AS by_adj
FROM (SELECT *, (SELECT sum(1.0::DOUBLE / i) FROM range(1, m + 1) t(i)) AS hm FROM (
  SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY p, metric) AS rk, count(*) OVER (PARTITION BY {part}) AS m FROM {src}))"""


@query("fdr_bh_by_hochberg", 'SELECT metric, round(p, 8) AS p_value, round(bh, 8) AS bh, round(by_adj, 8) AS "by", round(hochberg, 8) AS hochberg FROM ('
       + _adj_sql("(SELECT metric, n_ge / n_perm AS p FROM perm)", "true") + ")", ["perm"])
def fdr_bh_by_hochberg(spark, sf):
    t = I.adjust(I.permutation_test(metrics(spark, sf)).select("metric", "p_value"))
    return t.select("metric", *[F.round(c, 8).alias(c) for c in ("p_value", "bh", "by", "hochberg")])


cte("loo", "SELECT d.snapshot AS dropped, m.* FROM metrics m JOIN (SELECT DISTINCT snapshot FROM metrics WHERE regime <> 'crisis') d ON d.snapshot <> m.snapshot", ["metrics"])
cte("loop", "SELECT dropped, metric, n_ge / n_perm AS p FROM (" + _perm_sql("loo", "dropped, metric", NW - 1) + ")", ["loo"])


@query("perm_loo", "SELECT dropped, metric, round(p, 8) AS p_value, round(bh, 8) AS bh FROM (" + _adj_sql("loop", "dropped") + ")", ["loop"])
def perm_loo(spark, sf):
    t = I.leave_one_out(metrics(spark, sf))
    return t.select("dropped", "metric", F.round("p_value", 8).alias("p_value"), F.round("bh", 8).alias("bh"))


cte("merged", "SELECT CASE WHEN snapshot IN ('W13', 'W14') THEN 'W13+' ELSE snapshot END AS snapshot, metric, max_by(regime, snapshot) AS regime, avg(value) AS value FROM metrics GROUP BY 1, 2", ["metrics"])


def _merged(spark, sf):
    return I.merge_windows(metrics(spark, sf), "W13", "W14", "W13+")


@query("perm_merged", "SELECT metric, n_perm::BIGINT AS n_perm, n_ge::BIGINT AS n_ge, round(obs, 6) AS observed FROM ("
       + _perm_sql("merged", "metric", NW - 1).replace(f"c / {K} ", f"c / {K - 1} ").replace(f"/ {NW - 1 - K} >=", f"/ {NW - K} >=").replace(f"bit_count(m) = {K}", f"bit_count(m) = {K - 1}") + ")", ["merged"])
def perm_merged(spark, sf):
    return I.permutation_test(_merged(spark, sf)).select("metric", "n_perm", "n_ge", F.round("observed", 6).alias("observed"))


@query("cohen_d", """
SELECT metric, round(mc, 6) AS crisis_mean, round(mo, 6) AS other_mean, round((mc - mo) / sqrt(((nc - 1) * vc + (no - 1) * vo) / (nc + no - 2)), 6) AS d FROM (
  SELECT metric, avg(value) FILTER (WHERE regime = 'crisis') AS mc, avg(value) FILTER (WHERE regime <> 'crisis') AS mo, var_samp(value) FILTER (WHERE regime = 'crisis') AS vc,
    var_samp(value) FILTER (WHERE regime <> 'crisis') AS vo, count(*) FILTER (WHERE regime = 'crisis') AS nc, count(*) FILTER (WHERE regime <> 'crisis') AS no FROM metrics GROUP BY 1)""", ["metrics"])
def cohen_d(spark, sf):
    return I.cohen_d(metrics(spark, sf)).select("metric", *[F.round(c, 6).alias(c) for c in ("crisis_mean", "other_mean", "d")])


@query("regime_means", "SELECT metric, regime, round(avg(value), 6) AS mean_value, count(*)::BIGINT AS n FROM metrics GROUP BY 1, 2", ["metrics"])
def regime_means(spark, sf):
    return I.regime_means(metrics(spark, sf)).withColumn("mean_value", F.round("mean_value", 6))


@query("spearman_avg_rank", """
SELECT metric, round(corr(value, bench), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*)::BIGINT AS n FROM (
  SELECT metric, value, bench, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY metric ORDER BY bench) + (count(*) OVER (PARTITION BY metric, bench) - 1) / 2 AS ry FROM (
      SELECT metric, round(value, 10) AS value, round(bench, 6) AS bench FROM metrics JOIN wbench USING (snapshot))) GROUP BY 1""", ["metrics", "wbench"])
def spearman_avg_rank(spark, sf):
    t = metrics(spark, sf).join(window_bench(spark, sf).select("snapshot", "bench"), "snapshot").select(
        "metric", F.round("value", 10).alias("value"), F.round("bench", 6).alias("bench"))
    return I.spearman(t, "value", "bench", "metric").withColumn("pearson", F.round("pearson", 6)).withColumn("spearman", F.round("spearman", 6))


cte("mr", "SELECT snapshot, regime, metric, round(value, 10) AS value FROM metrics", ["metrics"])


@query("rank_correlation_prds", """
SELECT a.metric AS m1, b.metric AS m2, round(corr(a.rk, b.rk), 6) + 0.0::DOUBLE AS rho FROM
(SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value, snapshot) AS rk FROM mr) a
JOIN (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value, snapshot) AS rk FROM mr) b ON a.snapshot = b.snapshot AND a.metric < b.metric GROUP BY 1, 2""", ["mr"])
def rank_correlation_prds(spark, sf):
    m = metrics(spark, sf).withColumn("value", F.round("value", 10))
    return I.rank_correlations(m).withColumn("rho", X.rnd("rho"))


@query("ols_band", """
SELECT p.snapshot, round(ic + sl * bench, 6) AS fit, round(sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0::DOUBLE / n + pow(bench - xb, 2) / sxx)), 6) AS se FROM
(SELECT snapshot, bench, nsi FROM nsi JOIN wbench USING (snapshot)) p,
(SELECT regr_slope(nsi, bench) AS sl, regr_intercept(nsi, bench) AS ic, regr_sxx(nsi, bench) AS sxx, regr_syy(nsi, bench) AS syy, regr_sxy(nsi, bench) AS sxy, avg(bench) AS xb, count(*) AS n
 FROM nsi JOIN wbench USING (snapshot))""", ["nsi", "wbench"])
def ols_band(spark, sf):
    t = indexed(spark, sf).select("snapshot", "nsi").join(window_bench(spark, sf).select("snapshot", "bench"), "snapshot")
    return I.ols_band(t, "bench", "nsi").select("snapshot", F.round("fit", 6).alias("fit"), F.round("se", 6).alias("se"))


_TH_AXIS, _TH_ALL = I.bonferroni_threshold(NW), I.bonferroni_threshold(NW * len(METRICS))


@query("bonferroni_scan", f"""
SELECT metric AS axis, count(*)::BIGINT AS n, count(CASE WHEN abs(z) > {_TH_AXIS!r} THEN 1 END)::BIGINT AS n_axis, count(CASE WHEN abs(z) > {_TH_ALL!r} THEN 1 END)::BIGINT AS n_pooled,
  round(max(abs(z)), 6) AS max_abs_z, arg_max(snapshot, abs(z)) AS at FROM (SELECT snapshot, metric, (value - avg(value) OVER (PARTITION BY metric)) / stddev_pop(value) OVER (PARTITION BY metric) AS z FROM metrics)
GROUP BY 1""", ["metrics"])
def bonferroni_scan(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("metric")
    z = metrics(spark, sf).withColumn("z", (F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w))
    return I.bonferroni_scan(z.select("snapshot", F.col("metric").alias("axis"), "z")).select("axis", "n", "n_axis", "n_pooled", F.round("max_abs_z", 6).alias("max_abs_z"), "at")


def _points(spark, sf):
    """Index against window-mean benchmark; neighbouring windows share a cluster."""
    t = indexed(spark, sf).select("snapshot", "nsi").join(window_bench(spark, sf).select("snapshot", "bench"), "snapshot")
    no = F.substring("snapshot", 2, 2).cast("int")
    return t.select(F.expr("int(substring(snapshot, 2, 2)) DIV 2").alias("cluster"), F.col("nsi").alias("x"), F.col("bench").alias("y"), no.alias("pos"))


@query("cluster_bootstrap")
def cluster_bootstrap(spark, sf):
    return I.cluster_bootstrap(_points(spark, sf))


@query("label_shuffle")
def label_shuffle(spark, sf):
    return I.label_shuffle(_points(spark, sf))


@query("label_shuffle_properties", """
SELECT round(corr(nsi, bench), 6) AS r, 100000::BIGINT AS n_draws, true AS p_on_grid, true AS p_fits_r FROM nsi JOIN wbench USING (snapshot)""", ["nsi", "wbench"])
def label_shuffle_properties(spark, sf):
    """Whole draws, a p-value on their grid that is near the normal approximation of a correlation of 20 points."""
    t = D.stage(spark, sf, "label_shuffle", label_shuffle)
    z = F.abs(F.col("r")) * math.sqrt(NW - 1)
    rough = F.exp(-z * z / 2)  # above the two-sided tail
    on_grid = (F.col("p_value") >= 0) & (F.col("p_value") <= 1) & (F.abs(F.col("p_value") * F.col("n_draws") - F.round(F.col("p_value") * F.col("n_draws"))) < 1e-6)
    return t.select(F.round("r", 6).alias("r"), "n_draws", on_grid.alias("p_on_grid"), (F.col("p_value") <= rough + 0.1).alias("p_fits_r"))


@query("block_bootstrap")
def block_bootstrap(spark, sf):
    b = _both(spark, sf).select("pos", F.col("nsi").alias("x"), F.col("close").alias("y"))
    return I.block_bootstrap(b)


@query("block_bootstrap_properties", """
SELECT block::INT AS block, 5000::BIGINT AS n_draws, true AS ordered, true AS holds_r FROM (VALUES (6), (12), (24)) v(block), (SELECT corr(nsi, close) AS r FROM joint)""", ["joint"])
def block_bootstrap_properties(spark, sf):
    """Every draw counts, the interval is ordered and, widened by its own half, holds the plain correlation."""
    b = _both(spark, sf)
    t = attach(D.stage(spark, sf, "block_bootstrap", block_bootstrap), b.agg(F.corr("nsi", "close").alias("r")))
    half = (F.col("hi") - F.col("lo")) / 2
    return t.select("block", "n_draws", ((F.col("lo") < F.col("mean_r")) & (F.col("mean_r") < F.col("hi"))).alias("ordered"),
                    F.col("r").between(F.col("lo") - half, F.col("hi") + half).alias("holds_r"))


cte("secq", """
SELECT snapshot, regime, sum(win / m - pow(deg / (2 * m), 2)) AS q FROM (
  SELECT e.snapshot, c, sum(w_in) AS win, sum(weight) AS deg, any_value(m) AS m FROM (
    SELECT s.snapshot, a.sector AS c, weight, CASE WHEN a.sector = b.sector THEN weight / 2 ELSE 0 END AS w_in FROM sym s
    JOIN sector a ON a.asset = u JOIN sector b ON b.asset = v) e
  JOIN (SELECT snapshot, sum(weight) AS m FROM und GROUP BY 1) t ON t.snapshot = e.snapshot GROUP BY 1, 2) JOIN snap USING (snapshot) GROUP BY 1, 2""", ["sym", "sector", "und", "snap"])
cte("negq", "SELECT snapshot, regime, 'q' AS metric, -q AS value FROM secq", ["secq"])


@query("dissolution_by_sector", "SELECT n_perm::BIGINT AS n_perm, n_ge::BIGINT AS n_ge, round(n_ge / n_perm, 8) AS p_dissolution, round(mc - mo, 6) + 0.0::DOUBLE AS observed FROM ("
       + _perm_sql("negq", "metric", NW) + "), (SELECT avg(q) FILTER (WHERE regime = 'crisis') AS mc, avg(q) FILTER (WHERE regime <> 'crisis') AS mo FROM secq)", ["negq", "secq"])
def dissolution_by_sector(spark, sf):
    """Whether sectors hold together less in crises: modularity of the sector split, negated, one side."""
    q = G.modularity(G.undirected(N.arcs(spark, sf)), N._sector_member(spark, sf)).join(D.snapshots(spark).select("snapshot", "regime"), "snapshot")
    return I.dissolution_test(q.withColumnRenamed("modularity", "q")).select(
        "n_perm", "n_ge", F.round("p_dissolution", 8).alias("p_dissolution"), X.rnd("observed").alias("observed"))


@query("dissolution_density_matched", f"SELECT {math.comb(NW, K)}::BIGINT AS n_perm, true AS p_on_grid, true AS signs_agree")
def dissolution_density_matched(spark, sf):
    """The same test on communities of the threshold networks at one edge budget."""
    q = N.density_matched(spark, sf).select("snapshot", "q").join(D.snapshots(spark).select("snapshot", "regime"), "snapshot")
    t = I.dissolution_test(q)
    return t.select("n_perm", F.col("p_dissolution").between(1 / math.comb(NW, K), 1).alias("p_on_grid"),
                    ((F.col("observed") >= 0) == (F.col("d") >= 0)).alias("signs_agree"))


# ------------------------------------------------------------------ all seven metrics, motif z in the index
def _motifs(spark, sf):
    from tremora.operators import nulls

    return D.stage(spark, sf, "motif_z", lambda s, f: nulls.motif_test(N.arcs(s, f)))


def full_indexed(spark, sf):
    """The index with the triad z of the dyad-preserving null as motif channel."""
    def build(s, f):
        z = _motifs(s, f).select("snapshot", F.col("z_030t").alias("z_ffl"), F.abs(F.coalesce("z_111d", F.lit(0.0))).alias("abs_z_mr"))
        return T.snapshot_index(wide(s, f).drop("z_ffl").join(z, "snapshot", "left"))

    return D.stage(spark, sf, "full_indexed", build)


def full_metrics(spark, sf):
    names = ["nsi", "gini", "hhi", "abs_z_mr", "mutual_dyad_pct", "cross_sector", "mean_rho"]
    return D.stage(spark, sf, "full_metrics", lambda s, f: I.unpivot(full_indexed(s, f).withColumn("mean_rho", F.col("mean_corr")), names))


_DRAWN = ["nsi", "abs_z_mr"]  # rest on drawn null graphs; SQL can repeat the others exactly
_SEVEN = "('nsi'), ('gini'), ('hhi'), ('abs_z_mr'), ('mutual_dyad_pct'), ('cross_sector'), ('mean_rho')"


@query("seven_metrics", f"""
SELECT snapshot, v.metric, CASE WHEN v.metric IN ('nsi', 'abs_z_mr') THEN NULL ELSE round(value, 6) + 0.0::DOUBLE END AS value, true AS in_range
FROM snap CROSS JOIN (VALUES {_SEVEN}) v(metric) LEFT JOIN metrics m USING (snapshot, metric)""", ["snap", "metrics"])
def seven_metrics(spark, sf):
    """All metrics per window; the two that rest on drawn graphs show only that they lie in their range."""
    drawn = F.col("metric").isin(_DRAWN)
    ok = F.when(F.col("metric") == "nsi", F.col("value").between(-1e-9, 1 + 1e-9)).when(F.col("metric") == "abs_z_mr", F.col("value") >= 0).otherwise(F.lit(True))
    return full_metrics(spark, sf).select("snapshot", "metric", F.when(~drawn, X.rnd("value")).alias("value"), F.coalesce(ok, F.lit(False)).alias("in_range"))


@query("seven_perm", f"""
SELECT v.metric, {math.comb(NW, K)}::BIGINT AS n_perm, CASE WHEN v.metric IN ('nsi', 'abs_z_mr') THEN NULL ELSE n_ge END::BIGINT AS n_ge, true AS p_on_grid, true AS adjusted_in_order
FROM (VALUES {_SEVEN}) v(metric) LEFT JOIN perm USING (metric)""", ["perm"])
def seven_perm(spark, sf):
    """Exact permutation test of all seven metrics, adjusted as one family of seven."""
    t = I.permutation_test(full_metrics(spark, sf))
    t = t.join(I.adjust(t.select("metric", "p_value")).drop("p_value"), "metric")
    return t.select("metric", "n_perm", F.when(~F.col("metric").isin(_DRAWN), F.col("n_ge")).alias("n_ge"), F.col("p_value").between(1 / math.comb(NW, K), 1).alias("p_on_grid"),
                    ((F.col("bh") >= F.col("p_value") - 1e-12) & (F.col("by") >= F.col("bh") - 1e-12) & (F.col("hochberg") >= F.col("p_value") - 1e-12)).alias("adjusted_in_order"))


@query("seven_loo", f"SELECT snapshot AS dropped, 7::BIGINT AS n_metrics, {math.comb(NW - 1, K)}::BIGINT AS n_perm, true AS bh_in_order FROM snap WHERE regime <> 'crisis'", ["snap"])
def seven_loo(spark, sf):
    """Leave-one-out tests of all seven metrics."""
    t = I.leave_one_out(full_metrics(spark, sf))
    return t.groupBy("dropped").agg(F.count("*").alias("n_metrics"), F.lit(math.comb(NW - 1, K)).cast("bigint").alias("n_perm"), F.min(F.col("bh") >= F.col("p_value") - 1e-12).alias("bh_in_order"))


@query("seven_merged", f"""
SELECT v.metric, {math.comb(NW - 1, K - 1)}::BIGINT AS n_perm, CASE WHEN v.metric IN ('nsi', 'abs_z_mr') THEN NULL ELSE round(obs, 6) + 0.0::DOUBLE END AS observed, true AS adjusted_in_order
FROM (VALUES {_SEVEN}) v(metric) LEFT JOIN (""" + _perm_sql("merged", "metric", NW - 1).replace(f"c / {K} ", f"c / {K - 1} ").replace(f"/ {NW - 1 - K} >=", f"/ {NW - K} >=").replace(
    f"bit_count(m) = {K}", f"bit_count(m) = {K - 1}") + ") USING (metric)", ["merged"])
def seven_merged(spark, sf):
    """Two neighbouring windows merged: permutation test and adjustment of all seven metrics."""
    t = I.permutation_test(I.merge_windows(full_metrics(spark, sf), "W13", "W14", "W13+"))
    t = t.join(I.adjust(t.select("metric", "p_value")).drop("p_value"), "metric")
    return t.select("metric", "n_perm", F.when(~F.col("metric").isin(_DRAWN), X.rnd("observed")).alias("observed"),
                    ((F.col("bh") >= F.col("p_value") - 1e-12) & (F.col("by") >= F.col("bh") - 1e-12)).alias("adjusted_in_order"))


@query("rank_pairs_summary", "SELECT 21::BIGINT AS n_pairs, true AS in_range, true AS negatives_counted")
def rank_pairs_summary(spark, sf):
    """Rank correlations of all 21 pairs of metrics, summarised."""
    rho = I.rank_correlations(full_metrics(spark, sf))
    t = attach(I.dependence_evidence(rho), rho.agg(F.sum((F.col("rho") < 0).cast("long")).alias("neg")))
    return t.select("n_pairs", ((F.col("min_rho") >= -1) & (F.col("max_rho") <= 1) & (F.col("min_rho") <= F.col("max_rho"))).alias("in_range"),
                    (F.col("n_negative") == F.col("neg")).alias("negatives_counted"))


@query("null_axes_scan", f"""
SELECT axis, {NW}::BIGINT AS n, true AS pooled_is_stricter, true AS range_in_order FROM (VALUES ('z_c'), ('z_030t'), ('z_111d'), ('z_021d')) v(axis)""")
def null_axes_scan(spark, sf):
    """Clustering and triad z of every window against the per-axis and the pooled threshold."""
    z = I.null_axes(N.er_null_z(spark, sf), _motifs(spark, sf))
    t = I.axis_report(z.withColumn("z", F.coalesce("z", F.lit(0.0))))
    return t.select("axis", "n", ((F.col("below_pooled") >= F.col("below_axis")) & (F.col("th_all") > F.col("th_axis"))).alias("pooled_is_stricter"),
                    (F.col("min_abs_z") <= F.col("max_abs_z")).alias("range_in_order"))


@query("nsi_ablation_perm_properties", f"""
SELECT config, {math.comb(NW, K)}::BIGINT AS n_perm, n_ge::BIGINT AS n_ge FROM (SELECT metric AS config, n_ge FROM (""" + _perm_sql("ablm", "metric", NW) + "))", ["ablm"])
def nsi_ablation_perm_properties(spark, sf):
    return nsi_ablation_perm(spark, sf).select(F.col("metric").alias("config"), "n_perm", "n_ge")


@query("power_lattice", """
SELECT metric, round(d, 6) AS d, round(n_ge / n_perm, 8) AS p_value FROM (
  SELECT metric, (mc - mo) / sqrt(((nc - 1) * vc + (no - 1) * vo) / (nc + no - 2)) AS d FROM (
    SELECT metric, avg(value) FILTER (WHERE regime = 'crisis') AS mc, avg(value) FILTER (WHERE regime <> 'crisis') AS mo, var_samp(value) FILTER (WHERE regime = 'crisis') AS vc,
      var_samp(value) FILTER (WHERE regime <> 'crisis') AS vo, count(*) FILTER (WHERE regime = 'crisis') AS nc, count(*) FILTER (WHERE regime <> 'crisis') AS no FROM metrics GROUP BY 1))
JOIN perm USING (metric) WHERE d > 0""", ["metrics", "perm"])
def power_lattice(spark, sf):
    m = metrics(spark, sf)
    return I.power_lattice(I.cohen_d(m), I.permutation_test(m).select("metric", "p_value")).select("metric", F.round("d", 6).alias("d"), F.round("p_value", 8).alias("p_value"))
