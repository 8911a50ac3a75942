"""Volatility, dynamic-correlation and unit-root queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremora import config as C
from tremora.operators import composite
from tremora.operators import pairs as A
from tremora.operators import panel as P
from tremora.operators import selection as S
from tremora.operators import volatility as V
from tremora.plans import catalogue_network as N
from tremora.plans import standin as D
from tremora.plans.registry import query
from tremora.session import values

_GARCH = (0.05, 0.07, 0.90)


@query("garch_filter_fold", f"""
SELECT asset, date, round(s2, 6) AS s2 FROM (
  WITH s AS MATERIALIZED (SELECT asset, date, x, row_number() OVER (PARTITION BY asset ORDER BY date) AS t, avg(x * x) OVER (PARTITION BY asset) AS v0 FROM nret),
  f AS (SELECT asset, date, t, x, v0 AS s2 FROM s WHERE t = 1
        UNION ALL SELECT s.asset, s.date, s.t, s.x, {_GARCH[0]}::DOUBLE + {_GARCH[1]}::DOUBLE * f.x * f.x + {_GARCH[2]}::DOUBLE * f.s2
        FROM f JOIN s ON s.asset = f.asset AND s.t = f.t + 1)
  SELECT * FROM f)""".replace("  WITH s AS", "  WITH RECURSIVE s AS"), ["nret"])
def garch_filter_fold(spark, sf):
    return V.garch_filter(V.series_of(D.returns(spark, sf)), *_GARCH).withColumn("s2", F.round("s2", 6))


def fits(spark, sf):
    return D.stage(spark, sf, "garch", lambda s, f: V.garch(V.series_of(D.stage(s, f, "supplier_returns", D.supplier_returns))))


@query("garch_fit")
def garch_fit(spark, sf):
    """Model per supplier over its whole history."""
    r = D.stage(spark, sf, "supplier_returns", D.supplier_returns)
    return V.garch(V.series_of(r)).drop("dates", "z")


@query("garch_residuals")
def garch_residuals(spark, sf):
    return V.residuals(fits(spark, sf))


def _nation_residuals(spark, sf):
    return D.stage(spark, sf, "nation_resid", lambda s, f: V.residuals(V.garch(V.series_of(D.returns(s, f)))))


def adcc_params(spark, sf):
    return D.stage(spark, sf, "adcc", lambda s, f: composite.fit(_nation_residuals(s, f)))


@query("adcc_mle")
def adcc_mle(spark, sf):
    """Pooled parameters of all assets by composite likelihood, all starts."""
    return adcc_params(spark, sf)


def _groups(spark, sf):
    """Two sector-stratified subsets of the assets."""
    one, two = (S.stratified_subset(D.sectors(spark, sf), 15, seed).select(F.lit(seed).alias("grp"), "asset") for seed in (1, 2))
    return one.unionByName(two)


def _subset_params(spark, sf):
    def build(s, f):
        return composite.fit(_nation_residuals(s, f), _groups(s, f))

    return D.stage(spark, sf, "adcc_subsets", build)


@query("adcc_subset_sensitivity")
def adcc_subset_sensitivity(spark, sf):
    """Pooled parameters on two sector-stratified subsets."""
    return _subset_params(spark, sf)


@query("adcc_properties", """
SELECT grp, n AS n_assets, n * (n - 1) // 2 AS n_pairs, 6 AS n_starts, true AS converged, true AS admissible, true AS no_better_nearby
FROM (SELECT 0 AS grp, count(DISTINCT asset) AS n FROM nret UNION ALL SELECT 1, 15 UNION ALL SELECT 2, 15)""", ["nret"])
def adcc_properties(spark, sf):
    """The fits of all assets and of two subsets converge inside the admissible region, and points around them are no better."""
    out = None
    for shift, fitted, groups in ((0, adcc_params(spark, sf), None), (1, _subset_params(spark, sf), True)):
        rows = fitted.collect()  # one row a group
        sub = None if groups is None else D.stage(spark, sf, "adcc_groups", _groups)
        vecs = composite.grid_vectors(_nation_residuals(spark, sf), sub)
        around = {r.grp: {0: [r.a, r.b, r.g], **{i + 1: [max(v + d, 1e-9) for v, d in zip((r.a, r.b, r.g), step)]
                                                  for i, step in enumerate(_STEPS)}} for r in rows}
        got = composite.evaluate(vecs, around, C.ADCC_MIN_ROWS)
        best = {r.grp: all(got[r.grp, i + 1][3] or got[r.grp, i + 1][0] >= got[r.grp, 0][0] - 1e-9 for i in range(len(_STEPS))) for r in rows}
        flag = values(spark, list(best.items()), ["grp", "no_better_nearby"], ["INT", "BOOLEAN"])
        inside = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("g") > 0) & (F.col("a") + F.col("b") + F.col("g") < 1)
        t = fitted.join(flag, "grp").select("grp", F.col("n_assets").cast("long").alias("n_assets"), F.col("n_pairs").cast("long").alias("n_pairs"), "n_starts",
                                            "converged", inside.alias("admissible"), "no_better_nearby")
        out = t if out is None else out.unionByName(t)
    return out


_STEPS = [(s if c == 0 else 0.0, s if c == 1 else 0.0, s if c == 2 else 0.0) for c in range(3) for s in (0.004, -0.004)]


@query("adcc_window_correlation")
def adcc_window_correlation(spark, sf):
    """Window-average dynamic correlation of the fitted residuals."""
    cc = P.complete_cases(_nation_residuals(spark, sf), D.snapshots(spark), D.weeks(spark, sf), value="z")
    return A.adcc_mean_correlation(A.vectors(cc, "z"), adcc_params(spark, sf))


@query("adf_rates")
def adf_rates(spark, sf):
    return V.adf_rates(V.adf(N.vecs(spark, sf)))


@query("adf_full_panel")
def adf_full_panel(spark, sf):
    """Unit-root test per supplier over the full history."""
    r = D.stage(spark, sf, "supplier_returns", D.supplier_returns)
    v = V.series_of(r).withColumn("snapshot", F.lit("full")).select("snapshot", "asset", "vec")
    return V.adf(v)
