import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremora import config as C
from tremora.operators import inference as I
from tremora.operators import stress as T
from tremora.operators import volatility as V


def table(frame, values, n_crisis, metric="m"):
    return frame([(f"W{i:02d}", "crisis" if i < n_crisis else "baseline", metric, float(v)) for i, v in enumerate(values)],
                 "snapshot string, regime string, metric string, value double")


@pytest.mark.parametrize("values,k,want", [
    ([9, 8, 1, 2, 3, 1, 2, 3, 1, 2], 2, 1 / 45), ([1] * 10, 2, 1.0), ([0, 0, 1, 2, 3, 4, 5, 6, 7, 8], 2, 1.0), ([5, 1, 1, 1, 1, 1, 1, 1, 1, 1], 1, 1 / 10),
    (list(range(20, 0, -1)), 7, 1 / 77520)])
def test_permutation_p(frame, values, k, want):
    r = I.permutation_test(table(frame, values, k)).head()
    assert abs(r.p_value - want) < 1e-12


def test_permutation_matches_enumeration(frame):
    rng = np.random.default_rng(0)
    v = rng.normal(size=11)
    obs = v[:4].mean() - v[4:].mean()
    n = sum(np.mean(v[list(c)]) - np.delete(v, c).mean() >= obs - 1e-12 for c in itertools.combinations(range(11), 4))
    r = I.permutation_test(table(frame, v, 4)).head()
    assert (r.n_ge, r.n_perm) == (n, 330)


def test_adjustments(frame):
    p = frame([("a", 0.01), ("b", 0.04), ("c", 0.05), ("d", 0.20)], "metric string, p_value double")
    got = {r.metric: r for r in I.adjust(p).collect()}
    h = 1 + 1 / 2 + 1 / 3 + 1 / 4
    for m, bh in (("a", 0.04), ("b", 0.2 / 3), ("c", 0.2 / 3), ("d", 0.20)):
        assert abs(got[m].bh - bh) < 1e-12 and abs(got[m].by - min(1, bh * h)) < 1e-12
    assert [round(got[m].hochberg, 12) for m in "abcd"] == [0.04, 0.1, 0.1, 0.2]


def test_cohen_d(frame):
    a = table(frame, [1, 2, 3, 4, 5, 6], 3, "down").union(table(frame, [2, 2, 1, 1], 2, "up"))
    got = {r.metric: r.d for r in I.cohen_d(a).collect()}
    assert abs(got["down"] + 3) < 1e-12 and got["up"] == float("inf")


def test_bonferroni_thresholds():
    assert [round(I.bonferroni_threshold(m), 3) for m in (10, 1, 40)] == [2.807, 1.96, 3.227]


def test_spearman_ties(frame):
    t = frame([(1.0, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 3.0)], "x double, y double")
    r = I.spearman(t, "x", "y").head()
    want = np.corrcoef([1.5, 1.5, 3, 4], [1, 2, 3.5, 3.5])[0, 1]
    assert abs(r.spearman - want) < 1e-12


def test_leave_one_out_and_merge(frame):
    m = table(frame, [5, 4, 3, 1, 1, 1, 2], 2, "a").union(table(frame, [1, 4, 3, 1, 1, 1, 2], 2, "b"))
    loo = I.leave_one_out(m).collect()
    assert len(loo) == 10 and {r.dropped for r in loo} == {"W02", "W03", "W04", "W05", "W06"}
    merged = I.merge_windows(m, "W00", "W01", "W0x").where("metric = 'a' AND snapshot = 'W0x'").head()
    assert merged.value == 4.5


def test_resampling_is_deterministic_and_covers(frame):
    rng = np.random.default_rng(1)
    x = rng.normal(size=24)
    y = x + 0.4 * rng.normal(size=24)
    pts = frame([(int(i // 2), float(a), float(b), i) for i, (a, b) in enumerate(zip(x, y))], "cluster int, x double, y double, pos int")
    c1, c2 = I.cluster_bootstrap(pts, 400).head(), I.cluster_bootstrap(pts.repartition(3), 400).head()
    assert c1 == c2 and c1.pearson_lo < np.corrcoef(x, y)[0, 1] < c1.pearson_hi
    s = I.label_shuffle(pts, 500).head()
    assert s.p_value < 0.01
    b = I.block_bootstrap(pts, (3, 6), 200).orderBy("block").collect()
    assert [r.block for r in b] == [3, 6] and all(r.lo < r.mean_r < r.hi for r in b)


def test_index_range_constant_channel_and_weights(frame):
    rows = [("a", "crisis", 10, 45, 0.1, 0.3, 2.0), ("b", "baseline", 10, 45, 0.2, 0.1, 1.0), ("c", "baseline", 10, 45, 0.3, 0.2, None)]
    t = frame(rows, "snapshot string, regime string, n_nodes int, n_edges int, hhi_top10 double, mean_corr double, z_ffl double")
    r = {x.snapshot: x for x in T.snapshot_index(t).collect()}
    assert all(x.network_sparsity_norm == 0 for x in r.values()) and all(0 <= x.nsi <= 1 for x in r.values())
    assert r["a"].motif_shift == 4.0 and r["c"].motif_shift == 0.0
    assert abs(r["a"].nsi - (0.35 + 0.20)) < 1e-12
    with pytest.raises(ValueError):
        T.index(t, {"hhi_top10": 0.9, "mean_corr": 0.2})


def test_weight_settings():
    names = list(C.NSI_WEIGHTS)
    for _, w in T.weight_settings() + T.ablations():
        assert list(w) == names and abs(sum(w.values()) - 1) < 1e-12 and min(w.values()) >= 0
    assert len(T.weight_settings()) == 16
    assert T.perturbed(C.NSI_WEIGHTS, "hhi_top10", -0.5) is None


def test_simplex_fit_beats_a_grid(frame):
    rng = np.random.default_rng(2)
    x = rng.random((12, 4))
    y = x @ [0.5, 0.0, 0.5, 0.0] + 0.05 * rng.normal(size=12)
    names = list(C.NSI_WEIGHTS)
    t = frame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{n}_norm double" for n in names) + ", bench double")
    w = np.array(list(T.simplex_fit(t, "bench").values()))
    target = (y - y.min()) / (y.max() - y.min())
    loss = lambda v: ((x @ v - target) ** 2).sum()
    assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0
    assert all(loss(w) <= loss(v) + 1e-9 for v in rng.dirichlet(np.ones(4), 3000))


def test_log_volume_weights(frame):
    n = frame([("S", 0), ("S", 1), ("T", 5)], "snapshot string, node int")
    adv = frame([(0, 100.0)], "asset int, adv double")
    got = {(r.snapshot, r.node): r.w for r in T.log_volume_weights(n, adv).collect()}
    assert got == {("S", 0): 1.0, ("S", 1): 0.0, ("T", 5): 1.0}


def dates(n):
    return [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]


def test_rolling_windows_exclude_the_last(spark, frame):
    cal = frame([(d, i) for i, d in enumerate(dates(20))], "date date, pos int")
    r = cal.withColumn("asset", F.lit(1)).withColumn("x", F.col("pos").cast("double"))
    rows = T.rolling_panel(r, cal, window=8, step=4).groupBy("snapshot").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).orderBy("snapshot").collect()
    assert [(x.snapshot, x.lo, x.hi) for x in rows] == [(0, 0, 7), (4, 4, 11), (8, 8, 15)]


def test_backtest(frame):
    d = dates(60)
    idx = frame([(d[i], float(i % 30)) for i in range(60)], "date date, nsi double")
    bench = frame([(d[i], float((i - 2) % 30)) for i in range(2, 60)], "date date, close double")
    r = T.backtest(idx, bench).head()
    assert r.n_common == 58 and r.n_signals == r.n_bench_spikes and r.signal_rate == 1.0 and r.median_lead <= 2
    lag = {x.lag: x.r for x in T.lagged_correlations(T.common_dates(idx, bench), (0, 2, 5)).collect()}
    assert abs(lag[2] - 1) < 1e-12 and lag[5] < 1


def garch_path(n, seed=3, scale=1.0):
    rng = np.random.default_rng(seed)
    e, s2 = np.empty(n), 0.05 / 0.03
    for t in range(n):
        e[t] = np.sqrt(s2) * rng.normal()
        s2 = 0.05 + 0.07 * e[t] ** 2 + 0.90 * s2
    return scale * e / 100


def test_garch_ragged_batch_status_and_scale(spark, frame):
    rows = [("long", garch_path(900)), ("scaled", garch_path(900, scale=3.0)), ("other", garch_path(400, 5)), ("mid", garch_path(100)), ("tiny", garch_path(10))]
    t = frame([(a, dates(len(v)), [float(x) for x in v]) for a, v in rows], "asset string, dates array<date>, vec array<double>").coalesce(1)
    got = {r.asset: r for r in V.garch(t).collect()}
    assert [got[a].status for a in ("long", "other", "mid", "tiny")] == ["garch", "garch", "static", "short"]
    z = np.array(got["long"].z)
    assert abs(z.mean()) < 0.05 and abs(z.var() - 1) < 0.08 and 0 < got["long"].alpha + got["long"].beta < 1
    assert np.abs(z - np.array(got["scaled"].z)).max() < 0.05
    assert len(got["other"].z) == 400
    assert V.residuals(V.garch(t)).count() == 900 + 900 + 400 + 100


def test_garch_filter_fold(frame):
    v = [0.1, -0.2, 0.3]
    got = [r.s2 for r in V.garch_filter(frame([("a", dates(3), v)], "asset string, dates array<date>, vec array<double>"), 0.05, 0.07, 0.9).orderBy("date").collect()]
    s = np.mean(np.square(v))
    want = [s]
    for e in v[:2]:
        want.append(0.05 + 0.07 * e * e + 0.9 * want[-1])
    assert np.allclose(got, want)


def test_dynamic_likelihood_and_fit(frame):
    z = np.random.default_rng(4).normal(size=(300, 4))
    q, n = np.corrcoef(z, rowvar=False), np.minimum(z, 0).T @ np.minimum(z, 0) / 300
    a, b, g = 0.03, 0.9, 0.02
    const, qt, ll = (1 - a - b) * q - g * n, q, 0.0
    for t in range(1, 300):
        m = np.minimum(z[t - 1], 0)
        qt = const + a * np.outer(z[t - 1], z[t - 1]) + b * qt + g * np.outer(m, m)
        d = np.sqrt(np.diag(qt))
        r = qt / np.outer(d, d)
        ll += np.linalg.slogdet(r)[1] + z[t] @ np.linalg.solve(r, z[t]) - z[t] @ z[t]
    for chunk in (7, 256):
        assert abs(V.adcc_nll(np.array([a, b, g]), z, q, n, chunk) - 0.5 * ll) < 1e-8
    assert V.adcc_nll(np.array([0.3, 0.7, 0.1]), z, q, n) == 1e10
    long = frame([(int(k), d, float(z[i, k])) for i, d in enumerate(dates(300)) for k in range(4)], "asset int, date date, z double")
    fit = V.adcc_fit(long, long.select("asset").distinct()).head()
    assert fit.a + fit.b + fit.g < 1 and fit.n_rows == 300 and fit.n_ok >= 1 and fit.nll <= V.adcc_nll(np.array([0.02, 0.95, 0.01]), z, q, n)
    short = V.adcc_fit(long.where(F.col("date") < dates(300)[100]), long.select("asset").distinct()).head()
    assert short.n_ok == 0 and short.a is None


def test_unit_roots(frame):
    rng = np.random.default_rng(5)
    noise, walk = rng.normal(size=250), np.cumsum(rng.normal(size=250))
    t = frame([("S", "noise", noise.tolist()), ("S", "walk", walk.tolist()), ("S", "short", [1.0] * 10), ("S", "flat", [1.0] * 60)], "snapshot string, asset string, vec array<double>")
    got = {r.asset: r.reject for r in V.adf(t).collect()}
    assert got == {"noise": True, "walk": False, "short": None, "flat": None}
    assert V.adf_rates(V.adf(t)).head().reject_rate == 0.5


def test_simplex_scores_at_most_two_points_a_round():
    asked = []

    def bowl(points, rows):
        asked.append(len(points))
        return ((points - rows[:, None]) ** 2 * [1.0, 3.0]).sum(axis=1)

    pts, val, used = V.minimise(bowl, np.zeros((5, 2)))
    assert np.allclose(pts, np.arange(5)[:, None], atol=1e-2) and val.max() < 1e-4
    assert sum(n for n in asked[1:]) <= used * 5 * 2 + 5 * 2 * used // 4  # two trial points a round, shrinking is rare


def test_garch_fits_a_bounded_number_of_series_together(frame, monkeypatch):
    rows = [(f"a{i:02d}", dates(260), garch_path(260, i).tolist()) for i in range(7)]
    t = frame(rows, "asset string, dates array<date>, vec array<double>").coalesce(1)
    want = {a: V.fit_garch(100.0 * np.array([v]), np.ones((1, 260), bool)) for a, _, v in rows}
    sizes, run = [], V.fit_garch
    monkeypatch.setattr(V, "FIT_BATCH", 3)
    monkeypatch.setattr(V, "fit_garch", lambda y, live: sizes.append(len(y)) or run(y, live))
    monkeypatch.setattr(V, "spread", lambda s: s)

    class Rows:
        schema = t.schema

        def mapInPandas(self, fn, schema):
            return next(iter(fn(iter([t.toPandas()]))))

    got = V.garch(Rows()).set_index("asset")
    assert sizes == [3, 3, 1]
    assert all(abs(got.loc[a, "nll"] - w["nll"][0]) < 1e-9 and np.allclose(got.loc[a, "z"], w["z"][0]) for a, w in want.items())
