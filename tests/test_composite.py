"""Composite likelihood of dynamic correlations over asset pairs."""

import datetime as dt

import numpy as np
import pytest

from tremora.operators import composite


def slow(z, theta, min_rows=2):
    """Pair after pair, date after date."""
    a, b, g = theta
    total = 0.0
    for i in range(len(z)):
        for j in range(i + 1, len(z)):
            both = np.isfinite(z[i]) & np.isfinite(z[j])
            x = z[[i, j]][:, both]
            if x.shape[1] < min_rows:
                continue
            neg = np.minimum(x, 0)
            q_bar, n_bar = np.corrcoef(x), neg @ neg.T / x.shape[1]
            q = q_bar.copy()
            for t in range(1, x.shape[1]):
                q = (1 - a - b) * q_bar - g * n_bar + a * np.outer(x[:, t - 1], x[:, t - 1]) + b * q + g * np.outer(neg[:, t - 1], neg[:, t - 1])
                r = q / np.sqrt(np.outer(np.diag(q), np.diag(q)))
                total += 0.5 * (np.log(np.linalg.det(r)) + x[:, t] @ np.linalg.solve(r, x[:, t]) - x[:, t] @ x[:, t])
    return total


def simulate(rng, p, n, a, b, g):
    base = 0.4 * np.ones((p, p)) + 0.6 * np.eye(p)
    n_bar = 0.25 * base + 0.25 * np.eye(p)
    q, out, prev = base.copy(), np.empty((p, n)), np.zeros(p)
    for t in range(n):
        if t:
            m = np.minimum(prev, 0)
            q = (1 - a - b) * base - g * n_bar + a * np.outer(prev, prev) + b * q + g * np.outer(m, m)
        r = q / np.sqrt(np.outer(np.diag(q), np.diag(q)))
        prev = out[:, t] = np.linalg.cholesky(r) @ rng.normal(size=p)
    return out


def test_value_and_gradient_match_single_pairs():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(7, 60)) + 0.5 * rng.normal(size=60)
    z[2, :20] = z[4, 50:] = z[5, ::3] = np.nan
    points = np.array([[0.05, 0.9, 0.02], [0.1, 0.7, 0.05]])

    def at(theta):
        parts = [(z[:4], z[:4], np.triu(np.ones((4, 4), bool), 1)), (z[:4], z[4:], np.ones((4, 3), bool)), (z[4:], z[4:], np.triu(np.ones((3, 3), bool), 1))]
        got = [composite.pair_value(a, b, u, theta, 2) for a, b, u in parts]
        return sum(v for v, *_ in got), sum(g for _, g, *_ in got), sum(x[4] for x in got)

    value, grad, pairs = at(points)
    assert pairs == 21
    assert np.allclose(value, [slow(z, p) for p in points], atol=1e-8)
    for c in range(3):
        h = np.zeros(3)
        h[c] = 1e-6
        assert np.allclose(grad[:, c], (at(points + h)[0] - at(points - h)[0]) / 2e-6, rtol=1e-4, atol=1e-4)
    assert composite.pair_value(z[:1], z[1:2], np.ones((1, 1), bool), points, 100)[2:] [0] == 0


@pytest.fixture(scope="module")
def panel(spark):
    z = simulate(np.random.default_rng(11), 9, 700, 0.06, 0.88, 0.03)
    z[3, :150] = np.nan
    day = dt.date(2020, 1, 1)
    return z, spark.createDataFrame([(f"A{i}", day + dt.timedelta(t), float(z[i, t])) for i in range(9) for t in range(700) if np.isfinite(z[i, t])],
                                    "asset string, date date, z double")


def test_fit_recovers_parameters_of_all_assets(spark, panel):
    z, rows = panel
    r = composite.fit(rows, block=4).head()
    assert r.status == "ok" and r.converged and r.n_assets == 9 and r.n_pairs == 36 and r.n_converged >= 1
    assert abs(r.a - 0.06) < 0.03 and abs(r.b - 0.88) < 0.06 and 0 <= r.g < 0.09
    n = sum((np.isfinite(z[i]) & np.isfinite(z[j])).sum() - 1 for i in range(9) for j in range(i + 1, 9))
    best = slow(z, (r.a, r.b, r.g)) / n
    assert abs(best - r.nll) < 1e-9
    for step in ((0.005, 0, 0), (-0.005, 0, 0), (0, 0.005, 0), (0, -0.005, 0), (0, 0, 0.005)):
        assert slow(z, np.array((r.a, r.b, r.g)) + step) / n > best


def test_groups_and_short_panels(spark, panel):
    _, rows = panel
    groups = spark.createDataFrame([(g, f"A{i}") for g, ids in ((1, range(4)), (2, range(4, 9)), (3, [0])) for i in ids], "grp int, asset string")
    got = {r.grp: r for r in composite.fit(rows.where("date < '2021-01-01'"), groups).collect()}
    assert {k: (r.n_assets, r.n_pairs) for k, r in got.items()} == {1: (4, 3), 2: (5, 10), 3: (1, 0)}  # one asset of group 1 starts late
    assert got[3].status == "too_short" and got[3].a is None and all(0 < got[g].a + got[g].b + got[g].g < 1 for g in (1, 2) if got[g].converged)
    assert composite.fit(rows.where("date < '2020-02-01'")).head().status == "too_short"


def test_search_ends_at_the_bound_of_a_parameter():
    rng = np.random.default_rng(5)
    z = simulate(rng, 8, 400, 0.2, 0.0, 0.0)  # shocks that are gone a date later
    use = np.triu(np.ones((8, 8), bool), 1)
    for start in composite.adcc_starts():
        s = composite.Search(start)
        while s.state == "open":
            value, grad, n, bad, _ = composite.pair_value(z, z, use, s.trials, 2)
            s.tell(value[0] / n, grad / n, not bad[0], 1e-7)
        assert s.state == "converged" and s.steps <= 40
        theta = composite._inside(s.u)
        around = [np.maximum(theta + d, 1e-9) for c in range(3) for d in (0.004 * np.eye(3)[c], -0.004 * np.eye(3)[c])]
        value, _, n, bad, _ = composite.pair_value(z, z, use, np.array([theta, *around]), 2)
        assert all(b or v >= value[0] - 1e-9 * n for v, b in zip(value[1:], bad[1:]))


def test_passes_read_one_stage_table_without_a_shuffle_and_stay_few(spark, panel, monkeypatch):
    z, rows = panel
    calls, staged, build = [], [], composite.pair_blocks
    monkeypatch.setattr(composite, "pair_blocks", lambda *a: staged.append(build(*a)) or staged[-1])
    run = composite.score
    monkeypatch.setattr(composite, "score", lambda *a: calls.append(a[0]) or run(*a))
    r = composite.fit(rows, block=4).head()
    assert len(staged) == 1 and len(calls) == r.n_passes <= 40 and all(c is staged[0] for c in calls)
    assert r.n_converged == r.n_starts and not r.multi_modal and r.spread < 1e-3
    whole = spark.createDataFrame([(0, i, 9, z[i].tolist()) for i in range(9)], "grp int, idx int, p int, vec array<double>")
    pairs = build(whole, 4)
    assert sorted((b.bi, b.bj, len(b.za), len(b.zb)) for b in pairs.collect()) == [(0, 0, 4, 4), (0, 1, 4, 4), (0, 2, 4, 1), (1, 1, 4, 4), (1, 2, 4, 1), (2, 2, 1, 1)]
    assert abs(run(pairs, {0: {0: [0.05, 0.9, 0.02]}}, 2)[0, 0][0] * sum((np.isfinite(z[i]) & np.isfinite(z[j])).sum() - 1 for i in range(9) for j in range(i + 1, 9))
               - slow(z, (0.05, 0.9, 0.02))) < 1e-6


def test_groups_of_one_block_are_searched_in_one_job(spark, panel, monkeypatch):
    _, rows = panel
    passes = composite.fit(rows, block=4).head()  # nine assets, three blocks
    calls, run = [], composite.score
    monkeypatch.setattr(composite, "score", lambda *a: calls.append(a) or run(*a))
    place = composite.fit(rows).head()
    assert not calls
    assert (place.status, place.n_assets, place.n_pairs, place.n_converged) == (passes.status, passes.n_assets, passes.n_pairs, passes.n_converged)
    assert np.allclose([place.a, place.b, place.g, place.nll], [passes.a, passes.b, passes.g, passes.nll], atol=1e-6)
    groups = spark.createDataFrame([(g, f"A{i}") for g, ids in ((1, range(4)), (2, range(9))) for i in ids], "grp int, asset string")
    mixed = {r.grp: r for r in composite.fit(rows, groups, block=4).collect()}  # one group in place, one by passes
    assert calls and mixed[1].status == "ok" and mixed[1].n_pairs == 6 and abs(mixed[2].nll - passes.nll) < 1e-9


def test_few_series_start_few_tasks(spark):
    from tremora.operators import volatility

    x = np.random.default_rng(2).normal(size=(10, 40)).tolist()
    series = spark.createDataFrame([(i, list(range(40)), v) for i, v in enumerate(x)], "asset int, dates array<int>, vec array<double>")
    fitted = volatility.garch(series)
    assert fitted.rdd.getNumPartitions() == 2  # eight series a task, not one task a shuffle partition
    assert sorted((r.asset, r.n, r.status) for r in fitted.collect()) == [(i, 40, "static") for i in range(10)]
