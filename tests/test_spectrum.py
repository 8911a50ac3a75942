"""Smallest eigenvalues at any size and the penalised path of one component."""

import numpy as np
import pytest

from tremora.operators import quality, sparse, spectrum


def pair_rows(name, m):
    return [(name, i, j, float(m[i, j])) for i in range(len(m)) for j in range(i + 1, len(m)) if m[i, j]]


def test_smallest_eigenvalues_match_dense_ones(frame):
    rng = np.random.default_rng(2)
    full = np.corrcoef(rng.normal(size=(80, 14)).T)
    singular = np.corrcoef(rng.normal(size=(9, 16)).T)
    indefinite = np.clip(np.corrcoef(rng.normal(size=(9, 12)).T) * 1.4, -1, 1)
    np.fill_diagonal(indefinite, 1)
    blocks = np.eye(8)
    blocks[0, 1] = blocks[1, 0] = blocks[2, 3] = blocks[3, 2] = 0.5
    cases = {"full": full, "singular": singular, "indefinite": indefinite, "blocks": blocks, "identity": np.eye(3)}
    pairs = frame([r for k, m in cases.items() for r in pair_rows(k, m)], "snapshot string, i int, j int, v double")
    nodes = frame([(k, i) for k, m in cases.items() for i in range(len(m))], "snapshot string, node int")
    got = {r["snapshot"]: r for r in spectrum.smallest_eigenvalues(pairs, nodes).collect()}
    assert set(got) == set(cases)
    for k, m in cases.items():
        assert abs(got[k]["low"] - np.linalg.eigvalsh(m)[0]) < 1e-6 and got[k]["steps"] <= len(m) + 10
    assert spectrum.smallest_eigenvalues(pairs.limit(0), nodes.limit(0)).count() == 0
    checks = {r["snapshot"]: r["passed"] for r in quality.definiteness(pairs).collect()}
    assert not checks["indefinite"] and checks["full"] and checks["blocks"]


def test_small_windows_are_solved_in_place_and_large_ones_by_steps(frame):
    """Both ways agree, pairs in either order and of unknown nodes included; only windows above the bound take steps."""
    rng = np.random.default_rng(5)
    cases = {"six": np.corrcoef(rng.normal(size=(20, 6)).T), "nine": np.corrcoef(rng.normal(size=(20, 9)).T), "alone": np.eye(1)}
    rows = [r for k, m in cases.items() for r in pair_rows(k, m)]
    rows = [(k, j, i, v) if i % 2 else (k, i, j, v) for k, i, j, v in rows] + [("six", 0, 99, 0.9), ("gone", 0, 1, 0.9)]
    pairs = frame(rows, "snapshot string, i int, j int, v double")
    nodes = frame([(k, i) for k, m in cases.items() for i in range(len(m))], "snapshot string, node int")
    want = {k: np.linalg.eigvalsh(m)[0] for k, m in cases.items()}
    for dense, stepped in ((1000, set()), (6, {"nine"}), (0, set(cases))):
        got = {r["snapshot"]: r for r in spectrum.smallest_eigenvalues(pairs, nodes, dense=dense).collect()}
        assert {k for k, r in got.items() if r["steps"]} == stepped and set(got) == set(cases)
        assert max(abs(got[k]["low"] - v) for k, v in want.items()) < 1e-6


def factors(rng, n, p, delta):
    x = rng.normal(size=(n, 3)) @ rng.normal(size=(3, p)) * 0.7 + rng.normal(size=(n, p))
    return (1 - delta) * np.corrcoef(x.T) + delta * np.eye(p)


@pytest.mark.parametrize("p, delta", [(40, 0.05), (120, 0.15), (160, 0.45)])
def test_path_is_optimal_at_every_penalty(p, delta):
    s = factors(np.random.default_rng(7), 126, p, delta)
    off = ~np.eye(p, dtype=bool)
    path = list(sparse.solve_path(s, sparse.lambda_grid()))
    assert len(path) == 25
    for lam, theta, _, worst, gap, reason in path:
        w = np.linalg.inv(theta)
        assert reason == "optimal" and worst < 1e-6 and -1e-9 <= gap < 1e-3
        assert np.abs(w - s)[off].max() <= lam + 1e-6 and np.abs(np.diag(w) - np.diag(s)).max() < 1e-6
        assert np.abs((w - s - lam * np.sign(theta))[off & (theta != 0)]).max(initial=0) < 1e-6
    lam, theta = path[12][:2]
    assert np.abs(sparse.solve_glasso(s, lam)[0] - theta).max() < 1e-4  # a cold start ends at the same point


def test_one_shift_for_all_components_of_a_window(frame):
    """Two separate pairs; only one is indefinite, yet both see the shifted diagonal."""
    rows = [("A", 0, 1, 1.1), ("A", 2, 3, 0.6), ("B", 0, 1, 0.5)]
    corr = frame(rows, "snapshot string, i int, j int, s double")
    nodes = frame([("A", i) for i in range(5)] + [("B", i) for i in range(3)], "snapshot string, node int")
    shift = sparse.spectral_shift(corr, nodes)
    got = {r["snapshot"]: r["shift"] for r in shift.collect()}
    assert got["B"] == 0.0 and abs(got["A"] - (1e-4 + 0.1)) < 1e-6
    entries, summary = sparse.fit_grid(corr, nodes, [0.7, 0.2], shift)
    diag = {(r["snapshot"], r["lam"], r["i"]): r["omega"] for r in entries.where("i = j").collect()}
    assert abs(diag["A", 0.7, 4] - 1 / (1 + got["A"])) < 1e-12 and abs(diag["A", 0.7, 2] - 1 / (1 + got["A"])) < 1e-9
    assert diag["B", 0.2, 2] == 1.0
    assert {r["reason"] for r in summary.collect()} == {"optimal"} and summary.count() == 4
