import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremora.functions.special import f_critical, t_critical
from tremora.operators import community, nulls, pairs, sparse
from tremora.operators import direction as E
from tremora.operators import graph as G


def arcs_of(frame, edges, snap="S"):
    return frame([(snap, s, d, float(w[0]) if w else 1.0) for s, d, *w in edges], "snapshot string, src long, dst long, weight double")


def nodes_of(frame, n, snap="S"):
    return frame([(snap, i) for i in range(n)], "snapshot string, node long")


def vec_table(frame, m, snap="S"):
    return frame([(snap, i, i, len(m), [float(x) for x in row]) for i, row in enumerate(m)],
                 "snapshot string, asset int, idx int, p int, vec array<double>")


def test_critical_values():
    assert abs(t_critical(0.05, 10) - 2.228139) < 1e-5
    assert abs(f_critical(0.05, 1, 10) - 4.964603) < 1e-5
    assert abs(f_critical(0.05, 2, 20) - 3.492828) < 1e-5


@pytest.mark.parametrize("block", [3, 5, 64])
def test_blocked_correlations_equal_numpy(frame, block):
    m = np.random.default_rng(1).normal(size=(11, 40))
    v, want = vec_table(frame, m), np.corrcoef(m)
    got = {(r.i, r.j): r.v for r in pairs.pair_values(v, block=block).collect()}
    assert len(got) == 55 and all(abs(got[i, j] - want[i, j]) < 1e-12 for i, j in got)
    up = want[np.triu_indices(11, 1)]
    assert abs(pairs.mean_correlation(v, block=block).head().mean_corr - up.mean()) < 1e-12
    k = frame([("S", 9)], "snapshot string, k long")
    best = sorted(got, key=lambda e: (-abs(got[e]), e))[:9]
    assert sorted((r.i, r.j) for r in pairs.strongest_pairs(v, k, block=block).collect()) == sorted(best)
    near = {(r.asset, r["rank"]): r.other for r in pairs.strongest_neighbours(v, 4, block=block).collect()}
    for a in range(11):
        order = sorted((x for x in range(11) if x != a), key=lambda x: (-abs(want[a, x]), x))
        assert [near[a, q + 1] for q in range(4)] == order[:4]


def test_ties_inside_the_cut_bin_fall_to_the_smaller_pair(frame):
    m = np.tile(np.random.default_rng(3).normal(size=30), (6, 1))
    k = frame([("S", 4)], "snapshot string, k long")
    got = sorted((r.i, r.j) for r in pairs.strongest_pairs(vec_table(frame, m), k, block=2).collect())
    assert len(got) == 4


def test_column_correlations_fold_over_partitions(frame):
    m = np.random.default_rng(4).normal(size=(200, 5))
    rows = frame([("A" if i % 3 else "B", m[i].tolist()) for i in range(200)], "snapshot string, e array<double>").repartition(5)
    a = np.array([m[i] for i in range(200) if i % 3])
    want = np.corrcoef(a, rowvar=False)
    got = {(r.i, r.j): r.v for r in pairs.column_correlations(rows, "e").where("snapshot = 'A'").collect()}
    assert len(got) == 10 and all(abs(v - want[i - 1, j - 1]) < 1e-9 for (i, j), v in got.items())


def test_threshold_budget_larger_than_available(frame):
    m = np.random.default_rng(2).normal(size=(3, 30))
    k = frame([("S", 100)], "snapshot string, k long")
    assert pairs.strongest_pairs(vec_table(frame, m), k).count() == 3


def test_edge_budget_rule(frame):
    v = frame([("A", i) for i in range(10)] + [("B", i) for i in range(200)], "snapshot string, asset int")
    assert {r.k for r in pairs.edge_budget(v).collect()} == {10}
    assert {r.k for r in pairs.edge_budget(v.where("snapshot = 'B'")).collect()} == {995}


def reference_rbar(z, a, b, g):
    neg = np.minimum(z, 0)
    t, q_bar, n_bar = len(z), np.corrcoef(z, rowvar=False), neg.T @ neg / len(z)
    const, q, acc, used = (1 - a - b) * q_bar - g * n_bar, q_bar, np.zeros_like(q_bar), 0
    for s in range(1, t):
        new = const + a * np.outer(z[s - 1], z[s - 1]) + b * q + g * np.outer(neg[s - 1], neg[s - 1])
        if (np.diag(new) <= 0).any():
            continue
        q = new
        d = np.sqrt(np.diag(q))
        acc, used = acc + q / np.outer(d, d), used + 1
    return acc / used


@pytest.mark.parametrize("params", [(0.03, 0.90, 0.02), (0.01, 0.55, 0.30), (0.01, 0.60, 0.80)])
def test_dynamic_correlation_blocks_equal_matrix_recursion(frame, params):
    z = np.random.default_rng(3).normal(size=(80, 7))
    z[10, 2] = -9.0
    want = reference_rbar(z, *params)
    p = frame([tuple(params)], "a double, b double, g double")
    for r in pairs.adcc_mean_correlation(vec_table(frame, z.T), p, block=3).collect():
        assert abs(r.v - want[r.i, r.j]) < 1e-10


def residual_test(x, y, controls, lag):
    m = np.column_stack([y[:-lag], *[c[lag:] for c in controls]])
    res = lambda v: v - m @ np.linalg.lstsq(m, v, rcond=None)[0]
    return np.corrcoef(res(y[lag:]), res(x[:-lag]))[0, 1]


def test_evidence_against_brute_force_and_planted_lead(frame):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(8, 300))
    m[1, 1:] += 0.6 * m[0, :-1]
    m[3, 1:] -= 0.6 * m[2, :-1]
    v = vec_table(frame, m)
    edges = frame([("S", 0, 1, 0.5), ("S", 2, 3, 0.5), ("S", 4, 5, 0.5)], "snapshot string, i int, j int, weight double")
    near = pairs.strongest_neighbours(v, 6)
    ctl = {}
    for r in near.orderBy("asset", "rank").collect():
        ctl.setdefault(r.asset, []).append(r.other)
    ev = E.evidence(E.ordered_tests(edges, v, near), granger_lags=(1, 2)).collect()
    assert len(ev) == 12
    for r in ev:
        use = [c for c in ctl[r.src] if c != r.dst][:5]
        assert abs(r.r - residual_test(m[r.src], m[r.dst], m[use], 1)) < 1e-9
    dec = E.decide(E.with_rule(E.evidence(E.ordered_tests(edges, v, near)), alpha=0.001))
    got = {(r.i, r.j): r.verdict for r in dec.collect()}
    assert got[0, 1] == "forward" and got[4, 5] == "none"
    lead_only = {(r.i, r.j): r.verdict for r in E.decide(E.with_rule(E.evidence(E.ordered_tests(edges, v, near)), alpha=0.001), "lagged_partial").collect()}
    assert lead_only[0, 1] == "forward" and lead_only[2, 3] == "none"
    with pytest.raises(ValueError):
        E.decide(dec, "other")


def test_short_windows_give_no_evidence(frame):
    v = vec_table(frame, np.random.default_rng(5).normal(size=(3, 7)))
    edges = frame([("S", 0, 1, 0.5)], "snapshot string, i int, j int, weight double")
    assert {(r.r, r.p_r, r.f, r.p_f) for r in E.evidence(E.ordered_tests(edges, v, None, 0)).collect()} == {(0.0, 1.0, 0.0, 1.0)}


def test_direction_rule_cases(frame):
    rows = []
    for n, (rf, pf, rb, pb, gf, gb) in enumerate([(0.6, 0.01, 0.0, 1, 1, 1), (0.6, 0.01, 0.5, 0.01, 1, 1), (0.6, 0.01, 0.3, 0.01, 1, 1),
                                                  (-0.6, 0.01, 0.0, 1, 1, 1), (0, 1, 0, 1, 1, 0.01), (0, 1, 0, 1, 0.01, 0.01)]):
        rows += [("S", 2 * n, 2 * n + 1, 0.4, rf, pf, 1, gf), ("S", 2 * n + 1, 2 * n, 0.4, rb, pb, 1, gb)]
    rows = [(s, a, b, w, float(r), float(p), g, float(pf)) for s, a, b, w, r, p, g, pf in rows]
    ev = frame(rows, "snapshot string, src int, dst int, weight double, r double, p_r double, granger_lag int, p_f double")
    dec = E.decide(E.with_rule(ev)).orderBy("i")
    assert [r.verdict for r in dec.collect()] == ["forward", "mutual", "forward", "none", "backward", "mutual"]
    t = E.tally(dec).head()
    assert (t.n_input, t.n_directed, t.n_mutual, t.n_dropped, t.mutual_fraction) == (6, 3, 2, 1, 0.4)
    assert E.arcs(dec).count() == 7
    assert len(E.grid_cells()) == 14


@pytest.mark.parametrize("edges,want", [
    ([(0, 1), (1, 2), (0, 2)], (1, 0, 0)), ([(0, 1), (0, 2)], (0, 1, 0)), ([(0, 1), (1, 0), (2, 0)], (0, 0, 1)), ([(0, 1), (1, 2), (2, 0)], (0, 0, 0))])
def test_named_triads(frame, edges, want):
    r = G.triad_counts(arcs_of(frame, edges)).head()
    assert (r.n_030t, r.n_021d, r.n_111d) == want


def random_digraph(n, p, seed):
    a = np.random.default_rng(seed).random((n, n)) < p
    np.fill_diagonal(a, False)
    return a


def test_triads_clustering_components_against_enumeration(frame):
    a = random_digraph(14, 0.22, 6)
    e = list(zip(*np.nonzero(a)))
    u = a | a.T
    asym, mut = a & ~a.T, a & a.T
    n = range(14)
    ffl = sum(asym[x, y] and asym[y, z] and asym[x, z] for x, y, z in itertools.permutations(n, 3))
    out = sum(asym[x, y] and asym[x, z] and not u[y, z] for x in n for y, z in itertools.combinations(n, 2) if x not in (y, z))
    mr = sum(mut[x, y] and asym[z, x] and not u[z, y] for x, y, z in itertools.permutations(n, 3))
    arcs = arcs_of(frame, [(int(s), int(d)) for s, d in e])
    r = G.triad_counts(arcs).head()
    assert (r.n_030t, r.n_021d, r.n_111d) == (ffl, out, mr)
    deg = u.sum(1)
    tri = np.array([(u[x][:, None] & u[x][None, :] & u).sum() for x in n])
    want = np.where(deg > 1, tri / np.maximum(deg * (deg - 1), 1), 0).mean()
    assert abs(G.average_clustering(G.undirected(arcs), nodes_of(frame, 14)).head().clustering - want) < 1e-12
    shape = nulls.graph_shape(14, *np.nonzero(np.triu(u)))
    assert abs(shape[0] - want) < 1e-6
    assert abs(G.average_path_length(G.undirected(arcs), nodes_of(frame, 14)).head().path_length - shape[1]) < 1e-12


def test_hub_triangles_do_not_explode(frame):
    star = [(0, i) for i in range(1, 400)] + [(1, 2), (2, 3)]
    dy = G.dyads(arcs_of(frame, star))
    assert G.triangles(dy).count() == 2
    r = G.triad_counts(arcs_of(frame, star)).head()
    assert (r.n_030t, r.n_021d) == (2, 399 * 398 // 2 - 2)


def test_components_two_graphs_and_isolated(frame):
    chain = [(i, i + 1) for i in range(30)]
    arcs = arcs_of(frame, chain).union(arcs_of(frame, [(0, 1), (2, 3)], "T"))
    nodes = nodes_of(frame, 32).union(nodes_of(frame, 5, "T"))
    got = {(r.snapshot, r.node): r.component for r in G.connected_components(G.undirected(arcs), nodes).collect()}
    assert all(got["S", i] == 0 for i in range(31)) and got["S", 31] == 31
    assert [got["T", i] for i in range(5)] == [0, 0, 2, 2, 4]
    r = {x.snapshot: x.path_length for x in G.average_path_length(G.undirected(arcs), nodes).collect()}
    assert r["T"] == 1.0 and abs(r["S"] - 32 / 3) < 1e-9


def test_pagerank_with_dangling_nodes(frame):
    rng = np.random.default_rng(7)
    w = random_digraph(12, 0.2, 8) * rng.random((12, 12))
    w[3] = 0
    arcs = arcs_of(frame, [(int(i), int(j), w[i, j]) for i, j in zip(*np.nonzero(w))])
    s = w.sum(1, keepdims=True)
    p = np.where(s > 0, w / np.maximum(s, 1e-300), 1 / 12)
    x = np.full(12, 1 / 12)
    for _ in range(500):
        x = 0.85 * x @ p + 0.15 / 12
    for it in (dict(tol=1e-12, max_iter=300), dict(iterations=200, every=50)):
        got = {r.node: r.pagerank for r in G.pagerank(arcs, nodes_of(frame, 12), **it).collect()}
        assert max(abs(got[i] - x[i]) for i in range(12)) < 1e-8


@pytest.mark.parametrize("x,want", [([1, 1, 1, 1], 0.0), ([0, 0, 0, 1], 0.75), ([0] * 9 + [1], 0.9), ([0, 0], 0.0)])
def test_gini(frame, x, want):
    t = frame([("S", i, float(v)) for i, v in enumerate(x)], "snapshot string, node int, pagerank double")
    assert abs(G.concentration(t).head().gini - want) < 1e-12


def test_top_concentration(frame):
    x = np.random.default_rng(9).random(15)
    r = G.concentration(frame([("S", i, float(v)) for i, v in enumerate(x)], "snapshot string, node int, pagerank double"), top=5).head()
    w = np.sort(x)[::-1][:5] / np.sort(x)[::-1][:5].sum()
    up = np.sort(w)
    gini = 2 * (np.arange(1, 6) * up).sum() / (5 * up.sum()) - 6 / 5
    assert abs(r.hhi_top - (w * w).sum()) < 1e-12 and abs(r.entropy_top + (w * np.log(w)).sum()) < 1e-12 and abs(r.gini_top - gini) < 1e-12


def test_communities_of_two_cliques(frame):
    e = [(i, j) for b in (0, 6) for i, j in itertools.combinations(range(b, b + 6), 2)] + [(0, 6)]
    und, nodes = G.undirected(arcs_of(frame, e)), nodes_of(frame, 12)
    m = community.louvain(und, nodes)
    lab = {r.node: r.community for r in m.collect()}
    assert len(set(lab.values())) == 2 and len({lab[i] for i in range(6)}) == 1
    assert abs(G.modularity(und, m).head().modularity - (30 / 31 - 2 * 0.25)) < 1e-9


def test_purity_ignores_unclassified(frame):
    m = frame([("S", i, c) for i, c in enumerate([0, 0, 0, 1, 1, 1])], "snapshot string, node long, community int")
    sec = frame([(0, "X"), (1, "X"), (2, "X"), (3, "Y"), (4, "Y")], "asset long, sector string")
    r = G.purity(m, sec).head()
    assert r.purity == 1.0 and abs(r.purity_all - 5 / 6) < 1e-12 and r.n_communities == 2


def test_cross_sector_unknown_counts_as_same(frame):
    p = frame([("S", 0, 1), ("S", 0, 8), ("S", 8, 9)], "snapshot string, i long, j long")
    sec = frame([(0, "X"), (1, "X")], "asset long, sector string")
    assert G.cross_sector(p, sec).head().n_cross == 1


def test_reciprocity_without_edges_is_null(frame):
    r = G.reciprocity(arcs_of(frame, [(0, 1), (1, 0), (1, 2)])).head()
    assert (r.n_directed, r.n_mutual, r.mutual_fraction) == (1, 1, 0.5)


def test_rewiring_preserves_degrees_and_mutuals(frame):
    e = [(2 * i, 2 * i + 1) for i in range(5)] + [(2 * i + 1, 2 * i) for i in range(5)] + [(10 + i, 10 + (i + 1) % 10) for i in range(10)]
    arcs = arcs_of(frame, e)
    got = nulls.rewired_arcs(arcs, 6, seed=1).collect()
    key = lambda rows: (np.bincount([r[0] for r in rows], minlength=20).tolist(), np.bincount([r[1] for r in rows], minlength=20).tolist(),
                        sum((b, a) in set(rows) for a, b in rows))
    changed = 0
    for d in range(6):
        rows = [(r.src, r.dst) for r in got if r.draw == d]
        assert key(rows) == key(e) and len(set(rows)) == len(e)
        changed += set(rows) != set(e)
    assert changed == 6
    again = nulls.rewired_arcs(arcs.repartition(3), 6, seed=1).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_random_graphs_have_exact_size():
    for n, m in ((10, 0), (10, 45), (25, 90)):
        a, b = nulls.random_edges(np.random.default_rng(0), n, m)
        assert len(a) == m and (a < b).all() and (b < n).all() and len({*zip(a.tolist(), b.tolist())}) == m


def test_small_world(frame):
    t = frame([("a", 0.5, 0.125, 2.5, 3.0), ("b", 0.5, 0.0, 2.5, 3.0), ("c", 0.5, 0.1, 2.5, 0.0)], "snapshot string, c double, c0 double, l double, l0 double")
    got = {r.snapshot: r.sigma for r in G.small_world(t).collect()}
    assert abs(got["a"] - 4 / (2.5 / 3)) < 1e-12 and got["b"] is None and got["c"] is None


def factor_corr(p, seed=11):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, 2)) @ rng.normal(size=(2, p)) * 0.6 + rng.normal(size=(400, p))
    return np.corrcoef(x, rowvar=False)


@pytest.mark.parametrize("lam", [0.05, 0.2, 0.5])
def test_glasso_optimality(lam):
    s = factor_corr(15)
    theta, _, gap = sparse.solve_glasso(s, lam)
    w = np.linalg.inv(theta)
    off = ~np.eye(15, dtype=bool)
    assert gap < 1e-6 and np.linalg.eigvalsh(theta)[0] > 0
    assert np.abs(np.diag(w) - 1).max() < 1e-5 and (np.abs(s - w)[off] <= lam + 1e-5).all()
    on = off & (theta != 0)
    assert np.abs((w - s)[on] - lam * np.sign(theta[on])).max() < 1e-5


def test_component_split_equals_whole_problem(frame):
    s = np.eye(12)
    s[:6, :6], s[6:11, 6:11] = factor_corr(6, 1), factor_corr(5, 2)
    corr = frame([("S", i, j, float(s[i, j])) for i, j in itertools.combinations(range(12), 2)], "snapshot string, i long, j long, s double")
    entries, summary = sparse.fit_grid(corr, nodes_of(frame, 12), [0.1])
    theta, _, _ = sparse.solve_glasso(s, 0.1)
    got = {(r.i, r.j): r.omega for r in entries.collect()}
    for i, j in itertools.combinations_with_replacement(range(12), 2):
        assert abs(got.get((i, j), 0.0) - theta[i, j]) < 1e-4
    r = summary.head()
    assert abs(r.logdet - np.linalg.slogdet(theta)[1]) < 1e-4 and abs(r.tr - (s * theta).sum()) < 1e-4
    assert r.k == (np.abs(np.triu(theta, 1)) > 1e-10).sum()


def test_sparse_network_floor_and_partial_correlations(spark, frame):
    s = factor_corr(15)
    pr = frame([("S", i, j, float(s[i, j])) for i, j in itertools.combinations(range(15), 2)] + [("I", i, j, 0.0) for i, j in itertools.combinations(range(15), 2)],
               "snapshot string, i long, j long, v double")
    panel = spark.range(15).withColumnRenamed("id", "asset").withColumn("date", F.explode(F.sequence(F.lit(1), F.lit(60)))).withColumn(
        "snapshot", F.explode(F.array(F.lit("S"), F.lit("I"))))
    edges, sel, grid = sparse.sparse_network(pr, panel)
    r = {x.snapshot: x for x in sel.collect()}
    assert r["S"].status == "ok" and r["S"].k >= 15 and r["I"].status == "no_candidate"
    assert edges.where("snapshot = 'I'").count() == 0 and edges.count() == r["S"].k
    assert edges.agg(F.max("weight")).head()[0] <= 1


def test_early_stop_matches_a_sequential_sweep(frame):
    rng = np.random.default_rng(12)
    for trial in range(4):
        e = np.cumsum(rng.normal(0.3, 1, 25)) if trial else np.arange(25.0)
        k = np.sort(rng.integers(0, 30, 25))
        rows = [(f"S{trial}", 1.0 / (i + 1), float(e[i]), int(k[i]), 12) for i in range(25)]
        best, worse, prev, viable, stop = np.inf, 0, np.inf, False, 25
        for i in range(25):
            if e[i] < best:
                best, worse = e[i], 0
            else:
                worse = worse + 1 if e[i] > prev else 0
            prev, viable = e[i], viable or k[i] >= 12
            if worse >= 8 and viable:
                stop = i + 1
                break
        got = sparse.visited(frame(rows, "snapshot string, lam double, ebic double, k int, p int")).count()
        assert got == stop, trial


def test_tiers(frame):
    from tremora.functions.exprs import ebic_gamma, shrinkage_delta

    want = [(0.1, 0.0, 0.55), (0.2, 0.0, 0.45), (0.3, 0.0, 0.35), (0.5, 0.0, 0.15), (1.0, 0.0, 0.05), (2.0, 0.0, 0.005), (2.999, 0.0, 0.005),
            (3.0, 0.25, 0.005), (4.999, 0.25, 0.005), (5.0, 0.5, 0.005)]
    got = frame([(w[0],) for w in want], "r double").select("r", ebic_gamma("r"), shrinkage_delta("r")).collect()
    assert [tuple(g) for g in got] == want


def test_communities_do_not_depend_on_company(frame):
    from tremora.operators import community

    rng = np.random.default_rng(3)
    pairs = sorted({tuple(sorted(rng.choice(24, 2, replace=False).tolist())) for _ in range(60)})
    one = [("A", a, b, 1.0) for a, b in pairs]
    company = [(f"B{g}", 2 * i, 2 * i + 1, 1.0) for g in range(3) for i in range(10)]

    def labels(edges):
        und = frame(edges, "snapshot string, a int, b int, weight double")
        nodes = frame(sorted({(s, x) for s, a, b, _ in edges for x in (a, b)}), "snapshot string, node int")
        return {r.node: r.community for r in community.louvain(und, nodes).where("snapshot = 'A'").collect()}

    assert labels(one) == labels(one + company)


def test_glasso_converges_with_fewer_days_than_assets():
    from tremora.operators import sparse

    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 60)) + rng.normal(size=(30, 1))
    s = 0.8 * np.corrcoef(x.T) + 0.2 * np.eye(60)
    for lam in (0.4, 0.1, 0.03):
        theta, _, gap = sparse.solve_glasso(s, lam)
        assert gap < 1e-4
        w = np.linalg.inv(theta)
        assert np.abs(np.diag(w) - np.diag(s)).max() < 2e-4 and np.abs(w - s).max() < lam + 2e-4


def random_graphs(frame, n_graphs=3, n=24, m=60):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(n_graphs):
        pairs = sorted({tuple(rng.choice(n, 2, replace=False).tolist()) for _ in range(m)})
        rows += [(f"S{g}", a, b, float(w)) for (a, b), w in zip(pairs, rng.random(len(pairs)) + 0.1)]
    arcs = frame(rows, "snapshot string, src long, dst long, weight double")
    return arcs, frame([(f"S{g}", i) for g in range(n_graphs) for i in range(n + 1)], "snapshot string, node long")


def jobs_of(spark, run):
    """Number of Spark jobs that ``run`` starts."""
    name = f"count-{id(run)}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_small_graphs_take_no_rounds(spark, frame):
    arcs, nodes = random_graphs(frame)
    und = G.undirected(arcs)
    assert jobs_of(spark, lambda: community.louvain(und, nodes).collect()) <= 15
    assert jobs_of(spark, lambda: G.pagerank(arcs, nodes).collect()) <= 20
    assert jobs_of(spark, lambda: G.average_path_length(und, nodes).collect()) <= 15


def test_small_and_large_communities_are_local_optima(frame):
    arcs, nodes = random_graphs(frame, 2, 12, 25)
    und = G.undirected(arcs)
    small, large = community.louvain(und, nodes), community.louvain(und, nodes, small=0)
    for m in (small, large):
        assert m.count() == nodes.count() and m.schema["community"].dataType == nodes.schema["node"].dataType
        assert {r.n_gaining for r in community.gaining_moves(und, m).collect()} == {0}
    a, b = ({r.snapshot: r.modularity for r in G.modularity(und, m).collect()} for m in (small, large))
    assert all(abs(a[s] - b[s]) < 0.1 for s in b)
    first = {(r.snapshot, r.community) for r in small.where("node = community").collect()}
    assert {(r.snapshot, r.community) for r in small.collect()} == first


def test_small_and_large_ranks_and_paths_agree(frame):
    arcs, nodes = random_graphs(frame, 2, 16, 40)
    und = G.undirected(arcs)
    for it in ({"iterations": 7}, {"tol": 1e-7}):
        a, b = ({(r.snapshot, r.node): r for r in G.pagerank(arcs, nodes, small=s, **it).collect()} for s in (G.SMALL, 0))
        assert a.keys() == b.keys() and all(abs(a[x].pagerank - b[x].pagerank) < 1e-14 and a[x].n_iter == b[x].n_iter for x in b)
    with pytest.raises(RuntimeError):
        G.pagerank(arcs, nodes, tol=1e-14, max_iter=3)
    a, b = ({r.snapshot: (r.n_core, r.path_length) for r in G.average_path_length(und, nodes, dense=d).collect()} for d in (G.DENSE, 0))
    assert a == b


def test_rewirings_counted_in_place_agree(frame):
    arcs, _ = random_graphs(frame, 2, 14, 70)
    a, b = ({r.snapshot: r for r in nulls.motif_test(arcs, 7, dense=d).collect()} for d in (G.DENSE, 0))
    assert a.keys() == b.keys() and all(r.n_111d_sd > 0 for r in a.values())
    assert all(abs(x - y) < 1e-9 for s in a for x, y in zip(a[s][1:], b[s][1:]))  # draws are averaged in another order
