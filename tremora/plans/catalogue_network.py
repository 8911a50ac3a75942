"""Pair, direction and graph queries over the stand-in windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremora import config as C
from tremora.functions import exprs as X
from tremora.functions.special import f_critical, t_critical
from tremora.operators import community, nulls, sparse
from tremora.operators import direction as E
from tremora.operators import graph as G
from tremora.operators import pairs as A
from tremora.operators import panel as P
from tremora.plans import ctes  # noqa: F401
from tremora.plans import standin as D
from tremora.plans.registry import cte, query

DENSITY, ALPHA = 0.3, 0.3  # denser, looser networks: the stand-in returns are close to independent


def vecs(spark, sf):
    return D.stage(spark, sf, "vectors", lambda s, f: A.vectors(D.window_panel(s, f)))


def strong(spark, sf):
    def build(s, f):
        v = vecs(s, f)
        return A.strongest_pairs(v, A.edge_budget(v, density=DENSITY))

    return D.stage(spark, sf, "strong", build)


def simple_evidence(spark, sf):
    """Evidence without controls on the threshold edges, Granger orders one and two."""
    def build(s, f):
        e = strong(s, f).withColumn("weight", F.abs("v"))
        return E.evidence(E.ordered_tests(e, vecs(s, f), None, 0), granger_lags=(1, 2))

    return D.stage(spark, sf, "evidence0", build)


def arcs(spark, sf):
    def build(s, f):
        ev = E.with_rule(simple_evidence(s, f).where("granger_lag = 1"), alpha=ALPHA)
        return E.arcs(E.decide(ev))

    return D.stage(spark, sf, "arcs", build)


def nodes(spark, sf):
    return vecs(spark, sf).select("snapshot", F.col("asset").alias("node"))


# ------------------------------------------------------------------ reference SQL blocks
cte("budget", f"SELECT snapshot, round_even({DENSITY}::DOUBLE * (min(p) OVER () * (min(p) OVER () - 1) / 2), 0)::BIGINT AS k FROM pdim", ["pdim"])
cte("strong", "SELECT snapshot, i, j, r AS v, rn AS rank FROM (SELECT *, row_number() OVER "
              "(PARTITION BY snapshot ORDER BY abs(r) DESC, i, j) AS rn FROM pair) JOIN budget USING (snapshot) WHERE rn <= k",
    ["pair", "budget"])
cte("wlag", "SELECT snapshot, asset, date, x, lag(x) OVER (PARTITION BY snapshot, asset ORDER BY date) AS x1 FROM wcc", ["wcc"])
cte("ordered", "SELECT snapshot, i AS src, j AS dst, abs(v) AS weight FROM strong UNION ALL SELECT snapshot, j, i, abs(v) FROM strong", ["strong"])
_TCRIT = ", ".join(f"({df}, {t_critical(ALPHA, df)!r}::DOUBLE, {f_critical(ALPHA, 1, df)!r}::DOUBLE)" for df in range(20, 60))
cte("crit", f"SELECT * FROM (VALUES {_TCRIT}) t(df, tc, fc)")
# y(t) and x(t-1) projected on y(t-1) without intercept, then correlated; Granger F from three correlations
cte("evid", """
SELECT snapshot, src, dst, weight, n, r, r * sqrt((n - 2) / (1 - r * r)) AS t, (n - 3) * rho * rho / (1 - rho * rho) AS f
FROM (SELECT *, (r2 - r1 * r3) / sqrt((1 - r1 * r1) * (1 - r3 * r3)) AS rho FROM (
  SELECT snapshot, src, dst, any_value(weight) AS weight, count(*) AS n,
         corr(y - cy * y1, x1 - cx * y1) AS r, corr(y, y1) AS r1, corr(y, x1) AS r2, corr(y1, x1) AS r3
  FROM (SELECT o.*, s.x1, d.x AS y, d.x1 AS y1,
          sum(d.x * d.x1) OVER w / sum(d.x1 * d.x1) OVER w AS cy, sum(s.x1 * d.x1) OVER w / sum(d.x1 * d.x1) OVER w AS cx
        FROM ordered o JOIN wlag s ON s.snapshot = o.snapshot AND s.asset = o.src
        JOIN wlag d ON d.snapshot = o.snapshot AND d.asset = o.dst AND d.date = s.date
        WHERE s.x1 IS NOT NULL WINDOW w AS (PARTITION BY o.snapshot, o.src, o.dst))
  GROUP BY 1, 2, 3))""", ["ordered", "wlag"])


def _decided(alpha_r, alpha_f, tau, floor):
    """Verdict per undirected edge from ``evid`` joined with critical values."""
    return f"""
SELECT snapshot, i, j, weight, CASE WHEN fwd = 0 AND bwd = 0 THEN 'none' WHEN bwd = 0 THEN 'forward' WHEN fwd = 0 THEN 'backward'
  WHEN fwd >= {tau}::DOUBLE * bwd THEN 'forward' WHEN bwd >= {tau}::DOUBLE * fwd THEN 'backward' ELSE 'mutual' END AS verdict
FROM (SELECT snapshot, least(src, dst) AS i, greatest(src, dst) AS j, max(weight) AS weight,
        coalesce(max(CASE WHEN src < dst THEN conf END), 0) AS fwd, coalesce(max(CASE WHEN src > dst THEN conf END), 0) AS bwd
      FROM (SELECT e.*, greatest(CASE WHEN t > a.tc THEN r ELSE 0 END, CASE WHEN f > b.fc THEN {floor}::DOUBLE ELSE 0 END) AS conf
            FROM evid e JOIN {alpha_r} a ON a.df = n - 2 JOIN {alpha_f} b ON b.df = n - 3) GROUP BY 1, 2, 3)"""


cte("decided", _decided("crit", "crit", C.TAU, C.GRANGER_FLOOR), ["evid", "crit"])
cte("arcs", "SELECT snapshot, i AS src, j AS dst, weight FROM decided WHERE verdict IN ('forward', 'mutual') "
            "UNION ALL SELECT snapshot, j, i, weight FROM decided WHERE verdict IN ('backward', 'mutual')", ["decided"])
cte("nodes", "SELECT DISTINCT snapshot, asset AS node FROM wcc", ["wcc"])
cte("und", "SELECT DISTINCT snapshot, least(src, dst) AS a, greatest(src, dst) AS b, weight FROM arcs", ["arcs"])
cte("sym", "SELECT snapshot, a AS u, b AS v, weight FROM und UNION ALL SELECT snapshot, b, a, weight FROM und", ["und"])


# ------------------------------------------------------------------ pairs
def flagship(spark, sf):
    """Per window: size, mean correlation and cross-sector share of the strongest pairs."""
    cal, snaps = D.weeks(spark, sf), D.snapshots(spark)
    from tremora.session import materialize

    panel = materialize(P.complete_cases(D.returns(spark, sf), snaps, cal, min_assets=5), "flagship")
    v = A.vectors(panel)
    top = A.strongest_pairs(v, A.edge_budget(v))
    size = panel.groupBy("snapshot").agg(F.countDistinct("asset").alias("p"), F.countDistinct("date").alias("n_days"))
    return (
        snaps.select("snapshot", "regime").join(size, "snapshot")
        .join(A.mean_correlation(v).select("snapshot", "mean_corr"), "snapshot")
        .join(G.cross_sector(top, D.sectors(spark, sf)), "snapshot")
        .select("snapshot", "regime", "p", "n_days", X.rnd("mean_corr").alias("mean_corr"), X.rnd("cs_fraction").alias("cs_fraction"))
    )


query("flagship_comovement", """
SELECT snapshot, regime, p::BIGINT AS p, n_days::BIGINT AS n_days, round(mean_corr, 6) + 0.0::DOUBLE AS mean_corr, round(cs, 6) + 0.0::DOUBLE AS cs_fraction
FROM snap JOIN pdim USING (snapshot) JOIN (SELECT snapshot, avg(r) AS mean_corr FROM pair GROUP BY 1) USING (snapshot)
JOIN (SELECT snapshot, avg(CASE WHEN a.sector <> b.sector THEN 1.0::DOUBLE ELSE 0 END) AS cs FROM (
  SELECT snapshot, i, j FROM (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY abs(r) DESC, i, j) AS rn FROM pair)
  JOIN (SELECT snapshot, greatest(min(p) OVER (), round_even(0.05::DOUBLE * (min(p) OVER () * (min(p) OVER () - 1) / 2), 0)) AS k FROM pdim) USING (snapshot)
  WHERE rn <= k) JOIN sector a ON a.asset = i JOIN sector b ON b.asset = j GROUP BY 1) USING (snapshot)""",
      ["snap", "pdim", "pair", "sector"])(flagship)


@query("pair_corr", "SELECT snapshot, i, j, round(r, 6) + 0.0::DOUBLE AS r FROM pair", ["pair"])
def pair_corr(spark, sf):
    return A.pair_values(vecs(spark, sf)).select("snapshot", "i", "j", X.rnd("v").alias("r"))


@query("mean_corr_upper", "SELECT snapshot, count(*)::BIGINT AS n_pairs, round(avg(r), 6) + 0.0::DOUBLE AS mean_corr FROM pair GROUP BY 1", ["pair"])
def mean_corr_upper(spark, sf):
    return A.mean_correlation(vecs(spark, sf)).select("snapshot", "n_pairs", X.rnd("mean_corr").alias("mean_corr"))


@query("neg_second_moment", "SELECT a.snapshot, a.asset AS i, b.asset AS j, round(avg(least(a.x, 0) * least(b.x, 0)), 7) AS v FROM wcc a JOIN wcc b "
       "ON a.snapshot = b.snapshot AND a.date = b.date AND a.asset <= b.asset GROUP BY 1, 2, 3", ["wcc"])
def neg_second_moment(spark, sf):
    return A.pair_values(vecs(spark, sf), A.second_moment_block, diagonal=True).withColumn("v", F.round("v", 7))


@query("threshold_topk", "SELECT snapshot, i, j, round(v, 6) AS v FROM strong", ["strong"])
def threshold_topk(spark, sf):
    v = vecs(spark, sf)
    return A.strongest_pairs(v, A.edge_budget(v, density=DENSITY)).withColumn("v", F.round("v", 6))


cte("swin", "SELECT snapshot, asset, date, x FROM sret JOIN snap ON date BETWEEN d_from AND d_to", ["sret", "snap"])
cte("scc", """
SELECT snapshot, date, asset, x FROM (SELECT *, count(*) OVER (PARTITION BY snapshot, date) AS k FROM swin JOIN (
    SELECT snapshot, asset FROM (SELECT snapshot, asset, count(*) AS n FROM swin GROUP BY 1, 2) JOIN wrows USING (snapshot)
    WHERE n >= greatest(30, floor(n_rows * 0.8::DOUBLE))) USING (snapshot, asset))
JOIN (SELECT snapshot, count(*) AS p FROM (SELECT snapshot, asset, count(*) AS n FROM swin GROUP BY 1, 2) JOIN wrows USING (snapshot)
    WHERE n >= greatest(30, floor(n_rows * 0.8::DOUBLE)) GROUP BY 1) USING (snapshot) WHERE k = p""", ["swin", "wrows"])


@query("supplier_pairs_topk", """
SELECT snapshot, i, j, round(r, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY abs(r) DESC, i, j) AS rn,
    min(p) OVER () AS p0 FROM (
  SELECT a.snapshot, a.asset AS i, b.asset AS j, corr(a.x, b.x) AS r, any_value(p) AS p FROM scc a JOIN scc b
    ON a.snapshot = b.snapshot AND a.date = b.date AND a.asset < b.asset JOIN (SELECT snapshot, count(DISTINCT asset) AS p FROM scc GROUP BY 1) s ON s.snapshot = a.snapshot GROUP BY 1, 2, 3))
WHERE rn <= greatest(p0, round_even(0.05::DOUBLE * (p0 * (p0 - 1) / 2), 0))""", ["scc"])
def supplier_pairs_topk(spark, sf):
    """Threshold network over all suppliers: the blocked path on a universe that grows with the data."""
    r = D.stage(spark, sf, "supplier_returns", D.supplier_returns)
    v = D.stage(spark, sf, "supplier_vectors", lambda s, f: A.vectors(P.complete_cases(r, D.snapshots(s), D.weeks(s, f))))
    return A.strongest_pairs(v, A.edge_budget(v)).withColumn("v", F.round("v", 6))


@query("cross_sector_fraction", """
SELECT snapshot, count(*)::BIGINT AS n_edges, sum(CASE WHEN a.sector <> b.sector THEN 1 ELSE 0 END)::BIGINT AS n_cross,
  round(avg(CASE WHEN a.sector <> b.sector THEN 1.0::DOUBLE ELSE 0 END), 6) AS cs_fraction
FROM strong JOIN sector a ON a.asset = i JOIN sector b ON b.asset = j GROUP BY 1""", ["strong", "sector"])
def cross_sector_fraction(spark, sf):
    return G.cross_sector(strong(spark, sf), D.sectors(spark, sf)).withColumn("cs_fraction", X.rnd("cs_fraction"))


@query("top5_controls", """
SELECT snapshot, asset, other, round(v, 6) + 0.0::DOUBLE AS v, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY snapshot, asset ORDER BY abs(v) DESC, other) AS rn
FROM (SELECT snapshot, i AS asset, j AS other, r AS v FROM pair UNION ALL SELECT snapshot, j, i, r FROM pair)) WHERE rn <= 6""", ["pair"])
def top5_controls(spark, sf):
    return A.strongest_neighbours(vecs(spark, sf), 6).withColumn("v", X.rnd("v"))


@query("shrinkage_tiers", """
SELECT snapshot, p::BIGINT AS p, n_days::BIGINT AS n, round(n_days / p, 6) AS ratio,
  CASE WHEN n_days / p < 3 THEN 0 WHEN n_days / p < 5 THEN 0.25 ELSE 0.5 END::DOUBLE AS gamma,
  CASE WHEN n_days / p < 0.2 THEN 0.55 WHEN n_days / p < 0.3 THEN 0.45 WHEN n_days / p < 0.5 THEN 0.35 WHEN n_days / p < 1 THEN 0.15
       WHEN n_days / p < 2 THEN 0.05 ELSE 0.005 END::DOUBLE AS delta FROM pdim""", ["pdim"])
def shrinkage_tiers(spark, sf):
    return sparse.window_sizes(D.window_panel(spark, sf)).withColumn("ratio", X.rnd("ratio"))


@query("corr_embeddings", """
SELECT a.label AS snapshot, a.d::INT AS i, b.d::INT AS j, round(corr(a.v, b.v), 5) + 0.0::DOUBLE AS v FROM
  (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) a
  JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) b
  ON a.vec_id = b.vec_id AND a.d < b.d GROUP BY 1, 2, 3""")
def corr_embeddings(spark, sf):
    """Correlation of the embedding dimensions over all rows of a label."""
    e = D.table(spark, sf, "embeddings").select(F.col("label").alias("snapshot"), "embedding")
    return A.column_correlations(e, "embedding").withColumn("v", X.rnd("v", 5))


# ------------------------------------------------------------------ direction
@query("granger_lag1_f", "SELECT snapshot, src, dst, round(f, 5) + 0.0::DOUBLE AS f FROM evid", ["evid"])
def granger_lag1_f(spark, sf):
    return simple_evidence(spark, sf).where("granger_lag = 1").select("snapshot", "src", "dst", X.rnd("f", 5).alias("f"))


@query("lagged_partial_plain", "SELECT snapshot, src, dst, round(r, 6) + 0.0::DOUBLE AS r, t > tc AS leads FROM evid JOIN crit ON df = n - 2", ["evid", "crit"])
def lagged_partial_plain(spark, sf):
    return simple_evidence(spark, sf).where("granger_lag = 1").select(
        "snapshot", "src", "dst", X.rnd("r").alias("r"), ((F.col("p_r") < ALPHA) & (F.col("r") > 0)).alias("leads"))


def _projection_sql(n_controls: int) -> str:
    """Reference SQL of the controlled test: successive orthogonalisation of long vectors."""
    body = f"""
near AS MATERIALIZED (SELECT snapshot, asset, other, row_number() OVER (PARTITION BY snapshot, asset ORDER BY abs(v) DESC, other) AS rn
  FROM (SELECT snapshot, i AS asset, j AS other, r AS v FROM pair UNION ALL SELECT snapshot, j, i, r FROM pair)),
ctl AS MATERIALIZED (SELECT o.snapshot, src, dst, other, row_number() OVER (PARTITION BY o.snapshot, src, dst ORDER BY rn) AS c
  FROM ordered o JOIN near ON near.snapshot = o.snapshot AND near.asset = o.src AND near.other <> o.dst),
v0 AS MATERIALIZED (
  SELECT o.snapshot, src, dst, date, 'x' AS role, x1 AS val FROM ordered o JOIN wlag s ON s.snapshot = o.snapshot AND s.asset = src WHERE x1 IS NOT NULL
  UNION ALL SELECT o.snapshot, src, dst, date, 'y', x FROM ordered o JOIN wlag s ON s.snapshot = o.snapshot AND s.asset = dst WHERE x1 IS NOT NULL
  UNION ALL SELECT o.snapshot, src, dst, date, 'q0', x1 FROM ordered o JOIN wlag s ON s.snapshot = o.snapshot AND s.asset = dst WHERE x1 IS NOT NULL
  UNION ALL SELECT c.snapshot, src, dst, date, 'q' || c, x FROM ctl c JOIN wlag s ON s.snapshot = c.snapshot AND s.asset = other
    WHERE x1 IS NOT NULL AND c <= {n_controls})"""
    for k in range(n_controls + 1):
        body += f""",
v{k + 1} AS MATERIALIZED (SELECT snapshot, src, dst, date, role, val - qv * sum(val * qv) OVER w / sum(qv * qv) OVER w AS val
  FROM (SELECT v.*, q.val AS qv FROM v{k} v JOIN v{k} q USING (snapshot, src, dst, date) WHERE q.role = 'q{k}' AND v.role <> 'q{k}')
  WINDOW w AS (PARTITION BY snapshot, src, dst, role))"""
    last = f"v{n_controls + 1}"
    return f"""SELECT * FROM (WITH {body}
SELECT a.snapshot, a.src, a.dst, round(corr(a.val, b.val), 6) + 0.0::DOUBLE AS r FROM {last} a JOIN {last} b USING (snapshot, src, dst, date)
WHERE a.role = 'x' AND b.role = 'y' GROUP BY 1, 2, 3)"""


@query("fwl_evidence", _projection_sql(C.N_CONTROLS), ["pair", "ordered", "wlag"])
def fwl_evidence(spark, sf):
    e = strong(spark, sf).withColumn("weight", F.abs("v"))
    tests = E.ordered_tests(e, vecs(spark, sf), A.strongest_neighbours(vecs(spark, sf), C.N_CONTROLS + 1))
    return E.evidence(tests).select("snapshot", "src", "dst", X.rnd("r").alias("r"))


@query("direction_rule", "SELECT snapshot, i, j, round(weight, 6) AS weight, verdict FROM decided", ["decided"])
def direction_rule(spark, sf):
    ev = E.with_rule(simple_evidence(spark, sf).where("granger_lag = 1"), alpha=ALPHA)
    return E.decide(ev).select("snapshot", "i", "j", F.round("weight", 6).alias("weight"), "verdict")


_GRID = [(a, t, 1, f) for a in C.ALPHA_GRID for t in C.TAU_GRID for f in C.FLOOR_GRID]
for _a in C.ALPHA_GRID:
    cte(f"crit{int(_a * 100)}", "SELECT * FROM (VALUES " + ", ".join(
        f"({df}, {t_critical(_a, df)!r}::DOUBLE, {f_critical(_a, 1, df)!r}::DOUBLE)" for df in range(20, 60)) + ") t(df, tc, fc)")


@query("direction_grid", " UNION ALL ".join(
    f"SELECT {a}::DOUBLE AS alpha, {t}::DOUBLE AS tau, {f}::DOUBLE AS floor, snapshot, count(*)::BIGINT AS n_input, "
    f"count(CASE WHEN verdict IN ('forward', 'backward') THEN 1 END)::BIGINT AS n_directed, count(CASE WHEN verdict = 'mutual' THEN 1 END)::BIGINT AS n_mutual "
    f"FROM ({_decided(f'crit{int(a * 100)}', f'crit{int(a * 100)}', t, f)}) GROUP BY snapshot" for a, t, _, f in _GRID), ["evid", "crit5", "crit10"])
def direction_grid(spark, sf):
    ev = E.with_cells(simple_evidence(spark, sf), _GRID)
    return E.tally(E.decide(ev)).select("alpha", "tau", "floor", "snapshot", "n_input", "n_directed", "n_mutual")


@query("direction_sweep")
def direction_sweep(spark, sf):
    """The full rule grid with both Granger orders, averaged by regime."""
    ev = E.with_cells(simple_evidence(spark, sf), E.grid_cells())
    return E.regime_means(E.tally(E.decide(ev)), D.snapshots(spark))


# ------------------------------------------------------------------ graph
@query("mutual_fraction", """
SELECT snapshot, sum(1 - m)::BIGINT AS n_directed, sum(m)::BIGINT AS n_mutual, round(avg(m::DOUBLE), 6) AS mutual_fraction FROM (
  SELECT snapshot, a, b, CASE WHEN count(*) = 2 THEN 1 ELSE 0 END AS m FROM (SELECT snapshot, least(src, dst) AS a, greatest(src, dst) AS b FROM arcs) GROUP BY 1, 2, 3)
GROUP BY 1""", ["arcs"])
def mutual_fraction(spark, sf):
    return G.reciprocity(arcs(spark, sf)).withColumn("mutual_fraction", X.rnd("mutual_fraction"))


@query("degree_stats", """
SELECT snapshot, node, (SELECT count(*) FROM arcs a WHERE a.snapshot = n.snapshot AND src = node)::BIGINT AS out_deg,
  (SELECT count(*) FROM arcs a WHERE a.snapshot = n.snapshot AND dst = node)::BIGINT AS in_deg FROM nodes n""", ["nodes", "arcs"])
def degree_stats(spark, sf):
    return G.directed_degrees(arcs(spark, sf), nodes(spark, sf))


@query("mean_degree", "SELECT snapshot, n_nodes::BIGINT AS n_nodes, n_edges::BIGINT AS n_edges, round(2 * n_edges / n_nodes, 6) AS mean_degree FROM "
       "(SELECT snapshot, count(*) AS n_nodes FROM nodes GROUP BY 1) JOIN (SELECT snapshot, count(*) AS n_edges FROM arcs GROUP BY 1) USING (snapshot)", ["nodes", "arcs"])
def mean_degree(spark, sf):
    return G.mean_degree(arcs(spark, sf), nodes(spark, sf)).withColumn("mean_degree", X.rnd("mean_degree"))


@query("avg_clustering", """
SELECT snapshot, round(avg(coalesce(2.0::DOUBLE * t / nullif(d * (d - 1), 0), 0)), 6) AS clustering FROM (
  SELECT n.snapshot, n.node, (SELECT count(*) FROM sym s WHERE s.snapshot = n.snapshot AND s.u = n.node) AS d,
    (SELECT count(*) FROM sym p JOIN sym q ON p.snapshot = q.snapshot AND p.u = q.u AND p.v < q.v
       JOIN und e ON e.snapshot = p.snapshot AND e.a = p.v AND e.b = q.v WHERE p.snapshot = n.snapshot AND p.u = n.node) AS t
  FROM nodes n) GROUP BY 1""", ["nodes", "sym", "und"])
def avg_clustering(spark, sf):
    return G.average_clustering(G.undirected(arcs(spark, sf)), nodes(spark, sf)).withColumn("clustering", X.rnd("clustering"))


cte("asym", "SELECT * FROM arcs x WHERE NOT EXISTS (SELECT 1 FROM arcs y WHERE y.snapshot = x.snapshot AND y.src = x.dst AND y.dst = x.src)", ["arcs"])
cte("mut", "SELECT x.* FROM arcs x JOIN arcs y ON y.snapshot = x.snapshot AND y.src = x.dst AND y.dst = x.src", ["arcs"])


@query("triad_counts", """
SELECT g.snapshot,
 (SELECT count(*) FROM asym a JOIN asym b ON b.snapshot = a.snapshot AND a.dst = b.src JOIN asym c ON c.snapshot = a.snapshot AND c.src = a.src AND c.dst = b.dst WHERE a.snapshot = g.snapshot)::BIGINT AS n_030t,
 (SELECT count(*) FROM asym a JOIN asym b ON b.snapshot = a.snapshot AND a.src = b.src AND a.dst < b.dst WHERE a.snapshot = g.snapshot
   AND NOT EXISTS (SELECT 1 FROM und u WHERE u.snapshot = a.snapshot AND u.a = a.dst AND u.b = b.dst))::BIGINT AS n_021d,
 (SELECT count(*) FROM mut m JOIN asym c ON c.snapshot = m.snapshot AND c.dst = m.src WHERE m.snapshot = g.snapshot
   AND NOT EXISTS (SELECT 1 FROM und u WHERE u.snapshot = m.snapshot AND u.a = least(c.src, m.dst) AND u.b = greatest(c.src, m.dst)))::BIGINT AS n_111d
FROM (SELECT DISTINCT snapshot FROM arcs) g""", ["asym", "mut", "und", "arcs"])
def triad_counts(spark, sf):
    return G.triad_counts(arcs(spark, sf))


def _rank_sql(rounds: int) -> str:
    """PageRank as a chain of blocks; the mass of nodes without arcs goes evenly to all nodes of their graph."""
    steps = ["pn AS MATERIALIZED (SELECT snapshot, node, count(*) OVER (PARTITION BY snapshot) AS n FROM nodes)",
             "pw AS MATERIALIZED (SELECT snapshot, src, dst, weight / sum(weight) OVER (PARTITION BY snapshot, src) AS p FROM arcs)",
             "p0 AS MATERIALIZED (SELECT snapshot, node, n, NOT EXISTS (SELECT 1 FROM pw w WHERE w.snapshot = pn.snapshot AND w.src = pn.node) AS ends,"
             " 1.0::DOUBLE / n AS y FROM pn)"]
    for i in range(rounds):
        steps.append(f"""p{i + 1} AS MATERIALIZED (SELECT b.snapshot, b.node, b.n, b.ends, 0.15::DOUBLE / b.n
    + 0.85::DOUBLE * (coalesce(f.s, 0) + coalesce(sum(b.y) FILTER (WHERE b.ends) OVER (PARTITION BY b.snapshot), 0) / b.n) AS y
  FROM p{i} b LEFT JOIN (SELECT w.snapshot, w.dst, sum(y * p) AS s FROM pw w JOIN p{i} q ON q.snapshot = w.snapshot AND q.node = w.src GROUP BY 1, 2) f
  ON f.snapshot = b.snapshot AND f.dst = b.node)""")
    return "SELECT * FROM (WITH " + ",\n".join(steps) + f" SELECT snapshot, node, y AS pagerank FROM p{rounds})"


cte("ranks", _rank_sql(120), ["nodes", "arcs"])
cte("ranks20", """
SELECT snapshot, node, y / sum(y) OVER (PARTITION BY snapshot) AS pagerank FROM (
  WITH RECURSIVE n AS (SELECT snapshot, node, count(*) OVER (PARTITION BY snapshot) AS n FROM nodes),
  w AS (SELECT snapshot, src, dst, weight / sum(weight) OVER (PARTITION BY snapshot, src) AS p FROM arcs),
  walk AS (SELECT snapshot, node, 1.0::DOUBLE / n AS y, 0 AS t FROM n
    UNION ALL SELECT snapshot, node, sum(y) AS y, t + 1 FROM (
      SELECT w.snapshot, w.dst AS node, k.y * w.p * 0.85::DOUBLE AS y, k.t FROM walk k JOIN w ON w.snapshot = k.snapshot AND w.src = k.node WHERE k.t < 20)
    GROUP BY snapshot, node, t)
  SELECT snapshot, node, sum(y) AS y FROM walk GROUP BY snapshot, node)""", ["nodes", "arcs"])


def ranks(spark, sf):
    return D.stage(spark, sf, "ranks", lambda s, f: G.pagerank(arcs(s, f), nodes(s, f), tol=1e-10, max_iter=300))


@query("pagerank_iter20", "SELECT snapshot, node, round(pagerank, 7) AS pagerank FROM ranks20", ["ranks20"])
def pagerank_iter20(spark, sf):
    return G.pagerank(arcs(spark, sf), nodes(spark, sf), iterations=20).select("snapshot", "node", F.round("pagerank", 7).alias("pagerank"))


@query("pagerank_converged", "SELECT snapshot, node, round(pagerank, 7) AS pagerank FROM ranks", ["ranks"])
def pagerank_converged(spark, sf):
    return ranks(spark, sf).select("snapshot", "node", F.round("pagerank", 7).alias("pagerank"))


@query("pagerank_leaders", "SELECT snapshot, node, round(round(pagerank, 9), 7) AS pagerank, rn::INT AS rank FROM (SELECT *, row_number() OVER "
       "(PARTITION BY snapshot ORDER BY round(pagerank, 9) DESC, node) AS rn FROM ranks) WHERE rn <= 20", ["ranks"])
def pagerank_leaders(spark, sf):
    r = ranks(spark, sf).select("snapshot", "node", F.round("pagerank", 9).alias("pagerank"))
    return G.leaders(r).withColumn("pagerank", F.round("pagerank", 7))


cte("conc", """
SELECT snapshot, count(*) AS n_nodes, sum(x * x) AS hhi, 2 * sum(up * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*) AS gini,
  sum(CASE WHEN dn <= 10 THEN x * x END) / pow(sum(CASE WHEN dn <= 10 THEN x END), 2) AS hhi_top, gini_top, entropy_top
FROM (SELECT *, 2 * sum(CASE WHEN dn <= 10 THEN (11 - dn) * x END) OVER w / (10 * sum(CASE WHEN dn <= 10 THEN x END) OVER w) - 11 / 10 AS gini_top,
        -sum(CASE WHEN dn <= 10 THEN x / tot * ln(x / tot) END) OVER w AS entropy_top
      FROM (SELECT *, sum(CASE WHEN dn <= 10 THEN x END) OVER (PARTITION BY snapshot) AS tot FROM (
        SELECT snapshot, pagerank AS x, row_number() OVER (PARTITION BY snapshot ORDER BY pagerank, node) AS up,
          row_number() OVER (PARTITION BY snapshot ORDER BY pagerank DESC, node) AS dn FROM ranks)) WINDOW w AS (PARTITION BY snapshot))
GROUP BY snapshot, gini_top, entropy_top""", ["ranks"])


@query("gini_hhi_entropy", "SELECT snapshot, n_nodes::BIGINT AS n_nodes, " + ", ".join(
    f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in ("hhi", "gini", "hhi_top", "gini_top", "entropy_top")) + " FROM conc", ["conc"])
def gini_hhi_entropy(spark, sf):
    c = G.concentration(ranks(spark, sf))
    return c.select("snapshot", "n_nodes", *[X.rnd(n).alias(n) for n in ("hhi", "gini", "hhi_top", "gini_top", "entropy_top")])


def _sector_member(spark, sf):
    s = D.sectors(spark, sf).select(F.col("asset").alias("node"), F.dense_rank().over(Window.orderBy("sector")).alias("community"))
    return nodes(spark, sf).join(s, "node")


@query("modularity_by_sector", """
SELECT snapshot, round(sum(win / m - pow(deg / (2 * m), 2)), 6) + 0.0::DOUBLE AS modularity FROM (
  SELECT e.snapshot, c, sum(w_in) AS win, sum(weight) AS deg, any_value(m) AS m FROM (
    SELECT s.snapshot, a.sector AS c, weight, CASE WHEN a.sector = b.sector THEN weight / 2 ELSE 0 END AS w_in FROM sym s
    JOIN sector a ON a.asset = u JOIN sector b ON b.asset = v) e
  JOIN (SELECT snapshot, sum(weight) AS m FROM und GROUP BY 1) t ON t.snapshot = e.snapshot GROUP BY 1, 2) GROUP BY 1""", ["sym", "sector", "und"])
def modularity_by_sector(spark, sf):
    return G.modularity(G.undirected(arcs(spark, sf)), _sector_member(spark, sf)).withColumn("modularity", X.rnd("modularity"))


@query("sector_purity", """
SELECT snapshot, count(*)::BIGINT AS n_communities, max(size)::BIGINT AS largest, round(sum(top) / sum(size), 6) AS purity FROM (
  SELECT snapshot, c, max(n) AS top, sum(n) AS size FROM (SELECT snapshot, node % 4 AS c, sector, count(*) AS n FROM nodes JOIN sector ON asset = node GROUP BY 1, 2, 3) GROUP BY 1, 2)
GROUP BY 1""", ["nodes", "sector"])
def sector_purity(spark, sf):
    m = nodes(spark, sf).withColumn("community", F.col("node") % 4)
    return G.purity(m, D.sectors(spark, sf)).select("snapshot", "n_communities", "largest", X.rnd("purity").alias("purity"))


@query("sector_incidence", """
SELECT snapshot, s_src, s_dst, n_edges::BIGINT AS n_edges, round(n_edges / sum(n_edges) OVER (PARTITION BY snapshot, s_src), 6) AS row_share, round(n_edges / n_src, 6) AS per_node
FROM (SELECT snapshot, a.sector AS s_src, b.sector AS s_dst, count(*) AS n_edges FROM arcs JOIN sector a ON a.asset = src JOIN sector b ON b.asset = dst GROUP BY 1, 2, 3)
JOIN (SELECT sector AS s_src, count(*) AS n_src FROM sector GROUP BY 1) USING (s_src)""", ["arcs", "sector"])
def sector_incidence(spark, sf):
    return G.sector_incidence(arcs(spark, sf), D.sectors(spark, sf)).select(
        "snapshot", "s_src", "s_dst", "n_edges", X.rnd("row_share").alias("row_share"), X.rnd("per_node").alias("per_node"))


@query("hub_subgraph", """
SELECT snapshot, src, dst, CASE WHEN weight >= q67 THEN 3 WHEN weight >= q33 THEN 2 ELSE 1 END::INT AS tier FROM (
  SELECT *, quantile_cont(weight, 0.33) OVER (PARTITION BY snapshot) AS q33, quantile_cont(weight, 0.67) OVER (PARTITION BY snapshot) AS q67 FROM (
    SELECT arcs.* FROM arcs JOIN (SELECT snapshot, n FROM (SELECT snapshot, src AS n FROM arcs UNION ALL SELECT snapshot, dst FROM arcs) GROUP BY 1, 2 HAVING count(*) >= 4) h
      ON h.snapshot = arcs.snapshot AND h.n = src
    JOIN (SELECT snapshot, n FROM (SELECT snapshot, src AS n FROM arcs UNION ALL SELECT snapshot, dst FROM arcs) GROUP BY 1, 2 HAVING count(*) >= 4) g
      ON g.snapshot = arcs.snapshot AND g.n = dst))""", ["arcs"])
def hub_subgraph(spark, sf):
    return G.hub_subgraph(arcs(spark, sf), 4).select("snapshot", "src", "dst", "tier")


cte("reach", "SELECT snapshot, node, node AS lo FROM nodes UNION SELECT r.snapshot, s.v, r.lo FROM reach r JOIN sym s ON s.snapshot = r.snapshot AND s.u = r.node", ["nodes", "sym"])


@query("connected_components", "SELECT snapshot, node, min(lo) AS component FROM reach GROUP BY 1, 2", ["reach"])
def connected_components(spark, sf):
    return G.connected_components(G.undirected(arcs(spark, sf)), nodes(spark, sf))


cte("core", "SELECT snapshot, node FROM (SELECT *, count(*) OVER (PARTITION BY snapshot, c) AS size FROM (SELECT snapshot, node, min(lo) AS c FROM reach GROUP BY 1, 2)) "
            "QUALIFY dense_rank() OVER (PARTITION BY snapshot ORDER BY size DESC, c) = 1", ["reach"])
cte("bfs", "SELECT snapshot, node AS s, node AS u, 0 AS d FROM core UNION SELECT b.snapshot, b.s, e.v, b.d + 1 FROM bfs b JOIN sym e "
           "ON e.snapshot = b.snapshot AND e.u = b.u WHERE b.d < 12", ["core", "sym"])


@query("path_length", "SELECT snapshot, count(DISTINCT s)::BIGINT AS n_core, round(avg(d) FILTER (WHERE d > 0), 6) AS path_length FROM "
       "(SELECT snapshot, s, u, min(d) AS d FROM bfs GROUP BY 1, 2, 3) GROUP BY 1", ["bfs"])
def path_length(spark, sf):
    return G.average_path_length(G.undirected(arcs(spark, sf)), nodes(spark, sf)).withColumn("path_length", X.rnd("path_length"))


# ------------------------------------------------------------------ dynamic correlation
ADCC = (0.03, 0.90, 0.02)
cte("zz", "SELECT snapshot, asset, date, x / sd AS z, least(x / sd, 0) AS ng, row_number() OVER (PARTITION BY snapshot, asset ORDER BY date) - 1 AS t FROM (SELECT *, stddev_samp(x) OVER (PARTITION BY snapshot, asset) AS sd FROM wcc)", ["wcc"])
cte("qbar", "SELECT a.snapshot, a.asset AS i, b.asset AS j, corr(a.z, b.z) AS q0, avg(a.ng * b.ng) AS nb FROM zz a JOIN zz b "
            "ON a.snapshot = b.snapshot AND a.t = b.t AND a.asset <= b.asset GROUP BY 1, 2, 3", ["zz"])
cte("fold", f"""SELECT snapshot, i, j, 0::BIGINT AS t, CASE WHEN i = j THEN 1 ELSE q0 END::DOUBLE AS q FROM qbar
UNION ALL SELECT f.snapshot, f.i, f.j, f.t + 1, {1 - ADCC[0] - ADCC[1]!r}::DOUBLE * CASE WHEN f.i = f.j THEN 1 ELSE b.q0 END - {ADCC[2]}::DOUBLE * b.nb
  + {ADCC[0]}::DOUBLE * x.z * y.z + {ADCC[1]}::DOUBLE * f.q + {ADCC[2]}::DOUBLE * x.ng * y.ng
FROM fold f JOIN qbar b ON b.snapshot = f.snapshot AND b.i = f.i AND b.j = f.j
JOIN zz x ON x.snapshot = f.snapshot AND x.asset = f.i AND x.t = f.t JOIN zz y ON y.snapshot = f.snapshot AND y.asset = f.j AND y.t = f.t
WHERE f.t + 1 < (SELECT max(t) + 1 FROM zz m WHERE m.snapshot = f.snapshot)""", ["zz", "qbar"])


@query("adcc_fold_rbar", """
SELECT f.snapshot, f.i, f.j, round(avg(f.q / sqrt(a.q * b.q)), 6) + 0.0::DOUBLE AS v FROM fold f
JOIN fold a ON a.snapshot = f.snapshot AND a.i = f.i AND a.j = f.i AND a.t = f.t JOIN fold b ON b.snapshot = f.snapshot AND b.i = f.j AND b.j = f.j AND b.t = f.t
WHERE f.i < f.j AND f.t > 0 GROUP BY 1, 2, 3""", ["fold"])
def adcc_fold_rbar(spark, sf):
    from tremora.session import values

    w = Window.partitionBy("snapshot", "asset")
    v = A.vectors(D.window_panel(spark, sf).withColumn("x", F.col("x") / F.stddev_samp("x").over(w)))
    params = values(spark, [ADCC], ["a", "b", "g"], ["DOUBLE"] * 3)
    return A.adcc_mean_correlation(v, params).select("snapshot", "i", "j", X.rnd("v").alias("v"))


# ------------------------------------------------------------------ iterative and random operators
def _sizes(spark, sf):
    return D.stage(spark, sf, "sparse-size", lambda s, f: sparse.window_sizes(D.window_panel(s, f)))


def solved(spark, sf):
    """Solved penalty grid: support entries and one summary row per window and penalty."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITS:
        s = D.stage(spark, sf, "sparse-s", lambda s, f: sparse.shrunk(A.pair_values(vecs(s, f)), _sizes(s, f)))
        entries, summary = sparse.fit_grid(s, nodes(spark, sf), sparse.lambda_grid())
        _FITS[key] = (D.stage(spark, sf, "sparse-entries", lambda *_: entries), D.stage(spark, sf, "sparse-summary", lambda *_: summary))
    return _FITS[key]


def _sparse(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "chosen")
    if key not in _FITS:
        _FITS[key] = sparse.choose_edges(*solved(spark, sf), _sizes(spark, sf))
    return _FITS[key]


_FITS: dict = {}


@query("glasso_properties", "SELECT DISTINCT snapshot, 25::BIGINT AS n_penalties, 0::BIGINT AS n_failed, true AS penalty_on_grid FROM nodes", ["nodes"])
def glasso_properties(spark, sf):
    """All penalties of a window are solved within the optimality bound and the selected one is among them."""
    _, sel, grid = _sparse(spark, sf)
    per = grid.groupBy("snapshot").agg(F.count("*").alias("n_penalties"), F.count(F.when(F.col("violation") >= sparse.CONVERGED, 1)).alias("n_failed"))
    hit = grid.join(sel.select("snapshot", "lam"), ["snapshot", "lam"], "left_semi").groupBy("snapshot").agg((F.count("*") == 1).alias("penalty_on_grid"))
    return per.join(hit, "snapshot")


@query("glasso_edges")
def glasso_edges(spark, sf):
    return _sparse(spark, sf)[0]


@query("glasso_selection")
def glasso_selection(spark, sf):
    return _sparse(spark, sf)[1]


@query("glasso_early_stop")
def glasso_early_stop(spark, sf):
    return sparse.select_lambda(_sparse(spark, sf)[2], early_stop=True)


@query("glasso_kmin_sweep")
def glasso_kmin_sweep(spark, sf):
    """Selected penalty under edge floors p/2, p and 2p."""
    grid = _sparse(spark, sf)[2]
    out = None
    for name, floor in (("half", F.expr("p DIV 2")), ("one", F.col("p")), ("double", 2 * F.col("p"))):
        s = sparse.select_lambda(grid, k_min=floor).withColumn("k_min", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


@query("glasso_kmin_downstream")
def glasso_kmin_downstream(spark, sf):
    """Edge floors p/2, p and 2p carried through direction, PageRank and the index, keyed by floor."""
    from tremora.operators import stress as T
    from tremora.session import materialize

    entries, sel = solved(spark, sf)[0], None
    grid = _sparse(spark, sf)[2]
    for name, floor in (("half", F.expr("p DIV 2")), ("one", F.col("p")), ("double", 2 * F.col("p"))):
        t = sparse.select_lambda(grid, k_min=floor).select("snapshot", "lam", "k", F.lit(name).alias("k_min"))
        sel = t if sel is None else sel.unionByName(t)
    sel = materialize(sel, "km-sel")
    label = F.concat_ws("|", "k_min", "snapshot")
    edges = sparse.partial_correlations(entries.join(sel, ["snapshot", "lam"]).withColumn("snapshot", label).select("snapshot", "lam", "i", "j", "omega"))
    jobs = sel.select("k_min", "snapshot", "lam", "k")
    vec = vecs(spark, sf).join(jobs.select("snapshot", "k_min"), "snapshot").withColumn("snapshot", label).drop("k_min")
    near = A.strongest_neighbours(vecs(spark, sf), C.N_CONTROLS + 1).join(jobs.select("snapshot", "k_min"), "snapshot").withColumn("snapshot", label).drop("k_min")
    ev = E.evidence(E.ordered_tests(edges.withColumn("weight", F.abs("partial_corr")), vec, near))
    a = materialize(E.arcs(E.decide(E.with_rule(ev, alpha=ALPHA))), "km-arcs")
    n = vec.select("snapshot", F.col("asset").alias("node"))
    wide = (
        jobs.withColumn("window", F.col("snapshot")).withColumn("snapshot", label).join(D.snapshots(spark).select(F.col("snapshot").alias("window"), "regime"), "window")
        .join(G.mean_degree(a, n), "snapshot").join(A.mean_correlation(vecs(spark, sf)).select(F.col("snapshot").alias("window"), "mean_corr"), "window")
        .join(G.concentration(G.pagerank(a, n)).select("snapshot", F.col("hhi_top").alias("hhi_top10")), "snapshot")
        .join(G.triad_counts(a).select("snapshot", F.col("n_030t").cast("double").alias("z_ffl")), "snapshot", "left")
    )
    return T.snapshot_index(wide, by=("k_min",)).select("k_min", "window", "regime", "lam", "k", "n_edges", "nsi")


@query("solver_iterations")
def solver_iterations(spark, sf):
    """Rounds used by the penalised fits at the chosen penalty and by PageRank."""
    _, sel, grid = _sparse(spark, sf)
    fit = grid.join(sel.select("snapshot", "lam"), ["snapshot", "lam"]).select("snapshot", "lam", F.col("n_iter").alias("glasso_iter"), "violation")
    pr = G.pagerank(arcs(spark, sf), nodes(spark, sf)).groupBy("snapshot").agg(F.max("n_iter").alias("pagerank_iter"))
    return fit.join(pr, "snapshot", "left")


@query("louvain")
def louvain(spark, sf):
    return community.louvain(G.undirected(arcs(spark, sf)), nodes(spark, sf))


@query("louvain_properties", "SELECT snapshot, count(*)::BIGINT AS n_nodes, count(*)::BIGINT AS n_labelled, true AS above_one_community, 0::BIGINT AS n_gaining "
       "FROM nodes GROUP BY 1", ["nodes"])
def louvain_properties(spark, sf):
    """Every node has one label, the split beats the undivided graph and no single move raises modularity."""
    m = D.stage(spark, sf, "louvain", louvain)
    per = m.groupBy("snapshot").agg(F.count("*").alias("n_labelled"))
    q = G.modularity(G.undirected(arcs(spark, sf)), m).select("snapshot", (F.col("modularity") > 0).alias("above_one_community"))
    gaining = community.gaining_moves(G.undirected(arcs(spark, sf)), m)
    return nodes(spark, sf).groupBy("snapshot").agg(F.count("*").alias("n_nodes")).join(per, "snapshot").join(q, "snapshot").join(gaining, "snapshot")


@query("er_null_z")
def er_null_z(spark, sf):
    return D.stage(spark, sf, "er", lambda s, f: nulls.er_test(arcs(s, f), nodes(s, f)))


@query("motif_z")
def motif_z(spark, sf):
    return nulls.motif_test(arcs(spark, sf))


@query("density_matched")
def density_matched(spark, sf):
    return D.stage(spark, sf, "density_matched", lambda s, f: nulls.threshold_quality(strong(s, f), nodes(s, f), D.sectors(s, f)))


# ------------------------------------------------------------------ properties of drawn and fitted results
@query("rewiring_properties", f"SELECT DISTINCT snapshot, {C.N_REWIRES}::BIGINT AS n_draws, true AS degrees_kept, true AS mutual_kept, true AS simple FROM arcs", ["arcs"])
def rewiring_properties(spark, sf):
    """Every rewired graph keeps each node's arcs out and in and its mutual dyads, and has no loop or double arc."""
    a = arcs(spark, sf)
    drawn = D.stage(spark, sf, "rewired", lambda s, f: nulls.rewired_arcs(arcs(s, f), C.N_REWIRES))

    def shape(t, k):
        t = t.select(*k, F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
        back = t.select(*k, F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
        t = t.join(back.distinct(), [*k, "src", "dst"], "left")
        ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                                 F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
        node = t.select(*k, "back", ends.alias("e")).groupBy(*k, "e.node").agg(
            F.sum("e.o").alias("o"), F.sum("e.i").alias("i"), F.count("back").alias("m"))
        return node.groupBy(*k).agg(F.sum(F.xxhash64("node", "o", "i").cast("decimal(38,0)")).alias("degrees"), F.sum(F.xxhash64("node", "m").cast("decimal(38,0)")).alias("mutual"))

    k = ["snapshot", "draw"]
    plain = drawn.groupBy(*k).agg((F.count("*") == F.count_distinct("src", "dst")).alias("once"), (F.count_if(F.col("src") == F.col("dst")) == 0).alias("no_loop"))
    both = shape(drawn, k).join(plain, k).join(shape(a, ["snapshot"]).select("snapshot", F.col("degrees").alias("d0"), F.col("mutual").alias("m0")), "snapshot")
    return both.groupBy("snapshot").agg(
        F.count("*").alias("n_draws"), F.min(F.col("degrees") == F.col("d0")).alias("degrees_kept"), F.min(F.col("mutual") == F.col("m0")).alias("mutual_kept"),
        F.min(F.col("once") & F.col("no_loop")).alias("simple"))


@query("random_graph_properties", f"SELECT snapshot, {C.N_ER_MATCHED}::BIGINT AS n_draws, count(*)::BIGINT AS n_edges, true AS simple, true AS draws_differ FROM und GROUP BY 1", ["und"])
def random_graph_properties(spark, sf):
    """Uniform graphs have exactly the edges of their window, none twice, and no two draws of a window are equal."""
    u = G.undirected(arcs(spark, sf))
    sizes = nodes(spark, sf).groupBy("snapshot").agg(F.count("*").alias("n")).join(u.groupBy("snapshot").agg(F.count("*").alias("m")), "snapshot")
    per = nulls.er_edges(sizes).groupBy("snapshot", "draw").agg(
        F.count("*").alias("m"), F.count_distinct("a", "b").alias("once"), F.count_if(F.col("a") >= F.col("b")).alias("wrong"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    per = per.join(sizes.select("snapshot", F.col("m").alias("n_edges")), "snapshot")
    return per.groupBy("snapshot", "n_edges").agg(
        F.count("*").alias("n_draws"), F.min((F.col("m") == F.col("n_edges")) & (F.col("once") == F.col("m")) & (F.col("wrong") == 0)).alias("simple"),
        (F.count_distinct("h") == F.count("*")).alias("draws_differ"))


@query("motif_properties", "SELECT DISTINCT snapshot, true AS profile_is_unit, true AS z_signs_agree FROM arcs", ["arcs"])
def motif_properties(spark, sf):
    """The significance profile has length one (or no z is defined) and a z has the sign of count less mean."""
    t = D.stage(spark, sf, "motif_z", motif_z)
    names = [c[3:] for c in t.columns if c.startswith("sp_")]
    square = sum((F.coalesce(F.col(f"sp_{c}") * F.col(f"sp_{c}"), F.lit(0.0)) for c in names), F.lit(0.0))
    agree = F.lit(True)
    for c in names:
        agree = agree & F.coalesce(F.signum(f"z_{c}") == F.signum(F.round(F.col(f"n_{c}") - F.col(f"n_{c}_mu"), 12)), F.lit(True))
    return t.select("snapshot", ((F.abs(square - 1) < 1e-9) | (square == 0)).alias("profile_is_unit"), agree.alias("z_signs_agree"))


@query("glasso_path_properties", "SELECT DISTINCT snapshot, 25::BIGINT AS n_penalties, true AS all_optimal, true AS gaps_closed, true AS edges_as_selected, true AS weights_in_range FROM nodes", ["nodes"])
def glasso_path_properties(spark, sf):
    """All penalties reach the optimum with a duality gap below 1e-3, and the selected one has just the edges it counts."""
    edges, sel, grid = _sparse(spark, sf)
    per = grid.groupBy("snapshot").agg(F.count("*").alias("n_penalties"), F.min(F.col("reason") == "optimal").alias("all_optimal"),
                                       F.min(F.abs("gap") < 1e-3).alias("gaps_closed"))
    n = edges.groupBy("snapshot").agg(F.count("*").alias("found"), F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    t = per.join(sel.select("snapshot", "k"), "snapshot").join(n, "snapshot", "left")
    return t.select("snapshot", "n_penalties", "all_optimal", "gaps_closed", (F.coalesce("found", F.lit(0)) == F.col("k")).alias("edges_as_selected"),
                    F.coalesce((F.col("lo") > 0) & (F.col("hi") <= 1 + 1e-9), F.lit(True)).alias("weights_in_range"))


@query("density_matched_properties", "SELECT snapshot, count(*)::BIGINT AS n, true AS q_in_range, true AS purity_in_range FROM nodes GROUP BY 1", ["nodes"])
def density_matched_properties(spark, sf):
    """Modularity and purity of the threshold networks lie in their ranges, and the relative one follows from its parts."""
    t = density_matched(spark, sf)
    rel = F.coalesce(F.abs(F.col("q_rel") - (F.col("q") - F.col("q_random")) / F.col("q_random")) < 1e-9, F.lit(True))
    return t.select("snapshot", "n", (F.col("q").between(-0.5, 1) & F.col("q_random").between(-0.5, 1) & rel).alias("q_in_range"),
                    F.col("purity").between(0, 1).alias("purity_in_range"))
