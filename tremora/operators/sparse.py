"""Sparse precision networks: penalised likelihood over a penalty grid, selection and edges.

The graphical LASSO splits exactly along the connected components of the graph
``|s_ij| > lambda``, and components only merge as the penalty falls. A task takes one
component of the smallest penalty and walks all penalties, each from the solution
before; isolated assets are closed form and never reach Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora import config as C
from tremora.functions.exprs import ebic_gamma, shrinkage_delta
from tremora.operators.graph import connected_components
from tremora.operators.spectrum import smallest_eigenvalues
from tremora.session import materialize, spread


CONVERGED = GAP = 1e-4


def lambda_grid(n: int = C.N_LAMBDAS, bounds=C.LAMBDA_RANGE) -> list[float]:
    lo, hi = bounds
    return [float(v) for v in np.logspace(np.log10(hi), np.log10(lo), n)]


def window_sizes(panel: DataFrame) -> DataFrame:
    """``(snapshot, p, n)`` with the tier parameters of each window."""
    s = panel.groupBy("snapshot").agg(F.countDistinct("asset").alias("p"), F.countDistinct("date").alias("n"))
    r = F.col("n") / F.col("p")
    return s.withColumn("ratio", r).withColumn("gamma", ebic_gamma(r)).withColumn("delta", shrinkage_delta(r))


def shrunk(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Identity shrinkage of the off-diagonal correlations; the diagonal stays one."""
    return pairs.join(sizes.select("snapshot", "delta"), "snapshot").withColumn(
        "s", F.col("v") * (1 - F.col("delta"))).select("snapshot", "i", "j", "s")


def _violation(s: np.ndarray, theta: np.ndarray, w: np.ndarray, lam: float, off: np.ndarray) -> float:
    grad = s - w
    return float(np.where(theta != 0, np.abs(grad + lam * np.sign(theta) * off), np.maximum(np.abs(grad) - lam * off, 0.0)).max())


def _value(s: np.ndarray, theta: np.ndarray, weight: np.ndarray) -> float:
    """Objective; infinite where ``theta`` is not positive definite."""
    try:
        logdet = 2 * np.log(np.diag(np.linalg.cholesky(theta))).sum()
    except np.linalg.LinAlgError:
        return np.inf
    return float((s * theta).sum() - logdet + (weight * np.abs(theta)).sum())


def duality_gap(s: np.ndarray, w: np.ndarray, weight: np.ndarray, value: float) -> float:
    """Objective less the dual value of the inverse clipped to its bounds; infinite without a feasible point."""
    try:
        chol = np.linalg.cholesky(np.clip(w, s - weight, s + weight))
    except np.linalg.LinAlgError:
        return np.inf
    return float(value - 2 * np.log(np.diag(chol)).sum() - len(s))


def _newton_direction(w: np.ndarray, rest: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Solve ``(W D W) = rest`` on the free entries by preconditioned conjugate gradients, as exactly as the step needs."""
    diag = np.diag(w)
    scale = 1.0 / (np.outer(diag, diag) + w * w)
    d, norm = np.zeros_like(w), float(np.sqrt((rest * rest).sum()))
    enough = min(0.1, np.sqrt(norm / len(w))) * norm
    y = scale * rest
    q, ry = y, float((rest * y).sum())
    for _ in range(len(w)):
        h = np.where(free, w @ q @ w, 0.0)
        a = ry / float((q * h).sum())
        d = d + a * q
        rest = rest - a * h
        if np.sqrt((rest * rest).sum()) <= enough:
            break
        y = scale * rest
        ry, old = float((rest * y).sum()), ry
        q = y + (ry / old) * q
    return d


def minimise(s: np.ndarray, lam: float, tol: float = 1e-6, start: np.ndarray | None = None):
    """Minimise ``tr(S Theta) - logdet Theta + lam * |offdiag|_1``, from ``start`` where given.

    A step fixes the signs of the non-zero entries and of those whose gradient
    exceeds the penalty, takes the Newton direction on them by conjugate gradients
    (matrix products only), sets entries that would change sign to zero and halves
    the step until the objective falls enough; where no Newton step does, a proximal
    gradient step is taken. Returns ``(theta, steps, violation, gap, reason)``: the
    largest violation of the optimality conditions, the duality gap, and ``optimal``
    (violation below ``tol`` and gap below ``GAP``) or ``stalled`` (no step lowers the
    objective any more).
    """
    off = ~np.eye(len(s), dtype=bool)
    weight = lam * off
    theta = np.diag(1.0 / np.diag(s)) if start is None else start
    value, steps = _value(s, theta, weight), 0
    while True:
        w = np.linalg.inv(theta)
        w = (w + w.T) / 2
        grad = s - w
        worst = _violation(s, theta, w, lam, off)
        if worst < tol and (gap := duality_gap(s, w, weight, value)) < GAP:
            return theta, steps, worst, gap, "optimal"
        sign = np.where(theta != 0, np.sign(theta), np.where(np.abs(grad) > lam, -np.sign(grad), 0.0))
        free = (sign != 0) | ~off
        slope = np.where(free, grad + weight * sign, 0.0)
        d = _newton_direction(w, -slope, free)
        size, found = 1.0, False
        while size > 1e-10 and not found:
            cand = theta + size * (d + d.T) / 2
            cand = np.where(off & (np.sign(cand) != sign), 0.0, cand)
            new = _value(s, cand, weight)
            found = new <= value + 1e-4 * float((slope * (cand - theta)).sum()) + 1e-13 * abs(value) and not np.array_equal(cand, theta)
            size /= 2
        size = 1.0
        while size > 1e-14 and not found:
            cand = theta - size * grad
            cand = np.sign(cand) * np.maximum(np.abs(cand) - size * weight, 0.0)
            new = _value(s, cand, weight)
            found = new < value
            size /= 2
        if not found:
            return theta, steps, worst, duality_gap(s, w, weight, value), "stalled"
        theta, value, steps = cand, new, steps + 1


def solve_glasso(s: np.ndarray, lam: float, tol: float = 1e-6):
    """``(theta, steps, violation)`` for one penalty from the diagonal start."""
    return minimise(s, lam, tol)[:3]


def _parts(linked: np.ndarray) -> list[np.ndarray]:
    """Connected components of a boolean adjacency matrix, larger ones only by flooding."""
    left, out = np.ones(len(linked), bool), []
    for i in range(len(linked)):
        if not left[i]:
            continue
        seen = np.zeros(len(linked), bool)
        edge = np.zeros(len(linked), bool)
        edge[i] = True
        while edge.any():
            seen |= edge
            edge = linked[edge].any(axis=0) & ~seen
        left &= ~seen
        out.append(np.flatnonzero(seen))
    return out


def solve_path(s: np.ndarray, lambdas: list[float], tol: float = 1e-6):
    """Solutions for falling penalties, each from the one before; ``(lam, theta, steps, violation, gap, reason)``.

    A penalty falls apart into the components of the correlations above it, which
    only merge as penalties fall, so the solution before is block diagonal in them.
    """
    theta = np.diag(1.0 / np.diag(s))
    for lam in sorted(lambdas, reverse=True):
        new, steps, worst, gap, reason = np.diag(1.0 / np.diag(s)), 0, 0.0, 0.0, "optimal"
        for part in _parts(np.abs(s) > lam):
            if len(part) > 1:
                at = np.ix_(part, part)
                new[at], n, v, g, why = minimise(s[at], lam, tol, theta[at])
                steps, worst, gap, reason = max(steps, n), max(worst, v), gap + g, why if why != "optimal" else reason
        theta = new
        yield lam, theta, steps, worst, gap, reason


def spectral_shift(s: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(snapshot, shift)`` to add to the diagonal of each window, one for all its components and penalties.

    Windows that row sums prove positive definite need none; for the others the
    smallest eigenvalue decides.
    """
    sides = s.select("snapshot", F.explode(F.array("i", "j")).alias("node"), F.abs("s").alias("v"))
    low = 1 - F.coalesce(F.sum("v"), F.lit(0.0))
    bound = sides.groupBy("snapshot", "node").agg(low.alias("low")).groupBy("snapshot").agg(F.min("low").alias("low"))
    open_ = materialize(bound.where(F.col("low") < C.SPECTRAL_TRIGGER).select("snapshot"), "gl-open")
    found = smallest_eigenvalues(s.join(open_, "snapshot", "left_semi"), nodes.join(open_, "snapshot", "left_semi"), "s")
    shift = F.when(F.col("low") < C.SPECTRAL_TRIGGER, C.SPECTRAL_TARGET - F.col("low")).otherwise(0.0)
    return nodes.select("snapshot").distinct().join(found, "snapshot", "left").select("snapshot", F.coalesce(shift, F.lit(0.0)).alias("shift"))


def fit_grid(corr: DataFrame, nodes: DataFrame, lambdas: list[float], shift: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Solve every window for every penalty.

    ``corr`` is ``(snapshot, i, j, s)`` with ``i < j``, ``nodes`` is
    ``(snapshot, node)``, ``shift`` an optional ``(snapshot, shift)`` of the diagonal.
    A component of the smallest penalty is one task that walks all penalties, each
    pair sent once. Returns the support entries ``(snapshot, lam, i, j, omega)``
    including the diagonal, and one summary row per window and penalty.
    """
    grid = F.explode(F.array(*[F.lit(v) for v in lambdas]))
    cand = corr.where(F.abs("s") > min(lambdas)).select("snapshot", F.col("i").alias("a"), F.col("j").alias("b"))
    every = materialize(nodes if shift is None else nodes.join(shift, "snapshot"), "gl-nodes")
    comp = connected_components(cand, every.select("snapshot", "node"), ("snapshot",)).join(every, ["snapshot", "node"])
    comp = materialize(comp.withColumn("extra", F.lit(0.0) if shift is None else F.col("shift")), "gl-comp")
    size = comp.groupBy("snapshot", "component").agg(F.count("*").alias("size"))
    ci = comp.select("snapshot", F.col("node").alias("i"), "component", "extra")
    cj = comp.select("snapshot", F.col("node").alias("j"), "component")
    inside = corr.select("snapshot", "i", "j", "s").join(ci, ["snapshot", "i"]).join(cj, ["snapshot", "j", "component"])
    t = nodes.schema["node"].dataType.simpleString()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        snap, comp_ = key
        ids = np.unique(np.concatenate([pdf["i"].to_numpy(), pdf["j"].to_numpy()]))
        r, c = np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])
        s = (1.0 + pdf["extra"].iloc[0]) * np.eye(len(ids))
        s[r, c] = s[c, r] = pdf["s"].to_numpy()
        out = []
        for lam, theta, n_iter, worst, gap, reason in solve_path(s, lambdas):
            a, b = np.nonzero(np.triu(np.abs(theta) > C.EDGE_EPS))
            part = pd.DataFrame({"snapshot": snap, "lam": lam, "component": comp_, "i": ids[a], "j": ids[b], "omega": theta[a, b],
                                 "logdet": np.nan, "tr": np.nan, "n_iter": n_iter, "violation": worst, "gap": gap, "reason": reason})
            part.loc[0, ["logdet", "tr"]] = [float(np.linalg.slogdet(theta)[1]), float((s * theta).sum())]
            out.append(part)
        return pd.concat(out)

    fitted = materialize(spread(inside, "snapshot", "component").groupBy("snapshot", "component").applyInPandas(
        run, f"snapshot string, lam double, component {t}, i {t}, j {t}, omega double, logdet double, tr double, n_iter int, violation double, "
             "gap double, reason string"), "gl-fit")
    alone = comp.join(size.where("size = 1"), ["snapshot", "component"]).withColumn("lam", grid).select(
        "snapshot", "lam", "component", F.col("node").alias("i"), F.col("node").alias("j"), (1 / (1 + F.col("extra"))).alias("omega"),
        (-F.log1p("extra")).alias("logdet"), F.lit(1.0).alias("tr"), F.lit(0).alias("n_iter"), F.lit(0.0).alias("violation"),
        F.lit(0.0).alias("gap"), F.lit("optimal").alias("reason"))
    rows = fitted.unionByName(alone)
    head = F.col("logdet").isNotNull() & ~F.isnan("logdet")
    summary = rows.groupBy("snapshot", "lam").agg(
        F.sum(F.when(head, F.col("logdet"))).alias("logdet"), F.sum(F.when(head, F.col("tr"))).alias("tr"),
        F.count(F.when(F.col("i") != F.col("j"), 1)).alias("k"), F.max("n_iter").alias("n_iter"), F.max("violation").alias("violation"),
        F.sum(F.when(head, F.col("gap"))).alias("gap"), F.max("reason").alias("reason"))
    return rows.select("snapshot", "lam", "i", "j", "omega"), summary


def ebic(summary: DataFrame, sizes: DataFrame) -> DataFrame:
    """``-2L + k ln n + 4 k gamma ln p`` with ``L = n/2 (logdet - tr)``."""
    fit = -F.col("n") * (F.col("logdet") - F.col("tr"))
    pen = F.col("k") * F.log("n") + 4 * F.col("k") * F.col("gamma") * F.log("p")
    return summary.join(sizes, "snapshot").withColumn("ebic", fit + pen)


def visited(scored: DataFrame, patience: int = C.EARLY_STOP_PATIENCE) -> DataFrame:
    """Grid points a sparse-to-dense sweep with early stopping would visit.

    The run of worsening points and the presence of an eligible fallback are
    cumulative facts over the ordered grid; the sweep ends at the first point
    where both conditions hold. A window has one row per penalty.
    """
    w = Window.partitionBy("snapshot").orderBy(F.desc("lam"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    reset = F.coalesce(F.col("ebic") < F.min("ebic").over(before), F.lit(True)) | (
        F.col("ebic") <= F.coalesce(F.lag("ebic").over(w), F.lit(float("inf"))))
    s = (
        scored.withColumn("run_id", F.sum(reset.cast("int")).over(upto))
        .withColumn("worse", F.row_number().over(Window.partitionBy("snapshot", "run_id").orderBy(F.desc("lam"))) - 1)
        .withColumn("eligible", F.max((F.col("k") >= F.greatest("p", F.lit(10))).cast("int")).over(upto))
        .withColumn("stop", ((F.col("worse") >= patience) & (F.col("eligible") == 1)).cast("int"))
    )
    return s.withColumn("stopped", F.coalesce(F.sum("stop").over(before), F.lit(0))).where("stopped = 0").drop(
        "run_id", "worse", "eligible", "stop", "stopped")


def select_lambda(scored: DataFrame, k_min=None, early_stop: bool = False) -> DataFrame:
    """Best penalty per window, with the constrained fallback when too few edges survive.

    Penalties whose solution violates the optimality conditions by ``CONVERGED`` or
    more are left out and counted in ``n_failed``; a window without any other is ``unsolved``. ``k_min`` defaults to ``max(p, 10)``. Windows whose grid never reaches the
    floor report ``status = 'no_candidate'``.
    """
    ok = F.col("violation") < CONVERGED if "violation" in scored.columns else F.lit(True)
    failed = scored.groupBy("snapshot").agg(F.count(F.when(~ok, 1)).alias("n_failed"))
    s = visited(scored.where(ok)) if early_stop else scored.where(ok)
    floor = F.greatest("p", F.lit(10)) if k_min is None else k_min
    s = s.withColumn("k_floor", floor)
    rec = F.struct("lam", "k", "ebic")
    order = F.struct(F.col("ebic"), (-F.col("lam")).alias("o"))
    pick = s.groupBy("snapshot").agg(
        F.min_by(rec, order).alias("best"), F.min_by(rec, F.when(F.col("k") >= F.col("k_floor"), order)).alias("fallback"),
        F.first("p").alias("p"), F.first("n").alias("n"), F.first("gamma").alias("gamma"), F.first("delta").alias("delta"),
        F.first("k_floor").alias("k_floor"), F.count("*").alias("n_visited"))
    fired = (F.col("best.k") < F.col("k_floor")) & F.col("fallback").isNotNull()
    out = pick.withColumn("fallback_fired", fired).withColumn("chosen", F.when(fired, F.col("fallback")).otherwise(F.col("best")))
    out = out.join(failed, "snapshot", "right")
    return out.select(
        "snapshot", F.col("chosen.lam").alias("lam"), F.col("chosen.k").alias("k"), F.col("chosen.ebic").alias("ebic"),
        F.col("best.lam").alias("lam_unconstrained"), F.col("best.k").alias("k_unconstrained"), "fallback_fired",
        "p", "n", "gamma", "delta", "n_visited", "n_failed",
        F.when(F.col("chosen").isNull(), "unsolved").when(F.col("chosen.k") < F.col("k_floor"), "no_candidate").otherwise("ok").alias("status"))


def partial_correlations(entries: DataFrame) -> DataFrame:
    """``-w_ij / sqrt(w_ii w_jj)`` of the support, keyed by ``(snapshot, i, j)``."""
    diag = entries.where("i = j").select("snapshot", F.col("i").alias("n"), F.col("omega").alias("d"))
    root = F.sqrt(F.greatest(F.col("di") * F.col("dj"), F.lit(1e-20)))
    return (
        entries.where("i <> j")
        .join(diag.select("snapshot", F.col("n").alias("i"), F.col("d").alias("di")), ["snapshot", "i"])
        .join(diag.select("snapshot", F.col("n").alias("j"), F.col("d").alias("dj")), ["snapshot", "j"])
        .select("snapshot", "i", "j", "omega", (-F.col("omega") / root).alias("partial_corr"))
    )


def choose_edges(entries: DataFrame, summary: DataFrame, sizes: DataFrame, early_stop: bool = False):
    """Selection and weighted edges from solved grids. Returns ``(edges, selection, scored grid)``."""
    scored = materialize(ebic(summary, sizes), "gl-score")
    sel = materialize(select_lambda(scored, early_stop=early_stop), "gl-sel")
    chosen = entries.join(sel.where("status = 'ok'").select("snapshot", "lam"), ["snapshot", "lam"])
    edges = partial_correlations(chosen).withColumn("weight", F.abs("partial_corr"))
    return edges, sel, scored


def sparse_network(pairs: DataFrame, panel: DataFrame, lambdas: list[float] | None = None, early_stop: bool = False):
    """Correlation pairs to weighted edges. Returns ``(edges, selection, scored grid)``."""
    sizes = materialize(window_sizes(panel), "gl-size")
    s = materialize(shrunk(pairs, sizes), "gl-s")
    nodes = panel.select("snapshot", F.col("asset").alias("node")).distinct()
    entries, summary = fit_grid(s, nodes, lambdas or lambda_grid(), spectral_shift(s, nodes))
    return choose_edges(entries, summary, sizes, early_stop)
