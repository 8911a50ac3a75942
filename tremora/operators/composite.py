"""Pooled dynamic-correlation parameters by a composite likelihood over all asset pairs.

The value is the sum of the Gaussian correlation likelihoods of all pairs, so no
matrix over all assets exists anywhere. Pairs of asset blocks are rows of a table that
is written once per fit; a pass reads it without a shuffle and returns the value and
gradient of its pairs for every trial point, Spark adds them up, and the driver moves
one Newton search per start and group with three numbers each. All searches share a
pass over the data. A group whose assets fit into one block needs no passes: each of its
searches runs to its end inside one task, all of them in one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora import config as C
from tremora.operators.volatility import adcc_starts
from tremora.session import attach, materialize, release, spread, values

BLOCK, LEAST = 32, 8  # assets of a block; few assets go into smaller blocks, so that tasks share them
SMALL = 1e-12
NUDGE = 1e-4  # step of the gradient differences that give the curvature
NEAR, EDGE = -7.0, -25.0  # free numbers of a parameter close to its bound zero, and next to it


def grid_vectors(resid: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``(grp, asset, idx, p, vec)``: clipped residuals on the dates of the whole panel, NaN where an asset has none.

    ``groups`` is an optional ``(grp, asset)``; without it all assets form group 0.
    """
    rows = resid.where("z IS NOT NULL AND NOT isnan(z)").select(
        "asset", "date", F.greatest(F.lit(-C.CLIP), F.least(F.lit(C.CLIP), F.col("z").cast("double"))).alias("z"))
    days = rows.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")) - 1)  # a row per trading day
    n = days.agg(F.count("*").cast("int").alias("n_days"))
    one = rows.join(days, "date").groupBy("asset").agg(F.map_from_entries(F.collect_list(F.struct("t", "z"))).alias("m"))
    vec = attach(one, n).select("asset", F.transform(
        F.sequence(F.lit(0), F.col("n_days") - 1), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(float("nan")))).alias("vec"))
    vec = vec.withColumn("grp", F.lit(0)) if groups is None else vec.join(groups, "asset")
    w = Window.partitionBy("grp")
    return materialize(vec.withColumn("idx", (F.row_number().over(w.orderBy("asset")) - 1).cast("int")).withColumn(
        "p", F.count("*").over(w).cast("int")).select("grp", "asset", "idx", "p", "vec"), "adcc-grid")


def pair_value(za: np.ndarray, zb: np.ndarray, use: np.ndarray, theta: np.ndarray, min_rows: int):
    """Value and gradient of the pairs ``use`` of two blocks at the points ``theta`` (one per row).

    A pair runs over the dates both assets have; on other dates its state stands still.
    Returns ``(value, gradient, observations, inadmissible pairs, pairs)``; a pair is
    inadmissible at a point where its intercept is not positive semi-definite.
    """
    here_a, here_b = np.isfinite(za), np.isfinite(zb)
    za, zb = np.where(here_a, za, 0.0), np.where(here_b, zb, 0.0)
    na, nb = np.minimum(za, 0.0), np.minimum(zb, 0.0)
    fa, fb = here_a.astype(float), here_b.astype(float)
    n = fa @ fb.T
    use = use & (n >= max(min_rows, 2))
    n = np.maximum(n, 1.0)
    ea, eb, eab = za @ fb.T / n, fa @ zb.T / n, za @ zb.T / n
    va, vb = (za * za) @ fb.T / n - ea * ea, fa @ (zb * zb).T / n - eb * eb
    use = use & (va > SMALL) & (vb > SMALL)
    q_bar = np.clip((eab - ea * eb) / np.sqrt(np.maximum(va * vb, SMALL)), -1, 1)
    n_ab, n_aa, n_bb = na @ nb.T / n, (na * na) @ fb.T / n, fa @ (nb * nb).T / n
    a, b, g = (theta[:, c][:, None, None] for c in range(3))
    bars = [(q_bar, n_ab), (np.ones_like(q_bar), n_aa), (np.ones_like(q_bar), n_bb)]
    const = [(1 - a - b) * q - g * m for q, m in bars]
    low = (const[1] + const[2]) / 2 - np.sqrt(((const[1] - const[2]) / 2) ** 2 + const[0] ** 2)
    bad = ((low < -1e-8) & use).sum(axis=(1, 2))
    shape = (len(theta), *q_bar.shape)
    q = [np.broadcast_to(bar, shape).copy() for bar, _ in bars]
    dq = [np.zeros((3, *shape)) for _ in bars]
    value, grad = np.zeros(shape), np.zeros((3, *shape))
    started = np.zeros(q_bar.shape, bool)
    last = [np.zeros_like(q_bar) for _ in range(6)]  # products of the last common date: z z, n n, then z^2, n^2 of either side
    for t in range(za.shape[1]):
        both = np.outer(here_a[:, t], here_b[:, t]).astype(bool) & use
        if not both.any():
            continue
        x, y = za[:, t][:, None], zb[:, t][None, :]
        on = both & started
        if on.any():
            lags = [(last[0], last[1]), (last[2], last[3]), (last[4], last[5])]
            for s, ((q_b, n_b), (u, v)) in enumerate(zip(bars, lags)):
                d = dq[s] * b
                d[0] += u - q_b
                d[1] += q[s] - q_b
                d[2] += v - n_b
                dq[s] = np.where(on, d, dq[s])
                q[s] = np.where(on, const[s] + a * u + b * q[s] + g * v, q[s])
            qi, qj = np.maximum(q[1], 1e-8), np.maximum(q[2], 1e-8)
            root = np.sqrt(qi * qj)
            rho = np.clip(q[0] / root, -1 + 1e-9, 1 - 1e-9)
            rest = 1 - rho * rho
            ss, xy = x * x + y * y, x * y
            value += np.where(on, 0.5 * (np.log(rest) + (ss - 2 * rho * xy) / rest - ss), 0.0)
            by_rho = -rho / rest + (rho * (ss - 2 * rho * xy) / rest - xy) / rest
            d_rho = dq[0] / root - 0.5 * rho * (dq[1] / qi + dq[2] / qj)
            grad += np.where(on, by_rho * d_rho, 0.0)
        new = [x * y, na[:, t][:, None] * nb[:, t][None, :], x * x + 0 * y, na[:, t][:, None] ** 2 + 0 * y, y * y + 0 * x, nb[:, t][None, :] ** 2 + 0 * x]
        last = [np.where(both, v, w) for v, w in zip(new, last)]
        started |= both
    return value.sum(axis=(1, 2)), grad.sum(axis=(2, 3)).T, float(np.where(use, n - 1, 0).sum()), bad, int(use.sum())


def pair_blocks(vecs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(grp, bi, bj, za, zb)``: the vectors of every unordered pair of asset blocks as one row of a stage table."""
    width = F.least(F.lit(block), F.greatest(F.lit(LEAST), F.ceil(F.col("p") / 4).cast("int")))
    blk = F.floor(F.col("idx") / width).cast("int")
    rows = vecs.withColumn("blk", blk).groupBy("grp", "blk", F.ceil(F.col("p") / width).cast("int").alias("n_blk")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "vec"))).alias("s")).select("grp", "blk", "n_blk", F.col("s.vec").alias("z"))
    left = rows.select("grp", F.col("blk").alias("bi"), F.explode(F.sequence("blk", F.col("n_blk") - 1)).alias("bj"), F.col("z").alias("za"))
    right = rows.select("grp", F.col("blk").alias("bj"), F.col("z").alias("zb"))
    return materialize(spread(left.join(right, ["grp", "bj"]).select("grp", "bi", "bj", "za", "zb"), "grp", "bi", "bj"), "adcc-blocks")


def score(blocks: DataFrame, points: dict, min_rows: int) -> dict:
    """``(value, gradient, observations, inadmissible, pairs)`` per group and point number, means per observation."""
    columns = ["grp", "point", "value", "ga", "gb", "gg", "n", "bad", "pairs"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                if not (todo := points.get(r.grp)):
                    continue
                za, zb = (np.vstack([np.asarray(v, float) for v in z]) for z in (r.za, r.zb))
                use = np.ones((len(za), len(zb)), bool)
                value, grad, n, bad, pairs = pair_value(za, zb, np.triu(use, 1) if r.bi == r.bj else use, np.array(list(todo.values()), float), min_rows)
                yield pd.DataFrame({"grp": r.grp, "point": list(todo), "value": value, "ga": grad[:, 0], "gb": grad[:, 1], "gg": grad[:, 2],
                                    "n": n, "bad": bad, "pairs": pairs})[columns]

    kind = blocks.schema["grp"].dataType.simpleString()
    part = blocks.mapInPandas(run, f"grp {kind}, point int, value double, ga double, gb double, gg double, n double, bad long, pairs long")
    sums = part.groupBy("grp", "point").agg(*[F.sum(c).alias(c) for c in columns[2:]])
    return {(r.grp, r.point): (r.value / max(r.n, 1), np.array([r.ga, r.gb, r.gg]) / max(r.n, 1), r.n, r.bad, r.pairs) for r in sums.collect()}


def evaluate(vecs: DataFrame, points: dict, min_rows: int, block: int = BLOCK) -> dict:
    """One pass over vectors that are not cut into blocks yet."""
    blocks = pair_blocks(vecs, block)
    try:
        return score(blocks, points, min_rows)
    finally:
        release(blocks)


def _inside(u: np.ndarray) -> np.ndarray:
    """Three free numbers to positive parameters whose sum stays below the stationarity bound."""
    e = np.exp(u - max(u.max(), 0.0))
    return (1 - C.ADCC_SLACK) * e / (np.exp(-max(u.max(), 0.0)) + e.sum())


class Search:
    """Newton search of one start; ``trials`` are the next point to score and its three neighbours.

    The curvature is the difference of the gradients at the neighbours. Its eigenvalues count by
    their size, so a step goes downhill on a ridge as well, and no step is longer than two.
    Parameters that still fall close to zero when the rest has settled are tried next to zero.
    """

    def __init__(self, theta):
        share = np.asarray(theta, float) / (1 - C.ADCC_SLACK)
        self.u = self.next = np.log(share) - np.log(1 - share.sum())
        self.value, self.grad, self.state, self.steps = np.inf, None, "open", 0
        self.size, self.way, self.edge = 1.0, np.zeros(3), False

    @property
    def trials(self) -> np.ndarray:
        return np.array([_inside(self.next + d) for d in np.vstack([np.zeros(3), NUDGE * np.eye(3)])])

    def tell(self, value: float, by_theta: np.ndarray, admissible: bool, tol: float) -> None:
        """Take the value at the first of ``trials`` and the gradients at all four."""
        self.steps += 1
        grad = np.array([p * d - p * float(d @ p) / (1 - C.ADCC_SLACK) for p, d in zip(self.trials, by_theta)])
        fits = admissible and np.isfinite(value) and np.isfinite(grad).all()
        slope = 0.0 if self.grad is None or self.edge else float(self.grad @ self.way)
        if fits and value <= self.value + 1e-4 * self.size * slope:
            self.u, self.value, self.grad, self.edge = self.next, value, grad[0], False
            if np.abs(self.grad).max() < tol:
                low = (self.u < NEAR) & (self.u > EDGE) & (self.grad > 0)
                self.state, self.edge, self.next = "open" if low.any() else "converged", low.any(), np.where(low, EDGE, self.u)
                return
            h = (grad[1:] - grad[0]) / NUDGE
            size, axes = np.linalg.eigh((h + h.T) / 2)
            self.way = -axes @ ((axes.T @ self.grad) / np.maximum(np.abs(size), 1e-8))
            self.size = min(1.0, 2.0 / max(np.abs(self.way).max(), 1e-12))
        elif self.grad is None:
            self.state = "rejected"  # the start itself is not admissible
        elif self.edge:
            self.state = "converged"  # no better at the bound
        else:
            self.size /= 2
            if self.size * np.abs(self.way).max() < 1e-9:
                self.state = "stalled"
        self.next = self.u + self.size * self.way


def search_in_place(vecs: DataFrame, groups: list, min_rows: int, tol: float) -> dict:
    """``(search, pairs)`` per group and start of groups that are one block; every search is one task."""
    starts = adcc_starts()
    columns = ["grp", "start", "u", "value", "state", "steps", "pairs"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                z = np.vstack([np.asarray(v, float) for v in r.z])
                use = np.triu(np.ones((len(z), len(z)), bool), 1)
                s = Search(starts[r.start])
                while s.state == "open":
                    value, grad, n, bad, pairs = pair_value(z, z, use, s.trials, min_rows)
                    if n:
                        s.tell(value[0] / n, grad / n, not bad[0], tol)
                    else:
                        s.state = "too_short"
                yield pd.DataFrame({"grp": [r.grp], "start": [r.start], "u": [s.u], "value": [s.value], "state": [s.state],
                                    "steps": [s.steps], "pairs": [pairs]})[columns]

    whole = vecs.where(F.col("grp").isin(groups)).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("idx", "vec"))).alias("s"))
    jobs = whole.select("grp", F.col("s.vec").alias("z"), F.explode(F.sequence(F.lit(0), F.lit(len(starts) - 1))).alias("start"))
    jobs = jobs.repartition(min(len(groups) * len(starts), int(vecs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kind = vecs.schema["grp"].dataType.simpleString()
    ended = {}
    for r in jobs.mapInPandas(run, f"grp {kind}, start int, u array<double>, value double, state string, steps int, pairs long").collect():
        s = Search(starts[r.start])
        s.u, s.value, s.state, s.steps = np.array(r.u), r.value, r.state, r.steps
        ended[r.grp, r.start] = s, r.pairs
    return ended


def fit(resid: DataFrame, groups: DataFrame | None = None, min_rows: int = C.ADCC_MIN_ROWS, tol: float = 1e-7, block: int = BLOCK) -> DataFrame:
    """``grp, a, b, g, nll, status, converged, n_assets, n_pairs, n_starts, n_converged, n_passes, spread, multi_modal`` per group.

    The best converged start is taken; a group none of whose starts converges is
    ``unconverged``, one without a pair of ``min_rows`` common dates ``too_short``.
    ``nll`` is the mean value per pair and date.
    """
    vecs = grid_vectors(resid, groups)
    size = {r.grp: r.n for r in vecs.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    search = {(g, i): Search(s) for g in size for i, s in enumerate(adcc_starts())}
    pairs, passes = dict.fromkeys(size, 0), dict.fromkeys(size, 0)
    if few := [g for g, n in size.items() if n <= block]:
        for (g, i), (search[g, i], pairs[g]) in search_in_place(vecs, few, min_rows, tol).items():
            passes[g] = max(passes[g], search[g, i].steps, 1)
    blocks = pair_blocks(vecs.where(~F.col("grp").isin(few)) if few else vecs, block) if len(few) < len(size) else None
    while any(s.state == "open" for s in search.values()):
        points: dict = {}
        for (g, i), s in search.items():
            if s.state == "open":
                points.setdefault(g, {}).update({4 * i + c: p for c, p in enumerate(s.trials.tolist())})
        got = score(blocks, points, min_rows)
        for g, todo in points.items():
            passes[g] += 1
            for i in {k // 4 for k in todo}:
                at = [got.get((g, 4 * i + c), (np.inf, np.zeros(3), 0, 0, 0)) for c in range(4)]
                value, _, n, bad, pairs[g] = at[0]
                if not n:
                    search[g, i].state = "too_short"
                else:
                    search[g, i].tell(value, np.array([a[1] for a in at]), not bad, tol)
    release(blocks)
    rows = []
    for g in size:
        own = [s for (k, _), s in search.items() if k == g]
        good = [s for s in own if s.state == "converged"]
        best = min(good, key=lambda s: s.value) if good else None
        at = np.array([_inside(s.u) for s in good])
        spread = float((at.max(axis=0) - at.min(axis=0)).max()) if good else None
        status = "ok" if best else ("too_short" if not pairs[g] else "unconverged")
        rows.append((g, *(map(float, _inside(best.u)) if best else (None,) * 3), best.value if best else None, status, best is not None, size[g],
                     pairs[g], len(own), len(good), passes[g], spread, None if spread is None else spread > 1e-2))
    kind = vecs.schema["grp"].dataType.simpleString()
    names = ["grp", "a", "b", "g", "nll", "status", "converged", "n_assets", "n_pairs", "n_starts", "n_converged", "n_passes", "spread", "multi_modal"]
    types = [kind, *["DOUBLE"] * 4, "STRING", "BOOLEAN", *["INT"] * 5, "DOUBLE", "BOOLEAN"]
    return values(resid.sparkSession, rows, names, types)
