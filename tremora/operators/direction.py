"""Lead/lag evidence per edge and the rule that turns it into directed edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora import config as C
from tremora.functions.special import f_upper, t_two_sided
from tremora.session import spread


def ordered_tests(edges: DataFrame, vecs: DataFrame, neighbours: DataFrame | None, n_controls: int = C.N_CONTROLS) -> DataFrame:
    """Both orientations of every undirected edge with the series each test needs.

    The controls of a source are bundled once per source, not once per edge;
    the bundle holds one spare in case the target is among them. Edge rows carry
    only the target vector through the second shuffle.
    """
    both = edges.select("snapshot", F.col("i").alias("src"), F.col("j").alias("dst"), "weight").unionByName(
        edges.select("snapshot", F.col("j").alias("src"), F.col("i").alias("dst"), "weight"))
    v = vecs.select("snapshot", "asset", "vec")
    source = v.select("snapshot", F.col("asset").alias("src"), F.col("vec").alias("x"))
    if neighbours is not None and n_controls > 0:
        bundle = (
            neighbours.where(F.col("rank") <= n_controls + 1)
            .join(v.select("snapshot", F.col("asset").alias("other"), "vec"), ["snapshot", "other"])
            .groupBy("snapshot", F.col("asset").alias("src"))
            .agg(F.array_sort(F.collect_list(F.struct("rank", "other", "vec"))).alias("near"))
        )
        source = source.join(bundle, ["snapshot", "src"], "left")
    target = v.select("snapshot", F.col("asset").alias("dst"), F.col("vec").alias("y"))
    out = both.join(target, ["snapshot", "dst"]).join(source, ["snapshot", "src"])
    if neighbours is None or n_controls == 0:
        return out.withColumn("controls", F.expr("CAST(array() AS array<array<double>>)"))
    kept = F.slice(F.filter("near", lambda n: n["other"] != F.col("dst")), 1, n_controls)
    return out.withColumn("controls", F.coalesce(F.transform(kept, lambda n: n["vec"]),
                                                 F.expr("CAST(array() AS array<array<double>>)"))).drop("near")


def _residual(y: np.ndarray, design: np.ndarray) -> np.ndarray:
    """Least-squares residuals for a batch: ``y`` (B, T), ``design`` (B, T, k)."""
    beta = np.linalg.pinv(design) @ y[:, :, None]
    return y - (design @ beta)[:, :, 0]


def partial_lead(x: np.ndarray, y: np.ndarray, controls: np.ndarray, lag: int):
    """Correlation of y(t) and x(t-lag) after projecting out y(t-lag) and controls(t).

    Arrays are batches ``(B, T)`` and ``(B, k, T)``; returns ``(r, p)``.
    """
    n_batch, total = x.shape
    if total < lag + 10:
        return np.zeros(n_batch), np.ones(n_batch)
    design = np.concatenate([y[:, None, :-lag], controls[:, :, lag:]], axis=1).transpose(0, 2, 1)
    ry, rx = _residual(y[:, lag:], design), _residual(x[:, :-lag], design)
    ry, rx = ry - ry.mean(1, keepdims=True), rx - rx.mean(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (ry * rx).sum(1) / np.sqrt((ry * ry).sum(1) * (rx * rx).sum(1))
        df = total - lag - 2
        p = t_two_sided(r * np.sqrt(df / np.maximum(1 - r * r, 1e-300)), df)
    ok = np.isfinite(r) & np.isfinite(p)
    return np.where(ok, np.clip(r, -1, 1), 0.0), np.where(ok, p, 1.0)


def granger_f(x: np.ndarray, y: np.ndarray, lag: int):
    """F test that lags 1..lag of x add to an autoregression of y, per batch row."""
    n_batch, total = x.shape
    if total < 3 * lag + 5:
        return np.zeros(n_batch), np.ones(n_batch)
    n = total - lag

    def lagged(m):
        return np.stack([m[:, lag - q:total - q] for q in range(1, lag + 1)], axis=2)

    small = np.concatenate([np.ones((n_batch, n, 1)), lagged(y)], axis=2)
    full = np.concatenate([small, lagged(x)], axis=2)
    ssr0 = (_residual(y[:, lag:], small) ** 2).sum(1)
    ssr1 = (_residual(y[:, lag:], full) ** 2).sum(1)
    df = n - 2 * lag - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        f = ((ssr0 - ssr1) / lag) / (ssr1 / df)
    ok = np.isfinite(f)
    f = np.where(ok, f, 0.0)
    return f, np.where(ok, f_upper(f, lag, df), 1.0)


def evidence(tests: DataFrame, lag: int = C.LAG, granger_lags=(C.GRANGER_LAG,), chunk: int = 512) -> DataFrame:
    """One row per oriented edge and Granger order with both test results."""
    types = {f.name: f.dataType.simpleString() for f in tests.schema.fields}
    schema = (f"snapshot {types['snapshot']}, src {types['src']}, dst {types['dst']}, weight double, "
              "n int, r double, p_r double, granger_lag int, f double, p_f double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shape = pd.Series(list(zip(pdf["x"].map(len), pdf["controls"].map(len))), index=pdf.index)
            for (total, k), part in pdf.groupby(shape):
                for at in range(0, len(part), chunk):
                    sub = part.iloc[at:at + chunk]
                    x, y = np.vstack(sub["x"]).astype(float), np.vstack(sub["y"]).astype(float)
                    c = (np.stack([np.vstack(list(m)) for m in sub["controls"]]).astype(float)
                         if k else np.empty((len(sub), 0, total)))
                    r, p = partial_lead(x, y, c, lag)
                    for g in granger_lags:
                        f, pf = granger_f(x, y, g)
                        yield pd.DataFrame({
                            "snapshot": sub["snapshot"].to_numpy(), "src": sub["src"].to_numpy(), "dst": sub["dst"].to_numpy(),
                            "weight": sub["weight"].to_numpy(float), "n": total, "r": r, "p_r": p,
                            "granger_lag": g, "f": f, "p_f": pf})

    return spread(tests).mapInPandas(run, schema)


def grid_cells() -> list[tuple]:
    """Rule settings of the sweep: the main grid plus the floor variants, no repeats."""
    main = [(a, t, g, C.GRANGER_FLOOR) for a in C.ALPHA_GRID for t in C.TAU_GRID for g in C.LAG_GRID]
    floors = [(C.ALPHA, C.TAU, C.GRANGER_LAG, f) for f in C.FLOOR_GRID]
    return list(dict.fromkeys(main + floors))


def with_cells(ev: DataFrame, cells: list[tuple]) -> DataFrame:
    """Pair every evidence row with the rule settings that read its Granger order."""
    cell = F.explode(F.array(*[
        F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(t)).alias("tau"), F.lit(int(g)).alias("cell_lag"), F.lit(float(f)).alias("floor"))
        for a, t, g, f in cells]))
    return ev.withColumn("cell", cell).where("cell.cell_lag = granger_lag").select(*ev.columns, "cell.alpha", "cell.tau", "cell.floor")


def decide(ev: DataFrame, method: str = "both", keys=("snapshot",)) -> DataFrame:
    """Verdict per undirected edge from evidence with columns ``alpha, tau, floor``.

    Lagged partial correlation speaks only when significant and positive, with
    its own size as confidence; the F test contributes the floor.
    """
    if method not in ("both", "lagged_partial", "granger"):
        raise ValueError(f"unknown method {method!r}")
    zero = F.lit(0.0)
    lead = F.when((F.col("p_r") < F.col("alpha")) & (F.col("r") > 0), F.col("r")).otherwise(zero)
    gran = F.when(F.col("p_f") < F.col("alpha"), F.col("floor")).otherwise(zero)
    conf = {"both": F.greatest(lead, gran), "lagged_partial": lead, "granger": gran}[method]
    k = list(keys)
    settings = ["alpha", "tau", "granger_lag", "floor"]
    forward = F.col("src") < F.col("dst")
    pair = (
        ev.withColumn("conf", conf)
        .groupBy(*k, *settings, F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"))
        .agg(F.max("weight").alias("weight"), F.max(F.when(forward, F.col("conf"))).alias("fwd"),
             F.max(F.when(~forward, F.col("conf"))).alias("bwd"))
    )
    verdict = (
        F.when((F.col("fwd") == 0) & (F.col("bwd") == 0), "none")
        .when(F.col("bwd") == 0, "forward").when(F.col("fwd") == 0, "backward")
        .when(F.col("fwd") >= F.col("tau") * F.col("bwd"), "forward")
        .when(F.col("bwd") >= F.col("tau") * F.col("fwd"), "backward").otherwise("mutual")
    )
    return pair.withColumn("verdict", verdict)


def with_rule(ev: DataFrame, alpha=C.ALPHA, tau=C.TAU, floor=C.GRANGER_FLOOR) -> DataFrame:
    return ev.withColumn("alpha", F.lit(float(alpha))).withColumn("tau", F.lit(float(tau))).withColumn("floor", F.lit(float(floor)))


def arcs(decided: DataFrame, keys=("snapshot",)) -> DataFrame:
    """Directed edge table ``(keys, src, dst, weight)``; mutual edges give both arcs."""
    fwd = F.struct(F.col("i").alias("src"), F.col("j").alias("dst"))
    bwd = F.struct(F.col("j").alias("src"), F.col("i").alias("dst"))
    which = (F.when(F.col("verdict") == "forward", F.array(fwd)).when(F.col("verdict") == "backward", F.array(bwd))
             .when(F.col("verdict") == "mutual", F.array(fwd, bwd)))
    return decided.select(*keys, "weight", F.explode(which).alias("e")).select(*keys, "e.src", "e.dst", "weight")


def tally(decided: DataFrame, keys=("snapshot",)) -> DataFrame:
    """Edge accounting per window and rule setting."""
    def n(v):
        return F.count(F.when(F.col("verdict") == v, 1))

    return (
        decided.groupBy(*keys, "alpha", "tau", "granger_lag", "floor")
        .agg(F.count("*").alias("n_input"), (n("forward") + n("backward")).alias("n_directed"),
             n("mutual").alias("n_mutual"), n("none").alias("n_dropped"))
        .withColumn("mutual_fraction", F.coalesce(
            F.col("n_mutual") / F.nullif(F.col("n_directed") + F.col("n_mutual"), F.lit(0)), F.lit(0.0)))
    )


def regime_means(tallied: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Mean mutual fraction by regime and rule setting, headline setting flagged."""
    head = ((F.col("alpha") == C.ALPHA) & (F.col("tau") == C.TAU) & (F.col("granger_lag") == C.GRANGER_LAG)
            & (F.col("floor") == C.GRANGER_FLOOR))
    return (
        tallied.join(snapshots.select("snapshot", "regime"), "snapshot")
        .groupBy("alpha", "tau", "granger_lag", "floor", "regime")
        .agg(F.avg("mutual_fraction").alias("mean_mutual"), F.sum("n_directed").alias("n_directed"), F.sum("n_mutual").alias("n_mutual"))
        .withColumn("headline", head)
    )
