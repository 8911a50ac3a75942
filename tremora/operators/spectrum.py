"""Smallest eigenvalue of the pair matrix of every window, of any size.

A window of at most ``DENSE`` assets is one dense matrix of 8 MB at most in a task, all
such windows one job. Larger ones go through Lanczos iteration at once: the matrix stays
a table with one row per asset (its partners and their values); a step is one product of
these rows with the windows' vectors, and only two numbers a window and step reach the
driver. Smallest Ritz values are right without orthogonalising again: lost orthogonality
only adds copies of values already found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora.session import materialize, release, values

DENSE = 1_000


def _ritz(alpha: list[float], beta: list[float]) -> tuple[float, float]:
    """Smallest Ritz value and the norm of its residual."""
    v, u = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return float(v[0]), float(abs(beta[-1] * u[-1, 0]))


def smallest_eigenvalues(pairs: DataFrame, nodes: DataFrame, value: str = "v", diagonal: float = 1.0, tol: float = 1e-8,
                         dense: int = DENSE) -> DataFrame:
    """``(snapshot, low, residual, steps)`` of the symmetric matrix with ``diagonal`` and the values of ``(snapshot, i, j)``.

    ``nodes`` is ``(snapshot, node)``; absent pairs are zero. Windows of at most ``dense``
    nodes are solved in place, with residual and steps zero. A larger one is done when
    its residual falls below ``tol`` times the size of its matrix, or when its
    vectors span an invariant space, which is so after one step per asset at most.
    """
    spark = pairs.sparkSession
    kind = nodes.schema["snapshot"].dataType.simpleString()
    place = Window.partitionBy("snapshot").orderBy("node")  # the assets of one window
    ids = materialize(nodes.select("snapshot", "node").distinct().withColumn("at", F.row_number().over(place) - 1).withColumn(
        "n", F.count("*").over(Window.partitionBy("snapshot"))), "ev-id")
    small, ids = ids.where(F.col("n") <= dense), ids.where(F.col("n") > dense)
    solved = materialize(_dense(pairs, small, value, diagonal, kind), "ev-low")
    if ids.isEmpty():
        return solved
    both = pairs.select("snapshot", "i", "j", F.col(value).alias("v")).unionByName(
        pairs.select("snapshot", F.col("j").alias("i"), F.col("i").alias("j"), F.col(value).alias("v")))
    row = both.join(ids.select("snapshot", F.col("node").alias("i"), F.col("at").alias("r")), ["snapshot", "i"]).join(
        ids.select("snapshot", F.col("node").alias("j"), F.col("at").alias("c")), ["snapshot", "j"])
    row = row.groupBy("snapshot", "r").agg(F.collect_list(F.struct("c", "v")).alias("e"))
    matrix = materialize(ids.select("snapshot", F.col("at").alias("r")).join(row, ["snapshot", "r"], "left").select(
        "snapshot", "r", F.coalesce("e.c", F.array().cast("array<int>")).alias("cs"), F.coalesce("e.v", F.array().cast("array<double>")).alias("vs")), "ev-matrix")
    start = F.xxhash64("r", F.lit(17)) / F.lit(2.0**63)
    size = {r[0]: (r[1], r[2]) for r in matrix.groupBy("snapshot").agg(
        F.count("*"), F.max(F.aggregate("vs", F.lit(0.0), lambda a, x: a + F.abs(x)))).collect()}
    norm = {k: abs(diagonal) + top for k, (_, top) in size.items()}
    alpha, beta, done = {k: [] for k in size}, {k: [] for k in size}, {}
    state = materialize(matrix.select("snapshot", "r", start.alias("q"), F.lit(0.0).alias("before")), "ev-q")
    length = {r[0]: r[1] for r in state.groupBy("snapshot").agg(F.sqrt(F.sum(F.col("q") * F.col("q")))).collect()}
    held, state = state, state.join(_numbers(spark, kind, length), "snapshot").select("snapshot", "r", (F.col("q") / F.col("x")).alias("q"), "before")
    while len(done) < len(size):
        x = state.groupBy("snapshot").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "q"))), lambda s: s["q"]).alias("xs"))
        dot = F.aggregate(F.zip_with("cs", "vs", lambda c, v: v * F.get("xs", c)), F.lit(0.0), lambda a, b: a + b)
        step = matrix.join(x, "snapshot").select("snapshot", "r", dot.alias("d")).join(state, ["snapshot", "r"])
        new = materialize(step.select("snapshot", "r", "q", "before", (F.col("d") + F.lit(diagonal) * F.col("q")).alias("y")), "ev-q")
        release(held)
        held = new
        last = new.join(_numbers(spark, kind, {k: beta[k][-1] if beta[k] else 0.0 for k in size if k not in done}), "snapshot")
        y = F.col("y") - F.col("x") * F.col("before")
        sums = {r[0]: r[1:] for r in last.groupBy("snapshot").agg(F.sum(F.col("q") * y), F.sum(y * y), F.sum(F.col("q") * F.col("q"))).collect()}
        a = {k: qy for k, (qy, _, _) in sums.items()}
        b = {k: float(np.sqrt(max(yy - 2 * qy * qy + qy * qy * qq, 0.0))) for k, (qy, yy, qq) in sums.items()}
        for k in a:
            alpha[k].append(a[k])
            beta[k].append(b[k])
            low, residual = _ritz(alpha[k], beta[k])
            if residual <= tol * norm[k] or b[k] <= 1e-7 * norm[k]:
                done[k] = (low, residual, len(alpha[k]))
        going = {k: v for k, v in b.items() if k not in done}
        if going:
            state = last.join(_numbers(spark, kind, {k: (a[k], v) for k, v in going.items()}, "a"), "snapshot").select(
                "snapshot", "r", ((y - F.col("a") * F.col("q")) / F.col("a2")).alias("q"), F.col("q").alias("before"))
    release(held)
    release(matrix)
    rows = [(k, *v) for k, v in done.items()]
    return solved.unionByName(values(spark, rows, ["snapshot", "low", "residual", "steps"], [kind, "DOUBLE", "DOUBLE", "INT"]))


def _dense(pairs: DataFrame, ids: DataFrame, value: str, diagonal: float, kind: str) -> DataFrame:
    """The result for windows whose matrix fits a task."""
    i, j = (ids.select("snapshot", F.col("node").alias(c), F.col("at").alias(a)) for c, a in (("i", "r"), ("j", "c")))
    entry = pairs.join(i, ["snapshot", "i"]).join(j, ["snapshot", "j"]).select("snapshot", F.col("r").alias("at"), "c", F.col(value).cast("double").alias("v"))
    rows = ids.select("snapshot", "at", "n").join(entry, ["snapshot", "at"], "left")

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((int(pdf["n"].iloc[0]),) * 2)
        at = pdf[pdf["c"].notna()]
        np.add.at(m, (at["at"].to_numpy(int), at["c"].to_numpy(int)), at["v"].to_numpy(float))
        low = np.linalg.eigvalsh(m + m.T + diagonal * np.eye(len(m)))[0]
        return pd.DataFrame({"snapshot": [key[0]], "low": [low], "residual": [0.0], "steps": [0]})

    return rows.groupBy("snapshot").applyInPandas(solve, f"snapshot {kind}, low double, residual double, steps int")


def _numbers(spark, kind: str, of: dict, name: str = "x") -> DataFrame:
    """A number, or two, per window as a table."""
    wide = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in of.items()]
    return values(spark, wide, ["snapshot", name, name + "2"][:len(wide[0])], [kind, "DOUBLE", "DOUBLE"][:len(wide[0])])
