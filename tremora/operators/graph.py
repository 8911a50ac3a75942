"""Graph operators on edge tables. ``keys`` identify the graph, so all windows run in one job.

Directed graphs are ``(keys, src, dst, weight)``, undirected ones ``(keys, a, b,
weight)`` with ``a < b``, node tables ``(keys, node)``.

Ranks, communities and path lengths need rounds. Where the rows of a graph fit a task
(``SMALL`` of them, ``DENSE`` nodes for paths) its rounds run inside that task, all graphs
in one job; larger graphs go through distributed rounds, at any size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora import config as C
from tremora.session import materialize, materialize_with, release, spread

KEYS = ("snapshot",)
SMALL, DENSE = 200_000, 1_000


def graph_rows(edges: DataFrame, nodes: DataFrame, keys, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all graphs in one staged table ``(keys, a, b, weight, own)``, and ``(keys, n, n_rows)`` of each graph.

    A row of a node is ``own`` and names it twice, so ids stay integers in the tasks.
    """
    k = list(keys)
    kind = nodes.schema["node"].dataType
    own = nodes.select(*k, F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("weight"), F.lit(True).alias("own"))
    rows = materialize(own.unionByName(edges.select(
        *k, F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b"), F.col("weight").cast("double").alias("weight"), F.lit(False).alias("own"))), "graphs")
    return rows, rows.groupBy(*k).agg(F.count(F.when(F.col("own"), 1)).alias("n"), F.count(F.lit(1)).alias("n_rows"))


def in_place(rows: DataFrame, keys, columns: list[T.StructField], solve: Callable) -> DataFrame:
    """``solve(node, listed, a, b, weight)`` of every graph in ``graph_rows``, one task a graph.

    ``node`` holds the sorted ids, ``listed`` which of them the node table has, ``a``
    and ``b`` the places of edge ends in it; the result is a dict of the ``columns``.
    """
    k = list(keys)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["own"].to_numpy(bool)
        node, place = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
        a, b = place[:len(pdf)], place[len(pdf):]
        listed = np.zeros(len(node), bool)
        listed[a[own]] = True
        out = pd.DataFrame(solve(node, listed, a[~own], b[~own], pdf["weight"].to_numpy(float)[~own]))
        for name, v in zip(k, key):
            out[name] = v
        return out[k + [c.name for c in columns]]

    return spread(rows, *k).groupBy(*k).applyInPandas(run, T.StructType([rows.schema[c] for c in k] + columns))


def dyads(arcs: DataFrame, keys=KEYS) -> DataFrame:
    """One row per connected pair with flags for either arc; no self join needed."""
    up = F.col("src") < F.col("dst")
    return arcs.groupBy(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.max("weight").alias("weight"), F.max(up).alias("ab"), F.max(~up).alias("ba"))


def undirected(arcs: DataFrame, keys=KEYS) -> DataFrame:
    return dyads(arcs, keys).select(*keys, "a", "b", "weight")


def both_ways(und: DataFrame, keys=KEYS) -> DataFrame:
    """Each undirected edge seen from both ends."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                             F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return und.select(*keys, "weight", ends.alias("e")).select(*keys, "e.u", "e.v", "weight")


def degrees(und: DataFrame, nodes: DataFrame, keys=KEYS) -> DataFrame:
    k = list(keys)
    d = both_ways(und, keys).groupBy(*k, F.col("u").alias("node")).agg(
        F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    return (nodes.join(d, k + ["node"], "left")
            .select(*k, "node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength")))


def directed_degrees(arcs: DataFrame, nodes: DataFrame, keys=KEYS) -> DataFrame:
    k = list(keys)
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                             F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    d = arcs.select(*k, ends.alias("e")).groupBy(*k, "e.node").agg(F.sum("e.o").alias("out_deg"), F.sum("e.i").alias("in_deg"))
    return nodes.join(d, k + ["node"], "left").fillna(0, ["out_deg", "in_deg"])


def mean_degree(arcs: DataFrame, nodes: DataFrame, keys=KEYS) -> DataFrame:
    k = list(keys)
    n = nodes.groupBy(*k).agg(F.count("*").alias("n_nodes"))
    m = arcs.groupBy(*k).agg(F.count("*").alias("n_edges"))
    return n.join(m, k, "left").fillna(0, ["n_edges"]).withColumn("mean_degree", 2 * F.col("n_edges") / F.col("n_nodes"))


def reciprocity(arcs: DataFrame, keys=KEYS) -> DataFrame:
    """Counts of one-way and mutual dyads and the mutual share (NULL without edges)."""
    both = F.col("ab") & F.col("ba")
    return dyads(arcs, keys).groupBy(*keys).agg(
        F.count(F.when(~both, 1)).alias("n_directed"), F.count(F.when(both, 1)).alias("n_mutual"),
    ).withColumn("mutual_fraction", F.col("n_mutual") / F.nullif(F.col("n_directed") + F.col("n_mutual"), F.lit(0)))


def triangles(dy: DataFrame, keys=KEYS) -> DataFrame:
    """Every triangle of the undirected projection once, with the flags of its three dyads.

    Edges point from the lower to the higher ``(degree, id)``, so a hub fans out
    to few successors (at most sqrt(2m)) and the wedge join cannot explode on it.
    Output ``x < y < z`` with ``xy_f/xy_r`` etc. for the arcs along and against the order.
    """
    k = list(keys)
    deg = dy.select(*k, F.explode(F.array("a", "b")).alias("n")).groupBy(*k, "n").agg(F.count("*").alias("d"))
    e = (
        dy.join(deg.select(*k, F.col("n").alias("a"), F.col("d").alias("da")), k + ["a"])
        .join(deg.select(*k, F.col("n").alias("b"), F.col("d").alias("db")), k + ["b"])
    )
    low_a = F.struct("da", "a") < F.struct("db", "b")
    fan = e.select(*k, F.when(low_a, F.col("a")).otherwise(F.col("b")).alias("u"),
                   F.when(low_a, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = (
        fan.join(fan.withColumnRenamed("v", "w"), k + ["u"]).where("v < w")
    )
    closed = wedge.join(dy.select(*k, F.col("a").alias("v"), F.col("b").alias("w")), k + ["v", "w"])
    s = F.array_sort(F.array("u", "v", "w"))
    t = closed.select(*k, s[0].alias("x"), s[1].alias("y"), s[2].alias("z"))

    def attach(df, lo, hi):
        return df.join(dy.select(*k, F.col("a").alias(lo), F.col("b").alias(hi),
                                 F.col("ab").alias(f"{lo}{hi}_f"), F.col("ba").alias(f"{lo}{hi}_r")), k + [lo, hi])

    return attach(attach(attach(t, "x", "y"), "y", "z"), "x", "z")


def local_clustering(und: DataFrame, nodes: DataFrame, keys=KEYS) -> DataFrame:
    k = list(keys)
    dy = und.select(*k, "a", "b", F.lit(True).alias("ab"), F.lit(False).alias("ba"))
    per = triangles(dy, keys).select(*k, F.explode(F.array("x", "y", "z")).alias("node")).groupBy(*k, "node").agg(
        F.count("*").alias("tri"))
    d = F.col("degree")
    return (
        degrees(und, nodes, keys).join(per, k + ["node"], "left")
        .withColumn("tri", F.coalesce("tri", F.lit(0)))
        .withColumn("clustering", F.when(d >= 2, 2 * F.col("tri") / (d * (d - 1))).otherwise(0.0))
    )


def average_clustering(und: DataFrame, nodes: DataFrame, keys=KEYS) -> DataFrame:
    return local_clustering(und, nodes, keys).groupBy(*keys).agg(F.avg("clustering").alias("clustering"))


def triad_counts(arcs: DataFrame, keys=KEYS) -> DataFrame:
    """Counts of the transitive triad (030T), the out-star (021D) and 111D.

    Open triads are counted without listing them: all candidate pairs at a node
    follow from its degrees, and the ones closed by a third dyad are read off
    the triangles.
    """
    k = list(keys)
    dy = dyads(arcs, keys)
    mut = F.col("ab") & F.col("ba")
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("ab").alias("out"), F.col("ba").alias("inc")),
        F.struct(F.col("b").alias("node"), F.col("ba").alias("out"), F.col("ab").alias("inc"))))
    node = (
        dy.select(*k, ends.alias("e"))
        .groupBy(*k, "e.node").agg(
            F.count(F.when(F.col("e.out") & ~F.col("e.inc"), 1)).alias("o"),
            F.count(F.when(F.col("e.inc") & ~F.col("e.out"), 1)).alias("i"),
            F.count(F.when(F.col("e.inc") & F.col("e.out"), 1)).alias("m"))
    )
    stars = node.groupBy(*k).agg(
        F.sum(F.expr("o * (o - 1) DIV 2")).alias("out_pairs"), F.sum(F.expr("m * i")).alias("mut_in"))

    def side(p, q):
        """(out-only, in-only, mutual) of the dyad seen from p."""
        lo, hi = min(p, q), max(p, q)
        f, r = F.col(f"{lo}{hi}_f"), F.col(f"{lo}{hi}_r")
        out, inc = (f, r) if p == lo else (r, f)
        return out & ~inc, inc & ~out, out & inc

    one = F.lit(1)
    fan, hook = F.lit(0), F.lit(0)
    for p, q, s in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y")):
        (oq, iq, mq), (os_, is_, ms) = side(p, q), side(p, s)
        fan = fan + F.when(oq & os_, one).otherwise(0)
        hook = hook + F.when(mq & is_, one).otherwise(0) + F.when(ms & iq, one).otherwise(0)
    xy, yz, xz = F.col("xy_f"), F.col("yz_f"), F.col("xz_f")
    all_asym = ((F.col("xy_f") != F.col("xy_r")) & (F.col("yz_f") != F.col("yz_r")) & (F.col("xz_f") != F.col("xz_r")))
    cyclic = (xy == yz) & (xz != xy)
    tri = triangles(dy, keys).groupBy(*k).agg(
        F.count(F.when(all_asym & ~cyclic, 1)).alias("ffl"), F.sum(fan).alias("fan"), F.sum(hook).alias("hook"))
    return (
        stars.join(tri, k, "left").fillna(0, ["ffl", "fan", "hook"])
        .select(*k, F.col("ffl").alias("n_030t"), (F.col("out_pairs") - F.col("fan")).alias("n_021d"),
                (F.col("mut_in") - F.col("hook")).alias("n_111d"))
    )


def triads(u: np.ndarray, v: np.ndarray, mutual: np.ndarray) -> tuple[int, int, int]:
    """``triad_counts`` of one graph from its dyads, ``u`` to ``v`` or ``mutual``, by matrices of its nodes."""
    node, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[:len(u)], place[len(u):]
    one, both = np.zeros((2, len(node), len(node)))
    one[a[~mutual], b[~mutual]] = 1
    both[a[mutual], b[mutual]] = both[b[mutual], a[mutual]] = 1
    any_ = one + one.T + both
    out = one.sum(1)
    fan = ((one @ any_) * one).sum() / 2
    hook = ((both @ any_) * one.T).sum()
    return (int(((one @ one) * one).sum()), int((out * (out - 1)).sum() / 2 - fan), int((both.sum(1) * one.sum(0)).sum() - hook))


def pagerank(arcs: DataFrame, nodes: DataFrame, keys=KEYS, damping: float = C.DAMPING,
             iterations: int | None = None, tol: float = 1e-6, max_iter: int = 100, every: int = 5, small: int = SMALL) -> DataFrame:
    """Weighted PageRank with uniform teleport; ``n_iter`` reports the rounds used.

    Uniform redistribution of dangling mass only rescales the solution of
    ``y = damping * P'y + 1/n``, so rounds skip it and the result is normalised
    once. A round is one join on the source and one aggregation by target. The
    iteration stops when every graph changed by less than ``n * tol`` in total and
    raises if one has not after ``max_iter`` rounds. Graphs of at most ``SMALL`` rows
    make the same rounds inside tasks, unless there is a larger one among them.
    """
    k = list(keys)
    rows, size = graph_rows(arcs, nodes, keys, "src", "dst")
    if size.where(F.col("n_rows") > small).isEmpty():
        return _ranks_in_place(rows, nodes, k, damping, iterations, tol, max_iter, every)
    release(rows)
    n = nodes.groupBy(*k).agg(F.count("*").alias("n"))
    base = materialize(nodes.join(n, k).select(*k, "node", (1.0 / F.col("n")).alias("base")), "pr-base")
    total = arcs.groupBy(*k, "src").agg(F.sum("weight").alias("out_w"))
    step = materialize(arcs.join(total, k + ["src"]).select(
        *k, "src", "dst", (F.col("weight") / F.col("out_w") * F.lit(damping)).alias("p")), "pr-step")
    y = base.select(*k, "node", F.col("base").alias("y"))
    done, limit, kept = 0, iterations or max_iter, None
    while done < limit:
        prev = y
        todo = min(every, limit - done)
        for _ in range(todo):
            prev = y
            flow = y.join(step.withColumnRenamed("src", "node"), k + ["node"]).select(
                *k, F.col("dst").alias("node"), (F.col("y") * F.col("p")).alias("y"))
            y = flow.unionByName(base.select(*k, "node", F.col("base").alias("y"))).groupBy(*k, "node").agg(F.sum("y").alias("y"))
        done += todo
        if iterations is None:
            pair = materialize(y.join(prev.withColumnRenamed("y", "y0"), k + ["node"]), "pr-round")
            y = pair.select(*k, "node", "y")
            moved = F.sum(F.abs(F.col("y") - F.col("y0"))) / F.sum("y")
            if pair.groupBy(*k).agg((moved < F.count("*") * tol).alias("ok")).where("NOT ok").isEmpty():
                break
            release(kept)
            kept = pair
            if done >= limit:
                raise RuntimeError(f"ranks still move after {done} rounds")
        elif done < limit:
            y = materialize(y, "pr-round")
    w = Window.partitionBy(*k)
    return y.select(*k, "node", (F.col("y") / F.sum("y").over(w)).alias("pagerank"), F.lit(done).alias("n_iter"))


def _ranks_in_place(rows: DataFrame, nodes: DataFrame, k: list[str], damping: float, iterations: int | None, tol: float, max_iter: int, every: int) -> DataFrame:
    """Ranks after as many rounds as the slowest graph needs: those of the others are counted first, then made up for."""
    columns = [nodes.schema["node"], T.StructField("pagerank", T.DoubleType()), T.StructField("n_iter", T.IntegerType()), T.StructField("ok", T.BooleanType())]

    def solver(rounds: int | None):
        def solve(node, listed, a, b, weight):
            base = np.where(listed, 1.0 / max(listed.sum(), 1), 0.0)
            p = weight / np.bincount(a, weight, len(node))[a] * damping if len(a) else weight
            y, done, ok, limit = base, 0, rounds is not None, rounds or max_iter
            while done < limit:
                todo = limit if rounds else min(every, limit - done)
                for _ in range(todo):
                    prev, y = y, base + np.bincount(b, y[a] * p, len(node))
                done += todo
                if rounds is None and np.abs(y - prev).sum() / y.sum() < len(y) * tol:
                    ok = True
                    break
            keep = listed | (y > 0)
            return {"node": node[keep], "pagerank": (y / y.sum())[keep], "n_iter": done, "ok": ok}

        return solve

    got, seen = materialize_with(in_place(rows, k, columns, solver(iterations)), "pr", lo=F.min("n_iter"), hi=F.max("n_iter"), bad=F.count(F.when(~F.col("ok"), 1)))
    if seen["bad"]:
        raise RuntimeError(f"ranks still move after {seen['hi']} rounds")
    if seen["lo"] != seen["hi"]:
        release(got)
        got = materialize(in_place(rows, k, columns, solver(seen["hi"])), "pr")
    release(rows)
    return got.drop("ok")


def concentration(scores: DataFrame, value: str = "pagerank", top: int = 10, keys=KEYS) -> DataFrame:
    """Herfindahl (full and top-k renormalised), Gini (full and top-k) and top-k entropy."""
    k = list(keys)
    desc = Window.partitionBy(*k).orderBy(F.desc(value), "node")
    asc = Window.partitionBy(*k).orderBy(value, "node")
    r = scores.withColumn("rank", F.row_number().over(desc)).withColumn("up", F.row_number().over(asc))
    x, is_top = F.col(value), F.col("rank") <= top
    sums = r.groupBy(*k).agg(
        F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("hhi"), F.sum(F.col("up") * x).alias("ux"),
        F.sum(F.when(is_top, x)).alias("ts"), F.sum(F.when(is_top, x * x)).alias("ts2"),
        F.sum(F.when(is_top & (x > 0), x * F.log(x))).alias("tlog"), F.count(F.when(is_top, 1)).alias("tn"),
        F.sum(F.when(is_top, x * (F.lit(top) - F.col("rank")))).alias("trank"))
    ts = F.nullif("ts", F.lit(0.0))
    # rank r of the top-k descending is ascending position tn - r + 1
    top_up = F.col("trank") + (F.col("tn") + 1 - top) * F.col("ts")
    return sums.select(
        *k, F.col("n").alias("n_nodes"), "hhi",
        F.coalesce(F.when(F.col("s") > 0, 2 * F.col("ux") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")), F.lit(0.0)).alias("gini"),
        (F.col("ts2") / (ts * ts)).alias("hhi_top"),
        F.coalesce(2 * top_up / (F.col("tn") * ts) - (F.col("tn") + 1) / F.col("tn"), F.lit(0.0)).alias("gini_top"),
        (F.log(ts) - F.col("tlog") / ts).alias("entropy_top"))


def leaders(scores: DataFrame, n: int = 20, value: str = "pagerank", keys=KEYS) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(value), "node")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def connected_components(und: DataFrame, nodes: DataFrame, keys=KEYS) -> DataFrame:
    """Component label (smallest node) per node, by alternating star contraction.

    Each round links every node's larger neighbours, then its smaller ones, to
    the smallest node around; depth shrinks geometrically and rounds go on until one
    changes nothing. Minima are partial aggregates, so hubs cost no more than their edges.
    """
    k = list(keys)

    def large_star(e):
        s = e.select(*k, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(*k, F.col("b").alias("u"), F.col("a").alias("v")))
        low = s.groupBy(*k, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return s.where("v > u").join(low, k + ["u"]).select(*k, F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()

    def small_star(e):
        low = e.groupBy(*k, "hi").agg(F.min("lo").alias("m"))
        links = e.join(low, k + ["hi"])
        return (
            links.select(*k, F.col("lo").alias("b"), F.col("m").alias("a"))
            .unionByName(links.select(*k, F.col("hi").alias("b"), F.col("m").alias("a")))
            .where("a <> b").distinct()
        )

    e, last = und.select(*k, "a", "b"), None
    before = None
    while True:
        e, mark = materialize_with(small_star(large_star(e)), "cc", n=F.count(F.lit(1)),
                                   h=F.sum(F.xxhash64(*k, "a", "b").cast("decimal(38,0)")))
        release(before)
        if mark == last:
            break
        last, before = mark, e
    label = e.groupBy(*k, F.col("b").alias("node")).agg(F.min("a").alias("m"))
    return nodes.join(label, k + ["node"], "left").select(*k, "node", F.coalesce("m", "node").alias("component"))


def largest_component(comp: DataFrame, keys=KEYS) -> DataFrame:
    """Nodes of the largest component per graph, smallest label on a tie."""
    k = list(keys)
    size = comp.groupBy(*k, "component").agg(F.count("*").alias("size"))
    best = size.groupBy(*k).agg(F.max_by("component", F.struct(F.col("size"), -F.col("component"))).alias("component"))
    return comp.join(best, k + ["component"]).select(*k, "node")


def shape(n: int, a: np.ndarray, b: np.ndarray) -> tuple[float, float, int]:
    """Average clustering, mean path length and size of the largest component (on a tie that of the first node)."""
    adj = np.zeros((n, n), dtype=np.float32)
    adj[a, b] = adj[b, a] = 1.0
    deg = adj.sum(1)
    tri = ((adj @ adj) * adj).sum(1)
    possible = deg * (deg - 1)
    cluster = float(np.divide(tri, possible, out=np.zeros(n), where=possible > 0).mean()) if n else 0.0
    dist = np.full((n, n), -1, dtype=np.int32)
    np.fill_diagonal(dist, 0)
    front = np.eye(n, dtype=np.float32)
    step = 0
    while front.any():
        step += 1
        front = ((front @ adj) > 0) & (dist < 0)
        dist[front] = step
        front = front.astype(np.float32)
    sizes = (dist >= 0).sum(1)
    core = dist[np.argmax(sizes)] >= 0
    sub = dist[np.ix_(core, core)]
    size = int(core.sum())
    return cluster, float(sub.sum() / (size * (size - 1))) if size > 1 else 0.0, size


def _paths_in_place(rows: DataFrame, k: list[str]) -> DataFrame:
    def solve(node, listed, a, b, weight):
        _, length, size = shape(len(node), a, b)
        return {"n_core": [size], "path_length": [length]}

    return in_place(rows, k, [T.StructField("n_core", T.LongType()), T.StructField("path_length", T.DoubleType())], solve)


def average_path_length(und: DataFrame, nodes: DataFrame, keys=KEYS, dense: int = DENSE) -> DataFrame:
    """Mean shortest path over ordered pairs of the largest component.

    Graphs of at most ``dense`` nodes are searched in place, larger ones by frontier joins.
    """
    k = list(keys)
    rows, size = graph_rows(und.withColumn("weight", F.lit(1.0)), nodes, keys, "a", "b")
    large = materialize(size.where(F.col("n") > dense).select(*k), "paths-large")
    if large.isEmpty():
        return materialize(_paths_in_place(rows, k), "paths")
    small = materialize(_paths_in_place(rows.join(large, k, "left_anti"), k), "paths")
    return small.unionByName(_paths_by_joins(und.join(large, k, "left_semi"), nodes.join(large, k, "left_semi"), k))


def _paths_by_joins(und: DataFrame, nodes: DataFrame, k: list[str]) -> DataFrame:
    keys = tuple(k)
    core = materialize(largest_component(connected_components(und, nodes, keys), keys), "lcc")
    nb = materialize(both_ways(und, keys).select(*k, "u", "v").join(core.withColumnRenamed("node", "u"), k + ["u"]), "nb")
    seen = core.select(*k, F.col("node").alias("s"), F.col("node").alias("u"), F.lit(0).alias("d"))
    front, depth = seen, 0
    levels = []
    while True:
        depth += 1
        reach = front.select(*k, "s", "u").join(nb, k + ["u"]).select(*k, "s", F.col("v").alias("u")).distinct()
        front, got = materialize_with(
            reach.join(seen.select(*k, "s", "u"), k + ["s", "u"], "left_anti").withColumn("d", F.lit(depth)), "bfs", n=F.count(F.lit(1)))
        if got["n"] == 0:
            break
        levels.append(front)
        seen = seen.unionByName(front)
    size = core.groupBy(*k).agg(F.count("*").alias("n_core"))
    if not levels:
        return size.withColumn("path_length", F.lit(0.0))
    dist = seen.where("d > 0").groupBy(*k).agg(F.avg("d").alias("path_length"))
    return size.join(dist, k, "left").fillna(0.0, ["path_length"])


def modularity(und: DataFrame, member: DataFrame, keys=KEYS, resolution: float = 1.0) -> DataFrame:
    """Weighted modularity of a partition ``(keys, node, community)``."""
    k = list(keys)
    a = member.select(*k, F.col("node").alias("a"), F.col("community").alias("ca"))
    b = member.select(*k, F.col("node").alias("b"), F.col("community").alias("cb"))
    e = und.join(a, k + ["a"]).join(b, k + ["b"])
    ends = F.explode(F.array(
        F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0).alias("w_in")),
        F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("w_in"))))
    per = e.select(*k, "weight", ends.alias("x")).groupBy(*k, "x.c").agg(F.sum("x.w_in").alias("w_in"), F.sum("weight").alias("deg"))
    m = F.sum("deg").over(Window.partitionBy(*k)) / 2
    return (
        per.withColumn("m", m)
        .withColumn("q", F.col("w_in") / F.col("m") - F.lit(resolution) * F.pow(F.col("deg") / (2 * F.col("m")), 2))
        .groupBy(*k).agg(F.sum("q").alias("modularity"))
    )


def purity(member: DataFrame, sectors: DataFrame, keys=KEYS) -> DataFrame:
    """Dominant-sector share over classified nodes and over all nodes, with community count."""
    k = list(keys)
    s = sectors.select(F.col("asset").alias("node"), "sector")
    known = member.join(s, "node", "left").withColumn("known", F.col("sector").isNotNull() & (F.col("sector") != "Unknown"))
    cell = known.groupBy(*k, "community", "sector", "known").agg(F.count("*").alias("n"))
    best = cell.groupBy(*k, "community").agg(
        F.max(F.when(F.col("known"), F.col("n"))).alias("top"), F.sum("n").alias("size"),
        F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("classified"))
    return best.groupBy(*k).agg(
        F.count("*").alias("n_communities"), F.max("size").alias("largest"),
        (F.coalesce(F.sum("top"), F.lit(0)) / F.nullif(F.sum("classified"), F.lit(0))).alias("purity"),
        (F.coalesce(F.sum("top"), F.lit(0)) / F.sum("size")).alias("purity_all"))


def sector_incidence(arcs: DataFrame, sectors: DataFrame, keys=KEYS) -> DataFrame:
    """Edges by source and target sector, as share of the source sector's edges and per source node."""
    k = list(keys)
    s = sectors.select(F.col("asset").alias("src"), F.col("sector").alias("s_src"))
    t = sectors.select(F.col("asset").alias("dst"), F.col("sector").alias("s_dst"))
    size = sectors.groupBy(F.col("sector").alias("s_src")).agg(F.count("*").alias("n_src"))
    unk = F.lit("Unknown")
    cells = (
        arcs.join(s, "src", "left").join(t, "dst", "left")
        .groupBy(*k, F.coalesce("s_src", unk).alias("s_src"), F.coalesce("s_dst", unk).alias("s_dst")).agg(F.count("*").alias("n_edges"))
    )
    row = F.sum("n_edges").over(Window.partitionBy(*k, "s_src"))
    return cells.withColumn("row_share", F.col("n_edges") / row).join(size, "s_src", "left").withColumn(
        "per_node", F.col("n_edges") / F.col("n_src"))


def cross_sector(pairs: DataFrame, sectors: DataFrame, keys=KEYS) -> DataFrame:
    """Share of edges joining different sectors; two unknown sectors count as one."""
    si = sectors.select(F.col("asset").alias("i"), F.col("sector").alias("si"))
    sj = sectors.select(F.col("asset").alias("j"), F.col("sector").alias("sj"))
    unk = F.lit("Unknown")
    cross = F.coalesce("si", unk) != F.coalesce("sj", unk)
    return pairs.join(si, "i", "left").join(sj, "j", "left").groupBy(*keys).agg(
        F.count("*").alias("n_edges"), F.count(F.when(cross, 1)).alias("n_cross"),
    ).withColumn("cs_fraction", F.col("n_cross") / F.col("n_edges"))


def small_world(measured: DataFrame) -> DataFrame:
    """``(C/C0)/(L/L0)`` with NULL where a null mean vanishes; columns ``c, c0, l, l0``."""
    z = F.lit(0.0)
    c = F.col("c") / F.nullif("c0", z)
    l = F.col("l") / F.nullif("l0", z)
    return measured.withColumn("sigma", c / F.nullif(l, z))


def hub_subgraph(arcs: DataFrame, min_degree: int, keys=KEYS) -> DataFrame:
    """Arcs between nodes of at least ``min_degree`` total degree, with weight tiers at the 33rd and 67th percentile."""
    k = list(keys)
    deg = arcs.select(*k, F.explode(F.array("src", "dst")).alias("node")).groupBy(*k, "node").agg(F.count("*").alias("deg"))
    hubs = deg.where(F.col("deg") >= min_degree).select(*k, "node")
    sub = (arcs.join(hubs.withColumnRenamed("node", "src"), k + ["src"], "left_semi")
           .join(hubs.withColumnRenamed("node", "dst"), k + ["dst"], "left_semi"))
    q = sub.groupBy(*k).agg(F.percentile("weight", 0.33).alias("q33"), F.percentile("weight", 0.67).alias("q67"))
    return sub.join(q, k).withColumn(
        "tier", F.when(F.col("weight") >= F.col("q67"), 3).when(F.col("weight") >= F.col("q33"), 2).otherwise(1))
