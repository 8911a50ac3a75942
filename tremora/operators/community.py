"""Modularity communities by local moving, all graphs of a table in one job.

Graphs whose rows fit a task move node by node inside it; larger ones move in parallel rounds.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.operators.graph import KEYS, SMALL, graph_rows, in_place
from tremora.session import materialize, materialize_with, release

LOOSE_ROUNDS = 6


def _strength(edges: DataFrame, k: list[str]) -> DataFrame:
    """Weighted degree per node; a self loop counts twice."""
    ends = F.explode(F.array("a", "b"))
    return edges.select(*k, "weight", ends.alias("node")).groupBy(*k, "node").agg(F.sum("weight").alias("k"))


def _neighbours(edges: DataFrame, k: list[str]) -> DataFrame:
    """Both directions ``(keys, u, v, weight)`` of the edges between different nodes."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return edges.where("a <> b").select(*k, "weight", ends.alias("e")).select(*k, "e.u", "e.v", "weight")


def best_moves(st: DataFrame, nb: DataFrame, k: list[str], resolution: float) -> DataFrame:
    """``(keys, node, own, k, m2, b, g0, s0)``: the best community ``b`` around each node and the gain and size of its own.

    ``st`` is ``(keys, node, c, k, m2)``. Gains are compared to nine decimals, above
    the noise of the order in which they were summed.
    """
    tot = st.groupBy(*k, "c").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
    to = nb.join(st.select(*k, F.col("node").alias("v"), "c"), k + ["v"]).select(*k, F.col("u").alias("node"), "c", "weight")
    own = st.select(*k, "node", "c", F.lit(0.0).alias("weight"))
    cand = (
        to.unionByName(own).groupBy(*k, "node", "c").agg(F.sum("weight").alias("w"))
        .join(st.select(*k, "node", F.col("c").alias("own"), "k", "m2"), k + ["node"])
        .join(tot, k + ["c"])
    )
    here = F.col("c") == F.col("own")
    gain = F.col("w") - F.lit(resolution) * F.col("k") * (F.col("tot") - F.when(here, F.col("k")).otherwise(0.0)) / F.col("m2")
    return cand.withColumn("gain", F.round(gain, 9)).groupBy(*k, "node").agg(
        F.max(F.struct(F.col("gain"), (-F.col("c")).alias("neg"), F.col("c"), F.col("size"))).alias("b"),
        F.max(F.when(here, F.col("gain"))).alias("g0"), F.max(F.when(here, F.col("size"))).alias("s0"),
        F.first("own").alias("own"), F.first("k").alias("k"), F.first("m2").alias("m2"))


def start_state(edges: DataFrame, member: DataFrame, k: list[str]) -> DataFrame:
    """Nodes with label ``c``, strength and twice the total weight of their graph."""
    total = edges.groupBy(*k).agg((F.sum("weight") * 2).alias("m2"))
    return member.join(_strength(edges, k), k + ["node"], "left").join(total, k, "left").select(
        *k, "node", F.col("community").alias("c"), F.coalesce("k", F.lit(0.0)).alias("k"), F.coalesce("m2", F.lit(1.0)).alias("m2"))


def _move(edges: DataFrame, member: DataFrame, k: list[str], resolution: float, loose: int) -> DataFrame:
    """Local moving on one level from the labels of ``member``; returns ``(keys, node, community)``.

    In the first ``loose`` rounds half of the nodes (by hash) that gain join their
    best neighbouring community at once; two singletons only merge towards the
    smaller label, which rules out swapping. From then on a move is made if no better
    one touches the community it leaves or the one it joins: such moves do not disturb
    each other, so each raises modularity by just its gain and the rounds end by
    themselves. A graph in which no node gains is settled and leaves the rounds.
    """
    st = materialize(start_state(edges, member, k).withColumn("gains", F.lit(True)), "lm")
    nb = materialize(_neighbours(edges, k), "lm-nb")
    for rnd in count():
        open_ = st.where("gains").select(*k).distinct()  # graphs in which a node gained when it was last looked at
        live = st.join(open_, k, "left_semi").drop("gains")
        best = best_moves(live, nb, k, resolution)
        gains = (F.col("b.c") != F.col("own")) & (F.col("b.gain") > F.col("g0"))
        if rnd < loose:
            upwards = (F.col("s0") == 1) & (F.col("b.size") == 1) & (F.col("b.c") > F.col("own"))
            new = best.withColumn("go", gains & ~upwards & (F.pmod(F.xxhash64("node", F.lit(rnd)), F.lit(2)) == 0))
        else:
            rank = F.struct(F.round(F.col("b.gain") - F.col("g0"), 9).alias("d"), F.xxhash64("node", F.lit(rnd)).alias("h"), F.col("node").alias("x"))
            best = best.withColumn("rank", F.when(gains, rank)).withColumn("to", F.col("b.c"))
            top = best.where("rank IS NOT NULL").select(*k, F.explode(F.array("own", "to")).alias("c"), "rank").groupBy(*k, "c").agg(F.max("rank").alias("top"))
            new = (
                best.join(top.select(*k, F.col("c").alias("own"), F.col("top").alias("t0")), k + ["own"], "left")
                .join(top.select(*k, F.col("c").alias("to"), F.col("top").alias("t1")), k + ["to"], "left")
                .withColumn("go", (F.col("rank") == F.col("t0")) & (F.col("rank") == F.col("t1"))))
        moved = new.select(*k, "node", F.when(F.coalesce("go", F.lit(False)), F.col("b.c")).otherwise(F.col("own")).alias("c"), "k", "m2", gains.alias("gains"))
        old = st
        st, seen = materialize_with(moved.unionByName(st.join(open_, k, "left_anti")), "lm", still=F.count(F.when(F.col("gains"), 1)))
        release(old)
        if seen["still"] == 0:
            release(nb)
            return st.select(*k, "node", F.col("c").alias("community"))


def _settle(a: np.ndarray, b: np.ndarray, weight: np.ndarray, label: np.ndarray, resolution: float) -> bool:
    """Move nodes one by one to their best community, in place, until none gains (to nine decimals); whether any moved."""
    n = len(label)
    strength = np.bincount(a, weight, n) + np.bincount(b, weight, n)
    m2 = float(strength.sum()) or 1.0
    total = np.bincount(label, strength, n).tolist()
    apart = a != b
    u, v, w = np.concatenate([a[apart], b[apart]]), np.concatenate([b[apart], a[apart]]), np.tile(weight[apart], 2)
    order = np.argsort(u, kind="stable")
    at = np.searchsorted(u[order], np.arange(n + 1)).tolist()
    v, w, k, c = v[order].tolist(), w[order].tolist(), strength.tolist(), label.tolist()
    ever, going = False, True
    while going:
        going = False
        for x in range(n):
            own = c[x]
            near = {own: 0.0}
            for i in range(at[x], at[x + 1]):
                to = c[v[i]]
                near[to] = near.get(to, 0.0) + w[i]
            pull = resolution * k[x] / m2
            stay = round(near.pop(own) - pull * (total[own] - k[x]), 9)
            best = max(((round(t - pull * total[to], 9), -to) for to, t in near.items()), default=None)
            if best is not None and best[0] > stay:
                c[x] = -best[1]
                total[own] -= k[x]
                total[c[x]] += k[x]
                going = ever = True
    label[:] = c
    return ever


def partition(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, resolution: float = 1.0) -> np.ndarray:
    """The smallest member of the community of each of ``n`` nodes, by the levels of ``louvain``."""
    label = np.arange(n)
    _settle(a, b, weight, label, resolution)
    while True:
        merged = True
        while merged:
            _, part = np.unique(label, return_inverse=True)
            top = np.arange(part.max(initial=-1) + 1)
            merged = _settle(part[a], part[b], weight, top, resolution)
            label = top[part]
        first = np.full(n, n)
        np.minimum.at(first, label, np.arange(n))
        label = first[label]
        if not _settle(a, b, weight, label, resolution):
            return label


def louvain(und: DataFrame, nodes: DataFrame, keys=KEYS, resolution: float = 1.0, small: int = SMALL) -> DataFrame:
    """Community label per node.

    Levels alternate local moving and contraction of communities to weighted super
    nodes until none merges; then single nodes may move again, and if one gains the
    levels start over from there. The result is a partition that neither moving a
    node nor merging communities improves. Graphs of at most ``small`` nodes and edges
    are solved one a task, the others in rounds that graphs without a change leave;
    so labels do not depend on the other graphs of a job. Node ids must be integers.
    """
    k = list(keys)
    rows, size = graph_rows(und, nodes, keys, "a", "b")
    large = materialize(size.where(F.col("n_rows") > small).select(*k), "lv-large")

    def solve(node, listed, a, b, weight):
        return {"node": node[listed], "community": node[partition(len(node), a, b, weight, resolution)][listed]}

    label = T.StructField("community", nodes.schema["node"].dataType)
    if large.isEmpty():
        return materialize(in_place(rows, k, [nodes.schema["node"], label], solve), "lv-member")
    member = materialize(in_place(rows.join(large, k, "left_anti"), k, [nodes.schema["node"], label], solve), "lv-member")
    return member.unionByName(_rounds(und.join(large, k, "left_semi"), nodes.join(large, k, "left_semi"), k, resolution))


def _rounds(und: DataFrame, nodes: DataFrame, k: list[str], resolution: float) -> DataFrame:
    """``louvain`` by parallel moves, for graphs of any size."""
    edges, member = und.select(*k, "a", "b", "weight"), nodes.select(*k, "node", F.col("node").alias("community"))
    member = _move(edges, member, k, resolution, LOOSE_ROUNDS)
    level = edges
    while True:
        part = member.select(*k, F.col("node"), F.col("community"))
        pa = part.select(*k, F.col("node").alias("a"), F.col("community").alias("ca"))
        pb = part.select(*k, F.col("node").alias("b"), F.col("community").alias("cb"))
        level = materialize(
            edges.join(pa, k + ["a"]).join(pb, k + ["b"])
            .groupBy(*k, F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight")), "lv-edges")
        top = part.select(*k, F.col("community").alias("node")).distinct().withColumn("community", F.col("node"))
        step = _move(level, top, k, resolution, LOOSE_ROUNDS)
        up = step.select(*k, F.col("node").alias("community"), F.col("community").alias("next"))
        merged, seen = materialize_with(member.join(up, k + ["community"]).select(*k, "node", "community", "next"), "lv-member",
                                        moved=F.count(F.when(F.col("community") != F.col("next"), 1)))
        release(level)
        if seen["moved"]:
            member = merged.select(*k, "node", F.col("next").alias("community"))
            continue
        again = _move(edges, member, k, resolution, 0)
        both, seen = materialize_with(again.join(member.withColumnRenamed("community", "was"), k + ["node"]), "lv-again",
                                      moved=F.count(F.when(F.col("community") != F.col("was"), 1)))
        if not seen["moved"]:
            return member
        member = both.drop("was")


def gaining_moves(und: DataFrame, member: DataFrame, keys=KEYS, resolution: float = 1.0) -> DataFrame:
    """``(keys, n_gaining)``: nodes of each graph that another community around them would suit better; 0 at a local optimum."""
    k = list(keys)
    edges = und.select(*k, "a", "b", "weight")
    best = best_moves(start_state(edges, member, k), _neighbours(edges, k), k, resolution)
    return best.groupBy(*k).agg(F.count(F.when((F.col("b.c") != F.col("own")) & (F.col("b.gain") > F.col("g0")), 1)).alias("n_gaining"))
