"""Random-graph nulls: one row per draw fans out, draws run in parallel.

Seeds derive from ``(window, draw, seed)``, so results do not depend on how
rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora import config as C
from tremora.operators import graph as G
from tremora.session import materialize

TRIADS = ["n_030t", "n_021d", "n_111d"]


def draws(graphs: DataFrame, n: int, seed: int, name: str = "draw") -> DataFrame:
    """``n`` numbered copies of every row, each with its own 64-bit seed, spread over tasks."""
    keyed = graphs.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keyed = keyed.withColumn("seed", F.xxhash64(F.col("snapshot").cast("string"), F.col(name), F.lit(seed)))
    parts = int(graphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "snapshot", name)


def _rng(seed) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(int(seed) & (2**64 - 1)))


def random_edges(rng: np.random.Generator, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Exactly ``m`` distinct pairs of ``n`` nodes, uniformly."""
    total = n * (n - 1) // 2
    code = np.sort(rng.choice(total, size=min(m, total), replace=False))
    first = n * np.arange(n) - np.arange(n) * (np.arange(n) + 1) // 2
    a = np.searchsorted(first, code, side="right") - 1
    return a, code - first[a] + a + 1


def graph_shape(n: int, a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Average clustering and mean path length of the largest component."""
    return G.shape(n, a, b)[:2]


def er_shapes(sizes: DataFrame, n_sims: int = C.N_ER_SIMS, seed: int = 2026) -> DataFrame:
    """Clustering and path length of ``n_sims`` uniform graphs with the same ``n`` and ``m``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [graph_shape(int(n), *random_edges(_rng(s), int(n), int(m)))
                   for n, m, s in zip(pdf["n"], pdf["m"], pdf["seed"])]
            yield pd.DataFrame({"snapshot": pdf["snapshot"], "draw": pdf["draw"],
                                "c": [o[0] for o in out], "l": [o[1] for o in out]})

    return draws(sizes.select("snapshot", "n", "m"), n_sims, seed).mapInPandas(run, "snapshot string, draw int, c double, l double")


def er_test(arcs: DataFrame, nodes: DataFrame, n_sims: int = C.N_ER_SIMS, seed: int = 2026) -> DataFrame:
    """Clustering and path length against the uniform null: z scores (population deviation) and small-world ratio."""
    und = G.undirected(arcs)
    n = nodes.groupBy("snapshot").agg(F.count("*").alias("n"))
    m = und.groupBy("snapshot").agg(F.count("*").alias("m"))
    sizes = n.join(m, "snapshot", "left").fillna(0, ["m"])
    null = er_shapes(sizes, n_sims, seed).groupBy("snapshot").agg(
        F.avg("c").alias("c0"), F.stddev_pop("c").alias("c_sd"), F.avg("l").alias("l0"), F.stddev_pop("l").alias("l_sd"))
    shape = G.average_clustering(und, nodes).withColumnRenamed("clustering", "c").join(
        G.average_path_length(und, nodes).withColumnRenamed("path_length", "l"), "snapshot", "left")
    out = G.small_world(sizes.join(shape, "snapshot").join(null, "snapshot"))
    z = F.lit(0.0)
    out = out.withColumn("z_c", (F.col("c") - F.col("c0")) / F.nullif("c_sd", z)).withColumn(
        "z_l", (F.col("l") - F.col("l0")) / F.nullif("l_sd", z))
    return out.withColumn("is_non_random", F.coalesce(F.abs("z_c") > 1.96, F.lit(False)))


def er_edges(sizes: DataFrame, n_draws: int = C.N_ER_MATCHED, seed: int = 42) -> DataFrame:
    """Edge rows of uniform graphs, keyed by ``(snapshot, draw)``, nodes ``0..n-1``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, d, n, m, seed_ in zip(pdf["snapshot"], pdf["draw"], pdf["n"], pdf["m"], pdf["seed"]):
                a, b = random_edges(_rng(seed_), int(n), int(m))
                yield pd.DataFrame({"snapshot": s, "draw": d, "a": a, "b": b, "weight": 1.0})

    return draws(sizes.select("snapshot", "n", "m"), n_draws, seed).mapInPandas(
        run, "snapshot string, draw int, a bigint, b bigint, weight double")


def shuffle_class(rng: np.random.Generator, pairs: list, taken: set, mutual: bool) -> list:
    """Swap the second endpoints of random pairs of one dyad class.

    ``taken`` holds the node pairs (unordered) that are connected in either
    class; a swap is made only when both new pairs are free and the four
    endpoints differ, so degrees and the number of dyads of each class stay.
    """
    pairs = list(pairs)
    n = len(pairs)
    goal, budget, made = n, max(20 * n, 50), 0
    while n >= 2 and made < goal and budget > 0:
        budget -= 1
        i, j = (int(v) for v in rng.integers(0, n, 2))
        (u, v), (x, y) = pairs[i], pairs[j]
        if len({u, v, x, y}) < 4:
            continue
        new = (frozenset((u, y)), frozenset((x, v)))
        if new[0] in taken or new[1] in taken:
            continue
        taken -= {frozenset((u, v)), frozenset((x, y))}
        taken |= set(new)
        pairs[i], pairs[j] = (u, y), (x, v)
        made += 1
    return pairs


def dyad_lists(arcs: DataFrame) -> DataFrame:
    """``(snapshot, dyads, n)``: the sorted dyads of each window and its number of connected nodes."""
    d = G.dyads(arcs)
    src = F.when(F.col("ab"), F.col("a")).otherwise(F.col("b"))
    dst = F.when(F.col("ab"), F.col("b")).otherwise(F.col("a"))
    mutual = F.col("ab") & F.col("ba")
    lists = d.groupBy("snapshot").agg(F.array_sort(F.collect_list(F.struct(
        mutual.alias("mutual"), src.cast("bigint").alias("u"), dst.cast("bigint").alias("v")))).alias("dyads"))
    return lists.withColumn("n", F.size(F.array_union("dyads.u", "dyads.v")))


def rewired(rows, seed: int) -> tuple[list, list]:
    """Asymmetric and mutual dyads after one rewiring."""
    rng = _rng(seed)
    taken = {frozenset((r["u"], r["v"])) for r in rows}
    asym = shuffle_class(rng, [(r["u"], r["v"]) for r in rows if not r["mutual"]], taken, False)
    return asym, shuffle_class(rng, [(r["u"], r["v"]) for r in rows if r["mutual"]], taken, True)


def rewired_arcs(arcs: DataFrame, n_rewires: int = C.N_REWIRES, seed: int = 42) -> DataFrame:
    """Arcs of ``n_rewires`` dyad-preserving rewirings, keyed by ``(snapshot, draw)``.

    One row per draw carries the window's dyad list, whose length is the edge
    budget of the window.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, d, seed_, rows in zip(pdf["snapshot"], pdf["draw"], pdf["seed"], pdf["dyads"]):
                asym, mut = rewired(rows, seed_)
                ends = asym + mut + [(v, u) for u, v in mut]
                yield pd.DataFrame({"snapshot": s, "draw": d, "src": [e[0] for e in ends], "dst": [e[1] for e in ends], "weight": 1.0})

    return draws(dyad_lists(arcs).drop("n"), n_rewires, seed).mapInPandas(run, "snapshot string, draw int, src bigint, dst bigint, weight double")


def rewired_triads(lists: DataFrame, n_rewires: int, seed: int) -> DataFrame:
    """Triad counts of the same rewirings, each counted where it is drawn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rows, seed_ in zip(pdf["dyads"], pdf["seed"]):
                asym, mut = rewired(rows, seed_)
                ends = np.array(asym + mut, np.int64).reshape(-1, 2)
                out.append(G.triads(ends[:, 0], ends[:, 1], np.arange(len(ends)) >= len(asym)))
            yield pd.DataFrame({"snapshot": pdf["snapshot"], "draw": pdf["draw"], **{c: [o[i] for o in out] for i, c in enumerate(TRIADS)}})

    return draws(lists.drop("n"), n_rewires, seed).mapInPandas(run, "snapshot string, draw int, " + ", ".join(f"{c} bigint" for c in TRIADS))


def motif_test(arcs: DataFrame, n_rewires: int = C.N_REWIRES, seed: int = 42, dense: int = G.DENSE) -> DataFrame:
    """Triad z scores against rewirings and the normalised significance profile.

    Rewirings of windows with at most ``dense`` connected nodes are counted in the tasks
    that draw them, if there is a larger window all are counted by joins; counts are equal.
    """
    lists = materialize(dyad_lists(arcs), "dyads")
    if lists.where(F.col("n") > dense).isEmpty():
        null = rewired_triads(lists, n_rewires, seed)
    else:
        null = G.triad_counts(materialize(rewired_arcs(arcs, n_rewires, seed), "rewired"), ("snapshot", "draw"))
    names = TRIADS
    stats = null.groupBy("snapshot").agg(*[e for c in names for e in (F.avg(c).alias(f"{c}_mu"), F.stddev_pop(c).alias(f"{c}_sd"))])
    out = G.triad_counts(arcs).join(stats, "snapshot", "left")
    for c in names:
        out = out.withColumn(f"z_{c[2:]}", (F.col(c) - F.col(f"{c}_mu")) / F.nullif(f"{c}_sd", F.lit(0.0)))
    zs = [f"z_{c[2:]}" for c in names]
    norm = F.sqrt(sum((F.coalesce(F.col(z) * F.col(z), F.lit(0.0)) for z in zs), F.lit(0.0)))
    for z in zs:
        out = out.withColumn(z.replace("z_", "sp_"), F.col(z) / F.nullif(norm, F.lit(0.0)))
    return out


def threshold_quality(pairs: DataFrame, nodes: DataFrame, sectors: DataFrame, n_draws: int = C.N_ER_MATCHED, seed: int = 42) -> DataFrame:
    """Modularity and purity of threshold networks relative to uniform graphs of equal size."""
    from tremora.operators.community import louvain

    und = materialize(pairs.select("snapshot", F.col("i").alias("a"), F.col("j").alias("b"), F.abs("v").alias("weight")), "dm")
    n = nodes.groupBy("snapshot").agg(F.count("*").alias("n"))
    m = und.groupBy("snapshot").agg(F.count("*").alias("m"))
    sizes = materialize(n.join(m, "snapshot"), "dm-size")
    # networks and their random graphs share the rounds; the network is draw -1
    k, own = ("snapshot", "draw"), F.lit(-1).cast("int").alias("draw")
    drawn = er_edges(sizes, n_draws, seed).select(*k, "a", "b", "weight")
    every = materialize(drawn.unionByName(und.select("snapshot", own, "a", "b", "weight")), "dm-er")
    ids = draws(sizes, n_draws, seed).select("snapshot", "draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("node"))
    label = materialize(louvain(every, ids.unionByName(nodes.select("snapshot", own, "node")), k), "dm-label")
    found = G.modularity(every, label, k)
    q = found.where("draw = -1").select("snapshot", F.col("modularity").alias("q"))
    null = found.where("draw >= 0").groupBy("snapshot").agg(F.avg("modularity").alias("q_random"))
    member = label.where("draw = -1").drop("draw")
    out = sizes.join(q, "snapshot").join(G.purity(member, sectors), "snapshot").join(null, "snapshot", "left")
    return out.withColumn("q_rel", F.when(F.col("q_random") > 1e-6, (F.col("q") - F.col("q_random")) / F.col("q_random")))
