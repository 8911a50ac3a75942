"""Panel-size by selection-rule sweep: the job becomes part of the window key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora import config as C
from tremora.operators import direction as E
from tremora.operators import graph as G
from tremora.operators import nulls
from tremora.operators import pairs as A
from tremora.operators import panel as P
from tremora.operators import selection as S
from tremora.operators import stress as T
from tremora.session import materialize

SEP = "|"


def job_members(returns: DataFrame, adv: DataFrame, sizes, kinds) -> DataFrame:
    """``(kind, n, asset)`` of every job."""
    out = None
    for kind in kinds:
        for n in sizes:
            s = S.select_assets(returns, adv, n, kind).select(F.lit(kind).alias("kind"), F.lit(n).alias("n"), "asset")
            out = s if out is None else out.unionByName(s)
    return out


def run(returns: DataFrame, cal: DataFrame, snapshots: DataFrame, sectors: DataFrame, adv: DataFrame,
        sizes=tuple(C.PANEL_SIZES), kinds=C.SELECTION_KINDS, density: float = 0.3, alpha: float = 0.3, n_rewires: int = 20) -> DataFrame:
    """Network summary and index per job and window.

    Windows that cannot be analysed stay in the output with a status, so a
    failing job never hides others. The index is normalised within each job.
    """
    jobs = materialize(job_members(returns, adv, sizes, kinds), "sweep-jobs")
    key = F.concat_ws(SEP, "kind", F.col("n").cast("string"), "snapshot")
    names = jobs.select("kind", "n").distinct().withColumn("_k", F.lit(1))
    every = snapshots.select("snapshot", "regime").withColumn("_k", F.lit(1)).join(names, "_k").withColumn("key", key)
    every = materialize(every.select("key", "kind", "n", "snapshot", "regime"), "sweep-keys")
    rows = P.in_windows(returns, snapshots).join(jobs, "asset").withColumn("snapshot", key).select("snapshot", "date", "asset", "x")
    grid = P.in_windows(cal.select("date"), snapshots).groupBy("snapshot").agg(F.count("*").alias("n_rows"))
    grid = every.join(grid, "snapshot").select(F.col("key").alias("snapshot"), "n_rows")
    panel = materialize(P.balance(rows, grid), "sweep-panel")
    vecs = materialize(A.vectors(panel), "sweep-vecs")
    nodes = vecs.select("snapshot", F.col("asset").alias("node"))
    pairs_possible = F.col("p") * (F.col("p") - 1) / 2
    budget = vecs.select("snapshot", "p").distinct().select("snapshot", F.bround(pairs_possible * density).cast("bigint").alias("k"))
    strong = materialize(A.strongest_pairs(vecs, budget), "sweep-strong")
    near = A.strongest_neighbours(vecs, C.N_CONTROLS + 1)
    ev = E.evidence(E.ordered_tests(strong.withColumn("weight", F.abs("v")), vecs, near))
    arcs = materialize(E.arcs(E.decide(E.with_rule(ev, alpha=alpha))), "sweep-arcs")
    ranks = G.pagerank(arcs, nodes)
    motif = materialize(nulls.motif_test(arcs, n_rewires), "sweep-motifs")
    t = (
        every.withColumnRenamed("snapshot", "window").withColumnRenamed("key", "snapshot")
        .join(G.mean_degree(arcs, nodes), "snapshot", "left").join(A.mean_correlation(vecs).select("snapshot", "mean_corr"), "snapshot", "left")
        .join(G.concentration(ranks).select("snapshot", F.col("hhi_top").alias("hhi_top10"), "gini"), "snapshot", "left")
        .join(G.reciprocity(arcs).select("snapshot", "n_directed", "n_mutual", "mutual_fraction"), "snapshot", "left")
        .join(G.cross_sector(strong, sectors).select("snapshot", "cs_fraction"), "snapshot", "left")
        .join(motif.select("snapshot", F.col("z_030t").alias("z_ffl"), F.col("z_111d").alias("z_mr")), "snapshot", "left")
        .withColumn("status", F.when(F.col("n_nodes").isNull(), "skipped").otherwise("ok"))
    )
    t = materialize(t, "sweep-table")  # read several times below; rewirings are drawn once
    scored = T.snapshot_index(t.where("status = 'ok'"), by=("kind", "n"))
    cols = ["kind", "n", "window", "regime", "status", "n_nodes", "n_edges", "mean_corr", "hhi_top10", "gini", "mutual_fraction", "cs_fraction", "z_ffl", "z_mr"]
    return scored.select(*cols, "nsi").unionByName(
        t.where("status <> 'ok'").select(*cols).withColumn("nsi", F.lit(None).cast("double"))).withColumnRenamed("window", "snapshot")


def largest_gap(sweep: DataFrame, first: str = "coverage", second: str = "adv") -> DataFrame:
    """Per size the largest absolute index gap of two rules and where it occurs."""
    a = sweep.where(F.col("kind") == first).select("n", "snapshot", F.col("nsi").alias("a"))
    b = sweep.where(F.col("kind") == second).select("n", "snapshot", F.col("nsi").alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return a.join(b, ["n", "snapshot"]).groupBy("n").agg(F.max(gap).alias("max_gap"), F.max_by("snapshot", gap).alias("at"))


def decile_summary(sweep: DataFrame) -> DataFrame:
    """Largest size of each rule: mean index of crises and of baselines."""
    top = sweep.where("nsi IS NOT NULL").groupBy("kind").agg(F.max("n").alias("n"))
    return sweep.join(top, ["kind", "n"]).groupBy("kind", "n").agg(
        F.avg(F.when(F.col("regime") == "crisis", F.col("nsi"))).alias("crisis_mean"),
        F.avg(F.when(F.col("regime") == "baseline", F.col("nsi"))).alias("baseline_mean"))
