"""Data-quality checks as rows ``(stage, snapshot, name, passed, detail)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora import config as C
from tremora.functions.exprs import ebic_gamma, shrinkage_delta
from tremora.operators.sparse import CONVERGED
from tremora.operators.spectrum import smallest_eigenvalues
from tremora.session import attach


def check(df: DataFrame, stage: str, name: str, passed: Column, detail: Column | None = None) -> DataFrame:
    snap = F.col("snapshot").cast("string") if "snapshot" in df.columns else F.lit("-")
    return df.select(F.lit(stage).alias("stage"), snap.alias("snapshot"), F.lit(name).alias("name"),
                     F.coalesce(passed, F.lit(False)).alias("passed"),
                     (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit("NULL"))).alias("detail"))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def within(c: str, lo: float, hi: float, tol: float = 1e-9) -> Column:
    return F.col(c).between(lo - tol, hi + tol)


def parameters(params: DataFrame) -> DataFrame:
    """Pooled correlation parameters: positive and stationary."""
    s = F.col("a") + F.col("b") + F.col("g")
    return union(check(params, "stage1", "params_positive", (F.col("a") > 0) & (F.col("b") > 0) & (F.col("g") > 0)),
                 check(params, "stage1", "params_stationary", s < 1, s))


def volatility(fits: DataFrame) -> DataFrame:
    g = fits.where("status = 'garch'")
    s = F.col("alpha") + F.col("beta")
    return union(check(g, "stage1", "omega_positive", F.col("omega") > 0, F.col("asset")),
                 check(g, "stage1", "variance_stationary", s < 1 + 1e-9, s))


def correlations(pairs: DataFrame) -> DataFrame:
    """Finite, bounded and strictly ordered pair values, summarised per window."""
    t = pairs.groupBy("snapshot").agg(
        F.count(F.when(F.isnan("v") | F.col("v").isNull(), 1)).alias("bad"), F.max(F.abs("v")).alias("top"),
        F.count(F.when(F.col("i") >= F.col("j"), 1)).alias("unordered"))
    return union(check(t, "stage1", "corr_finite", F.col("bad") == 0, F.col("bad")),
                 check(t, "stage1", "corr_bounded", F.col("top") <= 1 + 1e-9, F.col("top")),
                 check(t, "stage1", "corr_ordered", F.col("unordered") == 0, F.col("unordered")))


def definiteness(pairs: DataFrame) -> DataFrame:
    """Smallest eigenvalue of each window matrix, at any number of assets."""
    nodes = pairs.select("snapshot", F.explode(F.array("i", "j")).alias("node")).distinct()
    low = smallest_eigenvalues(pairs, nodes)
    return check(low, "stage1", "corr_near_psd", F.col("low") >= -1e-8, F.col("low"))


def tiers(selection: DataFrame) -> DataFrame:
    r = F.col("n") / F.col("p")
    return union(check(selection, "stage2", "gamma_tier", F.col("gamma") == ebic_gamma(r)),
                 check(selection, "stage2", "delta_tier", F.col("delta") == shrinkage_delta(r)))


def sparse_edges(edges: DataFrame, selection: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    n = edges.groupBy("snapshot").agg(F.count("*").alias("found"), F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    t = selection.where("status = 'ok'").join(n, "snapshot", "left")
    parts = [check(t, "stage2", "edge_count", F.coalesce("found", F.lit(0)) == F.col("k")),
             check(t, "stage2", "weights_in_range", (F.col("lo") >= 0) & (F.col("hi") <= 1 + 1e-9)),
             check(selection, "stage2", "edge_floor", F.col("k") >= F.greatest("p", F.lit(10)), F.col("k"))]
    if scored is not None:
        v = scored.join(selection.where("status = 'ok'").select("snapshot", "lam"), ["snapshot", "lam"])
        parts.append(check(v, "stage2", "optimality", F.col("violation") < CONVERGED, F.col("violation")))
    return union(*parts)


def directions(arcs: DataFrame, tally: DataFrame) -> DataFrame:
    t = arcs.groupBy("snapshot").agg(F.min("weight").alias("lo"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops"))
    total = F.col("n_directed") + F.col("n_mutual") + F.col("n_dropped")
    n = arcs.groupBy("snapshot").agg(F.count("*").alias("n_arcs"))
    c = tally.join(n, "snapshot", "left")
    return union(check(t, "stage3", "weights_non_negative", F.col("lo") >= 0), check(t, "stage3", "no_self_loops", F.col("loops") == 0),
                 check(tally, "stage3", "edges_conserved", total == F.col("n_input")),
                 check(c, "stage3", "arc_count", F.coalesce("n_arcs", F.lit(0)) == F.col("n_directed") + 2 * F.col("n_mutual")))


def network(ranks: DataFrame, member: DataFrame | None, motifs: DataFrame | None) -> DataFrame:
    t = ranks.groupBy("snapshot").agg(F.sum("pagerank").alias("s"), F.min("pagerank").alias("lo"), F.count("*").alias("n"))
    parts = [check(t, "stage4", "pagerank_sums_to_one", F.abs(F.col("s") - 1) < 1e-6, F.col("s")), check(t, "stage4", "pagerank_positive", F.col("lo") > 0)]
    if member is not None:
        m = member.groupBy("snapshot").agg(F.countDistinct("node").alias("m")).join(t.select("snapshot", "n"), "snapshot", "right")
        parts.append(check(m, "stage4", "partition_covers_nodes", F.col("m") == F.col("n")))
    if motifs is not None:
        sq = sum((F.coalesce(F.col(c) * F.col(c), F.lit(0.0)) for c in ("sp_030t", "sp_021d", "sp_111d")), F.lit(0.0))
        some = F.coalesce("sp_030t", "sp_021d", "sp_111d").isNotNull()
        parts.append(check(motifs.where(some), "stage4", "profile_unit_norm", F.abs(sq - 1) < 1e-6, sq))
    return union(*parts)


def stress(indexed: DataFrame, weights: dict[str, float] = C.NSI_WEIGHTS, name: str = "nsi") -> DataFrame:
    again = sum((F.lit(float(w)) * F.col(f"{c}_norm") for c, w in weights.items()), F.lit(0.0))
    parts = [check(indexed, "stage5", "index_in_range", within(name, 0, 1), F.col(name)),
             check(indexed, "stage5", "index_recomputed", F.abs(again - F.col(name)) < 1e-9)]
    return union(*parts, *[check(indexed, "stage5", f"{c}_norm_in_range", within(f"{c}_norm", 0, 1)) for c in weights])


def same_members(left: DataFrame, right: DataFrame, stage: str, name: str) -> DataFrame:
    """Both tables list the same ``(snapshot, asset)`` pairs."""
    both = left.select("snapshot", "asset").distinct().withColumn("l", F.lit(1)).join(
        right.select("snapshot", "asset").distinct().withColumn("r", F.lit(1)), ["snapshot", "asset"], "full")
    t = both.groupBy("snapshot").agg(F.count(F.when(F.col("l").isNull() | F.col("r").isNull(), 1)).alias("bad"))
    return check(t, stage, name, F.col("bad") == 0, F.col("bad"))


def scale_guard(panel: DataFrame, raw: DataFrame, limit: float = 0.3) -> DataFrame:
    """Adjusted against raw price on the last shared date of each asset."""
    both = panel.select("asset", "date", "price").join(raw.select("asset", "date", F.col("price").alias("raw")), ["asset", "date"])
    last = both.groupBy("asset").agg(F.max_by(F.log(F.col("price") / F.col("raw")), "date").alias("gap"))
    return check(last.withColumnRenamed("asset", "snapshot"), "cache", "price_scale", F.abs("gap") <= limit, F.col("gap"))


def failure_share(expected: DataFrame, got: DataFrame, limit: float, name: str) -> DataFrame:
    """Share of expected assets without any record, against a limit."""
    e = expected.select("asset").distinct()
    miss = e.join(got.select("asset").distinct(), "asset", "left_anti").agg(F.count("*").alias("missing"))
    t = attach(e.agg(F.count("*").alias("n")), miss).withColumn("share", F.col("missing") / F.nullif("n", F.lit(0)))
    return check(t, "ingest", name, F.col("share") <= limit, F.col("share"))


def row_band(table: DataFrame, lo: int, hi: int, name: str) -> DataFrame:
    t = table.agg(F.count("*").alias("n"))
    return check(t, "ingest", name, F.col("n").between(lo, hi), F.col("n"))


def summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("stage", "name").agg(F.count("*").alias("n"), F.count(F.when(F.col("passed"), 1)).alias("n_passed"))


def failures(checks: DataFrame) -> DataFrame:
    """All failed checks as a table, to be written next to the report."""
    return checks.where("NOT passed").select("stage", "snapshot", "name", "detail")


def markdown(checks: DataFrame, title: str = "Invariant report") -> str:
    """Report text from the per-check summary; ``failures`` has the rows."""
    rows = summary(checks).orderBy("stage", "name").collect()
    out = [f"# {title}", "", f"{sum(r['n_passed'] for r in rows)} of {sum(r['n'] for r in rows)} checks passed.", "",
           "| stage | check | rows | passed |", "|---|---|---|---|"]
    out += [f"| {r['stage']} | {r['name']} | {r['n']} | {r['n_passed']} |" for r in rows]
    return "\n".join(out) + "\n"
