"""Pair statistics of window panels as a blocked matrix product.

Each asset becomes one vector per window (its length is the number of window
days). Assets are cut into blocks, every vector is replicated once per opposite
block, and one task handles one pair of blocks with a dense product. A task
holds ``2 * block`` vectors whatever the universe size, no asset-by-date pair
rows are shuffled, and reductions (moments, histogram, cut, neighbours) happen
inside the task so only what the caller asks for leaves it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora.session import attach, spread

BLOCK = 256
BINS = 4096


def vectors(panel: DataFrame, value: str = "x", order: str = "date", keys=("snapshot",)) -> DataFrame:
    """One ordered array per window and asset, with the asset's rank as index."""
    k = list(keys)
    w = Window.partitionBy(*k)
    ids = panel.select(*k, "asset").distinct().select(  # keys only: the vectors themselves are not sorted
        *k, "asset", (F.row_number().over(w.orderBy("asset")) - 1).cast("int").alias("idx"), F.count("*").over(w).cast("int").alias("p"))
    vec = panel.groupBy(*k, "asset").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("s"))
    return vec.join(ids, k + ["asset"]).select(*k, "asset", "idx", "p", F.col("s.v").alias("vec"))


def blocked(vecs: DataFrame, task: Callable, schema: str, keys=("snapshot",), block: int = BLOCK,
            extra: list[str] | None = None) -> DataFrame:
    """Run ``task(key, a, b, same)`` on every unordered pair of asset blocks."""
    k = list(keys)
    width = F.when(F.col("whole"), F.col("p")).otherwise(F.lit(block)) if "whole" in vecs.columns else F.lit(block)
    v = (
        vecs.withColumn("blk", F.floor(F.col("idx") / width).cast("int"))
        .withColumn("n_blk", F.ceil(F.col("p") / width).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1)))
        .withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other"))
        .select(*k, "bi", "bj", "blk", "asset", "idx", "p", "vec", *(extra or []))
    )
    n = len(k)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = key[n], key[n + 1]
        pdf = pdf.sort_values("idx")
        a = pdf[pdf["blk"] == bi]
        b = a if bi == bj else pdf[pdf["blk"] == bj]
        out = task(a, b, bi == bj)
        for name, val in zip(k, key):
            out.insert(0, name, val)
        return out

    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vecs.schema.fields if f.name in k)
    return spread(v, *k, "bi", "bj").groupBy(*k, "bi", "bj").applyInPandas(run, f"{key_schema}, {schema}")


def _stack(pdf: pd.DataFrame) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=float) for v in pdf["vec"]])


def corr_block(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Pearson correlation of the rows of two blocks."""

    def unit(pdf):
        m = _stack(pdf)
        m = m - m.mean(axis=1, keepdims=True)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)

    return unit(a) @ unit(b).T


def second_moment_block(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Uncentred second moment of the negative parts."""
    na, nb = np.minimum(_stack(a), 0.0), np.minimum(_stack(b), 0.0)
    return na @ nb.T / na.shape[1]


def _pairs_of(a, b, same, diagonal=False):
    """Row and column positions that represent each unordered pair once."""
    if same:
        return np.triu_indices(len(a), k=0 if diagonal else 1)
    r, c = np.indices((len(a), len(b)))
    return r.ravel(), c.ravel()


def pair_values(vecs: DataFrame, block_fn: Callable = corr_block, diagonal: bool = False,
                keys=("snapshot",), block: int = BLOCK, extra: list[str] | None = None) -> DataFrame:
    """Every pair ``(i, j, v)`` with ``i < j`` by asset order."""
    t = _asset_type(vecs)

    def task(a, b, same):
        m = block_fn(a, b)
        r, c = _pairs_of(a, b, same, diagonal)
        return pd.DataFrame({"i": a["asset"].to_numpy()[r], "j": b["asset"].to_numpy()[c], "v": m[r, c]})

    return blocked(vecs, task, f"i {t}, j {t}, v double", keys, block, extra)


def pair_summary(vecs: DataFrame, block_fn: Callable = corr_block, keys=("snapshot",), block: int = BLOCK,
                 extra: list[str] | None = None) -> DataFrame:
    """Sum and count of the pair values per window; blocks reduce before the shuffle."""

    def task(a, b, same):
        m = block_fn(a, b)
        r, c = _pairs_of(a, b, same)
        v = m[r, c]
        return pd.DataFrame({"s": [float(v.sum())], "n": [int(v.size)]})

    part = blocked(vecs, task, "s double, n bigint", keys, block, extra)
    return part.groupBy(*keys).agg(F.sum("s").alias("sum_v"), F.sum("n").alias("n_pairs"))


def _bin(v: np.ndarray) -> np.ndarray:
    return np.minimum((np.abs(v) * BINS).astype(np.int64), BINS - 1)


def strongest_pairs(vecs: DataFrame, budget: DataFrame, block_fn: Callable = corr_block,
                    keys=("snapshot",), block: int = BLOCK, extra: list[str] | None = None) -> DataFrame:
    """Exactly the ``k`` pairs of largest magnitude per window, ties by ``(i, j)``.

    ``budget`` holds ``(keys, k)``. A first pass counts magnitudes in fixed
    bins, which locates the bin holding the k-th value; a second pass emits only
    pairs from that bin upwards. Pairs above the bin are in; only those inside
    it are ranked for the remaining places. The full pair table never leaves the
    tasks, and no window ranks more than one bin.
    """
    k = list(keys)
    t = _asset_type(vecs)

    def count_bins(a, b, same):
        m = block_fn(a, b)
        v = m[_pairs_of(a, b, same)]
        n = np.bincount(_bin(v[np.isfinite(v)]), minlength=BINS)
        hit = np.flatnonzero(n)
        return pd.DataFrame({"bin": hit, "n": n[hit]})

    hist = blocked(vecs, count_bins, "bin bigint, n bigint", keys, block, extra).groupBy(*k, "bin").agg(F.sum("n").alias("n"))
    above = Window.partitionBy(*k).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*k)
    cut = (
        hist.join(budget, k).withColumn("cum", F.sum("n").over(above)).withColumn("all", F.sum("n").over(total))
        .where(F.col("cum") >= F.least("k", "all")).groupBy(*k)
        .agg(F.max("bin").alias("cut"), F.max_by(F.col("k") - F.col("cum") + F.col("n"), "bin").alias("open"))
    )

    def emit(a, b, same):
        m = block_fn(a, b)
        r, c = _pairs_of(a, b, same)
        v = m[r, c]
        at = np.where(np.isfinite(v), _bin(np.nan_to_num(v)), -1)
        ok = at >= a["cut"].iloc[0]
        return pd.DataFrame({"i": a["asset"].to_numpy()[r[ok]], "j": b["asset"].to_numpy()[c[ok]],
                             "v": v[ok], "open": a["open"].iloc[0], "edge": at[ok] == a["cut"].iloc[0]})

    cand = blocked(vecs.join(cut, k), emit, f"i {t}, j {t}, v double, open bigint, edge boolean", keys, block, ["cut", "open", *(extra or [])])
    rank = Window.partitionBy(*k, "edge").orderBy(F.desc(F.abs("v")), "i", "j")
    last = cand.where("edge").withColumn("rank", F.row_number().over(rank)).where("rank <= open")
    return cand.where("NOT edge").select(*k, "i", "j", "v").unionByName(last.select(*k, "i", "j", "v"))


def strongest_neighbours(vecs: DataFrame, n: int = 6, block_fn: Callable = corr_block,
                         keys=("snapshot",), block: int = BLOCK, extra: list[str] | None = None) -> DataFrame:
    """The ``n`` partners of largest magnitude of every asset.

    A block pair keeps at most ``n`` candidates per asset and side; the global
    best ``n`` are among them.
    """
    k = list(keys)
    t = _asset_type(vecs)

    def best(m, src, dst):
        take = min(n + 1, m.shape[1])
        mag = np.where(src[:, None] == dst[None, :], -1.0, np.abs(m))
        cols = np.argsort(-mag, axis=1, kind="stable")[:, :take]
        rows = np.repeat(np.arange(len(src)), take)
        cols = cols.ravel()
        ok = mag[rows, cols] >= 0
        return pd.DataFrame({"asset": src[rows[ok]], "other": dst[cols[ok]], "v": m[rows[ok], cols[ok]]})

    def task(a, b, same):
        m = block_fn(a, b)
        ia, ib = a["asset"].to_numpy(), b["asset"].to_numpy()
        return best(m, ia, ib) if same else pd.concat([best(m, ia, ib), best(m.T, ib, ia)])

    rank = Window.partitionBy(*k, "asset").orderBy(F.desc(F.abs("v")), "other")
    return (
        blocked(vecs, task, f"asset {t}, other {t}, v double", keys, block, extra)
        .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)
    )


def _asset_type(vecs: DataFrame) -> str:
    return vecs.schema["asset"].dataType.simpleString()


def mean_correlation(vecs: DataFrame, keys=("snapshot",), block: int = BLOCK) -> DataFrame:
    return pair_summary(vecs, corr_block, keys, block).withColumn("mean_corr", F.col("sum_v") / F.col("n_pairs"))


def edge_budget(vecs: DataFrame, density: float | None = None, n_edges: int | None = None) -> DataFrame:
    """Shared edge budget of the windows: explicit, by density, or the default rule.

    The default is ``max(p_min, round(0.05 * p_min * (p_min - 1) / 2))`` with
    half-even rounding, on the smallest window universe.
    """
    p = vecs.groupBy("snapshot").agg(F.count("*").alias("p"))
    low = F.min("p").over(Window.partitionBy(F.lit(1)))
    pairs = low * (low - 1) / 2
    if n_edges is not None:
        k = F.lit(n_edges)
    elif density is not None:
        k = F.bround(pairs * F.lit(density))
    else:
        k = F.greatest(low, F.bround(pairs * F.lit(0.05)))
    return p.withColumn("k", k.cast("bigint")).select("snapshot", "k")


# ---------------------------------------------------------------- dynamic correlation


def adcc_block(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Window-average correlation of two blocks under fixed dynamic parameters.

    Element ``(i, j)`` of the quasi-correlation obeys its own scalar recursion;
    only the diagonals couple it to its two assets, and both are in the task.
    Steps whose diagonal is unusable keep the previous state and do not count.
    """
    pa, pb, pg = (float(a[c].iloc[0]) for c in ("a", "b", "g"))
    za, zb = _stack(a), _stack(b)
    na, nb = np.minimum(za, 0.0), np.minimum(zb, 0.0)
    steps = za.shape[1]

    def diag_start(n):
        return (1 - pa - pb) - pg * (n * n).mean(axis=1)

    ca, cb = diag_start(na), diag_start(nb)
    q = corr_block(a, b)
    c = (1 - pa - pb) * q - pg * (na @ nb.T) / steps
    qa, qb = np.ones(len(a)), np.ones(len(b))
    total, used = np.zeros_like(q), 0
    for t in range(1, steps):
        ya = ca + pa * za[:, t - 1] ** 2 + pb * qa + pg * na[:, t - 1] ** 2
        yb = cb + pa * zb[:, t - 1] ** 2 + pb * qb + pg * nb[:, t - 1] ** 2
        bad = not (np.isfinite(ya).all() and np.isfinite(yb).all() and (ya > 0).all() and (yb > 0).all())
        if bad:
            continue
        q = c + pa * np.outer(za[:, t - 1], zb[:, t - 1]) + pb * q + pg * np.outer(na[:, t - 1], nb[:, t - 1])
        qa, qb = ya, yb
        total += q / np.sqrt(np.outer(np.maximum(qa, 1e-8), np.maximum(qb, 1e-8)))
        used += 1
    return total / used if used else np.full_like(q, np.nan)


def guarded_windows(vecs: DataFrame, params: DataFrame) -> DataFrame:
    """Attach parameters and mark windows in which some diagonal turns unusable.

    A diagonal can only leave the positive range when its intercept is negative,
    which is one arithmetic test per asset. Marked windows run as one block, so
    a frozen step freezes all their pairs together.
    """
    neg = F.aggregate("vec", F.lit(0.0), lambda s, z: s + F.least(z, F.lit(0.0)) * F.least(z, F.lit(0.0)))
    v = attach(vecs, params.select("a", "b", "g").limit(1))
    c = (1 - F.col("a") - F.col("b")) - F.col("g") * neg / F.size("vec")
    return v.withColumn("whole", F.max(c <= 0).over(Window.partitionBy("snapshot")))


def adcc_mean_correlation(vecs: DataFrame, params: DataFrame, block: int = BLOCK) -> DataFrame:
    """Window-average dynamic correlation ``(snapshot, i, j, v)`` for parameters ``(a, b, g)``."""
    v = guarded_windows(vecs, params)
    return pair_values(v, adcc_block, block=block, extra=["a", "b", "g"])


# ---------------------------------------------------------------- many observations, few columns


def column_correlations(rows: DataFrame, vec: str, keys=("snapshot",)) -> DataFrame:
    """Correlation of the positions of an array column over arbitrarily many rows per key.

    Every task folds its rows into one moment table per key, so a key holding
    most of the data is summed where it lies; only moments are shuffled.
    """
    k = list(keys)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in k)

    def fold(batches):
        acc: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(k):
                m = np.vstack(part[vec]).astype(float)
                m = np.column_stack([np.ones(len(m)), m])
                acc[key] = acc.get(key, 0.0) + m.T @ m
        for key, g in acc.items():
            a, b = np.triu_indices(len(g))
            yield pd.DataFrame({**dict(zip(k, key)), "a": a, "b": b, "s": g[a, b]})

    mom = rows.select(*k, vec).mapInPandas(fold, f"{kinds}, a int, b int, s double").groupBy(*k, "a", "b").agg(F.sum("s").alias("s"))
    n = mom.where("a = 0 AND b = 0").select(*k, F.col("s").alias("n"))
    one = mom.where("a = 0 AND b > 0").select(*k, F.col("b").alias("c"), F.col("s").alias("m1"))
    sq = mom.where("a = b AND a > 0").select(*k, F.col("a").alias("c"), F.col("s").alias("m2"))
    stat = one.join(sq, k + ["c"])

    def side(name):
        return stat.select(*k, F.col("c").alias(name), F.col("m1").alias(f"{name}1"), F.col("m2").alias(f"{name}2"))

    t = mom.where("a > 0 AND a < b").join(n, k).join(side("a"), k + ["a"]).join(side("b"), k + ["b"])
    cov = F.col("s") - F.col("a1") * F.col("b1") / F.col("n")
    var = (F.col("a2") - F.col("a1") * F.col("a1") / F.col("n")) * (F.col("b2") - F.col("b1") * F.col("b1") / F.col("n"))
    return t.select(*k, F.col("a").alias("i"), F.col("b").alias("j"), (cov / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0))).alias("v"))
