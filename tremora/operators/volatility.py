"""Volatility models per asset, the pooled dynamic-correlation fit and unit-root tests.

Every asset is one vector as long as its calendar. Tasks optimise a fixed number of
assets at once, so the time loop runs over dates, never over assets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora import config as C
from tremora.session import attach, dealt, spread as over_tasks

MIN_STATIC, MIN_FIT = 30, 200
FIT_BATCH = 256  # series fitted together; their trial points stay in the processor's cache
TASK_SERIES = 8  # series that make a task of their own; a batch of so few costs little more than one series


def minimise(fun: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, size: float = 0.25,
             max_iter: int = 400, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray, int]:
    """Simplex search for a batch of independent problems.

    ``start`` is ``(B, d)``; ``fun(points, rows)`` scores points of the problems
    named by ``rows``. A round scores the reflected points in one call and the one
    further point that some of them ask for in a second; problems whose simplex
    has collapsed drop out of the batch.
    """
    n, d = start.shape
    pts = np.repeat(start[:, None, :], d + 1, axis=1)
    for q in range(d):
        pts[:, q + 1, q] += size
    val = fun(pts.reshape(-1, d), np.repeat(np.arange(n), d + 1)).reshape(n, d + 1)
    used = 0
    for used in range(1, max_iter + 1):
        order = np.argsort(val, axis=1, kind="stable")
        pts, val = np.take_along_axis(pts, order[:, :, None], 1), np.take_along_axis(val, order, 1)
        act = np.flatnonzero(val[:, -1] - val[:, 0] >= tol * (1 + np.abs(val[:, 0])))
        if not len(act):
            break
        mid, worst = pts[act, :-1].mean(axis=1), pts[act, -1]
        refl = 2 * mid - worst
        v, f = val[act], fun(refl, act)
        which = np.where(f < v[:, 0], 1, np.where(f < v[:, -2], 0, np.where(f < v[:, -1], 2, 3)))
        new = np.stack([refl, 3 * mid - 2 * worst, (mid + refl) / 2, (mid + worst) / 2], axis=1)[np.arange(len(act)), which]
        more = np.flatnonzero(which)
        if len(more):
            second = fun(new[more], act[more])
            back = (which[more] == 1) & (second >= f[more])  # the longer step is no better than the plain one
            new[more[back]] = refl[more[back]]
            f[more[~back]] = second[~back]
        ok = f < v[:, -1]
        pts[act[ok], -1], val[act[ok], -1] = new[ok], f[ok]
        bad = act[~ok]
        if len(bad):
            shrunk = (pts[bad, 1:] + pts[bad, :1]) / 2
            pts[bad, 1:] = shrunk
            val[bad, 1:] = fun(shrunk.reshape(-1, d), np.repeat(bad, d)).reshape(-1, d)
    best = np.argmin(val, axis=1)
    rows = np.arange(n)
    return pts[rows, best], val[rows, best], used


def garch_variance(eps2: np.ndarray, omega, alpha, beta, first) -> np.ndarray:
    """Conditional variance recursion; dates run along the first axis, assets along the second."""
    s2 = np.empty_like(eps2)
    s2[0] = first
    drive = omega + alpha * eps2
    for t in range(1, len(eps2)):
        np.multiply(s2[t - 1], beta, out=s2[t])
        s2[t] += drive[t - 1]
    return s2


def _natural(theta: np.ndarray):
    """Unconstrained to natural: mean, omega > 0, alpha, beta >= 0 with sum < 1, nu > 2."""
    mu, omega = theta[:, 0], np.exp(np.clip(theta[:, 1], -30, 30))
    persistence = 1 / (1 + np.exp(-np.clip(theta[:, 2], -30, 30)))
    share = 1 / (1 + np.exp(-np.clip(theta[:, 3], -30, 30)))
    return mu, omega, persistence * share, persistence * (1 - share), 2.05 + np.exp(np.clip(theta[:, 4], -10, 6))


def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def fit_garch(y: np.ndarray, live: np.ndarray) -> dict[str, np.ndarray]:
    """Student-t GARCH(1,1) with constant mean for a batch of percentage returns.

    Series of different length share the batch: ``live`` marks the real values,
    which come first in every row.
    """
    y, live = np.ascontiguousarray(y.T), np.ascontiguousarray(live.T)
    n = live.sum(axis=0)
    mean = (y * live).sum(axis=0) / n
    var = ((y - mean) ** 2 * live).sum(axis=0) / n
    starts = ((0.95, 0.08), (0.6, 0.3), (0.2, 0.5))
    b, k = y.shape[1], len(starts)

    def nll(theta, rows):
        mu, omega, alpha, beta, nu = _natural(theta)
        at = rows % b
        mask = live[:, at]
        e2 = (y[:, at] - mu) ** 2 * mask
        with np.errstate(all="ignore"):
            s2 = garch_variance(e2, omega, alpha, beta, e2.sum(axis=0) / n[at])
            const = _lgamma((nu + 1) / 2) - _lgamma(nu / 2) - 0.5 * np.log(np.pi * (nu - 2))
            ll = const - 0.5 * np.log(s2) - (nu + 1) / 2 * np.log1p(e2 / (s2 * (nu - 2)))
            out = -(ll * mask).sum(axis=0)
        return np.where(np.isfinite(out), out, 1e12)

    start = np.concatenate([np.column_stack([
        mean, np.log(np.maximum(var * (1 - pers), 1e-12)), np.full(b, np.log(pers / (1 - pers))),
        np.full(b, np.log(share / (1 - share))), np.full(b, np.log(6.0))]) for pers, share in starts])
    pts, val, _ = minimise(nll, start)
    pick = np.argmin(val.reshape(k, b), axis=0) * b + np.arange(b)
    mu, omega, alpha, beta, nu = _natural(pts[pick])
    e = (y - mu) * live
    s2 = garch_variance(e * e, omega, alpha, beta, (e * e).sum(axis=0) / n)
    return {"mu": mu, "omega": omega, "alpha": alpha, "beta": beta, "nu": nu, "nll": val[pick], "z": (e / np.sqrt(s2)).T}


def spread(series: DataFrame) -> DataFrame:
    """``series`` dealt to tasks, ``TASK_SERIES`` at a time."""
    return dealt(series, "garch-series", TASK_SERIES)


def garch(series: DataFrame) -> DataFrame:
    """Fit per asset; input ``(asset, dates, vec)`` with log returns in ``vec``.

    Output carries the parameters, the standardised residuals and a status:
    ``garch``, ``static`` (fewer than 200 values) or ``short`` (below 30).
    """
    t = series.schema["asset"].dataType.simpleString()
    d = series.schema["dates"].dataType.simpleString()
    names = ["mu", "omega", "alpha", "beta", "nu", "nll"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["vec"].map(len).to_numpy()
            status = np.where(size >= MIN_FIT, "garch", np.where(size >= MIN_STATIC, "static", "short"))
            out = pd.DataFrame({"asset": pdf["asset"].to_numpy(), "n": size, **{k: np.nan for k in names},
                                "status": status, "dates": pdf["dates"].to_numpy()})
            z = [np.full(s, np.nan) for s in size]
            every = np.flatnonzero(status == "garch")
            for at in range(0, len(every), FIT_BATCH):
                long = every[at:at + FIT_BATCH]
                live = np.arange(size[long].max())[None, :] < size[long][:, None]
                y = np.zeros(live.shape)
                y[live] = 100.0 * np.concatenate(pdf["vec"].iloc[long].to_list())
                fit = fit_garch(y, live)
                for k in names:
                    out.loc[long, k] = fit[k]
                for row, i in enumerate(long):
                    z[i] = fit["z"][row, :size[i]]
            for i in np.flatnonzero(status == "static"):
                y = 100.0 * np.asarray(pdf["vec"].iloc[i], float)
                sd = y.std(ddof=1)
                z[i] = (y - y.mean()) / sd if sd > 0 else z[i]
            out["z"] = z
            bad = np.array([not np.isfinite(v).all() for v in z])
            out["status"] = np.where(bad & (status != "short"), "failed", status)
            yield out[["asset", "n", *names, "status", "dates", "z"]]

    return spread(series).mapInPandas(run, f"asset {t}, n int, " + ", ".join(f"{k} double" for k in names) + f", status string, dates {d}, z array<double>")


def series_of(returns: DataFrame, value: str = "x") -> DataFrame:
    """One row per asset with its dates and values in order."""
    s = F.array_sort(F.collect_list(F.struct("date", F.col(value).cast("double").alias("v"))))
    return returns.groupBy("asset").agg(s.alias("s")).select("asset", F.col("s.date").alias("dates"), F.col("s.v").alias("vec"))


def residuals(fits: DataFrame) -> DataFrame:
    """Long residual panel ``(asset, date, z)`` of the usable fits."""
    ok = fits.where(F.col("status").isin("garch", "static"))
    return ok.select("asset", F.explode(F.arrays_zip("dates", "z")).alias("e")).select("asset", F.col("e.dates").alias("date"), "e.z")


def garch_filter(series: DataFrame, omega: float, alpha: float, beta: float) -> DataFrame:
    """Variance path for known parameters as an array fold inside Catalyst."""
    first = F.aggregate("vec", F.lit(0.0), lambda s, e: s + e * e) / F.size("vec")
    path = F.aggregate(
        F.slice("vec", F.lit(1), F.size("vec") - 1), F.array(first),
        lambda acc, e: F.concat(acc, F.array(F.lit(float(omega)) + F.lit(float(alpha)) * e * e + F.lit(float(beta)) * F.element_at(acc, -1))))
    return series.withColumn("s2", path).select("asset", F.explode(F.arrays_zip("dates", "s2")).alias("e")).select(
        "asset", F.col("e.dates").alias("date"), F.col("e.s2").alias("s2"))


# ------------------------------------------------------------------ dynamic correlation


def adcc_nll(theta: np.ndarray, z: np.ndarray, q_bar: np.ndarray, n_bar: np.ndarray, chunk: int = 256) -> float:
    """Negative Gaussian correlation likelihood; 1e10 outside the admissible region.

    Dates pass in chunks, so memory is ``chunk`` matrices however long the panel.
    """
    a, b, g = theta
    if min(theta) < 0 or a + b + g >= 1 - C.ADCC_SLACK:
        return 1e10
    const = (1 - a - b) * q_bar - g * n_bar
    if np.linalg.eigvalsh(const)[0] < -1e-8:
        return 1e10
    neg = np.minimum(z, 0.0)
    prev, total = q_bar, 0.0
    for at in range(1, len(z), chunk):
        x, m, now = z[at - 1:at + chunk - 1][:len(z) - at], neg[at - 1:at + chunk - 1][:len(z) - at], z[at:at + chunk]
        q = const + a * x[:, :, None] * x[:, None, :] + g * m[:, :, None] * m[:, None, :]
        q[0] += b * prev
        for t in range(1, len(q)):
            q[t] += b * q[t - 1]
        prev = q[-1]
        d = np.sqrt(np.maximum(np.diagonal(q, axis1=1, axis2=2), 1e-8))
        r = q / (d[:, :, None] * d[:, None, :])
        try:
            chol = np.linalg.cholesky(r)
        except np.linalg.LinAlgError:
            return 1e10
        quad = (now * np.linalg.solve(r, now[:, :, None])[:, :, 0]).sum()
        total += 2 * np.log(np.diagonal(chol, axis1=1, axis2=2)).sum() + quad - (now * now).sum()
    return float(0.5 * total)


def adcc_starts() -> list[tuple[float, float, float]]:
    """The fixed starts plus two random ones inside the stationary region."""
    rng = np.random.default_rng(C.ADCC_SEED)
    drawn = []
    for _ in range(2):
        raw = rng.dirichlet([1.0, 1.0, 1.0])
        drawn.append(tuple(float(v) for v in rng.uniform(0.85, 0.97) * raw))
    return [s for s in C.ADCC_STARTS + drawn if sum(s) < 1 - C.ADCC_SLACK]


def adcc_fit(resid: DataFrame, subset: DataFrame, min_rows: int = C.ADCC_MIN_ROWS, group: str | None = None) -> DataFrame:
    """Pooled ``(a, b, g)`` by multi-start likelihood, one start per task.

    ``subset`` lists at most 100 assets (optionally per ``group``), which with
    the calendar bounds the matrix each start works on. Returns one row per
    group with the best start, the spread over starts and a status.
    """
    keys = [group] if group else []
    k = subset.groupBy(*keys).agg(F.count("*").alias("k"))
    rows = resid.where("z IS NOT NULL").join(subset, "asset").select(*keys, "asset", "date", F.greatest(F.lit(-C.CLIP), F.least(F.lit(C.CLIP), F.col("z"))).alias("z"))
    day = rows.groupBy(*keys, "date").agg(F.array_sort(F.collect_list(F.struct("asset", "z"))).alias("r"))
    day = (day.join(k, keys) if keys else attach(day, k)).where(F.size("r") == F.col("k"))
    full = day.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", F.col("r.z").alias("z")))).alias("m")).select(*keys, F.col("m.z").alias("m"))
    starts = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), *[F.lit(v).alias(n) for n, v in zip("abg", s)]) for i, s in enumerate(adcc_starts())]))
    jobs = over_tasks(full.withColumn("s", starts).select(*keys, "m", "s.*"))
    lo, hi = np.array(C.ADCC_BOUNDS).T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                z = np.vstack(row["m"]).astype(float)
                base = {"start": row["start"], "n_rows": len(z), "n_assets": z.shape[1], **{c: row[c] for c in keys}}
                if len(z) < min_rows:
                    yield pd.DataFrame([{**base, "a": np.nan, "b": np.nan, "g": np.nan, "nll": np.nan, "status": "too_short"}])
                    continue
                q_bar, neg = np.corrcoef(z, rowvar=False), np.minimum(z, 0)
                n_bar = neg.T @ neg / len(z)

                def f(batch, _rows):
                    x = np.clip(batch, lo, hi)
                    out = np.abs(batch - x).sum(axis=1) * 1e6
                    return out + np.array([adcc_nll(v, z, q_bar, n_bar) for v in x])

                best, val, _ = minimise(f, np.array([[row["a"], row["b"], row["g"]]], float), size=0.02, max_iter=150, tol=1e-7)
                a, b, g = (float(v) for v in np.clip(best[0], lo, hi))
                ok = val[0] < 1e9 and a + b + g < 1 - C.ADCC_SLACK
                yield pd.DataFrame([{**base, "a": a, "b": b, "g": g, "nll": float(val[0]), "status": "ok" if ok else "rejected"}])

    gtype = f"{group} {subset.schema[group].dataType.simpleString()}, " if group else ""
    cols = keys + ["start", "n_rows", "n_assets", "a", "b", "g", "nll", "status"]
    fitted = jobs.mapInPandas(lambda it: (p[cols] for p in run(it)), gtype + "start int, n_rows int, n_assets int, a double, b double, g double, nll double, status string")
    good = F.when(F.col("status") == "ok", F.struct("nll", "start"))
    return fitted.groupBy(*keys).agg(
        F.min_by(F.struct("a", "b", "g", "nll"), good).alias("p"), F.max("n_rows").alias("n_rows"), F.max("n_assets").alias("n_assets"),
        F.count("*").alias("n_starts"), F.count(good).alias("n_ok"),
        *[(F.max(F.when(F.col("status") == "ok", F.col(c))) - F.min(F.when(F.col("status") == "ok", F.col(c)))).alias(f"spread_{c}") for c in "abg"],
    ).select(*keys, "p.*", "n_rows", "n_assets", "n_starts", "n_ok", F.greatest("spread_a", "spread_b", "spread_g").alias("spread"),
             (F.greatest("spread_a", "spread_b", "spread_g") > 1e-4).alias("multi_modal"))


def refit_needed(new: DataFrame, old: DataFrame, tol: float = 1e-4) -> bool:
    """Whether pooled parameters moved enough to rebuild the window correlations."""
    a, b = new.select("a", "b", "g").head(), old.select("a", "b", "g").head()
    return max(abs(x - y) for x, y in zip(a, b)) > tol


# ------------------------------------------------------------------ unit roots

# Response surface of the 5 % critical value, constant case, one variable.
ADF_CRIT_5 = (-2.86154, -2.8903, -4.234, -40.040)


def adf_statistic(x: np.ndarray) -> tuple[float, int]:
    """Augmented Dickey-Fuller t statistic with a constant, lags by AIC over a common sample."""
    n = len(x)
    max_lag = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    dx = np.diff(x)

    def design(lag, start):
        rows = np.arange(start, len(dx))
        cols = [x[rows], np.ones(len(rows))] + [dx[rows - q] for q in range(1, lag + 1)]
        return dx[rows], np.column_stack(cols)

    best, pick = np.inf, 0
    for lag in range(max_lag + 1):
        y, m = design(lag, max_lag)
        resid = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
        aic = len(y) * (np.log(2 * np.pi * (resid @ resid) / len(y)) + 1) + 2 * m.shape[1]
        if aic < best - 1e-12:
            best, pick = aic, lag
    y, m = design(pick, pick)
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    resid = y - m @ beta
    s2 = resid @ resid / (len(y) - m.shape[1])
    return float(beta[0] / np.sqrt(s2 * np.linalg.inv(m.T @ m)[0, 0])), pick


def adf(vecs: DataFrame, keys=("snapshot",)) -> DataFrame:
    """Unit-root statistic per window and asset; ``reject`` at the 5 % level, NULL when untestable."""
    k = list(keys)
    types = {f.name: f.dataType.simpleString() for f in vecs.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stat, lags, reject = [], [], []
            for v in pdf["vec"]:
                v = np.asarray(v, float)
                n = len(v)
                if n < MIN_STATIC or not np.isfinite(v).all() or np.ptp(v) == 0:
                    stat.append(None), lags.append(None), reject.append(None)
                    continue
                s, lag = adf_statistic(v)
                m = n - 1 - lag
                crit = sum(c / m**i for i, c in enumerate(ADF_CRIT_5))
                stat.append(s), lags.append(lag), reject.append(bool(s < crit))
            yield pd.DataFrame({**{c: pdf[c] for c in k}, "asset": pdf["asset"], "statistic": pd.array(stat, dtype="Float64"),
                                "lags": pd.array(lags, dtype="Int32"), "reject": pd.array(reject, dtype="boolean")})

    schema = ", ".join(f"{c} {types[c]}" for c in k) + f", asset {types['asset']}, statistic double, lags int, reject boolean"
    return over_tasks(vecs).mapInPandas(run, schema)


def adf_rates(tested: DataFrame) -> DataFrame:
    """Share of rejecting assets per window and the window with the lowest share."""
    r = tested.groupBy("snapshot").agg(
        F.count("reject").alias("n_tested"), (F.count(F.when(F.col("reject"), 1)) / F.nullif(F.count("reject"), F.lit(0))).alias("reject_rate"))
    low = Window.partitionBy(F.lit(1)).orderBy(F.col("reject_rate").asc_nulls_last(), "snapshot")
    return r.withColumn("is_floor", F.row_number().over(low) == 1)
