"""Panel preparation on long ``(asset, date, value)`` tables.

A missing cell is an absent row. Panels are first aggregated to one row per
asset and date, so the rows of a single asset never exceed the length of the
trading calendar however many raw records it owns; per-asset windows are safe
under skew because of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora import config as C
from tremora.functions.exprs import clip, log_return
from tremora.session import attach


def calendar(dates: DataFrame) -> DataFrame:
    """Distinct dates numbered from zero.

    The numbering window has no key on purpose: it sees distinct trading days
    only (some ten thousand for forty years), never the fact rows.
    """
    w = Window.orderBy("date")
    return (
        dates.select("date").distinct()
        .withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
        .withColumn("next_date", F.lead("date").over(w))
    )


def to_panel(records: DataFrame, asset: str, date: Column, **measures: Column) -> DataFrame:
    """One row per asset and date; partial aggregation shrinks hot assets before the shuffle."""
    aggs = [c.alias(n) for n, c in measures.items()]
    return records.groupBy(F.col(asset).alias("asset"), date.alias("date")).agg(*aggs)


def forward_fill(panel: DataFrame, cal: DataFrame, value: str = "price", limit: int = 5) -> DataFrame:
    """Carry each observation over at most ``limit`` following calendar positions.

    Every observation emits itself and the gap positions it fills, so the dense
    grid is never built; positions past the calendar drop out in the last join.
    """
    w = Window.partitionBy("asset").orderBy("pos")
    reach = F.col("pos") + F.lit(limit)
    last = F.least(reach, F.coalesce(F.lead("pos").over(w) - 1, reach))
    return (
        panel.join(cal.select("date", "pos"), "date")
        .withColumn("last", last)
        .select("asset", value, F.col("pos").alias("src_pos"),
                F.explode(F.sequence("pos", "last")).alias("pos"))
        .join(cal.select("date", "pos"), "pos")
        .select("asset", "date", "pos", value, (F.col("pos") != F.col("src_pos")).alias("filled"))
    )


def log_diff(filled: DataFrame, value: str = "price") -> DataFrame:
    """Difference of logs between adjacent calendar positions."""
    w = Window.partitionBy("asset").orderBy("pos")
    prev = F.when(F.lag("pos").over(w) == F.col("pos") - 1, F.lag(value).over(w))
    return (
        filled.withColumn("x", F.log(value) - F.log(prev))
        .where(F.col("x").isNotNull())
        .select("asset", "date", "pos", "x")
    )


def simple_to_log(daily: DataFrame) -> DataFrame:
    return daily.where("ret IS NOT NULL").withColumn("x", log_return("ret"))


def split_adjusted(daily: DataFrame, asset: str = "permno") -> DataFrame:
    """``abs(prc)/cfacpr`` rescaled by the first valid factor of the asset."""
    w = (Window.partitionBy(asset).orderBy("date")
         .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        daily.where("prc IS NOT NULL AND cfacpr > 0")
        .withColumn("price", F.abs("prc") / F.col("cfacpr") * F.first("cfacpr").over(w))
    )


def coverage(panel: DataFrame, value: str = "price") -> DataFrame:
    return panel.groupBy("asset").agg(F.count(value).alias("n_obs"))


def coverage_filter(panel: DataFrame, cal: DataFrame, value: str = "price", min_frac: float = 0.05) -> DataFrame:
    """Assets observed on at least ``int(min_frac * calendar length)`` dates."""
    need = cal.agg(F.floor(F.count("*") * F.lit(min_frac)).alias("need"))
    kept = attach(coverage(panel, value), need).where("n_obs >= need").select("asset")
    return panel.join(kept, "asset", "left_semi")


def mask_before(panel: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Remove observations dated before the asset's cut-off (``asset, cutoff``)."""
    return (
        panel.join(cutoffs, "asset", "left")
        .where("cutoff IS NULL OR date >= cutoff").drop("cutoff")
    )


def zero_runs(returns: DataFrame, max_frac: float = 0.20, max_run: int = 20, min_obs: int = 20) -> DataFrame:
    """Zero-return share and longest zero run per asset, with the contamination verdict."""
    order = Window.partitionBy("asset").orderBy("pos")
    by_kind = Window.partitionBy("asset", "is_zero").orderBy("pos")
    runs = (
        returns.withColumn("is_zero", (F.col("x") == 0.0).cast("int"))
        .withColumn("seq", F.row_number().over(order))
        .withColumn("island", F.col("seq") - F.row_number().over(by_kind))
        .groupBy("asset", "is_zero", "island").agg(F.count("*").alias("len"))
    )
    zero = F.col("is_zero") == 1
    return (
        runs.groupBy("asset").agg(
            F.sum("len").alias("n_obs"),
            F.coalesce(F.sum(F.when(zero, F.col("len"))), F.lit(0)).alias("n_zero"),
            F.coalesce(F.max(F.when(zero, F.col("len"))), F.lit(0)).alias("max_run"))
        .where(F.col("n_obs") >= min_obs)
        .withColumn("zero_frac", F.col("n_zero") / F.col("n_obs"))
        .withColumn("contaminated", (F.col("zero_frac") > max_frac) | (F.col("max_run") > max_run))
    )


def drop_assets(panel: DataFrame, assets: DataFrame) -> DataFrame:
    return panel.join(assets.select("asset"), "asset", "left_anti")


def keep_assets(panel: DataFrame, assets: DataFrame) -> DataFrame:
    return panel.join(assets.select("asset"), "asset", "left_semi")


def dollar_volume(panel: DataFrame, price: Column, volume: Column) -> DataFrame:
    """Mean of ``abs(price) * volume`` over the dates where both exist."""
    return panel.groupBy("asset").agg(F.avg(F.abs(price) * volume).alias("adv"))


def sector_of(codes: DataFrame, bands: DataFrame, code: str) -> DataFrame:
    """Sector of an integer code by inclusive bands.

    Bands unroll to their single codes (a few thousand integers), which turns
    the range condition into an equi join. Bands do not overlap.
    """
    lookup = bands.select(F.explode(F.sequence("lo", "hi")).alias(code), "sector")
    return codes.join(lookup, code, "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


def latest_names(names: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Latest label per permanent id; labels held by several ids get the id appended."""
    latest = names.groupBy("permno").agg(
        F.max_by(F.struct("ticker", "comnam", "siccd"), F.struct("nameenddt", "namedt")).alias("n"))
    out = latest.select("permno", F.coalesce("n.ticker", F.lit("UNK")).alias("ticker"), "n.comnam", "n.siccd")
    if overrides is not None:
        out = (out.join(overrides.select("permno", F.col("ticker").alias("forced")), "permno", "left")
               .withColumn("ticker", F.coalesce("forced", "ticker")).drop("forced"))
    shared = out.groupBy("ticker").agg((F.count("*") > 1).alias("shared"))
    return (
        out.join(shared, "ticker")
        .withColumn("asset", F.when(F.col("shared"), F.concat_ws("_", "ticker", F.col("permno").cast("string")))
                    .otherwise(F.col("ticker")))
        .drop("shared")
    )


def trading_day_on_or_before(events: DataFrame, cal: DataFrame, date: str) -> DataFrame:
    """Map an event date to the last calendar date not after it (``trade_date``).

    Each calendar date owns the days up to its successor, so the as-of lookup is
    an equi join on days. Dates before the calendar find no partner; dates after
    it belong to the final entry and are resolved without a join.
    """
    owned = (
        cal.where("next_date IS NOT NULL")
        .select(F.col("date").alias("trade_date"),
                F.explode(F.sequence("date", F.date_sub("next_date", 1))).alias(date))
    )
    end = cal.agg(F.max("date").alias("end_date"))
    return (
        attach(events, end).join(owned, date, "left")
        .withColumn("trade_date", F.coalesce("trade_date", F.when(F.col(date) >= F.col("end_date"), F.col("end_date"))))
        .drop("end_date")
    )


def splice_delisting(returns: DataFrame, delisting: DataFrame, cal: DataFrame, start=None, end=None) -> DataFrame:
    """Compound delisting returns into the last trading day, floored at -0.9999.

    ``returns`` holds simple returns ``(asset, date, ret)``, ``delisting``
    ``(asset, dlstdt, dlret)``. Several events on one day compound together.
    """
    ev = delisting.withColumn("dlret", F.col("dlret").try_cast("double")).where("dlret IS NOT NULL")
    if start is not None:
        ev = ev.where(F.col("dlstdt") >= F.lit(start))
    if end is not None:
        ev = ev.where(F.col("dlstdt") <= F.lit(end))
    known = returns.select("asset").distinct()
    ev = (
        trading_day_on_or_before(ev.join(known, "asset", "left_semi"), cal, "dlstdt")
        .where("trade_date IS NOT NULL")
        .groupBy("asset", F.col("trade_date").alias("date"))
        .agg((F.product(1 + F.col("dlret")) - 1).alias("dlret"))
    )
    both = returns.join(ev, ["asset", "date"], "full")
    combined = (1 + F.coalesce("ret", F.lit(0.0))) * (1 + F.col("dlret")) - 1
    return both.select(
        "asset", "date",
        F.when(F.col("dlret").isNull(), F.col("ret"))
        .otherwise(F.greatest(combined, F.lit(-0.9999))).alias("ret"),
        F.col("dlret").isNotNull().alias("spliced"))


def splice_series(old: DataFrame, new: DataFrame, cut: str) -> DataFrame:
    """Older series strictly before the cut date, newer one from it on."""
    d = F.to_date(F.lit(cut))
    return (
        old.where(F.col("date") < d).withColumn("source", F.lit("old"))
        .unionByName(new.where(F.col("date") >= d).withColumn("source", F.lit("new")))
    )


def extend_later(base: DataFrame, extension: DataFrame, keys=("asset",)) -> DataFrame:
    """Rows of ``base`` plus those of ``extension`` strictly later than its last date per key."""
    last = base.groupBy(*keys).agg(F.max("date").alias("last"))
    tail = (
        extension.join(last, list(keys), "left")
        .where("last IS NULL OR date > last").drop("last").withColumn("segment", F.lit("extension"))
    )
    return base.withColumn("segment", F.lit("base")).unionByName(tail)


def union_keep_first(first: DataFrame, second: DataFrame, keys=("asset",)) -> DataFrame:
    """Union where a key present in both keeps the rows of ``first``."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def augment(panel: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append further assets on the panel's own calendar.

    Also returns the problems as rows ``(problem, asset)``: labels present on
    both sides, and added assets without a single date on the calendar.
    """
    days = panel.select("date").distinct()
    fitted = extra.join(days, "date", "left_semi").select(*panel.columns)
    both = panel.withColumn("segment", F.lit("panel")).unionByName(fitted.withColumn("segment", F.lit("added")))
    clash = extra.select("asset").distinct().intersect(panel.select("asset").distinct()).select(F.lit("overlap").alias("problem"), "asset")
    lost = extra.select("asset").distinct().join(fitted.select("asset").distinct(), "asset", "left_anti").select(F.lit("off_calendar").alias("problem"), "asset")
    return both, clash.unionByName(lost)


def mask_by_source(panel: DataFrame, source: str, keep: list[str], value: str) -> DataFrame:
    """Null ``value`` outside the listed provenance labels."""
    return panel.withColumn(value, F.when(F.col(source).isin(keep), F.col(value)))


def static_z(returns: DataFrame, min_obs: int = 30) -> DataFrame:
    """Standard score of ``100 * x`` per asset (sample deviation)."""
    stats = returns.groupBy("asset").agg(
        F.count("x").alias("n"), F.avg(F.col("x") * 100).alias("mu"), F.stddev_samp(F.col("x") * 100).alias("sd"))
    return (
        returns.join(stats.where((F.col("n") >= min_obs) & (F.col("sd") > 0)), "asset")
        .withColumn("z", (F.col("x") * 100 - F.col("mu")) / F.col("sd"))
        .select("asset", "date", "pos", "z")
    )


def snapshot_days(snapshots: DataFrame) -> DataFrame:
    """Inclusive window bounds unrolled to days, so window membership is an equi join."""
    return snapshots.select("snapshot", F.explode(F.sequence("start", "end")).alias("date"))


def in_windows(panel: DataFrame, snapshots: DataFrame) -> DataFrame:
    return panel.join(snapshot_days(snapshots), "date")


def alive(panel: DataFrame, snapshots: DataFrame, cal: DataFrame, value: str = "x",
          min_coverage: float = C.MIN_COVERAGE, min_rows: int = C.MIN_ROWS) -> DataFrame:
    """Assets with at least ``max(min_rows, int(min_coverage * window rows))`` values per window."""
    n_rows = in_windows(cal.select("date"), snapshots).groupBy("snapshot").agg(F.count("*").alias("n_rows"))
    n_obs = in_windows(panel, snapshots).groupBy("snapshot", "asset").agg(F.count(value).alias("n_obs"))
    need = F.greatest(F.lit(min_rows), F.floor(F.col("n_rows") * F.lit(min_coverage)))
    return n_obs.join(n_rows, "snapshot").where(F.col("n_obs") >= need)


def complete_cases(panel: DataFrame, snapshots: DataFrame, cal: DataFrame, value: str = "x",
                   min_coverage: float = C.MIN_COVERAGE, min_rows: int = C.MIN_ROWS,
                   min_assets: int = C.MIN_ASSETS, std_floor: float = C.STD_FLOOR,
                   bound: float = C.CLIP) -> DataFrame:
    """Balanced window panels: alive assets on the dates where all of them are observed."""
    n_rows = in_windows(cal.select("date"), snapshots).groupBy("snapshot").agg(F.count("*").alias("n_rows"))
    return balance(in_windows(panel, snapshots), n_rows, value, min_coverage, min_rows, min_assets, std_floor, bound)


def balance(rows: DataFrame, n_rows: DataFrame, value: str = "x", min_coverage: float = C.MIN_COVERAGE,
            min_rows: int = C.MIN_ROWS, min_assets: int = C.MIN_ASSETS, std_floor: float = C.STD_FLOOR,
            bound: float = C.CLIP) -> DataFrame:
    """Complete cases of rows already keyed by window; ``n_rows`` holds the calendar rows per window."""
    need = F.greatest(F.lit(min_rows), F.floor(F.col("n_rows") * F.lit(min_coverage)))
    live = (
        rows.groupBy("snapshot", "asset").agg(F.count(value).alias("n_obs")).join(n_rows, "snapshot")
        .where(F.col("n_obs") >= need).select("snapshot", "asset")
    )
    p = live.groupBy("snapshot").agg(F.count("*").alias("p")).where(F.col("p") >= min_assets)
    kept = rows.join(live, ["snapshot", "asset"])
    full = (
        kept.groupBy("snapshot", "date").agg(F.count(value).alias("k")).join(p, "snapshot").where("k = p")
        .select("snapshot", "date")
    )
    enough = full.groupBy("snapshot").agg(F.count("*").alias("n_days")).where(F.col("n_days") >= min_rows)
    by_asset = Window.partitionBy("snapshot", "asset")
    return (
        kept.join(full.join(enough.select("snapshot"), "snapshot", "left_semi"), ["snapshot", "date"], "left_semi")
        .withColumn("sd", F.stddev_samp(value).over(by_asset))
        .where(F.col("sd") > std_floor)
        .select("snapshot", "date", "asset", clip(value, bound).alias(value))
    )


def balanced_assets(panel: DataFrame, snapshots: DataFrame, cal: DataFrame, value: str = "x") -> DataFrame:
    """Column-wise completeness: assets observed on every calendar date of the window."""
    n_rows = in_windows(cal.select("date"), snapshots).groupBy("snapshot").agg(F.count("*").alias("n_rows"))
    rows = in_windows(panel, snapshots)
    n_obs = rows.groupBy("snapshot", "asset").agg(F.count(value).alias("n_obs"))
    keep = n_obs.join(n_rows, "snapshot").where("n_obs = n_rows").select("snapshot", "asset")
    return rows.join(keep, ["snapshot", "asset"], "left_semi")
