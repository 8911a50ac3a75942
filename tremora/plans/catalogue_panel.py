"""Panel, selection, as-of and source queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremora import config as C
from tremora.functions import exprs as X
from tremora.operators import asof
from tremora.operators import panel as P
from tremora.operators import selection as S
from tremora.plans import ctes  # noqa: F401
from tremora.plans import standin as D
from tremora.plans.registry import query
from tremora.session import values


@query("panel_weekly", "SELECT asset, date, round(price, 2) AS price, volume FROM nweek", ["nweek"])
def panel_weekly(spark, sf):
    return D.nation_weeks(spark, sf).select("asset", "date", F.round("price", 2).alias("price"), "volume")


@query("scan_date_range", "SELECT l_suppkey AS asset, CAST(l_shipdate AS DATE) AS date, count(*)::BIGINT AS n_rows, "
       "round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' "
       "AND l_shipdate <= TIMESTAMP '1998-12-31' GROUP BY 1, 2")
def scan_date_range(spark, sf):
    rows = D.table(spark, sf, "lineitem").where(
        F.col("l_shipdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1998-12-31").cast("timestamp")))
    return P.to_panel(rows, "l_suppkey", F.col("l_shipdate").cast("date"), n_rows=F.count("*"),
                      price=F.round(F.sum("l_extendedprice"), 2))


@query("ffill_bounded", "SELECT asset, date, pos::INT AS pos, round(price, 2) AS price, filled FROM sfill", ["sfill"])
def ffill_bounded(spark, sf):
    return P.forward_fill(D.supplier_weeks(spark, sf), D.weeks(spark, sf)).withColumn("price", F.round("price", 2))


@query("log_returns", "SELECT asset, date, pos::INT AS pos, round(x, 6) + 0.0::DOUBLE AS x FROM sret", ["sret"])
def log_returns(spark, sf):
    return D.supplier_returns(spark, sf).withColumn("x", X.rnd("x"))


@query("simple_to_log", """
SELECT asset, date, round(ln(1 + ret), 6) + 0.0::DOUBLE AS x FROM (
  SELECT asset, date, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS ret FROM nweek)
WHERE ret IS NOT NULL""", ["nweek"])
def simple_to_log(spark, sf):
    w = Window.partitionBy("asset").orderBy("date")
    daily = D.nation_weeks(spark, sf).withColumn("ret", F.col("price") / F.lag("price").over(w) - 1)
    return P.simple_to_log(daily).select("asset", "date", X.rnd("x").alias("x"))


@query("split_adjust", """
SELECT permno, date, round(abs(prc) / cfacpr * first_value(cfacpr) OVER (PARTITION BY permno ORDER BY date), 4) AS price
FROM (SELECT asset AS permno, date, CASE WHEN volume % 2 = 0 THEN price ELSE -price END AS prc,
             CASE WHEN volume % 7 = 0 THEN 0 WHEN date < DATE '1998-06-01' THEN 2 ELSE 1 END::DOUBLE AS cfacpr FROM sweek)
WHERE prc IS NOT NULL AND cfacpr > 0""", ["sweek"])
def split_adjust(spark, sf):
    daily = D.supplier_weeks(spark, sf).select(
        F.col("asset").alias("permno"), "date",
        F.when(F.col("volume") % 2 == 0, F.col("price")).otherwise(-F.col("price")).alias("prc"),
        F.when(F.col("volume") % 7 == 0, 0.0).when(F.col("date") < F.lit("1998-06-01").cast("date"), 2.0)
        .otherwise(1.0).alias("cfacpr"))
    return P.split_adjusted(daily).select("permno", "date", F.round("price", 4).alias("price"))


@query("zero_run_detector", """
SELECT asset, count(*)::BIGINT AS n_obs, sum(z)::BIGINT AS n_zero, coalesce(max(run), 0)::BIGINT AS max_run,
       round(sum(z) / count(*), 6) AS zero_frac, sum(z) / count(*) > 0.2 OR coalesce(max(run), 0) > 20 AS contaminated
FROM (SELECT asset, z, CASE WHEN z = 1 THEN count(*) OVER (PARTITION BY asset, z, island) END AS run FROM (
  SELECT asset, pos, z, sum(1 - z) OVER (PARTITION BY asset ORDER BY pos) AS island
  FROM (SELECT asset, pos, CASE WHEN x = 0 THEN 1 ELSE 0 END AS z FROM sret)))
GROUP BY asset HAVING count(*) >= 20""", ["sret"])
def zero_run_detector(spark, sf):
    return P.zero_runs(D.supplier_returns(spark, sf)).select(
        "asset", "n_obs", "n_zero", "max_run", X.rnd("zero_frac").alias("zero_frac"), "contaminated")


@query("drop_contaminated", """
SELECT asset, count(*)::BIGINT AS n_obs FROM sret WHERE asset NOT IN (
  SELECT asset FROM sret GROUP BY asset HAVING count(*) >= 20 AND avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END) > 0.15)
GROUP BY 1""", ["sret"])
def drop_contaminated(spark, sf):
    r = D.stage(spark, sf, "supplier_returns", D.supplier_returns)
    bad = P.zero_runs(r, max_frac=0.15, max_run=10**6).where("contaminated")
    return P.coverage(P.drop_assets(r, bad), "x")


@query("coverage_filter", """
SELECT asset, date, round(price, 2) AS price FROM sweek WHERE asset IN (
  SELECT asset FROM sweek GROUP BY 1 HAVING count(*) >= (SELECT floor(count(*) * 0.8::DOUBLE) FROM cal))""", ["sweek", "cal"])
def coverage_filter(spark, sf):
    p = D.supplier_weeks(spark, sf)
    return P.coverage_filter(p, D.weeks(spark, sf), min_frac=0.8).select("asset", "date", F.round("price", 2).alias("price"))


@query("cutoff_mask", """
SELECT asset, count(*)::BIGINT AS n_obs, min(date) AS first_date FROM nweek LEFT JOIN (
  SELECT n_nationkey AS k, DATE '1997-01-06' AS cutoff FROM nation WHERE n_regionkey = 2) ON asset = k
WHERE cutoff IS NULL OR date >= cutoff GROUP BY 1""", ["nweek"])
def cutoff_mask(spark, sf):
    cut = D.table(spark, sf, "nation").where("n_regionkey = 2").select(
        F.col("n_nationkey").alias("asset"), F.lit("1997-01-06").cast("date").alias("cutoff"))
    return P.mask_before(D.nation_weeks(spark, sf), cut).groupBy("asset").agg(
        F.count("*").alias("n_obs"), F.min("date").alias("first_date"))


@query("adv_mean", "SELECT asset, round(avg(abs(price) * volume), 2) AS adv FROM sweek GROUP BY 1", ["sweek"])
def adv_mean(spark, sf):
    return P.dollar_volume(D.scan_supplier_weeks(spark, sf), F.col("price"), F.col("volume")).withColumn("adv", F.round("adv", 2))


@query("coverage_count", "SELECT asset, count(x)::BIGINT AS n_obs FROM sret GROUP BY 1", ["sret"])
def coverage_count(spark, sf):
    return P.coverage(D.supplier_returns(spark, sf), "x")


_ADV = "(SELECT asset, avg(price * volume) AS adv FROM sweek GROUP BY 1)"


def _adv(spark, sf):
    return P.dollar_volume(D.supplier_weeks(spark, sf), F.col("price"), F.col("volume"))


@query("select_top_coverage", "SELECT asset, count(x)::BIGINT AS n_obs FROM sret GROUP BY 1 ORDER BY n_obs DESC, asset LIMIT 50", ["sret"])
def select_top_coverage(spark, sf):
    return S.top_by(P.coverage(D.supplier_returns(spark, sf), "x"), 50, "n_obs")


@query("select_bottom_coverage", "SELECT asset, count(x)::BIGINT AS n_obs FROM sret GROUP BY 1 ORDER BY n_obs, asset LIMIT 50", ["sret"])
def select_bottom_coverage(spark, sf):
    return S.top_by(P.coverage(D.supplier_returns(spark, sf), "x"), 50, "n_obs", largest=False)


@query("select_top_adv", f"SELECT asset, round(adv, 2) AS adv FROM {_ADV} ORDER BY 2 DESC, 1 LIMIT 50", ["sweek"])
def select_top_adv(spark, sf):
    return S.top_by(_adv(spark, sf), 50, "adv").withColumn("adv", F.round("adv", 2))


@query("select_bottom_adv", f"SELECT asset, round(adv, 2) AS adv FROM {_ADV} ORDER BY 2, 1 LIMIT 50", ["sweek"])
def select_bottom_adv(spark, sf):
    return S.top_by(_adv(spark, sf), 50, "adv", largest=False).withColumn("adv", F.round("adv", 2))


@query("select_adv_quintile", f"""
SELECT asset, round(adv, 2) AS adv, rn::INT AS rank0 FROM (
  SELECT asset, adv, row_number() OVER (ORDER BY adv DESC, asset) - 1 AS rn, count(*) OVER () AS n FROM {_ADV})
WHERE rn >= 4 * greatest(1, n // 5) AND rn < least(n, 4 * greatest(1, n // 5) + 50)""", ["sweek"])
def select_adv_quintile(spark, sf):
    return S.adv_quintile(_adv(spark, sf), 50, 5).withColumn("adv", F.round("adv", 2))


@query("select_dispatch", f"""
SELECT 'coverage' AS kind, asset FROM (SELECT asset FROM sret GROUP BY 1 ORDER BY count(*) DESC, asset LIMIT 20)
UNION ALL SELECT 'adv', asset FROM (SELECT asset FROM {_ADV} ORDER BY adv DESC, asset LIMIT 20)
UNION ALL SELECT 'bottom_adv', asset FROM (SELECT asset FROM {_ADV} ORDER BY adv, asset LIMIT 20)
UNION ALL SELECT 'bottom_coverage', asset FROM (SELECT asset FROM sret GROUP BY 1 ORDER BY count(*), asset LIMIT 20)
UNION ALL SELECT 'decile' || q, asset FROM (
  SELECT asset, row_number() OVER (ORDER BY adv DESC, asset) - 1 AS rn, greatest(1, count(*) OVER () // 5) AS m, count(*) OVER () AS n FROM {_ADV})
  CROSS JOIN range(1, 6) t(q) WHERE rn >= (q - 1) * m AND rn < least(CASE WHEN q < 5 THEN q * m ELSE n END, (q - 1) * m + 20)""", ["sret", "sweek"])
def select_dispatch(spark, sf):
    r = D.stage(spark, sf, "supplier_returns", D.supplier_returns)
    adv = D.stage(spark, sf, "supplier_adv", _adv)
    out = None
    for kind in ("coverage", "adv", "bottom_adv", "bottom_coverage", *(f"decile{q}" for q in range(1, 6))):
        s = S.select_assets(r, adv, 20, kind).select(F.lit(kind).alias("kind"), "asset")
        out = s if out is None else out.unionByName(s)
    return out


@query("jaccard_selection", f"""
SELECT n, count(a.asset + b.asset)::BIGINT AS n_both, count(*)::BIGINT AS n_union,
  count(CASE WHEN b.asset IS NULL THEN 1 END)::BIGINT AS only_a, count(CASE WHEN a.asset IS NULL THEN 1 END)::BIGINT AS only_b,
  round(count(a.asset + b.asset) / count(*), 6) AS jaccard
FROM (SELECT n, asset FROM (SELECT asset, row_number() OVER (ORDER BY n_obs DESC, asset) AS rn FROM
        (SELECT asset, count(*) AS n_obs FROM sret GROUP BY 1)) JOIN (VALUES (10), (20), (40)) v(n) ON rn <= n) a
FULL JOIN (SELECT n, asset FROM (SELECT asset, row_number() OVER (ORDER BY adv DESC, asset) AS rn FROM {_ADV})
        JOIN (VALUES (10), (20), (40)) v(n) ON rn <= n) b USING (n, asset) GROUP BY n""", ["sret", "sweek"])
def jaccard_selection(spark, sf):
    r = D.stage(spark, sf, "supplier_returns", D.supplier_returns)
    adv = D.stage(spark, sf, "supplier_adv", _adv)
    sets = {}
    for kind in ("coverage", "adv"):
        for n in (10, 20, 40):
            s = S.select_assets(r, adv, n, kind).select(F.lit(n).alias("n"), "asset")
            sets[kind] = sets[kind].unionByName(s) if kind in sets else s
    return S.jaccard(sets["coverage"], sets["adv"], ["n"]).withColumn("jaccard", X.rnd("jaccard"))


@query("sector_band_join", "SELECT p_partkey, CASE " + " ".join(
    f"WHEN p_size * 190 BETWEEN {lo} AND {hi} THEN '{s}'" for lo, hi, s in C.SECTOR_BANDS)
    + " ELSE 'Unknown' END AS sector FROM part")
def sector_band_join(spark, sf):
    codes = D.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 190).alias("siccd"))
    bands = values(spark, C.SECTOR_BANDS, ["lo", "hi", "sector"], ["INT", "INT", "STRING"])
    return P.sector_of(codes, bands, "siccd").select("p_partkey", "sector")


@query("name_latest_collision", """
SELECT permno, ticker, CASE WHEN count(*) OVER (PARTITION BY ticker) > 1 THEN concat(ticker, '_', permno) ELSE ticker END AS asset
FROM (SELECT permno, ticker FROM (
  SELECT o_custkey AS permno, concat('T', (o_orderkey % 977)::VARCHAR) AS ticker,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)""")
def name_latest_collision(spark, sf):
    names = D.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("permno"), F.concat(F.lit("T"), (F.col("o_orderkey") % 977).cast("string")).alias("ticker"),
        F.lit(None).cast("string").alias("comnam"), F.lit(None).cast("int").alias("siccd"),
        F.col("o_orderdate").alias("nameenddt"), F.col("o_orderkey").alias("namedt"))
    return P.latest_names(names).select("permno", "ticker", "asset")


@query("delist_splice_asof", """
SELECT asset, date, round(CASE WHEN dlret IS NULL THEN ret ELSE greatest((1 + coalesce(ret, 0)) * (1 + dlret) - 1, -0.9999::DOUBLE) END, 6) + 0.0::DOUBLE AS ret,
       dlret IS NOT NULL AS spliced
FROM (SELECT asset, date, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS ret FROM sweek) r
FULL JOIN (SELECT asset, max(date) AS date, any_value(dlret) AS dlret FROM (
  SELECT s_suppkey AS asset, DATE '1996-01-01' + (s_suppkey * 7919 % 1900)::INT AS dlstdt, -((s_suppkey % 11) / 10.0::DOUBLE) AS dlret
  FROM supplier) JOIN cal ON date <= dlstdt WHERE asset IN (SELECT asset FROM sweek) GROUP BY asset) d USING (asset, date)
WHERE ret IS NOT NULL OR dlret IS NOT NULL""", ["sweek", "cal"])
def delist_splice_asof(spark, sf):
    w = Window.partitionBy("asset").orderBy("date")
    daily = D.supplier_weeks(spark, sf).select("asset", "date", (F.col("price") / F.lag("price").over(w) - 1).alias("ret"))
    gone = D.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("asset"),
        F.date_add(F.lit("1996-01-01").cast("date"), (F.col("s_suppkey") * 7919 % 1900).cast("int")).alias("dlstdt"),
        (-((F.col("s_suppkey") % 11) / F.lit(10.0))).alias("dlret"))
    return P.splice_delisting(daily, gone, D.weeks(spark, sf)).where("ret IS NOT NULL").withColumn("ret", X.rnd("ret"))


@query("series_splice", """
SELECT date, round(v, 7) AS value, source FROM (
  SELECT date, close AS v, 'new' AS source FROM bench WHERE date >= DATE '1998-06-01'
  UNION ALL SELECT date, price, 'old' FROM (SELECT date, sum(price) AS price FROM nweek GROUP BY 1) WHERE date < DATE '1998-06-01')""",
       ["bench", "nweek"])
def series_splice(spark, sf):
    old = D.nation_weeks(spark, sf).groupBy("date").agg(F.sum("price").alias("value"))
    new = D.benchmark_daily(spark, sf).withColumnRenamed("close", "value")
    return P.splice_series(old, new, "1998-06-01").withColumn("value", F.round("value", 7))


@query("series_extend", """
SELECT asset, date, round(price, 2) AS price, segment FROM (
  SELECT asset, date, price, 'base' AS segment FROM nweek WHERE date < DATE '1999-01-01' AND asset % 3 <> 0
  UNION ALL SELECT n.asset, n.date, n.price, 'extension' FROM nweek n LEFT JOIN
    (SELECT asset, max(date) AS last FROM nweek WHERE date < DATE '1999-01-01' AND asset % 3 <> 0 GROUP BY 1) b ON b.asset = n.asset
  WHERE last IS NULL OR n.date > last)""", ["nweek"])
def series_extend(spark, sf):
    p = D.nation_weeks(spark, sf).select("asset", "date", "price")
    base = p.where((F.col("date") < F.lit("1999-01-01").cast("date")) & (F.col("asset") % 3 != 0))
    return P.extend_later(base, p).withColumn("price", F.round("price", 2))


@query("union_keep_first", """
SELECT asset, origin FROM (SELECT s_suppkey AS asset, 'info' AS origin FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT DISTINCT asset, 'panel' FROM sweek WHERE asset NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))""", ["sweek"])
def union_keep_first(spark, sf):
    info = D.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("asset"), F.lit("info").alias("origin"))
    return P.union_keep_first(info, D.supplier_weeks(spark, sf).select("asset").distinct().withColumn("origin", F.lit("panel")))


@query("panel_alignment", """
SELECT asset, n_price::BIGINT AS n_price, n_ret::BIGINT AS n_ret FROM (SELECT asset, count(*) AS n_price FROM sweek GROUP BY 1)
JOIN (SELECT asset, count(*) AS n_ret FROM sret GROUP BY 1) USING (asset)""", ["sweek", "sret"])
def panel_alignment(spark, sf):
    return D.supplier_weeks(spark, sf).groupBy("asset").agg(F.count("*").alias("n_price")).join(
        D.supplier_returns(spark, sf).groupBy("asset").agg(F.count("*").alias("n_ret")), "asset")


@query("ticker_set_difference", """
SELECT asset, side FROM (SELECT s_suppkey AS asset, 'missing_in_panel' AS side FROM supplier WHERE s_suppkey NOT IN (SELECT asset FROM sweek)
 UNION ALL SELECT DISTINCT asset, 'missing_in_info' FROM sweek WHERE asset NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))""", ["sweek"])
def ticker_set_difference(spark, sf):
    info = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("asset"), "s_acctbal")
    used = D.supplier_weeks(spark, sf).select("asset").distinct()
    return (
        info.select("asset").exceptAll(used).withColumn("side", F.lit("missing_in_panel"))
        .unionByName(used.exceptAll(info.where("s_acctbal > 0").select("asset")).withColumn("side", F.lit("missing_in_info")))
    )


@query("static_z", "SELECT asset, date, round((100 * x - avg(100 * x) OVER w) / stddev_samp(100 * x) OVER w, 6) + 0.0::DOUBLE AS z "
       "FROM sret WINDOW w AS (PARTITION BY asset) QUALIFY count(*) OVER w >= 30", ["sret"])
def static_z(spark, sf):
    return P.static_z(D.supplier_returns(spark, sf)).select("asset", "date", X.rnd("z").alias("z"))


@query("snapshot_range_join", "SELECT snapshot, regime, count(*)::BIGINT AS n_cells, count(DISTINCT asset)::BIGINT AS n_assets, "
       "min(date) AS first_date, max(date) AS last_date FROM sret JOIN snap ON date BETWEEN d_from AND d_to GROUP BY 1, 2", ["sret", "snap"])
def snapshot_range_join(spark, sf):
    snaps = D.snapshots(spark)
    return (
        P.in_windows(D.supplier_returns(spark, sf), snaps).groupBy("snapshot")
        .agg(F.count("*").alias("n_cells"), F.countDistinct("asset").alias("n_assets"),
             F.min("date").alias("first_date"), F.max("date").alias("last_date"))
        .join(snaps.select("snapshot", "regime"), "snapshot")
    )


@query("alive_complete_case", "SELECT snapshot, p::BIGINT AS p, n_days::BIGINT AS n_days FROM pdim", ["pdim"])
def alive_complete_case(spark, sf):
    cc = P.complete_cases(D.nation_returns(spark, sf), D.snapshots(spark), D.weeks(spark, sf))
    return cc.groupBy("snapshot").agg(F.countDistinct("asset").alias("p"), F.countDistinct("date").alias("n_days"))


@query("alive_counts", "SELECT snapshot, count(*)::BIGINT AS n_alive, min(n_obs)::BIGINT AS min_obs, max(n_rows)::BIGINT AS n_rows FROM walive GROUP BY 1", ["walive"])
def alive_counts(spark, sf):
    return P.alive(D.nation_returns(spark, sf), D.snapshots(spark), D.weeks(spark, sf)).groupBy("snapshot").agg(
        F.count("*").alias("n_alive"), F.min("n_obs").alias("min_obs"), F.max("n_rows").alias("n_rows"))


@query("key_valid_asof", """
SELECT o_custkey AS permno, o_orderkey AS name_id FROM orders
WHERE CAST(o_orderdate AS DATE) <= DATE '1998-06-30' AND CAST(o_orderdate AS DATE) + 180 >= DATE '1998-06-30'""")
def key_valid_asof(spark, sf):
    from tremora.sources.daily import valid_at

    d = F.col("o_orderdate").cast("date")
    names = D.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("permno"), F.col("o_orderkey").alias("name_id"), d.alias("namedt"), F.date_add(d, 180).alias("nameenddt"))
    return valid_at(names, "1998-06-30").select("permno", "name_id")


@query("semi_join_members", """
SELECT l_suppkey AS permno, count(*)::BIGINT AS n_rows, round(sum(l_quantity), 2) AS vol FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1""")
def semi_join_members(spark, sf):
    from tremora.sources.daily import for_members

    facts = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("permno"), "l_quantity")
    members = D.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("permno"))
    return for_members(facts, members).groupBy("permno").agg(F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("vol"))


@query("pivot_wide", "SELECT date, " + ", ".join(f"round(sum(price) FILTER (WHERE asset = {k}), 2) AS n{k}" for k in range(25)) + " FROM nweek GROUP BY 1", ["nweek"])
def pivot_wide(spark, sf):
    """Wide form of the named assets, for interchange only; operators stay long."""
    p = D.nation_weeks(spark, sf).withColumn("c", F.concat(F.lit("n"), F.col("asset").cast("string")))
    wide = p.groupBy("date").pivot("c", [f"n{k}" for k in range(25)]).agg(F.first("price"))
    return wide.select("date", *[F.round(f"n{k}", 2).alias(f"n{k}") for k in range(25)])


@query("augment_panel", """
SELECT asset, count(*)::BIGINT AS n_obs, min(date) AS first_date, segment FROM (
  SELECT asset::VARCHAR AS asset, date, 'panel' AS segment FROM nweek
  UNION ALL SELECT 'S' || s.asset, s.date, 'added' FROM sweek s WHERE date IN (SELECT date FROM nweek)) GROUP BY 1, 4""", ["nweek", "sweek"])
def augment_panel(spark, sf):
    base = D.nation_weeks(spark, sf).select(F.col("asset").cast("string").alias("asset"), "date", "price")
    extra = D.supplier_weeks(spark, sf).select(F.concat(F.lit("S"), F.col("asset").cast("string")).alias("asset"), "date", "price")
    both, _ = P.augment(base, extra)
    return both.groupBy("asset", "segment").agg(F.count("*").alias("n_obs"), F.min("date").alias("first_date"))


@query("mask_by_source", """
SELECT l_suppkey AS asset, count(CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity END)::BIGINT AS n_kept, count(*)::BIGINT AS n_rows FROM lineitem GROUP BY 1""")
def mask_by_source(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("asset"), "l_returnflag", "l_quantity")
    return P.mask_by_source(rows, "l_returnflag", ["A", "R"], "l_quantity").groupBy("asset").agg(
        F.count("l_quantity").alias("n_kept"), F.count("*").alias("n_rows"))


@query("membership_overlap", """
SELECT permno, count(*)::BIGINT AS n_spells, min(d0) AS first_start FROM (
  SELECT o_custkey AS permno, CAST(o_orderdate AS DATE) AS d0, CAST(o_orderdate AS DATE) + 90 AS d1 FROM orders)
WHERE d0 <= DATE '1999-12-31' AND d1 >= DATE '1999-01-01' GROUP BY 1""")
def membership_overlap(spark, sf):
    from tremora.sources.daily import overlapping

    d = F.col("o_orderdate").cast("date")
    spells = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("permno"), d.alias("start"), F.date_add(d, 90).alias("ending"))
    return overlapping(spells, "1999-01-01", "1999-12-31").groupBy("permno").agg(
        F.count("*").alias("n_spells"), F.min("start").alias("first_start"))


@query("list_cell_explode", """
SELECT code, count(*)::BIGINT AS n_parts FROM (SELECT DISTINCT p_partkey, trim(unnest(string_split(replace(p_name || ' ' || p_type, ' ', '|'), '|'))) AS code FROM part)
WHERE code <> '' GROUP BY 1""")
def list_cell_explode(spark, sf):
    from tremora.sources.daily import explode_codes

    cells = D.table(spark, sf, "part").select("p_partkey", F.replace(F.concat_ws(" ", "p_name", "p_type"), F.lit(" "), F.lit("|")).alias("cell"))
    return explode_codes(cells, "cell", "p_partkey").groupBy("code").agg(F.count("*").alias("n_parts"))


@query("html_cells", """
SELECT page_id, len(links)::BIGINT AS n_links, len(list_distinct(links))::BIGINT AS n_distinct,
       regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g') AS title
FROM (SELECT page_id, html, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages)""")
def html_cells(spark, sf):
    from tremora.sources.html import link_table

    return link_table(D.table(spark, sf, "pages"))


@query("numeric_coercion", """
SELECT event_id, TRY_CAST(replace(regexp_extract(props, '"k": ([^}]*)', 1), ',', '') AS DOUBLE) AS k,
       TRY_CAST(event_type AS DOUBLE) AS bad FROM events""")
def numeric_coercion(spark, sf):
    return D.table(spark, sf, "events").select(
        "event_id", X.decimal_number(F.regexp_extract("props", r'"k": ([^}]*)', 1)).alias("k"),
        X.decimal_number("event_type").alias("bad"))


@query("label_format", """
SELECT s_suppkey, upper(replace(s_name, '#', '-')) AS label, printf('%.3f', s_acctbal) AS shown,
       round_even(s_acctbal / 100, 0) AS half_even FROM supplier""")
def label_format(spark, sf):
    return D.table(spark, sf, "supplier").select(
        "s_suppkey", F.upper(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("label"),
        X.fixed("s_acctbal", 3).alias("shown"), F.bround(F.col("s_acctbal") / 100, 0).alias("half_even"))


@query("sector_share", """
SELECT sector, n::BIGINT AS n, round(100.0::DOUBLE * n / sum(n) OVER () - 100.0::DOUBLE * b / sum(b) OVER (), 6) + 0.0::DOUBLE AS diff_pp FROM (
  SELECT r_name AS sector, count(DISTINCT s_suppkey) AS n, count(DISTINCT n_nationkey) AS b
  FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)""")
def sector_share(spark, sf):
    panel = D.supplier_sectors(spark, sf).groupBy("sector").agg(F.count("*").alias("n"))
    bench = D.sectors(spark, sf).groupBy("sector").agg(F.count("*").alias("b"))
    both = bench.join(panel, "sector", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    every = Window.partitionBy(F.lit(1))
    diff = 100.0 * F.col("n") / F.sum("n").over(every) - 100.0 * F.col("b") / F.sum("b").over(every)
    return both.select("sector", "n", X.rnd(diff).alias("diff_pp"))


@query("nearest_asof_benchmark", """
SELECT d AS date, b.date AS bench_date, round(b.close, 7) AS close FROM (
  SELECT (date + 1)::DATE AS d FROM cal) c JOIN LATERAL (
  SELECT date, close FROM bench ORDER BY abs(date_diff('day', date, d)), date DESC LIMIT 1) b ON true""", ["cal", "bench"])
def nearest_asof_benchmark(spark, sf):
    left = D.weeks(spark, sf).select(F.date_add("date", 1).alias("date"))
    out = asof.nearest(left, D.benchmark_daily(spark, sf))
    return out.select("date", F.col("m.date").alias("bench_date"), F.round("m.close", 7).alias("close"))


@query("backward_asof_day", """
SELECT a.date, max(c.date) AS trade_date FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) a
LEFT JOIN cal c ON c.date <= a.date GROUP BY 1""", ["cal"])
def backward_asof_day(spark, sf):
    days = D.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return P.trading_day_on_or_before(days.withColumnRenamed("date", "d"), D.weeks(spark, sf), "d").select(F.col("d").alias("date"), "trade_date")
