"""Reference SQL building blocks. Written densely and naively, to be independent of the Spark plans."""

from tremora.plans.registry import cte
from tremora.plans.standin import window_rows

cte("cal", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM "
           "(SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS date FROM lineitem)")
cte("sweek", "SELECT l_suppkey AS asset, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, "
             "sum(l_extendedprice) AS price, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2")
cte("nweek", "SELECT s_nationkey AS asset, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, "
             "sum(l_extendedprice) AS price, sum(l_quantity) AS volume "
             "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")

_FILL = """
SELECT asset, date, pos, price, raw IS NULL AS filled FROM (
  SELECT a.asset, c.date, c.pos, k.price AS raw,
         last_value(k.price IGNORE NULLS) OVER (PARTITION BY a.asset ORDER BY c.pos
             ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS price
  FROM (SELECT DISTINCT asset FROM {t}) a CROSS JOIN cal c
  LEFT JOIN {t} k ON k.asset = a.asset AND k.date = c.date)
WHERE price IS NOT NULL"""
_RET = """
SELECT asset, date, pos, x FROM (
  SELECT asset, date, pos, ln(price) - ln(CASE WHEN lag(pos) OVER w = pos - 1 THEN lag(price) OVER w END) AS x
  FROM {t} WINDOW w AS (PARTITION BY asset ORDER BY pos)) WHERE x IS NOT NULL"""
for pre in ("n", "s"):
    cte(f"{pre}fill", _FILL.format(t=f"{pre}week"), ["cal", f"{pre}week"])
    cte(f"{pre}ret", _RET.format(t=f"{pre}fill"), [f"{pre}fill"])

cte("snap", "SELECT * FROM (VALUES " + ", ".join(
    f"('{l}', DATE '{s}', DATE '{e}', '{r}')" for l, s, e, r in window_rows())
    + ") AS t(snapshot, d_from, d_to, regime)")
cte("sector", "SELECT n_nationkey AS asset, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey")
cte("wrows", "SELECT snapshot, count(*) AS n_rows FROM snap JOIN cal ON date BETWEEN d_from AND d_to GROUP BY 1", ["snap", "cal"])
cte("wret", "SELECT snapshot, asset, date, pos, x FROM nret JOIN snap ON date BETWEEN d_from AND d_to", ["nret", "snap"])
cte("walive", "SELECT snapshot, asset, n_obs, n_rows FROM (SELECT snapshot, asset, count(x) AS n_obs FROM wret GROUP BY 1, 2) "
              "JOIN wrows USING (snapshot) WHERE n_obs >= greatest(30, floor(n_rows * 0.8::DOUBLE))", ["wret", "wrows"])
cte("wcc", """
SELECT snapshot, date, asset, least(10.0::DOUBLE, greatest(-10.0::DOUBLE, x)) AS x FROM (
  SELECT r.*, stddev_samp(x) OVER (PARTITION BY r.snapshot, r.asset) AS sd FROM (
    SELECT *, count(*) OVER (PARTITION BY snapshot) / k AS n_days FROM (
      SELECT wret.*, count(*) OVER (PARTITION BY wret.snapshot, wret.date) AS k, p
      FROM wret JOIN walive USING (snapshot, asset)
      JOIN (SELECT snapshot, count(*) AS p FROM walive GROUP BY 1) USING (snapshot))
    WHERE k = p AND p >= 10) r WHERE n_days >= 30) WHERE sd > 1e-8""", ["wret", "walive"])
cte("pair", "SELECT a.snapshot, a.asset AS i, b.asset AS j, corr(a.x, b.x) AS r FROM wcc a JOIN wcc b "
            "ON a.snapshot = b.snapshot AND a.date = b.date AND a.asset < b.asset GROUP BY 1, 2, 3", ["wcc"])
cte("pdim", "SELECT snapshot, count(DISTINCT asset) AS p, count(DISTINCT date) AS n_days FROM wcc GROUP BY 1", ["wcc"])
cte("bench", "SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1")
