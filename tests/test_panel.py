import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tremora.operators import asof
from tremora.operators import panel as P
from tremora.operators import quality as Q
from tremora.operators import selection as S
from tremora.sources import daily as D
from tremora.sources.html import quotes
from tremora.sources.store import StageStore, latex_macros, read_macros, require_windows, write_table

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def prices(frame, cells):
    return frame([(a, day(i), float(p)) for a, i, p in cells], "asset string, date date, price double")


def cal(frame, n):
    return P.calendar(frame([(day(i),) for i in range(n)], "date date"))


def test_forward_fill_stops_after_five(frame):
    p = prices(frame, [("A", 0, 10), ("A", 8, 12), ("B", 3, 5)])
    got = {(r.asset, r.pos): (r.price, r.filled) for r in P.forward_fill(p, cal(frame, 10)).collect()}
    assert [got.get(("A", i), (None,))[0] for i in range(10)] == [10, 10, 10, 10, 10, 10, None, None, 12, 12]
    assert ("B", 2) not in got and got[("B", 8)] == (5.0, True) and ("B", 9) not in got


def test_log_diff_needs_adjacent_rows(frame):
    p = prices(frame, [("A", 0, 1), ("A", 1, math.e), ("A", 9, 5), ("A", 10, 5)])
    rows = sorted((r.pos, round(r.x, 9)) for r in P.log_diff(P.forward_fill(p, cal(frame, 11))).collect())
    assert rows == [(1, 1.0), (2, 0.0), (3, 0.0), (4, 0.0), (5, 0.0), (6, 0.0), (10, 0.0)]


def test_coverage_filter_and_late_start(frame):
    p = prices(frame, [("A", i, 1) for i in range(50, 200)] + [("B", i, 1) for i in range(9)])
    kept = P.coverage(P.coverage_filter(p, cal(frame, 200))).collect()
    assert [(r.asset, r.n_obs) for r in kept] == [("A", 150)]


def test_zero_runs(frame):
    x = [("A", i, 0.0 if i < 21 else 0.1) for i in range(200)] + [("B", i, 0.0 if i % 4 == 0 else 0.1) for i in range(40)] + [("C", i, 0.0) for i in range(5)]
    r = {t.asset: t for t in P.zero_runs(frame(x, "asset string, pos int, x double")).collect()}
    assert r["A"].max_run == 21 and r["A"].contaminated
    assert r["B"].max_run == 1 and r["B"].zero_frac == 0.25 and r["B"].contaminated
    assert "C" not in r


def test_split_adjustment_skips_invalid_factors(frame):
    d = frame([(1, day(0), -10.0, 0.0), (1, day(1), -10.0, 2.0), (1, day(2), 6.0, 1.0), (1, day(3), None, 1.0)],
              "permno long, date date, prc double, cfacpr double")
    assert [(r.date, r.price) for r in P.split_adjusted(d).orderBy("date").collect()] == [(day(1), 10.0), (day(2), 12.0)]


def test_names_latest_collision_override_and_unknown(frame):
    n = frame([(1, "X", "c", day(0), day(5), 100), (1, "Y", "c", day(6), day(9), 100), (2, "Y", "c", day(0), day(9), 100),
               (3, None, "c", day(0), day(9), 100), (4, "Z", "c", day(0), day(9), 100)],
              "permno long, ticker string, comnam string, namedt date, nameenddt date, siccd int")
    over = frame([(4, "LEH")], "permno long, ticker string")
    assert {r.permno: r.asset for r in P.latest_names(n, over).collect()} == {1: "Y_1", 2: "Y_2", 3: "UNK", 4: "LEH"}


def test_sector_bands(frame):
    bands = frame([(10, 19, "a"), (30, 39, "b")], "lo int, hi int, sector string")
    codes = frame([(10,), (19,), (20,), (39,), (None,)], "siccd int")
    got = {r.siccd: r.sector for r in P.sector_of(codes, bands, "siccd").collect()}
    assert got == {10: "a", 19: "a", 20: "Unknown", 39: "b", None: "Unknown"}


def test_delisting_splice(frame):
    r = frame([("A", day(0), 0.1), ("A", day(2), 0.1), ("B", day(0), 0.2)], "asset string, date date, ret double")
    gone = frame([("A", day(1), "-0.5"), ("B", day(9), "-1.0"), ("C", day(0), "-1.0"), ("B", day(0), "n/a"), ("A", dt.date(2019, 1, 1), "-0.3")],
                 "asset string, dlstdt date, dlret string")
    c = P.calendar(r)
    got = {(x.asset, x.date): round(x.ret, 9) for x in P.splice_delisting(r, gone, c).collect()}
    assert got == {("A", day(0)): -0.45, ("A", day(2)): 0.1, ("B", day(0)): 0.2, ("B", day(2)): -0.9999}


def test_asof_strict_inclusive_and_nearest(frame):
    left = frame([(day(5),), (day(7),), (day(20),)], "date date")
    right = frame([(day(1), 1), (day(5), 5), (day(9), 9)], "date date, v int")
    assert [r.m.v for r in asof.backward(left, right, strict=True).orderBy("date").collect()] == [1, 5, 9]
    assert [r.m.v for r in asof.backward(left, right).orderBy("date").collect()] == [5, 5, 9]
    assert [r.m and r.m.v for r in asof.backward(left, right, strict=True, tolerance_days=3).orderBy("date").collect()] == [None, 5, None]
    assert [r.m.v for r in asof.nearest(left, right).orderBy("date").collect()] == [5, 9, 9]


def test_splice_extend_union(frame):
    a = frame([(day(i), float(i)) for i in range(5)], "date date, value double")
    b = frame([(day(i), 10.0 + i) for i in range(5)], "date date, value double")
    assert [r.value for r in P.splice_series(a, b, str(day(2))).orderBy("date").collect()] == [0, 1, 12, 13, 14]
    x = prices(frame, [("A", 0, 1), ("A", 1, 1)])
    y = prices(frame, [("A", 1, 9), ("A", 2, 9), ("B", 0, 9)])
    assert sorted((r.asset, r.date, r.price) for r in P.extend_later(x, y).collect()) == [("A", day(0), 1), ("A", day(1), 1), ("A", day(2), 9), ("B", day(0), 9)]
    assert P.union_keep_first(x, y).count() == 3


def test_adv_skips_missing_pairs(frame):
    p = frame([("A", day(0), -2.0, 3.0), ("A", day(1), None, 5.0), ("A", day(2), 4.0, None)], "asset string, date date, price double, volume double")
    assert P.dollar_volume(p, F.col("price"), F.col("volume")).head().adv == 6.0


def test_windows_alive_and_complete(frame):
    rows = [(f"a{k}", day(i), i, float((i * 7 + k * 3) % 11)) for k in range(10) for i in range(60) if not (k == 0 and i == 5)]
    rows += [("late", day(i), i, 1.0 * i) for i in range(40, 60)] + [("flat", day(i), i, 1.0) for i in range(60)]
    r = frame(rows, "asset string, date date, pos int, x double")
    snaps = frame([("S", day(0), day(59), "crisis"), ("tiny", day(0), day(5), "crisis")], "snapshot string, start date, end date, regime string")
    cc = P.complete_cases(r, snaps, cal(frame, 60))
    got = cc.groupBy("snapshot").agg(F.countDistinct("asset").alias("p"), F.countDistinct("date").alias("n")).collect()
    assert [(g.snapshot, g.p, g.n) for g in got] == [("S", 10, 59)]
    assert cc.agg(F.max("x")).head()[0] == 10.0
    bal = P.balanced_assets(r, snaps.where("snapshot = 'S'"), cal(frame, 60))
    assert bal.select("asset").distinct().count() == 10


def test_selection_rules(frame):
    adv = frame([(f"a{i:02d}", float(i)) for i in range(13)], "asset string, adv double")
    five = [sorted(r.rank0 for r in S.adv_quintile(adv, 100, q).collect()) for q in range(1, 6)]
    assert five == [[0, 1], [2, 3], [4, 5], [6, 7], [8, 9, 10, 11, 12]]
    assert S.adv_quintile(adv, 1, 5).count() == 1
    with pytest.raises(ValueError):
        S.select_assets(frame([("a", 1.0)], "asset string, x double"), adv, 3, "nope")
    with pytest.raises(ValueError):
        S.adv_quintile(adv, 1, 6)


def test_stratified_quota_adds_up(frame):
    a = frame([(f"x{i}", "big") for i in range(30)] + [(f"y{i}", "mid") for i in range(9)] + [("z", "one")], "asset string, sector string")
    got = S.stratified_subset(a, 10, 1).groupBy("sector").count().collect()
    counts = {r["sector"]: r["count"] for r in got}
    assert sum(counts.values()) == 10 and counts["one"] == 1
    assert sorted(r.asset for r in S.stratified_subset(a, 10, 1).collect()) == sorted(r.asset for r in S.stratified_subset(a.repartition(7), 10, 1).collect())


def test_mle_subset_falls_back_to_coverage(frame):
    c = cal(frame, 100)
    r = frame([(a, day(i), 1.0) for a, n in (("A", 60), ("B", 80)) for i in range(n)], "asset string, date date, x double")
    assert [x.asset for x in S.mle_subset(r, c, 1).collect()] == ["B"]
    full = r.union(frame([("Z", day(i), 1.0) for i in range(100)], "asset string, date date, x double"))
    assert [x.asset for x in S.mle_subset(full, c, 5).collect()] == ["Z"]


def test_sql_extracts(frame):
    n = frame([(1, day(0), day(5)), (2, day(3), day(9))], "permno long, namedt date, nameenddt date")
    assert [r.permno for r in D.valid_at(n, str(day(7))).collect()] == [2]
    m = frame([(1, day(0), day(5)), (2, day(6), day(9))], "permno long, start date, ending date")
    assert [r.permno for r in D.overlapping(m, str(day(5)), str(day(5))).collect()] == [1]
    cells = frame([(1, "A|B, C"), (1, "B")], "k int, cell string")
    assert sorted(r.code for r in D.explode_codes(cells, "cell", "k").collect()) == ["A", "B", "C"]


def test_quote_pages(frame):
    row = lambda *c: "<tr>" + "".join(f"<td> <b>{x}</b></td>" for x in c) + "</tr>"
    html = ("<table>" + row("Date", "Open", "High", "Low", "Close", "Volume", "Adj") + row("15-Sep-08", "1,017.5", "18", "16", "17", "12,345,678", "17.1")
            + row("16-Sep-08", "$ 0.35 Dividend") + row("x-Sep-08", "1", "1", "1", "1", "1", "1") + row("17-Sep-08", "1", "bad", "1", "1", "1", "1") + "</table>")
    got = quotes(frame([(1, html)], "page_id int, html string")).collect()
    assert [(r.date, r.open, r.volume, r.adj_close) for r in got] == [(dt.date(2008, 9, 15), 1017.5, 12345678, 17.1)]


def test_stage_store_round_trip(spark, frame, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return frame([("S", 1)], "snapshot string, v int")

    store = StageStore(spark, str(tmp_path))
    for params in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert store.get("t", params, build).count() == 1
    assert len(calls) == 2
    (tmp_path / "t").joinpath(store._path("t", {"a": 1}).split("/")[-1], "note").joinpath("part-junk.txt")
    StageStore(spark, str(tmp_path), force=True).get("t", {"a": 1}, build)
    assert len(calls) == 3
    with pytest.raises(ValueError):
        require_windows(build(), frame([("S",), ("T",)], "snapshot string"))


def test_sinks_and_macros(spark, frame, tmp_path):
    t = frame([("nsi max", 0.5), ("p1", 0.25)], "name string, value double")
    for fmt in ("csv", "tsv", "json", "parquet"):
        write_table(t, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tsv")).count() == 2
    (tmp_path / "m.tex").write_text(latex_macros(t))
    assert {r.name: r.value for r in read_macros(spark, str(tmp_path / "m.tex")).collect()} == {"nsimax": "0.5", "p": "0.25"}
    with pytest.raises(ValueError):
        write_table(t, str(tmp_path / "x"), "xml")


def test_quality_rows_and_report(frame):
    pairs = frame([("S", 0, 1, 0.5), ("S", 0, 2, 1.5), ("T", 0, 1, 0.1)], "snapshot string, i int, j int, v double")
    c = Q.correlations(pairs)
    bad = c.where("NOT passed").collect()
    assert [(r.snapshot, r.name) for r in bad] == [("S", "corr_bounded")]
    text = Q.markdown(c)
    assert "5 of 6" in text and "corr_bounded" in text
    a, b = prices(frame, [("A", 0, 10), ("B", 0, 10)]), prices(frame, [("A", 0, 10), ("B", 0, 20)])
    assert [r.snapshot for r in Q.scale_guard(a, b).where("NOT passed").collect()] == ["B"]
    assert not Q.failure_share(a, a.where("asset = 'A'"), 0.2, "missing").head().passed
    assert Q.row_band(a, 1, 5, "rows").head().passed


def test_quotas_fill_room_and_trim_above_one(frame):
    sizes = lambda *n: frame([(f"s{i}", v) for i, v in enumerate(n)], "sector string, size long")
    quota = lambda k, *n: [r.quota for r in S.sector_quotas(sizes(*n), k).orderBy("sector").collect()]
    assert sum(quota(18, 1, 7, 7, 7)) == 18 and quota(18, 1, 7, 7, 7)[0] == 1
    assert quota(4, 100, 1, 1, 1) == [1, 1, 1, 1]
    assert quota(6, 100, 1, 1, 1) == [3, 1, 1, 1]
    assert quota(10, 5, 3, 2) == [5, 3, 2]
    assert sum(quota(11, 50, 3, 2, 1, 1, 1)) == 11


def test_nation_panel_is_staged_once_and_stages_no_supplier_weeks(spark):
    from tremora.plans import standin

    sf = "/root/testdata/./sf0.001"  # a path of its own, so no other test has staged it
    got = {(r.asset, r.date): (r.price, r.volume) for r in standin.nation_weeks(spark, sf).collect()}
    cal = standin.weeks(spark, sf)
    standin.benchmark_daily(spark, sf)
    names = {k[2] for k in standin._STAGES if k[1] == sf}
    assert names == {"nation_weeks", "weeks", "benchmark"}
    assert standin.nation_weeks(spark, sf) is standin.nation_weeks(spark, sf) and standin.weeks(spark, sf) is cal
    s = standin.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("asset"), "s_nationkey")
    want = standin.scan_supplier_weeks(spark, sf).join(s, "asset").groupBy("s_nationkey", "date").agg(F.sum("price").alias("p"), F.sum("volume").alias("v")).collect()
    assert len(want) == len(got) and all(abs(got[r.s_nationkey, r.date][0] / r.p - 1) < 1e-12 and got[r.s_nationkey, r.date][1] == r.v for r in want)
    assert cal.collect() == P.calendar(standin.scan_supplier_weeks(spark, sf)).collect()
