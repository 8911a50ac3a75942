import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tremora.operators import panel as P
from tremora.plans.pipeline import Settings, StressPipeline, build_panel
from tremora.session import global_rank
from tremora.sources.store import StageStore
from tremora.streaming import ingest

D0 = dt.date(2015, 1, 1)


def write_daily(frame, path, n_days=40, n_assets=4):
    rng = np.random.default_rng(0)
    rows = [(k, D0 + dt.timedelta(days=i), float(rng.normal(0, 0.01)), float(10 + k), 100.0, 1.0) for k in range(1, n_assets + 1) for i in range(n_days)]
    df = frame(rows, "permno long, date date, ret double, prc double, vol double, cfacpr double")
    for c in ("retx", "openprc", "askhi", "bidlo", "shrout", "cfacshr"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    df.write.parquet(path)
    return df


def test_panel_from_raw_files(spark, frame, tmp_path):
    write_daily(frame, str(tmp_path / "daily"))
    (tmp_path / "names.csv").write_text("permno,ticker,comnam,namedt,nameenddt,siccd\n1,AA,a,2010-01-01,2020-01-01,1200\n2,BB,b,2010-01-01,2020-01-01,6020\n"
                                        "3,BB,c,2010-01-01,2020-01-01,9999\n4,DD,d,2010-01-01,2020-01-01,\n")
    (tmp_path / "gone.csv").write_text("permno,dlstdt,dlstcd,dlret,dlretx\n4,2015-03-01,574,-1.0,\n")
    info, prices, returns, cal = build_panel(spark, str(tmp_path / "daily"), str(tmp_path / "names.csv"), str(tmp_path / "gone.csv"), "2015-01-01", "2015-12-31")
    assert {r.asset: r.sector for r in info.collect()} == {"AA": "Materials", "BB_2": "Financials", "BB_3": "Unknown", "DD": "Unknown"}
    assert returns.count() == 160 and prices.count() == 160 and cal.count() == 40
    last = returns.where("asset = 'DD'").orderBy(F.desc("date")).head()
    assert abs(last.x - np.log(1 - 0.9999)) < 1e-9
    member = frame([(1, D0, D0 + dt.timedelta(days=9))], "permno long, start date, ending date")
    _, _, r2, _ = build_panel(spark, str(tmp_path / "daily"), str(tmp_path / "names.csv"), str(tmp_path / "gone.csv"), "2015-01-01", "2015-12-31", member)
    assert r2.count() == 10


def test_pipeline_end_to_end(spark, frame, tmp_path):
    rng = np.random.default_rng(1)
    n, p = 420, 12
    f = rng.normal(size=n)
    x = 0.01 * (0.6 * f[:, None] + rng.normal(size=(n, p)))
    for j in range(1, p):
        x[1:, j] += 0.35 * x[:-1, j - 1]
    days = [D0 + dt.timedelta(days=i) for i in range(n)]
    r = frame([(f"T{j:02d}", days[i], i, float(x[i, j])) for j in range(p) for i in range(n)], "asset string, date date, pos int, x double")
    snaps = frame([("A", days[0], days[149], "baseline"), ("B", days[130], days[279], "crisis"), ("C", days[260], days[419], "stress")],
                  "snapshot string, start date, end date, regime string")
    sec = frame([(f"T{j:02d}", f"s{j % 3}") for j in range(p)], "asset string, sector string")
    adv = frame([(f"T{j:02d}", float(1000 * (j + 1))) for j in range(p)], "asset string, adv double")
    s = Settings(n_er_sims=10, n_rewires=5, n_er_matched=2, lambdas=[0.4, 0.2, 0.1, 0.05])
    store = StageStore(spark, str(tmp_path / "stages"))
    pipe = StressPipeline(spark, r, P.calendar(r), snaps, sec, adv, s, store)
    out = pipe.run()
    assert sorted(t.snapshot for t in out["stress"].collect()) == ["A", "B", "C"]
    assert all(0 <= t.nsi <= 1 for t in out["stress"].collect())
    assert out["tests"].count() == 7
    assert out["checks"].where("NOT passed AND name <> 'edge_floor'").count() == 0
    assert pipe.volume_weighted().count() == 3
    ids = {t.node: t.asset for t in pipe.ids.collect()}
    one_way = [(ids[t.src], ids[t.dst]) for t in pipe.arcs().collect()]
    ahead = sum(int(b[1:]) == int(a[1:]) + 1 for a, b in one_way)
    behind = sum(int(b[1:]) == int(a[1:]) - 1 for a, b in one_way)
    assert ahead > behind
    again = StressPipeline(spark, r, P.calendar(r), snaps, sec, adv, s, store)
    assert again.stress().orderBy("snapshot").collect() == pipe.stress().orderBy("snapshot").collect()


def test_streamed_returns_drop_repeated_files(spark, frame, tmp_path):
    src = str(tmp_path / "in")
    day = write_daily(frame, src, 5, 2)
    day.write.mode("append").parquet(src)
    q = ingest.append_to(ingest.returns_stream(ingest.daily_stream(spark, src)), str(tmp_path / "out"), f"t-{tmp_path.name}")
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_streamed_coverage(spark, frame, tmp_path):
    src = str(tmp_path / "in")
    write_daily(frame, src, 90, 2)
    q = ingest.append_to(ingest.coverage_stream(ingest.daily_stream(spark, src, 1)), str(tmp_path / "out"), f"c-{tmp_path.name}")
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() >= 2 and got.agg(F.max("n_obs")).head()[0] <= 30


def test_global_rank_is_exact(frame):
    t = frame([(i, float((i * 37) % 101)) for i in range(500)], "asset int, adv double").repartition(6)
    rows = global_rank(t, F.desc("adv"), F.asc("asset")).orderBy("rank0").collect()
    assert [r.rank0 for r in rows] == list(range(500))
    assert [(r.adv, r.asset) for r in rows] == sorted(((r.adv, r.asset) for r in rows), key=lambda v: (-v[0], v[1]))


def test_sweep_draws_rewirings_once(spark):
    from tremora.plans import standin as D
    from tremora.plans import sweep
    from tremora.plans.catalogue_pipeline import sweep_adv

    sf = "/root/testdata/sf0.001"
    got = sweep.run(D.returns(spark, sf), D.weeks(spark, sf), D.snapshots(spark).where("snapshot <= 'W03'"), D.sectors(spark, sf), sweep_adv(spark, sf),
                    sizes=(12,), kinds=("coverage",), n_rewires=2)
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()
