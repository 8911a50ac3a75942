"""Job ledger of the sweep: resuming, redoing what changed, failures beside results."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tremora.operators import panel as P
from tremora.plans import ledger
from tremora.plans.pipeline import Settings, StressPipeline


def test_jobs_resume_and_failures_stay_in_the_table(spark, tmp_path):
    root, built, broken = str(tmp_path / "sweep"), [], {"b-2"}
    marks = {"a-1": "m1", "a-2": "m1", "b-2": "m1"}

    def build(kind, n):
        built.append(f"{kind}-{n}")
        if f"{kind}-{n}" in broken:
            raise ValueError("no 'assets'")
        return spark.range(n).withColumnRenamed("id", "v")

    def run():
        built.clear()
        jobs = [("a", 1), ("a", 2), ("b", 2)]
        return {r.job: r for r in ledger.run_jobs(spark, root, jobs, lambda k, n: marks[f"{k}-{n}"], build).collect()}

    first = run()
    assert built == ["a-1", "a-2", "b-2"] and {k: r.state for k, r in first.items()} == {"a-1": "done", "a-2": "done", "b-2": "failed"}
    assert first["b-2"].error == "ValueError: no 'assets'" and first["a-1"].seconds >= 0
    broken.clear()
    assert run()["b-2"].state == "done" and built == ["b-2"]
    marks["a-2"] = "m2"
    assert run()["a-2"].fingerprint == "m2" and built == ["a-2"]
    ledger.Ledger(spark, root).put("a-1", "a", 1, "m1", "running")  # as left by a killed run
    run()
    assert built == ["a-1"]
    rows = ledger.results(spark, root)
    assert sorted((r.kind, r.n, r.v) for r in rows.collect()) == [("a", 1, 0), ("a", 2, 0), ("a", 2, 1), ("b", 2, 0), ("b", 2, 1)]


def test_fingerprint_sees_values_and_parameters(frame):
    a = frame([(1, 2.0), (2, 3.0)], "x int, y double")
    assert ledger.table_mark(a) == ledger.table_mark(a.orderBy(F.desc("x")).select("y", "x"))
    assert ledger.table_mark(a) != ledger.table_mark(a.withColumn("y", F.col("y") + 1))
    assert ledger.fingerprint({"r": "1"}, {"n": 1}) != ledger.fingerprint({"r": "1"}, {"n": 2})


def test_one_job_through_all_stages(spark, frame, tmp_path):
    rng = np.random.default_rng(1)
    n, p = 420, 13
    x = 0.01 * (0.6 * rng.normal(size=n)[:, None] + rng.normal(size=(n, p)))
    days = [dt.date(2015, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    r = frame([(f"T{j:02d}", days[i], i, float(x[i, j])) for j in range(p) for i in range(n)], "asset string, date date, pos int, x double")
    snaps = frame([("A", days[0], days[209], "baseline"), ("B", days[210], days[419], "crisis"), ("C", days[0], days[5], "stress")],
                  "snapshot string, start date, end date, regime string")
    sec = frame([(f"T{j:02d}", f"s{j % 3}") for j in range(p)], "asset string, sector string")
    adv = frame([(f"T{j:02d}", float(1000 * (j + 1))) for j in range(p)], "asset string, adv double")
    s = Settings(n_er_sims=5, n_rewires=3, n_er_matched=1, lambdas=[0.3, 0.1, 0.05])
    root = str(tmp_path / "sweep")
    book = ledger.sweep(spark, root, r, P.calendar(r), snaps, sec, adv, (12,), ("adv",), s).collect()
    assert [(b.job, b.state, b.error) for b in book] == [("adv-12", "done", "")]
    got = {t.snapshot: t for t in ledger.results(spark, root).collect()}
    assert got["A"].status == got["B"].status == "ok" and got["A"].n_nodes == 12 and 0 <= got["A"].nsi <= 1
    assert got["C"].status == "skipped" and got["C"].nsi is None
    at = {b.job: b.at for b in book}
    assert {b.job: b.at for b in ledger.sweep(spark, root, r, P.calendar(r), snaps, sec, adv, (12,), ("adv",), s).collect()} == at


def test_parameters_are_kept_unless_they_moved(spark, frame):
    old = frame([(0.05, 0.9, 0.02)], "a double, b double, g double")
    near, far = frame([(0.05005, 0.9, 0.02)], old.schema), frame([(0.06, 0.9, 0.02)], old.schema)
    assert StressPipeline.settled(near, old).head().a == 0.05 and StressPipeline.settled(far, old).head().a == 0.06
    assert StressPipeline.settled(far, None).head().a == 0.06
