"""Resumable sweep: every job runs all five stages, its state is a row of a shared table.

A job's fingerprint covers the contents of its inputs and its parameters. A run takes
up only jobs that are not done under their present fingerprint, so a run that was
killed goes on where it stopped and a changed input redoes just the jobs it touches.
A job that fails leaves its error in the table and does not stop the others.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tremora import config as C
from tremora.operators import panel as P
from tremora.operators import selection as S
from tremora.plans.pipeline import Settings, StressPipeline
from tremora.session import values
from tremora.sources.store import StageStore

ROW = "job string, kind string, n int, fingerprint string, state string, error string, seconds double, at double"


def table_mark(df: DataFrame) -> str:
    """Row count and order-free hash of a table."""
    h = F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)"))
    n, s = df.agg(F.count(F.lit(1)), h).head()
    return f"{n}:{s}"


def fingerprint(marks: dict[str, str], params: dict) -> str:
    text = json.dumps({"inputs": marks, "params": params}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


class Ledger:
    """Append-only table of job states below ``root``; the latest row of a job counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, root.rstrip("/") + "/ledger"

    def put(self, job: str, kind: str, n: int, mark: str, state: str, error: str = "", seconds: float | None = None) -> None:
        row = values(self.spark, [(job, kind, n, mark, state, seconds, time.time())], ["job", "kind", "n", "fingerprint", "state", "seconds", "at"],
                     ["STRING", "STRING", "INT", "STRING", "STRING", "DOUBLE", "DOUBLE"])
        row.withColumn("error", F.lit(error)).select("job", "kind", "n", "fingerprint", "state", "error", "seconds", "at").write.mode("append").parquet(self.path)

    def latest(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(ROW).parquet(self.path)
        except AnalysisException:  # nothing written yet
            rows = self.spark.createDataFrame([], ROW)
        cols = ("kind", "n", "fingerprint", "state", "error", "seconds", "at")
        return rows.groupBy("job").agg(F.max_by(F.struct(*cols), "at").alias("r")).select("job", "r.*")


def run_jobs(spark: SparkSession, root: str, jobs: list[tuple[str, int]], mark_of: Callable[[str, int], str],
             build: Callable[[str, int], DataFrame]) -> DataFrame:
    """Build every ``(kind, n)`` whose present fingerprint is not done; returns the ledger."""
    book = Ledger(spark, root)
    done = {r.job: r.fingerprint for r in book.latest().where("state = 'done'").collect()}  # a row a job
    for kind, n in jobs:
        job, mark = f"{kind}-{n}", mark_of(kind, n)
        if done.get(job) == mark:
            continue
        book.put(job, kind, n, mark, "running")
        start = time.time()
        try:
            build(kind, n).write.mode("overwrite").parquet(f"{root.rstrip('/')}/results/{job}")
            book.put(job, kind, n, mark, "done", seconds=time.time() - start)
        except Exception as e:  # the table carries the failure, other jobs go on
            book.put(job, kind, n, mark, "failed", f"{type(e).__name__}: {e}"[:500], time.time() - start)
    return book.latest()


def results(spark: SparkSession, root: str) -> DataFrame | None:
    """Rows of all jobs that are done, with ``kind`` and ``n``."""
    out = None
    for r in Ledger(spark, root).latest().where("state = 'done'").orderBy("kind", "n").collect():
        t = spark.read.parquet(f"{root.rstrip('/')}/results/{r.job}").withColumn("kind", F.lit(r.kind)).withColumn("n", F.lit(r.n))
        out = t if out is None else out.unionByName(t)
    return out


def sweep(spark: SparkSession, root: str, returns: DataFrame, cal: DataFrame, snapshots: DataFrame, sectors: DataFrame, adv: DataFrame,
          sizes=tuple(C.PANEL_SIZES), kinds=C.SELECTION_KINDS, settings: Settings | None = None) -> DataFrame:
    """All selection rules by all sizes through the five stages; returns the ledger.

    A job's result is one row per window: its index, metrics and ``status``
    (``ok`` or ``skipped`` where the window had too few assets or rows).
    """
    s = settings or Settings()
    common = {"calendar": table_mark(cal), "snapshots": table_mark(snapshots), "sectors": table_mark(sectors)}

    def members(kind, n):
        return S.select_assets(returns, adv, n, kind).select("asset")

    def mark_of(kind, n):
        own = returns.join(members(kind, n), "asset", "left_semi")
        return fingerprint({**common, "returns": table_mark(own), "adv": table_mark(adv.join(members(kind, n), "asset", "left_semi"))},
                           {"kind": kind, "n": n, **asdict(s)})

    def build(kind, n):
        own = P.keep_assets(returns, members(kind, n))
        store = StageStore(spark, f"{root.rstrip('/')}/stages/{kind}-{n}/{mark_of(kind, n)}")
        pipe = StressPipeline(spark, own, cal, snapshots, sectors, adv, s, store)
        cols = ["n_nodes", "n_edges", "mean_corr", "hhi_top10", "gini", "mutual_fraction", "cs_fraction", "z_ffl", "z_111d", "nsi"]
        found = pipe.stress()
        found = found.select("snapshot", *[c if c in found.columns else F.lit(None).cast("double").alias(c) for c in cols])
        return snapshots.select("snapshot", "regime").join(found, "snapshot", "left").withColumn(
            "status", F.when(F.col("nsi").isNull(), "skipped").otherwise("ok"))

    return run_jobs(spark, root, [(k, n) for k in kinds for n in sizes], mark_of, build)
