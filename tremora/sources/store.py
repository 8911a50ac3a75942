"""Stage tables on shared storage: parquet per stage plus a parameter note."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StageStore:
    """Write-once stage tables, keyed by name and parameters.

    A table is reused when its note matches the requested parameters and rebuilt
    otherwise (or when ``force`` is set). Notes go through Spark as text files, so
    any file system Spark can write works; an unreadable note counts as absent.
    """

    def __init__(self, spark: SparkSession, root: str, force: bool = False):
        self.spark, self.root, self.force = spark, root.rstrip("/"), force

    def _path(self, name: str, params: dict) -> str:
        tag = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:12]
        return f"{self.root}/{name}/{tag}"

    def note(self, name: str, params: dict) -> dict | None:
        try:
            rows = self.spark.read.text(self._path(name, params) + "/note").limit(1).collect()
            return json.loads(rows[0][0])
        except Exception:
            return None

    def get(self, name: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
        path = self._path(name, params)
        if self.force or self.note(name, params) != json.loads(json.dumps(params, default=str)):
            build().write.mode("overwrite").parquet(path + "/data")
            note = self.spark.range(1).select(F.lit(json.dumps(params, default=str)).alias("value"))
            note.coalesce(1).write.mode("overwrite").text(path + "/note")
        return self.spark.read.parquet(path + "/data")


def require_windows(stage: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Fail fast when a stage table misses a window."""
    missing = [r[0] for r in snapshots.select("snapshot").join(stage.select("snapshot").distinct(), "snapshot", "left_anti").collect()]
    if missing:
        raise ValueError(f"stage table misses windows: {sorted(missing)}")
    return stage


def write_table(df: DataFrame, path: str, fmt: str) -> None:
    """CSV, TSV, JSON or parquet sink."""
    w = df.write.mode("overwrite")
    if fmt in ("csv", "tsv"):
        w.option("header", True).option("sep", "," if fmt == "csv" else "\t").csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def latex_macros(values: DataFrame, prefix: str = "") -> str:
    """One ``\\newcommand`` per ``(name, value)`` row of a report table (one row per macro)."""
    rows = values.select(F.regexp_replace("name", "[^A-Za-z]", "").alias("n"), F.col("value").cast("string").alias("v")).orderBy("n").collect()
    return "".join(f"\\newcommand{{\\{prefix}{r['n']}}}{{{r['v']}}}\n" for r in rows)


def read_macros(spark: SparkSession, path: str) -> DataFrame:
    """Names and values back out of a macro file."""
    pat = r"\\newcommand\{\\([A-Za-z]+)\}\{([^}]*)\}"
    t = spark.read.text(path)
    return t.select(F.regexp_extract("value", pat, 1).alias("name"), F.regexp_extract("value", pat, 2).alias("value")).where("name <> ''")
