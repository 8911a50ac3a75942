"""Session helpers: configured sessions, lineage cuts and the shared folder they write to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "tremora", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """Local session used by tests and the bench; a cluster brings its own."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; there a scratch folder of
    the machine is shared by definition.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = made = tempfile.mkdtemp(prefix="tremora-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return _LOCAL_DIRS[sc.applicationId]


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage durably (a lost executor re-reads files instead of replaying
    the plan) and hands the optimiser real file sizes, so broadcast decisions
    downstream rest on measured bytes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tremora/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    if df is not None and getattr(df, "staged_at", None):
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize_with(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, dict]:
    """Like ``materialize`` and also returns aggregates observed during the write, without a second job."""
    seen = Observation()
    return materialize(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), name), seen.get


def values(spark: SparkSession, rows, names, types) -> DataFrame:
    """A small parameter table as an inline relation with known size."""

    def lit(v, t):
        if v is None:
            return f"CAST(NULL AS {t})"
        if isinstance(v, str):
            v = "'" + v.replace("'", "\\'") + "'"
        return f"CAST({v} AS {t})"

    body = ", ".join("(" + ", ".join(lit(v, t) for v, t in zip(r, types)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over the configured number of tasks before CPU-heavy Python work.

    With keys rows go by hash (grouped work), without keys they go round robin.

    Adaptive execution merges partitions by bytes, which would queue many small
    but expensive groups behind one another; an explicit count is left alone.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if keys else df.repartition(n)


def dealt(df: DataFrame, name: str, each: int) -> DataFrame:
    """Like ``spread`` without keys for rows that are worked on ``each`` at a time: a few rows start a few tasks only."""
    rows, seen = materialize_with(df, name, n=F.count(F.lit(1)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, min(n, -(-seen["n"] // each))))


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate, which is one row by construction, to every row."""
    k = "_all"
    return df.withColumn(k, F.lit(1)).join(F.broadcast(one_row.withColumn(k, F.lit(1))), k).drop(k)


def global_rank(df: DataFrame, *order, name: str = "rank0") -> DataFrame:
    """Exact zero-based rank over a whole table without a single-task window.

    Rows are range-partitioned by the order columns and written with their
    partition number, so counts and ranks read the same cut; each partition then
    ranks its own rows on top of the rows before it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "rank")
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offset = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return cut.join(offset, "_part").withColumn(
        name, (F.col("_skip") + F.row_number().over(inside) - 1).cast("int")).drop("_part", "_skip")
