"""Shared pieces of the text operators: staged tables, components, vectorised words."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tremora.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 4 << 20
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the folder all executors share and read it back.

    Lineage ends at the files, so a lost executor re-reads them, and the shuffle
    files of the write go at its end, not when the driver happens to collect its
    garbage. Returns the table and its path for ``discard``.
    """
    path = f"{shared_dir(df.sparkSession)}/tremora-llm/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(RELEASE, None)
    conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(RELEASE) if before is None else conf.set(RELEASE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def few(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``ids`` (one to three numbers a row) marked for broadcast where a count shows at most ``most`` rows; else joined by shuffle."""
    ids, _ = stage(ids, "ids")
    return F.broadcast(ids) if ids.count() <= most else ids


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) for every id of ``edges(a, b)``.

    Distributed union-find by alternating stars: a round hangs every node's
    larger neighbours, then all its smaller ones, under the smallest id around.
    Depth shrinks geometrically; the loop ends only when a round changes nothing.
    Minima combine before the shuffle, so a hub costs its edges and no more.
    """
    spark = edges.sparkSession
    a, b = F.least("a", "b"), F.greatest("a", "b")
    e, path = stage(edges.select(a.alias("a"), b.alias("b")).where("a <> b").distinct(), "links")
    mark = None
    while True:
        both = e.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(
            e.select(F.col("a").alias("u"), F.col("b").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = small.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            small.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
        seen = Observation()
        n, new_path = stage(nxt.observe(
            seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links")
        discard(spark, path)
        e, path = n, new_path
        if (now := (seen.get["n"], seen.get["h"])) == mark:
            break
        mark = now
    label = e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    return label.unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()).groupBy("id").agg(
        F.min("component").alias("component"))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pc.fill_null(a.cast(pa.large_string()), "")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, *columns: str, limit: int = SLICE_BYTES):
    """Consecutive pieces of ``batch`` whose texts hold about ``limit`` bytes (one row at least)."""
    size = sum(np.diff(utf8(batch.column(c))[1]) for c in columns)
    at = 0
    ends = np.cumsum(size)
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a string column as flat arrays.

    ``start, end`` bytes in ``data``, ``row`` of each word, ``hash`` of 64 bits
    and ``count`` of words per row.
    """

    def __init__(self, column):
        raw, off = utf8(column)
        self.rows = len(off) - 1
        self.data = _FOLD[raw]
        inside = ~_GAP[self.data]
        n = len(inside)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        first[edge[inside[edge]]] = True
        last[edge[inside[edge - 1]] - 1] = True
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(off[1:], self.start, "right")
        self.count = np.bincount(self.row, minlength=self.rows)
        up = np.full(n + 1, _BASE, np.uint64)
        down = np.full(n + 1, _INVERSE, np.uint64)
        up[:1] = down[:1] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data] * up[:-1])])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed ``n``-word shingles per row, sorted by (row, hash): rows, hashes.

    A row with fewer words has its whole sequence as its one shingle, a row
    without words none.
    """
    begin = np.concatenate([[0], np.cumsum(w.count)[:-1]]) if w.rows else np.zeros(0, np.int64)
    k = np.minimum(n, w.count)
    m = np.where(w.count > 0, w.count - k + 1, 0)
    row = np.repeat(np.arange(w.rows), m)
    at = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin, m)
    width = np.repeat(k, m)
    h = np.zeros(len(row), np.uint64)
    for j in range(n):
        has = width > j
        word = w.hash[np.minimum(at + j, max(len(w.hash) - 1, 0))] if len(w.hash) else h
        h = np.where(has, mix(h * np.uint64(31) + word + np.uint64(j + 1)), h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]
