"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one vector kept per group.

Equal vectors collapse first. A pair with cosine ``t`` or more is at most
``acos t`` apart, so a vector is compared outside its own cell exactly where it
lies within that angle of the plane between two centroids; links are therefore
complete whatever the centroids are. Neighbouring cells share a block of bounded
size, a large cell fills several. A vector goes once to every block that holds a
cell it visits, however many of them, with the list of these cells; the guests of a
block are cut into chunks of bounded size, and a task multiplies the vectors of a
block with one chunk, cell by cell. Only counts and a spanning forest leave a task.
Products are made in single precision; those within its error of the threshold are
made again in double precision, and what is still too close is compared exactly.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import components, discard, mix, stage

SAMPLE = 20_000
PER_CELL = 2_000
MAX_CELLS = 1_024
BLOCK = 2_048  # vectors a side of a product; blocks of cells begin there
BLOCKS = 12  # blocks wanted before they grow
BLOCK_NUMBERS = 1 << 21  # numbers in a block of vectors at most
ASSIGNED = 1 << 20  # products with centroids made at once
NEAR = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Unit rows in double precision, scaled first so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def matrix(column) -> np.ndarray:
    return unit(np.array([np.asarray(v, np.float64) for v in column]))


def table_of(column) -> np.ndarray:
    """A column of lists of one length as rows in double precision."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; an empty cell keeps its centroid."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def cells_of(x: np.ndarray, c: np.ndarray, threshold: float):
    """Home cell per row, and (row, cell) of the lower-numbered cells it must also visit.

    If rows of two cells are linked, both lie within the angle of the plane
    between the centroids, so visiting the lower-numbered cell meets the other.
    """
    near = x @ c.T
    home = near.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
    reach = np.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9
    need = near[np.arange(len(x)), home][:, None] - near <= reach * gap[home]
    need &= np.arange(len(c)) < home[:, None]
    return home, *np.nonzero(need)


def at_least(a, b, threshold: float) -> bool:
    """Exact comparison of a cosine with the threshold, for products too close to call."""
    a, b = [[Fraction(float(v)) for v in x] for x in (a, b)]
    dot = sum(p * q for p, q in zip(a, b))
    t = Fraction(str(threshold))
    return dot > 0 and dot * dot >= t * t * sum(p * p for p in a) * sum(q * q for q in b)


def pieces(batch: pa.RecordBatch, cells: int):
    """Parts of ``batch`` whose products with the centroids are ``ASSIGNED`` at most, one row at least."""
    step = max(1, ASSIGNED // cells)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def home_counts(batches, c: np.ndarray, d: int):
    """How many vectors are at home in each cell."""
    total = np.zeros(len(c), np.int64)
    for batch in batches:
        for part in pieces(batch, len(c)):
            total += np.bincount((unit(table_of(part.column("embedding"))) @ c.T).argmax(axis=1), minlength=len(c))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), d), pa.int32()), pa.array(np.arange(len(c)), pa.int32()), pa.array(total)], ["dim", "cell", "n"])


def layout(counts: np.ndarray, size: int, base: int):
    """First block and number of blocks of each cell, from block ``base`` on, and the next free block; an empty cell has none."""
    first, parts = np.full(len(counts), -1), np.zeros(len(counts), np.int64)
    room = 0
    nxt = base
    for k, n in enumerate(counts.tolist()):
        if not n:
            continue
        if n > size:
            first[k], parts[k], room = nxt, -(-n // size), 0
            nxt += parts[k]
            continue
        if n > room:
            room, nxt = size, nxt + 1
        first[k], parts[k], room = nxt - 1, 1, room - n
    return first, parts, int(nxt)


def lists(values: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values, pa.int32()))


def dealt(batches, c: np.ndarray, first: np.ndarray, parts: np.ndarray, threshold: float):
    """Each vector with its block and cell, the cells of its own block it visits, and the other blocks it visits with their cells."""
    for batch in batches:
        for part in pieces(batch, len(c)):
            home, row, cell = cells_of(unit(table_of(part.column("embedding"))), c, threshold)
            rep = np.asarray(part.column("rep")).astype(np.int64)
            at = (mix(rep.astype(np.uint64)) % parts[home].astype(np.uint64)).astype(np.int64)
            own = first[home] + at
            row, cell = row[parts[cell] > 0], cell[parts[cell] > 0]
            n = parts[cell]  # a cell of several blocks is visited in each, the own one in those before the own block
            row = np.concatenate([np.repeat(row, n), np.repeat(np.arange(len(home)), at)])
            k = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.arange(at.sum()) - np.repeat(np.cumsum(at) - at, at)])
            cell = np.concatenate([np.repeat(cell, n), np.repeat(home, at)])
            block = first[cell] + k
            order = np.lexsort((cell, block, row))
            row, cell, block = row[order], cell[order], block[order]
            inner = block == own[row]
            mine = lists(cell[inner], np.bincount(row[inner], minlength=len(home)))
            row, cell, block = row[~inner], cell[~inner], block[~inner]
            begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])[:len(row)])
            visits = pa.StructArray.from_arrays(
                [pa.array(block[begin], pa.int32()), lists(cell, np.diff(np.append(begin, len(row))))], ["block", "cells"])
            yield pa.RecordBatch.from_arrays(
                [part.column("rep"), part.column("copies"), part.column("embedding"), pa.array(own, pa.int32()), pa.array(home, pa.int32()), mine,
                 lists(visits, np.bincount(row[begin], minlength=len(home)))],
                ["rep", "copies", "embedding", "block", "cell", "inner", "visits"])


class Links:
    """Links among the rows ``raw``: numbers of linked vectors, and connected rows under one label."""

    def __init__(self, raw: np.ndarray, copies: np.ndarray, threshold: float):
        self.raw, self.copies, self.threshold = raw, copies, threshold
        self.x = unit(raw)
        self.short = self.x.astype(np.float32)
        self.error = (raw.shape[1] + 8) * 1.2e-7
        self.n = np.zeros(len(raw), np.int64)
        self.label = np.arange(len(raw))

    def meet(self, left: np.ndarray, right: np.ndarray, same: bool = False) -> None:
        """Compares all rows of ``left`` with all of ``right``, or the rows of one list with each other once."""
        for i in range(0, len(left), BLOCK):
            a = left[i:i + BLOCK]
            for j in range(i if same else 0, len(right), BLOCK):
                b = right[j:j + BLOCK]
                s = self.short[a] @ self.short[b].T
                if s.max() < self.threshold - self.error:
                    continue
                p, q = np.nonzero(s >= self.threshold - self.error)
                if same and i == j:
                    p, q = p[p < q], q[p < q]
                self.add(a[p], b[q], s[p, q])

    def add(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        hit = s > self.threshold + self.error
        close = np.flatnonzero(~hit)
        for k in range(0, len(close), 100_000):
            few = close[k:k + 100_000]
            exact = np.einsum("ij,ij->i", self.x[a[few]], self.x[b[few]])
            hit[few] = exact >= self.threshold
            for e in few[np.abs(exact - self.threshold) < NEAR]:
                hit[e] = at_least(self.raw[a[e]], self.raw[b[e]], self.threshold)
        a, b = a[hit], b[hit]
        for x, y in ((a, b), (b, a)):
            np.add.at(self.n, x, self.copies[y])
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (self.label != (top := self.label[self.label])).any():
                self.label = top


def compare(rows: pa.Table, threshold: float) -> pa.Table:
    """Links of a block with itself or with a chunk of guests: ``a`` has ``n`` more linked vectors; ``a`` and ``b`` are connected."""
    rep = rows.column("rep").to_numpy()
    cell, home = rows.column("cell").to_numpy(), rows.column("home").to_numpy(zero_copy_only=False)
    cells = rows.column("cells").combine_chunks()
    links = Links(table_of(rows.column("embedding")), rows.column("copies").to_numpy(), threshold)
    at = np.flatnonzero(home)
    at = at[np.argsort(cell[at], kind="stable")]
    visitor = np.repeat(np.arange(len(rep)), cells.value_lengths().to_numpy())
    visited = cells.flatten().to_numpy()
    order = np.argsort(visited, kind="stable")
    visitor, visited = visitor[order], visited[order]
    alone = rows.column("chunk")[0].as_py() == 0
    for k in np.unique(cell[at]):
        here = at[np.searchsorted(cell[at], k):np.searchsorted(cell[at], k, "right")]
        if alone:
            links.meet(here, here, same=True)
        links.meet(visitor[np.searchsorted(visited, k):np.searchsorted(visited, k, "right")], here)
    some = links.n > 0
    return pa.table({"a": pa.array(rep[some], pa.int64()), "b": pa.array(rep[links.label[some]], pa.int64()), "n": pa.array(links.n[some])})


def embedding_groups(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``df``.

    A vector that is null, empty, zero or holds null or non-finite components
    links with nothing; vectors of different length never link. Rows with equal
    vectors link with each other (each row counts, also under a repeated key). A
    null key links with nothing and is kept. Other columns are not read. An empty
    table gives an empty result.

    ``SAMPLE`` vectors at most fit the centroids; all vectors are assigned and compared.
    """
    spark = df.sparkSession
    every = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    good = F.col("vec_id").isNotNull() & F.coalesce(
        (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists("embedding", lambda v: v != 0), F.lit(False))
    every = every.withColumn("embedding", F.when(good, F.col("embedding")))
    reps, _ = stage(
        every.where(F.col("embedding").isNotNull()).groupBy("embedding").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    kind = df.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"  # what travels is as exact as what was read
    sizes = [(r["d"], r["n"]) for r in reps.groupBy(F.size("embedding").alias("d")).count().withColumnRenamed("count", "n").collect()]
    work, blocks = None, 0
    for d, n in sorted(sizes):  # a vector length at a time
        one = reps.where(F.size("embedding") == d)
        h = F.xxhash64("rep")  # the smallest hashes lie below a bound that about four samples pass
        near = one.where(h.cast("double") <= F.lit(2.0**64 * min(1.0, 4 * SAMPLE / n) - 2.0**63))
        take = near.orderBy(h, "rep").limit(SAMPLE).toPandas()
        x = matrix(take["embedding"])
        c = spherical_kmeans(x, int(min(MAX_CELLS, max(1, n // PER_CELL), len(x))))
        one = one.select("rep", "copies", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
        counts = np.zeros(len(c), np.int64)
        for r in one.mapInArrow(lambda it, c=c, d=d: home_counts(it, c, d), "dim int, cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            counts[r["cell"]] = r["n"]
        size = max(min(n // BLOCKS, BLOCK_NUMBERS // d), min(BLOCK, max(1, BLOCK_NUMBERS // d)))
        first, parts, blocks = layout(counts, size, blocks)
        part = one.mapInArrow(
            lambda it, c=c, first=first, parts=parts: dealt(it, c, first, parts, threshold),
            f"rep long, copies long, embedding array<{kind}>, block int, cell int, inner array<int>, visits array<struct<block:int,cells:array<int>>>")
        part = part.withColumn("size", F.lit(size))
        work = part if work is None else work.unionByName(part)
    if work is None:
        linked = spark.createDataFrame([], "rep long, n long, component long")
    else:
        work, work_path = stage(work, "blocks")
        guests, guests_path = stage(work.select("size", F.explode("visits.block").alias("block")).groupBy("block").agg(
            F.ceil(F.count(F.lit(1)) / F.max("size")).cast("int").alias("chunks")), "guests")  # as many rows as blocks
        nothing = F.array().cast("array<int>")
        at_home = F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(0))), lambda k: F.struct(
            F.col("block"), k.alias("chunk"), F.lit(True).alias("home"), F.when(k == 0, F.col("inner")).otherwise(nothing).alias("cells")))
        homes = work.join(F.broadcast(guests), "block", "left").select("rep", "copies", "embedding", "cell", F.explode(at_home).alias("t"))
        away = work.select("rep", "copies", "embedding", "cell", F.explode("visits").alias("v")).select("rep", "copies", "embedding", "cell", "v.*")
        chunk = (F.pmod(F.xxhash64("rep"), F.col("chunks")) + 1).cast("int")
        away = away.join(F.broadcast(guests), "block").select("rep", "copies", "embedding", "cell", F.struct(
            "block", chunk.alias("chunk"), F.lit(False).alias("home"), "cells").alias("t"))
        met = homes.unionByName(away).select("rep", "copies", "embedding", "cell", "t.*")
        met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "chunk").groupBy("block", "chunk")
        found, _ = stage(met.applyInArrow(lambda rows: compare(rows, threshold), "a long, b long, n long"), "pairs")
        for path in (work_path, guests_path):
            discard(spark, path)
        group = components(found.select("a", "b"))
        linked = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n")).join(
            group.select(F.col("id").alias("rep"), "component"), "rep", "left")
    out = every.join(reps, "embedding", "left").join(linked, "rep", "left")
    many = F.coalesce(F.col("n"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    comp = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", many.alias("n_links"), comp.alias("component_id"),
                      F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))
