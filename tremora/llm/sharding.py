"""Shards by a hierarchical weighted hash tree.

Shards hang in racks of ``width`` and racks in regions of ``racks``, numbered in
that order; a node weighs what the shards below it weigh. A document's key draws
one exponential time of rate ``weight`` for every child of a node and descends to
the earliest, so a shard receives its share of the keys and a changed weight moves
keys only into or out of the subtrees whose weight changed.

The last region and rack may have shards still to come. Such a node keeps the
time and the choice that it has when complete: its chosen child inherits the node's
time, the others come later by a further draw of their own rate (an exponential
time has no memory), and the children that exist compete one by one. So a shard
more only adds a competitor: rows go into it and no row moves elsewhere, and the
shard depends on key, shard count and weights alone.

Defined results: a null key is one key of its own; equal keys share a shard, equal
texts under different keys need not; a null text has no bytes; a shard of weight 0
receives nothing; an empty table gives no rows. Only the key and text columns are
read, whatever others are called.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import discard, fresh, stage

RACKS, WIDTH = 2, 4
ROW_BYTES = 16
NEVER = math.inf


def unit(kind: str, node, key: Column) -> Column:
    """A number in (0, 1) drawn by 52 bits of the digest of (kind, node, key)."""
    name = F.concat(F.lit(f"{kind}:"), node.cast("string") if isinstance(node, Column) else F.lit(str(node)), F.lit(":"), key)
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def after(kind: str, node, weight, key: Column) -> Column:
    """Exponential time of rate ``weight``; weight 0 never comes."""
    if isinstance(weight, Column):
        return F.when(weight > 0, -F.log(unit(kind, node, key)) / weight).otherwise(F.lit(NEVER))
    return -F.log(unit(kind, node, key)) / F.lit(float(weight)) if weight > 0 else F.lit(NEVER)


class Tree:
    """Weights of shards, racks and regions for ``n`` shards; shards to come weigh 1 unless listed."""

    def __init__(self, n: int, weights: Sequence[float] | None = None, racks: int = RACKS, width: int = WIDTH):
        self.n, self.racks, self.width = n, racks, width
        size = racks * width
        given = [float(w) for w in weights or ()]
        if n < 1 or racks < 1 or width < 1 or any(not 0 <= w < NEVER for w in given):
            raise ValueError("a tree needs a shard and finite weights of 0 or more")
        total = -(-n // size) * size
        self.shard = (given + [1.0] * max(0, total - len(given)))[:total]
        if not any(self.shard[:n]):
            raise ValueError("all shards have weight 0")
        self.rack = [sum(self.shard[i:i + width]) for i in range(0, total, width)]
        self.region = [sum(self.rack[i:i + racks]) for i in range(0, len(self.rack), racks)]

    def _earliest(self, level: str, weights: list[float], parent: Column, fan: int, key: Column) -> Column:
        """Child of ``parent`` (a column) with the earliest draw."""
        every = F.array(*[F.lit(w) for w in weights])
        child = [parent * fan + i for i in range(fan)]
        return F.array_min(F.array(*[F.struct(after(level, c, F.get(every, c), key).alias("t"), c.alias("i")) for c in child]))["i"]

    def _apart(self, level: str, weights: list[float], parent: int, fan: int, time: Column, key: Column) -> list[tuple[int, Column]]:
        """``(child, time)`` of the children of an incomplete node that comes at ``time``."""
        child = range(parent * fan, parent * fan + fan)
        first = F.array_min(F.array(*[F.struct(after(level, c, weights[c], key).alias("t"), F.lit(c).alias("i")) for c in child]))["i"]
        return [(c, F.when(first == c, time).otherwise(time + after(f"later-{level}", c, weights[c], key))) for c in child]

    def place(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with the shard of ``key`` as column ``name``."""
        size = self.racks * self.width
        full, left = divmod(self.n, size)
        race = [(0, r, after("region", r, self.region[r], key)) for r in range(full)]
        if left:
            time = after("region", full, self.region[full], key)
            racks = self._apart("rack", self.rack, full, self.racks, time, key)
            done, open_ = divmod(left, self.width)
            race += [(1, c, t) for c, t in racks[:done]]
            if open_:
                c, time = racks[done]
                race += [(2, s, t) for s, t in self._apart("shard", self.shard, c, self.width, time, key)[:open_]]
        won, rack = fresh(df, "_won", "_rack")
        node = F.array_min(F.array(*[F.struct(t.alias("t"), F.lit(level).alias("level"), F.lit(i).alias("i")) for level, i, t in race]))
        out = df.withColumn(won, node)
        out = out.withColumn(rack, F.when(F.col(won)["level"] == 0, self._earliest("rack", self.rack, F.col(won)["i"], self.racks, key))
                             .otherwise(F.col(won)["i"]))
        return out.withColumn(name, F.when(F.col(won)["level"] == 2, F.col(won)["i"]).otherwise(
            self._earliest("shard", self.shard, F.col(rack), self.width, key)).cast("int")).drop(won, rack)


def key_text(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))


def assign(df: DataFrame, n: int, key: str = "doc_id", name: str = "shard", weights: Sequence[float] | None = None,
           racks: int = RACKS, width: int = WIDTH) -> DataFrame:
    """Every row of ``df`` with its shard; a narrow step, nothing is shuffled."""
    return Tree(n, weights, racks, width).place(df, key_text(F.col(key)), name)


def sharded(df: DataFrame, n: int, key: str = "doc_id", text: str = "text", weights: Sequence[float] | None = None,
            racks: int = RACKS, width: int = WIDTH) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` per row of ``df``.

    ``grown_shard`` is the shard under one shard more. Slots count from 0 within a
    shard by key, checksum and size. Numbering never gathers a shard: narrow rows
    are range-partitioned by shard and key (and by their place in the input, which
    cuts repeated rows apart), a partition's rows continue the count of those before.
    """
    spark = df.sparkSession
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("key"), (F.octet_length(raw) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = assign(assign(rows, n, "key", "shard", weights, racks, width), n + 1, "key", "grown_shard", weights, racks, width)
    rows, path = stage(rows.withColumn("seen", F.monotonically_increasing_id()), "shard-rows")
    order = ("shard", "key", "text_crc32", "size", "seen")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("seen")
    cut, _ = stage(cut.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "shard-slots")
    discard(spark, path)
    held = cut.groupBy("shard", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition that holds the shard
    skip = held.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("skip"))
    return cut.join(skip, ["shard", "part"]).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("skip")).alias("slot"), "grown_shard")


def write_shards(df: DataFrame, folder: str, n: int, key: str = "doc_id", weights: Sequence[float] | None = None,
                 racks: int = RACKS, width: int = WIDTH) -> None:
    """Write whole rows below ``folder/shard=…``; a shard fills as many files as range partitions hold it, in key order."""
    name, = fresh(df, "shard")
    seen, = fresh(df, "_seen")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = assign(df, n, key, name, weights, racks, width).withColumn(seen, F.monotonically_increasing_id())
    out.repartitionByRange(parts, name, key, seen).sortWithinPartitions(name, key).drop(seen).write.partitionBy(name).parquet(folder)
