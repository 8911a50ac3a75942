"""Near-duplicate documents by min-max hashing of word shingles.

A document's set of hashed shingles gives, under each permutation, its smallest
and its largest value: two unbiased signature rows for one hash evaluation. Rows
form bands; documents that agree in a band are candidates and every link is
confirmed on the full sets. Equal sets collapse before banding. Within a band's
bucket documents are first compared with one drawn member, a few rounds long, which settles
a group of near copies with a few comparisons each. What is still apart afterwards
is compared completely: pairs of small buckets one by one; large buckets that share
members form one cluster, cut into blocks, and each pair of blocks is one task that
counts intersections of full sets and gives back only the links that join groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import Words, components, discard, few, fresh, mix, shingle_sets, slices, stage

PERMUTATIONS = 120
ROWS = 6
STAR_ROUNDS = 2
SMALL = 8
BLOCK = 1_000
_RANDOM = np.random.default_rng(2024)
_XOR = _RANDOM.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 2**62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(row: np.ndarray, h: np.ndarray, rows: int):
    """Per row: set size, two set fingerprints, band keys, one byte of each signature value."""
    size = np.bincount(row, minlength=rows)
    has = np.flatnonzero(size)
    begin = (np.cumsum(size) - size)[has]
    print_ = np.zeros((2, rows), np.uint64)
    sig = np.zeros((2 * PERMUTATIONS, len(has)), np.uint64)
    if len(has):
        print_[0, has] = np.add.reduceat(mix(h), begin)
        print_[1, has] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), begin)
        for p in range(PERMUTATIONS):
            v = (h ^ _XOR[p]) * _ODD[p]
            v ^= v >> np.uint64(32)
            v *= _ODD[-1 - p]
            sig[p] = np.minimum.reduceat(v, begin)
            sig[PERMUTATIONS + p] = np.maximum.reduceat(v, begin)
    sig = mix(sig)
    bands = np.zeros((2 * PERMUTATIONS // ROWS, len(has)), np.uint64)
    for r in range(ROWS):
        bands = mix(bands * np.uint64(31) + sig[r::ROWS])
    return size, print_.view(np.int64), has, bands.T.copy().view(np.int64), (sig & np.uint64(255)).astype(np.uint8).T.copy()


def sign(batches, n: int):
    for batch in batches:
        for part in slices(batch, "text"):
            rows = part.num_rows
            size, prints, has, bands, sketch = signatures(*shingle_sets(Words(part.column("text")), n), rows)
            width = bands.shape[1]
            count = np.where(size > 0, width, 0)
            off = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            raw = np.concatenate([[0], np.cumsum(np.where(size > 0, sketch.shape[1], 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(size, pa.int64()), pa.array(prints[0]), pa.array(prints[1]),
                pa.ListArray.from_arrays(pa.array(off), pa.array(bands.ravel())),
                pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(raw), pa.py_buffer(sketch.tobytes())])],
                ["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch"])


def plausible(batches, floor: float):
    """Pairs whose signatures agree in at least ``floor`` of their values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
        keep = (a == b).mean(axis=1) >= floor
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def confirm(batches, n: int, percent: int):
    """Pairs with 100 * intersection >= percent * union on the full sets."""
    for batch in batches:
        for part in slices(batch, "ta", "tb", limit=8 << 20):
            (ra, ha), (rb, hb) = (shingle_sets(Words(part.column(c)), n) for c in ("ta", "tb"))
            rows = part.num_rows
            na, nb = np.bincount(ra, minlength=rows), np.bincount(rb, minlength=rows)
            row, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            same = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
            both = np.bincount(row[1:][same], minlength=rows)
            keep = 100 * both >= percent * (na + nb - both)
            yield part.select(["a", "b"]).filter(pa.array(keep))


def join_blocks(pdf: pd.DataFrame, n: int, percent: int) -> pd.DataFrame:
    """Links between the rows of side 0 and side 1 that join two groups; every pair is counted on full sets."""
    pdf = pdf.sort_values(["side", "id"])
    row, h = shingle_sets(Words(pa.array(pdf["text"].tolist(), pa.string())), n)
    _, item = np.unique(h, return_inverse=True)
    size = np.bincount(row, minlength=len(pdf))
    end = np.cumsum(size)
    left = int((pdf["side"] == 0).sum())
    first = end[left - 1] if left else 0
    right_item, right_row = item[first:], row[first:]
    ids, group = pdf["id"].to_numpy(), pdf["comp"].to_numpy().copy()
    mark = np.zeros(len(h), np.int64)
    out = []
    for a in range(left):
        own = item[end[a] - size[a]:end[a]]
        mark[own] = 1
        both = np.bincount(right_row, mark[right_item], minlength=len(pdf)).astype(np.int64)
        mark[own] = 0
        near = (100 * both >= percent * (size[a] + size - both)) & (both > 0) & (group != group[a])
        for b in np.flatnonzero(near):
            if group[b] != group[a]:
                out.append((ids[a], ids[b]))
                low, high = sorted((group[a], group[b]))
                group[group == high] = low
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def in_blocks(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links among the ``bucket, id, comp`` of large buckets that join groups."""
    lead = members.groupBy("bucket").agg(F.min("id").alias("a"))
    cluster = components(members.join(lead, "bucket").select("a", F.col("id").alias("b")).distinct())
    rows = members.select("id", "comp").distinct().join(cluster.withColumnRenamed("component", "cluster"), "id")
    rows, _ = stage(rows, "cluster-members")
    many = rows.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("many")).groupBy("cluster").agg(
        F.max_by("comp", F.struct("many", "comp")).alias("main"), F.sum("many").alias("all"), F.max("many").alias("most"))
    many = many.where("most < all").select(
        "cluster", "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("js"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("is"))
    rows = rows.join(many, "cluster").join(texts.withColumnRenamed("doc_id", "id"), "id")
    place = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("is") - 1), lambda i: F.struct(i.alias("i"), place("js").alias("j"), F.lit(1).alias("side")))
    other = F.transform(F.sequence(F.lit(0), F.col("js") - 1), lambda j: F.struct(place("is").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    dealt = rows.select("cluster", "id", "comp", "text", F.explode(F.when(F.col("comp") != F.col("main"), F.concat(every, other)).otherwise(every)).alias("t"))
    return dealt.select("cluster", "t.*", "id", "comp", "text").groupBy("cluster", "i", "j").applyInPandas(
        lambda pdf: join_blocks(pdf, n, percent), "a long, b long")


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``df``.

    Words are maximal runs without ASCII white space, A-Z lower-cased; the set
    holds distinct ``n``-word shingles (fewer words: the whole sequence as one).
    A null, empty or blank text has an empty set and links with nothing, and so
    does a row with a null key (kept, component null). Rows that repeat a key
    share its component. Other columns are not read; an empty table gives an
    empty result. At Jaccard 0.8 a pair misses all 40 bands of 6 rows with
    probability 5e-6, less above.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed, _ = stage(docs.mapInArrow(
        lambda it: sign(it, n), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary"), "signed")
    sets = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    by_set = ["n_shingles", "fp1", "fp2"]
    classes, _ = stage(sets.groupBy(*by_set).agg(F.min("doc_id").alias("rep")), "classes")
    reps = signed.join(classes.select("rep", *by_set), (signed["doc_id"] == F.col("rep")) & (signed["fp1"] == classes["fp1"]) & (signed["fp2"] == classes["fp2"]), "left_semi")
    reps = reps.dropDuplicates(["doc_id", "fp1", "fp2"])
    keyed = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "k"))
    full = keyed.groupBy("band", "k").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("band", "k")
    bucket, _ = stage(keyed.join(full, ["band", "k"]).withColumn("bucket", F.xxhash64("band", "k")).select("bucket", "id", "n"), "buckets")
    members = few(bucket.select(F.col("id").alias("doc_id")).distinct())
    texts, _ = stage(docs.where("doc_id IS NOT NULL").join(members, "doc_id", "left_semi")
                     .groupBy("doc_id").agg(F.max("text").alias("text")), "texts")
    marks, _ = stage(reps.select("doc_id", "sketch").join(members, "doc_id", "left_semi")
                     .groupBy("doc_id").agg(F.max("sketch").alias("sketch")), "sketches")

    def side(t: DataFrame, name: str, value: str) -> DataFrame:
        return t.select(F.col("doc_id").alias(name), F.col(value).alias(f"{value[0]}{name}"))

    def links(pairs: DataFrame) -> DataFrame:
        floor = percent / 100 - 0.15  # 5.8 standard deviations of an estimate from 240 values
        some = pairs.join(side(marks, "a", "sketch"), "a").join(side(marks, "b", "sketch"), "b")
        some = some.mapInArrow(lambda it: plausible(it, floor), "a long, b long")
        return some.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b").mapInArrow(
            lambda it: confirm(it, n, percent), "a long, b long")

    def in_size(x, y):
        return (F.least(x, y) * 100 >= F.greatest(x, y) * percent)

    group = settled = None
    open_, open_path = bucket.withColumn("comp", F.col("id")), None
    for turn in range(STAR_ROUNDS + 1):
        if turn < STAR_ROUNDS:
            lead = open_.groupBy("bucket").agg(
                F.min_by(F.struct("id", "n", "comp"), F.xxhash64("id", F.lit(turn))).alias("lead"),
                F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
            pairs = open_.join(lead.select("bucket", "lead"), "bucket").where(
                (F.col("comp") != F.col("lead.comp")) & in_size(F.col("n"), F.col("lead.n")))
            pairs = pairs.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()
        else:
            main = open_.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("many")).groupBy("bucket").agg(
                F.count(F.lit(1)).alias("comps"), F.sum("many").alias("size")).where("comps > 1")
            rest, _ = stage(open_.join(main, "bucket"), "rest")
            large = rest.where(F.col("size") > SMALL).select("bucket", "id", "comp")
            blocks = None if large.isEmpty() else stage(in_blocks(large, texts, n, percent), "block-links")[0]
            rest = rest.where(F.col("size") <= SMALL)
            pairs = rest.join(rest.select("bucket", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("comp").alias("xc")), "bucket").where(
                (F.col("id") > F.col("x")) & (F.col("comp") != F.col("xc")) & in_size(F.col("n"), F.col("xn")))
            pairs = pairs.select(F.col("x").alias("a"), F.col("id").alias("b")).distinct()
        if settled is not None:
            pairs = pairs.join(settled, ["a", "b"], "left_anti")
        asked, _ = stage(pairs, "asked")
        if group is not None and asked.isEmpty() and (turn < STAR_ROUNDS or blocks is None):
            continue
        more, _ = stage(links(asked), "links")
        if turn == STAR_ROUNDS and blocks is not None:
            more = more.unionByName(blocks)
        settled = asked if settled is None else settled.unionByName(asked)
        found = more if group is None else more.unionByName(group.select(F.col("id").alias("a"), F.col("component").alias("b")))
        group, _ = stage(components(found), "groups")
        if turn < STAR_ROUNDS:
            nxt, nxt_path = stage(bucket.join(group, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("comp")), "open")
            if open_path:
                discard(spark, open_path)
            open_, open_path = nxt, nxt_path
    out = signed.join(classes.withColumnRenamed("fp1", "f1").withColumnRenamed("fp2", "f2").withColumnRenamed("n_shingles", "m"),
                      (F.col("fp1") == F.col("f1")) & (F.col("fp2") == F.col("f2")) & (F.col("n_shingles") == F.col("m")), "left")
    out = out.join(group.select(F.col("id").alias("rep"), "component"), "rep", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.when(F.col("n_shingles") > 0, F.col("rep")), "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df``, unchanged, without the documents whose group has a smaller id; a repeated row stays once."""
    groups, _ = stage(near_groups(df, key, text, n, percent).where("doc_id IS NOT NULL"), "near-groups")
    seen = groups.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("many"))
    lost, again = fresh(df, "_gone", "_twice")
    gone = few(seen.where("NOT kept").select(F.col("doc_id").alias(lost)))
    twice = few(seen.where("kept AND many > 1").select(F.col("doc_id").alias(again)))
    rest = df.join(gone, F.col(key) == F.col(lost), "left_anti")
    once = rest.join(twice, F.col(key) == F.col(again), "left_semi").dropDuplicates([key, text])
    return rest.join(twice, F.col(key) == F.col(again), "left_anti").unionByName(once)
