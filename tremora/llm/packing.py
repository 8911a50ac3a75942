"""Best-fit packing of documents into fixed-length training sequences under conflicts.

No bin may hold two documents of one source, of one cluster or of one text. The
documents of a shard are placed longest first. Bins are ordered by what is left in
them; per source, per cluster and per residual a bitmap has one bit for every bin,
so one expression tests all bins of a residual. The search starts at the smallest
residual that fits and goes on to its successors until a compatible bin is found:
the tightest one. Shards are drawn by hash and of bounded size, so a hot source or
cluster spreads over all of them.
"""

from __future__ import annotations

import json
import re
import sys
import types
from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.alignment import WORD_PATTERN, byte_of_letter
from tremora.llm.common import components, slices, stage
from tremora.llm.near_dedup import near_groups
from tremora.llm.token_codes import Encoder

SHARD = 20_000
CAPACITY = 2_048
LONG = 2_000
_GAP = re.compile(rf"\s{{{LONG}}}")


def best_fit(length, source, cluster, capacity: int, same=None) -> list[int]:
    """Bin number per item; items come in the order in which they are placed. Items equal in ``same`` conflict as well."""
    by_residual: dict[int, int] = {}
    residuals: list[int] = []
    residual: list[int] = []
    sources: dict = {}
    clusters: dict = {}
    texts: dict = {}
    out = []
    for n, s, c, t in zip(length, source, cluster, same or [None] * len(length)):
        held = [(by, v) for by, v in ((sources, s), (clusters, c), (texts, t)) if v is not None]
        taken = 0
        for by, v in held:
            taken |= by.get(v, 0)
        i = bisect_left(residuals, n)
        while i < len(residuals) and not by_residual[residuals[i]] & ~taken:
            i += 1
        if i < len(residuals):
            r = residuals[i]
            free = by_residual[r] & ~taken
            bit = free & -free
            by_residual[r] ^= bit
            if not by_residual[r]:
                del by_residual[r], residuals[i]
            b, left = bit.bit_length() - 1, r - n
        else:
            b, left = len(residual), capacity - n
            bit = 1 << b
            residual.append(left)
        residual[b] = left
        if left in by_residual:
            by_residual[left] |= bit
        elif left > 0:
            by_residual[left] = bit
            insort(residuals, left)
        for by, v in held:
            by[v] = by.get(v, 0) | bit
        out.append(b)
    return out


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "missing", "doc_id", "copy", "first_token"], ascending=[False, True, True, True, True], kind="stable")
    blank = lambda c: [None if pd.isna(v) else v for v in pdf[c]]
    pdf = pdf.assign(bin=best_fit(pdf["n_tokens"].tolist(), blank("source"), blank("cluster"), capacity, blank("same")))
    pdf["bin_tokens"] = pdf.groupby("bin")["n_tokens"].transform("sum")
    pdf["position"] = pdf.groupby("bin").cumcount()
    return pdf[["shard", "bin", "position", "missing", "doc_id", "copy", "first_token", "n_tokens", "bin_tokens"]]


def word_count(text):
    """Words between white space, plus one for the end of the document."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(flat == "", F.lit(1)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 2).cast("long")


class Counter:
    """Numbers of token ids of whole texts.

    The ids of a byte-level vocabulary in merge order are byte-pair ranks, whose
    encoder counts several times faster than the tokenizers library. Texts that hold
    an added token or a stretch of ``LONG`` characters without change between word
    and white space, and vocabularies of another kind, go through the library.
    """

    def __init__(self, path: str):
        import tiktoken

        self.library = Encoder(path)
        self.ranked = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or "merges" not in model:
            return
        vocab, added = model["vocab"], set(self.library.added)
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged == sorted(merged):
            letter = byte_of_letter()
            ranks = {bytes(letter[c] for c in t): i for t, i in vocab.items() if t not in added}
            self.ranked = tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> Counter:
        """The counter of this worker."""
        held = sys.modules.setdefault("_token_counters", types.ModuleType("_token_counters"))
        if path not in held.__dict__:
            held.__dict__[path] = cls(path)
        return held.__dict__[path]

    def plain(self, text: str) -> bool:
        return (self.ranked is not None and not any(a in text for a in self.library.added) and max(map(len, text.split()), default=0) < LONG
                and not _GAP.search(text))

    def __call__(self, texts: list[str]) -> list[int]:
        out = [len(self.ranked.encode_ordinary(t)) if self.plain(t) else None for t in texts]
        rest = iter(self.library([t for t, n in zip(texts, out) if n is None]))
        return [len(next(rest)) // 4 if n is None else n for n in out]


def token_count(batches, tokenizer: str):
    """Token ids of every text, plus one for the end of the document."""
    count = Counter.of(tokenizer)
    for batch in batches:
        for part in slices(batch, "text", limit=2 << 20):
            total = [n + 1 for n in count([t or "" for t in part.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("source"), part.column("cluster"), part.column("same"), pa.array(total, pa.int64())],
                ["doc_id", "source", "cluster", "same", "total"])


def text_cluster(text):
    """Texts equal up to case and white space form one cluster; null and blank texts none."""
    flat = F.lower(F.regexp_replace(text, r"\s+", ""))
    return F.when(flat != "", F.xxhash64(flat))


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None,
         capacity: int = CAPACITY, shard_rows: int = SHARD, tokenizer: str | None = None) -> DataFrame:
    """``shard, bin, position, doc_id, copy, first_token, n_tokens, bin_tokens`` for every piece of every row.

    A row is one item of its tokens plus an end mark: ids of ``tokenizer`` (a file
    of the tokenizers library) where given, else words between white space, which
    say nothing of a text without spaces. A longer one is cut into pieces of
    ``capacity`` tokens and a rest; pieces are dealt to shards one by one. Nothing is dropped: a null or empty
    text is one token. A null source or cluster conflicts with nothing. Rows that
    repeat a key are numbered by ``copy`` and, their texts being equal, never share
    a bin. Nor do texts equal up to case and white space, whatever their cluster.
    Other columns are not read; an empty table gives an empty result.
    """
    items, _ = stage(lengths(df, key, text, source, cluster, tokenizer), "pack-lengths")
    return deal(items, capacity, shard_rows)


def lengths(df: DataFrame, key: str, text: str, source: str, cluster: str | None, tokenizer: str | None) -> DataFrame:
    """``doc_id, source, cluster, same, total``: what packing knows of every row, its text left behind."""
    clusters = F.col(cluster) if cluster else F.lit(None)
    items = df.select(
        F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        clusters.cast("string").alias("cluster"), text_cluster(F.col(text)).alias("same"), F.col(text).cast("string").alias("text"))
    if tokenizer:
        return items.mapInArrow(lambda it: token_count(it, tokenizer), "doc_id long, source string, cluster string, same long, total long")
    return items.select("doc_id", "source", "cluster", "same", word_count(F.col("text")).alias("total"))


def deal(items: DataFrame, capacity: int, shard_rows: int) -> DataFrame:
    """Pieces of the staged ``lengths``, dealt to shards and packed there."""
    n_pieces = items.agg(F.coalesce(F.sum(F.ceil(F.col("total") / capacity)), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-n_pieces // shard_rows))
    items = items.groupBy("doc_id", "source", "cluster", "same", "total").agg(F.count(F.lit(1)).alias("rows"))
    items = items.select("doc_id", "source", "cluster", "same", "total", F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1)).alias("copy"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(capacity).cast("long"))
    pieces = items.select("*", F.explode(starts).alias("first_token"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "total", "first_token"), F.lit(shards)).cast("int"))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("first_token")))
    pieces = pieces.withColumns({"missing": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    packed = pieces.groupBy("shard").applyInPandas(
        lambda pdf: pack_shard(pdf, capacity),
        "shard int, bin long, position long, missing boolean, doc_id long, copy int, first_token long, n_tokens long, bin_tokens long")
    return packed.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).drop("missing")


def clusters_of(groups: DataFrame) -> DataFrame:
    """``id, label`` from the ``doc_id, component_id`` of every row.

    An id whose rows have different texts belongs to several groups, which then
    count as one; only the labels of such groups are joined up.
    """
    label = groups.groupBy(F.col("doc_id").alias("id")).agg(F.min("component_id").alias("label"), F.max("component_id").alias("other"))
    label, _ = stage(label, "pack-labels")
    split = label.where("label <> other")
    if split.isEmpty():
        return label.select("id", "label")
    ids = split.select("id")
    edges = groups.select(F.col("doc_id").alias("id"), "component_id").join(ids, "id", "left_semi").join(split.select("id", "label"), "id")
    joined, _ = stage(components(edges.select(F.col("label").alias("a"), F.col("component_id").alias("b"))), "pack-joined")
    joined = joined.select(F.col("id").alias("label"), "component")
    return label.join(joined, "label", "left").select("id", F.coalesce("component", "label").alias("label"))


def pack_apart(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY,
               shard_rows: int = SHARD, tokenizer: str | None = None) -> DataFrame:
    """``pack`` with the groups of near copies (five-word shingles, Jaccard 0.8) of ``df`` as clusters.

    Texts are read where they lie, once for their tokens and once for their groups;
    clusters meet the token counts, never the texts. Odd rows count as in ``pack``.
    """
    items, _ = stage(lengths(df, key, text, source, None, tokenizer), "pack-counts")
    groups, _ = stage(near_groups(df, key, text).where("doc_id IS NOT NULL").select("doc_id", "component_id"), "pack-groups")
    near = clusters_of(groups).withColumnRenamed("id", "doc_id")
    items = items.join(near, "doc_id", "left").select("doc_id", "source", F.col("label").cast("string").alias("cluster"), "same", "total")
    return deal(stage(items, "pack-lengths")[0], capacity, shard_rows)
