"""Alignment of two tokenizers over the same texts.

Every text is encoded by a byte-level tokenizer (A) and a sentence-piece one (B).
Where a token of each ends at the same byte, the text is cut; the tokens between two
cuts form a group, and all A-B pairs inside a group are links. How many documents
hold an id pair linked is counted over the whole corpus, and each document's links
are rated by these counts.

Inside a task everything is an Arrow table: nested ids are flattened beside the
indices of their documents, byte lengths become ends by a cumulative sum less the
sum before the document, a hash join on (document, end) finds the cuts, a hash join
on the group the links, and ``group_by`` the counts of a chunk of texts. Spark adds
the counts up. A chunk then asks for the totals of its own pairs only: chunk and pair
meet in a join whose keys carry one row a chunk, and the answers come back to the
chunk, so no table of all pairs is sent to every task.

``align`` gives the groups and links of every text, ``rate`` the columns that need
counts over the corpus; it keeps the links in a table, for they are needed twice.

Defined results: texts that are null, empty or not given back byte by byte by both
tokenizers have no tokens, zero counts and no groups; strings of special tokens are
plain text; a null key stays null; repeated rows are documents of their own; an
empty table gives no rows. Only the key and text columns are read, whatever others
are called. A task holds a chunk of about 2 MB of texts, or one longer text.
"""

from __future__ import annotations

import json
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import slices, stage

CHUNK_BYTES = 2 << 20
ENCODE_BYTES = 256 << 10
BLOCK_LINKS = 2_000_000
PAIRS_A_ROW = 1_000
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: words of byte-level vocabularies
_IDS = pa.list_(pa.int32())
_PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
_SUMS = ("n_a", "n_b", "n_groups", "n_links")
CODED = pa.schema([("chunk", pa.int64()), ("key", pa.int64()), *[(c, pa.int64()) for c in _SUMS], ("groups", pa.string()),
                   ("link_a", _IDS), ("link_b", _IDS), ("link_m", _IDS), ("pairs", pa.list_(_PAIR))])
CODED_SQL = ("chunk long, key long, n_a long, n_b long, n_groups long, n_links long, groups string, link_a array<int>, link_b array<int>, "
             "link_m array<int>, pairs array<struct<a: int, b: int, n: int>>")


def byte_of_letter() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes: visible Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Both tokenizers and the bytes of their entries; built once per worker.

    The ids of a byte-level vocabulary rise in the order of its merges, so the
    entries themselves are the ranks of a byte-pair encoder; a vocabulary of another
    order, or with another way to split words, is refused.
    """

    def __init__(self, a_file: str, b_file: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        with open(a_file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        split = spec["pre_tokenizer"]
        if merged != sorted(merged) or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
            raise ValueError("not a plain byte-level vocabulary in merge order")
        letter = byte_of_letter()
        ranks = {bytes(letter[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        entry = [b""] * (max(vocab.values()) + 1)
        for t, i in ranks.items():
            entry[i] = t
        self.a_bytes = pa.array(entry, pa.large_binary())
        self.b = SentencePieceProcessor(model_file=b_file)
        piece = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                                 for i, p in enumerate(piece)], pa.large_binary())
        self.digits = pa.array([str(i) for i in range(max(len(entry), len(piece)))], pa.large_string())

    @classmethod
    def of(cls, a_file: str, b_file: str) -> Tokens:
        held = sys.modules.setdefault("_aligned_tokens", types.ModuleType("_aligned_tokens"))
        if (a_file, b_file) not in held.__dict__:
            held.__dict__[a_file, b_file] = cls(a_file, b_file)
        return held.__dict__[a_file, b_file]

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Nested ids of all texts; only those of about ``ENCODE_BYTES`` of text are Python objects at a time."""
        nested = pa.large_list(pa.int32())
        a, b = [pa.array([], nested)], [pa.array([], nested)]
        for part in slices(pa.record_batch({"text": texts}), "text", limit=ENCODE_BYTES):
            some = part.column("text").to_pylist()
            a.append(pa.array([self.a.encode_ordinary(" " + t) for t in some], nested))
            b.append(pa.array(self.b.encode(some, num_threads=1), nested))
        return pa.concat_arrays(a), pa.concat_arrays(b)


def spelled(ids: pa.Array, entries: pa.Array) -> pa.Array:
    """Bytes of each document's tokens, joined."""
    return pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets, entries.take(ids.values)), pa.scalar(b"", pa.large_binary()))


def token_table(ids: pa.Array, entries: pa.Array, valid: pa.Array) -> pa.Table:
    """``doc, id, end, at`` of the tokens of valid documents; ``end`` counts bytes from the document's start."""
    doc, flat = pc.list_parent_indices(ids), pc.list_flatten(ids)
    keep = valid.take(doc)
    doc, flat = doc.filter(keep), flat.filter(keep)
    total = pc.cumulative_sum(pc.binary_length(entries.take(flat)).cast(pa.int64()))
    first = np.flatnonzero(np.diff(doc.to_numpy(), prepend=-1))
    before = np.append(0, total.to_numpy())[first]
    own = np.repeat(before, np.diff(np.append(first, len(doc))))
    return pa.table({"doc": doc, "id": flat, "end": pc.subtract(total, pa.array(own, pa.int64())), "at": pa.array(np.arange(len(doc)))})


def cut(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of the groups and how many A and B tokens each holds."""
    def side(t, name):
        return pa.table({"stop": pc.add(pc.shift_left(t["doc"], pa.scalar(40, pa.int64())), t["end"]), name: t["at"]})  # (document, end) as one number

    both = side(a, "a").join(side(b, "b"), "stop", join_type="inner", use_threads=False)
    at, other = np.sort(both["a"].to_numpy()), np.sort(both["b"].to_numpy())  # both rise along the texts
    return a["doc"].to_numpy()[at], np.diff(at, prepend=-1), np.diff(other, prepend=-1)


def links(a: pa.Array, b: pa.Array, doc: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> pa.Table:
    """``doc, a, b, m`` by document: id pairs linked in it and how often, from tokens dealt to groups."""
    if not len(doc):
        return pa.table({"doc": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "m": pa.array([], pa.int64())})
    a, b = a.cast(pa.int64()), b.cast(pa.int64())
    wide = pc.max(b).as_py() + 1
    page = (pc.max(a).as_py() + 1) * wide
    group_a, group_b = np.repeat(np.arange(len(doc)), in_a), np.repeat(np.arange(len(doc)), in_b)
    single = (in_a == 1) & (in_b == 1)

    def summed(key, m):
        return pa.table({"k": key, "m": m}).group_by("k", use_threads=False).aggregate([("m", "sum")]).rename_columns(["k", "m"])

    alone_a, alone_b = a.filter(pa.array(single[group_a])), b.filter(pa.array(single[group_b]))
    key = pc.add(pc.add(pc.multiply(alone_a, wide), alone_b), pa.array(doc[single] * page))
    parts = [summed(key, pa.array(np.ones(len(key), np.int64)))]
    rest = np.flatnonzero(~single)
    size = np.cumsum((in_a * in_b)[rest])
    sides = []
    for name, ids, group in (("a", a, group_a), ("b", b, group_b)):
        t = pa.table({"g": group, name: ids}).filter(pa.array(~single[group]))
        sides.append(t.group_by(["g", name], use_threads=False).aggregate([([], "count_all")]).rename_columns(["g", name, f"m_{name}"]).sort_by("g"))
    lo = 0
    while lo < len(rest):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BLOCK_LINKS, "right")))
        met = [t.slice(x, y - x) for t in sides for x, y in [np.searchsorted(t["g"].to_numpy(), [rest[lo], rest[hi - 1] + 1])]]
        met = met[0].join(met[1], "g", join_type="inner", use_threads=False)
        key = pc.add(pc.add(pc.multiply(met["a"], wide), met["b"]), pc.multiply(pa.array(doc).take(met["g"]), page))
        parts.append(summed(key, pc.multiply(met["m_a"], met["m_b"])))
        lo = hi
    every = pa.concat_tables(parts)
    every = summed(every["k"], every["m"]).sort_by("k")
    k = every["k"].to_numpy()
    return pa.table({"doc": k // page, "a": k % page // wide, "b": k % wide, "m": every["m"]})


def as_text(ids: list[pa.Array], sizes: list[np.ndarray], doc: np.ndarray, n_docs: int, digits: pa.Array) -> pa.Array:
    """Groups of each document as ``a1,a2|b1;a3|b2,b3``."""
    side = []
    for values, size in zip(ids, sizes):
        off = pa.array(np.append(0, np.cumsum(size)), pa.int64())
        side.append(pc.binary_join(pa.LargeListArray.from_arrays(off, digits.take(values)), pa.scalar(",", pa.large_string())))
    group = pc.binary_join_element_wise(*side, pa.scalar("|", pa.large_string()))
    off = pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(off, group), pa.scalar(";", pa.large_string())).cast(pa.string())


def as_lists(values, doc: np.ndarray, n_docs: int) -> pa.Array:
    """One list a document of ``values`` in document order."""
    off = np.searchsorted(doc, np.arange(n_docs + 1))
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, pa.int32()))


def one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def code_chunks(batches, a_file: str, b_file: str):
    """Encoded documents of each chunk, then the chunk's id pairs with the number of its documents that link them."""
    tool, seq = Tokens.of(a_file, b_file), 0
    for batch in batches:
        for piece in slices(batch, "text", limit=CHUNK_BYTES):
            chunk = (TaskContext.get().partitionId() << 32) + seq
            seq += 1
            text = pc.fill_null(piece.column("text"), "").cast(pa.large_string())
            ids_a, ids_b = tool.encode(text)
            whole = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())).cast(pa.large_binary())
            valid = pc.and_(pc.equal(spelled(ids_a, tool.a_bytes), whole), pc.equal(spelled(ids_b, tool.b_bytes), whole))
            valid = pc.and_(valid, pc.greater(pc.binary_length(text), 0))
            a, b = token_table(ids_a, tool.a_bytes, valid), token_table(ids_b, tool.b_bytes, valid)
            doc, in_a, in_b = cut(a, b)
            id_a, id_b, n = one(a["id"]), one(b["id"]), piece.num_rows
            held = links(id_a, id_b, doc, in_a, in_b)
            owner = held["doc"].to_numpy()
            row = {"chunk": np.full(n, chunk), "key": piece.column("key"), "pairs": pa.nulls(n, CODED.field("pairs").type),
                   "n_a": np.bincount(doc, in_a, n).astype(np.int64), "n_b": np.bincount(doc, in_b, n).astype(np.int64),
                   "n_groups": np.bincount(doc, minlength=n), "n_links": np.bincount(doc, in_a * in_b, n).astype(np.int64),
                   "groups": as_text([id_a, id_b], [in_a, in_b], doc, n, tool.digits),
                   **{f"link_{c}": as_lists(one(held[c]).cast(pa.int32()), owner, n) for c in "abm"}}
            yield pa.RecordBatch.from_arrays([v if isinstance(v := row[f.name], pa.Array) else pa.array(v, f.type) for f in CODED], schema=CODED)
            held = held.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
            size = held.num_rows
            off = pa.array(np.append(np.arange(0, size, PAIRS_A_ROW), size), pa.int32())
            pair = pa.StructArray.from_arrays([one(held[c]).cast(pa.int32()) for c in ("a", "b", "count_all")], fields=list(_PAIR))
            rows = len(off) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, chunk))] + [pa.nulls(rows, f.type) for f in CODED if f.name not in ("chunk", "pairs")]
                + [pa.ListArray.from_arrays(off, pair)], schema=CODED)


def rate_chunk(docs: pa.Table, total: pa.Table) -> pa.Table:
    """``n_best, count_sum`` of the documents of a chunk, beside their other columns, by ``total(a, b, n, best)``."""
    docs = docs.combine_chunks()
    a, b, m = (pc.list_flatten(one(docs[f"link_{c}"])) for c in "abm")
    doc = one(pc.list_parent_indices(one(docs["link_a"]))).cast(pa.int64())
    held = pa.table({"doc": doc, "a": a, "b": b, "m": pc.cast(m, pa.int64())}).join(
        total.select(["a", "b", "n", "best"]), ["a", "b"], join_type="inner", use_threads=False)
    rated = pa.table({"doc": held["doc"], "n_best": pc.multiply(held["m"], held["best"].cast(pa.int64())), "count_sum": pc.multiply(held["m"], held["n"])})
    rated = rated.group_by("doc", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
    out = docs.drop_columns(["chunk", "link_a", "link_b", "link_m"])
    for c in ("n_best", "count_sum"):
        v = np.zeros(docs.num_rows, np.int64)
        v[rated["doc"].to_numpy()] = rated[f"{c}_sum"].to_numpy()
        out = out.append_column(c, pa.array(v))
    return out


def align(df: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``chunk, key, n_a, n_b, n_groups, n_links, groups, link_a, link_b, link_m`` per row of ``df``, and rows with the
    ``pairs`` of each chunk only.

    ``groups`` lists A ids, ``|``, B ids of each group, groups parted by ``;``. The
    lists ``link_…`` hold each linked id pair of the text once and how often it is linked.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: code_chunks(it, a_file, b_file), CODED_SQL)


def rate(aligned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of texts out of ``align`` (which may have gained or lost columns) without chunk and lists, with ``n_best`` and ``count_sum``."""
    coded, _ = stage(aligned, "aligned")
    asked = coded.where("pairs IS NOT NULL").select(F.col("chunk").alias("asker"), F.explode("pairs").alias("p")).select("asker", "p.a", "p.b", "p.n")
    total = asked.groupBy("a", "b").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy("a")  # at most one row per id of B
    total = total.withColumn("best", F.col("n") == F.max("n").over(of_a))
    answers = asked.select("asker", "a", "b").join(total, ["a", "b"])
    docs = coded.where("pairs IS NULL").drop("pairs")
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("chunk", "link_a", "link_b", "link_m")]
    out = docs.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(rate_chunk, ", ".join([*kept, "n_best long", "count_sum long"]))
    return out.withColumnRenamed("key", key)
