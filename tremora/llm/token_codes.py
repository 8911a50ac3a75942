"""Token ids in directly addressable files.

An id is split into chunks of 8 bits. Level 0 holds the lowest chunk of every id;
an id that has more is marked in the level's continuation bitmap and its next chunk
sits in the next level at the rank of that mark. A directory holds the marks before
every 512 bits, so any id is read from a few bytes without decoding its neighbours.

File, little-endian: ``b"DAC1"``, levels (u32), ids (u64), documents (u64); per
level its length (u64); document ids (i64), null flags (u8), ends (u64); then per
level chunks (u8), bitmap (u8, lowest bit first), directory (u64).
"""

from __future__ import annotations

import os
import struct
import sys
import types
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import slices, stage
from tremora.session import shared_dir, spread

END_ID = 2
FILE_IDS = 4_000_000
CACHE_WORDS = 1_000_000
ENCODE_WORDS = 2_000
WHOLE_CHARS = 256_000
BLOCK_BITS = 512
_HEAD = "<4sIQQ"
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint64)


def encode_levels(ids: np.ndarray):
    """``(chunks, bitmap, directory)`` per level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        ones = _BITS[np.pad(bitmap, (0, -len(bitmap) % (BLOCK_BITS // 8)))].reshape(-1, BLOCK_BITS // 8).sum(axis=1)
        levels.append(((rest & 255).astype(np.uint8), bitmap, np.cumsum(ones) - ones))
        if not more.any():
            return levels
        rest = rest[more] >> 8


def pack_file(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray) -> bytes:
    levels = encode_levels(ids)
    parts = [struct.pack(_HEAD, b"DAC1", len(levels), len(ids), len(doc_ids)), np.array([len(c) for c, _, _ in levels], "<u8").tobytes(),
             doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), ends.astype("<u8").tobytes()]
    for chunks, bitmap, directory in levels:
        parts += [chunks.tobytes(), bitmap.tobytes(), directory.astype("<u8").tobytes()]
    return b"".join(parts)


class TokenFile:
    """Reader over any object with ``read_at(bytes, offset)``."""

    def __init__(self, source):
        self.source = source
        magic, n_levels, self.n_ids, self.n_docs = struct.unpack(_HEAD, self._at(0, struct.calcsize(_HEAD)))
        if magic != b"DAC1":
            raise ValueError("not a token file")
        at = struct.calcsize(_HEAD)
        sizes = self._array(at, n_levels, "<u8")
        at += 8 * n_levels
        self.docs_at = at
        at += 17 * self.n_docs
        self.levels = []
        for n in map(int, sizes):
            bitmap, directory = at + n, at + n + -(-n // 8)
            self.levels.append((n, at, bitmap, directory))
            at = directory + 8 * -(-n // BLOCK_BITS)

    def _at(self, offset: int, size: int) -> bytes:
        return self.source.read_at(size, offset)

    def _array(self, offset: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(self._at(offset, n * np.dtype(kind).itemsize), kind)

    def documents(self):
        n, at = self.n_docs, self.docs_at
        return self._array(at, n, "<i8"), self._array(at + 8 * n, n, "u1").astype(bool), self._array(at + 9 * n, n, "<u8").astype(np.int64)

    def token(self, i: int) -> int:
        """The id at place ``i``, from one chunk, one block of marks and one directory entry per level."""
        value = shift = 0
        for _, chunks, bitmap, directory in self.levels:
            value |= self._at(chunks + i, 1)[0] << shift
            block = i // BLOCK_BITS
            first = block * BLOCK_BITS // 8
            marks = int.from_bytes(self._at(bitmap + first, i // 8 - first + 1), "little")
            k = i - block * BLOCK_BITS
            if not marks >> k & 1:
                return value
            i = int(self._array(directory + 8 * block, 1, "<u8")[0]) + (marks & ((1 << k) - 1)).bit_count()
            shift += 8
        raise ValueError("mark without a chunk")

    def ids(self) -> np.ndarray:
        """All ids, decoded from the last level up."""
        value = np.zeros(0, np.uint32)
        for n, chunks, bitmap, _ in reversed(self.levels):
            here = self._array(chunks, n, "u1").astype(np.uint32)
            more = np.unpackbits(self._array(bitmap, -(-n // 8), "u1"), bitorder="little")[:n].astype(bool)
            here[more] |= value << 8
            value = here
        return value


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

    The byte-level pattern never joins what stands before a space that follows a
    character other than a space, so a text without double spaces falls into words
    (each with the space before it) whose ids can be kept. New words are encoded
    many at a time as one text; ids of tokens that begin with a space tell where
    the words begin. Texts with double spaces or an added token go through the
    library whole. A store of more than ``CACHE_WORDS`` words keeps those that a later
    batch asked for again; words seen once, most of them, leave.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        shared = sys.modules.setdefault("_token_words", types.ModuleType("_token_words"))
        if path not in shared.__dict__:
            begins = np.zeros(max(self.tool.get_vocab().values()) + 1, bool)
            begins[[i for t, i in self.tool.get_vocab().items() if t[:1] == "\u0120"]] = True
            shared.__dict__[path] = ({}, set(), begins)
        self.known, self.again, self.begins = shared.__dict__[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that the library takes whole, in few calls."""
        out, some, size = [], [], 0
        for t in [*texts, None]:
            if some and (t is None or size > WHOLE_CHARS):
                out += [np.array(e.ids, "<u4").tobytes() for e in self.tool.encode_batch_fast(some, add_special_tokens=False)]
                some, size = [], 0
            if t is not None:
                some.append(t)
                size += len(t)
        return out

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), ENCODE_WORDS):
            some = words[i:i + ENCODE_WORDS]
            ids = np.array(self.tool.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            raw, cut = ids.tobytes(), [*(4 * np.flatnonzero(self.begins[ids])).tolist(), 4 * len(ids)]
            for w, x, y in zip(some, cut[:-1], cut[1:], strict=True):
                self.known[w] = raw[x:y]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > CACHE_WORDS:
            held = {} if len(self.again) > CACHE_WORDS // 2 else {w: self.known[w] for w in self.again}
            self.known.clear()
            self.again.clear()
            self.known.update(held)
        apart = np.array(["  " not in t and not any(a in t for a in self.added) for t in texts], bool)
        whole = iter(self.many([t for t, w in zip(texts, apart) if not w]))
        split = iter(self.by_words([t for t, w in zip(texts, apart) if w]))
        return [next(split if w else whole) for w in apart]

    def by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without double spaces: every distinct word of the batch is looked up once, places are gathered in arrays."""
        if not texts:
            return []
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        first = words.offsets.to_numpy()[:-1]
        flat = words.values
        heads = self.many(flat.take(pa.array(first)).to_pylist())
        later = np.ones(len(flat), bool)
        later[first] = False  # the first word of a text has no space before it
        coded = flat.filter(pa.array(later)).dictionary_encode()
        distinct, where = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self.known[""] = self.whole(" ")  # a space that ends a text
        raw = list(map(self.known.get, distinct))
        unknown = [i for i, r in enumerate(raw) if r is None]
        self.learn([distinct[i] for i in unknown])
        for i in unknown:
            raw[i] = self.known[distinct[i]]
        new = set(unknown)
        self.again.update(w for i, w in enumerate(distinct) if i not in new)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        base = np.cumsum(size) - size
        n = size[where]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(base[where] - ends[:-1], n) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(raw), "<u4")[place].tobytes()
        cut = (4 * ends[words.offsets.to_numpy() - np.arange(len(texts) + 1)]).tolist()
        return [h + ids[x:y] for h, x, y in zip(heads, cut[:-1], cut[1:])]


def open_uri(uri: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_files(batches, folder: str, tokenizer: str, file_ids: int):
    """Encode sorted rows into files of about ``file_ids`` ids; one row per file."""
    fs, base = open_uri(folder)
    encode, part = Encoder(tokenizer), None
    ids: list = []
    docs: list = []
    size = seq = 0
    end = struct.pack("<I", END_ID)

    def flush():
        nonlocal ids, docs, size, seq
        name = f"{base}/{uuid.uuid4().hex}.dac"
        key, null, n = zip(*docs)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(name) as out:
            out.write(pack_file(np.frombuffer(b"".join(ids), "<u4"), np.array(key), np.array(null), np.cumsum(n)))
        row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "name": name.rsplit("/", 1)[1], "n_ids": size, "n_docs": len(docs)}],
                                         pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))
        ids, docs, size, seq = [], [], 0, seq + 1
        return row

    for batch in batches:
        for piece in slices(batch, "text", limit=1 << 20):
            part = piece.column("part")[0].as_py()
            texts = [t or "" for t in piece.column("text").to_pylist()]
            for key, null, code in zip(piece.column("doc_id").to_pylist(), piece.column("missing").to_pylist(), encode(texts)):
                ids.append(code + end)
                docs.append((key, null, len(code) // 4 + 1))
                size += docs[-1][2]
                if size >= file_ids:
                    yield flush()
    if docs:
        yield flush()


def write_tokens(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", folder: str | None = None,
                 file_ids: int = FILE_IDS) -> tuple[DataFrame, str]:
    """Write every text of ``df`` and return the files in order, with ``start``, and their folder.

    Rows are range-partitioned by key (null first, equal keys by text), so file
    order is key order; a null text is empty and every document ends with id
    ``END_ID``. File names are new for every attempt of a task and only names of
    successful attempts are listed. The list has one row per ``file_ids`` ids.
    ``folder`` must be a URI that every executor can write (default: in the shared folder).
    """
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/tremora-llm/tokens-{uuid.uuid4().hex}"
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-2**63)).alias("doc_id"), F.col(key).isNull().alias("missing"),
                     F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(F.desc("missing"), "doc_id").sortWithinPartitions(F.desc("missing"), "doc_id", "text")
    rows = rows.withColumn("part", F.spark_partition_id())
    files, _ = stage(rows.mapInArrow(lambda it: write_files(it, folder, tokenizer, file_ids),
                                     "part int, seq int, name string, n_ids long, n_docs long"), "token-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), folder


def read_files(frames, folder: str):
    fs, base = open_uri(folder)
    for pdf in frames:
        for name, start in zip(pdf["name"], pdf["start"]):
            with fs.open_input_file(f"{base}/{name}") as source:
                f = TokenFile(source)
                key, null, ends = f.documents()
                raw = memoryview(f.ids().astype("<u4").tobytes())
            begin = np.concatenate([[0], ends[:-1]])
            yield pd.DataFrame({
                "doc_id": key, "missing": null, "start": start + begin, "n_tokens": ends - begin,
                "ids_crc32": [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begin, ends)]})


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, decoded from the files."""
    out = spread(files.select("name", "start"), "name").mapInPandas(  # an explicit count: the list is tiny, the work is not
        lambda it: read_files(it, folder), "doc_id long, missing boolean, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).drop("missing")
