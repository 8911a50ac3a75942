"""Benchmark decontamination by pigeonhole edit matching.

With an error budget of ``e`` edits a test item is cut into ``e + 1`` pieces; any
text that holds the item within the budget holds one piece unchanged. All pieces
of a block of items are found in one pass over a text, and each place they point
to is verified with Myers' bit-parallel edit distance, where the item is the
pattern and the distance is that of its best match ending anywhere.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_PER_EDIT = 25
BLOCK_CHARS = 4_000_000
_UPPER = str.maketrans({c: c + 32 for c in range(65, 91)})
_GAPS = re.compile(r"\s+")


def plain(text: str | None) -> str:
    """A-Z lower-cased, runs of white space as one space, trimmed."""
    return _GAPS.sub(" ", text or "").strip().translate(_UPPER)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal length with their offsets."""
    cut = [i * len(item) // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:]) if b > a]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to a substring of ``text``, and where that substring ends."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        where[ch] = where.get(ch, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, ch in enumerate(text):
        eq = where.get(ch, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        plus, minus = down | (full & ~(d0 | up)), d0 & up
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(d0 | plus)), d0 & plus
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Piece automaton over a block of ``(item_id, text)``."""

    def __init__(self, items, chars_per_edit: int):
        self.items, self.auto = [], ahocorasick.Automaton()
        at: dict[str, list] = {}
        for item_id, text in items:
            flat = plain(text)
            if not any(c.isalnum() for c in flat):
                continue
            edits = len(flat) // chars_per_edit
            for offset, piece in pieces(flat, edits):
                at.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, flat, edits))
        for piece, places in at.items():
            self.auto.add_word(piece, (len(piece), places))
        if at:
            self.auto.make_automaton()

    def find(self, text: str | None) -> dict:
        """``item_id -> (distance, end in the plain text)`` of the items that ``text`` holds."""
        if not self.items or not text:
            return {}
        flat = plain(text)
        starts: dict[int, set] = {}
        for end, (size, places) in self.auto.iter(flat):
            for item, offset in places:
                starts.setdefault(item, set()).add(end + 1 - size - offset)
        out = {}
        for item, places in starts.items():
            item_id, pattern, edits = self.items[item]
            begin = stop = None
            for p in [*sorted(places), None]:
                if begin is not None and (p is None or p - edits > stop):
                    distance, end = myers(pattern, flat[begin:stop])
                    if distance <= edits and (item_id not in out or (distance, begin + end) < out[item_id]):
                        out[item_id] = (distance, begin + end)
                    begin = None
                if p is not None:
                    begin = max(0, p - edits) if begin is None else begin
                    stop = p + len(pattern) + edits
        return out


def item_blocks(items: DataFrame, key: str, text: str, most: int):
    """The test set in blocks of bounded text, read one partition at a time."""
    block, size = [], 0
    for r in items.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where("k IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        block.append((r["k"], r["t"]))
        size += len(r["t"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, kept, n_items, item_ids, distances`` for every row of ``df``.

    A row is not kept if its text holds a test item within one edit (insertion,
    deletion, substitution of a character) per ``chars_per_edit`` characters of the
    item, both with A-Z lower-cased and white space runs as one space. Items that
    are null or without a letter or digit match nothing; an item given twice counts
    once. Null and empty texts hold nothing. Repeated rows are judged alike. Other
    columns are not read; empty tables give empty results or keep all rows.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                     F.array().cast("array<long>").alias("item_ids"), F.array().cast("array<int>").alias("distances"))
    blocks = item_blocks(items, item_key, item_text, block_chars)
    block = next(blocks, [])
    while block:
        after = next(blocks, [])

        def match(frames, block=block, more=bool(after)):
            matcher = Matcher(block, chars_per_edit)
            for pdf in frames:
                found = [matcher.find(t) for t in pdf["text"]]
                merged = [sorted({**dict(zip(a, d)), **{k: v[0] for k, v in f.items()}}.items())
                          for a, d, f in zip(pdf["item_ids"], pdf["distances"], found)]
                pdf = pdf.assign(item_ids=[[k for k, _ in m] for m in merged], distances=[[v for _, v in m] for m in merged])
                yield pdf if more else pdf.assign(text=None)  # the text goes on to a further block only

        rows = rows.mapInPandas(match, rows.schema)
        block = after
    return rows.select("doc_id", (F.size("item_ids") == 0).alias("kept"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "distances")


def clean(df: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
          chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``df``, unchanged, that hold no test item."""
    for block in item_blocks(items, item_key, item_text, block_chars):
        def keep(batches, block=block):
            matcher = Matcher(block, chars_per_edit)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(t) for t in b.column(text).to_pylist()], pa.bool_()))

        df = df.mapInArrow(keep, df.schema)
    return df
