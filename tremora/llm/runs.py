"""Periodic runs of words.

A run is a stretch with smallest period ``q`` that no neighbouring word extends.
By the runs theorem each run of exponent 2 or more has, under one of the two
opposite orders of the alphabet, a root that is the longest Lyndon word at its
place. The first phase of Baier's suffix sorter groups suffixes by exactly these
words: it takes the highest group left, appends every block of its members to the
suffix before the block and puts the lengthened suffixes into new groups directly
above their old one. A member's word ends where its right neighbour begins when its
group is taken. Roots that repeat are extended both ways by longest common
extensions over prefix hashes, and every run found is compared word by word.

A run of ``m`` periods holds each of its words ``m`` times, so words that occur less
often in their stretch are in no run: they cut the text, and again within the
parts, until hardly a word goes. Only what is left is grouped. All parts of a slice of
texts, under both orders, advance in step: a round takes one group of each.

Defined results: a null or empty text has no runs and collapses to an empty text; a
null key stays null; repeated rows are answered one by one; an empty table gives no
rows. Only the key and text columns are read, whatever others are called. A task
holds one slice of about 4 MB of texts, or one longer text, at a time.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import slices

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first[0], first[0]+1, …`` (``size[0]`` numbers), then the same for every further entry."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def frequent_stretches(word: np.ndarray, row: np.ndarray, length: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``word`` that may lie in a run, and the number of the stretch each is in."""
    at, part = np.arange(len(word)), row
    while len(at):
        key = part * (int(word.max()) + 1) + word[at]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = count[which] >= times
        before, at, part = len(at), at[keep], part[keep]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(part) != 0)
        part = np.cumsum(new) - 1
        long = (np.bincount(part) >= length)[part] if len(at) else keep[:0]
        at, part = at[long], part[long]
        part = np.unique(part, return_inverse=True)[1]
        if len(at) > 0.9 * before:  # stopping early only leaves more words to group
            break
    return at, part


def lyndon_array(symbol: np.ndarray, string: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at every place of many strings, by Baier's grouping.

    ``string`` numbers the string of each place, ascending from 0. Groups are
    intervals of ``order``, lowest first within a string, and are named by where
    they begin; the interval that ends at ``top`` is the highest group left.
    """
    n = len(symbol)
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(string, prepend=-1))
    left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
    left[first] = n
    left = np.append(left, n)
    end = np.append(first[1:], n)
    order = np.lexsort((symbol, string))
    new = np.ones(n, bool)
    new[1:] = (np.diff(symbol[order]) != 0) | (np.diff(string[order]) != 0)
    begin = np.flatnonzero(new)
    size = np.zeros(n + 1, np.int64)
    size[begin] = np.diff(np.append(begin, n))
    place, group = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order] = np.arange(n)
    group[order] = np.repeat(begin, size[begin])
    last = np.repeat(end, end - first)  # where the string of a place ends
    moved = np.zeros(n, bool)
    out = np.empty(n, np.int64)
    low, top = first, end - 1
    while len(top):
        start = group[order[top]]
        member = np.sort(order[ragged(start, top - start + 1)])
        out[member] = right[member] - member
        head = np.ones(len(member), bool)
        head[1:] = left[member[1:]] != member[:-1]
        at = np.flatnonzero(head)
        before = left[member[at]]
        block = np.diff(np.append(at, len(member)))
        after = right[member[at + block - 1]]
        inner = after < last[member[at]]
        left[after[inner]] = before[inner]
        real = before < n
        before, block, after = before[real], block[real], after[real]
        right[before] = after
        top = start - 1
        go = top >= low
        low, top = low[go], top[go]
        if not len(before):
            continue
        # lengthened members go to the upper end of their group, more repetitions higher
        by = np.lexsort((block, group[before]))
        node, block, old = before[by], block[by], group[before[by]]
        fresh = np.ones(len(old), bool)
        fresh[1:] = old[1:] != old[:-1]
        one = np.flatnonzero(fresh)
        many = np.diff(np.append(one, len(old)))
        own = old[one]
        goal = ragged(own + size[own] - many, many)
        moved[node] = True
        out_of = order[goal]
        out_of = out_of[~moved[out_of]]
        now = place[node]
        taken = now < np.repeat(own + size[own] - many, many)
        free = now[taken]
        order[free] = out_of
        place[out_of] = free
        order[goal] = node
        place[node] = goal
        moved[node] = False
        fresh[1:] |= block[1:] != block[:-1]
        cut = np.flatnonzero(fresh)
        many_new = np.diff(np.append(cut, len(old)))
        size[own] -= many
        size[goal[cut]] = many_new
        group[node] = np.repeat(goal[cut], many_new)
    return out


class Extensions:
    """Longest common extensions within strings by binary search over prefix hashes."""

    def __init__(self, symbol: np.ndarray):
        n = len(symbol)
        value = np.random.default_rng(5).integers(1, 2**63, int(symbol.max(initial=0)) + 1, dtype=np.uint64)[symbol]
        self.power = np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64)
        self.power[0] = 1
        self.power = np.cumprod(self.power)
        # prefix i is the sum of value[j] * base^j below i: blocks compare after a shift by powers
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * self.power[:-1])])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the blocks of ``size`` at ``a < b`` have one hash."""
        return (self.prefix[a + size] - self.prefix[a]) * self.power[b - a] == self.prefix[b + size] - self.prefix[b]

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a - mid, b - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def runs_of(word: np.ndarray, row: np.ndarray, length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT):
    """``start, length, period`` arrays of all runs of at least ``length`` words and ``exponent`` periods.

    ``word`` holds numbered words of all rows one behind the other, ``row``
    ascending row numbers; starts are places of ``word``, rows and starts ascend.
    """
    if exponent < 2:
        raise ValueError("runs have two periods or more")
    at, part = frequent_stretches(word, row, length, exponent)
    symbol = word[at]
    n = len(symbol)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    turned = int(symbol.max()) - symbol
    root = lyndon_array(np.concatenate([symbol, turned]), np.concatenate([part, part + part[-1] + 1]))
    i = np.tile(np.arange(n), 2)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    begin, end = first[part][i], np.append(first[1:], n)[part][i]
    keep = i + root < end
    ext = Extensions(symbol)
    if exponent >= 3:  # then some root of the run, not its first word, is followed by another
        keep &= i + 2 * root <= end
        keep[keep] &= ext.equal(i[keep], (i + root)[keep], root[keep])
    i, q, begin, end = i[keep], root[keep], begin[keep], end[keep]
    s = i - ext.backward(i, i + q, i - begin)
    e = i + q + ext.forward(i, i + q, end - i - q)
    fit = e - s >= np.maximum(length, exponent * q)
    i, s, q, e, begin, end = (x[fit] for x in (i, s, q, e, begin, end))
    found, which = np.unique(np.stack([s, q, e], 1), axis=0, return_inverse=True)
    # equal hashes are no proof: compare the words, and look along the stretch where hashes misled
    wrong = np.zeros(len(found), bool)
    for lo in range(0, len(found), 1024):
        a, period, b = found[lo:lo + 1024].T
        size = b - a - period
        x = ragged(a, size)
        bad = symbol[x] != symbol[x + np.repeat(period, size)]
        wrong[lo + np.repeat(np.arange(len(size)), size)[bad]] = True
    if wrong.any():
        roots = np.flatnonzero(wrong[which.reshape(-1)])
        again = [_around(symbol, *map(int, (i[k], q[k], begin[k], end[k]))) for k in roots]
        again = [(a, y, b) for a, y, b in again if b - a >= max(length, exponent * y)]
        found = np.unique(np.concatenate([found[~wrong], np.array(again, np.int64).reshape(-1, 3)]), axis=0)
    s, q, e = found.T
    return at[s], e - s, q


def _around(w: np.ndarray, i: int, q: int, begin: int, end: int) -> tuple[int, int, int]:
    """``from, q, to`` of the stretch of period ``q`` around the root at ``i``, word by word."""
    differs = np.flatnonzero(w[begin:end - q] != w[begin + q:end]) + begin
    k = int(np.searchsorted(differs, i))
    a = int(differs[k - 1]) + 1 if k else begin
    return a, q, (int(differs[k]) if k < len(differs) else end - q) + q


def run_batches(batches, schema: pa.Schema, length: int, exponent: int):
    for batch in batches:
        for piece in slices(batch, "text"):
            words = [(t or "").encode().split() for t in piece.column("text").to_pylist()]  # ASCII blanks only
            count = np.array([len(w) for w in words])
            every = list(chain.from_iterable(words))
            number = {w: i for i, w in enumerate(dict.fromkeys(every))}
            flat = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
            row = np.repeat(np.arange(len(words)), count)
            begin = np.cumsum(count) - count
            start, size, period = runs_of(flat, row, length, exponent)
            owner = row[start]
            mark = np.zeros(len(flat) + 1, np.int64)
            np.add.at(mark, start + period, 1)
            np.add.at(mark, start + size, -1)
            kept = np.cumsum(mark[:-1]) == 0
            text = []
            for r, ws in enumerate(words):
                keep = kept[begin[r]:begin[r] + count[r]]
                text.append(b" ".join(ws if keep.all() else [w for w, k in zip(ws, keep.tolist()) if k]).decode())
            runs = pa.StructArray.from_arrays([pa.array(start - begin[owner]), pa.array(size), pa.array(period)], fields=list(RUN))
            off = np.searchsorted(owner, np.arange(len(words) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [piece.column("key"), pa.ListArray.from_arrays(pa.array(off), runs).cast(schema.field("runs").type), pa.array(text)], schema=schema)


def word_runs(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``key, runs, collapsed`` per row: runs as ``(start, length, period)`` by start, then period, and the text
    without what a run repeats after its first period, its words joined by one space."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    schema = pa.schema([("key", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
    out = rows.mapInArrow(lambda it: run_batches(it, schema, length, exponent),
                          "key long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("key", key)
