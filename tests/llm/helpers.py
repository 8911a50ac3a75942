"""Brute-force versions and odd inputs for the operator tests."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(ids, linked):
    """Smallest id reachable for every id."""
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard80(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def odd_documents(spark, extra=()):
    """Nulls, empty, blank, long and repeated texts, and columns with names used inside the operators."""
    base = "the quick brown fox jumps over the lazy dog while seventeen grey geese watch from a frozen pond near the old mill "
    rows = [
        (1, base, "en", "s1", 10), (2, base, "en", "s1", 10), (3, base + "again", "en", "s1", 10), (4, None, "en", "s1", None),
        (5, "", None, None, 0), (6, " \n\t ", "en", None, 4), (7, base, "en", "s1", 10), (7, base, "en", "s1", 10),
        (None, base, None, None, None), (8, "x" * 200_000, "en", "s2", 1), (9, (base + "\n") * 400, "en", "s2", 1),
        (10, "1234 5678 !!", "de", "s2", 1), (11, "Ein \U0001F600 Wort", "de", "s2", 1), (12, "un", "fr", "s2", 1), *extra]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("id", "component", "hash", "row", "key", "bucket", "kept", "a", "b", "n", "score", "gone", "_key", "word"):
        df = df.selectExpr("*", f"'other' AS {c}")
    return df
