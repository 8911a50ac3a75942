"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample: at most
``PER_LANGUAGE`` documents a language, drawn by hash, one passage of
``PASSAGE`` characters at a drawn place from each. Prediction reads whole texts:
they are cut into chunks with a margin on both sides for the two directions to
settle, every byte gets a distribution over languages, and a document's
probabilities are the mean over the bytes of its letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import slices, utf8

PER_LANGUAGE = 400
PASSAGE = 400
MOST_LANGUAGES = 500
HIDDEN = 8
STEPS, BATCH, SPAN = 300, 96, 64
CHUNK, MARGIN = 384, 16
LEAST = 0.4
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def forward(m: dict, x: np.ndarray, keep: bool = False):
    """States of both directions for bytes ``x`` (time, batch): (2, time, batch, hidden) in text order."""
    t, b = x.shape
    h_size = m["U"].shape[1]
    h = np.zeros((2, b, h_size), np.float32)
    states = np.empty((2, t, b, h_size), np.float32)
    saved = []
    for i in range(t):
        xg = np.stack([m["E"][0].take(x[i], axis=0), m["E"][1].take(x[t - 1 - i], axis=0)])
        g = np.matmul(h, m["U"])
        zr = xg[:, :, :2 * h_size]
        zr += g[:, :, :2 * h_size]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :, :h_size], zr[:, :, h_size:]
        gc = g[:, :, 2 * h_size:]
        c = np.tanh(xg[:, :, 2 * h_size:] + r * gc)
        if keep:
            saved.append((h, z, r, gc, c))
        h = h + z * (c - h)
        states[0, i], states[1, t - 1 - i] = h[0], h[1]
    return (states, saved) if keep else states


def probabilities(m: dict, states: np.ndarray) -> np.ndarray:
    s = np.matmul(states[0], m["W"][0]) + np.matmul(states[1], m["W"][1]) + m["b"]
    s -= s.max(axis=-1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=-1, keepdims=True)
    return s


def gradients(m: dict, x: np.ndarray, label: np.ndarray, mask: np.ndarray):
    """Gradient of the mean cross-entropy over masked positions, by backpropagation through time."""
    t, b = x.shape
    h_size = m["U"].shape[1]
    states, saved = forward(m, x, keep=True)
    p = probabilities(m, states)
    weight = mask / max(mask.sum(), 1)
    d = p.copy()
    d[:, np.arange(b), label] -= 1
    d *= weight[:, :, None]
    g = {"b": d.sum(axis=(0, 1)), "W": np.stack([np.tensordot(states[k], d, ([0, 1], [0, 1])) for k in (0, 1)])}
    out = np.stack([np.matmul(d, m["W"][k].T) for k in (0, 1)])
    back = np.zeros((2, b, h_size), np.float32)
    g["U"] = np.zeros_like(m["U"])
    dx = np.empty((2, t, b, 3 * h_size), np.float32)
    for i in reversed(range(t)):
        h, z, r, gc, c = saved[i]
        back[0] += out[0, i]
        back[1] += out[1, t - 1 - i]
        dc = back * z * (1 - c * c)
        dz = back * (c - h) * z * (1 - z)
        dr = dc * gc * r * (1 - r)
        dg = np.concatenate([dz, dr, dc * r], axis=2)
        dx[0, i] = np.concatenate([dz[0], dr[0], dc[0]], axis=1)
        dx[1, t - 1 - i] = np.concatenate([dz[1], dr[1], dc[1]], axis=1)
        g["U"] += np.matmul(h.transpose(0, 2, 1), dg)
        back = back * (1 - z) + np.matmul(dg, m["U"].transpose(0, 2, 1))
    hot = np.zeros((t * b, 256), np.float32)
    hot[np.arange(t * b), x.ravel()] = 1
    g["E"] = np.stack([hot.T @ dx[k].reshape(t * b, -1) for k in (0, 1)])
    own = np.take_along_axis(p, np.broadcast_to(label[None, :, None], (t, b, 1)), 2)[:, :, 0]
    return g, float(-(np.log(own + 1e-12) * weight).sum())


def train(texts: list[bytes], labels: list[int], n_labels: int, seed: int = 5) -> dict:
    """Weights after ``STEPS`` Adam steps on spans drawn evenly over languages."""
    rng = np.random.default_rng(seed)
    h = HIDDEN
    m = {"E": rng.normal(0, 0.3, (2, 256, 3 * h)), "U": rng.normal(0, h ** -0.5, (2, h, 3 * h)),
         "W": rng.normal(0, 0.3, (2, h, n_labels)), "b": np.zeros(n_labels)}
    m = {k: v.astype(np.float32) for k, v in m.items()}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    by = [[t for t, y in zip(texts, labels) if y == k] for k in range(n_labels)]
    for step in range(1, STEPS + 1):
        label = rng.integers(0, n_labels, BATCH)
        x = np.full((BATCH, SPAN), 32, np.uint8)
        for i, y in enumerate(label):
            t = by[y][rng.integers(len(by[y]))]
            at = int(rng.integers(0, max(1, len(t) - SPAN + 1)))
            piece = np.frombuffer(t[at:at + SPAN], np.uint8)
            x[i, :len(piece)] = piece
        x = x.T
        g, _ = gradients(m, x, label, _LETTER[x].astype(np.float32))
        rate = 0.02 * (1 - 0.9 * step / STEPS)
        for k in m:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            m[k] -= (rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return m


def pooled(m: dict, data: np.ndarray, off: np.ndarray):
    """Summed letter probabilities, labels counted per language and letters, per row."""
    rows, n_labels = len(off) - 1, m["b"].shape[0]
    size = np.diff(off)
    n = -(-size // CHUNK)
    row = np.repeat(np.arange(rows), n)
    start = off[:-1][row] + CHUNK * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    total, votes, letters = np.zeros((rows, n_labels)), np.zeros((rows, n_labels), np.int64), np.zeros(rows, np.int64)
    step = max(64, 8192 // n_labels)
    wide = np.arange(-MARGIN, CHUNK + MARGIN)[:, None]
    for i in range(0, len(row), step):
        r, at = row[i:i + step], start[i:i + step] + wide
        inside = (at >= off[r]) & (at < off[r + 1])
        x = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 32).astype(np.uint8)
        scored = inside & _LETTER[x]
        scored[:MARGIN] = scored[MARGIN + CHUNK:] = False
        p = probabilities(m, forward(m, x))
        best = p.argmax(axis=2)
        p *= scored[:, :, None]
        np.add.at(total, r, p.sum(axis=0, dtype=np.float64))
        np.add.at(letters, r, scored.sum(axis=0))
        for k in range(n_labels):
            np.add.at(votes[:, k], r, ((best == k) & scored).sum(axis=0))
    return total, votes, letters


def judged(part: pa.RecordBatch, text: str, m: dict | None, names: list[str]):
    """Language, score, letters and share of labels per row of ``part``."""
    rows = part.num_rows
    lettered = np.array([bool(t) and any(c.isalpha() for c in t) for t in part.column(text).to_pylist()], bool)
    if m is None or not lettered.any():
        return ["und"] * rows, np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows)
    total, votes, letters = pooled(m, *utf8(part.column(text)))
    best, at = total.argmax(axis=1), np.arange(rows)
    sure = lettered & (letters > 0)
    many = np.maximum(letters, 1)
    return ([names[b] if s else "und" for b, s in zip(best, sure)], np.where(sure, np.clip(total[at, best] / many, 0, 1), 0.0),
            letters, np.where(sure, votes[at, best] / many, 0.0))


def label(batches, m: dict | None, names: list[str]):
    for batch in batches:
        for part in slices(batch, "text"):
            lang, score, letters, share = judged(part, "text", m, names)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(letters), pa.array(share)],
                ["doc_id", "held_out", "lang_pred", "score", "n_letters", "label_share"])


def accepted(batches, text: str, m: dict | None, names: list[str], least: float):
    for batch in batches:
        for part in slices(batch, text):
            lang, score, _, _ = judged(part, text, m, names)
            yield part.filter(pa.array([n != "und" and s >= least for n, s in zip(lang, score)], pa.bool_()))


def crc_mod(key, n: int):
    """crc32 of the key's decimal text, modulo ``n``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def fit(df: DataFrame, key: str, text: str, lang: str):
    """Model and language names from the training part of ``df``, or ``(None, [])`` without labelled rows."""
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    rows = rows.where((crc_mod("k", 4) != 2) & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    at = F.pmod(F.xxhash64("k", F.lit("at")), F.greatest(F.length("t") - PASSAGE, F.lit(1))) + 1
    rows = rows.select("l", "k", F.substring(F.col("t"), at.cast("int"), F.lit(PASSAGE)).alias("t"))
    draw = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k", "t")
    took = rows.withColumn("n", F.row_number().over(draw)).where(F.col("n") <= PER_LANGUAGE).limit(PER_LANGUAGE * MOST_LANGUAGES).select("l", "k", "t").collect()
    took.sort()
    names = sorted({r["l"] for r in took})
    if not names:
        return None, []
    return train([r["t"].encode() for r in took], [names.index(r["l"]) for r in took], len(names)), names


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_letters, label_share`` for every row of ``df``.

    Learns from rows with a label whose key's crc32 modulo 4 is not 2 (a null key is
    neither learned from nor held out). ``score`` is the pooled probability of
    ``lang_pred``, ``label_share`` the share of letter bytes labelled with it. A text
    that is null or has no letter is ``und`` with score 0, and so is every text if
    nothing was learned. Repeated rows are judged alike, an empty table gives an
    empty result, other columns are not read.
    """
    m, names = fit(df, key, text, lang)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(crc_mod(key, 4) == 2, F.lit(False)).alias("held_out"),
                     F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: label(it, m, names),
                           "doc_id long, held_out boolean, lang_pred string, score double, n_letters long, label_share double")


def recognised(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = LEAST) -> DataFrame:
    """The rows of ``df``, unchanged, whose language is recognised with a score of ``least`` or more."""
    m, names = fit(df, key, text, lang)
    return df.mapInArrow(lambda it: accepted(it, text, m, names, least), df.schema)
