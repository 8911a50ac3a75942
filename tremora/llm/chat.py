"""Chat formatting of typed content parts into one reversible template.

A turn is ``<s>[INST]role[/INST]body</s>``. A visitor flattens the parts of a turn
in order: text is escaped, every other part becomes a numbered placeholder with a
record of its reference and the tokens it expands to. A backslash before ``<``,
``[`` and itself keeps control strings out of texts, so the output parses back.
Formatted turns are rows: a conversation of any length never becomes one value.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = "array<struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
FORMATTED = ("conv_id long, turn long, piece string, body_start int, body_end int, loss boolean, "
             "attachments array<struct<number: int, kind: string, ref: string, at: int, tokens: int>>")
_CONTROL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[INST\]((?:[^\\<\[]|\\.)*)\[/INST\]((?:[^\\<\[]|\\.|<(?:image|audio|document):\d+>)*)</s>", re.S)
_PLACEHOLDER = re.compile(r"\\.|<(?:image|audio|document):\d+>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flatten:
    """Visitor over the parts of a turn; one method per kind."""

    PATCH, SECOND, PAGE = 14 * 14, 25, 512

    def __init__(self):
        self.out, self.length, self.attachments = [], 0, []

    def visit(self, part) -> None:
        getattr(self, f"visit_{part['kind'] or 'text'}", self.visit_unknown)(part)

    def put(self, piece: str) -> None:
        self.out.append(piece)
        self.length += len(piece)

    def attach(self, kind: str, part, tokens: int) -> None:
        n = len(self.attachments)
        self.attachments.append({"number": n, "kind": kind, "ref": part["ref"], "at": self.length, "tokens": tokens})
        self.put(f"<{kind}:{n}>")

    def visit_text(self, part) -> None:
        self.put(escape(part["text"] or ""))

    def visit_image(self, part) -> None:
        area = (part["width"] or 0) * (part["height"] or 0)
        self.attach("image", part, max(1, -(-area // self.PATCH)))

    def visit_audio(self, part) -> None:
        self.attach("audio", part, max(1, round((part["seconds"] or 0) * self.SECOND)))

    def visit_document(self, part) -> None:
        self.attach("document", part, max(1, (part["pages"] or 0) * self.PAGE))

    def visit_unknown(self, part) -> None:
        self.put(escape(f"({part['kind']})" + (part["text"] or "")))


def format_turns(frames, loss_roles: tuple[str, ...]):
    for pdf in frames:
        out = []
        for conv, missing, turn, role, parts in zip(pdf["conv_id"], pdf["missing"], pdf["turn"], pdf["role"], pdf["parts"]):
            v = Flatten()
            head = f"<s>[INST]{escape(role or '')}[/INST]"
            for part in parts if parts is not None else []:
                if part is not None:
                    v.visit(part)
            piece = head + "".join(v.out) + "</s>"
            out.append((conv, missing, turn, piece, len(head), len(head) + v.length, role in loss_roles, v.attachments))
        yield pd.DataFrame(out, columns=["conv_id", "missing", "turn", "piece", "body_start", "body_end", "loss", "attachments"])


def format_chat(df: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``FORMATTED`` rows, one for each row of ``df(conv_id, turn, role, and parts or text)``.

    ``loss`` marks turns whose body, from ``body_start`` to ``body_end`` in code
    points of ``piece``, is trained on. A null text, part list or role is empty, a
    null part is skipped, an unknown kind of part stays as text with its kind
    named. Null and repeated conversation ids, turns and rows are kept. A column
    ``parts`` of another type than ``PARTS`` is read as absent, other columns are
    not read, and an empty table gives an empty result.
    """
    typed = "parts" in df.columns and df.schema["parts"].dataType.simpleString() == PARTS.replace(" ", "")
    text = F.array(F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))
    rows = df.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("missing"),
                     F.coalesce(F.col("turn").cast("long"), F.lit(-2**62)).alias("turn"), F.col("role").cast("string").alias("role"),
                     (F.col("parts") if typed else text).alias("parts"))
    out = rows.mapInPandas(lambda it: format_turns(it, loss_roles), f"missing boolean, {FORMATTED}")
    return out.select(F.when(~F.col("missing"), F.col("conv_id")).alias("conv_id"),
                      F.when(F.col("turn") != -2**62, F.col("turn")).alias("turn"), *[c.split(": ")[0].split()[0] for c in (
                          "piece", "body_start", "body_end", "loss", "attachments")])


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders stand for nothing in the text."""
    m = _TURN.fullmatch(piece)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(_PLACEHOLDER.sub(lambda x: x[0] if x[0][0] == "\\" else "", m[2]))


class _Digest:
    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, piece: str, start: int, end: int, loss: bool) -> None:
        role, text = parse(piece)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.n += 1
        self.chars += len(piece)
        if loss:
            body = unescape(_PLACEHOLDER.sub(lambda x: x[0] if x[0][0] == "\\" else "", piece[start:end]))
            self.loss.update(body.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(body)

    def row(self, conv, missing) -> tuple:
        return conv, missing, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_sorted(frames):
    """Digests of conversations from formatted turns in order; holds one conversation's state, not its turns."""
    names = ["conv_id", "missing", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    at, state = None, None
    for pdf in frames:
        done = []
        for conv, missing, piece, start, end, loss in zip(pdf["conv_id"], pdf["missing"], pdf["piece"], pdf["body_start"], pdf["body_end"], pdf["loss"]):
            if at != (conv, missing):
                if state:
                    done.append(state.row(*at))
                at, state = (conv, missing), _Digest()
            state.add(piece, start, end, loss)
        if done:
            yield pd.DataFrame(done, columns=names)
    if state:
        yield pd.DataFrame([state.row(*at)], columns=names)


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` read back from formatted turns.

    Turns go by number, equal numbers by their piece. A hash of a conversation
    takes its turns one after the other, so they stream through one task in order
    and only the state of the hash is held.
    """
    rows = formatted.select(F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("missing"),
                            "turn", "piece", "body_start", "body_end", "loss")
    rows = rows.repartition("conv_id", "missing").sortWithinPartitions("missing", "conv_id", "turn", "piece")
    out = rows.mapInPandas(read_sorted, "conv_id long, missing boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.when(~F.col("missing"), F.col("conv_id"))).drop("missing")
