"""URL filter rules as a sort-merge range join.

A host is written with its labels reversed and closed by a dot (``org.example.``),
so a rule on a host covers one interval of keys: everything that starts with the
rule's key, its subdomains included. URLs are range-partitioned and sorted by that
key; one sweep per partition keeps the stack of rules whose interval holds the
current key, innermost last. Each stack entry carries the path rules of its host.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import ascii_lower

RULE_BLOCK = 50_000


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Add ``host`` and ``path`` of column ``url``; null or no ``://`` gives two empty strings."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = F.coalesce(F.col(url), F.lit(""))
    return df.withColumns({
        "host": ascii_lower(F.regexp_extract(found, pattern, 1)),
        "path": F.regexp_extract(found, pattern, 2)})


def reversed_host(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split(".")))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def blocks(rules: Iterable[tuple[str, str]], size: int):
    """Sorted ``(key, [(path, rule, verdict)])`` in blocks of at most ``size`` rules."""
    rows = sorted((reversed_host(split_rule(r)[0]), split_rule(r)[1], r, v) for r, v in rules)
    for i in range(0, len(rows), size):
        by: dict[str, list] = {}
        for key, path, rule, verdict in rows[i:i + size]:
            by.setdefault(key, []).append((path, rule, verdict))
        yield list(by.items())


def sweep(block, frames):
    """One pass over frames sorted by ``key``: replace ``rule, verdict, length`` where a longer rule fits."""
    p, stack = 0, []
    for pdf in frames:
        best = []
        for key, path, rule, verdict, length in zip(pdf["key"], pdf["path"], pdf["rule"], pdf["verdict"], pdf["length"]):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            while p < len(block) and block[p][0] <= key:
                if key.startswith(block[p][0]):
                    stack.append(block[p])
                p += 1
            for prefix, paths in stack:
                for start, text, said in paths:
                    if len(prefix) + len(start) > length and path.startswith(start):
                        rule, verdict, length = text, said, len(prefix) + len(start)
            best.append((rule, verdict, length))
        yield pdf.assign(**pd.DataFrame(best, columns=["rule", "verdict", "length"], index=pdf.index))


def judge(df: DataFrame, rules: Iterable[tuple[str, str]], key: str, url: str = "url", default: str = "allow",
          block: int = RULE_BLOCK) -> DataFrame:
    """``key, host, path, rule, verdict`` for every row of ``df``.

    ``rules`` are ``(host/path, verdict)``. A rule fits its host and all its
    subdomains if the URL's path starts with the rule's; the longest rule wins
    (characters of host and path), then the one that sorts first. Rows no rule
    fits get a null ``rule`` and ``default``. Null, empty and malformed URLs have
    an empty host, which no rule with a host fits. Repeated rows are judged one by
    one; other columns of ``df`` are not read. Rules travel in sorted blocks of
    bounded size, each swept over the same sorted partitions, so their number is
    not limited. Sorting by key and row splits a hot host over partitions.
    """
    rows = split_url(df.select(F.col(key).alias("row_id"), F.col(url).alias("url")), "url")
    rows = rows.select(
        "row_id", "host", "path",
        F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")).alias("key"),
        F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(-1).alias("length"))
    rows = rows.repartitionByRange("key", "path", "row_id").sortWithinPartitions("key")
    for b in blocks(rules, block):
        rows = rows.mapInPandas(lambda frames, b=b: sweep(b, frames), rows.schema)
    return rows.select(F.col("row_id").alias(key), "host", "path", "rule", "verdict")
