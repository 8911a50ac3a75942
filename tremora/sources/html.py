"""Quote tables and links out of stored HTML pages, by built-in string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.functions.exprs import decimal_number, whole_number


def link_table(pages: DataFrame) -> DataFrame:
    """Links and title of every page."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select(
        "page_id", F.size(links).cast("bigint").alias("n_links"),
        F.size(F.array_distinct(links)).cast("bigint").alias("n_distinct"),
        F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"\s+", " ").alias("title"))


def table_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Cells of every table row as an array of stripped texts."""
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    text = F.transform(cells, lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]+>", "")))
    return pages.select(key, F.posexplode(rows).alias("row_no", "row")).select(key, "row_no", text.alias("cells"))


def quotes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Quote rows ``d-Mon-yy, open, high, low, close, volume, adjusted``.

    Rows with fewer than seven cells, without a date or with malformed numbers
    (dividend notes, headings) are left out.
    """
    c = lambda i: F.get("cells", F.lit(i))
    part = lambda i: F.regexp_extract(c(0), r"^(\d{1,2})-([A-Za-z]{3})-(\d{2}|\d{4})$", i)
    text = F.concat_ws("-", part(1), F.initcap(F.lower(part(2))), part(3))
    day = F.when(text.rlike(r"^\d{1,2}-[A-Z][a-z]{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("d-MMM-yy"))).when(
        text.rlike(r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$"), F.try_to_timestamp(text, F.lit("d-MMM-yyyy"))).cast("date")
    return (
        table_rows(pages, key).where(F.size("cells") >= 7)
        .select(key, day.alias("date"),
                decimal_number(c(1)).alias("open"), decimal_number(c(2)).alias("high"), decimal_number(c(3)).alias("low"),
                decimal_number(c(4)).alias("close"), whole_number(c(5)).alias("volume"), decimal_number(c(6)).alias("adj_close"))
        .dropna()
    )
