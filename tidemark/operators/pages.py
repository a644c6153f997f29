"""Pages of a group's records by key, so that every record of a group of any size can be reached."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import fresh, numbered_within


def with_page(records: DataFrame, by: list[str], newest: list[str], size: int, page: str = "page", nth: str = "nth") -> DataFrame:
    """The records with their place in their group (1 is the newest, by the columns of ``newest`` falling) and its page (from 1)."""
    placed = numbered_within(records, by, [F.desc(c) for c in newest], nth)
    return placed.withColumn(page, F.floor((F.col(nth) - 1) / size) + 1)


def page_index(records: DataFrame, by: list[str], newest: list[str], size: int) -> DataFrame:
    """(by, page, n, first, last): each page's size and the keys that it begins and ends with; the last is the cursor of the next page."""
    page, nth = fresh(records, "page", "nth")
    paged, key = with_page(records, by, newest, size, page, nth), F.struct(*newest)
    index = paged.groupBy(*by, page).agg(F.count("*").alias("n"), F.max(key).alias("first"), F.min(key).alias("last"))
    return index.select(*by, F.col(page).alias("page"), "n", "first", "last")


def after(newest: list[str], cursor: tuple) -> Column:
    """Whether a record comes after a cursor: falling lexicographic order, stated so that the first column's bound reaches the scan."""
    tests = []
    for k, c in enumerate(newest):
        tests.append(reduce(Column.__and__, [*(F.col(x) == F.lit(v) for x, v in zip(newest[:k], cursor)), F.col(c) < F.lit(cursor[k])]))
    return (F.col(newest[0]) <= F.lit(cursor[0])) & reduce(Column.__or__, tests)


def page_of(records: DataFrame, newest: list[str], size: int, cursor: tuple | None = None) -> DataFrame:
    """The page after a cursor (the first without one), newest first; no count and no sort of what isn't on it."""
    rest = records if cursor is None else records.where(after(newest, cursor))
    return rest.orderBy(*(F.desc(c) for c in newest)).limit(size)
