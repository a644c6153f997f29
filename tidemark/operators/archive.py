"""Operators over signed records: search, facets, grouping, rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import by_name, contains_any_case
from tidemark.operators.pages import with_page

ALL = "all"


def matches(fields: list[str], query: str) -> Column:
    """Whether the trimmed query is in any field, whatever the case; an empty query is in all records."""
    needle = query.strip()
    hits = [F.coalesce(contains_any_case(F.col(f).cast("string"), needle), F.lit(False)) for f in fields]
    return reduce(Column.__or__, hits) if needle else F.lit(True)


def search(records: DataFrame, fields: list[str], query: str) -> DataFrame:
    """Records with the trimmed query in any field; an empty query keeps all."""
    return records.where(matches(fields, query))


def facet_filter(records: DataFrame, year: str = ALL, date: str = "filed", **facets: str) -> DataFrame:
    """Records that equal every facet that isn't ``ALL``; a year is a range of the date column, so that all filters reach the scan."""
    if year != ALL:
        records = records.where((F.col(date) >= F.lit(f"{int(year):04d}-01-01").cast(records.schema[date].dataType)) & (F.col(date) < F.lit(f"{int(year) + 1:04d}-01-01").cast(records.schema[date].dataType)))
    for column, value in facets.items():
        if value != ALL:
            records = records.where(F.col(column) == value)
    return records


def is_filtered(query: str, *facets: str) -> bool:
    return query.strip() != "" or any(f != ALL for f in facets)


def facet_values(records: DataFrame, columns: list[str], seq: str) -> DataFrame:
    """(facet, value, n, first_seq): distinct values with their first appearance; all facets in one scan.

    Rows are counted by all the columns together first; only these few counts are taken apart.
    """
    together = records.groupBy(*columns).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"))
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return together.select(F.inline(pairs), "n", "first_seq").groupBy("facet", "value").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))


def ordered_facets(facets: DataFrame, orders: dict[str, tuple[str, str]]) -> DataFrame:
    """Facet values with their place: each facet by (column, asc or desc).  Distinct values are few, as people choose among them."""
    place = F.lit(None).cast("int")
    for facet, (column, way) in orders.items():
        w = Window.partitionBy("facet").orderBy(F.desc(column) if way == "desc" else F.asc(column))
        place = F.when(F.col("facet") == facet, F.row_number().over(w)).otherwise(place)
    return facets.withColumn("place", place).orderBy("facet", "place")


def rollup_latest(records: DataFrame, by: str, newest: list[str], keep: list[str]) -> DataFrame:
    """Count and the newest record of each group in one aggregate with map-side parts, the largest groups first, then by name; no window."""
    latest = F.max_by(F.struct(*keep), F.struct(*newest)).alias("latest")
    counted = records.groupBy(by).agg(F.count("*").alias("n"), latest)
    return counted.select(by, "n", *(F.col(f"latest.{k}").alias(f"latest_{k}") for k in keep)).orderBy(F.desc("n"), by_name(F.col(by)) if records.schema[by].dataType.simpleString() == "string" else by)


def group_pages(records: DataFrame, by: str, newest: list[str], key: str, size: int) -> DataFrame:
    """Groups in the order of their newest record, in pages: (group, place, n, page, keys), the keys of ``size`` records in filing order.

    Every record is on a page.  A group of any size is cut into pages by its records' numbers, so no task has it whole.
    """
    paged = with_page(records.select(by, *dict.fromkeys([*newest, key])), [by], newest, size)
    lists = paged.groupBy(by, "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", key))), lambda x: x[key]).alias("keys"), F.max(F.struct(*newest)).alias("first"))
    counts = lists.groupBy(by).agg(F.sum(F.size("keys")).alias("n"), F.max("first").alias("newest"))
    # The groups are years or the like: few, so one window may put them in order.
    placed = counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("newest")))).select(F.col(by).alias("of"), "place", "n")
    return lists.join(placed, F.col(by).eqNullSafe(F.col("of"))).select(by, "place", "n", "page", "keys").orderBy("place", "page")
