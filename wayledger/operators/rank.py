"""Sorts, top lists, pages and filters that users combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def severity_rank(c: str, order: tuple[str, ...] = ("high", "medium", "low"), other: int = 9) -> Column:
    out = F.when(F.lower(F.trim(c)) == order[0], 0)
    for i, v in enumerate(order[1:], 1):
        out = out.when(F.lower(F.trim(c)) == v, i)
    return out.otherwise(other)


def top_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows; the order ends in a unique column. Each task keeps n rows (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def first_of_each(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; tasks keep n rows a key before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def page(df: DataFrame, order: list[Column], number: int, size: int = 30) -> DataFrame:
    """Page `number`, counted from 1 and held within the pages there are."""
    pages = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(1, number), pages) - 1) * size).limit(size)


def first_or_newest(df: DataFrame, featured: Column, newest: Column, tie: str) -> DataFrame:
    """The featured row, or else the newest."""
    return top_n(df, 1, [F.coalesce(featured, F.lit(False)).cast("int").desc(), newest.desc_nulls_last(), F.col(tie)])


def all_but(df: DataFrame, one: DataFrame, key: str) -> DataFrame:
    return df.join(F.broadcast(one.select(key).limit(1)), key, "left_anti")


#: The orders a user may choose from, by name: columns of the works table.
SORTS = {
    "severity": lambda: [severity_rank("severity"), F.col("road").asc_nulls_last()],
    "road": lambda: [F.col("road").asc_nulls_last()],
    "start": lambda: [F.col("start_ms").asc_nulls_last()],
    "end": lambda: [F.col("end_ms").asc_nulls_last()],
    "duration": lambda: [(F.col("end_ms") - F.col("start_ms")).desc_nulls_last()],
    "operator": lambda: [F.col("operator").asc_nulls_last()],
}


def facet_query(df: DataFrame, facets: dict[str, str] | None = None, road: str = "", window: tuple[int, int] | None = None, day: int | None = None, hour: int | None = None, sort: str = "severity", tie: str = "id", number: int | None = None, size: int = 30) -> DataFrame:
    """A conjunction of equal facets ('all' is none), a part of the road's name, a time window, a day and an hour, sorted by name
    and paged. Only the conditions asked for are in the plan, so they reach the scan."""
    from wayledger.operators.temporal import active_at_hour, active_on

    for column, value in (facets or {}).items():
        if value != "all":
            df = df.where(F.col(column) == value)
    if road:
        df = df.where(F.contains(F.lower("road"), F.lit(road.lower())))
    if window is not None:
        df = df.where((F.col("start_ms") <= window[1]) & (F.col("end_ms") >= window[0]))
    if day is not None:
        df = df.where(active_on("start_ms", "end_ms", day))
    if hour is not None:
        df = df.where(active_at_hour("start_ms", "end_ms", hour))
    order = [*SORTS[sort](), F.col(tie)]
    return df.orderBy(*order) if number is None else page(df, order, number, size)
