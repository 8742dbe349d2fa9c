"""Grouped counts, leagues, trends, statistics and ranges. All are partial aggregations before their one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayledger.functions.rules import trend


def group_counts(df: DataFrame, key: str, default: str = "Unknown") -> DataFrame:
    """(key, n), blank and null keys under a default."""
    return df.groupBy(F.coalesce(F.nullif(F.trim(key), F.lit("")), F.lit(default)).alias(key)).agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, key: str, conditions: dict[str, Column], default: str = "unknown") -> DataFrame:
    """(key, total, one count for each condition), blank and null keys under a default."""
    return df.groupBy(F.coalesce(F.nullif(F.trim(key), F.lit("")), F.lit(default)).alias(key)).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def league(df: DataFrame, key: str, active: Column, planned_days: Column, overran: Column, high: Column, area: str) -> DataFrame:
    """Per key: active, completed and total rows, mean of the planned days above 0, share of completed ones that overran
    (null without completed ones), share of high ones, and distinct areas, blank ones left out. Blank and null keys are
    'Unknown'."""
    done = ~active
    return df.groupBy(F.coalesce(F.nullif(F.trim(key), F.lit("")), F.lit("Unknown")).alias(key)).agg(
        F.count_if(active).alias("active"),
        F.count_if(done).alias("completed"),
        F.count("*").alias("total"),
        F.bround(F.avg(F.when(planned_days > 0, planned_days)), 1).alias("avg_days"),
        F.bround(F.try_divide(100.0 * F.count_if(done & overran), F.count_if(done)), 1).alias("overrun_pct"),
        F.bround(100.0 * F.count_if(high) / F.count("*"), 1).alias("high_pct"),
        F.countDistinct(F.when(F.col(area).cast("string") != "", F.col(area))).alias("areas"),
    )


def volume_trend(df: DataFrame, key: str, days_ago: Column, active: Column) -> DataFrame:
    """Per key: active rows, rows of the last 30 and 90 days and the trend between those."""
    within = lambda n: F.count_if(~active & (days_ago >= 0) & (days_ago <= n))
    out = df.groupBy(key).agg(F.count_if(active).alias("active"), within(30).alias("last_30d"), within(90).alias("last_90d"))
    return out.withColumn("trend", trend(F.col("last_30d"), F.col("last_90d")))


def zero_filled(df: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """Counts by key in which each value of the domain appears, with 0 if need be; other keys are kept."""
    base = df.sparkSession.createDataFrame([(v,) for v in domain], f"{key} string")
    return df.groupBy(key).agg(F.count("*").alias("n")).join(base, key, "full").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def duration_stats(df: DataFrame, days: str, key: str | None = None, most: int = 3650, every: str = "(all)") -> DataFrame:
    """count, mean, exact median in whole days and maximum of days between 0 and most, both exclusive; by key, with a row
    named `every` for all together, in one pass."""
    own = df.where((F.col(days) > 0) & (F.col(days) < most))
    grouped = own.groupingSets([[key], []], key) if key else own.groupBy()
    d = F.col(days).cast("double")
    out = grouped.agg(F.count("*").alias("n"), F.bround(F.avg(d), 1).alias("avg_days"), F.bround(F.median(d), 0).cast("long").alias("median_days"), F.max(days).cast("long").alias("max_days"), *([F.grouping(key).alias("_all")] if key else []))
    return out.withColumn(key, F.when(F.col("_all") == 1, every).otherwise(F.col(key))).drop("_all") if key else out


def arg_max(df: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """The row of each key with the largest value, of equal ones that with the smallest tie column. A single aggregation."""
    rest = [c for c in df.columns if c != key]
    best = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(value), -F.col(tie))).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def bounds(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """One row: the box around all valid places (null and 0 are none)."""
    own = df.where(valid_place(lat, lng))
    return own.agg(F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lng).alias("west"), F.max(lng).alias("east"), F.count("*").alias("n"))


def valid_place(lat: str, lng: str) -> Column:
    return F.col(lat).isNotNull() & F.col(lng).isNotNull() & (F.col(lat) != 0) & (F.col(lng) != 0)


def nearest_rank(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row: the sorted values' element number floor(share * n), counted from 0. The order is taken over the distinct
    values with their counts, whose running sum is formed over ranges, so that no task sorts all rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    at = counts.agg(F.floor(F.sum("n") * share)).first()[0]
    ranged = counts.repartitionByRange("v").withColumn("_p", F.spark_partition_id())
    parts = ranged.groupBy("_p").agg(F.sum("n").alias("_s"))
    before = parts.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_before"))  # a row a range
    run = ranged.join(F.broadcast(before), "_p").withColumn("_upto", F.col("_before") + F.sum("n").over(Window.partitionBy("_p").orderBy("v")))
    return run.where(F.col("_upto") > F.lit(at)).agg(F.min("v").alias("value"))


def share_of_total(df: DataFrame, key: str, weight: str, digits: int = 4) -> DataFrame:
    """Weight per key and its share of all; the total is a single number."""
    total = df.agg(F.sum(weight)).first()[0]
    return df.groupBy(key).agg(F.sum(weight).alias("weight")).withColumn("share", F.bround(F.try_divide(F.col("weight"), F.lit(total)), digits))


def freshness(frames: dict[str, tuple[DataFrame, Column]], as_of: Column, stale_hours: float = 6.0) -> DataFrame:
    """Per source: records, newest time and whether that is older than stale_hours."""
    rows = [df.agg(F.lit(n).alias("source"), F.count("*").alias("records"), F.max(at).alias("newest")) for n, (df, at) in frames.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("stale", F.coalesce((as_of - F.col("newest")) / 3600000.0 > stale_hours, F.lit(True)))
