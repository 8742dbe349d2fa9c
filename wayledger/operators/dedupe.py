"""Keeping one of several rows, differences between snapshots by key, and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.operators.redelivery import ranked_first


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that ends in a unique column. Null keys are keys of their own."""
    keyed = df.withColumn("_key", F.struct(*keys))
    return ranked_first(keyed, "_key", order).drop("_key")


def keep_preferred(df: DataFrame, reference: str, fallback: list[str], preferred: Column, order: list[Column]) -> DataFrame:
    """One row for each reference, preferred ones before others, then the first; rows with a blank reference are one for
    each combination of the fallback columns, the first of it."""
    ref = F.trim(F.coalesce(F.col(reference), F.lit("")))
    key = F.when(ref != "", F.struct(F.lit(1).alias("k"), ref.alias("r"), *[F.lit(None).cast(df.schema[c].dataType).alias(f"f{i}") for i, c in enumerate(fallback)])).otherwise(
        F.struct(F.lit(2).alias("k"), F.lit("").alias("r"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fallback)])
    )
    rank = F.when(ref != "", F.coalesce(preferred, F.lit(False)).cast("int")).otherwise(0)
    keyed = df.withColumns({"_key": key, "_pref": rank})
    return ranked_first(keyed, "_key", [F.col("_pref").desc(), *order]).drop("_key", "_pref")


def snapshot_key(reference: str, parts: list[str]) -> Column:
    """The reference, or the parts joined where it is blank."""
    return F.coalesce(F.nullif(F.trim(F.col(reference)), F.lit("")), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]))


def gone(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key new lacks."""
    return old.join(new.select(key), key, "left_anti")


def vanished(df: DataFrame, key: str, age: str) -> DataFrame:
    """(key, age), once each: keys of the snapshot of an age (1 is the newest) that the next newer one lacks."""
    held = df.select(key, age).distinct()
    return held.where(F.col(age) > 1).join(held.select(key, (F.col(age) + 1).alias(age)), [key, age], "left_anti")


def archive_additions(old: DataFrame, new: DataFrame, archive: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """What a snapshot adds to an archive: rows gone since the last one, one a key, that aren't archived yet."""
    return keep_first(gone(gone(old, new, key), archive, key), [key], order)


def with_fallback(first: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """All of first, and of other the rows whose key first lacks."""
    return first.unionByName(gone(other, first, key), allowMissingColumns=True)


def fill_missing(df: DataFrame, other: DataFrame, key: str, columns: list[str], list_cap: int = 5) -> DataFrame:
    """df with null or blank columns filled from other, which has one row a key; lists are filled when empty, to a cap."""
    right = other.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    out = df.join(right, key, "left")
    for c in columns:
        if dict(df.dtypes)[c].startswith("array"):
            out = out.withColumn(c, F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.slice(F.array_distinct(f"_o_{c}"), 1, list_cap)))
        else:
            out = out.withColumn(c, F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"_o_{c}")))
    return out.select(df.columns)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
