"""Problem 1: messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_RANK = "_wayledger_rank"


def ranked_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order; rows with a null key are left out. order must end in a unique
    column. As only rank 1 is asked for, Spark ranks within each map task before the shuffle too (WindowGroupLimit), so a
    key that holds a third of all rows sends one row per task."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn(_RANK, F.row_number().over(w)).where(F.col(_RANK) == 1).drop(_RANK)


def newest_order(updated: str, delivery: str) -> list[Column]:
    """Latest instant first, no instant last, then the smallest delivery."""
    return [F.col(updated).desc_nulls_last(), F.col(delivery).asc()]


def redelivered(df: DataFrame, key: str, updated: str, delivery: str) -> DataFrame:
    """The rows to be dropped so that one row per key stays, the one first in newest_order; only the delivery column.

    key null: never dropped. updated null: the earliest. Equal rows differ in delivery, which must be unique and not
    null. An empty table gives an empty result. The keepers are ranked once; the rest is an anti-join on the unique
    delivery number, which cannot be skewed.
    """
    keyed = df.select(delivery, key, updated).where(F.col(key).isNotNull())
    kept = ranked_first(keyed, key, newest_order(updated, delivery)).select(delivery)
    return keyed.select(delivery).join(kept, delivery, "left_anti")


def deduplicated(df: DataFrame, key: str, updated: str, delivery: str) -> DataFrame:
    """All rows but redelivered(df): one per key and every row without a key, with all columns of df."""
    return df.join(redelivered(df, key, updated, delivery), delivery, "left_anti")


def admit_batch(stored_keys: DataFrame, batch: DataFrame, key: str, updated: str, delivery: str) -> DataFrame:
    """The rows of a new batch whose key is not stored yet, one per key, and those without a key. stored_keys needs only
    the column key; it may hold nulls and repeats. The batch is cut to one row per key first, so a key that fills the
    batch meets the anti-join once."""
    columns = batch.columns
    fresh = ranked_first(batch, key, newest_order(updated, delivery)).join(stored_keys.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return fresh.select(columns).unionByName(batch.where(F.col(key).isNull()).select(columns))
