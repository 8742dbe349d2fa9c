"""Problem 5: mixed timestamp formats and time zones become one instant in UTC."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.functions.shapes import NONE, instants_ms
from wayledger.functions.zones import zone_tables
from wayledger.session import broadcast_if_small

#: A dimension of feeds or zones is broadcast up to this many rows, and joined by shuffle beyond.
SMALL = 100_000

EPOCH_MS = "^[0-9]{13}$"
ISO_Z = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"


def known_zones(feeds: DataFrame) -> dict:
    """Transition tables of the zones that feeds name; there are a few hundred zones in all, whatever the data."""
    return zone_tables(sorted(r[0] for r in feeds.select("zone_name").where("zone_name is not null").distinct().collect()))  # a row a name


def with_feed_rules(df: DataFrame, feeds: DataFrame, feed: str = "feed") -> DataFrame:
    """df with the columns _zone and _day_first of its feed; null for an unknown or missing feed. The feeds are made unique
    first, so that no row is multiplied."""
    rules = feeds.groupBy(F.col("feed").alias("_feed")).agg(F.min("zone_name").alias("_zone"), F.min("day_first").alias("_day_first"))
    return df.join(broadcast_if_small(rules, SMALL), df[feed] == rules["_feed"], "left").drop("_feed")


def instant_udf(tables: dict):
    """(value, zone, day_first) -> epoch milliseconds, by shape masks, batch by batch."""

    @F.pandas_udf("long")
    def instant(values: pd.Series, zones: pd.Series, day_first: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=values.index, dtype="Int64")
        own = values.notna().to_numpy()
        if own.any():
            ms = instants_ms(values[own].tolist(), [z if isinstance(z, str) else None for z in zones[own]], [None if x is None or x != x else x for x in day_first[own]], tables)
            out[own] = pd.array(ms, dtype="Int64")
            out[out == NONE] = pd.NA
        return out

    return instant


def instant_ms(value: Column, zone: Column, day_first: Column, tables: dict) -> Column:
    """Epoch milliseconds of a text. The usual form of 13 digits is read by the JVM; only the rest reaches Python."""
    usual = value.rlike(EPOCH_MS)
    quick = F.when(usual, F.nullif(value.try_cast("long"), F.lit(0).cast("long")))
    return F.coalesce(quick, instant_udf(tables)(F.when(~usual, value), zone, day_first))


def unusual_instants(df: DataFrame, feeds: DataFrame, key: str, fields: dict[str, str], feed: str = "feed", src_table: str = "") -> DataFrame:
    """One row (src_table, row_key, field_name, utc_ms) for each value of the fields that denotes an instant and does not
    match its field's usual form (fields: name -> pattern of that form).

    Values without a zone are local time of the feed's zone; all-number dates that don't begin with the year have the
    feed's order of day and month. An unknown feed counts as UTC and day first. Null, blank, zero, words, impossible
    dates and values of no known form denote no instant and give no row. Repeated rows give repeated results. No
    shuffle: filters and the feeds' rules run in the JVM, and only unusual values reach Python.
    """
    tables = known_zones(feeds)
    cases = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.when(~F.col(f).rlike(usual), F.col(f)).alias("value")) for f, usual in fields.items()]))
    rows = df.select(F.col(key).cast("long").alias("row_key"), F.col(feed).alias("_f"), cases.alias("case")).select("row_key", "_f", "case.*").where(F.col("value").rlike("[1-9]"))
    rows = with_feed_rules(rows, feeds, "_f").select("row_key", "field_name", "value", "_zone", "_day_first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ms = instants_ms(b["value"].to_pylist(), b["_zone"].to_pylist(), b["_day_first"].to_pylist(), tables)
            yield pa.RecordBatch.from_arrays([b["row_key"], b["field_name"], pa.array(ms, mask=ms == NONE)], ["row_key", "field_name", "utc_ms"])

    found = rows.mapInArrow(read, "row_key long, field_name string, utc_ms long").where("utc_ms is not null")
    return found.select(F.lit(src_table).alias("src_table"), "row_key", "field_name", "utc_ms")
