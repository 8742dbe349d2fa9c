"""Streaming forms: exactly one copy of each message, interval maps kept in keyed state, and the archive of snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayledger.operators.dedupe import archive_additions
from wayledger.operators.intervals import IntervalMap
from wayledger.operators.redelivery import admit_batch
from wayledger.sources.sinks import append_archive


def once_per_message(stream: DataFrame, key: str, at: str, within: str = "30 days") -> DataFrame:
    """One copy of each message among those that arrive within a time of each other; state older than that is dropped, so
    copies that come later pass. once_per_message_ever has no such bound."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def once_per_message_ever(store: str, key: str, updated: str, delivery: str):
    """A function for foreachBatch that admits of each batch one row a key that no earlier batch brought, the newest of the
    batch, however late a copy comes, and keeps it under store/batch=n. A batch that is run again gives the same."""
    from wayledger.sources.landed import exists

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(store).where(F.col("batch") < batch_id) if exists(spark, f"{store}/batch=*") else batch.limit(0)
        admit_batch(stored.select(key), batch, key, updated, delivery).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return run


def interval_state(stream: DataFrame, entity: str, from_ms: str, to_ms: str) -> DataFrame:
    """(entity, span_kind, from_ms, to_ms, version): whenever an entity gets new intervals, its periods and gaps anew, with
    a rising version. The state of an entity is its ordered map of disjoint intervals; an insertion finds what it overlaps
    by binary search. Rows with nulls or an end that isn't after the start are left out."""
    rows = stream.select(F.col(entity).cast("string").alias("entity"), F.col(from_ms).cast("long").alias("from_ms"), F.col(to_ms).cast("long").alias("to_ms")).where("entity is not null and from_ms < to_ms")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = IntervalMap()
        version = 0
        if state.exists:
            text, version = state.get
            held.starts, held.ends = json.loads(text)
        for pdf in batches:
            for a, b in zip(pdf["from_ms"].tolist(), pdf["to_ms"].tolist()):
                held.insert(a, b)
        state.update((json.dumps([held.starts, held.ends]), version + 1))
        spans = [("period", a, b) for a, b in zip(held.starts, held.ends)] + [("gap", a, b) for a, b in held.gaps()]
        yield pd.DataFrame([(key[0], k, a, b, version + 1) for k, a, b in spans], columns=["entity", "span_kind", "from_ms", "to_ms", "version"])

    return rows.groupBy("entity").applyInPandasWithState(update, "entity string, span_kind string, from_ms long, to_ms long, version long", "intervals string, version long", "update", GroupStateTimeout.NoTimeout)


def archive_snapshots(current: str, archive: str, key: str, order: str):
    """A function for foreachBatch: each batch is a full snapshot; rows of the one before that it lacks are archived, then
    it becomes the current one. A batch that is run again changes nothing, as archived keys are left out."""
    from wayledger.sources.landed import exists

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        here = f"{current}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(here)
        before = f"{current}/batch={batch_id - 1}"
        if exists(spark, before):
            old = spark.read.parquet(before)
            known = spark.read.parquet(archive) if exists(spark, archive) else old.limit(0)
            append_archive(archive_additions(old, spark.read.parquet(here), known.select(key), key, [F.col(order)]), archive, key, F.lit(batch_id))

    return run
