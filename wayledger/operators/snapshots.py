"""Problem 2: what changed between full snapshots."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.session import shuffle_partitions

#: Rows of compact keys that one bucket holds at most on average: 40 bytes each.
BUCKET_ROWS = 400_000


def _diff(bucket: pd.DataFrame, snapshots: list[int]) -> pd.DataFrame:
    """Changes within one bucket of compact rows (snapshot_no, k1, k2, state)."""
    k1, k2, state, no = (bucket[c].to_numpy() for c in ("k1", "k2", "state", "snapshot_no"))
    order = np.lexsort((k2, k1))
    new = np.r_[True, (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)] if len(order) else np.zeros(0, bool)
    key = np.empty(len(order), dtype=np.int64)
    key[order] = np.cumsum(new) - 1  # equal 128-bit keys share a number
    by = np.lexsort((key, no))
    key_s, state_s = key[by], state[by]
    lo, hi = (np.searchsorted(no[by], snapshots, side=s) for s in ("left", "right"))
    out = []
    for i in range(1, len(snapshots)):
        a, b = slice(lo[i - 1], hi[i - 1]), slice(lo[i], hi[i])
        old, now = key_s[a], key_s[b]  # each sorted and unique
        at = np.searchsorted(old, now)
        held = np.zeros(len(now), dtype=bool)
        inside = at < len(old)
        held[inside] = old[at[inside]] == now[inside]
        back = np.searchsorted(now, old)
        still = np.zeros(len(old), dtype=bool)
        inside = back < len(now)
        still[inside] = now[back[inside]] == old[inside]
        differ = held.copy()
        differ[held] = state_s[a][at[held]] != state_s[b][held]
        for kind, rows, value_in in (("added", by[b][~held], snapshots[i]), ("removed", by[a][~still], snapshots[i - 1]), ("changed", by[b][differ], snapshots[i])):
            if len(rows):
                out.append(pd.DataFrame({"snapshot_no": snapshots[i], "value_no": value_in, "k1": k1[rows], "k2": k2[rows], "state": state[rows], "change_kind": kind}))
    return pd.concat(out) if out else pd.DataFrame({"snapshot_no": no[:0], "value_no": no[:0], "k1": k1[:0], "k2": k2[:0], "state": state[:0], "change_kind": np.array([], dtype=object)})


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, key: str, state: str, preferred: str | None = None) -> DataFrame:
    """(snapshot_no, <key>, change_kind): keys added, removed or with another state, of each snapshot against the one with
    the next smaller number present.

    rows: snapshot_no, key and state, already in the form in which they are compared; snapshots: all rows that show which
    snapshot numbers are present. Rows with a null or empty key, and rows with a null snapshot_no, are left out; a null
    state equals an empty one. Where a key stands in a snapshot with several states, `preferred` counts if it is among
    them, else the smallest. One snapshot, or none, gives an empty result. Repeated rows count once.

    Each (snapshot, key) becomes 128 hash bits of the key and 64 of the state, in one aggregation. Those are dealt into
    buckets by hash and compared as sorted arrays; only the keys that differ are joined back to their full values.
    """
    spark = rows.sparkSession
    present = sorted(r[0] for r in snapshots.select("snapshot_no").distinct().where("snapshot_no is not null").collect())  # one number a snapshot
    value = F.coalesce(F.col(state), F.lit(""))
    held = rows.where(F.col("snapshot_no").isNotNull() & (F.col(key) != "")).select("snapshot_no", F.col(key).alias("_key"), value.alias("_value"))
    one = (
        held.withColumns({"k1": F.xxhash64("_key"), "k2": F.xxhash64(F.lit("second"), "_key")})
        .groupBy("snapshot_no", "k1", "k2")
        .agg(F.min("_key").alias("_key"), F.max(F.col("_value") == F.lit(preferred or "")).alias("_p"), F.min("_value").alias("_s"))
        .where(F.col("_key") != "")  # holds for all; it keeps the key in both uses, see below
        .select("snapshot_no", "k1", "k2", "_key", F.xxhash64(F.when(F.col("_p"), F.lit(preferred or "")).otherwise(F.col("_s"))).alias("state"))
    )
    buckets = max(shuffle_partitions(spark), math.ceil(rows.count() / BUCKET_ROWS))
    compact = one.select(F.pmod("k1", F.lit(buckets)).alias("bucket"), "snapshot_no", "k1", "k2", "state")
    schema = "snapshot_no int, value_no int, k1 long, k2 long, state long, change_kind string"
    diff = compact.groupBy("bucket").applyInPandas(lambda pdf: _diff(pdf, present), schema)
    # the state is no news here, but with it and the key both uses of `one` are the same shuffle, made once; values lie
    # as they are joined, so only the differing keys are moved
    values = one.select(F.col("snapshot_no").alias("value_no"), "k1", "k2", "state", F.col("_key").alias(key))
    return diff.join(values, ["value_no", "k1", "k2", "state"]).select("snapshot_no", key, "change_kind")
