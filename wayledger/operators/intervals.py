"""Problem 3: overlapping and gapped time intervals.

The time axis is cut into slabs, so that the unit of work is an entity within a slab and no entity, however large, is
the work of one task. Within a slab an ordered map of disjoint intervals is kept per entity; what reaches over the
slab's edges is joined up afterwards from two rows a slab at most.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayledger.session import use_checkpoints

DAY_MS = 86_400_000
#: Stands for the slab of ranges of slabs.
RANGE = -(1 << 62)


class IntervalMap:
    """Disjoint intervals in order. Touching intervals are one."""

    __slots__ = ("starts", "ends")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def insert(self, lo: int, hi: int) -> None:
        """Locates by binary search the intervals that [lo, hi] overlaps or touches and puts their union in their place."""
        i = bisect_left(self.ends, lo)
        j = bisect_right(self.starts, hi)
        if i < j:
            lo, hi = min(lo, self.starts[i]), max(hi, self.ends[j - 1])
        self.starts[i:j] = [lo]
        self.ends[i:j] = [hi]

    def gaps(self) -> Iterator[tuple[int, int]]:
        return zip(self.ends[:-1], self.starts[1:])


_PIECES = "entity string, slab long, from_ms long, to_ms long"


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, type=schema.field(n).type) for c, n in zip(columns, names)], schema=schema)


def _premerge(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Merges within a map task, before the shuffle. State is emitted and begun anew at `most` insertions."""
    schema = pa.schema([("entity", pa.string()), ("slab", pa.int64()), ("from_ms", pa.int64()), ("to_ms", pa.int64())])
    state: dict[tuple, IntervalMap] = {}

    def emit() -> pa.RecordBatch:
        rows = [(e, s, a, b) for (e, s), m in state.items() for a, b in zip(m.starts, m.ends)]
        state.clear()
        return _batch(rows, schema.names, schema)

    n = 0
    for b in batches:
        for e, s, lo, hi in zip(*(b[c].to_pylist() for c in schema.names)):
            m = state.get((e, s))
            if m is None:
                m = state[e, s] = IntervalMap()
            m.insert(lo, hi)
        n += b.num_rows
        if n >= most:
            yield emit()
            n = 0
    yield emit()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by entity and slab; the state is that of the current one."""
    schema = pa.schema([("entity", pa.string()), ("slab", pa.int64()), ("kind", pa.string()), ("from_ms", pa.int64()), ("to_ms", pa.int64())])
    key, state, rows = None, IntervalMap(), []

    def close() -> None:
        if key is not None:
            rows.extend((*key, "piece", a, b) for a, b in zip(state.starts, state.ends))
            rows.extend((*key, "gap", a, b) for a, b in state.gaps())
            rows.append((*key, "reach", state.starts[0], state.ends[-1]))

    for b in batches:
        for e, s, lo, hi in zip(*(b[c].to_pylist() for c in ("entity", "slab", "from_ms", "to_ms"))):
            if (e, s) != key:
                close()
                key, state = (e, s), IntervalMap()
                if len(rows) > 50_000:
                    yield _batch(rows, schema.names, schema)
                    rows.clear()
            state.insert(lo, hi)
    close()
    yield _batch(rows, schema.names, schema)


def _islands(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """(entity, lo, hi): the unions of an entity's intervals that overlap or touch; few rows an entity."""
    w = Window.partitionBy("entity").orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce((reach < F.col(lo)).cast("int"), F.lit(1)))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("entity", "_run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_run")


def periods_and_gaps(df: DataFrame, entity: str, from_ms: str, to_ms: str, slab_ms: int = 64 * DAY_MS, long_slabs: int = 16) -> DataFrame:
    """(entity, span_kind, from_ms, to_ms): the continuous `period`s of each entity and the `gap`s between neighbouring ones.

    Rows with a null entity or bound, or whose end isn't after their start, are left out; touching intervals are
    continuous; repeated rows change nothing; an empty table gives an empty result. An entity with one period has no gap.

    An interval over up to long_slabs slabs is cut into a piece for each. Of a longer one, such as one with an open end
    that is written as a far year, only the first and the last piece are cut; the slabs between are kept as one range,
    ranges are merged per entity, and what lies in a slab within a range is dropped, as it changes nothing.

    df is read once and merged once: pieces and ranges go through the same merge, whose output, a few rows for each entity
    and slab, is checkpointed for the three places where it is used.
    """
    use_checkpoints(df.sparkSession)
    rows = df.select(F.col(entity).cast("string").alias("entity"), F.col(from_ms).cast("long").alias("a"), F.col(to_ms).cast("long").alias("b"))
    slab = F.lit(slab_ms).cast("long")
    rows = rows.where("entity is not null and a < b").withColumns({"s0": F.floor(F.col("a") / slab), "s1": F.floor((F.col("b") - 1) / slab)})
    short = F.col("s1") - F.col("s0") <= long_slabs
    # a long interval has a third row, its range of slabs that are covered from end to end, under a slab of its own
    slabs = F.when(short, F.sequence("s0", F.when(short, F.col("s1")).otherwise(F.col("s0")))).otherwise(F.array("s0", "s1", F.lit(RANGE)))
    cut = rows.select("entity", "a", "b", "s0", "s1", F.explode(slabs).alias("slab"))
    ranged = F.col("slab") == RANGE
    first = F.when(ranged, F.col("s0") + 1).otherwise(F.greatest("a", F.when(~ranged, F.col("slab")) * slab))
    last = F.when(ranged, F.col("s1")).otherwise(F.least("b", (F.when(~ranged, F.col("slab")) + 1) * slab))
    cut = cut.select("entity", "slab", first.alias("from_ms"), last.alias("to_ms"))
    everything = cut.mapInArrow(_premerge, _PIECES).repartition("entity", "slab").sortWithinPartitions("entity", "slab").mapInArrow(_merge, "entity string, slab long, kind string, from_ms long, to_ms long").checkpoint()
    merged = everything.where(F.col("slab") != RANGE)
    ranges = everything.where((F.col("slab") == RANGE) & (F.col("kind") == "piece")).select("entity", "from_ms", "to_ms")
    spans = ranges.select(F.col("entity").alias("_e"), F.col("from_ms").alias("_lo"), F.col("to_ms").alias("_hi"))
    merged = merged.join(spans, (F.col("entity") == F.col("_e")) & (F.col("slab") >= F.col("_lo")) & (F.col("slab") < F.col("_hi")), "left_anti")
    covered = ranges.select("entity", (F.col("from_ms") * slab).alias("from_ms"), (F.col("to_ms") * slab).alias("to_ms"))
    at_edge = (F.col("from_ms") == F.col("slab") * slab) | (F.col("to_ms") == (F.col("slab") + 1) * slab)
    inner = merged.where((F.col("kind") == "gap") | ((F.col("kind") == "piece") & ~at_edge)).select("entity", F.when(F.col("kind") == "gap", "gap").otherwise("period").alias("span_kind"), "from_ms", "to_ms")
    # two edge pieces and one reach at most for each entity and slab
    edge = merged.where((F.col("kind") == "piece") & at_edge).select("entity", "from_ms", "to_ms").unionByName(covered)
    joined = _islands(edge, "from_ms", "to_ms").select("entity", F.lit("period").alias("span_kind"), "from_ms", "to_ms")
    w = Window.partitionBy("entity").orderBy("from_ms")
    reach = merged.where("kind = 'reach'").select("entity", "from_ms", "to_ms").unionByName(covered)
    reach = reach.select("entity", F.lag("to_ms").over(w).alias("g"), F.col("from_ms").alias("h"))
    between = reach.where("g < h").select("entity", F.lit("gap").alias("span_kind"), F.col("g").alias("from_ms"), F.col("h").alias("to_ms"))
    return inner.unionByName(joined).unionByName(between)
