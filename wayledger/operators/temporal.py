"""Predicates, joins and series over times. Times are epoch milliseconds, days are whole days since 1970."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayledger.session import broadcast_if_small

DAY = 86_400_000
HOUR = 3_600_000
#: Rows that a slab of a running sum holds on average.
SLAB_ROWS = 50_000


def day_of(ms: str | Column) -> Column:
    return F.floor((F.col(ms) if isinstance(ms, str) else ms) / DAY).cast("long")


def hour_of(ms: str | Column) -> Column:
    return F.floor(F.pmod(F.col(ms) if isinstance(ms, str) else ms, F.lit(DAY)) / HOUR).cast("int")


def active_on(start: str, end: str, day: int | Column) -> Column:
    """Whether a day lies between start and end day, both required."""
    d = F.lit(day) if isinstance(day, int) else day
    return F.coalesce((day_of(start) <= d) & (day_of(end) >= d), F.lit(False))


def active_at_hour(start: str, end: str, hour: int | Column) -> Column:
    """Whether an hour of day lies between the hours of start and end, inclusive. No start hour, or 0, means all day; no
    end hour, or 0, means 23."""
    h = F.lit(hour) if isinstance(hour, int) else hour
    a, b = F.coalesce(hour_of(start), F.lit(0)), F.coalesce(hour_of(end), F.lit(0))
    return (a == 0) | ((h >= a) & (h <= F.when(b == 0, 23).otherwise(b)))


def hourly_counts(df: DataFrame, start: str, end: str) -> DataFrame:
    """24 rows (hour, n): rows active at each hour. Rows are counted by their range of hours first, and only those few
    counts are spread over the hours."""
    a, b = F.coalesce(hour_of(start), F.lit(0)), F.coalesce(hour_of(end), F.lit(0))
    first, last = F.when(a == 0, 0).otherwise(a), F.when((a == 0) | (b == 0), 23).otherwise(b)
    shape = df.select(first.alias("f"), last.alias("l")).where("f <= l").groupBy("f", "l").agg(F.count("*").alias("n"))
    per = shape.select("n", F.explode(F.sequence("f", "l")).alias("hour")).groupBy("hour").agg(F.sum("n").alias("n"))
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(per, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def hourly_bars(hourly: DataFrame, low: float = 6.0, rise: float = 38.0) -> DataFrame:
    """hourly (hour, n; 24 rows) with height: low at the fewest, low + rise at the most, and is_peak, the first hour with
    the most. All the same, every height is low."""
    every = Window.partitionBy()  # 24 rows
    least, most = F.min("n").over(every), F.max("n").over(every)
    part = F.coalesce(F.try_divide(F.col("n") - least, most - least), F.lit(0.0))
    first = F.min(F.struct(-F.col("n"), F.col("hour"))).over(every)["hour"]
    return hourly.select("hour", "n", F.floor(F.lit(low) + part * F.lit(rise) + 0.5).cast("long").alias("height"), (F.col("hour") == first).alias("is_peak"))


def daily_counts(df: DataFrame, start: str, end: str, first_day: int, days: int, key: str | None = None) -> DataFrame:
    """(day, [key,] n) for each day of a window, and key: rows active on it. From the counts of begins and ends, whose sums
    are run up day by day; the cost doesn't depend on how long the rows last."""
    last_day = first_day + days - 1
    keys = [key] if key else []
    own = df.select(*keys, F.greatest(day_of(start), F.lit(first_day)).alias("a"), day_of(end).alias("b"), day_of(start).alias("s")).where(f"s is not null and b is not null and a <= b and a <= {last_day}")
    moves = own.groupBy(*keys, F.col("a").alias("day")).agg(F.count("*").alias("m")).unionByName(own.where(f"b < {last_day}").groupBy(*keys, (F.col("b") + 1).alias("day")).agg((-F.count("*")).alias("m")))
    moves = moves.groupBy(*keys, "day").agg(F.sum("m").alias("m"))
    grid = df.sparkSession.range(first_day, first_day + days).select(F.col("id").alias("day"))
    if key:  # keys x days is the result's own size
        grid = own.select(key).distinct().select(key, F.explode(F.sequence(F.lit(first_day).cast("long"), F.lit(last_day).cast("long"))).alias("day"))
    full = grid.join(moves, [*keys, "day"], "left")
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return full.select(*keys, "day", F.sum(F.coalesce("m", F.lit(0))).over(w).alias("n"))


def stacked(daily: DataFrame, key: str, order: list[str]) -> DataFrame:
    """daily with upto: the sum over the keys up to each one, in the given order (the layers of a stacked chart)."""
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col(key))
    w = Window.partitionBy("day").orderBy("_o", key).rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("_o", F.when(rank == 0, 99).otherwise(rank)).withColumn("upto", F.sum("n").over(w)).drop("_o")


def in_ranges(df: DataFrame, day: str, ranges: list[tuple[str, int, int]], default: str) -> DataFrame:
    """df with term: the name of the first of the ranges (name, first day, last day), a table of terms, that holds the day."""
    hit = [F.when(F.col(day).between(a, b), F.lit(name)) for name, a, b in ranges]
    return df.withColumn("term", F.coalesce(*hit, F.lit(default)))


def overlap_pairs(df: DataFrame, key: str, entity: str, start: str, end: str, slab: int = 32) -> DataFrame:
    """(key, a, b): pairs of one entity's rows, a before b by key, whose times overlap or touch. A missing start or end is
    open. The time axis is cut into slabs of days; a pair meets in the slab where the later of the two begins, so that it
    comes out once and an entity with many rows is the work of many tasks."""
    low, high = -(1 << 40), 1 << 40
    rows = df.where(F.col(entity).isNotNull()).select(F.col(entity).alias("e"), F.col(key).alias("k"), F.coalesce(F.col(start).cast("long"), F.lit(low * DAY // 1024)).alias("s"), F.coalesce(F.col(end).cast("long"), F.lit(high * DAY // 1024)).alias("t")).where("s <= t")
    size = slab * DAY
    range_ = rows.agg(F.floor(F.min(F.when(F.col("s") > low * DAY // 1024, F.col("s"))) / size).alias("lo"), F.floor(F.max(F.when(F.col("t") < high * DAY // 1024, F.col("t"))) / size).alias("hi")).first()
    lo, hi = (range_[0] or 0), (range_[1] or range_[0] or 0)
    held = lambda c: F.greatest(F.lit(lo), F.least(F.lit(hi), F.floor(F.col(c) / size)))
    cut = rows.select("*", held("s").alias("s0"), F.explode(F.sequence(held("s"), held("t"))).alias("slab"))
    a, b = (cut.select(*[F.col(c).alias(f"{p}{c}") for c in cut.columns]) for p in "ab")
    pairs = a.join(b, (F.col("ae") == F.col("be")) & (F.col("aslab") == F.col("bslab")) & (F.col("ak") < F.col("bk")) & (F.col("as") <= F.col("bt")) & (F.col("bs") <= F.col("at")))
    return pairs.where(F.col("aslab") == F.greatest("as0", "bs0")).select(F.col("ae").alias(entity), F.col("ak").alias("a"), F.col("bk").alias("b"))


def overlapping(df: DataFrame, entity: str, start: str, end: str, width: float = 32 * DAY) -> DataFrame:
    """The rows that overlap or touch another row of their entity; start and end not null. A row does if one before it, by
    start, reaches it, or the next one begins before it ends. Rows are ordered within slabs of the start only; what other
    slabs add is one farthest end and one first start for each, so no entity is the work of one task."""
    own = df.withColumn("_slab", F.floor(F.col(start) / F.lit(width)))
    w, per = Window.partitionBy(entity, "_slab").orderBy(start, end), Window.partitionBy(entity).orderBy("_slab")
    ends = own.groupBy(entity, "_slab").agg(F.max(end).alias("_far"), F.min(start).alias("_near"))
    ends = ends.select(entity, "_slab", F.max("_far").over(per.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.lead("_near").over(per).alias("_after"))
    reach = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    flagged = own.join(ends, [entity, "_slab"]).withColumns({"_reach": reach, "_next": F.coalesce(F.lead(start).over(w), F.col("_after"))})
    return flagged.where((F.col("_reach") >= F.col(start)) | (F.col("_next") <= F.col(end))).drop("_reach", "_next", "_slab", "_before", "_after")


def sum_before(df: DataFrame, group: str, order: str, value: str, name: str, width: float) -> DataFrame:
    """df with name: the sum of value over the rows of the group before each, by the order column, whose values are unique
    in a group and not null. The order is cut into slabs of a width; sums of slabs are run up per group, a row a slab, and
    rows within slabs only."""
    own = df.withColumn("_slab", F.floor(F.col(order) / F.lit(width)))
    per = own.groupBy(group, "_slab").agg(F.sum(value).alias("_sum"))
    before = per.select(group, "_slab", F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(group, "_slab").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return own.join(before, [group, "_slab"]).withColumn(name, F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_slab", "_before")


def first_in_interval(df: DataFrame, key: str, start: str, end: str, points: DataFrame, at: str, order: str, also: Column | None = None, slab: int = 64) -> DataFrame:
    """(key, columns of points): for each row the first of the points, by order, that lies between its start and end day.
    An equi-join of slabs of days with the exact test behind it; points are broadcast if they are few."""
    p = points.withColumn("_d", day_of(at)).where("_d is not null").withColumn("_slab", F.floor(F.col("_d") / slab))
    own = df.select(key, day_of(start).alias("_a"), day_of(end).alias("_b"), *[c for c in df.columns if c not in (key, start, end)]).where("_a <= _b")
    # no row goes into more slabs than the points span
    ends = p.agg(F.min("_slab"), F.max("_slab")).first()
    lo, hi = (F.lit(0 if x is None else x).cast("long") for x in ends)
    own = own.withColumns({"_lo": F.greatest(F.floor(F.col("_a") / slab), lo), "_hi": F.least(F.floor(F.col("_b") / slab), hi)}).where("_lo <= _hi")
    own = own.withColumn("_slab", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    joined = own.join(broadcast_if_small(p, 10_000), "_slab").where(F.col("_d").between(F.col("_a"), F.col("_b")) & (also if also is not None else F.lit(True)))
    best = joined.groupBy(key).agg(F.min_by(F.struct(*points.columns), F.col(order)).alias("_p"))
    return best.select(key, *[F.col(f"_p.{c}").alias(c) for c in points.columns])


def heatmap(df: DataFrame, start: str, end: str, first_day: int, profile: list[float], days: int = 7, per_row: float = 0.15, cap: float = 3.0, busy: tuple[int, int] = (7, 18), overlays: DataFrame | None = None, weekend: list[float] | None = None, school: dict[int, float] | None = None, terms: list[tuple[str, int, int]] = ()) -> DataFrame:
    """days x 24 rows (day, hour, flow): a profile by hour, plus an amount for the rows active on the day in busy hours,
    plus overlays (day, hour, extra). Saturdays and Sundays have a profile of their own if one is given; school adds to the
    hours of the other days within terms."""
    active = daily_counts(df, start, end, first_day, days)
    hours = F.explode(F.array(*[F.struct(F.lit(h).alias("hour"), F.lit(float(v)).alias("base")) for h, v in enumerate(profile)]))
    grid = active.withColumn("_h", hours).select("day", "n", "_h.*")
    off = F.pmod(F.col("day") + 3, F.lit(7)) >= 5
    if weekend is not None:
        grid = grid.withColumn("base", F.when(off, F.array(*[F.lit(float(v)) for v in weekend])[F.col("hour")]).otherwise(F.col("base")))
    if school:
        term = in_ranges(grid, "day", list(terms), "")
        run = F.coalesce(F.create_map(*[x for h, v in school.items() for x in (F.lit(h), F.lit(float(v)))])[F.col("hour")], F.lit(0.0))
        grid = term.withColumn("base", F.col("base") + F.when(~off & (F.col("term") != ""), run).otherwise(0.0)).drop("term")
    extra = F.when(F.col("hour").between(*busy), F.least(F.col("n") * F.lit(per_row), F.lit(cap))).otherwise(0.0)
    out = grid.withColumn("flow", F.col("base") + extra)
    if overlays is not None:
        add = overlays.groupBy("day", "hour").agg(F.sum("extra").alias("_x"))
        out = out.join(F.broadcast(add.limit(days * 24)), ["day", "hour"], "left").withColumn("flow", F.col("flow") + F.coalesce("_x", F.lit(0.0)))
    return out.select("day", "hour", F.bround("flow", 2).alias("flow"))


def peak_hours(heat: DataFrame) -> DataFrame:
    """Per day the busiest hour, the earliest of equal ones, and the flows as a list by hour."""
    return heat.groupBy("day").agg(F.max_by("hour", F.struct(F.col("flow"), -F.col("hour"))).alias("peak_hour"), F.max("flow").alias("peak_flow"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hour", "flow"))), lambda x: F.format_number(x["flow"], 2)), " ").alias("flows"))


def running_offset(df: DataFrame, group: str, order: str, duration: str) -> DataFrame:
    """df with offset: the sum of the durations before each row of its group, by a numeric order that is unique there."""
    low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    width = max(1.0, (float(high) - float(low)) / max(1, n // SLAB_ROWS)) if n else 1.0
    return sum_before(df, group, order, duration, "offset", width).withColumn("offset", F.col("offset").cast("long"))
