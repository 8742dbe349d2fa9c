"""Aggregations over near_pairs: counts, weights, nearest, first, existence; several radii; pairs near in time too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.operators.places import containing_regions, near_pairs
from wayledger.operators.temporal import sum_before

_AT = ("olat", "olng")


def radius_summary(points: DataFrame, key: str, others: DataFrame, radius_m: float, sums: dict[str, Column]) -> DataFrame:
    """points' key with each sum over the others (olat, olng, ...) less than radius_m away; 0 where there is none. Sums may
    use distance_m and the others' columns."""
    near = near_pairs(points.select(key, "lat", "lng"), others, radius_m, other=_AT)
    got = near.groupBy(key).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    return points.select(key).join(got, key, "left").select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in sums])


def falling_weight(radius_m: float) -> Column:
    """1 at the place itself, 0 at the radius."""
    return F.greatest(F.lit(0.0), 1.0 - F.col("distance_m") / radius_m)


def nearest_within(points: DataFrame, key: str, others: DataFrame, radius_m: float, tie: str) -> DataFrame:
    """(key, columns of others, distance_m): the nearest other less than radius_m away, of equally near ones that with the
    smallest tie."""
    near = near_pairs(points.select(key, "lat", "lng"), others, radius_m, other=_AT)
    rest = [*others.columns, "distance_m"]
    best = near.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("distance_m", tie)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def first_within(points: DataFrame, key: str, others: DataFrame, radius_m: float, order: str) -> DataFrame:
    """(key, columns of others): the first other by order, not the nearest, less than radius_m away."""
    near = near_pairs(points.select(key, "lat", "lng"), others, radius_m, other=_AT)
    best = near.groupBy(key).agg(F.min_by(F.struct(*others.columns), order).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in others.columns])


def any_within(points: DataFrame, key: str, others: DataFrame, radius_m: float) -> DataFrame:
    """Keys of the points that have another within the radius."""
    return near_pairs(points.select(key, "lat", "lng"), others.select(*_AT), radius_m, other=_AT).select(key).distinct()


def kind_points(points: DataFrame, key: str, others: DataFrame, kinds: dict[str, tuple[float, float]]) -> DataFrame:
    """(key, score): points for each other of a kind within that kind's radius (kinds: kind -> (radius, points)). One join
    at the largest radius for all kinds."""
    most = max(r for r, _ in kinds.values())
    radius = F.create_map(*[x for k, (r, _) in kinds.items() for x in (F.lit(k), F.lit(float(r)))])
    worth = F.create_map(*[x for k, (_, p) in kinds.items() for x in (F.lit(k), F.lit(float(p)))])
    return radius_summary(points, key, others.where(F.col("kind").isin(*kinds)), most, {"score": F.when(F.col("distance_m") < radius[F.col("kind")], worth[F.col("kind")]).otherwise(0.0)})


def near_in_time(df: DataFrame, key: str, start: str, end: str, radius_m: float) -> DataFrame:
    """(a, b): pairs of different rows, a before b, less than radius_m apart whose times overlap; all four times needed."""
    own = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    left = own.select(F.col(key).alias("a"), "lat", "lng", F.col(start).alias("_as"), F.col(end).alias("_ae"))
    right = own.select(F.col(key).alias("b"), F.col("lat").alias("olat"), F.col("lng").alias("olng"), F.col(start).alias("_bs"), F.col(end).alias("_be"))
    pairs = near_pairs(left, right, radius_m, other=_AT)
    return pairs.where((F.col("a") < F.col("b")) & (F.col("_as") <= F.col("_be")) & (F.col("_bs") <= F.col("_ae"))).select("a", "b")


def first_region(points: DataFrame, key: str, regions: DataFrame, region: str, ring: str, order: str, default: str = "") -> DataFrame:
    """(key, region): the first region by order that contains each point, or a default."""
    named = regions.select(F.concat_ws("\u0001", F.lpad(F.col(order).cast("string"), 12, "0"), F.col(region)).alias("_r"), F.col(ring).alias("_ring"))
    hit = containing_regions(points.select(key, "lat", "lng"), named, "_r", "_ring").groupBy(key).agg(F.min("region_id").alias("_m"))
    return points.select(key).join(hit, key, "left").select(key, F.coalesce(F.substring_index("_m", "\u0001", -1), F.lit(default)).alias(region))


def near_on_days(df: DataFrame, key: str, start_day: str, end_day: str, events: DataFrame, event: str, inclusive: bool = True) -> DataFrame:
    """(key, event, day, distance_m): each row of df (lat, lng) with each event (lat, lng, radius_m, days: a sorted list of
    day numbers) within the event's own radius, and the first of its days between start and end; a missing end is open.

    One grid join at the largest radius of all events; lists of days aren't multiplied out."""
    most = events.agg(F.max("radius_m")).first()[0] or 1.0
    there = events.select(F.col(event).alias("_event"), F.col("lat").alias("olat"), F.col("lng").alias("olng"), "radius_m", "days")
    pairs = near_pairs(df.select(key, "lat", "lng", F.col(start_day).alias("_a"), F.col(end_day).alias("_b")), there, float(most), other=_AT, keep="<=")
    within = F.col("distance_m") <= F.col("radius_m") if inclusive else F.col("distance_m") < F.col("radius_m")
    day = F.try_element_at(F.filter("days", lambda d: (F.col("_a") <= d) & F.coalesce(d <= F.col("_b"), F.lit(True))), F.lit(1))
    return pairs.where(within).withColumn("day", day).where("day is not null").select(key, F.col("_event").alias(event), "day", "distance_m")


def vertices(lines: DataFrame, key: str, path: str) -> DataFrame:
    """(key, vertex_no, lat, lng) of polylines whose vertices are [lng, lat]."""
    return lines.select(key, F.posexplode(path).alias("vertex_no", "_v")).select(key, "vertex_no", F.col("_v")[1].alias("lat"), F.col("_v")[0].alias("lng"))


def line_means(lines: DataFrame, key: str, path: str, others: DataFrame, order: str, value: str, radius_m: float) -> DataFrame:
    """(key, mean, hits): for each vertex of a line the first of the others by order, with a value above 0, less than
    radius_m away; the mean of their values over the line's vertices that have one, 0 if none has."""
    v = vertices(lines, key, path).withColumn("_vertex", F.struct(key, "vertex_no"))
    hit = first_within(v, "_vertex", others.where(F.col(value) > 0), radius_m, order)
    got = hit.groupBy(F.col(f"_vertex.{key}").alias(key)).agg(F.avg(value).alias("mean"), F.count("*").alias("hits"))
    return lines.select(key).join(got, key, "left").select(key, F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def near_lines(points: DataFrame, key: str, lines: DataFrame, line: str, path: str, radius_m: float) -> DataFrame:
    """(line, key, distance_m): points less than radius_m from a vertex of a line, with the distance to the nearest one."""
    v = vertices(lines, line, path).select(line, F.col("lat").alias("olat"), F.col("lng").alias("olng"))
    return near_pairs(points.select(key, "lat", "lng"), v, radius_m, other=_AT).groupBy(line, key).agg(F.min("distance_m").alias("distance_m"))


def overlap_counts(df: DataFrame, entity: str, start_day: str, end_day: str, width: float = 32) -> DataFrame:
    """(entity, pairs): how many pairs of an entity's rows overlap or touch, by days; rows without a start count in none,
    a missing end is open. All pairs, less those of which one ended before the other began: those are counted from running
    sums over the days (or instants) that occur, made within slabs of a width, so no pair is formed and no entity is the
    work of one task."""
    own = df.where(F.col(start_day).isNotNull() & (F.col(end_day).isNull() | (F.col(end_day) >= F.col(start_day))))
    begun = own.groupBy(entity, F.col(start_day).alias("_d")).agg(F.count("*").alias("_s"), F.lit(0).cast("long").alias("_e"))
    ended = own.where(F.col(end_day).isNotNull()).groupBy(entity, F.col(end_day).alias("_d")).agg(F.lit(0).cast("long").alias("_s"), F.count("*").alias("_e"))
    days = begun.unionByName(ended).groupBy(entity, "_d").agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"))
    n = sum_before(days, entity, "_d", "_e", "_ended", width).groupBy(entity).agg(F.sum("_s").alias("_n"), F.sum(F.col("_s") * F.col("_ended")).alias("_apart"))
    return n.select(entity, (F.col("_n") * (F.col("_n") - 1) / 2 - F.col("_apart")).cast("long").alias("pairs"))
