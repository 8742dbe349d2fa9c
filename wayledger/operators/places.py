"""Problem 4: points near other points or regions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.functions.geo import DEGREE_M, haversine_m
from wayledger.functions.text import settled
from wayledger.session import broadcast_if_small

#: Sides of at most this many rows are broadcast; larger ones are joined by shuffle on their cells.
SMALL = 500_000
#: Rings are broadcast up to this many.
SMALL_RINGS = 20_000


# ---- points near points


def _cells(lat: Column, lng: Column, step_lat: float, step_lng: float) -> list[Column]:
    return [F.floor(lat / F.lit(step_lat)), F.floor(lng / F.lit(step_lng))]


def near_pairs(points: DataFrame, others: DataFrame, radius_m: float, point: tuple[str, str] = ("lat", "lng"), other: tuple[str, str] = ("lat", "lng"), max_abs_lat: float = 80.0, keep: str = "<") -> DataFrame:
    """Each point with each other less than radius_m away (keep '<=': or just as far), with all columns of both and
    distance_m. Column names must not clash.

    An equi-join of grid cells with an exact test: cells are at least radius_m wide up to max_abs_lat, and each other
    stands in its own cell and the eight around it. Null places match nothing. Others are broadcast if they are few.
    """
    step_lat = radius_m * 1.001 / DEGREE_M
    step_lng = step_lat / math.cos(math.radians(min(max_abs_lat, 89.0)))
    (plat, plng), (olat, olng) = point, other
    here = points.where(F.col(plat).isNotNull() & F.col(plng).isNotNull()).withColumns(dict(zip(("_cy", "_cx"), _cells(F.col(plat), F.col(plng), step_lat, step_lng))))
    cy, cx = _cells(F.col(olat), F.col(olng), step_lat, step_lng)
    around = F.explode(F.array(*[F.struct((cy + a).alias("_oy"), (cx + b).alias("_ox")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    there = others.where(F.col(olat).isNotNull() & F.col(olng).isNotNull()).withColumn("_o", around).select(*others.columns, "_o._oy", "_o._ox")
    joined = here.join(broadcast_if_small(there, SMALL), (F.col("_cy") == F.col("_oy")) & (F.col("_cx") == F.col("_ox")))
    d = haversine_m(F.col(plat), F.col(plng), F.col(olat), F.col(olng))
    near = d < radius_m if keep == "<" else d <= radius_m
    return joined.where(near).drop("_cy", "_cx", "_oy", "_ox").withColumn("distance_m", d)


# ---- regions that contain points


def _edges(ring: list[list[float]]) -> list[tuple[float, float, float, float]]:
    """(x1, y1, y2, slope) of the ring's edges that are not level; open rings are closed, repeated vertices drop out."""
    p = [(float(v[0]), float(v[1])) for v in ring if v is not None and len(v) >= 2 and v[0] is not None and v[1] is not None]
    return [(x1, y1, y2, (x2 - x1) / (y2 - y1)) for (x1, y1), (x2, y2) in zip(p, [*p[1:], *p[:1]]) if y1 != y2]


def _inside(x: float, y: float, edges: list[tuple]) -> bool:
    return sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * slope for x1, y1, y2, slope in edges) % 2 == 1


def _meets(segment: tuple, box: tuple) -> bool:
    """Whether a segment has a point in a box (Liang-Barsky), edges included."""
    (x1, y1, x2, y2), (x0, y0, xm, ym) = segment, box
    dx, dy, t0, t1 = x2 - x1, y2 - y1, 0.0, 1.0
    for p, q in ((-dx, x1 - x0), (dx, xm - x1), (-dy, y1 - y0), (dy, ym - y1)):
        if p == 0:
            if q < 0:
                return False
            continue
        t = q / p
        if p < 0:
            t0 = max(t0, t)
        else:
            t1 = min(t1, t)
        if t0 > t1:
            return False
    return True


def cell_step(level: int) -> float:
    """Degrees that a cell of a level spans: 360 / 2^level."""
    return 360.0 / (1 << level)


def cover(ring: list[list[float]], coarsest: int, finest: int) -> list[tuple[int, int, int, bool]]:
    """(level, cx, cy, interior): cells that cover the ring. A cell without any of the border is interior or left out; one
    with border is split until the finest level."""
    p = [(float(v[0]), float(v[1])) for v in ring if v is not None and len(v) >= 2 and v[0] is not None and v[1] is not None]
    if len(p) < 3:
        return []
    segments = [(*a, *b) for a, b in zip(p, [*p[1:], *p[:1]]) if a != b]
    edges, step, out = _edges(ring), cell_step(coarsest), []
    xs, ys = [v[0] for v in p], [v[1] for v in p]
    todo = [
        (coarsest, cx, cy, segments)
        for cx in range(math.floor(min(xs) / step), math.floor(max(xs) / step) + 1)
        for cy in range(math.floor(min(ys) / step), math.floor(max(ys) / step) + 1)
    ]
    while todo:
        level, cx, cy, own = todo.pop()
        s = cell_step(level)
        slack = s * 1e-9
        box = (cx * s - slack, cy * s - slack, (cx + 1) * s + slack, (cy + 1) * s + slack)
        own = [g for g in own if _meets(g, box)]
        if not own:
            if _inside((cx + 0.5) * s, (cy + 0.5) * s, edges):
                out.append((level, cx, cy, True))
        elif level == finest:
            out.append((level, cx, cy, False))
        else:
            todo.extend((level + 1, 2 * cx + a, 2 * cy + b, own) for a in (0, 1) for b in (0, 1))
    return out


def coverage(regions: DataFrame, region: str, ring: str, coarsest: int = 11, finest: int = 17) -> DataFrame:
    """(region_id, level, cx, cy, interior): the cells that cover each region. Made where the regions are, one at a time."""
    names = ["region_id", "level", "cx", "cy", "interior"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, points in zip(b["region_id"].to_pylist(), b["ring"].to_pylist()):
                cells = cover(points or [], coarsest, finest)
                columns = [[name] * len(cells), *([c[k] for c in cells] for k in range(4))]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()))], names)

    source = regions.where(F.col(region).isNotNull()).select(F.col(region).cast("string").alias("region_id"), F.col(ring).alias("ring"))
    return source.mapInArrow(build, "region_id string, level int, cx long, cy long, interior boolean")


def ring_edges(regions: DataFrame, region: str, ring: str) -> DataFrame:
    """(region_id, edges): the edges of each region's ring that aren't level, as [{x, y1, y2, slope}]."""
    edge = pa.struct([("x", pa.float64()), ("y1", pa.float64()), ("y2", pa.float64()), ("slope", pa.float64())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = [[dict(zip(("x", "y1", "y2", "slope"), e)) for e in _edges(r or [])] for r in b["ring"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["region_id"], pa.array(edges, type=pa.list_(edge))], ["region_id", "edges"])

    source = regions.where(F.col(region).isNotNull()).select(F.col(region).cast("string").alias("region_id"), F.col(ring).alias("ring"))
    return source.mapInArrow(build, "region_id string, edges array<struct<x:double,y1:double,y2:double,slope:double>>")


def _sized(cells: DataFrame) -> tuple[DataFrame, list[int]]:
    """The cells, with a broadcast hint if they are proven few, and the levels that occur; one small job for both."""
    counts = {r["level"]: r["count"] for r in cells.groupBy("level").count().collect()}  # a row a level
    return (F.broadcast(cells) if sum(counts.values()) <= SMALL else cells), sorted(counts)


def _odd(x: Column, y: Column) -> Column:
    """Whether a ray from the point crosses an odd number of the column _edges."""
    crossed = F.filter("_edges", lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x"] + (y - e["y1"]) * e["slope"]))
    return F.size(crossed) % 2 == 1


def _level_keys(lat: str, lng: str, levels: list[int]) -> list[Column]:
    return [F.struct(F.lit(k).alias("level"), F.floor(F.col(lng) / cell_step(k)).alias("cx"), F.floor(F.col(lat) / cell_step(k)).alias("cy")) for k in levels]


def containing_regions(points: DataFrame, regions: DataFrame, region: str, ring: str, lat: str = "lat", lng: str = "lng", coarsest: int = 11, finest: int = 17) -> DataFrame:
    """points with region_id, one row for each region whose ring contains the point (even-odd rule, outer ring only).

    An equi-join of cells of every level that occurs; a hit on an interior cell is accepted as it stands, one on a border
    cell is tested exactly against the ring's edges. Regions may overlap or lie in each other. Rings may run either way,
    be open or repeat a vertex; one of under three vertices, or null, contains nothing. Null places match nothing. The
    coverage is broadcast if it is small, else joined by shuffle. A column region_id of the points is replaced.
    """
    cells, levels = _sized(coverage(regions, region, ring, coarsest, finest))
    own = [c for c in points.columns if c != "region_id"]
    if not levels:
        return points.select(*own, F.lit("").alias("region_id")).where(F.lit(False))
    keyed = points.select(*own).where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).withColumn("_k", F.explode(F.array(*_level_keys(lat, lng, levels))))
    cells = cells.select(F.struct("level", "cx", "cy").alias("_c"), F.col("region_id").alias("_region"), F.col("interior").alias("_interior"))
    edges = ring_edges(regions, region, ring).select(F.col("region_id").alias("_region"), F.col("edges").alias("_edges"))
    hits = keyed.join(cells, F.col("_k") == F.col("_c")).join(broadcast_if_small(edges, SMALL_RINGS), "_region")
    return hits.where(F.col("_interior") | _odd(F.col(lng), F.col(lat))).select(*own, F.col("_region").alias("region_id"))


def regions_and_neighbours(points: DataFrame, regions: DataFrame, region: str, ring: str, others: DataFrame, other: str, radius_m: float, max_abs_lat: float = 80.0, coarsest: int = 11, finest: int = 17) -> DataFrame:
    """points (with lat and lng) with target_kind and target: a row with 'region' for each region that contains the point
    and one with 'point' for each other (olat, olng) less than radius_m away. As containing_regions and near_pairs, but in
    one pass over the points and one join, the grid of the others being one more level of cells (level 0)."""
    step_lat = radius_m * 1.001 / DEGREE_M
    step_lng = step_lat / math.cos(math.radians(min(max_abs_lat, 89.0)))
    cells = coverage(regions, region, ring, coarsest, finest).select("level", "cx", "cy", F.col("region_id").alias("target"), "interior", F.lit(None).cast("double").alias("olat"), F.lit(None).cast("double").alias("olng"))
    cy, cx = _cells(F.col("olat"), F.col("olng"), step_lat, step_lng)
    around = F.explode(F.array(*[F.struct((cx + a).alias("cx"), (cy + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    placed_ = others.where(F.col("olat").isNotNull() & F.col("olng").isNotNull()).select(F.col(other).cast("string").alias("target"), "olat", "olng", around.alias("_o"))
    near = placed_.select(F.lit(0).alias("level"), "_o.cx", "_o.cy", "target", F.lit(False).alias("interior"), "olat", "olng")
    both, levels = _sized(cells.unionByName(near))
    keys = _level_keys("lat", "lng", [k for k in levels if k])
    if 0 in levels:
        y, x = _cells(F.col("lat"), F.col("lng"), step_lat, step_lng)
        keys.append(F.struct(F.lit(0).alias("level"), x.alias("cx"), y.alias("cy")))
    if not keys:
        return points.withColumns({"target_kind": F.lit(""), "target": F.lit("")}).where(F.lit(False))
    own = [c for c in points.columns if c not in ("target_kind", "target")]
    keyed = points.select(*own).where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumn("_k", F.explode(F.array(*keys)))
    names = ("target", "interior", "olat", "olng")
    hits = keyed.join(both.select(F.struct("level", "cx", "cy").alias("_c"), *[F.col(c).alias(f"_{c}") for c in names]), F.col("_k") == F.col("_c"))
    edges = ring_edges(regions, region, ring).select(F.col("region_id").alias("_t"), F.col("edges").alias("_edges"))
    is_point = F.col("_olat").isNotNull()
    sure = hits.withColumn("_t", F.when(~is_point & ~F.col("_interior"), F.col("_target"))).join(broadcast_if_small(edges, SMALL_RINGS), "_t", "left")
    inside = F.when(is_point, haversine_m(F.col("lat"), F.col("lng"), F.col("_olat"), F.col("_olng")) < radius_m).otherwise(F.col("_interior") | _odd(F.col("lng"), F.col("lat")))
    return sure.where(inside).select(*own, F.when(is_point, "point").otherwise("region").alias("target_kind"), F.col("_target").alias("target"))


def area(boxes: list[DataFrame], margin: float = 0.02) -> tuple[float, float, float, float]:
    """(min lat, max lat, min lng, max lng) over frames with lat and lng, widened by a margin; one row each to the driver."""
    both = reduce(DataFrame.unionByName, [b.select(F.col("lat").cast("double"), F.col("lng").cast("double")) for b in boxes])
    a, b, c, d = both.agg(F.min("lat"), F.max("lat"), F.min("lng"), F.max("lng")).first()
    return (0.0, 0.0, 0.0, 0.0) if a is None else (a - margin, b + margin, c - margin, d + margin)


def placed(df: DataFrame, lat: Column, lng: Column, box: tuple[float, float, float, float]) -> DataFrame:
    """df with lat and lng as numbers where they lie in the box, exchanged if only the exchange does; else nulls."""
    a, b, c, d = box
    tmp = settled(df, {"_y": lat, "_x": lng})
    straight = F.col("_y").between(a, b) & F.col("_x").between(c, d)
    turned = F.col("_x").between(a, b) & F.col("_y").between(c, d)
    pick = lambda p, q: F.when(straight, F.col(p)).when(turned, F.col(q))
    return settled(tmp, {"lat": pick("_y", "_x"), "lng": pick("_x", "_y")}).drop("_y", "_x")
