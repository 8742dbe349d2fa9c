"""Greedy clusters of near points. The result depends on the order of the points, so it isn't relational; only points
that are joined by steps shorter than the radius can affect each other, so each such component is worked by itself."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.functions.geo import EARTH_M
from wayledger.operators.places import near_pairs
from wayledger.session import stored


def components(points: DataFrame, key: str, radius_m: float, rounds: int = 200) -> DataFrame:
    """(key, component): the smallest key that each point is joined to by steps shorter than the radius. Labels are
    passed to neighbours and then shortened by their own labels, until nothing changes; each round is stored."""
    own = points.select(key, "lat", "lng")
    other = points.select(F.col(key).alias("_n"), F.col("lat").alias("olat"), F.col("lng").alias("olng"))
    edges = near_pairs(own, other, radius_m, other=("olat", "olng")).where(F.col(key) != F.col("_n")).select(key, "_n")
    edges, label = stored(edges), points.select(key, F.col(key).alias("component"))
    for _ in range(rounds):
        near = edges.join(label.withColumnRenamed(key, "_n"), "_n").groupBy(key).agg(F.min("component").alias("_c"))
        new = label.join(near, key, "left").select(key, F.least("component", F.coalesce("_c", "component")).alias("component"))
        hop = new.select(F.col(key).alias("component"), F.col("component").alias("_up"))
        new = new.join(hop, "component", "left").select(key, F.least("component", F.coalesce("_up", "component")).alias("component"))
        new = stored(new)
        changed = new.join(label.withColumnRenamed("component", "_old"), key).where("component <> _old").limit(1).count()
        label = new
        if not changed:
            return label
    raise RuntimeError(f"labels still change after {rounds} rounds")


def _metres(lat: float, lng: float, lats: np.ndarray, lngs: np.ndarray) -> np.ndarray:
    p, q = math.radians(lat), np.radians(lats)
    h = np.sin((q - p) / 2) ** 2 + math.cos(p) * np.cos(q) * np.sin(np.radians(lngs - lng) / 2) ** 2
    return 2 * EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(1 - np.minimum(h, 1.0)))


def greedy_clusters(points: DataFrame, key: str, radius_m: float, least: int = 1) -> DataFrame:
    """(cluster, lat, lng, n): each point in the order of keys that isn't in a cluster yet takes all free points less than
    radius_m away; a cluster of fewer than `least` isn't formed, and leaves its points free. lat and lng are means.

    Null places are left out. A component, points that hang together by steps below the radius, is the unit of work.
    """
    own = points.where("lat is not null and lng is not null").select(key, F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    marked = own.join(components(own, key, radius_m), key)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        ids, lat, lng = (pdf[c].to_numpy() for c in (key, "lat", "lng"))
        free, rows = np.ones(len(ids), dtype=bool), []
        for i in range(len(ids)):
            if free[i]:
                take = free & (_metres(lat[i], lng[i], lat, lng) < radius_m)
                take[i] = True
                if take.sum() >= least:
                    free &= ~take
                    rows.append((ids[i], lat[take].mean(), lng[take].mean(), int(take.sum())))
        return pd.DataFrame(rows, columns=["cluster", "lat", "lng", "n"])

    return marked.groupBy("component").applyInPandas(one, "cluster long, lat double, lng double, n long")
