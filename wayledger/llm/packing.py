"""Problem 8: filling containers of fixed capacity with documents."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that are packed together. A shard ends with a few containers that aren't full, so more items waste less.
SHARD_ITEMS = 20_000

#: Cheapest containers that the dearest one is paired with before it is left as it is.
TRIES = 2

#: Cost of a document of n tokens: LINEAR * n for the layers' products and QUADRATIC * n^2 for attention within it.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


def tightest(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, largest first, each to the fullest one that has room (best fit): how few are enough."""
    out = np.zeros(len(sizes), dtype=np.int64)
    rooms: list[tuple[int, int]] = []  # room, container; in order
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
        else:
            room, k, n = capacity, n, n + 1
        insort(rooms, (room - size, k))
        out[i] = k
    return out


def balanced(sizes: np.ndarray, capacity: int, n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Container of each item: largest first, each to the container of lowest cost that has room, of n that are open from
    the start; a new one is opened where none has room.

    Containers without room for the item at hand wait by their room until the items have become small enough, so that
    every item is placed in logarithmic time.
    """
    out = np.zeros(len(sizes), dtype=np.int64)
    ready = [(0.0, k, capacity) for k in range(n)]  # cost, container, room
    waiting: list[tuple[int, int, float]] = []  # -room, container, cost
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        while waiting and -waiting[0][0] >= size:
            room, k, cost = heapq.heappop(waiting)
            heapq.heappush(ready, (cost, k, -room))
        while ready and ready[0][2] < size:
            cost, k, room = heapq.heappop(ready)
            heapq.heappush(waiting, (-room, k, cost))
        if ready:
            cost, k, room = ready[0]
            heapq.heapreplace(ready, (cost + linear * size + quadratic * size * size, k, room - size))
        else:
            k, n = n, n + 1
            heapq.heappush(ready, (linear * size + quadratic * size * size, k, capacity - size))
        out[i] = k
    return out


def evened(sizes: np.ndarray, place: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC, turns: int = 12) -> np.ndarray:
    """place with the costs of the containers evened out by moves and swaps, in as many containers and with none over its
    capacity. The dearest container gives an item to one of the cheapest, or exchanges one with it, whichever lowers the dearer
    of the two most; a dearest container that nothing helps is left as it is. turns bounds the work, in rounds over all
    containers."""
    n = int(place.max()) + 1 if len(place) else 0
    if n < 2:
        return place
    cost_of = linear * sizes + quadratic * sizes.astype(np.float64) ** 2
    held: list[list[int]] = [[] for _ in range(n)]
    for i, k in enumerate(place.tolist()):
        held[k].append(i)
    room = capacity - np.bincount(place, weights=sizes, minlength=n)
    cost = np.bincount(place, weights=cost_of, minlength=n)
    dear = [(-c, k) for k, c in enumerate(cost.tolist())]
    cheap = [(c, k) for k, c in enumerate(cost.tolist())]
    heapq.heapify(dear)
    heapq.heapify(cheap)
    left = turns * n
    while dear and left:
        left -= 1
        c, a = heapq.heappop(dear)
        if -c != cost[a]:
            continue  # out of date; the newer entry is in the heap too
        while cheap and cheap[0][0] != cost[cheap[0][1]]:
            heapq.heappop(cheap)
        tried, done = [], False
        for _ in range(TRIES):
            if not cheap:
                break
            low, b = heapq.heappop(cheap)
            tried.append((low, b))
            if b == a or low != cost[b]:
                continue
            own, other = np.array(held[a]), np.array([*held[b], -1])  # -1: a move
            size_b, cost_b = np.r_[sizes[other[:-1]], 0], np.r_[cost_of[other[:-1]], 0.0]
            by = sizes[own][:, None] - size_b[None, :]
            gain = cost_of[own][:, None] - cost_b[None, :]
            dearer = np.where((by <= room[b]) & (-by <= room[a]) & (gain > 0), np.maximum(cost[a] - gain, cost[b] + gain), np.inf)
            x, y = np.unravel_index(int(dearer.argmin()), dearer.shape)
            if dearer[x, y] < cost[a] - 1e-9:
                i, j = int(own[x]), int(other[y])
                held[a].remove(i)
                held[b].append(i)
                if j >= 0:
                    held[b].remove(j)
                    held[a].append(j)
                room[a] += by[x, y]
                room[b] -= by[x, y]
                cost[a] -= gain[x, y]
                cost[b] += gain[x, y]
                done = True
                break
        for entry in tried:
            if entry[0] == cost[entry[1]]:
                heapq.heappush(cheap, entry)
        if done:
            for k in (a, b):
                heapq.heappush(dear, (-cost[k], k))
                heapq.heappush(cheap, (cost[k], k))
    out = np.empty_like(place)
    for k, items in enumerate(held):
        out[items] = k
    return out


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, none larger than capacity: balanced by cost over as few containers as a tight packing
    takes. Where balance from the start would take more, the tight packing is evened out by moves and swaps."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    tight = tightest(sizes, capacity)
    few = int(tight.max()) + 1
    least = max(1, math.ceil(int(sizes.sum()) / capacity))
    for n in sorted({least, min(least + 1, few), few}):
        even = balanced(sizes, capacity, n)
        if int(even.max()) + 1 <= n:
            return even
    return evened(sizes, tight, capacity)


def pack(items: DataFrame, item: str, size: str, containers: dict[str, int], shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container, sequence_id, item, piece_no, tokens): where each item, or piece of one, goes, for each kind of container.

    items has a unique key `item` (bigint) and `size`, a whole number; null or negative sizes count as 0. Items of size 0 are placed
    too. Only an item larger than the capacity is split: into full pieces, each a sequence of its own, and a rest that is
    packed as an item. sequence_id is unique within a kind of container. An empty table gives an empty result. Containers
    of a capacity below 1 are an error.

    Items are dealt by hash into shards of about shard_items, so no shard grows with the data; each is packed by itself.
    """
    if any(c < 1 for c in containers.values()):
        raise ValueError("a container needs a capacity of 1 at least")
    shards = max(1, math.ceil(items.count() / shard_items))
    base = items.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    base = base.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("container"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(containers.items())]))
    kinds = base.withColumn("_k", kinds).select("item", "size", "shard", "_k.*")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, shard = int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        key, size = pdf["item"].to_numpy(), pdf["size"].to_numpy()
        full = np.where(size > capacity, size // capacity, 0)
        rest = np.where(size > capacity, size % capacity, size)
        packed = (full == 0) | (rest > 0)
        place = assign(rest[packed], capacity)
        opened = int(place.max()) + 1 if len(place) else 0
        whole = np.repeat(np.arange(len(key)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        sequence = np.r_[place, opened + np.arange(len(whole))]
        return pd.DataFrame(
            {
                "container": pdf["container"].iloc[0],
                "sequence_id": sequence * shards + shard,
                "item": np.r_[key[packed], key[whole]],
                "piece_no": np.r_[full[packed], piece],
                "tokens": np.r_[rest[packed], np.full(len(whole), capacity, dtype=np.int64)],
            }
        )

    return kinds.groupBy("container", "shard").applyInPandas(one, "container string, sequence_id long, item long, piece_no long, tokens long").withColumnRenamed("item", item)


def fill_report(packed: DataFrame, containers: dict[str, int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """Per kind of container: sequences, tokens, the share of room that is used, and how evenly the cost lies."""
    cost = F.sum(F.lit(linear) * F.col("tokens") + F.lit(quadratic) * F.col("tokens") * F.col("tokens"))
    per = packed.groupBy("container", "sequence_id").agg(F.sum("tokens").alias("used"), cost.alias("cost"))
    room = F.create_map(*[x for k, c in containers.items() for x in (F.lit(k), F.lit(c).cast("long"))])
    out = per.groupBy("container").agg(F.count("*").alias("sequences"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.avg("cost").alias("mean_cost"), F.max("cost").alias("max_cost"))
    return out.withColumn("used_share", F.col("tokens") / (F.col("sequences") * room[F.col("container")]))
