"""Problems 1 to 4 against brute force, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from wayledger.functions.geo import coordinate
from wayledger.functions.text import number_key
from wayledger.operators.intervals import IntervalMap, periods_and_gaps
from wayledger.operators.places import _inside, _edges, containing_regions, cover, cell_step, near_pairs, regions_and_neighbours
from wayledger.operators.redelivery import admit_batch, deduplicated, redelivered
from wayledger.operators.snapshots import snapshot_changes


# ---- 1


def test_number_key(spark):
    cases = {"3000023": "3000023", "003000023": "3000023", "3,000,023": "3000023", " 3000023\t": "3000023", "3000023.0": "3000023", "#3000023": "3000023", " 3000023": "3000023", "3.000023e6": "3000023", "": None, "  ": None, None: None, "abc": None, "0": "0", "3.000.023": "3000023"}
    df = spark.createDataFrame([(k,) for k in cases], "id string").select("id", number_key("id").alias("n"))
    assert {r.id: r.n for r in df.collect()} == cases


def test_redelivered_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "delivery_id long, k string, u long").withColumn("_rank", F.lit("clash"))
    keep = {}
    for d, k, u in rows:
        if k is not None and (k not in keep or (-(u or 0), d) < (-(keep[k][1] or 0), keep[k][0])):
            keep[k] = (d, u)
    want = {d for d, k, _ in rows if k is not None and keep[k][0] != d}
    assert {r[0] for r in redelivered(df, "k", "u", "delivery_id").collect()} == want
    left = deduplicated(df, "k", "u", "delivery_id")
    assert left.columns == df.columns and {r[0] for r in left.collect()} == {d for d, *_ in rows} - want
    assert redelivered(df.limit(0), "k", "u", "delivery_id").count() == 0


def test_admit_batch(spark):
    stored = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    batch = spark.createDataFrame([(1, "a", 5), (2, "b", 1), (3, "b", 2), (4, None, 1), (5, None, 1)], "d long, k string, u long").withColumn("_rank", F.lit(1))
    assert sorted(r.d for r in admit_batch(stored, batch, "k", "u", "d").collect()) == [3, 4, 5]
    assert admit_batch(stored, batch.limit(0), "k", "u", "d").count() == 0


def test_hot_key_is_cut_before_the_shuffle(spark, small):
    from wayledger.plans.general import p1_found

    plan = p1_found(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# ---- 2


def brute_changes(rows, numbers):
    by = {n: {} for n in numbers}
    for n, k, s in rows:
        if n is not None and k:
            by[n].setdefault(k, set()).add(s or "")
    state = {n: {k: "started" if "started" in v else min(v) for k, v in d.items()} for n, d in by.items()}
    out = set()
    for a, b in zip(numbers, numbers[1:]):
        for k in state[a].keys() | state[b].keys():
            if k not in state[a]:
                out.add((b, k, "added"))
            elif k not in state[b]:
                out.add((b, k, "removed"))
            elif state[a][k] != state[b][k]:
                out.add((b, k, "changed"))
    return out


def test_snapshot_changes_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 5, 9]), rng.choice([None, "", *"abcdefgh"]), rng.choice([None, "", "planned", "started"])) for _ in range(120)] + [(7, None, None)]
    df = spark.createDataFrame(rows, "snapshot_no int, key string, st string").withColumn("state", F.lit("clash"))
    got = {tuple(r) for r in snapshot_changes(df, df, "key", "st", "started").collect()}
    assert got == brute_changes(rows, sorted({r[0] for r in rows}))


@pytest.mark.parametrize("n", [0, 1])
def test_no_consecutive_snapshots(spark, n):
    df = spark.createDataFrame([(1, "a", "x")][:n], "snapshot_no int, key string, st string")
    assert snapshot_changes(df, df, "key", "st").count() == 0


# ---- 3


def brute_spans(rows):
    by = {}
    for e, a, b in rows:
        if e is not None and a is not None and b is not None and a < b:
            by.setdefault(e, []).append((a, b))
    out = set()
    for e, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(e, "period", a, b) for a, b in merged} | {(e, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("slab", [3, 7, 100, 10_000])
def test_periods_brute_force(spark, slab):
    rng = random.Random(slab)
    rows = [(rng.choice([None, "hot", "hot", "hot", "x", "y"]), a := rng.choice([None, rng.randrange(-300, 900)]), None if a is None or rng.random() < 0.05 else a + rng.choice([-3, 0, 1, 2, 5, 20, 200])) for _ in range(400)]
    df = spark.createDataFrame(rows, "road string, a long, b long").withColumn("entity", F.lit(1))
    got = [tuple(r) for r in periods_and_gaps(df, "road", "a", "b", slab_ms=slab).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows)


def test_far_ends_stay_small(spark):
    far = 253_402_300_799_000  # the end of the year 9999
    rows = [("r", 0, 1000), ("r", 5000, far), ("r", 6000, 7000), ("r", far + 10, far + 20), ("q", -far, far)]
    got = {tuple(x) for x in periods_and_gaps(spark.createDataFrame(rows, "road string, a long, b long"), "road", "a", "b", slab_ms=1000).collect()}
    assert got == brute_spans(rows)


def test_periods_of_nothing(spark):
    assert periods_and_gaps(spark.createDataFrame([], "road string, a long, b long"), "road", "a", "b").count() == 0


def test_interval_map_touching_is_one():
    m = IntervalMap()
    for a, b in ((10, 20), (30, 40), (20, 30), (0, 5), (1, 2)):
        m.insert(a, b)
    assert (m.starts, m.ends) == ([0, 10], [5, 40]) and list(m.gaps()) == [(5, 10)]


# ---- 4


def test_coordinates(spark):
    cases = {"53.156126": 53.156126, " 53.1 ": 53.1, "53,105937": 53.105937, "53.22484N": 53.22484, "1.69109W": -1.69109, "-1.525871": -1.525871, "53°01'53.77\"N": 53 + 1 / 60 + 53.77 / 3600, "1°40'12.71\"W": -(1 + 40 / 60 + 12.71 / 3600), "5.3177343e+01": 53.177343, "-1.7003501e+00": -1.7003501, "unknown": None, "": None, None: None, "0": 0.0, "E": None, "12.3.4": None, "−1.5": -1.5}
    got = {r.c: r.v for r in spark.createDataFrame([(k,) for k in cases], "c string").select("c", coordinate("c").alias("v")).collect()}
    for k, v in cases.items():
        assert got[k] is v is None or abs(got[k] - v) < 1e-9, k


SQUARE = [[-1.60, 53.00], [-1.50, 53.00], [-1.50, 53.10], [-1.60, 53.10]]  # open
INNER = [[-1.56, 53.04], [-1.56, 53.06], [-1.54, 53.06], [-1.54, 53.06], [-1.54, 53.04], [-1.56, 53.04]]  # closed, the other way, a vertex twice
ELL = [[-1.5, 53.0], [-1.3, 53.0], [-1.3, 53.05], [-1.45, 53.05], [-1.45, 53.2], [-1.5, 53.2]]


def test_cover_is_sound():
    rng = random.Random(5)
    for ring in (SQUARE, INNER, ELL):
        edges, cells = _edges(ring), {(k, x, y): i for k, x, y, i in cover(ring, 10, 14)}
        for _ in range(400):
            x, y = rng.uniform(-1.65, -1.25), rng.uniform(52.95, 53.25)
            hit = [cells[c] for k in range(10, 15) if (c := (k, int(x // cell_step(k)), int(y // cell_step(k)))) in cells]
            assert len(hit) <= 1
            inside = _inside(x, y, edges)
            assert (hit == [True]) <= inside and inside <= bool(hit)


def test_regions_and_neighbours_brute_force(spark):
    import math

    rng = random.Random(6)
    points = [(i, rng.uniform(52.95, 53.25), rng.uniform(-1.65, -1.25)) for i in range(300)] + [(900, None, -1.5), (901, 53.0, None)]
    df = spark.createDataFrame(points, "delivery_id long, lat double, lng double")
    df = df.withColumns({c: F.lit("clash") for c in ("level", "region_id", "target", "interior", "edges", "cx")})
    rings = {"sq": SQUARE, "in": INNER, "ell": ELL}
    regions = spark.createDataFrame([*rings.items(), ("none", None), ("thin", [[0.0, 0.0], [1.0, 1.0]]), (None, SQUARE)], "name string, ring array<array<double>>")
    others = [(i, rng.uniform(52.95, 53.25), rng.uniform(-1.65, -1.25)) for i in range(60)] + [(99, None, None)]
    odf = spark.createDataFrame(others, "target long, olat double, olng double")

    def far(a, b, c, e):
        p, q = math.radians(a), math.radians(c)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(e - b) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    want = {(i, "region", n) for i, y, x in points if y is not None and x is not None for n, r in rings.items() if _inside(x, y, _edges(r))}
    assert {(r.delivery_id, "region", r.region_id) for r in containing_regions(df, regions, "name", "ring").collect()} == want
    near = {(i, "point", str(j)) for i, y, x in points if y is not None and x is not None for j, b, a in others if b is not None and far(y, x, b, a) < 3000}
    got = {(r.delivery_id, r.target_kind, r.target) for r in regions_and_neighbours(df, regions, "name", "ring", odf, "target", 3000.0).collect()}
    assert got == want | near
    assert {(r.delivery_id, "point", str(r.target)) for r in near_pairs(df.drop("target"), odf, 3000.0, other=("olat", "olng")).collect()} == near
    assert regions_and_neighbours(df.limit(0), regions, "name", "ring", odf, "target", 3000.0).count() == 0
    assert regions_and_neighbours(df, regions.limit(0), "name", "ring", odf.limit(0), "target", 3000.0).count() == 0
