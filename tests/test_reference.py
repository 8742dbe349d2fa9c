"""Edge cases of the analytics, and the SQL check of every query over the smallest tables."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from wayledger.functions import rules
from wayledger.functions.times import floor_days
from wayledger.operators import aggregate, cluster, dedupe, rank, temporal
from wayledger.plans import general_sql, reference_sql


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(small)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{small}/{f}')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted({**general_sql.SQL, **reference_sql.SQL}))
def test_same_as_sql(spark, duck, small, name):
    df = contract.queries()[name](spark, small)
    want = duck.execute(contract.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want.fetchall())


def test_snapshot_archive_brute_force(spark, duck, small):
    """Neighbouring snapshots one after the other, as the archive grows; all of them, not the newest three."""
    sql = f"{reference_sql.W} select snapshot_no, coalesce(nullif(reference, ''), concat_ws('|', road, operator, coalesce(cast(start_ms as varchar), ''))) as key, max(id) from works where snapshot_no is not null group by all"
    held = {}
    for no, key, last in duck.execute(sql).fetchall():
        held.setdefault(no, {})[key] = last
    archived, added = set(), set()
    for no, newer in zip(sorted(held), sorted(held)[1:]):
        left = set(held[no]) - set(held[newer])
        added = {(held[no][k], k) for k in left - archived}
        archived |= left
    assert len(held) > 3 and added
    got = [(r.id, r.key) for r in contract.queries()["snapshot_archive"](spark, small).collect()]
    assert len(got) == len(added) and set(got) == added


def test_vanished(spark):
    rows = [("stays", 3), ("stays", 2), ("stays", 1), ("back", 3), ("back", 1), ("back", 1), ("late", 2), ("late", 2), ("new", 1)]
    got = [tuple(r) for r in dedupe.vanished(spark.createDataFrame(rows, "key string, age int"), "key", "age").collect()]
    assert sorted(got) == [("back", 3), ("late", 2)]


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_rules(spark):
    df = spark.createDataFrame([(None, None), ("", "x"), ("laneClosures", "LANE"), ("abc", "ABCD")], "a string, b string")
    got = df.select(rules.any_keyword("a", ["lane"]).alias("k"), rules.keyword_hits("a", ["lane", "close", "clos"]).alias("h"), rules.either_contains("a", "b").alias("e"), rules.either_contains("a", "b", True).alias("f"), rules.camel_words("a").alias("c")).collect()
    assert [tuple(r) for r in got] == [(False, 0, False, False, "None"), (False, 0, False, True, "None"), (True, 2, True, True, "Lane Closures"), (False, 0, True, True, "Abc")]
    d = spark.createDataFrame([(1.0, "high"), (None, "low")], "v double, s string")
    assert [r[0] for r in d.select(rules.tier("v", [(1, "a"), (2, "b")], "z")).collect()] == ["a", "z"]
    assert [r[0] for r in d.select(rules.tier("v", [(1, "a")], "z", strict=True)).collect()] == ["z", "z"]


def test_duration_labels(spark):
    """Golden rows, worked out by hand: halves round up, weeks from 7 days, months from 30, an s but for one."""
    want = {None: "1 day", -3: "1 day", 0: "1 day", 1: "1 day", 2: "2 days", 6: "6 days", 7: "1 wk", 10: "1 wk", 11: "2 wks", 14: "2 wks", 29: "4 wks", 30: "1 mo", 44: "1 mo", 45: "2 mos", 60: "2 mos", 365: "12 mos"}
    df = spark.createDataFrame([(k,) for k in want], "d long")
    assert {r.d: r.x for r in df.select("d", rules.duration_label("d").alias("x")).collect()} == want
    df = spark.createDataFrame([("noCarriagewayIncursion",), ("ABCd",)], "a string")
    assert [r[0] for r in df.select(rules.camel_words("a")).collect()] == ["No Carriageway Incursion", "ABCd"]


def test_long_camel_words_stay_whole(spark):
    df = spark.createDataFrame([("laneClosures" * 500,), ("",), (None,), ("a",)], "a string")
    assert [r[0] for r in df.select(rules.camel_words("a")).collect()] == ["L" + ("lane Closures" * 500)[1:], "None", "None", "A"]


def test_whole_days_floor(spark):
    df = spark.createDataFrame([(0, 129600), (129600, 0)], "a long, b long")
    assert [r[0] for r in df.select(floor_days(F.col("a"), F.col("b"))).collect()] == [-2, 1]


def test_active_at_hour(spark):
    h = temporal.HOUR
    df = spark.createDataFrame([(8 * h, 10 * h), (0, 10 * h), (None, None), (8 * h, 0)], "a long, b long")
    got = [[r[0] for r in df.select(temporal.active_at_hour("a", "b", k)).collect()] for k in (7, 10, 23)]
    assert got == [[False, True, True, False], [True, True, True, True], [False, True, True, True]]
    assert [r.n for r in temporal.hourly_counts(df, "a", "b").orderBy("hour").collect()] == [sum(df.where(temporal.active_at_hour("a", "b", k)).count() for _ in (0,)) for k in range(24)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id long, key string, s long, t long, lat double, lng double")
    assert temporal.daily_counts(e, "s", "t", 0, 5).agg(F.sum("n")).first()[0] == 0
    assert temporal.overlap_pairs(e, "id", "key", "s", "t").count() == 0
    assert aggregate.nearest_rank(e, "s", 0.95).first()[0] is None
    assert rank.page(e, [F.col("id")], 3).count() == 0
    assert dedupe.keep_first(e, ["key"], [F.col("id")]).count() == 0
    assert cluster.greedy_clusters(e, "id", 10.0).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_overlap_pairs_brute_force(spark, seed):
    rng = random.Random(seed)
    day = temporal.DAY
    rows = [(i, rng.choice(["hot", "hot", "x", None]), rng.choice([None, rng.randrange(0, 400) * day]), rng.choice([None, rng.randrange(0, 400) * day])) for i in range(60)]
    inf = float("inf")
    span = {i: (k, -inf if a is None else a, inf if b is None else b) for i, k, a, b in rows}
    want = {(i, j) for i in span for j in span if i < j and span[i][0] is not None and span[i][0] == span[j][0] and span[i][1] <= span[i][2] and span[j][1] <= span[j][2] and span[i][1] <= span[j][2] and span[j][1] <= span[i][2]}
    got = [(r.a, r.b) for r in temporal.overlap_pairs(spark.createDataFrame(rows, "id long, k string, s long, t long"), "id", "k", "s", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("least", [1, 3])
def test_greedy_clusters_brute_force(spark, least):
    rng = np.random.default_rng(least)
    lat, lng = 53 + rng.random(80) * 0.02, -1.5 + rng.random(80) * 0.02
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lng))] + [(99, None, 1.0)], "id long, lat double, lng double")
    free, want = np.ones(80, dtype=bool), {}
    for i in range(80):
        if free[i]:
            take = free & (cluster._metres(lat[i], lng[i], lat, lng) < 250.0)
            if take.sum() >= least:
                free &= ~take
                want[i] = int(take.sum())
    assert {r.cluster: r.n for r in cluster.greedy_clusters(df, "id", 250.0, least).collect()} == want


def test_argmax_ties(spark):
    df = spark.createDataFrame([("a", 5, 2), ("a", 5, 1), ("a", None, 0), ("b", None, 3)], "k string, v long, id long")
    assert [(r.k, r.id) for r in aggregate.arg_max(df, "k", "v", "id").collect()] == [("a", 1)]


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([((i * 37) % 101, 53.0 + i * 0.001, -1.5) for i in range(101)] + [(500, 54.0, -1.5)], "id long, lat double, lng double")
    got = {r.id: r.component for r in cluster.components(df, "id", 120.0).collect()}
    assert {v for k, v in got.items() if k != 500} == {0} and got[500] == 500


@pytest.mark.parametrize("seed", range(2))
def test_overlap_counts_brute_force(spark, seed):
    from wayledger.operators import spatial

    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), rng.choice([None, *range(20)]), rng.choice([None, *range(25)])) for i in range(80)]
    inf = float("inf")
    own = [(k, a, inf if b is None else b) for _, k, a, b in rows if a is not None and (b is None or b >= a)]
    want = {k: sum(x[1] <= y[2] and y[1] <= x[2] for i, x in enumerate(own) for y in own[i + 1 :] if x[0] == y[0] == k) for k in "ab"}
    df = spark.createDataFrame(rows, "id long, k string, s long, t long")
    assert {r.k: r.pairs for r in spatial.overlap_counts(df, "k", "s", "t").collect()} == want
    assert spatial.overlap_counts(df.limit(0), "k", "s", "t").count() == 0


def test_works_without_a_shared_folder(spark):
    """A cluster without a shared checkpoint folder is an error, not a machine's own folder."""
    from unittest.mock import MagicMock

    from wayledger.session import use_checkpoints

    cluster = MagicMock()
    cluster.sparkContext.master = "spark://host:7077"
    cluster.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    cluster.conf.get.return_value = None
    with pytest.raises(RuntimeError):
        use_checkpoints(cluster)


def test_p3_and_p2_read_once(spark, small):
    from wayledger.plans import general

    plan = general.p2_found(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or plan.count("FileScan") <= 2
    p3 = general.p3_found(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in p3 and "ArrowEvalPython" not in p3  # all later uses read the merged rows
