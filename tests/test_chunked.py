import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trackloom.operators import chunked as m
from trackloom.operators import features, orientation


@pytest.fixture(scope="module")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def poses(spark, hot=700):
    rnd = random.Random(1)
    rows = []
    for t in range(5):
        p = [0.0, 0.0, 0.0]
        for f in range(hot if t == 0 else rnd.choice([1, 3, 6, 40])):
            going = [rnd.uniform(-4, 4), 25.0, rnd.uniform(-3, 3)] if f % 40 > 5 else [rnd.uniform(-60, 60) * (f % 3) for _ in range(3)]
            p = [a + b for a, b in zip(p, going, strict=True)]
            rows.append((t, f, *p))
    return spark.createDataFrame(rows, "track_id long, frame long, x double, y double, z double").repartition(5)


def test_any_chunk_size_gives_the_whole_tracks_values(spark):
    table = poses(spark)
    turned = table.select("*", *(F.lit(0.1).alias(f"v{c}") for c in "xyz"))
    whole = {(r["track_id"], r["step"], r["k"]): r for r in features.scalar_features(turned).collect()}
    sides = {(r["track_id"], r["step"], r["k"]): r for r in orientation.aligned(features.base(turned)).collect()}
    for size in (4, 7, 64, 100_000):
        got = {(r["track_id"], r["step"], r["k"]): r for r in m.since_events(table, size).collect()}
        assert got.keys() == whole.keys()
        for key, r in got.items():
            w, step = whole[key], key[1]
            assert r["still_rows"] * step == w["time_since_stationary"]
            assert r["turn_rows"] * step == w["time_since_dir_change"]
            assert r["dist_since_turn"] == pytest.approx(w["dist_since_dir_change"], abs=1e-6)
            assert r["flips"] == sides[key]["flips"]
            assert r["signed"] == pytest.approx(sides[key]["signed"], abs=1e-9)


def test_numbers(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), rnd.randrange(9), i) for i in range(400)]
    table = spark.createDataFrame(rows, "g string, day int, i int").repartition(4)
    got = {r["i"]: r["n"] for r in m.numbered(table, ["g"], "day", ["i"], "n").collect()}
    for g in "ab":
        for n, (_, i) in enumerate(sorted((d, i) for h, d, i in rows if h == g)):
            assert got[i] == n


def test_a_hot_track_is_spread(spark):
    """One track with nearly all rows: no task has more than twice the median's rows where the work is done."""
    rows = spark.range(60_000).select(F.lit(1).alias("track_id"), F.lit(1).alias("step"), F.col("id").alias("k"), F.lit(True).alias("own"))
    rows = rows.unionByName(spark.range(10).select(F.col("id").alias("track_id"), F.lit(1).alias("step"), F.lit(0).cast("long").alias("k"), F.lit(True).alias("own")))
    done = m.carried(m.within(m.chunked(rows.drop("own"), 300, 4), [{"before": f"lag(k) OVER {m.ORDER}"}]), {"total": ("sum", "before")})
    by = sorted(r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect())
    assert len(by) == 8
    assert by[-1] <= 2 * by[4]
    last = done.orderBy(F.desc("k")).first()
    assert last["total"] == sum(range(59_999))


def test_edges(spark):
    table = poses(spark, 5)
    assert m.since_events(table.where("false")).collect() == []
    with pytest.raises(ValueError):
        m.since_events(table, 3)
