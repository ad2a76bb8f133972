"""Closed forms: what each predictor must get exactly right, short tracks, and files."""

import pytest
from pyspark.sql import SparkSession

from trackloom.operators import predict as pr
from trackloom.sources import poses as src


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


FORMS = {
    "STATIC": lambda t: (5.0, -1.0, 2.0),
    "VEL_DEG1": lambda t: (t, 2.0 * t, 1.0 - t),
    "ACC_DEG2": lambda t: (t * t, t, 3.0 - t * t / 2),
    "JERK": lambda t: (t**3, t * t, -t),
}


@pytest.mark.parametrize("model", FORMS)
def test_polynomials_are_predicted_exactly(spark, model):
    rows = [(1, t, *map(float, FORMS[model](t))) for t in range(30)]
    df = spark.createDataFrame(rows, "track_id long, frame long, x double, y double, z double").repartition(3)
    need = len(pr.LINEAR[model])
    got = pr.errors(df, [model]).where(f"k >= {need}").collect()
    assert got and all(r[model] < 1e-6 for r in got)


@pytest.mark.parametrize("n", range(6))
def test_short_tracks(spark, n):
    df = spark.createDataFrame([(1, t, float(t), 0.0, 0.0) for t in range(n)], "track_id long, frame long, x double, y double, z double")
    got = {r["k"]: r for r in pr.errors(df, steps=(1,)).collect()}
    assert sorted(got) == list(range(1, n))
    assert all(r["JERK"] == (1.0 if k == 1 else 0.0) for k, r in got.items())


def test_one_exchange(spark):
    df = src.event_poses(spark, "/root/testdata/sf0.001")
    plan = pr.errors(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_pose_files(spark, tmp_path):
    (tmp_path / "seq/body").mkdir(parents=True)
    line = " ".join(map(str, range(9)))
    (tmp_path / "seq/body/pose.txt").write_text(f"{line} 1 2 3\n\n  {line} 4.5 5 6  \n")
    got = src.read_pose_text(spark, f"{tmp_path}/seq/body/pose.txt").orderBy("frame").collect()
    assert [(r["track_id"], r["frame"], r["x"], r["z"], len(r["rot"])) for r in got] == [("seq/body", 0, 1.0, 3.0, 9), ("seq/body", 1, 4.5, 6.0, 9)]
    (tmp_path / "a.json").write_text('{"3": [{"cam_R_m2c": [1,0,0,0,1,0,0,0,1], "cam_t_m2c": [7, 8, 9]}]}')
    (r,) = src.read_scene_json(spark, f"{tmp_path}/a.json").collect()
    assert (r["frame"], r["x"], r["rot"][0]) == (3, 7.0, 1.0)
