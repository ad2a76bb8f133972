"""What would grow faster than the input, or would be interpreted."""

import pytest
from pyspark.sql import SparkSession

from trackloom.plans import features

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def test_layers_make_no_methods_that_the_jvm_leaves_uncompiled(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    features.scalar_features(spark, DATA)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_statistics_hand_on_a_row_for_each_group_of_a_task(spark, monkeypatch):
    """Rows are summed where they pass, from wide rows as from long ones, and are not multiplied by models, frames and motion kinds."""
    from trackloom.operators import localized
    from trackloom.plans.motion import _turned

    poses = _turned(spark, DATA)
    handed, kept = [], type(poses).mapInArrow

    def counted(self, f, schema, **more):
        out = kept(self.coalesce(1), f, schema, **more).localCheckpoint()
        handed.append((self.count(), out.count()))
        return out

    monkeypatch.setattr(type(poses), "mapInArrow", counted)
    keys = ["step", "model", "kind", "frame_kind"]
    wide = {tuple(r[k] for k in keys): r for r in localized.statistics(localized.localized(poses, wide=True), localized.WIDE).collect()}
    assert len(handed) == 2 and all(r < 2000 and g <= 3 * 16 * 5 for r, g in handed)
    long = {tuple(r[k] for k in keys): r for r in localized.statistics(localized.localized(poses)).collect()}
    assert wide.keys() == long.keys() and len(wide) > 100
    for k, r in wide.items():
        for c in r.asDict():
            assert r[c] == long[k][c] or r[c] == pytest.approx(long[k][c], rel=1e-9, abs=1e-9)


def test_files_hold_many_tracks_whose_sections_are_cut(spark, tmp_path, monkeypatch):
    from trackloom.sources import poses as src

    monkeypatch.setattr(src, "LINES", 3)
    rows = [(t, f, float(10 * t + f), 0.5, -1e-7, [float(i) for i in range(9)]) for t in range(40) for f in range(2, 2 + t % 8)]
    poses = spark.createDataFrame(rows, src.POSES).repartition(5)
    src.write_pose_text(poses, f"{tmp_path}/text")
    src.write_scene_json(poses, f"{tmp_path}/scene")
    for name in ("text", "scene"):
        assert len(list((tmp_path / name).rglob("*.txt"))) <= 5
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        text = src.read_pose_text(spark, f"{tmp_path}/text", sections=True).collect()
        scene = src.read_scene_json(spark, f"{tmp_path}/scene", sections=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    of = lambda found, shift: sorted((int(r["track_id"].split("/")[0][6:]), r["frame"] + shift, r["x"], r["y"], r["z"], r["rot"]) for r in found)
    assert of(text, 2) == of(scene, 0) == sorted(rows)


def test_a_task_hands_on_a_cell_once(spark):
    from trackloom.operators import tree

    rows = spark.createDataFrame([(1 + i % 3, i % 5 - 1, i % 2, 1.0, float(i)) for i in range(30000)], "node int, bin_a int, bin_b int, m0 double, m1 double").coalesce(1)
    made = tree.sums_by_bin(rows, ["a", "b"], ["m0", "m1"])
    assert sum(r["m0"] for r in made.collect()) == 60000 and made.count() == 3 * (5 + 2)
    handed, kept = [], type(rows).mapInArrow

    def counted(self, f, schema, **more):
        out = kept(self, f, schema, **more)
        handed.append(out.count())
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(rows), "mapInArrow", counted)
        tree.sums_by_bin(rows, ["a", "b"], ["m0", "m1"])
    assert handed == [3 * (5 + 2)]


def test_rows_before_are_slid_over_and_not_gathered_for_each_row(spark):
    """A task of the filters holds a batch of plain numbers and the few rows before it, whatever its rows; tracks that batches cut are whole."""
    from pyspark.sql import functions as F

    from trackloom.operators import banks, filters
    from trackloom.plans import learning
    from trackloom.sources import poses as src

    for query in (learning.spline_errors, learning.spline_metrics):
        assert "collect_list" not in query(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    poses, of = src.event_poses(spark, DATA), filters.spline_filters(2, 4, 6)
    want = filters.filtered_errors(poses, of, "err").groupBy("step").agg(F.count("*").alias("n"), F.avg("err").alias("mean"), F.max("err").alias("most")).collect()
    tracks = filters.filtered_errors(poses, of, "err").groupBy("step", "track_id").agg(F.avg("err").alias("e")).groupBy("step").agg(F.count("*").alias("n"), F.avg("e").alias("mean")).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        found = banks.filter_summary(poses, [filters.spline_filters(1, 2, 3), of]).where("configuration = 1").collect()
        means = banks.filter_means(poses, [filters.spline_filters(1, 2, 3), of]).where("configuration = 1").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["step"]: (r["n"], pytest.approx(r["mean"]), pytest.approx(r["most"])) for r in want} == {r["step"]: (r["n"], r["mean_err"], r["most"]) for r in found}
    assert {r["step"]: (r["n"], pytest.approx(r["mean"])) for r in tracks} == {r["step"]: (r["tracks"], r["mean_err"]) for r in means}
