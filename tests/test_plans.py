"""How often queries read the tables, and how many exchanges by track they take."""

import re

import pytest
from pyspark.sql import SparkSession

from trackloom.plans import best_class, curves, features, learning, long_tracks, motion, queries, reports, views

DATA = "/root/testdata/sf0.001"
QUERIES = queries.QUERIES | motion.QUERIES | features.QUERIES | reports.QUERIES | learning.QUERIES | curves.QUERIES | views.QUERIES | best_class.QUERIES | long_tracks.QUERIES


@pytest.fixture(scope="module")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Scans of events and exchanges by track in the last job; what a query writes between is read once more before: local_error_statistics, best_class_statistics, sinc_filter_grid.
MOST = {
    "chosen_model_errors": (1, 1), "spline_errors": (1, 1), "scalar_features": (1, 1), "orientation_errors": (1, 1), "min_jerk_errors": (1, 1), "camera_object_errors": (1, 1),
    "local_error_statistics": (1, 1), "best_class_statistics": (1, 1), "chosen_bodies": (1, 1), "multiplier_errors": (1, 1), "sinc_filter_grid": (0, 0), "spline_metrics": (1, 1),
}


@pytest.mark.parametrize("name", MOST)
def test_scans_and_exchanges(spark, name):
    from trackloom.plans import sweeps

    plan = (QUERIES | sweeps.QUERIES)[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    scans, exchanges = MOST[name]
    assert len(re.findall(r"FileScan parquet .*events\.parquet", plan)) <= scans
    assert len(re.findall(r"Exchange hashpartitioning\((?:track_id|user_id)#", plan)) <= exchanges
