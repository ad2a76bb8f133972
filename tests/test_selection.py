import math
import random

import numpy as np
import pytest
from pyspark.sql import SparkSession

from trackloom.operators import selection as m


@pytest.fixture(scope="module")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def groups():
    rnd = random.Random(1)
    return {
        "plain": [rnd.gauss(0, 1) for _ in range(501)],
        "even": [rnd.random() for _ in range(400)],
        "ratios": [1 / (rnd.random() - 0.5) ** 5 for _ in range(800)],
        "tiny": [rnd.gauss(0, 1) * 1e-200 for _ in range(99)] + [1e200, -1e300],
        "close": [1 + i * 2.0**-52 for i in range(300)],
        "same": [3.5] * 50,
        "ties": [float(rnd.randrange(3)) for _ in range(301)],
        "one": [-7.25],
        "two": [1.0, 2.0],
        "negative": [-math.exp(rnd.gauss(0, 9)) for _ in range(333)],
    }


@pytest.mark.parametrize(("share", "cells"), [(0.5, 1024), (0.9, 7), (0.0, 64), (1.0, 2), (0.25, 16)])
def test_equals_sorting(spark, share, cells):
    rows = [(g, i % 2, v) for g, vs in groups().items() for i, v in enumerate(vs)] + [("plain", 0, None), ("plain", 0, float("nan")), (None, 0, 1.0), ("none", 1, None)]
    table = spark.createDataFrame(rows, "g string, part int, v double").repartition(5)
    got = {r["g"]: r for r in m.quantiles(table, ["g"], "v", share, cells).collect()}
    assert set(got) == set(groups())
    for g, vs in groups().items():
        assert got[g]["n"] == len(vs)
        assert got[g]["quantile"] == pytest.approx(np.quantile(vs, share), rel=1e-12, abs=0), g


def test_cells_are_in_order_and_apart():
    for vs in groups().values():
        v = np.sort(np.unique(vs))
        if len(v) > 1:
            cell = m.cells_of(v, v[0], v[-1], 64)
            assert (np.diff(cell) >= 0).all() and cell[0] == 0 and cell[-1] == 63


def test_edges(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert m.quantiles(empty, ["g"], "v", 0.5).collect() == []
    with pytest.raises(ValueError):
        m.quantiles(empty, ["g"], "v", 1.5)
