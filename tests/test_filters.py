import math
import random

import numpy as np
import pytest
from pyspark.sql import SparkSession

from trackloom.operators import filters as m


@pytest.fixture(scope="module")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def test_basis_sums_to_one():
    for degree in range(5):
        for count in range(degree + 1, 9):
            b = m.basis(np.linspace(degree, count, 13), degree, count)
            assert np.allclose(b.sum(axis=1), 1) and (b > -1e-12).all()


@pytest.mark.parametrize("mode", m.MODES)
def test_splines_reproduce_polynomials(mode):
    """A fit of a degree follows a polynomial of that degree; smooth ends at the last pose, the others at the next, if acceleration is enough."""
    for degree in range(1, 6):
        for controls in range(degree + 1, 8):
            for inputs in range(controls, 12):
                w = m.spline_weights(degree, controls, inputs, mode)
                assert sum(w) == pytest.approx(1)
                for p in range(1, min(degree, 9 if mode in ("extrapolate", "smooth") else 2) + 1):
                    if mode == "extrapolate" and controls == inputs + 1:
                        continue
                    t = np.arange(inputs) / 5
                    want = (t[-1] if mode == "smooth" else inputs / 5) ** p
                    if mode == "extrapolate" and controls > degree + 1:
                        continue  # the curve's last part may have no pose to hold it
                    assert np.dot(w, t**p) == pytest.approx(want, abs=1e-6), (degree, controls, inputs, p)


def test_sinc_filters():
    for n, w in m.sinc_filters(5.5, 8.0).items():
        assert sum(w) == pytest.approx(1) and len(w) == n
    t = np.array([-1.7, -0.3, 0.2, 0.9, 2.4, 5.4])
    h = 1e-6
    f = lambda t: np.sinc(t) * np.exp(-8.0 * t * t / (5.5**2 - t * t))
    assert np.allclose(m.sinc_derivative(t, 5.5, 8.0), (f(t + h) - f(t - h)) / (2 * h), atol=1e-6)
    assert (m.sinc_derivative(np.array([5.5, 7.0]), 5.5, 8.0) == 0).all()


def test_first_rows(spark):
    rnd = random.Random(3)
    rows = [(t, f, *(rnd.random() * 60 for _ in "xyz")) for t in range(4) for f in range(30)]
    poses = spark.createDataFrame(rows, "track_id long, frame long, x double, y double, z double")
    # By hand: the first row's history is one pose.
    first = [r for r in m.filtered_errors(poses, m.spline_filters(2, 4, 6), "err").collect() if (r["track_id"], r["step"], r["k"]) == (0, 1, 1)]
    assert first[0]["err"] == pytest.approx(math.dist(rows[0][2:], rows[1][2:]))


def test_grid():
    assert len(m.grid()) == sum(1 for d in range(1, 6) for c in range(d + 1, 11) for n in range(c, 21))


@pytest.mark.parametrize("mode", m.MODES)
def test_sinc_splines(mode):
    """Constant tracks stay, and wide functions with little taper follow a slow curve."""
    for degree in (1.2, 2.0, 2.66):
        for controls in range(int(degree) + 2, 8):
            for inputs in range(controls, 12):
                w = m.sinc_spline_weights(degree, controls, inputs, 6.6, 20.0, mode)
                # Rows of the basis sum to 1, so the fit holds a constant.
                assert sum(w) == pytest.approx(1, abs=1e-6) and len(w) == inputs
    u = np.array([2.3, 4.0, 5.9])
    b = m.sinc_basis(u, 2.2, 6, 4.7, 8.0)
    for row, x in zip(b, u):
        t = [(x - i) / 1.6 - 1 for i in range(6)]
        raw = [math.sin(math.pi * v) / (math.pi * v) * math.exp(-8 * v * v / (4.7**2 - v * v)) if v else 1.0 for v in t]
        assert row == pytest.approx([r / sum(raw) for r in raw])
