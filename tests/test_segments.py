import math
import random

import numpy as np
import pytest
from pyspark.sql import SparkSession

from trackloom.operators import segments as m


@pytest.fixture(scope="module")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def min_jerk(t):
    t = np.clip(t, 0, 1)
    return 10 * t**3 - 15 * t**4 + 6 * t**5


def fitted(points):
    """The next point of a movement (poses, axes) and its duration, each duration tried with all poses."""
    n = len(points)
    moved, w, best = points - points[0], 0.91 ** (2.0 * np.arange(n)), (np.inf,)
    for d in (1 + np.arange(33) / 8) * (n - 1):
        s = min_jerk(np.arange(n) / d)
        way = (w * s) @ moved / (w * s * s).sum()
        left = (w[:, None] * (moved - s[:, None] * way) ** 2).sum()
        if left < best[0] - 1e-12 * (w[:, None] * moved**2).sum():
            best = left, points[0] + min_jerk(np.array(n / d)) * way, d
    return best[1:]


def moving(p, step, joint=True):
    """Rows since the last pose in no movement, by the rules of one body, or of one axis."""
    last, out = 0, []
    for f in range(len(p)):
        v, u = (p[f] - p[f - 1] if f else 0 * p[0]), (p[f - 1] - p[f - 2] if f > 1 else 0 * p[0])
        pop = np.diff(p[f - 6 : f + 1], n=6, axis=0)[0] if f >= 6 else 0 * p[0]
        if joint:
            size = np.linalg.norm
            still, was = size(v) < 10, f > 1 and size(u) < 10
            cosine = v @ u / (size(v) * size(u)) if size(v) * size(u) else 1.0
            turned = math.acos(max(-1, min(1, cosine))) > math.pi / 6
            jump = size(pop) > 0.1 and size(pop) > 1.25 * size(v - u) / step**2
        else:
            still, was, turned = v[0] < 10, u[0] < 10, np.sign(v[0]) != np.sign(u[0])
            jump = abs(pop[0]) > 0.1 and abs(pop[0]) > 1.25 * abs(v[0] - u[0])
        if f == 0 or still or (f >= 2 and turned and not was) or jump:
            last = f
        out.append(f - last)
    return out


def test_a_noiseless_curve_is_recovered(spark):
    start, end, duration = np.array([1.35, 3.35, 0.0]), np.array([200700.5, 100800.5, 40000.0]), 24
    rows = [(0, f, *map(float, start + min_jerk(np.array(f / duration)) * (end - start))) for f in range(30)]
    got = m.predictions(m.down_sampled(spark.createDataFrame(rows, POSES), (1,)).select("track_id", "step", "k", "x", "y", "z")).collect()
    seen = 0
    for r in got:
        n, first = r["moving"] + 1, r["k"] - r["moving"]
        if n >= 3 and first == 0 and any(abs(duration - d * (n - 1)) < 1e-9 for d in m.DURATIONS):
            seen += 1
            assert np.allclose([r["joint_x"], r["joint_y"], r["joint_z"]], start + min_jerk(np.array((r["k"] + 1) / duration)) * (end - start), atol=1e-6)
    assert seen > 3


POSES = "track_id long, frame long, x double, y double, z double"


def tracks():
    """Moves and rests, and a movement of more than 150 poses on a wide arc."""
    rnd, out = random.Random(1), []
    for t in range(3):
        p, going = np.zeros(3), None
        for f in range(60):
            if f % 15 < 4:
                going = None
            elif going is None:
                going = np.array([rnd.uniform(12, 40), rnd.uniform(-20, 20), 0.0])
            p = p + (going * (1 + 0.05 * rnd.random()) if going is not None else 0)
            out.append((t, f, *map(float, p)))
    for f in range(400):
        a = f / 60
        out.append((3, f, 1500 * math.sin(a), 1500 * math.cos(a), 30.0 * f + 0.01 * f * f))
        out.append((4, f, 20.0 * f + 0.003 * f**2, 15.0 * f, 2000 * math.sin(f / 90)))
    return out


@pytest.mark.parametrize("step", [1, 2])
def test_movements_and_errors_equal_plain_ones(spark, step):
    rows = tracks()
    poses = spark.createDataFrame(rows, POSES).repartition(3)
    found = {(r["track_id"], r["k"]): r["moving"] for r in m.movements(poses).where(f"step = {step}").collect()}
    errors = {(r["track_id"], r["k"]): r for r in m.min_jerk_errors(poses).where(f"step = {step}").collect()}
    longest = 0
    for t in range(5):
        p = np.array([r[2:] for r in rows if r[0] == t and r[1] % step == 0])
        joint, split = moving(p, step), [moving(p[:, c : c + 1], step, False) for c in range(3)]
        for f in range(len(p)):
            assert found[t, f] == joint[f], (t, f)
            if not 2 <= f < len(p) - 1:
                continue
            r, quad = errors[t, f], 3 * p[f] - 3 * p[f - 1] + p[f - 2]
            assert r["quad"] == pytest.approx(np.linalg.norm(quad - p[f + 1]))
            longest = max(longest, joint[f])
            want = fitted(p[f - joint[f] : f + 1])[0] if joint[f] >= 2 else None
            assert (r["err"] is None) == (want is None)
            if want is not None:
                assert r["err"] == pytest.approx(np.linalg.norm(want - p[f + 1]), rel=1e-6, abs=1e-6), (t, f, joint[f])
            axes = [fitted(p[f - n[f] : f + 1, c : c + 1])[0][0] if n[f] >= 2 else quad[c] for c, n in enumerate(split)]
            assert r["axes"] == sum(n[f] >= 2 for n in split)
            assert r["split"] == pytest.approx(np.linalg.norm(axes - p[f + 1]), rel=1e-6, abs=1e-6), (t, f)
    assert longest > 60


def test_one_exchange(spark):
    plan = m.min_jerk_errors(spark.createDataFrame(tracks(), POSES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_nearest_rotations():
    rnd = np.random.default_rng(3)
    rough = rnd.normal(size=(50, 3, 3))
    near = m.nearest_rotations(rough)
    assert np.allclose(near @ near.transpose(0, 2, 1), np.eye(3)) and np.allclose(np.linalg.det(near), 1)
    for r, n in zip(rough, near):
        for _ in range(200):
            q = rnd.normal(size=4)
            w, x, y, z = q / np.linalg.norm(q)
            other = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
            assert np.linalg.norm(r - n) <= np.linalg.norm(r - other) + 1e-9
