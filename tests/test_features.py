"""Features, orientation predictors and localised errors against plain versions from their definitions, and on motions whose values are known."""

import math

import numpy as np
import pytest
from pyspark.sql import SparkSession

from trackloom.operators import features, localized, orientation


@pytest.fixture(scope="module")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


SCHEMA = "track_id long, frame long, x double, y double, z double, vx double, vy double, vz double"


def table(spark, tracks):
    rows = [(t, f, *map(float, (*p, *v))) for t, (ps, vs) in enumerate(tracks) for f, (p, v) in enumerate(zip(ps, vs, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def times(a, b):
    return np.append(a[0] * b[0] - a[1:] @ b[1:], a[0] * b[1:] + b[0] * a[1:] + np.cross(a[1:], b[1:]))


def back(q):
    return q * np.array([1, -1, -1, -1])


def of_vector(v):
    t = np.linalg.norm(v)
    return np.append(math.cos(t / 2), math.sin(t / 2) / t * v) if t else np.array([1.0, 0, 0, 0])


def vector_of(q):
    q = q if q[0] >= 0 else -q
    n = np.linalg.norm(q[1:])
    return 2 * math.atan2(n, q[0]) / n * q[1:] if n else np.zeros(3)


def matrix_of(q):
    return np.array([times(times(q, np.append(0, e)), back(q))[1:] for e in np.eye(3)]).T


def apart(a, b):
    return 2 * math.acos(min(1, abs(a @ b)))


def angle(a, b):
    return math.atan2(np.linalg.norm(np.cross(a, b)), a @ b)


def random_tracks(n=3, length=24, seed=1):
    rnd = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        p = np.cumsum(np.cumsum(rnd.normal(size=(length, 3)), axis=0) + rnd.normal(size=(length, 3)) * 4 + 6, axis=0)
        q, vs = of_vector(rnd.normal(size=3)), []
        axis = rnd.normal(size=3)
        for _ in range(length):
            vs.append(vector_of(q))
            axis = axis + 0.5 * rnd.normal(size=3)
            q = times(of_vector(0.35 * axis / np.linalg.norm(axis) * (0.5 + rnd.random())), q)
        out.append((p, np.array(vs)))
    return out


def circle(a, b, c):
    """Centre, radius, unit normal and signed angles of the circle through three points, by linear equations."""
    n = np.cross(b - a, c - a)
    if np.linalg.norm(n) < 1e-12:
        return None
    n = n / np.linalg.norm(n)
    centre = np.linalg.solve(np.array([b - a, c - a, n]), np.array([(b @ b - a @ a) / 2, (c @ c - a @ a) / 2, n @ a]))
    turn = lambda p, q: math.atan2(np.cross(p - centre, q - centre) @ n, (p - centre) @ (q - centre))
    return centre, np.linalg.norm(a - centre), n, turn(a, b), turn(b, c)


def plain(ps, vs, step, k):
    """Features of target k by their definitions; the newest pose is k - 1."""
    p = lambda i: ps[(k - i) * step]
    q = lambda i: of_vector(vs[(k - i) * step])
    s, v, u, t = float(step), p(1) - p(2), p(2) - p(3), p(3) - p(4)
    a, jerk, size = v - u, p(1) - 3 * p(2) + 3 * p(3) - p(4), np.linalg.norm
    v2 = v + a / 2
    out = {
        "speed_deg1": size(v) / s, "speed_deg2": size(v2) / s, "acc_mag": size(a) / s**2, "jerk_mag": size(jerk) / s**3, "speed_acc_ratio": size(v2) / s / (size(a) / s**2),
        "vel_bcs_ratio": (u @ v) / (v @ v), "disp_mag_diff": size(v) - size(u), "disp_mag_diff_timescaled": (size(v) - size(u)) / s, "disp_mag_ratio": size(v) / size(u),
        "bounce_angle": angle(u, v), "bounce_angle_2_sum": angle(u, v) + angle(t, u), "vel_dot": size(u) * size(v), "timestep": s, "frame_num": k - 1.0, "timestamp": (k - 1) * s,
        "ortho_acc_mag": size(a - v2 * (a @ v2) / (v2 @ v2)) / s**2, "speed_jerk_ratio": size(v2) / s / (size(jerk) / s**3), "acc_jerk_ratio": size(a) / s**2 / (size(jerk) / s**3),
    }
    plane = lambda v2, a: np.cross(v2, a) / size(np.cross(v2, a))
    out["plane_normal_dot"] = plane(v2, a) @ plane(u + (u - t) / 2, u - t)
    now, was = circle(p(3), p(2), p(1)), circle(p(4), p(3), p(2))
    valid = lambda c: c is not None and c[1] ** 2 <= 250000 and abs(c[3] + c[4]) <= math.pi / 2
    names = ("circ_rad", "circ_speed", "circ_ang_speed", "circ_ang_acc", "circ_acc", "circ_ang_ratio", "rad_diff", "circ_centre_diff", "dist_from_circle", "ratio_from_circle")
    out |= dict.fromkeys(names)
    if valid(now):
        c, r, n, one, two = now
        out |= {"circ_rad": r, "circ_speed": r * two / s, "circ_ang_speed": two / s, "circ_ang_acc": (two - one) / s, "circ_acc": r * (two - one) / s**2, "circ_ang_ratio": two / one}
        if valid(was):
            c0, r0, n0, *_ = was
            out |= {"rad_diff": r - r0, "circ_centre_diff": size(c - c0)}
            flat = (p(1) - c0) - ((p(1) - c0) @ n0) * n0
            nearest = c0 + r0 * flat / size(flat)
            out |= {"dist_from_circle": size(p(1) - nearest), "ratio_from_circle": size(p(1) - nearest) / r0}
    na, nb = times(q(1), back(q(2))), times(q(2), back(q(3)))
    wa, wb = vector_of(na), vector_of(nb)
    out["unit_rot_ax_diff"] = size(wa / size(wa) - wb / size(wb))
    # The angle about a fixed axis that comes closest to a turn, by trying many.
    tried = np.linspace(-math.pi, math.pi, 20_001)
    best = lambda axis, turn: tried[np.argmax(np.abs(np.cos(tried / 2) * turn[0] + np.sin(tried / 2) * (axis / size(axis) @ turn[1:])))]
    out["prev_fa_ang_acc"], out["next_fa_ang_acc"] = (size(wa) - best(wb, na)) / s**2, (best(wa, nb) - size(wb)) / s**2
    return out


def test_scalar_features_equal_plain_ones(spark):
    tracks = random_tracks()
    got = {(r["track_id"], r["step"], r["k"]): r.asDict() for r in features.scalar_features(table(spark, tracks)).collect()}
    seen = 0
    for t, (ps, vs) in enumerate(tracks):
        for step in (1, 2, 3):
            for k in range(4, (len(ps) - 1) // step + 1):
                for name, want in plain(ps, vs, step, k).items():
                    have = got[t, step, k][name]
                    if want is None:
                        assert have is None, (name, t, step, k)
                    else:
                        seen += 1
                        assert have == pytest.approx(want, rel=1e-6, abs=4e-4 if "fa_ang" in name else 1e-7), (name, t, step, k)
    assert seen > 2000


def test_events_since(spark):
    ps, vs = random_tracks(1, 60, seed=3)[0]
    ps = ps.copy()
    ps[20:24], ps[40] = ps[20], ps[41] + 300
    got = {r["k"]: r for r in features.scalar_features(table(spark, [(ps, vs)])).where("step = 1").collect()}
    still, turned, way = 1, 2, 0.0
    for k in range(1, 60):
        v = ps[k - 1] - ps[k - 2] if k >= 2 else np.zeros(3)
        u = ps[k - 2] - ps[k - 3] if k >= 3 else np.zeros(3)
        way += np.linalg.norm(v)
        if k < 2 or np.linalg.norm(v) < 10:
            still = k
        if k < 3 or (np.linalg.norm(u) * np.linalg.norm(v) > 0 and angle(u, v) > math.pi / 6):
            turned, way = k, np.linalg.norm(v)
        if k >= 4:
            assert (got[k]["time_since_stationary"], got[k]["time_since_dir_change"]) == (k - still, k - turned)
            assert got[k]["dist_since_dir_change"] == pytest.approx(way)


def test_a_circle_at_constant_speed(spark):
    a = np.arange(40) * 0.2
    ps = np.stack([3 + 80 * np.cos(a), 80 * np.sin(a), 0 * a], axis=1)
    rows = features.scalar_features(table(spark, [(ps, np.outer(a, [0, 0, 1]))])).where("step = 1").collect()
    for r in rows:
        assert (r["circ_rad"], r["circ_speed"], r["circ_ang_speed"]) == (pytest.approx(80), pytest.approx(16), pytest.approx(0.2))
        assert r["dist_from_circle"] == pytest.approx(0, abs=1e-6) and r["circ_ang_acc"] == pytest.approx(0, abs=1e-9)
    assert [r["time_circ_motion"] for r in sorted(rows, key=lambda r: r["k"])][-1] > 30


def test_axis_features_equal_plain_ones(spark):
    (ps, vs), *_ = tracks = random_tracks(1, 14, seed=5)
    got = {(r["step"], r["k"], r["vector"], r["axis"], r["shifted"]): (r["dot"], r["angle"]) for r in features.axis_features(table(spark, tracks)).collect()}
    unit = lambda v: v / np.linalg.norm(v)
    for step in (1, 2):
        for k in range(5, 13 // step + 1):
            p = lambda i: ps[(k - i) * step]  # noqa: E731, B023
            q = lambda i: of_vector(vs[(k - i) * step])  # noqa: E731, B023

            def axes(i):
                v, u = p(i) - p(i + 1), p(i + 1) - p(i + 2)  # noqa: B023
                a = v - u
                v2 = v + a / 2
                turn = vector_of(times(q(i), back(q(i + 1))))  # noqa: B023
                return {"vel_deg1": unit(v), "vel_deg2": unit(v2), "acc": unit(a), "ortho_acc": unit(a - unit(v2) * (a @ unit(v2))), "plane_normal": unit(np.cross(v2, a)), "rotation": unit(turn)}

            v, u = p(1) - p(2), p(2) - p(3)
            wa, wb = vector_of(times(q(1), back(q(2)))), vector_of(times(q(2), back(q(3))))
            missed = p(1) - (4 * p(2) - 6 * p(3) + 4 * p(4) - p(5))
            vectors = {"acc": (v - u) / step**2, "jerk": (p(1) - 3 * p(2) + 3 * p(3) - p(4)) / step**3, "rot_vel": wa / step, "rot_acc": (wa - wb) / step, "err_jerk": missed / step**4}
            for vector, x in vectors.items():
                for shifted in (False, True):
                    for axis, e in axes(2 if shifted else 1).items():
                        if vector == "acc" and not axis.startswith("vel"):
                            assert (step, k, vector, axis, shifted) not in got
                            continue
                        dot, turned = got[step, k, vector, axis, shifted]
                        assert dot == pytest.approx(x @ e, rel=1e-6, abs=1e-9), (vector, axis, shifted)
                        assert turned == pytest.approx(angle(x, e), abs=1e-6), (vector, axis, shifted)


def test_orientation_predictors_equal_plain_ones(spark):
    tracks = random_tracks(2, 18, seed=7)
    got = {(r["track_id"], r["step"], r["k"]): r for r in orientation.orientation_errors(table(spark, tracks)).collect()}
    loose = {(r["track_id"], r["step"], r["k"]): r for r in orientation.unwrapped(features.base(table(spark, tracks))).collect()}
    for t, (_, vs) in enumerate(tracks):
        for step in (1, 2, 3):
            qs = [of_vector(v) for v in vs[::step]]
            rs = [np.array([loose[t, step, k][f"r{c}"] for c in "xyz"]) for k in range(len(qs))]
            for k, q in enumerate(qs):
                assert apart(of_vector(rs[k]), q) < 1e-6  # the same rotation
                if k:  # and none nearer to the one before by whole turns
                    size = np.linalg.norm(rs[k])
                    others = [rs[k] * (1 + 2 * math.pi * n / size) for n in (-1, 1)]
                    assert np.linalg.norm(rs[k] - rs[k - 1]) <= min(np.linalg.norm(o - rs[k - 1]) for o in others) + 1e-6
            for k in range(4, len(qs)):
                r, q = got[t, step, k], qs[k]
                na, nb = times(qs[k - 1], back(qs[k - 2])), times(qs[k - 2], back(qs[k - 3]))
                wa, wb = vector_of(na), vector_of(nb)
                tried = np.linspace(-math.pi, math.pi, 4001)
                about = [apart(times(of_vector(a * wa / np.linalg.norm(wa)), qs[k - 1]), q) for a in tried]
                phi = np.linalg.norm(wa)
                a, b, c = rs[k - 1], rs[k - 2], rs[k - 3]
                twice = lambda a, b: 2 * (a @ b) * b - a
                middle = twice(qs[k - 3], qs[k - 2]) + qs[k - 1]
                middle = middle / np.linalg.norm(middle)
                points = [qs[k - 2], middle, twice(middle, qs[k - 2]), qs[k - 1]]
                while len(points) > 1:
                    points = [twice(a, b) for a, b in zip(points, points[1:], strict=False)]
                want = {
                    "squad": apart(points[0], q), "still": apart(qs[k - 1], q), "vel": apart(times(na, qs[k - 1]), q), "linear": apart(times(of_vector(2 * wa - wb), qs[k - 1]), q),
                    "saturated": apart(times(of_vector(wa / (1 + (phi / (2 * math.pi)) ** 0.75) ** (1 / 0.75)), qs[k - 1]), q),
                    "aa_vel": apart(of_vector(2 * a - b), q), "aa_acc": apart(of_vector(2.5 * a - 2 * b + 0.5 * c), q), "aa_spline2": apart(of_vector(a + (a - b) + 5 / 6 * (a - 2 * b + c)), q),
                    "fixed_axis_bcs": min(about),
                }
                for name, w in want.items():
                    assert r[name] == pytest.approx(w, abs=2e-3 if name == "fixed_axis_bcs" else 2e-6), (name, t, step, k)


def test_constant_turn_is_predicted(spark):
    vs = [vector_of(of_vector(np.array([0.1, 0.2, -0.15]) * f)) for f in range(30)]
    ps = np.stack([np.arange(30.0) * 5, np.arange(30.0) ** 2, np.zeros(30)], axis=1)
    for r in orientation.orientation_errors(table(spark, [(ps, vs)])).collect():
        assert max(r[n] for n in ("vel", "linear", "aa_vel", "aa_acc", "aa_spline2", "fixed_axis_bcs", "fixed_axis_acc", "fixed_axis_acc2")) < 1e-5


def test_localised_errors_equal_plain_ones(spark):
    tracks = random_tracks(2, 16, seed=9)
    rows = localized.localized(table(spark, tracks)).collect()
    got = {(r["track_id"], r["step"], r["k"], r["model"], r["frame_kind"]): np.array([r["ex"], r["ey"], r["ez"]]) for r in rows}
    unit = lambda v: v / np.linalg.norm(v)
    for t, (ps, vs) in enumerate(tracks):
        for step in (1, 3):
            for k in range(4, 15 // step + 1):
                p = lambda i: ps[(k - i) * step]  # noqa: E731, B023
                made = {"VEL_DEG1": 2 * p(1) - p(2), "VEL_DEG2": 2.5 * p(1) - 2 * p(2) + 0.5 * p(3), "ACC_DEG2": 3 * p(1) - 3 * p(2) + p(3), "JERK": 4 * p(1) - 6 * p(2) + 4 * p(3) - p(4)}
                a = p(1) - 2 * p(2) + p(3)
                frames = {"world": np.eye(3), "object": matrix_of(of_vector(vs[(k - 1) * step]))}
                for name, v in (("velocity", p(1) - p(2)), ("velocity2", p(1) - p(2) + a / 2)):
                    first = unit(v)
                    second = unit(a - (a @ first) * first)
                    frames[name] = np.stack([first, second, np.cross(first, second)], axis=1)
                for model, m in made.items():
                    for frame, axes in frames.items():
                        assert got[t, step, k, model, frame] == pytest.approx((p(0) - m) @ axes, rel=1e-6, abs=1e-6), (model, frame)


def test_statistics_equal_plain_ones(spark):
    tracks = random_tracks(4, 20, seed=11)
    errors = localized.localized(table(spark, tracks)).cache()
    rows = [r for r in errors.collect() if r["ex"] is not None]
    for r in localized.statistics(errors).where("kind = 'all' AND step < 3").collect():
        e = np.array([[x["ex"], x["ey"], x["ez"]] for x in rows if all(x[c] == r[c] for c in ("step", "model", "frame_kind"))])
        mean, cov = e.mean(axis=0), np.cov(e.T)
        off = np.linalg.norm(e - mean, axis=1)
        assert r["n"] == len(e)
        assert [r[f"mean_{c}"] for c in localized.MOMENTS] == pytest.approx(mean)
        assert r["det"] == pytest.approx(np.linalg.det(cov), rel=1e-6)
        assert (r["mean_distance"], r["mean_square_distance"], r["mean_size"]) == pytest.approx((off.mean(), (off**2).mean(), np.linalg.norm(e, axis=1).mean()))
        half = (r["high_ex"] - r["low_ex"]) / 2 / (e[:, 0].std(ddof=1) / math.sqrt(len(e)))
        assert 1.96 < half < 2.1 and (r["high_ex"] + r["low_ex"]) / 2 == pytest.approx(mean[0])


def test_principal_axes_equal_numpy(spark):
    rnd = np.random.default_rng(6)
    mats = [np.cov(rnd.normal(size=(12, 3)).T * rnd.random((3, 1)) * 50) for _ in range(30)] + [np.diag([3.0, 1.0, 2.0]), np.zeros((3, 3))]
    names = "step int, model string, kind string, frame_kind string, var_ex double, var_ey double, var_ez double, cov_ex_ey double, cov_ex_ez double, cov_ey_ez double"
    rows = [(i, "m", "k", "f", *map(float, (c[0, 0], c[1, 1], c[2, 2], c[0, 1], c[0, 2], c[1, 2]))) for i, c in enumerate(mats)] + [(99, "m", "k", "f", *[None] * 6)]
    got = {(r["step"], r["i"]): r for r in localized.principal_axes(spark.createDataFrame(rows, names)).collect()}
    assert len(got) == 3 * 31
    for i, c in enumerate(mats[:-1]):
        values, vectors = np.linalg.eigh(c)
        for j, at in enumerate(np.argsort(-values)):
            u = vectors[:, at] * np.sign(vectors[np.abs(vectors[:, at]).argmax(), at])
            assert got[i, j]["eigenvalue"] == pytest.approx(values[at], rel=1e-6, abs=1e-9)
            assert [got[i, j][f"u{x}"] for x in "xyz"] == pytest.approx(u, abs=1e-6)
