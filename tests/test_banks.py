import numpy as np
import pytest
from pyspark.sql import SparkSession

from trackloom.operators import banks as m
from trackloom.operators import filters, gram, orientation
from trackloom.operators.features import base

from .test_features import apart, back, of_vector, random_tracks, table, times, vector_of


@pytest.fixture(scope="module")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


SCALES, POWERS = np.array([0.5, 1.5, 3.0]), np.array([0.7, 2.0, 4.0])
MAPS = {
    "saturated": (m.saturated(SCALES, POWERS), lambda x, i: x / (1 + (x / SCALES[i]) ** POWERS[i]) ** (1 / POWERS[i])),
    "linear": (m.linear(SCALES), lambda x, i: SCALES[i] * x),
    "arctangent": (m.arctangent(SCALES), lambda x, i: SCALES[i] * np.arctan2(2 * np.sin(x / SCALES[i]), 2 * np.cos(x / SCALES[i]) - 1) - x),
}


def off(vs, step, i, angle):
    """Errors of a track by quaternions, k from 1."""
    qs = [of_vector(v) for v in vs[::step]]
    out = [apart(qs[1], qs[0])]
    for k in range(2, len(qs)):
        turn = vector_of(times(qs[k - 1], back(qs[k - 2])))
        size = np.linalg.norm(turn)
        out.append(apart(times(of_vector(turn / size * angle(size, i)), qs[k - 1]), qs[k]))
    return out


@pytest.mark.parametrize("name", MAPS)
def test_turn_banks(spark, monkeypatch, name):
    monkeypatch.setattr(m, "MATRIX", 12)
    tracks = random_tracks(5, 17, seed=2)
    errors, angle = MAPS[name]
    rows = m.turns(table(spark, tracks))
    means = {(r["step"], r["configuration"]): r for r in m.track_means(rows, errors, 3).collect()}
    medians = {(r["step"], r["configuration"]): r for r in m.medians(rows.where("k >= 2"), errors, 3, cells=5).collect()}
    for step in (1, 2, 3):
        for i in range(3):
            every = [off(vs, step, i, angle) for _, vs in tracks]
            assert means[step, i]["tracks"] == 5
            assert means[step, i]["mean_err"] == pytest.approx(np.mean([np.mean(e) for e in every]), abs=1e-6)
            pooled = [x for e in every for x in e[1:]]
            assert medians[step, i]["n"] == len(pooled)
            assert medians[step, i]["median"] == pytest.approx(np.median(pooled), abs=1e-6)


def test_sweep_equals_single_filters(spark):
    tracks = random_tracks(3, 25, seed=4)
    poses, fits = table(spark, tracks), [(1, 2, 3), (2, 4, 6)]
    got = {(r["step"], r["mode"], r["degree"]): r for r in m.spline_sweep(poses, fits, ("extrapolate", "smooth")).collect()}
    vectors = {(r["track_id"], r["step"], r["k"]): np.array([r[f"r{c}"] for c in "xyz"]) for r in orientation.unwrapped(base(poses)).collect()}
    assert len(got) == 3 * 2 * 2
    for step in (1, 2, 3):
        for mode in ("extrapolate", "smooth"):
            for fit in fits:
                bank, by_track = filters.spline_filters(*fit, mode), []
                for t, (ps, vs) in enumerate(tracks):
                    ps, qs = ps[::step], [of_vector(v) for v in vs[::step]]
                    rows = []
                    for k in range(1, len(ps)):
                        w = np.array(bank[min(k, max(bank))])
                        past = np.array([vectors[t, step, j] for j in range(k - len(w), k)])
                        rows.append((np.linalg.norm(ps[k] - w @ ps[k - len(w) : k]), apart(of_vector(w @ past), qs[k])))
                    d, a = np.array(rows).T
                    by_track.append([(d < 20).mean(), (d < 50).mean(), d.mean(), (a < np.radians(2)).mean(), (a < np.radians(5)).mean(), a.mean()])
                r = got[step, mode, fit[0]]
                assert r["tracks"] == 3
                assert [r[n] for n in m.METRICS] == pytest.approx(np.mean(by_track, axis=0), abs=1e-6), (step, mode, fit)


def test_empty(spark):
    rows = m.turns(table(spark, []))
    assert m.track_means(rows, MAPS["linear"][0], 3).collect() == []
    assert m.medians(rows, MAPS["linear"][0], 3).collect() == []


def test_correlations(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(300, 4)) + 1e6
    x[:, 1] += 3 * (x[:, 0] - 1e6)
    values = [[None if rnd.random() < 0.2 and j < 3 else float(v) for j, v in enumerate(row)] + [7.0] for row in x]
    names = ["a", "b", "c", "d", "e"]
    pairs = {(r["a"], r["b"]): r for r in gram.correlations(spark.createDataFrame(values, ", ".join(f"{n} double" for n in names)).repartition(3), names).collect()}
    assert len(pairs) == 10
    for i, a in enumerate(names):
        for j, b in enumerate(names[i + 1 :], i + 1):
            both = np.array([(r[i], r[j]) for r in values if r[i] is not None and r[j] is not None])
            assert pairs[a, b]["n"] == len(both)
            if b == "e":
                assert pairs[a, b]["r"] is None
            else:
                assert pairs[a, b]["r"] == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-7)
    kept = {r["feature"]: r["dropped"] for r in gram.collinear(gram.correlations(spark.createDataFrame(values, ", ".join(f"{n} double" for n in names)), names)).collect()}
    assert kept == {"b": True, "c": False, "d": False, "e": False}


def test_medians_of_many_configurations(spark, monkeypatch):
    """A task counts in one table: what it hands on doesn't grow with its rows. Evenly spaced scales take the cosines of sums of angles; ties, and a gap in the middle."""
    monkeypatch.setattr(m, "MATRIX", 64)
    monkeypatch.setattr(m, "FEW", 4)
    scales = np.linspace(0, 1, 23)
    rows = m.turns(table(spark, random_tracks(4, 20, seed=5))).where("k >= 2").localCheckpoint()
    errors = m.linear(scales)
    at = rows.toPandas()
    got = m.medians(rows, m.linear_cosines(scales), 23, cells=6, read=m.of_cosines).toPandas().set_index(["step", "configuration"])["median"]
    for step, of in at.groupby("step"):
        assert [got[step, i] for i in range(23)] == pytest.approx(np.median(errors(of), axis=0), abs=1e-7)
    seen = spark.createDataFrame([(1, float(v)) for v in [0] * 40 + [1] * 40 + [7]] + [(2, float(v)) for v in [0] * 30 + [1e9] * 30], "step long, v double").repartition(3)
    found = {(r["step"], r["configuration"]): r["median"] for r in m.medians(seen, lambda b: b["v"].to_numpy()[:, None] * np.array([1.0, 2.0]), 2, cells=8).collect()}
    assert found == {(1, 0): 1.0, (1, 1): 2.0, (2, 0): 5e8, (2, 1): 1e9}
    # A row a configuration and task, and of equal values one.
    monkeypatch.setattr(m, "FEW", 1000)
    handed = []
    kept = type(rows).mapInPandas

    def counted(self, f, schema, **more):
        out = kept(self, f, schema, **more).localCheckpoint()
        handed.append(out.count())
        return out

    monkeypatch.setattr(type(rows), "mapInPandas", counted)
    m.medians(seen.coalesce(1), lambda b: b["v"].to_numpy()[:, None] * np.array([1.0, 2.0]), 2)
    assert handed[0] == 4 and max(handed) <= 20


def test_saturated_of_large_powers():
    """Ratios whose powers are beyond all numbers saturate at the scale, and no turn stays none."""
    b = m.pd.DataFrame({"k": 5, "last": [0.0, 2.0, 1e-3], "noww": [1.0, 0.5, 0.2], "part": [0.0, 0.6, -0.3], "turn": 0.0})
    want = m.turn_errors(lambda x: np.minimum(x, 0.001))(b)
    assert m.saturated(np.array([0.001]), np.array([400.0]))(b)[:2] == pytest.approx(want[:2], abs=1e-7)


def test_filters_that_are_one_for_the_poses_at_hand_are_measured_once():
    """While a track is short, fits of more poses are those of the poses that there are."""
    bank = [filters.spline_filters(*c, mode) for mode in filters.MODES for c in filters.grid(range(1, 4), 5, 8)]
    weights = m._weights(bank)
    assert [weights[n][0].shape[1] for n in (1, 2)] == [1, 3] and weights[5][0].shape[1] < len(bank) / 2
    for n, (columns, which) in weights.items():
        for of, w in zip(bank, columns[:, which].T, strict=True):
            plain = of[min(n, max(of))] if n else []
            assert w.tolist() == [0.0] * (n - len(plain)) + plain


def test_angles_by_polynomials():
    """Angles between orientations and rotation vectors of any length are those by NumPy's own functions; none is one too, and so are whole turns."""
    rnd = np.random.default_rng(6)
    q = rnd.normal(size=(4, 200))
    q /= np.linalg.norm(q, axis=0)
    made = rnd.normal(size=(3, 200, 30)) * np.array([0, 1e-200, 1e-9, 0.1, 1, 50])[rnd.integers(0, 6, (200, 1))]
    made[:, 0, :3] = np.array([[0, 2 * np.pi, 4 * np.pi], [0, 0, 0], [0, 0, 0]])
    length = np.sqrt((made * made).sum(axis=0))
    want = np.abs(q[0][:, None] * np.cos(length / 2) + 0.5 * np.sinc(length / (2 * np.pi)) * np.einsum("ir,irf->rf", q[1:], made))
    cosines = m._cosines(dict(zip(["qw", "qx", "qy", "qz"], q, strict=True)), made.copy())
    assert np.abs(cosines - want).max() < 1e-12
    assert np.abs(m._angles(want.copy()) - 2 * np.arccos(np.minimum(1, want))).max() < 1e-12
    assert m._angles(np.array([1.0, 0.0, 1 + 1e-15])) == pytest.approx([0, np.pi, 0], abs=1e-12)
