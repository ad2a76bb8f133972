"""Queries on orientations, circles and shapes of tracks, and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import predict as pr
from ..operators import rotation, shape, tree
from ..sources import poses as src
from .queries import FIVE, MODELS, r6
from .sql import ALL, KEYS, LAGS, LOCAL, POSES, STEPS, _err, _errors, _norm

SCALES = [i / 10 for i in range(5, 13)]


def _turned(spark, d, scale=1):
    """Event poses with made-up axis-angle vectors, zero ones among them."""
    p = src.event_poses(spark, d)
    v = [((F.floor("x") % 7) - 3) * F.lit(0.2), ((F.col("y") % 5) - 2) * F.lit(0.2), ((F.col("z") % 3) - 1) * F.lit(0.2)]
    return p.select("*", *((c.cast("double") * scale).alias(f"v{n}") for c, n in zip(v, "xyz")))


def rotation_errors(spark, d):
    e = rotation.errors(_turned(spark, d))
    return e.select(*pr.KEYS, "k", *(r6(c) for c in ("still", "vel", "damped", "screw", "turn")))


def rotation_scores(spark, d):
    """Share of frames within two degrees, and mean angle, of each orientation predictor."""
    e = pr.long_errors(rotation.errors(_turned(spark, d)), ["still", "vel", "damped"])
    near = F.avg((F.col("err") <= F.radians(F.lit(2.0))).cast("int"))
    return e.groupBy("step", "model").agg(F.count("*").alias("n"), r6(near, "score"), r6(F.avg("err"), "mean_err"))


def rotation_scale_sweep(spark, d):
    s = rotation.scale_sweep(rotation.errors(_turned(spark, d)), SCALES)
    return s.select("step", "scale", r6("linear"), r6("saturated"))


def circle_errors(spark, d):
    e = shape.circle_errors(src.event_poses(spark, d))
    return e.select(*pr.KEYS, "k", "on_circle", *(r6(c) for c in shape.CIRCULAR))


def circle_shares(spark, d):
    e = shape.circle_errors(src.event_poses(spark, d))
    return e.groupBy("step").agg(F.count("*").alias("n"), F.sum(F.col("on_circle").cast("long")).alias("n_circle"), r6(F.avg("CIRC_VEL1"), "mean_err"))


def tangents(spark, d):
    t = shape.tangents(pr.down_sampled(src.event_poses(spark, d)))
    return t.select(*pr.KEYS, "k", *(r6(f"t{c}") for c in "xyz"))


def even_lengths(spark, d):
    return shape.even_lengths(src.event_poses(spark, d)).select("track_id", "i", *(r6(c) for c in "xyz"))


LOCAL_MOTION = ["speed", "acc_along", "acc_across", "jerk0", "jerk1", "jerk2", "next0", "next1", "next2"]


def local_motion(spark, d):
    return shape.local_motion(src.event_poses(spark, d)).select(*pr.KEYS, "k", *(r6(c) for c in LOCAL_MOTION))


ORDER = ("jerk", "velocity", "acceleration")
ORDERED = ["size", "along", "across", "third0", "third1", "third2", "next0", "next1", "next2"]


def ordered_motion(spark, d):
    """Motion in the frame of the jerk and the velocity across it, and the frame itself."""
    rows = shape.ordered_motion(src.event_poses(spark, d), ORDER)
    return rows.select(*pr.KEYS, "k", *(r6(c) for c in ORDERED), *(r6(F.col("frame")[i], f"m{i}") for i in range(9)))


def sweep_metrics(spark, d):
    """Shares of errors under 20 and under 50 and the mean, by track, then over tracks."""
    e = pr.long_errors(pr.errors(src.event_poses(spark, d), MODELS))
    share = lambda t: F.avg((F.col("err") < t).cast("int"))
    by = e.groupBy("track_id", "step", "model").agg(share(20).alias("a"), share(50).alias("b"), F.avg("err").alias("m"))
    return by.groupBy("step", "model").agg(r6(F.avg("a"), "under_20"), r6(F.avg("b"), "under_50"), r6(F.avg("m"), "mean_err"))


def chosen_model_errors(spark, d):
    """Errors of three ways to choose a model: always the quadratic one, the previous frame's best, this frame's best."""
    wide = pr.errors(src.event_poses(spark, d), FIVE)
    each = F.array(*(F.struct(F.col(m).alias("err"), F.lit(i).alias("i")) for i, m in enumerate(FIVE)))
    best = wide.select(*pr.KEYS, "k", F.array(*FIVE).alias("errs"), F.array_min(each).alias("best"))
    last = F.element_at("errs", F.lag("best.i", 1, 0).over(pr.order()) + 1)
    ways = {"quadratic": F.element_at("errs", FIVE.index("ACC_DEG2") + 1), "causal": last, "best": F.col("best.err")}
    rows = best.select("step", *(e.alias(n) for n, e in ways.items()))
    rows = rows.select("step", F.inline(F.array(*(F.struct(F.lit(n).alias("way"), F.col(n).alias("err")) for n in ways))))
    return rows.groupBy("step", "way").agg(F.count("*").alias("n"), r6(F.avg("err"), "mean_err"))


def unusual_frames(spark, d):
    """Neighbouring axis-angle vectors that don't point the same way: rows where their dot product is not above 0."""
    w = pr.order()
    rows = pr.down_sampled(_turned(spark, d)).select(*pr.KEYS, "k", sum((F.col(c) * F.lag(c).over(w) for c in ("vx", "vy", "vz")), F.lit(0.0)).alias("dot"))
    return rows.where("dot <= 0").select(*pr.KEYS, "k", r6("dot"))


def last_direction(spark, d):
    """Unit displacement, or where a track stands still the last one that it had."""
    w = pr.order()
    rows = pr.down_sampled(src.event_poses(spark, d)).select(*pr.KEYS, "k", *((F.floor(F.col(c) / 50) - F.lag(F.floor(F.col(c) / 50)).over(w)).cast("double").alias(c) for c in "xy"))
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    unit = [F.last(F.when(size > 0, F.col(c) / size), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"u{c}") for c in "xy"]
    return rows.select(*pr.KEYS, "k", *unit).select(*pr.KEYS, "k", r6("ux"), r6("uy"))


TREE = ["speed", "acc", "turn"]


def tree_root_split(spark, d):
    """The first cut of the tree that chooses a model by cost, for each step."""
    rows = tree.binned(tree.training_rows(src.event_poses(spark, d), FIVE), TREE).withColumn("node", F.col("step"))
    found = tree.best_splits(rows, TREE, FIVE)
    return found.select(F.col("node").alias("step"), "feature", F.col("bin").cast("long").alias("bin"), F.round("cost", 3).alias("cost"), F.round("whole", 3).alias("whole"), "left_model", "right_model")


def gaussian_divergence(spark, d):
    """Kullback-Leibler divergence of the errors' Gaussian in the velocity's frame from that in the world's."""
    cols = ["ex", "ey", "ez"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    local = ev.local_errors(src.event_poses(spark, d), "VEL_DEG1").where("ex IS NOT NULL AND ey IS NOT NULL AND ez IS NOT NULL")
    g = local.groupBy("step", "frame_kind").agg(*(F.avg(c).alias(f"m{c[1]}") for c in cols), *(F.covar_samp(a, b).alias(f"c{a[1]}{b[1]}") for a, b in pairs))
    a = g.where("frame_kind = 'velocity'").drop("frame_kind")
    b = g.where("frame_kind = 'world'").select("step", *(F.col(c).alias(f"w{c}") for c in g.columns[2:]))
    return a.join(b, "step").select("step", F.round(F.expr(DIVERGENCE), 5).alias("divergence"))


def _inverse(p):
    """Determinant and the inverse's numerators of a symmetric matrix of columns."""
    xx, xy, xz, yy, yz, zz = (f"{p}c{n}" for n in ("xx", "xy", "xz", "yy", "yz", "zz"))
    n = {"xx": f"({yy}*{zz}-{yz}*{yz})", "xy": f"({xz}*{yz}-{xy}*{zz})", "xz": f"({xy}*{yz}-{xz}*{yy})"}
    n |= {"yy": f"({xx}*{zz}-{xz}*{xz})", "yz": f"({xy}*{xz}-{xx}*{yz})", "zz": f"({xx}*{yy}-{xy}*{xy})"}
    return f"({xx}*{n['xx']}+{xy}*{n['xy']}+{xz}*{n['xz']})", n


_det, _n = _inverse("w")
_trace = "+".join(f"{1 if a == b else 2}*{_n[a + b]}*c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
_shift = "+".join(f"{1 if a == b else 2}*{_n[a + b]}*(wm{a}-m{a})*(wm{b}-m{b})" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
DIVERGENCE = f"(({_trace})/{_det} - 3 + ({_shift})/{_det} + ln({_det}/{_inverse('')[0]}))/2"

QUERIES = {
    f.__name__: f
    for f in (
        rotation_errors, rotation_scores, rotation_scale_sweep, circle_errors, circle_shares, tangents, even_lengths, local_motion, ordered_motion,
        sweep_metrics, chosen_model_errors, unusual_frames, last_direction, tree_root_split, gaussian_divergence,
    )
}


# The same in DuckDB's SQL, layer by layer.
def _dot(a, b, axes="xyz"):
    return "(" + "+".join(f"{a.format(c)}*{b.format(c)}" for c in axes) + ")"


def _cross(a, b):
    return {c: f"({a.format(p)}*{b.format(q)}-{a.format(q)}*{b.format(p)})" for c, p, q in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))}


def _times(a, b):
    w, x, y, z = (a.format(c) for c in "wxyz")
    e, f, g, h = (b.format(c) for c in "wxyz")
    return {
        "w": f"({w}*{e}-{x}*{f}-{y}*{g}-{z}*{h})",
        "x": f"({w}*{f}+{x}*{e}+{y}*{h}-{z}*{g})",
        "y": f"({w}*{g}-{x}*{h}+{y}*{e}+{z}*{f})",
        "z": f"({w}*{h}+{x}*{g}-{y}*{f}+{z}*{e})",
    }


def _named(columns, name):
    return ", ".join(f"{v} AS {name.format(c)}" for c, v in columns.items())


def _rounded(columns):
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


W = "WINDOW w AS (PARTITION BY track_id, step ORDER BY k)"
BACK = {"w": "qw2", "x": "(-qx2)", "y": "(-qy2)", "z": "(-qz2)"}
BACK1 = {"w": "qw1", "x": "(-qx1)", "y": "(-qy1)", "z": "(-qz1)"}


def _by(t):
    return type("T", (), {"format": staticmethod(lambda c: t[c])})


_move = {c: f"({c}1-{c}2)" for c in "xyz"}
_once, _twice = _cross("l{}", _by(_move)), _cross("l{}", "o{}")
ROT = f"""WITH {STEPS},
v AS (SELECT *, ((floor(x) % 7) - 3) * 0.2e0 AS vx, ((y % 5) - 2) * 0.2e0 AS vy, ((z % 3) - 1) * 0.2e0 AS vz FROM st),
t AS (SELECT *, sqrt({_dot('v{}', 'v{}')}) AS t FROM v),
q AS (SELECT *, cos(t/2) AS qw, {', '.join(f'v{c}*CASE WHEN t = 0 THEN 0.5 ELSE sin(t/2)/t END AS q{c}' for c in 'xyz')} FROM t),
h AS (SELECT *, {', '.join(f'lag({c}, {i}) OVER w AS {c}{i}' for i in (1, 2) for c in ('x', 'y', 'z', 'qw', 'qx', 'qy', 'qz'))} FROM q {W}),
l AS (SELECT *, {_named(_times('q{}1', _by(BACK)), 'l{}')}, {_named(_times('q{}', _by(BACK1)), 'n{}')} FROM h WHERE k >= 2),
o AS (SELECT *, {_named(_once, 'o{}')}, acos(least(1, abs(lw))) AS half FROM l),
s AS (SELECT *, {_named(_twice, 'c{}')}, CASE WHEN lw < 0 THEN -1 ELSE 1 END * sin(half*0.8525)/nullif(sqrt({_dot('l{}', 'l{}')}), 0) AS sc FROM o),
d AS (SELECT *, CASE WHEN 2*half < 1e-4 THEN 1 ELSE cos(half*0.8525) END AS dw,
      {', '.join(f'CASE WHEN 2*half < 1e-4 THEN 0 ELSE l{c}*sc END AS d{c}' for c in 'xyz')} FROM s),
f AS (SELECT *, {_named(_times('l{}', 'q{}1'), 'a{}')}, {_named(_times('d{}', 'q{}1'), 'r{}')} FROM d),
e AS (SELECT track_id, step, k, {', '.join(f"2*acos(least(1, abs({_dot('q{}', b, 'wxyz')}))) AS {n}" for n, b in (('still', 'q{}1'), ('vel', 'a{}'), ('damped', 'r{}')))},
      sqrt({'+'.join(f'({c}-({c}1+{_move[c]}+2*(lw*o{c}+c{c})))**2' for c in 'xyz')}) AS screw, 2*acos(least(1, abs(nw))) AS turn FROM f)"""

_m, _ma, _bm = _cross("a{}", "r{}"), _cross("m{}", "a{}"), _cross("r{}", "m{}")


def _signed(s, t):
    turn = f"acos(greatest(-1, least(1, {_dot(s, t)}/nullif({_dot('d{}', 'd{}')}, 0))))"
    return f"CASE WHEN {_dot('m{}', _by(_cross(s, t)))} < 0 THEN -{turn} ELSE {turn} END"


def _circle_error(last, before):
    t = f"greatest(-pi()/2, least(pi()/2, {last}*angle2+{before}*angle1))"
    to = " + ".join(f"({c}-({c}3+o{c}+f{c}*cos({t})+g{c}*sin({t})))**2" for c in "xyz")
    held = " + ".join(f"({c}-(2*{c}1-{c}2))**2" for c in "xyz")
    return f"CASE WHEN on_circle THEN sqrt({to}) ELSE sqrt({held}) END"


CIRCLE = f"""WITH {LAGS},
ab AS (SELECT *, {', '.join(f'{c}2-{c}3 AS a{c}, {c}1-{c}3 AS r{c}' for c in 'xyz')} FROM h WHERE k >= 3),
m AS (SELECT *, {_named(_m, 'm{}')} FROM ab),
o AS (SELECT *, {', '.join(f"({_ma[c]}*{_dot('r{}', 'r{}')}+{_bm[c]}*{_dot('a{}', 'a{}')})/nullif(2*{_dot('m{}', 'm{}')}, 0) AS o{c}" for c in 'xyz')} FROM m),
d AS (SELECT *, {', '.join(f'{c}3-({c}3+o{c}) AS d{c}, {c}2-({c}3+o{c}) AS e{c}, {c}1-({c}3+o{c}) AS f{c}' for c in 'xyz')} FROM o),
g AS (SELECT *, {_signed('d{}', 'e{}')} AS angle1, {_signed('e{}', 'f{}')} AS angle2,
      {', '.join(f"({v})/nullif(sqrt({_dot('m{}', 'm{}')}), 0) AS g{c}" for c, v in _cross('m{}', 'f{}').items())} FROM d),
v AS (SELECT *, coalesce({_dot('d{}', 'd{}')} <= 250000 AND abs(angle1+angle2) <= pi()/2, false) AS on_circle FROM g),
e AS (SELECT track_id, step, k, on_circle, {', '.join(f'{_circle_error(*w)} AS {n}' for n, w in shape.CIRCULAR.items())} FROM v)"""


def _tangent(c):
    near = {at: "+".join(f"({w})*" + (f"lead({c}, {j - at}) OVER w" if j >= at else f"lag({c}, {at - j}) OVER w") for j, w in enumerate(ws)) for at, ws in shape.TANGENT.items()}
    cases = " ".join(f"WHEN i = {i} THEN {near[at]}" for i, at in ((1, 0), (2, 1))) + f" WHEN n = i THEN {near[4]} WHEN n - i = 1 THEN {near[3]} ELSE {near[2]}"
    return f"round((CASE WHEN n < 5 THEN NULL {cases} END) / 12, 6) + 0.0 AS t{c}"


_axes = ("u{}", "w{}", "r{}")
SQL = {
    "rotation_errors": f"{ROT} SELECT {KEYS}, {_rounded(['still', 'vel', 'damped', 'screw', 'turn'])} FROM e",
    "rotation_scores": f"""{ROT}, l2 AS ({' UNION ALL '.join(f"SELECT step, '{m}' AS model, {m} AS err FROM e" for m in ('still', 'vel', 'damped'))})
SELECT step, model, count(*) AS n, round(avg(CAST(err <= radians(2) AS INT)), 6) AS score, round(avg(err), 6) AS mean_err FROM l2 GROUP BY ALL""",
    "rotation_scale_sweep": f"""{ROT}, g AS (SELECT step, turn, lag(turn) OVER w AS last FROM e {W})
SELECT step, scale, round(avg(abs(turn-scale*last)), 6) AS linear, round(avg(abs(turn-scale*(last/pow(1+pow(abs(last/(2*pi())), 0.75), 1/0.75e0)))), 6) AS saturated
FROM g, (SELECT unnest([{', '.join(f'{s}e0' for s in SCALES)}]) AS scale) WHERE last IS NOT NULL GROUP BY ALL""",
    "circle_errors": f"{CIRCLE} SELECT {KEYS}, on_circle, {_rounded(shape.CIRCULAR)} FROM e",
    "circle_shares": f"""{CIRCLE} SELECT step, count(*) AS n, count(*) FILTER (on_circle) AS n_circle, round(avg(CIRC_VEL1), 6) AS mean_err FROM e GROUP BY 1""",
    "tangents": f"""WITH {STEPS}, c AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY track_id, step) AS n FROM st {W})
SELECT {KEYS}, {', '.join(map(_tangent, 'xyz'))} FROM c {W}""",
    "even_lengths": f"""WITH {POSES},
s AS (SELECT track_id, frame, x, y, z, {', '.join(f'lead({c}) OVER w - {c} AS s{c}' for c in 'xyz')} FROM p WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
n AS (SELECT *, sqrt({_dot('s{}', 's{}')}) AS len FROM s WHERE sx IS NOT NULL),
c AS (SELECT *, sum(len) OVER (PARTITION BY track_id ORDER BY frame) AS upto, sum(len) OVER (PARTITION BY track_id) / 10 AS each FROM n),
f AS (SELECT *, CAST(i AS INT) AS i2 FROM c, range(0, 10) r(i) WHERE len > 0 AND i*each >= upto-len-1e-9 AND i*each < upto-1e-9)
SELECT track_id, i2 AS i, {', '.join(f'round({c}+(i2*each-(upto-len))/len*s{c}, 6) + 0.0 AS {c}' for c in 'xyz')} FROM f""",
    "local_motion": f"""WITH {LAGS},
m AS (SELECT *, {', '.join(f'{c}1-{c}2 AS v{c}, {c}1-2*{c}2+{c}3 AS a{c}, {c}1-3*{c}2+3*{c}3-{c}4 AS j{c}, {c}-{c}1 AS n{c}' for c in 'xyz')} FROM h WHERE k >= 4),
u AS (SELECT *, {', '.join(f"v{c}/nullif(sqrt({_dot('v{}', 'v{}')}), 0) AS u{c}" for c in 'xyz')} FROM m),
c AS (SELECT *, {', '.join(f"a{c}-u{c}*{_dot('a{}', 'u{}')} AS c{c}" for c in 'xyz')} FROM u),
w AS (SELECT *, {', '.join(f"c{c}/nullif(sqrt({_dot('c{}', 'c{}')}), 0) AS w{c}" for c in 'xyz')} FROM c),
b AS (SELECT *, {_named(_cross('u{}', 'w{}'), 'r{}')} FROM w),
r AS (SELECT track_id, step, k, sqrt({_dot('v{}', 'v{}')}) AS speed, {_dot('a{}', 'u{}')} AS acc_along, {_dot('a{}', 'w{}')} AS acc_across,
      {', '.join(f"{_dot('j{}', e)} AS jerk{i}, {_dot('n{}', e)} AS next{i}" for i, e in enumerate(_axes))} FROM b)
SELECT {KEYS}, {_rounded(LOCAL_MOTION)} FROM r""",
    "sweep_metrics": f"""{_errors(ALL)}, a AS (SELECT track_id, step, model, avg(CAST(err < 20 AS INT)) AS a, avg(CAST(err < 50 AS INT)) AS b, avg(err) AS m FROM l GROUP BY ALL)
SELECT step, model, round(avg(a), 6) AS under_20, round(avg(b), 6) AS under_50, round(avg(m), 6) AS mean_err FROM a GROUP BY ALL""",
    "ordered_motion": f"""WITH {LAGS},
o1 AS (SELECT track_id, step, k, {', '.join(f'{c}1-3*{c}2+3*{c}3-{c}4 AS f{c}, {c}1-{c}2 AS s{c}, {c}1-2*{c}2+{c}3 AS t{c}, {c}-{c}1 AS n{c}' for c in 'xyz')} FROM h WHERE k >= 4),
o2 AS (SELECT *, {', '.join(f'f{c}/nullif(sqrt(fx*fx+fy*fy+fz*fz),0) AS a{c}' for c in 'xyz')} FROM o1),
o3 AS (SELECT *, {', '.join(f's{c}-a{c}*(sx*ax+sy*ay+sz*az) AS c{c}' for c in 'xyz')} FROM o2),
o4 AS (SELECT *, {', '.join(f'c{c}/nullif(sqrt(cx*cx+cy*cy+cz*cz),0) AS w{c}' for c in 'xyz')} FROM o3),
o5 AS (SELECT *, ay*wz-az*wy AS ex, az*wx-ax*wz AS ey, ax*wy-ay*wx AS ez FROM o4)
SELECT track_id, step, k, round(sqrt(fx*fx+fy*fy+fz*fz), 6) AS size, round(sx*ax+sy*ay+sz*az, 6)+0.0 AS along, round(sx*wx+sy*wy+sz*wz, 6)+0.0 AS across,
{', '.join(f'round({v}x*{a}x+{v}y*{a}y+{v}z*{a}z, 6)+0.0 AS {n}{i}' for v, n in (('t', 'third'), ('n', 'next')) for i, a in enumerate('awe'))},
{', '.join(f'CASE WHEN wx IS NOT NULL THEN round({a}{c}, 6)+0.0 END AS m{3 * i + j}' for i, a in enumerate('awe') for j, c in enumerate('xyz'))} FROM o5""",
    "chosen_model_errors": f"""{_errors(FIVE)},
b AS (SELECT track_id, step, k, arg_min(ordinal, (err, ordinal)) AS best FROM l GROUP BY ALL),
c AS (SELECT *, coalesce(lag(best) OVER w, 0) AS last FROM b {W}),
a AS (SELECT step, err, 'quadratic' AS way FROM l WHERE model = 'ACC_DEG2'
      UNION ALL SELECT step, err, 'causal' FROM l JOIN c USING (track_id, step, k) WHERE ordinal = last
      UNION ALL SELECT step, err, 'best' FROM l JOIN c USING (track_id, step, k) WHERE ordinal = best)
SELECT step, way, count(*) AS n, round(avg(err), 6) AS mean_err FROM a GROUP BY ALL""",
    "unusual_frames": f"""WITH {STEPS},
v AS (SELECT track_id, step, k, ((floor(x) % 7) - 3) * 0.2e0 AS vx, ((y % 5) - 2) * 0.2e0 AS vy, ((z % 3) - 1) * 0.2e0 AS vz FROM st),
d AS (SELECT {KEYS}, {'+'.join(f'v{c} * lag(v{c}) OVER w' for c in 'xyz')} AS dot FROM v {W})
SELECT {KEYS}, round(dot, 6) + 0.0 AS dot FROM d WHERE dot <= 0""",
    "last_direction": f"""WITH {STEPS},
c AS (SELECT {KEYS}, {', '.join(f'floor({c}/50) - lag(floor({c}/50)) OVER w AS {c}' for c in 'xy')} FROM st {W}),
u AS (SELECT {KEYS}, {', '.join(f'last_value({c}/nullif(sqrt(x*x+y*y), 0) IGNORE NULLS) OVER (PARTITION BY track_id, step ORDER BY k) AS u{c}' for c in 'xy')} FROM c)
SELECT {KEYS}, {_rounded(['ux', 'uy'])} FROM u""",
    "gaussian_divergence": f"""{LOCAL},
g4 AS (SELECT step, frame_kind, {', '.join(f'avg(e{c}) AS m{c}' for c in 'xyz')}, {', '.join(f'covar_samp(e{a}, e{b}) AS c{a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))}
       FROM loc WHERE ex IS NOT NULL AND ey IS NOT NULL AND ez IS NOT NULL GROUP BY ALL),
wo AS (SELECT step, {', '.join(f'{c} AS w{c}' for c in ('mx', 'my', 'mz', 'cxx', 'cxy', 'cxz', 'cyy', 'cyz', 'czz'))} FROM g4 WHERE frame_kind = 'world')
SELECT step, round({DIVERGENCE}, 5) AS divergence FROM g4 JOIN wo USING (step) WHERE frame_kind = 'velocity'""",
    "tree_root_split": f"""{_errors(FIVE).split(',\ne AS')[0]},
f AS (SELECT step, sqrt({_dot('v{}', 'v{}').replace('vx', '(x1-x2)').replace('vy', '(y1-y2)').replace('vz', '(z1-z2)')})/step AS speed,
      sqrt({'+'.join(f'({c}1-2*{c}2+{c}3)*({c}1-2*{c}2+{c}3)' for c in 'xyz')})/(step*step) AS acc,
      acos(greatest(-1, least(1, ({'+'.join(f'({c}2-{c}3)*({c}1-{c}2)' for c in 'xyz')})/nullif({_norm(f'{c}2-{c}3' for c in 'xyz')}*{_norm(f'{c}1-{c}2' for c in 'xyz')}, 0)))) AS turn,
      {', '.join(f'{_err(m)} AS {m}' for m in FIVE)} FROM h WHERE k >= 3),
ends AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in TREE)} FROM f),
b AS ({' UNION ALL '.join(f"SELECT step, {i} AS place, '{c}' AS feature, coalesce(least(31, CAST(floor(({c}-lo_{c})/(hi_{c}-lo_{c})*32) AS INT)), -1) AS bin, {', '.join(FIVE)} FROM f, ends" for i, c in enumerate(TREE))}),
s AS (SELECT step, place, feature, bin, {', '.join(f'sum({m}) AS {m}' for m in FIVE)} FROM b GROUP BY ALL),
c AS (SELECT step, place, feature, bin, max(bin) OVER (PARTITION BY step, place) AS final,
      {', '.join(f'sum({m}) OVER (PARTITION BY step, place ORDER BY bin) AS l_{m}, sum({m}) OVER (PARTITION BY step, place) AS t_{m}' for m in FIVE)} FROM s),
o AS (SELECT step, feature, bin, place, least({', '.join(f'l_{m}' for m in FIVE)}) AS l, least({', '.join(f't_{m}-l_{m}' for m in FIVE)}) AS r, least({', '.join(f't_{m}' for m in FIVE)}) AS whole,
      CASE {' '.join(f"WHEN l_{m} = least({', '.join(f'l_{x}' for x in FIVE)}) THEN '{m}'" for m in FIVE)} END AS left_model,
      CASE {' '.join(f"WHEN t_{m}-l_{m} = least({', '.join(f't_{x}-l_{x}' for x in FIVE)}) THEN '{m}'" for m in FIVE)} END AS right_model FROM c WHERE bin < final),
p2 AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY round(l + r, 6), place, bin) AS i FROM o)
SELECT step, feature, CAST(bin AS BIGINT) AS bin, round(l + r, 3) AS cost, round(whole, 3) AS whole, left_model, right_model FROM p2 WHERE i = 1""",
}
