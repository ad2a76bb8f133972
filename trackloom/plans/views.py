"""Queries on views of turning objects by turning cameras, and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joint
from .features import WIDE, turned_sql
from .motion import _turned
from .sql import KEYS


def camera_object_errors(spark, d):
    """The angle off of each next orientation, if camera and object both turn evenly, and what the camera's turn leaves of the last turn."""
    return joint.errors(_turned(spark, d, WIDE)).selectExpr(*KEYS.split(", "), "round(residual, 4) + 0e0 AS residual", "round(err, 4) + 0e0 AS err")


def camera_object_tracks(spark, d):
    """Mean error by track and step, and how many of its predictions are within a tenth of a radian."""
    e = joint.errors(_turned(spark, d, WIDE))
    return e.groupBy("track_id", "step").agg(F.count("*").alias("n"), F.round(F.avg("err"), 4).alias("mean_err"), F.count_if(F.col("err") < 0.1).alias("near"))


QUERIES = {f.__name__: f for f in (camera_object_errors, camera_object_tracks)}


def _product(name: str, a: str, b: str, back_a: bool = False, back_b: bool = False) -> str:
    """Columns <name>w .. of a times b, quaternions by prefix; ``back`` conjugates."""
    aw, ax, ay, az = (f"{a}{c}" if c == "w" or not back_a else f"(-{a}{c})" for c in "wxyz")
    ew, ex, ey, ez = (f"{b}{c}" if c == "w" or not back_b else f"(-{b}{c})" for c in "wxyz")
    parts = {"w": f"{aw}*{ew}-{ax}*{ex}-{ay}*{ey}-{az}*{ez}", "x": f"{aw}*{ex}+{ax}*{ew}+{ay}*{ez}-{az}*{ey}", "y": f"{aw}*{ey}-{ax}*{ez}+{ay}*{ew}+{az}*{ex}", "z": f"{aw}*{ez}+{ax}*{ey}-{ay}*{ex}+{az}*{ew}"}
    return ", ".join(f"{e} AS {name}{c}" for c, e in parts.items())


def _three(name: str, e: str) -> str:
    return ", ".join(f"{e.replace('@', c)} AS {name}{c}" for c in "xyz")


def _cross(name: str, a: str, b: str) -> str:
    return ", ".join(f"{a}{p}*{b}{q}-{a}{q}*{b}{p} AS {name}{c}" for c, p, q in ("xyz", "yzx", "zxy"))


def _inner(a: str, b: str) -> str:
    return "(" + "+".join(f"{a}{c}*{b}{c}" for c in "xyz") + ")"


_errors = f"""{turned_sql(WIDE)},
r1 AS (SELECT *, {', '.join(f'lag(q{c}) OVER w AS l{c}, lead(q{c}) OVER w AS t{c}' for c in 'wxyz')} FROM q WINDOW w AS (PARTITION BY track_id, step ORDER BY k)),
r2 AS (SELECT *, {_product('d', 'q', 'l', back_b=True)} FROM r1),
r3 AS (SELECT *, {', '.join(f'lag(d{c}) OVER w AS h{c}' for c in 'wxyz')}, sqrt({_inner('d', 'd')}) AS ds FROM r2 WINDOW w AS (PARTITION BY track_id, step ORDER BY k)),
r4 AS (SELECT *, {_product('g', 'd', 'h')}, {_product('v', 'd', 'q')} FROM r3),
r5 AS (SELECT *, sqrt({_inner('g', 'g')}) AS gs FROM r4),
r6 AS (SELECT *, {', '.join(f"coalesce(last_value(CASE WHEN {s} > 0 THEN {a}{c} / {s} END IGNORE NULLS) OVER w, {1 if c == 'x' else 0}) AS {n}{c}" for n, a, s in (('n', 'd', 'ds'), ('m', 'g', 'gs')) for c in 'xyz')}
  FROM r5 WINDOW w AS (PARTITION BY track_id, step ORDER BY k ROWS UNBOUNDED PRECEDING)),
r7 AS (SELECT *, {_cross('c', 'n', 'm')} FROM r6),
r8 AS (SELECT *, sqrt({_inner('c', 'c')}) AS cs FROM r7),
r9 AS (SELECT *, {_three('f', 'CASE WHEN cs > 0 THEN c@ / cs ELSE 0 END')} FROM r8),
s1 AS (SELECT *, {', '.join('+'.join(f'{a}{c}*lag({a}{c}) OVER w' for c in 'xyz') + f' < 0 AS {a}o' for a in 'nf')} FROM r9 WINDOW w AS (PARTITION BY track_id, step ORDER BY k)),
s2 AS (SELECT *, {', '.join(f'CASE WHEN count(*) FILTER ({a}o) OVER w % 2 = 1 THEN -1 ELSE 1 END AS {a}s' for a in 'nf')} FROM s1 WINDOW w AS (PARTITION BY track_id, step ORDER BY k ROWS UNBOUNDED PRECEDING)),
s3 AS (SELECT *, {_three('to', 'ns * n@')}, {_three('pl', 'fs * f@')} FROM s2),
s4 AS (SELECT *, {_three('fr', 'lag(to@) OVER w')}, {_three('pp', 'lag(pl@) OVER w')}, lag(cs) OVER w AS pcs FROM s3 WINDOW w AS (PARTITION BY track_id, step ORDER BY k)),
s5 AS (SELECT *, {_three('mv', '(to@ - fr@)')}, {_three('ti', 'CASE WHEN cs > 0 AND pcs > 0 THEN pl@ - pp@ ELSE 0 END')} FROM s4),
s6 AS (SELECT *, {_cross('po', 'mv', 'ti')}, {_cross('le', 'to', 'fr')} FROM s5),
s7 AS (SELECT *, {_inner('po', 'po')} AS ps, sqrt({_inner('le', 'le')}) AS ls FROM s6),
s8 AS (SELECT *, k >= 3 AND ps > 1e-5 AS known, {_three('ax', 'CASE WHEN k >= 3 AND ps > 1e-5 THEN po@ / sqrt(ps) WHEN ls >= 1e-5 THEN le@ / ls ELSE le@ END')} FROM s7),
s9 AS (SELECT *, {_three('ta', f"to@ - {_inner('to', 'ax')} * ax@")}, {_three('fa', f"fr@ - {_inner('fr', 'ax')} * ax@")} FROM s8),
u1 AS (SELECT *, acos(greatest(-1, least(1, CASE WHEN known THEN {_inner('ta', 'fa')} / nullif(sqrt({_inner('ta', 'ta')}) * sqrt({_inner('fa', 'fa')}), 0) ELSE {_inner('to', 'fr')} END))) *
  CASE WHEN known AND {_inner('le', 'ax')} < 0 THEN -1 ELSE 1 END AS a FROM s9),
u2 AS (SELECT *, cos(a / 2) AS kw, {_three('k', 'ax@ * sin(a / 2)')} FROM u1),
u3 AS (SELECT *, {_product('aa', 'k', 'd')}, {_product('bb', 'k', 'q')}, {_product('cc', 'k', 'q', back_a=True)} FROM u2),
u4 AS (SELECT *, {_product('dd', 'aa', 'k', back_b=True)}, {_product('mm', 'l', 'bb', back_a=True)} FROM u3),
u5 AS (SELECT *, {_product('jj', 'cc', 'mm')}, 2 * acos(least(1, abs({'+'.join(f'dd{c}*h{c}' for c in 'wxyz')}))) AS left_ FROM u4),
er AS (SELECT track_id, step, k, CASE WHEN k >= 2 THEN left_ END AS residual,
  2 * acos(least(1, abs(CASE WHEN k >= 2 AND jjw IS NOT NULL AND left_ <= pi() THEN {'+'.join(f't{c}*jj{c}' for c in 'wxyz')} ELSE {'+'.join(f't{c}*v{c}' for c in 'wxyz')} END))) AS err
  FROM u5 WHERE k >= 1 AND tw IS NOT NULL)"""
SQL = {
    "camera_object_errors": f"{_errors} SELECT {KEYS}, round(residual, 4) + 0e0 AS residual, round(err, 4) + 0e0 AS err FROM er",
    "camera_object_tracks": f"{_errors} SELECT track_id, step, count(*) AS n, round(avg(err), 4) AS mean_err, count(*) FILTER (err < 0.1) AS near FROM er GROUP BY ALL",
}
