"""Queries on features, orientation predictors and rotations of tracks, and the same results in SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.layers import Layer, apply, arc, dot, each, norm, parallel, reflected, roots
from ..operators import features as ft
from ..operators import orientation as ot
from ..operators import predict as pr
from ..sources import poses as src
from .motion import _turned
from .sql import KEYS, LAGS, STEPS

#: The axis-angle vectors of these queries are as many times as long, so that turns come near a half turn.
WIDE = 4


def significant(name: str, value: str | None = None) -> str:
    """Rounded so that the last bits of either engine's functions don't show."""
    v = value or name
    return (
        f"CASE WHEN abs({v}) < 10 THEN round({v}, 5) WHEN abs({v}) < 1e3 THEN round({v}, 3) WHEN abs({v}) < 1e5 THEN round({v}, 1) ELSE round({v} / 1e4, 1) END + 0e0 AS {name}"
    )


def scalar_features(spark, d):
    return ft.scalar_features(_turned(spark, d)).selectExpr(*KEYS.split(", "), *(significant(n) for n in ft.SCALARS))


AXIS_MEANS = ["count(dot) AS n", "round(avg(dot), 3) + 0e0 AS mean_dot", "round(avg(abs(dot)), 3) AS mean_size", "round(avg(angle), 4) AS mean_angle", "round(avg(least(angle, pi() - angle)), 4) AS mean_acute"]


def axis_features(spark, d):
    """Means of the features of a vector along an axis, by step."""
    rows = ft.axis_features(_turned(spark, d))
    return rows.groupBy("step", "vector", "axis", "shifted").agg(*map(F.expr, AXIS_MEANS))


def orientation_errors(spark, d):
    e = ot.orientation_errors(_turned(spark, d, WIDE))
    return e.selectExpr(*KEYS.split(", "), *(f"round({n}, 5) + 0e0 AS {n}" for n in ot.PREDICTED))


def orientation_ranking(spark, d):
    """Mean angle and share within two degrees of every orientation predictor."""
    long = pr.long_errors(ot.orientation_errors(_turned(spark, d, WIDE)), list(ot.PREDICTED))
    near = F.avg((F.col("err") <= F.radians(F.lit(2.0))).cast("int"))
    return long.groupBy("step", "model").agg(F.count("err").alias("n"), F.round(near, 5).alias("score"), F.round(F.avg("err"), 5).alias("mean_err"))


def unwrapped_rotations(spark, d):
    rows = ot.unwrapped(ft.base(_turned(spark, d, WIDE)))
    return rows.selectExpr(*KEYS.split(", "), *(f"round(r{c}, 5) + 0e0 AS r{c}" for c in "xyz"))


def aligned_accelerations(spark, d):
    """Accelerations with axes turned to the side of the one before, their sign on that axis, and how often it turned."""
    rows = ot.aligned(ft.base(_turned(spark, d)))
    return rows.selectExpr(*KEYS.split(", "), "round(signed, 5) + 0e0 AS signed", "flips")


def orientation_sweep_metrics(spark, d):
    """Shares of angles under two and under five degrees and the mean, by track, then over tracks."""
    e = pr.long_errors(ot.orientation_errors(_turned(spark, d, WIDE)), list(ot.PREDICTED))
    share = lambda t: F.avg((F.col("err") < F.radians(F.lit(float(t)))).cast("int"))
    by = e.groupBy("track_id", "step", "model").agg(share(2).alias("a"), share(5).alias("b"), F.avg("err").alias("m"))
    return by.groupBy("step", "model").agg(F.round(F.avg("a"), 5).alias("under_2"), F.round(F.avg("b"), 5).alias("under_5"), F.round(F.avg("m"), 5).alias("mean_angle"))


def motion_parts(spark, d):
    """Of the last two moves: the parts along and across, the mirrored move, the acute angle, and when the motion comes within 100 of where it was, if it goes on."""
    rows = apply(pr.with_history(pr.down_sampled(src.event_poses(spark, d)), 3).where("k >= 3"), PARTS)
    return rows.selectExpr(*KEYS.split(", "), *(significant(n) for n in PART_NAMES))


PARTS = [
    each("v@", "(@1 - @2)") | each("u@", "(@2 - @3)"),
    parallel("along@", "u@", "v@") | reflected("mirror@", "u@", "v@") | {"uu": dot("u@", "u@"), "vv": dot("v@", "v@"), "uv": dot("u@", "v@")},
    each("across@", "(u@ - along@)") | {"acute_cos": "abs(uv) / nullif(sqrt(uu) * sqrt(vv), 0)", "reach": "uu - 10000"},
    {"along_size": norm("along@"), "across_size": norm("across@"), "acute": arc("acute_cos")} | dict(zip(("enters", "leaves"), roots("vv", "(2 * uv)", "reach"))),
]
PART_NAMES = ["along_size", "across_size", "mirrorx", "mirrory", "mirrorz", "acute", "enters", "leaves"]

QUERIES = {f.__name__: f for f in (scalar_features, axis_features, orientation_errors, orientation_ranking, unwrapped_rotations, aligned_accelerations, orientation_sweep_metrics, motion_parts)}


def ctes(layers: list[Layer], first: str, name: str) -> str:
    """Each layer as a common table expression over the one before, the last called ``name``."""
    out = []
    for i, layer in enumerate(layers):
        to = name if i == len(layers) - 1 else f"{name}_{i}"
        columns = ", ".join(f"{re.sub(r'\brint\((\w+)\)', r'round_even(\1, 0)', e)} AS {n}" for n, e in layer.items())
        out.append(f"{to} AS (SELECT *, {columns} FROM {first})")
        first = to
    return ",\n".join(out)


def turned_sql(scale: int = 1) -> str:
    vectors = ", ".join(f"(({e}) * 0.2e0) * {scale} AS v{c}" for c, e in (("x", "(floor(x) % 7) - 3"), ("y", "(y % 5) - 2"), ("z", "(z % 3) - 1")))
    return f"""WITH {STEPS},
v AS (SELECT *, {vectors} FROM st),
vt AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS t FROM v),
q AS (SELECT track_id, step, k, x, y, z, cos(t / 2) AS qw, {', '.join(f'v{c} * CASE WHEN t = 0 THEN 0.5 ELSE sin(t / 2) / t END AS q{c}' for c in 'xyz')} FROM vt)"""


def _list(name: str, columns: dict[str, str]) -> str:
    return "unnest([" + ", ".join(f"{{'{name}': '{n}', " + ", ".join(f"'{name}_{c}': {e.replace('@', c)}" for c in "xyz") + "}" for n, e in columns.items()) + "], recursive := true)"


_axes = {**ft.RELATIVE, **{f"{n} shifted": f"was_{a}" for n, a in ft.RELATIVE.items()}}
_axis_columns = ", ".join(e.replace("@", c) for e in _axes.values() for c in "xyz")
SQL = {
    "scalar_features": f"""{turned_sql()},
{ctes(ft.layers(), 'q', 'f')},
s2 AS (SELECT {KEYS}, {', '.join(f'{e} AS {n}' for n, e in ft.SCALARS.items())} FROM f WHERE k >= 4)
SELECT {KEYS}, {', '.join(significant(n) for n in ft.SCALARS)} FROM s2""",
    "axis_features": f"""{turned_sql()},
{ctes(ft.layers() + ft.error_layers(), 'q', 'f')},
a1 AS (SELECT {KEYS}, {_axis_columns}, {_list('vector', ft.VECTORS)} FROM f WHERE k >= 4),
a2 AS (SELECT {KEYS}, vector, vector_x, vector_y, vector_z, {_list('axis', _axes)} FROM a1),
a3 AS (SELECT * FROM a2 WHERE vector <> 'acc' OR axis LIKE 'vel%'),
{ctes(ft.PAIRS, 'a3', 'a4')}
SELECT step, vector, replace(axis, ' shifted', '') AS axis, axis LIKE '% shifted' AS shifted, {', '.join(AXIS_MEANS)} FROM a4 GROUP BY ALL""",
    "orientation_errors": f"""{turned_sql(WIDE)},
{ctes(ot.layers(), 'q', 'f')}
SELECT {KEYS}, {', '.join(f'round({e}, 5) + 0e0 AS {n}' for n, e in ot.PREDICTED.items())} FROM f WHERE k >= 4""",
    "orientation_ranking": f"""{turned_sql(WIDE)},
{ctes(ot.layers(), 'q', 'f')},
l AS ({' UNION ALL '.join(f"SELECT step, '{n}' AS model, {e} AS err FROM f WHERE k >= 4" for n, e in ot.PREDICTED.items())})
SELECT step, model, count(err) AS n, round(avg(CAST(err <= radians(2) AS INT)), 5) AS score, round(avg(err), 5) AS mean_err FROM l GROUP BY ALL""",
    "orientation_sweep_metrics": f"""{turned_sql(WIDE)},
{ctes(ot.layers(), 'q', 'f')},
l AS ({' UNION ALL '.join(f"SELECT track_id, step, '{n}' AS model, {e} AS err FROM f WHERE k >= 4" for n, e in ot.PREDICTED.items())}),
a AS (SELECT track_id, step, model, avg(CAST(err < radians(2) AS INT)) AS a, avg(CAST(err < radians(5) AS INT)) AS b, avg(err) AS m FROM l GROUP BY ALL)
SELECT step, model, round(avg(a), 5) AS under_2, round(avg(b), 5) AS under_5, round(avg(m), 5) AS mean_angle FROM a GROUP BY ALL""",
    "motion_parts": f"""WITH {LAGS}, h3 AS (SELECT * FROM h WHERE k >= 3), {ctes(PARTS, 'h3', 'f')}
SELECT {KEYS}, {', '.join(significant(n) for n in PART_NAMES)} FROM f""",
    "unwrapped_rotations": f"""{turned_sql(WIDE)},
{ctes(ot.unwrap_layers('q@'), 'q', 'f')}
SELECT {KEYS}, {', '.join(f'round(r{c}, 5) + 0e0 AS r{c}' for c in 'xyz')} FROM f""",
    "aligned_accelerations": f"""{turned_sql()},
{ctes(ot.ALIGN, 'q', 'f')}
SELECT {KEYS}, round(signed, 5) + 0e0 AS signed, flips FROM f WHERE k >= 3""",
}
