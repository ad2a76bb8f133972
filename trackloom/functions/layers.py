"""Tables as layers of named SQL expressions; a layer may use the names of those before it.

In expressions @ stands for the axes x, y, z. A layer is a projection: Spark computes each name once, as a name that is used
more than once is not written out again, and windows over a track share one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

Layer = dict[str, str]
Quat = dict[str, str]

ORDER = "(PARTITION BY track_id, step ORDER BY k)"
UPTO = "(PARTITION BY track_id, step ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def each(name: str, expression: str) -> Layer:
    return {name.replace("@", c): expression.replace("@", c) for c in "xyz"}


def dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a.replace('@', c)} * {b.replace('@', c)}" for c in "xyz") + ")"


def norm(a: str) -> str:
    return f"sqrt({dot(a, a)})"


def cross(name: str, a: str, b: str) -> Layer:
    turn = (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))
    return {name.replace("@", c): f"({a.replace('@', p)} * {b.replace('@', q)} - {a.replace('@', q)} * {b.replace('@', p)})" for c, p, q in turn}


def ratio(a: str, b: str) -> str:
    """Null where the divisor is 0."""
    return f"({a}) / nullif({b}, 0)"


def unit(name: str, a: str, size: str) -> Layer:
    return each(name, f"{a} / nullif({size}, 0)")


def parallel(name: str, a: str, b: str) -> Layer:
    """The part of a along b; null where b is zero."""
    return each(name, f"{b} * {dot(a, b)} / nullif({dot(b, b)}, 0)")


def reflected(name: str, a: str, b: str) -> Layer:
    """a mirrored at the line along b."""
    return each(name, f"(2 * {b} * {dot(a, b)} / nullif({dot(b, b)}, 0) - {a})")


def roots(a: str, b: str, c: str) -> tuple[str, str]:
    """The smaller and the larger root of a quadratic with a > 0; null if it has none."""
    square = f"({b} * {b} - 4 * {a} * {c})"
    return tuple(f"CASE WHEN {square} >= 0 THEN (-{b} {sign} sqrt(abs({square}))) / nullif(2 * {a}, 0) END" for sign in "-+")


def arc(cosine: str) -> str:
    """The angle of a column that holds a cosine; null of null."""
    return f"CASE WHEN {cosine} >= 1 THEN 0e0 WHEN {cosine} <= -1 THEN pi() ELSE acos({cosine}) END"


def lags(columns: list[str], n: int) -> Layer:
    return {f"{c}{i}": f"lag({c}, {i}) OVER {ORDER}" for c in columns for i in range(1, n + 1)}


def quat(pattern: str) -> Quat:
    return {c: pattern.replace("@", c) for c in "wxyz"}


def conjugate(a: Quat) -> Quat:
    return {c: a[c] if c == "w" else f"(-{a[c]})" for c in "wxyz"}


def times(name: str, a: Quat, b: Quat) -> Layer:
    w, x, y, z = (a[c] for c in "wxyz")
    e, f, g, h = (b[c] for c in "wxyz")
    out = {
        "w": f"({w} * {e} - {x} * {f} - {y} * {g} - {z} * {h})",
        "x": f"({w} * {f} + {x} * {e} + {y} * {h} - {z} * {g})",
        "y": f"({w} * {g} - {x} * {h} + {y} * {e} + {z} * {f})",
        "z": f"({w} * {h} + {x} * {g} - {y} * {f} + {z} * {e})",
    }
    return {name.replace("@", c): v for c, v in out.items()}


def dot4(a: Quat, b: Quat) -> str:
    return "(" + " + ".join(f"{a[c]} * {b[c]}" for c in "wxyz") + ")"


def each4(name: str, expression: str) -> Layer:
    return {name.replace("@", c): expression.replace("@", c) for c in "wxyz"}


def matrix(name: str, q: str) -> Layer:
    """The nine entries of a quaternion's rotation matrix, <name>00 to <name>22."""
    w, x, y, z = (q.replace("@", c) for c in "wxyz")
    entries = {
        "00": f"1 - 2 * ({y} * {y} + {z} * {z})", "01": f"2 * ({x} * {y} - {w} * {z})", "02": f"2 * ({x} * {z} + {w} * {y})",
        "10": f"2 * ({x} * {y} + {w} * {z})", "11": f"1 - 2 * ({x} * {x} + {z} * {z})", "12": f"2 * ({y} * {z} - {w} * {x})",
        "20": f"2 * ({x} * {z} - {w} * {y})", "21": f"2 * ({y} * {z} + {w} * {x})", "22": f"1 - 2 * ({x} * {x} + {y} * {y})",
    }
    return {f"{name}{k}": v for k, v in entries.items()}


#: The largest method that the JVM compiles, in bytes. Layers make longer ones, which it interprets for each row.
COMPILED = 8000


def apply(rows: DataFrame, layers: list[Layer]) -> DataFrame:
    """``rows`` with the layers' names. For the session, a stage whose code would be a method beyond ``COMPILED`` is made of smaller ones, as Spark's documentation advises."""
    rows.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED)
    for layer in layers:
        rows = rows.selectExpr("*", *(f"{e} AS {n}" for n, e in layer.items()))
    return rows
