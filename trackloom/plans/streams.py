"""Queries on streams, replayed from the tables, and the same results in SQL over all rows at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import poses as src
from ..sources.store import scratch
from ..streaming.online import MODELS, replayed
from .sql import LAGS, _err


def online_replay(spark, d):
    """Errors of four models and of the last winner, as poses arrive in four parts."""
    found = replayed(src.event_poses(spark, d), scratch(spark))
    return found.select("track_id", "frame", *(F.round(c, 5).alias(c) for c in (*MODELS, "switched")), "winner", "late")


QUERIES = {"online_replay": online_replay}

_names = dict(zip(MODELS, ("STATIC", "VEL_DEG1", "ACC_DEG2", "JERK"), strict=True))
_first = "CASE " + " ".join(f"WHEN {m} = least({', '.join(MODELS)}) THEN '{m}'" for m in MODELS) + " END"
SQL = {
    "online_replay": f"""WITH {LAGS},
e AS (SELECT track_id, k, {', '.join(f'{_err(f)} AS {m}' for m, f in _names.items())} FROM h WHERE step = 1 AND k > 0),
w AS (SELECT *, {_first} AS winner FROM e),
l AS (SELECT *, lag(winner, 1, 'static') OVER (PARTITION BY track_id ORDER BY k) AS last FROM w)
SELECT track_id, k AS frame, {', '.join(f'round({m}, 5) AS {m}' for m in MODELS)}, winner, CAST(0 AS BIGINT) AS late,
  round(CASE last {' '.join(f"WHEN '{m}' THEN {m}" for m in MODELS)} END, 5) AS switched FROM l"""
}
