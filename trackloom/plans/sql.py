"""The pose-track queries' results in DuckDB's SQL."""

from __future__ import annotations

from itertools import combinations

from ..sources.poses import BODIES, MOTION_KINDS, SEQUENCES

POSES = """p AS (
  SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS x,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y, CAST(event_id % 97 AS DOUBLE) AS z
  FROM events)"""
STEPS = POSES + """,
st AS (SELECT track_id, s AS step, frame // s AS k, x, y, z FROM p, (VALUES (1), (2), (3)) v(s) WHERE frame % s = 0)"""
LAGS = STEPS + """,
h AS (SELECT *, {} FROM st WINDOW w AS (PARTITION BY track_id, step ORDER BY k))""".format(
    ", ".join(f"lag({c}, {i}) OVER w AS {c}{i}" for i in range(1, 6) for c in "xyz")
)

# What a model predicts on one axis, from its last values, longest history first.
QUAD, VEL, HOLD = "3*c1-3*c2+c3", "2*c1-c2", "c1"
FORMS = {
    "STATIC": [HOLD],
    "VEL_DEG1": [VEL, HOLD],
    "VEL_DEG2": ["2.5*c1-2*c2+0.5*c3", VEL, HOLD],
    "ACC_DEG2": [QUAD, VEL, HOLD],
    "JERK": ["4*c1-6*c2+4*c3-c4", QUAD, VEL, HOLD],
    "DEG4": ["109e0/24*c1-25e0/3*c2+31e0/4*c3-11e0/3*c4+17e0/24*c5", QUAD, VEL, HOLD],
    "SPLINE2": ["c1+(c1-c2)+5e0/6*(c1-2*c2+c3)", VEL, HOLD],
    "ACC_LERP": ["c1+0.9*((c1-c2)+(c1-2*c2+c3)/2)", VEL, HOLD],
}
V = {c: f"({c}1-{c}2)" for c in "xyz"}
A = {c: f"({c}1-2*{c}2+{c}3)" for c in "xyz"}


def _dot(a, b):
    return "(" + "+".join(f"{a[c]}*{b[c]}" for c in "xyz") + ")"


def _norm(parts):
    return "sqrt(" + "+".join(f"({q})*({q})" for q in parts) + ")"


def _err(model):
    def at(c):
        if model == "VEL_ANG":
            return f"coalesce({c}1+(0.63837237*{_dot(A, V)}/nullif({_dot(V, V)},0)+0.83709242)*{V[c]},{c}1)"
        if model == "VEL_BCS":
            moved = {c: f"({c}-{c}1)" for c in "xyz"}
            return f"coalesce({c}1+{_dot(moved, V)}/nullif({_dot(V, V)},0)*{V[c]},{c}1)"
        return "coalesce(" + ",".join(f.replace("c", c) for f in FORMS[model]) + ")"

    return _norm(f"{c}-{at(c)}" for c in "xyz")


FIVE = list(FORMS)[:5]
ALL = [*FORMS, "VEL_ANG", "VEL_BCS"]


def _errors(models):
    wide = f"e AS (SELECT track_id, step, k, {', '.join(f'{_err(m)} AS {m}' for m in models)} FROM h WHERE k > 0)"
    rows = " UNION ALL ".join(f"SELECT track_id, step, k, {i} AS ordinal, '{m}' AS model, {m} AS err FROM e" for i, m in enumerate(models))
    return f"WITH {LAGS},\n{wide},\nl AS ({rows})"


BEST = ", b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, step, k ORDER BY err, ordinal) AS i FROM l) WHERE i = 1)"
SCORES = ", s AS (SELECT track_id, step, model, count(*) AS n, avg(CAST(err <= 20 AS INT)) AS score, avg(err) AS mean_err FROM l GROUP BY ALL)"


def _list(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


KIND = "CASE " + " ".join(f"WHEN contains(seq_name, '{k}') THEN '{k}'" for k in MOTION_KINDS) + " END"
TRACKS = f"""t AS (
  SELECT track_id, body, seq, {_list(BODIES)}[body + 1] AS body_name, {_list(SEQUENCES)}[seq + 1] AS seq_name
  FROM (SELECT DISTINCT user_id AS track_id, CAST((user_id // 22) % 20 AS INT) AS body, CAST(user_id % 22 AS INT) AS seq FROM events)),
tr AS (SELECT *, {KIND} AS motion_kind, contains(seq_name, 'cam2') AS is_cam2 FROM t)"""
TURN = "acos(greatest(-1, least(1, {d} / nullif({v} * {u}, 0))))"
U = {c: f"({c}1-{c}2)" for c in "xyz"}
W = {c: f"({c}-{c}1)" for c in "xyz"}
_v, _u = _norm(W.values()), _norm(U.values())
KIN = f"""WITH {LAGS},
kin AS (
  SELECT track_id, step, k, {_v}/step AS speed, {_norm(f'{c}-2*{c}1+{c}2' for c in 'xyz')}/(step*step) AS acc,
         {_norm(f'{c}-3*{c}1+3*{c}2-{c}3' for c in 'xyz')}/(step*step*step) AS jerk,
         {TURN.format(d=_dot(U, W), v=_v, u=_u)} AS turn, {_dot(W, U)}/nullif({_dot(W, W)}, 0) AS vel_bcs_ratio
  FROM h WHERE k >= 3)"""
_lv = _norm(V.values())
_along = {c: f"({V[c]}/nullif({_lv},0))" for c in "xyz"}
ACC2 = {c: f"({V[c]}-({c}2-{c}3))" for c in "xyz"}
LOCAL = f"""WITH {LAGS},
g AS (SELECT track_id, step, k, {', '.join(f'{c}-({VEL.replace("c", c)}) AS e{c}' for c in 'xyz')},
             {', '.join(f'{_along[c]} AS u{c}' for c in 'xyz')}, {', '.join(f'{ACC2[c]} AS q{c}' for c in 'xyz')} FROM h WHERE k >= 3),
g2 AS (SELECT *, {', '.join(f'q{c}-(qx*ux+qy*uy+qz*uz)*u{c} AS o{c}' for c in 'xyz')} FROM g),
g3 AS (SELECT *, {', '.join(f'o{c}/nullif(sqrt(ox*ox+oy*oy+oz*oz),0) AS w{c}' for c in 'xyz')} FROM g2),
loc AS (
  SELECT track_id, step, k, 'world' AS frame_kind, ex, ey, ez FROM g3 UNION ALL
  SELECT track_id, step, k, 'velocity', ex*ux+ey*uy+ez*uz, ex*wx+ey*wy+ez*wz,
         ex*(uy*wz-uz*wy)+ey*(uz*wx-ux*wz)+ez*(ux*wy-uy*wx) FROM g3)"""
KEYS = "track_id, step, k"
RANK = _errors(ALL) + """, m AS (SELECT track_id, step, model, avg(err) AS a FROM l GROUP BY ALL),
mm AS (SELECT step, model, round(avg(a), 6) AS macro FROM m GROUP BY ALL),
rk AS (SELECT step, model, macro, CAST(row_number() OVER (PARTITION BY step ORDER BY macro, model) - 1 AS INT) AS place FROM mm)"""
_t = "1.959963984540054"
_series = "({z}+({z}**3+{z})/4/(n-1)+(5*{z}**5+16*{z}**3+3*{z})/96/(n-1)**2+(3*{z}**7+19*{z}**5+17*{z}**3-15*{z})/384/(n-1)**3)".format(z=_t)

SQL = {
    "tracks": f"WITH {TRACKS} SELECT * FROM tr",
    "valid_tracks": f"WITH {TRACKS} SELECT motion_kind, count(*) AS n FROM tr WHERE NOT is_cam2 GROUP BY 1",
    "down_sampling": f"WITH {STEPS} SELECT track_id, step, count(*) AS n, max(k) AS last_k, round(sum(x), 6) AS sum_x FROM st GROUP BY ALL",
    "kinematics": f"{KIN} SELECT {KEYS}, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("speed", "acc", "jerk", "turn", "vel_bcs_ratio")) + " FROM kin",
    "prediction_errors": f"{_errors(ALL)} SELECT {KEYS}, model, round(err, 6) AS err FROM l",
    "track_scores": f"{_errors(ALL)}{SCORES} SELECT track_id, step, model, n, round(score, 6) AS score, round(mean_err, 6) AS mean_err FROM s",
    "best_models": f"{_errors(FIVE)}{BEST} SELECT {KEYS}, model, round(err, 6) AS err FROM b",
    "best_model_counts": f"{_errors(FIVE)}{BEST} SELECT step, model, count(*) AS n, round(avg(err), 6) AS mean_err FROM b GROUP BY ALL",
    "previous_best_label": f"{_errors(FIVE)}{BEST} SELECT {KEYS}, CAST(lag(ordinal) OVER (PARTITION BY track_id, step ORDER BY k) AS INT) AS last_label FROM b",
    "hindsight_switch": f"{_errors(FIVE)}{BEST} SELECT step, round(avg(err), 6) AS mean_err FROM b GROUP BY 1",
    "causal_switch": f"""{_errors(FIVE)}{BEST},
c AS (SELECT {KEYS}, lag(ordinal) OVER (PARTITION BY track_id, step ORDER BY k) AS o FROM b)
SELECT step, round(avg(err), 6) AS mean_err FROM c JOIN l USING (track_id, step, k) WHERE l.ordinal = coalesce(o, 0) GROUP BY 1""",
    "macro_micro": f"""{_errors(ALL)}, m AS (SELECT track_id, step, model, avg(err) AS a, sum(err) AS s, count(*) AS n FROM l GROUP BY ALL)
SELECT step, model, round(avg(a), 6) AS macro, round(sum(s) / sum(n), 6) AS micro FROM m GROUP BY ALL""",
    "model_ranking": f"{RANK} SELECT * FROM rk",
    "best_two_models": f"{RANK} SELECT * FROM rk WHERE place < 2",
    "score_table": f"{_errors(FIVE)}{SCORES}, {TRACKS} SELECT step, motion_kind, "
    + ", ".join(f"round(avg(score) FILTER (model = '{m}'), 6) AS {m}" for m in FIVE)
    + " FROM s JOIN tr USING (track_id) WHERE NOT is_cam2 GROUP BY ALL",
    "mean_error_by_step_and_all": f"{_errors(FIVE)}{BEST} SELECT step, round(avg(err), 6) AS mean_err, count(*) AS n FROM b GROUP BY ROLLUP (step)",
    "local_errors": f"{LOCAL} SELECT {KEYS}, frame_kind, " + ", ".join(f"round(e{c}, 6) + 0.0 AS e{c}" for c in "xyz") + " FROM loc",
    "error_statistics": f"""{LOCAL}, a AS (
  SELECT step, count(*) AS n, avg(ex) AS mean_ex, avg(ey) AS mean_ey, stddev_samp(ex) AS std_ex, var_samp(ez) AS var_ez,
         covar_samp(ex, ey) AS cov_ex_ey, avg(sqrt(ex*ex+ey*ey+ez*ez)) AS mean_mag FROM loc WHERE frame_kind = 'world' GROUP BY ROLLUP (step))
SELECT step, n, round(mean_ex, 4) AS mean_ex, round(mean_ey, 4) AS mean_ey, round(std_ex, 4) AS std_ex, round(var_ez, 4) AS var_ez,
       round(cov_ex_ey, 4) AS cov_ex_ey, round(mean_mag, 4) AS mean_mag, round(mean_ex - {_series} * std_ex / sqrt(n), 4) AS low,
       round(mean_ex + {_series} * std_ex / sqrt(n), 4) AS high FROM a""",
    "bounce_sweep": f"""WITH {LAGS},
c AS (SELECT step, coalesce({_dot(V, {c: f'({c}2-{c}3)' for c in 'xyz'})}/nullif({_lv}*{_norm(f'{c}2-{c}3' for c in 'xyz')},0),1) AS cosine,
             {_err('ACC_DEG2')} AS q, {_err('VEL_DEG1')} AS v FROM h WHERE k >= 3)
SELECT step, CAST(t AS INT) AS t, round(avg(CASE WHEN floor((cosine + 1) / 2 * 20) < t THEN v ELSE q END), 6) AS mean_err
FROM c, range(0, 21) r(t) GROUP BY ALL""",
    "since_still": f"""WITH {LAGS},
f AS (SELECT {KEYS}, coalesce(sqrt((x-x1)*(x-x1)+(y-y1)*(y-y1)) < 30, false) OR k < 2 AS f FROM h)
SELECT {KEYS}, k - max(CASE WHEN f THEN k END) OVER (PARTITION BY track_id, step ORDER BY k) AS rows_since FROM f""",
    "smoothed": f"WITH {LAGS} SELECT {KEYS}, round(0.5*x+0.3*x1+0.2*x2, 6) AS smooth_x FROM h",
    "frame_gaps": """WITH d AS (SELECT DISTINCT user_id AS track_id, date_diff('day', min(CAST(ts AS DATE)) OVER (PARTITION BY user_id), CAST(ts AS DATE)) AS frame FROM events)
SELECT track_id, frame, frame - lag(frame, 1, frame) OVER (PARTITION BY track_id ORDER BY frame) AS gap FROM d""",
    "sub_sequences": f"WITH {POSES} SELECT track_id, frame // 20 AS part, count(*) AS n, round(avg(x), 6) AS mean_x FROM p GROUP BY ALL",
    "tracker_errors": f"""WITH {POSES} SELECT track_id, count(*) AS n, count(*) FILTER (frame % 3 = 1) AS n_calc,
round(avg(abs(x + 0.5 - x)) FILTER (frame % 3 = 1), 6) AS mean_diff FROM p GROUP BY 1""",
    "track_bounds": f"WITH {POSES} SELECT track_id, " + ", ".join(f"{n}({c}) AS {n}_{c}" for c in "xyz" for n in ("min", "max")) + ", count(*) AS n FROM p GROUP BY 1",
    "ratio_distribution": f"""{KIN} SELECT step, round(avg(vel_bcs_ratio), 6) AS mean, round(min(vel_bcs_ratio), 6) AS least, round(max(vel_bcs_ratio), 6) AS most,
round(stddev_pop(vel_bcs_ratio), 6) AS std, {", ".join(f"round(avg(CAST(vel_bcs_ratio < {t} AS INT)), 6) AS under_{n}" for n, t in (("0", 0), ("half", 0.5), ("1", 1)))}
FROM kin WHERE vel_bcs_ratio IS NOT NULL GROUP BY 1""",
    "error_histogram": f"""{_errors(FIVE)},
p9 AS (SELECT step, max(p) AS top FROM (SELECT step, model, quantile_cont(err, 0.9) AS p FROM l GROUP BY ALL) GROUP BY 1),
b9 AS (SELECT step, model, top, CAST(floor(err / top * 35) AS INT) AS bin, count(*) AS n FROM l JOIN p9 USING (step) WHERE err < top GROUP BY ALL)
SELECT step, model, bin, n, round(n / sum(n) OVER (PARTITION BY step, model) / (top / 35), 6) AS density FROM b9""",
    "turn_fit": f"""{KIN}, r AS (SELECT step, lag(turn, 2) OVER w AS a, lag(turn) OVER w AS b, turn AS c FROM kin WINDOW w AS (PARTITION BY track_id, step ORDER BY k)),
f AS (SELECT step, CAST(floor(a / 0.1) AS INT) AS bin, count(*) AS n, regr_slope(c, b) AS slope, regr_intercept(c, b) AS intercept
      FROM r WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2)
SELECT step, bin, n, round(slope, 4) AS slope, round(intercept, 4) AS intercept FROM f WHERE n > 1 AND abs(slope) < 2""",
    "standard_scaling": f"""{KIN}, f AS (SELECT step, avg(speed) AS m, stddev_pop(speed) AS s FROM kin WHERE track_id % 5 <> 0 GROUP BY 1)
SELECT track_id, step, k, round((speed - m) / s, 6) + 0.0 AS scaled FROM kin JOIN f USING (step)""",
    "feature_correlation": KIN + ", c AS (SELECT * FROM kin WHERE turn IS NOT NULL AND vel_bcs_ratio IS NOT NULL) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r, abs(corr({a}, {b})) > 0.7 AS collinear FROM c"
        for a, b in combinations(["speed", "acc", "jerk", "turn", "vel_bcs_ratio"], 2)
    ),
    "track_split": """WITH i AS (SELECT track_id, row_number() OVER (ORDER BY (track_id * 2654435761) % 4294967296, track_id) AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT user_id AS track_id FROM events))
SELECT track_id, CASE WHEN i <= ceil(n * 0.2) THEN 'test' WHEN i <= ceil(n * 0.2) + ceil(n * 0.15) THEN 'validation' ELSE 'train' END AS split FROM i""",
    "compare_results": f"""{_errors(FIVE)}{SCORES}, a AS (SELECT * FROM s WHERE step < 3),
b AS (SELECT track_id, step, model, avg(CAST(err <= 30 AS INT)) AS score2, avg(err) AS mean_err2 FROM l WHERE step > 1 GROUP BY ALL)
SELECT count(*) FILTER (score2 IS NULL) AS only_left, count(*) FILTER (score IS NULL) AS only_right,
       round(max(abs(score - score2)), 6) AS score_diff, round(max(abs(mean_err - mean_err2)), 6) AS err_diff FROM a FULL JOIN b USING (track_id, step, model)""",
    "short_names": f"""WITH {TRACKS} SELECT DISTINCT body_name, seq_name, CASE WHEN length(body_name) < 11 THEN body_name ELSE body_name[1:8] || '...' END AS body_short,
array_to_string(list_transform(string_split(seq_name, '_'), lambda w: w[1] || CASE WHEN w[-1:] IN ('1', '2') THEN w[-1:] ELSE '' END), '_') AS seq_short FROM tr""",
    "best_model_per_sequence": f"""{_errors(FIVE)}, q AS (SELECT step, CAST(track_id % 22 AS INT) AS seq, model, sum(err) AS s, count(*) AS n FROM l GROUP BY ALL)
SELECT step, seq, model, round(s / n, 6) AS mean_err FROM (SELECT *, row_number() OVER (PARTITION BY step, seq ORDER BY round(s, 6), model) AS i FROM q) WHERE i = 1""",
}
