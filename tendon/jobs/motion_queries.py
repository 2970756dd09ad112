"""Registered queries of the motion checks, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.functions.alignment import aligned
from tendon.jobs import profile_queries
from tendon.operators import motion
from tendon.operators.config import with_overrides
from tendon.sources import episodes as src
from tendon.sources import recordings as rec

Query = Callable[[SparkSession, str], DataFrame]


#: Joint names are read from the profiles; override files may change any threshold.
OVERRIDES = {"general": {"scale_consistency": {"enabled": True}, "tracking_residual": {"enabled": True}, "delta_detection": {"enabled": True}}}


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.tolerant(rec.profiles(spark, sf_dir))


def _cells(spark: SparkSession, sf_dir: str, keys: tuple[str, ...], **more) -> DataFrame:
    return motion.cell_metrics(src.steps(spark, sf_dir, keys), src.episodes(spark, sf_dir), _profiles(spark, sf_dir), keys, **more)


def _keys(spark: SparkSession, sf_dir: str, keys: tuple[str, ...], **more) -> DataFrame:
    return motion.whole_keys(src.steps(spark, sf_dir, keys), src.episodes(spark, sf_dir), _profiles(spark, sf_dir), keys, **more)


def _general_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.with_states(_keys(spark, sf_dir, motion.GENERAL_KEYS), motion.state_lengths(src.steps(spark, sf_dir, motion.GENERAL_KEYS), motion.GENERAL_KEYS))


def aligned_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aligned(src.steps(spark, sf_dir))
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6)
    return rows.where("s is not null").select("episode_id", "key", "t", total("a").alias("a_sum"), total("s").alias("s_sum"), total("s_next").alias("s_next_sum"))


def general_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the checks on grippers that are off by default."""
    return motion.general(_general_keys(spark, sf_dir), with_overrides(OVERRIDES))


def joint_position_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.joint_position(_keys(spark, sf_dir, ("joint_position",), medians=True))


def joint_velocity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.joint_velocity(_keys(spark, sf_dir, ("joint_velocity",), flips=True))


def jumping_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.jumping_joints(_cells(spark, sf_dir, ("joint_position",)))


def worst_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.worst_joints(_cells(spark, sf_dir, ("joint_position",), medians=True))


def skipped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.skips(_general_keys(spark, sf_dir))


def command_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.command_rate(src.steps(spark, sf_dir, motion.ARM_KEYS), src.episodes(spark, sf_dir))


def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.duplicate_pairs(src.steps(spark, sf_dir))


def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.missing_keys(src.steps(spark, sf_dir))


STATE_OF = "CASE WHEN a.key LIKE 'joint%' THEN 'joint_position' WHEN a.key LIKE 'cartesian%' THEN 'cartesian_position' WHEN a.key LIKE 'gripper%' THEN 'gripper_position' ELSE a.key END"
#: Follows CTEs of steps and episodes.
ALIGNED = f"""
  st AS (SELECT episode_id, key, t, vals, lead(vals) OVER w AS nxt, lead(vals, 2) OVER w AS nxt2 FROM steps WHERE grp = 'state' WINDOW w AS (PARTITION BY episode_id, key ORDER BY t)),
  ac AS (SELECT *, lag(vals) OVER w AS prv, lead(vals) OVER w IS NOT NULL AS more, lead(vals, 2) OVER w IS NOT NULL AS more2 FROM steps WHERE grp = 'action' WINDOW w AS (PARTITION BY episode_id, key ORDER BY t)),
  al AS (SELECT a.episode_id, a.key, a.t, a.vals AS a, a.prv AS a_prev, s.vals AS s, s.nxt AS s_next, s.nxt2 AS s_next2, more, more2, CASE WHEN isfinite(control_freq) AND control_freq > 0 THEN control_freq END AS hz
    FROM ac a LEFT JOIN st s ON s.episode_id = a.episode_id AND s.t = a.t AND s.key = {STATE_OF} LEFT JOIN episodes e ON e.episode_id = a.episode_id)"""
_LAGS = ", ".join(
    f"count(*) FILTER ({y} IS NOT NULL AND per IS NOT NULL) AS n{k}, sum(per) FILTER ({y} IS NOT NULL) AS x{k}, sum({y}) FILTER (per IS NOT NULL) AS y{k}, sum(per * per) FILTER ({y} IS NOT NULL) AS xx{k},"
    f" sum({y} * {y}) FILTER (per IS NOT NULL) AS yy{k}, sum(per * {y}) AS xy{k}, sum((per - {y}) ** 2) AS dd{k}" for k, y in ((0, "move"), (1, "move2")))
_POOLED = ", ".join(f"sum({x}{k}) FILTER (NOT ex) AS {x}{k}" for k in (0, 1) for x in ("n", "x", "y", "xx", "yy", "xy", "dd"))
_R = "CASE WHEN n{0} >= 2 AND n{0} * xx{0} - x{0} ** 2 > 1e-12 * n{0} * xx{0} AND n{0} * yy{0} - y{0} ** 2 > 1e-12 * n{0} * yy{0} THEN (n{0} * xy{0} - x{0} * y{0}) / sqrt((n{0} * xx{0} - x{0} ** 2) * (n{0} * yy{0} - y{0} ** 2)) END"
METRICS = f"""{rec.as_cte("profiles", "steps", "episodes")}{profile_queries._J}, {ALIGNED},
  am AS (SELECT al.*, CASE WHEN key LIKE 'joint%' THEN coalesce(q.an, []) ELSE [] END AS an, CASE WHEN key LIKE 'joint%' THEN coalesce(q.sn, []) ELSE [] END AS sn FROM al LEFT JOIN q USING (episode_id)
    WHERE key IN ('joint_position', 'joint_velocity', 'cartesian_position', 'cartesian_velocity', 'gripper_position', 'gripper_binary')),
  ap AS (SELECT *, CASE WHEN len(an) = len(a) AND len(sn) = len(s) AND len(list_distinct(sn)) = len(sn) AND len(list_filter(an, lambda x: NOT list_contains(sn, x))) = 0 AND len(a) > 0 THEN list_transform(an, lambda x: list_position(sn, x))
      WHEN len(a) = len(s) THEN range(1, len(a) + 1) END AS pr FROM am),
  ce0 AS (SELECT episode_id, key, t, hz, d, a[d] AS a, a_prev[d] AS a_prev, s[pr[d]] AS s, CASE WHEN more THEN s_next[pr[d]] END AS s_next, CASE WHEN more2 THEN s_next2[pr[d]] END AS s_next2, len(a) AS dim, len(s) AS s_dim, len(an) AS an, len(sn) AS sn,
      coalesce(len(an) = len(a) AND contains(lower(an[d]), 'gripper'), false) AS ex, list_max(list_transform(s, lambda v: abs(v))) AS s_max,
      d = 1 AND len(list_filter(list_zip(a, a_prev), lambda z: abs(z[1] - z[2]) > 1e-9)) > 0 AS changed,
      d = 1 AND len(s) = len(a) AND list_max(list_transform(list_zip(a, s), lambda z: abs(z[1] - z[2]))) <= 1e-6 AS copied
    FROM (SELECT *, unnest(range(1, len(a) + 1)) AS d FROM ap)),
  ce AS (SELECT *, abs(a - a_prev) AS jump, s_next - s AS move, s_next2 - s_next AS move2, a / hz AS per, sqrt(avg(a * a) OVER (PARTITION BY episode_id, key, d)) AS sc FROM ce0),
  cm AS (SELECT episode_id, key, d, max(dim) AS dim, max(s_dim) AS s_dim, max(hz) AS hz, max(an) AS an, max(sn) AS sn, bool_or(ex) AS ex, count(*) AS n, count(s) AS n_state, count(s_next) AS n_next,
      count(*) FILTER (NOT isfinite(a)) AS n_bad, count(*) FILTER (NOT isfinite(s_max)) AS n_bad_state, max(abs(a)) AS top, min(a) AS low, max(a) AS high, max(s_max) AS s_top, min(s) AS s_low, max(s) AS s_high,
      sum(a * a) FILTER (s IS NOT NULL) AS aa, sum(s * s) AS ss, sum(a * a) FILTER (s_next IS NOT NULL) AS aa_next, sum((a - s_next) ** 2) AS to_next, sum((a - move) ** 2) AS to_move, sum(s_next * s_next) AS nn,
      quantile_cont(abs(a - s_next), 0.5) AS median, arg_min(a, t) AS first, count(*) FILTER (jump > 20e0 / hz) AS n_jumps, min(t - 1) FILTER (jump > 20e0 / hz) AS first_jump, max(jump) AS top_jump,
      count(*) FILTER (abs(a) > 0.1e0 * sc AND abs(a_prev) > 0.1e0 * sc) AS pairs, count(*) FILTER (abs(a) > 0.1e0 * sc AND abs(a_prev) > 0.1e0 * sc AND sign(a) <> sign(a_prev)) AS flips,
      count(*) FILTER (changed) AS changes, count(*) FILTER (copied) AS copies, {_LAGS} FROM ce GROUP BY ALL),
  nl AS (SELECT episode_id, key, count(*) AS l_n, min(list_min(vals)) AS l_low, max(list_max(vals)) AS l_high FROM steps WHERE grp = 'state' GROUP BY ALL),
  k0 AS (SELECT episode_id, key, max(dim) AS dim, max(s_dim) AS s_dim, max(hz) AS hz, max(an) AS an, max(sn) AS sn, max(n) AS n, max(n_state) AS n_state, max(n_next) AS n_next, sum(n_bad) AS n_bad, max(n_bad_state) AS n_bad_state,
      max(top) FILTER (NOT ex) AS top, min(low) FILTER (NOT ex) AS low, max(high) FILTER (NOT ex) AS high, max(s_top) AS s_top, max(s_high - s_low) AS state_range, max(s_high - s_low) FILTER (NOT ex) AS span,
      sum(aa) FILTER (NOT ex) AS aa, sum(ss) FILTER (NOT ex) AS ss, sum(aa_next) FILTER (NOT ex) AS aa_next, sum(to_next) FILTER (NOT ex) AS to_next, sum(to_move) FILTER (NOT ex) AS to_move, sum(nn) FILTER (NOT ex) AS nn,
      max(median) FILTER (NOT ex) AS median, sum(n_jumps) FILTER (NOT ex) AS n_jumps, min(first_jump) FILTER (NOT ex) AS first_jump, max(top_jump) FILTER (NOT ex) AS top_jump, sum(flips) FILTER (NOT ex) AS flips, sum(pairs) FILTER (NOT ex) AS pairs,
      max(changes) AS changes, max(copies) AS copies, max(first) FILTER (d = 1) AS first, count(*) FILTER (ex) AS grippers, count(*) FILTER (NOT ex) AS cols, sum(n_next) FILTER (NOT ex) AS next_values, {_POOLED} FROM cm GROUP BY ALL),
  k1 AS (SELECT a.*, l_n, l_low, l_high, {_R.format(0)} AS r_0, {_R.format(1)} AS r_1, {STATE_OF} AS state_key FROM k0 a LEFT JOIN nl ON nl.episode_id = a.episode_id AND nl.key = {STATE_OF}),
  k2 AS (SELECT *, CASE WHEN n1 >= 2 * cols AND (NOT coalesce(n0 >= 2 * cols, false) OR coalesce(r_1, -2) > coalesce(r_0, -2)) THEN 1 ELSE 0 END AS lag FROM k1),
  k3 AS (SELECT *, CASE lag WHEN 1 THEN r_1 ELSE r_0 END AS r, CASE lag WHEN 1 THEN xx1 ELSE xx0 END AS xx, CASE lag WHEN 1 THEN yy1 ELSE yy0 END AS yy, CASE lag WHEN 1 THEN dd1 ELSE dd0 END AS dd FROM k2),
  k4 AS (SELECT *, CASE WHEN yy > 0 THEN sqrt(xx / yy) END AS ratio, coalesce(yy > 0 AND dd <= 1e-12 * yy, false) AS exact FROM k3),
  km AS (SELECT *, concat_ws(',', CASE WHEN exact THEN 'copies_state_motion' END, CASE WHEN ratio > 8 THEN 'too_large' END, CASE WHEN ratio < 0.25e0 THEN 'too_small' END, CASE WHEN NOT exact AND NOT coalesce(r >= 0.3e0, false) THEN 'doesnt_match_state_motion' END) AS reasons,
      CASE WHEN ratio > 0 THEN CASE WHEN abs(ln(ratio / degrees(1))) < ln(2) THEN 'deg_per_s' WHEN abs(ln(ratio * hz)) < ln(2) THEN 'per_step_delta' END END AS suspected FROM k4)"""


def told(table: str, rules: list[tuple[str, str, dict[str, str]]], key: str = "key") -> str:
    """Rules with what they tell, in the form of findings."""
    kinds = (("metric", "DOUBLE"), ("other", "DOUBLE"), ("n", "BIGINT"), ("at", "BIGINT"), ("note", "VARCHAR"))
    one = lambda f, t, x: f"round(CAST({x.get(f, 'NULL')} AS DOUBLE), 6) AS {f}" if t == "DOUBLE" else f"CAST({x.get(f, 'NULL')} AS {t}) AS {f}"
    return " UNION ALL ".join(f"SELECT episode_id, '{n}' AS check_name, {key} AS key, " + ", ".join(one(f, t, x) for f, t in kinds) + f" FROM {table} WHERE {w}" for n, w, x in rules)


_ARM = "key IN ('joint_position', 'joint_velocity', 'cartesian_position', 'cartesian_velocity')"
_JP, _JV = "key = 'joint_position' AND n_bad = 0", "key = 'joint_velocity' AND n_bad = 0"
_SOUND = "n_bad = 0 AND n_bad_state = 0"
_GRIP = f"{_SOUND} AND key = 'gripper_position' AND dim = s_dim AND n_state >= 2"
_OUT = "greatest(l_low - low, high - l_high, 0)"
_MARGIN = "greatest(0.25e0 * greatest(l_high - l_low, abs(l_low), abs(l_high)), 0.05e0)"
_TO = "CASE WHEN to_next > 0 THEN sqrt(to_move / to_next) END"
_DELTA = f"n_next >= 1 AND aa_next > 0 AND {_TO} < 0.3e0"
_UNIT = "CASE WHEN {0} <= 6.5e0 THEN '' WHEN {0} <= 100.5e0 THEN 'degrees_or_normalized_100' WHEN {0} <= 400 THEN 'degrees' ELSE 'unknown' END"
_WRONG = "concat_ws(',', CASE WHEN an > 0 AND an <> dim THEN 'action' END, CASE WHEN sn > 0 AND s_dim > 0 AND sn <> s_dim THEN 'state' END, CASE WHEN an = 0 AND sn = 0 AND s_dim > 0 AND s_dim <> dim THEN 'action_vs_state' END)"
_TRACKED = f"{_JP} AND cols > 0 AND n_bad_state = 0 AND n_next >= 1"

QUERIES: dict[str, Query] = {
    "aligned_steps": aligned_steps,
    "general_checks": general_checks,
    "joint_position_checks": joint_position_checks,
    "joint_velocity_checks": joint_velocity_checks,
    "jumping_joints": jumping_joints,
    "worst_joints": worst_joints,
    "skipped_keys": skipped_keys,
    "command_rate": command_rate,
    "duplicate_pairs": duplicate_pairs,
    "missing_keys": missing_keys,
}

ORACLE_SQL: dict[str, str] = {
    "aligned_steps": f"""{src.as_cte("steps", "episodes")}, {ALIGNED}
      SELECT episode_id, key, t, round(list_sum(a), 6) AS a_sum, round(list_sum(s), 6) AS s_sum, round(list_sum(s_next), 6) AS s_next_sum FROM al WHERE s IS NOT NULL""",
    "general_checks": METRICS + told("km", [
        ("constant_action", f"n_bad = 0 AND {_ARM} AND n >= 2 AND changes = 0", {"metric": "first", "other": "state_range", "n": "n", "note": "state_key"}),
        ("length_mismatch", "l_n IS NOT NULL AND n <> l_n", {"metric": "n - l_n", "n": "n", "note": "state_key"}),
        ("action_copies_state", f"{_SOUND} AND key IN ('joint_position', 'cartesian_position') AND dim = s_dim AND state_range > 1e-6 AND copies / n_state >= 0.9e0", {"metric": "copies / n_state", "n": "n_state"}),
        ("gripper_range", "n_bad = 0 AND key = 'gripper_binary' AND (low < -0.05e0 OR high > 1.05e0)", {"metric": "low", "other": "high"}),
        ("gripper_command_range", f"n_bad = 0 AND key = 'gripper_position' AND {_OUT} > {_MARGIN} AND l_n IS NOT NULL", {"metric": _OUT, "other": _MARGIN}),
        ("scale_consistency", f"{_GRIP} AND (CASE WHEN ss > 0 THEN round(sqrt(aa / ss), 9) ELSE 'inf'::DOUBLE END > 5 OR CASE WHEN ss > 0 THEN round(sqrt(aa / ss), 9) END < 0.2e0)", {"metric": "CASE WHEN ss > 0 THEN sqrt(aa / ss) ELSE 'inf'::DOUBLE END"}),
        ("tracking_residual", f"{_GRIP} AND aa_next > 0 AND round(sqrt(to_next / aa_next), 9) > 0.5e0", {"metric": "sqrt(to_next / aa_next)"}),
        ("delta_detection", f"{_GRIP} AND {_DELTA} AND round({_TO}, 9) < 0.3e0", {"metric": _TO, "other": "sqrt(aa_next / next_values)"}),
    ]),
    "joint_position_checks": METRICS + told("km", [
        ("dof", f"{_JP} AND {_WRONG} <> ''", {"metric": "dim", "other": "s_dim", "n": "an", "note": _WRONG}),
        ("gripper_in_joints", f"{_JP} AND an = dim AND grippers > 0", {"n": "grippers"}),
        ("normalized_range", f"{_JP} AND cols > 0 AND abs(top - 1) <= 1e-6", {"metric": "top"}),
        ("radians", f"{_JP} AND cols > 0 AND (top > 6.5e0 OR (n_bad_state = 0 AND s_top > 6.5e0))", {"metric": "top", "other": "CASE WHEN n_bad_state = 0 THEN s_top END", "note": f"concat_ws('/', {_UNIT.format('top')}, CASE WHEN n_bad_state = 0 AND s_top IS NOT NULL THEN {_UNIT.format('s_top')} END)"}),
        ("step_jump", f"{_JP} AND cols > 0 AND top <= 6.5e0 AND n >= 2 AND n_jumps > 0", {"metric": "top_jump", "other": "hz", "n": "n_jumps", "at": "first_jump"}),
        ("delta_detection", f"{_TRACKED} AND {_DELTA}", {"metric": _TO, "other": "sqrt(aa_next / next_values)"}),
        ("tracking", f"{_TRACKED} AND top <= 6.5e0 AND median > 0.2e0", {"metric": "median"}),
    ]),
    "joint_velocity_checks": METRICS + told("km", [
        ("dof", f"{_JV} AND an > 0 AND an <> dim", {"metric": "dim", "n": "an"}),
        ("speed_limit", f"{_JV} AND top > 3.14e0", {"metric": "top"}),
        ("normalized_range", f"{_JV} AND abs(top - 1) <= 1e-6", {"metric": "top"}),
        ("smoothness", f"{_JV} AND pairs > 0 AND flips / pairs > 0.3e0", {"metric": "flips / pairs", "n": "flips"}),
        ("looks_like_position", f"{_JV} AND n_bad_state = 0 AND n_state >= 3 AND nn > 0 AND sqrt(to_next / nn) < 0.2e0", {"metric": "sqrt(to_next / nn)"}),
        ("tracking", f"{_JV} AND n_bad_state = 0 AND n_state >= 3 AND hz IS NOT NULL AND span >= 0.2e0 AND reasons <> ''", {"metric": "ratio", "other": "r", "n": "lag", "note": "concat_ws(';', reasons, suspected)"}),
    ]),
    "jumping_joints": METRICS + """, j0 AS (SELECT *, sum(n_bad) OVER w AS bad, max(top) OVER w AS all_top FROM cm WHERE key = 'joint_position' AND NOT ex WINDOW w AS (PARTITION BY episode_id))
      SELECT episode_id, d - 1 AS d, n_jumps AS n, first_jump AS first_step, round(top_jump, 6) AS top FROM j0 WHERE bad = 0 AND all_top <= 6.5e0 AND n_jumps > 0""",
    "worst_joints": METRICS + """ SELECT episode_id, CAST(rank AS INT) AS rank, d - 1 AS d, round(median, 6) AS median FROM (
      SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY median DESC, d DESC) AS rank FROM cm WHERE key = 'joint_position' AND n_bad = 0 AND n_next > 0 AND NOT ex) WHERE rank <= 3""",
    "skipped_keys": METRICS + " " + " UNION ALL ".join(
        f"SELECT episode_id, key, '{r}' AS reason FROM km WHERE {w}" for r, w in [
            ("non_finite_values", "n_bad > 0"), ("too_short", "n < 2"), ("no_matching_state", "l_n IS NULL"), ("feature_dim_mismatch", "l_n IS NOT NULL AND dim <> s_dim"), ("state_static", "state_range <= 1e-6"),
            ("no_control_freq", "hz IS NULL")]),
    "command_rate": f"""{src.as_cte("steps", "episodes")}, {ALIGNED},
      bd AS (SELECT DISTINCT episode_id, key FROM al WHERE len(list_filter(a, lambda v: NOT isfinite(v))) > 0),
      ch AS (SELECT episode_id, key, hz, t, t - coalesce(lag(t) OVER (PARTITION BY episode_id, key ORDER BY t), 0) AS period FROM al
        WHERE {_ARM} AND len(list_filter(list_zip(a, a_prev), lambda z: abs(z[1] - z[2]) > 1e-9)) > 0 AND a_prev IS NOT NULL AND (episode_id, key) NOT IN (SELECT (episode_id, key) FROM bd)),
      n AS (SELECT episode_id, key, hz, period, count(*) AS k FROM ch GROUP BY ALL),
      r AS (SELECT *, sum(k) OVER (PARTITION BY episode_id, key) AS total, row_number() OVER (PARTITION BY episode_id, key ORDER BY k DESC, period) AS rank FROM n)
      SELECT episode_id, key, period, round(k / total, 6) AS share, total::BIGINT AS n_holds, round(hz / period, 6) AS effective_hz FROM r WHERE rank = 1 AND total >= 10 AND period >= 2 AND k >= 0.8e0 * total""",
    "duplicate_pairs": f"""{src.as_cte("steps")}, s AS (SELECT *, count(*) OVER (PARTITION BY episode_id, key) AS n FROM steps WHERE grp = 'action')
      SELECT x.episode_id, x.key AS key_a, y.key AS key_b, round(max(g), 6) AS max_abs_diff FROM (
        SELECT x.episode_id, x, y, list_max(list_transform(list_zip(x.vals, y.vals), lambda z: abs(z[1] - z[2]))) AS g FROM s x JOIN s y ON x.episode_id = y.episode_id AND x.t = y.t
          AND x.key < y.key AND len(x.vals) = len(y.vals) AND x.n = y.n) GROUP BY ALL HAVING max(g) <= 1e-9""",
    "missing_keys": f"""{src.as_cte("steps")},
      need AS (SELECT DISTINCT episode_id, 'gripper_position' AS key FROM steps UNION SELECT episode_id, CASE WHEN key LIKE 'joint%' THEN 'joint_position' ELSE 'cartesian_position' END FROM steps
        WHERE grp = 'action' AND {_ARM})
      SELECT episode_id, 'required_state_keys' AS check_name, key FROM need WHERE (episode_id, key) NOT IN (SELECT (episode_id, key) FROM steps WHERE grp = 'state')
      UNION ALL SELECT DISTINCT episode_id, 'gripper_binary_present', 'gripper_binary' FROM steps WHERE episode_id NOT IN (SELECT episode_id FROM steps WHERE key = 'gripper_binary')""",
}
