"""Registered queries of the pose checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.functions.rotations import to_quaternion
from tendon.jobs.motion_queries import ALIGNED, told
from tendon.operators import poses
from tendon.operators.config import with_overrides
from tendon.sources import episodes as src


_ASIDE = "transform(vals, (v, i) -> v + CASE WHEN i = 1 THEN 1D ELSE 0D END)"
OVERRIDES = {"cartesian_position": {"quaternion_sign_flip": {"enabled": True}, "quaternion_scalar_order": {"enabled": True}}}


def two_armed(steps: DataFrame) -> DataFrame:
    """Most two-armed episodes have a second arm beside the first; the commands of some have their arms swapped."""
    two = "key LIKE 'cartesian%' AND episode_id % 4 = 1 AND episode_id % 6 <> 5"
    swap = "grp = 'action' AND key = 'cartesian_position' AND episode_id % 8 = 1"
    both = F.expr(f"CASE WHEN {two} THEN CASE WHEN {swap} THEN concat({_ASIDE}, vals) WHEN key = 'cartesian_velocity' THEN concat(vals, vals) ELSE concat(vals, {_ASIDE}) END ELSE vals END")
    return steps.withColumn("vals", both)


def _steps(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    return two_armed(src.steps(spark, sf_dir, key and (key,)))


def cartesian_position_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the checks on quaternions that are off by default."""
    return poses.cartesian_position(_steps(spark, sf_dir, poses.POSE), src.episodes(spark, sf_dir), with_overrides(OVERRIDES))


def pose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses.pose_errors(_steps(spark, sf_dir, poses.POSE), src.episodes(spark, sf_dir))


#: How states write orientations, by the episode's number modulo 8: what the profile declares, and the numbers; 5 and 6 don't fit what they declare.
_TURN = "2D * atan2(vals[5], vals[6])"
_WRITTEN = {
    1: ("matrix", f"array(cos({_TURN}), -sin({_TURN}), 0D, sin({_TURN}), cos({_TURN}), 0D, 0D, 0D, 1D)"), 2: ("rot6d", f"array(2D * cos({_TURN}), 2D * sin({_TURN}), 0D, cos({_TURN}) - sin({_TURN}), sin({_TURN}) + cos({_TURN}), 0D)"),
    3: ("rotvec", f"array(0D, 0D, {_TURN})"), 4: ("euler_zyx", f"array({_TURN}, 0D, 0D)"), 5: ("matrix", f"array(0D, 0D, {_TURN})"), 6: ("rot7d", f"array(0D, 0D, {_TURN})"), 7: ("euler_XYZ", f"array(0D, 0D, {_TURN})"),
}


def declared_pose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of poses of one arm whose states write orientations in several ways."""
    e = "episode_id % 8"
    steps = src.steps(spark, sf_dir, (poses.POSE,)).where("episode_id % 4 <> 1 OR episode_id % 8 = 1")
    numbers = " ".join(f"WHEN {k} THEN {v}" for k, (_, v) in _WRITTEN.items())
    steps = steps.withColumn("vals", F.expr(f"CASE WHEN grp = 'state' THEN concat(slice(vals, 1, 3), CASE {e} {numbers} ELSE slice(vals, 4, 4) END) ELSE vals END"))
    episodes = src.episodes(spark, sf_dir).withColumn("is_biarm", F.lit(False))
    said = " ".join(f"WHEN {k} THEN '{n}'" for k, (n, _) in _WRITTEN.items())
    return poses.pose_errors(steps, episodes, episodes.selectExpr("episode_id", f"CASE {e} {said} END AS declared"))


#: A lab that allows fast turns and long quaternions.
LENIENT = {"cartesian_position": {"rotation_jump": {"max_angular_speed_deg_s": 4000.0}, "quaternion_shape": {"norm_atol": 0.2}, "pose_tracking": {"max_median_position_error_m": 0.5}}}


def lenient_pose_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of poses with overridden thresholds."""
    return poses.cartesian_position(_steps(spark, sf_dir, poses.POSE), src.episodes(spark, sf_dir), with_overrides(LENIENT))


def cartesian_velocity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses.cartesian_velocity(_steps(spark, sf_dir, poses.VELOCITY), src.episodes(spark, sf_dir))


def velocity_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses.velocity_tracking(_steps(spark, sf_dir, poses.VELOCITY), src.episodes(spark, sf_dir))


def biarm_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses.biarm_ordering(_steps(spark, sf_dir, poses.POSE), src.episodes(spark, sf_dir))


def orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quaternions of the first numbers of every embedding, read as each representation."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    kinds = {"quat": 4, "rot6d": 6, "rotvec": 3, "euler_xyz": 3, "euler_ZYX": 3}
    picked = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), to_quaternion(F.slice("e", 1, n), k).alias("q")) for k, n in kinds.items()))).alias("x")
    rows = rows.select("vec_id", picked)
    return rows.select("vec_id", "x.kind", *(F.round(F.element_at("x.q", i + 1), 6).alias(a) for i, a in enumerate(("qx", "qy", "qz", "qw"))))


_SQ = lambda v: f"list_sum(list_transform({v}, lambda x: x * x))"
_GAP = lambda a, b: f"(({a}[1] - {b}[1]) ** 2 + ({a}[2] - {b}[2]) ** 2 + ({a}[3] - {b}[3]) ** 2)"
_DOT = lambda a, b: f"({a}[1] * {b}[1] + {a}[2] * {b}[2] + {a}[3] * {b}[3] + {a}[4] * {b}[4])"
_ANGLE = lambda a, b: f"degrees(2 * acos(least(abs({_DOT(a, b)}) / sqrt({_DOT(a, a)} * {_DOT(b, b)}), 1)))"
_TWO = """WITH steps AS (SELECT episode_id, grp, key, t, CASE WHEN key LIKE 'cartesian%' AND episode_id % 4 = 1 AND episode_id % 6 <> 5 THEN
      CASE WHEN grp = 'action' AND key = 'cartesian_position' AND episode_id % 8 = 1 THEN list_concat(list_transform(vals, lambda v, i: v + CASE WHEN i = 2 THEN 1e0 ELSE 0e0 END), vals)
        WHEN key = 'cartesian_velocity' THEN list_concat(vals, vals) ELSE list_concat(vals, list_transform(vals, lambda v, i: v + CASE WHEN i = 2 THEN 1e0 ELSE 0e0 END)) END ELSE vals END AS vals FROM steps0)"""
_BASE = src.as_cte("episodes", "steps").replace(", steps AS (", ", steps0 AS (") + ", " + _TWO.removeprefix("WITH ") + f", {ALIGNED}"
_POSE = f"""{_BASE}, pr AS (SELECT al.*, CASE WHEN is_biarm THEN 2 ELSE 1 END AS arms, bool_or(len(list_filter(a, lambda v: NOT isfinite(v))) > 0) OVER (PARTITION BY episode_id) AS bad FROM al JOIN episodes USING (episode_id) WHERE key = 'KEY'),
  ar AS (SELECT *, unnest(range(0, arms)) AS arm, len(s) // arms AS st FROM pr WHERE len(a) = WIDE * arms AND NOT bad),
  pt AS (SELECT episode_id, t, arm, arms, hz, a[WIDE * arm + 1:WIDE * arm + WIDE] AS own, a_prev[WIDE * arm + 1:WIDE * arm + WIDE] AS prv, s[st * arm + 1:st * arm + 3] AS sp, s[st * arm + 4:st * arm + 7] AS sq,
    CASE WHEN more THEN s_next[st * arm + 1:st * arm + 3] END AS np, CASE WHEN more THEN s_next[st * arm + 4:st * arm + 7] END AS nq FROM ar)"""
_ARM = _POSE.replace("KEY", "cartesian_position").replace("WIDE", "7") + f""",
  n0 AS (SELECT *, own[1:3] AS p, own[4:7] AS q, CASE WHEN len(prv) = 7 THEN prv[4:7] END AS qp, sqrt({_DOT("own[4:7]", "own[4:7]")}) AS n FROM pt),
  n1 AS (SELECT *, bool_or(n = 0) OVER (PARTITION BY episode_id) AS zero, CASE WHEN qp IS NOT NULL AND n > 0 THEN {_ANGLE("qp", "q")} END AS angle, CASE WHEN nq IS NOT NULL AND n > 0 THEN {_ANGLE("q", "nq")} END AS turned,
    CASE WHEN np IS NOT NULL THEN sqrt({_GAP("p", "np")}) END AS far, CASE WHEN qp IS NOT NULL THEN {_DOT("qp", "q")} END AS dp, (p[1] - np[1] + sp[1]) ** 2 + (p[2] - np[2] + sp[2]) ** 2 + (p[3] - np[3] + sp[3]) ** 2 AS mv FROM n0),
  m AS (SELECT episode_id, arm, max(arms) AS arms, max(hz) AS hz, count(*) AS steps, bool_or(zero) AS zero, count(*) FILTER (abs(n - 1) > 1e-3) AS n_off, min(n) FILTER (abs(n - 1) > 1e-3) AS least, max(n) FILTER (abs(n - 1) > 1e-3) AS most,
      count(*) FILTER (dp < 0) AS flips, min(t - 1) FILTER (dp < 0) AS first_flip, count(*) FILTER (angle > 360 / hz) AS n_jumps, min(t - 1) FILTER (angle > 360 / hz) AS first_jump, max(angle) AS top_angle,
      avg(abs(q[1] / n)) - stddev_pop(q[1] / n) AS fs, avg(abs(q[4] / n)) - stddev_pop(q[4] / n) AS ls, quantile_cont(far, 0.5) AS median_far, avg(far) AS mean_far, max(far) AS most_far, quantile_cont(turned, 0.5) AS median_turned,
      avg(turned) AS mean_turned, max(turned) AS most_turned, max(greatest(abs(p[1]), abs(p[2]), abs(p[3]))) AS top, max(greatest(abs(sp[1]), abs(sp[2]), abs(sp[3]))) AS s_top, sum({_SQ("p")}) FILTER (sp IS NOT NULL) AS pp, sum({_SQ("sp")}) AS ss,
      sum({_SQ("p")}) FILTER (np IS NOT NULL) AS aa_next, sum(far ** 2) AS to_next, sum(mv) AS to_move, count(far) AS n_next, (arm + 1)::VARCHAR AS key FROM n1 GROUP BY episode_id, arm),
  w0 AS (SELECT episode_id, sum(pp) AS pp, sum(ss) AS ss, sum(aa_next) AS aa_next, sum(to_next) AS to_next, sum(to_move) AS to_move, sum(n_next) AS n_next, max(top) AS top, max(s_top) AS s_top FROM m GROUP BY episode_id HAVING max(steps) >= 2),
  w1 AS (SELECT *, CASE WHEN ss > 0 THEN sqrt(pp / ss) END AS ratio FROM w0),
  w AS (SELECT *, top > 3 AS far, coalesce(s_top > 3, false) AS s_far, coalesce(ratio > 10, false) AS scale FROM w1),
  sh AS (SELECT episode_id, bool_or(bad) AS bad, bool_and(len(a) = 7 * arms) AS fits, max(len(a)) AS width, max(arms) AS arms FROM pr GROUP BY episode_id)"""
_REACH = lambda x: f"""CASE WHEN {x} BETWEEN 20 AND 150 AND NOT ({x} BETWEEN 200 AND 1500 AND abs(ln({x} / 100 / sqrt(0.3e0))) > abs(ln({x} / 1000 / sqrt(0.3e0)))) THEN 'cm' WHEN {x} BETWEEN 200 AND 1500 THEN 'mm' ELSE 'unknown' END"""
_NOTE = f"""concat_ws(';', concat_ws(',', CASE WHEN far THEN 'action_out_of_range' END, CASE WHEN s_far THEN 'state_out_of_range' END, CASE WHEN scale THEN 'action_state_scale_mismatch' END),
    CASE WHEN far OR scale THEN CASE WHEN NOT s_far AND ratio IS NOT NULL THEN CASE WHEN abs(log10(ratio / 100)) < 0.5e0 THEN 'cm' WHEN abs(log10(ratio / 1000)) < 0.5e0 THEN 'mm' ELSE 'unknown' END ELSE {_REACH("top")} END END, CASE WHEN s_far THEN {_REACH("s_top")} END)"""
_TO = "CASE WHEN to_next > 0 THEN sqrt(to_move / to_next) END"
_VEL = _POSE.replace("KEY", "cartesian_velocity").replace("WIDE", "6") + f""",
  ce AS (SELECT episode_id, arm, own[d] AS v, prv[d] AS b, sqrt(avg(own[d] ** 2) OVER (PARTITION BY episode_id, arm, d)) AS sc FROM (SELECT *, unnest(range(1, 7)) AS d FROM pt)),
  fl AS (SELECT episode_id, count(*) FILTER (abs(v) > 0.1e0 * sc AND abs(b) > 0.1e0 * sc) AS pairs, count(*) FILTER (abs(v) > 0.1e0 * sc AND abs(b) > 0.1e0 * sc AND sign(v) <> sign(b)) AS flips FROM ce GROUP BY episode_id),
  v0 AS (SELECT episode_id, max(sqrt({_SQ("own[1:3]")})) AS linear, max(sqrt({_SQ("own[4:6]")})) AS angular, max(list_max(list_transform(own, lambda x: abs(x)))) AS top, sum({_GAP("own", "np")}) FILTER (np IS NOT NULL) AS tn, sum({_SQ("np")}) AS nn,
    count(sp) / max(arms) AS n_state FROM pt GROUP BY episode_id), v AS (SELECT * FROM v0 JOIN fl USING (episode_id)),
  sh AS (SELECT episode_id, bool_or(bad) AS bad, bool_and(len(a) = 6 * arms) AS fits, max(len(a)) AS width, max(arms) AS arms FROM pr GROUP BY episode_id)"""

_QMUL = lambda a, b: f"[{a}[4] * {b}[1] + {a}[1] * {b}[4] + {a}[2] * {b}[3] - {a}[3] * {b}[2], {a}[4] * {b}[2] - {a}[1] * {b}[3] + {a}[2] * {b}[4] + {a}[3] * {b}[1], {a}[4] * {b}[3] + {a}[1] * {b}[2] - {a}[2] * {b}[1] + {a}[3] * {b}[4], {a}[4] * {b}[4] - {a}[1] * {b}[1] - {a}[2] * {b}[2] - {a}[3] * {b}[3]]"
_ROTVEC = lambda q: f"list_transform({q}[1:3], lambda v: v * CASE WHEN {q}[4] < 0 THEN -1 ELSE 1 END * CASE WHEN sqrt({_SQ(q + '[1:3]')}) > 1e-12 THEN 2 * atan2(sqrt({_SQ(q + '[1:3]')}), abs({q}[4])) / sqrt({_SQ(q + '[1:3]')}) ELSE 2 END)"
_SUMS = ", ".join(f"3 * count(y{k}) AS n{k}, sum(list_sum(x)) FILTER (y{k} IS NOT NULL) AS x{k}, sum(list_sum(y{k})) AS y{k}_, sum({_SQ('x')}) FILTER (y{k} IS NOT NULL) AS xx{k}, sum({_SQ(f'y{k}')}) AS yy{k}, sum(list_sum(list_transform(list_zip(x, y{k}), lambda z: z[1] * z[2]))) FILTER (y{k} IS NOT NULL) AS xy{k}, sum(list_sum(list_transform(list_zip(x, y{k}), lambda z: (z[1] - z[2]) ** 2))) FILTER (y{k} IS NOT NULL) AS dd{k}" for k in (0, 1))
_RK = "CASE WHEN n{0} >= 2 AND n{0} * xx{0} - x{0} ** 2 > 1e-12 * n{0} * xx{0} AND n{0} * yy{0} - y{0}_ ** 2 > 1e-12 * n{0} * yy{0} THEN (n{0} * xy{0} - x{0} * y{0}_) / sqrt((n{0} * xx{0} - x{0} ** 2) * (n{0} * yy{0} - y{0}_ ** 2)) END"
_PAIRS = [(f, p, x, y) for f in ("base", "ee") for p, x, y in (("linear", "own[1:3]", "lin"), ("angular", "own[4:6]", "ang"), ("swapped_linear", "own[4:6]", "lin"), ("swapped_angular", "own[1:3]", "ang"))]
_PIVOT = ", ".join(f"max({x}) FILTER (part = '{p}') AS {p}_{x}" if x != "moves" else f"bool_or(moves) FILTER (part = '{p}') AS {p}_moves" for p in ("linear", "angular", "swapped_linear", "swapped_angular") for x in ("r", "ratio", "reasons", "suspected", "moves"))
_LIST = lambda p: f"CASE WHEN {p}_moves AND {p}_reasons <> '' THEN array_to_string(list_transform(string_split({p}_reasons, ','), lambda x: '{p}_' || x), ',') END"
TRACKED = _POSE.replace("KEY", "cartesian_velocity").replace("WIDE", "6") + f""",
  t0 AS (SELECT *, first_value(sp) OVER w AS sp0, first_value(sq) OVER w AS sq0, [-sq[1], -sq[2], -sq[3], sq[4]] AS cq, [np[1] - sp[1], np[2] - sp[2], np[3] - sp[3], 0] AS gap FROM pt WHERE hz IS NOT NULL AND sp IS NOT NULL WINDOW w AS (PARTITION BY episode_id, arm ORDER BY t)),
  t1 AS (SELECT *, sqrt({_GAP("sp", "sp0")}) AS gone, {_ANGLE("sq", "sq0")} AS rotated, {_QMUL("nq", "cq")} AS qb, {_QMUL("cq", "nq")} AS qe, {_QMUL("cq", "gap")} AS half FROM t0),
  t2 AS (SELECT *, CASE WHEN np IS NOT NULL THEN gap[1:3] END AS base_lin, CASE WHEN np IS NOT NULL THEN {_ROTVEC("qb")} END AS base_ang, CASE WHEN np IS NOT NULL THEN ({_QMUL("half", "sq")})[1:3] END AS ee_lin, CASE WHEN np IS NOT NULL THEN {_ROTVEC("qe")} END AS ee_ang FROM t1),
  t3 AS (SELECT *, {", ".join(f"lead({k}) OVER w AS {k}1" for k in ("base_lin", "base_ang", "ee_lin", "ee_ang"))} FROM t2 WINDOW w AS (PARTITION BY episode_id, arm ORDER BY t)),
  t4 AS ({" UNION ALL ".join(f"SELECT episode_id, arms, hz, gone, rotated, '{f}' AS frame, '{p}' AS part, list_transform({x}, lambda v: v / hz) AS x, {f}_{y} AS y0, {f}_{y}1 AS y1 FROM t3" for f, p, x, y in _PAIRS)}),
  t5 AS (SELECT episode_id, frame, part, max(arms) AS arms, max(hz) AS hz, max(gone) AS gone, max(rotated) AS rotated, {_SUMS} FROM t4 GROUP BY ALL),
  t6 AS (SELECT *, {_RK.format(0)} AS r_0, {_RK.format(1)} AS r_1 FROM t5),
  t7 AS (SELECT *, n1 >= 6 * arms AND (NOT n0 >= 6 * arms OR coalesce(r_1, -2) > coalesce(r_0, -2)) AS later FROM t6 WHERE n0 >= 6 * arms OR n1 >= 6 * arms),
  t8 AS (SELECT *, CASE WHEN later THEN r_1 ELSE r_0 END AS r, CASE WHEN later THEN xx1 ELSE xx0 END AS xx, CASE WHEN later THEN yy1 ELSE yy0 END AS yy, CASE WHEN later THEN dd1 ELSE dd0 END AS dd FROM t7),
  t9 AS (SELECT *, CASE WHEN yy > 0 THEN sqrt(xx / yy) END AS ratio, yy > 0 AND dd <= 1e-12 * yy AS exact, CASE WHEN part LIKE '%linear' THEN gone >= 0.05e0 ELSE rotated >= 15 END AS moves FROM t8),
  ta AS (SELECT *, concat_ws(',', CASE WHEN exact THEN 'copies_state_motion' END, CASE WHEN ratio > 8 THEN 'too_large' END, CASE WHEN ratio < 0.25e0 THEN 'too_small' END, CASE WHEN NOT exact AND NOT coalesce(r >= 0.3e0, false) THEN 'doesnt_match_state_motion' END) AS reasons,
      CASE WHEN ratio > 0 THEN CASE WHEN abs(ln(ratio / degrees(1))) < ln(2) THEN 'deg_per_s' WHEN abs(ln(ratio * hz)) < ln(2) THEN 'per_step_delta' END END AS suspected FROM t9),
  tb AS (SELECT episode_id, frame, {_PIVOT} FROM ta GROUP BY ALL),
  tr0 AS (SELECT * FROM tb QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY round(coalesce(linear_r, -1) + coalesce(angular_r, -1), 9) DESC, frame) = 1),
  tr AS (SELECT *, concat_ws(',', {_LIST("linear")}, {_LIST("angular")}) AS reasons, (linear_r + angular_r) / 2 AS given, (swapped_linear_r + swapped_angular_r) / 2 AS swapped FROM tr0)"""

QUERIES = {
    "cartesian_position_checks": cartesian_position_checks,
    "pose_errors": pose_errors,
    "cartesian_velocity_checks": cartesian_velocity_checks,
    "velocity_tracking": velocity_tracking,
    "declared_pose_errors": declared_pose_errors,
    "lenient_pose_checks": lenient_pose_checks,
    "biarm_ordering": biarm_ordering,
    "orientations": orientations,
}
ORACLE_SQL = {
    "cartesian_position_checks": _ARM + told("m", [
        ("quaternion_shape", "n_off > 0", {"metric": "least", "other": "most", "n": "n_off", "note": "'bad_quaternion_norm'"}), ("quaternion_sign_flip", "steps >= 2 AND NOT zero AND flips > 0", {"n": "flips", "at": "first_flip"}),
        ("rotation_jump", "steps >= 2 AND NOT zero AND n_jumps > 0", {"metric": "top_angle", "other": "hz", "n": "n_jumps", "at": "first_jump"}),
        ("quaternion_scalar_order", "steps >= 2 AND NOT zero AND fs > ls", {"metric": "fs", "other": "ls"}),
        ("pose_tracking", "steps >= 2 AND NOT zero AND (median_far > 0.1e0 OR median_turned > 20)", {"metric": "median_far", "other": "median_turned"})])
      + " UNION ALL " + told("sh", [("quaternion_shape", "NOT bad AND NOT fits", {"metric": "width", "other": "7 * arms", "note": "'wrong_dim'"})], "'cartesian_position'")
      + " UNION ALL " + told("w", [("normalized_range", "abs(top - 1) <= 1e-6", {"metric": "top"}), ("position_units", "far OR s_far OR scale", {"metric": "top", "other": "ratio", "note": _NOTE}),
        ("delta_detection", f"n_next >= 1 AND aa_next > 0 AND {_TO} < 0.3e0", {"metric": _TO, "other": "sqrt(aa_next / (3 * n_next))"})], "'cartesian_position'"),
    "pose_errors": _ARM + " SELECT episode_id, arm + 1 AS arm, " + ", ".join(f"round({k}_{x}, 6) AS {k}_{x}" for x in ("far", "turned") for k in ("median", "mean", "most")) + " FROM m",
    "cartesian_velocity_checks": _VEL + told("v", [
        ("speed_limit", "linear > 2 OR angular > 6.28e0", {"metric": "linear", "other": "angular"}), ("normalized_range", "abs(top - 1) <= 1e-6", {"metric": "top"}),
        ("smoothness", "pairs > 0 AND flips / pairs > 0.3e0", {"metric": "flips / pairs", "n": "flips"}), ("looks_like_position", "n_state >= 3 AND nn > 0 AND sqrt(tn / nn) < 0.2e0", {"metric": "sqrt(tn / nn)"})], "'cartesian_velocity'")
      + " UNION ALL " + told("sh", [("shape", "NOT bad AND NOT fits", {"metric": "width", "other": "6 * arms"})], "'cartesian_velocity'"),
    "velocity_tracking": TRACKED + told("tr", [
        ("tracking", "(linear_moves OR angular_moves) AND reasons <> ''", {"metric": "CASE WHEN linear_moves THEN linear_ratio END", "other": "CASE WHEN angular_moves THEN angular_ratio END", "note": "concat_ws(';', frame, reasons, CASE WHEN linear_moves THEN linear_suspected END, CASE WHEN angular_moves THEN angular_suspected END)"}),
        ("linear_angular_order", "linear_moves AND angular_moves AND swapped IS NOT NULL AND (given IS NULL OR swapped > given + 0.2e0)", {"metric": "given", "other": "swapped", "note": "frame"})], "'cartesian_velocity'"),
    "biarm_ordering": _POSE.replace("KEY", "cartesian_position").replace("WIDE", "7") + f""", g AS (SELECT episode_id, a, s_next AS x, len(s) // 2 AS st FROM pr WHERE arms = 2 AND len(a) = 14 AND NOT bad AND more AND s_next IS NOT NULL AND len(s) % 2 = 0),
      r AS (SELECT episode_id, sum({_GAP("a[1:3]", "x[1:3]")} + {_GAP("a[8:10]", "x[st + 1:st + 3]")}) AS same, sum({_GAP("a[1:3]", "x[st + 1:st + 3]")} + {_GAP("a[8:10]", "x[1:3]")}) AS swapped FROM g GROUP BY episode_id)
      SELECT episode_id, round(sqrt(swapped / same), 6) AS ratio FROM r WHERE same > 0 AND sqrt(swapped / same) < 0.5e0""",
}
# a rotation that is written in another way is the same one; states of which the profile says something else have no angle
ORACLE_SQL["declared_pose_errors"] = (
    ORACLE_SQL["pose_errors"].replace(_TWO.removeprefix("WITH "), "steps AS (SELECT * FROM steps0 WHERE episode_id % 4 <> 1 OR episode_id % 8 = 1)").replace("CASE WHEN is_biarm THEN 2 ELSE 1 END AS arms", "1 AS arms")
    .replace("CASE WHEN nq IS NOT NULL AND n > 0 THEN", "CASE WHEN nq IS NOT NULL AND n > 0 AND episode_id % 8 NOT IN (5, 6) THEN")
)
ORACLE_SQL["lenient_pose_checks"] = "SELECT * FROM (" + (
    ORACLE_SQL["cartesian_position_checks"].replace("> 1e-3)", "> 0.2e0)").replace("angle > 360 / hz", "angle > 4000 / hz").replace("median_far > 0.1e0", "median_far > 0.5e0")
) + ") WHERE check_name NOT IN ('quaternion_sign_flip', 'quaternion_scalar_order')"
