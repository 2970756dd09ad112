"""Registered queries of validation and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.jobs import filmed_queries, motion_queries, pose_queries, profile_queries, video_queries
from tendon.operators import ledger, quality, reporting, validation
from tendon.operators.config import CHECKS, DEFAULTS, DESCRIPTIONS, HIGH_CONFIDENCE, action_of, catalogue
from tendon.sources import episodes as src
from tendon.sources import filmed
from tendon.sources import recordings as rec
from tendon.sources import tables


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.violations(src.episodes(spark, sf_dir), src.steps(spark, sf_dir), src.videos(spark, sf_dir))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.verdicts(_found(spark, sf_dir), src.episodes(spark, sf_dir))


def declared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = src.episodes(spark, sf_dir).select("episode_id", F.explode(F.array(*(
        F.struct(F.lit(g).alias("grp"), F.lit(k).alias("key")) for g, k in [("state", "joint_position"), ("state", "gripper_position"), ("action", "joint_position"), ("action", "gripper_binary"), ("action", "base_position")]
    ))).alias("x")).select("episode_id", "x.grp", "x.key")
    return validation.declared(src.steps(spark, sf_dir, values=False), wanted)


def bad_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.bad_values(src.steps(spark, sf_dir))


def bad_quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.bad_quaternions(pose_queries._steps(spark, sf_dir))


def validation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.totals(verdicts(spark, sf_dir))


def placeholder_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rec.tolerant(rec.profiles(spark, sf_dir)).select("episode_id", "p.policy_name", "p.robot_name", "p.gripper_name")
    return reporting.placeholder_metadata(src.episodes(spark, sf_dir).select("episode_id", "operator_name").join(p, "episode_id", "left"))


def _tables(spark: SparkSession, sf_dir: str) -> quality.Tables:
    """The test tables; those with a row per step or frame are written once, as they would be stored, and read by each pass."""
    steps = tables.saved(src.steps(spark, sf_dir), "steps")
    of = lambda keys: steps if keys is None else steps.where(src.wanted(keys))
    motion, frames = (tables.saved(f(spark, sf_dir), "filmed") for f in (filmed.motion, filmed.frames))
    return quality.Tables(
        src.episodes(spark, sf_dir), rec.profiles(spark, sf_dir), rec.arrays(spark, sf_dir), of, lambda key: pose_queries.two_armed(of((key,))), src.videos(spark, sf_dir), motion, frames, filmed.rates(spark, sf_dir)
    )


IGNORED = ("Side_Right",)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all categories, each written to its partition of a new ledger in the shared folder."""
    return quality.run(_tables(spark, sf_dir), tables.new_folder(spark, "ledger"), ignored=IGNORED)


def _labels(rows: DataFrame) -> DataFrame:
    known = catalogue(rows.sparkSession).select("category", "check_name", "confidence", "suggested_action")
    return rows.join(F.broadcast(known), ["category", "check_name"], "left")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(_ledger(spark, sf_dir).where("outcome = 'found'"))
    return rows.select("episode_id", "category", "check_name", "key", "metric", "other", "n", "at", "note", "confidence", "suggested_action")


def skipped_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that were passed over, with the reason."""
    return _ledger(spark, sf_dir).where("outcome = 'skipped'").select("episode_id", "category", "check_name", "key", F.col("note").alias("reason"))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.statuses(src.episodes(spark, sf_dir), ledger.bits(_ledger(spark, sf_dir)))


def episode_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.status_counts(_status(spark, sf_dir))


def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ledger(spark, sf_dir)
    return ledger.summary(ledger.statuses(src.episodes(spark, sf_dir), ledger.bits(rows)), rows, catalogue(spark))


def first_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.first_episodes(src.episodes(spark, sf_dir), 25).select("episode_id", "rel_path")


_V = src.as_cte("episodes", "steps", "videos") + """,
  p AS (SELECT *, isfinite(control_freq) AND control_freq > 0 AS good, CASE WHEN control_freq > 0 THEN trajectory_length / control_freq ELSE 'inf'::DOUBLE END AS seconds FROM episodes),
  k AS (SELECT episode_id, grp, key, count(*) AS n, max(len(vals)) AS width, count(*) FILTER (len(list_filter(vals, lambda v: NOT isfinite(v))) > 0) AS bad,
      count(*) FILTER (key = 'cartesian_position' AND len(vals) % 7 = 0 AND abs(sqrt(vals[4] ** 2 + vals[5] ** 2 + vals[6] ** 2 + vals[7] ** 2) - 1) > 1e-2) AS n_off,
      count(*) FILTER (key = 'gripper_binary' AND len(list_filter(vals, lambda v: v NOT IN (0, 1))) > 0) AS n_grip FROM steps GROUP BY ALL),
  kk AS (SELECT k.*, trajectory_length AS tl, CASE WHEN is_biarm THEN 2 ELSE 1 END AS arms, concat(grp, '/', key) AS subject FROM k JOIN episodes USING (episode_id)),
  vv AS (SELECT v.*, trajectory_length AS tl, control_freq, trim(stored_path) AS path, good, abs(frame_count / fps - seconds) AS drift FROM videos v JOIN p USING (episode_id)),
  found AS (""" + " UNION ALL ".join(
    [f"SELECT episode_id, {n} AS rule_order, '{r}' AS rule, '' AS subject FROM p WHERE {w}" for n, r, w in [
        (1, "schema", "schema <> 'episode_format_v1'"), (9, "language_instruction", "trim(language_instruction) = ''"), (10, "lab_id", "trim(lab_id) = '' OR lab_id = 'your_lab_id'"),
        (11, "operator_name", "trim(operator_name) = ''"), (12, "control_freq", "NOT good"), (13, "duration", "good AND (seconds < 1 OR seconds > 600)")]]
    + [f"SELECT episode_id, {n}, '{r}', subject FROM kk WHERE {w}" for n, r, w in [
        (14, "cartesian_width", "key = 'cartesian_position' AND width <> 7 * arms"), (16, "length", "n <> tl"), (17, "not_finite", "bad > 0"), (18, "unit_quaternion", "n_off > 0"), (19, "gripper_binary", "n_grip > 0 OR (key = 'gripper_binary' AND width <> arms)")]]
    + [f"SELECT episode_id, {n}, '{r}', name FROM vv WHERE {w}" for n, r, w in [
        (30, "video_reference_empty", "path = ''"), (31, "video_reference_absolute", "path LIKE '/%'"), (32, "video_reference_escapes", "path LIKE '../../../%'"), (33, "video_missing", "NOT file_exists"),
        (34, "video_side", "least(width, height) < 180 OR greatest(width, height) > 1280"), (35, "video_frames", "abs(frame_count - tl) > greatest(5, floor(0.1e0 * tl))"),
        (36, "video_duration", "good AND drift > 0.5e0"), (38, "video_crf", "crf IS NULL OR crf > 19")]]
    + ["SELECT episode_id, 29, 'no_video', '' FROM episodes WHERE episode_id NOT IN (SELECT episode_id FROM videos)", "SELECT episode_id, 33, 'video_header', name FROM vv WHERE NOT coalesce(width > 0 AND height > 0 AND fps > 0 AND frame_count > 0, false)"]
    + ["SELECT episode_id, 37, 'video_lengths', '' FROM videos GROUP BY episode_id HAVING max(frame_count) - min(frame_count) > 1"]) + ")"
def _sql_list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


_PLACE = DEFAULTS["general"]["placeholder_metadata"]
_PLACEHOLDERS = rec.as_cte("profiles", "episodes") + profile_queries._J + f""", x AS (SELECT episode_id, 'operator_name' AS field, operator_name AS v FROM episodes UNION ALL SELECT episode_id, f, p->>('$.' || f) FROM q, (VALUES ('policy_name'), ('robot_name'), ('gripper_name')) y(f)),
      n AS (SELECT *, regexp_replace(lower(trim(coalesce(v, ''))), '[\\s\\-]+', '_', 'g') AS n FROM x),
      r AS (SELECT episode_id, field, CASE WHEN trim(coalesce(v, '')) = '' THEN 'blank' WHEN n IN ({_sql_list("_" if x == "-" else x for x in _PLACE["placeholder_values"])}) THEN 'placeholder' WHEN {" OR ".join(f"starts_with(n, '{p}')" for p in _PLACE["template_prefixes"])} THEN 'template'
        WHEN field = 'operator_name' AND n IN ({_sql_list(_PLACE["operator_placeholder_values"])}) THEN 'placeholder'
        WHEN field = 'operator_name' AND list_has_any(list_transform(list_filter(regexp_split_to_array(n, '[^a-z0-9]+'), lambda w: w <> ''), lambda w: regexp_replace(w, '[0-9]+$', '')), [{_sql_list(_PLACE["operator_non_person_words"])}]) THEN 'not_a_person' END AS problem FROM n)
      SELECT * FROM r WHERE problem IS NOT NULL"""
_SQLS = {**motion_queries.ORACLE_SQL, **profile_queries.ORACLE_SQL, **pose_queries.ORACLE_SQL, **video_queries.ORACLE_SQL, **filmed_queries.ORACLE_SQL, "placeholder_metadata": _PLACEHOLDERS}
_CATALOGUE = "SELECT * FROM (VALUES " + ", ".join(
    "(" + _sql_list((cat, k, DESCRIPTIONS[k], "high_confidence" if k in HIGH_CONFIDENCE[cat] else "lower_confidence", action_of(cat, k))) + f", {str(DEFAULTS[cat][k]['enabled']).lower()})" for cat, ks in CHECKS.items() for k in ks
) + ") AS c(category, check_name, description, confidence, suggested_action, enabled)"
_OUT = 'metric, other, n, "at", note'
_NO_METRIC = "NULL::DOUBLE AS metric, NULL::DOUBLE AS other, NULL::BIGINT AS n, NULL::BIGINT AS at, NULL::VARCHAR AS note"


def _told(**given: str) -> str:
    return ", ".join(f"{given.get(f, 'NULL')}::{t} AS {f}" for f, t in (("metric", "DOUBLE"), ("other", "DOUBLE"), ("n", "BIGINT"), ("at", "BIGINT"), ("note", "VARCHAR")))


def _declares(key: str) -> str:
    return f"episode_id IN (SELECT episode_id FROM de WHERE key = '{key}')"


_M = motion_queries
#: Declared keys and what is known of them; each part is a query of its own, so that names don't meet.
_KEYS = f"""{_M.METRICS}, sb AS (SELECT episode_id, key, count(*) FILTER (len(list_filter(vals, lambda v: NOT isfinite(v))) > 0) AS s_bad FROM steps WHERE grp = 'state' GROUP BY ALL),
  dk AS (SELECT episode_id, unnest(list_distinct(space)) AS key FROM q)
  SELECT dk.episode_id, dk.key, km.n, n_bad, dim, s_dim, an, cols, top, hz, changes, km.state_range, n_state, span, l_n, s_bad FROM dk LEFT JOIN km ON km.episode_id = dk.episode_id AND km.key = dk.key LEFT JOIN sb ON sb.episode_id = km.episode_id AND sb.key = km.state_key"""
_DECLARED = rec.as_cte("profiles") + profile_queries._J + " SELECT episode_id, unnest(list_distinct(space)) AS key FROM q"
_HAVE = rec.as_cte("profiles", "steps") + profile_queries._J + """, h AS (SELECT episode_id, list(DISTINCT key) FILTER (grp = 'state') AS states, list(DISTINCT key) FILTER (grp = 'action') AS actions FROM steps GROUP BY ALL)
  SELECT q.episode_id, list_distinct(space) AS space, space AS listed, coalesce(h.states, []) AS states, list_sort(coalesce(h.actions, [])) AS actions FROM q LEFT JOIN h USING (episode_id) WHERE len(space) > 0"""
_POSED = pose_queries._ARM + """, sn AS (SELECT episode_id, count(*) AS n_seen FROM steps WHERE grp = 'state' AND key = 'cartesian_position' GROUP BY ALL),
  pz AS (SELECT episode_id, bool_or(zero) AS zero, max(hz) AS hz, max(steps) AS steps FROM m GROUP BY ALL), pn AS (SELECT episode_id, arm, count(sp) AS k FROM pt GROUP BY ALL), pk AS (SELECT episode_id, max(k) AS n_state FROM pn GROUP BY ALL),
  ps AS (SELECT episode_id, bool_and(len(s) % arms = 0 AND len(s) >= 3 * arms) AS placed FROM pr WHERE s IS NOT NULL GROUP BY ALL)
  SELECT sh.episode_id, bad, fits, arms, zero, hz, steps, n_seen, n_state, placed FROM sh LEFT JOIN sn USING (episode_id) LEFT JOIN pz USING (episode_id) LEFT JOIN pk USING (episode_id) LEFT JOIN ps USING (episode_id)"""
_SPED = pose_queries.TRACKED + """, sh AS (SELECT episode_id, bool_or(bad) AS bad, bool_and(len(a) = 6 * arms) AS fits, max(arms) AS arms, max(hz) AS hz FROM pr GROUP BY episode_id),
  sn AS (SELECT episode_id, count(*) AS n_seen FROM steps WHERE grp = 'state' AND key = 'cartesian_position' GROUP BY ALL), pk AS (SELECT episode_id, count(sp) AS n_state FROM pt GROUP BY ALL)
  SELECT sh.*, n_seen, n_state, coalesce(linear_moves, false) AS moves, coalesce(angular_moves, false) AS turns FROM sh LEFT JOIN sn USING (episode_id) LEFT JOIN pk USING (episode_id) LEFT JOIN tr USING (episode_id)"""


def _cover(table: str, category: str, checks: list[tuple[str, str, str]], key: str = "key") -> str:
    return " UNION ALL ".join(f"SELECT episode_id, '{category}' AS category, '{n}' AS check_name, {key} AS key, {r} AS reason FROM {table} WHERE {w}" for n, w, r in checks)


_ARM_KEY = "key IN ('joint_position', 'joint_velocity', 'cartesian_position', 'cartesian_velocity')"
_EMPTY, _BAD = "CASE WHEN n IS NULL THEN 'declared_but_empty'", "WHEN n_bad > 0 THEN 'non_finite_values'"
_STATE = lambda k: f"WHEN l_n IS NULL THEN 'no_matching_state' WHEN s_bad > 0 THEN 'non_finite_state' WHEN n_state = 0 THEN 'no_joint_pairing' WHEN n_state < {k} THEN 'too_short'"
_SOME = f"{_EMPTY} {_BAD} WHEN cols = 0 THEN 'only_gripper_columns'"
_POSE_OK = "CASE WHEN bad IS NULL THEN 'declared_but_empty' WHEN bad THEN 'non_finite_values'"
_POSE_WIDE = f"{_POSE_OK} WHEN NOT fits THEN 'wrong_action_dim' WHEN steps < 2 THEN 'too_short'"
_POSE_SEEN = "WHEN n_seen IS NULL THEN 'no_matching_state' WHEN NOT placed THEN 'unexpected_state_dim' WHEN n_state < 2 THEN 'too_short' END"
_VEL_WIDE = f"{_POSE_OK} WHEN NOT fits THEN 'wrong_action_dim'"
_VEL_SEEN = f"{_VEL_WIDE} WHEN n_seen IS NULL THEN 'no_matching_state' WHEN n_state < 3 * arms THEN 'too_short'"
_VIDEO_ON = [k for k, v in DEFAULTS["video"].items() if v["enabled"]]
_VIDEOS = src.as_cte("episodes", "videos") + " SELECT episode_id, count(name) AS k, count(*) FILTER (file_exists AND fps > 0) AS long FROM episodes LEFT JOIN (SELECT * FROM videos WHERE name <> 'Side_Right') USING (episode_id) GROUP BY ALL"
_IGN = "videos AS (" + src.as_cte("videos").split("videos AS (", 1)[1]


def _part(category: str, sql: str, check: str | None = None, key: str = "key", told: str = _OUT, where: str = "true") -> str:
    return f"SELECT episode_id, '{category}' AS category, " + (f"'{check}' AS check_name" if check else "check_name") + f", {key} AS key, {told} FROM ({sql}) WHERE {where}"


_BOTH = "(episode_id, key) IN (SELECT (episode_id, key) FROM de)"
_FOUND = "de AS (" + _DECLARED + "), hv AS (" + _HAVE + "), fi AS (" + " UNION ALL ".join([
    _part("general", _SQLS["general_checks"], where=f"check_name NOT IN ('scale_consistency', 'tracking_residual', 'delta_detection') AND {_BOTH}"),
    _part("joint_position", _SQLS["joint_position_checks"], where=_BOTH), _part("joint_velocity", _SQLS["joint_velocity_checks"], where=_BOTH),
    _part("general", _SQLS["command_rate"], "command_rate", told=_told(metric="period", other="effective_hz", n="n_holds"), where=_BOTH),
    _part("general", _SQLS["duplicate_pairs"], "duplicate_pairs", "concat(key_a, '+', key_b)", _told(metric="max_abs_diff"), "(episode_id, key_a) IN (SELECT (episode_id, key) FROM de) AND (episode_id, key_b) IN (SELECT (episode_id, key) FROM de)"),
    _part("general", """SELECT episode_id, k AS key, CASE WHEN len(who) > 0 THEN array_to_string(who, ',') ELSE 'always required' END AS note FROM (SELECT episode_id, states, k,
        list_filter(listed, lambda x: (k = 'joint_position' AND x IN ('joint_position', 'joint_velocity')) OR (k = 'cartesian_position' AND x IN ('cartesian_position', 'cartesian_velocity'))) AS who
        FROM hv, (VALUES ('joint_position'), ('cartesian_position'), ('gripper_position')) v(k)) WHERE NOT list_contains(states, k) AND (k = 'gripper_position' OR len(who) > 0)""", "required_state_keys", told=_told(note="note")),
    _part("general", "SELECT episode_id, 'gripper_binary' AS key, array_to_string(list_filter(listed, lambda x: starts_with(x, 'gripper')), ',') || ';' || array_to_string(list_filter(actions, lambda x: starts_with(x, 'gripper')), ',') AS note FROM hv WHERE NOT list_contains(actions, 'gripper_binary')", "gripper_binary_present", told=_told(note="note")),
    _part("general", _SQLS["chunked_actions"], told=_told(n="ndim"), where=_BOTH), _part("general", _PLACEHOLDERS, "placeholder_metadata", "field", _told(note="problem")),
    _part("joint_position", _SQLS["joint_name_checks"], "joint_names", "'joint_position'", _told(note="problem"), _declares("joint_position")),
    _part("cartesian_position", _SQLS["cartesian_position_checks"], where=f"check_name NOT IN ('quaternion_sign_flip', 'quaternion_scalar_order') AND {_declares('cartesian_position')}"),
    _part("cartesian_position", _SQLS["biarm_ordering"], "biarm_ordering", "'cartesian_position'", _told(metric="ratio"), _declares("cartesian_position")),
    _part("cartesian_velocity", _SQLS["cartesian_velocity_checks"], where=_declares("cartesian_velocity")), _part("cartesian_velocity", _SQLS["velocity_tracking"], where=_declares("cartesian_velocity")),
    _part("video", _SQLS["video_container_checks"], told=_told(metric="metric"), where="check_name <> 'resolution' AND key <> 'Side_Right'"),
    _part("video", "WITH v AS (SELECT * FROM (" + src.as_cte("videos") + " SELECT * FROM videos) WHERE name <> 'Side_Right') SELECT episode_id, round(max(decoded_frames / fps) - min(decoded_frames / fps), 6) AS gap FROM v GROUP BY ALL HAVING count(*) > 1 AND max(decoded_frames / fps) - min(decoded_frames / fps) > 0.5e0", "camera_duration_mismatch", "'all'", _told(metric="gap")),
    _part("video", _SQLS["glitched_frames"], "corrupted_frames", "camera", _told(at="frame")), _part("video", _SQLS["state_and_camera_jumps"], key="'all'", told=_told(at="t", note="nullif(cameras, '')")),
    _part("video", _SQLS["camera_jumps"], "video_jump", "camera", _told(metric="time_s", at="frame")), _part("video", _SQLS["still_frames"], key="camera", told=_told(metric="metric")),
    _part("video", _SQLS["periodic_skips"], "periodic_skips", "'all'", _told(metric="confirmed", n="jumps", at="period")),
]) + f"), ca AS ({_CATALOGUE}), la AS (SELECT fi.*, confidence, suggested_action FROM fi LEFT JOIN ca USING (category, check_name))"
_COVER = f"kd AS ({_KEYS}), pd AS (SELECT p.*, de.episode_id FROM de LEFT JOIN ({_POSED}) p ON p.episode_id = de.episode_id WHERE key = 'cartesian_position'), vd AS (SELECT p.*, de.episode_id FROM de LEFT JOIN ({_SPED}) p ON p.episode_id = de.episode_id WHERE key = 'cartesian_velocity'), vi AS ({_VIDEOS}), ar AS ({rec.as_cte('arrays')} SELECT * FROM arrays), ep AS ({src.as_cte('episodes')} SELECT * FROM episodes), vs AS ({src.as_cte('videos')} SELECT * FROM videos), co AS (" + " UNION ALL ".join([
    _cover("kd", "general", [
        ("constant_action", f"{_ARM_KEY} AND n IS NOT NULL", f"CASE WHEN n < 2 THEN 'too_short' {_BAD} END"), ("command_rate", f"{_ARM_KEY} AND n IS NOT NULL", f"CASE WHEN n < 2 THEN 'too_short' {_BAD} WHEN changes < 10 THEN 'too_few_changes' END"),
        ("length_mismatch", "n IS NOT NULL AND l_n IS NOT NULL", "NULL"),
        ("action_copies_state", "key IN ('joint_position', 'cartesian_position') AND n IS NOT NULL AND l_n IS NOT NULL", "CASE WHEN s_dim IS NULL OR dim <> s_dim THEN 'feature_dim_mismatch' WHEN n_bad > 0 OR s_bad > 0 THEN 'non_finite_values' WHEN coalesce(state_range, 0) <= 1e-6 THEN 'state_static' END"),
        ("gripper_range", "key = 'gripper_binary'", f"{_EMPTY} {_BAD} END"), ("gripper_command_range", "key = 'gripper_position'", f"{_EMPTY} WHEN l_n IS NULL THEN 'no_matching_state' WHEN n_bad > 0 OR s_bad > 0 THEN 'non_finite_values' END")]),
    _cover("hv", "general", [("duplicate_pairs", "len(space) >= 2", "NULL"), ("required_state_keys", "true", "NULL"), ("gripper_binary_present", "true", "NULL")], "'all'"),
    _cover("ar", "general", [("action_chunk_shape", f"grp = 'action' AND NOT is_empty AND {_ARM_KEY} AND {_BOTH}", "NULL")]), _cover("ep", "general", [("placeholder_metadata", "true", "NULL")], "'all'"),
    _cover("kd", "joint_position", [(n, "key = 'joint_position'", r) for n, r in [
        ("joint_names", "NULL"), ("dof", f"{_EMPTY} {_BAD} END"), ("gripper_in_joints", f"{_EMPTY} {_BAD} WHEN an <> dim THEN 'no_usable_joint_names' END"), ("normalized_range", f"{_SOME} END"), ("radians", f"{_SOME} END"),
        ("step_jump", f"{_SOME} WHEN top > 6.5e0 THEN 'not_radians' WHEN hz IS NULL THEN 'no_control_freq' WHEN n < 2 THEN 'too_short' END"), ("delta_detection", f"{_SOME} {_STATE(2)} END"), ("tracking", f"{_SOME} {_STATE(2)} WHEN top > 6.5e0 THEN 'not_radians' END")]]),
    _cover("kd", "joint_velocity", [(n, "key = 'joint_velocity'", r) for n, r in [
        *((x, f"{_EMPTY} {_BAD} END") for x in ("dof", "speed_limit", "normalized_range", "smoothness")), ("looks_like_position", f"{_EMPTY} {_BAD} {_STATE(3)} END"),
        ("tracking", f"{_EMPTY} {_BAD} {_STATE(3)} WHEN hz IS NULL THEN 'no_control_freq' WHEN coalesce(span, 0) < 0.2e0 THEN 'too_little_motion' END")]]),
    _cover("pd", "cartesian_position", [
        ("quaternion_shape", "true", f"{_POSE_OK} END"), ("normalized_range", "true", f"{_POSE_WIDE} END"), ("position_units", "true", f"{_POSE_WIDE} END"),
        ("rotation_jump", "true", f"{_POSE_WIDE} WHEN zero THEN 'zero_quaternion' WHEN hz IS NULL THEN 'no_control_freq' END"), ("pose_tracking", "true", f"{_POSE_WIDE} WHEN zero THEN 'zero_quaternion' {_POSE_SEEN}"),
        ("delta_detection", "true", f"{_POSE_WIDE} {_POSE_SEEN}"), ("biarm_ordering", "coalesce(arms, 2) = 2", f"{_POSE_WIDE} {_POSE_SEEN}")], "'cartesian_position'"),
    _cover("vd", "cartesian_velocity", [
        ("shape", "true", f"{_POSE_OK} END"), *((x, "true", f"{_VEL_WIDE} END") for x in ("speed_limit", "normalized_range", "smoothness")), ("looks_like_position", "true", f"{_VEL_SEEN} END"),
        ("tracking", "true", f"{_VEL_SEEN} WHEN hz IS NULL THEN 'no_control_freq' WHEN NOT moves AND NOT turns THEN 'too_little_motion' END"),
        ("linear_angular_order", "true", f"{_VEL_SEEN} WHEN hz IS NULL THEN 'no_control_freq' WHEN NOT moves OR NOT turns THEN 'too_little_motion' END")], "'cartesian_velocity'"),
    _cover("vi", "video", [(x, "true", "CASE WHEN k = 0 THEN 'no_video_files'" + (" WHEN long < 2 THEN 'fewer_than_two_cameras'" if x == "camera_duration_mismatch" else "") + " END") for x in _VIDEO_ON], "'all'"),
    _cover("vs", "video", [(x, "name = 'Side_Right'", "'ignored_camera'") for x in _VIDEO_ON], "name"),
]) + ")"
_NAMED = [(f"{k}.{x}", i) for (k, x), i in ledger.BITS.items()]
_SETS = f"""WITH {_FOUND}, {_COVER}, bi AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {i}, {1 << i}::BIGINT)" for n, i in _NAMED)}) b(name, i, bit)),
  oc AS (SELECT episode_id, concat(category, '.', check_name) AS name, CASE WHEN reason IS NULL THEN 'ran' ELSE 'skipped' END AS outcome FROM co UNION ALL SELECT episode_id, concat(category, '.', check_name), 'found' FROM fi),
  se AS (SELECT episode_id, coalesce(bit_or(bit) FILTER (outcome = 'ran'), 0) AS ran, coalesce(bit_or(bit) FILTER (outcome = 'skipped'), 0) AS skipped, coalesce(bit_or(bit) FILTER (outcome = 'found'), 0) AS found, count(*) FILTER (outcome = 'found') AS n_findings FROM oc JOIN bi USING (name) GROUP BY ALL),
  fl AS (SELECT episode_id, string_agg(DISTINCT concat(category, '.', check_name), ',' ORDER BY concat(category, '.', check_name)) AS flagged, count(DISTINCT concat(category, '.', check_name)) AS n_flags FROM la WHERE suggested_action <> 'informational' GROUP BY episode_id),
  es AS (SELECT episode_id, CASE WHEN read_error IS NOT NULL THEN 'error' WHEN flagged IS NOT NULL THEN 'flagged' WHEN ran <> 0 THEN 'clean' ELSE 'not_checked' END AS status, coalesce(flagged, '') AS flagged, bit_count(ran)::BIGINT AS n_ran, bit_count(skipped)::BIGINT AS n_skipped,
    n_findings, ran, skipped, found, coalesce(n_flags, 0) AS n_flags FROM ep LEFT JOIN se USING (episode_id) LEFT JOIN fl USING (episode_id))"""

QUERIES = {
    "violations": violations,
    "verdicts": verdicts,
    "declared_keys": declared_keys,
    "placeholder_metadata": placeholder_metadata,
    "bad_values": bad_values,
    "bad_quaternions": bad_quaternions,
    "validation_totals": validation_totals,
    "findings": findings,
    "status_counts": status_counts,
    "first_episodes": first_episodes,
    "episode_status": episode_status,
    "check_summary": check_summary,
    "skipped_checks": skipped_checks,
}
ORACLE_SQL = {
    "violations": _V + " SELECT * FROM found",
    "verdicts": _V + """, o AS (SELECT episode_id, count(*) AS n, arg_min(rule, (rule_order, rule, subject)) AS first_rule FROM found WHERE rule <> 'video_crf' GROUP BY episode_id)
      SELECT episode_id, n IS NULL AS passed, coalesce(n, 0) AS n_violations, first_rule FROM episodes LEFT JOIN o USING (episode_id)""",
    "declared_keys": src.as_cte("episodes", "steps") + """, w AS (SELECT episode_id, x.g AS grp, x.k AS key FROM episodes, (VALUES ('state', 'joint_position'), ('state', 'gripper_position'), ('action', 'joint_position'),
        ('action', 'gripper_binary'), ('action', 'base_position')) x(g, k)), h AS (SELECT DISTINCT episode_id, grp, key FROM steps)
      SELECT episode_id, 20 AS rule_order, 'declared_missing' AS rule, concat(grp, '/', key) AS subject FROM (SELECT * FROM w EXCEPT SELECT * FROM h)
      UNION ALL SELECT episode_id, 21, 'not_declared', concat(grp, '/', key) FROM (SELECT * FROM h EXCEPT SELECT * FROM w)""",
    "placeholder_metadata": _PLACEHOLDERS,
    "bad_values": src.as_cte("steps") + """, x AS (SELECT episode_id, grp, key, t, vals, unnest(range(1, len(vals) + 1)) AS d FROM steps), y AS (SELECT *, vals[d] AS v FROM x WHERE NOT isfinite(vals[d]))
      SELECT episode_id, grp, key, count(*) AS n_values, arg_min(t, (t, d)) AS first_t, arg_min(d, (t, d)) - 1 AS first_d, CASE WHEN isnan(arg_min(v, (t, d))) THEN 'nan' WHEN arg_min(v, (t, d)) > 0 THEN 'inf' ELSE '-inf' END AS value FROM y GROUP BY episode_id, grp, key""",
    "bad_quaternions": pose_queries._BASE + """, x AS (SELECT episode_id, grp, key, t, vals, unnest(range(1, len(vals) // 7 + 1)) AS arm FROM steps WHERE key = 'cartesian_position' AND len(vals) % 7 = 0),
      y AS (SELECT *, sqrt(vals[7 * arm - 3] ** 2 + vals[7 * arm - 2] ** 2 + vals[7 * arm - 1] ** 2 + vals[7 * arm] ** 2) AS norm FROM x)
      SELECT episode_id, grp, key, arm, count(*) AS n, min(t) AS first_t, round(arg_min(norm, t), 6) AS norm FROM y WHERE abs(norm - 1) > 1e-2 GROUP BY episode_id, grp, key, arm""",
    "validation_totals": _V + """, b AS (SELECT DISTINCT episode_id FROM found WHERE rule <> 'video_crf')
      SELECT count(*) AS n, count(*) FILTER (episode_id NOT IN (SELECT episode_id FROM b)) AS passed, count(*) FILTER (episode_id IN (SELECT episode_id FROM b)) AS failed FROM episodes""",
    "findings": f"WITH {_FOUND} SELECT episode_id, category, check_name, key, metric, other, n, \"at\", note, confidence, suggested_action FROM la",
    "skipped_checks": f"WITH {_FOUND}, {_COVER} SELECT * FROM co WHERE reason IS NOT NULL",
    "episode_status": _SETS + " SELECT * EXCLUDE (n_flags) FROM es",
    "status_counts": _SETS + " SELECT status, count(*) AS n, sum(n_flags)::BIGINT AS n_flagged_checks, sum(n_findings)::BIGINT AS n_findings FROM es GROUP BY status",
    "check_summary": _SETS + """, ok AS (SELECT oc.* FROM oc JOIN ep USING (episode_id) WHERE read_error IS NULL), p AS (SELECT name, count(DISTINCT episode_id) FILTER (outcome = 'ran') AS ran, count(DISTINCT episode_id) FILTER (outcome = 'skipped') AS skipped, count(DISTINCT episode_id) FILTER (outcome = 'found') AS e FROM ok GROUP BY ALL),
      f AS (SELECT name, count(*) AS n FROM oc WHERE outcome = 'found' GROUP BY ALL)
      SELECT category, check_name, description, confidence, suggested_action, enabled, coalesce(ran, 0) AS ran, coalesce(skipped, 0) AS skipped, coalesce(e, 0) AS episodes, coalesce(n, 0) AS findings, '{}' AS overrides
      FROM ca LEFT JOIN p ON p.name = concat(category, '.', check_name) LEFT JOIN f ON f.name = concat(category, '.', check_name)""",
    "first_episodes": src.as_cte("episodes") + " SELECT episode_id, rel_path FROM episodes ORDER BY rel_path LIMIT 25",
}
