"""Registered queries on robot profiles and stored arrays, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.operators import profiles as ops
from tendon.sources import episodes as src
from tendon.sources import recordings as rec


def header_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.header_violations(rec.headers(spark, sf_dir), rec.profiles(spark, sf_dir))


def profile_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.profile_violations(rec.profiles(spark, sf_dir))


def content_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.content_violations(rec.profiles(spark, sf_dir), rec.arrays(spark, sf_dir), src.videos(spark, sf_dir).where("episode_id % 18 <> 4"))


def writer_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.key_sets(rec.profiles(spark, sf_dir), rec.arrays(spark, sf_dir))


def joint_name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = rec.arrays(spark, sf_dir).where("grp = 'state' and key = 'joint_position' and not is_empty")
    return ops.joint_names(rec.tolerant(rec.profiles(spark, sf_dir)), states)


def joint_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rec.tolerant(rec.profiles(spark, sf_dir)).select("episode_id", rec.names_or_none(F.col("p.action_joint_names")).alias("a"), rec.names_or_none(F.col("p.robot_state_joint_names")).alias("s"))
    pairs = ops.joint_pairs(F.col("a"), F.col("s"), F.when(F.col("episode_id") % 5 == 0, F.lit(6)).otherwise(F.lit(7)), F.lit(7))
    return rows.select("episode_id", F.array_join(pairs.cast("array<string>"), ",").alias("pairs"))


def array_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes, types and sizes of stored arrays, with each episode's length: the rows of its first state by name."""
    a = rec.arrays(spark, sf_dir)
    length = a.where("grp = 'state'").groupBy("episode_id").agg(F.min_by("n", "key").alias("trajectory_length"))
    shape = F.when(F.col("is_empty") | (F.col("ndim") == 0), "").when(F.col("ndim") == 1, F.col("n").cast("string")).otherwise(F.concat_ws("x", "n", F.when(F.col("ndim") == 3, "1"), "width"))
    return a.join(length, "episode_id", "left").select("episode_id", "grp", "key", "dtype", shape.alias("shape"), "is_empty", "n_bytes", "trajectory_length")


def chunked_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = list(ops.ARM_ACTIONS)
    return rec.arrays(spark, sf_dir).where((F.col("grp") == "action") & F.col("key").isin(*arm) & ~F.col("is_empty") & (F.col("ndim") > 2)).select("episode_id", F.lit("action_chunk_shape").alias("check_name"), "key", "ndim")


_J = """, j AS (SELECT episode_id, CASE WHEN json_valid(profile) AND json_type(profile) = 'OBJECT' THEN profile::JSON END AS p FROM profiles),
  q AS (SELECT episode_id, p, json_keys(p) AS keys, CAST(p->'$.action_space' AS VARCHAR[]) AS space, CAST(p->'$.robot_state_keys' AS VARCHAR[]) AS states, CAST(p->'$.camera_names' AS VARCHAR[]) AS cameras,
    coalesce(CAST(p->'$.action_joint_names' AS VARCHAR[]), []) AS an, coalesce(CAST(p->'$.robot_state_joint_names' AS VARCHAR[]), []) AS sn, p->>'$.is_biarm' = 'true' AS biarm,
    p->>'$.uses_mobile_base' = 'true' AS mobile, p->'$.additional_data' AS extra FROM j),
  se0 AS (SELECT episode_id, cameras, extra, unnest(json_keys(extra)) AS key, generate_subscripts(json_keys(extra), 1) AS i FROM q WHERE p IS NOT NULL),
  se AS (SELECT *, extra->('$."' || key || '"') AS entry FROM se0),
  sf AS (SELECT *, coalesce(nullif(entry->>'$.format', ''), 'array') AS format, trim(coalesce(entry->>'$.sensor', '')) AS sensor, row_number() OVER (PARTITION BY episode_id, lower(key) ORDER BY i) AS nth FROM se)"""
_ARM = "['cartesian_position', 'cartesian_velocity', 'joint_position', 'joint_velocity']"
_GRIP = "['gripper_binary', 'gripper_position', 'gripper_velocity']"
_BASE = "['base_position', 'base_velocity']"
_REQ = "['action_space', 'camera_names', 'control_freq', 'gripper_name', 'is_biarm', 'policy_name', 'robot_name', 'robot_state_keys', 'uses_mobile_base']"
_NEED = """list_filter(list_distinct(['gripper_position'] || CASE WHEN list_has_any(space, ['joint_position', 'joint_velocity']) THEN ['joint_position'] ELSE [] END
    || CASE WHEN list_has_any(space, ['cartesian_position', 'cartesian_velocity']) THEN ['cartesian_position'] ELSE [] END), lambda k: NOT list_contains(states, k))"""
_MISS = f"list_filter({_REQ}, lambda k: NOT list_contains(keys, k))"
_COUNT = lambda xs: f"len(list_filter(list_distinct(space), lambda k: list_contains({xs}, k)))"
_HAS = f"p IS NOT NULL AND len({_MISS}) = 0"


def _one(n: int, rule: str, subject: str, table: str, where: str) -> str:
    return f"SELECT episode_id, {n} AS rule_order, '{rule}' AS rule, CAST({subject} AS VARCHAR) AS subject FROM {table} WHERE {where}"


_DECLARED = """, w AS (SELECT DISTINCT * FROM (SELECT episode_id, 'state' AS grp, unnest(states) AS key, 'array' AS format FROM q WHERE p IS NOT NULL UNION ALL SELECT episode_id, 'action', unnest(space), 'array' FROM q WHERE p IS NOT NULL
    UNION ALL SELECT episode_id, 'camera', unnest(cameras), 'video' FROM q WHERE p IS NOT NULL UNION ALL SELECT episode_id, 'additional', key, format FROM sf))"""
_CONTENT = rec.as_cte("profiles", "arrays", "videos") + _J + _DECLARED + """,
  h AS (SELECT episode_id, grp, key FROM arrays UNION SELECT episode_id, 'camera', name FROM videos WHERE episode_id % 18 <> 4),
  t AS (SELECT episode_id, arg_min(n, key) AS t FROM arrays WHERE grp = 'state' GROUP BY episode_id),
  f AS (SELECT a.*, w.format, q.biarm, q.an, q.sn, t.t, concat(a.grp, '/', a.key) AS subject, CASE WHEN biarm THEN 2 ELSE 1 END AS arms, a.grp IN ('state', 'action') AS motion, dtype = 'text' AS is_text
    FROM arrays a LEFT JOIN w ON w.episode_id = a.episode_id AND w.grp = a.grp AND w.key = a.key LEFT JOIN q ON q.episode_id = a.episode_id LEFT JOIN t ON t.episode_id = a.episode_id),
  s AS (SELECT episode_id, sum(n_bytes) AS total, string_agg(concat(key, '=', printf('%.1f', n_bytes / 1048576), ' MiB'), ', ' ORDER BY n_bytes DESC, key) AS parts FROM arrays WHERE grp = 'additional' AND NOT is_empty AND dtype <> 'text' GROUP BY episode_id)
"""

QUERIES = {f.__name__: f for f in (header_violations, profile_violations, content_violations, writer_key_sets, joint_name_checks, joint_pairing, array_structure, chunked_actions)}
ORACLE_SQL = {
    "header_violations": rec.as_cte("profiles", "headers") + ", h AS (SELECT headers.*, profile FROM headers LEFT JOIN profiles USING (episode_id)) " + " UNION ALL ".join(
        [_one(2, "missing_attribute", f"'{x}'", "h", f"{x} IS NULL") for x in ops.HEADER] + [_one(9, "empty_name", "''", "h", "trim(name) = ''")]),
    "profile_violations": rec.as_cte("profiles") + _J + " " + " UNION ALL ".join([
        _one(5, "profile_json", "''", "q", "p IS NULL"), _one(5, "profile_keys", f"array_to_string({_MISS}, ',')", "q", f"p IS NOT NULL AND len({_MISS}) > 0"),
        _one(5, "action_space", "array_to_string(space, ',')", "q", f"{_HAS} AND NOT ({_COUNT(_ARM)} >= 1 AND {_COUNT(_GRIP)} >= 1 AND {_COUNT(_BASE)} <= 1 AND {_COUNT(_ARM)} + {_COUNT(_GRIP)} + {_COUNT(_BASE)} = len(list_distinct(space)))"),
        _one(5, "required_states", f"array_to_string(list_sort({_NEED}), ',')", "q", f"{_HAS} AND len({_NEED}) > 0"),
        _one(5, "state_joint_names", "''", "q", f"{_HAS} AND list_contains(states, 'joint_position') AND len(sn) = 0"),
        _one(5, "action_joint_names", "''", "q", f"{_HAS} AND list_has_any(space, ['joint_position', 'joint_velocity']) AND len(an) = 0"),
        _one(5, "mobile_base", "''", "q", f"{_HAS} AND mobile AND {_COUNT(_BASE)} = 0"),
        _one(6, "sensor_key", "key", "sf", "NOT regexp_full_match(key, '[A-Za-z0-9_-]+')"),
        _one(6, "sensor_collision", "key", "sf", "nth > 1 OR list_contains(list_transform(cameras, lambda x: lower(x)), lower(key))"),
        _one(6, "sensor_fields", "key", "sf", "len(list_filter(json_keys(entry), lambda k: k NOT IN ('format', 'sensor', 'sensor_info'))) > 0"),
        _one(6, "sensor_name", "key", "sf", "sensor = ''"), _one(6, "sensor_format", "key", "sf", "format NOT IN ('array', 'video')")]),
    "content_violations": _CONTENT + " UNION ALL ".join([
        _one(3, "missing_group", "g", "(SELECT profiles.episode_id, g FROM profiles, (VALUES ('state'), ('action'), ('camera')) x(g))", "(episode_id, g) NOT IN (SELECT (episode_id, grp) FROM h)"),
        _one(12, "declared_missing", "concat(grp, '/', key)", "(SELECT episode_id, grp, key FROM w EXCEPT SELECT * FROM h)", "true"),
        _one(13, "not_declared", "concat(grp, '/', key)", "(SELECT * FROM h WHERE grp <> 'camera' EXCEPT SELECT episode_id, grp, key FROM w)", "episode_id IN (SELECT episode_id FROM q WHERE p IS NOT NULL)"),
        _one(4, "declared_empty", "subject", "f", "grp = 'action' AND is_empty AND format IS NOT NULL"), _one(8, "additional_empty", "subject", "f", "grp = 'additional' AND is_empty"),
        _one(8, "additional_reference", "subject", "f", "grp = 'additional' AND NOT is_empty AND format = 'video' AND NOT is_text"),
        _one(14, "cartesian_width", "subject", "f", "motion AND NOT is_empty AND key = 'cartesian_position' AND ndim >= 2 AND biarm IS NOT NULL AND width <> 7 * arms"),
        _one(15, "joint_names", "subject", "f", "NOT is_empty AND biarm IS NOT NULL AND ((grp = 'state' AND key = 'joint_position' AND len(sn) <> width) OR (grp = 'action' AND key IN ('joint_position', 'joint_velocity') AND len(an) > 0 AND len(an) <> width))"),
        _one(16, "length", "subject", "f", "motion AND NOT is_empty AND n <> t"),
        _one(19, "gripper_channels", "subject", "f", "motion AND NOT is_empty AND key = 'gripper_binary' AND biarm IS NOT NULL AND (ndim NOT IN (1, 2) OR width <> arms)"),
        _one(20, "additional_infinite", "subject", "f", "grp = 'additional' AND NOT is_empty AND NOT is_text AND n_inf > 0"),
        _one(20, "additional_length", "subject", "f", "grp = 'additional' AND NOT is_empty AND NOT is_text AND format <> 'video' AND (ndim = 0 OR n <> t)"),
        _one(21, "additional_bytes", "parts", "s", "total > 104857600")]),
    "writer_key_sets": rec.as_cte("profiles", "arrays") + _J + _DECLARED + """, x AS (SELECT episode_id, grp, list(DISTINCT key) AS ks FROM w WHERE grp <> 'camera' GROUP BY ALL),
      y AS (SELECT episode_id, grp, list(DISTINCT key) AS ks FROM arrays WHERE episode_id IN (SELECT episode_id FROM q WHERE p IS NOT NULL) GROUP BY ALL),
      z AS (SELECT episode_id, grp, array_to_string(list_sort(list_filter(coalesce(x.ks, []), lambda k: NOT list_contains(coalesce(y.ks, []), k))), ',') AS missing,
        array_to_string(list_sort(list_filter(coalesce(y.ks, []), lambda k: NOT list_contains(coalesce(x.ks, []), k))), ',') AS extra FROM x FULL JOIN y USING (episode_id, grp)) SELECT * FROM z WHERE missing <> '' OR extra <> ''""",
    "joint_name_checks": rec.as_cte("profiles", "arrays") + _J + """, b AS (SELECT episode_id, coalesce(biarm, false) AS biarm, an, sn FROM q),
      l AS (SELECT episode_id, 'action' AS lst, unnest(an) AS name, generate_subscripts(an, 1) AS i FROM b UNION ALL SELECT episode_id, 'state', unnest(sn), generate_subscripts(sn, 1) FROM b),
      m AS (SELECT *, lower(name) AS low, CASE WHEN regexp_matches(lower(name), '(^|[^a-z])(left|l)([^a-z]|$)') THEN 'left' WHEN regexp_matches(lower(name), '(^|[^a-z])(right|r)([^a-z]|$)') THEN 'right' ELSE '' END AS side,
        try_cast(regexp_extract(name, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS number, regexp_replace(name, '[0-9]+([^0-9]*)$', '#\\1') AS pat FROM l),
      r AS (SELECT *, CASE """ + " ".join(f"WHEN contains(low, '{k}') THEN {v}" for k, v in ops.CHAIN.items()) + """ END AS rank FROM m),
      v AS (SELECT *, max(rank) OVER (PARTITION BY episode_id, lst, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top_rank,
        last_value(rank IGNORE NULLS) OVER (PARTITION BY episode_id, lst, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_rank FROM r),
      o AS (SELECT episode_id, lst, number <= lag(number) OVER (PARTITION BY episode_id, lst, side, pat ORDER BY i) AS bad FROM r WHERE number IS NOT NULL)
      SELECT DISTINCT episode_id, concat(lst, '_blank_names') AS problem FROM v WHERE trim(name) = '' UNION ALL SELECT episode_id, concat(lst, '_duplicate_names') FROM v GROUP BY episode_id, lst HAVING count(DISTINCT name) < count(*)
      UNION ALL SELECT DISTINCT episode_id, concat(lst, '_numbering_out_of_order') FROM o WHERE bad UNION ALL SELECT DISTINCT episode_id, concat(lst, '_chain_out_of_order') FROM v WHERE rank < last_rank
      UNION ALL SELECT episode_id, 'missing_action_names' FROM b WHERE len(an) = 0
      UNION ALL SELECT episode_id, 'missing_state_names' FROM b WHERE len(sn) = 0 AND episode_id IN (SELECT episode_id FROM arrays WHERE grp = 'state' AND key = 'joint_position' AND NOT is_empty)
      UNION ALL SELECT episode_id, 'action_names_not_in_state' FROM b WHERE len(an) > 0 AND len(sn) > 0 AND len(list_filter(an, lambda x: NOT list_contains(sn, x))) > 0
      UNION ALL SELECT episode_id, 'reordered_vs_state' FROM b WHERE len(an) > 0 AND len(sn) > 0 AND len(list_filter(an, lambda x: NOT list_contains(sn, x))) = 0 AND list_filter(sn, lambda x: list_contains(an, x)) <> an
      UNION ALL SELECT episode_id, 'biarm_sides_not_named' FROM b WHERE biarm AND len(an) > 0 AND (SELECT count(DISTINCT side) FROM m WHERE m.episode_id = b.episode_id AND lst = 'action' AND side <> '') < 2""",
    "joint_pairing": rec.as_cte("profiles") + _J + """, b AS (SELECT episode_id, an, sn, CASE WHEN episode_id % 5 = 0 THEN 6 ELSE 7 END AS aw FROM q)
      SELECT episode_id, CASE WHEN len(an) = aw AND len(sn) = 7 AND len(list_distinct(sn)) = 7 AND len(list_filter(an, lambda x: NOT list_contains(sn, x))) = 0 THEN array_to_string(list_transform(an, lambda x: list_position(sn, x) - 1), ',')
        WHEN aw = 7 THEN '0,1,2,3,4,5,6' END AS pairs FROM b""",
    "array_structure": rec.as_cte("arrays") + """, t AS (SELECT episode_id, arg_min(n, key) AS trajectory_length FROM arrays WHERE grp = 'state' GROUP BY episode_id)
      SELECT episode_id, grp, key, dtype, CASE WHEN is_empty OR ndim = 0 THEN '' WHEN ndim = 1 THEN n::VARCHAR WHEN ndim = 3 THEN concat(n, 'x1x', width) ELSE concat(n, 'x', width) END AS shape, is_empty, n_bytes, trajectory_length
      FROM arrays LEFT JOIN t USING (episode_id)""",
    "chunked_actions": rec.as_cte("arrays") + f" SELECT episode_id, 'action_chunk_shape' AS check_name, key, ndim FROM arrays WHERE grp = 'action' AND list_contains({_ARM}, key) AND NOT is_empty AND ndim > 2",
}
