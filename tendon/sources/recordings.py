"""Tables of what recordings hold beside their steps: robot profiles, headers and stored arrays, derived from ``events``.

As in ``episodes``, the SQL is the part that Spark and other engines read alike, and defects are planted by the
episode's number. Readers turn stored text into typed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.sources import episodes as src

# The keys that a profile must and may have.
PROFILE = (
    "policy_name string, robot_name string, gripper_name string, control_freq double, is_biarm boolean, uses_mobile_base boolean, camera_names array<string>,"
    " robot_state_keys array<string>, action_space array<string>, action_joint_names array<string>, robot_state_joint_names array<string>,"
    " orientation_representation string, robot_state_orientation_representation string, additional_data map<string, string>"
)
SENSOR = "sensor string, format string"

_USERS = "u AS (SELECT user_id AS e, count(*) AS n FROM {events} GROUP BY user_id)"


def _names(names: list[str]) -> str:
    return "[" + ", ".join(f'"{x}"' for x in names) + "]"


_PLAIN = [f"joint{i}" for i in range(1, 8)]
_CHAIN = ["shoulder_pan", "shoulder_lift", "elbow", "forearm_roll", "wrist_angle", "wrist_2", "wrist_rotate"]
#: Joint names of actions and of states, by the episode's number modulo 12.
_JOINTS: dict[int, tuple[list[str], list[str]]] = {
    3: ([], _PLAIN),
    4: (_PLAIN, [_PLAIN[1], _PLAIN[0], *_PLAIN[2:]]),
    5: (["jointX", *_PLAIN[1:]], _PLAIN),
    6: (sorted(_CHAIN), _CHAIN),
    7: (["joint2", "joint1", *_PLAIN[2:]], _PLAIN),
    8: (["a", "a", " ", "b", "c", "d", "e"], _PLAIN),
    9: ([*_PLAIN[:6], "gripper"], [*_PLAIN[:6], "gripper"]),
    10: (_PLAIN[:6], _PLAIN[:5]),
    11: (["left_joint1", "left_joint2", "left_joint3", "right_joint1", "right_joint2", "right_joint3", "right_joint4"], _PLAIN),
}
_SPACE = ["joint_position", "joint_velocity", "cartesian_position", "cartesian_velocity", "gripper_position", "gripper_velocity", "gripper_binary"]
_STATES = ["joint_position", "gripper_position", "cartesian_position"]


def _case(on: str, rows: dict[int, str], other: str) -> str:
    return f"CASE {on} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in rows.items()) + f" ELSE '{other}' END"


def profiles_sql() -> str:
    """``profiles(episode_id, profile)``: the profile as it is stored, JSON for the most part."""
    sensors = {
        1: '{"touch": {"sensor": "skin"}}', 2: '{"Front": {"sensor": "lidar"}}', 3: '{"bad key!": {"sensor": "s"}}', 4: '{"depth": {"sensor": " "}}',
        5: '{"depth": {"sensor": "d", "format": "audio"}}', 6: '{"depth": {"sensor": "d", "colour": "red"}}', 7: '{"tac": {"sensor": "t", "format": "video"}, "TAC": {"sensor": "u"}}',
    }
    parts = [
        ("policy_name", f"""concat('"', {_case("e % 7", {1: "TODO", 2: "your_policy_name", 3: "my-policy"}, "policy a")}, '"')"""),
        ("robot_name", f"""concat('"', {_case("e % 9", {1: "robot", 2: "default", 3: ""}, "arm seven")}, '"')"""),
        ("gripper_name", f"""concat('"', {_case("e % 11", {1: "-", 2: "Example Gripper"}, "two finger")}, '"')"""),
        ("is_biarm", "CASE WHEN e % 4 = 1 THEN 'true' ELSE 'false' END"),
        ("uses_mobile_base", "CASE WHEN e % 13 = 4 THEN 'true' ELSE 'false' END"),
        ("camera_names", _case("e % 7", {3: _names(["front", "wrist_left", "top"])}, _names(["front", "wrist_left"]))),
        ("robot_state_keys", _case("e % 9", {2: _names(["joint_position", "cartesian_position"]), 5: _names([*_STATES, "base_position"])}, _names(_STATES))),
        ("action_space", _case("e % 10", {4: _names([*_SPACE, "wings"]), 7: _names(["gripper_binary"]), 8: _names([*_SPACE, "base_position", "base_velocity"])}, _names(_SPACE))),
        ("action_joint_names", _case("e % 12", {k: _names(a) for k, (a, _) in _JOINTS.items()}, _names(_PLAIN))),
        ("robot_state_joint_names", _case("e % 12", {k: _names(s) for k, (_, s) in _JOINTS.items()}, _names(_PLAIN))),
        ("additional_data", _case("e % 8", sensors, "{}")),
    ]
    body = ", ', ', ".join(f"""'"{k}": ', {v}""" for k, v in parts)
    freq = """CASE WHEN e % 15 = 8 THEN '' ELSE ', "control_freq": 10' END"""
    return f"""SELECT * FROM (WITH {_USERS} SELECT e AS episode_id,
      CASE WHEN e % 31 = 11 THEN '(broken' WHEN e % 31 = 12 THEN '[1, 2]' WHEN e % 31 = 13 THEN NULL ELSE concat('LEFT', {body}, {freq}, 'RIGHT') END AS profile FROM u) AS derived"""


def headers_sql() -> str:
    """``headers``: the attributes at the root of each recording, null where they are missing."""
    return """SELECT * FROM (WITH u AS (SELECT user_id AS e FROM {events} GROUP BY user_id) SELECT e AS episode_id,
      CASE WHEN e % 21 = 5 THEN NULL ELSE 'episode_format_v1' END AS schema, CASE e % 22 WHEN 6 THEN NULL WHEN 7 THEN '' ELSE concat('ep', CAST(e AS VARCHAR(20))) END AS name,
      CASE WHEN e % 23 = 9 THEN NULL ELSE 'pick it up' END AS language_instruction, CASE WHEN e % 26 = 1 THEN NULL ELSE 'lab' END AS lab_id,
      CASE WHEN e % 27 = 2 THEN NULL ELSE 'Ada' END AS operator_name FROM u) AS derived"""


_ARRAYS = [
    ("state", "joint_position", "7"), ("state", "gripper_position", "1"), ("state", "cartesian_position", "CASE WHEN e % 4 = 1 AND e % 6 <> 5 THEN 14 ELSE 7 END"),
    ("action", "joint_position", "7"), ("action", "joint_velocity", "7"), ("action", "cartesian_position", "CASE WHEN e % 4 = 1 AND e % 6 <> 5 THEN 14 ELSE 7 END"), ("action", "cartesian_velocity", "6"),
    ("action", "gripper_position", "1"), ("action", "gripper_velocity", "1"), ("action", "gripper_binary", "CASE WHEN e % 4 = 1 AND e % 5 <> 2 THEN 2 ELSE 1 END"),
    ("additional", "touch", "16"), ("additional", "depth", "307200"), ("additional", "tac", "1"),
]


def arrays_sql(one: str | None = None) -> str:
    """``arrays``: what is stored under each key, by shape and type, without its values."""
    one = one or " UNION ALL ".join(f"SELECT e, n, {i} AS k, '{g}' AS grp, '{key}' AS key, {w} AS width FROM u" for i, (g, key, w) in enumerate(_ARRAYS))
    return f"""SELECT * FROM (WITH {_USERS}, a AS ({one}),
      b AS (SELECT *, key = 'tac' AND e % 16 = 7 AS is_text FROM a WHERE NOT (grp = 'action' AND e % 25 = 3) AND NOT (grp = 'state' AND e % 25 = 4) AND NOT (key = 'gripper_position' AND grp = 'state' AND e % 11 = 5)
        AND NOT (key = 'gripper_binary' AND e % 8 = 3) AND (grp <> 'additional' OR (key = 'touch' AND (e % 8 = 1 OR e % 16 = 0)) OR (key = 'depth' AND e % 8 IN (4, 5, 6)) OR (key = 'tac' AND e % 8 = 7))),
      c AS (SELECT *, grp <> 'state' AND (e + k) % 17 = 1 AS is_empty, CASE WHEN is_text THEN 0 WHEN (e + k) % 19 = 2 THEN 3 WHEN width = 1 AND (e + k) % 5 = 0 THEN 1 ELSE 2 END AS ndim,
        CASE WHEN (e + k) % 20 = 4 THEN n + 3 WHEN grp = 'action' AND key = 'joint_position' THEN n - e % 4 ELSE n END AS len FROM b)
      SELECT e AS episode_id, grp, key, CASE WHEN is_text THEN 'text' ELSE 'float64' END AS dtype, CAST(ndim AS INT) AS ndim, CAST(CASE WHEN is_empty OR is_text THEN 0 ELSE len END AS BIGINT) AS n,
        CAST(CASE WHEN ndim = 1 THEN 1 ELSE width END AS INT) AS width, is_empty, CAST(CASE WHEN is_empty THEN 0 WHEN is_text THEN 40 ELSE 8 * len * width END AS BIGINT) AS n_bytes,
        CAST(CASE WHEN grp = 'additional' AND NOT is_text AND e % 12 = 1 THEN 2 ELSE 0 END AS BIGINT) AS n_inf FROM c) AS derived"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, profiles_sql())


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, headers_sql())


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, from one pass over the episodes for all keys."""
    keys = ", ".join(f"named_struct('k', {i}, 'grp', '{g}', 'key', '{key}', 'width', {w})" for i, (g, key, w) in enumerate(_ARRAYS))
    return _table(spark, sf_dir, arrays_sql(f"SELECT e, n, y.k, y.grp, y.key, y.width FROM u LATERAL VIEW inline(array({keys})) y AS k, grp, key, width"))


def _table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(_spark(sql), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _spark(sql: str) -> str:
    """Braces of JSON doubled, so that only ``{events}`` is a field."""
    return sql.replace("{events}", "\0").replace("{", "{{").replace("}", "}}").replace("\0", "{events}").replace("LEFT", "{{").replace("RIGHT", "}}")


def as_cte(*names: str) -> str:
    """A WITH clause of these and of the episodes' tables for the reference engine."""
    own = {"profiles": profiles_sql, "headers": headers_sql, "arrays": arrays_sql}
    text = lambda n: own[n]().replace("{events}", "events").replace("LEFT", "{").replace("RIGHT", "}")
    made = [f"{n} AS ({text(n)})" for n in names if n in own]
    others = [n for n in names if n not in own]
    return (src.as_cte(*others) + ", " if others else "WITH ") + ", ".join(made)


def parsed(rows: DataFrame) -> DataFrame:
    """Adds ``p``, the profile as a struct, and ``keys``, the names it has; null where it is no JSON object."""
    keys = F.json_object_keys("profile")
    return rows.withColumn("keys", keys).withColumn("p", F.when(keys.isNotNull(), F.from_json("profile", PROFILE)))


def tolerant(rows: DataFrame) -> DataFrame:
    """As ``parsed``, with an empty profile where there is none that can be read."""
    return parsed(rows).withColumn("p", F.coalesce("p", F.from_json(F.lit("{}"), PROFILE)))


def names_or_none(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))
