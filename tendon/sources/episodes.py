"""Episode tables derived by Spark from the ``events`` table: one episode per user, one step per event.

The SQL is the part that Spark and other engines read alike; ``ARR(`` stands for the engine's list constructor. Values
are made of triangle waves, so that every engine gets the same numbers, and defects are planted by the user's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.functions.columns import split

#: Action keys and the state key that observes each.
STATE_KEY_FOR_ACTION = {
    "joint_position": "joint_position",
    "joint_velocity": "joint_position",
    "cartesian_position": "cartesian_position",
    "cartesian_velocity": "cartesian_position",
    "gripper_position": "gripper_position",
    "gripper_velocity": "gripper_position",
    "gripper_binary": "gripper_position",
    "base_position": "base_position",
    "base_velocity": "base_position",
}
ARM_KEYS = ("joint_position", "joint_velocity", "cartesian_position", "cartesian_velocity")


def _wave(x: str) -> str:
    return f"(abs((({x}) % 40) - 20) / 20e0 - 0.5e0)"


def _joint(t: str, d: int) -> str:
    return f"(0.8e0 * {_wave(f'({t}) * {1 + d % 3} + {5 * d}')} + (e % 7) * 0.01e0)"


def _place(t: str, i: int) -> str:
    return f"({(0.4, 0.1, 0.3)[i]}e0 + 0.2e0 * {_wave(f'({t}) * {i + 1} + {i}')})"


def _turn(t: str) -> str:
    return f"(0.5e0 * {_wave(f'2 * ({t})')})"


def _quat(t: str, scale: str = "1e0") -> list[str]:
    u = _turn(t)
    return ["0e0", "0e0", f"{scale} * 2e0 * {u} / (1e0 + {u} * {u})", f"{scale} * (1e0 - {u} * {u}) / (1e0 + {u} * {u})"]


def _arr(xs: list[str]) -> str:
    return "ARR(" + ", ".join(xs) + ")"


def _joint_action(d: int) -> str:
    j = f"({_joint('t + 1', d)} + 0.001e0 * (((t * 7 + {d * 3} + e) % 5) - 2))"
    return (
        f"CASE e % 10 WHEN 2 THEN {j} * 57.29577951308232e0 WHEN 3 THEN {_joint('t + 1', d)} - {_joint('t', d)} WHEN 4 THEN {_joint('t', d)}"
        f" WHEN 5 THEN {_joint('1', d)} WHEN 6 THEN {_joint('t - t % 3 + 1', d)} WHEN 7 THEN CASE WHEN t = 5 THEN CAST('NaN' AS DOUBLE) ELSE {j} END"
        f" WHEN 8 THEN greatest(least({j} * 3e0, 1e0), -1e0) WHEN 9 THEN CASE WHEN t = 10 THEN {j} + 5e0 ELSE {j} END ELSE {j} END"
    )


def _joint_velocity(d: int) -> str:
    w = f"(({_joint('t + 1', d)} - {_joint('t', d)}) * hz)"
    return (
        f"CASE (e * 7 + 3) % 6 WHEN 1 THEN {w} * 57.3e0 WHEN 2 THEN {w} / hz WHEN 3 THEN {w} * (1 - 2 * (t % 2)) WHEN 4 THEN {_joint('t + 1', d)}"
        f" WHEN 5 THEN greatest(least({w} * 2e0, 1e0), -1e0) ELSE {w} END"
    )


def _cartesian_action() -> str:
    q, p = _quat("t + 1"), [f"({_place('t + 1', i)} + 0.0001e0 * ((t + {i}) % 3 - 1))" for i in range(3)]
    delta = [f"({_place('t + 1', i)} - {_place('t', i)})" for i in range(3)]
    flipped = [f"CASE WHEN t >= 20 THEN -1e0 ELSE 1e0 END * {x}" for x in q]
    rows = {
        1: [f"{x} * 1000e0" for x in p] + q,
        2: p + flipped,
        3: p + _quat("t + 1", "1.1e0"),
        4: p + [f"CASE WHEN t = 15 THEN {'1e0' if k == 0 else '0e0'} ELSE {x} END" for k, x in enumerate(q)],
        5: p + [q[3], *q[:3]],
        6: delta + q,
        7: p + q[:3],
        8: [f"greatest(least({x} * 4e0, 1e0), -1e0)" for x in p] + q,
    }
    cases = " ".join(f"WHEN {k} THEN {_arr(v)}" for k, v in rows.items())
    return f"CASE (e * 3 + 1) % 9 {cases} ELSE {_arr(p + q)} END"


def _cartesian_velocity() -> str:
    lin = [f"({_place('t + 1', i)} - {_place('t', i)}) * hz" for i in range(3)]
    ang = ["0.01e0 * (t % 2)", "0.01e0 * ((t + 1) % 2)", f"2e0 * ({_turn('t + 1')} - {_turn('t')}) * hz"]
    sign = "(1 - 2 * (t % 2))"
    rows = {
        1: ang + lin,
        2: [f"{x} / hz" for x in lin + ang],
        3: [f"{sign} * {x}" for x in lin + ang],
        4: lin + ang[:2],
        5: [f"{x} * 57.3e0" for x in lin + ang],
    }
    cases = " ".join(f"WHEN {k} THEN {_arr(v)}" for k, v in rows.items())
    return f"CASE (e * 5 + 2) % 7 {cases} ELSE {_arr(lin + ang)} END"


def _step_parts() -> list[tuple[str, str, str, str]]:
    """Group, key, values and condition of each array that an episode may have."""
    grip = lambda t: f"CASE WHEN ({t}) % 20 >= 10 THEN 0.04e0 ELSE 0e0 END"
    return [
        ("state", "joint_position", _arr([_joint("t", d) for d in range(7)]), "true"),
        ("state", "gripper_position", _arr([grip("t")]), "e % 11 <> 5"),
        ("state", "cartesian_position", _arr([_place("t", i) for i in range(3)] + _quat("t")), "true"),
        ("action", "joint_position", _arr([_joint_action(d) for d in range(7)]), "t < n - (e % 4)"),
        ("action", "joint_velocity", _arr([_joint_velocity(d) for d in range(7)]), "true"),
        ("action", "cartesian_position", _cartesian_action(), "true"),
        ("action", "cartesian_velocity", _cartesian_velocity(), "true"),
        ("action", "gripper_position", _arr([f"{grip('t + 1')} * CASE WHEN e % 6 = 1 THEN 5e0 ELSE 1e0 END"]), "true"),
        ("action", "gripper_velocity", _arr([f"{grip('t + 1')} * CASE WHEN e % 6 = 1 THEN 5e0 ELSE 1e0 END + CASE WHEN e % 3 = 0 THEN 1e-3 ELSE 0e0 END"]), "true"),
        ("action", "gripper_binary", _arr(["CASE WHEN (t + 1) % 20 >= 10 THEN 1e0 ELSE 0e0 END * CASE WHEN e % 9 = 4 THEN 2e0 ELSE 1e0 END"]), "e % 8 <> 3"),
    ]


_BASE = (
    "WITH b0 AS (SELECT user_id AS e, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t FROM {events}),"
    " b AS (SELECT e, t, count(*) OVER (PARTITION BY e) AS n, 10e0 * (1 + e % 3) AS hz FROM b0)"
)


def steps_sql() -> str:
    """``steps(episode_id, grp, key, t, vals)``."""
    every = " UNION ALL ".join(f"SELECT e AS episode_id, '{grp}' AS grp, '{key}' AS key, t, {vals} AS vals FROM b WHERE {where}" for grp, key, vals, where in _step_parts())
    return f"SELECT * FROM ({_BASE} {every}) AS x"


def episodes_sql() -> str:
    """``episodes``: identity, rate, length and labels of every episode, defects planted."""
    return """SELECT * FROM (WITH u AS (SELECT user_id AS e, count(*) AS n, min(event_id) AS first FROM {events} GROUP BY user_id)
    SELECT e AS episode_id, concat('lab', CAST(e % 5 AS VARCHAR(20)), '/run', CAST(e % 3 AS VARCHAR(20)), '/ep', CAST(e AS VARCHAR(20)), '.h5') AS rel_path,
      CASE WHEN e % 23 = 7 THEN 'episode_format_v0' ELSE 'episode_format_v1' END AS schema,
      CASE WHEN e % 19 = 3 THEN ' ' WHEN e % 3 = 0 THEN 'pick up the block' ELSE concat('move object ', CAST(e % 6 AS VARCHAR(20))) END AS language_instruction,
      CASE WHEN e % 17 = 2 THEN 'your_lab_id' WHEN e % 29 = 4 THEN '' ELSE concat('lab', CAST(e % 5 AS VARCHAR(20))) END AS lab_id,
      CASE e % 8 WHEN 1 THEN '' WHEN 2 THEN 'Test-Operator' WHEN 3 THEN 'robot 2' WHEN 4 THEN 'n/a' ELSE concat('Ada Smith ', CAST(e AS VARCHAR(20))) END AS operator_name,
      CASE e % 7 WHEN 1 THEN 'TODO' WHEN 2 THEN 'your_policy_name' ELSE 'policy a' END AS policy_name,
      CASE WHEN e % 31 = 6 THEN 0e0 WHEN e % 37 = 8 THEN CAST('NaN' AS DOUBLE) ELSE 10e0 * (1 + e % 3) END AS control_freq,
      e % 4 = 1 AS is_biarm, n AS trajectory_length, CAST(first % 1000 AS BIGINT) AS mtime, CAST(1000000 * (1 + e % 13) AS BIGINT) AS size_bytes,
      CAST(CASE WHEN e % 41 = 9 THEN 'cannot open' END AS VARCHAR(20)) AS read_error FROM u) AS x"""


def videos_sql() -> str:
    """``videos``: two cameras per episode, and a third one for some."""
    return """SELECT * FROM (WITH u AS (SELECT user_id AS e, count(*) AS n FROM {events} GROUP BY user_id),
      c AS (SELECT 0 AS c, 'front' AS name UNION ALL SELECT 1, 'wrist_left' UNION ALL SELECT 2, 'Side_Right'),
      v AS (SELECT e, c, name, n, 10e0 * (1 + e % 3) AS hz FROM u CROSS JOIN c WHERE c < 2 OR e % 3 = 0)
    SELECT e AS episode_id, 'video_paths' AS ref_group, name,
      CASE (e + c) % 12 WHEN 1 THEN '' WHEN 2 THEN concat('/abs/', name, '.mp4') WHEN 3 THEN concat('../../../', name, '.mp4') WHEN 4 THEN concat('./v/../', name, '.mp4')
        ELSE concat('videos/', CAST(e AS VARCHAR(20)), '_', name, '.mp4') END AS stored_path,
      (e + c) % 13 <> 5 AS file_exists, CAST(CASE (e + 2 * c) % 9 WHEN 1 THEN 1920 WHEN 2 THEN 160 ELSE 640 END AS INT) AS width,
      CAST(CASE (e + c) % 7 WHEN 1 THEN 340 WHEN 2 THEN 120 ELSE 480 END AS INT) AS height,
      CASE WHEN (e + c) % 11 = 3 THEN 1.2e0 * hz ELSE hz END AS fps,
      CAST(CASE (e + 3 * c) % 10 WHEN 4 THEN n + 40 WHEN 5 THEN n + 2 ELSE n END AS BIGINT) AS frame_count,
      CASE (e + c) % 5 WHEN 2 THEN 23e0 WHEN 3 THEN CAST(NULL AS DOUBLE) ELSE 18e0 END AS crf,
      CAST(CASE (e + c) % 14 WHEN 6 THEN 0 WHEN 7 THEN n - 5 ELSE n END AS BIGINT) AS decoded_frames, CAST(CASE WHEN (e + c) % 25 = 8 THEN 1 ELSE 0 END AS INT) AS returncode,
      CAST(100000 + 1000 * (e % 50) AS BIGINT) AS size_bytes FROM v) AS x"""


def for_engine(sql: str, list_name: str) -> str:
    return sql.replace("ARR(", f"{list_name}(")


def _table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(for_engine(sql, "array"), events=events)


def wanted(actions: tuple[str, ...]) -> str:
    """A condition for the steps of these actions and of the states that observe them."""
    listed = lambda keys: ", ".join(f"'{k}'" for k in sorted(keys))
    return f"(grp = 'action' AND key IN ({listed(actions)})) OR (grp = 'state' AND key IN ({listed({STATE_KEY_FOR_ACTION[k] for k in actions})}))"


def by_user(events: DataFrame) -> DataFrame:
    """Events dealt by user to as many tasks as shuffles have: arrays are made from few bytes, so sizes don't tell the work."""
    return events.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user_id")


def steps(spark: SparkSession, sf_dir: str, actions: tuple[str, ...] | None = None, groups: tuple[str, ...] = ("state", "action"), values: bool = True) -> DataFrame:
    """The steps from one scan and one window: each event gives the arrays of its step, of these actions and their states alone if named.

    ``groups`` leaves out states or actions; without ``values`` the steps have no arrays."""
    base = spark.sql(f"{_BASE} SELECT * FROM b", events=by_user(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")))
    states = None if actions is None else {STATE_KEY_FOR_ACTION[k] for k in actions}
    wanted = [x for x in _step_parts() if x[0] in groups and (actions is None or x[1] in (actions if x[0] == "action" else states))]
    array = lambda vals: f", 'vals', {for_engine(vals, 'array')}" if values else ""
    rows = {f"{grp}_{key}": F.expr(f"IF({where}, named_struct('grp', '{grp}', 'key', '{key}'{array(vals)}), NULL)") for grp, key, vals, where in wanted}
    each = split(base.withColumn("episode_id", F.col("e")), rows)
    return each.select("episode_id", "x.grp", "x.key", "t", *(["x.vals"] if values else []))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, episodes_sql())


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, videos_sql())


def as_cte(*names: str) -> str:
    """A WITH clause that makes the named tables for the reference engine."""
    made = {"steps": steps_sql, "episodes": episodes_sql, "videos": videos_sql}
    return "WITH " + ", ".join(f"{n} AS (" + for_engine(made[n](), "list_value").replace("{events}", "events") + ")" for n in names)
