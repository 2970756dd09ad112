"""Registered queries of video against motion, and their SQL, which pairs rows with those around them by plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.operators import video_motion as vm
from tendon.operators.config import with_overrides
from tendon.sources import filmed as src


def _motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vm.motion_of(vm.state_motion(src.motion(spark, sf_dir)), src.rates(spark, sf_dir))


def _cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = src.frames(spark, sf_dir)
    names = frames.select("episode_id", F.col("camera").alias("name")).distinct()
    return vm.diffs_of(frames, names.join(src.rates(spark, sf_dir).select("episode_id", "fps"), "episode_id"))


def robot_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _motion(spark, sf_dir).select("episode_id", F.posexplode(F.arrays_zip("step", "moving")).alias("t", "x"))
    return rows.select("episode_id", F.col("t").cast("long").alias("t"), F.round("x.step", 6).alias("step"), "x.moving")


def state_and_camera_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vm.jumps_and_gaps(vm.state_jumps(_motion(spark, sf_dir)), _cameras(spark, sf_dir))


def camera_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vm.video_jumps(_cameras(spark, sf_dir), _motion(spark, sf_dir))


def still_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vm.still_frames(_cameras(spark, sf_dir), _motion(spark, sf_dir))


def periodic_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vm.periodic_skips(_motion(spark, sf_dir), vm.position_motion(src.motion(spark, sf_dir)), vm.camera_diffs(src.frames(spark, sf_dir)))


def _hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The motion of the first two joints as that of a hand, without joints."""
    rows = src.motion(spark, sf_dir).where("key = 'joint_position'")
    return rows.withColumn("key", F.lit("cartesian_position")).withColumn("vals", F.expr("array(vals[0], vals[1], 0.2D, 0D, 0D, 0D, 1D)"))


def hand_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic skips of episodes that record the hand's pose and no joints."""
    rows = _hands(spark, sf_dir)
    return vm.periodic_skips(vm.motion_of(vm.state_motion(rows), src.rates(spark, sf_dir)), vm.position_motion(rows), vm.camera_diffs(src.frames(spark, sf_dir)))


#: Thresholds of a lab whose cameras are noisy.
NOISY = {"video": {"video_jump": {"jump_diff": 55.0, "jump_ratio": 12.0}, "corrupted_frames": {"glitch_diff": 95.0}}}


def noisy_camera_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps of cameras with overridden thresholds."""
    return vm.video_jumps(_cameras(spark, sf_dir), _motion(spark, sf_dir), with_overrides(NOISY))


def glitched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vm.corrupted(_cameras(spark, sf_dir))


def ignored_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, skipped = vm.without_ignored(src.frames(spark, sf_dir), ("tactile ",))
    counted = kept.groupBy("episode_id", "camera").agg(F.count("diff").alias("n")).withColumn("reason", F.lit(""))
    return counted.unionByName(skipped.groupBy("episode_id", "camera", "reason").agg(F.lit(0).cast("long").alias("n")))


_S = src.as_cte("motion", "frames", "rates") + """,
  st AS (SELECT episode_id AS e, key, t, vals, list_sum(list_transform(list_zip(vals[4:7], lag(vals[4:7]) OVER (PARTITION BY episode_id, key ORDER BY t)), lambda z: z[1] * z[2])) AS dp
    FROM motion WHERE grp = 'state' AND key <> 'gripper_position'),
  sg AS (SELECT *, CASE WHEN key = 'cartesian_position' AND sum((dp < 0)::INT) OVER (PARTITION BY e, key ORDER BY t) % 2 = 1 THEN -1 ELSE 1 END AS sg FROM st),
  ce AS (SELECT e, key, t, d, vals[d] * CASE WHEN key = 'cartesian_position' AND d > 3 THEN sg ELSE 1 END AS v FROM (SELECT *, unnest(range(1, len(vals) + 1)) AS d FROM sg)),
  un AS (SELECT *, v - lag(v) OVER w AS dv, key = 'joint_position' AND max(abs(v)) OVER (PARTITION BY e, key, d) <= pi() + 0.1e0 AS fits FROM ce WINDOW w AS (PARTITION BY e, key, d ORDER BY t)),
  uw AS (SELECT *, v + CASE WHEN fits THEN 2 * pi() * coalesce(sum(CASE WHEN dv > pi() THEN -1 WHEN dv < -pi() THEN 1 ELSE 0 END) OVER (PARTITION BY e, key, d ORDER BY t), 0) ELSE 0 END AS x FROM un),
  sd AS (SELECT e, key, d, CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1 END AS sd FROM uw GROUP BY ALL),
  mv AS (SELECT e, key, t, d, (x - lag(x) OVER (PARTITION BY e, key, d ORDER BY t)) / sd AS m FROM uw JOIN sd USING (e, key, d)),
  ss AS (SELECT e, t - 1 AS t, sqrt(sum(m * m)) AS step FROM mv WHERE t > 0 GROUP BY ALL),
  pp AS (SELECT e, quantile_cont(step, 0.95) AS p95, count(*) AS n FROM ss GROUP BY e),
  mo AS (SELECT ss.e, t, step, p95, n, p95 > 0 AND step > 0.1e0 * p95 AS moving, CASE WHEN control_freq > 0 THEN control_freq ELSE 0 END AS hz FROM ss JOIN pp USING (e) JOIN rates ON episode_id = e),
  di AS (SELECT f.episode_id AS e, camera, frame_idx AS t, diff, skip_diff AS skip, CASE WHEN fps > 0 THEN fps WHEN control_freq > 0 THEN control_freq ELSE 0 END AS rate, count(*) OVER (PARTITION BY f.episode_id, camera) AS n
    FROM frames f JOIN rates r ON r.episode_id = f.episode_id WHERE diff IS NOT NULL)"""
_JUMPS = """, ar AS (SELECT a.e, a.t, any_value(a.step) AS step, any_value(a.p95) AS p95, any_value(a.hz) AS hz, avg(b.step) AS near, avg((b.step > 0.1e0 * b.p95)::INT) AS busy FROM mo a JOIN mo b
      ON a.e = b.e AND a.t <> b.t AND abs(a.t - b.t) <= greatest(2, round_even(CASE WHEN a.hz > 0 THEN a.hz ELSE 10 END, 0)) WHERE a.n >= 5 GROUP BY a.e, a.t),
  cd AS (SELECT *, CASE WHEN near > 0 THEN step / near ELSE 'inf'::DOUBLE END >= 10 AND step >= p95 AND step > 0 AND busy >= 0.5e0 AS jump FROM ar),
  jp AS (SELECT e, t, CASE WHEN hz > 0 THEN (t + 1) / hz ELSE t + 1 END AS time FROM cd a WHERE jump AND NOT EXISTS (SELECT 1 FROM cd b WHERE b.e = a.e AND b.jump AND abs(b.t - a.t) = 1))"""

QUERIES = {f.__name__: f for f in (robot_moving, state_and_camera_jumps, camera_jumps, still_frames, periodic_skips, hand_skips, noisy_camera_jumps, glitched_frames, ignored_cameras)}
ORACLE_SQL = {
    "robot_moving": _S + " SELECT e AS episode_id, t, round(step, 6) AS step, moving FROM mo",
    "state_and_camera_jumps": _S + _JUMPS + """, kk AS (SELECT DISTINCT jp.e, jp.t, camera, rate, di.n, round_even(time * rate, 0)::BIGINT - 1 AS k, greatest(2, round_even(rate, 0)) AS w FROM jp JOIN di USING (e)),
      sp AS (SELECT kk.e, kk.t, kk.camera, max(di.diff) FILTER (abs(di.t - k) <= 1) AS peak, coalesce(quantile_cont(di.diff, 0.5) FILTER ((di.t < greatest(0, k - 1) AND di.t >= greatest(0, k - 1) - w) OR (di.t > k + 1 AND di.t <= k + 1 + w)), 0) AS base
        FROM kk JOIN di ON di.e = kk.e AND di.camera = kk.camera WHERE kk.rate > 0 AND kk.n >= 3 GROUP BY ALL),
      hs AS (SELECT e, t, string_agg(camera, ',' ORDER BY camera) AS cams FROM sp WHERE peak / (base + 1) >= 5 GROUP BY ALL)
      SELECT e AS episode_id, CASE WHEN cams IS NULL THEN 'state_jump' ELSE 'recording_gap' END AS check_name, t, coalesce(cams, '') AS cameras FROM jp LEFT JOIN hs USING (e, t)""",
    "camera_jumps": _S + """, co AS (SELECT b.e, b.camera, b.t FROM di a JOIN di b ON a.e = b.e AND a.camera = b.camera AND b.t = a.t + 1 WHERE least(a.diff, b.diff) >= 20 AND least(a.diff, b.diff) / (a.skip + 1) >= 4),
      ca AS (SELECT *, CASE WHEN rate > 0 THEN rate ELSE 1 END AS r FROM di d WHERE diff >= 40 AND NOT EXISTS (SELECT 1 FROM co WHERE co.e = d.e AND co.camera = d.camera AND d.t IN (co.t - 1, co.t))),
      ne AS (SELECT ca.e, ca.camera, ca.t, any_value(ca.diff) AS diff, any_value(r) AS r, quantile_cont(b.diff, 0.5) AS med FROM ca JOIN di b ON b.e = ca.e AND b.camera = ca.camera AND b.t <> ca.t AND abs(b.t - ca.t) <= greatest(2, round_even(r, 0)) GROUP BY ca.e, ca.camera, ca.t),
      vj AS (SELECT e, camera, t, (t + 1) / r AS time FROM ne WHERE diff / (med + 1) >= 20),
      sh AS (SELECT vj.e, vj.camera, vj.t, max(m.step) FILTER (abs(m.t - k) <= 1) AS top, coalesce(avg(m.step) FILTER ((m.t < greatest(0, k - 1) AND m.t >= greatest(0, k - 1) - w) OR (m.t > least(m.n - 1, k + 1) AND m.t <= least(m.n - 1, k + 1) + w)), 0) AS base
        FROM (SELECT vj.*, round_even(time * hz, 0)::BIGINT - 1 AS k, greatest(2, round_even(hz, 0)) AS w FROM vj JOIN (SELECT DISTINCT e, hz FROM mo WHERE hz > 0 AND n >= 3) USING (e)) vj JOIN mo m ON m.e = vj.e GROUP BY ALL)
      SELECT e AS episode_id, camera, t AS frame, round(time, 6) AS time_s FROM vj WHERE (e, camera, t) NOT IN (SELECT (e, camera, t) FROM sh WHERE top > 5 * base)""",
    "still_frames": _S + """, fm AS (SELECT d.e, d.camera, d.t, d.diff, d.rate, m.moving FROM di d JOIN (SELECT DISTINCT e, n AS k FROM mo) c ON c.e = d.e
        JOIN mo m ON m.e = d.e AND m.t = CASE WHEN k = d.n THEN d.t ELSE round_even(d.t * (k - 1) / greatest(d.n - 1, 1), 0)::BIGINT END WHERE d.n >= 3),
      fl AS (SELECT *, diff < 0.05e0 AND moving AS still, sum((NOT (diff < 0.05e0 AND moving))::INT) OVER (PARTITION BY e, camera ORDER BY t) AS g FROM fm),
      ru AS (SELECT e, camera, g, count(*) FILTER (still) AS k, any_value(CASE WHEN rate > 0 THEN rate ELSE 1 END) AS r FROM fl GROUP BY ALL), lo AS (SELECT e, camera, max(k) / any_value(r) AS s FROM ru GROUP BY ALL),
      ch AS (SELECT e, camera, count(*) FILTER (diff < 0.01e0 AND moving) / count(*) FILTER (moving) AS s FROM fm GROUP BY ALL HAVING bool_or(moving))
      SELECT e AS episode_id, 'frozen' AS check_name, camera, round(s, 6) AS metric FROM lo WHERE s >= 1 UNION ALL SELECT e, 'choppy', camera, round(s, 6) FROM ch WHERE s >= 0.2e0""",
    "periodic_skips": _S + """, cl AS (SELECT a.e, a.t, x.o, b.step FROM mo a, range(-8, 9) x(o) JOIN mo b ON b.e = a.e AND b.t = least(greatest(a.t + x.o, 0), a.n - 1) WHERE a.n >= 17),
      md AS (SELECT e, t, quantile_cont(step, 0.5) AS med FROM cl GROUP BY ALL), hi AS (SELECT e, t FROM mo JOIN md USING (e, t) WHERE step > 3 * med AND moving),
      jm AS (SELECT episode_id AS e, grp, t, list_transform(list_zip(vals, lag(vals) OVER (PARTITION BY episode_id, grp ORDER BY t)), lambda z: z[1] - z[2]) AS m FROM motion WHERE key = 'joint_position'),
      jj AS (SELECT e, grp, t - 1 AS t, sqrt(list_sum(list_transform(m, lambda v: v * v))) AS len, list_max(list_transform(m, lambda v: abs(v))) AS top FROM jm WHERE t > 0),
      al AS (SELECT * FROM hi a WHERE NOT EXISTS (SELECT 1 FROM hi b WHERE b.e = a.e AND abs(a.t - b.t) = 1)),
      ex AS (SELECT al.e, al.t FROM al JOIN jj s ON s.e = al.e AND s.t = al.t AND s.grp = 'state' JOIN jj c ON c.e = al.e AND c.grp = 'action' AND c.t BETWEEN al.t - 2 AND al.t GROUP BY ALL HAVING any_value(s.len) > 0 AND max(c.len) >= 3 * any_value(s.len)),
      ix AS (SELECT e, t, t - lag(t) OVER (PARTITION BY e ORDER BY t) AS gap FROM al WHERE (e, t) NOT IN (SELECT (e, t) FROM ex)),
      nx AS (SELECT e, count(*) AS k FROM ix GROUP BY e HAVING count(*) >= 6),
      sc AS (SELECT e, p, avg((least(gap % p, p - gap % p) <= 1)::INT) - 3 / p AS near, avg((gap % p = 0)::INT) AS exact FROM ix, range(3, 31) r(p) WHERE gap IS NOT NULL AND e IN (SELECT e FROM nx) GROUP BY e, p),
      be AS (SELECT e, p, near FROM sc QUALIFY near >= max(near) OVER (PARTITION BY e) - 0.05e0 AND max(near) OVER (PARTITION BY e) > 0 AND true),
      b1 AS (SELECT be.e, be.p, be.near FROM be JOIN sc USING (e, p) QUALIFY row_number() OVER (PARTITION BY be.e ORDER BY exact DESC, p) = 1),
      pc AS (SELECT b1.e, p, k FROM b1 JOIN nx USING (e) JOIN (SELECT e, count(*) FILTER (moving) AS m FROM mo GROUP BY e) USING (e) WHERE near >= 0.4e0 AND k * p >= 0.6e0 * m),
      jn AS (SELECT e, max(t) AS l FROM jj WHERE grp = 'state' GROUP BY e),
      xm AS (SELECT a.e, a.t, any_value(a.top) AS top, quantile_cont(b.top, 0.5) AS med FROM jj a JOIN jn USING (e), range(-8, 9) x(o) JOIN jj b ON b.e = a.e AND b.grp = 'state' AND b.t = least(greatest(a.t + x.o, 0), l) WHERE a.grp = 'state' AND a.e IN (SELECT e FROM pc) GROUP BY a.e, a.t),
      dm AS (SELECT a.e, a.camera, a.t, any_value(a.n) AS n, quantile_cont(b.diff, 0.5) AS med FROM di a, range(-8, 9) x(o) JOIN di b ON b.e = a.e AND b.camera = a.camera AND b.t = least(greatest(a.t + x.o, 0), a.n - 1) WHERE a.n >= 17 AND a.e IN (SELECT e FROM pc) GROUP BY a.e, a.camera, a.t),
      fr AS (SELECT ix.e, ix.t, camera, round_even(ix.t * (n - 1) / greatest(k, 1), 0)::BIGINT AS f FROM ix JOIN (SELECT DISTINCT e, camera, n FROM dm) USING (e) JOIN (SELECT DISTINCT e, n AS k FROM mo) USING (e)),
      vp AS (SELECT fr.e, fr.t, fr.camera, max(d.diff) / (any_value(dm.med) + 0.05e0) AS v FROM fr JOIN di d ON d.e = fr.e AND d.camera = fr.camera AND abs(d.t - f) <= 1 JOIN dm ON dm.e = fr.e AND dm.camera = fr.camera AND dm.t = f GROUP BY fr.e, fr.t, fr.camera),
      vt AS (SELECT e, t, max(v) AS v FROM vp GROUP BY ALL),
      cf AS (SELECT ix.e, avg((top - med >= 0.015e0 AND coalesce(v, 0) >= 2)::INT) AS sure FROM ix JOIN xm USING (e, t) LEFT JOIN vt USING (e, t) GROUP BY ix.e)
      SELECT e AS episode_id, p AS period, k AS jumps, round(sure, 6) AS confirmed FROM pc JOIN cf USING (e) WHERE sure >= 0.4e0""",
    "ignored_cameras": src.as_cte("frames") + """ SELECT episode_id, camera, count(diff) AS n, '' AS reason FROM frames WHERE camera = 'front' GROUP BY ALL
      UNION ALL SELECT DISTINCT episode_id, camera, 0, 'ignored_camera' FROM frames WHERE camera = 'Tactile'""",
}
_HANDS = _S.replace("motion AS (", "motion0 AS (", 1).replace(",\n  st AS (", """,
  motion AS (SELECT episode_id, grp, 'cartesian_position' AS key, t, [vals[1], vals[2], 0.2e0, 0, 0, 0, 1] AS vals FROM motion0 WHERE key = 'joint_position'),
  st AS (""", 1)
ORACLE_SQL["hand_skips"] = (
    ORACLE_SQL["periodic_skips"].replace(_S, _HANDS).replace("list_transform(list_zip(vals, lag(vals) OVER", "list_transform(list_zip(vals[1:3], lag(vals[1:3]) OVER").replace("FROM motion WHERE key = 'joint_position')", "FROM motion)")
    .replace("list_max(list_transform(m, lambda v: abs(v))) AS top", "100 * sqrt(list_sum(list_transform(m, lambda v: v * v))) AS top").replace("top - med >= 0.015e0", "top - med >= 1e0")
)
ORACLE_SQL["noisy_camera_jumps"] = ORACLE_SQL["camera_jumps"].replace("least(a.diff, b.diff) >= 20 AND", "least(a.diff, b.diff) >= 95 AND").replace("WHERE diff >= 40 AND", "WHERE diff >= 55 AND").replace("diff / (med + 1) >= 20)", "diff / (med + 1) >= 12)")
ORACLE_SQL["glitched_frames"] = _S + " SELECT b.e AS episode_id, b.camera, b.t AS frame FROM di a JOIN di b ON a.e = b.e AND a.camera = b.camera AND b.t = a.t + 1 WHERE least(a.diff, b.diff) >= 20 AND least(a.diff, b.diff) / (a.skip + 1) >= 4"
