"""What is written: reports, results, training episodes and rollouts; folders that are there are refused."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tendon.functions.columns import significant_text
from tendon.functions.numbering import running
from tendon.operators import conversion, ledger, reporting, validation
from tendon.operators.config import catalogue, with_overrides


def outcome(spark, rows):
    full = [(e, x, o, k, m, None, None, None, note, cat) for e, cat, x, o, k, m, note in rows]
    return spark.createDataFrame(full, ledger.OUTCOME)


def test_report_has_labels_and_four_digits(spark, tmp_path):
    rows = outcome(spark, [
        (1, "video", "fps", "found", "front", 12.34567, None), (1, "video", "fps", "ran", "all", None, None), (1, "general", "gripper_range", "found", "g", float("inf"), None), (1, "general", "command_rate", "skipped", "j", None, "too_short"),
        (3, "video", "resolution", "found", "front", 320.0, None), (2, "video", "fps", "ran", "all", None, None), (2, "general", "constant_action", "ran", "j", None, None), (3, "video", "resolution", "ran", "all", None, None),
        (5, "general", "command_rate", "skipped", "j", None, "non_finite_values"),
    ])
    episodes = spark.createDataFrame([(1, None), (2, None), (3, None), (4, "broken"), (5, None)], "episode_id long, read_error string")
    status = ledger.statuses(episodes, ledger.bits(rows))
    got = {r["episode_id"]: (r["status"], r["flagged"], r["n_ran"], r["n_skipped"]) for r in status.collect()}
    assert got == {1: ("flagged", "general.gripper_range,video.fps", 1, 1), 2: ("clean", "", 2, 0), 3: ("clean", "", 1, 0), 4: ("error", "", 0, 0), 5: ("not_checked", "", 0, 1)}
    assert {r["status"]: (r["n"], r["n_flagged_checks"], r["n_findings"]) for r in ledger.status_counts(status).collect()} == {"flagged": (1, 2, 2), "clean": (2, 0, 1), "error": (1, 0, 0), "not_checked": (1, 0, 0)}
    at = f"{tmp_path}/report"
    reporting.write_report(ledger.records(status, rows, catalogue(spark)), at)
    back = {r["episode_id"]: r for r in spark.read.json(at).collect()}
    first = json.loads(back[1]["findings"])
    assert [x["metric"] for x in first] == ["inf", "12.35"] and first[1]["suggested_action"] == "confirm_and_discuss" and back[2]["findings"] == "[]"
    assert json.loads(back[1]["skipped"]) == [{"check": "general.command_rate", "key": "j", "reason": "too_short"}] and back[5]["checks_run"] == 0
    with pytest.raises(AnalysisException):
        reporting.write_report(ledger.records(status, rows, catalogue(spark)), at)
    config = with_overrides({"video": {"fps": {"fps_rel_tol": 0.2}}})
    sums = {(r["category"], r["check_name"]): r for r in ledger.summary(status, rows, catalogue(spark, config), config).collect()}
    fps = sums["video", "fps"]
    assert len(sums) == 57 and (fps["ran"], fps["episodes"], fps["findings"], fps["overrides"]) == (2, 1, 1, '{"fps_rel_tol": 0.2}') and sums["video", "frozen"]["episodes"] == 0
    assert sums["general", "command_rate"]["skipped"] == 2 and sums["general", "command_rate"]["overrides"] == "{}"


def test_a_category_runs_again_alone(spark, tmp_path):
    at = f"{tmp_path}/ledger"
    ledger.write(outcome(spark, [(1, "video", "fps", "found", "front", 1.0, None), (1, "general", "gripper_range", "ran", "g", None, None)]), at)
    ledger.write(outcome(spark, [(1, "video", "fps", "ran", "all", None, None), (2, "video", "fps", "ran", "all", None, None)]), at)
    got = {r["episode_id"]: (r["ran"], r["found"]) for r in ledger.bits(ledger.read(spark, at)).collect()}
    fps, grip = 1 << ledger.BITS["video", "fps"], 1 << ledger.BITS["general", "gripper_range"]
    assert got == {1: (fps | grip, 0), 2: (fps, 0)}


def test_disabled_checks_have_no_outcome(spark):
    config = with_overrides({"general": {"gripper_range": {"enabled": False}}})
    rows = spark.createDataFrame([(1, "a")], "episode_id long, key string")
    cover = [("gripper_range", "true", "NULL"), ("length_mismatch", "true", "'too_short'")]
    got = ledger.outcomes(rows, "general", cover, config, [("gripper_range", F.lit(True), {})]).collect()
    assert [(r["check_name"], r["outcome"], r["note"], r["key"]) for r in got] == [("length_mismatch", "skipped", "too_short", "a")]
    assert all(c["informational"] == (c["suggested_action"] == "informational") for c in catalogue(spark).collect())


def test_numbers_of_one_crowded_folder_come_from_many_tasks(spark):
    n = 5000
    rows = spark.range(n).select(F.concat(F.lit("d/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("path"), F.when(F.col("id") % 50 == 0, "other").otherwise("crowded").alias("dir"), (F.col("id") % 3).alias("w"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = running(rows.repartition(7), ["path"], {"place": F.lit(1), "sum": F.col("w")}, ("dir",), ("place",))
        got = {r["path"]: (r["place"], r["sum"], r["place_total"]) for r in made.collect()}
        whole = {r["path"]: r["place"] for r in running(rows, ["path"], {"place": F.lit(1)}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen, total = {"other": [0, 0], "crowded": [0, 0]}, {"other": n // 50, "crowded": n - n // 50}
    for r in sorted(rows.collect()):
        place, s = seen[r["dir"]]
        assert got[r["path"]] == (place, s, total[r["dir"]])
        seen[r["dir"]] = [place + 1, s + r["w"]]
    assert [whole[p] for p in sorted(whole)] == list(range(n))


def test_digits_in_text(spark):
    row = spark.range(1).select(*(significant_text(F.lit(x)).alias(str(i)) for i, x in enumerate((float("nan"), float("-inf"), 0.0, 123456.0, -0.00123456)))).first()
    assert tuple(row) == ("nan", "-inf", "0.0", "123500.0", "-0.001235")


def test_results_rollouts_and_training(spark, tmp_path):
    results = spark.createDataFrame([(1, True, 0, None), (2, False, 2, "schema")], "episode_id long, passed boolean, n_violations long, first_rule string")
    validation.write_results(results, f"{tmp_path}/results")
    assert spark.read.json(f"{tmp_path}/results").count() == 2 and tuple(validation.totals(results).first()) == (2, 1, 1)
    conversion.write_rollouts(spark.createDataFrame([(True, 1.5, "a.mp4")], "success boolean, duration double, video_filename string"), f"{tmp_path}/rollouts")
    assert spark.read.option("header", True).csv(f"{tmp_path}/rollouts").first().asDict() == {"success": "true", "duration": "1.5", "video_filename": "a.mp4"}
    arrays = [(e, g, k, t, [0.5] * (w - (e == 3 and k == "joint_position"))) for e in range(5) for g in ("state", "action") for k, w in (("joint_position", 7), ("gripper_position", 1)) for t in range(4 - (e == 2 and g == "action" and w == 7))]
    arrays = [x for x in arrays if not (x[0] == 1 and x[2] == "gripper_position")]
    steps = spark.createDataFrame(arrays, "episode_id long, grp string, key string, t long, vals array<double>")
    episodes = spark.createDataFrame([(e, f"lab/ep{e}.h5") for e in range(5)], "episode_id long, rel_path string")
    labels = spark.createDataFrame([(0, "1"), (1, "0"), (2, "1"), (3, "1"), (4, "conflict")], "episode_id long, verdict string")
    rows = conversion.training_episodes(steps, episodes, labels)
    assert {r["episode_id"]: r["problem"] for r in rows.collect()} == {0: "", 1: "", 2: "lengths", 3: "width", 4: "no_consensus"}
    conversion.write_training(rows, f"{tmp_path}/out", 2)
    back = {r["episode_id"]: r for r in spark.read.parquet(f"{tmp_path}/out/train").collect()}
    assert {r["path"] for r in back.values()} == {"success/lab/ep0.h5", "failure/lab/ep1.h5"} and back[1]["steps"][0]["gripper"] == [0.0]
    assert [(s["is_first"], s["is_last"], s["reward"]) for s in back[0]["steps"]] == [(True, False, 0.0), (False, False, 0.0), (False, False, 0.0), (False, True, 1.0)]
    with pytest.raises(AnalysisException):
        conversion.write_training(rows, f"{tmp_path}/out")


def test_first_episodes_go_by_path(spark):
    rows = spark.createDataFrame([(f"p{i}",) for i in (3, 1, 2)], "rel_path string")
    assert [r["rel_path"] for r in reporting.first_episodes(rows, 2).collect()] == ["p1", "p2"]
