from tendon.operators import validation


def test_quaternions_of_both_arms(spark):
    good, bad = [0.0] * 3 + [0.0, 0.0, 0.0, 1.0], [0.0] * 3 + [0.5, 0.0, 0.0, 0.0]
    rows = [(e, t, "action", "cartesian_position", v) for e, v in enumerate([good, bad, good + good, good + bad, bad + good]) for t in range(2)]
    steps = spark.createDataFrame(rows, "episode_id long, t long, grp string, key string, vals array<double>")
    episodes = spark.createDataFrame([(e, 2) for e in range(5)], "episode_id long, trajectory_length long")
    found = validation.values(steps, episodes).where("rule_order = 18").collect()
    assert sorted(r["episode_id"] for r in found) == [1, 3, 4]
