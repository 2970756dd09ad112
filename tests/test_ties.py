"""Limits that a value lies on exactly, where the last bits of sums must not decide."""

import numpy as np

from tendon.operators import config, motion

EPISODES = "episode_id long, control_freq double, is_biarm boolean, trajectory_length long"


def test_a_ratio_of_sums_at_its_limit_is_not_above_it(spark):
    t = np.arange(66)
    state, command = np.where(t % 20 >= 10, 0.04, 0.0), np.where((t + 1) % 20 >= 10, 0.2, 0.0)  # five times as large: the limit
    rows = [(e, g, "gripper_position", int(i), [float(v)]) for e, f in ((0, 1.0), (1, 1.001)) for g, x in (("state", state), ("action", command * f)) for i, v in enumerate(x)]
    steps = spark.createDataFrame(rows, "episode_id long, grp string, key string, t long, vals array<double>")
    episodes = spark.createDataFrame([(e, 10.0, False, 66) for e in (0, 1)], EPISODES)
    keys = motion.with_states(motion.key_metrics(motion.cell_metrics(steps, episodes, None, motion.GENERAL_KEYS)), motion.state_lengths(steps, motion.GENERAL_KEYS))
    own = config.with_overrides({"general": {"scale_consistency": {"enabled": True}}})
    found = {r["episode_id"] for r in motion.general(keys, own).collect() if r["check_name"] == "scale_consistency"}
    assert found == {1}
