import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendon.functions import columns as col
from tendon.functions import rotations as rot
from tendon.operators import config, reporting


def matrix(q):
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def about(axis, a):
    c, s = math.cos(a), math.sin(a)
    return {"x": np.array([[1, 0, 0], [0, c, -s], [0, s, c]]), "y": np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]), "z": np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])}[axis]


@pytest.mark.parametrize("order", ["xyz", "zyx", "xyx", "XYZ", "ZYX", "XYX"])
def test_euler(spark, order):
    angles = [0.3, -1.1, 2.0]
    q = spark.range(1).select(rot.to_quaternion(F.array(*map(F.lit, angles)), f"euler_{order}").alias("q")).first()["q"]
    r = [about(a.lower(), v) for a, v in zip(order, angles)]
    want = r[2] @ r[1] @ r[0] if order.islower() else r[0] @ r[1] @ r[2]
    assert np.allclose(matrix(q), want, atol=1e-12)


def test_every_representation_gives_the_same_rotation(spark):
    rng = np.random.default_rng(1)
    for _ in range(6):
        q = rng.normal(size=4)
        q /= np.linalg.norm(q)
        m = matrix(q)
        angle = 2 * math.atan2(np.linalg.norm(q[:3]), q[3])
        forms = {"quat": list(2 * q), "matrix": m.ravel().tolist(), "rot6d": [*m[:, 0].tolist(), *(3 * m[:, 1] + m[:, 0]).tolist()], "rotvec": (q[:3] / np.linalg.norm(q[:3]) * angle).tolist()}
        row = spark.range(1).select(*(rot.to_quaternion(F.array(*map(F.lit, map(float, v))), k).alias(k) for k, v in forms.items())).first()
        for k in forms:
            assert np.allclose(matrix(row[k]), m, atol=1e-9), k


def test_names_paths_and_digits(spark):
    row = spark.range(1).select(
        col.slug(F.lit("Pick UP, the Block!")).alias("a"), col.slug(F.lit("--")).alias("b"), col.normal_name(F.lit("  Test - Operator ")).alias("c"),
        col.resolved_path(F.lit("a/b"), F.lit("../c/./d")).alias("d"), col.resolved_path(F.lit("a"), F.lit("../../x")).alias("e"),
        col.significant(F.lit(123456.0)).alias("f"), col.significant(F.lit(-0.00123456)).alias("g"), col.significant(F.lit(0.0)).alias("h"),
    ).first()
    assert tuple(row) == ("pick_up_the_block", "x", "test_operator", "a/c/d", None, 123500.0, -0.001235, 0.0)


def test_settings():
    made = config.with_overrides({"general": {"constant_action": {"atol": "0.5", "enabled": None}}})
    assert made["general"]["constant_action"] == {"enabled": True, "atol": 0.5}
    assert config.overridden(made) == [("general", "constant_action", "atol", 0.5)]
    with pytest.raises(KeyError):
        config.with_overrides({"general": {"nothing": {}}})
    assert not any(c["enabled"] for c in config.without_category(made, "video")["video"].values())
    assert sum(map(len, config.CHECKS.values())) == 57


def test_sampling_is_the_same_each_time(spark):
    rows = spark.createDataFrame([(f"p{i:02d}",) for i in range(20)], "rel_path string")
    one, two = (reporting.sampled(rows, 5, seed=3).collect() for _ in range(2))
    assert one == two and len(one) == 5 and one == sorted(one)
    assert reporting.sampled(rows, 0).count() == 20


def test_angles_are_unwrapped_like_a_numeric_library(spark):
    from tendon.operators import curation

    rng = np.random.default_rng(4)
    angles = (np.cumsum(rng.normal(0, 2.0, 200)) + np.pi) % (2 * np.pi) - np.pi
    rows = spark.createDataFrame([(1, i, float(a)) for i, a in enumerate(angles)], "e long, t long, v double")
    got = [r["unwrapped"] for r in curation.unwrapped(rows, ["e"], "t", "v").orderBy("t").collect()]
    assert np.allclose(got, np.unwrap(angles))


def test_each_arm_has_its_part(spark):
    two = F.array(*map(F.lit, [0.1, 0.2, 0.3, -1.0, 0.5, 0.0]))
    row = spark.range(1).select(rot.arms_to_quaternions(two, "rotvec", 2).alias("q"), *(rot.to_quaternion(F.slice(two, at, 3), "rotvec").alias(f"a{at}") for at in (1, 4))).first()
    assert np.allclose(row["q"], row["a1"] + row["a4"])
