"""Metadata checks, the written report, and samples of episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendon.functions.columns import normal_name
from tendon.operators.config import DEFAULTS, Config

c = F.col
METADATA = ("operator_name", "policy_name", "robot_name", "gripper_name")


def placeholder_metadata(names: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """``(episode_id, field, problem)`` of blank, placeholder, template and impersonal names.

    ``names`` has ``episode_id`` and the fields of METADATA; a missing name is blank.
    """
    own = config["general"]["placeholder_metadata"]
    norm = lambda xs: [x.strip().lower().replace(" ", "_").replace("-", "_") if x.strip("- ") else x.replace("-", "_") for x in xs]
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), c(f).alias("value")) for f in METADATA))).alias("found")
    rows = names.select("episode_id", each).select("episode_id", "found.field", "found.value")
    n = normal_name(F.coalesce("value", F.lit("")))
    words = F.transform(F.filter(F.split(n, "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.regexp_replace(w, "[0-9]+$", ""))
    person = c("field") == "operator_name"
    problem = (
        F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "blank").when(n.isin(*norm(own["placeholder_values"])), "placeholder")
        .when(_any(n.startswith(p) for p in norm(own["template_prefixes"])), "template")
        .when(person & n.isin(*norm(own["operator_placeholder_values"])), "placeholder")
        .when(person & F.arrays_overlap(words, F.array(*map(F.lit, own["operator_non_person_words"]))), "not_a_person")
    )
    return rows.select("episode_id", "field", problem.alias("problem")).where("problem is not null")


def _any(conditions) -> Column:
    out = F.lit(False)
    for cond in conditions:
        out = out | cond
    return out


def write_report(rows: DataFrame, at: str) -> None:
    """The report as JSON lines, a folder per status; a folder that is there is refused."""
    rows.write.mode("errorifexists").partitionBy("status").json(at)


def sampled(episodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """N episodes drawn by a seeded hash of the path, the same on every run; all of them for 0."""
    rows = episodes if n <= 0 else episodes.orderBy(F.xxhash64(F.lit(seed), "rel_path"), "rel_path").limit(n)
    return rows.orderBy("rel_path")


def first_episodes(episodes: DataFrame, n: int) -> DataFrame:
    """The first n episodes by path."""
    return episodes.orderBy("rel_path").limit(n)
