"""Actions beside the states that observe them, with one exchange on the episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendon.sources.episodes import STATE_KEY_FOR_ACTION


def state_key(key: Column) -> Column:
    pairs = [F.lit(x) for kv in STATE_KEY_FOR_ACTION.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def kept(actions: tuple[str, ...] | None = None) -> Column:
    """Whether a step is of these actions (all for none) or of the states that observe them."""
    if actions is None:
        return F.col("grp").isin("action", "state")
    states = sorted({STATE_KEY_FOR_ACTION[k] for k in actions})
    return ((F.col("grp") == "action") & F.col("key").isin(*actions)) | ((F.col("grp") == "state") & F.col("key").isin(*states))


def located(steps: DataFrame, actions: tuple[str, ...] | None = None) -> DataFrame:
    """Actions of these keys (all for none) and their states, dealt by episode; everything later keeps this partitioning."""
    return steps.where(kept(actions)).repartition("episode_id")


def wide(steps: DataFrame, actions: tuple[str, ...] | None = None) -> DataFrame:
    """``(episode_id, t, actions, states)`` and what lies one or two steps on or one back: maps by key, one row per step.

    Of several arrays under one key at one step, the largest counts.
    """
    pick = lambda g: F.sort_array(F.collect_list(F.when(F.col("grp") == g, F.struct("key", "vals"))))
    rows = located(steps, actions).groupBy("episode_id", "t").agg(pick("action").alias("actions"), pick("state").alias("states"))
    last = lambda x: F.map_from_entries(F.filter(x, lambda y, i: (i == F.size(x) - 1) | (F.get(x, i + 1)["key"] != y["key"])))
    rows = rows.select("episode_id", "t", *(last(x).alias(x) for x in ("actions", "states")))
    w = Window.partitionBy("episode_id").orderBy("t")
    ahead = [F.lead(x, k).over(w).alias(f"{x}_{k}") for x in ("states", "actions") for k in (1, 2)]
    return rows.select("episode_id", "t", "actions", "states", *ahead, F.lag("actions").over(w).alias("last_actions"))


def aligned(steps: DataFrame, actions: tuple[str, ...] | None = None) -> DataFrame:
    """``(episode_id, key, t, a, a_prev, s, s_next, s_next2, more, more2)``: each action with the one before, and the state
    then and at the next two steps; ``more`` says whether the action itself goes on so far.

    States are null where the mapped key has none at that step, so counting pairs stops at the shorter of the two.
    """
    rows = wide(steps, actions).withColumn("x", F.explode(F.map_entries("actions")))
    of = lambda m, k: F.element_at(F.col(m), k)
    own = F.col("x.key")
    k = state_key(own)
    return rows.select(
        "episode_id", own.alias("key"), "t", F.col("x.value").alias("a"), of("last_actions", own).alias("a_prev"), of("states", k).alias("s"), of("states_1", k).alias("s_next"),
        of("states_2", k).alias("s_next2"), of("actions_1", own).isNotNull().alias("more"), of("actions_2", own).isNotNull().alias("more2"),
    )


def rated(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Adds ``hz``, the control rate of the episode; null where it is missing, not finite or not above zero."""
    rate = F.col("control_freq")
    good = ~F.isnan(rate) & (rate > 0) & (rate < float("inf"))
    return rows.join(episodes.select("episode_id", F.when(good, rate).alias("hz")), "episode_id", "left")
