"""A ledger of checks: what ran, what was passed over and why, and what was found, for every episode.

Each category writes its outcomes to a partition of its own, so one category can run again alone; a roll-up reads the
outcomes once and keeps three sets of bits per episode, one bit per check of the catalogue. Statuses, counts and
summaries are sums over bits.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.functions.columns import significant_text
from tendon.operators.config import CHECKS, DEFAULTS, Config, action_of
from tendon.operators.motion import FINDING, Rule

c = F.col
#: The place of each check in the sets, in the order of the catalogue.
BITS: dict[tuple[str, str], int] = {(k, x): i for i, (k, x) in enumerate((k, x) for k, xs in CHECKS.items() for x in xs)}
OUTCOME = f"episode_id bigint, check_name string, outcome string, key string, {FINDING}, category string"
#: A check, the condition in SQL under which it concerns a row, and in SQL the reason why it is passed over there, null if it runs.
Coverage = tuple[str, str, str]


def mask(pairs) -> int:
    return reduce(lambda a, p: a | 1 << BITS[p], pairs, 0)


ACTIONABLE = mask((k, x) for k, x in BITS if action_of(k, x) != "informational")


def outcomes(rows: DataFrame, category: str, coverage: list[Coverage], config: Config, rules: list[Rule] = (), key: str = "key") -> DataFrame:
    """``OUTCOME`` rows of one category, from one pass (``outcomes_of``)."""
    return outcomes_of(rows, {category: (coverage, rules)}, config, key)


def outcomes_of(rows: DataFrame, checks: dict[str, tuple[list[Coverage], list[Rule]]], config: Config, key: str = "key") -> DataFrame:
    """``OUTCOME`` rows of several categories from one pass: rules that hold are ``found``, coverage is ``ran`` or ``skipped``
    with its reason as ``note``.

    Disabled checks have no outcome. ``rows`` has ``episode_id`` and what the conditions name; ``key`` is SQL.
    """
    fields = [x.split() for x in FINDING.split(", ")]

    def found(category: str, name: str, told: dict[str, Column]) -> Column:
        given = {f: F.round(told[f].cast(t), 6) if t == "double" else told[f].cast(t) for f, t in fields if f in told}
        values = (given.get(f, F.expr(f"CAST(NULL AS {t})")).alias(f) for f, t in fields)
        return F.struct(F.lit(name).alias("check_name"), F.lit("found").alias("outcome"), told.get("key", F.expr(key)).alias("key"), *values, F.lit(category).alias("category"))

    nothing = ", ".join(f"'{f}', CAST(NULL AS {t})" for f, t in fields if f != "note")
    entries, held = [], []
    for category, (coverage, rules) in checks.items():
        on = config[category]
        for name, applies, reason in coverage:
            if on[name]["enabled"]:
                why = f"CAST({reason} AS STRING)"
                entries.append(f"CASE WHEN {applies} THEN named_struct('check_name', '{name}', 'outcome', CASE WHEN {why} IS NULL THEN 'ran' ELSE 'skipped' END, 'key', {key}, {nothing}, 'note', {why}, 'category', '{category}') END")
        held += [F.when(cond, found(category, name, told)) for name, cond, told in rules if on[name]["enabled"]]
    parts = ([F.expr("array(" + ", ".join(entries) + ")")] if entries else []) + ([F.array(*held)] if held else [])
    if not parts:
        return rows.sparkSession.createDataFrame([], OUTCOME)
    out = rows.select("episode_id", F.explode(F.concat(*parts)).alias("outcome_entry")).where("outcome_entry is not null")
    return out.select("episode_id", "outcome_entry.*")


def found_rows(found: DataFrame, category: str, config: Config, check: str | None = None, key: str = "key", **told: str) -> DataFrame:
    """``OUTCOME`` rows of findings made elsewhere; ``told`` names SQL for what a finding tells. Disabled checks are left out."""
    name = F.lit(check) if check else c("check_name")
    fields = [F.expr(f"CAST({told.get(f, 'NULL')} AS {t})") for f, t in (x.split() for x in FINDING.split(", "))]
    names = [x.split()[0] for x in FINDING.split(", ")]
    kinds = [x.split()[1] for x in FINDING.split(", ")]
    values = [(F.round(v, 6) if t == "double" else v).alias(n) for v, n, t in zip(fields, names, kinds)]
    rows = found.select("episode_id", name.alias("check_name"), F.lit("found").alias("outcome"), F.expr(key).cast("string").alias("key"), *values, F.lit(category).alias("category"))
    return rows.where(c("check_name").isin(*(k for k, v in config[category].items() if v["enabled"])))


def write(rows: DataFrame, at: str) -> None:
    """Put the outcomes of the categories in ``rows`` in place of the ones that are there; other categories stay as they are."""
    rows.write.partitionBy("category").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(at)


def read(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(OUTCOME).parquet(at)


def bits(outcome: DataFrame) -> DataFrame:
    """``(episode_id, ran, skipped, found, n_findings)``: bit i of a set stands for check i of the catalogue.

    A check that ran for one key and was passed over for another is in both sets.
    """
    place = F.expr("element_at(map(" + ", ".join(f"'{k}.{x}', {1 << i}L" for (k, x), i in BITS.items()) + "), concat(category, '.', check_name))")
    rows = outcome.select("episode_id", "outcome", place.alias("bit"))
    one = lambda o: F.coalesce(F.bit_or(F.when(c("outcome") == o, c("bit"))), F.lit(0).cast("long"))
    return rows.groupBy("episode_id").agg(*(one(o).alias(o) for o in ("ran", "skipped", "found")), F.count_if(c("outcome") == "found").alias("n_findings"))


def names_of(bits: str) -> Column:
    """The checks of a set, in order of name, comma-joined."""
    by_name = sorted((f"{k}.{x}", 1 << i) for (k, x), i in BITS.items())
    return F.expr("array_join(filter(array(" + ", ".join(f"CASE WHEN {bits} & {b}L <> 0 THEN '{n}' END" for n, b in by_name) + "), x -> x IS NOT NULL), ',')")


def statuses(episodes: DataFrame, sets: DataFrame) -> DataFrame:
    """``(episode_id, status, flagged, n_ran, n_skipped, n_findings)``: error before flagged before clean before not_checked.

    Informational checks flag nothing; an episode for which no check ran is not_checked.
    """
    zero = F.lit(0).cast("long")
    rows = episodes.select("episode_id", "read_error").join(sets, "episode_id", "left")
    rows = rows.withColumns({x: F.coalesce(x, zero) for x in ("ran", "skipped", "found", "n_findings")}).withColumn("flags", c("found").bitwiseAND(F.lit(ACTIONABLE)))
    status = F.when(c("read_error").isNotNull(), "error").when(c("flags") != 0, "flagged").when(c("ran") != 0, "clean").otherwise("not_checked")
    return rows.select("episode_id", status.alias("status"), names_of("flags").alias("flagged"), F.bit_count("ran").cast("long").alias("n_ran"), F.bit_count("skipped").cast("long").alias("n_skipped"), "n_findings", "ran", "skipped", "found")


def status_counts(status: DataFrame) -> DataFrame:
    """``(status, n, n_flagged_checks, n_findings)``."""
    flags = F.bit_count(c("found").bitwiseAND(F.lit(ACTIONABLE)))
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(flags).cast("long").alias("n_flagged_checks"), F.sum("n_findings").alias("n_findings"))


def summary(status: DataFrame, outcome: DataFrame, catalogue: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """The catalogue with the episodes in which each check ran, was passed over and found something, its findings, and its
    settings that aren't the defaults as JSON; 0 for checks without outcome. Sums of bits, one row for all episodes."""
    sums = [F.sum(F.shiftright(c(o), i).bitwiseAND(F.lit(1))).alias(f"{o}_{i}") for i in range(len(BITS)) for o in ("ran", "skipped", "found")]
    whole = status.where("status <> 'error'").agg(*sums)
    entries = ", ".join(f"named_struct('category', '{k}', 'check_name', '{x}', 'ran', coalesce(ran_{i}, 0L), 'skipped', coalesce(skipped_{i}, 0L), 'episodes', coalesce(found_{i}, 0L))" for (k, x), i in BITS.items())
    per = whole.select(F.expr(f"inline(array({entries}))"))
    said = outcome.where("outcome = 'found'").groupBy("category", "check_name").agg(F.count(F.lit(1)).alias("findings"))
    changed = {(k, x): {n: v for n, v in config[k][x].items() if v != DEFAULTS[k][x][n]} for k, x in BITS}
    own = F.expr("element_at(map(" + ", ".join(f"'{k}.{x}', '{json.dumps(v)}'" for (k, x), v in changed.items()) + "), concat(category, '.', check_name))")
    rows = catalogue.join(per, ["category", "check_name"], "left").join(said, ["category", "check_name"], "left")
    return rows.select("category", "check_name", "description", "confidence", "suggested_action", "enabled", "ran", "skipped", "episodes", F.coalesce("findings", F.lit(0)).alias("findings"), own.alias("overrides"))


def records(status: DataFrame, outcome: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``(episode_id, status, checks_run, flagged, findings, skipped)``: the report's record of each episode as JSON lists.

    A finding has its check, key, all that it tells, and its entry in the catalogue; a skip its check, key and reason.
    """
    known = outcome.join(F.broadcast(catalogue.select("category", "check_name", "description", "confidence", "suggested_action")), ["category", "check_name"], "left")
    check = F.concat_ws(".", "category", "check_name").alias("check")
    finding = F.struct(check, "key", "description", "confidence", "suggested_action", *(significant_text(c(x)).alias(x) for x in ("metric", "other")), "n", "at", "note")
    skip = F.struct(check, "key", c("note").alias("reason"))
    listed = lambda o, x: F.to_json(F.sort_array(F.collect_list(F.when(c("outcome") == o, x)))).alias(o)
    per = known.where("outcome <> 'ran'").groupBy("episode_id").agg(listed("found", finding), listed("skipped", skip))
    rows = status.select("episode_id", "status", c("n_ran").alias("checks_run"), "flagged").join(per, "episode_id", "left")
    return rows.select("episode_id", "status", "checks_run", "flagged", F.coalesce("found", F.lit("[]")).alias("findings"), F.coalesce("skipped", F.lit("[]")).alias("skipped"))
