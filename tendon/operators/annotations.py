"""Failure annotations: reading old and new forms alike, migration, completeness, consensus, diversity and recency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

# The vocabulary and its older prose.
OUTCOME_SUCCESS = {"success": 1.0, "success_suboptimal": 1.0, "success_side_effect": 1.0, "failure": 0.0}
CATEGORIES = ("reaching", "grasp", "manipulation", "sequencing_semantic", "collision", "hardware", "not_attempted", "other")
SEVERITIES = ("low", "medium", "catastrophic")
OLD_OUTCOMES = {"clean success": "success", "success with side-effects": "success_side_effect", "suboptimal execution": "success_suboptimal"}
OLD_CATEGORIES = {
    "reaching failure (pre contact)": "reaching", "grasp failure (at contact)": "grasp", "manipulation failure (post contact)": "manipulation",
    "sequencing or semantic failure": "sequencing_semantic", "collision failure": "collision", "hardware/mechanical issue": "hardware",
    "task not attempted": "not_attempted", "other": "other",
}
OLD_SEVERITY_PREFIXES = (("low severity", "low"), ("medium severity", "medium"), ("catastrophic", "catastrophic"))
EXPECTED = {"success": (), "success_suboptimal": ("description",), "success_side_effect": ("description", "category", "severity"), "failure": ("description", "category", "severity")}
SCHEMA_V2 = "failure_taxonomy_v2"
TAXONOMY = "outcome string, failure_category array<string>, severity string, success_category string, side_effect_category array<string>"


def _lookup(x: Column, table: dict[str, object]) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), x)


def value_list(x: Column) -> Column:
    """The entries that aren't blank; null is an empty list."""
    return F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda v: F.trim(v) != "")


def category_slug(x: Column) -> Column:
    return F.when(x.isin(*CATEGORIES), x).otherwise(F.coalesce(_lookup(F.lower(F.trim(x)), OLD_CATEGORIES), x))


def severity_slug(x: Column) -> Column:
    low = F.lower(F.trim(x))
    by_prefix = reduce(lambda w, p: w.when(low.startswith(p[0]), p[1]), OLD_SEVERITY_PREFIXES, F.when(low.isin(*SEVERITIES), low))
    return by_prefix.otherwise(x)


def success_outcome(success: Column) -> Column:
    """What a number says at least; what isn't one says nothing, NaN is no success."""
    value = F.try_cast(success, "double") if hasattr(F, "try_cast") else success.try_cast("double")
    return F.when(value.isNull(), None).when(~F.isnan(value) & (value >= 0.5), "success").otherwise("failure")


def upcast(rows: DataFrame) -> DataFrame:
    """``(episode_id, annotator, source, outcome, description, categories, severity)`` of both forms.

    ``rows`` has ``success, episode_description, failure_description, taxonomy`` as text. Malformed taxonomies count
    as empty; what is absent stays null.
    """
    t = rows.withColumn("t", F.from_json("taxonomy", TAXONOMY))
    known = F.lower(F.trim("t.outcome"))
    plain = success_outcome(c("success"))
    refined = F.when(plain == "success", F.coalesce(_lookup(F.lower(F.trim("t.success_category")), OLD_OUTCOMES), plain)).otherwise(plain)
    outcome = F.when(known.isin(*OUTCOME_SUCCESS), known).otherwise(refined)
    filled = lambda x: F.when(F.trim(x) != "", x)
    own = value_list(c("t.failure_category"))
    raw = F.when(F.size(own) > 0, own).otherwise(value_list(c("t.side_effect_category")))
    return t.select(
        "episode_id", "annotator", "source", outcome.alias("outcome"), F.coalesce(filled(c("episode_description")), filled(c("failure_description"))).alias("description"),
        F.transform(raw, category_slug).alias("categories"), severity_slug(filled(c("t.severity"))).alias("severity"), "success", "schema", "taxonomy", "episode_description",
    )


def completeness(up: DataFrame) -> DataFrame:
    """``(episode_id, annotator, tick)``: 0 without an outcome, 1 with one, 2 if all it asks for is filled."""
    have = {"description": F.trim(F.coalesce("description", F.lit(""))) != "", "category": F.size("categories") > 0, "severity": F.trim(F.coalesce("severity", F.lit(""))) != ""}
    full = F.lit(False)
    for outcome, fields in EXPECTED.items():
        full = full | ((c("outcome") == outcome) & reduce(lambda a, f: a & have[f], fields, F.lit(True)))
    return up.select("episode_id", "annotator", F.when(c("outcome").isNull(), 0).when(full, 2).otherwise(1).alias("tick"))


def unmapped(up: DataFrame) -> DataFrame:
    """``(episode_id, annotator, field, value)`` of categories and severities that have no slug."""
    cats = up.select("episode_id", "annotator", F.lit("category").alias("field"), F.explode("categories").alias("value")).where(~c("value").isin(*CATEGORIES))
    sev = up.where(c("severity").isNotNull() & ~c("severity").isin(*SEVERITIES)).select("episode_id", "annotator", F.lit("severity").alias("field"), c("severity").alias("value"))
    return cats.unionByName(sev)


def migrated(rows: DataFrame) -> DataFrame:
    """``(episode_id, annotator, status, schema, taxonomy_schema, episode_description, taxonomy)``: the rows rewritten to
    the new form, or why a row stays as it is. Idempotent: the new form is "already v2"."""
    up = upcast(rows).withColumn("named", F.lower(F.trim(F.get_json_object("taxonomy", "$.outcome"))))
    done = (c("schema") == SCHEMA_V2) | F.coalesce(c("named").isin(*OUTCOME_SUCCESS), F.lit(False))
    nothing = c("success").isNull() & c("taxonomy").isNull()
    status = F.when(done, "already v2").when(nothing, "not an annotation").otherwise("migrated")
    new = lambda made, old: F.when(status == "migrated", made).otherwise(old)
    return up.select(
        "episode_id", "annotator", status.alias("status"), new(F.lit(SCHEMA_V2), c("schema")).alias("schema"), new(F.lit(SCHEMA_V2), F.lit(None).cast("string")).alias("taxonomy_schema"),
        new(F.coalesce("description", F.lit("")), c("episode_description")).alias("episode_description"), new(taxonomy_json(), c("taxonomy")).alias("taxonomy"),
    )


def migration_report(rows: DataFrame) -> DataFrame:
    """``(episode_id, migrated, skipped, unmapped)``: annotators migrated, annotators and why they weren't, labels without a slug."""
    each = migrated(rows)
    odd = unmapped(upcast(rows)).groupBy("episode_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "annotator", "value"))), ",").alias("unmapped"))
    named = lambda cond, *parts: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.concat_ws(":", *parts)))), ",")
    done = c("status") == "migrated"
    per = each.groupBy("episode_id").agg(named(done, "annotator").alias("migrated"), named(~done, "annotator", "status").alias("skipped"))
    return per.join(odd, "episode_id", "left").withColumn("unmapped", F.coalesce("unmapped", F.lit("")))


def taxonomy_json() -> Column:
    """The taxonomy of an upcast row in its new form."""
    return F.to_json(F.struct(F.coalesce("outcome", F.lit("")).alias("outcome"), c("categories").alias("failure_category"), F.coalesce("severity", F.lit("")).alias("severity")))


def outcome_success(outcome: Column) -> Column:
    """What an outcome says as a number; null if it isn't known."""
    return _lookup(F.lower(F.trim(outcome)), OUTCOME_SUCCESS)


def built(rows: DataFrame) -> DataFrame:
    """The attributes that are written for an annotation ``(episode_id, annotator, outcome, source, description, categories,
    severity)``: ``success`` only if the outcome is known, blank sources as human."""
    outcome = F.lower(F.trim(F.coalesce("outcome", F.lit(""))))
    return rows.withColumn("outcome", outcome).withColumn("categories", F.transform(value_list(c("categories")), category_slug)).withColumn("severity", severity_slug(c("severity"))).select(
        "episode_id", "annotator", F.lit(SCHEMA_V2).alias("schema"), F.coalesce(F.when(c("source") != "", c("source")), F.lit("human")).alias("source"),
        F.coalesce("description", F.lit("")).alias("episode_description"), outcome_success(c("outcome")).alias("success"), taxonomy_json().alias("taxonomy"),
    )


def write_checked(rows: DataFrame) -> DataFrame:
    """``(episode_id, annotator, success, outcome, rejected)`` of annotations ``(success double, outcome)`` that are to be written.

    A missing outcome is taken from the number; the number stays exact. ``rejected`` says why a row may not be written.
    """
    ok = (c("success") >= 0) & (c("success") <= 1)
    outcome = F.coalesce(F.when(F.trim("outcome") != "", F.lower(F.trim("outcome"))), success_outcome(c("success")))
    rejected = (
        F.when(~F.coalesce(ok, F.lit(False)), "success_range").when(~F.coalesce(outcome.isin(*OUTCOME_SUCCESS), F.lit(False)), "outcome")
        .when((outcome == "failure") != (c("success") < 0.5), "disagrees")
    )
    return rows.select("episode_id", "annotator", "success", outcome.alias("outcome"), rejected.alias("rejected"))


def strict_violations(rows: DataFrame) -> DataFrame:
    """``(episode_id, annotator, rule)``: the first rule of a strict reading that each annotation breaks."""
    v = c("success").try_cast("double")
    text = F.trim(F.coalesce("taxonomy", F.lit("")))
    keys = F.json_object_keys("taxonomy")
    named = F.lower(F.trim(F.coalesce(F.get_json_object("taxonomy", "$.outcome"), F.lit(""))))
    valid = F.try_parse_json("taxonomy").isNotNull()
    rule = (
        F.when(c("success").isNull(), "success_missing").when(v.isNull(), "success_not_numeric").when(F.isnan(v), "success_nan").when(F.abs(v) == float("inf"), "success_infinite")
        .when((v < 0) | (v > 1), "success_range").when(text == "", None).when(~valid, "taxonomy_not_json").when(keys.isNull(), "taxonomy_not_object")
        .when((named != "") & ~named.isin(*OUTCOME_SUCCESS), "outcome_unknown").when((named != "") & ((named == "failure") != (v < 0.5)), "outcome_disagrees")
        .when(F.exists("categories", lambda x: ~F.trim(x).isin(*CATEGORIES)), "category_unknown").when((F.trim("severity") != "") & ~F.trim("severity").isin(*SEVERITIES), "severity_unknown")
    )
    return upcast(rows).select("episode_id", "annotator", rule.alias("rule")).where("rule is not null")


def with_legacy(rows: DataFrame, legacy: DataFrame, annotator: str) -> DataFrame:
    """``(episode_id, outcome, description, categories, severity, is_legacy)``: an annotator's own annotation, or what the
    older flat JSON ``(episode_id, flat)`` says; what has neither is left out."""
    own = upcast(rows.where(c("annotator") == annotator)).withColumn("is_legacy", F.lit(False))
    flat = F.from_json("flat", "success string, failure_description string, failure_category array<string>, severity string, success_category string")
    old = legacy.where(F.size(F.json_object_keys("flat")) > 0).withColumn("x", flat)
    made = F.to_json(F.struct("x.failure_category", "x.severity", "x.success_category"))
    old = old.select(
        "episode_id", F.lit(annotator).alias("annotator"), F.lit(None).cast("string").alias("source"), "x.success", F.lit(None).cast("string").alias("schema"),
        F.lit(None).cast("string").alias("episode_description"), "x.failure_description", made.alias("taxonomy"),
    ).join(own.select("episode_id"), "episode_id", "left_anti")
    every = own.unionByName(upcast(old).withColumn("is_legacy", F.lit(True)))
    return every.select("episode_id", "outcome", "description", "categories", "severity", "is_legacy")


def recent_annotations(up: DataFrame, episodes: DataFrame, limit: int = 15) -> DataFrame:
    """``(rank, rel_path, outcome, categories, severity, description)``: one annotator's newest distinct annotations that
    are no clean success, one to a hundred of them."""
    limit = min(max(limit, 1), 100)
    rows = up.where("outcome is not null and outcome <> 'success'").join(episodes.select("episode_id", "rel_path", "mtime"), "episode_id")
    plain = lambda x: F.trim(F.coalesce(x, F.lit("")))
    key = F.to_json(F.struct(F.array_sort("categories").alias("c"), plain(c("severity")).alias("s"), plain(c("description")).alias("d")))
    entry = F.struct("mtime", "rel_path", "outcome", F.array_join("categories", ",").alias("categories"), "severity", "description")
    newest = rows.groupBy(F.md5(key).alias("k")).agg(F.max(entry).alias("x")).select("x.*")
    by = c("mtime").desc(), c("rel_path").desc()
    top = newest.orderBy(*by).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(*by)).alias("rank"), "rel_path", "outcome", "categories", "severity", "description")


def consensus(rows: DataFrame) -> DataFrame:
    """``(episode_id, verdict)``: the annotators' common 0 or 1, or ``none``, ``invalid`` or ``conflict``."""
    v = c("success").try_cast("double")
    per = rows.groupBy("episode_id").agg(F.count("success").alias("n"), F.count_if(c("success").isNotNull() & ~F.coalesce(v.isin(0.0, 1.0), F.lit(False))).alias("bad"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    verdict = F.when(c("n") == 0, "none").when(c("bad") > 0, "invalid").when(c("lo") != c("hi"), "conflict").when(c("lo") == 1.0, "1").otherwise("0")
    return per.select("episode_id", verdict.alias("verdict"))


def instruction_diversity(episodes: DataFrame, by: str = "lab_id") -> DataFrame:
    """``(group, n, distinct, warning)``: sets of five or more with one instruction, or of ten or more with few."""
    text = F.when(F.trim("language_instruction") != "", F.lower(F.trim("language_instruction")))
    per = episodes.groupBy(c(by).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(text).alias("distinct"))
    warn = F.when((c("n") >= 5) & (c("distinct") <= 1), "one instruction").when((c("n") >= 10) & (c("distinct") < 0.1 * c("n")), "few instructions").otherwise("")
    return per.withColumn("warning", warn)


def copied_descriptions(up: DataFrame, least: int = 5, most: float = 0.8) -> DataFrame:
    """``(n, top, share, description, warning)`` of the most common description, ignoring case; one row.

    Of equally common ones the first by code point. There is a warning from ``least`` descriptions on if its share is above ``most``.
    """
    d = F.lower(F.trim("description"))
    counts = up.where(d != "").groupBy(F.md5(d).alias("h")).agg(F.count(F.lit(1)).alias("k"), F.min(d).alias("description"))
    total = counts.agg(F.sum("k").alias("n"))
    top = counts.orderBy(c("k").desc(), "description").limit(1)
    share = c("k") / c("n")
    warning = F.when((c("n") >= least) & (share > most), "copied").otherwise("")
    return top.join(F.broadcast(total)).select("n", c("k").alias("top"), F.round(share, 6).alias("share"), "description", warning.alias("warning"))


def other_annotators(rows: DataFrame) -> DataFrame:
    """``(episode_id, annotator, others)``: whether another human annotated the episode; a blank source is human."""
    human = F.trim(F.coalesce("source", F.lit(""))).isin("", "human")
    per = rows.where(human).groupBy("episode_id").agg(F.collect_set("annotator").alias("humans"))
    own = rows.join(per, "episode_id", "left")
    return own.select("episode_id", "annotator", (F.size(F.array_remove(F.coalesce("humans", F.array().cast("array<string>")), c("annotator"))) > 0).alias("others"))


def recent_instructions(episodes: DataFrame, limit: int = 10) -> DataFrame:
    """``(rank, instruction)``: the newest distinct instructions, whatever their case; one to fifty of them."""
    limit = min(max(limit, 1), 50)
    text = F.trim("language_instruction")
    newest = episodes.where(text != "").groupBy(F.lower(text).alias("k")).agg(F.max(F.struct("mtime", "episode_id", text.alias("instruction"))).alias("x"))
    top = newest.select("x.*").orderBy(c("mtime").desc(), c("episode_id").desc()).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(c("mtime").desc(), c("episode_id").desc())).alias("rank"), "instruction")
