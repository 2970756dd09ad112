"""Registered queries of annotations, layout, evaluation and export, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.operators import annotations as ann
from tendon.operators import collections_ as col
from tendon.sources import episodes as src

ANNOTATIONS = """SELECT d.doc_id AS episode_id, concat('a', CAST(k AS VARCHAR(3))) AS annotator, CASE WHEN lang = 'de' THEN 'tool' WHEN lang = 'fr' THEN '' ELSE 'human' END AS source,
    CASE WHEN (d.doc_id + k) % 13 = 1 THEN 'yes' WHEN (d.doc_id + k) % 13 = 2 THEN 'NaN' WHEN (d.doc_id + k) % 17 = 3 THEN NULL WHEN quality IS NULL THEN '0.5' ELSE CAST(quality AS VARCHAR(3)) END AS success,
    CASE WHEN (d.doc_id + k) % 3 = 0 THEN 'failure_taxonomy_v2' ELSE 'failure_taxonomy_v1' END AS schema,
    CASE WHEN (d.doc_id + k) % 4 = 0 THEN NULL WHEN (d.doc_id + k) % 4 = 1 THEN ' ' ELSE CASE WHEN d.doc_id % 5 = 0 THEN 'Dropped it' ELSE text END END AS episode_description,
    CASE WHEN (d.doc_id + k) % 5 = 1 THEN 'dropped it' END AS failure_description,
    CASE (d.doc_id + k) % 9 WHEN 0 THEN '{"outcome": "failure", "failure_category": ["grasp", " "], "severity": "medium"}' WHEN 1 THEN '{"failure_category": ["Grasp failure (at contact)", "odd one"], "severity": "Low severity - no damage"}'
      WHEN 2 THEN '{"success_category": "Clean success"}' WHEN 3 THEN '{"success_category": "Success with side-effects", "side_effect_category": ["Collision failure"], "severity": "Catastrophic damage"}'
      WHEN 4 THEN '{broken' WHEN 5 THEN '{"outcome": " Success_Suboptimal "}' WHEN 6 THEN '{"outcome": "unheard", "severity": "grave"}' WHEN 7 THEN '{}' END AS taxonomy
  FROM DOCUMENTS d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM LABELS GROUP BY doc_id) l ON l.doc_id = d.doc_id CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) x WHERE k = 0 OR d.doc_id % 3 = 0"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    sql = ANNOTATIONS.replace("{", "{{").replace("}", "}}").replace("DOCUMENTS", "{documents}").replace("LABELS", "{labels}")
    return spark.sql(sql, documents=read("documents"), labels=read("labels"))


def annotation_upcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = ann.upcast(_rows(spark, sf_dir))
    return up.select("episode_id", "annotator", "outcome", "description", F.array_join("categories", ",").alias("categories"), "severity")


def annotation_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.completeness(ann.upcast(_rows(spark, sf_dir)))


def unmapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.unmapped(ann.upcast(_rows(spark, sf_dir)))


def migration_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.migrated(_rows(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def migrated_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.migrated(_rows(spark, sf_dir))


def migration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.migration_report(_rows(spark, sf_dir))


def written_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upcast annotations as they would be written; the outcomes of some are blank or unheard of."""
    outcome = F.when(F.col("episode_id") % 7 == 0, " Success ").when(F.col("episode_id") % 7 == 1, "unheard").otherwise(F.col("outcome"))
    return ann.built(ann.upcast(_rows(spark, sf_dir)).withColumn("outcome", outcome))


def annotation_write_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = F.when(F.col("episode_id") % 11 == 3, 1.5).when(F.col("episode_id") % 11 == 4, -0.25).otherwise(0.0)
    rows = ann.upcast(_rows(spark, sf_dir)).withColumn("success", F.col("success").try_cast("double") + shift)
    return ann.write_checked(rows.withColumn("outcome", F.when(F.col("episode_id") % 5 != 0, F.get_json_object("taxonomy", "$.outcome"))))


def strict_annotation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.strict_violations(_rows(spark, sf_dir))


def legacy_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second annotator's own annotations, and flat ones of the first annotator where there are none."""
    rows = _rows(spark, sf_dir)
    flat = F.when(F.col("episode_id") % 4 == 1, F.lit("{broken")).when(F.col("episode_id") % 4 == 2, F.to_json(F.struct(
        F.col("success"), F.col("episode_description").alias("failure_description"), F.array(F.lit("Grasp failure (at contact)")).alias("failure_category"), F.lit("Low severity").alias("severity"))))
    found = ann.with_legacy(rows, rows.where("annotator = 'a0'").select("episode_id", flat.alias("flat")), "a1")
    return found.withColumn("categories", F.array_join("categories", ","))


def recent_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.recent_annotations(ann.upcast(_rows(spark, sf_dir)).where("annotator = 'a0'"), src.episodes(spark, sf_dir))


def success_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.consensus(_rows(spark, sf_dir))


def copied_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.copied_descriptions(ann.upcast(_rows(spark, sf_dir)))


def other_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.other_annotators(_rows(spark, sf_dir))


def instruction_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.instruction_diversity(src.episodes(spark, sf_dir))


def recent_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.recent_instructions(src.episodes(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col.files_of(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def directory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col.directory_counts(_files(spark, sf_dir), 3)


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col.inventory(_files(spark, sf_dir))


def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col.split_plan(_files(spark, sf_dir), 4)


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col.unique_names(_files(spark, sf_dir))


def _rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col.rollouts(spark.read.parquet(f"{sf_dir}/events.parquet"))


def rollout_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col.evaluation(_rollouts(spark, sf_dir))


def success_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col.success_curve(col.evaluation(_rollouts(spark, sf_dir)), 4)


def training_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col.training_steps(src.steps(spark, sf_dir), src.episodes(spark, sf_dir))


def absolute_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col.absolute_actions(src.steps(spark, sf_dir))


_A = "WITH an AS (" + ANNOTATIONS.replace("DOCUMENTS", "documents").replace("LABELS", "labels") + """),
  j AS (SELECT *, CASE WHEN json_valid(taxonomy) THEN taxonomy END AS js, try_cast(success AS DOUBLE) AS v FROM an),
  k AS (SELECT *, lower(trim(js->>'$.outcome')) AS o, CASE WHEN v IS NULL THEN NULL WHEN NOT isnan(v) AND v >= 0.5 THEN 'success' ELSE 'failure' END AS plain,
      list_filter(coalesce(CAST(js->'$.failure_category' AS VARCHAR[]), []), lambda x: trim(x) <> '') AS fc, list_filter(coalesce(CAST(js->'$.side_effect_category' AS VARCHAR[]), []), lambda x: trim(x) <> '') AS sc,
      nullif(trim(js->>'$.severity'), '') AS sv FROM j),
  up AS (SELECT episode_id, annotator, source, success, schema, taxonomy, o,
      CASE WHEN o IN ('success', 'success_suboptimal', 'success_side_effect', 'failure') THEN o WHEN plain = 'success' THEN
        CASE lower(trim(js->>'$.success_category')) WHEN 'success with side-effects' THEN 'success_side_effect' WHEN 'suboptimal execution' THEN 'success_suboptimal' ELSE 'success' END ELSE plain END AS outcome,
      CASE WHEN trim(episode_description) <> '' THEN episode_description WHEN trim(failure_description) <> '' THEN failure_description END AS description,
      list_transform(CASE WHEN len(fc) > 0 THEN fc ELSE sc END, lambda x: CASE lower(x) WHEN 'grasp failure (at contact)' THEN 'grasp' WHEN 'collision failure' THEN 'collision' ELSE x END) AS cats,
      CASE WHEN lower(sv) IN ('low', 'medium', 'catastrophic') THEN lower(sv) WHEN lower(sv) LIKE 'low severity%' THEN 'low' WHEN lower(sv) LIKE 'medium severity%' THEN 'medium'
        WHEN lower(sv) LIKE 'catastrophic%' THEN 'catastrophic' ELSE sv END AS severity FROM k)"""
_FILES = "WITH f0 AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, length(html)::BIGINT AS size FROM pages), f AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name, size FROM f0)"
_ROLL = "WITH r AS (SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, CASE WHEN event_id % 10 <> 0 THEN least(4, floor(abs(value) / 10))::INT END AS reward FROM events), p AS (SELECT episode_id, coalesce(sum(reward), 0)::BIGINT AS total, max(reward) AS highest, arg_max_null(reward, t) AS last FROM r GROUP BY ALL)"

_CATS = "'reaching', 'grasp', 'manipulation', 'sequencing_semantic', 'collision', 'hardware', 'not_attempted', 'other'"
_STATUS = """CASE WHEN up.schema = 'failure_taxonomy_v2' OR coalesce(o IN ('success', 'success_suboptimal', 'success_side_effect', 'failure'), false) THEN 'already v2' WHEN up.success IS NULL AND up.taxonomy IS NULL THEN 'not an annotation' ELSE 'migrated' END"""
_TAXONOMY = "json_object('outcome', coalesce(outcome, ''), 'failure_category', cats, 'severity', coalesce(severity, ''))::VARCHAR"

QUERIES = {f.__name__: f for f in (
    annotation_upcast, annotation_ticks, unmapped_labels, migration_status, migrated_annotations, migration_report, written_annotations, annotation_write_checks,
    strict_annotation_violations, legacy_annotations, recent_annotations, success_consensus, copied_descriptions, other_annotators, instruction_diversity, recent_instructions,
    directory_counts, file_inventory, split_plan, unique_names, rollout_evaluation, success_curve, training_steps, absolute_actions,
)}
ORACLE_SQL = {
    "annotation_upcast": _A + " SELECT episode_id, annotator, outcome, description, array_to_string(cats, ',') AS categories, severity FROM up",
    "annotation_ticks": _A + """ SELECT episode_id, annotator, CASE WHEN outcome IS NULL THEN 0 WHEN outcome = 'success' OR (outcome = 'success_suboptimal' AND description IS NOT NULL)
        OR (description IS NOT NULL AND len(cats) > 0 AND severity IS NOT NULL) THEN 2 ELSE 1 END AS tick FROM up""",
    "unmapped_labels": _A + """ SELECT * FROM (SELECT episode_id, annotator, 'category' AS field, unnest(cats) AS value FROM up) WHERE value NOT IN ('reaching', 'grasp', 'manipulation', 'sequencing_semantic', 'collision', 'hardware', 'not_attempted', 'other')
        UNION ALL SELECT episode_id, annotator, 'severity', severity FROM up WHERE severity NOT IN ('low', 'medium', 'catastrophic')""",
    "migration_status": _A + """ SELECT CASE WHEN schema = 'failure_taxonomy_v2' OR o IN ('success', 'success_suboptimal', 'success_side_effect', 'failure') THEN 'already v2' WHEN success IS NULL AND taxonomy IS NULL THEN 'not an annotation'
        ELSE 'migrated' END AS status, count(*) AS n FROM up GROUP BY 1""",
    "success_consensus": _A + """, g AS (SELECT episode_id, count(success) AS n, count(*) FILTER (success IS NOT NULL AND NOT coalesce(v IN (0, 1), false)) AS bad, min(v) AS lo, max(v) AS hi FROM j GROUP BY ALL)
        SELECT episode_id, CASE WHEN n = 0 THEN 'none' WHEN bad > 0 THEN 'invalid' WHEN lo <> hi THEN 'conflict' WHEN lo = 1 THEN '1' ELSE '0' END AS verdict FROM g""",
    "copied_descriptions": _A + """, g AS (SELECT lower(trim(description)) AS d, count(*) AS k FROM up WHERE trim(description) <> '' GROUP BY 1), x AS (SELECT *, sum(k) OVER () AS n FROM g ORDER BY k DESC, d LIMIT 1)
        SELECT n::BIGINT AS n, k AS top, round(k / n, 6) AS share, d AS description, CASE WHEN n >= 5 AND k / n > 0.8e0 THEN 'copied' ELSE '' END AS warning FROM x""",
    "migrated_annotations": _A + f""", m AS (SELECT up.*, {_STATUS} AS status, an.episode_description AS ed FROM up JOIN an USING (episode_id, annotator))
        SELECT episode_id, annotator, status, CASE WHEN status = 'migrated' THEN 'failure_taxonomy_v2' ELSE schema END AS schema, CASE WHEN status = 'migrated' THEN 'failure_taxonomy_v2' END AS taxonomy_schema,
          CASE WHEN status = 'migrated' THEN coalesce(description, '') ELSE ed END AS episode_description, CASE WHEN status = 'migrated' THEN {_TAXONOMY} ELSE taxonomy END AS taxonomy FROM m""",
    "migration_report": _A + f""", m AS (SELECT episode_id, annotator, {_STATUS} AS status FROM up),
      x AS (SELECT episode_id, array_to_string(list_sort(list(annotator) FILTER (status = 'migrated')), ',') AS migrated, array_to_string(list_sort(list(concat(annotator, ':', status)) FILTER (status <> 'migrated')), ',') AS skipped FROM m GROUP BY ALL),
      o AS (SELECT DISTINCT episode_id, concat(annotator, ':', value) AS v FROM (SELECT episode_id, annotator, unnest(cats) AS value FROM up) WHERE value NOT IN ({_CATS})
        UNION SELECT episode_id, concat(annotator, ':', severity) FROM up WHERE severity NOT IN ('low', 'medium', 'catastrophic')), p AS (SELECT episode_id, array_to_string(list_sort(list(v)), ',') AS unmapped FROM o GROUP BY ALL)
      SELECT episode_id, coalesce(migrated, '') AS migrated, coalesce(skipped, '') AS skipped, coalesce(unmapped, '') AS unmapped FROM x LEFT JOIN p USING (episode_id)""",
    "written_annotations": _A + f""", w AS (SELECT * REPLACE (lower(trim(coalesce(CASE episode_id % 7 WHEN 0 THEN ' Success ' WHEN 1 THEN 'unheard' ELSE outcome END, ''))) AS outcome) FROM up)
      SELECT episode_id, annotator, 'failure_taxonomy_v2' AS schema, CASE WHEN source <> '' THEN source ELSE 'human' END AS source, coalesce(description, '') AS episode_description,
        CASE WHEN outcome = 'failure' THEN 0e0 WHEN outcome IN ('success', 'success_suboptimal', 'success_side_effect') THEN 1e0 END AS success, {_TAXONOMY} AS taxonomy FROM w""",
    "annotation_write_checks": _A + """, w AS (SELECT episode_id, annotator, try_cast(success AS DOUBLE) + CASE episode_id % 11 WHEN 3 THEN 1.5e0 WHEN 4 THEN -0.25e0 ELSE 0e0 END AS s, CASE WHEN episode_id % 5 <> 0 THEN o END AS o FROM up),
      x AS (SELECT *, coalesce(nullif(o, ''), CASE WHEN s IS NULL THEN NULL WHEN NOT isnan(s) AND s >= 0.5e0 THEN 'success' ELSE 'failure' END) AS outcome FROM w)
      SELECT episode_id, annotator, s AS success, outcome, CASE WHEN s IS NULL OR isnan(s) OR s < 0 OR s > 1 THEN 'success_range' WHEN outcome NOT IN ('success', 'success_suboptimal', 'success_side_effect', 'failure') THEN 'outcome'
        WHEN (outcome = 'failure') <> (s < 0.5e0) THEN 'disagrees' END AS rejected FROM x""",
    "strict_annotation_violations": _A + f""", x AS (SELECT up.*, v, an.taxonomy AS tx, coalesce(o, '') AS oo FROM up JOIN j USING (episode_id, annotator) JOIN an USING (episode_id, annotator)),
      r AS (SELECT episode_id, annotator, CASE WHEN success IS NULL THEN 'success_missing' WHEN v IS NULL THEN 'success_not_numeric' WHEN isnan(v) THEN 'success_nan' WHEN isinf(v) THEN 'success_infinite' WHEN v < 0 OR v > 1 THEN 'success_range'
        WHEN trim(coalesce(tx, '')) = '' THEN NULL WHEN NOT json_valid(tx) THEN 'taxonomy_not_json' WHEN json_type(tx) <> 'OBJECT' THEN 'taxonomy_not_object'
        WHEN oo <> '' AND oo NOT IN ('success', 'success_suboptimal', 'success_side_effect', 'failure') THEN 'outcome_unknown' WHEN oo <> '' AND (oo = 'failure') <> (v < 0.5e0) THEN 'outcome_disagrees'
        WHEN len(list_filter(cats, lambda c: trim(c) NOT IN ({_CATS}))) > 0 THEN 'category_unknown' WHEN trim(severity) <> '' AND trim(severity) NOT IN ('low', 'medium', 'catastrophic') THEN 'severity_unknown' END AS rule FROM x)
      SELECT * FROM r WHERE rule IS NOT NULL""",
    "legacy_annotations": _A + """, g AS (SELECT episode_id, outcome, description, array_to_string(cats, ',') AS categories, severity, false AS is_legacy FROM up WHERE annotator = 'a1')
      SELECT * FROM g UNION ALL SELECT episode_id, CASE WHEN v IS NULL THEN NULL WHEN NOT isnan(v) AND v >= 0.5e0 THEN 'success' ELSE 'failure' END, CASE WHEN trim(episode_description) <> '' THEN episode_description END, 'grasp', 'low', true
      FROM j WHERE annotator = 'a0' AND episode_id % 4 = 2 AND episode_id NOT IN (SELECT episode_id FROM g)""",
    "recent_annotations": _A + f""", eps AS ({src.for_engine(src.episodes_sql(), 'list_value').replace('{events}', 'events')}),
      n AS (SELECT mtime, rel_path, outcome, array_to_string(cats, ',') AS categories, severity, description,
        row_number() OVER (PARTITION BY list_sort(cats), trim(coalesce(severity, '')), trim(coalesce(description, '')) ORDER BY mtime DESC, rel_path DESC) AS k FROM up JOIN eps USING (episode_id) WHERE annotator = 'a0' AND outcome <> 'success')
      SELECT CAST(row_number() OVER (ORDER BY mtime DESC, rel_path DESC) AS INT) AS rank, rel_path, outcome, categories, severity, description FROM n WHERE k = 1 ORDER BY mtime DESC, rel_path DESC LIMIT 15""",
    "other_annotators": _A + """ SELECT episode_id, annotator, EXISTS (SELECT 1 FROM an b WHERE b.episode_id = a.episode_id AND b.annotator <> a.annotator AND trim(coalesce(b.source, '')) IN ('', 'human')) AS others FROM an a""",
    "instruction_diversity": src.as_cte("episodes") + """, g AS (SELECT lab_id AS "group", count(*) AS n, count(DISTINCT nullif(lower(trim(language_instruction)), '')) AS "distinct" FROM episodes GROUP BY 1)
        SELECT *, CASE WHEN n >= 5 AND "distinct" <= 1 THEN 'one instruction' WHEN n >= 10 AND "distinct" < 0.1e0 * n THEN 'few instructions' ELSE '' END AS warning FROM g""",
    "recent_instructions": src.as_cte("episodes") + """, r AS (SELECT trim(language_instruction) AS instruction, mtime, episode_id, row_number() OVER (PARTITION BY lower(trim(language_instruction)) ORDER BY mtime DESC, episode_id DESC) AS k
        FROM episodes WHERE trim(language_instruction) <> '') SELECT CAST(row_number() OVER (ORDER BY mtime DESC, episode_id DESC) AS INT) AS rank, instruction FROM r WHERE k = 1 ORDER BY mtime DESC, episode_id DESC LIMIT 10""",
    "directory_counts": _FILES + ", g AS (SELECT dir, count(*) AS n_files, count(*) FILTER (regexp_matches(lower(name), '\\.(html|h5|hdf5)$')) AS n_episodes FROM f GROUP BY dir) SELECT *, CASE WHEN n_episodes > 0 THEN 'splittable' ELSE 'unfixable' END AS verdict FROM g WHERE n_files > 3",
    "file_inventory": _FILES + ", o AS (SELECT path, max(size) AS size FROM f GROUP BY path) SELECT CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '(root)' END AS folder, count(*) AS n_files, sum(size)::BIGINT AS n_bytes FROM o GROUP BY 1",
    "split_plan": _FILES + """, r AS (SELECT *, ((row_number() OVER (PARTITION BY dir ORDER BY path) - 1) // 4)::VARCHAR AS i, count(*) OVER (PARTITION BY dir) AS n FROM (SELECT DISTINCT path, dir, name FROM f))
        SELECT path, CASE WHEN n > 4 THEN concat(dir, '/', CASE WHEN length(i) >= 3 THEN i ELSE lpad(i, 3, '0') END, '/', name) ELSE path END AS new_path FROM r""",
    "unique_names": _FILES + ", r AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY path) AS k FROM (SELECT DISTINCT dir, name, path FROM f)) SELECT dir, path, CASE WHEN k > 1 THEN concat(name, '_', k) ELSE name END AS unique_name FROM r",
    "rollout_evaluation": _ROLL + " SELECT episode_id, total, highest, last FROM p",
    "success_curve": _ROLL + " SELECT CAST(l AS INT) AS reward, round(avg(CASE WHEN highest >= l THEN 1e0 ELSE 0e0 END), 6) AS share FROM p, range(0, 5) t(l) GROUP BY l",
    "training_steps": src.as_cte("steps", "episodes") + """, w AS (SELECT episode_id, t, coalesce(max(vals) FILTER (grp = 'state' AND key = 'joint_position'), list_value(0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0)) AS joints,
        coalesce(max(vals) FILTER (grp = 'action' AND key = 'gripper_position'), [0e0]) AS grip, coalesce(max(vals) FILTER (grp = 'state' AND key = 'gripper_position'), [0e0]) AS held FROM steps GROUP BY ALL)
      SELECT episode_id, t, round(list_sum(joints), 6) AS joint_sum, grip[1] AS grip, held[1] AS held, t = 0 AS is_first, t = trajectory_length - 1 AS is_last, CAST(t = trajectory_length - 1 AS INT) AS reward, language_instruction FROM w JOIN episodes USING (episode_id)""",
    "absolute_actions": src.as_cte("steps") + """, p AS (SELECT episode_id, t, vals AS a, lead(vals) OVER w AS n, lag(vals) OVER w AS l FROM steps WHERE grp = 'state' AND key = 'cartesian_position' WINDOW w AS (PARTITION BY episode_id ORDER BY t))
      SELECT episode_id, t, """ + ", ".join(f"round(coalesce(n[{i}], a[{i}] + a[{i}] - coalesce(l, a)[{i}]), 6) AS {x}" for i, x in ((1, "x"), (2, "y"), (3, "z"))) + " FROM p",
}
