"""Queries of the training-data operators over the test tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.llm import bpe, exact_dedup, factorisation_machine, html_text, kneser_ney, mixing, pii, prefix_trie, quality_rules, sharding, simhash, token_counts, whitening
from tendon.llm.shared import id_crc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.held_out_scores(_documents(spark, sf_dir), id_crc() % 10 == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after edits that Spark draws from its text, and what was encoded for them."""
    before = token_counts.derived_edits(token_counts.trees(_documents(spark, sf_dir)))
    packed = before.withColumn("row", F.struct("doc_id", F.length("text").alias("n_chars"), F.col("tokens")[1].alias("n_tokens"), F.size("edits").alias("n_edits")))
    after = token_counts.edited(packed.drop("doc_id"), id_col="row")
    return after.select(
        "row.doc_id", F.col("row.n_chars").cast("long").alias("n_chars"), F.col("row.n_tokens").cast("long").alias("n_tokens"),
        F.col("row.n_edits").cast("long").alias("n_edits"), F.length("text").cast("long").alias("n_chars_after"),
        F.col("tokens")[1].cast("long").alias("n_tokens_after"), F.col("encoded").alias("n_chars_encoded"), F.sha2("text", 256).alias("text_sha256_after"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_documents(spark, sf_dir), keep="max")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.components(_documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encoded(_documents(spark, sf_dir), decode=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.found(_documents(spark, sf_dir))
    counts = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    counts.append(F.expr("size(filter(spans, x -> x.kind = 'secret'))").cast("long").alias("n_secret"))
    counts.append((F.size("spans") - F.size("base")).cast("long").alias("n_added"))
    return rows.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(_documents(spark, sf_dir))
    base, full = quality_rules.policy_mask("base"), quality_rules.policy_mask("web")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.verdict(base)).alias("base_failed"),
        quality_rules.verdict(base | full).alias("kept"),
        "rule_bits",
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _documents(spark, sf_dir), factorisation_machine.held_out()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = factorisation_machine.scored(docs, factorisation_machine.fitted(docs, labels, ~held_out))
    good = F.when(F.col("score") >= factorisation_machine.THRESHOLD, 1).otherwise(0)
    return rows.select("doc_id", held_out.alias("held_out"), "score", good.cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(_documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fit = whitening.fitted(vectors)
    error = whitening.identity_error(vectors, fit) if fit else 0.0
    return whitening.whitened(vectors, fit).withColumn("identity_error", F.lit(error))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_token_counts": op2_token_counts,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sharding": op12_sharding,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)
    """,
    "op7_quality_rules": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
        p AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w),
        g AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM p),
        rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
        m AS (
            SELECT w.r, doc_id, len(words)::BIGINT AS n_words,
                   length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
                   length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_bangs,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
                   coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN rep ON rep.r = w.r
        ),
        f AS (
            SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines FROM m
        ),
        b AS (
            SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
                + 4 * (100 * n_symbols > 20 * n_words)::INT + 8 * (100 * n_upper > 50 * word_chars)::INT
                + 16 * (100 * n_bangs > 30 * n_words)::INT + 32 * (100 * n_dup_lines > 50 * n_lines)::INT
                + 64 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
                + 128 * (n_words > 1000000)::INT)::BIGINT AS rule_bits
            FROM f
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               rule_bits & 3 <> 0 AS base_failed, rule_bits & 127 = 0 AS kept, rule_bits
        FROM b
    """,
    "op11_prefix_trie": r"""
        WITH ids AS (
            SELECT DISTINCT conv_id AS c, conv_id - conv_id % 20 AS base,
                   -- CRC-32 of the decimal id: eight shifts a byte, the byte xored in before the first
                   xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR d IN string_split(conv_id::VARCHAR, '')])),
                       lambda acc, x: xor(xor(acc, x) >> 1, 3988292384 * (xor(acc, x) & 1))), 4294967295) % 4 AS h
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        t AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        whole AS (
            SELECT ids.c, t.i AS j, 0 AS own, role, text FROM ids JOIN t ON t.c = ids.base AND t.i <= ids.h
            UNION ALL SELECT ids.c, t.i, 1, role, text FROM ids JOIN t ON t.c = ids.c AND t.i > ids.h
        ),
        steps AS (
            SELECT c, row_number() OVER w AS depth, text, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS node
            FROM whole WINDOW w AS (PARTITION BY c ORDER BY own, j ROWS UNBOUNDED PRECEDING)
        ),
        paths AS (
            SELECT c, depth, sha256(node) AS node, coalesce(lag(sha256(node)) OVER (PARTITION BY c ORDER BY depth), 'root') AS parent,
                   len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
            FROM steps
            UNION ALL SELECT c, 0, 'root', NULL, 0 FROM ids
        ),
        nodes AS (SELECT node, any_value(parent) AS parent, any_value(depth)::BIGINT AS depth, min(c) AS c, count(*) AS n, any_value(words) AS words FROM paths GROUP BY node),
        kids AS (SELECT parent AS node, count(*) AS k FROM nodes GROUP BY parent),
        sums AS (
            SELECT p.node, sum((n.n - 1) * n.words)::BIGINT AS saved, count(*) FILTER (kids.k IS NULL) AS leaves
            FROM nodes n JOIN paths p ON p.c = n.c AND p.depth <= n.depth LEFT JOIN kids ON kids.node = n.node GROUP BY p.node
        ),
        last AS (SELECT c, arg_max(node, depth) AS node FROM paths GROUP BY c),
        ends AS (SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM last GROUP BY node)
        SELECT n.c AS conv_id, n.depth, p.c AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children, s.leaves AS n_leaves,
               s.saved AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
        FROM nodes n JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node LEFT JOIN ends e ON e.node = n.node
    """,
}
