"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import chatformat, decisionlist, fmindex, gam, mixing, repair, simhash, suffixdedup, tokencount, urlrules
from quantloom.llm.vocabularies import tokenizer_file
from quantloom.shared import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 3 or fewer differing bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, seed=42, distance=3, blocks=6)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token shards, written and read back."""
    path = new_path(spark, "tokens")
    repair.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return repair.read_documents(spark, path)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that repeated strings of 200 bytes cover."""
    found = suffixdedup.repeated_bytes(_table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    own = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(own, "conv_id long, turn long, role string, text string")
    return chatformat.conversation_digests(chatformat.format_conversations(turns.unionByName(more)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of each document, and the learned decision list's verdict."""
    docs = _table(spark, sf_dir, "documents")
    rules = decisionlist.fit(docs, _table(spark, sf_dir, "labels"), max_labelled=20_000)
    judged = decisionlist.judge(docs, rules, min_words=20, max_repeat_percent=30)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rule").alias("first_rule"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that 10-word windows of the benchmark hit, and the items found."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fmindex.find_contamination(docs, _table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, through a digest cache that starts empty."""
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=512)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The additive model's score of each document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.fit(docs, _table(spark, sf_dir, "labels"), max_labelled=20_000)
    scored = gam.score_documents(docs, model)
    return scored.select("doc_id", gam.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 percent of all sizes, by source weights 3, 1, 2, takes of each document."""
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, passes=2)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standing rules' verdict on each page's url."""
    return urlrules.judge_urls(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_output": op2_token_output,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_mix_sources": op9_mix_sources,
    "op10_url_filters": op10_url_filters,
}

_ESCAPED = r"replace(replace(replace(replace({}, '\', '\\'), '<', '\<'), '[', '\['), ']', '\]')"

ORACLE_SQL: dict[str, str] = {
    "op4_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
            CAST(3 + sum(length({_ESCAPED.format("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
                ELSE 14 + length({_ESCAPED.format("role")}) END) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op9_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place, md5(coalesce(text, '')) AS tie FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
        w AS (
            SELECT *, CAST([3, 1, 2][1 + rank % 3] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
        f AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
            FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (
            SELECT source, rank, source_size, least(cap, max(level) OVER () * weight) AS target FROM f),
        c AS (
            SELECT d.*, t.rank, t.source_size, t.target, sum(size) OVER (PARTITION BY t.rank ORDER BY place, tie ROWS UNBOUNDED PRECEDING) AS done
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        h AS (
            SELECT *, CASE WHEN target > 0 THEN (source_size * k::DOUBLE + done) / target END AS time FROM c, (VALUES (0), (1)) AS p(k)),
        e AS (
            SELECT *, sum(size) OVER (ORDER BY time, rank, k, place, tie ROWS UNBOUNDED PRECEDING) - size AS before,
                (SELECT sum(target) FROM t) AS budget FROM h WHERE time IS NOT NULL)
        SELECT c.doc_id, c.size, c.source_size, c.target, CAST(coalesce(sum(CASE WHEN e.before < e.budget THEN e.size END), 0) AS BIGINT) AS taken
        FROM c LEFT JOIN e ON c.place = e.place AND c.tie = e.tie AND c.rank = e.rank GROUP BY c.doc_id, c.size, c.source_size, c.target""",
    "op10_url_filters": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (
            SELECT *, '.' || host AS h FROM p),
        d AS (
            SELECT page_id, host, path, CASE
                WHEN h LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
                WHEN h LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
                WHEN h LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
                WHEN h LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
                WHEN h LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM r)
        SELECT page_id, host, path, rule, CASE WHEN rule IS NULL OR rule = 'example.com/en/7' THEN 'allow' ELSE 'block' END AS verdict FROM d""",
}
