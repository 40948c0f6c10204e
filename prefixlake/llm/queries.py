"""Queries of the numbered operators, with their SQL where SQL can express them."""

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.llm import encoding, exact_dedup, html_text, licenses, near_dedup, packing, passages, quality, token_counts, transcripts
from prefixlake.llm.shared import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_limits(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of all conversations; each half, by a hash of the id, is parsed by a model of the other half."""
    turns = table(spark, sf_dir, "conversations")
    halves = [turns.filter(F.pmod(F.xxhash64("conv_id"), F.lit(2)) == k) for k in (0, 1)]
    one, two = (transcripts.parse(transcripts.transcripts_of(held), transcripts.fit(other), conversation="conv_id") for held, other in (halves, halves[::-1]))
    return one.unionByName(two)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "spans", F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).alias("n_words"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encoding.encode(table(spark, sf_dir, "documents"), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("known")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_chat_format": op2_chat_format,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_html_text": op4_html_text,
    "op5_bpe": op5_bpe,
    "op6_license_scan": op6_license_scan,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_near_dedup": op9_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
        g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
        SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
        FROM d JOIN g USING (h)""",
}
