"""Registered queries of the text-corpus operators: each runs over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from beamquarry.llm import chat, exact_dedup, line_dedup, merkle, mixing, ngram_join, oracles, packing, period_runs, pii, quality, sharding, substring_dedup, url_filter
from beamquarry.llm.common import read_table

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query("op1_mixing")
def op1_mixing(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("row_sign")


@query(
    "op2_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
         g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
    SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
           d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
    FROM d JOIN g ON d.body = g.body
    """,
)
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(read_table(spark, sf_dir, "documents"), keep="largest")


@query("op5_chat", oracles.OP5)
def op5_chat(spark, sf_dir):
    return chat.digests(chat.prefix_targets(chat.with_planted(read_table(spark, sf_dir, "conversations"))))


@query("op6_url_filter", url_filter.ORACLE)
def op6_url_filter(spark, sf_dir):
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


@query("op8_quality", oracles.OP8)
def op8_quality(spark, sf_dir):
    judged = quality.assess(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_packing")
def op3_packing(spark, sf_dir):
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source_queue")


@query("op4_ngram_join", oracles.OP4)
def op4_ngram_join(spark, sf_dir):
    return ngram_join.join(read_table(spark, sf_dir, "documents"), k=3, percent=90)


@query("op7_line_dedup", oracles.OP7)
def op7_line_dedup(spark, sf_dir):
    return line_dedup.aligned(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


@query("op9_sharding")
def op9_sharding(spark, sf_dir):
    placed = sharding.assign(read_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


@query("op10_substring_dedup", oracles.OP10)
def op10_substring_dedup(spark, sf_dir):
    kept = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op11_period_runs", oracles.OP11)
def op11_period_runs(spark, sf_dir):
    return period_runs.digests(period_runs.detect(period_runs.with_planted(read_table(spark, sf_dir, "documents"))))


@query("op12_merkle_manifest", oracles.OP12)
def op12_merkle_manifest(spark, sf_dir):
    audited = merkle.audit(read_table(spark, sf_dir, "documents"), merkle.tampered(F.col("text"), F.col("doc_id")))
    return audited.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


@query("op13_pii", oracles.OP13)
def op13_pii(spark, sf_dir):
    return pii.digests(pii.sanitise(read_table(spark, sf_dir, "documents")))
