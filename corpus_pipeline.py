"""A training corpus from `documents`: five stages, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the
last return the columns of documents.

Defined cases: a null or blank text fails the quality rules; a null doc_id counts as later than all and each such row stays
one; of rows that share a doc_id, the near-duplicate stage leaves one; repeated rows are copies; a null source is a source of its
own; very long texts are taken whole; ties go to the smaller doc_id; further columns, whatever their names, are passed
through to the mix; an empty table gives no piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamquarry.llm import line_dedup, mixing, ngram_join, packing, quality
from beamquarry.llm.common import read_table, stored


def keep_good_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: failing lines go, and documents that fail or lose too much go whole."""
    return quality.clean(docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: blocks shared with an earlier document go; a document left without words goes."""
    return line_dedup.clean(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: of documents linked at 0.8 on five-word shingles, the smallest doc_id stays."""
    return ngram_join.one_per_component(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each source's words come to its target; a document taken several times has several rows."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of all documents in windows of 2048 tokens, each window in the sources' proportions."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", keep_good_lines),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The last stage tokenises with a vocabulary file, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
