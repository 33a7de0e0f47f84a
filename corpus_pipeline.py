"""Clean a corpus: quality rules, line dedup, near-dedup, benchmark decontamination, then pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.llm import decontaminate, lines, pieces, quality, simhash
from waypoint.llm.common import scratch_scope, ship_code, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words and go; null ids, languages and sources are values like others;
    repeated rows are judged each; further columns pass.
    """
    ship_code(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; n_chars follows the text.

    Null texts stay null and keep their n_chars; a null id counts as one document; repeated rows lose the
    same lines; a document of shared lines alone stays with an empty text.
    """
    out = lines.drop_shared_lines(docs).drop("n_lines", "n_dropped")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id.

    Texts without words have fingerprint zero and link like any other; null ids come after all others; of repeated rows one stays.
    """
    ship_code(spark)
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go.

    Null texts hold no item and stay; null items match nothing; repeated rows are judged each.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts, a hash of the ids and of the decoded text of what is left.

    Null and empty texts have no pieces and decode to the empty text. Every stage takes an empty table.
    """
    ship_code(spark)
    return pieces.report(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_neardup", simhash_neardup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: The quality rules iterate to a robust estimate and the near-dedup to components; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written before the next reads it; what a stage wrote for itself is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", scratch=False)
    return docs
