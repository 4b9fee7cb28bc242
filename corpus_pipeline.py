"""The corpus pipeline: five stages from documents to a training mix.

Each function takes (spark, docs, sf_dir) and returns what it keeps of ``docs``; all but the last return
the columns of documents. A stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import staged, text_of, words_of
from plotweave.llm.decontaminate import indexes_of, with_hits
from plotweave.llm.hyperminhash import near_duplicates
from plotweave.llm.mixing import mix_sources
from plotweave.llm.quality import fit_quality, with_quality
from plotweave.llm.queries import LEAST_QUALITY, prepared, table
from plotweave.llm.winnow import dedup_lines
from plotweave.plans.picking import dedup_keep_first

#: Share of its words that a document keeps at least when repeated passages go; what is left of near copies is less.
LEAST_LEFT = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject; it learns from ``labels``."""
    prepared(spark)
    scored = with_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), name="_score")
    return scored.where(F.col("_score") >= LEAST_QUALITY).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines. What keeps less than ``LEAST_LEFT`` of its words goes; what had none before stays."""
    prepared(spark)
    had = docs.withColumn("_had", F.size(words_of(F.col("text"))))
    return dedup_lines(had).where(F.size(words_of(F.col("text"))) >= LEAST_LEFT * F.col("_had")).select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), the one of smallest id.

    Rows equal in id and text, null ids included, are one document: one row of them stays, the first by its other columns.
    """
    prepared(spark)
    dropped = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct().withColumn("_spread", F.lit(0).cast("bigint"))
    text = F.xxhash64(text_of(F.col("text")))
    # Rows without an id are spread by their texts. The rows of a document already share a task when repeats are looked for.
    keyed = docs.withColumn("_text", text).withColumn("_spread", F.when(F.col("doc_id").isNull(), F.col("_text")).otherwise(0))
    left = keyed.join(dropped, ["doc_id", "_spread"], "left_anti")
    return dedup_keep_first(left, ["doc_id", "_spread", "_text"], ["lang", "source", "n_chars"]).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    prepared(spark)
    found = with_hits(docs, indexes_of(table(spark, sf_dir, "benchmark")), name="_hits")
    return found.where(F.size("_hits") == 0).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: documents with the words taken, repeats counted."""
    prepared(spark)
    return mix_sources(docs).where(F.col("taken") > 0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("minhash dedup", minhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
]

#: Classifier, sketches and retrieval have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
