"""From raw documents to packed training windows.

Each stage works on all rows that the one before it kept, and is written as
Parquet and read again before the next. The first three return the columns of
documents; the last returns the pieces of the packed windows.

Defined results, for all stages: a null text is an empty one, null and repeated
ids are rows like any others, texts are whole however long, further columns stay
with their row whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf

from findings_engine.llm import common, jaccard_dedup, packing, quality, toxicity
from findings_engine.llm.encoding import vocabulary_path


def _rated(docs: DataFrame, score):
    """A model's score of each row's text, as an expression."""
    common.small_batches(docs.sparkSession)

    @pandas_udf("double")
    def rate(texts):
        import pandas as pd

        return pd.Series(score(texts.tolist()), dtype="float64")

    return rate(common.digest_text())


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are more likely bad than good; equal texts share a fate, and a tie at one half stays."""
    scorer, _ = quality.train(docs)
    return docs.where(_rated(docs, scorer.score) >= 0.5)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored 0.5 or more; learns from the labelled training rows among those kept so far.

    Without labels of both kinds nothing is rejected.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(_rated(docs, model.score) < 0.5)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at similarity 0.8.

    The one with the smallest id (a missing id comes last), of a repeated id the first
    by its text's digest, of equal rows one. Candidates are sets whose SimHash fingerprints
    op1's Gray-order index finds within two bits. Those are only the closest, so a prefix
    filter adds all others that can be linked, and an exact check decides on both.
    """
    return jaccard_dedup.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-dedup", dedup_stage),
    ("packing", packing_stage),
]

#: The stages train models, compare shingle sets and encode: SQL expresses none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
