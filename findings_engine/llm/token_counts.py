"""Token counts through a digest cache.

A document's key is the digest of the tokenizer's version (the digest of its
vocabulary file) and of its whole text. Keys are joined to a stored table of
counts; only distinct keys that the table lacks are encoded, and their counts
are appended to it. A later run over the same or overlapping texts encodes
only what is new; another vocabulary has other keys.

Defined results: a null text counts as the empty text (0 tokens); repeated
rows and null ids are kept row by row, equal texts with equal counts; two counts
stored for a key by runs at once are the same; an empty table gives an empty result;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import encoder, vocabulary_path

CACHE = "digest string, n_tokens bigint"
FEW_MISSES = 100_000  # digests of 64 characters


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class TokenCache:
    """Counts by digest, as Parquet folders under one path; each run appends one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        """One row per digest, though two runs at once may both have stored it."""
        if not self.exists():
            return self.spark.createDataFrame([], CACHE)
        return self.spark.read.schema(CACHE).parquet(self.path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame) -> None:
        counts.write.mode("append").option("compression", "zstd").parquet(self.path)


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(digest, text) to (digest, n_tokens)."""

    def count(b):
        ids = encoder(path).encode_many(b.column("text").to_pylist())
        return {"digest": b.column("digest"), "n_tokens": [len(x) for x in ids]}

    return common.map_batches(texts, CACHE, count, common.BATCH_ROWS)


def missing_texts(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, text) of each digest that ``known`` lacks, once.

    Texts are folded by digest within each task before they move, so a text that
    many rows share moves once a task. Where few digests are missing, their list
    is sent to the tasks and only their texts move.
    """
    lacking = common.materialize(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "lacking")
    if lacking.count() <= FEW_MISSES:
        keyed = keyed.join(F.broadcast(lacking), "digest", "left_semi")
        return keyed.groupBy("digest").agg(F.first("text").alias("text"))
    texts = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    return texts.join(known, "digest", "left_anti")


def count_tokens(docs: DataFrame, vocabulary: str, cache: TokenCache, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), digest; one row per input row."""
    version = tokenizer_version(vocabulary)
    keyed = docs.select("doc_id", common.digest_text().alias("text")).select(
        "doc_id",
        "text",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.concat(F.lit(version + ":"), "text"), 256).alias("digest"),
    )
    misses = missing_texts(keyed.select("digest", "text"), cache.read().select("digest"))
    cache.append(encode_counts(misses, vocabulary))
    counts = common.materialize(cache.read(), "counts")
    return (
        keyed.select("doc_id", "n_bytes", "digest")
        .join(counts, "digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cache = TokenCache(spark, common.new_path(spark, "token-cache"))
    return count_tokens(docs, vocabulary_path("byte_bpe_50k.json"), cache)
