"""The driver's queries on the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fingerprints, media, packing, quality, segmentation, simhash_dedup, token_counts, token_files, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": simhash_dedup.query,
    "op2_segmentation": segmentation.query,
    "op3_packing": packing.query,
    "op4_media": media.query,
    "op5_fingerprints": fingerprints.query,
    "op6_toxicity": toxicity.query,
    "op7_chat": chat.query,
    "op8_token_counts": token_counts.query,
    "op9_quality": quality.query,
    "op10_token_files": token_files.query,
}

ORACLES: dict[str, str] = {"op7_chat": chat.ORACLE}
