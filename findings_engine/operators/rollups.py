"""Reverse indexes, hotspots and totals over links, anchors and withheld references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def reverse_index(links: DataFrame) -> DataFrame:
    """name, location (the least spelling), note_count, notes, by note count and name."""
    return (
        links.groupBy("name")
        .agg(
            F.min(C.location(F.col("path"), F.col("line"))).alias("location"),
            F.array_sort(F.collect_set("note")).alias("notes"),
        )
        .select("name", "location", F.size("notes").cast("long").alias("note_count"), "notes")
    )


def symbol_hotspots(links: DataFrame, least: int = 2) -> DataFrame:
    return reverse_index(links).where(F.col("note_count") >= least)


def file_rollup(links: DataFrame) -> DataFrame:
    """path, distinct_symbols, note_links: distinct (note, symbol) pairs located in each file."""
    pairs = links.select("path", "note", "name").distinct()
    return pairs.groupBy("path").agg(
        F.count_distinct("name").alias("distinct_symbols"), F.count("*").alias("note_links")
    )


def file_hotspots(links: DataFrame, least: int = 2) -> DataFrame:
    return file_rollup(links).where(F.col("note_links") >= least)


def anchored_files(anchors: DataFrame) -> DataFrame:
    """path, note_count, notes."""
    return (
        anchors.groupBy("path")
        .agg(F.array_sort(F.collect_set("note")).alias("notes"))
        .select("path", F.size("notes").cast("long").alias("note_count"), "notes")
    )


def ambiguous_refs(withheld: DataFrame, candidates: DataFrame) -> DataFrame:
    """kind, ref, notes, candidates."""
    return withheld.groupBy("kind", "ref").agg(F.array_sort(F.collect_set("note")).alias("notes")).join(candidates, ["kind", "ref"])


def link_metrics(
    notes: DataFrame, links: DataFrame, anchors: DataFrame, withheld: DataFrame, bare: DataFrame, skipped: DataFrame | None = None
) -> DataFrame:
    """One row: what was scanned, linked, withheld, left unlinked and skipped."""
    one = lambda df, *aggs: df.agg(*aggs)
    matched = links.select("note").union(anchors.select("note")).distinct()
    return (
        one(notes, F.count("*").alias("notes_scanned"))
        .crossJoin(one(matched, F.count("*").alias("notes_with_matches")))
        .crossJoin(
            one(links, F.count("*").alias("symbols_linked"), F.count_distinct("name").alias("distinct_symbols"))
        )
        .crossJoin(one(anchors, F.count("*").alias("files_linked")))
        .crossJoin(one(withheld, F.count("*").alias("ambiguous_matches")))
        .crossJoin(one(bare, F.count("*").alias("unlinked_notes")))
        .crossJoin(
            one(notes.limit(0) if skipped is None else skipped, F.count("*").alias("notes_skipped_unchanged"))
        )
    )


def index_counts(symbols: DataFrame) -> DataFrame:
    """names, definitions, ambiguous_names."""
    per = symbols.groupBy("name").agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("names"), F.sum("n").alias("definitions"), F.count_if(F.col("n") > 1).alias("ambiguous_names")
    )


def ubiquity(symbols: DataFrame, limit: int = 4) -> DataFrame:
    """name, paths, ubiquitous: defined in more than ``limit`` distinct files."""
    return symbols.groupBy("name").agg(F.count_distinct("path").alias("paths")).withColumn(
        "ubiquitous", F.col("paths") > limit
    )
