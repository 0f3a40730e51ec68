"""Readers of registers, vaults, manifests, link states, configuration and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import references as R

MANIFEST = "schema_version int, register struct<prefix:string,source:string>, generated_from string, prefix string, generated_notes array<string>"
STATE_NOTE = "struct<content_hash:string,linked:array<string>,locations:array<struct<path:string,line:int>>,files:array<string>,files_fingerprint:string,ambiguous:array<array<string>>>"
STATE = f"schema_version int, symbols_fingerprint string, options_fingerprint string, symbol_locations map<string,string>, notes map<string,{STATE_NOTE}>"
STATE_SCHEMA = 3
EDIT = "tool_name string, tool_input struct<file_path:string>, stop_hook_active boolean, session_id string, source string"
GENERATED = ("INDEX.md", "CODE-INDEX.md")


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, text of whole files; invalid UTF-8 is replaced."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select("path", C.text_of(F.col("content")).alias("text"))


def vault_notes(texts: DataFrame, marker: str = "findings_schema", key: str = "findings") -> DataFrame:
    """(path, text) of a vault's files to owned notes: note, text, body, fm, overrides."""
    name = C.basename(F.col("path"))
    owned = texts.where(name.endswith(".md") & ~name.isin(*GENERATED) & R.is_owned(F.col("text"), marker))
    return owned.select(
        F.regexp_replace(name, r"\.md$", "").alias("note"),
        "text",
        R.authored(F.col("text")).alias("body"),
        R.frontmatter(F.col("text")).alias("fm"),
        R.overrides(F.col("text"), key).alias("overrides"),
    )


def unowned(texts: DataFrame, marker: str = "findings_schema") -> DataFrame:
    """Notes that are not ours and stay untouched: counted, never read further."""
    name = C.basename(F.col("path"))
    return texts.where(name.endswith(".md") & ~name.isin(*GENERATED) & ~R.is_owned(F.col("text"), marker)).select(name.alias("file"))


def note_titles(texts: DataFrame, id_field: str = "findings_id") -> DataFrame:
    """note, title (normalised), ord (the file's name) of each note with a first-level heading."""
    name = C.basename(F.col("path"))
    own = C.first_group(F.substring("text", 1, 2000), rf"(?m)^\Q{id_field}\E:\s*(\S+)\s*$")
    note = F.coalesce(own, F.regexp_replace(name, r"\.md$", ""))
    head = F.get(F.filter(C.lines(F.col("text")), lambda x: x.startswith("# ")), F.lit(0))
    t = texts.where(name.endswith(".md") & ~name.isin(*GENERATED)).select(note.alias("note"), C.strip(F.substr(head, F.lit(3))).alias("t"), name.alias("ord"))
    seps = F.filter(F.array(F.lit(" — "), F.lit(" – "), F.lit(" - ")), lambda s: F.startswith(F.col("t"), F.concat("note", s)))
    rest = F.when(F.size(seps) > 0, F.substr("t", F.length("note") + F.length(F.get(seps, F.lit(0))) + 1)).otherwise(F.col("t"))
    return t.where(F.col("t").isNotNull()).select(
        "note", C.norm_title(F.regexp_replace(rest, r"\[[A-Za-z]+\]\s*$", "")).alias("title"), "ord"
    )


def manifest(texts: DataFrame) -> DataFrame:
    """One row: prefix, source, notes; version 1 has its source under generated_from."""
    m = F.from_json("text", MANIFEST)
    return texts.select(m.alias("m")).select(
        F.coalesce("m.register.prefix", "m.prefix").alias("prefix"),
        F.coalesce("m.register.source", "m.generated_from").alias("source"),
        F.coalesce("m.generated_notes", F.array().cast("array<string>")).alias("notes"),
    )


def safe_manifest_notes(manifests: DataFrame, prefix: str) -> DataFrame:
    """note of each manifest entry that can only be a generated note's file."""
    from ..functions import rx

    entry = F.explode("notes").alias("file")
    return manifests.select(entry).where(F.col("file").rlike(rf"(?U)^{rx.finding_id(prefix)}\.md$")).select(
        F.regexp_replace("file", r"\.md$", "").alias("note")
    )


def link_state(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state_meta, state_notes); anything less than a fully well-formed state is no state at all."""
    s = F.from_json("text", STATE, {"mode": "PERMISSIVE"})
    whole = texts.select(s.alias("s")).where(
        (F.col("s.schema_version") == STATE_SCHEMA)
        & F.col("s.symbols_fingerprint").isNotNull()
        & F.col("s.options_fingerprint").isNotNull()
        & F.col("s.symbol_locations").isNotNull()
        & F.col("s.notes").isNotNull()
        & F.forall(F.map_values("s.notes"), _sound)
    )
    meta = whole.select("s.symbols_fingerprint", "s.options_fingerprint", "s.symbol_locations")
    notes = whole.select(F.explode("s.notes").alias("note", "e")).select(
        F.regexp_replace("note", r"\.md$", "").alias("note"), "e.*"
    )
    return meta, notes


def _sound(e: Column) -> Column:
    strings = lambda a: a.isNotNull() & ~F.exists(a, lambda x: x.isNull())
    return F.coalesce(
        e["content_hash"].isNotNull()
        & e["files_fingerprint"].isNotNull()
        & strings(e["linked"])
        & strings(e["files"])
        & (F.size(e["locations"]) == F.size(e["linked"]))
        & ~F.exists(e["locations"], lambda x: x["path"].isNull())
        & strings(e["ambiguous"])
        & F.forall(e["ambiguous"], lambda a: F.size(a) == 2),
        F.lit(False),
    )


def enabled(texts: DataFrame, name: str) -> DataFrame:
    """One row: is this gate exactly JSON true?"""
    v = F.try_parse_json("text")
    field = F.try_variant_get(v, f"$.{name}", "variant")
    return texts.select(
        F.coalesce((F.schema_of_variant(field) == "BOOLEAN") & F.try_variant_get(v, f"$.{name}", "boolean"), F.lit(False)).alias("enabled")
    )


def edit_events(payloads: DataFrame) -> DataFrame:
    """(payload, ...) to the payload's file_path and flags; what is no such JSON is dropped without a word."""
    e = F.from_json("payload", EDIT, {"mode": "PERMISSIVE"})
    return payloads.withColumn("e", e).where(F.col("e").isNotNull()).select("*", "e.tool_input.file_path", F.coalesce("e.stop_hook_active", F.lit(False)).alias("continuing")).drop("e")
