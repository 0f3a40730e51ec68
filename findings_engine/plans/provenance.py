"""Where an index comes from, and whether it is still true of its tree.

An index is written with an envelope: the repository's state, a fingerprint of
the files considered, the scope that makes this set reproducible, and the
configuration. Later the scope is derived anew from the tree, so that a file
added since counts, and the two fingerprints are compared.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rx
from ..operators import freshness as FR
from ..sources import indexes as I
from ..sources import tree as T

VERSION = "1"


def config_fingerprint(config: dict) -> str:
    """Of the canonical JSON: sorted keys, no spaces."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"))
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def scan_config(max_files: int = I.MAX_FILES) -> dict:
    """A scan's configuration: its patterns belong to it, since others give other definitions."""
    return {"backend": "scan", "exclude": sorted(rx.SKIP_DIRS), "max_files": max_files, "patterns": dict(rx.DEFINITIONS)}


def scan_scope() -> dict:
    return {"kind": "extensions", "extensions": sorted("." + e for e in rx.DEFINITIONS), "exclude": sorted(rx.SKIP_DIRS)}


def discover_scope(spark: SparkSession, root: str, scope: dict | None, considered: DataFrame | None = None) -> tuple[DataFrame | None, bool]:
    """((path, content) of the files that a backend would consider now, known); None where the scope can't be rebuilt.

    A scope of extensions is walked again. Those of a tags file or a graph are as
    good as the file on disk now: ``considered`` are the paths (path) that it names.
    """
    T.register(spark)
    kind = (scope or {}).get("kind")
    source = spark.read.format("source_tree")
    if kind == "extensions":
        ext = ",".join(e.removeprefix(".") for e in scope.get("extensions") or [])
        if not ext:
            return None, True
        return source.option("extensions", ext).option("skip", ",".join(scope.get("exclude") or [])).load(root), True
    if kind in ("ctags", "graphify") and considered is not None:
        return source.load(root).join(considered.select("path").distinct(), "path", "left_semi"), True
    return None, False


def envelope(
    backend: str, scope: dict, config: dict, files: DataFrame, fingerprint: Column, notes: list[str], commit: str | None = None,
    dirty: bool | None = None,
) -> dict[str, Column]:
    """Columns of an index's JSON beside its symbols. files: one row of (fingerprint, files, unreadable, considered)."""
    row = files.first()
    warnings = [{"code": "unreadable", "path": p, "message": "not read"} for p in row.unreadable]
    warnings += [{"code": "backend-note", "path": None, "message": n} for n in notes]
    partial = bool(row.unreadable) or any("max-files-reached" in n for n in notes)
    text = lambda x: F.parse_json(F.lit(json.dumps(x)))
    return {
        "engine_version": F.lit(VERSION),
        "repository": F.struct(
            F.lit(".").alias("root"), F.lit("git" if commit else None).cast("string").alias("vcs"), F.lit(commit).cast("string").alias("commit"),
            F.lit(dirty).cast("boolean").alias("dirty"), fingerprint.alias("fingerprint"), F.lit(row.files).alias("files_fingerprinted"),
            F.lit("symbol-index").alias("scope"),
        ),
        "indexing": F.struct(
            F.lit(backend).alias("backend"), F.lit(partial).alias("partial"), text(scope).alias("scope"),
            text(sorted(row.considered)).alias("files_considered"), text(warnings).alias("warnings"), text(config).alias("configuration"),
            F.lit(config_fingerprint(config)).alias("configuration_fingerprint"),
        ),
    }


def index_tree(spark: SparkSession, root: str, max_files: int = I.MAX_FILES) -> DataFrame:
    """One row, text: the index of a source tree, of at most max_files files, with its envelope."""
    files = I.read_sources(spark, root, max_files)
    print_ = I.tree_fingerprint(files).first()
    # Paths only; their number has the scan's ceiling.
    rows = files.agg(
        F.lit(print_.fingerprint).alias("fingerprint"), F.lit(print_.files).alias("files"),
        F.collect_list(F.when(F.col("content").isNull(), F.col("path"))).alias("unreadable"), F.collect_list("path").alias("considered"),
    )
    note = I.scan_note(root, max_files)
    commit, dirty = T.vcs_state(root)
    meta = envelope(
        "scan", scan_scope(), scan_config(max_files), rows, F.lit(print_.fingerprint), [f"scan: {note}"] if note else [], commit, dirty
    )
    return I.index_json(I.from_sources(files), meta)


def freshness_of(spark: SparkSession, root: str, index: DataFrame, considered: DataFrame | None = None) -> DataFrame:
    """The verdict on an index (text) of one row against the tree as it is now."""
    text = index.first().text
    try:
        whole = json.loads(text)
        scope = ((whole.get("indexing") or {}).get("scope")) if isinstance(whole, dict) else None
    except ValueError:
        scope = None
    files, known = discover_scope(spark, root, scope if isinstance(scope, dict) else None, considered)
    now = I.tree_fingerprint(files).first().fingerprint if files is not None else None
    commit, dirty = T.vcs_state(root)
    row = spark.createDataFrame(
        [(text, now, known, commit, dirty)], "text string, fingerprint_now string, scope_known boolean, commit_now string, dirty_now boolean"
    )
    return FR.verdict(row)


def may_refresh(root: str, hinted: bool, max_files: int = I.MAX_FILES) -> tuple[bool, str | None]:
    """(go on, hint): a tree over the ceiling is not refreshed by itself, and that is said once (hinted: it was)."""
    if T.count_files(root, frozenset(rx.DEFINITIONS), max_files) <= max_files:
        return True, None
    return False, None if hinted else f"over {max_files} source files: refresh skipped; index and link by hand"


def vault_conflict(manifests: DataFrame, prefix: str, source: str, adopt: bool = False) -> str | None:
    """Why a register must not be split into a vault: it belongs to another prefix or source; None if it may be."""
    row = None if adopt else manifests.first()
    if row is None:
        return None
    if row.prefix and row.prefix != prefix:
        return f"vault belongs to prefix {row.prefix}"
    if row.source and row.source != source:
        return f"vault was built from {row.source}"
    return None
