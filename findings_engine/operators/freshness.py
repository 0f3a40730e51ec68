"""Is an index still true of its tree? fresh, stale, unknown or invalid, with a reason; unknown is never fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict(indexes: DataFrame) -> DataFrame:
    """Adds status and reason.

    indexes: text (the index's JSON), fingerprint_now, scope_known, commit_now,
    dirty_now: what can be told of the tree, null where it can't. ``partial``
    is reported beside the verdict and never changes it.
    """
    v = F.try_parse_json("text")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    symbols = get("$.symbols", "variant")
    plain = get("$", "map<string,variant>")
    kind = lambda x: F.schema_of_variant(x)
    legacy = (F.size(plain) > 0) & F.forall(F.map_values(plain), lambda x: kind(x).rlike("^(STRING|ARRAY<.*)$"))
    fingerprint, commit = get("$.repository.fingerprint"), get("$.repository.commit")
    scope = F.coalesce(get("$.indexing.scope", "variant"), get("$.repository.scope", "variant"))
    rules: list[tuple[Column, str, str]] = [
        (v.isNull(), "invalid", "not-a-symbol-index"),
        (symbols.isNull() & F.coalesce(legacy, F.lit(False)), "unknown", "legacy-index-without-provenance"),
        (symbols.isNull(), "invalid", "not-a-symbol-index"),
        (~kind(symbols).startswith("OBJECT"), "invalid", "symbols-not-a-mapping"),
        (fingerprint.isNull() & commit.isNull(), "unknown", "legacy-index-without-provenance"),
        (fingerprint.isNotNull() & scope.isNull(), "unknown", "fingerprint-scope-not-recorded"),
        (fingerprint.isNotNull() & ~F.coalesce("scope_known", F.lit(False)), "unknown", "scope-cannot-be-rebuilt"),
        (fingerprint.isNotNull() & (fingerprint == F.col("fingerprint_now")), "fresh", "fingerprint-match"),
        (fingerprint.isNotNull(), "stale", "fingerprint-mismatch"),
        (F.col("commit_now").isNull(), "unknown", "git-unavailable-or-not-a-repository"),
        (commit != F.col("commit_now"), "stale", "commit-mismatch"),
        (F.coalesce("dirty_now", F.lit(False)), "stale", "working-tree-modified"),
    ]
    status, reason = None, None
    for when, s, r in rules:
        status = (F if status is None else status).when(when, s)
        reason = (F if reason is None else reason).when(when, r)
    return indexes.withColumns(
        {
            "status": status.otherwise("unknown"),
            "reason": reason.otherwise("commit-match-without-fingerprint"),
            "partial": F.coalesce(get("$.indexing.partial", "boolean"), F.lit(False)),
        }
    )


def gate(verdicts: DataFrame, require_fresh: bool = False, allow_partial: bool = False) -> DataFrame:
    """Adds exit_code and refusal: invalid is 2; where freshness is required, stale, unknown and partial are 1."""
    invalid, bad = F.col("status") == "invalid", F.col("status") != "fresh"
    partial = F.col("partial") & F.lit(not allow_partial)
    need = F.lit(require_fresh)
    return verdicts.withColumns(
        {
            "exit_code": F.when(invalid, 2).when(need & (bad | partial), 1).otherwise(0),
            "refusal": F.when(invalid, F.concat(F.lit("index-"), "status"))
            .when(need & bad, F.concat(F.lit("index-"), "status"))
            .when(need & partial, F.lit("index-partial")),
        }
    )
