"""The state of a whole project as one report: register, vault, index, links and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .incremental import vouching


def register_vs_vault(ids: DataFrame, generated: DataFrame, on_disk: DataFrame) -> DataFrame:
    """id, problem (missing, extra): ids (id) of the register against generated notes (id) that are on disk (id)."""
    vault = generated.select("id").distinct().join(on_disk.select("id"), "id", "left_semi")
    missing = ids.select("id").distinct().join(vault, "id", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(vault.join(ids, "id", "left_anti").withColumn("problem", F.lit("extra")))


def links_section(
    notes: DataFrame, state_notes: DataFrame | None, withheld: DataFrame, symbols_match: bool | None
) -> DataFrame:
    """One row: notes_recorded, notes_unverified, notes_ambiguous, unlinked_count (null where it isn't known)."""
    spark = notes.sparkSession
    if state_notes is None:
        return spark.createDataFrame([(None, None, None, None)], "notes_recorded bigint, notes_unverified bigint, notes_ambiguous bigint, unlinked_count bigint")
    amb = withheld.select("note").distinct().withColumn("amb", F.lit(True))
    rows = (
        vouching(notes, state_notes)
        .join(state_notes.select("note", (F.size("linked") + F.size("files")).alias("n")), "note", "left")
        .join(amb, "note", "left")
    )
    here, sure = F.col("vouched").isNotNull(), F.coalesce("amb", F.lit(False))
    unverified = F.count_if(~F.coalesce("vouched", F.lit(False)) & ~(here & sure & F.col("n").isNull()))
    got = rows.agg(
        F.count("n").alias("notes_recorded"),
        unverified.alias("notes_unverified"),
        F.count_if(here & sure).alias("notes_ambiguous"),
        F.count_if(here & (F.col("n") == 0) & ~sure).alias("empty"),
    )
    known = F.lit(bool(symbols_match)) & (F.col("notes_unverified") == 0)
    return got.select("notes_recorded", "notes_unverified", "notes_ambiguous", F.when(known, F.col("empty")).alias("unlinked_count"))


def findings_section(notes: DataFrame) -> DataFrame:
    """status, n, open_high: notes by their frontmatter's status."""
    field = lambda k: F.coalesce(F.try_element_at("fm", F.lit(k)), F.lit("unspecified"))
    high = (field("status") == "open") & field("severity").isin("critical", "high")
    return notes.groupBy(field("status").alias("status")).agg(F.count("*").alias("n"), F.count_if(high).alias("open_high"))


def problems(
    register_found: bool, vault_found: bool, manifest: DataFrame, register_name: str, compared: DataFrame | None,
    verdict: DataFrame | None, links: DataFrame | None, symbols_match: bool | None,
) -> list[str]:
    """The report's problems in order; empty means all is well. Each table here is one row, or counts of two kinds."""
    out = []
    if not register_found:
        out.append("register-not-found")
    if not vault_found:
        out.append("vault-not-found")
    else:
        m = manifest.first()
        if m is None:
            out.append("manifest-missing")
        elif m.source is not None and m.source != register_name:
            out.append("register-source-mismatch")
    if compared is not None and vault_found:
        n = {r.problem: r.n for r in compared.groupBy("problem").agg(F.count("*").alias("n")).collect()}
        out += [f"vault-behind-register: {n['missing']}"] * ("missing" in n) + [f"vault-has-extra-notes: {n['extra']}"] * ("extra" in n)
    v = verdict.first() if verdict is not None else None
    if v is None:
        out.append("symbols-not-found")
    elif v.status != "fresh":
        out.append({"stale": "index-stale", "unknown": f"index-freshness-unknown: {v.reason}", "invalid": f"index-invalid: {v.reason}"}[v.status])
    row = links.first() if links is not None else None
    if vault_found and (row is None or row.notes_recorded is None):
        out.append("link-state-missing" if row is None else "link-state-unreadable")
    elif vault_found:
        out += ["link-state-stale: symbols changed"] * (symbols_match is False)
        out += [f"link-state-stale: {row.notes_unverified} unverified"] * bool(row.notes_unverified)
        out += [f"unlinked-notes: {row.unlinked_count}"] * bool(row.unlinked_count)
    return out
