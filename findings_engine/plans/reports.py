"""Reports as rows: of linking, freshness, health, lint and capture. Each is small; what it counts is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rx
from ..operators import findings as N

WHY = {
    "no-identifiers": "no symbol identifiers found",
    "all-candidates-filtered": "candidate symbols filtered as common or too short",
    "only-ambiguous": "only ambiguous symbols found",
}


def modified(before: DataFrame, after: DataFrame) -> DataFrame:
    """note of each rendered note (note, text) whose text isn't what it was."""
    was = before.select("note", F.sha2("text", 256).alias("was"))
    now = after.select("note", F.sha2("text", 256).alias("now"))
    return now.join(was, "note", "left").where(~F.col("was").eqNullSafe(F.col("now"))).select("note")


def link_report(metrics: DataFrame, changed: DataFrame, index_stale: bool = False, check: bool = False, require_linked: bool = False) -> DataFrame:
    """One row: the pass's counters, notes_modified and the exit code."""
    row = metrics.crossJoin(changed.agg(F.count("*").alias("notes_modified")))
    failed = F.lit(check) & ((F.col("notes_modified") > 0) | F.lit(index_stale)) | F.lit(require_linked) & (F.col("unlinked_notes") > 0)
    return row.withColumn("exit_code", F.when(failed, 1).otherwise(0))


def unlinked_lines(bare: DataFrame) -> DataFrame:
    reasons = F.create_map(*[F.lit(x) for kv in WHY.items() for x in kv])
    return bare.select("note", F.concat("note", F.lit("\n  reason: "), F.try_element_at(reasons, F.col("reason"))).alias("line"))


def freshness_text(verdicts: DataFrame) -> DataFrame:
    """verdict() rows with their text."""
    line = lambda label, value: F.concat(F.lit(f"{label}:".ljust(19)), value)
    commit = F.try_variant_get(F.try_parse_json("text"), "$.repository.commit", "string")
    short = lambda label, c: F.when(C.or_null(c).isNotNull(), F.concat(F.lit(f"{label}:    "), F.left(c, F.lit(12))))
    return verdicts.withColumn(
        "report",
        F.concat_ws(
            "\n", line("index_freshness", F.col("status")), line("reason", F.col("reason")), short("indexed_commit", commit),
            short("current_commit", F.col("commit_now")),
            F.when(F.col("partial"), "index_completeness: partial — it does not cover the whole repository"),
            F.when(F.col("status") == "stale", "\nRun the symbol indexer again before trusting generated links."),
        ),
    )


def lint_report(checked: DataFrame, found: DataFrame) -> DataFrame:
    """One row: findings_checked, warnings, infos (each (id, code, detail), by id), how many they are, exit_code: only warnings fail.

    The lists are one row's; who reads only the numbers doesn't have them collected.
    """
    of = lambda level: F.col("level") == level
    rows = lambda level: F.sort_array(F.collect_list(F.when(of(level), F.struct("id", "code", "detail"))))
    counted = checked.agg(
        rows("warning").alias("warnings"), rows("info").alias("infos"), F.count_if(of("warning")).alias("warning_count"),
        F.count_if(of("info")).alias("info_count"),
    )
    return found.agg(F.count("*").alias("findings_checked")).crossJoin(counted).withColumn(
        "exit_code", F.when(F.col("warning_count") > 0, 1).otherwise(0)
    )


def inspect(registers: DataFrame, first: int = 8, styles: int | None = None) -> DataFrame:
    """line, ord: identifier styles by count; of a register without any, its first headings instead."""
    by = N.id_styles(registers).orderBy(F.desc("n"), "style")
    by = by.limit(styles) if styles is not None else by
    out = by.select(F.concat("style", F.lit(" "), F.col("n").cast("string")).alias("line"), (-F.col("n")).alias("ord"))
    if not out.isEmpty():
        return out
    heads = registers.select("path", F.posexplode(N.heading_lines(C.unix_lines(F.col("text")))).alias("at", "h"))
    return heads.orderBy("path", "at").limit(first).select(C.rstrip(F.col("h")).alias("line"), F.col("at").cast("long").alias("ord"))


def status_report(
    findings: DataFrame, notes: DataFrame, compared: DataFrame, verdict: DataFrame, links: DataFrame, problems: Column
) -> DataFrame:
    """One row, report: a struct of register, vault, index, links, findings, problems and ok.

    findings: the register's (id); notes: the vault's heads (note, id, status, severity,
    title); compared: register_vs_vault rows; verdict and links: one row each;
    problems: over the report's fields, as vault_missing_count or index_freshness.
    """
    flat = status_facts(findings, notes, compared, verdict, links)
    parts: dict[str, list[Column]] = {}
    for c in flat.columns:
        part, field = c.split("_", 1)
        parts.setdefault(part, []).append(F.col(c).alias(field))
    whole = [F.struct(*fields).alias(part) for part, fields in parts.items()]
    return flat.select(F.struct(*whole, problems.alias("problems"), (F.size(problems) == 0).alias("ok")).alias("report"))


def status_facts(findings: DataFrame, notes: DataFrame, compared: DataFrame, verdict: DataFrame, links: DataFrame) -> DataFrame:
    """status_report's fields as columns, each behind its part's name.

    Beside each list stands its length, and beside open_high its first: who reads
    only these doesn't have the lists collected.
    """
    ids = lambda p: F.sort_array(F.collect_list(F.when(F.col("problem") == p, F.col("id"))))
    many = lambda p: F.count_if(F.col("problem") == p)
    open_high = (F.col("status") == "open") & F.col("severity").isin("critical", "high")
    item = F.struct(C.number_of(F.col("id")).alias("number"), "id", "severity", "title")
    high = F.when(open_high, item)
    by = notes.groupBy("status").agg(
        F.count("*").alias("n"), F.collect_list(high).alias("high"), F.count_if(open_high).alias("high_n"), F.min(high).alias("high_1")
    ).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"),
        F.sort_array(F.flatten(F.collect_list("high"))).alias("open_high"),
        F.coalesce(F.sum("high_n"), F.lit(0)).alias("open_high_count"),
        F.min("high_1").alias("first_open_high"),
    )
    vault = compared.agg(
        ids("missing").alias("missing_in_vault"), ids("extra").alias("extra_in_vault"), many("missing").alias("missing_count"),
        many("extra").alias("extra_count"),
    )
    bare = lambda x: x.dropFields("number")
    listed = F.transform("open_high", bare).alias("open_high")
    parts = {
        "register": findings.agg(F.count("*").alias("count")),
        "vault": vault,
        "index": verdict.select(F.col("status").alias("freshness"), F.array("reason").alias("reasons"), "partial").limit(1),
        "links": links.limit(1),
        "findings": by.select("total", "by_status", listed, "open_high_count", bare(F.col("first_open_high")).alias("first_open_high")),
    }
    row = None
    for name, part in parts.items():  # a row each
        part = part.toDF(*[f"{name}_{c}" for c in part.columns])
        row = part if row is None else row.crossJoin(part)
    return row


def capture_json(decisions: DataFrame, register: str, prefix: str = "RES", lint: str = "lint --register {} --repo .") -> DataFrame:
    """decisions of capture() with the block's JSON; passes say nothing."""
    reason = (
        f"This session edited code but recorded nothing. Append what is worth knowing next time to {register} as findings "
        f"(### {prefix}-<n> heading, ### STATUS: and ### SEVERITY: lines, the exact symbols and files). If nothing is, append "
        f"nothing and stop again. Then run: {lint.format(register)}"
    )
    block = F.to_json(F.struct(F.lit("block").alias("decision"), F.lit(reason).alias("reason")))
    return decisions.withColumn("json", F.when(F.col("decision") == "block", block))
