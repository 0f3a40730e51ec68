"""Lint: what keeps a finding from being linked, found again or read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rx
from .references import DEFAULT_MIN_LEN, deliberate, file_refs, resolve_files, symbol_refs
from .rollups import ubiquity

NO_NAMES = "no linkable identifiers: put the exact symbols in backticks"
COMMON_NAMES = "the only names in backticks are stopwords or ubiquitous: name the specific symbols"


def _claims(found: DataFrame, files: DataFrame | None) -> DataFrame:
    """note, ref, n (matches), unknown: file references that files answer for."""
    notes = found.select(F.col("id").alias("note"), F.col("blob").alias("body"))
    if files is None:
        return notes.select("note", F.lit("").alias("ref"), F.lit(0).alias("n"), F.lit(False).alias("unknown")).limit(0)
    got = resolve_files(file_refs(notes), files).withColumn("n", F.size("matches"))
    shaped = F.col("ref").contains("/") | C.is_filename(F.col("ref")) | ~F.col("ref").rlike(f"^{rx.DOTTED}$")
    claimed = got.where((F.col("n") > 0) | shaped)
    return claimed.select("note", "ref", "n", ((F.col("n") == 0) & (F.col("evidence") == "inline-code")).alias("unknown"))


def check(
    found: DataFrame,
    symbols: DataFrame | None = None,
    titles: DataFrame | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """findings() rows to id, level, code, detail; titles: (note, title, ord) of existing notes, normalised."""
    stop = sorted(rx.STOPWORDS)
    notes = found.select(F.col("id").alias("note"), F.col("blob").alias("body"))
    tokens = notes.select("note", F.explode(deliberate(F.col("body"))).alias("token")).withColumn("tail", C.tail(F.col("token")))
    if symbols is not None:
        known = ubiquity(symbols)
        tokens = tokens.join(known.select(F.col("name").alias("tail"), "ubiquitous"), "tail", "left")
    else:
        tokens = tokens.withColumn("ubiquitous", F.lit(None).cast("boolean"))
    common, indexed, wide = F.col("tail").isin(*stop), F.col("ubiquitous").isNotNull(), F.coalesce("ubiquitous", F.lit(False))
    telling = ~common & ~wide if symbols is not None else F.lit(True)
    lost = ~indexed & ~common if symbols is not None else F.lit(False)
    # What a finding's text holds is folded to one row of it, so that all that follows meets in one partitioning.
    parts = [
        tokens.groupBy("note").agg(
            F.max(telling).alias("names"), F.max(indexed & ~common & ~wide).alias("anchor"), F.lit(True).alias("some"),
            F.collect_set(F.when(lost, F.col("token"))).alias("lost"),
        ),
        _claims(found, files).groupBy("note").agg(
            F.max(F.col("n") == 1).alias("anchored"), F.max((F.col("n") > 0) | F.col("unknown")).alias("cites"),
            F.collect_set("ref").alias("claimed"), F.collect_set(F.when(F.col("unknown"), F.col("ref"))).alias("bad"),
        ),
    ]
    if symbols is not None:
        cand = symbol_refs(notes, known, DEFAULT_MIN_LEN, flag="ubiquitous").where(~F.col("ubiquitous") & ~F.lower("name").isin(*stop))
        parts.append(cand.groupBy("note").agg(F.lit(True).alias("cand")))
    if titles is not None:
        parts.append(duplicates(found, titles))
    facts = found.select(F.col("id").alias("note"), "has_status", "has_severity")
    for part in parts:
        facts = facts.join(part.hint("merge"), "note", "left")  # they grow with the findings: never broadcast
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in facts.columns else F.lit(False)
    list_ = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    issue = lambda level, code, detail: F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), detail.alias("detail"))
    when = lambda test, *x: F.when(test, F.array(issue(*x)))
    unknown = F.array_sort(F.array_union(list_("bad"), F.array_except(list_("lost"), list_("claimed"))))
    facts = facts.withColumn("unknown", unknown)
    vouched = yes("anchor") | yes("anchored")
    issues = [
        when(
            ~yes("names") & ~yes("cand") & ~yes("cites"), "warning", "prose-only", F.when(yes("some"), COMMON_NAMES).otherwise(NO_NAMES)
        ),
        F.when(vouched, F.transform("unknown", lambda x: issue("info", "unknown-symbols", F.concat(F.lit("not in the index: "), x)))),
        when(
            ~vouched & (F.size("unknown") > 0), "warning", "unknown-symbols",
            F.concat(F.lit("names unknown symbols: "), F.array_join("unknown", ", ")),
        ),
        when(F.col("of").isNotNull(), "warning", "duplicate", F.concat(F.lit("possible duplicate of "), "of")) if titles is not None else None,
        when(~F.col("has_status"), "warning", "missing-status", F.lit("no STATUS heading")),
        when(~F.col("has_severity"), "warning", "missing-severity", F.lit("no SEVERITY heading or tag")),
    ]
    none = F.array().cast("array<struct<level:string,code:string,detail:string>>")
    every = F.concat(*[F.coalesce(x, none) for x in issues if x is not None])
    return facts.select(F.col("note").alias("id"), F.explode(every).alias("x")).select("id", "x.level", "x.code", "x.detail")


def duplicates(found: DataFrame, titles: DataFrame) -> DataFrame:
    """note, of: the first other note, in the vault's order, with the same normalised title.

    Only the first two notes of a title can be an answer, so a title that many
    notes share is never paired with itself.
    """
    mine = found.select(F.col("id").alias("note"), C.norm_title(F.col("lint_title")).alias("title")).where("title <> ''")
    each = titles.select("title", F.struct("ord", F.col("note").alias("of")).alias("t"))
    first = each.groupBy("title").agg(F.min("t").alias("one"))
    second = each.join(first, "title").where(F.col("t.of") != F.col("one.of")).groupBy("title").agg(F.min("t").alias("two"))
    two = first.join(second, "title", "left")
    of = F.when(F.col("one.of") != F.col("note"), F.col("one.of")).otherwise(F.col("two.of"))
    return mine.join(two, "title").select("note", of.alias("of")).where(F.col("of").isNotNull())


def only_new(found: DataFrame, manifest_notes: DataFrame) -> DataFrame:
    """Findings that the manifest's notes don't have yet."""
    return found.join(manifest_notes.select("id"), "id", "left_anti")


def totals(checked: DataFrame, found: DataFrame) -> DataFrame:
    """findings_checked, warnings, infos."""
    return found.agg(F.count("*").alias("findings_checked")).crossJoin(
        checked.agg(
            F.count_if(F.col("level") == "warning").alias("warnings"), F.count_if(F.col("level") == "info").alias("infos")
        )
    )
