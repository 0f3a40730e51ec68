"""Registers to findings: block split, status and severity folds, titles, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rx


def blocks(registers: DataFrame, prefix: str = "RES") -> DataFrame:
    """(path, text) to path, seq, id, block: one row a section; what precedes the first finding is dropped."""
    fid = rx.finding_id(prefix)
    part = F.posexplode(F.split(C.unix_lines(F.col("text")), rf"(?U)\n(?={rx.HEADING}{fid})", -1)).alias("seq", "raw")
    found = F.regexp_extract(C.strip(F.col("raw")), rf"(?U)^{rx.HEADING}({fid})", 1)
    return (
        registers.select("path", part)
        .select("path", "seq", found.alias("id"), C.rstrip(F.col("raw")).alias("block"))
        .where(F.col("id") != "")
    )


def explicit_status(h: Column) -> Column:
    s = F.lower(C.first_group(h, rx.STATUS))
    return F.when(s == "reopened", "open").otherwise(s)


#: Some word of some status, wherever: what has none needs no look at each.
_ANY_WORD = "(?iU)" + "|".join(pattern.removeprefix("(?iU)") for _, pattern in rx.STATUS_WORDS)


def worded_status(h: Column) -> Column:
    out = None
    for status, pattern in rx.STATUS_WORDS:
        out = (F if out is None else out).when(h.rlike(pattern), status)
    return F.when(h.rlike(_ANY_WORD), out)


def tagged_severity(h: Column) -> Column:
    """Of several tags in one heading, the lowest."""
    tag = None
    for s in reversed(rx.SEVERITIES):
        tag = (F if tag is None else tag).when(F.upper(h).contains(f"[{s.upper()}]"), s)
    return F.when(h.contains("["), tag)


def heading_facts(headings: Column, own: str) -> Column:
    """Each heading with what is asked of it more than once: is it a finding's own, does it tell a status, a severity."""
    tells = lambda h, pattern: h.contains(":") & h.rlike(pattern)
    return F.transform(
        headings,
        lambda h: F.struct(
            h.alias("h"), h.rlike(own).alias("own"), tells(h, rx.STATUS).alias("status"), tells(h, rx.SEVERITY).alias("severity")
        ),
    )


def fold_status(facts: Column) -> Column:
    """The last heading that tells a status decides; open if none does."""
    told = lambda f: F.coalesce(F.when(f["status"], explicit_status(f["h"])), worded_status(f["h"]))
    return F.aggregate(facts, F.lit("open"), lambda acc, f: F.coalesce(told(f), acc))


def fold_severity(facts: Column) -> Column:
    """The last heading that tells a severity decides."""
    told = lambda f: F.coalesce(F.when(f["severity"], F.lower(C.first_group(f["h"], rx.SEVERITY))), tagged_severity(f["h"]))
    return F.aggregate(facts, F.lit("unspecified"), lambda acc, f: F.coalesce(told(f), acc))


def heading_lines(text: Column) -> Column:
    return F.filter(C.lines(text), lambda x: x.startswith("#") | (x.contains("#") & F.regexp_replace(x, r"(?U)^\s+", "").startswith("#")))


def findings(sections: DataFrame, prefix: str = "RES") -> DataFrame:
    """blocks() to one row a finding.

    path, id, number, first_seq, sections, blob, status, severity, title (for
    notes), lint_title (without a closing tag), refs (other ids, by number then
    id), has_status and has_severity (for lint: over all headings).
    """
    fid = rx.finding_id(prefix)
    whole = sections.groupBy("path", "id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "block"))), lambda b: b["block"]), "\n\n").alias("blob"),
        F.min("seq").alias("first_seq"),
        F.count("*").cast("int").alias("sections"),
    )
    head = rf"(?U)^{rx.HEADING}{fid}"
    states = F.filter("facts", lambda f: f["own"] | f["status"] | f["severity"])
    first = F.get(F.filter("facts", lambda f: f["own"]), F.lit(0))["h"]
    number = lambda r: C.number_of(r)
    refs = F.filter(F.array_distinct(C.find_all(F.col("blob"), f"(?U){fid}", 0)), lambda r: r != F.col("id"))
    ordered = F.array_sort(F.transform(refs, lambda r: F.struct(number(r).alias("n"), r.alias("r"))))
    lint_title = F.regexp_replace(F.regexp_replace("first", head + r"\s*[—:–-]?\s*", ""), r"(?U)\[[A-Za-z]+\]\s*$", "")
    return whole.withColumn("facts", heading_facts(heading_lines(F.col("blob")), head)).withColumn("states", states).withColumn("first", first).select(
        "path",
        "id",
        C.number_of(F.col("id")).alias("number"),
        "first_seq",
        "sections",
        "blob",
        fold_status(F.col("states")).alias("status"),
        fold_severity(F.col("states")).alias("severity"),
        F.coalesce(C.strip(F.regexp_replace("first", head + r"\s*[—:-]?\s*", "")), F.col("id")).alias("title"),
        F.coalesce(C.strip(lint_title), F.lit("")).alias("lint_title"),
        F.transform(ordered, lambda s: s["r"]).alias("refs"),
        F.exists("facts", lambda f: f["status"]).alias("has_status"),
        F.exists("facts", lambda f: f["severity"] | tagged_severity(f["h"]).isNotNull()).alias("has_severity"),
    )


def related(found: DataFrame) -> DataFrame:
    """id, ref, rank."""
    return found.select("id", F.posexplode("refs").alias("rank", "ref"))


def id_styles(registers: DataFrame) -> DataFrame:
    """style, n: the identifier styles that headings really use."""
    h = registers.select(F.explode(heading_lines(C.unix_lines(F.col("text")))).alias("h"))
    stem, digits = F.regexp_extract("h", rx.ID_STYLE, 1), F.regexp_extract("h", rx.ID_STYLE, 2)
    sep = F.when(F.contains(F.col("h"), F.concat(F.col("stem"), F.lit("-"), F.col("digits"))), "-").otherwise("")
    return (
        h.select(C.rstrip(F.col("h")).alias("h"), stem.alias("stem"), digits.alias("digits"))
        .where(F.col("stem") != "")
        .groupBy(F.concat("stem", sep, F.lit("<n>")).alias("style"))
        .agg(F.count("*").alias("n"))
    )


def status_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count("*").alias("n"))


def open_high(found: DataFrame) -> DataFrame:
    return found.where((F.col("status") == "open") & F.col("severity").isin("critical", "high"))
