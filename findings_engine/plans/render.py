"""Tables to Markdown and JSON, and their export as files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rx
from ..sources.registers import STATE_SCHEMA


def _wiki(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("[["), n, F.lit("]]"))), " ")


def note_text(found: DataFrame) -> DataFrame:
    """findings() rows to note, text."""
    related = F.when(F.size("refs") > 0, _wiki(F.col("refs"))).otherwise("none")
    text = F.concat(
        F.lit("---\nfindings_schema: 1\nfindings_id: "), "id", F.lit("\nid: "), "id", F.lit("\nstatus: "), "status",
        F.lit("\nseverity: "), "severity", F.lit("\nsections: "), F.col("sections").cast("string"), F.lit("\n---\n\n# "), "id",
        F.lit(" — "), "title", F.lit("\n\nRelated: "), related, F.lit("\n\n---\n\n"), "blob", F.lit("\n"),
    )
    return found.select(F.col("id").alias("note"), text.alias("text"))


def index_lines(found: DataFrame) -> DataFrame:
    """part, at1, at2, line of the findings' overview: the table, then what is open and severe; by number."""
    cells = F.concat(
        F.lit("| [["), "id", F.lit("]] | "), "status", F.lit(" | "), "severity", F.lit(" | "), F.col("sections").cast("string"),
        F.lit(" | "), F.substring("title", 1, 70), F.lit(" |"),
    )
    row = lambda df, part, text: df.select(F.lit(part).alias("part"), F.col("number").alias("at1"), F.col("first_seq").alias("at2"), text.alias("line"))
    high = found.where((F.col("status") == "open") & F.col("severity").isin("critical", "high"))
    bullet = F.concat(F.lit("- [["), "id", F.lit("]] — "), F.substring("title", 1, 80))
    return row(found, 1, cells).unionByName(row(high, 2, bullet))


def manifest_json(found: DataFrame, prefix: str, source: str) -> DataFrame:
    """One row, text."""
    files = F.transform(
        F.array_sort(F.collect_list(F.struct("first_seq", F.concat("id", F.lit(".md")).alias("f")))), lambda x: x["f"]
    )
    whole = F.struct(
        F.lit(2).alias("schema_version"),
        F.struct(F.lit(prefix).alias("prefix"), F.lit(source).alias("source")).alias("register"),
        F.lit(source).alias("generated_from"),
        files.alias("generated_notes"),
    )
    return found.agg(F.to_json(whole).alias("text"))


def block(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """note, block: the managed part of each note that links anything."""
    sym = links.select("note", F.lit(0).alias("kind"), "rank", F.concat(F.lit("- `"), "name", F.lit("` — "), C.location(F.col("path"), F.col("line"))).alias("l"))
    fil = anchors.select("note", F.lit(1).alias("kind"), "rank", F.concat(F.lit("- `"), "path", F.lit("`")).alias("l"))
    ls = F.sort_array(F.collect_list(F.struct("kind", "rank", "l")))["l"]
    whole = sym.unionByName(fil).groupBy("note").agg(ls.alias("ls"))
    return whole.select("note", F.concat(F.lit(f"{rx.MARK_START}\n## Linked code\n\n"), F.array_join("ls", "\n"), F.lit(f"\n{rx.MARK_END}\n\n")).alias("block"))


def with_block(text: Column, new: Column) -> Column:
    """The text with its managed block replaced, put behind the frontmatter, or taken out where ``new`` is null."""
    bare = F.regexp_replace(F.regexp_replace(text, rx.MANAGED, ""), rx.OLD_BLOCK, "")
    head = F.regexp_extract(bare, rx.FRONTMATTER, 0)
    rest = F.regexp_replace(F.substr(bare, F.length(head) + 1), r"\A\n+", "")
    placed = F.when(head == "", F.concat(new, bare)).otherwise(F.concat(head, F.lit("\n"), new, rest))
    return F.when(new.isNull(), bare).otherwise(placed)


def rewritten(notes: DataFrame, blocks: DataFrame) -> DataFrame:
    """note, text, changed for every note."""
    rows = notes.join(blocks, "note", "left").withColumn("new", with_block(F.col("text"), F.col("block")))
    return rows.select("note", F.col("new").alias("text"), (F.col("new") != F.col("text")).alias("changed"))


def code_index_lines(
    reverse: DataFrame, anchored: DataFrame, hot_symbols: DataFrame, hot_files: DataFrame, ambiguous_refs: DataFrame
) -> DataFrame:
    """section, at1 (descending count), at2 (name), line of the reverse index; a section without rows has no heading."""

    def rows(df: DataFrame, section: int, count: Column, name: str, line: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), (-count).cast("long").alias("at1"), F.col(name).alias("at2"), line.alias("line"))

    pipe = lambda *cs: F.concat(F.lit("| "), *[x for c in cs for x in (c, F.lit(" | "))][:-1], F.lit(" |"))
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    text = lambda c: F.col(c).cast("string")
    loc = C.escape_pipe(F.col("location"))
    entry = F.concat(
        F.lit("### "), tick(F.col("ref")), F.lit("\n\nReferenced by: "), _wiki(F.col("notes")), F.lit("\n\nCandidates:\n\n- "),
        F.array_join("candidates", "\n- "),
    )
    return (
        rows(reverse, 1, F.col("note_count"), "name", pipe(tick(F.col("name")), loc, _wiki(F.col("notes"))))
        .unionByName(rows(anchored, 2, F.col("note_count"), "path", pipe(C.escape_pipe(F.col("path")), _wiki(F.col("notes")))))
        .unionByName(rows(hot_symbols, 3, F.col("note_count"), "name", pipe(tick(F.col("name")), loc, _wiki(F.col("notes")), text("note_count"))))
        .unionByName(rows(hot_files, 4, F.col("note_links"), "path", pipe(C.escape_pipe(F.col("path")), text("distinct_symbols"), text("note_links"))))
        .unionByName(rows(ambiguous_refs, 5, F.when(F.col("kind") == "symbol", 1).otherwise(0), "ref", entry))
    )


def state_json(state_notes: DataFrame, hashes: DataFrame, symbols_fingerprint: str, options_fingerprint: Column) -> DataFrame:
    """One row, text: the link state as a file for other tools; large vaults keep the tables instead."""
    note = F.struct("content_hash", "linked", "locations", "files", "files_fingerprint", "ambiguous")
    notes = state_notes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat("note", F.lit(".md")).alias("k"), note.alias("v"))))).alias("notes"))
    names = hashes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "hash")))).alias("symbol_locations"))
    whole = F.struct(
        F.lit(STATE_SCHEMA).alias("schema_version"), F.lit(symbols_fingerprint).alias("symbols_fingerprint"),
        options_fingerprint.alias("options_fingerprint"), "symbol_locations", "notes",
    )
    return notes.crossJoin(names).select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("text"))


def export(texts: DataFrame, root: str) -> None:
    """Write (note, text) as files, one a note: a temporary file, then a rename. ``root`` must be shared by the tasks."""

    def write(rows):
        os.makedirs(root, exist_ok=True)
        for r in rows:
            path = os.path.join(root, f"{r.note}.md")
            if os.path.dirname(os.path.realpath(path)) != os.path.realpath(root):
                raise ValueError(f"{r.note!r} leaves the vault")
            with open(f"{path}.{os.getpid()}.tmp", "w", encoding="utf-8") as f:
                f.write(r.text)
            os.replace(f"{path}.{os.getpid()}.tmp", path)

    texts.select("note", "text").foreachPartition(write)


def stale_notes(manifest_notes: DataFrame, found: DataFrame, prefix: str) -> DataFrame:
    """note: recorded before, gone from the register, and safely named."""
    safe = rf"(?U)^{rx.finding_id(prefix)}$"
    return manifest_notes.where(F.col("note").rlike(safe)).select("note").distinct().join(found.select(F.col("id").alias("note")), "note", "left_anti")


def prune(stale: DataFrame, root: str, marker: str = "findings_schema: 1") -> list[str]:
    """Delete stale notes: only inside ``root``, only with our marker in their frontmatter. Returns what went."""
    gone, top = [], os.path.realpath(root)
    for r in stale.toLocalIterator():
        path = os.path.realpath(os.path.join(top, f"{r.note}.md"))
        if os.path.dirname(path) != top or not os.path.isfile(path):
            continue
        with open(path, encoding="utf-8", errors="replace") as f:
            head = f.read(400)
        if head.startswith("---") and marker in head.split("\n---", 1)[0]:
            os.remove(path)
            gone.append(r.note)
    return sorted(gone)
