"""What is already known of a file: the notes that link or anchor to it, most urgent first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

SHOWN = 5


def heads(notes: DataFrame, id_field: str = "findings_id") -> DataFrame:
    """note, id, status, severity, title from the tops of notes: frontmatter and the first heading, within 200 lines."""
    top = F.slice(F.split(F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", ""), "\n"), 1, 200)
    title = C.strip(F.substr(F.get(F.filter(top, lambda x: x.startswith("# ")), F.lit(0)), F.lit(3)))
    field = lambda k: F.coalesce(F.try_element_at("fm", F.lit(k)), F.lit(""))
    return notes.select(
        "note",
        F.coalesce(C.or_null(field(id_field)), "note").alias("id"),
        field("status").alias("status"),
        field("severity").alias("severity"),
        tidy_title(F.coalesce(title, F.lit("")), F.coalesce(C.or_null(field(id_field)), F.col("note")), field("severity")).alias("title"),
    )


def tidy_title(title: Column, note_id: Column, severity: Column) -> Column:
    """Without the id before it and the severity's tag behind it."""
    cut = title
    for sep in (" — ", " – ", " - "):
        start = F.concat(note_id, F.lit(sep))
        cut = F.when(F.startswith(title, start), F.substr(title, F.length(start) + 1)).otherwise(cut)
    tag = F.concat(F.lit("["), severity, F.lit("]"))
    tagged = (severity != "") & F.endswith(F.lower(cut), F.lower(tag))
    return C.strip(F.when(tagged, F.substr(cut, F.lit(1), F.length(cut) - F.length(tag))).otherwise(cut))


def known(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """path, note, symbols (name, line) by rank, anchored: the lookup table, keyed by path."""
    hit = links.select("path", "note", F.struct("rank", "name", "line").alias("s"), F.lit(False).alias("f"))
    hit = hit.unionByName(anchors.select("path", "note", F.lit(None).cast("struct<rank:int,name:string,line:int>").alias("s"), F.lit(True).alias("f")))
    return hit.groupBy("path", "note").agg(F.sort_array(F.collect_list("s")).alias("symbols"), F.bool_or("f").alias("anchored"))


def ranked(table: DataFrame, top: DataFrame, shown: int = SHOWN) -> DataFrame:
    """path, place, hidden, and the note's head: at most ``shown`` a path, open and severe first."""
    matches = F.size("symbols") + F.col("anchored").cast("int")
    order = Window.partitionBy("path").orderBy(
        F.when(F.col("status") == "open", 0).otherwise(1), C.severity_rank(F.col("severity")), F.desc("matches"), "id", "note"
    )
    rows = table.join(top, "note").withColumn("matches", matches)
    total = rows.groupBy("path").agg(F.count("*").alias("total"))
    best = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= shown)
    return best.join(total, "path").select(
        "path", "place", "note", "id", "status", "severity", "title", "matches", "symbols", "anchored",
        F.greatest(F.col("total") - shown, F.lit(0)).alias("hidden"),
    )


def context(best: DataFrame) -> DataFrame:
    """path, context: the answer as one text; a path that nothing is known of has no row."""
    tag = F.concat_ws("/", C.or_null(F.col("status")), C.or_null(F.col("severity")))
    name = lambda s: F.when(s["line"].isNotNull(), F.concat(s["name"], F.lit(" (L"), s["line"].cast("string"), F.lit(")"))).otherwise(s["name"])
    why = F.when(F.size("symbols") > 0, F.concat(F.lit("symbols: "), F.array_join(F.transform("symbols", name), ", "))).otherwise(
        F.concat(F.lit("file: "), "path")
    )
    bullet = F.concat(
        F.lit("- "), "id", F.lit(" ["), F.when(tag == "", "?").otherwise(tag), F.lit("]"),
        F.when(F.col("title") == "", "").otherwise(F.concat(F.lit(" "), "title")), F.lit(" — "), why,
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", bullet.alias("b")))), lambda x: x["b"])
    whole = best.groupBy("path").agg(lines.alias("ls"), F.max("hidden").alias("hidden"))
    more = F.when(F.col("hidden") > 0, F.concat(F.lit("\nand "), F.col("hidden").cast("string"), F.lit(" more"))).otherwise("")
    return whole.select("path", F.concat(F.lit("Known findings about "), "path", F.lit(":\n"), F.array_join("ls", "\n"), more).alias("context"))


def answer(requests: DataFrame, table: DataFrame, top: DataFrame, shown: int = SHOWN) -> DataFrame:
    """requests (path) to path, context; only asked paths are ranked."""
    asked = table.join(requests.select("path").distinct(), "path", "left_semi")
    return context(ranked(asked, top, shown))


def hook_json(answers: DataFrame) -> DataFrame:
    inner = F.struct(F.lit("PostToolUse").alias("hookEventName"), F.col("context").alias("additionalContext"))
    return answers.select("path", F.to_json(F.struct(inner.alias("hookSpecificOutput"))).alias("json"))
