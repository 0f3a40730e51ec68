"""Symbol indexes from tag files, graphs, source text and written indexes: all to symbol_def rows.

symbol_def: name, path, line, kind, qualified_name; one row a definition,
unique by (name, path, line), where two unknown lines are equal.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rx

COLUMNS = ("name", "path", "line", "kind", "qualified_name")
MAX_FILES = 20_000


def distinct_definitions(rows: DataFrame) -> DataFrame:
    """The first by (kind, qualified_name) of equal (name, path, line)."""
    first = F.min(F.struct("kind", "qualified_name")).alias("f")
    return rows.groupBy("name", "path", "line").agg(first).select("name", "path", "line", "f.kind", "f.qualified_name")


def from_sources(files: DataFrame) -> DataFrame:
    """(path, content) of source files to definitions, by one pattern an extension, the first match a line."""
    ext = C.extension(F.col("path"))
    line = F.posexplode(F.split(C.text_of(F.col("content")), "\n", -1)).alias("at", "l")
    rows = files.where(ext.isin(*rx.DEFINITIONS)).select("path", ext.alias("kind"), line)
    name = reduce(
        lambda c, e: (F if c is None else c).when(F.col("kind") == e, F.regexp_extract("l", rx.DEFINITIONS[e], 1)), rx.DEFINITIONS, None
    )
    stem = C.without_extension(C.basename(F.col("path")))
    return distinct_definitions(
        rows.select(name.alias("name"), "path", (F.col("at") + 1).alias("line"), "kind")
        .where("name <> ''")
        .select("name", "path", "line", "kind", F.concat(stem, F.lit("."), "name").alias("qualified_name"))
    )


def from_tags(lines: DataFrame) -> DataFrame:
    """(value) lines of a tags file: tab-separated, extension fields for line, kind and scope."""
    f = F.split("value", "\t", -1)
    scope = C.first_group(F.col("value"), r"(?U)\b(?:module|namespace|scope|struct|class):([\w.]+)")
    rows = lines.where(~F.startswith("value", F.lit("!_TAG_")) & (F.size(f) >= 3)).select(
        F.get(f, F.lit(0)).alias("name"),
        F.get(f, F.lit(1)).alias("path"),
        C.text_line_number(F.regexp_extract("value", r"(?U)line:(\d+)", 1)).alias("line"),
        F.regexp_extract("value", r"(?U)\bkind:(\w+)", 1).alias("kind"),
        F.when(scope.isNotNull(), F.concat(scope, F.lit("."), F.get(f, F.lit(0)))).alias("qualified_name"),
    )
    return distinct_definitions(rows)


def from_graph(texts: DataFrame) -> DataFrame:
    """(text) of a graph's JSON: nodes, or graph.nodes; empty fields fall through to the next like missing ones."""
    v = F.try_parse_json("text")
    nodes = F.coalesce(
        F.try_variant_get(v, "$.nodes", "array<variant>"), F.try_variant_get(v, "$.graph.nodes", "array<variant>")
    )
    n = texts.select(F.explode(nodes).alias("n"))
    get = lambda k: F.try_variant_get("n", f"$.{k}", "string")
    some = lambda *ks: F.coalesce(*[C.or_null(get(k)) for k in ks], F.lit(""))
    label = F.regexp_replace(F.regexp_replace(C.strip(some("label", "name")), r"[()]+$", ""), r"^\.+", "")
    place = lambda k: F.try_variant_get("n", f"$.{k}", "variant")
    truthy = F.coalesce(~get("source_location").isin("", "0", "false", "0.0"), F.lit(False))
    norm = C.strip(some("norm_label"))
    rows = n.select(
        label.alias("name"),
        some("source_file", "source", "file").alias("path"),
        C.line_number(F.when(truthy, place("source_location")).otherwise(place("line"))).alias("line"),
        some("file_type").alias("kind"),
        norm.alias("norm"),
    ).where("name <> '' and path <> ''")
    qualified = F.when((F.col("norm") != "") & (F.col("norm") != F.col("name")) & F.col("norm").contains("."), F.col("norm"))
    return distinct_definitions(rows.select("name", "path", "line", "kind", qualified.alias("qualified_name")))


def from_index(texts: DataFrame) -> DataFrame:
    """(text) of a written index: version 1 maps a name to path:Lline, later ones to a list; with or without envelope."""
    v = F.try_parse_json("text")
    whole = F.coalesce(F.try_variant_get(v, "$.symbols", "map<string,variant>"), F.try_variant_get(v, "$", "map<string,variant>"))
    e = texts.select(F.explode(whole).alias("name", "v"))
    item = "struct<path:string,line:int,kind:string,qualified_name:string>"
    lists = F.try_variant_get("v", "$", f"array<{item}>")
    text = F.try_variant_get("v", "$", "string")
    path = F.regexp_extract(text, r"^(.*):[^:]*$", 1)
    line = C.text_line_number(F.regexp_extract(text, r":([^:]*)$", 1))
    one = F.struct(
        F.when(path != "", path).otherwise(text).alias("path"),
        F.when(path != "", line).alias("line"),
        F.lit("").alias("kind"),
        F.col("name").alias("qualified_name"),
    )
    return distinct_definitions(
        e.select("name", F.explode(F.coalesce(lists, F.array(one.cast(item)))).alias("d")).select(
            "name", "d.path", "d.line", F.coalesce("d.kind", F.lit("")).alias("kind"), "d.qualified_name"
        )
    )


def first_non_empty(backends: list[tuple[str, Callable[[], tuple[DataFrame, str | None]]]]) -> tuple[str, DataFrame | None, list[str]]:
    """The first backend that has any definition, its rows, and the notes of all that were asked.

    A backend gives (symbol_def, note): a note tells of a failure or of what it
    left out, and is kept even where it has definitions. One that raises has none.
    """
    notes: list[str] = []
    for name, ask in backends:
        try:
            rows, note = ask()
            empty = rows.isEmpty()
        except Exception as e:  # noqa: BLE001 - another backend may still answer
            notes.append(f"{name}: {type(e).__name__}")
            continue
        if note:
            notes.append(f"{name}: {note}")
        if not empty:
            return name, rows, notes
    return "none", None, notes


def _records(files: DataFrame) -> Column:
    return F.concat("path", F.lit("\0"), F.sha2("content", 256), F.lit("\n"))


def tree_fingerprint(files: DataFrame) -> DataFrame:
    """One row: fingerprint, files. A digest of the sorted records ``path NUL sha256 LF``; unreadable files have none.

    Contents are hashed where they are. The digest over the records is one chain
    by definition, so they go to one task, but sorted on disk and streamed through
    it: a record is about a hundred bytes and none is kept.
    """
    schema = pa.schema([("fingerprint", pa.string()), ("files", pa.int64())])

    def run(batches):
        import hashlib

        h, n = hashlib.sha256(), 0
        for b in batches:
            for r in b.column("r").to_pylist():
                h.update(r.encode())
                n += 1
        yield pa.RecordBatch.from_pylist([{"fingerprint": "sha256:" + h.hexdigest(), "files": n}], schema)

    records = files.select(_records(files).alias("r")).where("r is not null")
    return records.repartition(1).sortWithinPartitions("r").mapInArrow(run, "fingerprint string, files bigint")


def tree_fingerprints(files: DataFrame, *keys: str) -> DataFrame:
    """The same for many small trees at once: keys, fingerprint, files; a tree's records are held together."""
    every = F.collect_list(_records(files))
    return files.groupBy(*keys).agg(C.sha(F.array_join(F.sort_array(every), "")).alias("fingerprint"), F.count("content").alias("files"))


def write_index(symbols: DataFrame, path: str) -> None:
    symbols.write.mode("overwrite").parquet(path)


def index_json(symbols: DataFrame, meta: dict[str, Column] | None = None) -> DataFrame:
    """One row, text: the index as JSON with an envelope of the given columns."""
    loc = F.struct("path", "line", "kind", "qualified_name")
    per = symbols.groupBy("name").agg(F.array_sort(F.collect_list(loc)).alias("locs"))
    all_ = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "locs")))).alias("symbols"))
    extra = [c.alias(k) for k, c in (meta or {}).items()]
    return all_.select(F.to_json(F.struct(F.lit(3).alias("schema_version"), *extra, "symbols"), {"ignoreNullFields": "false"}).alias("text"))


def read_sources(spark: SparkSession, root: str, max_files: int = MAX_FILES) -> DataFrame:
    """(path, content) of at most max_files source files; ``scan_note`` says whether there are more."""
    from .tree import register

    register(spark)
    return spark.read.format("source_tree").option("extensions", ",".join(rx.DEFINITIONS)).option("maxFiles", max_files).load(root)


def scan_note(root: str, max_files: int = MAX_FILES) -> str | None:
    """What a scan of the tree leaves out, None if nothing: an index of it is partial."""
    from .tree import count_files

    more = count_files(root, frozenset(rx.DEFINITIONS), max_files) > max_files
    return f"max-files-reached at {max_files}" if more else None
