"""What a note's authored text refers to: symbols and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rx

DEFAULT_MIN_LEN = 7
INLINE, BARE = 0, 1


def authored(text: Column) -> Column:
    """A note without frontmatter, managed or older link blocks and generated lines: never our own output."""
    for pattern in (rx.FRONTMATTER, rx.MANAGED, rx.OLD_BLOCK, rx.RELATED_LINE):
        text = F.regexp_replace(text, pattern, "")
    return text


def is_owned(text: Column, marker: str = "findings_schema") -> Column:
    """The marker stands in the frontmatter, not merely somewhere."""
    return F.regexp_extract(text, rx.FRONTMATTER, 1).rlike(rf"(?m)^{rx.quoted(marker)}:\s*1\s*$")


def frontmatter(text: Column) -> Column:
    """Unindented key: value lines as a map, the last of a key."""
    pairs = F.filter(F.split(F.regexp_extract(text, rx.FRONTMATTER, 1), "\n"), lambda x: x.rlike(r"^[^\s:][^:]*:"))
    keyed = F.transform(
        pairs,
        lambda x: F.struct(
            F.substring_index(x, ":", 1).alias("k"), C.strip(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")
        ),
    )
    return _last_of_each(keyed)


def _last_of_each(pairs: Column) -> Column:
    """An array of (k, v) as a map; of equal keys the last. The pairs are parsed once, not once a pair."""

    def last(ps):
        keys = F.transform(ps, lambda p: p["k"])
        later = lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"])
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), ps).otherwise(F.filter(ps, later))

    return F.map_from_entries(C.let(pairs, last))


def overrides(text: Column, key: str = "findings") -> Column:
    """The author's own decisions: the mapping under ``key`` within the first 2000 characters."""
    block = F.regexp_extract(
        F.substring(text, 1, 2000), rf"(?Um)^\s*{rx.quoted(key)}:\s*$\n((?:\s+\w[\w.]*:\s*\S+\s*\n)+)", 1
    )
    pairs = F.transform(
        F.filter(F.split(block, r"\n"), lambda x: x.contains(":")),
        lambda x: F.struct(
            C.strip(F.substring_index(x, ":", 1)).alias("k"), C.strip(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")
        ),
    )
    kept = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "") & (p["k"] != "symbols"))
    none = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    return F.when(F.contains(text, F.lit(f"{key}:")), _last_of_each(kept)).otherwise(none)


#: What a token is: a code span, the tail of a dotted one, a word of the text.
_SPAN, _TAIL, _BARE = "0", "1", "2"


def tokens(body: Column, stop: list[str], min_len: int) -> Column:
    """Candidate tokens, each behind the digit of its kind. Spans pass both filters."""

    def tried(spans):
        dotted = F.filter(spans, lambda t: t.contains(".") & t.rlike(f"^{rx.DOTTED}$"))
        return F.concat(_kind(_SPAN, spans), _kind(_TAIL, dotted))

    spans = C.let(F.array_distinct(F.transform(C.find_all(body, rx.CODE_SPAN), C.span_token)), tried)
    long = lambda m: F.length(m) >= min_len
    bare = F.array_union(
        F.filter(C.find_all(body, rx.SNAKE), lambda m: long(m) & ~m.isin(*stop)),
        F.filter(C.find_all(body, rx.CAMEL), lambda m: long(m) & ~F.lower(m).isin(*stop)),
    )
    return F.concat(spans, _kind(_BARE, bare))


def _kind(digit: str, found: Column) -> Column:
    return F.transform(found, lambda t: F.concat(F.lit(digit), t))


def symbol_refs(
    notes: DataFrame, names: DataFrame, min_len: int = DEFAULT_MIN_LEN, stopwords: tuple[str, ...] = rx.STOPWORDS, flag: str | None = None
) -> DataFrame:
    """notes (note, body) and names (name) to note, name, evidence: known names, the strongest evidence of each.

    flag: a boolean column of names, one value a name, to be handed on.

    One semi-join on the exploded tokens; a dotted span falls back to its tail
    only where the whole span is no name itself.
    """
    stop = sorted(stopwords) or [""]
    each = notes.select("note", F.explode(tokens(F.col("body"), stop, min_len)).alias("t"))
    each = each.select("note", F.left("t", F.lit(1)).alias("kind"), F.substr("t", F.lit(2)).alias("token"))
    name = F.when(F.col("kind") == _TAIL, C.tail(F.col("token"))).otherwise(F.col("token")).alias("name")
    flagged = F.lit(False) if flag is None else F.col(flag)
    index = names.select("name", flagged.cast("int").alias("flag")).distinct()
    known = each.select("note", "kind", "token", name).join(index, "name")
    # Both groupings and the later join on the note work within this one partitioning.
    bare = F.col("kind") == _BARE
    # The turn and the flag in one number: the least is that of the earlier turn, with its name's flag.
    turn = F.when(F.col("kind") == _TAIL, 2).otherwise(0) + F.col("flag")
    known = known.select("note", bare.alias("bare"), "token", turn.alias("turn"))
    known = known.repartition(int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "note")
    first = known.groupBy("note", "bare", "token").agg(F.min("turn").alias("turn"))
    name = F.when(F.col("turn") < 2, F.col("token")).otherwise(C.tail(F.col("token")))
    rank = F.min(F.when(F.col("bare"), BARE).otherwise(INLINE)).alias("rank")
    best = first.groupBy("note", name.alias("name")).agg(rank, F.max(F.col("turn") % 2 == 1).alias("flag"))
    return best.select("note", "name", F.when(F.col("rank") == INLINE, "inline-code").otherwise("identifier").alias("evidence"), *([] if flag is None else [F.col("flag").alias(flag)]))


def file_refs(notes: DataFrame) -> DataFrame:
    """note, ref, evidence, pos: path-shaped tokens in order of first sight; spans before bare ones."""
    body = F.col("body")
    dotted = F.filter(C.find_all(body, rx.CODE_SPAN), lambda t: t.contains("."))
    spans = F.filter(F.transform(dotted, C.strip), lambda t: t.rlike(rx.FILE_TOKEN))
    bare = F.when(body.contains("/"), C.find_all(body, rx.FILE_BARE)).otherwise(F.array().cast("array<string>"))
    each = lambda found, kind: F.transform(found, lambda t: F.struct(C.norm_ref(t).alias("ref"), F.lit(kind).alias("kind")))
    # The place and the kind in one number: the first place of a reference is the least number, and tells its kind.
    at = (F.col("pos") * 2 + F.col("r.kind")).alias("at")
    return (
        notes.select("note", F.posexplode(F.concat(each(spans, INLINE), each(bare, BARE))).alias("pos", "r"))
        .select("note", "r.ref", at)
        .groupBy("note", "ref")
        .agg(F.min("at").alias("at"))
        .select("note", "ref", F.when(F.col("at") % 2 == INLINE, "inline-code").otherwise("bare").alias("evidence"), F.floor(F.col("at") / 2).cast("int").alias("pos"))
    )


def repo_files(paths: DataFrame) -> DataFrame:
    return paths.select("path", C.basename(F.col("path")).alias("basename")).distinct()


def resolve_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """All paths whose last components are the reference's: each spelling is resolved once, not once a note.

    A path stands under each of its suffixes, so that a spelling meets its matches alone, however many
    files have its basename.
    """
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    each = files.select(F.col("path").alias("match"), F.explode(suffixes).alias("ref"))
    hits = each.join(refs.select("ref").distinct(), "ref").groupBy("ref").agg(F.sort_array(F.collect_set("match")).alias("matches"))
    empty = F.array().cast("array<string>")
    return refs.join(hits, "ref", "left").select("note", "ref", "evidence", "pos", F.coalesce("matches", empty).alias("matches"))


def deliberate(text: Column) -> Column:
    """Tokens that can only be identifiers, without any index."""
    stop = sorted(rx.STOPWORDS)
    spans = F.filter(
        F.transform(C.find_all(text, rx.CODE_SPAN), C.span_token),
        lambda t: t.rlike(rx.IDENT) | (t.contains(".") & t.rlike(f"^{rx.DOTTED}$") & ~C.is_filename(t)),
    )
    snake = F.filter(C.find_all(text, rx.SNAKE), lambda m: m.contains("_") & ~m.isin(*stop))
    capitals = lambda m: F.length(F.regexp_replace(m, "[^A-Z]", ""))
    camel = F.filter(
        C.find_all(text, rx.CAMEL),
        lambda m: m.rlike("[a-z]") & ((capitals(m) >= 2) | m.rlike("[0-9]")) & ~F.lower(m).isin(*stop),
    )
    dotted = F.filter(
        F.transform(C.find_all(text, rx.DOTTED, 0), C.strip_syntax),
        lambda t: t.contains(".") & ~C.is_filename(t) & ~t.rlike(r"(?s)(?:\A|\.)[^.]?(?:\.|\z)"),
    )
    return F.array_distinct(F.concat(spans, snake, camel, dotted))
