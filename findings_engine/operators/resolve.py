"""Which definition a reference names: match, no match or ambiguous, always with a reason.

A reference may have very many definitions of its name, so it is never paired
with them. What a note says is turned into keys (dotted spellings and their
suffixes, qualified names and paths that stand in its text, the author's own
word), and the definitions of a name are indexed by the same keys, one row a
(name, key) with the first and the last definition that has it. A decision only
asks whether none, one or several definitions match: one if first and last are
the same. So rows grow with what notes say, not with references times definitions.
In all of this a definition is its place among those of its name: numbers are
folded by hash, and the definition itself is looked up once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rx

DEFAULT_MAX_LINKS = 8


def _locations(symbols: DataFrame) -> DataFrame:
    """symbol_def rows to name, loc: comparable in the order (path, line, kind)."""
    stem = F.split(C.without_extension(F.replace("path", F.lit("\\"), F.lit("/"))), "/")
    parts = F.when(F.element_at(stem, -1) == "__init__", F.slice(stem, 1, F.size(stem) - 1)).otherwise(stem)
    return symbols.select("name", F.struct("path", "line", "kind", "qualified_name", parts.alias("parts")).alias("loc"))


def placed(symbols: DataFrame) -> DataFrame:
    """name, at, loc: each definition by its place among those of its name."""
    return _locations(symbols).withColumn("at", F.dense_rank().over(Window.partitionBy("name").orderBy("loc")))


def _suffixes(parts: Column, glue: str) -> Column:
    """The last 1, 2, ... of the parts, joined."""
    n = F.size(parts)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), glue))).otherwise(
        F.array().cast("array<string>")
    )


def _marked(mark: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(mark), k))


def _some(when: Column, value: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(value)).otherwise(F.array().cast("array<string>"))


def definition_keys(places: DataFrame) -> DataFrame:
    """name, key, lo, hi: the places of the first and the last definition of a name that a key stands for.

    Keys: s: a qualified name or one of its dotted suffixes, w: a dotted qualified
    name, p: a suffix of the path's parts, q: a qualified name other than the name
    itself, f: a path, o: whatever an override may say.
    """
    q, path = F.col("loc.qualified_name"), F.col("loc.path")
    named = q != ""
    keys = F.concat(
        F.when(F.coalesce(named, F.lit(False)), _marked("s:", _suffixes(F.split(q, r"\."), "."))).otherwise(F.array().cast("array<string>")),
        _some(named & q.contains("."), F.concat(F.lit("w:"), q)),
        _marked("p:", _suffixes(F.col("loc.parts"), "/")),
        _some(named & (q != F.col("name")), F.concat(F.lit("q:"), q)),
        F.array(F.concat(F.lit("f:"), path), F.concat(F.lit("o:"), path), F.concat(F.lit("o:"), C.location(path, F.col("loc.line")))),
        _some(named, F.concat(F.lit("o:"), q)),
    )
    each = places.select("name", "at", F.explode(F.array_distinct(keys)).alias("key"))
    return each.groupBy("name", "key").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))


#: Two runs of word characters with one character between, or one run, that stand inside a path with
#: something else on both sides: where the path stands in a text, so does its key, as whole runs.
_PAIR, _RUN = r"(?s).*(?<=\W)(\w+\W\w+)(?=\W)", r"(?s).*(?<=\W)(\w+)(?=\W)"


def _path_key(path: Column) -> Column:
    return F.coalesce(C.first_group(path, _PAIR), C.first_group(path, _RUN))


def near_paths(notes: DataFrame, symbols: DataFrame) -> DataFrame:
    """note, near: the definitions' paths whose key stands in the note's text; whether all of a path does is left to see.

    Only words that one of the keys' own separators joins are looked at.
    """
    keyed = symbols.select("path").distinct().select(_path_key(F.col("path")).alias("key"), "path").where("key is not null")
    glue = C.first_group(F.col("key"), r"(?s)\A\w+(\W)\w+\z")
    shape = keyed.agg(F.collect_set(glue).alias("glue"), F.coalesce(F.max(glue.isNull()), F.lit(False)).alias("runs"))
    any_of = F.array_join(F.transform("glue", lambda g: F.concat(F.lit("\\x{"), F.hex(F.ascii(g)), F.lit("}"))), "")
    shape = shape.select(F.when(F.size("glue") > 0, F.concat(F.lit(r"(?<!\w)(?=(\w++["), any_of, F.lit(r"]\w+))"))).alias("pairs"), "glue", "runs")
    body, none = F.col("body"), F.array().cast("array<string>")
    glued = F.exists("glue", lambda g: F.contains(body, g))
    pairs = F.when(glued, F.call_function("regexp_extract_all", body, F.col("pairs"), F.lit(1))).otherwise(none)
    words = F.array_union(pairs, F.when(F.col("runs"), C.find_all(body, r"\w+", 0)).otherwise(none))
    said = notes.crossJoin(F.broadcast(shape)).select("note", F.explode(words).alias("key"))  # one row is broadcast
    return said.join(keyed, "key").groupBy("note").agg(F.collect_set("path").alias("near"))


def names_of(symbols: DataFrame) -> DataFrame:
    """name, n (definitions) and what its keys need of a text.

    lengths: of what stands before ``.name`` in its qualified names; odd: qualified
    names that don't end so; loose: paths without a key. The last two are compared
    with the texts of the name's references one by one.
    """
    q, name = F.col("loc.qualified_name"), F.col("name")
    other = F.coalesce((q != "") & (q != name), F.lit(False))
    ends = q.endswith(F.concat(F.lit("."), name))
    return _locations(symbols).groupBy("name").agg(
        F.count("*").alias("n"),
        F.collect_set(F.when(other & ends, F.length(q) - F.length(name) - 1)).alias("lengths"),
        F.collect_set(F.when(other & ~ends, q)).alias("odd"),
        F.collect_set(F.when(_path_key(F.col("loc.path")).isNull(), F.col("loc.path"))).alias("loose"),
    )


def dotted_refs(chains: Column, name: Column) -> Column:
    """Spellings of ``name`` with a prefix: each chain up to the name's last place in it."""

    def upto(chain):
        whole, one = F.concat(F.lit("."), chain, F.lit(".")), F.concat(F.lit("."), name, F.lit("."))
        # What the last such part leaves behind; all, if there is none.
        rest = F.call_function("substring_index", whole, one, F.lit(-1))
        n = F.length(whole) - F.length(rest)
        return F.when(n > F.length(one), C.strip_syntax(F.substr(whole, F.lit(2), n - 2)))

    mine = F.filter(chains, lambda c: c.contains(name))
    return F.array_sort(F.array_distinct(F.filter(F.transform(mine, upto), lambda r: r.isNotNull() & r.contains("."))))


def matches_qualified(loc: Column, ref: Column) -> Column:
    q = loc["qualified_name"]
    dot = lambda x: F.concat(F.lit("."), x)
    return F.coalesce((q != "") & ((q == ref) | q.endswith(dot(ref)) | (q.contains(".") & ref.endswith(dot(q)))), F.lit(False))


def matches_path(loc: Column, segments: Column) -> Column:
    parts, whole = loc["parts"], F.size(segments)

    def last(k, wanted):
        return (F.size(parts) >= k) & (F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), k) == wanted)

    return last(whole - 1, F.slice(segments, 1, whole - 1)) | last(whole, segments)


def _qualified_in(body: Column, name: Column, lengths: Column) -> Column:
    """For each place of ``.name`` in the text, what stands before it, as long as a qualified name has it."""
    dotted = F.concat(F.lit("."), name)
    parts = F.split(body, F.concat(F.lit("\\Q"), F.replace(dotted, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)

    one = lambda x: F.transform(F.filter(lengths, lambda k: k <= F.length(x)), lambda k: F.concat(F.right(x, k), dotted))

    def at(p):
        before = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.call_function("array_join", F.slice(p, 1, i), dotted))
        return F.when(F.size(p) > 1, F.flatten(F.transform(before, one))).otherwise(F.array().cast("array<string>"))

    # Most names have one such place, which needs no list of parts.
    upto = lambda n: F.call_function("substring_index", body, dotted, F.lit(n))
    single = F.concat(upto(1), dotted, upto(-1)) == body
    some = F.when(single, C.let(upto(1), one)).otherwise(C.let(parts, at))
    return F.when((F.size(lengths) > 0) & F.contains(body, dotted), some).otherwise(F.array().cast("array<string>"))


def _keys(refs: Column, name: Column, body: Column, want: Column) -> Column:
    """The keys that a note gives for a name."""

    def spelled(r):
        path = F.replace(r, F.lit("."), F.lit("/"))
        above = F.left(path, F.length(path) - F.length(C.tail(r)) - 1)
        own = F.array(F.concat(F.lit("s:"), r), F.concat(F.lit("p:"), above), F.concat(F.lit("p:"), path))
        return F.concat(own, _marked("w:", C.find_all(r, r"(?<![^.])(?=([^.]+\..+))")))

    within = lambda c: F.filter(c, lambda x: F.contains(body, x))
    return F.array_distinct(
        F.concat(
            F.flatten(F.transform(refs, spelled)),
            _marked("q:", F.concat(_qualified_in(body, name, F.col("lengths")), within(F.col("odd")))),
            _marked("f:", F.concat("paths", within(F.col("loose")))),
            _some(want.isNotNull(), F.concat(F.lit("o:"), want)),
        )
    )


def resolve(refs: DataFrame, notes: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (note, name, evidence), notes (note, body, overrides) and symbol_def to one decision a reference.

    note, name, evidence, reason, location (null where the link is withheld) and
    definitions (how many the name has).
    """
    places = placed(symbols)
    within = F.filter("near", lambda p: F.contains(F.col("body"), p))
    texts = notes.select("note", "body", "overrides", C.find_all(F.col("body"), rx.CHAIN, 0).alias("chains"))
    texts = texts.join(near_paths(notes, symbols), "note", "left").select("note", "body", "overrides", "chains", F.coalesce(within, F.array().cast("array<string>")).alias("paths"))
    rows = refs.join(names_of(symbols), "name").join(texts, "note")
    wanted = F.try_element_at("overrides", F.col("name"))
    rows = rows.withColumn("want", wanted).withColumn("refs", dotted_refs(F.col("chains"), F.col("name")))
    keys = _keys(F.col("refs"), F.col("name"), F.col("body"), F.col("want"))
    # A key of the reference's own, that no definition has, keeps a reference without any other; spread by note.
    own = F.array(F.concat(F.lit("\0"), F.col("note")))
    known = ("note", "name", "evidence", "n", "wanted", "dotted", "spelled")
    rows = rows.select("note", "name", "evidence", "n", F.col("want").isNotNull().alias("wanted"), "refs", "paths", "loose", keys.alias("keys"))
    # The spellings are asked again only where a path stands in the note.
    asked = F.when(F.size("paths") + F.size("loose") > 0, F.col("refs"))
    rows = rows.select("note", "name", "evidence", "n", "wanted", (F.size("refs") > 0).alias("dotted"), asked.alias("spelled"), "keys")
    each = rows.select(*known, F.explode(F.concat(own, "keys")).alias("key")).join(definition_keys(places), ["name", "key"], "left")
    mark = F.left("key", F.lit(2))
    span = [
        x
        for short, marks in (("dq", ("s:", "w:")), ("dp", ("p:",)), ("q", ("q:",)), ("p", ("f:",)), ("o", ("o:",)))
        for x in (
            F.min(F.when(mark.isin(*marks), F.col("lo"))).alias(f"{short}_lo"),
            F.max(F.when(mark.isin(*marks), F.col("hi"))).alias(f"{short}_hi"),
        )
    ]
    found = each.groupBy(*known).agg(*span)

    some = lambda k: F.col(f"{k}_lo").isNotNull()
    one = lambda k: some(k) & (F.col(f"{k}_lo") == F.col(f"{k}_hi"))
    many = lambda k: some(k) & (F.col(f"{k}_lo") != F.col(f"{k}_hi"))
    dotted = F.col("dotted")
    d, d_one = some("dq") | some("dp"), F.when(some("dq"), one("dq")).otherwise(one("dp"))
    # Whether the one definition whose path stands in the note is among those that the dotted spellings match.
    found = _look_up(found, places, F.when(dotted & d & one("p"), F.col("p_lo")), "at_path")
    spelled = F.coalesce("spelled", F.array().cast("array<string>"))
    agrees = F.when(some("dq"), F.exists(spelled, lambda r: matches_qualified(F.col("at_path"), r))).otherwise(
        F.exists(spelled, lambda r: matches_path(F.col("at_path"), F.split(r, r"\.")))
    )
    decided = [
        (F.col("wanted") & some("o"), "frontmatter-override", F.col("o_lo")),
        (F.col("wanted"), "override-unmatched", None),
        (dotted & ~d, "dotted-unmatched", None),
        (F.col("n") == 1, "unique", F.lit(1)),
        (many("q"), "multiple-qualified-names", None),
        (many("p"), "multiple-paths-in-note", None),
        (one("q") & one("p") & (F.col("q_lo") != F.col("p_lo")), "qualified-name-and-path-disagree", None),
        (dotted & d & one("p") & ~agrees, "dotted-and-path-disagree", None),
        (one("q"), "qualified-name", F.col("q_lo")),
        (one("p"), "path-in-note", F.col("p_lo")),
        (dotted & d_one & some("dq"), "dotted-name", F.col("dq_lo")),
        (dotted & d_one, "dotted-path", F.col("dp_lo")),
        (dotted, "dotted-ambiguous", None),
    ]
    reason = None
    for when, code, _ in decided:
        reason = (F if reason is None else reason).when(when, code)
    found = found.withColumn("reason", reason.otherwise("ambiguous"))
    place = None
    for _, code, at in decided:
        if at is not None:
            place = (F if place is None else place).when(F.col("reason") == code, at)
    return _look_up(found, places, place, "location").select("note", "name", "evidence", "reason", "location", F.col("n").alias("definitions"))


def _look_up(rows: DataFrame, places: DataFrame, at: Column, name: str) -> DataFrame:
    """rows with the definition of their name at a place, null where it is null; those are spread by note."""
    none = -(F.pmod(F.xxhash64("note"), F.lit(1 << 20)) + 1)
    own = places.select("name", F.col("at").cast("long").alias("_at"), F.col("loc").alias(name))
    return rows.withColumn("_at", F.coalesce(at.cast("long"), none)).join(own, ["name", "_at"], "left").drop("_at")


def cap_links(decisions: DataFrame, max_links: int = DEFAULT_MAX_LINKS) -> DataFrame:
    """note, name, path, line, evidence, reason, rank: resolved links only, spans first, at most max_links a note."""
    order = Window.partitionBy("note").orderBy(F.when(F.col("evidence") == "inline-code", 0).otherwise(1), "name")
    return (
        decisions.where(F.col("location").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max_links)
        .select("note", "name", "location.path", "location.line", "evidence", "reason", "rank")
    )


def cap_anchors(resolved: DataFrame, links: DataFrame, max_links: int = DEFAULT_MAX_LINKS) -> DataFrame:
    """note, path, rank: uniquely resolved files by first sight, within what the note's links leave of the budget."""
    unique = (
        resolved.where(F.size("matches") == 1)
        .groupBy("note", F.get("matches", F.lit(0)).alias("path"))
        .agg(F.min("pos").alias("pos"))
    )
    used = links.groupBy("note").agg(F.count("*").alias("used"))
    order = Window.partitionBy("note").orderBy("pos")
    return (
        unique.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max_links)
        .join(used, "note", "left")
        .where(F.col("rank") <= max_links - F.coalesce("used", F.lit(0)))
        .select("note", "path", "rank")
    )


def ambiguous(decisions: DataFrame, resolved_files: DataFrame) -> DataFrame:
    """note, kind, ref, reason: every reference whose link is withheld."""
    symbols = decisions.where(F.col("location").isNull()).select(
        "note", F.lit("symbol").alias("kind"), F.col("name").alias("ref"), "reason"
    )
    files = resolved_files.where(F.size("matches") > 1).select(
        "note", F.lit("file").alias("kind"), "ref", F.lit("file-suffix").alias("reason")
    )
    return symbols.unionByName(files)


def candidates(withheld: DataFrame, symbols: DataFrame, resolved_files: DataFrame) -> DataFrame:
    """kind, ref, candidates of each reference withheld somewhere: once, not once a note; in definition order."""
    asked = withheld.where(F.col("kind") == "symbol").select(F.col("ref").alias("name")).distinct()
    place = F.transform(F.array_sort(F.collect_list("loc")), lambda x: C.location(x["path"], x["line"]))
    named = _locations(symbols).join(asked, "name", "left_semi").groupBy(F.col("name").alias("ref")).agg(place.alias("candidates"))
    files = resolved_files.where(F.size("matches") > 1).groupBy("ref").agg(F.any_value("matches").alias("candidates"))
    row = lambda df, kind: df.select(F.lit(kind).alias("kind"), "ref", "candidates")
    return row(named, "symbol").unionByName(row(files, "file"))


def unlinked(notes: DataFrame, links: DataFrame, anchors: DataFrame, withheld: DataFrame, names: DataFrame) -> DataFrame:
    """note, reason of each note without links and anchors; withheld file references don't count as a reason."""
    bare = notes.join(links.select("note").union(anchors.select("note")).distinct(), "note", "left_anti").select("note", "body")
    words = bare.select("note", F.explode(F.array_distinct(C.find_all(F.col("body"), rx.WORD, 0))).alias("name"))
    known = words.join(names.select("name").distinct(), "name", "left_semi").select("note").distinct()
    only = withheld.where(F.col("kind") == "symbol").select("note").distinct()
    return (
        bare.select("note")
        .join(only.withColumn("o", F.lit(True)), "note", "left")
        .join(known.withColumn("k", F.lit(True)), "note", "left")
        .select(
            "note",
            F.when(F.col("o"), "only-ambiguous").when(F.col("k"), "all-candidates-filtered").otherwise("no-identifiers").alias("reason"),
        )
    )
