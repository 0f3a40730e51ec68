"""Near-duplicates by five-word shingles at similarity 0.8, exactly.

Two texts are linked if their sets of SHINGLE-word shingles (words and hashes as
in simhash_dedup) share 4/5 of their union or more; components of links are groups.

1. Equal sets fold into one node before anything else moves.
2. Candidates by op1's method: a SimHash of each set, and all within its radius by
   the Gray-order index. It finds the closest pairs only, so a prefix filter finds the
   rest; the same exact check decides on both. Linked sets share 4/5 of the larger one at least,
   so under any common order of all shingles the first n - ceil(4n/5) + k of each
   hold the first k common ones. The order is rare first, by counts in a sample of at
   most about SAMPLE texts, then by hash: the sample decides the cost, never the result.
3. Two sets are candidates if their prefixes share ``need`` shingles, more for larger
   sets, at places that leave enough for a link: large texts of a large corpus share
   one or two by chance, and groups by one would grow together. A shingle with over
   DENSE pairs a set, as in large groups of near copies, lists no pairs: sorted by
   size, its sets are chained, and every chain of neighbours within 4/5 holds all pairs.
4. Groups are cut into chunks of about CHUNK nodes (for sketches at most WIDE, and no
   more than 32 chunks up to that), and a task compares all pairs of two chunks and
   emits a spanning forest of its links, never the pairs. Within a
   group work is quadratic. First by sketches, counts of shingles in CELLS cells:
   linked sets differ in at most a ninth of their sizes' sum, and their sketches in
   no more, so only pairs that can't be linked go. Then what is still together is
   checked by the sets themselves.
5. simhash_dedup.components joins the forests.

Defined results: a null text is an empty one, and all texts without words are one
node; a shorter text is one shingle; null and repeated ids are as in simhash_dedup.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash_dedup import components, links, majority, shingle_hashes, signed, union

SHINGLE = 5
SAMPLE, FREQUENT, CHUNK, COLUMNS, CELLS = 1 << 16, 1 << 18, 512, 4096, 256
DENSE, LISTED, WIDE = 8, 1024, 4096
NODE = "doc_id bigint, tie bigint, node bigint, n int, fp bigint, sketch binary, prefix array<bigint>"


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def need(n):
    """Shingles that the prefixes of a set of n and a larger one share at least if the two are linked."""
    return np.minimum(1 + n // 64, 16)


def prefix(hashes: np.ndarray, common_hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest n - ceil(4n/5) + need of a sorted set; common_hashes (sorted) have counts, all others 0."""
    n = len(hashes)
    if not n:
        return hashes
    seen = np.zeros(n, np.int64)
    if len(common_hashes):
        at = np.minimum(np.searchsorted(common_hashes, hashes), len(common_hashes) - 1)
        seen = np.where(common_hashes[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, seen))[: n - -(-4 * n // 5) + need(n)]]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Hashes a cell, 255 at most; two sketches never differ in more than the sets do."""
    cell = (hashes >> np.uint64(32)).astype(np.int64) % CELLS
    return np.minimum(np.bincount(cell, minlength=CELLS), 255).astype(np.uint8)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (child, root) of a spanning forest of links among n places."""
    labels = np.arange(n)
    union(labels, a, b)
    child = np.flatnonzero(labels != np.arange(n))
    return child, labels[child]


def alike(sketches: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of all pairs that their sketches (a row each) and sizes let be linked."""
    a, b = [], []
    wide = sketches.astype(np.int16)
    for i in range(len(size) - 1):
        other = i + 1 + np.flatnonzero(5 * np.minimum(size[i], size[i + 1 :]) >= 4 * np.maximum(size[i], size[i + 1 :]))
        other = other[9 * np.abs(wide[other] - wide[i]).sum(axis=1, dtype=np.int64) <= size[other] + size[i]]
        a.append(np.full(len(other), i))
        b.append(other)
    return forest(np.concatenate(a or [np.empty(0, int)]), np.concatenate(b or [np.empty(0, int)]), len(size))


def linked(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (child, root) of a spanning forest over all pairs that share 4/5 of their union; no set is empty."""
    size = np.array([len(s) for s in sets])
    every, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    often = np.bincount(column) > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers, exact below 2**24
    for first in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[a:b], column[a:b] - first] = 1
        shared += has @ has.T
    a, b = np.nonzero(9 * shared.astype(np.int64) >= 4 * (size[:, None] + size[None, :]))
    return forest(a, b, len(sets))


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the sample's most frequent shingles, at most FREQUENT."""
    every = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod("tie", F.lit(every)) == 0).select("text").distinct()
    schema = common.arrow_schema("h bigint")

    def run(batches):
        for b in common.pieces(batches):
            found = [shingle_set(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], schema=schema)

    counted = common.materialize(
        sample.mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shingle-counts"
    )
    # The least count that FREQUENT shingles reach at most; there are no more counts than texts in the sample.
    least = 2
    total = 0
    for n, rows in sorted(((r.n, r.rows) for r in counted.groupBy("n").agg(F.count("*").alias("rows")).collect()), reverse=True):
        total += rows
        if total > FREQUENT:
            least = n + 1
            break
    found = counted.where(F.col("n") >= least).toArrow()
    common.discard(counted)
    h = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], found.column("n").to_numpy()[order]


def nodes(texts: DataFrame) -> DataFrame:
    """NODE for each row of (doc_id, tie, text)."""
    import xxhash

    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(frequent(texts))  # two numbers for each of FREQUENT shingles at most

    def run(b):
        found = [shingle_set(t) for t in b.column("text").to_pylist()]
        return {
            "doc_id": b.column("doc_id"),
            "tie": b.column("tie"),
            "node": [signed(xxhash.xxh64_intdigest(s.tobytes(), 42)) for s in found],
            "n": [len(s) for s in found],
            "fp": [signed(majority(s)) for s in found],
            "sketch": [sketch(s).tobytes() for s in found],
            "prefix": [prefix(s, *shared.value).view(np.int64) for s in found],
        }

    return common.materialize(common.map_batches(texts, NODE, run), "shingled")


def fingerprinted(rows: DataFrame) -> DataFrame:
    """a, b: links whose components hold all pairs of nodes with fingerprints within simhash_dedup's radius."""
    each = rows.select("fp", "node").distinct()
    first = common.materialize(each.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    equal = each.join(first.withColumnRenamed("node", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    near = links(first.select("fp")).toDF("x", "y")
    near = near.join(first.toDF("x", "a"), "x").join(first.toDF("y", "b"), "y").select("a", "b")
    return equal.union(near)


def listed(h: np.ndarray, n: np.ndarray, at: np.ndarray, node: np.ndarray):
    """Arrays (a, b, need) of whole lists of sets by shingle, sorted by (h, n); at: the shingle's place in the prefix.

    Pairs that a link can need this shingle for, or chains with need 0 of lists with too many pairs.
    """
    n, at = n.astype(np.int64), at.astype(np.int64)
    new = np.append(True, h[1:] != h[:-1])
    number = np.cumsum(new) - 1
    length = np.diff(np.append(np.flatnonzero(new), len(h)))
    dense = length > LISTED
    x = np.flatnonzero((length > 1)[number] & ~dense[number])
    found = []
    for d in range(1, LISTED):
        x = x[x + d < len(h)]
        x = x[(h[x] == h[x + d]) & (5 * n[x] >= 4 * n[x + d])]  # sizes rise, so what fails here fails further on
        if not len(x):
            break
        left = np.minimum(n[x] - at[x], n[x + d] - at[x + d])
        ok = x[9 * (left + need(n[x]) - 1) >= 4 * (n[x] + n[x + d])]
        found.append((ok, ok + d))
    a, b = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in (0, 1))
    dense |= np.bincount(number[a], minlength=len(length)) > DENSE * length
    keep = ~dense[number[a]]
    a, b = a[keep], b[keep]
    x = np.flatnonzero(dense[number])
    x = x[x + 1 < len(h)]
    x = x[(h[x] == h[x + 1]) & (5 * n[x] >= 4 * n[x + 1])]
    return (
        np.concatenate([node[a], node[x]]),
        np.concatenate([node[b], node[x + 1]]),
        np.concatenate([need(n[a]), np.zeros(len(x), np.int64)]).astype(np.int32),
    )


def candidates(rows: DataFrame) -> DataFrame:
    """a, b: links whose components hold all pairs of nodes that can be linked by their prefixes."""
    schema = common.arrow_schema("a bigint, b bigint, need int")
    each = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    each = each.select("node", "n", F.posexplode("prefix").alias("at", "h"))

    def run(batches):
        columns = ("h", "n", "at", "node")
        held = None
        long = None  # the shingle of a list that is dense by its length already; its last set is held

        def out(a, b, least):
            if len(a):
                columns = [pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(least)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        def chained(x):
            h, n, _, node = (c.astype(np.int64) for c in x)
            near = 5 * n[:-1] >= 4 * n[1:]
            return out(node[:-1][near], node[1:][near], np.zeros(int(near.sum()), np.int32))

        for b in batches:
            now = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            if long is not None:
                end = int(np.searchsorted(now[0], long, side="right"))
                yield from chained([x[:end] for x in now])
                if end == len(now[0]):
                    held = [x[-1:] for x in now]
                    continue
                now, long = [x[end:] for x in now], None
            end = int(np.searchsorted(now[0], now[0][-1]))  # the last list may go on
            if end:
                yield from out(*listed(*[x[:end] for x in now]))
            held = [x[end:] for x in now]
            if len(held[0]) > LISTED:
                yield from chained(held)
                long, held = held[0][-1], [x[-1:] for x in held]
        if held is not None and long is None:
            yield from out(*listed(*held))

    dealt = each.repartition(common.tasks_for(rows), "h").sortWithinPartitions("h", "n", "node")
    found = dealt.select("h", "n", "at", "node").mapInArrow(run, "a bigint, b bigint, need int")
    shared = found.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need"))
    return shared.where("shared >= need").select("a", "b")


def grouped(roots: DataFrame, most: int) -> DataFrame:
    """node, blob, chunks for each node of a component with an edge; chunks of CHUNK nodes, from 32 chunks on up to ``most``."""
    every = roots.toDF("node", "blob")
    every = common.materialize(every.union(every.select("blob", "blob").distinct()), "groups")
    chunk = F.least(F.greatest(F.lit(CHUNK), F.count("*") / F.lit(32)), F.greatest(F.lit(CHUNK), F.lit(most)))
    return every.join(every.groupBy("blob").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "blob")


def compared(rows: DataFrame, find) -> DataFrame:
    """a, b: what ``find`` links within any two chunks of (node, blob, chunks, ...); repeated nodes count once."""
    schema = common.arrow_schema("a bigint, b bigint")
    mine = F.pmod("node", F.col("chunks")).cast("int").alias("mine")
    dealt = rows.select("*", mine, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select(*rows.columns, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        node, at = np.unique(table.column("node").to_numpy(), return_index=True)
        a, b = find(table.take(pa.array(at)))
        return pa.table([pa.array(node[a]), pa.array(node[b])], schema=schema)

    return dealt.groupBy("blob", "i", "j").applyInArrow(run, "a bigint, b bigint")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest doc_id.

    All columns are kept, whatever their names. Where that row's id is repeated,
    the first by its text's digest stays; of equal rows one.
    """
    from pyspark.sql.window import Window

    common.small_batches(docs.sparkSession)
    key = lambda c: F.col(f"`{c}`")
    name, tie, rows, place = "_id", "_tie", "_rows", "_place"
    while {name, tie, rows, place} & set(docs.columns):
        name, tie, rows, place = (f"_{x}" for x in (name, tie, rows, place))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.digest_text().alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    shingled = nodes(texts)
    # Of each node the row that would stay; a missing id comes last.
    same = shingled.groupBy("node", "doc_id", "tie").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "rows")).alias("best")
    best = common.materialize(same.groupBy("node").agg(first), "best")

    drawn = shingled.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))

    def by_sketch(table: pa.Table):
        found = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, CELLS)
        return alike(found, table.column("n").to_numpy().astype(np.int64))

    def by_set(table: pa.Table):
        return linked([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()])

    def sets(b):
        return {
            **{c: b.column(c) for c in ("node", "blob", "chunks")},
            "hashes": [shingle_set(t).tobytes() for t in b.column("text").to_pylist()],
        }

    wide = components(fingerprinted(shingled).union(candidates(shingled)))
    close = components(compared(grouped(wide, WIDE).join(drawn, "node"), by_sketch))
    asked = grouped(close, CHUNK).join(best, "node").select(
        "node", "blob", "chunks", F.col("best.doc_id").alias("asked_id"), F.col("best.tie").alias("asked_tie")
    )
    found = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("tie") == F.col("asked_tie")))
    held = common.map_batches(
        found.select("node", "blob", "chunks", "text"), "node bigint, blob bigint, chunks int, hashes binary", sets
    )
    edges = compared(held, by_set)
    roots = components(edges)
    rooted = best.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "best")
    keep = rooted.groupBy("root").agg(F.min("best").alias("best")).select(
        F.col("best.doc_id").alias(name), F.col("best.tie").alias(tie), F.col("best.rows").alias(rows)
    )
    k, t = common.materialize(keep, "keep").alias("k"), docs.alias("t")
    kept = t.join(
        k, F.col("t.doc_id").cast("long").eqNullSafe(key(name)) & (F.xxhash64(common.digest_text("t.text")) == key(tie))
    )
    single = kept.where(key(rows) == 1).select("t.*")
    order = Window.partitionBy(name, tie).orderBy(tie)
    repeated = kept.where(key(rows) > 1).withColumn(place, F.row_number().over(order)).where(key(place) == 1)
    return single.unionByName(repeated.select(*[key(c) for c in docs.columns]))
