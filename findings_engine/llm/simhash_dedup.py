"""SimHash near-duplicates through a Gray-order hierarchical index.

1. Fingerprints. Words of the lower-cased (A-Z) text, shingles of SHINGLE words
   with repeats, XXH64 of each; a bit is set if it is set in over half of them.
   Equal fingerprints fold into one node before anything else moves.
2. Blocks. Distinct fingerprints are cut by Gray rank, at the quantiles of a
   sample, into blocks of about BLOCK; beyond MAX_BLOCKS (a thousand million
   fingerprints) blocks deepen instead, to about 100,000 for a corpus of 100 TB.
   A block's root is the mask of bits that all its members share, and their
   pattern: at most MAX_BLOCKS rows of three numbers and PER_BLOCK sampled ranks
   a block, the only things the driver and the tasks hold of all blocks.
3. Routing. The roots, themselves in Gray order, form the upper levels of the
   index. A fingerprint goes to its own block and to later blocks whose root it
   differs from in at most RADIUS shared bits: the rest are pruned as wholes.
4. Search. A block's task sorts its members by Gray rank and factors shared bit
   patterns into upper nodes; each node holds the bits that its parent has not
   tested. Differences add up on the way down and a subtree is dropped as soon
   as they pass RADIUS, so exactly the links within RADIUS are found.
5. Components. A block emits a spanning forest of its links (never the pairs),
   and large-star/small-star rounds join the forests; each round is a table in
   the shared folder.

Defined results: a null text is an empty one (fingerprint 0, linked like any
other); a null doc_id keeps its row and is never a component's name unless all
its members have none; repeated rows give repeated results; other columns,
whatever their names, don't take part.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, RADIUS = 3, 2
BLOCK, MAX_BLOCKS, PER_BLOCK, FAN = 4096, 1 << 18, 16, 8
FRONTIER = 1 << 18
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; a shorter text is one shingle, no words none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1) if words else 0
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends][:n]
    stops = [e - 1 for e in ends[min(size, len(words)) - 1 :]] if words else []
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = SHINGLE, text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(b):
        return {
            "doc_id": b.column("doc_id"),
            "fp": [signed(majority(shingle_hashes(t, size))) for t in b.column("text").to_pylist()],
        }

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.digest_text(text).alias("text"))
    return common.map_batches(plain, "doc_id bigint, fp bigint", run)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code word in Gray order."""
    out = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


class GrayIndex:
    """Masked patterns in Gray order, and over them nodes that hold what FAN neighbours share."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None):
        order = np.argsort(gray_rank(patterns), kind="stable")
        masks = np.full(len(patterns), FULL) if masks is None else masks
        self.order = order
        levels = [(patterns[order], masks[order])]
        while len(levels[-1][0]) > FAN:
            p, m = levels[-1]
            at = np.arange(0, len(p), FAN)
            first = np.repeat(p[at], np.diff(np.append(at, len(p))))
            shared = np.bitwise_and.reduceat(m, at) & ~np.bitwise_or.reduceat((p ^ first) & m, at)
            levels.append((p[at] & shared, shared))
        self.levels = []
        for k, (p, m) in enumerate(levels):
            if k + 1 < len(levels):  # a node tests only what its parent has not
                m = m & ~np.repeat(levels[k + 1][1], FAN)[: len(m)]
            self.levels.append((p, m))

    def search(self, queries: np.ndarray, radius: int):
        """Arrays (query, leaf) of all matches, leaf as placed in what the index was built of."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        stack = []
        for at in range(0, len(queries), max(1, FRONTIER // max(1, n))):
            q = np.arange(at, min(len(queries), at + max(1, FRONTIER // max(1, n))))
            stack.append((top, np.repeat(q, n), np.tile(np.arange(n), len(q)), np.zeros(len(q) * n, np.uint8)))
        while stack:
            level, q, node, gone = stack.pop()
            p, m = self.levels[level]
            gone = gone + np.bitwise_count((queries[q] ^ p[node]) & m[node])
            keep = gone <= radius
            q, node, gone = q[keep], node[keep], gone[keep]
            if not len(q):
                continue
            if level == 0:
                yield q, self.order[node]
                continue
            below = len(self.levels[level - 1][0])
            for at in range(0, len(q), FRONTIER // FAN):
                part = slice(at, at + FRONTIER // FAN)
                child = (node[part, None] * FAN + np.arange(FAN)).ravel()
                ok = child < below
                stack.append((level - 1, np.repeat(q[part], FAN)[ok], child[ok], np.repeat(gone[part], FAN)[ok]))


def union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge in place; a label is the smallest place of its set."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def forest(members: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over the links of members among themselves and with others."""
    nodes = np.unique(np.concatenate([members, others]))
    labels = np.arange(len(nodes))
    place = np.searchsorted(nodes, members)
    for q, leaf in GrayIndex(members).search(nodes, radius):
        union(labels, q, place[leaf])
    child = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[child], nodes[labels[child]]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: a forest whose components are those of all links within ``radius`` of distinct ``fp``."""
    spark = distinct.sparkSession
    common.small_batches(spark)
    n = distinct.count()
    blocks = int(min(MAX_BLOCKS, max(16, -(-n // BLOCK))))
    # Ranks as signed longs in the same order; the cuts need not be exact, only the same for all rows.
    rank = F.col("fp")
    for k in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, k))
        distinct = distinct.withColumn("rank", rank)
        rank = F.col("rank")
    distinct = distinct.withColumn("rank", rank.bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    # Ranks of a sample by hash, PER_BLOCK for each block: enough for cuts of about equal depth.
    share = min(1 << 32, -(-PER_BLOCK * blocks * (1 << 32) // max(1, n)))
    sample = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 32)) < share).select("rank").toArrow()
    ranks = np.sort(sample.column("rank").to_numpy())
    cuts = np.unique(ranks[np.arange(1, blocks) * len(ranks) // blocks]) if len(ranks) else ranks

    def place(b):
        return {
            "fp": b.column("fp"),
            "block": np.searchsorted(cuts, b.column("rank").to_numpy(zero_copy_only=False), side="right"),
        }

    placed = common.materialize(
        common.map_batches(distinct.select("fp", "rank"), "fp bigint, block int", place, 1024), "blocks"
    )
    roots = placed.groupBy("block").agg(F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any")).toArrow()
    number, every, some = (roots.column(c).to_numpy() for c in ("block", "all", "any"))
    order = np.argsort(number)
    number, every = number[order], every[order].view(np.uint64)
    shared = spark.sparkContext.broadcast((number, every, ~(every ^ some[order].view(np.uint64))))
    routed_schema = common.arrow_schema("block int, fp bigint, member boolean")

    def route(batches):
        number, every, mask = shared.value
        upper = GrayIndex(every & mask, mask) if len(every) else None
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            own = b.column("block").to_numpy(zero_copy_only=False)
            for q, leaf in upper.search(fp.view(np.uint64), radius):
                to = number[leaf]
                keep = to >= own[q]
                q, to = q[keep], to[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array(fp[q]), pa.array(to == own[q])], schema=routed_schema
                )

    edge_schema = common.arrow_schema("a bigint, b bigint")

    def search(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        member = table.column("member").to_numpy(zero_copy_only=False)
        a, b = forest(fp[member], fp[~member], radius)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=edge_schema)

    routed = placed.mapInArrow(route, "block int, fp bigint, member boolean")
    return routed.groupBy("block").applyInArrow(search, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node with an edge that isn't its component's root."""
    spark = edges.sparkSession
    both = lambda e: e.union(e.select("b", "a"))
    e = common.materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    while True:
        # The links' number and the sums of their ends: the same twice only when nothing has moved.
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        near = both(e)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = common.materialize(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .where("b <> m")
            .select("b", "m")
            .union(least.select("a", "m"))
            .toDF("a", "b")
            .distinct()
        )
        old, e = e, common.materialize(small, "small-star")
        common.discard(old, large)


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root, component_id, docs (rows with this fingerprint) for each distinct ``fp`` of (doc_id, fp)."""
    distinct = common.materialize(
        fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("docs")), "fingerprints"
    )
    roots = components(links(distinct.select("fp"), radius))
    named = common.materialize(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first_id", "docs", F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = common.materialize(named.join(least, "root").select("fp", "root", "component_id", "docs"), "classes")
    common.discard(distinct, named)
    return found


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, same_fingerprint (rows); one row per input row."""
    fps = common.materialize(fingerprints(docs, size), "simhash")
    found = classes(fps, radius)
    return fps.join(found, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("docs").alias("same_fingerprint"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest doc_id.

    All columns are kept, whatever their names. Where that row is repeated, one
    of its repeats stays, the first by its text's digest.
    """
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.window import Window

    @pandas_udf("bigint")
    def fingerprint(texts):
        return texts.map(lambda t: signed(majority(shingle_hashes(t, size))))

    common.small_batches(docs.sparkSession)
    fp, rows, place = "_fp", "_rows", "_place"
    while {fp, rows, place} & set(docs.columns):
        fp, rows, place = "_" + fp, "_" + rows, "_" + place
    tagged = common.materialize(docs.withColumn(fp, fingerprint(common.digest_text())), "tagged")
    fps = tagged.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"))
    keep = (
        fps.join(classes(fps, radius), "fp")
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.first("component_id").alias(place), F.min("fp").alias(fp), F.count("*").alias(rows))
        .select(place, fp, rows)
    )
    keep = common.materialize(keep, "keep")
    k, t = keep.alias("k"), tagged.alias("t")
    found = t.join(
        k,
        (F.col(f"t.{fp}") == F.col(f"k.{fp}")) & F.col("t.doc_id").cast("long").eqNullSafe(F.col(f"k.{place}")),
    ).select("t.*", f"k.{rows}")
    repeats = Window.partitionBy(fp, "doc_id").orderBy(F.xxhash64("text"))
    repeated = found.where(F.col(rows) > 1).withColumn(place, F.row_number().over(repeats)).where(F.col(place) == 1)
    return found.where(F.col(rows) == 1).select(*docs.columns).unionByName(repeated.select(*docs.columns))
