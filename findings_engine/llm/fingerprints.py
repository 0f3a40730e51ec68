"""Document fingerprints: weighted SimHash and permuted block tables.

A fingerprint: each distinct term (white-space word of the lower-cased text)
votes with its hash's 64 bits, +weight for a set bit and -weight for a clear
one; the weight grows with the logarithm of the term's count and is an integer,
so equal texts always have equal fingerprints. A bit of the result is set where
the votes are positive; a text without terms has fingerprint 0.

Search within RADIUS bits: the 64 bits are cut into BLOCKS runs. Two
fingerprints that differ in at most RADIUS bits agree in whole in at least
BLOCKS - RADIUS runs, so for each choice of that many runs a table is keyed by
them. A pair is kept only in the first table where it agrees, so nothing needs
to be made distinct afterwards. Equal fingerprints fold into one row first.

Successors: rows are dealt by range of doc_id and sorted; a task needs only one
row ahead. The first and last row of each task are joined in a table with two
rows a partition.

Defined results: a null text is empty; null ids come first; repeated ids are
ordered by their text's digest; a table of one row is its own successor.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .simhash_dedup import signed

RADIUS, BLOCKS, SEED = 3, 5, 0
PAIR = "doc_id bigint, n_chars bigint, edited_sha256 string, fp bigint, edited_fp bigint, next_fp bigint"
ROW = PAIR + ", kind int, part int, text string"
WHOLE, HEAD, TAIL = 0, 1, 2


def weight(count: int) -> int:
    return int(np.rint(16 * (1 + np.log2(count))))


_WEIGHTS = np.array([0, *(weight(i) for i in range(1, 4096))])


def simhash(text: str) -> int:
    """The fingerprint as an unsigned integer."""
    import xxhash

    terms = Counter(text.lower().split())
    if not terms:
        return 0
    hashes = np.array([xxhash.xxh64_intdigest(t, SEED) for t in terms], "<u8")
    counts = np.fromiter(terms.values(), np.int64, len(terms))
    weights = np.where(counts < 4096, _WEIGHTS[np.minimum(counts, 4095)], 0)
    for i in np.flatnonzero(counts >= 4096):
        weights[i] = weight(int(counts[i]))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += (weights[at : at + (1 << 14)].astype(np.float64) @ bits).astype(np.int64)
    return int(np.packbits(2 * votes > int(weights.sum()), bitorder="little").view("<u8")[0])


def edit(text: str, following: str) -> str:
    """The last quarter's code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """PAIR columns for each document: its fingerprint, its edited text's and its successor's."""
    spark = docs.sparkSession
    common.small_batches(spark)
    schema, out = common.arrow_schema(ROW), common.arrow_schema(PAIR)

    def paired(doc_id, text, fp, following, next_fp):
        edited = edit(text, following)
        digest = hashlib.sha256(edited.encode("utf-8")).hexdigest()
        return doc_id, len(text), digest, signed(fp), signed(fp if edited == text else simhash(edited)), signed(next_fp)

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        for b in common.pieces(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                fp = last[2] if last and last[1] == text else simhash(text)
                if last is None:
                    rows.append((doc_id, len(text), None, signed(fp), None, None, HEAD, part, text))
                else:
                    rows.append((*paired(*last, text, fp), WHOLE, part, None))
                last = doc_id, text, fp
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            )
        if last:
            row = (last[0], len(last[1]), None, signed(last[2]), None, None, TAIL, part, last[1])
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.digest_text().alias("text"))
    rows = common.materialize(
        texts.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(common.tasks_for(docs), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(run, ROW),
        "successors",
    )
    # One head and one tail a partition; the numbers of non-empty partitions are as many.
    parts = sorted(r.part for r in rows.where(F.col("kind") == HEAD).select("part").collect())
    after = dict(zip(parts, parts[1:] + parts[:1], strict=True))
    pairs = spark.createDataFrame(list(after.items()), "part int, next_part int")
    tails = rows.where(F.col("kind") == TAIL).select("doc_id", "text", "fp", "part").join(F.broadcast(pairs), "part")
    heads = rows.where(F.col("kind") == HEAD).select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fp").alias("next_fp")
    )

    def finish(batches):
        for b in common.pieces(batches, 8):
            rows = [
                paired(r["doc_id"], r["text"], r["fp"] % (1 << 64), r["next_text"], r["next_fp"] % (1 << 64))
                for r in b.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out
            )

    ends = tails.join(heads, "next_part").select("doc_id", "text", "fp", "next_text", "next_fp").mapInArrow(finish, PAIR)
    return rows.where(F.col("kind") == WHOLE).select(*out.names).unionByName(ends)


def tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks of the tables' keys, as signed longs."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    return [signed(sum(c)) for c in itertools.combinations(runs, blocks - radius)]


def within(queries: DataFrame, all_fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """query_fp, fp, docs, distance: every pair of a distinct query fingerprint and a distinct one within ``radius``."""
    masks = tables(radius, blocks)

    def keyed(df, name):
        t = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)]))
        return df.select("*", t.alias("at")).select("*", "at.t", "at.k").drop("at")

    q = keyed(queries.select(F.col("fp").alias("query_fp")).distinct(), "query_fp")
    a = keyed(all_fps.groupBy("fp").agg(F.count("*").alias("docs")), "fp")
    differ = F.col("query_fp").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    # Merged, not broadcast: Spark would judge the queries' size before they become a row for each table.
    return (
        q.hint("merge").join(a, ["t", "k"])
        .where((F.bit_count(differ) <= radius) & (first == F.col("t")))
        .select("query_fp", "fp", "docs", F.bit_count(differ).alias("distance"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_docs: for ids divisible by 20, the documents within RADIUS bits, itself included; else null."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pairs = common.materialize(with_next(docs), "pairs")
    asked = pairs.where(F.col("doc_id") % 20 == 0)
    near = within(asked, pairs.select("fp")).groupBy(F.col("query_fp").alias("fp")).agg(F.sum("docs").alias("near_docs"))
    near = common.materialize(near, "near")
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    like = lambda c: 1 - F.bit_count(F.col("fp").bitwiseXOR(F.col(c))) / F.lit(64.0)
    columns = (
        "doc_id",
        "n_chars",
        "edited_sha256",
        digits("fp").alias("fingerprint"),
        digits("edited_fp").alias("edited_fingerprint"),
        like("edited_fp").alias("near_edited"),
        like("next_fp").alias("near_next"),
    )
    rest = pairs.where(~F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False)))
    return (
        asked.join(near, "fp")
        .select(*columns, "near_docs")
        .unionByName(rest.select(*columns, F.lit(None).cast("long").alias("near_docs")))
    )
