"""Media payloads in a store of content-defined chunks.

A payload (a text's UTF-8, zero bytes up to a positive multiple of UNIT) is cut
where a rolling gear hash of its last 32 bytes has its MASK bits clear, at
lengths from LEAST to MOST bytes, so an edit moves only the cuts near it. A
chunk's digest is SHA-256.

The store: one row per distinct chunk, with its bytes compressed under a shared
zstandard dictionary (trained on a bounded sample of payloads), bucketed by
digest, so that it is written and joined without another shuffle. A recipe is
an ordered list of digests and lengths; equal payloads share one. Chunks are
deduplicated in each task, then by digest over all of them. Reconstruction
joins the distinct payloads' recipes to the store, puts the chunks in order and
verifies the payload's digest; a payload of one chunk needs no gathering.

The stored form of a payload is its recipe followed by its stored chunks, in
order; media_bytes and media_sha256 are of that.

Defined results: a null text is an empty one (UNIT zero bytes); rows keep their
ids, repeats and nulls included, and equal texts share a recipe; a text is whole
however long; other columns, whatever their names, don't take part; a payload that cannot be verified raises.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNIT, LEAST, MOST, MASK, LEVEL = 64, 1024, 32 << 10, np.uint32((1 << 12) - 1), 9
SEEN_DIGESTS = 400_000
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 8192, 112 << 10
RECIPE = "doc_id bigint, n_bytes bigint, payload binary, chunks array<struct<digest:binary,size:int>>"
FOUND = (
    "payload binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint,"
    " media_sha256 string, feature string"
)
_GEAR = np.frombuffer(hashlib.shake_256(b"findings-engine gear").digest(1024), "<u4").copy()


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def cuts(data: bytes, least: int = LEAST, most: int = MOST, mask: np.uint32 = MASK) -> list[int]:
    """Ends of the chunks. The gear hash is sum(gear[byte k back] << k) over the last 32 bytes, by doubling."""
    if len(data) <= least:
        return [len(data)]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    ends, last = [], 0
    for at in (np.flatnonzero((h >> np.uint32(20)) & mask == 0) + 1).tolist():
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            ends.append(at)
            last = at
    while len(data) - last > most:
        last += most
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def squeeze(chunk: bytes, c) -> bytes:
    """A chunk's stored bytes: a mark, then a zstandard frame, or the chunk itself where that is no longer."""
    z = c.compress(chunk)
    return b"z" + z if len(z) < len(chunk) else b"r" + chunk


def restore(stored: bytes, d) -> bytes:
    return d.decompress(stored[1:]) if stored[:1] == b"z" else stored[1:]


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples and how often neighbours differ by over 32."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    jumps = int((np.abs(np.diff(x.astype(np.int16))) > 32).sum())
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-math.fsum((p * np.log2(p)).tolist()):.4f};jumps={jumps}"


def recipes(docs: DataFrame) -> DataFrame:
    def run(b):
        out = {"doc_id": b.column("doc_id"), "n_bytes": [], "payload": [], "chunks": []}
        for text in b.column("text").to_pylist():
            data = payload_of(text)
            out["n_bytes"].append(len(text.encode("utf-8", "surrogatepass")))
            out["payload"].append(hashlib.sha256(data).digest())
            out["chunks"].append([{"digest": hashlib.sha256(x).digest(), "size": len(x)} for x in chunks(data)])
        return out

    return common.map_batches(texts_of(docs), RECIPE, run)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.digest_text().alias("text"))


def train_dictionary(texts: DataFrame) -> bytes:
    """From at most SAMPLE_DOCS whole texts of at most SAMPLE_CHARS characters; empty where those are too few."""
    import zstandard

    sample = common.sample_texts(texts, SAMPLE_DOCS, SAMPLE_CHARS)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(map(payload_of, sample))).as_bytes()
    except zstandard.ZstdError:
        return b""


def store_chunks(docs: DataFrame, buckets: int, dictionary: bytes) -> str:
    """Write each distinct chunk once; the store's table name."""
    import zstandard

    spark = docs.sparkSession
    schema = common.arrow_schema("digest binary, stored binary")

    def run(batches):
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        c, seen = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False), set()
        for b in common.pieces(batches):
            new = {}
            for text in b.column("text").to_pylist():
                for x in chunks(payload_of(text)):
                    digest = hashlib.sha256(x).digest()
                    if digest not in seen:
                        if len(seen) >= SEEN_DIGESTS:
                            seen.clear()
                        seen.add(digest)
                        new[digest] = squeeze(x, c)
            yield pa.RecordBatch.from_arrays([pa.array(new.keys(), pa.binary()), pa.array(new.values(), pa.binary())], schema=schema)

    name = f"fe_chunks_{uuid.uuid4().hex}"
    made = texts_of(docs).select("text").mapInArrow(run, "digest binary, stored binary")
    (
        made.groupBy("digest")
        .agg(F.first("stored").alias("stored"))
        .repartition(buckets, "digest")
        .write.option("compression", "none")
        .option("path", common.new_path(spark, "chunk-store"))
        .bucketBy(buckets, "digest")
        .saveAsTable(name)
    )
    return name


def reconstruct(spark: SparkSession, recipe: DataFrame, store: str, dictionary: bytes) -> DataFrame:
    """FOUND for each distinct payload, from the stored bytes."""
    import zstandard

    common.small_batches(spark)
    distinct = recipe.groupBy("payload").agg(F.first("chunks").alias("chunks"))
    wanted = distinct.select("payload", F.size("chunks").alias("n"), F.posexplode("chunks").alias("at", "c"))
    joined = wanted.select("payload", "n", "at", "c.digest", "c.size").join(spark.table(store), "digest")
    part = F.struct("at", "digest", "size", "stored")
    single = joined.where("n = 1").select("payload", F.array(part).alias("parts"))
    several = joined.where("n > 1").groupBy("payload").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    schema = common.arrow_schema(FOUND)

    def run(batches):
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        d = zstandard.ZstdDecompressor(dict_data=shared)
        for b in common.pieces(batches, 32):
            rows = []
            for name, parts in zip(b.column("payload").to_pylist(), b.column("parts").to_pylist(), strict=True):
                data = b"".join([restore(p["stored"], d) for p in parts])
                if hashlib.sha256(data).digest() != name:
                    raise ValueError(f"payload {name.hex()} does not verify")
                media = b"".join([p["digest"] + p["size"].to_bytes(4, "little") for p in parts] + [p["stored"] for p in parts])
                rows.append(
                    (name, len(data), name.hex(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(data))
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            )

    return single.unionByName(several).mapInArrow(run, FOUND)


def store_and_read(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    recipe = common.materialize(recipes(docs), "recipes")
    buckets = common.tasks_for(docs)
    dictionary = train_dictionary(texts_of(docs))
    store = store_chunks(docs, buckets, dictionary)
    found = common.materialize(reconstruct(spark, recipe, store, dictionary), "media")
    spark.sql(f"DROP TABLE {store}")  # the catalog's entry; the store's files stay
    return (
        recipe.select("doc_id", "n_bytes", "payload", F.size("chunks").alias("n_chunks"))
        .join(found, "payload")
        .select(
            "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
