"""Token ids in binary containers under one shared zstandard dictionary.

Documents are dealt by range of doc_id and sorted, so shard k holds smaller ids
than shard k+1. A shard is a sequence of containers of about CONTAINER_BYTES:

    magic, dictionary digest (32 bytes), width of an id (2 or 4), documents n,
    ids before the container in its shard,
    index: n x (doc_id, null flag, offset, length, ids),
    one zstandard frame per document

Each document is its own frame, so a short one is read with the index and one
seek; the frames share a dictionary trained on the serialized ids of a bounded
sample (SAMPLE_DOCS documents of at most SAMPLE_CHARS characters, by hash), stored beside
the containers and named in each of them by its digest. Containers are rows of
a Parquet table: Spark's commit protocol keeps the files of a retried task from
doubling, on any store Spark can write.

Defined results: a null text is the empty text, which still has the end id;
null ids come first; repeated rows are kept, ordered by id, then text digest; a
text is one document however long; an empty table gives no containers; other
columns, whatever their names, don't take part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import encoder, vocabulary_path

MAGIC = b"FETOK1\0\0"
HEAD = struct.Struct("<8s32sBxxxIQ")
CONTAINER_BYTES = 4 << 20
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 8192, 64 << 10
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("at", "<u8"), ("size", "<u4"), ("ids", "<u8")])
CONTAINER = "shard int, container int, first_id bigint, ids bigint, data binary"
DICTIONARY = "digest binary, data binary"
DOCUMENT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, stored_bytes bigint"


def width(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def train_dictionary(texts: DataFrame, path: str, kind: str, end_id: int) -> bytes:
    """A shared dictionary; plain content where the sample is too small to train on."""
    import zstandard

    ids = encoder(path).encode_many(common.sample_texts(texts, SAMPLE_DOCS, SAMPLE_CHARS))
    blobs = [np.append(x, end_id).astype(kind).tobytes() for x in ids]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blobs).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blobs)[:DICTIONARY_BYTES]


def pack_container(digest: bytes, kind: str, before: int, rows: list[tuple]) -> bytes:
    """rows: (doc_id or None, frame, number of ids)."""
    index = np.zeros(len(rows), INDEX)
    at = HEAD.size + index.nbytes
    for i, (doc_id, frame, ids) in enumerate(rows):
        index[i] = (doc_id or 0, doc_id is None, at, len(frame), ids)
        at += len(frame)
    head = HEAD.pack(MAGIC, digest, int(kind[-1]), len(rows), before)
    return b"".join([head, index.tobytes(), *(frame for _, frame, _ in rows)])


def read_container(data: bytes, dictionary: bytes):
    """(doc_id, start in the shard, ids as little-endian unsigned 32-bit, stored bytes), in order."""
    import zstandard

    magic, digest, size, n, start = HEAD.unpack_from(data)
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("a container of another format or dictionary")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    for doc_id, null, at, length, ids in np.frombuffer(data, INDEX, n, HEAD.size).tolist():
        raw = np.frombuffer(d.decompress(data[at : at + length], max_output_size=ids * size), f"<u{size}")
        yield None if null else doc_id, start, raw.astype("<u4"), length
        start += ids


def write_token_files(docs: DataFrame, out: str, vocabulary: str, end_id: int = 2, shards: int | None = None) -> None:
    """Write ``out``/containers and ``out``/dictionary."""
    import zstandard

    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), common.digest_text().alias("text"))
    kind = width(encoder(vocabulary).tok.get_vocab_size())
    dictionary = train_dictionary(texts, vocabulary, kind, end_id)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest, dictionary)], DICTIONARY).coalesce(1).write.parquet(f"{out}/dictionary")
    schema = common.arrow_schema(CONTAINER)

    def run(batches):
        c = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        )
        shard, k, before, total, rows, held = TaskContext.get().partitionId(), 0, 0, 0, [], 0

        def flush():
            data = pack_container(digest, kind, before, rows)
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "container": k, "first_id": before, "ids": total - before, "data": data}], schema
            )

        for b in common.pieces(batches, common.BATCH_ROWS):
            found = encoder(vocabulary).encode_many(b.column("text").to_pylist())
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), found, strict=True):
                ids = np.append(ids, np.uint32(end_id))
                frame = c.compress(ids.astype(kind).tobytes())
                rows.append((doc_id, frame, len(ids)))
                total += len(ids)
                held += len(frame)
                if held >= CONTAINER_BYTES:
                    yield flush()
                    k, before, rows, held = k + 1, total, [], 0
        if rows:
            yield flush()

    (
        texts.withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(shards or common.tasks_for(docs), "doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "text")
        .mapInArrow(run, CONTAINER)
        .write.option("compression", "none")
        .parquet(f"{out}/containers")
    )


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """One row per stored document: its place in the whole token stream and a checksum of its ids."""
    containers = spark.read.schema(CONTAINER).parquet(f"{out}/containers")
    [dictionary] = spark.read.schema(DICTIONARY).parquet(f"{out}/dictionary").collect()
    dictionary = bytes(dictionary.data)
    # A row per shard: bounded by the number of partitions that wrote them.
    totals = {r.shard: r.ids for r in containers.groupBy("shard").agg(F.sum("ids").alias("ids")).collect()}
    base, at = {}, 0
    for shard in sorted(totals):
        base[shard] = at
        at += totals[shard]
    schema = common.arrow_schema(DOCUMENT)

    def run(batches):
        for b in common.pieces(batches, 1):
            shard, data = b.column("shard")[0].as_py(), b.column("data")[0].as_py()
            rows = [
                (doc_id, base[shard] + start, len(ids), zlib.crc32(ids.tobytes()), size)
                for doc_id, start, ids, size in read_container(data, dictionary)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            )

    common.small_batches(spark)
    return containers.select("shard", "data").mapInArrow(run, DOCUMENT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.new_path(spark, "token-files")
    write_token_files(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), out, vocabulary_path("byte_bpe_50k.json")
    )
    return read_token_files(spark, out)
