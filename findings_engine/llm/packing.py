"""Lexical retrieval packing into windows of WINDOW tokens.

1. Every text is encoded once, an end id follows, and the ids are stored with a
   locality key (two min-hashes of the document's rarer ids).
2. Document frequencies of all vocabulary entries are counted over all
   documents; that table is bounded by the vocabulary.
3. Documents are dealt by range of (locality key, doc_id), so similar ones meet
   and a hot group is split. A task reads its range in shards of about
   SHARD_TOKENS ids and builds for each a BM25 inverted index.
4. A seed document asks the index with all of its terms; unused
   neighbours, best first, fill its window, and the last is cut to fit. What is
   left of it seeds the next window. The last window of a task is split at powers
   of two, which need no padding, so nothing is padded at all.

Defined results: a null or empty text is a document of one id (the end id);
repeated rows and null ids are packed like any others; ties in the scores go to
the lower place in the range; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import encoder, ragged, vocabulary_path

WINDOW, SHARD_TOKENS, DENSE, K1, B = 4096, 2 << 20, 8, 1.2, 0.75
COMMON_IDS = 2000
TASK_SHARDS = 32  # at most so many in one task, however large the table
ENCODED = "doc_id bigint, locality bigint, n_tokens bigint, ids binary"
PIECE = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
    " sequence_id bigint, offset bigint, sequence_tokens bigint"
)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_MIXED: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def locality(ids: np.ndarray, size: int) -> int:
    """Two 31-bit min-hashes of the ids beyond the vocabulary's commonest, or of all ids if there are none."""
    if size not in _MIXED:
        every = np.arange(size)
        _MIXED[size] = tuple((mixed(every, s) >> np.uint64(33)).astype(np.int64) for s in (1, 2))
    a, b = _MIXED[size]
    rare = ids[ids >= COMMON_IDS]
    rare = rare if len(rare) else ids
    return int(a[rare].min()) << 31 | int(b[rare].min())


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    size = encoder(vocabulary).tok.get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def encode(b):
        found = [np.append(x, np.uint32(end_id)) for x in encoder(vocabulary).encode_many(b.column("text").to_pylist())]
        return {
            "doc_id": b.column("doc_id"),
            "locality": [locality(x, size) for x in found],
            "n_tokens": [len(x) for x in found],
            "ids": [x.astype(kind).tobytes() for x in found],
        }

    texts = docs.select(F.col("doc_id").cast("long"), common.digest_text().alias("text"))
    return common.map_batches(texts, ENCODED, encode, common.BATCH_ROWS)


def document_frequencies(encoded: DataFrame, size: int, kind: str) -> tuple[np.ndarray, int, int]:
    """Documents that hold each id, documents, ids: over all rows, at most ``size`` rows to the driver."""
    schema = common.arrow_schema("id int, n bigint")
    common.small_batches(encoded.sparkSession)

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in common.pieces(batches, 128):
            for x in b.column("ids").to_pylist():
                total[np.unique(np.frombuffer(x, kind))] += 1
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(total[has])], schema=schema)

    found = encoded.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(size, np.int64)
    df[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    n, ids = encoded.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    return df, n, ids


class Shard:
    """A BM25 inverted index over some documents' ids.

    Rare terms have posting lists; of terms in over 1 / DENSE of the documents, which
    have so many postings that lists would not be shorter, each is a column of weights.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n, size = len(docs), len(idf)
        lengths = np.array([len(x) for x in docs])
        keys, tf = np.unique(
            np.repeat(np.arange(n, dtype=np.int64), lengths) * size + np.concatenate(docs), return_counts=True
        )
        at, term = keys // size, keys % size
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[at] / mean))
        self.rows = np.searchsorted(at, np.arange(n + 1))
        self.term, self.n = term, n
        often = np.bincount(term, minlength=size) * DENSE > n
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((n, int(often.sum())), np.float32)
        wide = often[term]
        self.dense[at[wide], self.column[term[wide]]] = weight[wide]
        at, term, weight = at[~wide], term[~wide], weight[~wide]
        order = np.argsort(term, kind="stable")
        self.docs, self.by_term = at[order], weight[order]
        self.terms = np.searchsorted(term[order], np.arange(size + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents for all of the seed's terms."""
        terms = self.term[self.rows[seed] : self.rows[seed + 1]]
        column = self.column[terms]
        asked = np.zeros(self.dense.shape[1], np.float32)
        asked[column[column >= 0]] = 1
        rare = terms[column < 0]
        first, size = self.terms[rare], self.terms[rare + 1] - self.terms[rare]
        places = ragged(first, size)
        return self.dense @ asked + np.bincount(self.docs[places], self.by_term[places], self.n)


def best(rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest ranks in falling order, ties by place."""
    least = -np.partition(-rank, k - 1)[k - 1]
    above = np.flatnonzero(rank > least)
    found = np.concatenate([above, np.flatnonzero(rank == least)[: k - len(above)]])
    return found[np.lexsort((found, -rank[found]))]


def windows(docs: list[np.ndarray], starts: list[int], idf: np.ndarray, mean: float, window: int):
    """Lists of (document, from, to); all but the last fill ``window``. starts: ids used before."""
    index = Shard(docs, idf, mean)
    at, size = list(starts), [len(x) for x in docs]
    free = np.array([a < n for a, n in zip(at, size, strict=True)])
    seed, first = None, 0
    while True:
        if seed is None:
            while first < len(docs) and not free[first]:
                first += 1
            if first == len(docs):
                return
            seed = first
        out, room, nxt = [], window, None

        def take(d: int) -> None:
            nonlocal room, nxt
            n = min(room, size[d] - at[d])
            out.append((d, at[d], at[d] + n))
            at[d] += n
            room -= n
            if at[d] == size[d]:
                free[d] = False
            else:
                nxt = d

        take(seed)
        if room:
            rank = np.where(free, index.scores(seed), -1.0)
            k = 64
            while room and (left := int(free.sum())):
                for d in best(rank, min(k, left)).tolist():
                    if not room:
                        break
                    take(d)
                rank, k = np.where(free, rank, -1.0), k * 8
        yield out
        seed = nxt


def power_cuts(pieces: list[tuple[int, int, int]]):
    """The pieces of a last window as sequences whose lengths are powers of two."""
    total = sum(b - a for _, a, b in pieces)
    queue = list(pieces)
    for bit in reversed(range(total.bit_length())):
        room = total & (1 << bit)
        out = []
        while room:
            d, a, b = queue.pop(0)
            n = min(room, b - a)
            out.append((d, a, a + n))
            if a + n < b:
                queue.insert(0, (d, a + n, b))
            room -= n
        if out:
            yield out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row per piece: a run of a document's ids and its place in a sequence."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    size = encoder(vocabulary).tok.get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"
    encoded = common.materialize(encode_documents(docs, vocabulary, end_id), "encoded")
    df, n, total = document_frequencies(encoded, size, kind)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    mean = max(1.0, total / max(1, n))
    schema = common.arrow_schema(PIECE)

    def run(batches):
        base, k = TaskContext.get().partitionId() << 40, 0
        ids, names, starts, held = [], [], [], 0

        def rows(sequences):
            nonlocal k
            out = []
            for s in sequences:
                offset, whole = 0, sum(b - a for _, a, b in s)
                for d, a, b in s:
                    crc = zlib.crc32(ids[d][a:b].astype("<u4").tobytes())
                    out.append((names[d], a, b - a, crc, len(ids[d]), base + k, offset, whole))
                    offset += b - a
                k += 1
            return pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
            )

        def full():
            """All windows that this shard fills; what is left begins the next shard."""
            nonlocal ids, names, starts, held
            done, last = [], None
            for w in windows(ids, starts, idf, mean, window):
                if last:
                    done.append(last)
                last = w
            if sum(b - a for _, a, b in last) == window:
                done, last = [*done, last], []
            out = rows(done) if done else None
            keep = [d for d, _, _ in last]
            ids, names, starts = [ids[d] for d in keep], [names[d] for d in keep], [a for _, a, _ in last]
            held = sum(b - a for _, a, b in last)
            return out

        for b in common.pieces(batches):
            for name, raw in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                ids.append(np.frombuffer(raw, kind))
                names.append(name)
                starts.append(0)
                held += len(ids[-1])
                if held >= SHARD_TOKENS and (out := full()) is not None:
                    yield out
        if held:
            if (out := full()) is not None:
                yield out
            if held:
                rest = [(d, starts[d], len(x)) for d, x in enumerate(ids)]
                yield rows(power_cuts(rest))

    shards = -(-total // SHARD_TOKENS)
    parts = max(1, min(shards, max(common.shuffle_width(spark), -(-shards // TASK_SHARDS))))
    return (
        encoded.repartitionByRange(parts, "locality", "doc_id")
        .sortWithinPartitions("locality", "doc_id", F.xxhash64("ids"))
        .select("doc_id", "ids")
        .mapInArrow(run, PIECE)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("word_bpe_49k.json"))
