"""Sampled SentencePiece segmentations without replacement, by Gumbel top-k.

The lattice of a text is the chain of its chunks' lattices (a chunk: a run of
space marks and what follows it; no piece has a mark behind another character,
so none crosses a cut). A Python worker builds a chunk's lattice once and keeps
it, within LATTICE_NODES nodes: all pieces of the vocabulary at all places, byte pieces where no piece
fits, and the backward sums that make every arc's conditional probability.

Perturbed A-star: a node is a set of segmentations (a prefix and the arcs still
open behind it), its priority the largest Gumbel-perturbed log probability in
it. That priority is known without looking inside: the root's is one Gumbel
draw, and given a node's priority its best arc keeps it while the other arcs
together get a Gumbel draw truncated at it. So the search goes straight down
to the best segmentation, leaving one open node at each step of the path;
popping the best open node gives the next segmentation, never one seen before.
The best priority left after the last, kappa, gives each sample's inclusion
score 1 - exp(-exp(log p - kappa)), its probability of being among the sample.

Draws are hashes of the row key, the sample's number and the place, so a row's
samples depend on nothing else. The vocabulary is the public BPE model's; a
piece's probability falls with its merge rank r as 1 / (r + RANK_SHIFT), since a
BPE model has no unigram scores of its own, and a byte piece has BYTE_LOG.

Defined results: a null text is empty and has one segmentation, of no pieces;
texts with fewer than k segmentations give all they have, with inclusion 1;
rows with equal ids get equal draws; a null id is a key of its own; other columns
are ignored, whatever their names. decodes says whether a sample gives the text
back; it is false for a text that holds the space mark U+2581 itself, which the
model reads as a space.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import KEY, KeyTable, distinct_keys, keys_of, vocabulary_path

SAMPLES, SEED, RANK_SHIFT, BYTE_LOG = 2, 20, 30.0, -14.0
MARK = "▁"
SLICE_CHARS, LATTICE_NODES = 1_200_000, 3 << 20
ROW = (
    "doc_id bigint, sample int, n_pieces bigint, ids_crc32 bigint, log_prob double, perturbed double,"
    " inclusion double, decodes boolean"
)
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_U = np.uint64
TABLE_BITS, SPARE_BITS = 20, 17


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniform(key: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((mix(key) >> _U(12)).astype(np.float64) + 0.5) / (1 << 52)


def normal_form(text: str) -> str:
    """As the model's normalizer has it: a mark before the text and for each space."""
    return MARK + text.replace(" ", MARK) if text else ""


def joined_chunks(text: str) -> bytes:
    """chunks_of with a space between two; no bytes for no chunks."""
    if "  " in text or MARK in text or text[:1] == " ":
        text = " ".join(chunks_of(text))
    return text.encode("utf-8", "surrogatepass")


def chunks_of(text: str) -> list[str]:
    """The normal form's chunks without their first mark; where no spaces meet, the words."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " ":
        return [c[1:] for c in _CHUNK.findall(normal_form(text))]
    return text.split(" ")


class Vocabulary:
    """Pieces by hash of their code points, their log probabilities and bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        pieces, ids = [], []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces.append(piece)
                ids.append(i)
                self.bytes[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses the cuts between chunks")
        rank = -np.array([sp.get_score(i) for i in ids])
        self.log = np.full(n, BYTE_LOG)
        share = 1 / (rank - rank.min() + RANK_SHIFT)
        self.log[ids] = np.log(share / share.sum())
        self.longest = max(map(len, pieces))
        keys = np.array([self.hash(p) for p in pieces], np.uint64)
        ids = np.array(ids)
        self.key, self.id = np.zeros(1 << TABLE_BITS, np.uint64), np.full(1 << TABLE_BITS, -1, np.int32)
        at = (keys >> _U(64 - TABLE_BITS)).astype(np.int64)
        _, first = np.unique(at, return_index=True)
        self.key[at[first]], self.id[at[first]] = keys[first], ids[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        self.key2, self.id2 = np.sort(keys[rest]), ids[rest][np.argsort(keys[rest])]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * 0x9E3779B97F4A7C15 + ord(ch) + 1) % (1 << 64)
        return int(mix(np.array([h], np.uint64))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of mixed hashes, -1 where there is none."""
        at = (h >> _U(64 - TABLE_BITS)).astype(np.int64)
        out = np.where(self.key[at] == h, self.id[at], -1)
        if len(self.key2):
            clash = np.flatnonzero((out < 0) & (self.id[at] >= 0))
            if len(clash):
                at2 = np.minimum(np.searchsorted(self.key2, h[clash]), len(self.key2) - 1)
                out[clash] = np.where(self.key2[at2] == h[clash], self.id2[at2], -1)
        return out


class Lattices:
    """Arcs of all chunks seen; nodes are numbered through, and a node's arcs stand together, the longest first."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.start, self.end = np.empty(0, np.int64), np.empty(0, np.int64)  # nodes of a chunk
        self.table = KeyTable(LATTICE_NODES)
        self.nodes = self.arcs = 0
        # Pages that nothing has been written to take no memory.
        self.first = np.zeros(LATTICE_NODES + (1 << 20), np.int32)
        self.frm, self.to, self.id = (np.zeros(3 * LATTICE_NODES, np.int32) for _ in range(3))
        self.lp, self.cum = np.zeros(3 * LATTICE_NODES), np.zeros(3 * LATTICE_NODES)

    def numbered(self, raws: list[bytes]) -> np.ndarray:
        """The chunks of all these texts (chunks_of, joined by spaces) by number; new ones get their lattices."""
        raws = [r for r in raws if r]
        joined = b" ".join([*raws, bytes(KEY)])
        text = np.frombuffer(joined, np.uint8)
        stops = np.flatnonzero(text == 32)
        starts = np.append(0, stops[:-1] + 1)
        sizes = stops - starts
        out = np.empty(len(starts), np.int64)
        short = np.flatnonzero(sizes < KEY)
        keys = keys_of(text, starts[short], sizes[short])
        found = self.table.find(keys)
        lost = np.flatnonzero(found < 0)
        new: list[bytes] = []
        if len(lost):
            wanted, at, back = distinct_keys(keys[lost])
            at = short[lost[at]]
            new = [joined[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
            fresh = self.table.more(len(new))
            self.table.enter(wanted, fresh)
            found[lost] = fresh[back]
        out[short] = found
        for i in np.flatnonzero(sizes >= KEY).tolist():
            c = joined[starts[i] : stops[i]]
            if c not in self.table.long:
                self.table.long[c] = int(self.table.more(1)[0])
                new.append(c)
            out[i] = self.table.long[c]
        if new:
            self.build([MARK + c.decode("utf-8", "surrogatepass") for c in new])
        return out

    def build(self, chunks: list[str]) -> None:
        v = self.v
        n = np.array([len(c) for c in chunks], np.int64)
        cp = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        chunk = np.repeat(np.arange(len(chunks)), n)
        start = np.cumsum(n + 1) - (n + 1)
        node = np.arange(len(cp)) + chunk  # each chunk has one node more than characters
        end = start + n
        left = end[chunk] - node  # characters from here to the chunk's end
        at, h = np.arange(len(cp)), np.zeros(len(cp), np.uint64)
        froms, tos, ids = [], [], []
        for k in range(1, v.longest + 1):
            ok = left[at] >= k
            at, h = at[ok], h[ok]
            if not len(at):
                break
            h = h * _U(0x9E3779B97F4A7C15) + cp[at + k - 1] + _U(1)
            found = v.find(mix(h))
            hit = found >= 0
            froms.append(node[at[hit]])
            tos.append(node[at[hit]] + k)
            ids.append(found[hit].astype(np.int64))
            if k == 1:  # no piece: one byte piece, or several as a negative code point
                miss = at[~hit]
                c = cp[miss].astype(np.int64)
                froms.append(node[miss])
                tos.append(node[miss] + 1)
                ids.append(np.where(c < 128, v.byte_id[np.minimum(c, 127)], -c))
        # A node's arcs together, without a sort: a place is the sum of what comes before. The longest first,
        # mostly the likeliest, so that a walk looks at few arcs.
        total = int(end[-1]) + 1
        width = np.zeros(total, np.int64)
        for f in froms:
            width[f] += 1
        first = np.append(0, np.cumsum(width))
        fill = first[:-1].copy()
        frm, to, id_ = (np.empty(int(first[-1]), np.int64) for _ in range(3))
        for f, t, i in zip(froms[::-1], tos[::-1], ids[::-1], strict=True):
            place = fill[f]
            frm[place], to[place], id_[place] = f, t, i
            fill[f] = place + 1
        log = np.where(id_ >= 0, v.log[np.maximum(id_, 0)], 0.0)
        many = np.flatnonzero(id_ < 0)
        log[many] = BYTE_LOG * (2 + (id_[many] <= -0x800).astype(int) + (id_[many] <= -0x10000))
        beta = np.zeros(total)
        far = np.zeros(total, np.uint16 if n.max() < 1 << 16 else np.int64)  # the short one sorts by radix
        far[node] = left
        far = far[frm]
        by = np.argsort(far, kind="stable")
        edges = np.searchsorted(far[by], np.arange(1, int(n.max()) + 2))
        for a, b in zip(edges[:-1], edges[1:], strict=True):  # from the chunks' ends, all chunks at once
            e = by[a:b]
            if not len(e):
                continue
            x = log[e] + beta[to[e]]
            heads = np.flatnonzero(np.diff(frm[e], prepend=-1))
            top = np.maximum.reduceat(x, heads)
            spread = np.exp(x - np.repeat(top, np.diff(np.append(heads, len(e)))))
            beta[frm[e[heads]]] = top + np.log(np.add.reduceat(spread, heads))
        lp = np.minimum(log + beta[to] - beta[frm], 0.0)
        width = width[width > 0]
        heads = np.cumsum(width) - width
        lp[heads[width == 1]] = 0.0
        p = np.exp(lp)
        sums = np.cumsum(p)
        cum = sums - np.repeat(sums[heads] - p[heads], width)
        cum[heads + width - 1] = 1.0
        self._append(start, end, first, frm, to, id_, lp, np.minimum(cum, 1.0))

    def _append(self, start, end, first, frm, to, id_, lp, cum) -> None:
        total = len(first) - 1
        while self.nodes + total + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while self.arcs + len(frm) > len(self.frm):
            for name in ("frm", "to", "id", "lp", "cum"):
                x = getattr(self, name)
                setattr(self, name, np.concatenate([x, np.zeros_like(x)]))
        arcs = slice(self.arcs, self.arcs + len(frm))
        self.frm[arcs], self.to[arcs], self.id[arcs], self.lp[arcs], self.cum[arcs] = frm + self.nodes, to + self.nodes, id_, lp, cum
        self.first[self.nodes : self.nodes + total + 1] = self.arcs + first
        self.start, self.end = np.append(self.start, start + self.nodes), np.append(self.end, end + self.nodes)
        self.nodes += total
        self.arcs += len(frm)

    def walk(self, chunk: np.ndarray, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sampled way from each node to its chunk's end: all arcs in order, and how many each has."""
        end = self.end[chunk]
        counts = np.zeros(len(chunk), np.int64)
        live, steps = np.flatnonzero(node < end), []
        node, end, key = node[live], end[live], key[live]
        t = 0
        while len(live):
            u = uniform(key + _U(t * 0xD1B54A32D192ED03 % (1 << 64)))
            e = self.first[node]
            over = np.flatnonzero(u >= self.cum[e])
            while len(over):
                e[over] += 1
                over = over[u[over] >= self.cum[e[over]]]
            steps.append((live, e))
            counts[live] += 1
            node = self.to[e]
            on = np.flatnonzero(node < end)
            live, node, end, key = live[on], node[on], end[on], key[on]
            t += 1
        at = np.cumsum(counts) - counts
        path = np.empty(int(counts.sum()), np.int64)
        for t, (w, e) in enumerate(steps):
            path[at[w] + t] = e
        return path, counts


def truncated(phi: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel draws with location phi, given that they are at most bound."""
    with np.errstate(over="ignore", divide="ignore"):
        return phi - np.log(np.exp(np.minimum(phi - bound, 700.0)) - np.log(u))


def sample_batch(keys: np.ndarray, texts: list[str], lat: Lattices, k: int):
    """For each text, a list of (ids, log probability, perturbed), best first, and kappa."""
    raws = [joined_chunks(t) for t in texts]
    size = np.array([r.count(b" ") + 1 if r else 0 for r in raws])
    if not size.any():
        return [([((), 0.0, 0.0)], -np.inf) for _ in texts]
    flat = lat.numbered(raws)
    first = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(flat)) - first[doc]
    salt = lambda d, j: mix(keys[d] + _U(j * 0xA0761D6478BD642F % (1 << 64)))
    root = -np.log(-np.log(uniform(salt(np.arange(len(texts)), 0))))
    results = [[] for _ in texts]
    heaps: list[list] = [[] for _ in texts]

    def leave(d: int, j: int, path: np.ndarray, lp: np.ndarray, since: int, bound: float) -> None:
        """Open nodes at the steps of a path from ``since`` on."""
        before = np.cumsum(lp) - lp
        rest = -np.expm1(lp[since:])
        open_ = np.flatnonzero(rest > 1e-12)
        if not len(open_):
            return
        phi = before[since:][open_] + np.log(rest[open_])
        u = uniform(salt(np.array([d]), 1000 + j) + (open_ + since).astype(np.uint64) * _U(0xE7037ED1A0B428DB))
        t = truncated(phi, bound, u)
        for i in np.argsort(-t, kind="stable")[: k + 1].tolist() if len(t) <= 64 else _top(t, k + 1):
            at = since + int(open_[i])
            heapq.heappush(heaps[d], (-float(t[i]), j, at, (int(path[at]),), float(before[at])))

    paths, counts = lat.walk(flat, lat.start[flat], salt(doc, 1) + place.astype(np.uint64) * _U(0x8EBC6AF09C88C6E3))
    ends = np.cumsum(np.bincount(doc, counts, len(texts)).astype(np.int64))
    word_of = np.repeat(np.arange(len(flat)), counts)
    for d in range(len(texts)):
        part = slice(int(ends[d - 1]) if d else 0, int(ends[d]))
        path, lp = paths[part], lat.lp[paths[part]]
        results[d].append((path, word_of[part], float(lp.sum()), float(root[d])))
        leave(d, 0, path, lp, 0, float(root[d]))
    for j in range(1, k):
        popped, starts, nodes, walk_keys = [], [], [], []
        for d in range(len(texts)):
            if not heaps[d]:
                continue
            t, source, at, used, before = heapq.heappop(heaps[d])
            path, word = results[d][source][:2]
            node = int(lat.frm[path[at]])
            arcs = [e for e in range(int(lat.first[node]), int(lat.first[node + 1])) if e not in used]
            chance = np.exp(lat.lp[arcs])
            share = np.cumsum(chance)
            u = float(uniform(salt(np.array([d]), 2000 + j))[0])
            pick = min(int(np.searchsorted(share, u * share[-1], side="right")), len(arcs) - 1)
            arc, left = arcs[pick], float(share[-1] - chance[pick])
            if len(arcs) > 1 and left > 1e-12:  # what is still open at this node
                u = uniform(salt(np.array([d]), 3000 + j))
                again = float(truncated(np.array([before + np.log(left)]), -t, u)[0])
                heapq.heappush(heaps[d], (-again, source, at, (*used, arc), before))
            w = int(word[at])
            last = int(first[d] + size[d])
            popped.append((d, -t, path[:at], word[:at], arc, w, last - w))
            here = np.arange(w, last)
            begin = lat.start[flat[here]].copy()
            begin[0] = lat.to[arc]
            starts.append(here)
            nodes.append(begin)
            walk_keys.append(salt(np.full(len(here), d), j + 1) + (here - first[d]).astype(np.uint64) * _U(0x8EBC6AF09C88C6E3))
        if not popped:
            break
        here = np.concatenate(starts)
        tails, counts = lat.walk(flat[here], np.concatenate(nodes), np.concatenate(walk_keys))
        tail_words = np.repeat(here, counts)
        at = word_at = 0
        sums = np.cumsum(counts)
        for d, value, head, head_words, arc, w, n in popped:
            to = int(sums[word_at + n - 1])
            path = np.concatenate([head, [arc], tails[at:to]])
            lp = lat.lp[path]
            results[d].append((path, np.concatenate([head_words, [w], tail_words[at:to]]), float(lp.sum()), value))
            leave(d, len(results[d]) - 1, path, lp, len(head) + 1, value)
            at, word_at = to, word_at + n
    out = []
    for d in range(len(texts)):
        kappa = -heaps[d][0][0] if heaps[d] else -np.inf
        out.append(([(lat.id[path], lp, g) for path, _, lp, g in results[d]], kappa))
    return out


def _top(t: np.ndarray, n: int) -> list[int]:
    best = np.argpartition(-t, n)[:n]
    return best[np.argsort(-t[best], kind="stable")].tolist()


def spelled(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Ids with characters that no piece covers as their byte pieces."""
    if not len(ids) or ids.min() >= 0:
        return np.asarray(ids, np.int64)
    return np.array(
        [x for i in ids.tolist() for x in ([i] if i >= 0 else v.byte_id[list(chr(-i).encode("utf-8", "surrogatepass"))].tolist())]
    )


def decode(ids, v: Vocabulary) -> str:
    """The text of a sequence of ids, without the mark before it."""
    text = b"".join(map(v.bytes.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


_LATTICES: dict[str, Lattices] = {}


def lattices(path: str) -> Lattices:
    """One per Python worker and model, begun anew where it has grown past LATTICE_NODES."""
    if path not in _LATTICES:
        _LATTICES[path] = Lattices(Vocabulary(path))
    elif _LATTICES[path].nodes > LATTICE_NODES:
        _LATTICES[path] = Lattices(_LATTICES[path].v)
    return _LATTICES[path]


def row_keys(doc_ids: list, seed: int) -> np.ndarray:
    null = 0x5EED
    return mix(np.array([null if i is None else i % (1 << 64) for i in doc_ids], np.uint64) * _U(2) + _U(seed * 0x9E3779B97F4A7C15 % (1 << 64)))


def sample_segmentations(docs: DataFrame, model: str, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """One row per document and distinct sampled segmentation, numbered from the largest perturbed value down."""
    if samples < 1:
        raise ValueError("at least one sample")
    common.small_batches(docs.sparkSession)
    schema = common.arrow_schema(ROW)

    def rows(doc_ids: list, texts: list[str]):
        lat = lattices(model)
        v, out = lat.v, []
        for doc_id, text, (found, kappa) in zip(doc_ids, texts, sample_batch(row_keys(doc_ids, seed), texts, lat, samples), strict=True):
            for j, (ids, lp, g) in enumerate(found):
                ids = spelled(ids, v)
                inclusion = float(-np.expm1(-np.exp(min(lp - kappa, 700.0)))) if np.isfinite(kappa) else 1.0
                same = decode(ids.tolist(), v) == text
                out.append((doc_id, j, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), lp, g, inclusion, same))
        return pa.RecordBatch.from_arrays(
            [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
        )

    def run(batches):
        for b in common.pieces(batches, common.BATCH_ROWS):
            doc_ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            a, chars = 0, 0
            for i, text in enumerate(texts):
                if i > a and chars + len(text) > SLICE_CHARS:
                    yield rows(doc_ids[a:i], texts[a:i])
                    a, chars = i, 0
                chars += len(text)
            if texts:
                yield rows(doc_ids[a:], texts[a:])

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.digest_text().alias("text"))
        .mapInArrow(run, ROW)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("piece_bpe_32k.model"))
