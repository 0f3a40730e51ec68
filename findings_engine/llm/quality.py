"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote good (1), bad (-1) or abstain (0) on
   each document. Votes are counted by pattern over all documents: at most
   3^LABELLERS rows, whatever the corpus.
2. Expectation-maximisation on the pattern counts estimates each labeller's
   accuracies and the share of good documents (Dawid and Skene, votes
   independent given the latent kind of document).
3. Posterior labels of a sample of at most SAMPLE documents of at most MAX_CHARS
   characters, taken by hash order, train a hashed linear scorer on word shapes, pairs of them and bucketed
   ratios; the posterior is the target, so doubtful documents pull less.
4. The scorer rates every document. No gold label is read anywhere.

Defined results: a null text is an empty one; on texts with fewer
than MIN_WORDS words all labellers abstain, so the prior decides; rows keep
their ids, null and repeated ones too, and equal texts get equal scores, however
long; other columns, whatever their names, don't take part; without documents
there is nothing to train and the scorer is 0.5.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, MAX_CHARS, BITS, MIN_WORDS, ROUNDS = 8_000, 16_384, 12, 6, 60
_SYMBOLS = re.compile(rb"[#$%&*~^<>{}\\]")
_RUN = re.compile(rb"a+")
_CAPS = re.compile(rb"A{2,}")
# ASCII letters, digits and the bytes of other letters to classes; punctuation stays.
_SHAPE = bytes(
    65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256)
)


def measures(text: str) -> dict[str, float]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, len(text))
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(re.findall(r"[A-Z]", text))
    return {
        "words": len(words),
        "symbols": len(_SYMBOLS.findall(raw)) / n,
        "pipes": raw.count(b"|") / n,
        "upper": upper / letters,
        "repeats": sum(map(eq, words, words[1:])) / n,
        "distinct": len(set(words)) / n,
        "bangs": raw.count(b"!!") / n,
        "length": sum(map(len, words)) / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "stops": sum(1 for w in words if len(w) <= 4) / n,
    }


#: name -> a bad vote above this, else none.
LABELLERS = {"symbols": 0.1, "pipes": 0.06, "upper": 0.22, "repeats": 0.12, "bangs": 0.05, "lines": 0.6, "length": 16.0}


def votes(m: dict[str, float]) -> list[int]:
    """One for each of LABELLERS, then variety and the share of short words; all abstain on a few words."""
    out = [-1 if m["words"] >= MIN_WORDS and m[name] > bad else 0 for name, bad in LABELLERS.items()]
    out.append(-1 if m["words"] > 40 and m["distinct"] < 0.15 else 1 if m["words"] > 40 and m["distinct"] > 0.35 else 0)
    out.append(-1 if m["words"] > 40 and m["stops"] < 0.1 else 1 if m["words"] > 40 and m["stops"] > 0.25 else 0)
    return out


N_VOTES = len(LABELLERS) + 2


def vote_patterns(docs: DataFrame) -> DataFrame:
    """pattern, n over all documents."""

    def run(b):
        c = Counter(",".join(map(str, votes(measures(t)))) for t in b.column("text").to_pylist())
        return {"pattern": list(c), "n": list(c.values())}

    plain = docs.select(common.digest_text().alias("text"))
    counted = common.map_batches(plain, "pattern string, n bigint", run)
    return counted.groupBy("pattern").agg(F.sum("n").alias("n"))


class LabelModel:
    """Accuracies by expectation-maximisation over latent kinds: good, and one bad kind a labeller.

    A labeller looks for one flaw and is silent on documents with another. With a
    single bad class the silent ones outvote the one that saw something; with a
    kind for each flaw, their silence is what that kind predicts. A Beta prior
    worth PRIOR of the documents starts bad votes on good documents at
    FALSE_ALARM; all other rates are the data's.
    """

    PRIOR, FALSE_ALARM = 0.2, 0.002

    def __init__(self, patterns: np.ndarray, n: np.ndarray):
        k = patterns.shape[1]
        fired = patterns < 0
        some = fired.any(axis=1)
        share = np.where(some[:, None], fired / np.maximum(1, fired.sum(axis=1, keepdims=True)), 1 / k)
        good = np.where(some, 0.02, 0.95)
        kinds = np.vstack([good, (1 - good) * share.T])
        for _ in range(ROUNDS):
            weight = kinds * n
            total = weight.sum(axis=1)
            self.prior = np.log((total + 1) / (n.sum() + k + 1))
            #: [kind, labeller, vote + 1]: log of how often it votes so on that kind.
            rates = np.stack([weight @ (patterns == v) + 0.5 for v in (-1, 0, 1)], axis=2)
            held = self.PRIOR * n.sum()
            rates[0, :, 0] += held * self.FALSE_ALARM
            rates[0, :, 1:] += held * (1 - self.FALSE_ALARM) * rates[0, :, 1:] / rates[0, :, 1:].sum(axis=1, keepdims=True)
            self.rates = np.log(rates / rates.sum(axis=2, keepdims=True))
            kinds = self.kinds(patterns)

    def kinds(self, patterns: np.ndarray) -> np.ndarray:
        at = np.arange(patterns.shape[1])
        # The labellers after LABELLERS abstain where a text is too short to tell; that says nothing.
        told = (patterns != 0) | (at < len(LABELLERS))
        ll = np.stack(
            [p + (told * r[at, patterns + 1]).sum(axis=1) for p, r in zip(self.prior, self.rates, strict=True)]
        )
        ll = np.exp(ll - ll.max(axis=0))
        return ll / ll.sum(axis=0)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        return self.kinds(patterns)[0]

    def accuracies(self) -> np.ndarray:
        """[labeller]: how often its bad votes are right."""
        bad = np.exp(self.prior[:, None] + self.rates[:, :, 0])
        return 1 - bad[0] / bad.sum(axis=0)


def hashed(text: str) -> dict[int, float]:
    """Shares of word shapes, pairs of them and buckets of ratios, in 2^BITS places."""
    import xxhash

    raw = text.encode("utf-8", "surrogatepass")
    shapes = _CAPS.sub(b"AA", _RUN.sub(b"a", raw.translate(_SHAPE))).split()
    n = max(1, len(shapes))
    m = measures(text)
    counts: dict[bytes, float] = {}
    for (a, b), c in Counter(zip(shapes, shapes[1:], strict=False)).items():
        key = a[:12] + b" " + b[:12]
        counts[key] = counts.get(key, 0) + c / n
    for a, c in Counter(shapes).items():
        key = a[:12]
        counts[key] = counts.get(key, 0) + c / n
    for name, x in m.items():
        counts[f"{name}:{int(np.log2(x + 0.01) * 2)}".encode()] = 0.5
    out: dict[int, float] = {}
    for key, c in counts.items():
        h = xxhash.xxh64_intdigest(key, 7)
        place, sign = h & ((1 << BITS) - 1), 1.0 if h >> 63 else -1.0
        out[place] = out.get(place, 0.0) + sign * min(1.0, c * 8) ** 0.5
    return out


class Scorer:
    def __init__(self, weights: np.ndarray | None):
        self.weights = weights

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability that each text is good."""
        if self.weights is None:
            return np.full(len(texts), 0.5)
        z = np.empty(len(texts))
        for i, t in enumerate(texts):
            f = hashed(t)
            places = np.fromiter(f, np.int64, len(f))
            z[i] = self.weights[places] @ np.fromiter(f.values(), float, len(f)) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_scorer(texts: list[str], target: np.ndarray, rounds: int = 200, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on soft targets, by accelerated full-batch gradient steps; deterministic."""
    if not len(texts):
        return Scorer(None)
    rows = [hashed(t) for t in texts]
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    place = np.concatenate([np.fromiter(r, np.int64, len(r)) for r in rows])
    value = np.concatenate([np.fromiter(r.values(), float, len(r)) for r in rows])
    place, value = np.append(place, np.full(len(rows), 1 << BITS)), np.append(value, np.ones(len(rows)))
    at = np.append(at, np.arange(len(rows)))
    w = np.zeros((1 << BITS) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        z = np.bincount(at, value * w[place], len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(place, value * (p - target)[at], len(w)) / len(rows) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (1 - (k - 1) / rounds) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Scorer(w)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[Scorer, LabelModel | None]:
    found = vote_patterns(docs).orderBy("pattern").collect()  # at most 3^N_VOTES rows
    if not found:
        return Scorer(None), None
    patterns = np.array([[int(x) for x in r.pattern.split(",")] for r in found])
    n = np.array([r.n for r in found], float)
    model = LabelModel(patterns, n)
    texts = sorted(common.sample_texts(docs.select("doc_id", common.digest_text().alias("text")), sample, MAX_CHARS))
    target = model.posterior(np.array([votes(measures(t)) for t in texts]).reshape(-1, N_VOTES))
    return fit_scorer(texts, target), model


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    def run(b):
        return {"doc_id": b.column("doc_id"), "quality": scorer.score(b.column("text").to_pylist())}

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.digest_text().alias("text"))
    return common.map_batches(plain, "doc_id bigint, quality double", run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scorer, _ = train(docs)
    return score_documents(docs, scorer).select(
        "doc_id", "quality", (F.col("quality") >= 0.5).alias("kept")
    )
