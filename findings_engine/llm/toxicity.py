"""Toxicity by a lexicon with misspellings, weighed by its context.

The lexicon is learned from labelled training rows: terms far likelier in toxic
documents than in others. A trie holds it; the Levenshtein automata of all its
terms run over the trie at once, their joint states made on demand and kept, so
a text's word costs one table look-up a letter until the state is dead. A hit
counts less inside quotation marks or near words of report, and more near a
second person. Quotation marks count in pairs within a line: an apostrophe between
letters is none, and a mark without its partner quotes nothing. A logistic model
over the hits' sums scores the document.

Only training rows are read: labels whose crc32(doc_id) mod 5 is not 0, in a
sample of at most MAX_ROWS by hash order, of texts of at most MAX_CHARS characters
(one text an id). Scores read the whole text and nothing else.

Defined results: null and empty texts have no hits and get the model's base
score; rows keep their ids, null ids are never held out; repeated rows get equal
scores; a document labelled twice is toxic if one label says so; terms that lift
equally come in alphabetical order; other columns, whatever their names, don't
take part; without training rows of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_ROWS, MAX_CHARS, MAX_TERMS, MIN_DOCS, MIN_LIFT = 12_000, 16_384, 600, 4, 8.0
WINDOW, MEMO = 6, 300_000
_WORD = re.compile(r"\w+")
_QUOTES = re.compile("\n|[\"«»“”„‘]|(?<!\\w)’|’(?!\\w)")
#: A closing mark, and what it closes: the last of these open in the line. One that closes nothing opens.
_CLOSES = {'"': '"', "»": "«", "«": "»", "”": "“„", "“": "„", "’": "‘"}
REPORT = frozenset(
    "said says called quote quoted quotes wrote word term means dit disait mot appelé sagte nannte wort zitat dijo palabra llamó".split()
)
SECOND = frozenset("you your youre u ur tu toi vous ton votre du dich dir ihr usted tú ti vosotros".split())
LEET = str.maketrans("013457@$", "oieastas")


class LexiconAutomaton:
    """Levenshtein automata of all terms against their trie, determinised on demand."""

    def __init__(self, terms: dict[str, int], limit: int = 200_000):
        self.limit = limit
        self.next: list[dict[str, int]] = [{}]
        self.end: list[str | None] = [None]
        self.depth_left = [0]
        for term in terms:
            node = 0
            for ch in term:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.end.append(None)
                node = self.next[node][ch]
            self.end[node] = term
        self.edits = terms
        self.most = max(terms.values(), default=0)
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.start = self.add({0: 0})

    def add(self, state: dict[int, int]) -> int:
        """The number of a state: trie node -> fewest edits so far, closed under skipped term letters."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            if e < self.most:
                for child in self.next[node].values():
                    if state.get(child, self.most + 1) > e + 1:
                        state[child] = e + 1
                        todo.append((child, e + 1))
        key = tuple(sorted(state.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(e, self.end[n]) for n, e in key if self.end[n] is not None and e <= self.edits[self.end[n]]]
            best = min(ends, default=None)
            self.accepts.append(best and (best[1], best[0]))
        return self.ids[key]

    def step(self, at: int, ch: str) -> int:
        """-1 when dead. A letter matches, replaces one, or is put in."""
        out: dict[int, int] = {}
        for node, e in self.states[at]:
            for letter, child in self.next[node].items():
                cost = e + (letter != ch)
                if cost <= self.most and out.get(child, self.most + 1) > cost:
                    out[child] = cost
            if e < self.most and out.get(node, self.most + 1) > e + 1:
                out[node] = e + 1
        return self.add(out) if out else -1

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its own edits, and the edits; ties to the first in order."""
        if len(self.states) > self.limit:
            self.reset()
        at = self.start
        for ch in word:
            to = self.moves[at].get(ch)
            if to is None:
                to = self.moves[at][ch] = self.step(at, ch)
            if to < 0:
                return None
            at = to
        return self.accepts[at]


def edits_for(term: str) -> int:
    """Misspellings are told only of terms long enough for one edit to leave them recognisable."""
    return 0 if len(term) < 5 else 1


def quotations(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the outermost quoted spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    open_: list[tuple[str, int]] = []
    for m in _QUOTES.finditer(text):
        mark, at = m.group(), m.start()
        if mark == "\n":
            open_.clear()
            continue
        closes = _CLOSES.get(mark, "")
        k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] in closes), None) if closes else None
        if k is None:
            open_.append((mark, at))
            continue
        begin = open_[k][1]
        del open_[k:]
        while starts and starts[-1] > begin:  # spans within this one
            starts.pop()
            ends.pop()
        starts.append(begin)
        ends.append(at)
    return starts, ends


class Matcher:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.automaton = LexiconAutomaton({t: edits_for(t) for t in lexicon})
        self.memo: dict[str, tuple[str, int] | None] = {}

    def find(self, word: str):
        memo = self.memo
        if word in memo:
            return memo[word]
        if len(memo) > MEMO:
            memo.clear()
        got = self.automaton.match(word)
        if got is None and not word.isalpha() and not word.isdigit():
            got = self.automaton.match(word.translate(LEET))
        memo[word] = got
        return got

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = _WORD.findall(low)
        find = self.find
        hits = [(i, got) for i, got in enumerate(map(find, words)) if got is not None]
        if not hits:
            return [0.0] * 7
        spans = [m.start() for m in _WORD.finditer(low)]
        starts, ends = quotations(low)
        exact, near, quoted, direct, best = 0.0, 0.0, 0.0, 0.0, 0.0
        terms: dict[str, float] = {}
        for i, (term, e) in hits:
            value = self.lexicon[term]
            around = words[max(0, i - WINDOW) : i + WINDOW + 1]
            k = bisect_right(starts, spans[i]) - 1
            inside = k >= 0 and spans[i] < ends[k]
            reported = any(w in REPORT for w in around)
            if inside or reported:
                quoted += value
                value *= 0.25 if inside and reported else 0.5
            if any(w in SECOND for w in around):
                direct += value
            if e:
                near += value
            else:
                exact += value
                terms[term] = value
            best = max(best, value if not e else value / 2)
        n = math.log1p(len(words))
        return [
            math.log1p(exact), math.log1p(near), math.log1p(quoted), math.log1p(direct), best,
            math.log1p(len(terms)), math.log1p(exact) / n,
        ]


def learn_lexicon(texts: list[str], toxic: np.ndarray) -> dict[str, float]:
    """Terms by weighted log odds of their documents."""
    counts = [Counter(), Counter()]
    for text, y in zip(texts, toxic.tolist(), strict=True):
        counts[int(y)].update(set(_WORD.findall(text.lower())))
    t, c = int(toxic.sum()), int(len(toxic) - toxic.sum())
    found = {}
    for term, k in counts[1].items():
        lift = ((k + 0.5) / (t + 1)) / ((counts[0][term] + 0.5) / (c + 1))
        if k >= MIN_DOCS and lift >= MIN_LIFT and len(term) > 2:
            found[term] = math.log(lift) * math.sqrt(k)
    best = sorted(found, key=lambda w: (-found[w], w))[:MAX_TERMS]
    return {w: found[w] / math.sqrt(t) for w in best}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights with the intercept last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, lexicon: dict[str, float], weights: np.ndarray | None):
        self.lexicon, self.weights, self.matcher = lexicon, weights, None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights, "matcher": None}

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        if self.matcher is None:
            self.matcher = Matcher(self.lexicon)
        x = np.array([self.matcher.features(t) for t in texts]).reshape(len(texts), -1)
        z = x @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Half of the sample gives the lexicon, all of it the weights, cross-fitted by halves."""
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.digest_text().alias("text"))
    # At most max_rows rows of two numbers; then at most as many texts, of a bounded length.
    chosen = chosen.where(F.length("text") <= MAX_CHARS).join(F.broadcast(rows), "doc_id")
    got = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    got.sort(key=lambda r: r.doc_id)
    texts, y = [r.text for r in got], np.array([r.toxic for r in got], np.int64)
    if len(np.unique(y)) < 2:
        return Model({}, None)
    x = np.zeros((len(y), 7))
    half = np.arange(len(y)) % 2
    for side in (0, 1):  # a document's features come from a lexicon that has not seen it
        there, here = half == side, np.flatnonzero(half != side)
        part = Matcher(learn_lexicon([t for t, k in zip(texts, there, strict=True) if k], y[there]))
        for i in here:
            x[i] = part.features(texts[i])
    return Model(learn_lexicon(texts, y), fit_logistic(x, y))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row."""

    def run(b):
        return {"doc_id": b.column("doc_id"), "score": model.score(b.column("text").to_pylist())}

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.digest_text().alias("text"))
    return common.map_batches(plain, "doc_id bigint, score double", run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
