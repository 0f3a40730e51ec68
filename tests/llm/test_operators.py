"""The training-data operators against brute force on awkward rows, and on tables without rows."""

import hashlib
import itertools
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from findings_engine.llm import (
    chat, common, encoding, fingerprints, media, packing, quality, segmentation, simhash_dedup, token_counts, token_files, toxicity,
)

SCHEMA = "doc_id bigint, text string, fp bigint, block int, digest string, start bigint, shard int, part int, payload binary, _tie long, pattern string, score string"
BYTES = encoding.vocabulary_path("byte_bpe_50k.json")
WORDS = encoding.vocabulary_path("word_bpe_49k.json")
PIECES = encoding.vocabulary_path("piece_bpe_32k.model")


def _texts():
    base = " ".join(f"word{i * 7919 % 501}" for i in range(600))
    return [
        (1, "The quick brown fox jumps over the lazy dog."), (2, "The quick brown fox jumps over the lazy dog."), (3, ""), (4, None),
        (5, "one"), (6, "Two  spaces\tand\nlines  \n\n end "), (None, "no id"), (None, "no id"), (7, "dup"), (7, "dup"), (7, "other"),
        (8, base), (9, base + " tail"), (20, "😀 émoji <|endoftext|> ÉCOLE ñ ▁x </s>[INST]"), (40, "x" * 30_000), (60, "long " * 20_000),
        (61, " leading"), (62, "THE QUICK brown fox jumps over the lazy dog."), (63, "<|startoftext|> it's 12,345!! \r\n ok"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, "d", 3, 4, 5, b"p", 6, "q", "s") for i, t in _texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def _library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def _plain_fingerprint(text, size=3):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    sh = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components():
    """Fingerprints of all rows, and of each the set of those that it is linked to over any number of steps."""
    rows = [(i, _plain_fingerprint(t)) for i, t in _texts()]
    comp = {f: {f} for _, f in rows}
    for a, b in itertools.combinations(list(comp), 2):
        if (a ^ b).bit_count() <= 2 and comp[a] is not comp[b]:
            comp[a] |= comp[b]
            for f in comp[a]:
                comp[f] = comp[a]
    return rows, comp


def test_simhash_classes(docs):
    rows, comp = _components()
    least = lambda f: min((i for i, g in rows if g in comp[f] and i is not None), default=None)
    want = sorted(((i, f"{f:016x}", least(f)) for i, f in rows), key=str)
    assert _rows(simhash_dedup.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want


def test_gray_index_finds_all_links():
    r = np.random.default_rng(1)
    fp = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [f ^ np.uint64(sum(1 << int(b) for b in r.choice(64, k, replace=False))) for f, k in zip(fp[:120], itertools.cycle((1, 2, 3, 4)), strict=False)]
    every = np.unique(np.concatenate([fp, np.array(near, np.uint64)]))
    for radius in (0, 2, 3):
        got = set()
        for q, leaf in simhash_dedup.GrayIndex(every).search(every, radius):
            got.update(zip(q.tolist(), leaf.tolist(), strict=True))
        want = {(i, j) for i in range(len(every)) for j in range(len(every)) if int(every[i] ^ every[j]).bit_count() <= radius}
        assert got == want


def test_links_across_blocks(spark):
    r = np.random.default_rng(2)
    fp = r.integers(-(1 << 62), 1 << 62, 400).tolist()
    fp = sorted({*fp, *(x ^ (1 << (i % 60)) ^ (1 << ((7 * i + 3) % 60)) for i, x in enumerate(fp[:200]))})
    df = spark.createDataFrame([(x,) for x in fp], "fp bigint")
    roots = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.links(df)).collect()}
    parent = {x: x for x in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fp, 2):
        if ((a ^ b) % (1 << 64)).bit_count() <= 2:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    same = lambda f: {frozenset(g) for g in _groups(fp, f)}
    assert same(lambda x: roots.get(x, x)) == same(find)


def _groups(xs, key):
    out = {}
    for x in xs:
        out.setdefault(key(x), []).append(x)
    return out.values()


def test_keep_one(docs, empty):
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    # Rows 7 are two texts that share an id: two components, one row of each.
    assert kept.count() == len({frozenset(c) for c in _components()[1].values()})
    assert simhash_dedup.keep_one(empty).count() == 0


PIECES_OF_TEXT = [
    " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\0", "\u00a0", " \u00a0", "\u0085", "\u3000", "\u2028", "\u1680", "a", "b", "Word", "hello", "DON'T", "it's",
    "'s", "'", "x'll", ",", ".", "!!", "***", "---", "7", "1234", "é", "É", "ß", "ẞ", "İ", "ñ", "e\u0301", "H\u0331", "\u0301", "Σ", "中文", "😀", "<|endoftext|>",
    "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "longwordlongwordlongwordlongword", "à",
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path):
    """Every awkward neighbourhood: one text at a time, in batches, and with tables that fill up all the time."""
    ids = _library(path)
    r = np.random.default_rng(5)
    texts = [t or "" for _, t in _texts()] + ["hi \0there", "a \u00a0 \u00a0 b", "x\n ", "a \n \n b", " ", "   ", "Go <|ENDOFTEXT|> é"]
    texts += ["".join(r.choice(PIECES_OF_TEXT, r.integers(0, 14))) for _ in range(4000)]
    want = [ids(t) for t in texts]
    for limit, size in ((20, 1), (50, 64), (1 << 20, 512)):
        enc = encoding.ChunkEncoder(path, limit=limit)
        for at in range(0, len(texts), size):
            got = enc.encode_many(texts[at : at + size])
            for t, g, w in zip(texts[at : at + size], got, want[at : at + size], strict=True):
                assert g.tolist() == w, t


def test_token_counts_and_cache(spark, docs, empty, tmp_path):
    ids = _library(BYTES)
    cache = token_counts.TokenCache(spark, str(tmp_path / "cache"))
    want = sorted(((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for i, t in _texts()), key=str)
    for _ in range(2):  # the second run finds all in the cache
        got = _rows(token_counts.count_tokens(docs, BYTES, cache), "doc_id", "n_bytes", "n_tokens", "over_limit")
        assert got == want
    assert cache.read().count() == len({t or "" for _, t in _texts()})
    assert token_counts.count_tokens(empty, BYTES, cache).count() == 0


def test_token_files(spark, docs, empty, tmp_path):
    ids = _library(BYTES)
    token_files.write_token_files(docs, str(tmp_path / "a"), BYTES)
    got = token_files.read_token_files(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in _texts()), key=lambda x: (x is not None, x))
    want = sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in _texts() for x in [ids(t) + [2]]), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    token_files.write_token_files(empty, str(tmp_path / "b"), BYTES)
    assert token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_packing_covers_every_id_once(docs, empty):
    ids = _library(WORDS)
    rows = packing.pack(docs, WORDS).collect()
    want = {}
    for i, t in _texts():
        want.setdefault(i, []).append(ids(t) + [2])
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert {k: sum(map(len, v)) for k, v in want.items()} == {k: sum(r.length for r in v) for k, v in by_doc.items()}
    for k, v in want.items():
        if len(v) == 1:
            at = 0
            for r in sorted(by_doc[k], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(v[0])
                assert r.ids_crc32 == zlib.crc32(np.array(v[0][at : at + r.length], "<u4").tobytes())
                at += r.length
    for s in _groups(rows, lambda r: r.sequence_id):
        s = sorted(s, key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s)])[:-1].tolist()
        total = sum(r.length for r in s)
        assert total <= 4096 and total & (total - 1) == 0
    assert packing.pack(empty, WORDS).count() == 0


def test_bm25_brings_like_documents_together():
    r = np.random.default_rng(3)
    docs = [r.integers(2000 * k, 2000 * k + 300, 100) for k in (0, 1, 2, 3) for _ in range(10)]
    order = r.permutation(len(docs))
    idf = np.ones(10_000)
    for w in packing.windows([docs[i] for i in order], [0] * len(docs), idf, 100.0, 1000):
        assert len({order[d] // 10 for d, _, _ in w}) == 1


def test_media_round_trip(docs, empty):
    got = media.store_and_read(docs).collect()
    want = []
    for i, t in _texts():
        raw = (t or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), media.feature(data)))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in got), key=str) == sorted(want, key=str)
    assert media.store_and_read(empty).count() == 0


def test_cuts_move_only_near_an_edit():
    data = np.random.default_rng(4).integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    edited = data[:150_000] + b"inserted" + data[150_000:]
    a, b = set(media.chunks(data)), set(media.chunks(edited))
    assert len(a - b) <= 3 and b"".join(media.chunks(edited)) == edited


def test_fingerprints_and_successors(docs, empty):
    rows = [(i, t or "") for i, t in _texts() if i is not None]
    got = [r for r in fingerprints.with_next(docs).collect() if r.doc_id is not None]
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    single = [(i, t) for i, t in rows if i != 7]
    for (i, t), (_, after) in itertools.pairwise(single):
        if {5, 6, 8} & {i}:
            continue
        [r] = by[i]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k] if i not in (6,) else None
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fp == simhash_dedup.signed(fingerprints.simhash(t)) and r.edited_fp == simhash_dedup.signed(fingerprints.simhash(edited))
        assert r.next_fp == simhash_dedup.signed(fingerprints.simhash(after))
    assert len(got) + 2 == len(_texts())
    assert fingerprints.with_next(empty).count() == 0


def test_block_tables_lose_no_pair(spark):
    r = np.random.default_rng(5)
    base = r.integers(-(1 << 62), 1 << 62, 60).tolist()
    near = [x ^ sum(1 << int(b) for b in r.choice(62, k, replace=False)) for x, k in zip(base, itertools.cycle((1, 2, 3, 4)), strict=False)]
    fp = sorted({*base, *near})
    df = spark.createDataFrame([(x,) for x in fp], "fp bigint")
    got = _rows(fingerprints.within(df, df), "query_fp", "fp", "distance")
    d = lambda a, b: ((a ^ b) % (1 << 64)).bit_count()
    assert got == sorted([(a, b, d(a, b)) for a in fp for b in fp if d(a, b) <= 3], key=str)


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(3, 8)))
    terms = {w: toxicity.edits_for(w) for w in (word() for _ in range(40))}
    a = toxicity.LexiconAutomaton(terms)
    for w in (word() for _ in range(1500)):
        near = [(d, t) for t, e in terms.items() if (d := _edit_distance(w, t)) <= e]
        got = a.match(w)
        assert (got is None) == (not near)
        if near:
            assert got[1] == min(near)[0] and _edit_distance(w, got[0]) == got[1]


def test_quotation_weighs_less():
    m = toxicity.Matcher({"idiot": 2.0})
    abuse, quoted = m.features("you are an idiot"), m.features('she said the word "idiot" twice')
    assert abuse[0] > quoted[0] and quoted[2] > 0 and m.features("you idjot here")[1] > 0


def _plain_quoted(text):
    """Places inside a pair of straight, angle or curly marks of one line, by trying all pairs of a kind from the left."""
    inside, base = set(), 0
    for line in text.split("\n"):
        for a, b in (('"', '"'), ("«", "»"), ("“", "”")):
            at = 0
            while (x := line.find(a, at)) >= 0 and (y := line.find(b, x + 1)) >= 0:
                inside.update(range(base + x, base + y))
                at = y + 1
        base += len(line) + 1
    return inside


def test_features_by_brute_force():
    import math
    import random
    import re

    lexicon = {"idiot": 2.0, "moron": 1.5, "dolt": 1.0}
    m = toxicity.Matcher(lexicon)
    r = random.Random(8)
    words = ["idiot", "idjot", "moron", "morons", "dolt", "dollt", "you", "said", "don’t", "it's", "house", "tree", "we", "saw", "old"]
    for _ in range(400):
        text = ""
        for _ in range(r.randint(0, 30)):
            w = r.choice(words)
            if r.random() < 0.1:
                a, b = r.choice([('"', '"'), ("«", "»"), ("“", "”")])
                w = f"{a}{w} {r.choice(words)}{b}"
            text += w + r.choice([" ", " ", " ", " ’ ", "\n"])
        low = text.lower()
        spans = [(x.start(), x.group()) for x in re.finditer(r"\w+", low)]
        quoted_at = _plain_quoted(low)
        exact = near = quoted = direct = best = 0.0
        terms = set()
        for i, (at, w) in enumerate(spans):
            found = sorted((_edit_distance(w, t), t) for t in lexicon if _edit_distance(w, t) <= toxicity.edits_for(t))
            if not found:
                continue
            e, t = found[0]
            around = {x for _, x in spans[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1]}
            value, inside, told = lexicon[t], at in quoted_at, bool(around & toxicity.REPORT)
            quoted += value * (inside or told)
            value *= (1, 0.5, 0.25)[inside + told]
            direct += value * bool(around & toxicity.SECOND)
            near, exact = (near + value, exact) if e else (near, exact + value)
            terms |= set() if e else {t}
            best = max(best, value / 2 if e else value)
        log = math.log1p
        want = [log(exact), log(near), log(quoted), log(direct), best, log(len(terms)), log(exact) / log(len(spans)) if spans else 0]
        assert m.features(text) == pytest.approx(want), text


def test_apostrophes_and_lone_marks_quote_nothing():
    f = toxicity.Matcher({"idiot": 2.0}).features
    assert f("you don’t see an idiot") == f("you dont see an idiot") or f("you don’t see an idiot")[2] == 0
    assert f('5" of rain, you idiot')[2] == 0 and f('a " lone mark\nidiot " there')[2] == 0
    assert f("he called „idiot“ once")[2] > 0 and f("say ‘an idiot’ now")[2] > 0 and f("»idiot«")[2] > 0
    assert toxicity.quotations('"a “b” c" d "e"') == ([0, 12], [8, 14])


def test_lexicon_by_brute_force():
    import math

    texts = [f"plain words here {'vile' if i % 3 == 0 else 'mild'} tail{i % 5}" for i in range(60)]
    y = np.array([i % 3 == 0 for i in range(60)], int)
    got = toxicity.learn_lexicon(texts, y)
    t, c = int(y.sum()), int((1 - y).sum())
    want = {}
    for w in {w for x in texts for w in x.split()}:
        k1 = sum(w in x.split() for x, k in zip(texts, y, strict=True) if k)
        k0 = sum(w in x.split() for x, k in zip(texts, y, strict=True) if not k)
        lift = ((k1 + 0.5) / (t + 1)) / ((k0 + 0.5) / (c + 1))
        if k1 >= toxicity.MIN_DOCS and lift >= toxicity.MIN_LIFT:
            want[w] = math.log(lift) * math.sqrt(k1) / math.sqrt(t)
    assert got == pytest.approx(want) and set(got) == {"vile"}


def test_toxicity_learns_and_scores(spark, docs, empty):
    rows = [(i, f"you are a {'vilething' if i % 2 else 'kind'} person number {i % 9}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(d, labels)
    got = toxicity.score_documents(spark.createDataFrame([(1, "you vilethimg"), (2, "a kind one"), (None, None)], "doc_id bigint, text string"), model)
    s = {r.doc_id: r.score for r in got.collect()}
    assert s[1] > 0.5 > s[2] and s[None] < 0.5
    assert toxicity.score_documents(docs, model).count() == len(_texts())
    blank = toxicity.train(empty, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(docs, blank).collect()} == {0.0}
    assert toxicity.score_documents(empty, model).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    from findings_engine.llm.queries import QUERIES

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op6_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert got > 0.9


def test_quality(spark, docs, empty):
    good = [(i, f"We walked to the old mill on day {i} and then read a long and calm book by the fire until it was late in the evening. " * 3) for i in range(60)]
    bad = [(100 + i, f"$$ ## %% {i} ^^ ** {{}} \\ ~~ " * 12) for i in range(20)]
    d = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    scorer, model = quality.train(d)
    s = {r.doc_id: r.quality for r in quality.score_documents(d, scorer).collect()}
    assert min(s[i] for i, _ in good) > 0.5 > max(s[i] for i, _ in bad)
    assert model.accuracies().shape == (quality.N_VOTES,)
    assert quality.score_documents(docs, scorer).count() == len(_texts())
    blank, none = quality.train(empty)
    assert none is None and {r.quality for r in quality.score_documents(docs, blank).collect()} == {0.5}


def test_label_model_by_brute_force():
    """Expectation-maximisation row by row, with plain loops, gives the rates, posteriors and accuracies of the pattern counts."""
    import math

    r = np.random.default_rng(9)
    k = quality.N_VOTES
    rows = np.where(r.random((150, k)) < 0.12, -1, np.where(r.random((150, k)) < 0.3, 1, 0))
    rows[:, : len(quality.LABELLERS)] = np.minimum(rows[:, : len(quality.LABELLERS)], 0)
    patterns, n = np.unique(rows, axis=0, return_counts=True)
    model = quality.LabelModel(patterns, n.astype(float))
    kinds = []
    for row in rows:
        fired = [j for j in range(k) if row[j] < 0]
        good = 0.02 if fired else 0.95
        kinds.append([good, *((1 - good) * ((j in fired) / len(fired) if fired else 1 / k) for j in range(k))])
    total_rows = len(rows)
    for _ in range(quality.ROUNDS):
        prior, rate = [], []
        for z in range(k + 1):
            mass = sum(x[z] for x in kinds)
            prior.append((mass + 1) / (total_rows + k + 1))
            per = []
            for j in range(k):
                c = [0.5 + sum(x[z] for x, row in zip(kinds, rows, strict=True) if row[j] == v) for v in (-1, 0, 1)]
                if z == 0:
                    held = model.PRIOR * total_rows
                    rest = c[1] + c[2]
                    c = [c[0] + held * model.FALSE_ALARM, *(x + held * (1 - model.FALSE_ALARM) * x / rest for x in c[1:])]
                per.append([x / sum(c) for x in c])
            rate.append(per)
        kinds = []
        for row in rows:
            like = []
            for z in range(k + 1):
                told = [j for j in range(k) if row[j] or j < len(quality.LABELLERS)]
                like.append(prior[z] * math.prod(rate[z][j][row[j] + 1] for j in told))
            kinds.append([x / sum(like) for x in like])
    assert np.allclose(np.exp(model.rates), rate) and np.allclose(model.posterior(rows), [x[0] for x in kinds])
    bad = np.array([[prior[z] * rate[z][j][0] for j in range(k)] for z in range(k + 1)])
    assert np.allclose(model.accuracies(), 1 - bad[0] / bad.sum(axis=0))


def test_scorer_is_at_the_minimum():
    """The gradient that the fit follows vanishes where it ends: checked by differences of the penalised loss."""
    texts = [f"calm words about the sea number {i} and more of them" if i % 2 else f"$$$ {i} ## !! %% *** $$ {i}" for i in range(40)]
    target = np.array([0.9 if i % 2 else 0.2 for i in range(40)])
    w = quality.fit_scorer(texts, target, rounds=3000, ridge=1e-2).weights
    rows = [quality.hashed(t) for t in texts]

    def loss(w):
        z = np.array([sum(w[i] * v for i, v in row.items()) + w[-1] for row in rows])
        return np.mean(np.logaddexp(0, z) - target * z) + 0.5e-2 * (w @ w)

    for i in [*sorted({i for row in rows for i in row})[:25], len(w) - 1]:
        step = np.zeros_like(w)
        step[i] = 1e-4
        assert abs(loss(w + step) - loss(w - step)) / 2e-4 < 2e-3


def _segmentations(text, v):
    """All segmentations of a normal form, with log probabilities."""
    table = {b.decode().replace(" ", segmentation.MARK): i for i, b in enumerate(v.bytes) if b and i not in set(v.byte_id.tolist())}

    def go(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, min(v.longest, len(rest)) + 1):
            i = table.get(rest[:k])
            if i is None and k == 1:
                raw = rest[0].encode()
                for tail, lp in go(rest[1:]):
                    yield (*(int(v.byte_id[b]) for b in raw), *tail), segmentation.BYTE_LOG * len(raw) + lp
            elif i is not None:
                for tail, lp in go(rest[k:]):
                    yield (i, *tail), v.log[i] + lp

    return dict(go(segmentation.normal_form(text)))


def test_samples_are_distinct_and_follow_the_lattice():
    v = segmentation.Vocabulary(PIECES)
    text = "a bad"
    every = _segmentations(text, v)
    total = np.logaddexp.reduce(list(every.values()))
    first, n = {}, 3000
    out = segmentation.sample_batch(segmentation.row_keys(list(range(n)), 1), [text] * n, segmentation.Lattices(v), 4)
    for found, _ in out:
        seqs = [tuple(segmentation.spelled(ids, v).tolist()) for ids, _, _ in found]
        assert len(set(seqs)) == len(seqs) == min(4, len(every)) and set(seqs) <= set(every)
        assert [g for _, _, g in found] == sorted((g for _, _, g in found), reverse=True)
        for s, (_, lp, _) in zip(seqs, found, strict=True):
            assert abs(lp - (every[s] - total)) < 1e-6
        first[seqs[0]] = first.get(seqs[0], 0) + 1
    for s, lp in every.items():
        p = float(np.exp(lp - total))
        assert abs(first.get(s, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


def test_second_draws_and_inclusion_scores():
    """Pairs are drawn as without replacement, and weighing each sample by its inclusion score counts every one once."""
    v = segmentation.Vocabulary(PIECES)
    text, n, k = "a bad", 6000, 2
    every = _segmentations(text, v)
    total = np.logaddexp.reduce(list(every.values()))
    p = {s: float(np.exp(lp - total)) for s, lp in every.items()}
    pairs, weight = {}, dict.fromkeys(every, 0.0)
    squares = dict.fromkeys(every, 0.0)
    for found, kappa in segmentation.sample_batch(segmentation.row_keys(list(range(n)), 3), [text] * n, segmentation.Lattices(v), k):
        seqs = [tuple(segmentation.spelled(ids, v).tolist()) for ids, _, _ in found]
        pairs[tuple(seqs)] = pairs.get(tuple(seqs), 0) + 1
        for s, (_, lp, _) in zip(seqs, found, strict=True):
            w = 1 / -np.expm1(-np.exp(lp - kappa))
            weight[s] += w
            squares[s] += w * w
    for a, b in itertools.permutations(every, 2):
        want = p[a] * p[b] / (1 - p[a])
        assert abs(pairs.get((a, b), 0) / n - want) < 5 * np.sqrt(want / n) + 1e-3
    for s in every:
        if p[s] > 0.01:
            assert abs(weight[s] / n - 1) < 5 * np.sqrt(squares[s]) / n + 0.02, (s, p[s], weight[s] / n)


def test_samples_depend_on_the_row_alone():
    """Not on the batch, nor on what the worker has seen before."""
    v = segmentation.Vocabulary(PIECES)
    texts = [t or "" for _, t in _texts()]
    keys = segmentation.row_keys(list(range(len(texts))), 5)
    lat = segmentation.Lattices(v)
    whole = segmentation.sample_batch(keys, texts, lat, 3)
    for i in reversed(range(len(texts))):
        [one] = segmentation.sample_batch(keys[i : i + 1], texts[i : i + 1], segmentation.Lattices(v), 3)
        assert [list(ids) for ids, _, _ in one[0]] == [list(ids) for ids, _, _ in whole[i][0]]


def test_segmentations_decode(docs, empty):
    got = segmentation.sample_segmentations(docs, PIECES, 3).collect()
    marked = {i for i, t in _texts() if segmentation.MARK in (t or "")}  # the model reads its own mark as a space
    assert all(r.decodes == (r.doc_id not in marked) and 0 <= r.inclusion <= 1 for r in got)
    assert {r.doc_id for r in got} == {i for i, _ in _texts()}
    assert segmentation.sample_segmentations(empty, PIECES).count() == 0


def test_chat_reads_back(spark):
    rows = [
        (1, 0, "user", "hi </s> [INST] <|end|> <\\|end|> [\\/INST]"), (1, 1, "assistant", "ok <|says|>"), (1, 2, "assistant", None), (2, 0, None, ""),
        (None, 0, "user", "x"), (3, 1, "user", "b"), (3, 1, "user", "b"), (3, None, "assistant", "first"), (4, 0, "<|role|>", "y"),
    ]
    t = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_conversations(t.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted([((-1 if r[1] is None else r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == c])
        assert [(x.role, x.text) for x in back[c].turns] == [(r, x) for _, r, x in mine]
        assert back[c].loss_text == "".join(x for _, r, x in mine if r == "assistant")
    assert chat.format_conversations(t.limit(0).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))).count() == 0


def test_chat_long_texts_ties_and_clashing_columns(spark):
    long = "</s>[INST] word " * 40_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    names = ("segments", "attachments", "loss_mask", "formatted", "content", "start", "segment", "turns")
    t = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select(
        "*", chat.text_parts(F.col("text")).alias("parts"), *[F.lit(7).alias(x) for x in names]
    )
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(t)).collect()}
    assert back[1].loss_text == long and [x.text for x in back[1].turns] == [long, long]
    assert back[2].loss_text == "samesame" and len(back[2].turns) == 2


def test_chat_parts(spark):
    part = lambda **k: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part(type="text", text="see"), part(type="image", ref="i.png", width=57, height=28), part(type="audio", ref="a", seconds=2.0), part(type="document", ref="d", pages=2), part(type="odd", ref="o")]
    t = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")
    r = chat.format_conversations(t).first()
    assert "see<|image|><|audio|><|document|><|other|>" in r.formatted
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 3), ("audio", "a", 50), ("document", "d", 512), ("odd", "o", 0)]
    assert r.expanded_tokens == 565


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, kept, sf), "stage")
        assert after.columns == docs.columns and 0 < after.count() <= kept.count()
        kept = after
    _, last = corpus_pipeline.STAGES[-1]
    assert {r.doc_id for r in last(spark, kept, sf).select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_pipeline_stages_on_awkward_tables(spark, docs, empty, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns, and tables without rows."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, None, None), (1, None, 1)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    every = sorted(map(str, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        rows = sorted(map(str, got.collect()))
        assert set(rows) <= set(every) and len(rows) <= len(every)
        again = sorted(map(str, stage(spark, docs, str(tmp_path)).collect()))
        assert rows == again, name
        none = stage(spark, empty, str(tmp_path))
        assert none.columns == empty.columns and none.count() == 0
    _, packing_stage = corpus_pipeline.STAGES[-1]
    pieces = packing_stage(spark, docs, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    ids = _library(WORDS)
    want = {}
    for i, t in _texts():
        want[i] = want.get(i, 0) + len(ids(t)) + 1
    assert {r.doc_id: r.n for r in pieces} == want
    assert packing_stage(spark, empty, str(tmp_path)).count() == 0


def test_dedup_keeps_the_smallest_of_ties(spark):
    """Of equal texts the smallest id stays, a missing id last; of a repeated row one; other columns stay with their row."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(9, long, "a"), (4, long, "b"), (4, long, "b"), (None, long, "c"), (7, long + " tail", "d"), (None, "lone", "e"), (None, "lone", "e"), (3, "", "f"), (2, None, "g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    got = sorted(((r.doc_id, r.source) for r in corpus_pipeline.dedup_stage(spark, df, "").collect()), key=str)
    assert got == sorted([(4, "b"), (None, "e"), (2, "g")], key=str)


def _near_texts():
    """Chains, edits, containment, copies, hot passages, short and empty texts."""
    r = np.random.default_rng(7)
    text = lambda n: [f"w{x}" for x in r.integers(0, 5000, n)]
    hot, out = text(40), ["", None, "one two", "ONE  two", "a b c d e", "a b c d e f"]
    for n in (20, 60, 250):
        for _ in range(12):
            base = text(n)
            out += [" ".join(base), " ".join(base + hot)]
            for edits in (1, 2, 4, 6, 9):
                words = list(base)
                for i in r.choice(n, min(edits, n // 10), replace=False):
                    words[i] = f"x{r.integers(1 << 30)}"
                out.append(" ".join(words))
            out += [" ".join(base[: int(n * 0.8)]), " ".join(base[: int(n * 0.85)])]
    return out


@pytest.mark.parametrize("sample, chunk", [(8192, 512), (40, 3)])
def test_pipeline_dedup_links_by_five_words(spark, monkeypatch, sample, chunk):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    jaccard_dedup = pytest.importorskip("findings_engine.llm.jaccard_dedup")
    monkeypatch.setattr(jaccard_dedup, "SAMPLE", sample)
    monkeypatch.setattr(jaccard_dedup, "CHUNK", chunk)
    rows = [*enumerate(_near_texts()), (None, "no id"), (None, "no id"), (3, "one TWO"), (9000, "same row"), (9000, "same row")]
    df = spark.createDataFrame([(i, t, 0, 0, 0, 0) for i, t in rows], "doc_id bigint, text string, _tie int, _id int, n int, node int")
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    fewer = 0
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x == y or 10 * len(x & y) >= 8 * len(x | y):
            fewer += (_plain_fingerprint(rows[a][1]) ^ _plain_fingerprint(rows[b][1])).bit_count() > 2
            root = [root[a] if q == root[b] else q for q in root]
    assert fewer > 10  # the two-bit radius of op1 loses these
    want = sorted(min((rows[i][0] for i in g if rows[i][0] is not None), default=-1) for g in _groups(range(len(rows)), root.__getitem__))
    got = corpus_pipeline.dedup_stage(spark, df.repartition(3), "")
    assert got.columns == df.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == want
    assert corpus_pipeline.dedup_stage(spark, df.limit(0), "").count() == 0


def test_pipeline_dedup_groups_nothing_by_chance(spark, monkeypatch):
    """Texts that share a passage with the next, which a small sample doesn't show, must not grow into one group."""
    jaccard_dedup = pytest.importorskip("findings_engine.llm.jaccard_dedup")
    monkeypatch.setattr(jaccard_dedup, "SAMPLE", 1)
    texts = []
    for i in range(60):
        words = [f"w{i}x{k}" for k in range(300)]
        words[100:105], words[200:205] = ([f"p{j}x{k}" for k in range(5)] for j in (i, i + 1))
        texts.append((i, i, " ".join(words)))
    shingled = jaccard_dedup.nodes(spark.createDataFrame(texts, "doc_id bigint, tie bigint, text string"))
    assert jaccard_dedup.candidates(shingled).count() == 0


def test_pipeline_dedup_uses_the_simhash_index(spark, monkeypatch):
    """The stage asks op1's index, whose candidates are all nodes with fingerprints within two bits."""
    jaccard_dedup = pytest.importorskip("findings_engine.llm.jaccard_dedup")
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    df = spark.createDataFrame([(i, i, t or "") for i, t in enumerate(_near_texts())], "doc_id bigint, tie bigint, text string")
    shingled = common.materialize(jaccard_dedup.nodes(df).select("node", "fp").distinct(), "shingled")
    rows = shingled.collect()
    place = {r.node: k for k, r in enumerate(rows)}
    edges = np.array([(place[r.a], place[r.b]) for r in jaccard_dedup.fingerprinted(shingled).collect()])
    labels = np.arange(len(rows))
    simhash_dedup.union(labels, edges[:, 0], edges[:, 1])
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if ((rows[i].fp ^ rows[j].fp) & (1 << 64) - 1).bit_count() <= 2]
    assert len(near) > 5 and all(labels[i] == labels[j] for i, j in near)
    asked = []
    monkeypatch.setattr(jaccard_dedup, "links", lambda d: asked.append(1) or simhash_dedup.links(d))
    corpus_pipeline.dedup_stage(spark, df.limit(5), "")
    assert asked


def test_shared_shingles_lose_no_link(monkeypatch):
    """Lists of any length, cut anywhere into batches, hold all pairs of linked sets, as pairs or by chains."""
    jaccard_dedup = pytest.importorskip("findings_engine.llm.jaccard_dedup")
    r = np.random.default_rng(5)
    none = np.empty(0, np.uint64)
    for most in (4, 1024):
        monkeypatch.setattr(jaccard_dedup, "LISTED", most)
        sets = []
        for n in (3, 30, 70, 200, 900):
            base = r.integers(0, 1 << 62, n).astype(np.uint64)
            for k in range(12):
                less = r.choice(base, n - n * k // 60, replace=False)
                sets.append(np.unique(np.append(less, r.integers(0, 1 << 62, n * (k % 4) // 30).astype(np.uint64))))
        rows = [(int(h), len(s), at, i) for i, s in enumerate(sets) for at, h in enumerate(jaccard_dedup.prefix(s, none, none))]
        h, n, at, node = (np.array(c) for c in zip(*sorted(rows, key=lambda x: (x[0], x[1], x[3])), strict=True))
        a, b, least = jaccard_dedup.listed(h, n, at, node)
        seen = {}
        for x, y, k in zip(a.tolist(), b.tolist(), least.tolist(), strict=True):
            c, m = seen.get((x, y), (0, k))
            seen[x, y] = c + 1, min(m, k)
        labels = np.arange(len(sets))
        good = np.array([p for p, (c, m) in seen.items() if c >= m])
        simhash_dedup.union(labels, good[:, 0], good[:, 1])
        links = 0
        for i, j in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                links += 1
                assert labels[i] == labels[j]
        assert links > 50


@pytest.mark.parametrize("kind", ["empty", "equal", "mixed"])
def test_tied_neighbours_fill_windows(kind):
    r = np.random.default_rng(5)
    one, copy, idf = np.array([2]), np.array([5, 6, 7, 2]), np.linspace(1.0, 2.0, 500)
    docs = {"empty": [one] * 6000, "equal": [copy] * 6000}.get(kind)
    docs = docs or [(one, copy, r.integers(0, 500, 3), r.integers(0, 500, 90))[i % 4] for i in range(6000)]
    found = list(packing.windows(docs, [0] * len(docs), idf, 4.0, 4096))
    assert all(b > a for w in found for _, a, b in w)
    assert all(sum(b - a for _, a, b in w) == 4096 for w in found[:-1])
    ids = {}
    for d, a, b in itertools.chain(*found):
        ids.setdefault(d, []).extend(range(a, b))
    assert all(ids[d] == list(range(len(x))) for d, x in enumerate(docs))
    if kind == "empty":  # ties go to the lower place
        assert [d for w in found for d, _, _ in w] == list(range(6000))
