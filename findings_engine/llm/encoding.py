"""Exact, memoised encoding with the public tokenizers.

Both JSON vocabularies cut a text before every single space (the byte vocabulary
not behind a no-break space) and between an ASCII letter and a punctuation mark,
the byte vocabulary also before a line feed behind a printable ASCII character.
So the ids of a text are the ids of its chunks one after the other; a chunk holds
the space or line feed that leads it. The byte vocabulary's runs of two or more
spaces are never cut, nor is any special string.

Chunks repeat far more than texts do. Each Python worker keeps tables from chunk
to the ids that the library gave for it and asks the library only for chunks that
it has not seen. Short chunks are found by their bytes, which are the keys
themselves (no digest), in an open-addressing table that numpy reads for a whole
slice of texts at once; longer ones are found in a dictionary. There are two
generations of MEMO_CHUNKS each, so a worker's memory has a bound.
"""

from __future__ import annotations

import itertools
import os
import re
import string

import numpy as np

MEMO_CHUNKS = 1 << 19
MEMO_IDS = 8 * MEMO_CHUNKS
MEMO_BYTES = 256
SLICE_CHARS = 1 << 20
KEY = 24  # bytes of a key; the last is the chunk's length
_U = np.uint64
_FEEDS = re.compile(r"\n\n?[!-~]+")
_WORD_MARKS = re.compile(f"[A-Za-zÀ-ÖØ-öø-ÿ]+[{re.escape(string.punctuation.replace(chr(39), ''))}]+")
_MARKS = frozenset(string.punctuation) - {"'"}
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*string.ascii_letters.encode()]], _MARK[[*string.punctuation.encode()]] = True, True
_MASK = np.zeros((KEY, KEY), np.uint8)
for _n in range(KEY):
    _MASK[_n, :_n] = 255
_MASK = _MASK.view(_U)
_LENGTH = (np.arange(KEY, dtype=_U)) << _U(56)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of many runs, one after the other."""
    stops = np.cumsum(sizes)
    places = np.repeat(starts - (stops - sizes), sizes)
    places += np.arange(len(places))
    return places


def keys_of(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Keys (a row each) of chunks of under KEY bytes; ``text`` has KEY bytes more behind the last."""
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, KEY)[starts]).view(_U)
    keys &= _MASK[sizes]
    keys[:, -1] |= _LENGTH[sizes]
    return keys


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of one of each, and the number of each row's key among them."""
    found, at, back = np.unique(keys.view(f"V{KEY}").ravel(), return_index=True, return_inverse=True)
    return found.view(_U).reshape(-1, KEY // 8), at, back


class KeyTable:
    """Short chunks lead to entries by an open-addressing table over their keys."""

    def __init__(self, limit: int):
        self.limit = limit
        bits = max(10, (3 * limit).bit_length())
        self.shift, self.last = _U(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros((1024, KEY // 8), _U)
        self.entries = 0
        self.long: dict[bytes, int] = {}  # chunks that are no short ones

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(32)
        h += keys[:, 1]
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
        h += keys[:, 2]
        h *= _U(0x94D049BB133111EB)
        return (h >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        slot = self._slot(keys)
        out = self.slots[slot].astype(np.int64)
        other = np.flatnonzero((out >= 0) & (self.keys[out] != keys).any(axis=1))
        while len(other):
            slot[other] = (slot[other] + 1) & self.last
            out[other] = self.slots[slot[other]]
            e = out[other]
            other = other[(e >= 0) & (self.keys[e] != keys[other]).any(axis=1)]
        return out

    def more(self, n: int) -> np.ndarray:
        """n new entries."""
        while self.entries + n > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
        self.entries += n
        return np.arange(self.entries - n, self.entries)

    def enter(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Lead distinct new keys to their entries."""
        self.keys[entries] = keys
        slot = self._slot(keys)
        while len(slot):
            empty = np.flatnonzero(self.slots[slot] < 0)
            took, first = np.unique(slot[empty], return_index=True)
            first = empty[first]
            self.slots[took] = entries[first]
            rest = np.ones(len(slot), bool)
            rest[first] = False
            slot, entries = (slot[rest] + 1) & self.last, entries[rest]


class ChunkTable(KeyTable):
    """Entries have ids."""

    def __init__(self, limit: int):
        super().__init__(limit)
        self.start, self.size = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def full(self) -> bool:
        return self.entries > self.limit or self.used > MEMO_IDS

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New entries with these ids, one after the other."""
        entry, more = self.more(len(sizes)), len(ids)
        while len(self.start) < len(self.keys):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + more] = ids
        self.size[entry] = sizes
        self.start[entry] = self.used + np.cumsum(sizes) - sizes
        self.used += more
        return entry


class ChunkEncoder:
    """Ids of whole texts as arrays of unsigned 32-bit numbers."""

    def __init__(self, path: str, limit: int = MEMO_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit = limit
        self.new, self.old = ChunkTable(limit), None
        one = lambda x: self.tok.encode(x, add_special_tokens=False).ids
        # A vocabulary that drops white space has the same ids with and without the leading space.
        self.drops_space = one("a b") == [*one("a"), *one("b")]
        self.lowers = self.drops_space and one("ÉA") == one("éa")
        self.closes = np.zeros(self.tok.get_vocab_size(), bool)
        self.opens = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.closes[i], self.opens[i] = token.endswith("</w>"), token.startswith("Ġ")
        if not self.drops_space:
            self.feeds = np.arange(len(self.opens)) == one("\n")[0]

    # -- what the library says of new chunks ------------------------------------

    def _runs(self, parts: list[str], counts: list[int], marks: np.ndarray, glue: str, closing: bool) -> list[bytes | None]:
        """Ids of parts, 64 in one call, cut at the tokens that open or close them; None where their count is off."""
        out: list[bytes | None] = []
        for k in range(0, len(parts), 4096):
            runs = [(parts[a : a + 64], counts[a : a + 64]) for a in range(k, min(k + 4096, len(parts)), 64)]
            found = self.tok.encode_batch_fast([glue.join(p) for p, _ in runs], add_special_tokens=False)
            for (p, n), e in zip(runs, found, strict=True):
                ids = np.array(e.ids, "<u4")
                at = np.flatnonzero(marks[ids])
                n = np.cumsum(n)
                if len(at) != n[-1]:
                    out.extend([None] * len(p))
                    continue
                cuts = [0, *(4 * (at[n - 1] + 1)).tolist()] if closing else [*(4 * at[np.append(0, n[:-1])]).tolist(), 4 * len(ids)]
                raw = ids.tobytes()
                out.extend([raw[a:b] for a, b in itertools.pairwise(cuts)])
        return out

    def ask(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(chunks)

        def some(places: list[int], counts: list[int], marks: np.ndarray, glue: str, closing: bool) -> None:
            for i, x in zip(places, self._runs([chunks[i] for i in places], counts, marks, glue, closing), strict=True):
                out[i] = x

        if self.drops_space:  # a word, or a word and the marks behind it, has one token that closes each
            chunks = [c[1:] if c[:1] == " " else c for c in chunks]
            n = [1 if c.isalpha() or (c and _MARKS.issuperset(c)) else 2 if _WORD_MARKS.fullmatch(c) else 0 for c in chunks]
            easy = [i for i, k in enumerate(n) if k]
            some(easy, [n[i] for i in easy], self.closes, " ", True)
        else:
            led = [i for i, c in enumerate(chunks) if c[:1] == " " and len(c) > 1 and " " not in c[1:] and "<|" not in c]
            some(led, [1] * len(led), self.opens, "", False)
            fed = [i for i, c in enumerate(chunks) if c[:1] == "\n" and _FEEDS.fullmatch(c) and "<|" not in c]
            some(fed, [chunks[i].count("\n") for i in fed], self.feeds, "", False)
        rest = [i for i, x in enumerate(out) if x is None]
        for group in (rest[at : at + 1024] for at in range(0, len(rest), 1024)):
            es = self.tok.encode_batch_fast([chunks[i] for i in group], add_special_tokens=False)
            for i, e in zip(group, es, strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    # -- texts --------------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        first = chars = 0
        for i, text in enumerate(texts):
            if i > first and chars + len(text) > SLICE_CHARS:
                out += self._slice(texts[first:i])
                first, chars = i, 0
            chars += len(text)
        return out + self._slice(texts[first:]) if len(texts) > first else out

    def _plain(self, text: str) -> str:
        """The same text to a vocabulary that drops white space, with fewer distinct chunks."""
        text = text.replace("\n", " ")
        if self.lowers and "<|" not in text:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
            return text.lower()
        return text

    def _cut(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All bytes (one between texts, KEY behind), the chunks' starts and sizes, and the chunks up to each text."""
        text = np.frombuffer(b"\0".join([*raw, bytes(KEY)]), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
        space = text == 32
        cut = space.copy()
        if not self.drops_space:
            cut[1:] &= ~space[:-1]
            cut[:-1] &= ~space[1:]
            # The vocabulary has pieces of no-break spaces and spaces in turn.
            hard = np.flatnonzero((text[1:-1] == 0xA0) & (text[:-2] == 0xC2))
            cut[hard + 2] = False
            feed = np.flatnonzero(text[1:] == 10)
            cut[feed[(text[feed] > 32) & (text[feed] < 127)] + 1] = True
        if not any(b"<|" in r for r in raw):  # no special string that this could cut through
            cut[1:] |= _LETTER[text[:-1]] & _MARK[text[1:]]
        cut[np.append(0, ends[:-1] + 1)] = True
        cut[ends] = True  # the byte between two texts is no chunk
        cut[ends[-1] + 1 :] = False
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts, append=ends[-1] + 1)
        real = np.ones(len(starts), bool)
        real[np.searchsorted(starts, ends)] = False
        starts, sizes = starts[real], sizes[real]
        return text, starts, sizes, np.append(0, np.searchsorted(starts, ends))

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        if self.drops_space:
            texts = [self._plain(t) for t in texts]
        text, starts, sizes, upto = self._cut([t.encode() for t in texts])
        if self.new.full():
            self.old, self.new = self.new, ChunkTable(self.limit)
        table, old = self.new, self.old
        entry = np.empty(len(starts), np.int64)
        short = np.flatnonzero(sizes < KEY)
        keys = keys_of(text, starts[short], sizes[short])
        found = table.find(keys)
        lost = np.flatnonzero(found < 0)
        whole = text.tobytes() if len(lost) or len(short) < len(starts) else b""
        if len(lost):
            wanted, at, back = distinct_keys(keys[lost])
            fresh = np.empty(len(wanted), np.int64)
            known = old.find(wanted) if old else np.full(len(wanted), -1)
            again = known >= 0
            if again.any():  # what this stretch asks for again is taken over
                e = known[again]
                fresh[again] = table.add(old.ids[ragged(old.start[e], old.size[e])], old.size[e])
            ask = short[lost[at[~again]]]
            if len(ask):
                spans = zip(starts[ask].tolist(), (starts[ask] + sizes[ask]).tolist(), strict=True)
                fresh[~again] = self._asked(table, [whole[a:b].decode() for a, b in spans])
            table.enter(wanted, fresh)
            found[lost] = fresh[back]
        entry[short] = found
        far = np.flatnonzero(sizes >= KEY)
        if len(far):
            chunks = [whole[a:b] for a, b in zip(starts[far].tolist(), (starts[far] + sizes[far]).tolist(), strict=True)]
            here: dict[bytes, int] = {}
            ask = []
            for c in dict.fromkeys(chunks):
                if c in table.long:
                    here[c] = table.long[c]
                elif old and c in old.long:
                    e = old.long[c]
                    here[c] = int(table.add(old.ids[old.start[e] : old.start[e] + old.size[e]], old.size[e : e + 1])[0])
                    table.long[c] = here[c]
                else:
                    ask.append(c)
            for c, e in zip(ask, self._asked(table, [c.decode() for c in ask]).tolist(), strict=True):
                here[c] = e
                if len(c) <= MEMO_BYTES:
                    table.long[c] = e
            entry[far] = [here[c] for c in chunks]
        size = table.size[entry]
        ids = table.ids[ragged(table.start[entry], size)]
        cuts = np.append(0, np.cumsum(size))[upto].tolist()
        return [ids[a:b] for a, b in itertools.pairwise(cuts)]

    def _asked(self, table: ChunkTable, chunks: list[str]) -> np.ndarray:
        got = self.ask(chunks)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        return table.add(np.frombuffer(b"".join(got), "<u4"), sizes)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
