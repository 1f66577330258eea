"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each symbol of a piece owns a leaf that holds rank * width + position of the pair that it begins. The root is the least
of them: the lowest rank, and of equal ranks the leftmost pair. A merge changes three leaves (the merged pair, its left
neighbour and the symbol that vanishes) and their ancestors, so it costs the logarithm of the width. Many pieces of a
similar width are merged in step: one row of a numpy array is one tree.

:class:`Vocabulary` reads a tokenizer's public file. :class:`WordCoder` encodes whole texts by their distinct words.

Defined results: null and empty texts have no ids; words of any length are merged by the same tree; the strings of the
special tokens in a text are their ids, as in the file's own library; repeated rows get equal results.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hairpin.llm.batches import Texts, arrow_rows, map_texts, slices, span_hashes

#: Tree entries that are merged at once.
TREE_ENTRIES = 1 << 20
#: Words that a worker remembers; beyond them it starts anew.
MEMO_WORDS = 1_000_000
_NONE = np.int64(1) << 62


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """Merges, ids and token strings of a tokenizers file with a BPE model."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids |= self.special
        self.suffix = model.get("end_of_word_suffix") or ""
        size = max(self.ids.values()) + 1
        self.strings = [""] * size
        for token, i in self.ids.items():
            self.strings[i] = token
        letters = byte_letters()
        self.base = np.array([self.ids[x] for x in letters], np.int64)
        self.last = np.array([self.ids[x + self.suffix] for x in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([self.ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self._keys, self._ranks = key[order], order
        self.merged = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        # an open hash table over the pairs, as one lookup costs less than a binary search
        self._bits = 18
        self._slot_key = np.full(1 << self._bits, -1, np.int64)
        self._slot_rank = np.zeros(1 << self._bits, np.int64)
        todo, at = np.arange(len(self._keys)), self._hash(self._keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self._slot_key[at] < 0
            cand, where = todo[free], at[free]
            _, pick = np.unique(where, return_index=True)
            self._slot_key[where[pick]], self._slot_rank[where[pick]] = self._keys[cand[pick]], self._ranks[cand[pick]]
            left_over = np.ones(len(todo), bool)
            left_over[np.flatnonzero(free)[pick]] = False
            todo, at = todo[left_over], (at[left_over] + 1) & ((1 << self._bits) - 1)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; -1 where they don't merge or one of them is below 0."""
        key = (left << 20) | right
        out, at = np.full(key.shape, -1, np.int64), self._hash(key)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            slot = at[todo]
            there = self._slot_key[slot]
            hit = there == key[todo]
            out[todo[hit]] = self._slot_rank[slot[hit]]
            todo = todo[~hit & (there >= 0)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self._bits) - 1)
        return out


def merge(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, begin, count): the ids of piece i (a whole word: its last byte carries the vocabulary's end-of-word suffix) are
    ids[begin[i]:begin[i] + count[i]]."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    begin, count, found, used = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [np.zeros(0, np.int64)], 0
    for bits in range(int(lengths.max(initial=0)).bit_length() + 1):
        width = 1 << bits
        of = np.flatnonzero((lengths <= width) & (lengths > width // 2))
        step = max(1, TREE_ENTRIES // (2 * width))
        for a in range(0, len(of), step):
            part = of[a : a + step]
            ids, count[part] = _merge(vocabulary, [pieces[k] for k in part.tolist()], lengths[part], bits)
            begin[part] = used + np.cumsum(count[part]) - count[part]
            found.append(ids)
            used += len(ids)
    return np.concatenate(found), begin, count


def _merge(v: Vocabulary, pieces: list[bytes], lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, width = len(pieces), 1 << bits
    row = np.arange(n)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    column = np.arange(width)
    symbol = np.where(column < lengths[:, None], v.base[raw], -1)
    symbol[row, lengths - 1] = v.last[raw[row, lengths - 1]]
    if width > 1:
        # next and previous living symbol of each; `width` and -1 stand for none
        after = np.where(column + 1 < lengths[:, None], column + 1, width)
        before = np.tile(column - 1, (n, 1))
        tree = np.full((n, 2 * width), _NONE, np.int64)
        rank = v.rank(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, width - 1)
        tree[:, width : 2 * width - 1] = np.where(rank >= 0, rank * width + column[:-1], _NONE)
        for level in range(bits - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        live = row
        while True:
            root = tree[live, 1]
            some = root < _NONE
            live, root = live[some], root[some]
            if not len(live):
                break
            at = root & (width - 1)
            gone = after[live, at]
            symbol[live, at] = v.merged[root >> bits]
            symbol[live, gone] = -1
            follow = after[live, gone]
            after[live, at] = follow
            inner = follow < width
            before[live[inner], follow[inner]] = at[inner]
            prior = before[live, at]
            m = len(live)
            # the pair that the merged symbol begins, the one that it ends, and the one that vanished
            has_prior = prior >= 0
            rows2 = np.concatenate([live, live])
            leaf2 = np.concatenate([at, np.where(has_prior, prior, at)])
            right2 = np.concatenate([follow, np.where(has_prior, at, follow)])
            right_symbol = np.where(right2 < width, symbol[rows2, np.minimum(right2, width - 1)], -1)
            r = v.rank(symbol[rows2, leaf2], right_symbol)
            value = np.where(r >= 0, (r << bits) | leaf2, _NONE)
            tree[rows2, width + leaf2] = value
            tree[live, width + gone] = _NONE
            rows3 = np.concatenate([rows2, live])
            node = np.concatenate([leaf2, gone]) + width
            for _ in range(bits):
                node >>= 1
                tree[rows3, node] = np.minimum(tree[rows3, 2 * node], tree[rows3, 2 * node + 1])
            del m
    alive = symbol >= 0
    return symbol[alive], alive.sum(1)


#: The split pattern and the normalisation that the word-end vocabulary's file states.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+|\n")


def normalised(text: str) -> str:
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    # letter by letter: no final form of sigma
    return text.replace("Σ", "σ").lower()


class Memo:
    """Ids of up to ``limit`` words by hash, in an open table."""

    def __init__(self, limit: int):
        self.limit, self._mask = limit, (1 << (2 * limit - 1).bit_length()) - 1
        self.size = self.used = 0
        self._key, self._word = np.zeros(self._mask + 1, np.uint64), np.zeros(self._mask + 1, np.int32)
        self.begin, self.count, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.int32)

    def _at(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(self._mask)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, or -1; hashes aren't 0."""
        out, todo, at = np.full(len(h), -1, np.int64), np.arange(len(h)), self._at(h)
        while len(todo):
            there = self._key[at]
            hit = there == h[todo]
            out[todo[hit]] = self._word[at[hit]]
            on = ~hit & (there != 0)
            todo, at = todo[on], (at[on] + 1) & self._mask
        return out

    def add(self, h: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        """Distinct new words with their ids, one word's after the other's; no more than there is room for."""
        n, m = self.size + len(h), self.used + len(flat)
        self.begin, self.count, self.flat = _room(self.begin, n), _room(self.count, n), _room(self.flat, m)
        self.begin[self.size : n], self.count[self.size : n], self.flat[self.used : m] = self.used + np.cumsum(count) - count, count, flat
        todo, at = np.arange(len(h)), self._at(h)
        while len(todo):
            free = np.flatnonzero(self._key[at] == 0)
            slot, pick = np.unique(at[free], return_index=True)
            own = todo[free[pick]]
            self._key[slot], self._word[slot] = h[own], self.size + own
            on = np.ones(len(todo), bool)
            on[free[pick]] = False
            todo, at = todo[on], (at[on] + 1) & self._mask
        self.size, self.used = n, m


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


class WordCoder:
    """Encodes whole texts; remembers the ids of the words that it has met, up to a slice's words or MEMO_WORDS.

    Which code points are letters or numbers, and how they are lower-cased, depends on the Unicode tables of a program's version. Each code point
    beyond ASCII is held against the file's own library when it is first met; a word with one that is taken otherwise there is encoded
    by the library.
    """

    def __init__(self, vocabulary: Vocabulary, memo_words: int = MEMO_WORDS):
        self.vocabulary, self.memo_words, self.memo = vocabulary, memo_words, Memo(memo_words)
        self._special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self._checked: set[str] = set()
        self._odd: set[str] = set()

    def spans(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, first) of the parts that are encoded each by itself: words between ASCII white space."""
        return texts.words()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.vocabulary.path)
        whole.no_truncation()
        whole.no_padding()
        return whole

    def odd(self, text: str) -> set[str]:
        """The characters of a text that the library takes otherwise than the pattern and the normalisation here."""
        chars = set(text)
        for c in chars - self._checked:
            self._checked.add(c)
            if c > "\x7f" and not self._alike(f"a{c}{c}b"):
                self._odd.add(c)
        return chars & self._odd

    def _alike(self, text: str) -> bool:
        known = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        letters = byte_letters()
        return [p for p, _ in known] == ["".join(letters[b] for b in p.encode()) for p in _PIECES.findall(normalised(text))]

    def encode_parts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one part after the other, the number of each) of words without ASCII white space."""
        v = self.vocabulary
        index: dict[str | int, int] = {"\n": 0}
        # all words as lines of one text; the special tokens in them are parted from it first
        size = end - start + 1
        total = np.cumsum(size)
        lines = data[np.minimum(np.arange(total[-1]) + np.repeat(start - (total - size), size), len(data) - 1)]
        lines[total - 1] = 10
        text = lines.tobytes().decode("utf-8", "replace")
        codes: list[int] = []

        def take(plain: str) -> None:
            for part in self._special.split(plain) if self._special and "<|" in plain else [plain]:
                if part in v.special:
                    codes.append(index.setdefault(v.special[part], len(index)))
                else:
                    codes.extend(index.setdefault(p, len(index)) for p in _PIECES.findall(normalised(part)))

        if odd := self.odd(text):
            plain: list[str] = []
            for word in text.split("\n")[:-1]:
                if odd.isdisjoint(word):
                    plain.append(word + "\n")
                    continue
                take("".join(plain))
                plain = []
                codes += [index.setdefault(i, len(index)) for i in self.library.encode(word, add_special_tokens=False).ids]
                codes.append(0)
            text = "".join(plain)
        take(text)
        keys = list(index)
        words = [i for i, x in enumerate(keys) if i and isinstance(x, str)]
        ids, begin, count = merge(v, [keys[i].encode() for i in words])
        own = np.array([i for i, x in enumerate(keys) if not isinstance(x, str)], np.int64)
        first, many = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[words], many[words] = begin, count
        first[own], many[own] = len(ids) + np.arange(len(own)), 1
        ids = np.concatenate([ids, np.array([keys[i] for i in own.tolist()], np.int64)])
        code = np.array(codes, np.int64)
        n = many[code]
        before = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat(first[code] - before[:-1], n) + np.arange(before[-1])]
        return flat.astype(np.int32), np.diff(before[np.concatenate([[0], np.flatnonzero(code == 0) + 1])])

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): document i's ids are ids[first[i]:first[i + 1]]."""
        start, end, first = self.spans(texts)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        h = np.maximum(span_hashes(texts.data, start, end), np.uint64(1))
        memo, of = self.memo, self.memo.find(h)
        missing = np.flatnonzero(of < 0)
        if len(missing):
            new, sample = np.unique(h[missing], return_index=True)
            if memo.size + len(new) > memo.limit:
                # a slice needs the ids of all its words at once
                new, sample = np.unique(h, return_index=True)
                missing, memo = np.arange(len(h)), Memo(max(self.memo_words, len(new)))
                self.memo = memo
            memo.add(new, *self.encode_parts(texts.data, start[missing[sample]], end[missing[sample]]))
            of = memo.find(h)
        begin, count = memo.begin[of], memo.count[of]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = memo.flat[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return ids, total[first]


#: One coder for each file and worker; tasks that share a worker share what it has learned.
_CODERS: dict[tuple[str, type], WordCoder] = {}


def coder(path: str, kind: Callable[[Vocabulary], WordCoder] = WordCoder) -> WordCoder:
    if (path, kind) not in _CODERS:
        _CODERS[path, kind] = kind(Vocabulary(path))
    return _CODERS[path, kind]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ids array<int>; it replaces a column so named."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for part, texts in slices(batches):
            ids, first = c.encode(texts)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.ListArray.from_arrays(first.astype(np.int32), ids)], names=["row", "ids"])

    return map_texts(docs, text, "ids array<int>", run)


def decode_strings(strings: list[bytes], ids: list[int]) -> bytes:
    """What the library's decode gives for a file without a decoder: the tokens joined by a space."""
    return b" ".join(map(strings.__getitem__, ids))


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_tokens and the SHA-256 of its ids and of the text decoded from them."""
    from hashlib import sha256

    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        strings = [x.encode() for x in c.vocabulary.strings]
        numbers = [b"%d" % i for i in range(len(strings))]
        for part, texts in slices(batches, text):
            ids, first = c.encode(texts)
            a, b = [], []
            for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = ids[x:y].tolist()
                a.append(sha256(b" ".join(map(numbers.__getitem__, own))).hexdigest())
                b.append(sha256(decode_strings(strings, own)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(np.diff(first)), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[doc_id, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(doc_id, text).mapInArrow(run, f"{doc_id} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
