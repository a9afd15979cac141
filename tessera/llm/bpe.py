"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each word is a row of symbols; leaf i of its tree holds rank * leaves + i of the pair that starts at symbol i, so the
root is the lowest rank and, among equals, the leftmost place. A merge changes three leaves, each updated up to the
root; a word is done when its root is empty. Words of similar length are merged together as rows of numpy arrays, and
long ones alone. Letters, numbers and case are those of the Unicode version that Python knows. Texts are mapped where they lie: no shuffle, and the vocabulary, a fixed file, is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Collection
from functools import cached_property

import numpy as np
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import map_rows

NONE = np.int64(2**62)
#: Words with more symbols than this are merged one at a time.
ROWS_UP_TO = 256
#: Words remembered between batches by a Python worker: two generations of this many, or of a group's words.
REMEMBERED = 120_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next unused code point from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in own else next(other)) for b in range(256)]


class Bpe:
    """A BPE with an end-of-word suffix and a byte-level alphabet, from the text of a tokenizers file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.base = len(self.names) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.words = regex.compile(split.replace(r"[^\s", "[^" + space))
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._new: dict[str, tuple[int, str, str]] = {}
        self._old: dict[str, tuple[int, str, str]] = {}

    @cached_property
    def rank_of(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def symbols(self, word: bytes) -> np.ndarray:
        b = np.frombuffer(word, np.uint8)
        return np.append(self.inner[b[:-1]], self.last[b[-1]])

    def merge_one(self, word: bytes) -> list[int]:
        """The merges of one word, of any length, in plain Python."""
        sym = self.symbols(word).tolist()
        n = len(sym)
        leaves = 1 << max(n - 1, 1).bit_length()
        none, rank_of, base, made = int(NONE), self.rank_of, self.base, self.made
        tree = [none] * (2 * leaves)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def key(i: int) -> int:
            j = nxt[i]
            r = rank_of.get(sym[i] * base + sym[j]) if j < n else None
            return none if r is None else r * leaves + i

        for i in range(n):
            tree[leaves + i] = key(i)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, k: int) -> None:
            i += leaves
            tree[i] = k
            while i > 1:
                i >>= 1
                m = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == m:
                    break
                tree[i] = m

        while tree[1] < none:
            rank, i = divmod(tree[1], leaves)
            j = nxt[i]
            sym[i], nxt[i] = int(made[rank]), nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            put(j, none)
            put(i, key(i))
            if prv[i] >= 0:
                put(prv[i], key(prv[i]))
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = nxt[i]
        return out

    def _merge_rows(self, words: list[bytes], leaves: int) -> list[list[int]]:
        """The merges of words of 2 to `leaves` symbols, row by row of one array."""
        w = len(words)
        size = np.array([len(x) for x in words])
        flat = np.frombuffer(b"".join(x.ljust(leaves, b"\0") for x in words), np.uint8).reshape(w, leaves)
        sym = np.zeros((w, leaves + 1), np.int64)
        sym[:, :leaves] = self.inner[flat]
        every = np.arange(w)
        sym[every, size - 1] = self.last[flat[every, size - 1]]
        place = np.arange(leaves)
        nxt = np.tile(place + 1, (w, 1))
        prv = np.tile(np.arange(-1, leaves), (w, 1))
        tree = np.full((w, 2 * leaves), NONE)
        rank = self._rank(sym[:, :-1], sym[:, 1:])
        rank[place[None, :] >= size[:, None] - 1] = NONE
        tree[:, leaves:] = np.where(rank < NONE, rank * leaves + place, NONE)
        for level in range(leaves.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        live = np.flatnonzero(tree[:, 1] < NONE)

        def put(rows, i, key):
            i = i + leaves
            tree[rows, i] = key
            while leaves > 1 and i.size and i[0] > 1:
                i = i >> 1
                tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])

        def keys(rows, i):
            j = nxt[rows, i]
            ok = j < size[rows]
            r = self._rank(sym[rows, i], sym[rows, np.where(ok, j, 0)])
            return np.where(ok & (r < NONE), r * leaves + i, NONE)

        while live.size:
            r, i = np.divmod(tree[live, 1], leaves)
            j = nxt[live, i]
            k = nxt[live, j]
            sym[live, i] = self.made[r]
            nxt[live, i] = k
            prv[live, np.minimum(k, leaves)] = i
            put(live, j, NONE)
            put(live, i, keys(live, i))
            before = prv[live, i]
            has = before >= 0
            rows, p = live[has], before[has]
            put(rows, p, keys(rows, p))
            live = live[tree[live, 1] < NONE]
        # A symbol stands where following the links from 0 arrives: it is the next of its own predecessor.
        alive = place[None, :] < size[:, None]
        first = np.zeros((w, leaves), bool)
        first[:, 0] = True
        at = np.zeros(w, np.int64)
        rows = every
        while rows.size:
            at = nxt[rows, at]
            more = at < size[rows]
            rows, at = rows[more], at[more]
            first[rows, at] = True
        keep = first & alive
        ids, ends = sym[:, :leaves][keep].tolist(), np.cumsum(keep.sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each non-empty word."""
        out: list[list[int]] = [[]] * len(words)
        groups: dict[int, list[int]] = {}
        for i, x in enumerate(words):
            if len(x) == 1:
                out[i] = [int(self.last[x[0]])]
            elif len(x) > ROWS_UP_TO:
                out[i] = self.merge_one(x)
            else:
                groups.setdefault(1 << (len(x) - 1).bit_length(), []).append(i)
        for leaves, members in groups.items():
            step = max(1, (1 << 18) // leaves)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                for i, ids in zip(part, self._merge_rows([words[i] for i in part], leaves), strict=True):
                    out[i] = ids
        return out

    def split(self, text: str) -> list[str]:
        """Words and special tokens in order: special tokens as they stand, the rest composed (NFC) and lower-cased letter by letter."""
        if self.marks and "<|" in text:
            parts = self.marks.split(text)
        else:
            parts = [text]
        out: list[str] = []
        for i, p in enumerate(parts):
            if i % 2:
                out.append(p)
            elif p:
                out += self.words.findall(unicodedata.normalize("NFC", p).replace("Σ", "σ").lower())
        return out

    def remember(self, words: set[str]) -> dict[str, tuple[int, str, str]]:
        """For each word: the number of its ids, the ids and their decoding as text."""
        new, old, got, add, todo = self._new, self._old, {}, {}, []
        for x in words:
            hit = new.get(x)
            if hit is None:
                hit = old.get(x)
                if hit is None:
                    todo.append(x)
                    continue
                add[x] = hit
            got[x] = hit
        written, names = self._written
        for x, ids in zip(todo, self._encode_set(todo), strict=True):
            got[x] = add[x] = (len(ids), " ".join([written[i] for i in ids]), " ".join([names[i] for i in ids]))
        if len(new) + len(add) > REMEMBERED:
            self._old, self._new = new, add
        else:
            new.update(add)
        return got

    @cached_property
    def _written(self) -> tuple[list[str], list[str]]:
        """Each id as decimal text, and its token's string."""
        ids = range(max(self.names) + 1)
        return [str(i) for i in ids], [self.names.get(i, "") for i in ids]

    def encode(self, text: str | None) -> list[int]:
        words = self.split(text or "")
        of = dict(zip(set(words), self._encode_set(set(words)), strict=True))
        return [i for x in words for i in of[x]]

    def _encode_set(self, words: Collection[str]) -> list[list[int]]:
        plain = [x for x in words if x not in self.special]
        of = dict(zip(plain, self.encode_words([x.encode() for x in plain]), strict=True))
        return [of[x] if x in of else [self.special[x]] for x in words]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, the token strings joined by spaces; unknown ids are left out."""
        names = self.names
        return " ".join(names[i] for i in ids if i in names)

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Per text: the number of ids, SHA-256 of the ids joined by spaces and of the decoded text."""
        split = [self.split(t or "") for t in texts]
        out = []
        # Texts are taken in groups, so that the words known at one time stay bounded.
        a = 0
        while a < len(split):
            b, words = a, set()
            while b < len(split) and (b == a or len(words) < REMEMBERED):
                words.update(split[b])
                b += 1
            of = self.remember(words)
            for doc in split[a:b]:
                n, ids, text = zip(*[of[x] for x in doc], strict=True) if doc else ((), (), ())
                out.append((sum(n), *(hashlib.sha256(" ".join(v).encode()).hexdigest() for v in (ids, text))))
            a = b
        return out


def default_path() -> str:
    """The word-level vocabulary among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LOADED: dict[str, Bpe] = {}


def _loaded(text: str) -> Bpe:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(text)
    return _LOADED[key]


def _vocabulary(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids): the ids of every whole text; a null or empty text has none. path: a tokenizers file."""
    send = _vocabulary(docs, path)
    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", "text"), lambda k, t: [(a, _loaded(send.value).encode(x)) for a, x in zip(k, t, strict=True)], f"doc_id {kind}, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids)."""
    send = _vocabulary(ids, path)
    kind = dict(ids.dtypes)["doc_id"]
    return map_rows(ids.select("doc_id", "ids"), lambda k, v: [(a, _loaded(send.value).decode(x or [])) for a, x in zip(k, v, strict=True)], f"doc_id {kind}, text string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), encoding and decoding every whole text in one pass.

    A null or empty text has no ids and the digests of the empty text. Repeated rows get equal rows; an empty table gives
    no rows, and other columns are ignored.
    """
    send = _vocabulary(docs, path)
    kind = dict(docs.dtypes)["doc_id"]

    def run(doc_id, text):
        bpe = _loaded(send.value)
        for a in range(0, len(text), 256):
            for k, row in zip(doc_id[a : a + 256], bpe.digests(text[a : a + 256]), strict=True):
                yield k, *row

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
