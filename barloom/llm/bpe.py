"""Byte-level BPE by speculation: propose tokens, verify pairs, merge the rest.

Each distinct word is first cut greedily into the longest vocabulary entries
(one Aho-Corasick pass over all new words of a batch). A cut is the true
encoding exactly if every pair of adjacent tokens is *compatible*, that is if
merging the bytes of the two tokens gives the two tokens again. That test is
vectorised: no merge may join a piece on the right edge of the left token with
a piece on the left edge of the right token while both pieces exist. Words with
a failing pair are merged exactly, by rank.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import resident, spread, text_batches, tidy

#: The byte-level pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.int64(1) << 40
NONE = 1 << 62
GAP = "Ā"  # stands between words; no byte maps to it


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves,
    the other bytes for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """A tokenizer read from the JSON text of a byte-level BPE file."""

    def __init__(self, text: bytes, cache_words: int = 300_000):
        spec = json.loads(text)
        byte = _byte_of()
        latin = lambda token: "".join(map(chr, (byte[c] for c in token)))
        self.ids = {latin(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(chain(self.ids.values(), self.special.values()))
        self.bytes = [b""] * size
        for t, i in self.ids.items():
            self.bytes[i] = t.encode("latin-1")
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.text = [str(i) for i in range(size)]
        self.size = size
        self.merges: dict[int, int] = {}  # pair -> (rank + 1) * size + new token
        left, right = np.full(size, -1), np.full(size, -1)
        born = np.full(size, -1, np.int64)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (latin(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            new = self.ids[a + b]
            self.merges[self.ids[a] * size + self.ids[b]] = (rank + 1) * size + new
            if born[new] >= 0:
                raise ValueError("a token with two derivations; pairs cannot be verified")
            left[new], right[new], born[new] = self.ids[a], self.ids[b], rank
        code = np.fromiter(self.merges, np.int64, len(self.merges))
        order = np.argsort(code)
        self.codes = code[order]
        self.ranks = np.fromiter(self.merges.values(), np.int64, len(code))[order] // size - 1
        self.right_edge, self.left_edge = self._edge(right, born), self._edge(left, born)
        self.single = [self.ids[chr(b)] for b in range(256)]
        self.machine = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.machine.add_word(t, (i, len(t)))
        self.machine.make_automaton()
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_words = cache_words

    @staticmethod
    def _edge(child: np.ndarray, born: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pieces on one edge of every token, outermost token first, each with
        the rank at which it is swallowed by the next larger piece."""
        piece, until, out = np.arange(len(child)), np.full(len(child), NEVER), []
        while (piece >= 0).any():
            out.append((piece, until))
            until = np.where(piece >= 0, born[piece], -1)
            piece = np.where(piece >= 0, child[piece], -1)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of tokens a and b gives a and b again."""
        good = np.ones(len(a), bool)
        for x, x_until in self.right_edge:
            left = x[a]
            if not (left >= 0).any():
                break
            for y, y_until in self.left_edge:
                right = y[b]
                open_ = np.flatnonzero((left >= 0) & (right >= 0) & good)
                if not len(open_):
                    break
                code = left[open_] * self.size + right[open_]
                k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                rank = np.where(self.codes[k] == code, self.ranks[k], NEVER)
                # of equal ranks the leftmost merge comes first
                good[open_[(rank < x_until[a[open_]]) & (rank <= y_until[b[open_]]) & (rank < NEVER)]] = False
        return good

    def merge(self, word: str) -> tuple[int, ...]:
        """Exact encoding of one Latin-1 word: lowest rank first, leftmost first."""
        ids = [self.single[c] for c in word.encode("latin-1")]
        return tuple(self._merge_short(ids) if len(ids) <= 48 else self._merge_long(ids))

    def _merge_short(self, ids: list[int]) -> list[int]:
        """By looking for the least rank again and again."""
        size, get = self.size, self.merges.get
        open_ = [get(a * size + b, NONE) for a, b in pairwise(ids)]
        while open_ and (least := min(open_)) != NONE:
            i = open_.index(least)
            ids[i] = least % size
            del ids[i + 1], open_[i]
            if i < len(open_):
                open_[i] = get(ids[i] * size + ids[i + 1], NONE)
            if i:
                open_[i - 1] = get(ids[i - 1] * size + ids[i], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """By a heap of pairs over a linked list: n log n for any length."""
        n, size, merges = len(ids), self.size, self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get(ids[i] * size + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            new = m % size
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := merges.get(new * size + ids[after[j]]):
                    heapq.heappush(heap, (m, i, new, ids[after[j]]))
            if (h := before[i]) >= 0 and (m := merges.get(ids[h] * size + new)):
                heapq.heappush(heap, (m, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode new words together and remember them."""
        cache, ids = self.cache, self.ids
        open_, latin = [], []
        for w in words:
            t = w.encode().decode("latin-1")
            if (i := ids.get(t)) is not None:
                cache[w] = (i,)  # a vocabulary entry always encodes as itself
            else:
                open_.append(w)
                latin.append(t)
        if not open_:
            return
        ends, found = [], []
        for end, (i, _) in self.machine.iter_long(GAP.join(latin)):
            ends.append(end)
            found.append(i)
        tokens, ends = np.array(found, np.int64), np.array(ends, np.int64)
        stops = np.cumsum([len(t) + 1 for t in latin])
        word = np.searchsorted(stops, ends, "right")
        bounds = np.searchsorted(word, np.arange(len(open_) + 1))
        inside = np.flatnonzero(word[1:] == word[:-1])
        pair = tokens[inside] * self.size + tokens[inside + 1]
        each, back = np.unique(pair, return_inverse=True)
        bad = ~self.compatible(each // self.size, each % self.size)[back]
        wrong = np.zeros(len(open_), bool)
        wrong[word[inside[bad]]] = True
        for k, w in enumerate(open_):
            cache[w] = self.merge(latin[k]) if wrong[k] else tuple(found[bounds[k] : bounds[k + 1]])

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text; strings of special tokens become their id.
        Collecting cycles pauses meanwhile: a batch makes very many tuples, and
        no cycles."""
        pause = gc.isenabled()
        gc.disable()
        try:
            return self._encode_batch(texts)
        finally:
            if pause:
                gc.enable()

    def _encode_batch(self, texts: list[str]) -> list[list[int]]:
        find, cache = self.words.findall, self.cache
        if len(cache) > self.cache_words:
            cache.clear()
        docs, new = [], set()
        for text in texts:
            if self.cut is not None and any(s in text for s in self.special):
                words: list[str | int] = []
                for part in self.cut.split(text):
                    words += [self.special[part]] if part in self.special else find(part)
            else:
                words = find(text)
            docs.append(words)
            new |= set(words).difference(cache)
        new = [w for w in new if isinstance(w, str)]
        self.learn(new)
        for s in self.special.values():
            cache[s] = (s,)
        out = [list(chain.from_iterable(map(cache.__getitem__, words))) for words in docs]
        for w in new:
            if len(w) > 64:
                del cache[w]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the decoded text; invalid UTF-8 becomes U+FFFD."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode()


def _model(spec: bytes) -> ByteBPE:
    return resident(("bpe", hashlib.sha256(spec).digest()), lambda: ByteBPE(spec))


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "decoded"), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every whole text and decode it again.

    ``outputs`` may name ``ids`` (array), ``decoded`` (text) and ``digests``
    (``ids_sha256`` of the decimal ids joined by commas, ``decoded_sha256`` of
    the UTF-8 text). ``n_tokens`` always comes. Null texts count as empty and
    give no tokens; repeated rows give repeated rows; an empty table gives no
    rows; a very long text is one row of a batch, and merging it takes n log n;
    other columns are not read. The tokenizer file is read on the driver and broadcast (about 2 MB);
    a worker's word cache is bounded.
    """
    spark = docs.sparkSession
    text_batches(spark)
    with open(path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()
    extra = {"ids": "ids array<int>", "decoded": "decoded string", "digests": "ids_sha256 string, decoded_sha256 string"}
    schema = ", ".join([f"{key} {kind}", "n_tokens bigint", *(extra[o] for o in outputs)])

    def run(batches):
        model = _model(spec.value)
        for batch in batches:
            ids = model.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            cols = {key: batch.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
            back = [model.decode(x) for x in ids]
            if "ids" in outputs:
                cols["ids"] = pa.array(ids, pa.list_(pa.int32()))
            if "decoded" in outputs:
                cols["decoded"] = pa.array([b.decode() for b in back], pa.string())
            if "digests" in outputs:
                name = model.text.__getitem__
                cols["ids_sha256"] = pa.array([hashlib.sha256(",".join(map(name, x)).encode()).hexdigest() for x in ids])
                cols["decoded_sha256"] = pa.array([hashlib.sha256(b).hexdigest() for b in back])
            yield pa.RecordBatch.from_pydict(cols)

    return spread(docs.select(key, text)).mapInArrow(tidy(run, keep=True), schema)
