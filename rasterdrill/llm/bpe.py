"""Byte-level BPE over whole texts: speculate, verify, and merge exactly where that fails.

Texts are cut into words at the boundaries of the tokenizer's pattern, as numpy over
the code points of a block. Each distinct word of a block that is not known yet is
encoded once:

1. greedy longest match over a trie of the vocabulary proposes tokens, for all words
   side by side;
2. every pair of adjacent tokens is tested: both are taken apart in the reverse order
   of their merges, and no merge across their border may come before the merge that
   would use up either side. Tokens are the encoding of a word if and only if all of
   its adjacent pairs pass;
3. only words with a failing pair are merged exactly, lowest rank first. So are words
   above ``LONG_WORD`` bytes, with a heap, whose cost does not grow with the square.

Decoding gathers the bytes of the tokens. Every block is decoded again and compared
with its bytes, so a meeting of word hashes cannot pass; such a block is encoded
without the cache.

A special string in a text is its special token, as the library does by default.

Defined results: null is the empty text; an empty text has no tokens.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterdrill.llm import text as T

LONG_WORD = 512
# Words a task's cache holds before it starts anew (some 60 bytes each).
CACHE_WORDS = 1_000_000
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class Model(NamedTuple):
    """Tables of a vocabulary, as arrays; some 4 MB, so it can go to every task."""

    classes: np.ndarray  # of each code point: 1 letter, 2 number, 3 white space, 0 other
    byte_id: np.ndarray
    left: np.ndarray  # halves of each merged token, -1 for bytes
    right: np.ndarray
    rank: np.ndarray  # of the merge that makes the token, -1 for bytes
    pair_key: np.ndarray  # sorted left << 32 | right
    pair_rank: np.ndarray
    pair_id: np.ndarray
    edge_key: np.ndarray  # trie: sorted node << 8 | byte
    edge_to: np.ndarray
    node_id: np.ndarray  # token that ends at the node, or -1
    size: np.ndarray  # bytes of each token
    first: np.ndarray  # where its bytes begin
    data: np.ndarray
    special: dict[bytes, int]


def _classes(path: str) -> np.ndarray:
    """Classes of code points as the library's own pattern sees them.

    Letters and numbers by Python's Unicode table are probed against the library,
    whose table may be older.
    """
    from tokenizers import Tokenizer

    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        out[c] = {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 0)
    # The code points of Unicode's White_Space.
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    cut = Tokenizer.from_file(path).pre_tokenizer
    for kind, probe in ((1, "a"), (2, "1")):
        known = np.flatnonzero(out == kind)
        pieces = cut.pre_tokenize_str("".join(f"{probe}{chr(c)}\n" for c in known))
        starts = {s for _, (s, _) in pieces}
        out[[c for i, c in enumerate(known) if 3 * i + 1 in starts]] = 0
    return out


@cache
def load(path: str) -> Model:
    """Read a byte-level BPE vocabulary of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError("not a plain byte-level vocabulary")
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
    symbol = byte_symbols()
    of_symbol = {s: b for b, s in enumerate(symbol)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    n = max([*vocab.values(), *special.values()]) + 1
    raw = [b""] * n
    for t, i in vocab.items():
        raw[i] = t.encode() if t in special else bytes(of_symbol[c] for c in t)
    for t, i in special.items():
        raw[i] = t.encode()
    left, right, rank = (np.full(n, -1, np.int64) for _ in range(3))
    keys, ids = np.zeros(len(merges), np.int64), np.zeros(len(merges), np.int64)
    for r, (a, b) in enumerate(merges):
        i = vocab[a + b]
        left[i], right[i], rank[i] = vocab[a], vocab[b], r
        keys[r], ids[r] = vocab[a] << 32 | vocab[b], i
    whole = [i for t, i in vocab.items() if t not in special and (rank[i] >= 0 or len(raw[i]) == 1)]
    if any(rank[i] >= 0 and max(rank[left[i]], rank[right[i]]) >= rank[i] for i in whole):
        raise ValueError("a merge comes before the merges that make its halves")
    edges: dict[int, int] = {}
    ends = [-1]
    for i in whole:
        node = 0
        for b in raw[i]:
            key = node << 8 | b
            if key not in edges:
                edges[key] = len(ends)
                ends.append(-1)
            node = edges[key]
        ends[node] = i
    edge_key = np.fromiter(edges, np.int64, len(edges))
    edge_to = np.fromiter(edges.values(), np.int64, len(edges))
    by_edge, by_pair = np.argsort(edge_key), np.argsort(keys)
    size = np.array([len(x) for x in raw], np.int64)
    return Model(
        _classes(path), np.array([vocab[s] for s in symbol], np.int64), left, right, rank,
        keys[by_pair], by_pair.astype(np.int64), ids[by_pair], edge_key[by_edge], edge_to[by_edge],
        np.array(ends, np.int64), size, np.cumsum(size) - size,
        np.frombuffer(b"".join(raw), np.uint8), {t.encode(): i for t, i in special.items()},
    )


# --- words -------------------------------------------------------------------

def word_starts(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Byte offsets at which words begin: the pattern's matches, found for a block at once."""
    if not len(data):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    code = lead
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        def byte(k):
            return data[np.minimum(at[wide] + k, len(data) - 1)].astype(np.int32) & 0x3F

        b, b1 = lead[wide], byte(1)
        two = (b & 0x1F) << 6 | b1
        code = lead.copy()
        if b.max() >= 0xE0:
            b2 = byte(2)
            three = (b & 0x0F) << 12 | b1 << 6 | b2
            four = (b & 0x07) << 18 | b1 << 12 | b2 << 6 | byte(3)
            two = np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))
        code[wide] = two
    kind = model.classes[np.minimum(code, 0x10FFFF)]
    n = len(at)
    edge = np.searchsorted(at, offsets)  # characters at which texts begin, and n
    fresh = np.zeros(n + 1, bool)
    fresh[edge] = True
    fresh[0] = fresh[n] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= fresh[:n]
    # White space before a word of the same text: its last character is cut off, and a blank joins the word.
    after = np.flatnonzero(start & ~fresh[:n] & (kind != 3))
    after = after[kind[after - 1] == 3]
    start[after - 1] = True
    start[after[code[after - 1] == 0x20]] = False
    # An apostrophe that begins a word takes a short ending with it.
    quote = np.flatnonzero((code == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == 1) & ~fresh[quote + 1]]
    if len(quote):
        c1, c2 = code[quote + 1], code[np.minimum(quote + 2, n - 1)]
        one = np.isin(c1, [ord(c) for c in "stmd"])
        more = (quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)]
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (c1 == ord(a)) & (c2 == ord(b))
        two = pair & more & ~one
        for hit, length in ((one, 2), (two, 3)):
            q = quote[hit]
            start[q + 1] = False
            end = q + length
            end = end[end < n]
            start[end[~fresh[end]]] = True
            # What follows the ending begins a word; a blank or another class already did.
    # An ending may be followed by white space whose first character began a run anyway.
    return at[start]


def _specials(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Where special strings stand, none across texts."""
    if not model.special:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = data.tobytes()
    if not any(s in raw for s in model.special):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    find = re.compile(b"|".join(re.escape(s) for s in sorted(model.special, key=len, reverse=True)))
    begin, end = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        for m in find.finditer(raw, a, b):
            begin.append(m.start())
            end.append(m.end())
    return np.array(begin, np.int64), np.array(end, np.int64)


def cut_words(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Word starts, with every special string one word; what is around it are texts apart."""
    begin, end = _specials(data, offsets, model)
    if not len(begin):
        return word_starts(data, offsets, model)
    starts = word_starts(data, np.unique(np.concatenate([offsets, begin, end])), model)
    inside = np.searchsorted(begin, starts, "left") > np.searchsorted(end, starts, "right")
    return starts[~inside]


# --- encoding words ----------------------------------------------------------

def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: int) -> np.ndarray:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], missing)


def propose(data: np.ndarray, start: np.ndarray, end: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Greedy longest match: tokens of all words in order, and the number of each word's."""
    at = start.copy()
    todo = np.arange(len(start))
    turns: list[tuple[np.ndarray, np.ndarray]] = []
    while len(todo):
        token = model.byte_id[data[at[todo]]]
        node, walk, place = np.zeros(len(todo), np.int64), np.arange(len(todo)), at[todo]
        while len(walk):
            to = _lookup(model.edge_key, model.edge_to, node[walk] << 8 | data[place[walk]], -1)
            walk, to = walk[to >= 0], to[to >= 0]
            node[walk] = to
            ends = model.node_id[to]
            token[walk[ends >= 0]] = ends[ends >= 0]
            place[walk] += 1
            walk = walk[place[walk] < end[todo[walk]]]
        turns.append((todo, token))
        at[todo] += model.size[token]
        todo = todo[at[todo] < end[todo]]
    word = np.concatenate([w for w, _ in turns]) if turns else np.zeros(0, np.int64)
    token = np.concatenate([t for _, t in turns]) if turns else np.zeros(0, np.int64)
    order = np.argsort(word, kind="stable")
    return token[order], np.bincount(word, minlength=len(start))


def compatible(a: np.ndarray, b: np.ndarray, model: Model) -> np.ndarray:
    """Whether tokens ``a, b`` side by side are what BPE makes of their bytes."""
    ok = np.ones(len(a), bool)
    x, y = a.copy(), b.copy()
    until_x, until_y = np.full(len(a), _NONE), np.full(len(a), _NONE)
    todo = np.arange(len(a))
    while len(todo):
        u, v = x[todo], y[todo]
        across = _lookup(model.pair_key, model.pair_rank, u << 32 | v, _NONE)
        # The merge on the left goes first among equals, so it only loses to a lower rank.
        ok[todo] = (across == _NONE) | (across >= until_x[todo]) | (across > until_y[todo])
        ru, rv = model.rank[u], model.rank[v]
        open_ = ok[todo] & ((ru >= 0) | (rv >= 0))
        todo, u, v, ru, rv = todo[open_], u[open_], v[open_], ru[open_], rv[open_]
        take = ru > rv  # the younger of the two is taken apart
        i, j = todo[take], todo[~take]
        until_x[i], x[i] = ru[take], model.right[u[take]]
        until_y[j], y[j] = rv[~take], model.left[v[~take]]
    return ok


def merge(token: np.ndarray, word: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Exact merging of many words: all places of each word's lowest pair at a time."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(token):
        key = token[:-1] << 32 | token[1:]
        at = np.searchsorted(model.pair_key, key)
        at[at == len(model.pair_key)] = 0
        known = (model.pair_key[at] == key) & (word[:-1] == word[1:])
        rank = np.append(np.where(known, model.pair_rank[at], _NONE), _NONE)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(word)))
        closed = np.repeat(least == _NONE, size)
        if closed.any():
            done.append((token[closed], word[closed]))
            least, size = least[least < _NONE], size[least < _NONE]
            token, word, rank = token[~closed], word[~closed], rank[~closed]
            at = np.append(at, 0)[~closed]
            if not len(token):
                break
        else:
            at = np.append(at, 0)
        hit = rank == np.repeat(least, size)
        # Of places that overlap, every second one from the left.
        run = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
        begin = np.zeros(len(hit), np.int64)
        begin[run] = run
        begin = np.maximum.accumulate(begin)
        hit &= (np.arange(len(hit)) - begin) % 2 == 0
        place = np.flatnonzero(hit)
        token = token.copy()
        token[place] = model.pair_id[at[place]]
        keep = np.ones(len(token), bool)
        keep[place + 1] = False
        token, word = token[keep], word[keep]
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    token, word = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(word, kind="stable")
    return token[order], word[order]


def merge_long(raw: bytes, model: Model) -> list[int]:
    """Exact merging of one long word with a heap of pairs."""
    ids = model.byte_id[np.frombuffer(raw, np.uint8)].tolist()
    after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
    keys = np.array(ids[:-1], np.int64) << 32 | np.array(ids[1:], np.int64)
    ranks = _lookup(model.pair_key, model.pair_rank, keys, -1) if len(keys) else keys
    heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks.tolist()) if r >= 0]
    heapq.heapify(heap)
    made = _pairs(id(model.pair_key), model)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j] = made[a << 32 | b][1], -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for p, q in ((before[i], i), (i, after[i])):
            if p >= 0 and q >= 0 and (m := made.get(ids[p] << 32 | ids[q])):
                heapq.heappush(heap, (m[0], p, ids[p], ids[q]))
    return [t for t in ids if t >= 0]


_PAIRS: dict[int, dict] = {}


def _pairs(which: int, model: Model) -> dict[int, tuple[int, int]]:
    if which not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[which] = dict(zip(model.pair_key.tolist(), zip(model.pair_rank.tolist(), model.pair_id.tolist())))
    return _PAIRS[which]


def encode_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the given words in order, and the number of each word's."""
    n = len(start)
    long = np.flatnonzero(end - start > LONG_WORD)
    short = np.flatnonzero(end - start <= LONG_WORD)
    token, count = propose(data, start[short], end[short], model)
    word = np.repeat(np.arange(len(short)), count)
    if len(token) > 1:
        key = token[:-1] << 32 | token[1:]
        key[word[:-1] != word[1:]] = -1
        pairs, of = np.unique(key, return_inverse=True)
        good = np.ones(len(pairs), bool)
        real = pairs >= 0
        good[real] = compatible(pairs[real] >> 32, pairs[real] & 0xFFFFFFFF, model)
        failing = np.zeros(len(short), bool)
        failing[word[:-1][~good[of]]] = True
        if failing.any():
            bad = short[np.flatnonzero(failing)]
            size = end[bad] - start[bad]
            place = np.repeat(start[bad] - np.cumsum(size) + size, size) + np.arange(size.sum())
            t, w = merge(model.byte_id[data[place]], np.repeat(np.flatnonzero(failing), size), model)
            rest = ~failing[word]
            token, word = np.concatenate([token[rest], t]), np.concatenate([word[rest], w])
            order = np.argsort(word, kind="stable")
            token, word = token[order], word[order]
    word = short[word]
    extra_t, extra_w = [token], [word]
    for i in long:
        raw = data[start[i] : end[i]].tobytes()
        ids = [model.special[raw]] if raw in model.special else merge_long(raw, model)
        extra_t.append(np.array(ids, np.int64))
        extra_w.append(np.full(len(ids), i))
    if len(long):
        token, word = np.concatenate(extra_t), np.concatenate(extra_w)
        order = np.argsort(word, kind="stable")
        token, word = token[order], word[order]
    return token, np.bincount(word, minlength=n)


def decode(token: np.ndarray, model: Model) -> np.ndarray:
    """Bytes of a run of tokens."""
    size = model.size[token]
    total = int(size.sum())
    ends = np.cumsum(size)
    place = np.repeat(model.first[token] - ends + size, size)
    place += np.arange(total)
    return model.data[place]


class Encoder:
    """Encodes blocks of texts; each distinct word once while the cache holds it.

    ``words_to_tokens(data, start, end)`` encodes new words.
    """

    def __init__(self, model: Model, words_to_tokens: Callable | None = None):
        self.model = model
        self.new_words = words_to_tokens or (lambda d, s, e: encode_words(d, s, e, model))
        self._forget()

    def _forget(self):
        self.hash = np.zeros(0, np.uint64)
        self.place, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.recent: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _add(self, hashes: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(tokens) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(tokens)] = tokens
        place = self.used + np.cumsum(counts) - counts
        self.used += len(tokens)
        order = np.argsort(hashes)
        self.recent.append((hashes[order], place[order], counts[order].astype(np.int32)))
        if len(self.recent) >= 8 or not len(self.hash):
            parts = [(self.hash, self.place, self.count), *self.recent]
            h, p, c = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.hash, self.place, self.count = h[order], p[order], c[order]
            self.recent = []

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        todo = np.arange(len(hashes))
        for h, p, c in [(self.hash, self.place, self.count), *self.recent]:
            if not len(h) or not len(todo):
                continue
            at = np.searchsorted(h, hashes[todo])
            at[at == len(h)] = 0
            ok = h[at] == hashes[todo]
            place[todo[ok]], count[todo[ok]] = p[at[ok]], c[at[ok]]
            todo = todo[~ok]
        return place, count

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order (int32), and offsets of the texts in them."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        start = cut_words(data, offsets, self.model)
        end = np.append(start[1:], len(data))
        token, count = self._cached(data, start, end)
        whole = decode(token, self.model)
        if len(whole) != len(data) or not np.array_equal(whole, data):
            token, count = self._direct(data, start, end)
        at = np.zeros(n + 1, np.int64)
        run = np.append(0, np.cumsum(count))
        at[:] = run[np.searchsorted(start, offsets)]
        return token, at

    def _cached(self, data, start, end):
        hashes = T.hash_runs(data, end - start)
        distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hash) + len(distinct) > CACHE_WORDS:
            self._forget()
        place, count = self._find(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            s = first[new]
            tokens, counts = self._special_or_new(data, start[s], end[s])
            self._add(distinct[new], tokens, counts)
            place[new] = self.used - len(tokens) + np.cumsum(counts) - counts
            count[new] = counts
        count, place = count[of], place[of]
        ends = np.cumsum(count)
        gather = np.repeat(place - ends + count, count)
        gather += np.arange(len(gather))
        return self.pool[gather], count

    def _direct(self, data, start, end):
        tokens, counts = self._special_or_new(data, start, end)
        return tokens.astype(np.int32), counts

    def _special_or_new(self, data, start, end):
        """Special strings are tokens of their own; all other words are encoded."""
        special = {}
        for raw, i in self.model.special.items():
            for w in np.flatnonzero(end - start == len(raw)):
                if data[start[w] : end[w]].tobytes() == raw:
                    special[int(w)] = i
        if not special:
            return self.new_words(data, start, end)
        plain = np.array([w for w in range(len(start)) if w not in special], np.int64)
        token, count = self.new_words(data, start[plain], end[plain])
        word = np.concatenate([np.repeat(plain, count), list(special)]).astype(np.int64)
        token = np.concatenate([token, list(special.values())]).astype(np.int64)
        return token[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(start))


# --- tables ------------------------------------------------------------------

def _list_column(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of each text as an array of int; rows do not move."""
    model = docs.sparkSession.sparkContext.broadcast(load(path))
    keep = [c for c in docs.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Encoder(model.value)
        for batch in batches:
            data, offsets = T.flat(batch.column(text))
            for a, b in T.blocks(offsets):
                token, at = one.block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, _list_column(token, at)], [*keep, ids])

    out = docs.select(*keep, F.lit(None).cast("array<int>").alias(ids))
    return docs.select(*keep).mapInArrow(run, out.schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each text: ``key, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``).

    Hashes are lowercase hex: of the ids as little-endian unsigned 32-bit integers, and
    of the decoded text. The two steps share a pass, so ids need not travel.
    """
    from hashlib import sha256

    model = docs.sparkSession.sparkContext.broadcast(load(path))
    schema = f"{key} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Encoder(model.value)
        for batch in batches:
            data, offsets = T.flat(batch.column(1))
            for a, b in T.blocks(offsets):
                token, at = one.block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                whole = decode(token, model.value)
                size = np.append(0, np.cumsum(model.value.size[token]))[at].tolist()
                low, raw, cut = token.astype("<u4").tobytes(), whole.tobytes(), at.tolist()
                columns = [
                    batch.column(0).slice(a, b - a), pa.array(np.diff(at)),
                    pa.array([sha256(low[4 * i : 4 * j]).hexdigest() for i, j in zip(cut, cut[1:])]),
                    pa.array([sha256(raw[i:j]).hexdigest() for i, j in zip(size, size[1:])]),
                ]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, _list_column(token, at)], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(key).cast("bigint"), F.col(text))
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
