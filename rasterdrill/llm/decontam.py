"""Benchmark decontamination: test suffixes searched in suffix arrays of training shards.

A shard is a block of documents inside a task. Its suffix array holds the word
suffixes that begin with two words some test window begins with (a sparse suffix
array: no other suffix can match), sorted by their first ``window`` words as vocabulary
numbers. Every suffix of every test item is found in it by binary search; the range of
equal suffixes gives the places of verbatim matches, and comparing on from each place
gives their full length.

The items, not the documents, go to every task: in blocks of at most
``ITEM_BYTES``, which the documents pass one after another in the same stage. Documents
never move and their order is kept.

Words are lower-cased (A-Z) runs of ASCII letters, digits and bytes above 127. An item
of fewer words than a window, but not none, is one window; matches never cross documents.

Defined results: a null text has no words and is clean; an item without words takes no
part; equal items are found alike. An item without an id is searched like any other: its
words are hit, and only the list of ids leaves it out. Without documents or items the
result is empty or finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterdrill.llm import text as T

NO_ID = -(1 << 63)  # stands for an item without an id: its words are hit, the lists of ids leave it out
WINDOW = 10
# Bytes of item texts in one broadcast.
ITEM_BYTES = 4 << 20


class Items(NamedTuple):
    """Test suffixes of one block of items."""

    vocab: np.ndarray  # sorted word hashes; a word's number is its place plus one
    word: np.ndarray  # numbers of all words of all items
    item: np.ndarray  # number of each word's item
    ids: np.ndarray  # id of each item
    keys: np.ndarray  # distinct windows as rows of numbers, 0 after a short one
    length: np.ndarray  # words of each distinct window
    of_item: np.ndarray  # items of each distinct window, one after the other
    of_start: np.ndarray
    at_word: np.ndarray  # first word of one occurrence of each distinct window
    pairs: np.ndarray  # sorted codes of the first two words of windows
    single: np.ndarray  # by word number: it is a window of its own
    window: int


def prepare(ids: list[int], texts: list[str], window: int) -> Items:
    data, offsets = T.flat(pa.array(texts, pa.string()))
    w = T.words(T.LOWER[data], offsets, T.ALNUM)
    vocab = np.unique(w.hash)
    word = (np.searchsorted(vocab, w.hash) + 1).astype(np.int64)
    count = np.bincount(w.text, minlength=len(ids)) if len(word) else np.zeros(len(ids), np.int64)
    begin = np.cumsum(count) - count
    n = np.where(count >= window, count - window + 1, np.minimum(count, 1))
    size = np.repeat(np.minimum(count, window), n)
    first = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item = np.repeat(np.arange(len(ids)), n)
    rows = np.zeros((len(first), window), np.int64)
    for j in range(window):
        here = size > j
        rows[here, j] = word[first[here] + j]
    if len(rows):
        keys, at, of = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        both = np.unique(np.stack([of.ravel(), item], 1), axis=0)
        of_start = np.searchsorted(both[:, 0], np.arange(len(keys) + 1))
        of_item, length, at_word = both[:, 1], size[at], first[at]
    else:
        keys, of_item, of_start = rows, np.zeros(0, np.int64), np.zeros(1, np.int64)
        length, at_word = np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = len(vocab) + 1
    two = keys[length > 1] if window > 1 else keys[:0]
    pairs = np.unique(two[:, 0] * base + two[:, 1]) if len(two) else np.zeros(0, np.int64)
    single = np.zeros(base, bool)
    single[keys[length == 1, 0]] = True
    return Items(vocab, word, w.text, np.array(ids, np.int64), keys, length, of_item, of_start, at_word, pairs, single, window)


def _as_bytes(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings of the same order."""
    wide = np.ascontiguousarray(rows.astype(">u4"))
    return wide.view(f"S{4 * rows.shape[1]}").ravel()


class Shard:
    """Words of a block of documents and its sparse suffix array."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, items: Items):
        self.items = items
        w = T.words(T.LOWER[data], offsets, T.ALNUM)
        self.text = w.text
        at = np.searchsorted(items.vocab, w.hash)
        if len(items.vocab):
            at[at == len(items.vocab)] = 0
            self.word = np.where(items.vocab[at] == w.hash, at + 1, 0)
        else:
            self.word = np.zeros(len(w.hash), np.int64)
        self.count = np.bincount(w.text, minlength=len(offsets) - 1) if len(w.text) else np.zeros(len(offsets) - 1, np.int64)
        n, window = len(self.word), items.window
        heads = items.single[self.word] & (self.word > 0)
        if n > 1 and len(items.pairs):
            i = np.flatnonzero((self.word[:-1] > 0) & (self.word[1:] > 0) & (self.text[:-1] == self.text[1:]))
            code = self.word[i] * (len(items.vocab) + 1) + self.word[i + 1]
            found = np.searchsorted(items.pairs, code)
            found[found == len(items.pairs)] = 0
            heads[i[items.pairs[found] == code]] = True
        start = np.flatnonzero(heads)
        rows = np.zeros((len(start), window), np.int64)
        open_ = np.ones(len(start), bool)
        for j in range(window):  # a word outside the vocabulary, or the end, is 0 and stops the suffix
            here = np.minimum(start + j, max(n - 1, 0))
            open_ &= (start + j < n) & (self.text[here] == self.text[start]) & (self.word[here] > 0)
            rows[open_, j] = self.word[here[open_]]
        order = np.lexsort(rows.T[::-1]) if len(start) else np.zeros(0, np.int64)
        self.suffix, self.sorted = start[order], _as_bytes(rows[order]) if len(start) else np.zeros(0, f"S{4 * window}")

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Every (distinct test window, word at which it occurs), by binary search."""
        it = self.items
        if not len(self.suffix) or not len(it.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = np.searchsorted(self.sorted, _as_bytes(it.keys), "left")
        last = it.keys.copy()
        last[np.arange(it.window)[None, :] >= it.length[:, None]] = 0xFFFFFFFF
        high = np.searchsorted(self.sorted, _as_bytes(last), "right")
        n = high - low
        key = np.repeat(np.arange(len(n)), n)
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return key, self.suffix[at]

    def lengths(self, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words that match from each place on, to the end of the item or document."""
        it = self.items
        out = it.length[key].copy()
        todo = np.arange(len(key))
        while len(todo):
            i, j = it.at_word[key[todo]] + out[todo], place[todo] + out[todo]
            ok = (i < len(it.word)) & (j < len(self.word))
            i, j = np.where(ok, i, 0), np.where(ok, j, 0)
            ok &= (it.item[i] == it.item[it.at_word[key[todo]]]) & (self.text[j] == self.text[place[todo]])
            ok &= it.word[i] == self.word[j]
            todo = todo[ok]
            out[todo] += 1
        return out


def _hits(shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags of hit words, and the distinct (document, item) pairs."""
    key, place = shard.places()
    it = shard.items
    edge = np.zeros(len(shard.word) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + it.length[key], -1)
    hit = np.cumsum(edge[:-1]) > 0
    pair = np.unique(shard.text[place] * max(1, len(it.keys)) + key) if len(key) else np.zeros(0, np.int64)
    doc, key = pair // max(1, len(it.keys)), pair % max(1, len(it.keys))
    n = it.of_start[key + 1] - it.of_start[key] if len(key) else np.zeros(0, np.int64)
    at = np.repeat(it.of_start[key] - (np.cumsum(n) - n), n) + np.arange(n.sum()) if len(key) else n
    both = np.unique(np.stack([np.repeat(doc, n), it.ids[it.of_item[at]]], 1), axis=0) if len(key) else np.zeros((0, 2), np.int64)
    return hit, both[:, 0], both[:, 1]


def item_blocks(items: DataFrame, window: int, key: str | None, text: str, limit: int = ITEM_BYTES) -> Iterator[Items]:
    """Distinct items in blocks of about ``limit`` bytes; there is at least one block.

    An item without an id, or all without a ``key``, has the number ``NO_ID``.
    """
    number = F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)) if key else F.lit(NO_ID)
    rows = items.select(number.alias("i"), F.col(text).alias("t")).filter("t IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-2 * total // limit)) if total > limit else 1
    for block in range(n):
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == block)
        got = sorted(own.collect())  # at most about ``limit`` bytes
        yield prepare([r["i"] for r in got], [r["t"] for r in got], window)


def mark(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", limit: int = ITEM_BYTES,
) -> DataFrame:
    """``key, n_words, spans, items``: runs of hit words ``[first, last]`` and ids of items found."""
    spark = docs.sparkSession
    out = None
    kind = "array<struct<first:int,last:int>>"
    for block in item_blocks(items, window, item_key, item_text, limit):
        shared = spark.sparkContext.broadcast(block)
        schema = f"{key} bigint, text string, n_words bigint, spans {kind}, items array<bigint>"
        if out is None:
            out = docs.select(
                F.col(key).cast("bigint").alias(key), F.col(text).alias("text"), F.lit(0).cast("bigint").alias("n_words"),
                F.array().cast(kind).alias("spans"), F.array().cast("array<bigint>").alias("items"),
            )

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = T.flat(batch.column(1))
                for a, b in T.blocks(offsets):
                    part = batch.slice(a, b - a)
                    shard = Shard(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shared.value)
                    hit, doc, item = _hits(shard)
                    spans, found = part.column(3).to_pylist(), part.column(4).to_pylist()
                    begin = np.cumsum(shard.count) - shard.count
                    own = np.bincount(shard.text[hit], minlength=b - a)
                    for d in np.flatnonzero(own):
                        flags = hit[begin[d] : begin[d] + shard.count[d]]
                        for s in spans[d]:
                            flags[s["first"] : s["last"] + 1] = True
                        turn = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
                        spans[d] = [{"first": int(x), "last": int(y) - 1} for x, y in zip(turn[::2], turn[1::2])]
                    for d in np.unique(doc):
                        found[d] = sorted({*found[d], *item[doc == d].tolist()} - {NO_ID})
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(shard.count), pa.array(spans, part.column(3).type), pa.array(found, pa.list_(pa.int64()))],
                        batch.schema.names,
                    )

        out = out.mapInArrow(run, schema)
    return out.drop("text")


def clean(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text",
    item_text: str = "text", limit: int = ITEM_BYTES,
) -> DataFrame:
    """The documents in which no window of any item occurs, all columns as they are."""
    spark = docs.sparkSession
    for block in item_blocks(items, window, None, item_text, limit):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = T.flat(batch.column(text))
                keep = np.ones(batch.num_rows, bool)
                for a, b in T.blocks(offsets):
                    shard = Shard(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shared.value)
                    _, place = shard.places()
                    keep[a + shard.text[place]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def longest_matches(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", limit: int = ITEM_BYTES,
) -> DataFrame:
    """For each distinct test window that occurs, its longest verbatim match over all shards.

    ``item_id, item_word, n_words, doc_id, doc_word``: the first item holding the
    window; of matches of one length that of the smallest document and place.
    """
    spark = docs.sparkSession
    schema = "item_id bigint, item_word bigint, n_words bigint, doc_id bigint, doc_word bigint"
    out = spark.createDataFrame([], schema)
    rows = docs.select(F.col(key).cast("bigint"), F.col(text)).filter(F.col(key).isNotNull())
    for block in item_blocks(items, window, item_key, item_text, limit):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            it = shared.value
            first = np.searchsorted(it.item, np.arange(len(it.ids)))
            for batch in batches:
                ids = batch.column(0).to_numpy()
                data, offsets = T.flat(batch.column(1))
                for a, b in T.blocks(offsets):
                    shard = Shard(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], it)
                    k, place = shard.places()
                    size = shard.lengths(k, place)
                    doc = ids[a + shard.text[place]]
                    begin = np.cumsum(shard.count) - shard.count
                    word = place - begin[shard.text[place]]
                    order = np.lexsort((word, doc, -size, k))
                    best = order[np.append(True, np.diff(k[order]) > 0)] if len(order) else order
                    at = it.at_word[k[best]]
                    columns = (it.ids[it.item[at]], at - first[it.item[at]], size[best], doc[best], word[best])
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["item_id", "item_word", "n_words", "doc_id", "doc_word"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    best = F.min(F.struct(-F.col("n_words"), "doc_id", "doc_word"))
    return (
        out.groupBy("item_id", "item_word").agg(best.alias("b"))
        .select(F.nullif("item_id", F.lit(NO_ID)).alias("item_id"), "item_word", (-F.col("b.col1")).alias("n_words"), F.col("b.doc_id").alias("doc_id"), F.col("b.doc_word").alias("doc_word"))
    )


def joined_sha256(ids: list[int]) -> str:
    """Digest of ids, sorted as strings and joined by commas."""
    return sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
