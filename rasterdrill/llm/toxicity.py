"""Toxicity by a classifier chain over hashed words.

A chain predicts categories one after the other. Each link is a logistic model of the
text's features and of the probabilities of the categories before it. For training,
those probabilities come from models of other folds (out-of-fold), so later links learn
from what they will see in use, not from fitted values.

The label table names one category, ``toxic``. Two more, learned from it, go before:
``terms`` (toxic, and holds a term of the learned lexicon) and ``severe`` (toxic, with
a density of such terms above the median of toxic texts). A term is a feature of many
toxic and hardly any other texts; no word list is given. Callers with a table of several
categories name them in order instead.

Features are words (lower-cased letters, digits and bytes above 127) and their first
five and six bytes, hashed to ``2 ** BITS`` numbers; a feature's value is the root of its
share of the text's words. Each link uses the ``WIDTH`` features that best tell the
sample's classes apart.

Only the fit uses a sample: at most ``SAMPLE_ROWS`` labelled rows of either class, in order
of a hash of the id, weighted back to their shares. Every whole text is scored.

Defined results: null is the empty text; a text without words has the chain's base
probability; without labels of both classes, every probability is the share of ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterdrill.llm import text as T

BITS = 20
SAMPLE_ROWS = 3000
WIDTH = 1024
FOLDS = 4
STEPS = 150
PENALTY = 1e-5
CHAIN = ("terms", "severe", "toxic")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature number and value, by text; and once for each feature of a text."""
    w = T.words(T.LOWER[data], offsets, T.ALNUM)
    if not len(w.text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    low = T.LOWER[data]
    size = w.end - w.start
    hashes = [w.hash]
    for n in (5, 6):
        long = size >= n
        place = w.start[long, None] + np.arange(n)[None, :]
        h = np.full(len(size), np.uint64(n))
        h[long] = T.hash_runs(low[place].ravel(), np.full(int(long.sum()), n)) + np.uint64(n)
        hashes.append(np.where(long, T.mix(h), np.uint64(0)))
    keys = []
    for h in hashes:
        own = h > 0
        keys.append((w.text[own].astype(np.uint64) << np.uint64(BITS)) | (h[own] >> np.uint64(64 - BITS)))
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(first, len(key)))
    text = (key[first] >> np.uint64(BITS)).astype(np.int64)
    total = np.bincount(w.text, minlength=len(offsets) - 1)
    value = np.sqrt(count / total[text]).astype(np.float32)
    return text, (key[first] & np.uint64((1 << BITS) - 1)).astype(np.int64), value


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


class Link(NamedTuple):
    """One logistic model: weights of chosen features and of earlier probabilities."""

    chosen: np.ndarray
    weights: np.ndarray
    of_chain: np.ndarray
    base: float

    def score(self, x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return _sigmoid(x @ self.weights + earlier @ self.of_chain + self.base)


class Sparse(NamedTuple):
    """Sampled texts as rows of (feature, value)."""

    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    rows: int

    def dense(self, chosen: np.ndarray) -> np.ndarray:
        out = np.zeros((self.rows, len(chosen)), np.float32)
        if len(chosen):
            at = np.searchsorted(chosen, self.feature)
            at[at == len(chosen)] = 0
            ok = chosen[at] == self.feature
            out[self.row[ok], at[ok]] = self.value[ok]
        return out


def _counts(x: Sparse, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features seen, and their texts of either class. One table of all feature numbers, whatever the sample."""
    both = np.bincount(x.feature, minlength=1)
    seen = np.flatnonzero(both)
    one = np.bincount(x.feature[y[x.row]], minlength=len(both))[seen].astype(np.float64)
    return seen, one, both[seen] - one


def choose(x: Sparse, y: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Features whose presence differs most between the classes, in standard errors; sorted."""
    n1, n0 = max(1, int(y.sum())), max(1, int((~y).sum()))
    seen, one, zero = _counts(x, y)
    if not len(seen):
        return seen
    p1, p0, p = (one + 0.5) / (n1 + 1), (zero + 0.5) / (n0 + 1), (one + zero + 1) / (n1 + n0 + 2)
    z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    z[one + zero < 3] = 0
    top = np.argsort(-z, kind="stable")[:width]
    return np.sort(seen[top[z[top] > 0]])


def train(x: np.ndarray, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray, chosen: np.ndarray) -> Link:
    """Weighted logistic regression by Adam over all rows at once."""
    share = float((weight * y).sum() / max(weight.sum(), 1e-12))
    share = min(max(share, 1e-4), 1 - 1e-4)
    c = earlier.shape[1]
    if not len(y) or y.all() or not y.any():
        return Link(chosen, np.zeros(len(chosen)), np.zeros(c), float(np.log(share / (1 - share))))
    full = np.concatenate([x, earlier.astype(np.float32), np.ones((len(x), 1), np.float32)], 1)
    w = np.zeros(full.shape[1])
    w[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(w), np.zeros_like(w)
    of = weight / weight.sum()
    for t in range(1, STEPS + 1):
        p = _sigmoid(full @ w.astype(np.float32))
        g = full.T @ (of * (p - y)).astype(np.float32) + PENALTY * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.3 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return Link(chosen, w[: x.shape[1]], w[x.shape[1] : -1], float(w[-1]))


def fit_chain(x: Sparse, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> list[Link]:
    """Links for the columns of ``y`` in order; a row with ``fold`` f is predicted without fold f."""
    links, earlier = [], np.zeros((x.rows, 0))
    for j in range(y.shape[1]):
        chosen = choose(x, y[:, j])
        dense = x.dense(chosen)
        out = np.zeros(x.rows)
        for f in range(FOLDS):
            rest, own = fold != f, fold == f
            if own.any():
                part = Sparse(*(v[rest[x.row]] for v in x[:3]), x.rows)
                mine = choose(part, y[:, j])
                if len(mine):
                    at = x.dense(mine)
                    out[own] = train(at[rest], earlier[rest], y[rest, j], weight[rest], mine).score(at[own], earlier[own])
        links.append(train(dense, earlier, y[:, j], weight, chosen))
        earlier = np.concatenate([earlier, out[:, None]], 1)
    return links


def categories(x: Sparse, toxic: np.ndarray) -> np.ndarray:
    """``terms``, ``severe`` and ``toxic`` of the sampled rows."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    seen, one, zero = _counts(x, toxic)
    is_term = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, bool)
    is_term[seen] = (one >= 3) & ((one + 0.5) / (n1 + 1) > 20 * (zero + 0.5) / (n0 + 1))
    own = is_term[x.feature]
    density = np.bincount(x.row[own], weights=x.value[own].astype(np.float64) ** 2, minlength=x.rows)
    held = toxic & (density > 0)
    middle = np.median(density[held]) if held.any() else 0.0
    return np.stack([held, held & (density > middle), toxic], 1)


def _sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, n: int) -> tuple[Sparse, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, weights and folds of the sample."""
    marks = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
    marks = marks.filter("_k IS NOT NULL AND _y IN (0, 1)").groupBy("_k").agg(F.max("_y").alias("_y"))
    totals = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [marks.filter(F.col("_y") == v).orderBy(F.xxhash64("_k"), "_k").limit(n) for v in (0, 1)]
    picked = parts[0].unionByName(parts[1])  # at most 2 n rows
    rows = docs.select(F.col(key).alias("_id"), F.col(text)).join(F.broadcast(picked), F.col("_id") == F.col("_k"))
    rows = rows.select(F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int"), F.col("_y"), F.col(text), F.xxhash64("_id"), F.xxhash64(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.flat(batch.column(2))
            for a, b in T.blocks(offsets):
                text, feature, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(value)),
                        batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a),
                    ],
                    ["fold", "y", "f", "v", "h", "t"],
                )

    got = rows.mapInArrow(run, "fold int, y int, f array<int>, v array<float>, h bigint, t bigint").toArrow()
    # The order of the rows depends on tasks; a fixed one, by hash of id and text, makes fits repeat.
    order = np.lexsort((got.column("t").to_numpy(), got.column("h").to_numpy()))
    turn = np.empty(len(order), np.int32)
    turn[order] = np.arange(len(order))
    y = got.column("y").to_numpy().astype(bool)[order]
    fold = got.column("fold").to_numpy()[order]
    f = got.column("f").combine_chunks()
    f = f.combine_chunks() if isinstance(f, pa.ChunkedArray) else f
    v = got.column("v").combine_chunks()
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    size = f.value_lengths().to_numpy() if len(f) else np.zeros(0, np.int64)
    del got
    x = Sparse(np.repeat(turn, size), f.flatten().to_numpy(), v.flatten().to_numpy(), len(y))
    weight = np.ones(len(y))
    for value in (0, 1):
        own = y == bool(value)
        if own.any():
            weight[own] = totals.get(value, 0) / own.sum()
    return x, y, weight, fold


class Chain(NamedTuple):
    """Links with their weights spread over all feature numbers."""

    names: tuple[str, ...]
    weights: np.ndarray  # links x features
    of_chain: list[np.ndarray]
    base: np.ndarray

    def scores(self, text: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Probabilities, texts x links."""
        out = np.zeros((n, len(self.names)))
        for j in range(len(self.names)):
            z = np.bincount(text, weights=self.weights[j, feature] * value, minlength=n) if len(text) else np.zeros(n)
            out[:, j] = _sigmoid(z + out[:, :j] @ self.of_chain[j] + self.base[j])
        return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Chain:
    x, y, weight, fold = _sampled(docs, labels, key, text, label, sample_rows)
    links = fit_chain(x, categories(x, y), weight, fold)
    weights = np.zeros((len(links), 1 << BITS), np.float32)
    for j, k in enumerate(links):
        weights[j, k.chosen] = k.weights
    return Chain(CHAIN, weights, [k.of_chain for k in links], np.array([k.base for k in links]))


def _batch_scores(chain: Chain, column: pa.Array) -> np.ndarray:
    data, offsets = T.flat(column)
    out = [np.zeros((0, len(chain.names)))]
    for a, b in T.blocks(offsets):
        out.append(chain.scores(*features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a))
    return np.concatenate(out)


def score(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the probability of each category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _batch_scores(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in p.T)], [key, *chain.names])

    return docs.select(key, text).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{n} double" for n in chain.names)]))


def clean(docs: DataFrame, chain: Chain, text: str = "text", least: float = 0.5, category: str = "toxic") -> DataFrame:
    """Documents whose probability of ``category`` is below ``least``; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _batch_scores(shared.value, batch.column(at))[:, chain.names.index(category)]
            yield batch.filter(pa.array(p < least))

    return docs.mapInArrow(run, docs.schema)
