"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train an additive logistic model that minimises
the non-negative unbiased risk ("Positive-Unlabeled Learning with Non-Negative Risk
Estimator", 2017): the positive risk weighted by the class prior, plus the unlabelled
risk as negatives less what positives contribute to it, held at zero or above.

The class prior is estimated from scores, not from negative labels: in the region a
first model finds most positive, the share of unlabelled rows over the share of
positives bounds the prior from above and meets it where no negatives are.

A text is described by shares and counts of its bytes, words and lines. Each is cut at
quantiles over all documents; the model adds one weight per cell. Labels, language,
source and id are no inputs.

Only the fit uses a sample: at most ``SAMPLE_ROWS`` positives and as many unlabelled
rows, in order of a hash of the id. Features, quantiles and scores cover all rows.

Defined results: null is the empty text; empty texts are scored like others; without
any positive the score is the prior 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterdrill.llm import text as T
from rasterdrill.llm.store import Work

SAMPLE_ROWS = 10_000
CELLS = 16
STEPS = 400
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_FIRM = np.zeros(256, bool)  # punctuation that ordinary prose holds
_FIRM[[ord(c) for c in ".,;:'\"-()?!"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False

FEATURES = (
    "log_bytes", "log_words", "log_lines", "upper", "digits", "symbols", "marks", "wide", "blanks",
    "word_length", "capital_words", "marked_words", "digit_words", "distinct_words", "commonest_word",
    "repeated_neighbours", "distinct_pairs", "line_length", "distinct_lines", "short_words", "ends_marked",
)


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.append(0, np.cumsum(values, dtype=np.float64))
    return run[offsets[1:]] - run[offsets[:-1]]


def _distinct(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, and the count of its most frequent one."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = np.sort(text.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16))  # a block has at most 2^16 texts
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    t = (key[first] >> np.uint64(48)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, t, np.diff(np.append(first, len(key))))
    return np.bincount(t, minlength=n).astype(np.float64), most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(np.float64)
    w = T.words(data, offsets, T.NOT_SPACE)
    words = np.bincount(w.text, minlength=n).astype(np.float64)
    lines = T.words(data, offsets, _LINE)
    n_lines = np.bincount(lines.text, minlength=n).astype(np.float64)

    def share(flags: np.ndarray) -> np.ndarray:
        return _per_text(flags[data], offsets) / np.maximum(size, 1)

    def of_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(w.text, weights=flags.astype(np.float64), minlength=n) / np.maximum(words, 1)

    letters = share(_LETTER)
    at = np.append(0, np.cumsum(_UPPER[data])), np.append(0, np.cumsum(_LETTER[data])), np.append(0, np.cumsum(_DIGIT[data]))
    upper, letter, digit = (a[w.end] - a[w.start] for a in at)
    distinct, most = _distinct(w.text, w.hash, n)
    near = (w.text[1:] == w.text[:-1]) if len(w.text) else np.zeros(0, bool)
    pair = T.mix(w.hash[:-1] * np.uint64(3) + w.hash[1:])[near] if len(near) else np.zeros(0, np.uint64)
    pairs = np.bincount(w.text[:-1][near], minlength=n).astype(np.float64) if len(near) else np.zeros(n)
    twin = np.bincount(w.text[:-1][near], weights=(w.hash[:-1] == w.hash[1:])[near], minlength=n) if len(near) else np.zeros(n)
    ends = _PUNCTUATION[data[w.end - 1]] if len(w.end) else np.zeros(0, bool)
    d_pairs, _ = _distinct(w.text[:-1][near], pair, n) if len(near) else (np.zeros(n), None)
    d_lines, _ = _distinct(lines.text, lines.hash, n)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(n_lines),
        share(_UPPER) / np.maximum(letters, 1e-9) * (letters > 0), share(_DIGIT), share(_PUNCTUATION & ~_FIRM), share(_FIRM),
        share(np.arange(256) >= 0x80), share(~T.NOT_SPACE),
        np.bincount(w.text, weights=w.end - w.start, minlength=n) / np.maximum(words, 1),
        of_words((upper == letter) & (letter > 1)), of_words(ends), of_words(digit > 0),
        distinct / np.maximum(words, 1), most / np.maximum(words, 1), twin / np.maximum(pairs, 1),
        d_pairs / np.maximum(pairs, 1), size / np.maximum(n_lines, 1), d_lines / np.maximum(n_lines, 1),
        of_words(w.end - w.start <= 2), _PUNCTUATION[data[np.maximum(offsets[1:] - 1, 0)]] * (size > 0) if len(data) else np.zeros(n),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1).astype(np.float32)


def feature_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, x``: rows in place, features as an array of float."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.flat(batch.column(1))
            for a, b in T.blocks(offsets):
                x = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.arange(b - a + 1, dtype=np.int32) * np.int32(x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], [key, "x"]
                )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, x array<float>")


def edges(table: DataFrame) -> np.ndarray:
    """Quantiles of each feature over all rows: FEATURES x (CELLS - 1)."""
    at = [i / CELLS for i in range(1, CELLS)]
    row = table.agg(*[F.percentile_approx(F.col("x")[i], at, 1000).alias(f"q{i}") for i in range(len(FEATURES))]).first()
    return np.array([row[i] if row[i] is not None else [0.0] * (CELLS - 1) for i in range(len(FEATURES))])


def cells(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Number of each value's cell among all cells of all features; values on a cut lie above it."""
    out = np.empty(x.shape, np.int64)
    for j in range(x.shape[1]):
        out[:, j] = np.searchsorted(cuts[j], x[:, j], "right") + j * CELLS
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


class _Additive:
    """A weight per cell and a constant, by Adam on a gradient in the scores."""

    def __init__(self, width: int, penalty: float):
        self.w, self.penalty = np.zeros(width + 1), penalty

    def score(self, c: np.ndarray) -> np.ndarray:
        return self.w[c].sum(1) + self.w[-1]

    def fit(self, c: np.ndarray, gradient, steps: int = STEPS, rate: float = 0.05) -> None:
        first, second = np.zeros_like(self.w), np.zeros_like(self.w)
        for t in range(1, steps + 1):
            of_score, sign = gradient(self.score(c))
            g = np.append(np.bincount(c.ravel(), weights=np.repeat(of_score, c.shape[1]), minlength=len(self.w) - 1), of_score.sum())
            g = sign * g + self.penalty * np.append(self.w[:-1], 0)
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            self.w -= rate * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from scores of a model of one against the other.

    The least ratio of shares above a threshold, plus one standard error, over thresholds
    that at least three in ten positives pass.
    """
    best = 1.0
    p, u = np.sort(positive), np.sort(unlabelled)
    for t in np.quantile(p, np.linspace(0.0, 0.7, 29)):
        of_p = 1 - np.searchsorted(p, t, "left") / len(p)
        of_u = 1 - np.searchsorted(u, t, "left") / len(u)
        error = np.sqrt(of_u * (1 - of_u) / len(u)) / of_p
        best = min(best, of_u / of_p + error)
    return float(np.clip(best, 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, width: int, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and class prior from cells of positives and unlabelled rows."""
    if not len(positive) or not len(unlabelled):
        return np.zeros(width + 1), 0.5
    # Even rows train the first model, odd rows are scored by it: no row judges itself.
    c = np.concatenate([positive[::2], unlabelled[::2]])
    y = np.append(np.ones(len(positive[::2])), np.zeros(len(unlabelled[::2])))
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    first = _Additive(width, penalty)
    first.fit(c, lambda z: (share * (_sigmoid(z) - y), 1.0), steps=150)
    odd = (positive[1::2], unlabelled[1::2]) if len(positive) > 1 and len(unlabelled) > 1 else (positive, unlabelled)
    prior = estimate_prior(first.score(odd[0]), first.score(odd[1]))

    n_p, n_u = len(positive), len(unlabelled)
    c = np.concatenate([positive, unlabelled])

    def gradient(z: np.ndarray) -> tuple[np.ndarray, float]:
        p, u = z[:n_p], z[n_p:]
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        of_u, of_p = _sigmoid(u) / n_u, prior * _sigmoid(p) / n_p
        if negative < 0:  # the negative risk went below zero: step back on it alone
            return np.append(of_p, -of_u), 1.0
        return np.append(prior * (_sigmoid(p) - 1) / n_p - of_p, of_u), 1.0

    model = _Additive(width, penalty)
    model.w[-1] = np.log(prior / (1 - prior))
    model.fit(c, gradient)
    return model.w, prior


def _sample(rows: DataFrame, key: str, n: int) -> np.ndarray:
    got = rows.orderBy(F.xxhash64(key), key).limit(n).select("x").toPandas()["x"]
    return np.array(got.tolist(), np.float32).reshape(-1, len(FEATURES))


def score(
    docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text",
    label: str = "quality", sample_rows: int = SAMPLE_ROWS, work: Work | None = None,
) -> DataFrame:
    """``key, held_out, score`` of every row; ``held_out`` is a condition on the key.

    Positives are rows labelled 1, unlabelled text the rows without a label, neither of
    them held out.
    """
    work = work or Work(docs.sparkSession, "quality")
    table = work.keep(feature_table(docs, key, text), "features")
    free = table.filter(F.col(key).isNotNull() & ~held_out)
    marks = labels.select(F.col(key).alias("_k"), F.col(label).alias("_y")).filter("_k IS NOT NULL AND _y IS NOT NULL")
    positive = free.join(marks.filter("_y = 1").select("_k").distinct(), F.col(key) == F.col("_k"), "left_semi")
    unlabelled = free.join(marks.select("_k").distinct(), F.col(key) == F.col("_k"), "left_anti")
    cuts = edges(table)
    p, u = _sample(positive, key, sample_rows), _sample(unlabelled, key, sample_rows)
    weights, prior = fit(cells(p, cuts), cells(u, cuts), cuts.shape[0] * CELLS)
    shared = docs.sparkSession.sparkContext.broadcast((weights, cuts))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts = shared.value
        for b in batches:
            x = b.column(2).flatten().to_numpy().reshape(-1, len(FEATURES))
            s = _sigmoid(w[cells(x, cuts)].sum(1) + w[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], [key, "held_out", "score"])

    rows = table.select(key, F.coalesce(held_out, F.lit(False)).alias("held_out"), "x")
    return rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double")
