"""Words with their strings and counts, folded inside tasks before they move.

A word of a language has a 64-bit number, the hash of its bytes mixed with the hash of
its language; strings travel once per fold. :func:`clashes` looks for two words with
one number, which a corpus of 10^7 words holds with a chance of 10^-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterdrill.llm import spans as S
from rasterdrill.llm import text as T

# Distinct words a task holds before it hands them on.
FOLD = 400_000


def tags(column: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit number of each string of a short column."""
    coded = column.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    known = [np.frombuffer(x.encode() + b"\0", np.uint8) for x in coded.dictionary.to_pylist()]
    value = T.hash_runs(np.concatenate(known), np.array([len(x) for x in known])) if known else np.zeros(0, np.uint64)
    return T.mix(value + np.uint64(seed))[coded.indices.to_numpy()]


def numbers(w: T.Words, tag: np.ndarray) -> np.ndarray:
    """Number of each word in its language; 0 and 1 are kept free."""
    return np.maximum(T.mix(w.hash ^ tag[w.text]), np.uint64(2))


def counted(docs: DataFrame, inside: np.ndarray, in_texts: bool, seed: int = 0) -> DataFrame:
    """``lang, word, id, n`` of ``docs (lang, text)``, one row or more per word.

    Only A-Z are lower-cased. ``n`` counts occurrences or, with ``in_texts``, texts.
    """
    names = ["lang", "word", "id", "n"]

    def close(held: list) -> tuple:
        ids, n, lang, word = (np.concatenate(x) if isinstance(x[0], np.ndarray) else pa.concat_arrays(x) for x in zip(*held))
        known, at, group = np.unique(ids, return_index=True, return_inverse=True)
        return known, np.bincount(group, n).astype(np.int64), lang.take(pa.array(at)), word.take(pa.array(at))

    def emit(held: list) -> Iterator[pa.RecordBatch]:
        ids, n, lang, word = close(held)
        yield pa.RecordBatch.from_arrays([lang, word, pa.array(ids.view(np.int64)), pa.array(n)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, data, offsets in S.text_blocks(batches, 1):
            data = T.LOWER[data]
            w = S.words(data, offsets, inside)
            if not len(w.start):
                continue
            ids = numbers(w, tags(batch.column(0), seed))
            if in_texts:
                order = np.lexsort((ids, w.text))
                new = np.append(True, (ids[order[1:]] != ids[order[:-1]]) | (w.text[order[1:]] != w.text[order[:-1]]))
                pick = order[new]
            else:
                pick = np.arange(len(ids))
            known, at, n = np.unique(ids[pick], return_index=True, return_counts=True)
            at = pick[at]
            held.append((known, n, batch.column(0).take(pa.array(w.text[at])).cast(pa.string()), S.strings(data, w.start[at], w.end[at])))
            size += len(known)
            if size >= FOLD:
                held = [close(held)]
                size = len(held[0][0])
                if size >= FOLD // 2:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    out = docs.select("lang", "text").mapInArrow(run, "lang string, word binary, id bigint, n bigint")
    return out.withColumn("word", F.col("word").cast("string"))


def clashes(words: DataFrame) -> bool:
    """Whether two words share a number."""
    return not words.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
