"""Exact repeats of ``length`` words, by Rabin-Karp hashes of every window of words.

Hashing. A word is a 64-bit number, and a window the polynomial of its words in an odd
base modulo 2^64, so all windows of a block are two prefix sums away. Two such hashes
with different bases and word numbers give up to 128 bits.

Counting. A task folds the windows of its documents: of equal ones the earliest stays
and the others are repeats already. What stays is packed by *cell*, a slice of the hash
space, in order of text: hash, document and place. Spark deals the cells, and in a cell
every window but the earliest of its hash is a repeat. As each task sends a hash once,
a passage that stands everywhere is a handful of rows.

Merging. Repeated windows of a document, which come from many cells, are dealt by document
in packed rows and laid over each other; what they cover together are its maximal removal
intervals. A document without a repeat needs no join: a filter of fixed size (blocked
Bloom, 2^19 rows of 64 bits, broadcast) tells for sure that most have none, and only the
others move to meet their intervals.

Width of the hash. It follows the bytes of text so that the chance that any two
different windows meet is about 2^-10: ``bits = 2 * log2(bytes / 2) + 10``. Some bits
are the cell's number, the rest are sent in whole bytes (eight for a GB, twelve for 100 TB).

Defined results. A null or empty text, or one of fewer than ``length`` words, loses
nothing. The order is that of the key, then of the hash of the text; a null key comes
first. Rows of one key and text are one document and get the same result. An empty
table gives an empty one. Other columns stay, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterdrill.llm import spans as S
from rasterdrill.llm import text as T
from rasterdrill.llm.store import Work
from rasterdrill.llm.suffix import _numbered

LENGTH = 20
# Windows a task folds at once (some 100 bytes each while it does).
FOLD = 1_200_000
# Windows of a cell, about, where cells outnumber the shuffle partitions.
CELL = 4_000_000
FILTER_WORDS = 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two Rabin-Karp hashes of each run of ``length`` word numbers."""
    n = len(words)
    if n < length:
        none = np.zeros(0, np.uint64)
        return none, none
    out = []
    for lane, base in enumerate(_BASES):
        value = words if lane == 0 else T.mix(words + np.uint64(lane))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value * _powers(base, n), out=total[1:])
        back = _powers(pow(base, -1, 1 << 64), n - length + 1)
        out.append(T.mix((total[length:] - total[:-length]) * back))
    return out[0], out[1]


def _windows(text: np.ndarray, n_texts: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows that stay in one text, their texts, and their places there."""
    if len(text) < length:
        none = np.zeros(0, np.int64)
        return none, none, none
    own = text[: len(text) - length + 1]
    first = np.flatnonzero(own == text[length - 1 :])
    begin = np.searchsorted(text, np.arange(n_texts))
    return first, own[first], first - begin[own[first]]


def _runs(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in order of document and place as runs: document, first place, number."""
    new = np.append(True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1))
    at = np.flatnonzero(new)
    return doc[at], place[at], np.diff(np.append(at, len(doc)))


def _by_bucket(doc: np.ndarray, first: np.ndarray, count: np.ndarray, buckets: int) -> tuple[np.ndarray, list]:
    """Runs as one packed row per bucket of documents: bucket; documents, first places, numbers."""
    bucket = (T.mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((first, doc, bucket))
    bucket = bucket[order]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    cuts = np.append(at, len(bucket)).tolist()
    columns = (doc[order], first[order].astype(np.uint32), count[order].astype(np.uint32))
    return bucket[at], [pa.array([S.planes(c[i:j]) for i, j in zip(cuts, cuts[1:])], pa.binary()) for c in columns]


_CELLS = "cell int, hash binary, doc binary, runs binary, place binary"


def _packed(docs: DataFrame, length: int, cells: int, wide: int) -> DataFrame:
    """Cells of hashes, and the repeats found inside tasks as packed runs without a hash, dealt by document."""
    names = ["cell", "hash", "doc", "runs", "place"]
    shift = np.uint64(32)

    def fold(held: list) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, place = (np.concatenate(x) for x in zip(*held))
        turn = np.lexsort((place, doc))
        h1, h2, doc, place = h1[turn], h2[turn], doc[turn], place[turn]
        order = np.lexsort((h2, h1))  # stable: of equal windows the earliest comes first
        again = np.zeros(len(h1), bool)
        again[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
        del order
        if again.any():
            bucket, (d, first, count) = _by_bucket(*_runs(doc[again], place[again]), cells)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.nulls(len(bucket), pa.binary()), d, count, first], names)
        keep = ~again
        h1, h2, doc, place = h1[keep], h2[keep], doc[keep], place[keep]
        cell = ((h2 >> shift) * np.uint64(cells) >> shift).astype(np.int64)
        turn = np.argsort(cell, kind="stable")
        cuts = np.searchsorted(cell[turn], np.arange(cells + 1)).tolist()
        rows = []
        for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a == b:
                continue
            own = turn[a:b]
            d = doc[own]
            at = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            step = np.diff(d[at], prepend=0)
            body = np.stack([h1[own], h2[own]], 1).view(np.uint8)[:, :wide].tobytes()
            rows.append((c, body, S.planes(step), S.planes(np.diff(np.append(at, b - a)).astype(np.uint32)), S.planes(place[own].astype(np.uint32))))
        if rows:
            c, *rest = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), *[pa.array(x, pa.binary()) for x in rest]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch, data, offsets in S.text_blocks(batches, 1):
            w = S.words(data, offsets, T.NOT_SPACE)
            first, text, place = _windows(w.text, batch.num_rows, length)
            if not len(first):
                continue
            h1, h2 = window_hashes(w.hash, length)
            held.append((h1[first], h2[first], batch.column(0).to_numpy()[text], place))
            n += len(first)
            if n >= FOLD:
                yield from fold(held)
                held, n = [], 0
        if n:
            yield from fold(held)

    return docs.select("doc", "text").mapInArrow(run, _CELLS)


def _settled(packed: DataFrame, cells: int, wide: int) -> DataFrame:
    """Windows that stand earlier, as packed runs dealt by document."""
    names = ["bucket", "doc", "first", "count"]

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        body = np.concatenate([np.frombuffer(x[0], np.uint8).reshape(-1, wide) for x in held])
        key = np.zeros((len(body), 16), np.uint8)
        key[:, :wide] = body
        key = key.view(np.uint64)
        place = np.concatenate([S.from_planes(x[3], np.uint32) for x in held]).astype(np.int64)
        doc = np.concatenate(
            [np.repeat(np.cumsum(S.from_planes(x[1], np.int64)), S.from_planes(x[2], np.uint32)) for x in held])
        order = np.lexsort((key[:, 0], key[:, 1])) if wide > 8 else np.argsort(key[:, 0], kind="stable")
        same = (key[order[1:]] == key[order[:-1]]).all(1)
        lone = ~(np.append(False, same) | np.append(same, False))
        order = order[~lone]
        if not len(order):
            return
        k, doc, place = key[order], doc[order], place[order]
        turn = np.lexsort((place, doc, k[:, 0], k[:, 1]))
        k, doc, place = k[turn], doc[turn], place[turn]
        again = np.append(False, (k[1:] == k[:-1]).all(1))
        doc, place = doc[again], place[again]
        turn = np.lexsort((place, doc))
        bucket, columns = _by_bucket(*_runs(doc[turn], place[turn]), cells)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for cell, body, doc, runs, place in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if body is None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell], pa.int32()), *[pa.array([x], pa.binary()) for x in (doc, place, runs)]], names)
                    continue
                if cell != now and held:
                    yield from settle(held)
                    held = []
                now = cell
                held.append((body, doc, runs, place))
        if held:
            yield from settle(held)

    # Repeats of a task come first in their cell, so no cell is broken.
    dealt = packed.repartition("cell").sortWithinPartitions("cell", F.col("hash").isNotNull())
    return dealt.mapInArrow(run, "bucket int, doc binary, first binary, count binary")


def _merged(settled: DataFrame, length: int) -> DataFrame:
    """``doc, spans``: maximal intervals of words ``[first, last)`` that repeated windows cover."""
    item = pa.struct([("first", pa.int32()), ("last", pa.int32())])

    def close(held: list) -> pa.RecordBatch:
        doc, first, count = (np.concatenate([S.from_planes(x[i], d) for x in held]) for i, d in enumerate((np.int64, np.uint32, np.uint32)))
        first = first.astype(np.int64)
        last = first + count + length - 1
        order = np.lexsort((first, doc))
        doc, first, last = doc[order], first[order], last[order]
        other = np.append(False, doc[1:] != doc[:-1])
        base = np.cumsum(other) * (int(last.max()) + 1)
        reach = np.maximum.accumulate(last + base) - base
        new = np.append(True, other[1:] | (first[1:] > reach[:-1]))
        at = np.flatnonzero(new)
        ends = reach[np.append(at[1:], len(doc)) - 1]
        owner = np.flatnonzero(np.append(True, doc[at][1:] != doc[at][:-1]))
        value = pa.StructArray.from_arrays(
            [pa.array(first[at].astype(np.int32)), pa.array(ends.astype(np.int32))], fields=list(item))
        lists = pa.ListArray.from_arrays(pa.array(np.append(owner, len(at)).astype(np.int32)), value)
        return pa.RecordBatch.from_arrays([pa.array(doc[at][owner]), lists], ["doc", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != now and held:
                    yield close(held)
                    held = []
                now = bucket
                held.append(row)
        if held:
            yield close(held)

    dealt = settled.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "doc bigint, spans array<struct<first:int,last:int>>")


def repeats(docs: DataFrame, length: int = LENGTH, work: Work | None = None) -> DataFrame:
    """``doc, spans`` of ``docs (doc, text)`` with a repeat; ``doc`` is a number of its own per row."""
    if length < 1:
        raise ValueError("a window has a word at least")
    spark = docs.sparkSession
    work = work or Work(spark, "rabin")
    size = int(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(2 * parts, ceil(size / 6 / CELL))
    bits = 2 * log2(max(size, 4) / 2) + 10 - log2(cells)
    wide = min(16, max(8, ceil(bits / 8)))
    packed = _packed(docs, length, cells, wide)
    return work.keep(_merged(_settled(packed, cells, wide), length), "spans")


def _bit(key: str) -> tuple[Column, Column]:
    """Row and bits of a key in the filter."""
    word = F.expr(f"xxhash64({key}, 11) & {FILTER_WORDS - 1}")
    mask = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}, 12), 64) AS INT)) | shiftleft(1L, cast(pmod(xxhash64({key}, 13), 64) AS INT))")
    return word, mask


def _split(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that surely have no spans, and the others with theirs; columns of ``rows`` but ``doc``, and ``spans``."""
    word, mask = _bit("doc")
    bits = found.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.expr("bit_or(_mask)").alias("_bits"))
    asked = rows.withColumns({"_word": word, "_mask": mask}).join(F.broadcast(bits), "_word", "left")
    maybe = F.coalesce(F.expr("_bits & _mask = _mask"), F.lit(False))
    columns = [c for c in rows.columns if c != "doc"]
    none = F.lit(None).cast("array<struct<first:int,last:int>>").alias("spans")
    without = asked.filter(~maybe).select(*columns, none)
    held = asked.filter(maybe).select("doc", *columns).join(found.hint("merge"), "doc", "left")
    return without, held.select(*columns, "spans")


def _with_spans(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """All rows with ``spans``; columns are called c0, c1 … so that no name can clash."""
    work = Work(docs.sparkSession, "rabin")
    names = [f"c{i}" for i in range(len(docs.columns))]
    k, t = (names[docs.columns.index(c)] for c in (key, text))
    plain = docs.toDF(*names)
    number = F.col(k).cast("bigint")
    keys = plain.groupBy(number.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    seen = keys.agg(F.max("n").alias("most"), F.count(F.when(F.col("k").isNull(), 1)).alias("nulls")).first()
    if (seen["most"] or 0) <= 1 and not seen["nulls"]:
        plain = plain.withColumn("doc", number)
        once = plain
    else:
        plain = work.keep(_numbered(plain, k, t, work), "rows")
        once = plain.dropDuplicates(["doc"])
    found = repeats(once.select("doc", F.col(t).alias("text")), length, work)
    without, held = _split(plain.select("doc", *names), found)
    return without.unionByName(held)


def _left(data: np.ndarray, offsets: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words kept, joined by one space, their offsets, words and words removed of each text."""
    n_texts = len(offsets) - 1
    w = S.words(data, offsets, T.NOT_SPACE)
    n_words = np.bincount(w.text, minlength=n_texts)
    begin = np.append(0, np.cumsum(n_words))
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n_texts), sizes)
    kept = np.ones(len(w.start), bool)
    if len(row):
        flat = lists.flatten()
        edge = np.zeros(len(w.start) + 1, np.int32)
        edge[begin[row] + flat.field("first").to_numpy()] += 1
        edge[begin[row] + flat.field("last").to_numpy()] -= 1  # spans are disjoint and do not touch
        kept = np.cumsum(edge[:-1]) == 0
    start, end, text = w.start[kept], w.end[kept], w.text[kept]
    cover = np.zeros(len(data) + 1, np.int8)
    cover[start] += 1
    cover[end] -= 1
    mask = np.cumsum(cover[:-1], dtype=np.int8) > 0
    # A word that another one of its text follows is followed by white space: one space of it stays.
    gap = end[:-1][text[1:] == text[:-1]]
    out = data.copy()
    out[gap] = 0x20
    mask[gap] = True
    at = np.append(0, np.cumsum(mask))[offsets]
    return out[mask], at, n_words, n_words - np.bincount(text, minlength=n_texts)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` of every row."""
    rows = _with_spans(docs.select(key, text), key, text, length)
    schema = f"`{key}` bigint, n_words bigint, n_removed bigint, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in S.text_blocks(batches, 1):
            out, at, n, removed = _left(data, offsets, batch.column(2))
            raw, cuts = out.tobytes(), at.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)),
                 pa.array([sha256(raw[i:j]).hexdigest() for i, j in zip(cuts, cuts[1:])], pa.string())],
                [key, "n_words", "n_removed", "kept_sha256"])

    return rows.select(F.col("c0").cast("bigint"), "c1", "spans").mapInArrow(run, schema)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with the words that stay, joined by one space; a null text stays null."""
    rows = _with_spans(docs, key, text, length)
    place, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in S.text_blocks(batches, place):
            *columns, spans = batch.columns
            out, at, _, _ = _left(data, offsets, spans)
            raw, cuts = out.tobytes(), at.tolist()
            valid = columns[place].is_valid().to_pylist()
            columns[place] = pa.array(
                [raw[i:j].decode("utf-8", "replace") if v else None for i, j, v in zip(cuts, cuts[1:], valid)], columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, docs.schema)
