"""Exact repeats of ``length`` bytes, by external induced sorting of sampled suffixes.

Sampling. Every window of ``length`` bytes names one of its grams, the leftmost of
least hash; windows that name the same place form a *run*, some forty windows. Equal
windows name equal grams at equal distances, so the grams are the sampled suffixes
(what leftmost-smaller suffixes are in classical induced sorting), and windows need
only be compared among the runs of one gram.

Naming. Runs of equal bytes get one name. Each task folds its own copies first; the
rest go to the gram's partition, where Spark's external sort is the disk-backed queue
of tuples (gram, name, document, place). All but the first run of a name are repeats as
a whole. Grams with one name are done: in most text, nearly all.

Induction. Where a gram has several names, one run of each is fetched. Its sampled
suffixes are sorted with their common-prefix values. From the order at distance d to
the gram, the order at d + 1 is induced: stable, by the byte before; the common prefix
of two neighbours is one more than the least value between them in the old order.
Neighbours with ``length`` bytes in common are equal windows, and all but the first
are repeats.

Bounds. Names of one gram are told apart in one task, sorted by Spark, a batch at a time.
The texts of a gram with more than ``GROUP_RUNS`` names, which may be most of a corpus
around a widespread passage, never meet in one task: its windows are named one by one
with map-side partials. Every other queue holds at most ``BATCH_RUNS`` runs and one
group. So memory does not grow with the shard.

Order is that of the document key, then place. Rows of one key are ordered by the hash
of their texts; rows of one key and text are one document and get the same result; a
null key comes first. A null text is empty. Matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterdrill.llm import text as T
from rasterdrill.llm.store import Work

LENGTH = 100
GRAM = 24
GROUP_RUNS = 2048
BATCH_RUNS = 20_000
# Runs a task folds at once before they move (24 bytes each).
FOLD_RUNS = 400_000
# Grams that may be broadcast: 8 bytes each.
BROADCAST_ROWS = 300_000
_PLACE_BITS = 24
_PIECE = 4 << 20  # a longer text is cut into overlapping pieces
_BYTE = T.mix(np.arange(1001, 1257, dtype=np.uint64))
_BYTE2 = T.mix(np.arange(5001, 5257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on."""
    power, width = _BYTE[data], 1
    out, done = None, 0
    while True:
        if size & width:
            if out is None:
                out, done = power[: len(data) - width + 1], width
            else:
                n = len(data) - done - width + 1
                out = out[:n] * np.uint64(0xD6E8FEB86659FD93 + 2 * width) + power[done : done + n]
                done += width
        if 2 * width > size:
            return T.mix(out)
        n = len(power) - width
        power = power[:n] * np.uint64(0xA0761D6478BD642F + 2 * width) + power[width:]
        width *= 2


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Prefix:
    """Hash of any substring of a block from sums of byte values."""

    def __init__(self, data: np.ndarray, values: np.ndarray = _BYTE):
        n = len(data)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * _powers(_BASE, n), out=self.sum[1:])
        self.back = _powers(_BACK, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return T.mix((self.sum[end] - self.sum[start]) * self.back[start] + (end - start).astype(np.uint64))


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of a block: gram hash, name, text number, first window, its distance to the gram, windows."""
    none = np.zeros(0, np.int64)
    wide = length - gram + 1
    if len(data) < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    g = _grams(data, gram)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    reach = 1
    while 2 * reach <= wide:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < wide:
        key = np.minimum(key[: len(key) - (wide - reach)], key[wide - reach :])
    place = (key & low).astype(np.int64)
    n = len(place)
    size = np.diff(offsets)
    valid = np.zeros(n + 1, np.int32)
    big = np.flatnonzero(size >= length)
    np.add.at(valid, offsets[:-1][big], 1)
    np.add.at(valid, np.minimum(offsets[1:][big] - length + 1, n), -1)
    p = np.flatnonzero(np.cumsum(valid[:n]) > 0)
    if not len(p):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    first = np.ones(len(p), bool)
    first[1:] = (place[p[1:]] != place[p[:-1]]) | (p[1:] != p[:-1] + 1)
    at = np.flatnonzero(first)
    start, count = p[at], np.diff(np.append(at, len(p)))
    text = np.searchsorted(offsets, start, "right") - 1
    # Adjacent texts without a gap between their windows share no place, as grams lie inside windows.
    spot = place[start]
    name = Prefix(data).of(start, start + count + length - 1)
    return g[spot], name, text, start - offsets[text], spot - start, count


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """A long text in pieces that share all but one byte of a window: (first byte, offsets)."""
    limit = _PIECE
    begin, end = int(offsets[0]), int(offsets[-1])
    at = begin
    while True:
        stop = min(end, at + limit)
        yield at, np.array([0, stop - at], np.int64)
        if stop == end:
            return
        at = stop - length + 1


def _pack(off, lead, count):
    return off.astype(np.int64) << 16 | lead.astype(np.int64) << 8 | count.astype(np.int64)


def _unpack(loc):
    return loc >> 16, loc >> 8 & 0xFF, loc & 0xFF


def _all_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``k, name, doc, loc, again`` of all runs; of a task's equal runs all but the first are marked."""
    schema = "k bigint, name bigint, doc bigint, loc bigint, again boolean"

    def fold(held: list) -> pa.RecordBatch:
        k, name, doc, loc = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((loc, doc, name, k))
        k, name, doc, loc = k[order], name[order], doc[order], loc[order]
        again = np.zeros(len(k), bool)
        # The same row twice is one run.
        again[1:] = (k[1:] == k[:-1]) & (name[1:] == name[:-1])
        same = again.copy()
        same[1:] &= (doc[1:] == doc[:-1]) & (loc[1:] == loc[:-1])
        begin = np.maximum.accumulate(np.where(again, 0, np.arange(len(k))))
        same |= again & (doc == doc[begin]) & (loc == loc[begin])
        k = np.where(again, T.mix((doc * 1_000_003 + loc).view(np.uint64)).view(np.int64), k)
        keep = ~same
        return pa.RecordBatch.from_arrays(
            [pa.array(x[keep]) for x in (k, name, doc, loc, again)], ["k", "name", "doc", "loc", "again"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = T.flat(batch.column(1))
            for a, b in T.blocks(offsets):
                if b > a + 1 or offsets[b] - offsets[a] <= _PIECE:
                    parts = [(0, offsets[a], offsets[b], offsets[a : b + 1] - offsets[a])]
                else:  # one long text
                    parts = [(x - offsets[a], x, x + o[-1], o) for x, o in _pieces(offsets[a : b + 1], length)]
                for shift, x, y, own in parts:
                    g, name, text, off, lead, count = runs(data[x:y], own, length, gram)
                    held.append((g.view(np.int64), name.view(np.int64), ids[a + text], _pack(off + shift, lead, count)))
                    n += len(g)
                if n >= FOLD_RUNS:
                    yield fold(held)
                    held, n = [], 0
        if n:
            yield fold(held)

    return docs.mapInArrow(run, schema)


def _named(rows: DataFrame, length: int) -> DataFrame:
    """From runs to repeats ``(doc, first, last, k null)`` and open runs ``(doc, loc, k)``."""
    schema = "doc bigint, first bigint, last bigint, k bigint"

    def emit(doc, loc, k=None):
        off, _, count = _unpack(loc)
        first, last = (off, off + count + length - 1) if k is None else (loc, loc)
        kept = pa.nulls(len(doc), pa.int64()) if k is None else pa.array(k)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(first), pa.array(last), kept], ["doc", "first", "last", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = None  # the last name's first run, until it is known whether its gram has another
        for batch in batches:
            if not batch.num_rows:
                continue
            k, name, doc, loc = (batch.column(i).to_numpy() for i in range(4))
            again = batch.column(4).to_numpy(zero_copy_only=False)
            if again.any():
                yield emit(doc[again], loc[again])
            k, name, doc, loc = (x[~again] for x in (k, name, doc, loc))
            if not len(k):
                continue
            if wait is not None:
                k, name, doc, loc = (np.append(w, x) for w, x in zip(wait[:4], (k, name, doc, loc)))
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (name[1:] != name[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            copy = ~new & ((doc != doc[lead]) | (loc != loc[lead]))
            if copy.any():
                yield emit(doc[copy], loc[copy])
            k, name, doc, loc = k[new], name[new], doc[new], loc[new]
            open_ = np.zeros(len(k), bool)
            more = k[1:] == k[:-1]
            open_[1:] |= more
            open_[:-1] |= more
            if wait is not None:
                open_[0] |= wait[4]
            wait = (k[-1:], name[-1:], doc[-1:], loc[-1:], bool(open_[-1]))
            open_[-1] = False
            if open_.any():
                yield emit(doc[open_], loc[open_], k[open_])
        if wait is not None and wait[4]:
            yield emit(wait[2], wait[3], wait[0])

    dealt = rows.repartition("k").sortWithinPartitions("k", "again", "name", "doc", "loc")
    return dealt.mapInArrow(run, schema)


def _merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Overlapping spans of a document as one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    if len(doc):
        base = np.cumsum(np.append(False, doc[1:] != doc[:-1])) * (int(last.max()) + 1)
        reach = np.maximum.accumulate(last + base) - base
        new = np.append(True, (doc[1:] != doc[:-1]) | (first[1:] > reach[:-1]))
        at = np.flatnonzero(new)
        doc, first, last = doc[at], first[at], reach[np.append(at[1:], len(doc)) - 1]
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(first), pa.array(last)], ["doc", "first", "last"])


def _least_between(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of ``values[start + 1 .. end]`` for start < end, by doubling."""
    table, width = [values], 1
    longest = int((end - start).max(initial=1))
    while 2 * width <= longest:
        last = table[-1]
        table.append(np.minimum(last[: len(last) - width], last[width:]))
        width *= 2
    level = np.frexp((end - start).astype(np.float64))[1] - 1
    out = np.empty(len(start), values.dtype)
    for j, row in enumerate(table):
        own = np.flatnonzero(level == j)
        out[own] = np.minimum(row[start[own] + 1], row[end[own] + 1 - (1 << j)])
    return out


def induce(
    group: np.ndarray, age: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, lead: np.ndarray, length: int
) -> Iterator[tuple[int, np.ndarray]]:
    """For each distance, the runs whose window at that distance repeats an older one.

    ``data[begin : begin + size]`` is a run's text, its gram ``lead`` bytes in; ``age``
    orders the runs. Yields ``(distance, numbers of runs)``.
    """
    n = len(group)
    right = size - lead
    words = -(-length // 8)
    spot = np.minimum(np.arange(8 * words)[None, :], length - 1)
    cells = np.where(
        np.arange(8 * words)[None, :] < np.minimum(right, length)[:, None],
        data[np.minimum((begin + lead)[:, None] + spot, len(data) - 1)], 0,
    ).astype(np.uint8)
    parts = np.ascontiguousarray(cells).view(">u8")
    order = np.lexsort((*[parts[:, j] for j in range(words - 1, -1, -1)], group))
    a, b = order[:-1], order[1:]
    differ = cells[a] != cells[b]
    common = np.where(differ.any(1), differ.argmax(1), length)
    common = np.minimum(common, np.minimum(np.minimum(right[a], right[b]), length))
    common[group[a] != group[b]] = -1
    prefix = np.append(-1, common).astype(np.int32)  # with the one before, in the order
    distance = 0
    while True:
        head = prefix < length
        if not head.all():
            first = np.flatnonzero(head)
            eldest = np.minimum.reduceat(age[order], first)
            again = age[order] != np.repeat(eldest, np.diff(np.append(first, len(order))))
            yield distance, order[again]
        distance += 1
        stay = np.flatnonzero(lead[order] >= distance)
        if len(stay) < 2:
            return
        # The queue: suffixes that have a byte before them, in their old order, by that byte.
        before = data[(begin + lead)[order[stay]] - distance].astype(np.int64)
        bucket = group[order[stay]] * 256 + before
        turn = np.argsort(bucket, kind="stable")
        old = stay[turn]
        same = bucket[turn[1:]] == bucket[turn[:-1]]
        # Neighbours with different bytes have nothing in common; those of different grams never meet.
        new = np.append(-1, np.where(bucket[turn[1:]] >> 8 == bucket[turn[:-1]] >> 8, 0, -1)).astype(np.int32)
        i = np.flatnonzero(same)
        if len(i):
            new[i + 1] = 1 + _least_between(prefix, old[i], old[i + 1])
        order, prefix = order[old], new


def _induced(strings: DataFrame, length: int) -> DataFrame:
    """Repeats among the runs ``(k, doc, loc, s)`` of each gram."""

    def settle(held: list) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        k, doc, loc = (t.column(i).to_numpy() for i in range(3))
        raw = t.column(3)
        _, cuts, body = raw.buffers()
        at = np.frombuffer(cuts, np.int32 if pa.types.is_binary(raw.type) else np.int64)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        data = np.frombuffer(body, np.uint8)
        off, lead, _ = _unpack(loc)
        group = np.unique(k, return_inverse=True)[1]
        age = np.empty(len(k), np.int64)
        age[np.lexsort((off + lead, doc))] = np.arange(len(k))
        docs, first = [doc[:0]], [off[:0]]
        for distance, again in induce(group, age, data, at[:-1], np.diff(at), lead, length):
            docs.append(doc[again])
            first.append((off + lead)[again] - distance)
        first = np.concatenate(first)
        return _merged(np.concatenate(docs), first, first + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy()
            if n and n + len(k) > BATCH_RUNS:  # cut where a gram begins
                prior = held[-1].column(0)[-1].as_py()
                turn = np.flatnonzero(np.append(k[0] != prior, k[1:] != k[:-1]))
                if len(turn):
                    cut = int(turn[0])
                    if cut:
                        held.append(batch.slice(0, cut))
                    yield settle(held)
                    held, n = [], 0
                    batch = batch.slice(cut)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield settle(held)

    dealt = strings.repartition("k").sortWithinPartitions("k")
    return dealt.mapInArrow(run, "doc bigint, first bigint, last bigint")


def _fetched(docs: DataFrame, wanted: DataFrame, length: int, spread: bool) -> DataFrame:
    """Texts of the wanted runs: as ``(k, doc, loc, s)``, or spread as windows ``(h1, h2, doc, first)``."""
    schema = "h1 bigint, h2 bigint, doc bigint, first bigint" if spread else "k bigint, doc bigint, loc bigint, s binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            data, offsets = T.flat(batch.column(1))
            lists = batch.column(2)
            values = lists.flatten()
            k, loc = values.field("k").to_numpy(), values.field("loc").to_numpy()
            cuts = _cuts(lists)
            row = np.repeat(np.arange(len(ids)), np.diff(cuts))
            off, _, count = _unpack(loc)
            start = offsets[row] + off
            step = 1 << 15
            for a in range(0, len(k), step):
                s, c, r = start[a : a + step], count[a : a + step], row[a : a + step]
                size = c + length - 1
                place = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(size.sum())
                own = data[place]
                ends = np.append(0, np.cumsum(size))
                if not spread:
                    text = pa.Array.from_buffers(
                        pa.binary(), len(s), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(own.tobytes())]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k[a : a + step]), pa.array(ids[r]), pa.array(loc[a : a + step]), text], ["k", "doc", "loc", "s"]
                    )
                    continue
                shift = np.repeat(ends[:-1] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                h1, h2 = (Prefix(own, v).of(shift, shift + length).view(np.int64) for v in (_BYTE, _BYTE2))
                first = np.repeat(off[a : a + step] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1), pa.array(h2), pa.array(np.repeat(ids[r], c)), pa.array(first)], ["h1", "h2", "doc", "first"]
                )

    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("k", "loc")).alias("runs"))
    joined = docs.join(lists.hint("merge"), "doc")
    return joined.select("doc", "text", "runs").mapInArrow(run, schema)


def _numbered(docs: DataFrame, key: str, text: str, work: Work) -> DataFrame:
    """Add ``doc``, a whole number in the order of key and hash of the text.

    Only needed where keys repeat or are null: else the key itself is the number.
    """
    hashed = docs.withColumn("_h", F.xxhash64(text))
    keys = hashed.select(F.col(key).cast("bigint").alias("key"), F.col("_h").alias("h")).distinct()
    order = [F.col("key").asc_nulls_first(), F.col("h")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            new = pa.array(np.arange(n, n + b.num_rows))
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), new], ["key", "h", "part", "i"])

    ranged = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = work.keep(ranged.mapInArrow(count, "key bigint, h bigint, part int, i bigint"), "keys")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbers = placed.join(sizes, "part").select(F.col("key").alias("_key"), "h", (F.col("base") + F.col("i")).alias("doc"))
    same = F.col(key).cast("bigint").eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("h"))
    return hashed.join(numbers, same).drop("_key", "_h", "h")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, work: Work | None = None) -> DataFrame:
    """``doc, spans``: the spans ``[first, last)`` of ``docs (doc, text)`` that repeat earlier ones."""
    if not gram <= length <= 255 or length - gram > 200:
        raise ValueError("a window has at most 255 bytes, and a gram not much less")
    work = work or Work(docs.sparkSession, "suffix")
    docs = docs.select("doc", "text")
    named = work.keep(_named(_all_runs(docs, length, gram), length), "named")
    spans = named.filter("k IS NULL").select("doc", "first", "last")
    open_ = named.filter("k IS NOT NULL").select("doc", F.col("first").alias("loc"), "k")
    hot = work.keep(open_.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_RUNS).select("k"), "hot")
    n_hot = hot.count()
    if n_hot:
        few = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        cold = open_.join(few, "k", "left_anti")
        windows = _fetched(docs, open_.join(few, "k", "left_semi"), length, spread=True)
        windows = work.keep(windows, "windows")
        eldest = windows.groupBy("h1", "h2").agg(
            F.min(F.struct("doc", "first")).alias("e"), F.count(F.lit(1)).alias("n")
        ).filter("n > 1").select("h1", "h2", "e")
        again = windows.join(eldest, ["h1", "h2"]).filter(F.struct("doc", "first") != F.col("e"))
        spans = spans.unionByName(again.select("doc", "first", (F.col("first") + length).alias("last")))
    else:
        cold = open_
    if not cold.isEmpty():
        spans = spans.unionByName(_induced(_fetched(docs, cold, length, spread=False), length))
    return work.keep(spans.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")


def _with_spans(docs: DataFrame, key: str, text: str, length: int, gram: int) -> DataFrame:
    """All rows of ``docs`` with ``spans``; columns are called c0, c1 … so that no name can clash."""
    work = Work(docs.sparkSession, "suffix")
    names = [f"c{i}" for i in range(len(docs.columns))]
    k, t = (names[docs.columns.index(c)] for c in (key, text))
    plain = docs.toDF(*names)
    number = F.col(k).cast("bigint")
    keys = plain.groupBy(number.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    seen = keys.agg(F.max("n").alias("most"), F.count(F.when(F.col("k").isNull(), 1)).alias("nulls")).first()
    if (seen["most"] or 0) <= 1 and not seen["nulls"]:
        plain = plain.withColumn("doc", number)
        found = repeats(plain.select("doc", F.col(t).alias("text")), length, gram, work)
    else:
        plain = work.keep(_numbered(plain, k, t, work), "rows")
        found = repeats(plain.select("doc", F.col(t).alias("text")).dropDuplicates(["doc"]), length, gram, work)
    return plain.join(found.hint("merge"), "doc", "left").select(*names, "spans")


def _union(lists: pa.Array, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint, unconnected spans of each row: row, first, last."""
    values = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(cuts))
    m = _merged(row, values.field("first").to_numpy(), values.field("last").to_numpy())
    return tuple(m.column(i).to_numpy() for i in range(3))


def _cuts(lists: pa.Array) -> np.ndarray:
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(sizes)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of rows with the bytes and offsets of their texts, so that memory follows a block."""
    for batch in batches:
        data, offsets = T.flat(batch.column(text))
        for a, b in T.blocks(offsets):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _kept(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    edge = np.zeros(len(data) + 1, np.int32)
    edge[first] += 1
    edge[last] -= 1  # spans are disjoint and do not touch
    return np.cumsum(edge[:-1]) == 0


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    rows = _with_spans(docs.select(key, text), key, text, length, gram)
    schema = f"{key} bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _blocks(batches, 1):
            lists = batch.column(2)
            row, first, last = _union(lists, _cuts(lists))
            kept = _kept(data, first + offsets[row], last + offsets[row]) if len(row) else np.ones(len(data), bool)
            n = np.diff(offsets)
            raw = data[kept].tobytes()
            at = np.append(0, np.cumsum(kept))[offsets].tolist()
            removed = n - np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n), pa.array(removed), pa.array(np.bincount(row, minlength=len(n)).astype(np.int64)),
                    pa.array([sha256(raw[i:j]).hexdigest() for i, j in zip(at, at[1:])], pa.string()),
                ],
                [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.select(F.col("c0").cast("bigint"), "c1", "spans").mapInArrow(run, schema)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents without their repeats; all rows and columns stay.

    A span that cuts a character keeps all of it, so what is left is text. A null text
    stays null.
    """
    rows = _with_spans(docs, key, text, length, gram)
    place, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _blocks(batches, place):
            *columns, spans = batch.columns
            column = columns[place]
            row, first, last = _union(spans, _cuts(spans))
            if len(row):
                kept = _kept(data, first + offsets[row], last + offsets[row])
                # A character goes only if all of its bytes do.
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                kept = np.repeat(np.maximum.reduceat(kept, lead), np.diff(np.append(lead, len(data))))
                raw = data[kept].tobytes()
                at = np.append(0, np.cumsum(kept))[offsets].tolist()
                valid = column.is_valid().to_pylist()
                column = pa.array(
                    [raw[i:j].decode("utf-8", "replace") if v else None for i, j, v in zip(at, at[1:], valid)], column.type
                )
            columns[place] = column
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, docs.schema)
