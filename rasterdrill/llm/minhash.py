"""Near-duplicates by one-permutation hashing, and components of confirmed links.

A text's set holds its distinct shingles of ``k`` words. One hash per shingle deals
it to one of ``bands * rows`` bins by its top bits; a bin's value is its smallest
hash. An empty bin takes the value of a filled one that a hash of (bin, attempt)
names ("Optimal Densification for Fast and Accurate Minwise Hashing", 2017). Each
band of ``rows`` bins is a bucket key; at 40 bands of 5 a pair of similarity 0.8
misses every bucket with a chance of 1e-7.

Texts of equal sets are one node. In a bucket only pairs with one node, the centre,
are candidates: a star, whose size is the bucket's. Candidates are confirmed on the
full sets. Then components are found, and buckets that still hold several get one
more star, around a node of the component with the fewest members there.

Sizes and sketches rule out candidates of a star before texts move. Sketches hold a
byte for each of ``SKETCH`` bins of the same permutation; a pair of similarity 0.8 is
ruled out with a chance of 1e-6.

What is left are few buckets with nodes that linked to no centre. So that no link is
lost, those nodes are compared with all others of their buckets, in groups of bounded
size, on sets of 32-bit hashes, which never hide a link. Only a spanning forest of the
links found leaves a task, to be confirmed like the others. Links inside a component
are never looked for.

Defined results: null or wordless texts have an empty set, link to nothing and are
kept; a text of fewer than ``k`` words has its whole word sequence as its one
shingle; rows of one id are one document, linked where any of its texts is; rows
with a null id have a null component and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterdrill.llm import text as T
from rasterdrill.llm.components import components
from rasterdrill.llm.store import Work

BANDS, ROWS = 40, 5
STAR_ROUNDS = 2
SKETCH = 512
# Nodes of a bucket compared in one group, on either side.
GROUP_NODES = 512
# Ids in a broadcast set: 8 bytes each, so at most some 32 MB in the JVM.
BROADCAST_IDS = 1_000_000
_SIGMAS = 4.8
_ATTEMPTS = 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, rising, one text after the other; offsets."""
    n = len(offsets) - 1
    w = T.words(T.LOWER[data], offsets, T.NOT_SPACE)
    count = np.bincount(w.text, minlength=n) if len(w.text) else np.zeros(n, np.int64)
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    each = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.zeros(n + 1, np.int64)
    np.cumsum(each, out=at[1:])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    first = np.repeat(begin[:-1] - at[:-1], each) + np.arange(at[-1])
    size = np.repeat(np.minimum(count, k), each)
    h = size.astype(np.uint64)
    for j in range(k):
        here = size > j
        word = w.hash[np.minimum(first + j, len(w.hash) - 1)]
        h = np.where(here, T.mix(h * np.uint64(0x9FB21C651E98DF25) + word), h)
    for i in np.flatnonzero(each > 1):
        h[at[i] : at[i + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][each > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return h[new], kept[at]


def _attempts(bins: int) -> np.ndarray:
    tries = np.arange(bins * _ATTEMPTS, dtype=np.uint64).reshape(bins, _ATTEMPTS)
    return (T.mix(tries + np.uint64(77)) % np.uint64(bins)).astype(np.int64)


def bin_minima(sets: np.ndarray, at: np.ndarray, bins: int, attempts: np.ndarray) -> np.ndarray:
    """Smallest hash per text and bin, with empty bins densified; 0 for an empty text."""
    n = len(at) - 1
    out = np.zeros((n, bins), np.uint64)
    if not len(sets):
        return out
    text = np.repeat(np.arange(n), np.diff(at))
    slot = ((sets >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    slot = slot.astype(np.int64)
    first = np.ones(len(sets), bool)
    first[1:] = (slot[1:] != slot[:-1]) | (text[1:] != text[:-1])
    filled = np.zeros((n, bins), bool)
    filled[text[first], slot[first]] = True
    out[text[first], slot[first]] = sets[first]
    i, b = np.nonzero(~filled & (np.diff(at) > 0)[:, None])
    t = 0
    while len(i):
        if t < _ATTEMPTS:
            source = attempts[b, t]
        else:  # all but impossible; any fixed rule keeps equal sets equal
            source = (b + t) % bins
        ok = filled[i, source]
        out[i[ok], b[ok]] = out[i[ok], source[ok]]
        i, b, t = i[~ok], b[~ok], t + 1
    return out


def signatures(docs: DataFrame, key: str, text: str, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id, n, fp1, fp2, bands, sketch`` per row; a set's fingerprint has 128 bits."""
    schema = "id bigint, n bigint, fp1 bigint, fp2 bigint, bands array<bigint>, sketch binary"
    bins = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempts, wider = _attempts(bins), _attempts(SKETCH)
        salt = T.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            data, offsets = T.flat(batch.column(1))
            for a, b in T.blocks(offsets):
                own = offsets[a : b + 1] - offsets[a]
                sets, at = shingle_sets(data[offsets[a] : offsets[b]], own, k)
                n = np.diff(at)
                fps = []
                for s in (0x51, 0xA7):
                    run = np.concatenate([[0], np.cumsum(T.mix(sets ^ np.uint64(s * 0x0101010101010101)))])
                    run = run.astype(np.uint64)
                    fps.append((run[at[1:]] - run[at[:-1]]).view(np.int64))
                low = bin_minima(sets, at, bins, attempts)
                h = np.broadcast_to(salt, (len(n), bands)).copy()
                for r in range(rows):
                    h = T.mix(h * np.uint64(0x9FB21C651E98DF25) + low[:, r::rows])
                values = np.ascontiguousarray(h).view(np.int64).ravel()
                ends = np.arange(len(n) + 1, dtype=np.int32)
                wide = T.mix(bin_minima(sets, at, SKETCH, wider)).astype(np.uint8)
                sketch = pa.Array.from_buffers(
                    pa.binary(), len(n),
                    [None, pa.py_buffer(ends * np.int32(SKETCH)), pa.py_buffer(wide.tobytes())],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(n), *map(pa.array, fps),
                        pa.ListArray.from_arrays(pa.array(ends * np.int32(bands)), pa.array(values)), sketch,
                    ],
                    ["id", "n", "fp1", "fp2", "bands", "sketch"],
                )

    return docs.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(sign, schema)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a set of ids only if it was counted to be small; else shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df.hint("merge")


def _least_agreement(na: np.ndarray, nb: np.ndarray, goal: float) -> np.ndarray:
    """Share of equal sketch bytes below which a pair cannot be hoped to reach the goal."""
    seen = np.minimum(SKETCH, np.maximum(na, nb))
    return goal - _SIGMAS * np.sqrt(goal * (1 - goal) / seen)


def _likely(pairs: DataFrame, n_pairs: int, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes can, and whose sketches may, reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = nodes.select("id", "n", "sketch").join(_few(ids, 2 * n_pairs), "id", "left_semi")

    def side(c: str) -> DataFrame:
        return held.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = joined.filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    goal = percent / 100

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sa", "sb"))
            least = _least_agreement(b.column("na").to_numpy(), b.column("nb").to_numpy(), goal)
            keep = pa.array((x == y).mean(1) >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(agree, "a bigint, b bigint").distinct()


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which links to keep for a spanning forest."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def _short_sets(docs: DataFrame, ids: DataFrame, n_ids: int, k: int) -> DataFrame:
    """``id, s``: the upper halves of the shingle hashes of the wanted documents, rising."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.flat(batch.column(1))
            for a, b in T.blocks(offsets):
                sets, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                raw = (sets >> np.uint64(32)).astype("<u4").tobytes()
                column = pa.Array.from_buffers(
                    pa.binary(), b - a, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(raw)]
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), column], ["id", "s"])

    wanted = docs.join(_few(ids, n_ids), "id", "left_semi").select("id", "t")
    return wanted.mapInArrow(run, "id bigint, s binary")


def _rest(held: DataFrame, docs: DataFrame, k: int, percent: int, thin: bool, work: Work) -> DataFrame:
    """Links between components in ``held (bucket, id, comp)``, by groups of a bucket.

    A node outside its bucket's largest component asks all others of the bucket. Askers and
    asked are dealt to groups of some ``GROUP_NODES`` each.
    """
    per = held.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("bucket").agg(
        F.max(F.struct("n", "comp")).alias("big"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("comps")
    ).filter("comps > 1")
    rows = work.keep(
        held.join(mixed, "bucket").select(
            "bucket", "id", "comp", (F.col("comp") != F.col("big.comp")).alias("asks"),
            F.ceil(F.col("size") / GROUP_NODES).alias("m"), F.ceil((F.col("size") - F.col("big.n")) / GROUP_NODES).alias("q"),
        ),
        "rest",
    )
    h = F.xxhash64("id")
    to = F.struct(F.pmod(h, "m").alias("m"), F.col("i").alias("q"), F.lit(False).alias("asker"))
    asked = rows.select("bucket", "id", "comp", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("q") - 1)).alias("i"))
    asked = asked.select("bucket", "id", "comp", to.alias("g"))
    to = F.struct(F.col("i").alias("m"), F.pmod(h, "q").alias("q"), F.lit(True).alias("asker"))
    askers = rows.filter("asks").select("bucket", "id", "comp", "q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("i"))
    askers = askers.select("bucket", "id", "comp", to.alias("g"))
    dealt = asked.unionByName(askers).select(F.xxhash64("bucket", "g.m", "g.q").alias("g"), "id", "comp", "g.asker")
    ids = work.keep(rows.select("id").distinct(), "ids")
    sets = _short_sets(docs, ids, ids.count(), k)
    dealt = dealt.join(sets.hint("merge"), "id").select("g", "asker", "id", "comp", "s")

    def group(rows: pa.Table) -> pa.RecordBatch:
        asker = rows.column(1).to_numpy()
        ids, comp = (rows.column(i).to_numpy() for i in (2, 3))
        sets = [np.frombuffer(x, "<u4") for x in rows.column(4).to_pylist()]
        n = np.array([len(x) for x in sets])
        at, to = np.flatnonzero(asker), np.flatnonzero(~asker)
        found = []
        for i in at:
            other = to[(comp[to] != comp[i]) & (100 * np.minimum(n[to], n[i]) >= percent * np.maximum(n[to], n[i]))]
            if not len(other):
                continue
            flat = np.concatenate([sets[j] for j in other])
            place = np.searchsorted(sets[i], flat)
            place[place == n[i]] = 0
            run = np.append(0, np.cumsum(sets[i][place] == flat))
            ends = np.cumsum(n[other])
            both = run[ends] - run[ends - n[other]]
            ok = 100 * both >= percent * (n[i] + n[other] - both)
            found.append((np.full(int(ok.sum()), ids[i]), ids[other[ok]]))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (ids[:0], ids[:0])
        a, b = np.minimum(a, b), np.maximum(a, b)
        keep = _forest(a, b) if thin else np.ones(len(a), bool)
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                g = b.column(0).to_numpy()
                own = held[0].column(0)[0].as_py() if held else g[0]
                other = np.flatnonzero(g != own)
                cut = int(other[0]) if len(other) else b.num_rows
                if cut:
                    held.append(b.slice(0, cut))
                if cut < b.num_rows:
                    yield group(pa.Table.from_batches(held))
                    held = []
                b = b.slice(cut)
        if held:
            yield group(pa.Table.from_batches(held))

    grouped = dealt.repartition("g").sortWithinPartitions("g")
    return grouped.mapInArrow(run, "a bigint, b bigint").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, n_pairs: int, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold; only texts of their ids move."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.join(_few(ids, 2 * n_pairs), "id", "left_semi")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [T.flat(batch.column(c)) for c in ("ta", "tb")]
            keep = np.zeros(batch.num_rows, bool)
            total = sides[0][1] + sides[1][1]
            for i, j in T.blocks(total):
                (x, ax), (y, ay) = (
                    shingle_sets(d[o[i] : o[j]], o[i : j + 1] - o[i], k) for d, o in sides
                )
                for p in range(j - i):
                    u, v = x[ax[p] : ax[p + 1]], y[ay[p] : ay[p + 1]]
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    keep[i + p] = both > 0 and 100 * both >= percent * (len(u) + len(v) - both)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    side = texts.hint("merge")
    joined = pairs.join(side.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
    joined = joined.join(side.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80,
    bands: int = BANDS, rows: int = ROWS, work: Work | None = None,
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``."""
    work = work or Work(docs.sparkSession, "minhash")
    sig = work.keep(signatures(docs, key, text, k, bands, rows), "sig")
    real = sig.filter("n > 0 AND id IS NOT NULL")
    same = ["fp1", "fp2", "n"]
    reps = real.groupBy(*same).agg(F.min("id").alias("rep"))
    own = F.col("id") == F.col("rep")
    mapped = work.keep(
        real.join(reps, same).select(
            "id", "n", "rep", F.when(own, F.col("bands")).alias("bands"), F.when(own, F.col("sketch")).alias("sketch")
        ),
        "map",
    )
    nodes = mapped.filter(own).select("id", "n", "bands", "sketch")
    members = nodes.select(F.explode("bands").alias("bucket"), "id")
    shared = members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    live = work.keep(members.join(shared.select("bucket"), "bucket"), "live")
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    # Texts of one id are one document: where their sets differ, their nodes are linked.
    several = mapped.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).filter("a < hi")
    labels, n_labels = components(
        mapped.select("id", F.col("rep").alias("b")).join(several, "id").select("a", "b"), work
    )
    checked, turn = None, 0
    while True:
        held = live.select("bucket", "id").join(_few(labels, n_labels), "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"))
        if turn < STAR_ROUNDS:
            centre = (
                held.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"))
                .groupBy("bucket").agg(F.min(F.struct("n", "lo", "comp")).alias("c"), F.count(F.lit(1)).alias("comps"))
                .filter("comps > 1")
                .select("bucket", F.col("c.lo").alias("centre"), F.col("c.comp").alias("own"))
            )
            live = work.keep(held.join(centre, "bucket").select("bucket", "id", "comp", "centre", "own"), "live")
            pairs = live.filter("comp <> own").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
            pairs = work.keep(pairs.distinct(), "pairs")
            likely = _likely(pairs, pairs.count(), nodes, percent)
        else:
            likely = _rest(held, texts, k, percent, turn == STAR_ROUNDS, work)
        if turn == STAR_ROUNDS:
            likely = work.keep(likely, "forest")
            n_forest = likely.count()
        if checked is not None:
            likely = likely.join(checked, ["a", "b"], "left_anti")
        likely = work.keep(likely, "likely")
        n, confirmed = likely.count(), 0
        if n:
            links = work.keep(_confirmed(likely, texts, n, k, percent), "links")
            confirmed = links.count()
            before = labels.select(F.col("comp").alias("a"), F.col("id").alias("b"))
            labels, n_labels = components(links.unionByName(before), work)
            checked = likely if checked is None else checked.unionByName(likely)
        turn += 1
        # A turn that looked at all that is left is the last, unless a link of its forest was none,
        # now or in a star round before.
        if turn > STAR_ROUNDS and confirmed == (n_forest if turn == STAR_ROUNDS + 1 else n):
            break
    # A row's class is its representative's, whose own smallest row is the class's smallest.
    found = (
        mapped.select("rep", F.col("id").alias("row")).join(_few(labels.withColumnRenamed("id", "rep"), n_labels), "rep", "left")
        .select("row", F.coalesce("comp", "rep").alias("component_id"))
        .groupBy("row").agg(F.min("component_id").alias("component_id"))
    )
    return (
        sig.select("id", F.col("n").alias("n_shingles"))
        .join(found.withColumnRenamed("row", "id"), "id", "left")
        .withColumn("component_id", F.coalesce("component_id", "id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class, that of the smallest id, with all its columns.

    Of rows of one id that of the smallest text hash stays, then of the smallest text and
    other columns; rows with a null id stay.
    """
    work = Work(docs.sparkSession, "minhash")
    found = near_duplicates(docs, key, text, k, percent, work=work)
    gone = work.keep(found.filter(~F.col("kept")).select(F.col("id").alias("_gone")).distinct(), "gone")
    single = found.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    number = F.col(key).cast("bigint")
    left = docs.join(_few(gone, gone.count()), number == F.col("_gone"), "left_anti")
    if single:
        return left
    # Maps have no order.
    other = [f.name for f in docs.schema if f.name != text and "map<" not in f.dataType.simpleString()]
    first = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64(text), text, *other)).alias("_first")
    one = left.filter(number.isNotNull()).groupBy(number.alias("_id")).agg(first).select("_first.*")
    return one.unionByName(left.filter(number.isNull()))
