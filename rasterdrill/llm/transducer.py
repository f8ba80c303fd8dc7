"""Source divergence audit over a vocabulary held as minimal acyclic transducers.

Vocabulary. The kept terms of a language (in at least ``least`` of its documents) are
numbered in lexicographic order of their UTF-8 bytes by a range sort. Each shard of that
order is built into a minimal acyclic automaton: sorted terms are added one after the
other, and the finished tail of the last one is merged with an equal state ("Incremental
Construction of Minimal Acyclic Finite-State Automata", 2000). A state knows how many
terms lie behind it, so the edges of a term sum to its ordinal.

Recounting. Texts are streamed through the transducers: all distinct words of a block
walk at once, an edge per step, and either fall off or end at an ordinal. Counts are
folded per task and packed by (language, source, run of ordinals) before they move. The
transducers go to tasks in blocks of at most ``BLOCK_BYTES``, one pass over the texts for
each, so a broadcast has a bound whatever the vocabulary.

Divergence. A group's probability of a term is 1 + floor(scale * (count + add) / (N + add * V)) in
whole numbers. Pairs of sources are compared in tiles of sources by runs of ordinals;
what a source has never seen is one number, so only seen terms move. Ties of terms go to
the smaller ordinal.

Defined results. Null text, language and source are ''. A repeated row is one more
document. A group without terms is compared like any other; where a language keeps no
term all pairs have value 0 and there is no term part. Equal values rank by the UTF-8
order of the item. An empty table gives an empty one; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterdrill.llm import spans as S
from rasterdrill.llm import text as T
from rasterdrill.llm import vocab
from rasterdrill.llm.store import Work

# Terms are ASCII letters and all bytes above ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

SHARD = 100_000  # terms of a transducer
BLOCK_BYTES = 64 << 20
RUN = 1024  # ordinals counted in one row
TILE = 1024  # sources compared at once
# (group, ordinal) counts a task holds before it hands them on.
FOLD = 1_000_000


class Transducer(NamedTuple):
    """States with sorted edges: ``edge`` is state * 256 + byte; the root is the last state."""

    edge: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    final: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self)


def build(terms: list[bytes]) -> Transducer:
    """Minimal transducer of sorted, distinct terms; a term's ordinal is its place in the list."""
    register: dict[tuple, int] = {}
    behind: list[int] = []  # terms that end in or after a finished state
    states: list[tuple] = []

    def finish(node: list) -> int:
        final, arms = node
        key = (final, *arms)
        number = register.get(key)
        if number is None:
            number = register[key] = len(states)
            states.append(key)
            behind.append(final + sum(behind[t] for _, t in arms))
        return number

    path: list[list] = [[False, []]]  # unfinished states of the last term
    spelled = b""
    for term in terms:
        common = 0
        top = min(len(term), len(spelled))
        while common < top and term[common] == spelled[common]:
            common += 1
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1].append((spelled[len(path) - 1], finish(node)))
        path.extend([False, []] for _ in range(len(term) - common))
        path[-1][0] = True
        spelled = term
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((spelled[len(path) - 1], finish(node)))
    # The root is numbered apart, so that it is the last state even where it equals another.
    states.append((path[0][0], *path[0][1]))
    edge, target, weight = [], [], []
    for number, (final, *arms) in enumerate(states):
        passed = int(final)
        for byte, to in arms:
            edge.append(number << 8 | byte)
            target.append(to)
            weight.append(passed)
            passed += behind[to]
    return Transducer(
        np.array(edge, np.int64), np.array(target, np.int32), np.array(weight, np.int32),
        np.array([s[0] for s in states], bool),
    )


def ordinals(t: Transducer, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ordinal of each byte run, or -1: all walk at once, those that fall off stop."""
    out = np.full(len(start), -1, np.int64)
    alive = np.arange(len(start))
    state = np.full(len(start), len(t.final) - 1, np.int64)
    total = np.zeros(len(start), np.int64)
    at = start.copy()
    while len(alive):
        done = at == end[alive]
        if done.any():
            hit = done & t.final[state]
            out[alive[hit]] = total[hit]
            go = ~done
            alive, state, total, at = alive[go], state[go], total[go], at[go]
        if not len(t.edge) or not len(alive):
            break
        key = state << 8 | data[at]
        place = np.minimum(np.searchsorted(t.edge, key), len(t.edge) - 1)
        go = t.edge[place] == key
        place = place[go]
        alive, total, at = alive[go], total[go] + t.weight[place], at[go] + 1
        state = t.target[place].astype(np.int64)
    return out


def kept_terms(docs: DataFrame, least: int, work: Work) -> DataFrame:
    """``lang, term, ord`` of the terms in at least ``least`` documents of a language; ``ord`` from 0 in UTF-8 order."""
    spark = docs.sparkSession
    counts = vocab.counted(docs, LETTERS, in_texts=True).groupBy("lang", F.col("word").alias("term")).agg(F.sum("n").alias("n"))
    kept = work.keep(counts.filter(F.col("n") >= least).select("lang", "term"), "terms")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lang, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            tag = vocab.tags(b.column(0), 0)
            at = np.flatnonzero(np.append(True, tag[1:] != tag[:-1]))
            place = np.arange(b.num_rows) - np.repeat(at, np.diff(np.append(at, b.num_rows)))
            if b.column(0)[0].as_py() == lang:
                place[: at[1] if len(at) > 1 else b.num_rows] += n
            lang, n = b.column(0)[-1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(place)], ["lang", "term", "part", "i"])

    ranged = kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    placed = work.keep(ranged.mapInArrow(count, "lang string, term string, part int, i bigint"), "placed")
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sizes = placed.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("lang", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(base, ["lang", "part"]).select("lang", "term", (F.col("base") + F.col("i")).alias("ord"))


_SHARDS = "lang string, base bigint, edge binary, target binary, weight binary, final binary"


def transducers(terms: DataFrame) -> DataFrame:
    """A row per shard of ``terms (lang, term, ord)``: its first ordinal and its transducer."""
    names = ["lang", "base", "edge", "target", "weight", "final"]

    def close(lang: str, base: int, held: list[bytes]) -> pa.RecordBatch:
        t = build(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([base]), *[pa.array([x.tobytes()], pa.binary()) for x in t]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, held = None, 0, []
        for b in batches:
            for lang, shard, place, term in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (lang, shard) != now:
                    if held:
                        yield close(now[0], base, held)
                    now, base, held = (lang, shard), place, []
                held.append(term)
        if held:
            yield close(now[0], base, held)

    cut = terms.select("lang", F.floor(F.col("ord") / SHARD).alias("shard"), "ord", F.col("term").cast("binary").alias("term"))
    return cut.repartition("lang", "shard").sortWithinPartitions("lang", "shard", "ord").mapInArrow(run, _SHARDS)


def _loaded(rows: list) -> list[tuple[str, int, Transducer]]:
    return [
        (r["lang"], r["base"], Transducer(*(np.frombuffer(r[c], d) for c, d in
         (("edge", np.int64), ("target", np.int32), ("weight", np.int32), ("final", bool)))))
        for r in rows
    ]


def _streamed(docs: DataFrame, block: list) -> DataFrame:
    """Packed counts of ``docs (lang, source, text)``: the words that end in a transducer of ``block``."""
    names = ["lang", "source", "run", "ords", "counts"]
    shipped = docs.sparkSession.sparkContext.broadcast(block)

    def emit(held: list, groups: list[tuple]) -> pa.RecordBatch:
        group, place, n = (np.concatenate(x) for x in zip(*held))
        key = group << 40 | place
        known, inverse = np.unique(key, return_inverse=True)
        n = np.bincount(inverse, n).astype(np.int64)
        at = np.flatnonzero(np.append(True, known[1:] // RUN != known[:-1] // RUN))
        cuts = np.append(at, len(known)).tolist()
        own = (known % RUN).astype(np.uint16)
        lang, source = zip(*(groups[g] for g in (known[at] >> 40).tolist()))
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array((known[at] & ((1 << 40) - 1)) // RUN),
             pa.array([S.planes(own[i:j]) for i, j in zip(cuts, cuts[1:])], pa.binary()),
             pa.array([S.planes(n[i:j]) for i, j in zip(cuts, cuts[1:])], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list] = {}
        for lang, base, t in _loaded(shipped.value):
            by_lang.setdefault(lang, []).append((base, t))
        held, size, groups, number = [], 0, [], {}
        for batch, data, offsets in S.text_blocks(batches, 2):
            data = T.LOWER[data]
            w = S.words(data, offsets, LETTERS)
            if not len(w.start):
                continue
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for p in set(pairs) - number.keys():
                number[p] = len(groups)
                groups.append(p)
            mine = np.array([number[p] for p in pairs])[w.text]
            ids = vocab.numbers(w, vocab.tags(batch.column(0), 0))
            _, at, word = np.unique(ids, return_index=True, return_inverse=True)
            place = np.full(len(at), -1, np.int64)
            spoken = np.array([p[0] for p in pairs], object)[w.text[at]]
            for lang in set(spoken.tolist()) & by_lang.keys():
                own = np.flatnonzero(spoken == lang)
                for base, t in by_lang[lang]:
                    found = ordinals(t, data, w.start[at[own]], w.end[at[own]])
                    hit = found >= 0
                    place[own[hit]] = base + found[hit]
            where = place[word]
            hit = where >= 0
            known, n = np.unique(mine[hit] << 40 | where[hit], return_counts=True)
            if not len(known):
                continue
            held.append((known >> 40, known & ((1 << 40) - 1), n))
            size += len(known)
            if size >= FOLD:
                yield emit(held, groups)
                held, size = [], 0
        if held:
            yield emit(held, groups)

    return docs.mapInArrow(run, "lang string, source string, run bigint, ords binary, counts binary")


def recounted(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """``lang, source, ord, n``: occurrences of each term that occurs, by streaming texts through ``shards``."""
    sized = shards.select("lang", "base", F.expr("octet_length(edge) + octet_length(target) + octet_length(weight) + octet_length(final)").alias("size"))
    blocks, room = [[]], 0
    for r in sized.orderBy("lang", "base").collect():  # a row per shard of 100,000 terms
        if room + r["size"] > BLOCK_BYTES and blocks[-1]:
            blocks.append([])
            room = 0
        blocks[-1].append((r["lang"], r["base"]))
        room += r["size"]
    out = None
    for block in blocks:
        chosen = " OR ".join("(lang = '{}' AND base = {})".format(lang.replace("\\", "\\\\").replace("'", "\\'"), base) for lang, base in block) or "false"
        part = _streamed(docs, shards.filter(chosen).collect())
        out = part if out is None else out.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def close() -> pa.RecordBatch:
            seen = np.flatnonzero(total)
            lang, source, first = now
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array([source] * len(seen), pa.string()),
                 pa.array(first * RUN + seen), pa.array(total[seen])], ["lang", "source", "ord", "n"])

        for b in batches:
            for lang, source, first, own, n in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (lang, source, first) != now:
                    if now:
                        yield close()
                    now, total = (lang, source, first), np.zeros(RUN, np.int64)
                total[S.from_planes(own, np.uint16)] += S.from_planes(n, np.int64)
        if now:
            yield close()

    keys = ["lang", "source", "run"]
    return out.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "lang string, source string, ord bigint, n bigint")


def _share(n: str, total: str, kept: str, add: int, scale: int) -> F.Column:
    """1 + floor(scale * (n + add) / (total + add * kept)), exact beyond 64 bits."""
    wide = "DECIMAL(20,0)"
    return F.expr(
        f"1 + (CAST({scale} AS DECIMAL(11,0)) * CAST({n} + {add} AS {wide})) div CAST({total} + {add} * {kept} AS {wide})"
    ).cast("bigint")


def _pairs(shares: DataFrame, groups: DataFrame, runs: DataFrame) -> DataFrame:
    """``lang, a, b, value``: summed differences of every two sources of a language.

    ``shares (lang, no, ord, p)`` are the seen terms, ``groups (lang, no, p0, tiles)`` all sources
    with the share of an unseen term, ``runs (lang, run, size)`` the runs of ordinals. A task
    holds two tiles of sources by one run.
    """
    head = groups.join(runs, "lang").select("lang", "run", "no", "tiles", "size", F.lit(-1).alias("at"), F.col("p0").alias("p"))
    body = shares.select("lang", F.floor(F.col("ord") / RUN).alias("run"), "no", "tiles", F.lit(0).alias("size"),
                         (F.col("ord") % RUN).cast("int").alias("at"), "p")
    mine = F.floor(F.col("no") / TILE).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = head.unionByName(body).withColumn("tile", mine).withColumn("other", other)
    rows = rows.select("lang", "run", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "no", "size", "at", "p")
    keys = ["lang", "run", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            no, size, at, p = (np.concatenate(x) for x in zip(*held))
            first = at < 0
            known = np.sort(no[first])
            grid = np.empty((len(known), int(size.max())), np.int64)
            grid[:] = p[first][np.argsort(no[first])][:, None]
            grid[np.searchsorted(known, no[~first]), at[~first]] = p[~first]
            right = known // TILE == now[3]
            for i in np.flatnonzero(known // TILE == now[2]):
                b = np.flatnonzero(right & (known > known[i]))
                if len(b):
                    value = np.abs(grid[b] - grid[i]).sum(1)
                    a = np.full(len(b), known[i])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([now[0]] * len(b), pa.string()), pa.array(a), pa.array(known[b]), pa.array(value)], ["lang", "a", "b", "value"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3)]
            values = [batch.column(i).to_numpy() for i in (4, 5, 6, 7)]
            marks = list(zip(*columns))
            cuts = [0, *[i for i in range(1, len(marks)) if marks[i] != marks[i - 1]], len(marks)]
            for i, j in zip(cuts, cuts[1:]):
                if marks[i] != now:
                    if held:
                        yield from close()
                    now, held = marks[i], []
                held.append([v[i:j] for v in values])
        if held:
            yield from close()

    parts = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "lang string, a bigint, b bigint, value bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame, least: int = 30, add: int = 5, scale: int = 1_000_000_000, top: int = 50,
    text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language.

    Part ``pair`` sums the differences to another source over all kept terms; part ``term``
    names the ``top`` terms that the source uses more than its language does.
    """
    work = Work(docs.sparkSession, "audit")
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    terms = work.keep(kept_terms(plain, least, work), "vocabulary")
    shards = work.keep(transducers(terms), "transducers")
    counts = work.keep(recounted(plain, shards), "counts")

    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("lang").orderBy("source")  # a row per source
    groups = work.keep(
        plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"),
                (F.row_number().over(order) - 1).cast("bigint").alias("no"),
                F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / TILE).cast("int").alias("tiles")),
        "groups",
    )
    seen = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "kept", add, scale))

    unseen = groups.filter("kept > 0").withColumn("n", F.lit(0)).withColumn("p0", _share("n", "total", "kept", add, scale))
    runs = kept.select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("kept") - 1) / RUN))).alias("run"), "kept")
    runs = runs.select("lang", "run", F.least(F.lit(RUN), F.col("kept") - F.col("run") * RUN).cast("int").alias("size"))
    half = work.keep(_pairs(seen, unseen.select("lang", "no", "p0", "tiles"), runs), "pairs")
    names = groups.select("lang", "no", "source")
    both = half.select("lang", "a", "b", "value").unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    # Languages that keep no term: every pair at 0.
    void = groups.filter("kept = 0")
    both = both.join(names.withColumnRenamed("no", "a"), ["lang", "a"]).join(
        names.select("lang", F.col("no").alias("b"), F.col("source").alias("item")), ["lang", "b"]
    ).select("lang", "source", "item", "value").unionByName(
        void.select("lang", "source").join(void.select("lang", F.col("source").alias("item")), "lang")
        .filter("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    )
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    spoken = counts.groupBy("lang", "ord").agg(F.sum("n").alias("n"))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"))
    common = spoken.join(whole, "lang").select("lang", "ord", _share("n", "total", "kept", add, scale).alias("q"))
    more = seen.join(common, ["lang", "ord"]).filter("p > q").select("lang", "source", "ord", (F.col("p") - F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord")
    best = more.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    term = best.join(terms, ["lang", "ord"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pair.unionByName(term)
