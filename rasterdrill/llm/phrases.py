"""Phrase collocations: exact counts of all phrases of up to three words by HAT-tries.

Words. One pass counts the words of each language with their strings; a word's number is
64 bits (see ``vocab``). A second pass counts phrases.

Trie. An occurrence of a word is one entry: its number and those of the two words after it
in its piece, 0 where the piece ends. So the count of any phrase is a sum over the entries
that begin with it. A task keeps entries in a burst trie over the bytes of word numbers: a
leaf is a hash container, whose entries are kept in order of a hash and fold when as many
have been appended; one that outgrows ``BURST`` becomes a node with a leaf for each next
byte. When a trie holds ``HOLD`` entries, its largest subtrees are spilled whole, together
as one run sorted by word numbers, until a quarter is left.

Prefix partitions. Runs are dealt by the first word. Where that is one of the few *heavy*
words (at least one in ``HEAVY`` of all occurrences, so at most ``HEAVY`` of them, whatever
the corpus) the prefix is two words, where both are heavy all three; then the pair itself
is counted by entries of its own. So no prefix has more than a ``HEAVY``-th of all entries.
A partition merges its runs and keeps what occurs at least ``least`` times: no phrase below
that is a candidate, or a part of one.

Scores are exact in whole numbers beyond 64 bits. Defined results: a null text is empty, a
null language ``und``; a repeated row counts again; phrases never cross pieces or texts; an
empty table gives an empty one; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterdrill.llm import spans as S
from rasterdrill.llm import text as T
from rasterdrill.llm import vocab
from rasterdrill.llm.store import Work

# Fixed by the contract: bytes that end a piece, and bytes that end a word.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~ENDS
INSIDE[[0x20, 0x09]] = False

HEAVY = 1024
BURST = 1 << 16
HOLD = 500_000
# Entries of a prefix partition, about, where these outnumber the shuffle partitions (some 150
# bytes each while it merges).
PART = 500_000
BATCH_BYTES = 8 << 20
_PAIR = np.uint64(1)  # third number of an entry that counts a pair of heavy words
_HALF = np.uint64(32)


class Entries:
    """Phrases as three columns of word numbers, with counts."""

    def __init__(self, words: np.ndarray, n: np.ndarray):
        self.words, self.n = words, n

    def __len__(self) -> int:
        return len(self.n)

    def take(self, at) -> Entries:
        return Entries(self.words[at], self.n[at])

    @staticmethod
    def together(parts: list[Entries]) -> Entries:
        return Entries(np.concatenate([p.words for p in parts]), np.concatenate([p.n for p in parts]))

    def folded(self) -> Entries:
        """Equal phrases as one, in order of a hash; phrases whose hashes meet may stay apart."""
        w = self.words
        h = T.mix(w[:, 0] * np.uint64(3) + T.mix(w[:, 1] * np.uint64(5) + T.mix(w[:, 2])))
        order = np.argsort(h)
        w = w[order]
        new = np.append(True, (w[1:] != w[:-1]).any(1))
        at = np.flatnonzero(new)
        return Entries(w[at], np.add.reduceat(self.n[order], at))

    def sorted(self) -> Entries:
        """Equal phrases as one, in order of their words."""
        w = self.words
        order = np.lexsort((w[:, 2], w[:, 1], w[:, 0]))
        w = w[order]
        at = np.flatnonzero(np.append(True, (w[1:] != w[:-1]).any(1)))
        return Entries(w[at], np.add.reduceat(self.n[order], at))


def _byte(words: np.ndarray, level: int) -> np.ndarray:
    """Byte ``level`` of a phrase: eight of the first word from the highest on, then of the next."""
    return (words[:, level // 8] >> np.uint64(56 - 8 * (level % 8))).astype(np.uint8)


class Trie:
    """A burst trie with hash containers as leaves."""

    def __init__(self, level: int = 0):
        self.level = level
        self.arms: dict[int, Trie] | None = {} if level == 0 else None
        self.kept: Entries | None = None
        self.fresh: list[Entries] = []
        self.waiting = 0
        self.size = 0  # entries below, those that wait included

    def add(self, entries: Entries) -> int:
        """Take in entries; the change of ``size``."""
        before = self.size
        if self.arms is None:
            self.fresh.append(entries)
            self.waiting += len(entries)
            self.size += len(entries)
            if self.waiting > max(8192, self.size - self.waiting):
                self._fold()
                if self.size > BURST and self.level < 23:
                    held, self.kept, self.size, self.arms = self.kept, None, 0, {}
                    self.size = self._deal(held)
        else:
            self.size += self._deal(entries)
        return self.size - before

    def _deal(self, entries: Entries) -> int:
        byte = _byte(entries.words, self.level)
        order = np.argsort(byte, kind="stable")
        entries, byte = entries.take(order), byte[order]
        at = np.flatnonzero(np.append(True, byte[1:] != byte[:-1])).tolist()
        change = 0
        for i, j in zip(at, [*at[1:], len(byte)]):
            arm = self.arms.get(int(byte[i]))
            if arm is None:
                arm = self.arms[int(byte[i])] = Trie(self.level + 1)
            change += arm.add(Entries(entries.words[i:j], entries.n[i:j]))
        return change

    def _fold(self) -> None:
        if self.fresh:
            self.kept = Entries.together([*([self.kept] if self.kept else []), *self.fresh]).folded()
            self.fresh, self.waiting, self.size = [], 0, len(self.kept)

    def run(self) -> Entries | None:
        """All entries of the subtree, folded and sorted."""
        if self.arms is None:
            self._fold()
            return self.kept.sorted() if self.kept else None
        runs = [r for _, arm in sorted(self.arms.items()) if (r := arm.run()) is not None]
        return Entries.together(runs) if runs else None

    def spill(self, leave: int) -> Iterator[tuple[int, Entries]]:
        """Hand out whole subtrees of the root with their byte, the largest first, until at most ``leave`` entries stay."""
        for byte, arm in sorted(self.arms.items(), key=lambda x: -x[1].size):
            if self.size <= leave:
                return
            del self.arms[byte]
            self.size -= arm.size
            if (run := arm.run()) is not None:
                yield byte, run


def partition(words: np.ndarray, heavy: np.ndarray, parts: int) -> np.ndarray:
    """Prefix partition of each phrase; ``heavy`` is sorted."""
    key = words[:, 0].copy()
    if len(heavy):
        def held(column: np.ndarray) -> np.ndarray:
            return heavy[np.minimum(np.searchsorted(heavy, column), len(heavy) - 1)] == column

        one = held(key)
        two = one & held(words[:, 1])
        key[one] = T.mix(words[one, 0] * np.uint64(3) + words[one, 1])
        whole = two & (words[:, 2] != _PAIR)
        key[whole] = T.mix(key[whole] + T.mix(words[whole, 2]))
    return ((key >> _HALF) * np.uint64(parts) >> _HALF).astype(np.int32)


def _entries(data: np.ndarray, w: T.Words, ids: np.ndarray, heavy: np.ndarray) -> Entries:
    """An entry per word of a block, and one per pair of heavy words."""
    n = len(ids)
    out = np.zeros((n, 3), np.uint64)
    out[:, 0] = ids
    if n > 1:
        ends = np.cumsum(ENDS[data], dtype=np.int64)
        next_ = (w.text[1:] == w.text[:-1]) & (ends[w.start[1:]] == ends[w.end[:-1] - 1])
        out[:-1, 1] = np.where(next_, ids[1:], 0)
        out[:-2, 2] = np.where(next_[:-1] & next_[1:], ids[2:], 0)
    if len(heavy):
        pair = np.isin(out[:, 0], heavy) & np.isin(out[:, 1], heavy)
        extra = out[pair]
        extra[:, 2] = _PAIR
        out = np.concatenate([out, extra])
    return Entries(out, np.ones(len(out), np.int64))


def _runs(docs: DataFrame, seed: int, heavy: np.ndarray, parts: int) -> DataFrame:
    """Sorted runs of spilled subtrees, cut by prefix partition."""
    names = ["part", "one", "two", "three", "n"]

    def emit(run: Entries) -> pa.RecordBatch:
        part = partition(run.words, heavy, parts)
        order = np.argsort(part, kind="stable")
        run, part = run.take(order), part[order]
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        cuts = np.append(at, len(part)).tolist()
        columns = [[run.words[i:j, c].tobytes() for i, j in zip(cuts, cuts[1:])] for c in range(3)]
        counts = [S.planes(run.n[i:j]) for i, j in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[at]), *[pa.array(c, pa.binary()) for c in (*columns, counts)]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch, data, offsets in S.text_blocks(batches, 1):
            data = T.LOWER[data]
            w = S.words(data, offsets, INSIDE)
            if not len(w.start):
                continue
            trie.add(_entries(data, w, vocab.numbers(w, vocab.tags(batch.column(0), seed)), heavy).folded())
            if trie.size > HOLD:
                yield emit(Entries.together([run for _, run in sorted(trie.spill(HOLD // 4), key=lambda r: r[0])]))
        if rest := sorted(trie.spill(0), key=lambda r: r[0]):
            yield emit(Entries.together([run for _, run in rest]))

    return docs.select("lang", "text").mapInArrow(run, "part int, one binary, two binary, three binary, n binary")


def _merged(runs: DataFrame, heavy: np.ndarray, least: int) -> DataFrame:
    """``w1, w2, w3, f`` of the phrases of two words (w3 = 0) and three that occur ``least`` times."""
    def settle(held: list[Entries]) -> pa.RecordBatch:
        e = Entries.together(held)
        held.clear()
        e = e.sorted()
        w, n = e.words, e.n
        three = (w[:, 2] > _PAIR) & (n >= least)
        # A pair is the sum over what follows it, but for pairs of heavy words, which have entries of their own.
        both = np.isin(w[:, 0], heavy) & np.isin(w[:, 1], heavy)
        plain = (w[:, 1] > 0) & np.where(both, w[:, 2] == _PAIR, True)
        w2, n2 = w[plain][:, :2], n[plain]
        at = np.flatnonzero(np.append(True, (w2[1:] != w2[:-1]).any(1))) if len(n2) else np.zeros(0, np.int64)
        total = np.add.reduceat(n2, at) if len(at) else n2
        two = total >= least
        pairs = np.concatenate([w2[at][two], np.zeros((two.sum(), 1), np.uint64)], 1)
        out = np.concatenate([w[three], pairs]).view(np.int64)
        f = np.concatenate([n[three], total[two]])
        return pa.RecordBatch.from_arrays([*[pa.array(out[:, c]) for c in range(3)], pa.array(f)], ["w1", "w2", "w3", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for part, one, two, three, n in zip(*(b.column(i).to_pylist() for i in range(5))):
                if part != now:
                    if held:
                        yield settle(held)
                    now, held = part, []
                words = np.stack([np.frombuffer(x, np.uint64) for x in (one, two, three)], 1)
                held.append(Entries(words, S.from_planes(n, np.int64)))
        if held:
            yield settle(held)

    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(run, "w1 bigint, w2 bigint, w3 bigint, f bigint")


def _with_word(rows: DataFrame, column: str, words: DataFrame, hot: DataFrame, name: str) -> DataFrame:
    """Add word, count and language of the word ``column``; null where it is 0.

    A third of all phrases may hold one heavy word. These come by broadcast, and a row that
    has found one looks among the others under a key of its own, so it joins no group.
    """
    def side(of: DataFrame, key: str, end: str) -> DataFrame:
        return of.select(F.col("id").alias(key), F.col("word").alias(f"_w{end}"), F.col("f").alias(f"_f{end}"), F.col("lang").alias(f"_l{end}"))

    met = rows.join(F.broadcast(side(hot, column, "h")), column, "left")
    alone = F.col("_wh").isNotNull() | (F.col(column) == 0)
    met = met.withColumn("_key", F.when(alone, F.xxhash64("w1", "w2", "w3", F.lit(column))).otherwise(F.col(column)))
    met = met.join(side(words, "_key", "r").hint("merge"), "_key", "left")
    found = {f"{new}{name}": F.coalesce(F.col(f"{old}h"), F.when(~alone, F.col(f"{old}r"))) for new, old in (("", "_w"), ("f_", "_f"), ("lang_", "_l"))}
    return met.withColumns(found).select(*rows.columns, *found)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows of packed runs are large, so a batch of them is bounded by its bytes, not its rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def phrase_counts(docs: DataFrame, least: int, work: Work) -> tuple[DataFrame, DataFrame, list[int]]:
    """Words ``(lang, word, id, f)``, frequent phrases ``(w1, w2, w3, f)`` by number, and the heavy words' numbers."""
    spark = docs.sparkSession
    seed = 0
    while True:
        counted = vocab.counted(docs, INSIDE, in_texts=False, seed=seed)
        words = work.keep(counted.groupBy("lang", "word").agg(F.first("id").alias("id"), F.sum("n").alias("f")), "words")
        if not vocab.clashes(words):
            break
        work.drop(words)
        seed += 1
    total = words.agg(F.sum("f").alias("n")).first()["n"] or 0
    # At most HEAVY words reach that share, and a word below ``least`` is in no phrase.
    share = max(least, -(-total // HEAVY))
    heavy = sorted(r["id"] for r in words.filter(F.col("f") >= share).select("id").collect())
    numbers = np.sort(np.array(heavy, np.int64).view(np.uint64))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    with small_batches(spark):
        phrases = work.keep(_merged(_runs(docs, seed, numbers, parts), numbers, least), "phrases")
    return words, phrases, heavy


def collocations(
    docs: DataFrame, least: int = 10, inside: int = 50, top: int = 2000, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases of two and three words.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of its lowest-scoring
    cut, ``score`` is floor(1000000 a a / (l r)). A pair that stands inside a phrase of three
    words with ``inside`` percent of its count is left out.
    """
    work = Work(docs.sparkSession, "phrases")
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words, phrases, heavy = phrase_counts(plain, least, work)
    pairs = phrases.filter("w3 = 0").select("w1", "w2", F.col("f").alias("a"))
    threes = phrases.filter("w3 <> 0").select("w1", "w2", F.col("f").alias("a"), "w3")
    cover = threes.select("w1", "w2", "a").unionByName(threes.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    cover = cover.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    lone = pairs.join(cover, ["w1", "w2"], "left").filter(f"longer IS NULL OR 100 * longer < {inside} * a")
    lone = lone.select("w1", "w2", F.lit(0).cast("bigint").alias("w3"), "a", *[F.lit(None).cast("bigint").alias(c) for c in ("f_xy", "f_yz")])
    front = pairs.select("w1", "w2", F.col("a").alias("f_xy"))
    back = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f_yz"))
    three = threes.join(front.hint("merge"), ["w1", "w2"]).join(back.hint("merge"), ["w2", "w3"])
    rows = lone.unionByName(three)
    often = words.filter(F.col("f") >= least)
    hot = often.filter(F.col("id").isin(heavy))
    for column, name in (("w1", "x"), ("w2", "y"), ("w3", "z")):
        rows = _with_word(rows, column, often, hot, name)
    rows = work.keep(rows, "spelled")

    def scored(a: str, l: str, r: str) -> F.Column:  # noqa: E741
        wide = "CAST({} AS DECIMAL({},0))".format
        return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * {wide(a, 15)} * {wide(a, 15)}) div ({wide(l, 19)} * {wide(r, 19)})")

    # A pair has one cut, so its second score is missing.
    cut = rows.withColumns({
        "f_yz": F.coalesce("f_yz", "f_y"), "phrase": F.concat_ws(" ", "x", "y", "z"), "lang": F.col("lang_x"),
    }).withColumns({"s1": scored("a", "f_x", "f_yz"), "s2": scored("a", "f_xy", "f_z")})
    first = "s2 IS NULL OR s1 <= s2"
    cut = cut.select(
        "lang", "phrase", "a", F.expr(f"IF({first}, f_x, f_xy)").alias("l"), F.expr(f"IF({first}, f_yz, f_z)").alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = cut.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))  # a row per language
    return best.join(n, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score")
    )
