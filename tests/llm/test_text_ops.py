"""Operators on texts against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rasterdrill.llm import bpe, decontam, minhash, store, suffix, tokens, toxicity
from rasterdrill.llm import text as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, "The quick brown fox jumps over the lazy dog, again and again. " * 4),
    (2, None), (3, ""), (4, "word " * 60_000), (5, "é😀 \n\n  x'll <|endoftext|>y"),
    (6, "The quick brown fox jumps over the lazy dog, again and again. " * 4), (7, " "), (8, "a"),
]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def _texts(seed: int, n: int, parts: list[str], most: int = 40) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, most))) for _ in range(n)]


# --- BPE ---------------------------------------------------------------------

PARTS = ["'", "s", "t", "re", "'ve", "ll", " ", "  ", "\n", "\t", "a", "é", "!", "1", "Ⅷ", "中", "\u00a0", "\u3000",
         "<|endoftext|>", "<|", "x" * 600, "the", "ö", "😀", "aaaa", ".", "\u0085", "\x1c", "\x00", "don't"]


def test_encoding_is_the_library_s(tok):
    texts = ["", " ", "'s", "a's  b", "x  ", "<|endoftext|>", *_texts(1, 3000, PARTS)]
    one = bpe.Encoder(bpe.load(PATH))
    data, offsets = T.flat(pa.array(texts))
    ids, at = one.block(data, offsets)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tok.encode(text, add_special_tokens=False).ids, text
    assert bpe.decode(ids, one.model).tobytes().decode() == "".join(texts)


def test_pairs_of_tokens_are_judged_as_the_library_would(tok):
    model = bpe.load(PATH)
    rnd = random.Random(2)
    plain = [i for i in range(50_000) if model.size[i] > 0 and bytes(model.data[model.first[i] : model.first[i] + model.size[i]]).isalpha()]
    a, b = (np.array([rnd.choice(plain) for _ in range(4000)]) for _ in range(2))
    got = bpe.compatible(a, b, model)
    for x, y, ok in zip(a.tolist(), b.tolist(), got.tolist()):
        raw = b"".join(bytes(model.data[model.first[i] : model.first[i] + model.size[i]]) for i in (x, y)).decode()
        assert ok == (tok.encode(raw, add_special_tokens=False).ids == [x, y])


def test_exact_merging_agrees_with_the_heap():
    model = bpe.load(PATH)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("aethn") for _ in range(rnd.randint(1, 40))).encode() for _ in range(500)]
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    token, word = bpe.merge(model.byte_id[data], np.repeat(np.arange(len(words)), size), model)
    for i, w in enumerate(words):
        assert token[word == i].tolist() == bpe.merge_long(w, model)


def test_a_meeting_of_hashes_is_found(monkeypatch, tok):
    monkeypatch.setattr(T, "hash_runs", lambda data, lengths: lengths.astype(np.uint64))
    data, offsets = T.flat(pa.array(["one two six ten"]))
    ids, _ = bpe.Encoder(bpe.load(PATH)).block(data, offsets)
    assert ids.tolist() == tok.encode("one two six ten", add_special_tokens=False).ids


def test_digests_of_odd_rows(spark, tok):
    docs = spark.createDataFrame([*ODD, (None, "x"), (1, "second")], SCHEMA).withColumn("n_tokens", F.lit("kept out"))
    got = {(r.doc_id, r.n_tokens): r for r in bpe.digests(docs, PATH).collect()}
    assert len(got) == docs.count()
    for k, text in ODD:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids, "<u4")
        r = got[k, len(ids)]
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH).count() == 0
    full = bpe.encode(docs.withColumn("ids", F.lit(1)), PATH)
    assert full.columns == ["doc_id", "text", "n_tokens", "ids"]
    assert {r.doc_id: r.ids for r in full.collect()}[8] == tok.encode("a").ids


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tok, tmp_path, encoding):
    rows = [*ODD, (9, "second"), (9, "second"), (None, "first of all")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("source", F.lit("s")).withColumn("file_no", F.lit(7))
    tokens.write_tokens(docs, str(tmp_path / "t"), PATH, encoding=encoding, files=3, page_rows=2)
    back = tokens.read_tokens(spark, str(tmp_path / "t"))
    got = sorted(back.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *range(1, 9), 9, 9]
    start = 0
    for r, (_, text) in zip(got, sorted(rows, key=lambda r: -1 if r[0] is None else r[0])):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids, r.source) == (start, len(ids), ids, "s")
        start += len(ids)
    crc = {r.doc_id: r.ids_crc32 for r in tokens.checksums(back).collect()}
    assert crc[8] == zlib.crc32(np.array([*tok.encode("a").ids, 0], "<u4").tobytes())
    parts = [pq.ParquetFile(f).metadata for f in (tmp_path / "t").glob("part-*.parquet")]
    columns = [m.row_group(0).column(i) for m in parts if m.num_row_groups for i in range(m.num_columns)]
    ids = [c for c in columns if c.path_in_schema.startswith("ids")]
    assert ids and all(c.has_offset_index for c in columns)
    assert all(("DELTA_BINARY_PACKED" in c.encodings) == (encoding == "delta") for c in ids)
    # Metadata alone does not read ids.
    plan = tokens.read_tokens(spark, str(tmp_path / "t"), with_ids=False)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan
    tokens.write_tokens(docs.limit(0), str(tmp_path / "none"), PATH)
    assert tokens.read_tokens(spark, str(tmp_path / "none")).count() == 0


# --- near-duplicates ---------------------------------------------------------

def _shingles(text: str | None, k: int) -> frozenset:
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())  # of bytes: A-Z only
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def _classes(rows: list, k: int) -> dict:
    sets = [(d, _shingles(t, k)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if both and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in up}


def _families(seed: int) -> list[tuple[int, str]]:
    """Groups of copies edited so that many pairs lie near the threshold."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for size in (1, 1, 2, 3, 8, 25):
        base = [rnd.choice(words) for _ in range(rnd.randint(30, 150))]
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 9))):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append((n * 7 % 1009, " ".join(own)))
            n += 1
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_are_the_components_of_brute_force(spark, k):
    rows = [*_families(k), *((2000 + i, t) for i, t in ODD), (2100, "A b"), (2101, "a  B"), (2102, "a")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r for r in minhash.near_duplicates(docs, k=k).collect()}
    want = _classes(rows, k)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    texts = dict(rows)
    assert all(r.n_shingles == len(_shingles(texts[i], k)) for i, r in got.items())


def test_pairs_off_the_star_are_found(spark):
    """A chain a-b-c in which the smallest id links to one end only."""
    words = [f"x{i}" for i in range(200)]
    rows = []
    for d in range(12):
        own = list(words)
        own[d * 7 : d * 7 + 7] = [f"y{d}_{i}" for i in range(7)]
        own[(d + 1) * 7 : (d + 1) * 7 + 7] = [f"y{d + 1}_{i}" for i in range(7)]
        rows.append((d, " ".join(own)))
    got = {r.id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), k=1).collect()}
    assert got == _classes(rows, 1)


def test_a_false_link_of_the_forest_hides_no_other(spark, monkeypatch):
    """Nodes 1, 2 and 3 look alike on short sets; the stars have refuted 1-2 and 1-3, and 2-3 is one."""
    for seed in range(100):
        w = [f"s{seed}_{i}" for i in range(25)]
        rows = [(1, " ".join(w[:20])), (2, " ".join([*w[:16], *w[20:24]])), (3, " ".join([*w[:16], *w[20:23], w[24]]))]
        low = {int(minhash.shingle_sets(*T.flat(pa.array([t])), 1)[0][0]) for _, t in rows}
        if len(low) == 1:  # one bucket holds all three
            break
    alike = bytearray(np.arange(20, dtype="<u4").tobytes())
    monkeypatch.setattr(minhash, "_short_sets", lambda docs, ids, n_ids, k: ids.select("id", F.lit(alike).alias("s")))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.component_id for r in minhash.near_duplicates(docs, k=1, bands=1, rows=1).collect()}
    assert got == _classes(rows, 1) == {1: 1, 2: 2, 3: 2}


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here now ok"), (3, "other words here now ok"),
            (None, "a b c d e f"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit(1)).withColumn("id", F.lit("x"))
    got = {(r.id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(1, 1, True), (3, 1, False), (None, None, True), (4, 4, True), (5, 5, True)}
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 4, 5]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_the_text_kept_of_a_repeated_id_is_fixed(spark):
    rows = [(1, f"text {i} of one id", s) for i in range(6) for s in ("b", "a")] + [(2, "alone", "a"), (None, "x", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    text = docs.filter("doc_id = 1").orderBy(F.xxhash64("text"), "text").first().text
    for order in (rows, rows[::-1]):
        left = minhash.deduplicated(spark.createDataFrame(order, docs.schema).coalesce(1))
        assert {tuple(r) for r in left.collect()} == {(1, text, "a"), (2, "alone", "a"), (None, "x", "a")}


# --- repeats -----------------------------------------------------------------

def _removed(rows: list, length: int) -> dict:
    order = sorted(rows, key=lambda r: r[0])
    seen, out = set(), {}
    for d, text in order:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        out[d] = gone
    return out


def _shared_passages(seed: int, n: int) -> list[tuple[int, str]]:
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice("abcé \n") for _ in range(rnd.randint(60, 260))) for _ in range(6)]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            parts.append("".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 90))))
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            parts.append(p[a : a + rnd.randint(50, 260)])
        rows.append((d * 31 % 997, "".join(parts)))
    return [*rows, (2000, "z" * 400), (2001, "ab" * 150), (2002, "ba" * 120), (2003, "q" * 99), (2004, "q" * 100)]


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_are_those_of_brute_force(spark, monkeypatch, hot):
    if hot:  # every gram of several names goes the way of widespread ones
        monkeypatch.setattr(suffix, "GROUP_RUNS", 0)
    monkeypatch.setattr(suffix, "BATCH_RUNS", 50)
    rows = _shared_passages(4, 120)
    want = _removed(rows, 100)
    got = {r.doc_id: r for r in suffix.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        raw, gone = np.frombuffer(text.encode(), np.uint8), want[d]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), int(gone.sum()), spans)
        assert r.kept_sha256 == hashlib.sha256(raw[~gone].tobytes()).hexdigest()


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_PIECE", 500)
    monkeypatch.setattr(T, "BLOCK_BYTES", 400)
    rows = _shared_passages(5, 40)
    rows += [(3000, rows[3][1] * 3 + rows[5][1] + rows[9][1]), (3001, rows[5][1] + rows[9][1] * 2)]
    want = _removed(rows, 100)
    found = suffix.repeats(spark.createDataFrame(rows, "doc bigint, text string"))
    for r in found.collect():
        gone = np.zeros(len(want[r.doc]), bool)
        for s in r.spans:
            gone[s["first"] : s["last"]] = True
        assert (gone == want.pop(r.doc)).all()
    assert not any(v.any() for v in want.values())


def test_induced_order_has_the_right_repeats():
    rnd = random.Random(6)
    runs = ["".join(rnd.choice("ab") for _ in range(rnd.randint(8, 30))).encode() for _ in range(80)]
    size = np.array([len(r) for r in runs])
    lead = np.array([rnd.randint(0, n - 1) for n in size])
    group = np.array([rnd.randint(0, 2) for _ in runs])
    data, begin = np.frombuffer(b"".join(runs), np.uint8), np.cumsum(size) - size
    got = {d: set(a.tolist()) for d, a in suffix.induce(group, np.arange(len(runs)), data, begin, size, lead, 6)}
    for d in range(30):
        seen, again = set(), set()
        for i, r in enumerate(runs):
            a = lead[i] - d
            if a >= 0 and a + 6 <= size[i]:
                key = (group[i], r[a : a + 6])
                if key in seen:
                    again.add(i)
                seen.add(key)
        assert got.get(d, set()) == again


def test_repeats_in_odd_rows(spark):
    rnd = random.Random(10)
    p = "".join(rnd.choice("abcdefgh") for _ in range(150))
    rows = [(1, p), (1, p), (2, "é" + p + "é"), (None, p), (3, None), (4, ""), (5, "short")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("doc", F.lit(9)).withColumn("spans", F.lit("s"))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix.digests(docs).collect())
    # A null key comes first; rows of one key and text are one document.
    assert got == [(0, 150, 0), (1, 150, 150), (1, 150, 150), (2, 154, 150), (3, 0, 0), (4, 0, 0), (5, 5, 0)]
    left = suffix.deduplicated(docs)
    assert left.columns == docs.columns
    texts = sorted(((r.doc_id or 0), r.text, r.doc, r.spans) for r in left.filter("doc_id <> 3").collect())
    assert texts[:3] == [(1, "", 9, "s"), (1, "", 9, "s"), (2, "éé", 9, "s")]
    assert left.filter("doc_id = 3").first().text is None
    assert suffix.digests(docs.limit(0)).count() == 0


def test_a_cut_character_stays(spark):
    rnd = random.Random(7)
    p = "".join(rnd.choice("éü") for _ in range(80))
    rows = [(1, "x" + p), (2, "y" + p)]
    want = _removed(rows, 101)[2]
    docs = spark.createDataFrame(rows, SCHEMA)
    text = suffix.deduplicated(docs, length=101).filter("doc_id = 2").first().text
    assert want.sum() == 160 and text == "y"
    odd = suffix.deduplicated(spark.createDataFrame([(1, "a" + p[:60]), (2, "é" + p[:60])], SCHEMA), length=101)
    assert odd.filter("doc_id = 2").first().text == "é"


# --- decontamination ---------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text: str | None) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _contamination(docs: list, items: list, window: int) -> dict:
    wins: dict[tuple, set] = {}
    for i, text in items:
        w = _words(text)
        if w:
            n = min(window, len(w))
            for a in range(len(w) - n + 1):  # without an id: words are hit, no item is named
                wins.setdefault(tuple(w[a : a + n]), set()).update([] if i is None else [i])
    out = {}
    for d, text in docs:
        w, hit, found = _words(text), set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[a : a + n]))) is not None:
                    hit.update(range(a, a + n))
                    found |= own
        out[d] = (len(w), len(hit), sorted(found))
    return out


def _passages(seed: int) -> tuple[list, list]:
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "γάμμα", "d4", "e", "f"]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 6, 9, 14])))) for i in range(25)]
    items += [(25, items[3][1]), (None, "Alpha beta"), (26, None), (27, "..."), (28, "beta")]
    docs = [(d, ", ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for d in range(80)]
    return [*docs, (100, None), (101, ""), (102, "Beta"), (103, " ".join(t for _, t in items[:9] if t))], items


@pytest.mark.parametrize("limit", [1 << 20, 64])
def test_contamination_is_that_of_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(T, "BLOCK_BYTES", 2000)
    docs, items = _passages(8)
    left = spark.createDataFrame(docs, SCHEMA).withColumn("items", F.lit(1))
    right = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.mark(left, right, window=6, limit=limit)
    want = _contamination(docs, items, 6)
    for r in got.collect():
        n_hit = sum(s["last"] - s["first"] + 1 for s in r.spans)
        assert (r.n_words, n_hit, sorted(r.items)) == want[r.doc_id]
    kept = decontam.clean(left, right, window=6, limit=limit)
    assert kept.columns == left.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, v in want.items() if not v[1])


def test_an_item_without_an_id_cleans(spark):
    docs = spark.createDataFrame([(1, "x Held out passage y"), (2, "another text")], SCHEMA)
    items = spark.createDataFrame([(None, "held OUT passage"), (None, None), (1, "...")], "item_id bigint, text string")
    for limit in (1 << 20, 4):
        assert [r.doc_id for r in decontam.clean(docs, items, window=3, limit=limit).collect()] == [2]


def test_repeated_items_are_one(spark):
    items = spark.createDataFrame([(1, "one of many items")] * 500 + [(2, "one of many items"), (3, "other")], "item_id bigint, text string")
    held = [b.ids.tolist() for b in decontam.item_blocks(items, 3, "item_id", "text", limit=100)]
    assert [sorted(ids) for ids in held] == [[1, 2, 3]]


def test_longest_matches(spark):
    item = [f"w{i}" for i in range(30)]
    docs = [(1, " ".join(item[2:15])), (2, "x " + " ".join(item[5:25]) + " y"), (3, "none")]
    got = decontam.longest_matches(
        spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    )
    found = {r.item_word: (r.n_words, r.doc_id, r.doc_word) for r in got.collect()}
    assert found[2] == (13, 1, 0) and found[5] == (20, 2, 1) and found[15] == (10, 2, 11)
    assert set(found) == set(range(2, 16))


def test_empty_sides(spark):
    docs, items = _passages(9)
    left, right = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    assert decontam.mark(left.limit(0), right).count() == 0
    assert all(not r.spans for r in decontam.mark(left, right.limit(0)).collect())
    assert decontam.clean(left, right.limit(0)).count() == left.count()


def test_shared_folder_is_the_session_s():
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://shared/"}, sparkContext=SimpleNamespace(master="yarn"))
    assert store.fresh_path(named, "x").startswith("hdfs://shared/x-")
    with pytest.raises(ValueError, match="checkpoint"):
        store.fresh_path(SimpleNamespace(conf={}, sparkContext=named.sparkContext), "x")


# --- pipeline ----------------------------------------------------------------

def test_pipeline_is_a_plain_chain(spark, tok):
    """Each step in Python; only the weights of the classifier are the stage's own."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows, steps = [(r.doc_id, r.text) for r in docs.collect()], []
    steps.append(len(rows))
    ends = [np.array([0, len((t or "").encode())]) for _, t in rows]
    found = [toxicity.features(np.frombuffer((t or "").encode(), np.uint8), e) for (_, t), e in zip(rows, ends)]
    rows = [r for r, f in zip(rows, found) if chain.scores(*f, 1)[0, chain.names.index("toxic")] < 0.5]
    steps.append(len(rows))
    own = _classes(rows, 5)
    rows = [r for r in rows if own[r[0]] == r[0]]
    steps.append(len(rows))
    cut = []
    for (d, text), gone in zip(sorted(rows), _removed(rows, 100).values()):
        at, left = 0, []
        for c in text or "":  # a character goes only if all its bytes do
            n = len(c.encode())
            left.append("" if gone[at : at + n].all() else c)
            at += n
        cut.append((d, "".join(left)))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = _contamination(cut, items, 10)
    want = {d: tok.encode(t, add_special_tokens=False).ids for d, t in cut if not hits[d][1]}
    steps.append(len(want))
    assert sorted(set(steps), reverse=True) == steps and cut != sorted(rows)  # each stage has work
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()} == want
