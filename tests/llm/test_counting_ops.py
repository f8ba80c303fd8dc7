"""Window repeats, the vocabulary audit and phrases against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterdrill.llm import phrases, rabin, spans, transducer, vocab
from rasterdrill.llm import text as T

SCHEMA = "doc_id bigint, lang string, source string, text string, map map<string,int>"


def _docs(spark, rows):
    """Rows with a null anywhere, and columns whose names the operators use inside."""
    frame = spark.createDataFrame([(*r, {"a": 1}) for r in rows], SCHEMA)
    return frame.withColumns({n: F.lit("own") for n in ("doc", "spans", "n", "word", "c0", "item", "rank")})


def _rows(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "A", "é", "ab", "a-b", "1x", "z.", "the", "of", "b,", "c;c", " ", "Ⅷ"]
    texts = [rnd.choice([" ", "  ", "\n", "\t"]).join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    texts += texts[: n // 4] + ["x " * 3000, "\n " + "y" * 300_000 + " end", "", None]
    keys = rnd.sample(range(-5000, 5000), len(texts))
    return [(k, rnd.choice(["en", "de", "", None]), rnd.choice(["s1", "s2", "Ω", "", None]), t) for k, t in zip(keys, texts)]


# --- windows -----------------------------------------------------------------

def _kept(rows: list[tuple], length: int) -> dict:
    """Words that stay, by looking every window up in a set."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(w) - length + 1):
            s = tuple(w[i : i + length])
            if s in seen:
                gone.update(range(i, i + length))
            seen.add(s)
        out[key] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("length", [1, 3, 20])
def test_repeated_windows_go(spark, monkeypatch, length):
    monkeypatch.setattr(rabin, "FOLD", 500)
    monkeypatch.setattr(T, "BLOCK_BYTES", 300)
    rows = _rows(length, 120)
    want = _kept([(r[0], r[3]) for r in rows], length)
    docs = _docs(spark, rows).repartition(5)
    got = {r.doc_id: r for r in rabin.digests(docs, length=length).collect()}
    assert len(got) == len(rows)
    for k, (n, removed, text) in want.items():
        assert (got[k].n_words, got[k].n_removed) == (n, removed)
        assert got[k].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
    full = rabin.deduplicated(docs, length=length)
    assert full.columns == docs.columns
    texts = {r.doc_id: r.text for r in full.select("doc_id", "text").collect()}
    assert all(texts[r[0]] == (None if r[3] is None else want[r[0]][2]) for r in rows)


def test_keys_that_repeat_or_lack(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(None, "en", "s", passage), (1, "en", "s", passage), (1, "en", "s", passage), (1, "en", "s", "other words"), (2, "en", "s", passage + " more")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rabin.digests(_docs(spark, rows)).collect())
    # The null key comes first and keeps all; the equal rows of key 1 are one document.
    assert got == [(0, 25, 0), (1, 2, 0), (1, 25, 25), (1, 25, 25), (2, 26, 25)]
    assert rabin.digests(_docs(spark, rows).limit(0)).count() == 0


def test_filter_loses_no_document(spark, monkeypatch):
    monkeypatch.setattr(rabin, "FILTER_WORDS", 2)  # nearly all bits are set: all move, none is lost
    rows = [(i, "en", "s", " ".join(f"w{j % 40}" for j in range(i, i + 30))) for i in range(60)]
    want = _kept([(r[0], r[3]) for r in rows], 20)
    got = {r.doc_id: r.n_removed for r in rabin.digests(_docs(spark, rows)).collect()}
    assert got == {k: v[1] for k, v in want.items()}


def test_window_hashes_roll():
    rnd = np.random.default_rng(5)
    words = rnd.integers(0, 5, 400).astype(np.uint64)
    h = np.stack(rabin.window_hashes(words, 3), 1)
    shapes = {}
    for i in range(len(h)):
        assert shapes.setdefault(tuple(words[i : i + 3]), tuple(h[i])) == tuple(h[i])
    assert len(set(shapes.values())) == len(shapes)
    assert len(rabin.window_hashes(words[:2], 3)[0]) == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 64)
    data = np.frombuffer(("ab " * 100 + "x" * 500 + " é" * 50).encode(), np.uint8)
    one, two = T.words(data, np.array([0, len(data)]), T.NOT_SPACE), spans.words(data, np.array([0, len(data)]), T.NOT_SPACE)
    assert all((a == b).all() for a, b in zip(one, two))


# --- vocabulary --------------------------------------------------------------

def test_transducer_is_minimal_and_counts():
    rnd = random.Random(1)
    terms = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7))).encode() for _ in range(800)})
    t = transducer.build(terms)
    strange = [b"zz", b"a" * 20, b"\xff"]
    asked = terms + [x for x in strange if x not in terms]
    data = np.frombuffer(b"".join(asked), np.uint8)
    cuts = np.cumsum([0, *map(len, asked)])
    assert transducer.ordinals(t, data, cuts[:-1], cuts[1:]).tolist() == list(range(len(terms))) + [-1] * (len(asked) - len(terms))
    # Minimal: as many states as there are different sets of ends (Myhill-Nerode).
    ends = {}
    for term in terms:
        for i in range(len(term) + 1):
            ends.setdefault(term[:i], set()).add(term[i:])
    assert len(t.final) <= len({frozenset(e) for e in ends.values()}) + 1
    none = transducer.build([])
    assert transducer.ordinals(none, data, cuts[:3], cuts[1:4]).tolist() == [-1] * 3


def _audit(rows, least, top):
    """The contract in plain Python."""
    words = [((r[1] or ""), (r[2] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[3] or ""))) for r in rows]
    out = set()
    for lang in {w[0] for w in words}:
        df = Counter(t for w in words if w[0] == lang for t in set(w[2]))
        kept = sorted((t for t, n in df.items() if n >= least), key=str.encode)
        sources = sorted({w[1] for w in words if w[0] == lang}, key=str.encode)
        n = {s: Counter(t for w in words if w[:2] == (lang, s) for t in w[2] if t in set(kept)) for s in sources}
        whole = sum(n.values(), Counter())

        def share(c, t):
            return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s in sources:
            far = sorted(((-sum(abs(share(n[s], t) - share(n[o], t)) for t in kept), o.encode()) for o in sources if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(far)}
            more = sorted((share(whole, t) - share(n[s], t), t.encode()) for t in kept if n[s][t] and share(n[s], t) > share(whole, t))
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(more[:top])}
    return out


@pytest.mark.parametrize("least, shard, block", [(1, 100_000, 1 << 20), (3, 4, 200), (10_000, 4, 200)])
def test_audit(spark, monkeypatch, least, shard, block):
    monkeypatch.setattr(transducer, "SHARD", shard)
    monkeypatch.setattr(transducer, "BLOCK_BYTES", block)
    monkeypatch.setattr(transducer, "RUN", 4)
    monkeypatch.setattr(transducer, "TILE", 2)
    monkeypatch.setattr(T, "BLOCK_BYTES", 300)
    rows = _rows(11, 80)
    rows.append((9999, "it's", "quoted\\", "a a b"))
    got = transducer.divergence(_docs(spark, rows).repartition(3), least=least, top=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == _audit(rows, least, 5)


def test_audit_of_nothing(spark):
    assert transducer.divergence(_docs(spark, [(1, "en", "s", "a")]).limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    one = spark.createDataFrame([(9_000_000_000_000, 9_000_000_000_001, 3)], "n bigint, total bigint, kept bigint")
    got = one.select(transducer._share("n", "total", "kept", 5, 1_000_000_000)).first()[0]
    assert got == 1 + 1_000_000_000 * 9_000_000_000_005 // (9_000_000_000_001 + 15)


# --- phrases -----------------------------------------------------------------

def _phrases(rows, least, inside, top):
    out = []
    for lang in {r[1] if r[1] is not None else "und" for r in rows}:
        f = Counter()
        for r in rows:
            if (r[1] if r[1] is not None else "und") != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), r[3] or "")):
                w = re.findall(r"[^\x20\x09]+", piece)
                f.update(tuple(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
        n = sum(c for g, c in f.items() if len(g) == 1)
        best = []
        for g, a in f.items():
            if len(g) == 1 or a < least:
                continue
            if len(g) == 2 and any(len(h) == 3 and c >= least and g in (h[:2], h[1:]) and 100 * c >= inside * a for h, c in f.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            best.append((-score, -a, " ".join(g).encode(), l, r))
        for i, (s, a, g, l, r) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, g.decode(), -a, l, r, n, -s))
    return sorted(out)


@pytest.mark.parametrize("heavy, burst, hold", [(1024, 1 << 16, 1_500_000), (8, 40, 200), (1, 3, 50)])
def test_phrases(spark, monkeypatch, heavy, burst, hold):
    monkeypatch.setattr(phrases, "HEAVY", heavy)
    monkeypatch.setattr(phrases, "BURST", burst)
    monkeypatch.setattr(phrases, "HOLD", hold)
    monkeypatch.setattr(T, "BLOCK_BYTES", 400)
    monkeypatch.setattr(vocab, "FOLD", 60)
    rows = _rows(21, 90)
    docs = _docs(spark, rows).repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=4, inside=50, top=25).collect())
    assert got == _phrases(rows, 4, 50, 25)


def test_phrases_of_nothing(spark):
    docs = _docs(spark, [(1, None, None, None), (2, "en", "s", ""), (3, "en", "s", "one two three")])
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_trie_spills_whole_subtrees(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 20)
    rnd = np.random.default_rng(3)
    words = rnd.integers(2, 1 << 63, 40).astype(np.uint64)
    rows = words[rnd.integers(0, 40, (30_000, 3))]
    trie, runs = phrases.Trie(), []
    for part in np.array_split(rows, 10):
        trie.add(phrases.Entries(part, np.ones(len(part), np.int64)))
        runs += [r for _, r in trie.spill(3000)]
    assert trie.size <= 3000
    runs += [r for _, r in trie.spill(0)]
    count = Counter()
    for r in runs:
        assert [tuple(x) for x in r.words.tolist()] == sorted(set(map(tuple, r.words.tolist())))
        assert len({x >> 56 for x in r.words[:, 0].tolist()}) == 1  # one subtree of the root
        for w, n in zip(map(tuple, r.words.tolist()), r.n.tolist()):
            count[w] += n
    assert count == Counter(map(tuple, rows.tolist()))


def test_prefixes_meet_in_one_partition():
    rnd = np.random.default_rng(4)
    words = rnd.integers(2, 1 << 63, 30).astype(np.uint64)
    heavy = np.sort(words[:5])
    rows = words[rnd.integers(0, 30, (5000, 3))]
    part = phrases.partition(rows, heavy, 64)
    hot = np.isin(rows, heavy)
    for a, b in combinations(range(0, 5000, 50), 2):
        depth = 1 + (hot[a, 0]) + (hot[a, 0] & hot[a, 1])
        if (rows[a, :depth] == rows[b, :depth]).all():
            assert part[a] == part[b]
    assert len(set(part[hot[:, :2].all(1)].tolist())) > 30  # pairs of heavy words spread


def test_numbers_that_meet_are_found(spark):
    rows = spark.createDataFrame([("en", "a", 1), ("en", "b", 1)], "lang string, word string, id bigint")
    assert vocab.clashes(rows) and not vocab.clashes(rows.limit(1))
    assert pa.array(["a"]).type == pa.string()
