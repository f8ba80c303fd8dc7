"""Sharding, urls, search, classifiers and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterdrill.llm import bpe, quality, queries, shards, topk, toxicity, urls
from rasterdrill.llm import text as T

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([0, 1, 2**64 - 1, *(random.Random(1).getrandbits(64) for _ in range(500))], np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert shards.jump_numpy(keys, n).tolist() == [_jump(int(k), n) for k in keys]


def test_shards_and_slots(spark):
    got = queries.op4_jump_shards(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    moved = got[got["shard"] != got["grown_shard"]]
    assert len(got) == len(docs) and (moved["grown_shard"] == 24).all() and 0 < len(moved) < 0.1 * len(got)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    by = docs.set_index("doc_id")["text"]
    for r in got.itertuples():
        raw = by[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))


def test_slots_of_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 50 + [(2, "b"), (None, None), (None, None)], "k bigint, slot string")
    out = shards.numbered(shards.assign(df.withColumnRenamed("slot", "_n"), "k", 3)).toPandas()
    assert len(out) == 53 and list(out.columns) == ["k", "_n", "shard", "slot"]
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert shards.numbered(shards.assign(df.limit(0), "k", 3)).count() == 0


def test_shards_follow_a_plain_loop(spark):
    """Jump consistent hashing, one key at a time, over the hashed ids."""
    def jump(key: int, n: int) -> int:
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    got = queries.op4_jump_shards(spark, SF).selectExpr("xxhash64(doc_id) AS h", "shard", "grown_shard").collect()
    assert len(got) >= 200
    assert all((r.shard, r.grown_shard) == (jump(r.h % 2**64, 24), jump(r.h % 2**64, 25)) for r in got)


def test_slots_beside_maps(spark):
    rows = [
        (1, {"a": 1, "b": 2}, [({"x": {1: "y"}}, 1)]), (1, {"b": 2, "a": 1}, [({"x": {1: "y"}}, 1)]),
        (1, None, None), (2, {}, [(None, None), None]), (2, {"a": None}, []),
    ]
    kind = "k bigint, key map<string,int>, m array<struct<p:map<string,map<int,string>>,value:int>>"
    df = spark.createDataFrame(rows, kind)
    out = shards.numbered(shards.assign(df, "k", 3))
    assert out.schema["m"].dataType.simpleString() == df.schema["m"].dataType.simpleString()
    plain = lambda r: repr((r["k"], r["key"] and sorted(r["key"].items()), r["m"]))
    got = out.collect()
    assert sorted(map(plain, got)) == sorted(map(plain, df.collect()))
    for shard in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))


def _fits(r: urls.Rule, host: str, path: str) -> bool:
    return (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)


@pytest.mark.parametrize("per_trie", [1000, 7])
def test_urls_against_every_rule(spark, per_trie):
    rnd = random.Random(2)
    label, seg = ["a", "b", "org", "x-1"], ["", "en", "e", "1", "12", "es"]
    rules = [
        urls.rule(rnd.choice(["allow", "block"]), ".".join(rnd.choice(label) for _ in range(rnd.randint(1, 3))) + "/" + "/".join(rnd.choice(seg) for _ in range(rnd.randint(0, 3))))
        for _ in range(60)
    ]
    pages = [(i, rnd.choice(["http", "HTTP", ""]) + "://" + ".".join(rnd.choice([*label, "ORG"]) for _ in range(rnd.randint(1, 4)))
              + rnd.choice(["", "/"]) + "/".join(rnd.choice(seg) for _ in range(rnd.randint(0, 4))) + rnd.choice(["", "?q=/en", "#x"])) for i in range(800)]
    pages += [(900, None), (901, ""), (902, "no scheme/en"), (903, "http://"), (904, "a://b.org/en/1\n2"), (905, "http://" + "a." * 3000 + "org/" + "en/" * 3000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string").withColumn("rule", F.lit(5))
    got = {r.page_id: r for r in urls.judge(df, rules, per_trie=per_trie).collect()}
    for i, u in pages:
        host, path = urls.split_url(u)
        fit = [r for r in rules if u and "://" in u and _fits(r, host, path)]
        best = max(fit, key=urls._rank, default=None)
        r = got[i]
        assert (r.host, r.path, r.verdict) == (host, path, best.verdict if best else "allow"), u
        assert r.rule == (str(best) if best else None)
    assert urls.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(df, []).collect()} == {"allow"}


def _best(rows: list, k: int) -> set:
    ok = [(i, v) for i, v in rows if i is not None and v]
    out = set()
    for q, v in ok:
        if q % 5 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
            out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])}
    return out


def test_topk_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    monkeypatch.setattr(topk, "SEEDS", 9)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    rnd = np.random.default_rng(3)
    axes = rnd.normal(size=(3, 12))
    rows = [(i, (rnd.normal(size=3) @ axes * 40 * rnd.random()).astype(int).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 320)] + [(320, [0] * 12), (325, [1, 2]), (326, [3, 4]), (330, None), (None, [1] * 12), (335, [10**9] * 12)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>")
    got = {tuple(r) for r in topk.top_k(df, df.filter("vec_id % 5 = 0"), 4).collect()}
    assert got == _best(rows, 4)
    assert topk.top_k(df.limit(0), df.limit(0), 4).count() == 0


def test_topk_prunes():
    rnd = np.random.default_rng(4)
    x = (rnd.normal(size=(5000, 4)) @ rnd.normal(size=(4, 32)) * 100 * (rnd.random((5000, 1)) ** 4)).astype(np.int64)
    x = x[np.argsort(-(x.astype(float) ** 2).sum(1), kind="stable")]
    _, axes = np.linalg.eigh((x.T @ x).astype(float))
    one = topk._Search(np.arange(20) + 10**6, x[:400:20], np.ascontiguousarray(axes[:, ::-1]), np.full(20, -np.inf), 5)
    one.run(np.arange(5000), x)
    assert one.scored < 0.5 * 20 * 5000


def test_vectors_that_take_no_part(spark):
    rows = [(0, [0.5, -0.5]), (50, [1.0, None]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.001, -0.001])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("vec_id", topk.whole(F.col("embedding"), 256.0).alias("v"))
    assert {r.vec_id: r.v for r in df.collect()} == {0: [128, -128], 50: None, 1: None, 2: None, 3: None, 4: None, 5: [0, -1]}
    assert [tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect()] == [(0, 1, 5, 128)]


# --- classifiers -------------------------------------------------------------

def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op10_pu_quality(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(got) == 10_000 and got["score"].between(0, 1).all()
    both = got[got["held_out"]].merge(labels, on="doc_id")
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both["doc_id"]]).all()
    assert (both["predicted"] == both["quality"]).mean() > 0.95
    good, bad = (both.loc[both["quality"] == v, "score"].to_numpy() for v in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.97


def test_prior_of_a_known_mixture():
    rnd = np.random.default_rng(5)
    p, n = rnd.normal(1, 1, 8000), rnd.normal(-2, 1, 8000)
    u = np.concatenate([rnd.normal(1, 1, 5600), n[:2400]])
    assert abs(quality.estimate_prior(p, u) - 0.7) < 0.04


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 100_000), (None, "a b"), (4, "a b"), (4, "a b"), (5, "\n\n"), (6, "é")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit(1)).withColumn("x", F.lit(1))
    held = F.col("doc_id") == 4
    for labels in ([(1, 1), (2, 0), (9, None), (None, 1)], []):
        out = quality.score(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"), held).collect()
        assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)
        assert sum(r.held_out for r in out) == 2
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.score(docs.limit(0), none, held).count() == 0


def test_toxicity_of_unseen_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels.filter("doc_id % 3 <> 0"))
    got = toxicity.score(docs, chain).toPandas().merge(labels.toPandas(), on="doc_id", suffixes=("_p", ""))
    got = got[got["doc_id"] % 3 == 0]
    found = got["toxic_p"] >= 0.5
    assert found[got["toxic"] == 1].mean() > 0.85 and found[got["toxic"] == 0].mean() < 0.01
    kept = toxicity.clean(docs, chain)
    assert kept.columns == docs.columns


def test_later_links_use_earlier_ones(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels)
    assert [len(c) for c in chain.of_chain] == [0, 1, 2]
    assert chain.of_chain[2].max() > 0


def test_toxicity_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 50_000), (None, "a b"), (4, "a b"), (4, "a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("toxic", F.lit("t"))
    for labels in ([(1, 1), (2, 0), (4, 1), (9, 1), (None, 0), (3, None)], [(1, 0)], []):
        chain = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        out = toxicity.score(docs, chain).collect()
        assert len(out) == 6 and all(0 <= r.toxic <= 1 for r in out)
        assert toxicity.clean(docs, chain).columns == docs.columns
    assert toxicity.score(docs.limit(0), chain).count() == 0


# --- pipeline ----------------------------------------------------------------

def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.count()
        assert 0 < after <= before
        before = after
        if name != "bpe":
            assert docs.columns == columns
    assert {"doc_id", "ids", "n_tokens"} <= set(docs.columns)


def test_toxicity_fits_alike_in_any_partitioning(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    one, two = (toxicity.fit(d, labels) for d in (docs.coalesce(1), docs.repartition(7, "text")))
    assert (one.weights == two.weights).all() and (one.base == two.base).all()
    # Probabilities from the weights, word by word.
    rows = docs.limit(50).collect()
    got = {r.doc_id: r for r in toxicity.score(docs, one).collect()}
    for r in rows:
        data, offsets = T.flat(pa.array([r.text]))
        text, feature, value = toxicity.features(data, offsets)
        earlier = []
        for j, name in enumerate(one.names):
            z = sum(float(one.weights[j, f]) * float(v) for f, v in zip(feature, value))
            z += sum(w * p for w, p in zip(one.of_chain[j], earlier)) + one.base[j]
            earlier.append(1 / (1 + np.exp(-z)))
            assert abs(got[r.doc_id][name] - earlier[-1]) < 1e-4


def test_stages_take_odd_and_no_rows(spark):
    good = "Some plain words that follow each other without any harm in a text of their own. "
    rows = [(1, good * 3, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, good * 3, "en", "s", 1),
            (None, good, "en", "s", 1), (1, good * 3, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(1)).withColumn("doc", F.lit(2))
    for n in (len(rows), 0):
        frame = docs.limit(n)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SMALL)
            assert out.columns == docs.columns and out.count() <= n
        assert corpus_pipeline.to_tokens(spark, frame, SMALL).count() == n
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3]


def test_pipeline_runs_as_its_stages_say(spark, tmp_path):
    """Brute force over what each stage reads: the stages' own operators are tested above."""
    out = corpus_pipeline.run(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    want = {r.doc_id: r.ids for r in bpe.encode(docs, queries.tokenizer()).collect()}
    assert {r.doc_id: r.ids for r in out.collect()} == want


def test_each_stage_reads_what_the_one_before_wrote(spark, monkeypatch):
    read = []

    def watched(stage):
        def run(spark, docs, sf_dir):
            read.append((docs.inputFiles(), docs._jdf.queryExecution().optimizedPlan().toString()))
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(s)) for n, s in corpus_pipeline.STAGES])
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    files = [{f.rsplit("/", 1)[0] for f in files} for files, _ in read]
    assert len(read) == 5 and len(set.union(*files)) == 5 and all(len(f) == 1 for f in files)
    assert not any("MapInArrow" in plan for _, plan in read)


def test_texts_of_a_repeated_id_go_through_the_pipeline_alike(spark, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()
    texts = [r.text for r in rows]
    rows = [r.asDict() | {"doc_id": r.doc_id % 20} for r in rows]
    out = []
    for turn, order in enumerate((rows, rows[::-1])):
        at = str(tmp_path / str(turn))
        spark.createDataFrame(order, DOCS).coalesce(1).write.parquet(f"{at}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
        out.append({r.doc_id: r.ids for r in corpus_pipeline.run(spark, at).collect()})
    assert len(texts) == 60 and 0 < len(out[0]) <= 20 and out[0] == out[1]
