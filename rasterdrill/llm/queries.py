"""One query per operator of the subpackage, over its whole table, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from rasterdrill.llm import (
    bpe, decontam, minhash, phrases, quality, rabin, shards, store, suffix, tokens, topk, toxicity, transducer, urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    to = store.fresh_path(spark, "token-files")
    tokens.write_tokens(docs, to, tokenizer())
    return tokens.checksums(tokens.read_tokens(spark, to))


@query
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, tokenizer())


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, k=2, percent=80).withColumnRenamed("id", "doc_id")


SQL["op3_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
           ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
twice AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM twice UNION SELECT r.a, t.b FROM reach r JOIN twice t ON r.b = t.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS kept
FROM s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""


@query
def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jump consistent hashing of ``doc_id`` to 24 shards, and to 25."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    dealt = shards.assign(shards.assign(docs, "doc_id", 24), "doc_id", 25, "grown_shard")
    out = shards.numbered(dealt)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


# Fixed by the contract.
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge(pages, [urls.rule(*r) for r in URL_RULES])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(column: str) -> str:
    longest = sorted(URL_RULES, key=lambda r: (r[1].partition("/")[0].count("."), len(r[1])), reverse=True)
    cases = []
    for verdict, text in longest:
        host, slash, path = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')"
        cases.append(f"WHEN {fits} THEN '{text if column == 'rule' else verdict}'")
    return f"CASE {' '.join(cases)} ELSE {'NULL' if column == 'rule' else repr('allow')} END"


SQL["op5_url_filter"] = f"""
WITH cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT page_id, host, path, {_rule_sql('rule')} AS rule, {_rule_sql('verdict')} AS verdict FROM cut
"""


@query
def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each category of the chain, and whether the document is rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).withColumn("rejected", F.col("toxic") >= 0.5)


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


SQL["op7_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s
      FROM d, LATERAL (SELECT unnest(range(0, length(h) // 2 - 99)) AS i) WHERE length(h) >= 200),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w),
b AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100
             OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS fresh
      FROM r WHERE n > 1),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, span),
cut AS (SELECT doc_id, span, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY span) AS nxt FROM spans),
kept AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * z + 1, 2 * (coalesce(nxt, length(h) // 2) - z)), '' ORDER BY span) AS tail,
         any_value(substr(h, 1, 2 * first_a)) AS front
  FROM cut JOIN d USING (doc_id) JOIN (SELECT doc_id, min(a) AS first_a FROM spans GROUP BY doc_id) USING (doc_id)
  GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(front || tail, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.mark(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


SQL["op8_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
hit AS (SELECT doc_id, pos.n, i, item_id FROM pos JOIN win ON win.n = pos.n AND win.g = pos.g),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", topk.whole(F.col("embedding"), 256.0).alias("v")
    )
    return topk.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


SQL["op9_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = quality.score(docs, table(spark, sf_dir, "labels"), held_out)
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op11_rabin_karp_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words that stand earlier, cut out of every document."""
    return rabin.digests(table(spark, sf_dir, "documents"), length=20)


SQL["op11_rabin_karp_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d),
win AS (
  SELECT doc_id, k AS i, list(x) OVER ahead AS s FROM words
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(s, ' ')) ORDER BY doc_id, i) AS n
    FROM win WHERE len(s) = 20) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM again),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS s, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op12_transducer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of a language are apart, over terms in at least 30 of its documents."""
    docs = table(spark, sf_dir, "documents")
    return transducer.divergence(docs, least=30, add=5, scale=1_000_000_000, top=50)


SQL["op12_transducer_audit"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
term AS MATERIALIZED (SELECT k, lang, source, unnest(w) AS t FROM d),
kept AS MATERIALIZED (SELECT lang, t FROM term GROUP BY lang, t HAVING count(DISTINCT k) >= 30),
grp AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
v AS MATERIALIZED (SELECT l.lang, count(kept.t) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept USING (lang) GROUP BY l.lang),
cnt AS MATERIALIZED (SELECT lang, source, t, count(*) AS n FROM term JOIN kept USING (lang, t) GROUP BY lang, source, t),
tot AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM grp LEFT JOIN cnt USING (lang, source) GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT tot.lang, tot.source, kept.t, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM tot JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN cnt ON cnt.lang = tot.lang AND cnt.source = tot.source AND cnt.t = kept.t),
q AS (
  SELECT kept.lang, kept.t, 1 + (1000000000::HUGEINT * (coalesce(s.n, 0) + 5)) // (w.total + 5 * v) AS q
  FROM kept JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM tot GROUP BY lang) w USING (lang)
  LEFT JOIN (SELECT lang, t, sum(n) AS n FROM cnt GROUP BY lang, t) s ON s.lang = kept.lang AND s.t = kept.t),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
more AS (SELECT p.lang, p.source, p.t AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p.p > q.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM more)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of two and three words of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=10, inside=50, top=2000)


SQL["op13_phrase_collocations"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS s
  FROM documents),
w AS (SELECT row_number() OVER () AS k, lang, list_filter(string_split_regex(s, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
x AS (SELECT k, lang, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS one FROM w),
pos AS (SELECT lang, one, lead(one) OVER o AS two, lead(one, 2) OVER o AS three FROM x WINDOW o AS (PARTITION BY k ORDER BY i)),
gram AS (
  SELECT lang, 1 AS m, one AS g, one, NULL AS two, NULL AS three FROM pos
  UNION ALL SELECT lang, 2, one || ' ' || two, one, two, NULL FROM pos WHERE two IS NOT NULL
  UNION ALL SELECT lang, 3, one || ' ' || two || ' ' || three, one, two, three FROM pos WHERE three IS NOT NULL),
f AS MATERIALIZED (SELECT lang, m, g, one, two, three, count(*)::HUGEINT AS a FROM gram GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT * FROM f WHERE m > 1 AND a >= 10),
halves AS (
  SELECT lang, g, m, a, 1 AS k, one AS lg, CASE WHEN m = 2 THEN two ELSE two || ' ' || three END AS rg FROM cand
  UNION ALL SELECT lang, g, m, a, 2, one || ' ' || two, three FROM cand WHERE m = 3),
cut AS (
  SELECT h.lang, h.g, h.m, h.a, k, l.a AS l, r.a AS r, (1000000 * h.a * h.a) // (l.a * r.a) AS score
  FROM halves h JOIN f l ON l.lang = h.lang AND l.g = h.lg JOIN f r ON r.lang = h.lang AND r.g = h.rg),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (
  SELECT lang, one || ' ' || two AS g, a FROM cand WHERE m = 3
  UNION ALL SELECT lang, two || ' ' || three, a FROM cand WHERE m = 3),
inner_ AS (SELECT DISTINCT c.lang, c.g FROM cand c JOIN longer t ON t.lang = c.lang AND t.g = c.g AND 100 * t.a >= 50 * c.a WHERE c.m = 2),
best AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, score
  FROM low ANTI JOIN inner_ USING (lang, g))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM best JOIN n USING (lang) WHERE rank <= 2000
"""
