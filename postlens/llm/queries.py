"""The registered queries of the operators, with their check SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.catalog.registry import query
from postlens.llm import (
    decontaminate,
    exact_dedup,
    language_id,
    lm_score,
    minhash,
    packing,
    quality,
    source_audit,
    spelling,
    substring_dedup,
    suffix_dedup,
    vector_join,
    warc,
)

from postlens.session import staging_root


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    return language_id.predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query()
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
        "kept_sha256")


@query("""WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL),
  l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label
    AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
  r(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
  c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u),
  n AS (SELECT u, count(*) AS k FROM l GROUP BY u)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id""")
def op3_vector_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_copies(table(spark, sf_dir, "embeddings"))


@query("""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  t AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b,
    CASE WHEN i > 2 THEN w[i - 2] END AS a FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
  n1 AS (SELECT c, count(*) AS k FROM t GROUP BY c),
  n2 AS (SELECT b, c, count(*) AS k FROM t WHERE b IS NOT NULL GROUP BY b, c),
  n3 AS (SELECT a, b, c, count(*) AS k FROM t WHERE a IS NOT NULL GROUP BY a, b, c),
  s AS (SELECT doc_id, CASE WHEN n3.k >= 2 THEN log10(n3.k / ab.k)
      WHEN bc.k >= 2 THEN log10(bc.k / n1b.k) + CASE WHEN a IS NULL THEN 0 ELSE log10(0.4) END
      ELSE log10(n1.k / (SELECT count(*) FROM t)) + CASE WHEN b IS NULL THEN 0 WHEN a IS NULL
        THEN log10(0.4) ELSE 2 * log10(0.4) END END AS l,
      CASE WHEN n3.k >= 2 THEN 3 WHEN bc.k >= 2 THEN 2 ELSE 1 END AS o
    FROM t JOIN n1 USING (c) LEFT JOIN n3 USING (a, b, c) LEFT JOIN n2 AS bc USING (b, c)
    LEFT JOIN n2 AS ab ON ab.b = t.a AND ab.c = t.b LEFT JOIN n1 AS n1b ON n1b.c = t.b)
SELECT doc_id, count(o) AS n_tokens, count(*) FILTER (o = 3) AS n_trigrams,
  count(*) FILTER (o = 2) AS n_bigrams, count(*) FILTER (o = 1) AS n_unigrams,
  round(avg(l), 5) AS mean_log10
FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id""")
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.scored(docs).select("doc_id", "n_tokens", "n_trigrams", "n_bigrams",
                                        "n_unigrams", F.round("mean_log10", 5).alias("mean_log10"))


@query()
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query("""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{staging_root(spark)}/archive-{uuid.uuid4().hex}"
    warc.archive(table(spark, sf_dir, "pages"), path)
    records = warc.read(spark, path)
    stored = F.col("record_type") == "response"
    return records.select(
        warc.page_of("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length"))
        .alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
        .alias("payload_digest"),
        "record_type", warc.page_of("refers_to").alias("refers_to"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
    FROM d, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS t(i)),
  n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b USING (g)
    WHERE a.doc_id < b.doc_id GROUP BY ALL),
  h AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
    WHERE 100 * c >= 75 * (x.k + y.k - c)),
  l AS (SELECT u, v FROM h UNION ALL SELECT v, u FROM h),
  r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
  c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, coalesce(k, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)""")
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents"))


@query()
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query()
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


@query("""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
    FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
  f AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g),
  r AS (SELECT DISTINCT doc_id, i + k AS p FROM s JOIN f USING (g), unnest(range(13)) AS o(k)
    WHERE least < doc_id),
  q AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(
    list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' '))
  AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)""")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query("""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  g AS (SELECT DISTINCT lang, source FROM d),
  t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
  k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 10),
  v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
  c AS (SELECT t.lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
  s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
  p AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n,
      1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v)::HUGEINT AS p,
      1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v)::HUGEINT AS q
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source)
    LEFT JOIN c USING (lang, source, term)),
  a AS (SELECT x.lang, x.source, y.source AS item,
      sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
  r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
    FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 10""")
def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


@query("""WITH RECURSIVE d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\\x{00C0}-\\x{00FF}]{7,}')) AS run FROM documents),
  e AS (SELECT id, run, count(*) AS k, flatten(list_transform(string_split(id || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]
      ELSE [192 + (ord(c) >> 6), -1, -1, -1, -1, -1, -1, -1, -1,
        128 + (ord(c) & 63), -1, -1, -1, -1, -1, -1, -1, -1] END)) AS bits FROM d GROUP BY ALL),
  h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, bits::BIGINT[]), lambda c, x:
    CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h FROM e),
  r AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END
    AS word, k FROM h),
  w AS (SELECT word, sum(k)::BIGINT AS n FROM r WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
  x AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM w, unnest(range(1, length(word) + 1)) AS t(i)),
  l AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i
      AND length(a.word) = length(b.word) AND a.word <> b.word
    UNION SELECT w.word, w.n, x.word, x.n FROM w JOIN x ON x.rest = w.word
    UNION SELECT x.word, x.n, w.word, w.n FROM w JOIN x ON x.rest = w.word),
  p AS (SELECT word, n, count(*) AS n_near,
    first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM l GROUP BY ALL),
  f AS (SELECT word, near AS form, near_n AS form_n FROM p WHERE near_n >= 10 * n),
  c(word, root, step) AS (SELECT word, word, 0 FROM w UNION ALL
    SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.root)
SELECT w.word, form, root, w.n, coalesce(n_near, 0) AS n_near, form_n
FROM w LEFT JOIN p USING (word) LEFT JOIN f USING (word)
JOIN (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word) USING (word)""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("""SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents"))
