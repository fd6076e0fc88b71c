"""The registered queries of this subpackage, with their production parameters.

Each applies one operator to its whole table and derives the digest columns from the result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from ragloom.llm import alignment, pii, quality, ranking, secrets, toxicity
from ragloom.llm.common import read
from ragloom.llm.decontaminate import contamination
from ragloom.llm.fingerprints import fingerprints
from ragloom.llm.packing import pack_documents
from ragloom.llm.sharding import shard_documents
from ragloom.llm.simhash import near_duplicates
from ragloom.llm.token_files import read_token_files, write_token_files
from ragloom.llm.url_reputation import judge_urls
from ragloom.session import scratch_path

CAPACITY = 2048


def op1_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_token_files(spark, sf_dir):
    path = scratch_path(spark, f"token_files/{uuid.uuid4().hex}")
    write_token_files(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_iblt_fingerprints(spark, sf_dir):
    found = fingerprints(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                        "near_edited", "near_next")


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op4_url_reputation(spark, sf_dir):
    """A page's outcome is the label of the document of its number: bad if it is toxic or of low quality."""
    labels = read(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    judged = judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, pre, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                        ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL
                                             ELSE 0 END) AS bad
          FROM labels GROUP BY doc_id),
labelled AS (SELECT host, split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l,
                    count(bad) AS n, coalesce(sum(bad), 0) AS bad
             FROM p LEFT JOIN (SELECT * FROM known WHERE bad IS NOT NULL) USING (page_id) GROUP BY host),
hosts AS (SELECT *, array_to_string(l[-(CASE WHEN array_to_string(l[-2:], '.') IN (
            'ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn',
            'com.mx', 'com.tr', 'com.tw', 'gov.uk', 'ne.jp', 'net.au', 'or.jp', 'org.au', 'org.uk') THEN 3 ELSE 2 END):], '.') AS domain
          FROM labelled),
h AS (SELECT *, regexp_extract(domain, '^[^.]*\.(.*)$', 1) AS suffix FROM hosts),
g AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS m FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM h, g GROUP BY suffix),
s1 AS (SELECT 1 / least(greatest(coalesce(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0),
                                 0.001), 0.9) - 1 AS k FROM s0),
s AS (SELECT suffix, (m * k + bad) / (k + n) AS m FROM s0, s1),
d0 AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM h JOIN s USING (suffix) GROUP BY suffix, domain),
d1 AS (SELECT 1 / least(greatest(coalesce(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0),
                                 0.001), 0.9) - 1 AS k FROM d0),
d AS (SELECT domain, (m * k + bad) / (k + n) AS m FROM d0, d1),
h0 AS (SELECT host, n, bad, m FROM h JOIN d USING (domain)),
h1 AS (SELECT 1 / least(greatest(coalesce(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0),
                                 0.001), 0.9) - 1 AS k FROM h0),
ab AS (SELECT host, m * k + bad AS a, (1 - m) * k + n - bad AS b FROM h0, h1),
rep AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 AS blocked FROM ab),
fit AS (SELECT host, path, arg_max(h || pre, length(h || pre)) AS rule, arg_max(v, length(h || pre)) AS verdict
        FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)
        GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN rep USING (host) LEFT JOIN fit USING (host, path)
"""


def op5_histogram_sharding(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shard_documents(docs, n_shards=40)
    return placed.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                         F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_benchmark_decontamination(spark, sf_dir):
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _joined(columns):
    """kind:start:end of all spans, by kind as listed, then start, with commas between."""
    return F.array_join(F.concat(*[F.transform(F.array_sort(c), _written(k)) for k, c in zip(pii.KINDS, columns)]), ",")


def _written(kind):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def op6_pii(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.train(docs))
    base, more = found.columns[2:6], found.columns[6:10]
    return found.select(
        "doc_id", *[F.size(c).cast("long").alias(f"n_{k}") for k, c in zip(pii.KINDS, base)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined([F.concat(a, b) for a, b in zip(base, more)]).alias("spans"))


def op7_secret_scan(spark, sf_dir):
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "start", "end", F.sha2("secret_text", 256).alias("secret_sha256"), "score", "secret")


OP8_SQL = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[a:a + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS a
        FROM (SELECT *, least(13, len(w)) AS n FROM item_words WHERE len(w) > 0))),
places AS (
  SELECT rid, n, a, array_to_string(w[a:a + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS a
        FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT DISTINCT rid, p.n, a, item_id FROM places p JOIN windows USING (n, win)),
hit AS (SELECT rid, count(DISTINCT pos) AS n_hit
        FROM (SELECT rid, unnest(range(a, a + n)) AS pos FROM (SELECT DISTINCT rid, n, a FROM found)) GROUP BY rid),
listed AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM doc_words LEFT JOIN hit USING (rid) LEFT JOIN listed USING (rid)
"""


def op10_best_fit_packing(spark, sf_dir):
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                          end_id=0, capacity=CAPACITY)


def op11_tokenizer_alignment(spark, sf_dir):
    found = alignment.alignments(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return alignment.counted(found.withColumn("groups_sha256", digest).drop("groups"))


def op12_ranked_search(spark, sf_dir):
    found = ranking.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)
    return found.select("item_id", "rank", "doc_id", "score")


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tf, s GROUP BY term, n_docs),
q AS (SELECT iid, item_id, term, count(*) AS q FROM (
        SELECT iid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS iid, * FROM benchmark)) GROUP BY iid, item_id, term),
scored AS (
  SELECT iid, item_id, rid, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(t) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (rid), s GROUP BY iid, item_id, rid),
ranked AS (SELECT iid, item_id, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank
           FROM scored JOIN d USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op13_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_token_files, op3_iblt_fingerprints, op4_url_reputation, op5_histogram_sharding, op6_pii, op7_secret_scan, op8_benchmark_decontamination, op9_toxicity, op10_best_fit_packing,
                                  op11_tokenizer_alignment, op12_ranked_search, op13_quality_classifier)}
ORACLE_SQL = {"op4_url_reputation": OP4_SQL, "op8_benchmark_decontamination": OP8_SQL, "op12_ranked_search": OP12_SQL}
