"""The corpus operators' registered queries, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc.llm import decontaminate, digest_cache, hnsw, interleave, jaccard_join, knn_quality, language_crf, repair, secret_scan, sentencepiece_rounds
from readqc.llm.common import table


def op1_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_cache.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.interleave(table(spark, sf_dir, "documents"))


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_crf.identify(docs, language_crf.train(docs))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_rounds.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return knn_quality.score_quality(docs, knn_quality.train(docs, table(spark, sf_dir, "labels")))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL can express."""
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def interleave_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 without the checksum, which SQL can't express."""
    return op5_interleave(spark, sf_dir).select("doc_id", "size", "law", F.col("shard").cast("long").alias("shard"), "slot")


QUERIES = {
    f.__name__: f
    for f in (
        op1_repair_token_files, op2_digest_cache, op3_secret_scan, op4_hnsw, op5_interleave, op6_language_crf, op7_jaccard_join,
        op8_decontamination, op9_sentencepiece, op10_knn_quality, secret_counts, interleave_places,
    )
}

_LOWER = "translate(coalesce({0},''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"

_JACCARD = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4],' ') for i in range(1,len(w)-3)] WHEN len(w) > 0 THEN [array_to_string(w,' ')] ELSE [] END) AS s FROM w),
 e AS (SELECT r, len(s) AS n, unnest(s) AS g FROM s),
 l AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100*count(*) >= 75*(a.n+b.n-count(*))),
 c(a, b) AS (SELECT r, r FROM s UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
 m AS (SELECT c.a, min(s.doc_id) AS component_id FROM c JOIN s ON s.r = c.b GROUP BY c.a)
 SELECT s.doc_id, len(s.s) AS n_shingles, m.component_id FROM s JOIN m ON m.a = s.r"""

_WORDS = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_CONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
 i AS (SELECT item_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark), k AS (SELECT item_id, w, least(len(w),10) AS k FROM i WHERE len(w) > 0),
 bw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p+k-1],' ') AS g FROM (SELECT *, unnest(range(1,len(w)-k+2)) AS p FROM k)),
 dw AS (SELECT r, k, p, array_to_string(w[p:p+k-1],' ') AS g FROM (SELECT r, w, k, unnest(range(1,len(w)-k+2)) AS p FROM d, (SELECT DISTINCT k FROM bw))),
 h AS (SELECT r, item_id, k, p FROM dw JOIN bw USING (k, g)),
 hw AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p,p+k)) AS q FROM h) GROUP BY r),
 it AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::varchar AS id FROM h) GROUP BY r)
 SELECT doc_id, len(w) AS n_words, coalesce(hw.n,0) AS n_hit, coalesce(it.n,0) AS n_items, sha256(coalesce(ids,'')) AS items_sha256, coalesce(hw.n,0) > 0 AS contaminated FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)"""

_SECRETS = r"""SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)(?-i)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 6)) AS n_assign,
 len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: len(x) >= 24)) AS n_hex
 FROM (SELECT doc_id, coalesce(text,'') AS t FROM documents)"""

_PLACES = """WITH r AS (SELECT doc_id, octet_length(encode(coalesce(text,'')))+1 AS size, coalesce('='||source,'') AS stratum, md5('mixture:'||coalesce(doc_id::varchar,'null')||':'||coalesce(md5(text),'')) AS key FROM documents),
 p AS (SELECT *, ((row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, size)-1)*2+1)::double/(count(*) OVER (PARTITION BY stratum)*2)::double AS part FROM r),
 q AS (SELECT *, row_number() OVER (ORDER BY part, stratum, key, doc_id, size)-1 AS i, count(*) OVER () AS n FROM p),
 e AS (SELECT *, n//16 AS small, n%16 AS longer, (n%16)*(n//16+1) AS edge FROM q)
 SELECT doc_id, size, 'rows' AS law, CASE WHEN i < edge THEN i//(small+1) ELSE longer+(i-edge)//small END AS shard, CASE WHEN i < edge THEN i%(small+1) ELSE (i-edge)%small END AS slot FROM e"""

#: The others' results (models, entropy spans, checksums, a library's ids, links of vectors in double precision) are held
#: against brute force, libraries and held-out rows in the tests.
ORACLE_SQL: dict[str, str] = {"op7_jaccard_join": _JACCARD, "op8_decontamination": _CONTAMINATION, "secret_counts": _SECRETS, "interleave_places": _PLACES}
