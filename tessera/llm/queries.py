"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.embedding_dedup import near_duplicate_vectors
from tessera.llm.exact_dedup import exact_duplicates
from tessera.llm.html_text import extract_pages, fit_page_weights
from tessera.llm.jaccard_join import jaccard_components
from tessera.llm.mixing import mix_sources
from tessera.llm.piece_codec import encode_pieces
from tessera.llm.secret_scan import scan_secrets
from tessera.llm.substring_dedup import dedup_passages
from tessera.llm.token_files import read_token_files, write_token_files
from tessera.llm.toxicity import fit_severity, score_severity
from tessera.plans.scratch import new_path


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; it is the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return scan_secrets(docs, owner=F.col("source"), repository=F.col("doc_id"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_severity(docs, fit_severity(docs, _table(spark, sf_dir, "labels")))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), k=5, percent=80)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(_table(spark, sf_dir, "documents"), window=13)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    shards = write_token_files(_table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path, shards)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return extract_pages(pages, fit_page_weights(pages))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op3_piece_codec": op3_piece_codec,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_files": op7_token_files,
    "op8_html_text": op8_html_text,
    "op9_mix_sources": op9_mix_sources,
    "op10_embedding_dedup": op10_embedding_dedup,
}

OP4_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR || '/17'), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT skey, sum(size)::HUGEINT AS source_size FROM d GROUP BY skey),
w AS (SELECT skey, source_size, 2 * source_size AS cap,
             CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (SELECT *, row_number() OVER o AS nth,
             150 * sum(source_size) OVER () - 100 * coalesce(sum(cap) OVER (ORDER BY cap * (10 // w), skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left100,
             sum(w) OVER (ORDER BY cap * (10 // w), skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
      FROM w WINDOW o AS (ORDER BY cap * (10 // w), skey)),
cut AS (SELECT nth AS c_nth, left100 AS c_left, w_left AS c_w FROM r WHERE left100 * w <= cap * 100 * w_left ORDER BY nth LIMIT 1),
t AS (SELECT skey, source_size, CASE WHEN c_nth IS NULL OR nth < c_nth THEN cap::DOUBLE
             ELSE c_left::DOUBLE * w::DOUBLE / (100.0::DOUBLE * c_w::DOUBLE) END AS target
      FROM r LEFT JOIN cut ON true),
b AS (SELECT *, round(target)::BIGINT AS budget, greatest(source_size, 1)::BIGINT AS safe FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       ((budget // safe) * size + least(size, greatest(0, budget % safe - ahead)))::BIGINT AS taken
FROM p JOIN b USING (skey)
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, k = a.n AND k = b.n AS same FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS y FROM r GROUP BY 1),
z AS (SELECT x, count(*) AS z FROM l WHERE same GROUP BY 1)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(c.y, doc_id)) AS component_id, 1 + coalesce(z, 0) AS class_size
FROM n LEFT JOIN c ON c.x = doc_id LEFT JOIN z ON z.x = doc_id
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS q FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
m AS (SELECT q, min(doc_id) AS m FROM v GROUP BY 1),
g AS (SELECT DISTINCT doc_id, i + k.range AS i FROM v JOIN m USING (q) CROSS JOIN range(13) k WHERE m < doc_id),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
x AS (SELECT w.doc_id, w.i, word, g.i IS NOT NULL AS gone FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.i = w.i),
f AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM x),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, count(*) FILTER (WHERE starts) AS f, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(f, 0) AS n_factors FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {"op4_exact_dedup": OP4_SQL, "op5_jaccard_join": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op9_mix_sources": OP9_SQL}
