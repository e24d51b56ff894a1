"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import infill, jaccard, langid, licenses, merkle, mixing, negatives, packing, passages, products, toxicity, vectors, warc
from .shared import crc32_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_pairs(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    model = toxicity.fit(docs, labels)
    return toxicity.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    page = lambda c: F.expr(f"try_cast(substr({c}, {len(warc.PREFIX) + 1}) AS long)")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_repeated", "n_removed", "spans")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored()).alias("restored_sha256"))


def op12_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return products.top_products(rows, rows.where("vec_id % 50 = 0"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_vectors": op2_vectors,
    "op3_licenses": op3_licenses,
    "op4_suffixes": op4_suffixes,
    "op5_jaccard": op5_jaccard,
    "op6_language": op6_language,
    "op7_fingerprints": op7_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_infill": op11_infill,
    "op12_products": op12_products,
    "op13_negatives": op13_negatives,
}

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM {documents}
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, ([5, 2, 1])[rank % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM sources
), filled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), open AS (
  SELECT arg_min(level, cap / w) AS level FROM filled WHERE cap / w > level
), targets AS (
  SELECT f.source, f.source_size, CASE WHEN cap / w <= f.level THEN cap ELSE open.level * w END AS target FROM filled f LEFT JOIN open ON true
), budgets AS (
  SELECT source, source_size, target, coalesce(least(floor(target / nullif(source_size, 0)), 2), 0)::BIGINT AS times FROM targets
), summed AS (
  SELECT s.doc_id, s.size, s.h, b.*, floor(b.target - b.times * b.source_size)::BIGINT AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h)::BIGINT AS upto, sum(s.size) OVER (PARTITION BY s.source, s.h)::BIGINT AS tied
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
), mixed AS (
  SELECT *, times * size + CASE WHEN upto <= budget THEN size WHEN upto - tied <= budget THEN floor(size * (budget - upto + tied) / tied)::BIGINT ELSE 0 END AS taken FROM summed
)
"""

WARC_SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), kept AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n >= 1000) ELSE page_id END AS keeper FROM sized
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN keeper IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to
FROM kept
"""

LICENSE_SQL = r"""
WITH templates AS (
  SELECT t.name, t.grams FROM (SELECT unnest([{rows}]) AS t)
), words AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents
), grams AS (
  SELECT doc_id, rid, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM words WHERE len(w) >= 2
), possible AS (
  SELECT doc_id, rid, name, g, grams FROM grams JOIN templates ON len(list_intersect(list_distinct(g), grams)) >= len(grams) * (0.8::DOUBLE / 1.2) - 1e-9
), places AS (
  SELECT doc_id, rid, name, len(grams) AS size, unnest(range(1, len(g) + 1)) AS p, unnest(g) AS gram, grams FROM possible
), marked AS (
  SELECT doc_id, rid, name, size, p, list_contains(grams, gram) AS own, coalesce(lag(p) OVER (PARTITION BY rid, name, gram ORDER BY p), 0) AS before FROM places
), windows AS (
  SELECT a.doc_id, a.rid, a.name, a.size, a.p, sum((e.before < a.p)::INT) OVER w AS total, sum((e.own AND e.before < a.p)::INT) OVER w AS both_
  FROM marked a JOIN marked e ON e.rid = a.rid AND e.name = a.name AND e.p >= a.p WHERE a.own WINDOW w AS (PARTITION BY a.rid, a.name, a.p ORDER BY e.p)
), scored AS (
  SELECT doc_id, rid, name, p, max(2.0::DOUBLE * both_ / (total + size)) AS dice FROM windows GROUP BY ALL
)
SELECT doc_id, name AS license, max(dice) AS dice, arg_max(p - 1, (dice, -p)) AS start, count(*) AS n_windows FROM scored WHERE dice >= 0.8 GROUP BY doc_id, name
"""

INFILL_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
         ('0x' || h[17:24])::BIGINT % 100 AS rate, ('0x' || h[25:32])::BIGINT % 100 AS turn FROM cut
), pieces AS (
  SELECT doc_id, text, n, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle,
         array_to_string(u[greatest(x, y) + 1:n], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR rate >= 100 THEN 'plain'
              WHEN turn < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""

USABLE_SQL = """
WITH usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""

PRODUCTS_SQL = USABLE_SQL + """, scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored QUALIFY rank <= 5
"""

NEGATIVES_SQL = USABLE_SQL + """, labelled AS (
  SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM usable WHERE label IS NOT NULL
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM labelled a JOIN labelled c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def _license_rows() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"{{'name': {quoted(n)}, 'grams': [{', '.join(map(quoted, licenses.bigrams(t)))}]}}" for n, t in licenses.TEMPLATES.items())


ORACLE_SQL: dict[str, str] = {
    "op3_licenses": LICENSE_SQL.replace("{rows}", _license_rows()),
    "op9_warc": WARC_SQL,
    "op11_infill": INFILL_SQL,
    "op12_products": PRODUCTS_SQL,
    "op13_negatives": NEGATIVES_SQL,
    "op1_mixing": MIX_SQL.replace("{documents}", "documents") + "SELECT doc_id, size, source, source_size, target, taken::BIGINT AS taken FROM mixed",
}
