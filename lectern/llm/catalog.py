"""Queries of the training-data operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, exponion, licenses, merkle, mixing, quality_crf, quality_rules, simhash, substrings, suffixes, tokens, toxicity, urls
from lectern.llm.long_sql import EXPONION, MERKLE, SUFFIXES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document: three-word shingles, links of two bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, budget=2)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices in every document, exact and with errors: figures, labels, score and the places themselves."""
    return licenses.license_summary(licenses.find_licenses(_table(spark, sf_dir, "documents")))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of passages of 20 words that start earlier: counts and hash of what is left."""
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), window=20, texts=False)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or re-parameterised, with share and span."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: where each document's ids stand, how many, and their CRC."""
    return tokens.token_files(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, and its offending sentences."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of the quality rules for every document."""
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


#: Rules of the URL filter, host and path together.
URL_RULES = {"allow": ["org/", "com/fr/"], "block": ["example.org/es/", "example.org/en/1", "com/de/"]}


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url. The host list stands for a block list drawn from the corpus: hosts whose MD5 begins with 0 (a sixteenth)."""
    pages = _table(spark, sf_dir, "pages")
    hosts = urls.split_url(pages.select("url")).select("host").distinct().where("host <> '' and substr(md5(cast(host as binary)), 1, 1) = '0'")
    return urls.filter_urls(pages, URL_RULES, hosts)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, and its bad lines."""
    return quality_crf.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every whole vector after ten rounds of k-means, with inertia and the centroid's hash."""
    return exponion.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10).drop("scanned")


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that start more than once: counts, runs, and hash of what is left."""
    return suffixes.remove_repeated_bytes(_table(spark, sf_dir, "documents"), length=400, texts=False)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the fold of those whose line feeds were deleted (even CRCs of the id)."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.document_manifest(_table(spark, sf_dir, "documents"), tampered=tampered)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_licenses": op4_licenses,
    "op5_substrings": op5_substrings,
    "op6_quality_rules": op6_quality_rules,
    "op7_urls": op7_urls,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_tokens": op10_tokens,
    "op11_centroids": op11_centroids,
    "op12_suffixes": op12_suffixes,
    "op13_merkle": op13_merkle,
}
ORACLES: dict[str, str] = {
    "op11_centroids": EXPONION,
    "op12_suffixes": SUFFIXES,
    "op13_merkle": MERKLE,
    "op5_substrings": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS pos, ws FROM w WHERE len(ws) >= 20
), seq AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(ws[pos:pos + 19], ' ') ORDER BY doc_id, pos) AS k FROM win
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS at FROM seq, unnest(range(0, 20)) AS t(d) WHERE k > 1
), word AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS at, unnest(ws) AS w FROM w
), kept AS (
  SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.at) AS t, count(*) AS n
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.at = gone.at GROUP BY 1
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
""",
    "op2_mixing": r"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('17-' || coalesce(doc_id::VARCHAR, 'null') || '-' || md5(coalesce(text, ''))) AS h FROM documents
), d AS (
  SELECT doc_id, source, size, h, count(*) AS copies FROM r GROUP BY ALL
), s AS (
  SELECT source, sum(size * copies)::BIGINT AS source_size, count(*) AS n, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source
), lv AS (
  SELECT 0.0::DOUBLE AS level, 0 AS k
  UNION ALL
  SELECT (SELECT (1.5 * (SELECT sum(source_size) FROM s) - sum(CASE WHEN w * lv.level > 2.0 * source_size THEN 2.0 * source_size ELSE 0.0 END)) / sum(CASE WHEN w * lv.level > 2.0 * source_size THEN 0.0 ELSE w END) FROM s), k + 1
  FROM lv WHERE k < 30
), top AS (SELECT max(level) AS level FROM lv
), t AS (
  SELECT source, source_size, n, least(w * level, 2.0 * source_size) AS target FROM s, top
), g AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS part,
    ('0x' || substr(h, 1, 8))::BIGINT % ceil(n / 4096)::BIGINT AS g
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, sum(size * copies) OVER (PARTITION BY source, g) AS total,
    coalesce(sum(size * copies) OVER (PARTITION BY source, g ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g
), e AS (
  SELECT *, greatest(0, least(size * copies, floor(total * part + 0.5) - before)) AS more, unnest(range(copies)) AS k FROM c
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (whole * size + greatest(0, least(size, more - k * size)))::BIGINT AS taken FROM e
""",
    "op7_urls": r"""
WITH r AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), rule(h, q, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), hit AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v
  FROM p JOIN rule ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(path, q) GROUP BY page_id
), listed AS (SELECT DISTINCT host AS l FROM p WHERE host <> '' AND md5(host)[1] = '0'
), blocked AS (
  SELECT page_id, arg_max(l, length(l)) AS l FROM p JOIN listed ON p.host = l OR ends_with(p.host, '.' || l) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(v, CASE WHEN l IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l AS listed_host
FROM p LEFT JOIN hit USING (page_id) LEFT JOIN blocked USING (page_id)
""",
}
