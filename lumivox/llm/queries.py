"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumivox.llm import align, bpe, decontam, embed_dedup, license_scan, line_dedup, packing, quality, resample, simhash, suffix_tree, toxicity, warc
from lumivox.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_zip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=0.8, shingle=5)


def op5_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), threshold=0.8)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_packed_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), length=2048)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.summary(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = resample.Options(longest=1, buckets=10_000, scale=1000, least_words=20, per_cent=10, seed=2024)
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), o)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


#: The line rule by brute force over distinct lines: every edit by one word is a join on what is left without a word.
OP10_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a, text FROM documents),
u AS (SELECT doc_id, unnest(range(len(a))) AS line, unnest(a) AS unit FROM l),
w AS (SELECT doc_id, line, unit, list_filter(string_split_regex(lower(unit), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM u),
f AS (SELECT w, min((doc_id, line)) AS pos, len(w) AS n FROM w WHERE len(w) > 0 GROUP BY w),
v AS (SELECT pos, n, w, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 8),
k AS (SELECT pos, n, i, list_concat(w[1:i - 1], w[i + 1:]) AS rest FROM v),
s AS (SELECT n, i, rest, min(pos) AS pos FROM k GROUP BY n, i, rest),
gone AS (SELECT k.pos FROM k JOIN s USING (n, i, rest) WHERE s.pos < k.pos
  UNION SELECT k.pos FROM k JOIN f ON k.rest = f.w AND f.n >= 8 WHERE f.pos < k.pos
  UNION SELECT f.pos FROM k JOIN f ON k.rest = f.w AND f.n >= 8 WHERE k.pos < f.pos),
kept AS (SELECT pos FROM f WHERE pos NOT IN (SELECT pos FROM gone)),
o AS (SELECT doc_id, string_agg(unit, chr(10) ORDER BY line) AS text, count(*) AS n FROM w WHERE len(w) = 0 OR (doc_id, line) IN (SELECT pos FROM kept) GROUP BY doc_id)
SELECT l.doc_id, coalesce(o.text, '') AS text, CAST(len(a) AS INTEGER) AS n_lines, CAST(len(a) - coalesce(o.n, 0) AS INTEGER) AS n_removed FROM l LEFT JOIN o USING (doc_id)
"""

#: Equal payloads of 1000 bytes or more refer to the largest page_id.
OP1_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN f IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f IS DISTINCT FROM page_id THEN f END AS refers_to FROM q
"""


#: crc32 by its rule, of each distinct word's bytes; tab: a byte's eight steps.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
e AS (SELECT doc_id, unnest(w) AS f FROM d),
n AS (SELECT f, sum(s) AS s, sum(t) AS t, hex(encode(f)) AS h FROM (SELECT f, 1 AS s, 0 AS t FROM e UNION ALL SELECT f, 0, 1 FROM b) GROUP BY f),
tab AS (SELECT list_transform(range(256), lambda r: list_reduce([r, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS step),
c AS (SELECT f, s, t, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))),
  lambda x, y: xor(x >> 8, step[(xor(x, y) & 255) + 1]))) % 10000 AS bucket FROM n, tab),
k AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM c GROUP BY bucket),
a AS (SELECT sum(s) AS s, sum(t) AS t FROM k),
g AS (SELECT bucket, CAST(floor(1000 * ln(((CAST(k.t AS DOUBLE) + 1) * (CAST(a.s AS DOUBLE) + 10000)) / ((CAST(k.s AS DOUBLE) + 1) * (CAST(a.t AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM k, a),
w AS (SELECT e.doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM e JOIN c USING (f) JOIN g USING (bucket) GROUP BY e.doc_id),
o AS (SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(w.weight, 0) AS weight,
  coalesce(w.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM o WHERE n_features >= 20)
SELECT o.doc_id, n_features, weight, score, CASE WHEN rank <= floor(10 * n / 100) THEN rank END AS rank FROM o LEFT JOIN r USING (doc_id)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_zip_round_trip, op2_quality_classifier, op3_bpe_round_trip, op4_benchmark_decontamination, op5_suffix_tree_scores, op6_license_scan, op7_simhash_near_dedup, op8_embedding_near_dedup, op9_packed_token_rows, op10_line_dedup, op11_tokenizer_alignment, op12_importance_resampling, op13_toxicity, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_zip_round_trip": OP1_SQL, "op6_license_scan": license_scan.scan_sql(), "op10_line_dedup": OP10_SQL, "op12_importance_resampling": OP12_SQL}
