"""The numbered queries over the driver tables, each a thin digest of its operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from provena.llm import bpe, centroids, common, decontaminate, jaccard, language, licenses, neardup, quality, spelling, substring, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _learned(labels: DataFrame, modulus: int, held: int) -> DataFrame:
    return labels.where(F.coalesce(common.remainder("doc_id", modulus) != held, F.lit(True)))


def _with_decision(scored: DataFrame, modulus: int, held: int) -> DataFrame:
    return scored.withColumns({"held_out": common.remainder("doc_id", modulus) == held, "predicted": (F.col("score") >= 0.7).cast("int")})


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    labels = _learned(table(spark, folder, "labels"), 3, 1)
    return _with_decision(toxicity.score(table(spark, folder, "documents"), labels), 3, 1)


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    labels = _learned(table(spark, folder, "labels"), 4, 2)
    return _with_decision(quality.score(table(spark, folder, "documents"), labels), 4, 2)


def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"), common.scratch_folder(spark))


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
head AS (SELECT h, max(page_id) AS head FROM p WHERE octet_length(b) >= 1000 GROUP BY h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN head USING (h)"""


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select("doc_id", F.size("sentences").cast("bigint").alias("n_sentences"), F.array_join("rules", ",").alias("rules"), F.array_join("licenses", ",").alias("licenses"))


def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_sets(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


# Pairs of distinct sets by shared shingles, then the least reachable document by a recursive walk.
JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS t
  FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS u(i) WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS n, md5(string_agg(t, '|' ORDER BY t)) AS h FROM s GROUP BY doc_id),
heads AS (SELECT h, min(doc_id) AS head FROM z GROUP BY h),
hs AS (SELECT s.doc_id, t, n FROM s JOIN z USING (doc_id) JOIN heads ON head = s.doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM hs a JOIN hs b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
walk(node, seen) AS (SELECT head, head FROM heads UNION SELECT walk.node, edges.b FROM walk JOIN edges ON edges.a = walk.seen),
comp AS (SELECT node, min(seen) AS component_id FROM walk GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN heads USING (h) LEFT JOIN comp ON comp.node = heads.head"""


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = language.identify(documents, _learned(documents, 3, 1))
    return found.withColumn("held_out", common.remainder("doc_id", 3) == 1)


def exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return coded.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


# Windows and words by position, joined by content: the plain form of the same result.
DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, lens, unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i)),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
its AS (SELECT doc_id, array_agg(DISTINCT CAST(item_id AS VARCHAR) ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.repeated_windows(table(spark, folder, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", F.col("digest").alias("kept_sha256"))


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - 33, 1))) AS u(i)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM win SEMI JOIN rep USING (h), unnest(range(i, i + 35)) AS u(p)),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n_kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


# crc32 by its table of 256 entries; words are near if one is the other without a letter, or both are equal without
# the letter at the same place.
SPELLING_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_transform(range(len(x) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h
  FROM bytes, crc),
changed AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS u(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({'k': -other_n, 'other': other}) AS top FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.k >= 10 * n THEN top.other END AS form, CASE WHEN -top.k >= 10 * n THEN -top.k END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS onward FROM formed UNION ALL SELECT walk.word, walk.onward, f.form FROM walk JOIN formed f ON f.word = walk.onward)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM walk WHERE onward IS NULL) USING (word)"""


def embedding_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "embeddings"))


NEARDUP_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
edges AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.98 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
walk(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT node, b FROM walk JOIN edges ON a = seen)
SELECT vec_id, (SELECT count(*) FROM edges WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT node, min(seen) AS component_id FROM walk GROUP BY node) ON node = vec_id"""


def centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings"))


def _centroid_sql(rounds: int = 3) -> str:
    """Vectors as (vec_id, place, x) rows; one assignment and one mean a round."""
    steps = [
        """WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS cluster, e AS c FROM v
  ORDER BY sha256('1:' || vec_id) LIMIT 16)"""
    ]
    gap = "list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
  SELECT r, any_value(vec_id) AS vec_id, any_value(e) AS e, min({{'d': CAST({gap} AS BIGINT), 'cluster': cluster}}) AS best
  FROM v, c{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT best.cluster AS cluster, p, sum(e[p]) AS s, count(*) AS n FROM a{i}, range(1, 65) AS u(p) GROUP BY 1, 2),
c{i + 1} AS (
  SELECT c{i}.cluster, coalesce(n.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS c FROM m{i} GROUP BY cluster) n USING (cluster))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, best.cluster AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.cluster = c{rounds}.cluster"""


QUERIES: dict[str, Query] = {
    "op1_toxicity": toxicity_scores,
    "op2_quality": quality_scores,
    "op3_warc": warc_round_trip,
    "op4_decontamination": decontamination,
    "op5_license_scan": license_scan,
    "op6_ngram_jaccard": jaccard_join,
    "op7_language": language_id,
    "op8_exact_topk": exact_topk,
    "op9_byte_bpe": byte_bpe,
    "op10_substring_dedup": substring_dedup,
    "op11_spelling": spelling_variants,
    "op12_embedding_neardup": embedding_neardup,
    "op13_centroids": centroid_clusters,
}

ORACLES: dict[str, str] = {
    "op3_warc": WARC_SQL,
    "op4_decontamination": DECONTAMINATION_SQL,
    "op5_license_scan": licenses.oracle(),
    "op6_ngram_jaccard": JACCARD_SQL,
    "op8_exact_topk": TOPK_SQL,
    "op10_substring_dedup": SUBSTRING_SQL,
    "op11_spelling": SPELLING_SQL,
    "op12_embedding_neardup": NEARDUP_SQL,
    "op13_centroids": _centroid_sql(),
}
