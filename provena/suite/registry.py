"""Registry queries: predicates, equi-joins, listings, integrity, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from provena.functions import crypto, text
from provena.operators import evidence, filters, listing, matching
from provena.sources import registry as reader, sinks
from provena.suite.base import RECORDS_SQL, SUSPECTS_SQL, VIEWS_SQL, query, records, suspects, table, views

ORDERS_SQL = """listing AS (
  SELECT o_orderkey AS record_id, o_orderkey AS position_index, o_custkey AS owner_user_id,
         CASE o_orderstatus WHEN 'F' THEN 'deleted' ELSE 'active' END AS status, o_orderstatus AS raw_status,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at, o_totalprice, o_orderpriority
  FROM orders)"""


def order_records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.col("o_orderkey").alias("position_index"), F.col("o_custkey").alias("owner_user_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("deleted")).otherwise(F.lit("active")).alias("status"),
        F.col("o_orderstatus").alias("raw_status"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        "o_totalprice", "o_orderpriority",
    )


# --- scans ---------------------------------------------------------------------------------------


@query("scan_registry", """SELECT vec_id // 5 AS source_group_id, CAST(vec_id % 5 AS INTEGER) AS view_index, label AS owner_user_id, len(embedding) AS dimension FROM embeddings""")
def scan_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Typed scan of the embedding table with the declared schema."""
    schema = "vec_id bigint, embedding array<float>, label int"
    rows = spark.read.schema(schema).parquet(f"{folder}/embeddings.parquet")
    return rows.select(
        F.floor(F.col("vec_id") / 5).cast("bigint").alias("source_group_id"), (F.col("vec_id") % 5).cast("int").alias("view_index"),
        F.col("label").alias("owner_user_id"), F.size("embedding").cast("bigint").alias("dimension"),
    )


@query(
    "scan_record_documents",
    """SELECT doc_id AS position_index, 'r' || doc_id AS id, 'trace-' || doc_id AS trace_id, source AS name,
              CAST(n_chars AS INTEGER) AS image_width, lang AS unknown_key FROM documents""",
)
def scan_record_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Records as JSON text and back to typed columns; unknown keys stay reachable."""
    docs = table(spark, folder, "documents")
    body = F.to_json(
        F.struct(
            F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("trace-"), F.col("doc_id").cast("string")).alias("trace_id"),
            F.col("source").alias("name"), F.col("n_chars").cast("int").alias("image_width"), F.col("lang").alias("lang"),
        )
    )
    rows = reader.scan_record_documents(docs.select(F.col("doc_id").alias("position_index"), F.lit("u").alias("user_id"), body.alias("data")))
    return rows.select("position_index", "id", "trace_id", "name", "image_width", F.variant_get("extra", "$.lang", "string").alias("unknown_key"))


@query(
    "export_csv",
    """WITH """ + ORDERS_SQL + """ SELECT record_id,
      '"o""' || record_id || '","' || owner_user_id || '","trace-' || record_id || '","V4","' || created_at || '","' || status || '","' ||
      CAST(record_id % 3 AS VARCHAR) || '","",""' AS line FROM listing""",
)
def export_csv(spark: SparkSession, folder: str) -> DataFrame:
    rows = order_records(spark, folder).select(
        "record_id", F.concat(F.lit('o"'), F.col("record_id").cast("string")).alias("name"), F.col("owner_user_id").alias("user_id"),
        F.concat(F.lit("trace-"), F.col("record_id").cast("string")).alias("trace_id"), "created_at", "status",
        (F.col("record_id") % 3).cast("double").alias("confidence"), F.lit(None).cast("double").alias("conf"),
        F.lit(None).cast("string").alias("original_url"), F.lit(None).cast("string").alias("download_url"),
    )
    lines = sinks.csv_lines(rows).select("line")
    return lines.select(F.regexp_extract("line", r'^"o""(\d+)"', 1).cast("bigint").alias("record_id"), "line")


@query(
    "media_manifest",
    """SELECT doc_id AS media_id, 'original' AS variant, CAST(octet_length(encode(text)) AS BIGINT) AS byte_size, sha256(text) AS sha256 FROM documents""",
)
def media_manifest(spark: SparkSession, folder: str) -> DataFrame:
    from provena.sources.images import media_manifest as manifest

    files = table(spark, folder, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return manifest(files, F.lit("original")).select(F.col("path").alias("media_id"), "variant", "byte_size", "sha256")


@query(
    "append_generation_batch",
    """WITH RECURSIVE k AS (
  SELECT doc_id AS record_id, doc_id % 5 = 4 AS old, concat(doc_id % 7, '|', source, '-', n_chars % 10) AS k1, concat(doc_id % 7, '|', substr(md5(text), 1, 3)) AS k2 FROM documents),
b AS (SELECT *, row_number() OVER (ORDER BY record_id) AS i FROM k WHERE NOT old),
s AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS record_id, '' AS result, (SELECT list(k1) FROM k WHERE old) AS a1, (SELECT list(k2) FROM k WHERE old) AS a2
  UNION ALL
  SELECT b.i, b.record_id, CASE WHEN list_contains(a1, k1) THEN 'collision:owner_trace' WHEN list_contains(a2, k2) THEN 'collision:group_tag' ELSE 'appended' END,
         CASE WHEN list_contains(a1, k1) OR list_contains(a2, k2) THEN a1 ELSE list_append(a1, k1) END,
         CASE WHEN list_contains(a1, k1) OR list_contains(a2, k2) THEN a2 ELSE list_append(a2, k2) END
  FROM s JOIN b ON b.i = s.i + 1)
SELECT record_id, result FROM s WHERE i > 0""",
)
def append_generation_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Row-level result of a batch append: which rows go in, which clash with the registry or with a row that went in."""
    rows = records(spark, folder).select(
        "record_id", "owner_user_id", F.concat("source_name", F.lit("-"), (F.col("n_chars") % 10).cast("string")).alias("trace_id"), F.col("owner_user_id").alias("source_group_id"),
        F.substring("original_file_md5", 1, 3).alias("auth_tag"),
    )
    old = F.col("record_id") % 5 == 4
    kept, rejected = sinks.split_collisions(rows.where(~old), rows.where(old))
    return kept.select("record_id", F.lit("appended").alias("result")).unionByName(rejected.select("record_id", F.col("reason").alias("result")))


@query(
    "upsert_features",
    """WITH r AS (SELECT vec_id // 5 AS source_group_id, CASE vec_id % 2 WHEN 0 THEN 'orb' ELSE 'superpoint' END AS feature_kind, vec_id AS feature_ref, label FROM embeddings),
            old AS (SELECT source_group_id, feature_kind, -max(feature_ref) AS feature_ref FROM r WHERE source_group_id % 3 <> 0 GROUP BY ALL),
            new AS (SELECT source_group_id, feature_kind, max(feature_ref) AS feature_ref FROM r WHERE source_group_id % 2 = 0 GROUP BY ALL)
       SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (source_group_id, feature_kind)""",
)
def upsert_features(spark: SparkSession, folder: str) -> DataFrame:
    """Groups not divisible by 3 are stored; even ones arrive again, so a third is replaced, kept and added each."""
    rows = table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 5).cast("bigint").alias("source_group_id"),
        F.when(F.col("vec_id") % 2 == 0, F.lit("orb")).otherwise(F.lit("superpoint")).alias("feature_kind"), F.col("vec_id").alias("feature_ref"),
    )
    stored = rows.where(F.col("source_group_id") % 3 != 0).groupBy("source_group_id", "feature_kind").agg((-F.max("feature_ref")).alias("feature_ref"))
    arriving = rows.where(F.col("source_group_id") % 2 == 0)
    return sinks.upsert_features(stored, arriving.withColumn("sequence", F.col("feature_ref") + 1))


@query("backfill_owners", "SELECT o_orderkey AS record_id, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE o_custkey END AS owner_user_id FROM orders")
def backfill_owners(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("owner_user_id")
    )
    return sinks.backfill_owners(rows, 1)[0].select("record_id", F.col("owner_user_id").cast("bigint").alias("owner_user_id"))


@query(
    "delete_records",
    "WITH " + RECORDS_SQL + ", " + SUSPECTS_SQL + """ SELECT r.record_id FROM records r
    WHERE NOT EXISTS (SELECT 1 FROM suspects s WHERE s.query_id = r.record_id AND (s.cross_owner OR s.user_id = r.owner_user_id))""",
)
def delete_records(spark: SparkSession, folder: str) -> DataFrame:
    wanted = suspects(spark, folder).withColumnRenamed("query_id", "record_id")
    return sinks.delete_records(records(spark, folder), wanted)[0].select("record_id")


# --- predicates ----------------------------------------------------------------------------------


@query("owner_scope", "SELECT o_orderkey AS record_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7")
def owner_scope(spark: SparkSession, folder: str) -> DataFrame:
    owners = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("owner_user_id"))
    rows = table(spark, folder, "orders").join(owners, "o_custkey")
    return filters.owner_scope(rows, 7).select(F.col("o_orderkey").alias("record_id"))


@query(
    "active_only",
    "WITH " + RECORDS_SQL + " SELECT record_id, status = 'active' AS found_by_lookup FROM records WHERE status <> 'deleted'",
)
def active_only(spark: SparkSession, folder: str) -> DataFrame:
    """Both status rules: listings keep all but deleted rows, lookups need active ones."""
    listed = filters.not_deleted(records(spark, folder))
    live = filters.active_only(records(spark, folder)).select("record_id", F.lit(True).alias("found_by_lookup"))
    return listed.select("record_id").join(live, "record_id", "left").fillna(False, ["found_by_lookup"])


@query("public_projection", "SELECT 'u' || c_custkey AS username, c_mktsegment AS role FROM customer")
def public_projection(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("username"), F.col("c_mktsegment").alias("role_key"), F.col("c_name").alias("password_hash")
    )
    return filters.public_users(users)


@query(
    "record_search",
    "WITH " + ORDERS_SQL + """ SELECT record_id FROM listing WHERE status = 'active' AND substr(created_at, 1, 7) >= '1995'
      AND contains(lower(o_orderpriority || ' ' || owner_user_id || ' ' || 'Trace-' || record_id || ' ' || status), 'high 1')""",
)
def record_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = order_records(spark, folder).select(
        "record_id", F.col("o_orderpriority").alias("name"), F.col("owner_user_id").alias("user_id"),
        F.concat(F.lit("Trace-"), F.col("record_id").cast("string")).alias("trace_id"), "status", "created_at",
    )
    return filters.record_search(rows, status="active", search="  HIGH 1 ").select("record_id")


@query(
    "v4_candidate_filter",
    """SELECT doc_id AS id FROM documents d WHERE doc_id % 5 = 4 AND regexp_full_match(substr(sha256(text), 1, 16), '[0-9a-f]{16}')
       AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def v4_candidate_filter(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("trace_id"),
        (F.col("doc_id") % 5).alias("robust_watermark_version"), F.lit(crypto.CODEC).alias("robust_watermark_codec"),
        F.substring(F.sha2(F.encode("text", "UTF-8"), 256), 1, 16).alias("robust_auth_code"),
    )
    features = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return filters.v4_candidate_filter(docs, features).select(F.col("id").cast("bigint").alias("id"))


@query(
    "layer_candidate_filter",
    """WITH l AS (SELECT doc_id, source <> 'src1' AS robust, doc_id % 6 AS version, lang = 'en' AS enabled FROM documents)
       SELECT layer, count(*) AS n, sum(doc_id) AS ids FROM (
         SELECT 'robust' AS layer, doc_id FROM l WHERE robust
         UNION ALL SELECT 'legacy_robust', doc_id FROM l WHERE robust AND version NOT IN (2, 3, 4)
         UNION ALL SELECT 'dot_matrix', doc_id FROM l WHERE enabled AND version = 1
         UNION ALL SELECT 'code', doc_id FROM l WHERE robust AND version = 4
         UNION ALL SELECT 'small_crop', doc_id FROM l WHERE robust AND version = 4 AND enabled) GROUP BY layer""",
)
def layer_candidate_filter(spark: SparkSession, folder: str) -> DataFrame:
    version = (F.col("doc_id") % 6).cast("int")
    rows = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("trace_id"), (F.col("source") != "src1").alias("robust_watermark"),
        version.alias("robust_watermark_version"), version.alias("watermark_code_version"),
        (F.col("lang") == "en").alias("dot_matrix_trace_enabled"), version.alias("dot_matrix_trace_version"),
        (F.col("lang") == "en").alias("small_crop_trace_enabled"), F.lit(1).alias("small_crop_trace_version"),
    )
    parts = {layer: filters.layer_candidates(rows, layer) for layer in ("robust", "legacy_robust", "dot_matrix", "code", "small_crop")}
    return listing.union_evidence(parts).groupBy(F.col("kind").alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query(
    "fallback_route",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, w * h <= 3000000 OR (w * h <= 5000000 AND greatest(w, h) / greatest(1, least(w, h)) >= 2.2) AS run_frequency,
              w * h >= 40000 AS run_visual
       FROM (SELECT *, l_suppkey + 300 AS h, CAST(l_extendedprice / 20 AS BIGINT) + 1 AS w FROM lineitem)""",
)
def fallback_route(spark: SparkSession, folder: str) -> DataFrame:
    images = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.rint(F.col("l_extendedprice") / 20).cast("bigint") + 1).alias("width"), (F.col("l_suppkey") + 300).alias("height"),
    )
    routed = filters.fallback_routes(images, table(spark, folder, "documents"))
    return routed.drop("width", "height")


@query(
    "allowed_menus",
    """SELECT conv_id, list_filter(list(role ORDER BY turn), lambda r: r IN ('user', 'assistant')) AS menus FROM
       (SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY ALL) GROUP BY conv_id""",
)
def allowed_menus(spark: SparkSession, folder: str) -> DataFrame:
    """Menu lists (distinct roles of a conversation in order) cut to the known keys."""
    first = table(spark, folder, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))
    lists = first.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda m: m["role"]).alias("menus"))
    return lists.withColumn("menus", filters.allowed_menus(F.col("menus"), ["user", "assistant"]))


@query(
    "check_violations",
    """SELECT o_orderkey, 'known_status' AS "constraint" FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
       UNION ALL SELECT o_orderkey, 'price_limit' FROM orders WHERE NOT o_totalprice <= 450000
       UNION ALL SELECT o_orderkey, 'dated' FROM orders WHERE NOT o_orderdate >= TIMESTAMP '1995-02-01'""",
)
def check_violations(spark: SparkSession, folder: str) -> DataFrame:
    checks = {
        "known_status": F.col("o_orderstatus").isin("O", "F"), "price_limit": F.col("o_totalprice") <= 450000,
        "dated": F.col("o_orderdate") >= F.lit("1995-02-01").cast("timestamp"),
    }
    return filters.check_violations(table(spark, folder, "orders"), "o_orderkey", checks)


@query(
    "media_access",
    "WITH " + RECORDS_SQL + ", " + SUSPECTS_SQL + """ SELECT s.query_id FROM suspects s
       WHERE EXISTS (SELECT 1 FROM records r WHERE (r.original_file_md5 = s.md5 OR r.watermarked_file_md5 = s.md5) AND (s.cross_owner OR r.owner_user_id = s.user_id))""",
)
def media_access(spark: SparkSession, folder: str) -> DataFrame:
    named = records(spark, folder).select(
        "owner_user_id", F.col("original_file_md5").alias("original_url"), F.col("watermarked_file_md5").alias("download_url"),
        F.lit(None).cast("string").alias("thumbnail_url"),
    )
    asked = suspects(spark, folder).select("query_id", "user_id", F.col("cross_owner").alias("is_admin"), F.col("md5").alias("url"))
    return filters.media_access(asked, named).select("query_id")


# --- joins ---------------------------------------------------------------------------------------

_HITS_SQL = "WITH " + RECORDS_SQL + ", " + SUSPECTS_SQL + """,
files AS (SELECT record_id, owner_user_id, status, original_file_md5 AS md5, original_file_sha256 AS sha256 FROM records
          UNION ALL SELECT record_id, owner_user_id, status, watermarked_file_md5, watermarked_file_sha256 FROM records),
hits AS (SELECT DISTINCT s.query_id, f.record_id FROM suspects s JOIN files f USING (md5, sha256)
         WHERE f.status = 'active' AND (s.cross_owner OR f.owner_user_id = s.user_id))"""
_OUTCOME = """SELECT s.query_id, count(h.record_id) AS n_records,
  CASE count(h.record_id) WHEN 0 THEN '{0}' WHEN 1 THEN 'success' ELSE 'ambiguous' END AS outcome,
  CASE WHEN count(h.record_id) = 1 THEN max(h.record_id) END AS record_id
  FROM suspects s LEFT JOIN hits h USING (query_id) GROUP BY s.query_id"""


@query("exact_file_match", _HITS_SQL + _OUTCOME.format("continue"))
def exact_file_match(spark: SparkSession, folder: str) -> DataFrame:
    return matching.exact_file_match(suspects(spark, folder), records(spark, folder))


_TIER_SQL = "WITH " + RECORDS_SQL + """, files AS (
  SELECT record_id, position_index, 0 AS t, 'original' AS file_type, CASE WHEN source_name IN ('src1', 'src2', 'src3') THEN '' ELSE upper(original_file_md5) END AS md5,
         CASE WHEN source_name = 'src4' THEN '' ELSE upper(original_file_sha256) END AS sha256, upper(watermarked_file_sha256) AS pixel FROM records
  UNION ALL SELECT record_id, position_index, 1, 'watermarked', CASE WHEN source_name IN ('src1', 'src2', 'src3') THEN '' ELSE upper(watermarked_file_md5) END,
         CASE WHEN source_name = 'src4' THEN '' ELSE upper(watermarked_file_sha256) END, upper(watermarked_file_sha256) FROM records),
q AS (SELECT doc_id AS query_id, upper(md5(text)) AS md5, upper(sha256(text)) AS sha256, upper(sha256(lower(text))) AS pixel FROM documents),
h AS (
  SELECT q.query_id, 1 AS tier, f.position_index, f.t, f.record_id, f.file_type, 'file_md5_sha256' AS kind FROM q JOIN files f ON f.md5 = q.md5 AND f.sha256 = q.sha256 WHERE f.sha256 <> ''
  UNION ALL SELECT q.query_id, 1, f.position_index, f.t, f.record_id, f.file_type, 'file_sha256' FROM q JOIN files f ON f.sha256 = q.sha256 WHERE f.md5 = '' AND f.sha256 <> ''
  UNION ALL SELECT q.query_id, 2, f.position_index, f.t, f.record_id, f.file_type, 'image_pixels' FROM q JOIN files f ON f.pixel = q.pixel)
SELECT query_id, record_id, file_type AS matched_file_type, kind AS matched_hash_type FROM h
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, position_index, t) = 1"""


@query("tiered_fingerprint_match", _TIER_SQL)
def tiered_fingerprint_match(spark: SparkSession, folder: str) -> DataFrame:
    bare, none = F.col("source_name").isin("src1", "src2", "src3"), F.col("source_name") == "src4"
    stored = records(spark, folder)
    for kind in ("original", "watermarked"):
        stored = (
            stored.withColumn(f"{kind}_image_sha256", F.col("watermarked_file_sha256"))
            .withColumn(f"{kind}_md5_kept", F.when(~bare, F.col(f"{kind}_file_md5")))
            .withColumn(f"{kind}_sha_kept", F.when(~none, F.col(f"{kind}_file_sha256")))
        )
    for kind in ("original", "watermarked"):
        stored = stored.withColumn(f"{kind}_file_md5", F.col(f"{kind}_md5_kept")).withColumn(f"{kind}_file_sha256", F.col(f"{kind}_sha_kept"))
    pixel = F.sha2(F.encode(F.lower("text"), "UTF-8"), 256).alias("image_sha256")
    asked = suspects(spark, folder).join(table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), pixel), "query_id")
    return matching.tiered_fingerprint_match(asked, stored)


@query(
    "match_group_tag",
    "WITH " + RECORDS_SQL + ", " + SUSPECTS_SQL + """ SELECT s.query_id, r.record_id FROM suspects s JOIN records r
       ON r.source_name = 'src' || (s.query_id % 20) AND substr(r.original_file_md5, 1, 4) = substr(s.md5, 1, 4)
       WHERE r.status = 'active' AND (s.cross_owner OR s.user_id = r.owner_user_id)""",
)
def match_group_tag(spark: SparkSession, folder: str) -> DataFrame:
    stored = records(spark, folder).withColumn("source_group_id", F.col("source_name")).withColumn("auth_tag", F.substring("original_file_md5", 1, 4))
    asked = suspects(spark, folder).withColumn("source_group_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))).withColumn("auth_tag", F.substring("md5", 1, 4))
    return matching.match_group_tag(asked, stored).select("query_id", "record_id")


@query(
    "records_of_groups",
    "WITH " + VIEWS_SQL + """, recalled AS (SELECT vec_id AS query_id, vec_id // 7 AS source_group_id, label AS user_id, label = 3 AS cross_owner FROM embeddings)
       SELECT q.query_id, q.source_group_id, v.source_group_id * 5 + v.view_index AS record_id
       FROM recalled q JOIN views v USING (source_group_id) WHERE q.cross_owner OR q.user_id = v.owner_user_id""",
)
def records_of_groups(spark: SparkSession, folder: str) -> DataFrame:
    stored = views(spark, folder).select("source_group_id", "owner_user_id", (F.col("source_group_id") * 5 + F.col("view_index")).alias("record_id"), F.lit("active").alias("status"))
    recalled = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / 7).cast("bigint").alias("source_group_id"), F.col("label").alias("user_id"), (F.col("label") == 3).alias("cross_owner")
    )
    return matching.records_of_groups(recalled, stored)


@query(
    "features_of_groups",
    """WITH w AS (SELECT l_orderkey AS query_id, l_partkey AS source_group_id FROM lineitem UNION SELECT -1 - l_suppkey, l_partkey FROM lineitem),
         s AS (SELECT query_id, count(*) AS n FROM w GROUP BY 1)
       SELECT w.query_id, CAST(w.source_group_id AS VARCHAR) AS source_group_id, k AS feature_kind, CAST(NULL AS VARCHAR) AS error
       FROM w JOIN s USING (query_id) JOIN part ON p_partkey = source_group_id, (VALUES ('orb'), ('superpoint')) v(k) WHERE n <= 40
       UNION ALL SELECT query_id, NULL, NULL, 'too_many_groups' FROM s WHERE n > 40""",
)
def features_of_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Orders name a few groups; suppliers, as queries of their own, name more than the cap of 40."""
    lines = table(spark, folder, "lineitem")
    named = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("source_group_id")).unionByName(
        lines.select((-F.col("l_suppkey") - 1).alias("query_id"), F.col("l_partkey").alias("source_group_id"))
    )
    groups = table(spark, folder, "part").select(F.col("p_partkey").alias("source_group_id"), F.lit("active").alias("status"), F.lit(1).alias("owner_user_id"))
    features = groups.select("source_group_id", F.explode(F.array(F.lit("orb"), F.lit("superpoint"))).alias("feature_kind"))
    return matching.features_of_groups(named.withColumn("user_id", F.lit(0)).withColumn("cross_owner", F.lit(True)), groups, features)


@query(
    "record_enrichment",
    """SELECT o_orderkey AS id, 'f' || o_orderkey AS name,
         CASE WHEN p.p_retailprice IS NULL THEN '-' ELSE CAST(p.p_size AS VARCHAR) || ' B' END AS size,
         coalesce(nullif(trim(c.c_mktsegment), ''), CAST(o_custkey AS VARCHAR)) AS user_id, 'trace-' || o_orderkey AS trace_id,
         substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS evidence_uuid_head, right(md5(CAST(o_orderkey AS VARCHAR)), 8) AS evidence_uuid_tail
       FROM orders LEFT JOIN part p ON p.p_partkey = o_orderkey LEFT JOIN customer c ON c.c_custkey = o_custkey""",
)
def record_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("owner_user_id"), F.col("o_orderkey").alias("source_group_id"),
        F.col("o_orderkey").alias("output_media_id"), F.col("o_orderkey").alias("thumbnail_media_id"), F.concat(F.lit("f"), key).alias("original_filename"),
        F.concat(F.lit("trace-"), key).alias("trace_id"), F.md5(F.encode(key, "UTF-8")).alias("evidence_uuid"),
    )
    groups = rows.select("source_group_id", F.col("record_id").alias("original_media_id"))
    media = table(spark, folder, "part").select(F.col("p_partkey").alias("media_id"), F.col("p_size").cast("bigint").alias("byte_size"))
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("username"))
    return matching.record_enrichment(rows, groups, media, users).drop("original_byte_size", "thumbnail_byte_size")


@query(
    "tag_collision",
    "WITH " + RECORDS_SQL + """, b AS (SELECT doc_id AS request_id, source AS source_group_id, substr(md5(lower(text)), 1, 2) AS auth_tag FROM documents)
       SELECT request_id, EXISTS (SELECT 1 FROM records r WHERE r.status <> 'deleted' AND r.source_name = b.source_group_id AND substr(r.original_file_md5, 1, 2) = b.auth_tag) AS in_registry,
              count(*) OVER (PARTITION BY source_group_id, auth_tag) > 1 AS in_batch FROM b""",
)
def tag_collision(spark: SparkSession, folder: str) -> DataFrame:
    stored = records(spark, folder).withColumn("source_group_id", F.col("source_name")).withColumn("auth_tag", F.substring("original_file_md5", 1, 2))
    batch = records(spark, folder).select(F.col("record_id").alias("request_id"), F.col("source_name").alias("source_group_id"), F.substring("watermarked_file_md5", 1, 2).alias("auth_tag"))
    return matching.tag_collision(batch, stored).select("request_id", "in_registry", "in_batch")


@query(
    "find_or_create_groups",
    """WITH w AS (SELECT DISTINCT doc_id % 7 AS owner_user_id, sha256(text) AS sha FROM documents),
            e AS (SELECT DISTINCT doc_id % 7 AS owner_user_id, sha256(text) AS sha FROM documents WHERE lang = 'en')
       SELECT w.owner_user_id, w.sha AS original_image_sha256, e.sha IS NULL AS created FROM w LEFT JOIN e USING (owner_user_id, sha)""",
)
def find_or_create_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "lang", (F.col("doc_id") % 7).alias("owner_user_id"), crypto.file_sha256(F.encode("text", "UTF-8")).alias("original_image_sha256"),
        F.col("n_chars").alias("image_width"), F.lit(1).alias("image_height"),
    )
    known = docs.where(F.col("lang") == "en").drop("lang").distinct().withColumn("source_group_id", matching.group_id(F.col("owner_user_id"), F.col("original_image_sha256")))
    rows = matching.find_or_create_groups(docs, known)
    return rows.select("owner_user_id", F.lower(F.hex("original_image_sha256")).alias("original_image_sha256"), "created")


@query("duplicate_keys", "SELECT o_custkey, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return matching.duplicate_keys(rows, ["o_custkey", "day"])


@query(
    "orphan_rows",
    """SELECT l_orderkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O')""",
)
def orphan_rows(spark: SparkSession, folder: str) -> DataFrame:
    parent = table(spark, folder, "orders").where(F.col("o_orderstatus") == "O")
    return matching.orphan_rows(table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey"), ["l_orderkey"], parent, ["o_orderkey"])


def _registry_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Documents as source groups and records that break some of the declared rules."""
    docs = table(spark, folder, "documents")
    text = F.encode("text", "UTF-8")
    owner = (F.col("doc_id") % 7).cast("int")
    groups = docs.select(
        F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("source_group_id"), owner.alias("owner_user_id"), F.unhex(F.sha2(text, 256)).alias("original_image_sha256"),
        F.col("n_chars").cast("int").alias("image_width"), (F.col("n_chars") % 50).cast("int").alias("image_height"),
        F.when(F.col("lang") == "fr", F.lit("hidden")).otherwise(F.lit("active")).alias("status"),
    )
    md5, sha = F.unhex(F.md5(text)), F.unhex(F.sha2(text, 256))
    tag = F.substring(md5, F.lit(1), F.when(F.col("lang") == "es", F.lit(7)).otherwise(F.lit(8)))
    rows = docs.select(
        F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("record_id"), F.concat(F.lit("g"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string")).alias("source_group_id"),
        owner.alias("owner_user_id"), F.concat("source", F.lit("-"), (F.col("n_chars") % 100).cast("string")).alias("trace_id"), tag.alias("auth_tag"), F.lit("active").alias("status"),
        md5.alias("original_file_md5"), md5.alias("watermarked_file_md5"), sha.alias("original_file_sha256"), sha.alias("watermarked_file_sha256"), sha.alias("original_pixel_sha256"), sha.alias("watermarked_pixel_sha256"),
    )
    return {"source_groups": groups, "v4_records": rows}


@query(
    "constraint_gate",
    """WITH u AS (SELECT c_custkey AS user_id, c_custkey % 1000 AS name, c_nationkey FROM customer),
       m AS (SELECT o_orderkey AS id, o_custkey % 400 AS owner, o_orderkey // 2 AS storage, o_orderpriority AS p, o_orderstatus AS s FROM orders),
       j AS (SELECT event_id AS id, user_id AS owner, event_type AS s, value FROM events),
       c AS (SELECT l_suppkey AS owner, l_linenumber AS k, sum(l_quantity) - 1200 AS v FROM lineitem GROUP BY ALL)
       SELECT 'users' AS "table", 'check' AS kind, 'known_role' AS rule, CAST(user_id AS VARCHAR) AS row_key FROM u WHERE c_nationkey = 7
       UNION ALL SELECT 'users', 'unique', 'username', 'user' || name FROM u GROUP BY name HAVING count(*) > 1
       UNION ALL SELECT 'media_objects', 'check', 'known_variant', 'm' || id FROM m WHERE p LIKE '4%'
       UNION ALL SELECT 'media_objects', 'check', 'known_status', 'm' || id FROM m WHERE s = 'P'
       UNION ALL SELECT 'media_objects', 'unique', 'storage_key', 'k' || storage FROM m GROUP BY storage HAVING count(*) > 1
       UNION ALL SELECT 'media_objects', 'foreign', 'owner', 'm' || id FROM m WHERE owner NOT IN (SELECT user_id FROM u)
       UNION ALL SELECT 'deep_forensics_jobs', 'check', 'progress', 'j' || id FROM j WHERE floor(value) NOT BETWEEN 0 AND 100
       UNION ALL SELECT 'deep_forensics_jobs', 'check', 'known_status', 'j' || id FROM j WHERE s = 'view'
       UNION ALL SELECT 'deep_forensics_jobs', 'foreign', 'owner', 'j' || id FROM j WHERE owner NOT IN (SELECT user_id FROM u)
       UNION ALL SELECT 'deep_forensics_jobs', 'foreign', 'input_media', 'j' || id FROM j WHERE id NOT IN (SELECT id FROM m)
       UNION ALL SELECT 'auth_sessions', 'check', 'token_hash_length', upper(md5('t' || id)) FROM j WHERE s = 'error'
       UNION ALL SELECT 'auth_sessions', 'check', 'idle_before_absolute', upper(CASE s WHEN 'error' THEN md5('t' || id) ELSE sha256('t' || id) END) FROM j WHERE s = 'click'
       UNION ALL SELECT 'auth_sessions', 'foreign', 'user', upper(CASE s WHEN 'error' THEN md5('t' || id) ELSE sha256('t' || id) END) FROM j WHERE owner NOT IN (SELECT user_id FROM u)
       UNION ALL SELECT 'v4_counters', 'check', 'counter_value', 'c' || k FROM c WHERE v < 0
       UNION ALL SELECT 'v4_counters', 'foreign', 'owner', 'c' || k FROM c WHERE owner NOT IN (SELECT user_id FROM u)
       UNION ALL SELECT 'rate_limit_buckets', 'check', 'request_count', upper(sha256('b' || l_suppkey || ':' || l_linenumber)) FROM lineitem GROUP BY l_suppkey, l_linenumber HAVING sum(l_quantity) < 1200
       UNION ALL SELECT 'source_group_embeddings', 'unique', 'group_view', 'g' || label || '|' || v FROM (SELECT label, vec_id % 20 AS v FROM embeddings) GROUP BY label, v HAVING count(*) > 1
       UNION ALL SELECT 'source_group_features', 'check', 'known_kind', 'g' || p_partkey FROM part WHERE p_size = 9
       UNION ALL SELECT 'source_group_features', 'check', 'sha256_length', 'g' || p_partkey FROM part WHERE p_size = 10
       UNION ALL SELECT 'audit_events', 'unique', 'primary', 'a' || id // 3 FROM j GROUP BY id // 3 HAVING count(*) > 1
       UNION ALL SELECT 'keypoints', 'check', 'keypoint_index', conv_id::VARCHAR FROM conversations WHERE turn - 1 < 0
       UNION ALL SELECT 'keypoints', 'unique', 'primary', conv_id || '|' || (turn - 1) FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1""",
)
def constraint_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The other nine registry tables, filled from the driver tables so that some rows break their rules."""
    text = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    users = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("int").alias("user_id"), F.concat(F.lit("user"), (F.col("c_custkey") % 1000).cast("string")).alias("username"), F.when(F.col("c_nationkey") == 7, F.lit("guest")).otherwise(F.lit("user")).alias("role_key")
    )
    media = table(spark, folder, "orders").select(
        text("m", "o_orderkey").alias("media_id"), (F.col("o_custkey") % 400).cast("int").alias("owner_user_id"), F.when(F.col("o_orderpriority").startswith("4"), F.lit("preview")).otherwise(F.lit("original")).alias("variant"),
        F.concat(F.lit("k"), F.floor(F.col("o_orderkey") / 2).cast("string")).alias("storage_key"), F.lit(1).alias("byte_size"), F.unhex(F.sha2(F.lit("x"), 256)).alias("sha256"), F.when(F.col("o_orderstatus") == "P", F.lit("lost")).otherwise(F.lit("active")).alias("status"),
    )
    events = table(spark, folder, "events")
    jobs = events.select(
        text("j", "event_id").alias("job_id"), F.col("user_id").alias("owner_user_id"), F.lit(None).cast("int").alias("requested_owner_user_id"), text("m", "event_id").alias("input_media_id"),
        F.floor("value").alias("progress"), F.when(F.col("event_type") == "view", F.lit("lost")).otherwise(F.lit("queued")).alias("status"),
    )
    token = F.encode(text("t", "event_id"), "UTF-8")
    late = F.timestamp_seconds(F.when(F.col("event_type") == "click", F.lit(9)).otherwise(F.lit(1)))
    logins = events.select(
        F.unhex(F.when(F.col("event_type") == "error", F.md5(token)).otherwise(F.sha2(token, 256))).alias("token_hash"), "user_id", late.alias("idle_expires_at"), F.timestamp_seconds(F.lit(5)).alias("absolute_expires_at")
    )
    sums = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_linenumber").agg((F.sum("l_quantity") - 1200).alias("v"))
    counters = sums.select(F.col("l_suppkey").cast("int").alias("owner_user_id"), text("c", "l_linenumber").alias("counter_key"), F.col("v").alias("counter_value"))
    buckets = sums.select(F.unhex(F.sha2(F.concat(F.lit("b"), F.concat_ws(":", "l_suppkey", "l_linenumber")), 256)).alias("bucket_key"), F.col("v").alias("request_count"))
    views = table(spark, folder, "embeddings").select(text("g", "label").alias("source_group_id"), (F.col("vec_id") % 20).alias("view_index"), F.lit(1).alias("owner_user_id"))
    features = table(spark, folder, "part").select(
        text("g", "p_partkey").alias("source_group_id"), F.when(F.col("p_size") == 9, F.lit("sift")).otherwise(F.lit("orb")).alias("feature_kind"), F.when(F.col("p_size") == 10, F.unhex(F.lit("00"))).otherwise(F.unhex(F.sha2(F.lit("f"), 256))).alias("feature_sha256")
    )
    audit = events.select(F.concat(F.lit("a"), F.floor(F.col("event_id") / 3).cast("string")).alias("event_id"))
    points = table(spark, folder, "conversations").select(F.col("conv_id").cast("string").alias("owner_id"), (F.col("turn") - 1).alias("kp_idx"))
    return matching.constraint_violations(
        {"users": users, "media_objects": media, "deep_forensics_jobs": jobs, "auth_sessions": logins, "v4_counters": counters, "rate_limit_buckets": buckets, "source_group_embeddings": views, "source_group_features": features, "audit_events": audit, "keypoints": points}
    )


@query(
    "constraint_violations",
    """WITH d AS (SELECT *, doc_id % 7 AS owner, doc_id - doc_id % 2 AS g, source || '-' || n_chars % 100 AS trace, substr(upper(md5(text)), 1, CASE lang WHEN 'es' THEN 14 ELSE 16 END) AS tag FROM documents)
       SELECT 'source_groups' AS "table", 'check' AS kind, 'positive_dimensions' AS rule, 'g' || doc_id AS row_key FROM d WHERE n_chars % 50 = 0
       UNION ALL SELECT 'source_groups', 'check', 'known_status', 'g' || doc_id FROM d WHERE lang = 'fr'
       UNION ALL SELECT 'source_groups', 'unique', 'owner_sha256', owner || '|' || upper(sha256(text)) FROM d GROUP BY owner, sha256(text) HAVING count(*) > 1
       UNION ALL SELECT 'v4_records', 'check', 'auth_tag_length', 'r' || doc_id FROM d WHERE lang = 'es'
       UNION ALL SELECT 'v4_records', 'unique', 'owner_trace', owner || '|' || trace FROM d GROUP BY owner, trace HAVING count(*) > 1
       UNION ALL SELECT 'v4_records', 'unique', 'group_tag', 'g' || g || '|' || tag FROM d GROUP BY g, tag HAVING count(*) > 1
       UNION ALL SELECT 'v4_records', 'foreign', 'group_owner', 'r' || doc_id FROM d WHERE NOT EXISTS (SELECT 1 FROM d p WHERE p.doc_id = d.g AND p.owner = d.owner)""",
)
def constraint_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Everything in a registry made of the documents that breaks the declared rules, by kind."""
    return matching.constraint_violations(_registry_tables(spark, folder))


_BOX_SQL = """boxes AS (SELECT l_orderkey AS image_id, 1920 AS image_width, 1080 AS image_height, l_partkey % 1800 AS "left", l_suppkey * 9 AS top,
   l_partkey % 1800 + CAST(l_quantity * 8 AS BIGINT) AS "right", l_suppkey * 9 + CAST(l_quantity * 6 AS BIGINT) AS bottom FROM lineitem)"""


def boxes(spark: SparkSession, folder: str, box_id: Column | None = None) -> DataFrame:
    left, top = F.col("l_partkey") % 1800, F.col("l_suppkey") * 9
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.lit(1920).alias("image_width"), F.lit(1080).alias("image_height"), left.alias("left"), top.alias("top"),
        (left + (F.col("l_quantity") * 8).cast("bigint")).alias("right"), (top + (F.col("l_quantity") * 6).cast("bigint")).alias("bottom"),
        F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").alias("confidence"),
        (F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice") if box_id is None else box_id).alias("box_id"),
    )


@query(
    "region_tiles",
    "WITH " + _BOX_SQL + """, t AS (SELECT image_id, greatest(0, "left" // 128) AS x0, least(image_width // 128 - 1, ("right" - 1) // 128) AS x1,
        greatest(0, top // 128) AS y0, least(image_height // 128 - 1, (bottom - 1) // 128) AS y1 FROM boxes)
      SELECT DISTINCT image_id, CAST(x AS INTEGER) AS tile_x, CAST(y AS INTEGER) AS tile_y FROM
        (SELECT image_id, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM t WHERE x0 <= x1 AND y0 <= y1), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y)""",
)
def region_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return matching.region_tiles(boxes(spark, folder))


@query(
    "role_menus",
    """WITH f AS (SELECT conv_id, role, min(turn) AS turn FROM conversations WHERE role <> 'system' GROUP BY ALL)
       SELECT c.conv_id AS role_key, coalesce(list(f.role ORDER BY f.turn) FILTER (f.role IS NOT NULL), []) AS menus
       FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f USING (conv_id) GROUP BY 1""",
)
def role_menus(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    links = turns.select(F.col("conv_id").alias("role_key"), F.col("role").alias("menu_key"), F.col("turn").alias("position_index"))
    known = spark.createDataFrame([("user",), ("assistant",)], "menu_key string")
    return matching.role_menus(links.select("role_key").distinct(), links, known)


@query(
    "snapshot_diff",
    """SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
         CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS change
       FROM (SELECT o_orderkey, o_totalprice AS p FROM orders WHERE o_orderstatus <> 'P') a
       FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE o_totalprice END AS p FROM orders WHERE o_orderstatus <> 'F') b USING (o_orderkey)
       WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.p IS DISTINCT FROM b.p""",
)
def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    before = orders.where(F.col("o_orderstatus") != "P").select("o_orderkey", F.col("o_totalprice").alias("p"))
    price = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(0.0)).otherwise(F.col("o_totalprice"))
    after = orders.where(F.col("o_orderstatus") != "F").select("o_orderkey", price.alias("p"))
    return matching.snapshot_diff(before, after, ["o_orderkey"])


@query(
    "checksum_verify",
    """SELECT coalesce(m.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'unexpected' ELSE 'mismatch' END AS problem
       FROM (SELECT 'd' || doc_id AS path, sha256(text) AS s FROM documents WHERE lang <> 'de') m
       FULL JOIN (SELECT 'd' || doc_id AS path, sha256(CASE lang WHEN 'es' THEN upper(text) ELSE text END) AS s FROM documents WHERE lang <> 'fr') f ON m.path = f.path
       WHERE m.path IS NULL OR f.path IS NULL OR m.s <> f.s""",
)
def checksum_verify(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    wanted = docs.where(F.col("lang") != "de").select("path", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    body = F.when(F.col("lang") == "es", F.upper("text")).otherwise(F.col("text"))
    found = docs.where(F.col("lang") != "fr").select("path", F.sha2(F.encode(body, "UTF-8"), 256).alias("sha256"))
    return matching.checksum_verify(wanted, found)


@query(
    "packet_lookup",
    """WITH r AS (SELECT source AS trace_id, min(doc_id) AS record_id FROM documents WHERE lang = 'es' GROUP BY 1)
       SELECT doc_id AS query_id, d.source AS trace_id, r.record_id, CASE WHEN r.record_id IS NULL THEN 92 ELSE 98 END AS confidence,
              coalesce(CASE WHEN lang = 'en' THEN 'own' END, 'e' || r.record_id, CASE WHEN lang = 'en' THEN 'own' END) AS evidence_uuid
       FROM documents d LEFT JOIN r ON r.trace_id = d.source""",
)
def packet_lookup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    packets = docs.select(F.col("doc_id").alias("query_id"), F.col("source").alias("trace_id"), F.when(F.col("lang") == "en", F.lit("own")).alias("evidence_uuid"))
    stored = docs.where(F.col("lang") == "es").select(
        F.col("doc_id").alias("record_id"), F.col("doc_id").alias("position_index"), F.col("source").alias("trace_id"),
        F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("evidence_uuid"),
    )
    return matching.packet_lookup(packets, stored)


# --- listings ------------------------------------------------------------------------------------


@query("list_records", "WITH " + ORDERS_SQL + " SELECT record_id, created_at FROM listing WHERE status <> 'deleted' ORDER BY created_at DESC, record_id")
def list_records(spark: SparkSession, folder: str) -> DataFrame:
    return listing.list_records(order_records(spark, folder)).select("record_id", "created_at")


@query(
    "sort_modes",
    "WITH " + ORDERS_SQL + """ SELECT record_id, coalesce(nullif(CASE WHEN raw_status = 'P' THEN 0 ELSE o_totalprice END, 0), owner_user_id, 0) AS shown FROM listing
       ORDER BY shown DESC, record_id""",
)
def sort_modes(spark: SparkSession, folder: str) -> DataFrame:
    rows = order_records(spark, folder).withColumn("confidence", F.when(F.col("raw_status") == "P", F.lit(0.0)).otherwise(F.col("o_totalprice"))).withColumn("conf", F.col("owner_user_id").cast("double"))
    return listing.sorted_listing(rows, "confidence_desc").select("record_id", listing.shown_confidence().alias("shown"))


@query(
    "page",
    "WITH " + ORDERS_SQL + """, r AS (SELECT record_id, row_number() OVER (ORDER BY created_at DESC, record_id) AS row_no, count(*) OVER () AS n FROM listing)
       SELECT record_id, row_no, 37 AS page, CAST(ceil(n / 10) AS BIGINT) AS total_pages FROM r WHERE row_no BETWEEN 361 AND 370""",
)
def page(spark: SparkSession, folder: str) -> DataFrame:
    rows = listing.page(order_records(spark, folder).select("record_id", "created_at"), [F.col("created_at").desc(), F.col("record_id")], 37)
    return rows.select("record_id", "row_no", "page", "total_pages")


@query(
    "position_index",
    "WITH " + ORDERS_SQL + " SELECT record_id, row_number() OVER (ORDER BY created_at DESC, record_id) - 1 AS position_index FROM listing",
)
def position_index(spark: SparkSession, folder: str) -> DataFrame:
    return listing.position_index(order_records(spark, folder).select("record_id", "created_at")).select("record_id", "position_index")


@query("keep_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def keep_latest(spark: SparkSession, folder: str) -> DataFrame:
    return listing.keep_latest(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("caps", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def caps(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders")
    return listing.cap_rows(rows, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], "verified_candidates").select("o_custkey", "o_orderkey")


@query(
    "claimable_jobs",
    """SELECT o_orderkey AS job_id FROM orders WHERE o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1998-06-01'
         AND (o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderdate + INTERVAL 5 DAY < TIMESTAMP '1998-06-01'))""",
)
def claimable_jobs(spark: SparkSession, folder: str) -> DataFrame:
    day = lambda n: F.col("o_orderdate") + F.make_interval(days=F.lit(n))
    state = F.when(F.col("o_orderstatus") == "O", F.lit("queued")).when(F.col("o_orderstatus") == "P", F.lit("running")).otherwise(F.lit("completed"))
    jobs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), state.alias("status"), day(30).alias("deadline_at"), day(5).alias("lease_expires_at")
    )
    return listing.claimable_jobs(jobs, F.lit("1998-06-01").cast(dict(jobs.dtypes)["created_at"])).select("job_id")


@query(
    "dashboard",
    """SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS total,
              (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate::DATE = DATE '1998-06-01') AS today,
              CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS detected,
              (SELECT count(*) FROM lineitem WHERE l_shipdate::DATE = DATE '1998-06-01') AS detected_today,
              (SELECT round(100.0 * count(*) FILTER (l_discount > 0.03) / count(*), 2) FROM lineitem) AS success_rate""",
)
def dashboard(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") == "F", F.lit("deleted")).otherwise(F.lit("active")).alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("owner_user_id")
    )
    lines = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("owner_user_id"), "l_shipdate", "l_discount")
    total = lines.select("owner_user_id", F.lit("detection_total").alias("counter_key"), F.lit(1).alias("delta"), "l_shipdate")
    won = lines.where(F.col("l_discount") > 0.03).select("owner_user_id", F.lit("detection_success").alias("counter_key"), F.lit(1).alias("delta"), "l_shipdate")
    counters = listing.counters(listing.with_daily_keys(total.unionByName(won), "l_shipdate"))
    return listing.dashboard(rows, counters, "1998-06-01")


@query(
    "image_status_counts",
    """SELECT (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS protected,
         (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS leaks, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS hits,
         (SELECT count(*) FROM events) AS detection_attempts, (SELECT count(*) FROM events WHERE event_type <> 'error') AS detection_successes,
         (SELECT round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 1) FROM events) AS detection_success_rate""",
)
def image_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    names = F.create_map(F.lit("O"), F.lit(listing.PROTECTED), F.lit("F"), F.lit(listing.LEAK), F.lit("P"), F.lit(listing.HIT))
    rows = table(spark, folder, "orders").select(F.element_at(names, F.col("o_orderstatus")).alias("status"))
    attempts = table(spark, folder, "events").select(F.lit(1).alias("attempts"), (F.col("event_type") != "error").cast("int").alias("successes"))
    return listing.image_status_counts(rows, attempts)


@query(
    "counters",
    "SELECT l_suppkey AS owner_user_id, l_returnflag AS counter_key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS counter_value FROM lineitem WHERE CAST(l_quantity AS BIGINT) > 0 GROUP BY ALL",
)
def counters(spark: SparkSession, folder: str) -> DataFrame:
    deltas = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("owner_user_id"), F.col("l_returnflag").alias("counter_key"), F.col("l_quantity").cast("bigint").alias("delta"))
    return listing.counters(deltas)


@query(
    "daily_counts",
    """WITH c AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)
       SELECT coalesce(c.day, s.day) AS day, coalesce(s.n, c.n) AS n FROM c FULL JOIN s USING (day)""",
)
def daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return listing.daily_counts(table(spark, folder, "orders"), stored, "o_orderdate")


# --- sets ----------------------------------------------------------------------------------------


@query(
    "union_evidence",
    """SELECT kind, count(*) AS n, sum(query_id) AS ids FROM (
         SELECT 'exact' AS kind, d.doc_id AS query_id FROM documents d JOIN (SELECT DISTINCT sha256(text) AS s FROM documents WHERE lang = 'en') e ON e.s = sha256(d.text)
         UNION ALL SELECT 'labelled', doc_id FROM labels UNION ALL SELECT 'item', item_id FROM benchmark) GROUP BY kind""",
)
def union_evidence(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), "lang", F.sha2(F.encode("text", "UTF-8"), 256).alias("s"))
    english = docs.where(F.col("lang") == "en").select("s").distinct()
    parts = {
        "exact": docs.join(english, "s", "left_semi").select("query_id"),
        "labelled": table(spark, folder, "labels").select(F.col("doc_id").alias("query_id"), "quality"),
        "item": table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id")),
    }
    return listing.union_evidence(parts).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("query_id").alias("ids"))


@query("unique_records", "SELECT DISTINCT l_orderkey AS query_id, l_suppkey AS record_id FROM lineitem")
def unique_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("record_id"))
    return listing.unique_records(rows)


@query(
    "split_overlap",
    """SELECT s AS sha256, count(*) AS uses, count(DISTINCT split) AS splits FROM (
         SELECT sha256(text) AS s, lang AS split FROM documents UNION ALL SELECT sha256(text), 'benchmark' FROM benchmark) GROUP BY s HAVING count(*) > 1""",
)
def split_overlap(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")
    docs = table(spark, folder, "documents").select(digest, F.col("lang").alias("split"))
    return listing.split_overlap(docs.unionByName(table(spark, folder, "benchmark").select(digest, F.lit("benchmark").alias("split"))))


@query("required_coverage", "SELECT DISTINCT c_custkey AS name FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def required_coverage(spark: SparkSession, folder: str) -> DataFrame:
    required = table(spark, folder, "customer").select(F.col("c_custkey").alias("name"))
    return listing.required_coverage(required, table(spark, folder, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("name")))


@query(
    "case_matrix",
    """SELECT p_partkey AS source, CAST(scale_factor AS DOUBLE) AS scale_factor, CAST(crop_ratio AS DOUBLE) AS crop_ratio, crop_index, case_type FROM part, (VALUES (0.5), (1.0), (2.0)) a(scale_factor), (VALUES (0.3), (1.0)) b(crop_ratio),
       (VALUES (0), (1), (2)) c(crop_index), (VALUES ('watermarked'), ('unwatermarked')) d(case_type)""",
)
def case_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return listing.case_matrix(table(spark, folder, "part").select(F.col("p_partkey").alias("source")), [0.5, 1.0, 2.0], [0.3, 1.0], 3)


@query(
    "keep_first_distinct",
    """SELECT doc_id, len(words) AS n_words, array_to_string(words, ' ') AS words FROM (
         SELECT doc_id, list_sort(list_distinct(string_split(text, ' '))) AS words FROM documents)""",
)
def keep_first_distinct(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array_sort(listing.keep_first_distinct(F.split("text", " ")))
    return table(spark, folder, "documents").select("doc_id", F.size(words).cast("bigint").alias("n_words"), F.array_join(words, " ").alias("words"))


@query("reconcile_selection", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def reconcile_selection(spark: SparkSession, folder: str) -> DataFrame:
    kept = table(spark, folder, "orders").where(F.col("o_orderstatus") != "F").select(F.col("o_orderkey").alias("id"))
    return listing.reconcile_selection(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id")), kept)


@query("unique_outcome", _HITS_SQL + _OUTCOME.format("not_found"))
def unique_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """Authenticated hits of each suspect reduced to success, ambiguous or not found."""
    asked = suspects(spark, folder).distinct()
    scope = F.col("cross_owner") | (F.col("user_id") == F.col("owner_user_id"))
    files = matching.file_digests(filters.active_only(records(spark, folder))).where(F.col("record_id").isNotNull())
    files = files.select("record_id", "owner_user_id", "md5", "sha256").distinct()
    # A record has one owner, so the records of a digest by owner are sets that share none: one row with their number, however many.
    sets = files.groupBy("owner_user_id", "md5", "sha256").agg(F.count(F.lit(1)).alias("n_records"), F.min("record_id").alias("record_id"))
    digests = asked.groupBy("query_id").agg(F.countDistinct("md5", "sha256").alias("digests"))
    asked_by = asked.join(digests, "query_id")
    whole = asked_by.where(F.col("digests") == 1).join(sets, ["md5", "sha256"]).where(scope).select("query_id", "owner_user_id", "record_id", "n_records").distinct()
    # Sets of several digests may share a record: an id that comes with several texts has its records one by one.
    each = asked_by.where(F.col("digests") > 1).join(files, ["md5", "sha256"]).where(scope).select("query_id", "record_id").distinct()
    hits = whole.drop("owner_user_id").unionByName(each.withColumn("n_records", F.lit(1).cast("bigint")))
    return evidence.unique_outcome(hits, asked)


@query(
    "same_source_versions",
    "SELECT source AS source_group_id, count(*) AS versions, count(*) >= 1000 AS meets_scale_gate FROM documents GROUP BY 1",
)
def same_source_versions(spark: SparkSession, folder: str) -> DataFrame:
    from provena.operators import summaries

    return summaries.same_source_versions(table(spark, folder, "documents").select(F.col("source").alias("source_group_id")))


@query(
    "first_hit_precedence",
    """WITH e AS (SELECT doc_id AS query_id, doc_id AS record_id, 2 AS priority, 90 AS confidence, 'label' AS evidence FROM labels WHERE quality = 1
         UNION ALL SELECT doc_id, doc_id + 1, 1, 95, 'lang' FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, doc_id + 2, 0, 99, 'source' FROM documents WHERE source = 'src1')
       SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY priority, confidence DESC, record_id) = 1""",
)
def first_hit_precedence(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")

    def rows(frame: DataFrame, shift: int, place: int, confidence: int, name: str) -> DataFrame:
        return frame.select(F.col("doc_id").alias("query_id"), (F.col("doc_id") + shift).alias("record_id"), F.lit(place).alias("priority"), F.lit(confidence).alias("confidence"), F.lit(name).alias("evidence"))

    found = rows(table(spark, folder, "labels").where(F.col("quality") == 1), 0, 2, 90, "label")
    found = found.unionByName(rows(docs.where(F.col("lang") == "en"), 1, 1, 95, "lang")).unionByName(rows(docs.where(F.col("source") == "src1"), 2, 0, 99, "source"))
    return evidence.first_hit_precedence(found)
