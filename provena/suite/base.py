"""Registry of queries, and the driver tables seen as registry tables (Spark and SQL forms)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from provena.functions import bits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under the operator's name; without SQL it is a rows-only check."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Documents as image records: the text is the file, the lower-cased text its watermarked copy and
# the language its status (de = deleted, fr = disabled). Suspects are all documents again.
RECORDS_SQL = """records AS (
  SELECT doc_id AS record_id, doc_id AS position_index, doc_id % 7 AS owner_user_id,
         CASE lang WHEN 'de' THEN 'deleted' WHEN 'fr' THEN 'disabled' ELSE 'active' END AS status,
         'trace-' || doc_id AS trace_id, source AS source_name, n_chars,
         md5(text) AS original_file_md5, sha256(text) AS original_file_sha256,
         md5(lower(text)) AS watermarked_file_md5, sha256(lower(text)) AS watermarked_file_sha256
  FROM documents)"""
SUSPECTS_SQL = """suspects AS (
  SELECT doc_id AS query_id, (doc_id * 3) % 7 AS user_id, lang = 'es' AS cross_owner,
         md5(text) AS md5, sha256(text) AS sha256
  FROM documents)"""


def records(spark: SparkSession, folder: str) -> DataFrame:
    text = F.encode("text", "UTF-8")
    copy = F.encode(F.lower("text"), "UTF-8")
    status = F.when(F.col("lang") == "de", F.lit("deleted")).when(F.col("lang") == "fr", F.lit("disabled")).otherwise(F.lit("active"))
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("record_id"), F.col("doc_id").alias("position_index"), (F.col("doc_id") % 7).alias("owner_user_id"),
        status.alias("status"), F.concat(F.lit("trace-"), F.col("doc_id").cast("string")).alias("trace_id"),
        F.col("source").alias("source_name"), "n_chars",
        F.md5(text).alias("original_file_md5"), F.sha2(text, 256).alias("original_file_sha256"),
        F.md5(copy).alias("watermarked_file_md5"), F.sha2(copy, 256).alias("watermarked_file_sha256"),
    )


def suspects(spark: SparkSession, folder: str) -> DataFrame:
    text = F.encode("text", "UTF-8")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("query_id"), (F.col("doc_id") * 3 % 7).alias("user_id"), (F.col("lang") == "es").alias("cross_owner"),
        F.md5(text).alias("md5"), F.sha2(text, 256).alias("sha256"),
    )


# Embeddings as views: five views a source group, the label as owner; every vector is also a
# query view, four views a query.
VIEWS_SQL = """views AS (
  SELECT vec_id // 5 AS source_group_id, CAST(vec_id % 5 AS INTEGER) AS view_index, label AS owner_user_id, embedding
  FROM embeddings)"""
QUERY_VIEWS_SQL = """query_views AS (
  SELECT vec_id // 4 AS query_id, CAST(vec_id % 4 AS INTEGER) AS query_view, (vec_id // 4) % 10 AS user_id,
         (vec_id // 4) % 10 = 3 AS cross_owner, embedding
  FROM embeddings)"""


def _div(column: str, by: int) -> Column:
    return F.floor(F.col(column) / by).cast("bigint")


def views(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        _div("vec_id", 5).alias("source_group_id"), (F.col("vec_id") % 5).cast("int").alias("view_index"),
        F.col("label").alias("owner_user_id"), "embedding",
    )


def query_views(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        _div("vec_id", 4).alias("query_id"), (F.col("vec_id") % 4).cast("int").alias("query_view"),
        (_div("vec_id", 4) % 10).alias("user_id"), (_div("vec_id", 4) % 10 == 3).alias("cross_owner"), "embedding",
    )


# Line items as benchmark cases.
CASES_SQL = """cases AS (
  SELECT l_linenumber AS round, l_returnflag AS attack,
         CASE l_linestatus WHEN 'O' THEN 'watermarked' ELSE 'unwatermarked' END AS case_type,
         l_discount > 0.03 AS success, l_discount > 0.03 AND l_tax < 0.07 AS correct_trace,
         l_extendedprice AS detection_ms, l_quantity AS scale_factor, l_tax AS crop_ratio,
         CASE l_returnflag WHEN 'A' THEN 'synthetic_noise' ELSE l_returnflag END AS category
  FROM lineitem)"""


def cases(spark: SparkSession, folder: str) -> DataFrame:
    found = F.col("l_discount") > 0.03
    return table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("round"), F.col("l_returnflag").alias("attack"),
        F.when(F.col("l_linestatus") == "O", F.lit("watermarked")).otherwise(F.lit("unwatermarked")).alias("case_type"),
        found.alias("success"), (found & (F.col("l_tax") < 0.07)).alias("correct_trace"),
        F.col("l_extendedprice").alias("detection_ms"), F.col("l_quantity").alias("scale_factor"), F.col("l_tax").alias("crop_ratio"),
        F.when(F.col("l_returnflag") == "A", F.lit("synthetic_noise")).otherwise(F.col("l_returnflag")).alias("category"),
    )


# Embeddings as tiles: 64 values are 64 scores, 16 tiles an image.
TILES_SQL = """tiles AS (
  SELECT vec_id, vec_id // 16 AS image_id, CAST(vec_id % 4 AS INTEGER) AS tile_x, CAST((vec_id // 4) % 4 AS INTEGER) AS tile_y,
         CAST((vec_id % 4 + 2 * ((vec_id // 4) % 4)) % 4 AS INTEGER) AS phase,
         CAST((vec_id % 4 + 2 * ((vec_id // 4) % 4)) % 3 AS INTEGER) AS phase3,
         0.6 + label / 20.0 AS coverage, embedding AS scores
  FROM embeddings)"""


def tiles(spark: SparkSession, folder: str) -> DataFrame:
    x, y = (F.col("vec_id") % 4).cast("int"), (_div("vec_id", 4) % 4).cast("int")
    return table(spark, folder, "embeddings").select(
        "vec_id", _div("vec_id", 16).alias("image_id"), x.alias("tile_x"), y.alias("tile_y"),
        bits.tile_phase(x, y).alias("phase"), bits.tile_phase(x, y, 3).alias("phase3"),
        (F.lit(0.6) + F.col("label") / 20.0).alias("coverage"), F.col("embedding").alias("scores"),
    )


# Sign bits of an embedding as a 64-bit code in two 32-bit halves (SQL side has no unsigned shift).
SIGN_SQL = """signs AS (
  SELECT vec_id, label,
         CAST(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << CAST(32 - i AS INTEGER) ELSE 0 END)) AS BIGINT) AS hi,
         CAST(list_sum(list_transform(range(33, 65), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << CAST(64 - i AS INTEGER) ELSE 0 END)) AS BIGINT) AS lo
  FROM embeddings)"""


def sign_code(column: str = "embedding") -> Column:
    return bits.bits_to_code(F.transform(column, lambda v: F.when(v > 0, F.lit(1)).otherwise(F.lit(0))))
