"""Typed tables, record documents, manifests, benchmark cases and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from provena import schemas

RECORD_DOCUMENT = (
    "struct<id:string,trace_id:string,user_id:string,name:string,image_width:int,image_height:int,status:string,"
    "confidence:double,conf:double,created_at:string,original_url:string,download_url:string,thumbnail_url:string,"
    "original_file_md5:string,original_file_sha256:string,original_image_sha256:string,watermarked_file_md5:string,"
    "watermarked_file_sha256:string,watermarked_image_sha256:string,robust_watermark:boolean,robust_watermark_version:int,"
    "robust_watermark_codec:string,robust_auth_code:string,feature_index_path:string,watermark_code_version:int,"
    "small_crop_trace_enabled:boolean,small_crop_trace_version:int,dot_matrix_trace_enabled:boolean,dot_matrix_trace_version:int,"
    "evidence_uuid:string,watermark_layers:array<string>>"
)
CASE_FIELDS = (
    "array<struct<round:int,case_type:string,source:string,attack:string,category:string,name:string,trace_id:string,"
    "scale_factor:double,crop_ratio:double,crop_index:int,success:boolean,correct_trace:boolean,detected_trace_id:string,"
    "confidence:double,status:string,detail:string,detection_ms:double,bit_errors:int,corrected_symbols:int,erasure_count:int>>"
)
AUDIT_SCHEMA = schemas.TABLES["audit_events"]


def scan_registry(spark: SparkSession, root: str, tables: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Typed tables under ``root``; schemas are given, so nothing is read to infer them.

    Batches appended by ``append_generation_batch`` count only once they are committed.
    """
    from provena.sources.sinks import committed

    return {name: committed(spark, root, name) for name in (tables or schemas.TABLES)}


def scan_record_documents(rows: DataFrame) -> DataFrame:
    """(position_index, user_id, data JSON) to typed columns; unknown keys stay in ``extra``."""
    return rows.select(
        "position_index",
        F.col("user_id").alias("stored_user_id"),
        F.from_json("data", RECORD_DOCUMENT).alias("r"),
        F.try_parse_json("data").alias("extra"),
    ).select("position_index", "stored_user_id", "r.*", "extra").orderBy("position_index")


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files as (manifest_id, document) for the validators."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("manifest_id"), F.col("value").alias("document")
    )


def manifest_items(manifests: DataFrame, field: str) -> DataFrame:
    from provena.operators.validators import Item, explode_items

    item = Item()
    names = ("id", "category", "relative_path", "status", "sha256", "source_id", "route")
    return explode_items(manifests, field).select("manifest_id", "index", *[item.text(n).alias(n) for n in names])


def scan_case_results(reports: DataFrame) -> DataFrame:
    """(report_id, report JSON) to one typed row per case."""
    schema = f"struct<cases:{CASE_FIELDS}>"
    parsed = reports.select("report_id", F.from_json("report", schema).alias("r"))
    return parsed.select("report_id", F.posexplode("r.cases").alias("case_index", "c")).select("report_id", "case_index", "c.*")


def scan_events_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", event_time: str = "ts", delay: str = "10 minutes", max_files: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files)
        .parquet(folder).withWatermark(event_time, delay)
    )
