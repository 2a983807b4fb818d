"""Registry table schemas and the declarative constraint table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F, types as T



# One schema per registry table, as DDL.
TABLES: dict[str, str] = {
    "users": "user_id int, username string, role_key string",
    "source_groups": (
        "source_group_id string, owner_user_id int, original_image_sha256 binary, image_width int, image_height int, "
        "original_media_id string, model_version string, feature_schema_version string, view_policy_version string, "
        "status string, created_at timestamp, updated_at timestamp"
    ),
    "source_group_embeddings": (
        "source_group_id string, view_index int, owner_user_id int, view_kind string, embedding array<float>, model_version string"
    ),
    "source_group_features": (
        "source_group_id string, feature_kind string, schema_version string, model_version string, feature_bytes binary, feature_sha256 binary"
    ),
    "media_objects": (
        "media_id string, owner_user_id int, variant string, storage_key string, content_type string, byte_size bigint, "
        "sha256 binary, status string, created_at timestamp"
    ),
    "v4_records": (
        "record_id string, source_group_id string, owner_user_id int, trace_id string, codec string, auth_tag binary, key_id string, "
        "original_file_md5 binary, original_file_sha256 binary, watermarked_file_md5 binary, watermarked_file_sha256 binary, "
        "original_pixel_sha256 binary, watermarked_pixel_sha256 binary, output_media_id string, thumbnail_media_id string, "
        "evidence_uuid string, original_filename string, status string, created_at timestamp"
    ),
    "auth_sessions": (
        "token_hash binary, user_id int, created_at timestamp, idle_expires_at timestamp, absolute_expires_at timestamp, "
        "last_used_at timestamp, revoked_at timestamp"
    ),
    "rate_limit_buckets": "bucket_key binary, endpoint_class string, window_start timestamp, request_count int, updated_at timestamp",
    "v4_counters": "owner_user_id int, counter_key string, counter_value bigint, updated_at timestamp",
    "audit_events": (
        "event_id string, actor_user_id int, action string, target_id string, outcome string, correlation_id string, created_at timestamp"
    ),
    "deep_forensics_jobs": (
        "job_id string, owner_user_id int, requested_owner_user_id int, input_media_id string, status string, progress int, "
        "lease_owner string, lease_expires_at timestamp, deadline_at timestamp, result_outcome string, result_media_id string, "
        "result_evidence_id string, error_code string, error_detail string, created_at timestamp, updated_at timestamp"
    ),
    "keypoints": "owner_id string, kp_idx int, x float, y float, descriptor binary",
}


def table_schema(name: str) -> T.StructType:
    """Parsed schema of a registry table (needs an active session)."""
    return T.StructType.fromDDL(TABLES[name])


@dataclass(frozen=True)
class Constraints:
    key: str
    checks: dict[str, Column] = field(default_factory=dict)
    unique: dict[str, tuple[str, ...]] = field(default_factory=dict)
    # name -> (child columns, parent table, parent columns)
    foreign: dict[str, tuple[tuple[str, ...], str, tuple[str, ...]]] = field(default_factory=dict)


def _size(column: str, size: int) -> Column:
    return F.octet_length(column) == size


def constraints() -> dict[str, Constraints]:
    """CHECK, UNIQUE and foreign-key rules of every table (needs an active session)."""
    owner = {"owner": (("owner_user_id",), "users", ("user_id",))}
    return {
        "users": Constraints("user_id", {"known_role": F.col("role_key").isin("admin", "user", "auditor")}, {"primary": ("user_id",), "username": ("username",)}),
        "source_groups": Constraints(
            "source_group_id",
            {
                "positive_dimensions": (F.col("image_width") > 0) & (F.col("image_height") > 0),
                "sha256_length": _size("original_image_sha256", 32),
                "known_status": F.col("status").isin("active", "disabled", "deleted"),
            },
            {"primary": ("source_group_id",), "owner_sha256": ("owner_user_id", "original_image_sha256")},
            {**owner, "original_media": (("original_media_id",), "media_objects", ("media_id",))},
        ),
        "source_group_embeddings": Constraints(
            "source_group_id",
            {"view_index": F.col("view_index") >= 0},
            {"group_view": ("source_group_id", "view_index")},
            {"group_owner": (("source_group_id", "owner_user_id"), "source_groups", ("source_group_id", "owner_user_id"))},
        ),
        "source_group_features": Constraints(
            "source_group_id",
            {"known_kind": F.col("feature_kind").isin("orb", "superpoint"), "sha256_length": _size("feature_sha256", 32)},
            {"group_kind": ("source_group_id", "feature_kind")},
            {"group": (("source_group_id",), "source_groups", ("source_group_id",))},
        ),
        "media_objects": Constraints(
            "media_id",
            {
                "known_variant": F.col("variant").isin("original", "watermarked", "thumbnail"),
                "byte_size": F.col("byte_size") >= 0,
                "sha256_length": _size("sha256", 32),
                "known_status": F.col("status").isin("staged", "active", "deleted"),
            },
            {"primary": ("media_id",), "storage_key": ("storage_key",)},
            owner,
        ),
        "v4_records": Constraints(
            "record_id",
            {
                "auth_tag_length": _size("auth_tag", 8),
                "md5_lengths": _size("original_file_md5", 16) & _size("watermarked_file_md5", 16),
                "sha256_lengths": _size("original_file_sha256", 32) & _size("watermarked_file_sha256", 32)
                & _size("original_pixel_sha256", 32) & _size("watermarked_pixel_sha256", 32),
                "known_status": F.col("status").isin("staging", "active", "disabled", "deleted"),
            },
            {"primary": ("record_id",), "owner_trace": ("owner_user_id", "trace_id"), "group_tag": ("source_group_id", "auth_tag")},
            {
                "group_owner": (("source_group_id", "owner_user_id"), "source_groups", ("source_group_id", "owner_user_id")), **owner,
                "output_media": (("output_media_id",), "media_objects", ("media_id",)), "thumbnail_media": (("thumbnail_media_id",), "media_objects", ("media_id",)),
            },
        ),
        "auth_sessions": Constraints(
            "token_hash",
            {"token_hash_length": _size("token_hash", 32), "idle_before_absolute": F.col("idle_expires_at") <= F.col("absolute_expires_at")},
            {"primary": ("token_hash",)},
            {"user": (("user_id",), "users", ("user_id",))},
        ),
        "rate_limit_buckets": Constraints("bucket_key", {"request_count": F.col("request_count") >= 0}, {"primary": ("bucket_key",)}),
        "v4_counters": Constraints(
            "counter_key", {"counter_value": F.col("counter_value") >= 0}, {"owner_key": ("owner_user_id", "counter_key")}, owner
        ),
        "audit_events": Constraints("event_id", {}, {"primary": ("event_id",)}),
        "keypoints": Constraints("owner_id", {"keypoint_index": F.col("kp_idx") >= 0}, {"primary": ("owner_id", "kp_idx")}),
        "deep_forensics_jobs": Constraints(
            "job_id",
            {
                "progress": F.col("progress").between(0, 100),
                "known_status": F.col("status").isin("queued", "running", "completed", "failed", "cancelled"),
            },
            {"primary": ("job_id",)},
            {**owner, "requested_owner": (("requested_owner_user_id",), "users", ("user_id",)), "input_media": (("input_media_id",), "media_objects", ("media_id",))},
        ),
    }
