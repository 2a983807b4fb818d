"""Projections, filters and predicates (owner scope, status rules, candidate rules, constraints)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provena.functions import crypto, geometry, text, vectors
from provena.operators.scale import pinned

# Public fields of a listing row and the media fields of a record.
PUBLIC_FIELDS = (
    "id", "name", "size", "user_id", "trace_id", "evidence_uuid_head", "evidence_uuid_tail",
    "robust_watermark_version", "mode", "mode_label", "created_at", "time", "status",
    "confidence", "conf", "original_access_url", "download_access_url", "thumbnail_access_url",
)
MEDIA_URL_FIELDS = ("original_url", "download_url", "thumbnail_url")
ALL_FILTER = "全部"


def owner_scope(frame: DataFrame, user_id: int, cross_owner: bool = False, column: str = "owner_user_id") -> DataFrame:
    return frame if cross_owner else frame.where(F.col(column) == user_id)


def active_only(frame: DataFrame, column: str = "status") -> DataFrame:
    return frame.where(F.col(column) == "active")


def not_deleted(frame: DataFrame, column: str = "status") -> DataFrame:
    return frame.where(F.col(column) != "deleted")


def public_projection(frame: DataFrame) -> DataFrame:
    return frame.select(*[c for c in PUBLIC_FIELDS if c in frame.columns])


def public_users(users: DataFrame) -> DataFrame:
    """User name and role; password material never leaves the table."""
    return users.select("username", F.col("role_key").alias("role"))


def record_search(frame: DataFrame, status: str = "", date: str = "", search: str = "") -> DataFrame:
    rows = frame
    if status and status != ALL_FILTER:
        rows = rows.where(F.col("status") == status)
    if date:
        rows = rows.where(F.substring(F.coalesce(F.col("created_at"), F.lit("")), 1, 10) == date)
    wanted = search.strip().lower()
    if wanted:
        parts = [
            F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
            for c in ("name", "user_id", "trace_id", "status")
        ]
        rows = rows.where(F.concat_ws(" ", *parts).contains(wanted))
    return rows


def v4_candidate_filter(records: DataFrame, features: DataFrame) -> DataFrame:
    """Records with the current version and codec, usable ids, a 16-hex tag and a stored index."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    kept = records.where(
        (F.col("robust_watermark_version") == 4)
        & (F.col("robust_watermark_codec") == crypto.CODEC)
        & ~blank("id")
        & ~blank("trace_id")
        & F.trim(F.col("robust_auth_code")).rlike(r"^[0-9a-f]{16}$")
    )
    return kept.join(features.select("id").distinct(), "id", "left_semi")


def layer_candidates(records: DataFrame, layer: str) -> DataFrame:
    """Records eligible for one older layer: dot_matrix, robust, legacy_robust, code or small_crop."""
    traced = F.coalesce(F.col("trace_id"), F.lit("")) != ""
    robust = traced & F.coalesce(F.col("robust_watermark"), F.lit(False))
    coded = robust & (F.col("watermark_code_version") == 4)
    rules = {
        "dot_matrix": traced & F.col("dot_matrix_trace_enabled") & (F.col("dot_matrix_trace_version") == 1),
        "robust": robust,
        "legacy_robust": robust & (text.normalize_version(F.col("robust_watermark_version").cast("string")) == 1),
        "code": coded,
        "small_crop": coded & F.col("small_crop_trace_enabled") & (F.col("small_crop_trace_version") == 1),
    }
    return records.where(F.coalesce(rules[layer], F.lit(False)))


def fallback_routes(images: DataFrame, robust_records: DataFrame) -> DataFrame:
    """Adds run_frequency and run_visual to rows with (width, height)."""
    pixels = F.col("width").cast("bigint") * F.col("height")
    aspect = F.greatest("width", "height") / F.greatest(F.lit(1), F.least("width", "height"))
    frequency = (pixels <= 3_000_000) | ((pixels <= 5_000_000) & (aspect >= 2.2))
    any_robust = robust_records.limit(1).agg((F.count(F.lit(1)) > 0).alias("_any"))
    return (
        images.join(F.broadcast(any_robust))  # one-row flag
        .withColumn("run_frequency", frequency)
        .withColumn("run_visual", F.col("_any") & (pixels >= 40_000))
        .drop("_any")
    )


def allowed_menus(menus: Column, known: list[str]) -> Column:
    return F.filter(menus, lambda m: m.isin(*known))


def check_violations(frame: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row per (key, constraint) for every CHECK that does not hold; NULL passes, as in SQL."""
    broken = F.array(*[F.when(~predicate, F.lit(name)) for name, predicate in checks.items()])
    return frame.select(key, F.explode(F.array_compact(broken)).alias("constraint"))


def embedding_validity(frame: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    return frame.withColumn("reject_reason", vectors.validity(F.col(column), dimension))


def valid_embeddings(frame: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    return embedding_validity(frame, dimension, column).where(F.col("reject_reason").isNull()).drop("reject_reason")


def normalize_embeddings(frame: DataFrame, column: str = "embedding") -> DataFrame:
    unit = pinned(frame, **{column: vectors.normalize(F.col(column))}).select(*frame.columns)
    return unit.where(F.col(column).isNotNull())


def geometry_confirmed(evidence: DataFrame, matcher: str = "orb") -> DataFrame:
    """Evidence (inliers, ratio, reprojection_error, homography, sizes) that confirms a group."""
    limits = {"orb": (18, 0.32, 5.0), "model": (4, 0.0, float("inf"))}
    inliers, ratio, error = limits[matcher]
    usable = (
        (F.col("inliers") >= inliers)
        & F.col("ratio").between(ratio, 1.0)
        & ~F.isnan("ratio")
        & ~F.isnan("reprojection_error")
        & (F.col("reprojection_error") >= 0)
        & (F.col("reprojection_error") < float("inf"))
        & (F.col("reprojection_error") <= error)
    )
    return evidence.where(usable).where(
        geometry.plausible_confirmed(
            F.col("homography"), F.col("query_width"), F.col("query_height"), F.col("target_width"), F.col("target_height")
        )
    )


def media_access(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requests (user_id, is_admin, url) that some visible record names in a media field."""
    named = records.select(
        F.col("owner_user_id").alias("_owner"),
        F.explode(F.array_compact(F.array(*[F.col(c) for c in MEDIA_URL_FIELDS]))).alias("url"),
    )
    own = requests.where(~F.col("is_admin")).join(
        named.distinct(), (F.col("user_id") == F.col("_owner")) & (requests["url"] == named["url"]), "left_semi"
    )
    all_urls = named.select("url").distinct()
    admin = requests.where(F.col("is_admin")).join(all_urls, "url", "left_semi").select(*requests.columns)
    return own.unionByName(admin)
