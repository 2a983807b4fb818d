"""Recall queries: validity, nearest views, group statistics, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from provena.functions import vectors
from provena.operators import filters, recall
from provena.suite.base import QUERY_VIEWS_SQL, VIEWS_SQL, query, query_views, table, views

_NEAR_SQL = f"""WITH {VIEWS_SQL}, {QUERY_VIEWS_SQL},
pairs AS (
  SELECT q.query_id, q.query_view, v.source_group_id, v.view_index,
         round(1 - greatest(-1, least(1, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 12) AS distance
  FROM query_views q JOIN views v ON q.cross_owner OR v.owner_user_id = q.user_id),
near AS (
  SELECT * FROM pairs
  QUALIFY row_number() OVER (PARTITION BY query_id, query_view ORDER BY distance, source_group_id, view_index) <= 400),
grouped AS (
  SELECT query_id, query_view, source_group_id, min(distance) AS best_distance, count(*) AS matching_view_count,
         coalesce(stddev_pop(distance), 0) AS distance_consistency
  FROM near GROUP BY ALL)"""


@query(
    "embedding_validity",
    """SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'dimension'
         WHEN abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-4 THEN 'norm'
         ELSE 'usable' END AS verdict FROM embeddings""",
)
def embedding_validity(spark: SparkSession, folder: str) -> DataFrame:
    rows = filters.embedding_validity(table(spark, folder, "embeddings"), 64)
    return rows.select("vec_id", F.coalesce("reject_reason", F.lit("usable")).alias("verdict"))


@query(
    "normalize_embedding",
    """WITH n AS (SELECT vec_id, embedding, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS s FROM embeddings)
       SELECT vec_id, round(CAST(CAST(CAST(embedding[1] AS DOUBLE) / s AS FLOAT) AS DOUBLE), 6) AS first_value,
              round(CAST(CAST(CAST(embedding[64] AS DOUBLE) / s AS FLOAT) AS DOUBLE), 6) AS last_value FROM n WHERE s > 0""",
)
def normalize_embedding(spark: SparkSession, folder: str) -> DataFrame:
    rows = filters.normalize_embeddings(table(spark, folder, "embeddings"))
    at = lambda i: F.round(F.element_at("embedding", i).cast("double"), 6)
    return rows.select("vec_id", at(1).alias("first_value"), at(64).alias("last_value"))


@query(
    "cosine_distance",
    """SELECT a.vec_id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_distance(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("vector_knn", _NEAR_SQL + " SELECT query_id, query_view, source_group_id, view_index, round(distance, 6) AS distance FROM near")
def vector_knn(spark: SparkSession, folder: str) -> DataFrame:
    near = recall.vector_knn(query_views(spark, folder), views(spark, folder))
    return near.select("query_id", "query_view", "source_group_id", "view_index", F.round("distance", 6).alias("distance"))


@query(
    "recall_group_agg",
    _NEAR_SQL + """ SELECT query_id, query_view, source_group_id, round(best_distance, 6) AS best_distance, matching_view_count,
      round(distance_consistency, 6) AS distance_consistency FROM grouped""",
)
def recall_group_agg(spark: SparkSession, folder: str) -> DataFrame:
    rows = recall.recall_group_agg(recall.vector_knn(query_views(spark, folder), views(spark, folder)))
    return rows.select(
        "query_id", "query_view", "source_group_id", F.round("best_distance", 6).alias("best_distance"), "matching_view_count",
        F.round("distance_consistency", 6).alias("distance_consistency"),
    )


@query(
    "multi_view_agg",
    _NEAR_SQL + """ SELECT query_id, source_group_id, round(min(best_distance), 6) AS best_distance, count(*) AS matching_view_count,
      round(coalesce(stddev_pop(best_distance), 0), 6) AS distance_consistency FROM grouped GROUP BY ALL""",
)
def multi_view_agg(spark: SparkSession, folder: str) -> DataFrame:
    rows = recall.multi_view_agg(recall.recall_group_agg(recall.vector_knn(query_views(spark, folder), views(spark, folder))))
    return rows.select(
        "query_id", "source_group_id", F.round("best_distance", 6).alias("best_distance"), "matching_view_count",
        F.round("distance_consistency", 6).alias("distance_consistency"),
    )


@query(
    "recall_topk",
    _NEAR_SQL + """,
per_view AS (
  SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY query_id, query_view
    ORDER BY best_distance, matching_view_count DESC, round(distance_consistency, 12), source_group_id) <= 40),
merged AS (
  SELECT query_id, source_group_id, min(best_distance) AS best_distance, count(*) AS matching_view_count,
         coalesce(stddev_pop(best_distance), 0) AS distance_consistency
  FROM per_view GROUP BY ALL)
SELECT query_id, source_group_id, round(best_distance, 6) AS best_distance, matching_view_count,
       round(distance_consistency, 6) AS distance_consistency,
       row_number() OVER (PARTITION BY query_id ORDER BY best_distance, matching_view_count DESC, round(distance_consistency, 12), source_group_id) AS rank
FROM merged QUALIFY rank <= 40""",
)
def recall_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = recall.recall_topk(query_views(spark, folder), views(spark, folder))
    return rows.select(
        "query_id", "source_group_id", F.round("best_distance", 6).alias("best_distance"), "matching_view_count",
        F.round("distance_consistency", 6).alias("distance_consistency"), F.col("rank").cast("bigint").alias("rank"),
    )
