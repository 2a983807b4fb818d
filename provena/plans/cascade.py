"""Detector plug-ins and the ordered cascade over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from provena.operators.evidence import first_hit_precedence

# A detector gets (queries, registry) and returns query_id, record_id, priority, confidence, evidence.
Detector = Callable[[DataFrame, DataFrame], DataFrame]
EVIDENCE = ("query_id", "record_id", "priority", "confidence", "evidence")


def run_cascade(queries: DataFrame, registry: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    """First detector (in list order) with a hit wins for each query.

    Queries settled by a detector leave the plan before the next one runs, so expensive detectors
    only see what the cheap ones could not decide.
    """
    found: DataFrame | None = None
    open_queries = queries
    for place, detector in enumerate(detectors):
        rows = detector(open_queries, registry).withColumn("priority", F.lit(place)).select(*EVIDENCE)
        found = rows if found is None else found.unionByName(rows)
        open_queries = open_queries.join(rows.select("query_id").distinct(), "query_id", "left_anti")
    return first_hit_precedence(found)


def hide_legacy(evidence: DataFrame, v4_candidates: DataFrame) -> DataFrame:
    """Queries with any current-version candidate take no evidence from the older layers."""
    modern = v4_candidates.select("query_id").distinct()
    current = evidence.where(F.col("evidence") == "v4")
    older = evidence.where(F.col("evidence") != "v4").join(modern, "query_id", "left_anti")
    return current.unionByName(older)


# An embedding plug-in maps batches of image rows to (image_id, view_index, embedding); no model ships here.
EmbeddingFunction = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
EMBEDDING_SCHEMA = "image_id string, view_index int, embedding array<float>"


def embed_views(images: DataFrame, function: EmbeddingFunction, dimension: int) -> DataFrame:
    """Run an embedding plug-in over image partitions and keep unit-normalised, valid vectors."""
    from provena.operators.filters import normalize_embeddings, valid_embeddings

    raw = images.mapInPandas(function, EMBEDDING_SCHEMA)
    return valid_embeddings(normalize_embeddings(raw), dimension)
