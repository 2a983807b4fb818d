"""Listing, paging, dashboards, counters and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from provena.functions import text
from provena.operators.filters import not_deleted
from provena.operators.scale import ranked, top_rows

PAGE_SIZE = 10
# Status words of a listing.
PROTECTED, LEAK, HIT = "保护中", "泄露预警", "溯源命中"
# Per-query and per-report caps.
CAPS = {"verified_candidates": 3, "aligned_candidates": 8, "recalled_groups": 40, "persistent_records": 80, "failure_rows": 100}


def list_records(records: DataFrame, user_id: int | None = None) -> DataFrame:
    rows = not_deleted(records)
    if user_id is not None:
        rows = rows.where(F.col("owner_user_id") == user_id)
    return rows.orderBy(F.col("created_at").desc(), F.col("record_id"))


def shown_confidence() -> Column:
    """confidence, or conf when confidence is zero or missing, or 0."""
    return F.coalesce(F.nullif(F.col("confidence"), F.lit(0)), F.col("conf"), F.lit(0))


def sort_keys(mode: str) -> list[Column]:
    created = F.coalesce(F.col("created_at"), F.lit(""))
    keys = {
        "created_desc": created.desc(),
        "created_asc": created.asc(),
        "confidence_desc": shown_confidence().desc(),
        "confidence_asc": shown_confidence().asc(),
    }
    return [keys.get(mode, keys["created_desc"]), F.col("position_index").asc()]


def sorted_listing(records: DataFrame, mode: str = "created_desc") -> DataFrame:
    return records.orderBy(*sort_keys(mode))


def page(records: DataFrame, order: Sequence[str | Column], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Rows of one page; the page number is clamped to the last page. ``order`` ends in a unique column.

    A count and a top of ``page * size`` rows: every task keeps no more, and nothing is written.
    """
    last = max(1, -(-records.count() // size))
    wanted = min(max(number, 1), last)
    skipped = (wanted - 1) * size
    rows = records.orderBy(*order).offset(skipped).limit(size)
    # At most ``size`` rows are left for the window.
    placed = rows.withColumn("row_no", F.row_number().over(Window.orderBy(*order)).cast("bigint") + skipped)
    return placed.withColumn("page", F.lit(wanted).cast("bigint")).withColumn("total_pages", F.lit(last).cast("bigint"))


def position_index(records: DataFrame) -> DataFrame:
    """Newest first, dense from 0; computed at read, so a delete needs no rewrite."""
    placed = ranked(records, [], [F.col("created_at").desc(), F.col("record_id")], "_rank")
    return placed.withColumn("position_index", F.col("_rank") - 1).drop("_rank")


def keep_latest(changes: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Last write per key; a partial maximum a map task keeps hot keys cheap."""
    best = changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), F.col(sequence)).alias("b"))
    return best.select("b.*")


def cap_rows(frame: DataFrame, group: Sequence[str], order: Sequence[Column], cap: str) -> DataFrame:
    return top_rows(frame, group, order, CAPS[cap])


def claimable_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Backlog: unexpired jobs that are queued, or running under an expired lease; oldest first."""
    open_job = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_expires_at") < now))
    return jobs.where((F.col("deadline_at") > now) & open_job).orderBy("created_at", "job_id")


def dashboard(records: DataFrame, counters: DataFrame, as_of: str, user_id: int | None = None) -> DataFrame:
    """One row: totals of live records and detection counters, scoped to an owner or over all."""
    if user_id is not None:
        records = records.where(F.col("owner_user_id") == user_id)
        counters = counters.where(F.col("owner_user_id") == user_id)
    totals = not_deleted(records).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.to_date("created_at") == F.lit(as_of).cast("date")).alias("today")
    )
    value = lambda key: F.coalesce(F.sum(F.when(F.col("counter_key") == key, F.col("counter_value"))), F.lit(0))
    sums = counters.agg(
        value("detection_total").alias("detected"),
        value(f"detection_total:{as_of}").alias("detected_today"),
        value("detection_success").alias("_succeeded"),
    )
    rate = F.when(F.col("detected") > 0, F.round(F.col("_succeeded") * 100.0 / F.col("detected"), 2)).otherwise(F.lit(0.0))
    return totals.crossJoin(F.broadcast(sums)).withColumn("success_rate", rate).drop("_succeeded")  # one row each


def image_status_counts(records: DataFrame, attempts: DataFrame) -> DataFrame:
    """records: status; attempts: attempts, successes (one row)."""
    counts = records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == PROTECTED).alias("protected"),
        F.count_if(F.col("status") == LEAK).alias("leaks"),
        F.count_if(F.col("status") == HIT).alias("hits"),
    )
    sums = attempts.agg(F.coalesce(F.sum("attempts"), F.lit(0)).alias("detection_attempts"), F.coalesce(F.sum("successes"), F.lit(0)).alias("detection_successes"))
    rate = F.when(F.col("detection_attempts") > 0, F.round(F.col("detection_successes") * 100.0 / F.col("detection_attempts"), 1)).otherwise(F.lit(0.0))
    return counts.crossJoin(F.broadcast(sums)).withColumn("detection_success_rate", rate)  # one row each


def counters(deltas: DataFrame) -> DataFrame:
    """(owner, key, delta) to totals; deltas must be positive."""
    return (
        deltas.where(F.col("delta") > 0).groupBy("owner_user_id", "counter_key").agg(F.sum("delta").alias("counter_value"))
    )


def with_daily_keys(deltas: DataFrame, when: str) -> DataFrame:
    """Every increment also counts under its dated key."""
    keys = F.array(F.col("counter_key"), text.daily_key(F.col("counter_key"), F.col(when)))
    return deltas.withColumn("counter_key", F.explode(keys))


def daily_counts(records: DataFrame, stored: DataFrame | None = None, when: str = "created_at") -> DataFrame:
    """(day, n): the stored count of a day wins, other days are recounted."""
    counted = records.groupBy(F.to_date(when).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    if stored is None:
        return counted
    fixed = stored.select("day", F.col("n").alias("stored_n"))
    return counted.join(fixed, "day", "full_outer").select("day", F.coalesce("stored_n", "n").alias("n"))


def daily_map(days: DataFrame) -> DataFrame:
    """The same as one MAP<day, n> row; one entry a calendar day bounds it."""
    return days.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("day").cast("string"), "n")))).alias("daily"))


# --- sets ----------------------------------------------------------------------------------------


def union_evidence(parts: dict[str, DataFrame]) -> DataFrame:
    out: DataFrame | None = None
    for kind, frame in parts.items():
        tagged = frame.withColumn("kind", F.lit(kind))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def unique_records(hits: DataFrame) -> DataFrame:
    return hits.dropDuplicates(["query_id", "record_id"])


def split_overlap(hashes: DataFrame) -> DataFrame:
    """(split, sha256): hashes present more than once within or across splits."""
    return hashes.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("uses"), F.countDistinct("split").alias("splits")
    ).where(F.col("uses") > 1)


def required_coverage(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required names that are not present."""
    return required.select("name").distinct().join(present.select("name").distinct(), "name", "left_anti")


def case_matrix(sources: DataFrame, scales: Sequence[float], ratios: Sequence[float], copies: int) -> DataFrame:
    """Planned positive and negative cases: sources x scales x crops x index (fixed small axes)."""
    axis = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    return (
        sources.withColumn("scale_factor", axis(scales))
        .withColumn("crop_ratio", axis(ratios))
        .withColumn("crop_index", axis(range(copies)))
        .withColumn("case_type", axis(["watermarked", "unwatermarked"]))
    )


def keep_first_distinct(column: Column) -> Column:
    return F.array_distinct(column)


def reconcile_selection(selected: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    return selected.select(key).distinct().join(records.select(key).distinct(), key, "left_semi")
