"""Benchmark summaries, distributions and image quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from provena.operators.scale import beside, group_quantiles


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def _positive() -> Column:
    return F.col("case_type") == "watermarked"


def _case_counts(success: Column, correct: Column) -> list[Column]:
    positive, negative = _positive(), ~_positive()
    return [
        F.count_if(positive).alias("positive_total"),
        F.count_if(positive & correct).alias("correct"),
        F.count_if(positive & success & ~correct).alias("wrong"),
        F.count_if(positive & ~success).alias("missed"),
        F.count_if(negative).alias("negative_total"),
        F.count_if(negative & success).alias("false_positive"),
    ]


def _with_rates(frame: DataFrame) -> DataFrame:
    return (
        frame.withColumn("recall", ratio(F.col("correct"), F.col("positive_total")))
        .withColumn("wrong_rate", ratio(F.col("wrong"), F.col("positive_total")))
        .withColumn("false_positive_rate", ratio(F.col("false_positive"), F.col("negative_total")))
    )


def _grouped(cases: DataFrame, axes: dict[str, str], aggregates: list[Column]) -> DataFrame:
    """Total and one grouping per axis in a single pass: (grouping, key, measures).

    Cases are first reduced to one row per combination of the axes, which is what gets shuffled
    and then re-aggregated, so grouping sets do not multiply the input rows.
    """
    names = list(axes)
    base = cases.groupBy(*[F.col(c).cast("string").alias(n) for n, c in axes.items()]).agg(*aggregates)
    measures = [c for c in base.columns if c not in names]
    sets = [[]] + [[F.col(n)] for n in names]
    rolled = base.groupingSets(sets, *[F.col(n) for n in names]).agg(
        F.grouping_id().alias("_g"), *[F.sum(m).cast("bigint").alias(m) for m in measures]
    )
    full = 2 ** len(names) - 1
    grouping, key = F.lit("total"), F.lit("")
    for place, name in enumerate(names):
        mask = full & ~(1 << (len(names) - 1 - place))
        grouping = F.when(F.col("_g") == mask, F.lit(name)).otherwise(grouping)
        key = F.when(F.col("_g") == mask, F.coalesce(F.col(name), F.lit(""))).otherwise(key)
    return rolled.select(grouping.alias("grouping"), key.alias("key"), *measures)


def attack_summary(cases: DataFrame) -> DataFrame:
    """Totals, by attack (positives only) and by round (both case types)."""
    rows = _grouped(cases, {"attack": "attack", "round": "round"}, _case_counts(F.col("success"), F.col("correct_trace")))
    attack = F.col("grouping") == "attack"
    for column in ("negative_total", "false_positive"):
        rows = rows.withColumn(column, F.when(attack, F.lit(0)).otherwise(F.col(column)))
    return _with_rates(rows.where(~attack | (F.col("positive_total") > 0)))


def crop_summary(cases: DataFrame) -> DataFrame:
    """Totals, by scale and by crop ratio (positives only in the groups)."""
    rows = _grouped(cases, {"scale": "scale_factor", "crop": "crop_ratio"}, _case_counts(F.col("success"), F.col("correct_trace")))
    group = F.col("grouping") != "total"
    for column in ("negative_total", "false_positive"):
        rows = rows.withColumn(column, F.when(group, F.lit(0)).otherwise(F.col(column)))
    return _with_rates(rows.where(~group | (F.col("positive_total") > 0)))


def negative_summary(cases: DataFrame) -> DataFrame:
    aggregates = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("false_positive"),
        F.count_if(F.col("success") & ~F.col("category").startswith("synthetic_")).alias("source_false_positive"),
    ]
    return _grouped(cases, {"category": "category"}, aggregates).withColumn(
        "false_positive_rate", ratio(F.col("false_positive"), F.col("total"))
    )


def profile_summary(cases: DataFrame) -> DataFrame:
    """cases: profile, expected_watermarked, detected, correct, wrong_trace."""
    positive = F.col("expected_watermarked")
    aggregates = [
        F.count_if(positive & F.col("correct")).alias("correct"),
        F.count_if(positive).alias("total"),
        F.count_if(positive & F.col("wrong_trace")).alias("wrong_trace"),
        F.count_if(~positive & F.col("detected")).alias("negative_false_positives"),
        F.count_if(~positive).alias("negative_total"),
    ]
    return _grouped(cases, {"profile": "profile"}, aggregates).withColumn("recall", ratio(F.col("correct"), F.col("total"), 6))


def config_summary(quality: DataFrame, probes: DataFrame) -> DataFrame:
    """Per fidelity: quality floor and probe recall."""
    q = quality.groupBy("fidelity").agg(
        F.min("psnr").alias("min_psnr"), F.min("ssim").alias("min_ssim"), F.bool_and("pass").alias("quality_pass")
    )
    p = probes.groupBy("fidelity").agg(*_case_counts(F.col("success"), F.col("correct_trace")))
    return q.join(p, "fidelity", "left").select(
        "fidelity", "min_psnr", "min_ssim", "quality_pass",
        F.coalesce("positive_total", F.lit(0)).alias("probe_total"),
        F.coalesce("correct", F.lit(0)).alias("probe_correct"),
        ratio(F.coalesce("correct", F.lit(0)), F.coalesce("positive_total", F.lit(0)), 6).alias("probe_recall"),
        F.coalesce("wrong", F.lit(0)).alias("wrong"),
        F.coalesce("negative_total", F.lit(0)).alias("negative_total"),
        F.coalesce("false_positive", F.lit(0)).alias("false_positive"),
    )


def recommend_config(configs: DataFrame, min_recall: float = 0.95) -> DataFrame:
    """Best passing configuration by (ssim, psnr, recall, fidelity); a single FAIL row when none passes."""
    passing = configs.where(
        F.col("quality_pass") & (F.col("wrong") == 0) & (F.col("false_positive") == 0) & (F.col("probe_recall") >= min_recall)
    )
    best = passing.agg(F.max(F.struct("min_ssim", "min_psnr", "probe_recall", "fidelity")).alias("b"))
    return best.select(
        F.when(F.col("b").isNull(), F.lit("FAIL")).otherwise(F.lit("PASS")).alias("verdict"),
        F.col("b.fidelity").alias("fidelity"), F.col("b.min_ssim").alias("min_ssim"),
        F.col("b.min_psnr").alias("min_psnr"), F.col("b.probe_recall").alias("probe_recall"),
    )


def manifest_counts(samples: DataFrame) -> DataFrame:
    return samples.agg(
        F.count(F.lit(1)).alias("slots"),
        F.count_if(F.col("status") == "collected").alias("collected"),
        F.count_if(F.col("status") == "pending_collection").alias("pending"),
    )


_SPREAD = ("min", "p5", "p50", "p95", "mean")
_POINTS = {"p5": 0.05, "p50": 0.5, "p95": 0.95}


def metric_distribution(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    ends = rows.where(F.col(value).isNotNull()).groupBy(*group).agg(F.min(value).alias("min"), F.avg(value).alias("mean"))
    found = beside(ends, group_quantiles(rows, group, value, _POINTS), group)
    return found.select(*group, *[F.round(c, 6).alias(c) for c in _SPREAD])


def latency_percentiles(cases: DataFrame, group: list[str], value: str = "detection_ms") -> DataFrame:
    """Nearest-rank P50 and P95 and the maximum."""
    top = cases.where(F.col(value).isNotNull()).groupBy(*group).agg(F.max(value).alias("max"))
    ranks = group_quantiles(cases, group, value, {"p50": 0.5, "p95": 0.95}, "nearest")
    return beside(top, ranks, group).select(*group, "p50", "p95", "max")


def stage_timing(events: DataFrame) -> DataFrame:
    """stage, duration_ms, candidate_count, fallback_count to per-stage statistics; stages without a duration are left out."""
    counts = [F.count(F.lit(1)).alias("events"), F.sum("candidate_count").alias("candidates"), F.sum("fallback_count").alias("fallbacks")]
    ends = [F.min("duration_ms").alias("min"), F.avg("duration_ms").alias("mean")]
    found = beside(events.groupBy("stage").agg(*counts, *ends).where(F.col("min").isNotNull()), group_quantiles(events, ["stage"], "duration_ms", _POINTS), ["stage"])
    return found.select("stage", "events", "candidates", "fallbacks", *[F.round(c, 6).alias(c) for c in _SPREAD])


def same_source_versions(records: DataFrame) -> DataFrame:
    """Records per source group, largest first place flagged against the 1000-version requirement."""
    sizes = records.groupBy("source_group_id").agg(F.count(F.lit(1)).alias("versions"))
    return sizes.withColumn("meets_scale_gate", F.col("versions") >= 1000)


# --- image quality -------------------------------------------------------------------------------


def _gaussian(size: int = 11, sigma: float = 1.5) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    kernel = np.exp(-(x * x) / (2 * sigma * sigma))
    return kernel / kernel.sum()


def _blur(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Separable blur with mirrored borders (edge pixel not repeated)."""
    half = len(kernel) // 2
    for axis in (0, 1):
        pad = [(0, 0)] * image.ndim
        pad[axis] = (half, half)
        padded = np.pad(image, pad, mode="reflect")
        size = image.shape[axis]
        image = sum(w * np.take(padded, range(i, i + size), axis=axis) for i, w in enumerate(kernel))
    return image


def ssim(first: np.ndarray, second: np.ndarray) -> float:
    kernel = _gaussian()
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    m1, m2 = _blur(first, kernel), _blur(second, kernel)
    v1 = _blur(first * first, kernel) - m1 * m1
    v2 = _blur(second * second, kernel) - m2 * m2
    cov = _blur(first * second, kernel) - m1 * m2
    top = (2 * m1 * m2 + c1) * (2 * cov + c2)
    return float(np.mean(top / np.maximum((m1 * m1 + m2 * m2 + c1) * (v1 + v2 + c2), 1e-12)))


def quality_metrics(pairs: DataFrame) -> DataFrame:
    """pair, width, height, first, second (RGB bytes of equal size) to error and similarity measures."""

    def measure(batches):
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                shape = (row.height, row.width, 3)
                a = np.frombuffer(row.first, np.uint8).reshape(shape).astype(np.float64)
                b = np.frombuffer(row.second, np.uint8).reshape(shape).astype(np.float64)
                gap = b - a
                mse = float(np.mean(gap * gap))
                rmse = mse**0.5
                psnr = float("inf") if mse == 0 else 20 * np.log10(255.0 / rmse)
                rows.append((row.pair, round(psnr, 6), round(ssim(a, b), 6), round(float(np.abs(gap).mean()), 6), round(rmse, 6), int(np.abs(gap).max())))
            yield pd.DataFrame(rows, columns=["pair", "psnr", "ssim", "mae", "rmse", "max_abs_diff"])

    schema = "pair string, psnr double, ssim double, mae double, rmse double, max_abs_diff int"
    return pairs.select("pair", "width", "height", "first", "second").mapInPandas(measure, schema)
