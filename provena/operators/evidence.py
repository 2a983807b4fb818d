"""Evidence aggregation and verdicts: tiles to codewords, windows to votes, candidates to one record."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from provena.functions import bits, codewords, geometry, text, vectors
from provena.operators.scale import blocked_pairs, median, pinned, ranked, top_rows
from provena.session import discard, shuffle_partitions, written

BITS = 64


def _per_bit(make) -> Column:
    """ARRAY of one aggregate per bit; 64 small buffers a group instead of 64 exploded rows a tile."""
    return F.array(*[make(i) for i in range(BITS)])


def _sign_bits(values: Column) -> Column:
    return F.transform(values, lambda v: F.when(v > 0, F.lit(1)).otherwise(F.lit(0)))


def _array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _mean_abs(values: Column) -> Column:
    return _array_sum(F.transform(values, lambda v: F.abs(v))) / F.size(values)


# --- tiles ---------------------------------------------------------------------------------------


def tile_observation(
    tiles: DataFrame, min_tiles: int = 1, min_phases: int = 2, min_coverage: float = 0.0
) -> DataFrame:
    """Tile scores to one codeword observation per image.

    tiles: image_id, tile_x, tile_y, phase, coverage, scores (64, logical order). Every tile is
    divided by its median energy, bits are averaged per carrier class, both classes must pass.
    """
    energy = vectors.median_abs(F.col("scores"), BITS)
    usable = (
        pinned(tiles.where((F.col("coverage") >= min_coverage) & (F.size("scores") == BITS)), energy=energy)
        .where((F.col("energy") > 1e-9) & ~F.isnan("energy") & (F.col("energy") < float("inf")))
        .withColumn("carrier", bits.carrier_class(F.col("tile_x"), F.col("tile_y")))
    )
    per_class = usable.groupBy("image_id", "carrier").agg(
        _per_bit(lambda i: F.avg(F.element_at("scores", i + 1) / F.col("energy"))).alias("mean_scores"),
        F.count(F.lit(1)).alias("tile_count"),
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("phase").cast("int"))).alias("phases"),
        F.min("coverage").alias("min_coverage"),
    ).where(F.col("tile_count") >= min_tiles)

    def of(carrier: int) -> Column:
        return F.max(
            F.when(F.col("carrier") == carrier, F.struct("tile_count", "phases", "min_coverage", "mean_scores"))
        ).alias(f"c{carrier}")

    both = per_class.groupBy("image_id").agg(of(0), of(1)).where(F.col("c0").isNotNull() & F.col("c1").isNotNull())
    both = both.where(F.bit_count(F.col("c0.phases").bitwiseOR(F.col("c1.phases"))) >= min_phases)
    scores = F.concat(F.col("c0.mean_scores"), F.col("c1.mean_scores"))
    return both.select(
        "image_id",
        bits.bits_to_bytes(_sign_bits(scores), 16).alias("codeword"),
        byte_confidence(scores, 16).alias("confidences"),
        F.col("c0.tile_count").alias("tiles_a"),
        F.col("c1.tile_count").alias("tiles_b"),
        F.bit_count("c0.phases").alias("phases_a"),
        F.bit_count("c1.phases").alias("phases_b"),
        F.col("c0.min_coverage").alias("coverage_a"),
        F.col("c1.min_coverage").alias("coverage_b"),
        _mean_abs(F.col("c0.mean_scores")).alias("signal_a"),
        _mean_abs(F.col("c1.mean_scores")).alias("signal_b"),
    )


def byte_confidence(scores: Column, size: int) -> Column:
    """v / (1 + v) per byte, v = weakest absolute bit of the byte."""

    def one(i: Column) -> Column:
        weakest = F.array_min(F.transform(F.slice(scores, (i * 8 + 1).cast("int"), F.lit(8)), lambda s: F.abs(s)))
        return weakest / (F.lit(1.0) + weakest)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)


def soft_merge_v1(tiles: DataFrame, expected: DataFrame, max_errors: int = 4) -> DataFrame:
    """Sum raw tile scores per bit, read the sign, accept near the expected 64-bit code."""
    merged = (
        tiles.where(F.col("coverage") >= 0.70).groupBy("image_id")
        .agg(_per_bit(lambda i: F.sum(F.element_at("scores", i + 1).cast("double"))).alias("sums"), F.count(F.lit(1)).alias("tiles"))
        .where(F.col("tiles") >= 2)
        .withColumn("code", bits.bits_to_code(_sign_bits(F.col("sums"))))
    )
    joined = merged.join(expected.select("image_id", "trace_id", F.col("code").alias("wanted")), "image_id")
    errors = bits.hamming64(F.col("code"), F.col("wanted"))
    magic = bits.magic_distance(bits.high_bits(F.col("code"), 48))
    return joined.select(
        "image_id", "trace_id", "code", errors.alias("bit_errors"), magic.alias("magic_errors"), "tiles",
        (_mean_abs(F.col("sums")) / F.col("tiles")).alias("mean_abs_score"),
        ((errors <= max_errors) & (magic <= max_errors)).alias("accepted"),
    )


def phase_merge_v2(tiles: DataFrame, expected: DataFrame) -> DataFrame:
    """Average scores per phase (two tiles each at least) into a 24-byte observation; RS(24,8) rule.

    expected: image_id, trace_id, codeword (24 bytes).
    """
    phased = (
        tiles.where(F.col("coverage") >= 0.70).groupBy("image_id", "phase")
        .agg(_per_bit(lambda i: F.avg(F.element_at("scores", i + 1).cast("double"))).alias("mean"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= 2) & F.col("phase").between(0, 2))
        .groupBy("image_id")
        .agg(F.array_sort(F.collect_list(F.struct("phase", "n", "mean"))).alias("parts"))
        .where(F.size("parts") == 3)
    )
    scores = F.flatten(F.transform("parts", lambda p: p["mean"]))

    def confidence(i: Column) -> Column:
        sizes = F.array_sort(F.transform(F.slice(F.col("scores"), (i * 8 + 1).cast("int"), F.lit(8)), lambda s: F.abs(s)))
        median = (F.element_at(sizes, 4) + F.element_at(sizes, 5)) / 2
        return F.element_at(sizes, 1) / F.greatest(F.lit(1e-6), median)

    observed = pinned(phased, scores=scores).select(
        "image_id",
        bits.bits_to_bytes(_sign_bits(F.col("scores")), 24).alias("observed"),
        F.transform(F.sequence(F.lit(0), F.lit(23)), confidence).alias("confidences"),
        F.transform("parts", lambda p: p["n"]).alias("phase_tiles"),
        _mean_abs(F.col("scores")).alias("mean_abs_score"),
    )
    joined = observed.join(expected, "image_id")
    rule = codewords.acceptance_v2(F.col("observed"), F.col("codeword"), F.col("confidences"))
    return pinned(joined, r=rule).select(
        "image_id", "trace_id", "observed", F.col("r.accepted").alias("accepted"), F.col("r.bit_errors").alias("bit_errors"),
        F.col("r.erasure_count").alias("erasure_count"), F.col("r.corrected_symbols").alias("corrected_symbols"),
        F.col("r.method").alias("recovery_method"), "phase_tiles", "mean_abs_score",
    )


def clipped_merge_v3(tiles: DataFrame, expected: DataFrame, max_errors: int = 8, permuted: bool = True) -> DataFrame:
    """Scale each tile by its median, clip to +-3, undo the phase order, sum; compare with the tag bits.

    expected: image_id, trace_id, code (BIGINT of the 8-byte tag).
    """
    scale = F.greatest(F.lit(1e-6), vectors.median_abs(F.col("scores"), BITS))
    clipped = F.transform("scores", lambda s: F.greatest(F.lit(-3.0), F.least(F.lit(3.0), s.cast("double") / F.col("scale"))))
    rows = pinned(pinned(tiles.where(F.col("coverage") >= 0.70), scale=scale), scores=clipped)
    if permuted:
        rows = pinned(rows, scores=bits.to_logical_order(F.col("scores"), F.col("phase"), bits.PHASE_SEED_V3, 3))
    merged = (
        rows.groupBy("image_id")
        .agg(
            _per_bit(lambda i: F.sum(F.element_at("scores", i + 1))).alias("sums"),
            F.count(F.lit(1)).alias("tiles"),
            F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("phase").cast("int"))).alias("phases"),
        )
        .where((F.col("tiles") >= 2) & (F.bit_count("phases") >= 2))
    )
    joined = merged.join(expected, "image_id")
    errors = bits.hamming64(bits.bits_to_code(_sign_bits(F.col("sums"))), F.col("code"))
    signed = F.zip_with("sums", bits.code_bits(F.col("code")), lambda s, b: s * (b * 2 - 1))
    agreement = _array_sum(signed) / (F.col("tiles") * BITS)
    return joined.withColumn("bit_errors", errors).withColumn("agreement", agreement).select(
        "image_id", "trace_id", "bit_errors", "tiles", F.bit_count("phases").alias("phases"),
        F.col("agreement").alias("mean_signed_agreement"),
        (_mean_abs(F.col("sums")) / F.col("tiles")).alias("mean_abs_score"),
        ((F.col("bit_errors") <= max_errors) & (F.col("agreement") > 0)).alias("accepted"),
    )


def bit_majority(tiles: DataFrame) -> DataFrame:
    """Hard vote per bit over the tiles of an image; margin is |ones - zeros| / votes."""
    votes = (
        tiles.groupBy("image_id")
        .agg(
            _per_bit(lambda i: F.count_if(F.element_at("scores", i + 1) > 0)).alias("ones"),
            _per_bit(lambda i: F.count(F.element_at("scores", i + 1))).alias("votes"),
            F.count(F.lit(1)).alias("tiles"),
        )
        .where(F.col("tiles") >= 2)
    )
    ones_win = F.zip_with("ones", "votes", lambda o, n: F.when(o * 2 > n, F.lit(1)).otherwise(F.lit(0)))
    margins = F.zip_with("ones", "votes", lambda o, n: F.when(n > 0, F.abs(o * 2 - n) / n).otherwise(F.lit(0.0)))
    decided = F.size(F.filter("votes", lambda n: n > 0))
    return votes.select(
        "image_id", bits.bits_to_code(ones_win).alias("code"), (_array_sum(margins) / BITS).alias("confidence"), decided.alias("decided"), "tiles"
    )


# --- votes ---------------------------------------------------------------------------------------


def small_window_votes(windows: DataFrame) -> DataFrame:
    """Window scores to the winning trace of each query.

    windows: query_id, trace_id, persistent, by_short_code, marker_score, code_strength,
    short_strength, trace_score, tile_w, tile_h.
    """
    strength = F.greatest("code_strength", "short_strength")
    score = F.col("marker_score") * 0.40 + strength * 2.8 + F.greatest(F.lit(0.0), "trace_score") * 0.24
    area = F.least(F.lit(5.0), F.rint(F.col("tile_w") * F.col("tile_h") / F.lit(9216.0)))
    passed = windows.withColumn("score", score).where(
        (F.col("marker_score") >= 0.060) & (strength >= 0.005) & (F.col("trace_score") >= 0.020) & (F.col("score") >= 0.060)
        & (~F.col("by_short_code") | (F.col("trace_score") >= 0.034))
    )
    weight = (F.greatest(F.lit(1.0), F.col("score") * 10000) * F.greatest(F.lit(1.0), area)).cast("bigint")
    votes = passed.withColumn("weight", weight).groupBy("query_id", "trace_id").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("weight").alias("votes"),
        F.sum(F.col("score") * F.col("weight")).alias("weighted"), F.bool_or("persistent").alias("persistent"),
    )
    enough = F.when(F.col("persistent"), (F.col("hits") >= 10) & (F.col("votes") >= 36000)).otherwise(
        (F.col("hits") >= 5) & (F.col("votes") >= 24000)
    )
    return _winner(votes.where(enough).withColumn("strength", F.col("weighted") / F.col("votes")), "strength", text.confidence_small_crop)


def _winner(votes: DataFrame, strength: str, confidence) -> DataFrame:
    best = votes.groupBy("query_id").agg(
        F.max_by(F.struct("trace_id", "hits", "votes", strength), F.struct(F.col("votes"), F.col(strength), F.col("trace_id"))).alias("b")
    )
    return best.select("query_id", "b.trace_id", "b.hits", "b.votes", f"b.{strength}", confidence(F.col("b.votes")).alias("confidence"))


def dot_matrix_votes(windows: DataFrame) -> DataFrame:
    """windows: query_id, trace_id, strength, tile_size, distance. Most votes, then smallest distance."""
    weight = F.greatest(F.lit(1), (F.col("strength") * 100).cast("int")) * F.greatest(F.lit(1), F.floor(F.col("tile_size") / 32).cast("int"))
    votes = windows.withColumn("weight", weight).groupBy("query_id", "trace_id").agg(
        F.sum("weight").alias("votes"), F.min("distance").alias("distance"),
        (F.sum(F.col("strength") * F.col("weight")) / F.greatest(F.lit(1), F.sum("weight"))).alias("strength"),
    ).where((F.col("votes") >= 12) & (F.col("distance") <= 8))
    best = votes.groupBy("query_id").agg(
        F.min_by(F.struct("trace_id", "votes", "distance", "strength"), F.struct(-F.col("votes"), F.col("distance"), F.col("trace_id"))).alias("b")
    )
    return best.select("query_id", "b.*", text.confidence_dots(F.col("b.votes")).alias("confidence"))


def code_votes(hits: DataFrame, persistent: bool = False) -> DataFrame:
    """Votes counted inside each scale, then the best scale. hits: query_id, scale, trace_id, score, tiles."""
    weight = (F.greatest(F.lit(1.0), F.col("score") * 10000) * F.least(F.col("tiles"), F.lit(16))).cast("bigint")
    votes = hits.withColumn("weight", weight).groupBy("query_id", "scale", "trace_id").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("weight").alias("votes"), F.sum(F.col("score") * F.col("weight")).alias("w")
    ).withColumn("strength", F.col("w") / F.greatest(F.lit(1), F.col("votes")))
    if persistent:
        enough = ((F.col("hits") >= 2) & (F.col("votes") >= 30000)) | (F.col("votes") >= 23000)
    else:
        enough = (F.col("hits") >= 3) & (F.col("votes") >= 30000)
    capped = lambda v: F.least(F.lit(98), F.greatest(F.lit(75), v * 8 + 70)).cast("int")
    return _winner(votes.where(enough), "strength", capped)


# --- geometry ------------------------------------------------------------------------------------


def inlier_stats(points: DataFrame, max_error: float = 5.0) -> DataFrame:
    """Matched points (pair, qx, qy, tx, ty, homography) to inliers, ratio and median inlier error.

    ``accepted`` follows the matcher (18 inliers, ratio 0.32 or 256 inliers, error 5 px).
    """
    px, py = geometry.project(F.col("homography"), F.col("qx").cast("double"), F.col("qy").cast("double"))
    errors = points.withColumn("error", F.sqrt((px - F.col("tx")) ** 2 + (py - F.col("ty")) ** 2))
    errors = errors.withColumn("inlier", F.coalesce(F.col("error") <= max_error, F.lit(False)))
    errors = errors.withColumn("inlier_error", F.when(F.col("inlier"), F.col("error")))
    joined = errors.groupBy("pair").agg(F.count(F.lit(1)).alias("matches"), F.count_if("inlier").alias("inliers"), median("inlier_error").alias("median_error")).withColumn("ratio", F.col("inliers") / F.col("matches"))
    accepted = (F.col("inliers") >= 18) & ((F.col("ratio") >= 0.32) | (F.col("inliers") >= 256)) & (F.col("median_error") <= 5.0)
    return joined.withColumn("accepted", F.coalesce(accepted, F.lit(False)))


MAX_KEYPOINTS = 3072


def translation_vote(matches: DataFrame, tile_size: int = 128) -> DataFrame:
    """Matches with a known rotation and scale vote a translation per pair.

    matches: pair, query_kp, qx, qy, tx, ty, rotation_degrees, scale, offset_x, offset_y (NULL = no tile grid),
    query_width, query_height, target_width, target_height. Every match shifts its query point onto its target
    point. The shift with most others within 6 px (the first of equals) starts; the median of those, then of the
    ones within 5 px of it, is the translation, snapped to the tile grid. Pairs with fewer than 3 supporters at
    any point, or with an implausible transform, give no row.

    The matches of a pair lie together and are taken as arrays; its shifts are sorted by x, and a shift is compared with
    those of the strip around it only. A feature index holds at most MAX_KEYPOINTS points and each matches once, so a pair is bounded; larger
    inputs fail instead of being cut.
    """
    facts = ("rotation_degrees", "scale", "offset_x", "offset_y", "query_width", "query_height", "target_width", "target_height")
    turn, points = F.radians("rotation_degrees"), ("qx", "qy", "tx", "ty")
    sides = ("cos", "sin", *facts[4:])
    columns = [F.col(c).cast("double").alias(c) for c in (*points, *facts[2:])]
    rows = matches.select("pair", "query_kp", (F.cos(turn) / F.col("scale")).alias("cos"), (F.sin(turn) / F.col("scale")).alias("sin"), *columns)
    rows = rows.repartition(shuffle_partitions(matches.sparkSession), "pair").sortWithinPartitions("pair", "query_kp", *points)
    schema = "pair string, " + ", ".join(f"{c} double" for c in (*sides, "dx", "dy")) + ", good_matches int, inliers int, median_error double"

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(batches, "pair"):
            pair, kp = _starts(batch.column("pair")), batch.column("query_kp").to_numpy()
            if len(kp) and (kp.min() < 0 or kp.max() >= MAX_KEYPOINTS):
                raise ValueError("a feature index holds more keypoints than its contract allows")
            # A query keypoint counts once, by its least match.
            once = np.flatnonzero(pair | np.concatenate([[True], kp[1:] != kp[:-1]]))
            heads = np.flatnonzero(pair[once])
            sizes = np.diff(np.append(heads, len(once)))
            flat = {c: batch.column(c).to_numpy(zero_copy_only=False)[once] for c in (*points, "cos", "sin", *facts[2:4])}
            mx = flat["tx"] - (flat["cos"] * flat["qx"] - flat["sin"] * flat["qy"])
            my = flat["ty"] - (flat["sin"] * flat["qx"] + flat["cos"] * flat["qy"])
            kept, found = _voted_shifts(mx, my, sizes, [flat[c][heads] for c in facts[2:4]], float(tile_size))
            part = batch.take(pa.array(once[heads[kept]]))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("pair", *sides)] + [pa.array(f) for f in found], ["pair", *sides, "dx", "dy", "good_matches", "inliers", "median_error"])

    found = rows.mapInArrow(vote, schema)
    zero, one = F.lit(0.0), F.lit(1.0)
    found = found.withColumn("homography", F.array(F.col("cos"), -F.col("sin"), F.col("dx"), F.col("sin"), F.col("cos"), F.col("dy"), zero, zero, one))
    found = found.where(geometry.plausible_matched(F.col("homography"), *map(F.col, facts[4:])))
    return found.select("pair", "homography", "dx", "dy", "good_matches", "inliers", (F.col("inliers") / F.col("good_matches")).alias("ratio"), "median_error")


def _starts(keys: pa.Array) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys):
        return np.zeros(0, bool)
    return np.concatenate([[True], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])


def _whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows cut between runs of equal keys, so that no run lies in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(np.flatnonzero(_starts(batch.column(key)))[-1])
        if held and (last > 0 or batch.column(key)[0] != held[-1].column(key)[0]):
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        elif not held and last > 0:
            yield batch.slice(0, last)
        held.append(batch.slice(last) if last else batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# Compared shifts that are held at a time.
_COMPARED = 1 << 21


def _shift_gaps(mx: np.ndarray, my: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt((mx - x) * (mx - x) + (my - y) * (my - y))


def _supporters(mx: np.ndarray, my: np.ndarray, sizes: np.ndarray, radius: float) -> np.ndarray:
    """How many shifts of its own pair lie within the radius of each one; pairs follow one another."""
    pair = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((mx, pair))
    x, y, own = mx[order], my[order], pair[order]
    # Strips a little wider than the radius, found pair by pair where they are long, then the exact test.
    ends = np.cumsum(sizes)
    first, last = np.arange(len(x)), np.arange(len(x)) + 1
    for begin, end in zip((ends - sizes)[sizes > 1].tolist(), ends[sizes > 1].tolist(), strict=True):
        if end - begin <= 16:
            first[begin:end], last[begin:end] = begin, end
        else:
            part = x[begin:end]
            first[begin:end] = begin + np.searchsorted(part, part - radius * 1.001, "left")
            last[begin:end] = begin + np.searchsorted(part, part + radius * 1.001, "right")
    width = last - first
    counts = np.empty(len(x), np.int64)
    upto = np.cumsum(width)
    start = 0
    while start < len(x):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + _COMPARED, "right")))
        many = width[start:stop]
        left = np.repeat(np.arange(start, stop), many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + first[left]
        near = _shift_gaps(x[right], y[right], x[left], y[left]) <= radius
        counts[order[start:stop]] = np.bincount(left[near] - start, minlength=stop - start)
        start = stop
    return counts


def _medians(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Median of each group of values; a group without values gets NaN."""
    order = np.lexsort((values, group))
    n = np.bincount(group, minlength=groups)
    begin, some = np.cumsum(n) - n, n > 0
    out = np.full(groups, np.nan)
    low, high = (values[order[begin[some] + at[some]]] for at in ((n - 1) // 2, n // 2))
    out[some] = np.where(low == high, low, 0.5 * low + 0.5 * high)
    return out


def _voted_shifts(mx: np.ndarray, my: np.ndarray, sizes: np.ndarray, grid: list[np.ndarray], tile: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pairs with three supporters throughout, and dx, dy, matches, inliers and median error of each."""
    n = len(sizes)
    pair = np.repeat(np.arange(n), sizes)
    counts = _supporters(mx, my, sizes, 6.0)
    # The first of those with the most supporters, in keypoint order.
    best = np.lexsort((np.arange(len(mx)), -counts, pair))[np.cumsum(sizes) - sizes]
    x, y = mx[best], my[best]
    for radius in (6.0, 5.0):
        near = _shift_gaps(mx, my, x[pair], y[pair]) <= radius
        x, y = _medians(mx[near], pair[near], n), _medians(my[near], pair[near], n)
    enough = np.bincount(pair[near], minlength=n) >= 3
    gridded = ~np.isnan(grid[0].astype(float)) & ~np.isnan(grid[1].astype(float))
    x, y = (np.where(gridded, v + np.rint((s - v) / tile) * tile, s) for s, v in zip((x, y), (g.astype(float) for g in grid), strict=True))
    error = _shift_gaps(mx, my, x[pair], y[pair])
    inside = error <= 5.0
    inliers = np.bincount(pair[inside], minlength=n)
    kept = np.flatnonzero(enough & (inliers >= 3))
    middle = _medians(error[inside], pair[inside], n)
    return kept, [x[kept], y[kept], sizes[kept].astype(np.int32), inliers[kept].astype(np.int32), middle[kept]]


def _match_once(matches: DataFrame, points: tuple[str, ...], facts: tuple[str, ...]) -> DataFrame:
    """One row per query keypoint of a pair: its least match and the facts of the pair."""
    once = matches.groupBy("pair", "query_kp").agg(F.min(F.struct(*points)).alias("p"), *[F.first(c).alias(c) for c in facts])
    return once.where(F.assert_true(F.col("query_kp").between(0, MAX_KEYPOINTS - 1)).isNull())


def pair_rows(matches: DataFrame, points: tuple[str, ...], facts: tuple[str, ...]) -> DataFrame:
    """One row per pair: point arrays in keypoint order and the facts of the pair.

    Each query keypoint counts once and indexes stop at MAX_KEYPOINTS, so the arrays are bounded.
    """
    gathered = _match_once(matches, points, facts).groupBy("pair").agg(
        F.array_sort(F.collect_list(F.struct("query_kp", "p"))).alias("rows"), *[F.first(c).alias(c) for c in facts]
    )
    n = shuffle_partitions(matches.sparkSession)
    return gathered.repartition(n, "pair").select(
        "pair", *[F.transform(F.col(f"rows.p.{c}"), lambda v: v.cast("double")).alias(c) for c in points], *facts
    )


def visual_consistency() -> Column:
    """Rule on (inliers, ratio, residual): a standard match or a strong small crop."""
    standard = (F.col("inliers") >= 18) & (F.col("ratio") >= 0.32) & (F.col("residual") >= 0.08)
    strong = (F.col("inliers") >= 30) & (F.col("ratio") >= 0.65) & (F.col("residual") >= 0.06)
    return standard | strong


def _place(candidates: DataFrame) -> Column:
    """Ties go to the first record in listing order where the candidates carry it, else to the smaller id."""
    return F.col("position_index") if "position_index" in candidates.columns else F.col("record_id")


def residual_evidence(candidates: DataFrame) -> DataFrame:
    """Best consistent candidate per query by (residual, inliers, ratio), shown from residual 0.12."""
    best = candidates.where(F.col("robust_watermark") & visual_consistency()).groupBy("query_id").agg(
        F.min_by(
            F.struct("record_id", "trace_id", "inliers", "ratio", "residual"),
            F.struct(-F.col("residual"), -F.col("inliers"), -F.col("ratio"), _place(candidates)),
        ).alias("b")
    )
    return best.select("query_id", "b.*").where(F.col("residual") >= 0.12)


def visual_match_verdict(candidates: DataFrame) -> DataFrame:
    """Best robust record per query by (inliers, ratio); strong pairs also need residual 0.18."""
    strong = (F.col("inliers") >= 80) & (F.col("ratio") >= 0.80)
    kept = candidates.where(F.col("robust_watermark") & (~strong | (F.col("residual") >= 0.18)))
    best = kept.groupBy("query_id").agg(
        F.min_by(
            F.struct("record_id", "inliers", "ratio", "residual"),
            F.struct(-F.col("inliers"), -F.col("ratio"), _place(candidates)),
        ).alias("b")
    )
    return best.select("query_id", "b.*").where(strong).withColumn("confidence", text.confidence_residual(F.col("residual")))


def layer_snr(values: DataFrame) -> DataFrame:
    """Signed coefficients (image_id, trace_id, value, sign) to max(0, mean/(std + 1e-6)); 16 blocks at least."""
    signed = F.col("value") * F.col("sign")
    stats = values.groupBy("image_id", "trace_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(signed).alias("m"), F.stddev_pop(signed).alias("s")
    )
    score = F.when(F.col("n") < 16, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("m") / (F.col("s") + 1e-6)))
    return stats.select("image_id", "trace_id", "n", score.alias("score"))


def spectrum_snr(values: DataFrame) -> DataFrame:
    """Magnitudes (image_id, trace_id, value, selected) to (mean selected - mean rest) / std rest."""
    picked, rest = F.when(F.col("selected"), F.col("value")), F.when(~F.col("selected"), F.col("value"))
    stats = values.groupBy("image_id", "trace_id").agg(
        F.count(picked).alias("n"), F.avg(picked).alias("a"), F.avg(rest).alias("b"), F.stddev_pop(rest).alias("s")
    )
    score = F.when(F.col("n") < 10, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (F.col("a") - F.col("b")) / (F.col("s") + 1e-6)))
    return stats.select("image_id", "trace_id", "n", score.alias("score"))


def bright_ratio(pixels: DataFrame, limit: int = 205, threshold: float = 0.05) -> DataFrame:
    """Gray histogram (image_id, gray, n) to the share of bright pixels."""
    share = F.sum(F.when(F.col("gray") >= limit, F.col("n")).otherwise(F.lit(0))) / F.sum("n")
    return pixels.groupBy("image_id").agg(share.alias("bright_ratio")).withColumn("bright", F.col("bright_ratio") >= threshold)


def signal_match(windows: DataFrame, patterns: DataFrame, markers: DataFrame) -> DataFrame:
    """Correlate window signals with candidate patterns behind the marker gate of 0.055.

    windows: query_id, window_id, signal; patterns: query_id, trace_id, pattern (the candidates of
    that query); markers: marker (one row). Score = 0.7 marker + 0.3 best. A query with many windows and patterns
    is compared in blocks, of which each returns the two best patterns of a window.
    """
    size = F.size("signal")
    gated = windows.join(F.broadcast(markers.limit(1))).withColumn(
        "marker_score", vectors.dot(F.col("signal"), F.col("marker")) / size
    ).where(F.col("marker_score") >= 0.055).drop("marker")

    def two_best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "window_id", "marker_score", "trace_id", "pattern_score"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        right = right.sort_values("trace_id")
        signal = np.stack([np.asarray(v, np.float64) for v in left.signal])
        scores = signal @ np.stack([np.asarray(v, np.float64) for v in right.pattern]).T / signal.shape[1]
        order = np.argsort(-scores, axis=1, kind="stable")[:, :2]
        row = np.repeat(np.arange(len(left)), order.shape[1])
        out = left[["query_id", "window_id", "marker_score"]].iloc[row].reset_index(drop=True)
        return out.assign(trace_id=right.trace_id.to_numpy()[order.ravel()], pattern_score=scores[row, order.ravel()])[columns]

    types = {c: frame.schema[c].dataType.simpleString() for frame in (windows, patterns) for c in frame.columns}
    schema = f"query_id {types['query_id']}, window_id {types['window_id']}, marker_score double, trace_id {types['trace_id']}, pattern_score double"
    scored = blocked_pairs(gated, patterns.select("query_id", "trace_id", "pattern"), "query_id", "window_id", "trace_id", two_best, schema)
    two = top_rows(scored, ["query_id", "window_id"], [F.col("pattern_score").desc(), F.col("trace_id")], 2)
    return two.groupBy("query_id", "window_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("trace_id"))).alias("trace_id"),
        (F.first("marker_score") * 0.7 + F.max(F.when(F.col("rank") == 1, F.col("pattern_score"))) * 0.3).alias("score"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("pattern_score"))), F.lit(-1.0)).alias("second_score"),
    )


# --- verdicts ------------------------------------------------------------------------------------


def unique_outcome(hits: DataFrame, queries: DataFrame, nothing: str = "not_found") -> DataFrame:
    """Distinct authenticated records per query to success / ambiguous / nothing; only success shows one.

    With ``n_records`` a row of hits stands for so many records, of which it names the least; no two rows of a query share one.
    """
    from provena.operators.matching import outcome_columns

    n = F.sum("n_records") if "n_records" in hits.columns else F.countDistinct("record_id")
    counts = hits.groupBy("query_id").agg(n.alias("n"), F.min("record_id").alias("r"))
    return outcome_columns(queries.select("query_id").distinct().join(counts, "query_id", "left"), "n", "r", nothing)


def thumbnail_distance(pairs: DataFrame) -> DataFrame:
    """Mean absolute difference of two 1024-byte thumbnails over 255 (query_thumb, target_thumb)."""

    @F.pandas_udf("double")
    def distance(left: pd.Series, right: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(map(bytes, left)), np.uint8).reshape(len(left), -1).astype(np.float64)
        b = np.frombuffer(b"".join(map(bytes, right)), np.uint8).reshape(len(right), -1).astype(np.float64)
        return pd.Series(np.abs(a - b).mean(axis=1) / 255.0)

    return pairs.withColumn("thumbnail_distance", distance("query_thumb", "target_thumb"))


def aligned_verdict(decoded: DataFrame, candidate_limit: int = 8) -> DataFrame:
    """Decodes of up to 8 ranked candidates: exactly one authenticated record and trace, else nothing.

    decoded: query_id, record_id, trace_id, candidate_rank, version, accepted, bit_errors.
    """
    methods = F.create_map(
        F.lit(1), F.lit("homography_aligned_robust_64"),
        F.lit(2), F.lit("homography_aligned_rs_24_8_three_phase"),
        F.lit(3), F.lit("homography_aligned_hmac64_full_repeat_v3"),
    )
    good = decoded.where((F.col("candidate_rank") <= candidate_limit) & F.col("accepted"))
    one = good.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("record_id", "trace_id", "version", "bit_errors")).alias("b")
    ).where(F.col("n") == 1)
    return one.select(
        "query_id", "b.record_id", "b.trace_id", "b.bit_errors",
        text.confidence_aligned(F.col("b.bit_errors")).alias("confidence"),
        F.coalesce(F.try_element_at(methods, F.col("b.version")), F.element_at(methods, F.lit(1))).alias("method"),
    )


def blind_code_pick(scans: DataFrame, registry: DataFrame) -> DataFrame:
    """Grid readings (query_id, code, confidence) that equal a record code; the most confident one."""
    from provena.operators.hamming import exact_code_lookup

    readings = scans.groupBy("query_id", "code").agg(F.max("confidence").alias("confidence"))
    hits = exact_code_lookup(readings.withColumnRenamed("code", "observed").withColumn("query_id", F.struct("query_id", "confidence")), registry)
    best = hits.groupBy("query_id.query_id").agg(
        F.max(F.struct(F.col("query_id.confidence").alias("confidence"), F.col("trace_id"))).alias("b")
    )
    shown = F.least(F.lit(98), F.greatest(F.lit(75), (F.col("b.confidence") * 100).cast("int")))
    return best.where(F.col("b.confidence") >= 0.08).select("query_id", "b.trace_id", shown.alias("confidence"))


def best_evidence(refinements: DataFrame) -> DataFrame:
    """Best refinement per (query, candidate): fewest bit errors, corrections, erasures, highest score."""
    order = F.struct("bit_errors", "corrected_symbols", "erasure_count", (-F.col("mean_abs_score")).alias("s"), "refinement")
    best = refinements.groupBy("query_id", "record_id").agg(
        F.min_by(F.struct("refinement", "bit_errors", "corrected_symbols", "erasure_count", "mean_abs_score"), order).alias("b")
    )
    return best.select("query_id", "record_id", "b.*")


# --- ranking -------------------------------------------------------------------------------------


def rank_with_reserved_seat(candidates: DataFrame, recent: DataFrame, limit: int = 3) -> DataFrame:
    """Two best by (matches, quality, thumbnail, id) and one reserved seat from the recent list.

    candidates: query_id, record_id, match_count, match_quality, thumbnail_distance.
    recent: query_id, record_id, recency (0 = newest).
    """
    order = [F.col("match_count").desc(), F.col("match_quality").desc(), F.col("thumbnail_distance"), F.col("record_id")]
    top = top_rows(candidates, ["query_id"], order, min(2, limit)).withColumn("reserved", F.lit(False))
    if limit <= 2:
        return top
    rest = candidates.join(recent, ["query_id", "record_id"]).join(top.select("query_id", "record_id"), ["query_id", "record_id"], "left_anti")
    seat = rest.groupBy("query_id").agg(F.min_by(F.struct(*candidates.columns), F.struct("recency", "record_id")).alias("b"))
    seat = seat.select("b.*", F.lit(3).alias("rank"), F.lit(True).alias("reserved"))
    return top.unionByName(seat)


def rank_three_tiers(candidates: DataFrame, min_good: int = 12, reserve: int = 2) -> DataFrame:
    """Full candidate order per query: strong matches, then recent records, then aspect-ratio distance.

    candidates: query_id, record_id, trace_id, position_index, good_matches, quality, recency (NULL
    when not recent), ratio_distance (NULL when unknown). Nothing is cut; ranks are assigned by
    range partitioning, so one query with very many candidates is not one task.
    """
    strong = F.col("good_matches") >= min_good
    strong_traces = candidates.where(strong).select("query_id", "trace_id").distinct().withColumn("_s", F.lit(True))
    marked = candidates.join(strong_traces, ["query_id", "trace_id"], "left")
    recent = ~strong & F.col("_s").isNull() & (F.col("recency") < reserve)
    pool = top_rows(marked.where(F.coalesce(recent, F.lit(False))), ["query_id"], [F.col("recency"), F.col("position_index")], reserve, "_seat")
    marked = marked.join(pool.select("query_id", "record_id", "_seat"), ["query_id", "record_id"], "left")
    tier = F.when(strong, F.lit(1)).when(F.col("_seat").isNotNull(), F.lit(2)).otherwise(F.lit(3))
    infinity = F.lit(float("inf"))
    keyed = marked.withColumn("tier", tier).select(
        *candidates.columns, "tier",
        F.when(F.col("tier") == 1, -F.col("good_matches").cast("double")).when(F.col("tier") == 2, F.col("recency").cast("double"))
        .otherwise(F.coalesce("ratio_distance", infinity)).alias("_k1"),
        F.when(F.col("tier") == 1, -F.col("quality")).otherwise(F.lit(0.0)).alias("_k2"),
    )
    return ranked(keyed, ["query_id"], ["tier", "_k1", "_k2", "position_index"]).drop("_k1", "_k2")


def recent_candidates(session: DataFrame, records: DataFrame, limit: int = 4, reserve: int = 2) -> DataFrame:
    """First 4 recent traces: the session list in order, then records with a creation time in record order.

    session: query_id, trace_id, session_order. records: query_id, trace_id, position_index, created_at.
    """
    listed = session.select("query_id", "trace_id", F.lit(0).alias("source"), F.col("session_order").cast("bigint").alias("place"))
    stored = records.where((F.coalesce("trace_id", F.lit("")) != "") & (F.coalesce(F.col("created_at").cast("string"), F.lit("")) != ""))
    stored = stored.select("query_id", "trace_id", F.lit(1).alias("source"), F.col("position_index").cast("bigint").alias("place"))
    first = listed.unionByName(stored).groupBy("query_id", "trace_id").agg(F.min(F.struct("source", "place")).alias("k"))
    top = top_rows(first, ["query_id"], [F.col("k.source"), F.col("k.place"), F.col("trace_id")], limit)
    return top.select("query_id", "trace_id", (F.col("rank") - 1).alias("recency"), (F.col("rank") <= reserve).alias("reserved"))


def first_hit_precedence(evidence: DataFrame) -> DataFrame:
    """Detector rows (query_id, record_id, priority, confidence, evidence): the earliest detector wins."""
    best = evidence.groupBy("query_id").agg(
        F.min_by(F.struct("record_id", "priority", "confidence", "evidence"), F.struct("priority", F.col("confidence") * -1, "record_id")).alias("b")
    )
    return best.select("query_id", "b.*")


def keypoint_quota(points: DataFrame, limit: int = 3072, grid: int = 8, octaves: int = 8, per_octave: int = 6) -> DataFrame:
    """Spatially balanced keypoints of each image in output order.

    points: image_id, kp_idx, x, y, response, octave, width, height. The detector order bounds an
    image to 4*limit rows, so every window below is over a bounded group.
    """
    quota = limit // (grid * grid)
    column = F.least(F.lit(grid - 1), F.floor(F.col("x") * grid / F.col("width")).cast("int"))
    row = F.least(F.lit(grid - 1), F.floor(F.col("y") * grid / F.col("height")).cast("int"))
    strongest = [F.col("response").desc(), F.col("kp_idx")]
    placed = (
        points.where(F.col("kp_idx") < 4 * limit)
        .withColumn("_cell", row * grid + column)
        .withColumn("_oct", F.least(F.lit(octaves - 1), F.greatest(F.lit(0), F.col("octave"))))
        .withColumn("_r", F.row_number().over(Window.partitionBy("image_id", "_cell", "_oct").orderBy(*strongest)))
    )
    first = F.col("_r") <= per_octave
    cell = Window.partitionBy("image_id", "_cell")
    placed = placed.withColumn("_n1", F.count_if(first).over(cell)).withColumn(
        "_r2", F.row_number().over(Window.partitionBy("image_id", "_cell", first).orderBy(*strongest))
    )
    pick = F.when(first, F.lit(1)).when(F.col("_r2") <= quota - F.col("_n1"), F.lit(2)).otherwise(F.lit(3))
    placed = placed.withColumn("selection_pass", pick).withColumn(
        "rank", F.row_number().over(Window.partitionBy("image_id").orderBy("selection_pass", *strongest))
    )
    return placed.where(F.col("rank") <= limit).select("image_id", "kp_idx", "selection_pass", "rank")


def cut_lineage(frame: DataFrame) -> DataFrame:
    """The rows as a table of their own, which ``discard`` deletes at once; the files of a checkpoint stay until a collection."""
    return written(frame)


# Boxes whose pairs are looked for at a time.
SLICE_BOXES = 1 << 24


def suppress_overlaps(boxes: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Greedy overlap suppression per (image, kind) in rounds over a spatial join.

    boxes: image_id, kind, box_id, confidence, left, top, right, bottom (integers). A box is accepted
    once no stronger undecided box overlaps it, and dropped once an accepted one does; this gives
    the sequential result. Equal boxes are collapsed first. Boxes with IoU >= t have widths within
    1/t and left edges within one width, so a join on a size class and a grid cell finds all pairs, each once.
    Boxes are numbered by strength, and what is overlapped moves as pairs of numbers.

    Images and kinds don't touch each other: of very many boxes, slices of them are settled one after another, each of
    which leaves the boxes it keeps on the disks and nothing else.
    """
    slices = max(1, math.ceil(boxes.count() / SLICE_BOXES))
    if slices == 1:
        return _strongest(boxes, threshold)[0]
    own, kept = F.pmod(F.xxhash64("image_id", "kind"), F.lit(slices)), None
    for number in range(slices):
        accepted, scratch = _strongest(boxes.where(own == number), threshold)
        accepted = written(accepted)
        discard(*scratch)
        kept = accepted if kept is None else kept.unionByName(accepted)
    return kept


def _strongest(boxes: DataFrame, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """Boxes that ``suppress_overlaps`` keeps, and the tables that they are read from."""
    place = ["image_id", "kind", "left", "top", "right", "bottom"]
    order = F.struct((-F.col("confidence")).alias("c"), F.col("box_id").alias("i"))
    placed = boxes.groupBy(*place).agg(F.min(order).alias("o")).repartitionByRange(shuffle_partitions(boxes.sparkSession), "o", *place)
    # The smaller the number, the stronger the box; only the order counts.
    distinct = cut_lineage(placed.sortWithinPartitions("o", *place).withColumn("n", F.monotonically_increasing_id()))

    def cells(frame: DataFrame, spread: bool, prefix: str) -> DataFrame:
        """Rows at their own (size class, cell), or at every one where a partner that is no wider may sit.

        A partner's side is within a factor ``threshold`` and its edge within (1 - threshold) of the
        larger side, which bounds both ranges to two or three entries an axis. A size class holds sides of a factor of
        four, and a cell is eight of its least sides long: few copies of a box, and few strangers in its cells.
        """
        rows = frame
        for axis, low, high in (("x", "left", "right"), ("y", "top", "bottom")):
            side = F.greatest(F.lit(1), F.col(high) - F.col(low)).cast("double")
            level = lambda v: F.floor(F.log2(v) / 2).cast("int")
            classes = F.sequence(level(side * threshold), level(side if axis == "x" else side / threshold)) if spread else F.array(level(side))
            rows = rows.withColumn(f"k{axis}", F.explode(classes))
            span = F.pow(F.lit(4.0), F.col(f"k{axis}")) * 8
            larger = side if axis == "x" else F.greatest(span / 2, side)
            reach = larger * (1 - threshold) if spread else F.lit(0.0)
            at = lambda v: F.floor(v / span).cast("bigint")  # noqa: B023, E731
            rows = rows.withColumn(f"c{axis}", F.explode(F.sequence(at(F.col(low) - reach), at(F.col(low) + reach))))
        # Rows meet by a hash of their cell; whether they share an image and a kind is asked again.
        cell = F.xxhash64(*place[:2], "kx", "ky", "cx", "cy").alias("cell")
        return rows.select(cell, *[F.col(c).alias(f"{prefix}{c}") for c in (*place, "n")])

    a, b = cells(distinct, False, "a_"), cells(distinct, True, "b_")
    iw = F.greatest(F.lit(0), F.least("a_right", "b_right") - F.greatest("a_left", "b_left"))
    ih = F.greatest(F.lit(0), F.least("a_bottom", "b_bottom") - F.greatest("a_top", "b_top"))
    area = lambda p: (F.col(f"{p}right") - F.col(f"{p}left")) * (F.col(f"{p}bottom") - F.col(f"{p}top"))
    inter = iw * ih
    iou = inter / F.greatest(F.lit(1), area("a_") + area("b_") - inter)
    gap = (F.col("b_right") - F.col("b_left")) - (F.col("a_right") - F.col("a_left"))
    # The wider box looks for the other; of equal ones, the weaker.
    once = (gap > 0) | ((gap == 0) & (F.col("a_n") < F.col("b_n")))
    same = (F.col("a_image_id") == F.col("b_image_id")) & (F.col("a_kind") == F.col("b_kind"))
    edges = a.join(b, "cell").where(same & once & (inter > 0) & (iou >= threshold))
    edges = cut_lineage(edges.select(F.least("a_n", "b_n").alias("strong"), F.greatest("a_n", "b_n").alias("weak")))
    end = lambda frame, name: frame.select(F.col(name).alias("n")).distinct()
    lost: DataFrame | None = None
    scratch = [distinct]
    # Each round settles the strongest undecided box of every chain, so the rounds end.
    while not edges.isEmpty():
        # A strong end that nothing blocks is accepted, so its weak ends are lost.
        blocked = end(edges, "weak").withColumnRenamed("n", "strong").withColumn("_b", F.lit(True))
        marked = edges.join(blocked, "strong", "left")
        beaten = cut_lineage(end(marked.where(F.col("_b").isNull()), "weak"))
        scratch.append(beaten)
        lost = beaten if lost is None else lost.unionByName(beaten)
        rest = marked.where(F.col("_b")).drop("_b")
        for name in ("strong", "weak"):
            rest = rest.join(beaten.withColumnRenamed("n", name), name, "left_anti")
        before, edges = edges, cut_lineage(rest.select("strong", "weak"))
        discard(before)
    discard(edges)
    accepted = distinct if lost is None else distinct.join(lost, "n", "left_anti")
    shown = accepted.select(
        "image_id", "kind", F.col("o.i").alias("box_id"), (-F.col("o.c")).alias("confidence"), "left", "top", "right", "bottom"
    )
    return shown, scratch
