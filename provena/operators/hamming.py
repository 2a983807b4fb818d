"""Nearest codes and descriptors by Hamming distance, in bounded blocks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from provena.functions import bits, codewords
from provena.operators.scale import blocked_pairs
from provena.session import cut_lineage, shuffle_partitions

# Bands of a code: at least this many bits, so that few bands are needed, and at most so many that flips stay listable.
BAND_BITS = (8, 20)


def _signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def code_bands(varying: int, count: int) -> list[list[int]]:
    """Bit positions of each band: about log2(count) bits, so that a bucket holds about one code."""
    places = [i for i in range(64) if varying >> i & 1]
    width = min(max(math.ceil(math.log2(max(count, 2))), BAND_BITS[0]), BAND_BITS[1])
    bands = max(1, math.ceil(len(places) / width))
    return [places[j::bands] for j in range(bands)]


def likely_radius(bits: int, bands: int, count: int) -> int:
    """Radius by which a random code has probably met its two nearest of ``count`` random ones."""
    share, distance = 2.0**-bits, 0
    while distance < bits and count * share < 4:
        distance += 1
        share += math.comb(bits, distance) * 2.0**-bits
    return max(0, math.ceil((distance + 1) / bands) - 1)


def _flips(places: list[int], radius: int) -> np.ndarray:
    """All values with ``radius`` of the given bits set."""
    out = [sum(1 << i for i in picked) for picked in itertools.combinations(places, radius)]
    return np.array(out, np.uint64)


def _band_value(code: Column, places: list[int]) -> Column:
    """Bits of a band, packed: the first place is the lowest bit."""
    return reduce(Column.bitwiseOR, [F.shiftleft(F.shiftright(code, i).bitwiseAND(F.lit(1).cast("bigint")), k) for k, i in enumerate(places)], F.lit(0).cast("bigint"))


# Bits of a stored value bitmap row, as Spark's bitmap aggregates make it.
_BITMAP_BITS = 32768


def _stored_values(index: DataFrame, bands: list[list[int]]) -> list[bytes]:
    """For each band a bitmap of the values that stored codes have in it: at most 2^20 bits, as bands are no wider."""
    bucket = F.shiftright("value", 15).alias("bucket")
    rows = index.groupBy("band", bucket).agg(F.bitmap_construct_agg(F.col("value").bitwiseAND(F.lit(_BITMAP_BITS - 1).cast("bigint"))).alias("bits")).collect()
    out = [bytearray(max(_BITMAP_BITS, 1 << len(places)) // 8) for places in bands]
    for row in rows:
        start = row["bucket"] * _BITMAP_BITS // 8
        out[row["band"]][start : start + _BITMAP_BITS // 8] = row["bits"]
    return [bytes(x) for x in out]


def _probes(batches: Iterator[pa.RecordBatch], bands: list[list[int]], radii: list[int], stored: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Every value of each band within the radii of an observed code that a stored code has there."""
    known = [np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little").view(bool) for x in stored]
    lists = [(b, _flips(list(range(len(places))), r)) for b, places in enumerate(bands) for r in radii if r <= len(places)]
    for batch in batches:
        codes = batch.column("observed").to_numpy().view(np.uint64)
        packed = [sum(((codes >> np.uint64(i) & np.uint64(1)) << np.uint64(k) for k, i in enumerate(places)), np.zeros(len(codes), np.uint64)) for places in bands]
        for band, flips in lists:
            step = max(1, (1 << 18) // len(flips))
            for start in range(0, len(codes), step):
                values = packed[band][start : start + step, None] ^ flips[None]
                row, column = np.nonzero(known[band][values])
                arrays = [codes[start + row].view(np.int64), np.full(len(row), band, np.int32), values[row, column].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["observed", "band", "value"])


# What is known of a query is three numbers: its nearest code as distance, rank and whether there are copies, the same with
# the largest rank among the nearest, and one bit a distance that was seen. Each is a minimum or a union, so that it
# does not matter how often a pair meets.
_RANKS = (1 << 55) - 1


def _met(asked: DataFrame, index: DataFrame, bands: list[list[int]], radii: list[int], stored: list[bytes]) -> DataFrame:
    """What each asked code learns from the stored codes in which it meets a band within the radii."""
    probes = asked.mapInArrow(lambda batches: _probes(batches, bands, radii, stored), "observed bigint, band int, value bigint")
    # Probes are many times what Spark takes them for, by the size of the codes that they come from.
    pairs = probes.hint("merge").join(index, ["band", "value"])
    pairs = pairs.withColumn("distance", F.bit_count(F.col("observed").bitwiseXOR(F.col("code"))))
    near = F.shiftleft(F.col("distance").cast("bigint"), 56)
    return pairs.groupBy("observed").agg(
        F.min(near + F.shiftleft("rank", 1) + F.col("copied")).alias("_low"), F.min(near + F.shiftleft(F.lit(_RANKS) - F.col("rank"), 1)).alias("_high"),
        F.bit_or(F.when(F.col("distance") > 0, F.expr("shiftleft(1L, CAST(distance - 1 AS INT))")).otherwise(F.lit(0).cast("bigint"))).alias("_seen"),
    )


def nearest_codes(observed: DataFrame, registry: DataFrame, none_distance: int = 65) -> DataFrame:
    """For every distinct observed code: best trace, best and second-best distance over the registry.

    registry: trace_id, code, position. Equal codes are collapsed on both sides first, so copies
    cost nothing; ties go to the smallest position. With fewer than two records the missing
    distance is ``none_distance``; an empty registry gives no rows.

    Bits in which all stored codes agree add the same to every distance. The others are cut into bands, and both
    sides meet by equal bands at a growing radius: after radius r, every stored code that differs in less than
    bands * (r + 1) of them has been met. A query is closed once its second best lies within that. Pairs are reduced
    as they meet, never sorted.
    """
    spark = observed.sparkSession
    codes = cut_lineage(observed.select("observed").where(F.col("observed").isNotNull()).distinct())
    stored = registry.where(F.col("code").isNotNull()).groupBy("code").agg(F.min(F.struct("position", "trace_id")).alias("_f"), F.count(F.lit(1)).alias("copies"))
    stored = stored.select("code", "copies", F.col("_f.position").alias("position"), F.col("_f.trace_id").alias("trace_id"))
    # Ranks follow the positions; only their order counts.
    placed = stored.repartitionByRange(shuffle_partitions(spark), "position", "code").sortWithinPartitions("position", "code")
    stored = cut_lineage(placed.withColumn("rank", F.monotonically_increasing_id()))
    facts = stored.agg(F.count(F.lit(1)), F.sum("copies"), F.expr("bit_and(code)"), F.expr("bit_or(code)")).first()
    if not facts[0]:
        shape = "observed bigint, best_trace string, best_distance int, second_distance int"
        return spark.createDataFrame([], shape)
    varying = (facts[2] ^ facts[3]) & 0xFFFFFFFFFFFFFFFF
    bands = code_bands(varying, facts[0])
    same = F.bit_count(F.col("observed").bitwiseXOR(F.lit(facts[2])).bitwiseAND(F.lit(_signed(~varying & 0xFFFFFFFFFFFFFFFF))))
    copied = (F.col("copies") > 1).cast("bigint").alias("copied")
    values = [F.struct(F.lit(b).alias("band"), _band_value(F.col("code"), places).alias("value")) for b, places in enumerate(bands)]
    index = cut_lineage(stored.select("code", "rank", copied, F.inline(F.array(*values))))
    known = _stored_values(index, bands)

    none = F.lit(None).cast("bigint")
    state = codes.withColumns({"low": none, "high": none, "seen": F.lit(0).cast("bigint"), "open": F.lit(True)})
    rank = F.shiftright("low", 1).bitwiseAND(F.lit(_RANKS))
    best = F.shiftright("low", 56).cast("int")
    alone = (rank == F.lit(_RANKS) - F.shiftright("high", 1).bitwiseAND(F.lit(_RANKS))) & (F.col("low").bitwiseAND(F.lit(1).cast("bigint")) == 0)
    # Bit d - 1 stands for distance d: the lowest of those above the best distance.
    above = F.when(best < 64, F.col("seen").bitwiseAND(F.expr("shiftleft(-1L, CAST(shiftright(low, 56) AS INT))")))
    lowest = F.when(F.col("_above") == F.lit(-(1 << 63)), F.lit(64)).when(F.col("_above") != 0, F.bit_count(F.bitwise_not("_above").bitwiseAND(F.expr("try_subtract(_above, 1L)"))) + 1)
    runner = F.when(~alone, best).otherwise(F.col("_next"))
    needed = runner if facts[1] > 1 else best
    with_next = lambda frame: frame.withColumn("_above", above).withColumn("_next", lowest)
    widest, radii = max(map(len, bands)), [0, 1]
    likely = likely_radius(varying.bit_count(), len(bands), facts[0])
    while True:
        asked = state.where("open").select("observed").repartition(shuffle_partitions(spark), "observed")
        both = state.join(_met(asked, index, bands, list(radii), known), "observed", "left").select(
            "observed", F.least("low", "_low").alias("low"), F.least("high", "_high").alias("high"), F.col("seen").bitwiseOR(F.coalesce("_seen", F.lit(0).cast("bigint"))).alias("seen"), "open"
        )
        reached = len(bands) * (radii[-1] + 1) - 1
        open_ = F.coalesce(needed - same > reached, F.lit(True)) if radii[-1] < widest else F.lit(False)
        state = cut_lineage(with_next(both).withColumn("open", F.col("open") & open_).drop("_above", "_next"))
        if radii[-1] >= widest or state.where("open").isEmpty():
            break
        # What is not near a stored code is about as far as a random one.
        radii = list(range(radii[-1] + 1, min(widest, max(likely, radii[-1] + 1)) + 1))
    found = with_next(state).select("observed", rank.alias("rank"), best.alias("best_distance"), F.coalesce(runner, F.lit(none_distance)).alias("second_distance"))
    return found.join(stored.select("rank", F.col("trace_id").alias("best_trace")), "rank", "left").select("observed", "best_trace", "best_distance", "second_distance")


def best_second_gap(near: DataFrame) -> DataFrame:
    return near.withColumn("gap", F.col("second_distance") - F.col("best_distance"))


def hamming_nearest(observed: DataFrame, registry: DataFrame, max_errors: int = 18, magic_errors: int = 6) -> DataFrame:
    """Nearest 64-bit code: gated on the magic, accepted within ``max_errors``, minimum always shown."""
    gate = bits.magic_distance(bits.high_bits(F.col("observed"), 48)) <= magic_errors
    passed = observed.where(gate)
    near = nearest_codes(passed, registry)
    return observed.select("query_id", "observed").join(near, "observed", "left").select(
        "query_id",
        F.when(F.col("best_distance") <= max_errors, F.col("best_trace")).alias("trace_id"),
        F.coalesce("best_distance", F.lit(65)).alias("distance"),
    )


def exact_code_lookup(observed: DataFrame, registry: DataFrame) -> DataFrame:
    """64-bit code equality behind the magic gate; the first record of a shared code wins."""
    first = registry.groupBy("code").agg(F.min(F.struct("position", "trace_id")).alias("_f"))
    gate = bits.high_bits(F.col("observed"), 48) == bits.MAGIC
    return observed.where(gate).join(first, observed["observed"] == first["code"]).select(
        "query_id", F.col("_f.trace_id").alias("trace_id")
    )


@dataclass(frozen=True)
class PayloadGates:
    magic: int
    checksum: int
    distance: int
    total: int
    gap: int | None


# Acceptance limits of the three payload layers.
SMALL_CROP = PayloadGates(3, 12, 10, 28, 3)
CODE_LAYER = PayloadGates(2, 12, 7, 24, 4)
DOT_MATRIX = PayloadGates(4, 10, 8, 24, None)


def payload_gate_columns(observed: DataFrame, gates: PayloadGates, checksum=codewords.checksum16) -> DataFrame:
    """Adds magic and checksum distances to rows with a 48-bit payload and keeps rows inside both gates."""
    payload = F.col("payload")
    magic = F.bit_count(F.shiftright(payload, 32).bitwiseXOR(F.lit(bits.MAGIC).cast("bigint")))
    gated = observed.withColumn("magic_distance", magic).where(F.col("magic_distance") <= gates.magic)
    check = F.bit_count(payload.bitwiseAND(F.lit(65535).cast("bigint")).bitwiseXOR(checksum(F.shiftright(payload, 16))))
    return gated.withColumn("checksum_distance", check).where(F.col("checksum_distance") <= gates.checksum)


def gated_payload_match(observed: DataFrame, registry: DataFrame, gates: PayloadGates, checksum=codewords.checksum16) -> DataFrame:
    """Payload (query_id, payload, corrections) to record: all gates, then best and second-best distance."""
    passed = payload_gate_columns(observed, gates, checksum)
    near = best_second_gap(
        nearest_codes(passed.select(F.col("payload").alias("observed")), registry, none_distance=49)
    )
    joined = passed.join(near, passed["payload"] == near["observed"])
    total = F.col("best_distance") + F.col("magic_distance") + F.col("checksum_distance") + F.col("corrections")
    ok = (F.col("best_distance") <= gates.distance) & (total <= gates.total)
    if gates.gap is not None:
        ok = ok & (F.col("gap") >= gates.gap)
    return joined.select(
        "query_id",
        F.when(ok, F.col("best_trace")).alias("trace_id"),
        "best_distance",
        "second_distance",
        total.alias("total_distance"),
    )


def short_code_match(observed: DataFrame, registry: DataFrame, persistent: bool = False) -> DataFrame:
    """16-bit short codes: distance and gap limits (4, 2) for recent and (2, 3) for persistent records."""
    max_errors, min_gap = (2, 3) if persistent else (4, 2)
    near = best_second_gap(nearest_codes(observed, registry, none_distance=17))
    ok = (F.col("best_distance") <= max_errors) & (F.col("gap") >= min_gap)
    return observed.select("query_id", "observed").join(near, "observed").select(
        "query_id", F.when(ok, F.col("best_trace")).alias("trace_id"), "best_distance", "second_distance"
    )


def packed_points(points: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Keypoints as one row an owner: lists in keypoint order. A feature index is bounded by contract.

    Points come one a row, or as lists where their owner's row holds them already; then whole lists are shuffled, and
    those of owners with several rows are put together.
    """
    columns = ("kp_idx", "descriptor", *extra)
    if isinstance(points.schema["kp_idx"].dataType, T.ArrayType):
        rows = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(*columns))))
    else:
        rows = F.array_sort(F.collect_list(F.struct(*columns)))
    packed = points.groupBy("owner_id").agg(rows.alias("_r"))
    return packed.select("owner_id", *[F.col(f"_r.{c}").alias(c) for c in columns])


# Rows of a query side that are compared with a target side at a time.
_COMPARED_ROWS = 512


def _matrices(packs: pa.Array) -> Iterator[np.ndarray]:
    """Descriptors of each list as rows of 64-bit words."""
    flat = packs.flatten()
    _, offsets, data = flat.buffers()
    marks = np.frombuffer(offsets, np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    raw = np.frombuffer(data if data is not None else b"", np.uint8)
    edges = np.concatenate([[0], np.cumsum(packs.value_lengths().to_numpy())])
    for begin, end in itertools.pairwise(edges):
        own = np.ascontiguousarray(raw[marks[begin] : marks[end]])
        yield own.view(np.uint64).reshape(end - begin, -1) if end > begin else np.zeros((0, 1), np.uint64)


def _ratio_matches(left: np.ndarray, right: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows whose nearest target row is clearly nearer than the second, with that row and its distance."""
    found = []
    for start in range(0, len(left), _COMPARED_ROWS):
        own = left[start : start + _COMPARED_ROWS]
        distance = np.zeros((len(own), len(right)), np.int32)
        for word in range(own.shape[1]):
            distance += np.bitwise_count(own[:, word, None] ^ right[None, :, word])
        rows, first = np.arange(len(own)), distance.argmin(axis=1)
        best = distance[rows, first].copy()
        distance[rows, first] = np.iinfo(np.int32).max
        good = np.flatnonzero(best < ratio * distance.min(axis=1))
        found.append((good + start, first[good], best[good]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def matched_pairs(pairs: DataFrame, query_packs: DataFrame, target_packs: DataFrame, ratio: float = 0.75, extra: Sequence[str] = (), describe: Callable[[Column], Column] | None = None) -> DataFrame:
    """Ratio-test matches of candidate pairs, one row a pair.

    pairs: pair, query_owner, target_owner; packs as ``packed_points`` makes them. Returns pair, the number of
    keypoints of both sides, the lists query_kp, target_kp and distance, and for each ``extra`` column its lists
    on both sides as q_<column> and t_<column>. Packs move as one row; no keypoint is shuffled for a pair. Where the
    descriptors are longer than what they are made of, packs hold the latter and ``describe`` turns its list into
    descriptors where the sides of a pair have met.
    """
    columns = ("kp_idx", "descriptor", *extra)
    side = lambda packs, p: packs.select(F.col("owner_id").alias(f"{p}_owner"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    both = pairs.select("pair", "query_owner", "target_owner").join(side(query_packs, "q"), F.col("query_owner") == F.col("q_owner"))
    both = both.join(side(target_packs, "t"), F.col("target_owner") == F.col("t_owner"))
    made = describe or (lambda c: c)
    both = both.select("pair", *[(made(F.col(f"{p}_{c}")) if c == "descriptor" else F.col(f"{p}_{c}")).alias(f"{p}_{c}") for p in "qt" for c in columns])
    kinds = {c: query_packs.schema[c].dataType.simpleString() for c in extra}
    names = ["pair", "n_query", "n_target", "query_kp", "target_kp", "distance", *[f"{p}_{c}" for p in "qt" for c in extra]]
    schema = "pair string, n_query int, n_target int, query_kp array<int>, target_kp array<int>, distance array<int>" + "".join(f", {p}_{c} {kinds[c]}" for p in "qt" for c in extra)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = {p: batch.column(f"{p}_kp_idx").value_lengths().to_numpy() for p in "qt"}
            begins = {p: np.cumsum(n) - n for p, n in sizes.items()}
            marks, picks = [0], {"q": [], "t": [], "d": []}
            for i, (left, right) in enumerate(zip(_matrices(batch.column("q_descriptor")), _matrices(batch.column("t_descriptor")), strict=True)):
                if len(left) and len(right) > 1:
                    own, other, distance = _ratio_matches(left, right, ratio)
                    picks["q"].append(own + begins["q"][i])
                    picks["t"].append(other + begins["t"][i])
                    picks["d"].append(distance)
                    marks.append(marks[-1] + len(own))
                else:
                    marks.append(marks[-1])
            at = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in picks.items()}
            edges = pa.array(np.array(marks, np.int32))
            lists = lambda values: pa.ListArray.from_arrays(edges, values)
            taken = lambda p, c: lists(batch.column(f"{p}_{c}").flatten().take(pa.array(at[p])))
            arrays = [batch.column("pair"), pa.array(sizes["q"], pa.int32()), pa.array(sizes["t"], pa.int32())]
            arrays += [taken("q", "kp_idx"), taken("t", "kp_idx"), lists(pa.array(at["d"].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(arrays + [taken(p, c) for p in "qt" for c in extra], names)

    return both.mapInArrow(compare, schema)


def descriptor_matches(pairs: DataFrame, query_points: DataFrame, target_points: DataFrame, ratio: float = 0.75, describe: Callable[[Column], Column] | None = None) -> DataFrame:
    """Ratio-test matches inside candidate pairs: pair, query_kp, target_kp, distance.

    pairs: pair, query_owner, target_owner. Keypoints: owner_id, kp_idx, descriptor (8*n bytes, or what ``describe``
    makes them of), one a row or as lists.
    """
    found = matched_pairs(pairs, packed_points(query_points), packed_points(target_points), ratio, describe=describe)
    return found.select("pair", F.inline(F.arrays_zip("query_kp", "target_kp", "distance")))


def descriptor_ratio_match(pairs: DataFrame, query_points: DataFrame, target_points: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Good-match count and quality (count / smaller side) of every candidate pair."""
    found = matched_pairs(pairs, packed_points(query_points), packed_points(target_points), ratio)
    usable = (F.col("n_query") >= 2) & (F.col("n_target") >= 2)
    good = found.select(F.col("pair").alias("_pair"), F.when(usable, F.size("distance")).otherwise(F.lit(0)).alias("good"), F.least("n_query", "n_target").alias("least"))
    return pairs.join(good, F.col("pair") == F.col("_pair"), "left").select(
        "pair",
        F.coalesce("good", F.lit(0)).cast("bigint").alias("good_matches"),
        F.round(F.coalesce(F.col("good") / F.nullif("least", F.lit(0)), F.lit(0.0)), 6).alias("quality"),
    )


# Pairs of codewords that are compared at a time.
_COMPARED_PAIRS = 1 << 18
_LOW_BITS, _HIGH_BITS = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def _accepted_pairs(observations: pd.DataFrame, records: pd.DataFrame) -> pd.DataFrame:
    """Vectorised form of the RS(16,8) acceptance rule for one block; returns accepted pairs only.

    Pairs are compared as two 64-bit words. With f erasures at most (8 - f) / 2 other bytes are wrong, so more than eight
    wrong bytes leave the bit errors alone to decide; the erasures are gone through for the few pairs that pass this.
    """
    seen = np.frombuffer(b"".join(map(bytes, observations["codeword"])), np.uint8).reshape(-1, 16)
    known = np.frombuffer(b"".join(map(bytes, records["codeword"])), np.uint8).reshape(-1, 16)
    confidence = np.stack(observations["confidences"].to_numpy())
    order = np.argsort(confidence, axis=1, kind="stable")
    with np.errstate(invalid="ignore"):
        usable = (np.isfinite(confidence) & (confidence >= 0) & (confidence <= 1)).all(axis=1)
    own, other = seen.view(np.uint64), known.view(np.uint64)
    step = max(1, _COMPARED_PAIRS // max(1, len(known)))
    names = ("query_id", "source_group_id"), ("record_id",)
    columns = [observations[c].to_numpy() for c in names[0]], [records[c].to_numpy() for c in names[1]]
    outs = []
    for start in range(0, len(seen), step):
        bits_off = np.zeros((len(own[start : start + step]), len(other)), np.uint8)
        bytes_off = np.zeros_like(bits_off)
        for word in range(2):
            delta = own[start : start + step, word, None] ^ other[None, :, word]
            bits_off += np.bitwise_count(delta)
            bytes_off += np.bitwise_count((((delta & _LOW_BITS) + _LOW_BITS) | delta) & _HIGH_BITS)
        i, j = np.nonzero(((bytes_off <= 8) | (bits_off <= 16)) & usable[start : start + step, None])
        errors = bits_off[i, j].astype(int)
        i += start
        wrong = np.take_along_axis(seen[i] != known[j], order[i], axis=1)
        # left[f] = wrong bytes outside the f least trusted bytes
        left = wrong[:, ::-1].cumsum(axis=1, dtype=np.int8)[:, ::-1][:, :9].astype(int)
        solvable = 2 * left + np.arange(9) <= 8
        rs = solvable.any(axis=1)
        erased = np.where(rs, solvable.argmax(axis=1), 0)
        pick = np.flatnonzero(rs | (errors <= 16))
        corrected = np.where(rs, erased + left[np.arange(len(i)), erased], wrong.sum(axis=1))
        found = {c: v[i[pick]] for c, v in zip(names[0], columns[0], strict=True)} | {c: v[j[pick]] for c, v in zip(names[1], columns[1], strict=True)}
        # Accepted without erasures: the plain decoder finds this record's tag.
        found |= {"bit_errors": errors[pick], "erasure_count": erased[pick], "corrected_symbols": corrected[pick], "blind": (left[:, 0] <= 4)[pick]}
        outs.append(pd.DataFrame(found))
    return pd.concat(outs)


def codeword_match(observations: DataFrame, records: DataFrame) -> DataFrame:
    """Authenticated records per (query, group): the blind-decoded record alone, else all accepted ones.

    observations: query_id, user_id, cross_owner, source_group_id, codeword, confidences.
    records: record_id, source_group_id, owner_user_id, codeword (of a verified tag), status.
    """
    # Scope comes first: records meet the observations of their owner, and those that ask across owners as a part more.
    group, star = F.col("source_group_id").cast("string"), F.lit("*")
    live = records.where(F.col("status") == "active")
    stored = live.select("record_id", "codeword", F.explode(F.array(F.concat(group, F.lit("|"), F.col("owner_user_id").cast("string")), F.concat(group, F.lit("|"), star))).alias("_part"))
    asked = F.concat(group, F.lit("|"), F.when(F.col("cross_owner"), star).otherwise(F.col("user_id").cast("string")))
    seen = observations.select("query_id", "source_group_id", "codeword", "confidences", asked.alias("_part")).where(F.col("_part").isNotNull())
    schema = "query_id bigint, source_group_id bigint, record_id bigint, bit_errors int, erasure_count int, corrected_symbols int, blind boolean"
    hits = blocked_pairs(seen, stored.where(F.col("_part").isNotNull()), "_part", "query_id", "record_id", _accepted_pairs, schema)
    any_blind = hits.where(F.col("blind")).select("query_id", "source_group_id").distinct().withColumn("_b", F.lit(True))
    kept = hits.join(any_blind, ["query_id", "source_group_id"], "left").where(F.col("_b").isNull() | F.col("blind"))
    return kept.select("query_id", "source_group_id", "record_id", "bit_errors", "erasure_count", "corrected_symbols")
