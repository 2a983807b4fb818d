"""Bit and code expressions. Codes of 64 bits are BIGINT, bit lists are most significant first."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import Column, functions as F

# Fixed values of the code formats.
MAGIC = 0b1010110011010011
PHASE_SEED_V4 = b"hmac64_rs_16_8_split_repeat_sync_v4:carrier-permutation:"
PHASE_SEED_V3 = b"robust-v3-carrier-permutation:"


def hamming64(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def magic_distance(magic: Column) -> Column:
    return F.bit_count(magic.bitwiseXOR(F.lit(MAGIC).cast("bigint")))


def bits_to_code(bits: Column) -> Column:
    """Array of 0/1 (first = highest) to BIGINT."""
    return F.aggregate(
        bits, F.lit(0).cast("bigint"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit.cast("bigint"))
    )


def code_bit(code: Column, index: Column, width: int = 64) -> Column:
    """Bit ``index`` of a code, 0 = most significant."""
    return F.call_function("shiftrightunsigned", code, (F.lit(width - 1) - index).cast("int")).bitwiseAND(
        F.lit(1).cast("bigint")
    ).cast("int")


def code_bits(code: Column, width: int = 64) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: code_bit(code, i, width))


def high_bits(code: Column, drop: int) -> Column:
    return F.shiftrightunsigned(code, drop)


def hex_to_code(text: Column) -> Column:
    """16 hex characters to BIGINT (two 32-bit halves, so the sign bit is safe)."""
    high = F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(text, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def byte_values(data: Column, size: int) -> Column:
    """BINARY of ``size`` bytes to ARRAY<INT>."""
    text = F.hex(data)
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.conv(F.substr(text, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int"),
    )


def bits_to_bytes(bits: Column, size: int) -> Column:
    """Array of size*8 bits (first = highest) to BINARY."""
    text = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.lpad(
            F.hex(
                F.aggregate(
                    F.slice(bits, (i * 8 + 1).cast("int"), F.lit(8)),
                    F.lit(0).cast("bigint"),
                    lambda acc, bit: acc * 2 + bit.cast("bigint"),
                )
            ),
            2,
            "0",
        ),
    )
    return F.unhex(F.array_join(text, ""))


def binary_hamming(left: Column, right: Column, size: int) -> Column:
    pairs = F.zip_with(byte_values(left, size), byte_values(right, size), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(pairs, F.lit(0), lambda acc, n: acc + n)


def repetition_decode(code: Column, payload_bits: int = 48, physical_bits: int = 64) -> tuple[Column, Column]:
    """Majority over the copies of each payload bit; a tie counts as one. Returns (payload, corrections)."""
    doubled = physical_bits - payload_bits

    def ones(index: Column) -> Column:
        first = code_bit(code, index, physical_bits)
        again = F.when(index < doubled, code_bit(code, index + payload_bits, physical_bits)).otherwise(F.lit(0))
        return first + again

    copies = lambda index: F.when(index < doubled, F.lit(2)).otherwise(F.lit(1))
    positions = F.sequence(F.lit(0), F.lit(payload_bits - 1))
    payload = bits_to_code(
        F.transform(positions, lambda i: F.when(ones(i) * 2 >= copies(i), F.lit(1)).otherwise(F.lit(0)))
    )
    corrections = F.aggregate(
        F.transform(positions, lambda i: F.least(ones(i), copies(i) - ones(i))), F.lit(0), lambda a, b: a + b
    )
    return payload, corrections


def tile_phase(tile_x: Column, tile_y: Column, phases: int = 4) -> Column:
    return F.pmod(tile_x + tile_y * 2, F.lit(phases))


def carrier_class(tile_x: Column, tile_y: Column) -> Column:
    return F.pmod(tile_x + tile_y, F.lit(2))


def phase_table(phase: int, seed: bytes, width: int = 64) -> list[int]:
    """Seeded carrier order of one phase: logical bit -> physical cell."""
    digest = hashlib.sha256(seed + str(phase).encode("ascii")).digest()
    order = list(range(width))
    random.Random(int.from_bytes(digest, "big")).shuffle(order)
    return order


def phase_tables(seed: bytes, phases: int) -> Column:
    """All phase tables as one literal ARRAY<ARRAY<INT>>."""
    return F.array(*[F.array(*[F.lit(v) for v in phase_table(p, seed)]) for p in range(phases)])


def to_logical_order(scores: Column, phase: Column, seed: bytes, phases: int) -> Column:
    """Physical cell scores to logical bit order of the tile's phase."""
    table = F.element_at(phase_tables(seed, phases), (phase + 1).cast("int"))
    return F.transform(table, lambda cell: F.element_at(scores, cell + 1))


def radius_probability(max_errors: int, bits: int = 64) -> Column:
    """P(random code within the radius) = sum of C(bits, k) / 2^bits."""
    from math import comb

    if not 0 <= max_errors <= bits:
        raise ValueError("radius must lie within the code length")
    return F.lit(sum(comb(bits, k) for k in range(max_errors + 1)) / 2**bits)
