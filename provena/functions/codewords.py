"""Codeword acceptance as closed-form expressions, and the two digests that need Arrow functions.

A bounded-distance decoder with ``parity`` check bytes returns a given codeword exactly when
2*errors + erasures <= parity, so accepting against a known codeword needs no decoder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from provena.functions import bits
from provena.functions.geometry import let

DATA_BYTES = 8


def valid_confidences(confidences: Column, size: int) -> Column:
    return (F.size(confidences) == size) & F.forall(
        confidences, lambda c: c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)
    )


def acceptance(
    observed: Column,
    expected: Column,
    confidences: Column,
    parity: int = 8,
    erasure_counts: tuple[int, ...] = tuple(range(9)),
    max_bit_errors: int = 16,
    check_confidences: bool = True,
) -> Column:
    """STRUCT(accepted, erasure_count, corrected_symbols, bit_errors, method) for two codewords."""
    size = DATA_BYTES + parity
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    # Per byte: (confidence, position, number of wrong bits), from least to most trusted.
    zipped = F.arrays_zip(
        confidences.alias("c"), bits.byte_values(observed, size).alias("a"), bits.byte_values(expected, size).alias("b")
    )
    ordered = F.array_sort(
        F.transform(zipped, lambda z, i: F.struct(z["c"].alias("c"), i.alias("i"), F.bit_count(z["a"].bitwiseXOR(z["b"])).alias("n")))
    )
    usable = (F.octet_length(observed) == size) & (F.octet_length(expected) == size) & (F.size(confidences) == size)
    if check_confidences:
        usable = usable & valid_confidences(confidences, size)
    wrong = lambda rows: total(F.transform(rows, lambda z: F.when(z["n"] > 0, F.lit(1)).otherwise(F.lit(0))))

    def solve(rows: Column) -> Column:
        tried = F.transform(
            F.array(*map(F.lit, erasure_counts)), lambda f: F.struct(f.alias("f"), wrong(F.slice(rows, f + 1, F.lit(size) - f)).alias("e"))
        )
        solved = F.get(F.filter(tried, lambda t: t["e"] * 2 + t["f"] <= parity), F.lit(0))
        return F.struct(solved.alias("s"), total(F.transform(rows, lambda z: z["n"])).alias("n"), wrong(rows).alias("w"))

    def decide(v: Column) -> Column:
        by_code, near = v["s"].isNotNull(), v["n"] <= max_bit_errors
        shown = lambda solved, other: F.when(by_code, solved).when(near, other)
        return F.struct(
            F.coalesce(by_code | near, F.lit(False)).alias("accepted"),
            shown(v["s"]["f"], F.lit(0)).alias("erasure_count"),
            shown(v["s"]["f"] + v["s"]["e"], v["w"]).alias("corrected_symbols"),
            shown(v["n"], v["n"]).alias("bit_errors"),
            shown(F.lit("reed_solomon"), F.lit("expected_codeword_distance")).alias("method"),
        )

    nothing = F.struct(
        F.lit(False).alias("accepted"), *[F.lit(None).cast("int").alias(c) for c in ("erasure_count", "corrected_symbols", "bit_errors")],
        F.lit(None).cast("string").alias("method"),
    )
    return F.when(F.coalesce(usable, F.lit(False)), let(let(ordered, solve), decide)).otherwise(nothing)


def acceptance_v2(observed: Column, expected: Column, confidences: Column) -> Column:
    """RS(24,8) rule: erasures 0, 2, 4, 6, else up to 32 bit errors."""
    return acceptance(observed, expected, confidences, 16, (0, 2, 4, 6), 32, check_confidences=False)


def _generator_parity(parity: int) -> np.ndarray:
    """Parity bytes of each unit data byte (8 positions x 256 values), as XOR tables.

    Field: GF(2^8) with polynomial 0x11D, generator roots 2^0 .. 2^(parity-1).
    """
    exp = [0] * 512
    log = [0] * 256
    value = 1
    for power in range(255):
        exp[power] = value
        log[value] = power
        value = (value << 1) ^ (0x11D if value & 0x80 else 0)
    for power in range(255, 512):
        exp[power] = exp[power - 255]

    def times(a: int, b: int) -> int:
        return exp[log[a] + log[b]] if a and b else 0

    generator = [1]
    for root in range(parity):
        grown = generator + [0]
        for i, coefficient in enumerate(generator):
            grown[i + 1] ^= times(coefficient, exp[root])
        generator = grown
    tables = np.zeros((DATA_BYTES, 256, parity), dtype=np.uint8)
    for position in range(DATA_BYTES):
        for byte in range(256):
            message = [0] * (DATA_BYTES + parity)
            message[position] = byte
            for i in range(DATA_BYTES):
                if message[i]:
                    for j in range(1, parity + 1):
                        message[i + j] ^= times(message[i], generator[j])
            tables[position, byte] = message[DATA_BYTES:]
    return tables


def encode_batch(data: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(n, 8) data bytes to (n, 8 + parity) systematic codewords."""
    parity = np.zeros((len(data), tables.shape[2]), dtype=np.uint8)
    for position in range(DATA_BYTES):
        parity ^= tables[position, data[:, position]]
    return np.concatenate([data, parity], axis=1)


def encode_codeword(data: Column, parity: int = 8) -> Column:
    """8-byte tag to systematic codeword; NULL when the input is not 8 bytes."""
    tables = _generator_parity(parity)

    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(values), index=values.index, dtype=object)
        good = values.map(lambda v: v is not None and len(v) == DATA_BYTES)
        if good.any():
            data_rows = np.frombuffer(b"".join(map(bytes, values[good])), dtype=np.uint8).reshape(-1, DATA_BYTES)
            out[good] = [row.tobytes() for row in encode_batch(data_rows, tables)]
        return out

    return encode(data)


@F.pandas_udf(T.BinaryType())
def _blake2b_6(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else hashlib.blake2b(bytes(v), digest_size=6).digest())


@F.pandas_udf(T.BinaryType())
def _blake2b_2(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else hashlib.blake2b(bytes(v), digest_size=2).digest())


def _number(data: Column) -> Column:
    return F.conv(F.hex(data), 16, 10).cast("bigint")


def trace_code64(trace_id: Column) -> Column:
    """16-bit magic followed by a 48-bit digest of the trace id."""
    body = _number(_blake2b_6(F.encode(trace_id, "UTF-8")))
    return F.shiftleft(F.lit(bits.MAGIC).cast("bigint"), 48).bitwiseOR(body)


def checksum16(value: Column) -> Column:
    """16-bit digest of a 32-bit number (four big-endian bytes)."""
    return _number(_blake2b_2(F.unhex(F.lpad(F.hex(value), 8, "0"))))


def trace_payload48(trace_id: Column) -> Column:
    """magic (16) | digest of the trace id (16) | checksum of both (16)."""
    head = F.lit(bits.MAGIC * 65536).cast("bigint") + _number(_blake2b_2(F.encode(trace_id, "UTF-8")))
    return F.shiftleft(head, 16).bitwiseOR(checksum16(head))
