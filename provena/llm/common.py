"""Text chunks, word boundaries, rolling hashes and scratch tables shared by the corpus operators.

The numpy helpers see one bounded chunk of one Spark partition at a time; a chunk holds whole texts,
so only a single longer text makes it larger than its bound.
"""

from __future__ import annotations

import contextlib
import ctypes
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from provena.session import discard, scratch_folder, written  # noqa: F401 - part of this module too

CHUNK_BYTES = 2 << 20

# Hashes of a chunk are taken in slices of about so many bytes and words, however long a text is.
SLICE_BYTES, SLICE_WORDS = 1 << 20, 1 << 17

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BYTE_STEP = 0xD6E8FEB86659FD93
_WORD_STEP = 0xA0761D6478BD642F
_POSITION_BITS = np.uint64(31)

WHITE = bytes([0x20, *range(0x09, 0x0E)])


# --- Spark side --------------------------------------------------------------------------------


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids_repeat(frame: DataFrame, key: str) -> bool:
    """Whether several rows share an id or have none."""
    return not frame.groupBy(key).count().where("count > 1").isEmpty()


def numbered(frame: DataFrame, key: str) -> DataFrame:
    """The rows with ``_row``, unique numbers in the order of ``key`` (nulls last), written as a table."""
    parts = [F.xxhash64(*[c for c in frame.columns if c != key]), F.monotonically_increasing_id()]
    ordered = frame.select("*", *[p.alias(f"_o{i}") for i, p in enumerate(parts)]).orderBy(F.asc_nulls_last(key), "_o0", "_o1")
    return written(ordered.select(*frame.columns, F.monotonically_increasing_id().alias("_row")))


def folded(frame: DataFrame, key: str, content: list[str], nulls: bool = False) -> DataFrame:
    """One row for all that are equal in ``key`` and ``content``, the least; rows without key stay as they are, unless
    ``nulls`` has them folded by content."""
    keys = [key, *content]
    rest = [c for c in frame.columns if c not in keys]
    known = frame if nulls else frame.where(F.col(key).isNotNull())
    if rest:
        least = known.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r"))
        known = least.select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in frame.columns])
    else:
        known = known.distinct()
    return known if nulls else known.unionByName(frame.where(F.col(key).isNull()))


def own_rows(frame: DataFrame, fold: bool = True, nulls: bool = False) -> DataFrame:
    """Documents with ``_row``, a number of their own: the id, where no two rows share one or have none. Else rows equal
    in id and text are folded (if ``fold``) and the rows are numbered in the order of their ids."""
    if not ids_repeat(frame, "doc_id"):
        return frame.withColumn("_row", F.col("doc_id"))
    return numbered(folded(frame, "doc_id", ["text"], nulls) if fold else frame, "doc_id")


def renamed(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Results by row number (as ``doc_id``) under the ids of the numbered rows(doc_id, _row)."""
    ids = rows.select(F.col("_row").alias("_n"), F.col("doc_id").alias("_id"))
    return found.join(ids, F.col("doc_id") == F.col("_n")).select(*[F.col("_id").alias(c) if c == "doc_id" else c for c in found.columns])


def rekeyed(column: str) -> Column:
    """The same key as another expression.

    A join on it needs a shuffle of its own, even above an aggregate by the key; adaptive execution
    can then split a hot key of the other side, which it can't do when the aggregate feeds the join directly.
    """
    return F.struct(F.col(column).alias("k"))


def skew_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows that may share a hot ``key`` with a table of one row a key (a null key meets nothing)."""
    left = many.withColumn("_k", rekeyed(key))
    right = one.withColumn("_k", rekeyed(key)).drop(key)
    return left.join(right, "_k", how).drop("_k")


def remainder(column: str, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``, the held-out rule of the learned operators."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


# --- numpy side --------------------------------------------------------------------------------


def release() -> None:
    """Give back to the system what this worker, which Spark uses again, holds of earlier tasks but needs no more."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mixed(values: np.ndarray) -> np.ndarray:
    """Bit mixer on uint64 values; arithmetic is modulo 2^64."""
    x = values ^ (values >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_CODES[0] = 0  # separators add nothing
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(step: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """step^i and its inverse modulo 2^64 for i < size; a table is kept up to a few chunks long."""
    kept = _POWERS.get(step)
    if kept is None or len(kept[0]) < size:
        rows = max(size, 1 << 16)
        both = []
        for base in (step, pow(step, -1, 1 << 64)):
            table = np.full(rows, base, np.uint64)
            table[0] = 1
            both.append(np.cumprod(table, dtype=np.uint64))
        kept = (both[0], both[1])
        if rows <= 4 * CHUNK_BYTES:
            _POWERS[step] = kept
    return kept[0][:size], kept[1][:size]


def byte_table(separators: bytes = b"", words: bytes | None = None, lower: bool = True) -> np.ndarray:
    """256 entries: 0 for a separator, else the byte itself, A-Z lower-cased if asked.

    Byte 0 can't be told from a separator, so where it belongs to words it is mapped to 0xFF, which never
    occurs in UTF-8.
    """
    table = np.arange(256, dtype=np.uint8)
    table[0] = 0xFF
    if lower:
        table[65:91] += 32
    if words is not None:
        keep = np.zeros(256, bool)
        keep[list(words)] = True
        table[~keep] = 0
    table[list(separators)] = 0
    return table


WHITE_LOWER = byte_table(WHITE)
WHITE_EXACT = byte_table(WHITE, lower=False)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts, from 0) and bytes of a string array; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    marks = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or marks[-1] == marks[0]:
        return marks - marks[0], np.zeros(0, np.uint8)
    return marks - marks[0], np.frombuffer(data, np.uint8)[marks[0] : marks[-1]]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take at most ``size`` bytes, or one longer text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, length in enumerate(lengths):
        if held and held + length > size:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(length)
    if start < batch.num_rows:
        yield batch.slice(start)


class Words:
    """Words of a string array: byte range and 64-bit hash of each, and the first word of each text."""

    def __init__(self, texts: pa.Array, table: np.ndarray, hashed: bool = True):
        self.offsets, self.source = raw(texts)
        self.data = table[self.source]
        inside = self.data != 0
        edge = self.offsets[:-1]
        edge = edge[edge < len(inside)]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        begin[edge] = inside[edge]
        end[:-1] &= ~inside[1:]
        before = edge[edge > 0] - 1
        end[before] = inside[before]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.count = np.diff(self.first)
        if hashed:
            self.hash = self._hashes()

    def __len__(self) -> int:
        return len(self.starts)

    def _hashes(self) -> np.ndarray:
        """Hashes of the words, taken in slices of whole words: a hash does not depend on where its word lies."""
        out = np.empty(len(self.starts), np.uint64)
        row = 0
        while row < len(out):
            begin = int(self.starts[row])
            stop = max(row + 1, int(np.searchsorted(self.ends, begin + SLICE_BYTES, "right")))
            starts = self.starts[row:stop] - begin
            values = _CODES[self.data[begin : int(self.ends[stop - 1])]]
            up, down = _powers(_BYTE_STEP, len(values))
            values *= up
            total = np.add.reduceat(values, starts) * down[starts]
            out[row:stop] = mixed(total + (self.ends - self.starts)[row:stop].astype(np.uint64) * _GOLDEN)
            row = stop
        return out

    def text_of(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each position on, and whether they stay inside one text."""
        n = len(self)
        if n < size:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.empty(n - size + 1, np.uint64)
        # Slices overlap by the words of a gram; its hash does not depend on where it lies.
        for begin in range(0, len(out), SLICE_WORDS):
            stop = min(begin + SLICE_WORDS, len(out))
            words = self.hash[begin : stop + size - 1]
            up, down = _powers(_WORD_STEP, len(words))
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum((mixed(words + np.uint64(salt)) if salt else words) * up, out=sums[1:])
            out[begin:stop] = mixed((sums[size:] - sums[:-size]) * down[: stop - begin] + np.uint64(size))
        last = np.repeat(self.first[1:], self.count)[: len(out)]
        return out, np.arange(size, n + 1) <= last

    def winnowed(self, size: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Winnowing: positions of the least ``size``-gram of every ``span``-word window, and their hashes.

        Equal windows choose equal grams at equal places, so texts that share ``span`` words share a chosen gram.
        """
        hashes, _ = self.grams(size)
        window = span - size + 1
        if len(hashes) < window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        # Leading bits of the hash, then the position: equal grams tie towards the left.
        key = (hashes >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(hashes), dtype=np.uint64)
        reach = 1
        while reach * 2 <= window:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if reach < window:
            key = np.minimum(key[: len(key) - (window - reach)], key[window - reach :])
        last = self.first[1:][self.text_of()[: len(key)]]
        key = key[np.arange(span, span + len(key)) <= last]
        chosen = np.unique(key & np.uint64((1 << 31) - 1)).astype(np.int64)
        return chosen, hashes[chosen]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def as_lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    marks = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=marks[1:])
    return pa.ListArray.from_arrays(pa.array(marks), values)


def as_binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Fixed-width values as one binary a row."""
    marks = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * values.dtype.itemsize, out=marks[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(marks.tobytes()), pa.py_buffer(values.tobytes())])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def batch_of(schema: pa.Schema | list[str], arrays: list) -> pa.RecordBatch:
    names = schema if isinstance(schema, list) else schema.names
    return pa.RecordBatch.from_arrays([a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in arrays], names)


# --- learned operators ---------------------------------------------------------------------------

LETTERS = byte_table(words=bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def training_frame(documents: DataFrame, labels: DataFrame, label: str, per_label: tuple[int, int], chars: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """A bounded sample of labelled texts for a model: at most ``per_label`` rows of label 0 and of 1, the first
    by the hash of their id, of which texts up to ``chars`` characters are used. Learning alone is bounded; scores
    see every text whole."""
    picked = None
    for value in (0, 1):
        own = labels.where((F.col(label) == value) & F.col("doc_id").isNotNull()).select("doc_id", F.lit(value).alias("_label"))
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label[value])
        picked = own if picked is None else picked.union(own)
    texts = documents.select("doc_id", "text", *extra).where(F.col("text").isNotNull() & (F.length("text") <= chars))
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", *extra, F.col("_label").alias("label"))


_TRAINING_ORDER = [("doc_id", "ascending"), ("text", "ascending"), ("label", "ascending")]


def training_rows(documents: DataFrame, labels: DataFrame, label: str, per_label: tuple[int, int], chars: int, extra: tuple[str, ...] = ()) -> pa.Table:
    """The rows of ``training_frame`` on the driver, in an order of their own."""
    return training_frame(documents, labels, label, per_label, chars, extra).toArrow().sort_by(_TRAINING_ORDER)


def learned(sample: DataFrame, learn: Callable[[pa.Table], object]) -> object:
    """What ``learn`` makes of a bounded sample, worked out in one task, so that the driver holds the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield batch_of(["model"], [pa.array([pickle.dumps(learn(pa.Table.from_batches(held).sort_by(_TRAINING_ORDER)))], pa.binary())])

    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(rows[0]["model"])) if rows else None


def word_grams(words: Words, rows: np.ndarray, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of some words, each word framed by marks, and the number of grams of each."""
    lengths = (words.ends - words.starts)[rows]
    framed = lengths + 2
    ends = np.cumsum(framed)
    begins = ends - framed
    data = np.full(int(ends[-1]) if len(ends) else 0, 1, np.uint64)
    inner = np.ones(len(data), bool)
    inner[begins] = False
    inner[ends - 1] = False
    take = np.repeat(words.starts[rows] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    data[inner] = words.data[take]
    owner = np.repeat(np.arange(len(rows)), framed)
    parts, owners = [], []
    for size in sizes:
        n = len(data) - size + 1
        if n <= 0:
            continue
        code = np.full(n, size, np.uint64)
        for j in range(size):
            code = code * np.uint64(257) + data[j : j + n]
        whole = owner[:n] == owner[size - 1 :]
        parts.append((mixed(code[whole]) % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[:n][whole])
    if not parts:
        return np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    grams, own = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return grams[order], np.bincount(own, minlength=len(rows))


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive segments of rows; an empty segment sums to zero."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    full = counts > 0
    if full.any():
        begins = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, begins, axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
