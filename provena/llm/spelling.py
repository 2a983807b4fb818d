"""Spelling variants: near words by PartEnum signatures of their letters.

A word is the set of its letters, each with its occurrence number: a binary vector. One inserted, deleted or
replaced letter changes at most two places of it. The places are dealt into parts; vectors at Hamming distance two
or less agree on all but two parts at most, so the signatures of a word, one for each choice of all parts but two,
meet those of every near word. An edit also leaves the first letters or the last letters of a word alone, which
narrows every signature to words of one beginning or of one end. Words meet by equal signatures and are verified.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from provena.llm import common

LETTERS, OCCURRENCES, RATIO = 7, 2, 10
DISTANCE, PARTS = 2, 5
_DROP = 31
_RUN = re.compile("[a-zÀ-ÿ]+")
_BREAK = re.compile(b"[^A-Za-z\x80-\xff]")
_SLICE, _HELD = 1 << 20, 1 << 18
_CHOICES = list(itertools.combinations(range(PARTS), PARTS - DISTANCE))


# --- words -------------------------------------------------------------------------------------


def _runs(text: bytes) -> Counter:
    """Runs of letters, A-Z in lower case, of a whole text, taken in slices cut outside of runs."""
    found: Counter = Counter()
    start = 0
    while start < len(text):
        stop = start + _SLICE
        if stop < len(text):
            cut = _BREAK.search(text, stop)
            stop = cut.start() if cut else len(text)
        found.update(_RUN.findall(text[start:stop].lower().decode("utf-8", "replace")))
        start = stop
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a partition with their counts, added up as far as memory of a fixed size allows."""
    held: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return common.batch_of(["word", "n"], [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())])

    for batch in batches:
        for part in common.chunks(batch, "text"):
            texts = part.column("text").cast(pa.large_binary())
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                data = text.as_py()
                if not data:
                    continue
                prefix = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
                for run, n in _runs(data).items():
                    if prefix is not None:
                        h = zlib.crc32(run.encode(), prefix)
                        if h % _DROP == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                    if len(run) >= LETTERS:
                        held[run] = held.get(run, 0) + n
                if len(held) > _HELD:
                    yield out()
                    held.clear()
    if held:
        yield out()


def words(documents: DataFrame) -> DataFrame:
    """(word, n): words of enough letters and occurrences over all documents."""
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    counted = texts.mapInArrow(_counted, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


# --- signatures --------------------------------------------------------------------------------


def signatures(texts: pa.Array, edge: int) -> np.ndarray:
    """Signature hashes of words, one row a word: every choice of parts, with its beginning and with its end."""
    data = [w.as_py() for w in texts]
    sizes = np.array([len(w) for w in data], np.int64)
    points = np.frombuffer("".join(data).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(data)), sizes)
    order = np.lexsort((points, owner))
    letters = points[order]
    # Occurrence number of a letter in its word: the distance from the first of its equals.
    new = np.ones(len(letters), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(new)
    nth = np.arange(len(letters)) - np.repeat(begins, np.diff(np.append(begins, len(letters))))
    place = common.mixed((letters << np.uint64(24)) + nth.astype(np.uint64) + np.uint64(1))
    part = (common.mixed(place + np.uint64(7)) % np.uint64(PARTS)).astype(np.int64)
    sums = np.zeros((len(data), PARTS), np.uint64)
    np.add.at(sums, (owner, part), place)
    first = np.cumsum(sizes) - sizes
    ends = []
    for start in (first, first + sizes - edge):
        value = np.zeros(len(data), np.uint64)
        for i in range(edge):
            value = common.mixed(value * np.uint64(0x9E3779B97F4A7C15) + points[start + i])
        ends.append(value)
    out = np.empty((len(data), 2 * len(_CHOICES)), np.uint64)
    for j, choice in enumerate(_CHOICES):
        value = np.full(len(data), j + 1, np.uint64)
        for p in choice:
            value = common.mixed(value + sums[:, p])
        for side in (0, 1):
            out[:, 2 * j + side] = common.mixed(value + common.mixed(ends[side] + np.uint64(side)))
    return out


def _signed(batches: Iterator[pa.RecordBatch], edge: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1 << 14):
            part = batch.slice(start, 1 << 14)
            rows = signatures(part.column("word"), edge)
            index = np.repeat(np.arange(part.num_rows), rows.shape[1])
            yield common.batch_of(["signature", "word", "n"], [common.signed(rows.ravel()), part.column("word").take(pa.array(index)), part.column("n").take(pa.array(index))])


def near_pairs(counted: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n), a < b: words that differ by exactly one inserted, deleted or replaced code point.

    Words that share a signature meet in a join that verifies at once; nothing is gathered by signature. One edit of
    a word of seven letters leaves its first three or its last three as they are.
    """
    signed = counted.mapInArrow(lambda b: _signed(b, (LETTERS - 1) // 2), "signature bigint, word string, n bigint")
    # Signatures of one word meet no other and go before the join.
    shared = signed.groupBy("signature").agg(F.count("*").alias("held")).where("held > 1").select("signature")
    signed = common.written(common.skew_join(signed, shared, "signature"))
    left = signed.select("signature", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = signed.select("signature", F.col("word").alias("b"), F.col("n").alias("b_n"))
    size = F.abs(F.char_length("a") - F.char_length("b")) <= 1
    met = left.join(right, "signature").where((F.col("a") < F.col("b")) & size & (F.levenshtein("a", "b", 1) == 1))
    pairs = common.written(met.select("a", "b", "a_n", "b_n").distinct())
    common.discard(signed)
    return pairs


# --- forms -------------------------------------------------------------------------------------


def variants(documents: DataFrame) -> DataFrame:
    """Words of documents, each with the much more frequent near word that it may be a misspelling of.

    Takes documents(doc_id long, text); other columns are ignored. Runs of ``[A-Za-z\\u00C0-\\u00FF]`` are taken with A-Z
    in lower case. Let h be crc32 of ``<doc_id>:<run>``; where 31 divides h, code point h % length is deleted. Words
    are the results of at least 7 code points and 2 occurrences. Returns one row a word: ``word, n`` (occurrences),
    ``n_near`` (words at exactly one edit), ``form`` (the near word of largest n, ties to the smallest, if it has at
    least 10 times the occurrences, else null), ``form_n`` and ``root`` (the end of the chain of forms).

    Null and empty texts have no words. Runs of a row without id are taken as they are. Every row counts, repeated ids
    and texts too. An empty table gives no rows.
    """
    counted = common.written(words(documents))
    pairs = near_pairs(counted)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    joined = counted.join(best, "word", "left").withColumn("_big", -F.col("best.k") >= RATIO * F.col("n"))
    rows = common.written(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(F.col("_big"), F.col("best.near")).alias("form"), F.when(F.col("_big"), -F.col("best.k")).alias("form_n"),
        )
    )
    common.discard(counted, pairs)
    # Counts grow tenfold along a chain, so doubling the steps ends it in a few joins.
    steps = common.written(rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("at")))
    while True:
        onward = steps.select(F.col("word").alias("at"), F.col("at").alias("to"))
        moved = common.written(common.skew_join(steps, onward, "at", "left").select("word", F.coalesce("to", "at").alias("at"), F.col("to").isNotNull().alias("moved")))
        more = not moved.where("moved").isEmpty()
        common.discard(steps)
        steps = moved
        if not more:
            break
    roots = steps.select("word", F.col("at").alias("_root"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
