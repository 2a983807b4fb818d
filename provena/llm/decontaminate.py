"""Benchmark decontamination by winnowing.

Both sides keep the least k-gram hash of every sliding window, so a shared span of ``window`` words shares at
least one kept fingerprint. The fingerprints are joined, each hit is extended to the windows around it, and
every such window is confirmed by its whole 128-bit hash. Items of fewer words than a window are found the
same way at their own length (at most ``window - 1`` such lengths exist).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from provena.llm import common

WINDOW, GRAM = 10, 5
SALT = 0x5DEECE66D

# Words are runs of ASCII letters and digits and of everything beyond ASCII.
_ASCII = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]
TABLE = common.byte_table(words=bytes([*_ASCII, *range(0x80, 0x100)]))


def gram_size(length: int) -> int:
    return max(1, min(GRAM, (length + 1) // 2))


def _item_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    names = ["item_id", "span", "kind", "h1", "h2"]
    for batch in batches:
        for part in common.chunks(batch, "text"):
            words = common.Words(part.column("text"), TABLE)
            ids = part.column("item_id")
            spans = np.minimum(words.count, window)
            for span in np.unique(spans[spans > 0]):
                span = int(span)
                own = (spans == span)[words.text_of()]
                h1, inside = words.grams(span)
                h2, _ = words.grams(span, SALT)
                at = np.flatnonzero(inside & own[: len(inside)])
                yield common.batch_of(names, [ids.take(pa.array(words.text_of()[at])), np.full(len(at), span, np.int32), np.zeros(len(at), np.int32), common.signed(h1[at]), common.signed(h2[at])])
                at, prints = words.winnowed(gram_size(span), span)
                kept = own[at]
                at, prints = at[kept], prints[kept]
                yield common.batch_of(names, [ids.take(pa.array(words.text_of()[at])), np.full(len(at), span, np.int32), np.ones(len(at), np.int32), common.signed(prints), common.signed(prints)])


def _document_rows(batches: Iterator[pa.RecordBatch], spans: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """One row a document (span 0, its word count as place) and one a fingerprint."""
    names = ["doc_id", "span", "place", "print"]
    for batch in batches:
        for part in common.chunks(batch, "text"):
            words = common.Words(part.column("text"), TABLE)
            ids, owner = part.column("doc_id"), words.text_of()
            n = part.num_rows
            # Any value will do as the print of a document row; different ones keep the join even.
            yield common.batch_of(names, [ids, np.zeros(n, np.int32), words.count.astype(np.int64), common.signed(common.mixed(words.offsets[1:].astype(np.uint64) + np.uint64(1)))])
            for span in spans:
                at, prints = words.winnowed(gram_size(span), span)
                yield common.batch_of(names, [ids.take(pa.array(owner[at])), np.full(len(at), span, np.int32), at - words.first[owner[at]], common.signed(prints)])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around the hits of each document, with their hashes."""
    names = ["doc_id", "span", "start", "h1", "h2"]
    for batch in batches:
        for part in common.chunks(batch, "text"):
            words = common.Words(part.column("text"), TABLE)
            ids, owner, hits = part.column("doc_id"), words.text_of(), part.column("hits")
            counts = np.diff(hits.offsets.to_numpy())
            flat = hits.flatten()
            row = np.repeat(np.arange(part.num_rows), counts)
            spans = flat.field("span").to_numpy(zero_copy_only=False)
            places = flat.field("place").to_numpy(zero_copy_only=False) + words.first[row]
            for span in np.unique(spans):
                span = int(span)
                h1, inside = words.grams(span)
                h2, _ = words.grams(span, SALT)
                reach = span - gram_size(span) + 1
                at, of = places[spans == span], row[spans == span]
                starts = (at[:, None] - np.arange(reach)).ravel()
                of = np.repeat(of, reach)
                starts = starts[starts >= words.first[of]]
                starts = np.unique(starts[starts < len(inside)])
                starts = starts[inside[starts]]
                yield common.batch_of(names, [ids.take(pa.array(owner[starts])), np.full(len(starts), span, np.int32), starts - words.first[owner[starts]], common.signed(h1[starts]), common.signed(h2[starts])])


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Benchmark windows found in documents.

    Takes documents(doc_id, text) and benchmark(item_id, text), other columns are ignored. Returns one row a
    document: ``doc_id, n_words, n_hit``, ``spans`` (array of start, length in words, merged, in order) and
    ``items`` (ids of items with a window in the text, sorted as strings).

    Null or empty texts have no words and no hits; an item without words is never found. Rows equal in id
    and text are one document; other texts under the same id and rows without id are documents of their own. Items with an id of null count as hits, only their
    id is not listed. Empty tables give empty results or no hits.
    """
    doc_type, item_type = documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    texts = documents.select("doc_id", "text")
    if common.ids_repeat(texts, "doc_id"):
        rows = common.numbered(common.folded(texts, "doc_id", ["text"]), "doc_id")
        return common.renamed(contamination(rows.select(F.col("_row").alias("doc_id"), "text"), benchmark, window), rows)
    items = benchmark.select("item_id", "text")
    items = common.written(items.mapInArrow(lambda b: _item_rows(b, window), f"item_id {item_type}, span int, kind int, h1 bigint, h2 bigint"))
    spans = sorted(r.span for r in items.select("span").distinct().collect())  # at most ``window`` values
    prints = common.written(items.where("kind = 1").select("span", F.col("h1").alias("print")).distinct())

    rows = texts.mapInArrow(lambda b: _document_rows(b, spans), f"doc_id {doc_type}, span int, place bigint, print bigint")
    # The prints are a written table of known size: Spark broadcasts it below its threshold, else it shuffles
    # both sides and splits hot prints.
    found = rows.join(prints.withColumn("hit", F.lit(True)), ["span", "print"], "left")
    base = common.written(
        found.groupBy("doc_id").agg(
            F.max(F.when(F.col("span") == 0, F.col("place"))).alias("n_words"),
            F.collect_set(F.when((F.col("span") > 0) & F.col("hit"), F.struct("span", "place"))).alias("hits"),
        )
    )

    hit = base.where(F.size("hits") > 0).select(F.col("doc_id").alias("_doc"), "hits")
    near = texts.join(hit, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "text", "hits")
    starts = near.mapInArrow(_extend, f"doc_id {doc_type}, span int, start bigint, h1 bigint, h2 bigint").distinct()
    windows = items.where("kind = 0").select("item_id", F.struct("span", "h1", "h2").alias("key")).distinct()
    # Windows that lie in the same items share one representative, so a document meets an item list once.
    lists = windows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("item_id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("item_id", F.lit(1))).alias("x"))
    lists = common.written(lists)
    first = lists.groupBy("n", "s", "x").agg(F.min("key").alias("list"))
    listed = common.written(lists.join(first, ["n", "s", "x"]).select("key", "list"))
    confirmed = common.written(common.skew_join(starts.select("doc_id", F.struct("span", "h1", "h2").alias("key"), "start"), listed, "key"))

    covered = confirmed.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", F.col("key.span").cast("bigint").alias("length")))).alias("found"))
    merge = F.aggregate(
        "found",
        F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["start"] + F.element_at(done, -1)["length"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["length"], x["start"] + x["length"] - F.element_at(done, -1)["start"]).alias("length"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["length"].alias("length"))))),
    )
    covered = covered.select(F.col("doc_id").alias("_d1"), merge.alias("spans"))
    of_list = windows.join(listed.where(F.col("key") == F.col("list")).select("key"), "key").select(F.col("key").alias("list"), "item_id")
    named = confirmed.select("doc_id", "list").distinct().join(of_list, "list").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    named = named.select(F.col("doc_id").alias("_d2"), "items")
    out = base.select("doc_id", "n_words").join(covered, F.col("doc_id").eqNullSafe(F.col("_d1")), "left").join(named, F.col("doc_id").eqNullSafe(F.col("_d2")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["length"]), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )
