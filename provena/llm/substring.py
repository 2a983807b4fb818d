"""Removal of word windows that recur anywhere in the corpus, found with sharded phrase automata.

1. Texts of equal words are one class; a class of several documents recurs as a whole.
2. Every class keeps the least 18-gram of each sliding 35-word window (winnowing), so two places of one
   window keep the same phrase. Phrases kept at two places or more are the recurring phrases.
3. Each recurring phrase is spelled once, by the least document that holds it: a symbol for each of its words.
   Phrases and the documents that hold them are dealt into shards. A shard compiles the phrases that it was dealt
   into an Aho-Corasick automaton (pyahocorasick) and streams its documents through it; the places of phrases are
   those that the automaton finds.
4. The windows around the occurrences are confirmed by counting their 96-bit hashes over all documents.

Automata stay as small as a shard, so the work grows in proportion to the corpus. Two words may share a symbol: then
an automaton finds a place more, whose windows step 4 leaves out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from provena.llm import common

WINDOW = 35
SALT = 0x2545F4914F6CDD1D
# 2^20 code points above the basic plane: one symbol a word.
_PLANE, _SYMBOLS = 0x10000, 0xFFFFF


def phrase_size(window: int) -> int:
    return (window + 1) // 2


def _profile(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Word count, class, digest of all words and kept phrases of each document."""
    names = ["doc_id", "n_words", "class", "digest", "prints"]
    for batch in batches:
        for part in common.chunks(batch, "text"):
            words = common.Words(part.column("text"), common.WHITE_EXACT)
            at, prints = words.winnowed(phrase_size(window), window)
            counts = np.bincount(words.text_of()[at], minlength=part.num_rows)
            classes, digests = [], []
            for text in part.column("text").to_pylist():
                joined = b" ".join((text or "").encode().split())
                digest = hashlib.sha256(joined)
                digests.append(digest.hexdigest())
                classes.append(digest.digest()[:16])
            yield common.batch_of(names, [part.column("doc_id"), words.count.astype(np.int64), pa.array(classes, pa.binary()), digests, common.as_lists(common.signed(prints), counts)])


def _symbols(words: common.Words) -> np.ndarray:
    return ((words.hash >> np.uint64(44)).astype(np.uint32) & np.uint32(_SYMBOLS)) + np.uint32(_PLANE)


def _spelled(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The symbols of the phrases that a document was asked to spell."""
    size = phrase_size(window)
    for batch in batches:
        for part in common.chunks(batch, "text"):
            words = common.Words(part.column("text"), common.WHITE_EXACT)
            at, prints = words.winnowed(size, window)
            asked = part.column("asked")
            lists = asked.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            # A phrase is spelled by its own document alone: both sides carry the number of the text.
            keyed = lambda text, prints: common.mixed(prints + common.mixed(text.astype(np.uint64) + np.uint64(1)))
            wanted = keyed(np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy()), lists)
            _, _, pick = np.intersect1d(wanted, keyed(words.text_of()[at], prints), return_indices=True)
            symbols = _symbols(words)[at[pick][:, None] + np.arange(size)]
            yield common.batch_of(["print", "phrase"], [common.signed(prints[pick]), common.as_binaries(symbols.ravel(), np.full(len(pick), size))])


def _located(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Windows around each place of a recurring phrase: the automaton of a shard, then its documents."""
    names = ["doc_id", "h1", "h2", "start"]
    size = phrase_size(window)
    for batch in batches:
        for part in common.chunks(batch, "text"):
            automaton = ahocorasick.Automaton()
            for phrase in pc.unique(part.column("phrases").flatten()).to_pylist():
                automaton.add_word(phrase.decode("utf-32-le"), size)
            hits = []
            words = common.Words(part.column("text"), common.WHITE_EXACT)
            if len(automaton):
                automaton.make_automaton()
                text = _symbols(words).tobytes().decode("utf-32-le")
                for row in range(part.num_rows):
                    begin = int(words.first[row])
                    hits += [begin + end - size + 1 for end, _ in automaton.iter(text[begin : int(words.first[row + 1])])]
            h1, whole = words.grams(window)
            h2, _ = words.grams(window, SALT)
            # Windows that hold the phrase begin up to window - size words before it.
            at, n = np.asarray(hits, np.int64), len(h1)
            mark = np.bincount(np.clip(at - (window - size), 0, n), minlength=n + 1) - np.bincount(np.minimum(at + 1, n), minlength=n + 1)
            starts = np.flatnonzero((np.cumsum(mark)[:n] > 0) & whole)
            owner = words.text_of()[starts]
            ids = part.column("doc_id").take(pa.array(owner))
            yield common.batch_of(names, [ids, common.signed(h1[starts]), pa.array((h2[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array((starts - words.first[owner]).astype(np.int32))])


def _spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    heads = starts[np.concatenate([[0], cut]).astype(np.int64)]
    tails = starts[np.concatenate([cut - 1, [len(starts) - 1]]).astype(np.int64)] + window
    return [(int(a), int(b - a)) for a, b in zip(heads, tails, strict=True)]


def _cleaned(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "spans", "n_removed", "digest", "kept"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    for batch in batches:
        for part in common.chunks(batch, "text"):
            spans, removed, digests, kept = [], [], [], []
            for text, starts in zip(part.column("text").to_pylist(), part.column("starts").to_pylist(), strict=True):
                words = (text or "").encode().split()
                found = _spans(np.asarray(starts, np.int64), window)
                rest, last = [], 0
                for start, length in found:
                    rest += words[last:start]
                    last = start + length
                rest += words[last:]
                joined = b" ".join(rest)
                spans.append([{"start": a, "length": n} for a, n in found])
                removed.append(len(words) - len(rest))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode())
            yield common.batch_of(names, [part.column("doc_id"), pa.array(spans, kind), pa.array(removed, pa.int64()), digests, kept])


def repeated_windows(documents: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Words covered by a window of ``window`` words that also starts elsewhere, and the text without them.

    Takes documents(doc_id, text); other columns are ignored. Returns one row a document: ``doc_id, n_words,
    n_removed, digest`` (SHA-256 of the kept words joined by a space), ``spans`` (start and length in words of what
    was removed; null if all words went with a copy of the whole text) and, with ``with_text``, ``kept`` (the kept
    words; null where nothing was removed: the text stands as it is).

    Words are runs of anything but ASCII white space. Windows are judged on the input, in all documents and in
    the same one. Null and empty texts have no words. Rows equal in id and text are one document; other texts
    under the same id and rows without id are documents of their own. An empty table gives no rows.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", "text")
    if common.ids_repeat(texts, "doc_id"):
        rows = common.numbered(common.folded(texts, "doc_id", ["text"]), "doc_id")
        return common.renamed(repeated_windows(rows.select(F.col("_row").alias("doc_id"), "text"), window, with_text), rows)
    profile = common.written(texts.mapInArrow(lambda b: _profile(b, window), f"doc_id {kind}, n_words bigint, class binary, digest string, prints array<bigint>"))
    classes = common.written(profile.groupBy("class").agg(F.min(F.struct("doc_id")).alias("head"), F.count("*").alias("copies")))
    same = F.col("doc_id").eqNullSafe(F.col("_doc"))
    heads = profile.select("doc_id", "prints").join(classes.select(F.col("head.doc_id").alias("_doc")), same)
    places = heads.select("doc_id", F.explode("prints").alias("print"))
    counts = common.written(places.groupBy("print").agg(F.count("*").alias("n"), F.min(F.struct("doc_id")).alias("owner")).where("n > 1").select("print", "owner.doc_id"))
    asked = counts.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("print").alias("asked"))
    owners = texts.join(asked, same).select("text", "asked")
    spelled = common.written(owners.mapInArrow(lambda b: _spelled(b, window), "print bigint, phrase binary"))
    hits = common.skew_join(places, spelled, "print").groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("phrase").alias("phrases"))

    # Shards are bounded slices of the partitions that this join deals.
    shards = texts.join(hits, same).select("doc_id", "text", "phrases")
    located = common.written(shards.mapInArrow(lambda b: _located(b, window), f"doc_id {kind}, h1 bigint, h2 int, start int"))
    again = located.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select(F.struct("h1", "h2").alias("_again"))
    starts = common.written(located.join(again, F.struct("h1", "h2") == F.col("_again")).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("start").alias("starts")))
    brief = common.written(profile.drop("prints"))
    common.discard(located, profile, counts, spelled)
    cleaned = texts.join(starts, same).select("doc_id", "text", "starts")
    fields = f"doc_id {kind}, spans array<struct<start:bigint,length:bigint>>, n_removed bigint, digest string, kept string"
    cleaned = cleaned.mapInArrow(lambda b: _cleaned(b, window), fields)
    names = ["spans", "n_removed", "digest", *(["kept"] if with_text else [])]
    cleaned = cleaned.select(F.col("doc_id").alias("_d"), *[F.col(c).alias(f"_{c}") for c in names])

    # A class of several documents recurs as a whole if it has a window at all.
    copies = common.skew_join(brief, classes, "class")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    out = copies.join(cleaned, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    none = F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")
    result = [
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("_n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, nothing).otherwise(F.coalesce("_digest", "digest")).alias("digest"),
        F.when(~whole, F.coalesce("_spans", none)).alias("spans"),
    ]
    if with_text:
        result.append(F.when(whole, F.lit("")).otherwise(F.col("_kept")).alias("kept"))
    return out.select(*result)
