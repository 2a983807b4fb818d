"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is ``w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j``. The pair sum is taken in linear
time with the sum-of-squares identity: half of ``(sum v x)^2 - sum (v x)^2`` in each of the few factors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from provena.llm import common
from provena.llm.toxicity import Adam

WORD_BUCKETS, FACTORS = 1 << 14, 6
# Bounds of learning; scoring has none.
PER_LABEL, TRAIN_CHARS, ROUNDS = (1500, 3000), 8000, 14

LINES = common.byte_table(b"\n", lower=False)
STATISTICS = (
    "words", "characters", "word_length", "capitals", "digits", "marks", "exclamations", "bars", "symbols", "spaces", "beyond_ascii",
    "distinct_words", "commonest_word", "same_as_before", "lines", "line_length", "repeated_lines", "words_without_letters", "one_letter_words", "metadata_length",
)
_CLASSES = {
    "capitals": range(0x41, 0x5B), "digits": range(0x30, 0x3A), "exclamations": b"!", "bars": b"|", "symbols": b"#$%&*@^_~<>{}[]\\/=+",
    "spaces": common.WHITE, "beyond_ascii": range(0x80, 0x100), "marks": b"!\"'(),-.:;?",
}
_CLASS_TABLES = {name: np.isin(np.arange(256), list(members)).astype(np.float64) for name, members in _CLASSES.items()}
_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def features(texts: pa.Array, sizes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of the texts (bucket, weight, count of entries a text) and the statistics (texts, names)."""
    words = common.Words(texts, common.WHITE_LOWER)
    n, owner = words.count, words.text_of()
    texts_n = len(n)
    total = np.maximum(n, 1).astype(np.float64)
    bytes_n = np.maximum(np.diff(words.offsets), 1).astype(np.float64)
    stats = {}
    place = np.repeat(np.arange(texts_n), np.diff(words.offsets))
    kinds = np.bincount(place * 256 + words.source, minlength=texts_n * 256).reshape(texts_n, 256)
    for name, table in _CLASS_TABLES.items():
        stats[name] = kinds @ table / bytes_n
    lengths = words.ends - words.starts
    stats["words"], stats["characters"] = np.log1p(n), np.log1p(np.diff(words.offsets))
    stats["word_length"] = np.bincount(owner, lengths, texts_n) / total
    stats["one_letter_words"] = np.bincount(owner, lengths == 1, texts_n) / total
    letters = np.concatenate([[0], np.cumsum(_LETTER[words.source])])
    stats["words_without_letters"] = np.bincount(owner, letters[words.ends] == letters[words.starts], texts_n) / total
    same = np.zeros(len(words), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    stats["same_as_before"] = np.bincount(owner, same, texts_n) / total

    # Entries of a text are its distinct words; those in one bucket add up in the sums below.
    order = np.lexsort((words.hash, owner))
    hashes, of = words.hash[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(order))).astype(np.float64)
    of, entries = of[heads], np.bincount(of[heads], minlength=texts_n)
    buckets = (hashes[heads] % np.uint64(WORD_BUCKETS)).astype(np.int64)
    weights = np.log1p(counts)
    norm = np.sqrt(np.bincount(of, weights**2, texts_n))
    weights = weights / np.maximum(norm, 1e-9)[of]
    stats["distinct_words"] = entries / total
    top = np.zeros(texts_n)
    np.maximum.at(top, of, counts)
    stats["commonest_word"] = top / total

    lines = common.Words(texts, LINES)
    line_n = np.maximum(lines.count, 1).astype(np.float64)
    line_owner = lines.text_of()
    distinct = np.unique(np.stack([line_owner.astype(np.uint64), lines.hash]), axis=1)[0].astype(np.int64) if len(lines) else np.zeros(0, np.int64)
    stats["lines"], stats["line_length"] = np.log1p(lines.count), np.log1p(bytes_n / line_n)
    stats["repeated_lines"] = 1 - np.bincount(distinct, minlength=texts_n) / line_n
    stated = np.nan_to_num(sizes.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))
    stats["metadata_length"] = np.log1p(np.clip(stated, 0, None))
    return buckets, weights.astype(np.float32), entries, np.stack([stats[s] for s in STATISTICS], axis=1)


class Machine:
    """Weights of words first, then of statistics, which enter scaled to the sample."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = WORD_BUCKETS + len(STATISTICS)
        self.mean, self.scale = mean, scale
        self.p = {"w": np.zeros(size, np.float32), "v": rng.standard_normal((size, FACTORS)).astype(np.float32) * np.float32(0.05), "w0": np.zeros(1, np.float32)}

    def joined(self, buckets, weights, entries, stats):
        """Entries of each text followed by its statistics."""
        scaled = np.clip((stats - self.mean) / self.scale, -4, 4).astype(np.float32) * np.float32(0.5)
        texts, s = scaled.shape
        counts = entries + s
        ends = np.cumsum(counts)
        stat_at = ((ends - s)[:, None] + np.arange(s)).ravel()
        index, value = np.empty(int(ends[-1]) if texts else 0, np.int64), np.empty(int(ends[-1]) if texts else 0, np.float32)
        is_word = np.ones(len(index), bool)
        is_word[stat_at] = False
        index[stat_at], value[stat_at] = np.tile(WORD_BUCKETS + np.arange(s), texts), scaled.ravel()
        index[is_word], value[is_word] = buckets, weights
        return index, value, counts

    def logits(self, index, value, counts):
        vx = self.p["v"][index] * value[:, None]
        sums = common.segment_sums(vx, counts)
        squares = common.segment_sums(vx * vx, counts)
        linear = common.segment_sums(self.p["w"][index] * value, counts)
        return self.p["w0"][0] + linear + 0.5 * (sums * sums - squares).sum(axis=1), vx, sums

    def gradients(self, index, value, counts, labels, importance, decay: float):
        logits, vx, sums = self.logits(index, value, counts)
        d = (importance * (common.sigmoid(logits) - labels) / len(labels)).astype(np.float32)
        each = np.repeat(d, counts) * value
        g_w = np.bincount(index, each, len(self.p["w"])).astype(np.float32) + decay * self.p["w"]
        g_v = decay * self.p["v"]
        np.add.at(g_v, index, each[:, None] * (np.repeat(sums, counts, axis=0) - vx))
        return {"w": g_w, "v": g_v, "w0": np.array([d.sum()], np.float32)}


def train(texts: list[str], sizes: list[int | None], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Machine | None:
    """A machine from labelled texts; None where a label is missing altogether."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return None
    parts = [features(pa.array(texts[i : i + 200], pa.string()), pa.array(sizes[i : i + 200], pa.int64())) for i in range(0, len(texts), 200)]
    buckets, weights, entries, stats = (np.concatenate(x) for x in zip(*parts, strict=True))
    machine = Machine(stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6), seed)
    index, value, counts = machine.joined(buckets, weights, entries, stats)
    begins = np.cumsum(counts) - counts
    rng, adam = np.random.default_rng(seed), Adam(machine.p, 0.02)
    # Both labels weigh half each, however many there are.
    importance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for turn in range(rounds):
        adam.rate = 0.02 * (1 - turn / rounds) + 0.001
        for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 64)):
            c = counts[part]
            take = np.repeat(begins[part] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            adam.step(machine.gradients(index[take], value[take], c, labels[part], importance[part], 1e-5))
    return machine


def _scored(batches: Iterator[pa.RecordBatch], machine: Machine | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.chunks(batch, "text"):
            if machine is None:
                score = np.zeros(part.num_rows)
            else:
                logits, _, _ = machine.logits(*machine.joined(*features(part.column("text"), part.column("n_chars"))))
                score = common.sigmoid(logits.astype(np.float64))
            yield common.batch_of(["doc_id", "score"], [part.column("doc_id"), score])


def score(documents: DataFrame, labelled: DataFrame, per_label: tuple[int, int] = PER_LABEL, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """Quality of documents(doc_id, text, n_chars): ``doc_id, score`` (0 to 1, higher: label 1 likelier).

    ``labelled`` (doc_id, quality 0 or 1) names the rows of ``documents`` to learn from; rows with a null id or
    label teach nothing. Learning takes at most ``per_label`` texts of label 0 and of 1, of at most ``train_chars``
    characters; scoring reads every text whole. A null text counts as empty and a null ``n_chars`` as 0; an empty
    text is scored by its statistics. If a label is missing altogether, every text scores 0. Each row gives a row,
    repeated ones too; other columns are ignored.
    """
    rows = common.training_rows(documents, labelled, "quality", per_label, train_chars, ("n_chars",))
    shared = documents.sparkSession.sparkContext.broadcast(train(rows["text"].to_pylist(), rows["n_chars"].to_pylist(), rows["label"].to_numpy()))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("n_chars").cast("bigint").alias("n_chars"))
    return rows.mapInArrow(lambda b: _scored(b, shared.value), f"doc_id {kind}, score double")
