"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. One binary classifier over hashed byte n-grams of words predicts each
position. Decoding takes the codeword with the least weighted logistic loss; a close second marks the text as
ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from provena.llm import common

BUCKETS, SIZES = 1 << 13, (1, 2, 3)
# Bounds of learning; predictions have none.
PER_LANGUAGE, MAX_LANGUAGES, TRAIN_CHARS, ROUNDS = 400, 1000, 8000, 120
TRAIN_TEXTS = 100_000
AMBIGUOUS = 0.2
UNKNOWN = "und"


def codebook(classes: int, seed: int = 5) -> np.ndarray:
    """Codewords (classes, positions): all different splits for up to 5 classes, else the best of random ones."""
    if classes < 2:
        return np.ones((classes, 0), np.int8)
    if classes <= 5:
        # The first class is always +1, so no split is another's opposite.
        rows = [(1, *bits) for bits in itertools.product((1, -1), repeat=classes - 1) if -1 in bits]
        return np.array(rows, np.int8).T
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    best, distance = None, -1
    for _ in range(200):
        code = rng.choice(np.array([1, -1], np.int8), (classes, length))
        if (np.abs(code.sum(axis=0, dtype=np.int64)) == classes).any():
            continue
        gaps = (length - code.astype(np.int64) @ code.T.astype(np.int64)) // 2
        np.fill_diagonal(gaps, length)
        if gaps.min() > distance:
            best, distance = code, gaps.min()
    return best


def _grams(texts: pa.Array) -> tuple[common.Words, np.ndarray, np.ndarray, np.ndarray]:
    words = common.Words(texts, common.LETTERS)
    _, first, at = np.unique(words.hash, return_index=True, return_inverse=True)
    grams, counts = common.word_grams(words, first, SIZES, BUCKETS)
    return words, at, grams, counts


class Decoder:
    def __init__(self, languages: list[str], code: np.ndarray):
        self.languages, self.code = languages, code
        self.w = np.zeros((BUCKETS, code.shape[1]), np.float32)
        self.b = np.zeros(code.shape[1], np.float32)
        self.weights = np.ones(code.shape[1], np.float32)

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Output of each binary classifier: mean weight of the n-grams of a text, plus a bias."""
        words, at, grams, counts = _grams(texts)
        sums = common.segment_sums(self.w[grams], counts)
        total = common.segment_sums(sums[at], words.count)
        n = common.segment_sums(counts[at].astype(np.float32), words.count)
        return total / np.maximum(n, 1)[:, None] + self.b

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, confidence and gap to the second."""
        agreed = margins[:, None, :] * self.code[None]
        loss = (np.logaddexp(0, -agreed) * self.weights).sum(axis=2)
        likely = np.exp(loss.min(axis=1, keepdims=True) - loss)
        likely /= likely.sum(axis=1, keepdims=True)
        best = likely.argmax(axis=1)
        ordered = np.sort(likely, axis=1)
        gap = ordered[:, -1] - (ordered[:, -2] if likely.shape[1] > 1 else 0)
        return best, ordered[:, -1].astype(np.float64), gap


def train(texts: list[str], languages: list[str], rounds: int = ROUNDS) -> Decoder | None:
    """Binary logistic classifiers of all code positions, by full gradient steps; None without a text."""
    if not texts:
        return None
    names = sorted(set(languages))
    decoder = Decoder(names, codebook(len(names)))
    if len(names) == 1:
        return decoder
    shares = _shares(texts)
    # Frequent n-grams would rule the step size; scaled columns have like weights.
    square = sum((np.bincount(at, value.astype(np.float64) ** 2, BUCKETS) for at, value, _ in shares), np.zeros(BUCKETS))
    scale = (1 / (np.sqrt(square / len(texts)) + 1e-4)).astype(np.float32)
    number = {name: i for i, name in enumerate(names)}
    label = np.array([number[x] for x in languages])
    target = decoder.code[label].astype(np.float32)
    share = 1 / np.bincount(label)[label]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, b = np.zeros_like(decoder.w), np.zeros_like(decoder.b)
    rate = np.float32(4.0 / max(1.0, float((square * scale.astype(np.float64) ** 2).sum() / len(texts))))

    def batches() -> Iterator[tuple[np.ndarray, slice]]:
        """Rows of a batch as a dense matrix; between batches only their n-grams are held."""
        begin = 0
        for at, value, counts in shares:
            rows = np.zeros((len(counts), BUCKETS), np.float32)
            rows[np.repeat(np.arange(len(counts)), counts), at] = value * scale[at]
            yield rows, slice(begin, begin + len(counts))
            begin += len(counts)

    for _ in range(rounds):
        step, shift = np.float32(1e-5) * w, np.zeros_like(b)
        for rows, part in batches():
            slope = -target[part] * common.sigmoid(-target[part] * (rows @ w + b)) * share[part]
            step += rows.T @ slope
            shift += slope.sum(axis=0)
        w -= rate * step
        b -= np.float32(0.5) * shift
    decoder.w, decoder.b = w * scale[:, None], b
    right = np.zeros(len(b))
    for rows, part in batches():
        right += (share[part] * ((rows @ w + b) * target[part] > 0)).sum(axis=0)
    # Positions that learned their split badly say less.
    decoder.weights = np.clip(right * 2 - 1, 0.05, 1).astype(np.float32)
    return decoder


def _shares(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of texts as sparse rows: the n-grams of each text, their shares of it, and how many there are."""
    out = []
    for begin in range(0, len(texts), 200):
        words, at, grams, counts = _grams(pa.array(texts[begin : begin + 200], pa.string()))
        begins = np.cumsum(counts) - counts
        taken = counts[at]
        flat = grams[np.repeat(begins[at] - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())]
        cells, held = np.unique(np.repeat(words.text_of(), taken) * BUCKETS + flat, return_counts=True)
        text = cells // BUCKETS
        total = np.bincount(text, held, len(words.count))
        out.append(((cells % BUCKETS).astype(np.int32), (held / total[text]).astype(np.float32), np.bincount(text, minlength=len(words.count))))
    return out


def _predicted(batches: Iterator[pa.RecordBatch], decoder: Decoder | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.chunks(batch, "text"):
            known = part.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            names = np.full(part.num_rows, UNKNOWN, object)
            score, close = np.zeros(part.num_rows), np.ones(part.num_rows, bool)
            if decoder is not None:
                best, sure, gap = decoder.decode(decoder.margins(part.column("text")))
                names[known] = np.array(decoder.languages, object)[best[known]]
                score[known], close[known] = sure[known], gap[known] < AMBIGUOUS
            yield common.batch_of(["doc_id", "lang_pred", "score", "ambiguous"], [part.column("doc_id"), pa.array(names.tolist(), pa.string()), score, pa.array(close)])


def training_texts(documents: DataFrame, per_language: int, chars: int, languages: int = MAX_LANGUAGES, texts: int = TRAIN_TEXTS) -> pa.Table:
    """The first texts of each language by the hash of their id: up to ``per_language`` each and ``texts`` altogether, of up
    to ``chars`` characters, of the ``languages`` languages with the most of them.

    A language's texts are thinned by a threshold on the hash, set from its count so that enough stay; no task ranks
    all texts of a language.
    """
    able = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= chars))
    counts = able.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return able.select("doc_id", "text", "lang").limit(0).toArrow()
    each = max(1, min(per_language, texts // len(counts)))
    shares = documents.sparkSession.createDataFrame([(r["lang"], min(1.0, (4.0 * each + 100) / r["n"])) for r in counts], "_lang string, _share double")
    place = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    some = able.select("doc_id", "lang").join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(place <= F.col("_share"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).select("doc_id", F.col("lang").alias("_lang"))
    rows = able.select("doc_id", "text", "lang").join(F.broadcast(picked), "doc_id").where(F.col("lang") == F.col("_lang")).select("doc_id", "text", "lang").toArrow()
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("lang", "ascending")])


def identify(documents: DataFrame, labelled: DataFrame, per_language: int = PER_LANGUAGE, train_chars: int = TRAIN_CHARS, languages: int = MAX_LANGUAGES, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """Language of documents(doc_id, text): ``doc_id, lang_pred, score`` (0 to 1) and ``ambiguous``.

    ``labelled`` (doc_id, text, lang) are the rows to learn from: of the ``languages`` most frequent languages at most
    ``per_language`` texts each and ``train_texts`` altogether (with more languages each has fewer), up to
    ``train_chars`` characters long. Languages beyond these are never predicted. Predictions read every text whole. ``lang_pred`` is ``und`` (score 0,
    ambiguous) for texts that are null or hold no letter, and for all if there is nothing to learn from. Rows with
    a null text or language teach nothing. Each row gives a row, repeated ones too; other columns are ignored.
    """
    rows = training_texts(labelled, per_language, train_chars, languages, train_texts)
    shared = documents.sparkSession.sparkContext.broadcast(train(rows["text"].to_pylist(), rows["lang"].to_pylist()))
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return texts.mapInArrow(lambda b: _predicted(b, shared.value), f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
