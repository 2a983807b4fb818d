"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word enters as the sum of a hashed word vector and the mean of its hashed character n-gram vectors. The
network reads windows of 32 words, each overlapping the next by half; a text scores as its worst window.
Labels belong to whole texts, so training alternates between choosing the window of each text that scores
highest and learning from the chosen windows (multiple-instance learning).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from provena.llm import common

STEPS, STRIDE = 32, 16
HIDDEN, INPUT, LOOK = 8, 12, 8
WORD_BUCKETS, CHAR_BUCKETS, CHAR_SIZES = 8192, 4096, (3, 4)
BLOCK = 2048

# Bounds of learning; scoring has none.
PER_LABEL, TRAIN_CHARS, ROUNDS = (2000, 700), 6000, 16


class Network:
    """Parameters, forward pass and gradients. Direction 0 reads forwards, 1 backwards."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)

        self.p = {
            "word": rng.standard_normal((WORD_BUCKETS, INPUT)).astype(np.float32) * np.float32(0.1),
            "char": rng.standard_normal((CHAR_BUCKETS, INPUT)).astype(np.float32) * np.float32(0.1),
            "win": normal(2, INPUT, 3 * HIDDEN), "rec": normal(2, HIDDEN, 3 * HIDDEN), "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "look": normal(2 * HIDDEN, LOOK), "key": normal(LOOK, 1)[:, 0], "out": normal(2 * HIDDEN, 1)[:, 0] * np.float32(0.3), "base": np.zeros(1, np.float32),
        }

    # --- words ---

    def inputs(self, buckets: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        chars = common.segment_sums(self.p["char"][grams], counts) / np.maximum(counts, 1)[:, None].astype(np.float32)
        return self.p["word"][buckets] + chars

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        """Input part of the gates, (2, words, 3 * HIDDEN); one more word of zeros stands for padding."""
        gates = np.matmul(inputs[None], self.p["win"]) + self.p["bias"]
        return np.concatenate([gates, np.zeros((2, 1, gates.shape[2]), np.float32)], axis=1)

    # --- windows: words (windows, STEPS), padding is the last word ---

    def forward(self, gates: np.ndarray, words: np.ndarray, keep: bool = False):
        pad = gates.shape[1] - 1
        n, h3 = len(words), HIDDEN
        flat = gates.reshape(-1, 3 * h3)
        state = np.zeros((2, n, h3), np.float32)
        states = np.empty((STEPS, n, 2 * h3), np.float32)
        trail = []
        for t in range(STEPS):
            both = np.stack([words[:, t], words[:, STEPS - 1 - t]])
            x = flat[both + np.array([[0], [pad + 1]])]
            rec = np.matmul(state, self.p["rec"])
            rz = fast_sigmoid(x[..., : 2 * h3] + rec[..., : 2 * h3])
            r, z = rz[..., :h3], rz[..., h3:]
            new = np.tanh(x[..., 2 * h3 :] + r * rec[..., 2 * h3 :])
            step = new + z * (state - new)
            real = (both != pad)[..., None]
            step = np.where(real, step, state)
            if keep:
                trail.append((both, state, r, z, new, rec[..., 2 * h3 :], real))
            state = step
            states[t, :, :h3] = state[0]
            states[STEPS - 1 - t, :, h3:] = state[1]
        seen = np.tanh(states @ self.p["look"])
        weight = seen @ self.p["key"]
        weight = np.where(words.T != pad, weight, np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logits = pooled @ self.p["out"] + self.p["base"][0]
        return (logits, (states, seen, weight, pooled, trail)) if keep else logits

    def learn(self, inputs: np.ndarray, words: np.ndarray, labels: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean log loss, and of the word inputs."""
        p, h = self.p, HIDDEN
        gates = self.gates(inputs)
        logits, (states, seen, weight, pooled, trail) = self.forward(gates, words, keep=True)
        n = len(words)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        d_logit = ((common.sigmoid(logits) - labels) / n).astype(np.float32)
        g["base"][0], g["out"] = d_logit.sum(), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_states = weight[..., None] * d_pooled
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["key"] = np.einsum("tn,tna->a", d_score, seen)
        d_seen = d_score[..., None] * p["key"] * (1 - seen * seen)
        g["look"] = np.einsum("tnh,tna->ha", states, d_seen)
        d_states += d_seen @ p["look"].T
        d_gates = np.zeros_like(gates)
        back = np.zeros((2, n, h), np.float32)
        for t in reversed(range(STEPS)):
            both, before, r, z, new, rec, real = trail[t]
            d = back + np.stack([d_states[t, :, :h], d_states[STEPS - 1 - t, :, h:]])
            held = np.where(real, 0, d)
            d = np.where(real, d, 0)
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * rec * r * (1 - r)
            d_x = np.concatenate([d_r, d_z, d_new], axis=2)
            d_rec = np.concatenate([d_r, d_z, d_new * r], axis=2)
            g["rec"] += np.matmul(before.transpose(0, 2, 1), d_rec)
            back = held + d * z + np.matmul(d_rec, p["rec"].transpose(0, 2, 1))
            for way in (0, 1):
                np.add.at(d_gates[way], both[way], d_x[way])
        d_gates = d_gates[:, :-1]
        g["bias"] = d_gates.sum(axis=1, keepdims=True)
        g["win"] = np.matmul(inputs.T[None], d_gates)
        d_inputs = np.matmul(d_gates, p["win"].transpose(0, 2, 1)).sum(axis=0)
        return g, d_inputs


def fast_sigmoid(x: np.ndarray) -> np.ndarray:
    """Logistic function by tanh, which is fast on float32."""
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        fix = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


class Lexicon:
    """Distinct words of a chunk with their features, and the windows of its texts over them."""

    def __init__(self, texts: pa.Array):
        words = common.Words(texts, common.LETTERS)
        distinct, first, self.at = np.unique(words.hash, return_index=True, return_inverse=True)
        self.buckets = (distinct % np.uint64(WORD_BUCKETS)).astype(np.int64)
        self.grams, self.counts = common.word_grams(words, first, CHAR_SIZES, CHAR_BUCKETS)
        self.words = words
        # A text of n words has windows at 0, STRIDE, ... until one reaches its end; without words it has none.
        n = words.count
        self.per_text = np.where(n > 0, np.maximum(0, -(-(n - STEPS) // STRIDE)) + 1, 0)
        self.owner = np.repeat(np.arange(len(n)), self.per_text)
        place = (np.arange(len(self.owner)) - np.repeat(np.cumsum(self.per_text) - self.per_text, self.per_text)) * STRIDE
        self.start = words.first[self.owner] + place
        self.end = words.first[self.owner + 1]

    def windows(self, rows: np.ndarray) -> np.ndarray:
        places = self.start[rows][:, None] + np.arange(STEPS)
        inside = places < self.end[rows][:, None]
        return np.where(inside, self.at[np.where(inside, places, 0)] if len(self.at) else 0, len(self.buckets))


def window_logits(net: Network, lexicon: Lexicon) -> np.ndarray:
    gates = net.gates(net.inputs(lexicon.buckets, lexicon.grams, lexicon.counts))
    out = np.empty(len(lexicon.owner), np.float32)
    for begin in range(0, len(out), BLOCK):
        rows = np.arange(begin, min(begin + BLOCK, len(out)))
        out[rows] = net.forward(gates, lexicon.windows(rows))
    return out


def text_logits(net: Network, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Highest window of each text and its number among all windows; texts without words get -30 and -1."""
    logits = window_logits(net, lexicon)
    best, which = np.full(len(lexicon.per_text), -30.0, np.float32), np.full(len(lexicon.per_text), -1)
    full = lexicon.per_text > 0
    if full.any():
        order = np.lexsort((logits, lexicon.owner))
        last = order[np.cumsum(lexicon.per_text)[full] - 1]
        best[full], which[full] = logits[last], last
    return best, which


def _first_choice(lexicon: Lexicon, labels: np.ndarray) -> np.ndarray:
    """Before there is a network: the window with the word most telling of label 1 in the sample."""
    n = len(lexicon.buckets)
    pairs = np.unique(lexicon.words.text_of() * (n + 1) + lexicon.at)
    word, label = pairs % (n + 1), labels[pairs // (n + 1)]
    one = np.bincount(word[label == 1], minlength=n) + 0.5
    zero = np.bincount(word[label == 0], minlength=n) + 0.5
    telling = np.append(np.log(one / (labels.sum() + 1)) - np.log(zero / ((1 - labels).sum() + 1)), -np.inf)
    value = telling[lexicon.windows(np.arange(len(lexicon.owner)))].max(axis=1)
    order = np.lexsort((value, lexicon.owner))
    return order[np.cumsum(lexicon.per_text) - 1]


def train(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> Network | None:
    """A network from labelled texts; None where a label is missing altogether."""
    labels = np.asarray(labels, np.int64)
    keep = common.Words(pa.array(texts, pa.string()), common.LETTERS, hashed=False).count > 0 if len(texts) else np.zeros(0, bool)
    texts, labels = [t for t, k in zip(texts, keep, strict=True) if k], labels[keep]
    if len(set(labels.tolist())) < 2:
        return None
    rng, net, lexicon = np.random.default_rng(seed), Network(seed), Lexicon(pa.array(texts, pa.string()))
    adam = Adam(net.p, 0.01)
    chosen = _first_choice(lexicon, labels)
    for turn in range(rounds):
        if turn >= 4:
            chosen = text_logits(net, lexicon)[1]
        # Another window of each text without label 1 as well: all of its windows are clean.
        spare = np.cumsum(lexicon.per_text) - lexicon.per_text + (rng.random(len(texts)) * lexicon.per_text).astype(np.int64)
        rows = np.concatenate([chosen, spare[labels == 0]])
        target = np.concatenate([labels, np.zeros((labels == 0).sum(), np.int64)])
        # Few texts make small steps, so that there are enough of them.
        for part in np.array_split(rng.permutation(len(rows)), max(len(rows) // 96, min(16, len(rows) // 8), 1)):
            windows = lexicon.windows(rows[part])
            used, local = np.unique(windows, return_inverse=True)
            used = used[used < len(lexicon.buckets)]
            local = local.reshape(windows.shape)
            begins = np.cumsum(lexicon.counts) - lexicon.counts
            counts = lexicon.counts[used]
            grams = lexicon.grams[np.repeat(begins[used] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
            inputs = net.inputs(lexicon.buckets[used], grams, counts)
            grads, d_inputs = net.learn(inputs, local, target[part])
            grads["word"], grads["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(grads["word"], lexicon.buckets[used], d_inputs)
            np.add.at(grads["char"], grams, np.repeat(d_inputs / np.maximum(counts, 1)[:, None], counts, axis=0))
            adam.step(grads)
    return net


def _learn(rows: pa.Table) -> Network | None:
    return train(rows["text"].to_pylist(), rows["label"].to_numpy())


def _scored(batches: Iterator[pa.RecordBatch], net: Network | None, base: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.chunks(batch, "text"):
            if net is None:
                score, windows = np.full(part.num_rows, base), np.zeros(part.num_rows, np.int64)
            else:
                lexicon = Lexicon(part.column("text"))
                best, _ = text_logits(net, lexicon)
                score, windows = common.sigmoid(best.astype(np.float64)), lexicon.per_text
            yield common.batch_of(["doc_id", "score", "n_windows"], [part.column("doc_id"), score, windows.astype(np.int64)])


def score(documents: DataFrame, labelled: DataFrame, per_label: tuple[int, int] = PER_LABEL, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """Toxicity of documents(doc_id, text): ``doc_id, score`` (0 to 1) and ``n_windows``.

    ``labelled`` (doc_id, toxic 0 or 1) names the rows of ``documents`` to learn from; rows with a null id or label
    teach nothing. Learning takes at most ``per_label`` texts of label 0 and of 1, of at most ``train_chars`` characters;
    scoring reads all windows of every text. Null, empty and wordless texts score next to 0. If a label is missing
    altogether, every text scores 0. Each row gives a row, repeated ones too; other columns are ignored.
    """
    sample = common.training_frame(documents, labelled, "toxic", per_label, train_chars)
    shared = documents.sparkSession.sparkContext.broadcast(common.learned(sample, _learn))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _scored(b, shared.value, 0.0), f"doc_id {kind}, score double, n_windows bigint")


def _clean(batches: Iterator[pa.RecordBatch], net: Network | None, text: str, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.chunks(batch, text):
            if net is not None:
                best, _ = text_logits(net, Lexicon(part.column(text)))
                part = part.filter(pa.array(common.sigmoid(best.astype(np.float64)) < threshold))
            yield part


def reject(documents: DataFrame, labelled: DataFrame, threshold: float = 0.7, per_label: tuple[int, int] = PER_LABEL, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """The rows of ``documents`` that score below ``threshold``, with all their columns; else as ``score``."""
    sample = common.training_frame(documents, labelled, "toxic", per_label, train_chars)
    shared = documents.sparkSession.sparkContext.broadcast(common.learned(sample, _learn))
    # Columns travel under plain numbers, whatever their names.
    numbered = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])
    text = f"c{documents.columns.index('text')}"
    return numbered.mapInArrow(lambda b: _clean(b, shared.value, text, threshold), numbered.schema).toDF(*documents.columns)
