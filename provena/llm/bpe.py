"""Byte-level BPE: encoding in length-bucketed padded matrices, and decoding.

Each distinct piece of a chunk is one matrix row of token ids, padded to the length of its bucket. In every
round each row merges its leftmost pair of minimum rank: ranks come from a hashed pair table, and the row
is compacted by one column. A piece that is a token as a whole is that token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from provena.llm import common

NONE = np.int32(np.iinfo(np.int32).max)
# Pieces beyond this length are merged one by one, every occurrence of a pair at once where that is the same.
LONG_PIECE = 256
# Distinct pieces whose ids a Python worker keeps between chunks.
KEPT_PIECES = 200_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Ranks of a tiktoken file as arrays: bytes of each token, and the hashed table of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self._index(np.array(keys, np.uint64), np.array(values, np.int32))

    def _index(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(10, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.full(1 << bits, NONE, np.int32)
        slot = (keys * _SPREAD) >> self.shift
        open_ = np.arange(len(keys))
        while len(open_):
            # Of the keys that want one free slot, one gets it; the others go on to the next.
            free = open_[self.keys[slot[open_]] == _EMPTY]
            self.keys[slot[free]] = keys[free]
            settled = self.keys[slot[open_]] == keys[open_]
            self.values[slot[open_[settled]]] = values[open_[settled]]
            open_ = open_[~settled]
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where no token joins it or an id is padding (-1)."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint32)
        key[(left < 0) | (right < 0)] = _EMPTY - np.uint64(1)
        slot = (key * _SPREAD) >> self.shift
        out = np.full(key.shape, NONE, np.int32)
        held = self.keys[slot]
        hit = held == key
        out[hit] = self.values[slot[hit]]
        todo = np.flatnonzero(~hit & (held != _EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != _EMPTY)]
        return out

    # --- encoding ---------------------------------------------------------------------------------

    def merge_rows(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of one bucket, one after another, and their counts."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        final = np.full((len(pieces), width), -1, np.int32)
        final[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rows, ids = np.arange(len(pieces)), final.copy()
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        while ids.shape[1] > 1:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(ranks)), at]
            open_ = best != NONE
            if not open_.all():
                done = ~open_
                final[rows[done]] = -1
                final[rows[done], : ids.shape[1]] = ids[done]
                rows, ids, ranks, at, best = rows[open_], ids[open_], ranks[open_], at[open_], best[open_]
            if not len(rows):
                break
            line, width = np.arange(len(rows)), ids.shape[1] - 1
            ids[line, at] = best
            after = np.arange(width) > at[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            ranks = np.where(after[:, : width - 1], ranks[:, 1:], ranks[:, :-1])
            if width > 1:
                for place, ok in ((at - 1, at > 0), (at, at < width - 1)):
                    r, p = line[ok], place[ok]
                    ranks[r, p] = self.pair_ranks(ids[r, p], ids[r, p + 1])
        if len(rows):
            final[rows] = -1
            final[rows, : ids.shape[1]] = ids
        held = final >= 0
        return final[held], held.sum(axis=1)

    def merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            ranks = self.pair_ranks(ids[:-1], ids[1:])
            best = ranks.min()
            if best == NONE:
                break
            at = np.flatnonzero(ranks == best)
            # In a run of overlapping pairs every second one stands.
            run = np.ones(len(at), bool)
            run[1:] = np.diff(at) > 1
            heads = np.flatnonzero(run)
            at = at[(np.arange(len(at)) - heads[np.cumsum(run) - 1]) % 2 == 0]
            around = np.concatenate([[-1], ids, [-1]]).astype(np.int32)
            new = np.full(len(at), best, np.int32)
            near = min(self.pair_ranks(around[at], new).min(), self.pair_ranks(new, around[at + 3]).min(), self.pair_ranks(new[:1], new[:1]).min())
            if near < best:  # a new pair would come before the other occurrences
                at = at[:1]
            ids = ids.copy()
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                out[i] = self.merge_long(piece).astype("<u4").tobytes()
            else:
                buckets.setdefault((len(piece) + 3) // 4 if len(piece) <= 16 else 2 + len(piece).bit_length(), []).append(i)
        for members in buckets.values():
            ids, counts = self.merge_rows([pieces[i] for i in members])
            flat, end = ids.astype("<u4").tobytes(), 0
            for i, n in zip(members, counts.tolist(), strict=True):
                out[i] = flat[end : end + 4 * n]
                end += 4 * n
        return out

    # --- decoding ---------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, one after another, and the byte count of each."""
        counts = self.lengths[ids]
        return self.bytes[ragged(self.begin[ids], counts)], counts


def ragged(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes begin[i], begin[i]+1, ... of all ranges, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(begin - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _sums(counts: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Sums of the first parts[0] counts, of the next parts[1], ..."""
    total = np.concatenate([[0], np.cumsum(counts)])
    ends = np.cumsum(parts)
    return total[ends] - total[ends - parts]


def _run(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, pattern: str, decode: bool) -> Iterator[pa.RecordBatch]:
    split = regex.compile(pattern).findall
    kept: dict[str, bytes] = {}
    for batch in batches:
        for part in common.chunks(batch, "text"):
            pieces, counts = [], []
            for text in part.column("text").to_pylist():
                found = split(text) if text else []
                pieces += found
                counts.append(len(found))
            coded = pa.array(pieces, pa.large_string()).dictionary_encode()
            del pieces
            distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            fresh = [p for p in distinct if p not in kept]
            kept.update(zip(fresh, vocabulary.encode_pieces([p.encode() for p in fresh]), strict=True))
            ids_of = [kept[p] for p in distinct]
            if len(kept) > KEPT_PIECES:
                kept.clear()
            flat = np.frombuffer(b"".join(ids_of), "<u4")
            sizes = np.array([len(x) for x in ids_of], np.int64) // 4
            begin = np.cumsum(sizes) - sizes
            taken = sizes[at]
            ids = flat[ragged(begin[at], taken)] if len(at) else flat[:0]
            per_text = _sums(taken, np.array(counts, np.int64))
            arrays = [part.column("doc_id"), common.as_binaries(ids, per_text)]
            if decode:
                data, lengths = vocabulary.decode(ids)
                arrays.append(common.as_binaries(data, _sums(lengths, per_text)))
            yield common.batch_of(["doc_id", "ids", "decoded"][: len(arrays)], arrays)


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.chunks(batch, "ids"):
            raw = [x or b"" for x in part.column("ids").to_pylist()]
            ids = np.frombuffer(b"".join(raw), "<u4")
            data, lengths = vocabulary.decode(ids)
            yield common.batch_of(["doc_id", "decoded"], [part.column("doc_id"), common.as_binaries(data, _sums(lengths, np.array([len(x) // 4 for x in raw], np.int64)))])


def _shared(documents: DataFrame, path: str):
    """The parsed rank file, sent to each executor once; its size is that of the file, not of the data."""
    return documents.sparkSession.sparkContext.broadcast(Vocabulary(load_ranks(path)))


def encode(documents: DataFrame, path: str, pattern: str, decode: bool = False) -> DataFrame:
    """Token ids of documents(doc_id, text): ``doc_id, ids`` (binary, little-endian unsigned 32-bit) and, if asked,
    ``decoded`` (the bytes of those ids).

    ``path`` is a tiktoken rank file that the driver reads, ``pattern`` cuts the pieces. Texts are cut whole, without
    special tokens. Null and empty texts give empty binaries; each row gives a row, repeated ones too; other
    columns are ignored.
    """
    shared = _shared(documents, path)
    kind = documents.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, ids binary" + (", decoded binary" if decode else "")
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _run(b, shared.value, pattern, decode), fields)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Bytes of tokens(doc_id, ids) as ``encode`` gives them: ``doc_id, decoded``; null ids give no bytes."""
    shared = _shared(tokens, path)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(lambda b: _decoded(b, shared.value), f"doc_id {kind}, decoded binary")
