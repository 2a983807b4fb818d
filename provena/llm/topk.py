"""Exact top-k search by distributed histogram selection.

Vectors become integers, so scores are exact. Every query block meets every candidate block once a round; a cell
scores everything and returns, for each query, the counts of its scores in the bins of the query's present
range. The summed histograms show which bin holds the kth score, and the next round refines that bin, until it
is one value wide. A last round keeps what lies above the kth score, and of its ties the smallest ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from provena.llm import common

# A cell returns at most k bins a query, so many bins cost memory only: ranges of 2^24 values take two rounds.
BINS = 4096
QUERY_ROWS, CANDIDATE_ROWS = 512, 4096
# Query blocks that share one copy of a candidate block, at most.
GROUP_BLOCKS = 32
# Squared length of a scaled vector; products of two such vectors stay within a long.
LIMIT = 1 << 60


def quantized(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, null if the vector is null or too long, or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    square = F.aggregate(F.col(vector), F.lit(0.0), lambda n, x: n + (x.cast("double") * scale) * (x.cast("double") * scale))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return F.when(F.col(vector).isNotNull() & ~bad & (square < float(LIMIT)), whole)


def _pack(table: pa.Table) -> pa.Table:
    """One row for a block: its ids in order, and its vectors in that order."""
    order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
    ids = table["vec_id"].to_numpy()[order]
    vectors = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
    return pa.table({"dim": pa.array([vectors.shape[1]], pa.int32()), "block": table["block"][:1].cast(pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([np.ascontiguousarray(vectors).tobytes()], pa.binary())})


def _blocks(frame: DataFrame, rows: int) -> tuple[DataFrame, int]:
    blocks = max(1, math.ceil(frame.count() / rows))
    dealt = frame.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    packed = dealt.groupBy("dim", "block").applyInArrow(_pack, "dim int, block int, ids binary, vectors binary")
    return common.written(packed), blocks


def _matrix(data: pa.Scalar, dim: int) -> np.ndarray:
    return np.frombuffer(data.as_py(), np.int64).reshape(-1, dim)


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(query ids, candidate ids, scores, state of the queries) of each cell."""
    for i in range(batch.num_rows):
        dim = batch.column("dim")[i].as_py()
        q_ids, c_ids = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("q_ids", "ids"))
        q, c = ((_matrix(batch.column(x)[i], dim) if dim else np.zeros((len(ids), 0), np.int64)) for x, ids in (("q_vectors", q_ids), ("vectors", c_ids)))
        top = [int(np.abs(m).max()) if m.size else 0 for m in (q, c)]
        if dim * top[0] * top[1] < 1 << 53:  # sums stay exact in doubles
            scores = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
        else:
            scores = q @ c.T
        state = {s: np.array(batch.column(s)[i].as_py(), np.int64) for s in ("low", "width", "span")}
        yield q_ids, c_ids, scores, state


def _histograms(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Counts by bin, from the top, as far down as the cell itself could hold the kth score."""
    for batch in batches:
        for q_ids, c_ids, scores, state in _cells(batch):
            below = scores - state["low"][:, None]
            bins = below // state["width"][:, None]
            use = (below >= 0) & (below < state["span"][:, None]) & (q_ids[:, None] != c_ids[None])
            n = len(q_ids)
            flat = (np.arange(n)[:, None] * BINS + bins)[use]
            counts = np.bincount(flat, minlength=n * BINS).reshape(n, BINS)
            above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            query, bin_ = np.nonzero((counts > 0) & (above < k))
            yield common.batch_of(["query_id", "bin", "n"], [q_ids[query], bin_.astype(np.int64), counts[query, bin_].astype(np.int64)])


def _winners(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for q_ids, c_ids, scores, state in _cells(batch):
            own = q_ids[:, None] == c_ids[None]
            least = state["low"][:, None]
            tie = (scores == least) & ~own
            # Ids are in order, so the first k ties of a cell are its smallest.
            keep = ((scores > least) & ~own) | (tie & (np.cumsum(tie, axis=1) <= k))
            query, at = np.nonzero(keep)
            yield common.batch_of(["query_id", "vec_id", "score"], [q_ids[query], c_ids[at], scores[query, at]])


def search(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """The ``k`` highest integer inner products of each query among all other rows.

    Takes vectors(vec_id long, embedding array); ``queries`` is a condition on vec_id. Returns ``query_id, rank``
    (from 1), ``vec_id, score``, ties to the smaller vec_id; a query with fewer candidates gets all of them.

    Rows take no part if the id or the vector is null, if a component is null or not finite, or if the squared length
    of the scaled vector is 2^60 or more, as its scores may leave a long. Rows that repeat
    an id are one row (of the least vector). Vectors of another length than the query's are no candidates, so an
    empty vector only meets empty ones, with score 0. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantized("embedding", scale).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    rows = common.written(rows)
    asked = rows.where(queries)
    square = F.aggregate("v", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    bound = [frame.agg(F.max(square)).first()[0] for frame in (rows, asked)]
    shape = "query_id long, rank int, vec_id long, score long"
    if bound[1] is None:
        return spark.createDataFrame([], shape)
    reach = math.ceil(math.sqrt(bound[0]) * math.sqrt(bound[1]) * (1 + 1e-9)) + 1

    candidates, n = _blocks(rows, CANDIDATE_ROWS)
    blocks, _ = _blocks(asked, QUERY_ROWS)
    blocks = blocks.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    parts = max(1, math.ceil(asked.count() / QUERY_ROWS))
    # Groups of query blocks: small enough that there are a few cells a task, and bounded.
    groups = min(parts, max(math.ceil(parts / GROUP_BLOCKS), math.ceil(4 * common.partitions(spark) / n)))
    cell = ["dim", "block", "q_group"]
    # An explicit partition count: adaptive execution would fold narrow inputs into a few long tasks.
    right = candidates.withColumn("q_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(common.partitions(spark), *cell)

    def cells(state: DataFrame) -> DataFrame:
        """Query blocks with their ranges beside each candidate block; keys are even, blocks are bounded.

        Blocks are files of few rows, whose copies Spark takes for small: the join asks for a merge, so that no driver holds them.
        """
        held = state.groupBy("dim", "q_block").agg(F.array_sort(F.collect_list(F.struct("query_id", "low", "width", "span"))).alias("s"))
        held = blocks.join(held, ["dim", "q_block"]).select("dim", F.pmod("q_block", F.lit(groups)).alias("q_group"), "q_ids", "q_vectors", F.col("s.low").alias("low"), F.col("s.width").alias("width"), F.col("s.span").alias("span"))
        held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(common.partitions(spark), *cell)
        return held.hint("merge").join(right.hint("merge"), cell).drop("block", "q_group")

    width = max(1, -(-(2 * reach + 1) // BINS))
    state = asked.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("q_block"), F.col("vec_id").alias("query_id"), F.lit(-reach).cast("bigint").alias("low"), F.lit(width).cast("bigint").alias("width"), F.lit(2 * reach + 1).cast("bigint").alias("span"), F.lit(0).cast("bigint").alias("above"))
    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    while True:
        counts = cells(state).mapInArrow(lambda b: _histograms(b, k), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        upto = counts.join(state.select("query_id", F.col("above").alias("_a")), "query_id").withColumn("upto", F.sum("n").over(down) + F.col("_a"))
        # The kth score lies in the first bin that reaches k; with fewer candidates everything is kept.
        found = upto.where(F.col("upto") >= k).groupBy("query_id").agg(F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))).alias("f"))
        last = width == 1
        span, width = width, max(1, -(-width // BINS))
        state = common.written(
            state.join(found, "query_id", "left").select(
                "dim", "q_block", "query_id",
                F.when(F.col("f").isNull(), F.lit(-reach)).otherwise(F.col("low") + F.col("f.bin") * F.col("width")).cast("bigint").alias("low"),
                F.lit(width).cast("bigint").alias("width"),
                F.lit(span).cast("bigint").alias("span"),
                F.coalesce("f.above", "above").alias("above"),
            )
        )
        if last:
            break
    kept = cells(state).mapInArrow(lambda b: _winners(b, k), "query_id long, vec_id long, score long")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
