"""Building blocks that stay distributed when one group holds a large share of all rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from provena.session import cut_lineage, shuffle_partitions

# One block pair of a blocked comparison holds at most about this many rows a side.
BLOCK_ROWS = 2048
# Keys that a join splits at most; with more shuffle partitions than these, keys of a larger share are hot.
MAX_HOT_KEYS = 10_000


def _name(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item


def ranked(
    frame: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """1-based dense position of every row in its group, without a per-group sort task.

    Rows are range-partitioned on (group, order), so even a single hot group spreads over all
    partitions; positions inside a partition come from the row index and are shifted by the
    running size of the group in the partitions before it. ``order`` must end in a unique column.
    """
    spark = frame.sparkSession
    keys = [*map(F.col, group), *map(_name, order)]
    placed = (
        frame.repartitionByRange(shuffle_partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed).withColumn("_pid", F.shiftright("_mid", 33))
    # One row per (group, partition): the partition count bounds the rows of one group here.
    runs = placed.groupBy(*group, "_pid").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    over_group = Window.partitionBy(*group)
    before = over_group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.col("_pid").alias("_g_pid"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(over_group).alias("_total"),
    )
    match = F.col("_pid") == F.col("_g_pid")
    for column in group:
        match = match & F.col(column).eqNullSafe(F.col(f"_g_{column}"))
    joined = placed.join(runs, match).withColumn(rank, F.col("_mid") + F.col("_shift") + 1)
    if total:
        joined = joined.withColumn(total, F.col("_total"))
    return joined.select(*frame.columns, rank, *([total] if total else []))


def median(value: str) -> Column:
    """Exact median as an aggregate, for groups that a contract bounds; NULL is left out."""
    return F.percentile(value, 0.5)


def group_quantiles(frame: DataFrame, group: Sequence[str], value: str, probabilities: dict[str, float], method: str = "linear") -> DataFrame:
    """Exact quantiles of each group: ``linear`` interpolation or ``nearest`` rank (ceil(p*n)). Returns the group columns
    and one column a probability; values of NULL are left out, groups of NULL are groups.

    One plan for groups of any size. Equal values are counted first, so that no single value is hot; distinct values
    are range-partitioned on (group, value) and written once. A value's rank is its running count inside its
    partition, shifted by the counts of its group in the partitions before; the value of a rank is the least one whose
    running count reaches it. No task holds more of a group than a range partition.
    """
    keys = [*map(F.col, group), F.col("_v")]
    counted = frame.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = counted.repartitionByRange(shuffle_partitions(frame.sparkSession), *keys).withColumn("_pid", F.spark_partition_id())
    placed = cut_lineage(placed)
    inside = Window.partitionBy(*group, "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed_sums = placed.withColumn("_upto", F.sum("_n").over(inside))
    over_group = Window.partitionBy(*group)
    runs = placed.groupBy(*group, "_pid").agg(F.sum("_n").alias("_own"))
    runs = runs.select(
        *[F.col(c).alias(f"_g_{c}") for c in group], F.col("_pid").alias("_g_pid"),
        (F.sum("_own").over(over_group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_own")).alias("_before"),
        F.sum("_own").over(over_group).alias("_total"),
    )
    match = F.col("_pid") == F.col("_g_pid")
    for column in group:
        match = match & F.col(column).eqNullSafe(F.col(f"_g_{column}"))
    # No quantile looks at other values than those around its rank.
    rows = placed_sums.join(runs, match).withColumn("_upto", F.col("_upto") + F.col("_before"))
    total = F.col("_total")
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    found = [F.max("_total").alias("_total")]
    for name, p in probabilities.items():
        if method == "linear":
            low = F.floor((total - 1) * F.lit(p))
            found += [at(low + 1).alias(f"_l_{name}"), at(F.ceil((total - 1) * F.lit(p)) + 1).alias(f"_h_{name}")]
        else:
            found.append(at(F.greatest(F.lit(1), F.ceil(F.lit(p) * total))).alias(f"_l_{name}"))
    best = rows.groupBy(*group).agg(*found)
    out = []
    for name, p in probabilities.items():
        low = F.col(f"_l_{name}")
        if method == "linear":
            place, high = (total - 1) * F.lit(p), F.col(f"_h_{name}")
            mixed = (F.floor(place) + 1 - place) * low + (place - F.floor(place)) * high
            low = F.when(low == high, low).otherwise(mixed)
        out.append(low.alias(name))
    return best.select(*group, *out)


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of ``right``, which has one row a key, beside the rows of ``left``; a key of NULL is a key."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") for c in keys], *[c for c in right.columns if c not in keys])
    match = F.lit(True)
    for column in keys:
        match = match & F.col(column).eqNullSafe(F.col(f"_r_{column}"))
    return left.join(named, match, "left").drop(*[f"_r_{c}" for c in keys])


def split_hot_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: str, how: str = "inner", spread_right: str | None = None) -> DataFrame:
    """Equi-join whose hot keys are spread over many tasks; other keys are untouched.

    A key with more rows than an even shuffle partition of its side is cut into parts of that size: left rows
    by ``spread_by``, and with ``spread_right`` (inner joins) right rows as well, each side repeated for the parts
    of the other. At most as many keys a side as there are shuffle partitions are hot, so their list is small. Each side
    is read once more to find them.
    """
    spark, partitions = left.sparkSession, shuffle_partitions(left.sparkSession)
    key = F.xxhash64(*keys)

    def hot(frame: DataFrame) -> dict[int, int]:
        """Parts of each hot key, by its hash: one aggregate counts the rows and sketches the most frequent keys."""
        items = min(partitions, MAX_HOT_KEYS)
        seen = frame.select(key.alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_h, {items}, {10 * items})").alias("top")).first()
        share = max(seen["n"] / partitions, 1.0)
        return {row["item"]: math.ceil(row["count"] / share) for row in seen["top"] or [] if row["item"] is not None and row["count"] > share}

    own, other = hot(left), hot(right) if spread_right else {}
    if not own and not other:
        return left.join(right, list(keys), how)
    # Any number of parts gives the same rows, so counts may be estimates.
    parts = F.broadcast(spark.createDataFrame([(h, own.get(h, 1), other.get(h, 1)) for h in sorted({*own, *other})], "_h bigint, _nl int, _nr int"))

    def placed(frame: DataFrame, mine: str, by: str | None, others: str) -> DataFrame:
        rows = frame.withColumn("_h", key).join(parts, "_h", "left")
        n_own, n_other = (F.coalesce(F.col(c), F.lit(1)) for c in (mine, others))
        at = F.pmod(F.xxhash64(by), n_own).cast("int") if by else F.lit(0)
        side = {"_nl": "_sl", "_nr": "_sr"}
        rows = rows.withColumns({side[mine]: at, side[others]: F.sequence(F.lit(0), n_other - 1)})
        return rows.withColumn(side[others], F.explode(side[others])).drop("_nl", "_nr", "_h")

    return placed(left, "_nl", spread_by, "_nr").join(placed(right, "_nr", spread_right, "_nl"), [*keys, "_sl", "_sr"], how).drop("_sl", "_sr")


def blocked_pairs(
    queries: DataFrame,
    targets: DataFrame,
    part: str,
    query_key: str,
    target_key: str,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
    query_rows: int = BLOCK_ROWS,
    target_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Compare queries with targets of the same ``part`` in bounded blocks.

    Each part is cut into a grid of (query block, target block) cells by key hash, so a part that
    holds most rows becomes many equal cells. ``kernel`` sees one cell and returns only what it
    keeps (local best, accepted pairs); pairs never become rows. Results of one query may come
    from several cells and have to be reduced by the caller.
    """
    sizes_q = queries.groupBy(part).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(query_rows)).cast("int").alias("_nq")
    )
    sizes_t = targets.groupBy(part).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(target_rows)).cast("int").alias("_nt")
    )
    grid = sizes_q.join(sizes_t, part)

    def blocks(frame: DataFrame, key: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        placed = (
            frame.join(grid, part)
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(own_n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
            .drop("_nq", "_nt")
        )
        # Fresh column identities: both sides may come from the same table.
        return placed.select(*[F.col(c).alias(c) for c in placed.columns])

    left = blocks(queries, query_key, "_qb", "_nq", "_tb", "_nt")
    right = blocks(targets, target_key, "_tb", "_nt", "_qb", "_nq")
    cell = [part, "_qb", "_tb"]

    def run(left_cell: pd.DataFrame, right_cell: pd.DataFrame) -> pd.DataFrame:
        return kernel(left_cell, right_cell)

    # An explicit partition count: adaptive execution would fold small inputs into one Python task.
    n = shuffle_partitions(queries.sparkSession)
    left, right = left.repartition(n, *cell), right.repartition(n, *cell)
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(run, schema)


def pinned(frame: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, however often later expressions use them.

    A plain projection may be merged into its users and repeated per use; a one-row generator is not.
    """
    kept = [c for c in frame.columns if c not in columns]
    return frame.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def top_rows(frame: DataFrame, group: Sequence[str], order: Iterable[Column], limit: int, rank: str = "rank") -> DataFrame:
    """First ``limit`` rows a group; Spark cuts each map task to ``limit`` rows before the shuffle."""
    spec = Window.partitionBy(*group).orderBy(*order)
    return frame.withColumn(rank, F.row_number().over(spec)).where(F.col(rank) <= limit)
