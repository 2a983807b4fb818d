"""Embedding near-duplicates by collision counting on one-dimensional projections.

Each vector has values on many random directions. In the sorted order of one direction a vector collides with all
whose values lie in a window centred at its own; near vectors collide on almost every direction. Pairs with at
least so many collisions that pairs at the least wanted cosine reach it with the wanted recall are verified by
their cosine.

Vectors meet in tiles, so that only a small part of all pairs is counted: a table halves the vectors of a label by
one direction after another, and a vector whose window reaches over a cut is a guest on both sides. Several
tables, each with directions of its own, make up for pairs that a cut parts. A pair is counted in the first
table in which it meets. Large tiles are cut into cells of bounded blocks, and cells return numbers of links and
a spanning forest, never their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from provena.llm import common, jaccard

COSINE = 0.98
DIRECTIONS, TABLES = 32, 3
# Deviations of a pair at the least cosine: half width of a window, and of that at a cut.
WINDOW, REACH = 2.0, 1.0
RECALL = 0.999
TILE, BLOCK = 512, 1024
MAX_DEPTH = 40
_SEED = 20


def usable(vector: str) -> F.Column:
    """Whether a vector has a direction: no component null or not finite, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def directions(dim: int, count: int, salt: int) -> np.ndarray:
    """Unit vectors, the same in every task."""
    out = np.random.default_rng([_SEED, salt, dim]).normal(size=(count, dim))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def deviation(dim: int, cosine: float) -> float:
    """Standard deviation, over random directions, of the difference of two unit vectors at a cosine."""
    return math.sqrt(max(2 - 2 * cosine, 0) / max(dim, 1))


def wanted_collisions(count: int, window: float, recall: float) -> int:
    """The most collisions that a pair at the least cosine reaches with probability ``recall``."""
    p = math.erf(window / math.sqrt(2))
    reached = 0.0
    for least in range(count, -1, -1):
        reached += math.comb(count, least) * p**least * (1 - p) ** (count - least)
        if reached >= recall:
            return least
    return 0


def unit(vectors: np.ndarray) -> np.ndarray:
    out = vectors.astype(np.float64)
    out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def collisions(left: np.ndarray, right: np.ndarray, width: float) -> np.ndarray:
    """On how many directions the right values lie in the window of the left: rows are values by direction."""
    count = np.zeros((left.shape[1], right.shape[1]), np.int16)
    for own, other in zip(left, right, strict=True):
        order = np.argsort(other)
        ranked = other[order]
        first, last = np.searchsorted(ranked, own - width, "left"), np.searchsorted(ranked, own + width, "right")
        place = np.arange(len(order))
        inside = np.empty(count.shape, bool)
        inside[:, order] = (place >= first[:, None]) & (place < last[:, None])
        count += inside
    return count


def _stacked(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by label and length."""
    for batch in batches:
        for dim in pc.unique(batch.column("dim")).to_pylist():
            part = batch.filter(pc.equal(batch.column("dim"), dim))
            labels = part.column("label").dictionary_encode()
            at = labels.indices.to_numpy()
            total = np.zeros((len(labels.dictionary), dim))
            np.add.at(total, at, unit(_stacked(part.column("v"))))
            n = len(total)
            yield common.batch_of(["label", "dim", "n", "total"], [labels.dictionary, np.full(n, dim, np.int32), np.bincount(at, minlength=n), common.as_lists(pa.array(total.ravel()), np.full(n, dim))])


def _marks(vectors: np.ndarray, means: np.ndarray, depth: int, tables: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Side of each cut, and whether the window reaches over it, as bits by table."""
    home, guest = np.zeros((len(vectors), tables), np.int64), np.zeros((len(vectors), tables), np.int64)
    for t in range(tables):
        for level, axis in enumerate(directions(vectors.shape[1], MAX_DEPTH, 1 + t)[:depth]):
            gap = vectors @ axis - means @ axis
            home[:, t] |= (gap > 0).astype(np.int64) << level
            guest[:, t] |= (np.abs(gap) <= reach).astype(np.int64) << level
    return home, guest


def _visits(home: np.ndarray, guest: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, tile) for every tile that a row visits."""
    rows, tiles = np.arange(len(home)), home.copy()
    for level in range(depth):
        over = np.flatnonzero(guest[rows] >> level & 1)
        rows, tiles = np.concatenate([rows, rows[over]]), np.concatenate([tiles, tiles[over] ^ (1 << level)])
    return rows, tiles


def _placed(batches: Iterator[pa.RecordBatch], tables: int, cosine: float, reach: float) -> Iterator[pa.RecordBatch]:
    """Rows of (head, label, dim, v, depth, mean) by table and tile; ``own`` marks the tile a row belongs to."""
    names = ["head", "label", "dim", "home", "guest", "table", "tile", "own"]
    for batch in batches:
        dims, depths = batch.column("dim").to_numpy(), batch.column("depth").to_numpy()
        for dim, depth in sorted(set(zip(dims.tolist(), depths.tolist(), strict=True))):
            part = batch.filter(pa.array((dims == dim) & (depths == depth)))
            vectors = unit(_stacked(part.column("v")))
            home, guest = _marks(vectors, _stacked(part.column("mean")), depth, tables, reach * deviation(dim, cosine))
            bits = [common.as_lists(pa.array(x.ravel()), np.full(len(x), tables)) for x in (home, guest)]
            for t in range(tables):
                rows, tiles = _visits(home[:, t], guest[:, t], depth)
                take = pa.array(rows)
                columns = [part.column(c).take(take) for c in ("head", "label", "dim")] + [b.take(take) for b in bits]
                yield common.batch_of(names, [*columns, np.full(len(rows), t, np.int32), tiles, tiles == home[rows, t]])


def _cell(table: pa.Table, cosine: float, window: float, least: int, tables: int) -> pa.Table:
    """Links between the guests and owners of a cell: numbers of links, and a spanning forest of them."""
    table = table.combine_chunks()
    sides = table["side"].to_numpy()
    head, weight = table["head"].to_numpy(), table["weight"].to_numpy()
    home, guest = (_stacked(table[c].chunk(0)) for c in ("home", "guest"))
    vectors, t = unit(_stacked(table["v"].chunk(0))), table["table"][0].as_py()
    asking, asked = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    values = directions(vectors.shape[1], DIRECTIONS, 0) @ vectors.T
    width = window * deviation(vectors.shape[1], cosine)
    near = collisions(values[:, asking], values[:, asked], width) >= least
    i, j = np.nonzero(near & (head[asking][:, None] != head[asked][None]))
    a, b = asking[i], asked[j]
    # A pair counts where it meets first: by table, then with the smaller id as guest.
    early = np.zeros(len(a), bool)
    for earlier in range(t):
        apart = home[a, earlier] ^ home[b, earlier]
        early |= (apart & ~guest[a, earlier] == 0) | (apart & ~guest[b, earlier] == 0)
    early |= (head[a] > head[b]) & ((home[a, t] ^ home[b, t]) & ~guest[b, t] == 0)
    a, b = a[~early], b[~early]
    linked = np.zeros(len(a), bool)
    for start in range(0, len(a), 1 << 16):
        part = slice(start, start + (1 << 16))
        linked[part] = np.einsum("ij,ij->i", vectors[a[part]], vectors[b[part]]) >= cosine
    a, b = head[a[linked]], head[b[linked]]
    ids, back = np.unique(head, return_index=True)
    weights = weight[back]
    u, v = np.searchsorted(ids, a), np.searchsorted(ids, b)
    links = np.bincount(u, weights[v], len(ids)) + np.bincount(v, weights[u], len(ids))
    parent = np.arange(len(ids))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            forest.append((x, y))
    some = np.flatnonzero(links)
    ends = np.array(forest, np.int64).reshape(-1, 2)
    empty = lambda n: pa.nulls(n, pa.int64())
    return pa.table(
        {
            "a": pa.concat_arrays([pa.array(ids[some]), pa.array(ids[ends[:, 0]])]),
            "b": pa.concat_arrays([empty(len(some)), pa.array(ids[ends[:, 1]])]),
            "n": pa.concat_arrays([pa.array(links[some].astype(np.int64)), empty(len(ends))]),
        }
    )


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, window: float = WINDOW, reach: float = REACH, recall: float = RECALL) -> DataFrame:
    """Groups of vectors of one label that link, directly or in chains, by a cosine of at least ``cosine``.

    Takes vectors(vec_id long, embedding array, label); other columns are ignored. Every link that is returned is
    verified in double precision; links are found with a recall that ``recall`` (collisions of a pair) and ``tables``
    (meetings of a pair) set, 0.99 or more with the defaults. Returns ``vec_id, n_links`` (other vectors linked
    directly), ``component_id`` (least vec_id reachable by links) and ``kept`` (whether it is the least itself).

    A vector links with nothing if it, its label or a component is null, if a component is not finite, or if it is
    zero; vectors of other lengths do not link. Equal vectors of a label are one class and link with each other. Each
    row is a vector of its own, also one that repeats an id; rows without id sort last, so their group has the least
    id that it holds, or none. An empty table gives no rows.
    """
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").alias("v"))
    if own.groupBy("vec_id").count().where("count > 1 or vec_id is null").isEmpty():
        rows = own.withColumn("row", F.col("vec_id"))
    else:
        rows = common.numbered(own, "vec_id").withColumnRenamed("_row", "row")
    keyed = F.when(F.col("label").isNotNull() & usable("v"), F.struct("label", F.xxhash64("v"), F.xxhash64("v", F.lit(1))))
    rows = rows.withColumn("key", keyed)
    brief = common.written(rows.select("row", "vec_id", "key"))
    classes = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("row").alias("head"), F.count("*").alias("weight"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    classes = common.written(classes.withColumn("dim", F.size("v")))

    # Cuts of a label go through its mean; one more for each doubling of its size.
    label = classes.schema["label"].dataType.simpleString()
    sums = classes.select("label", "dim", "v").mapInArrow(_sums, f"label {label}, dim int, n bigint, total array<double>")
    sums = sums.select("label", "dim", "n", F.posexplode("total").alias("at", "x")).groupBy("label", "dim", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    means = sums.groupBy("label", "dim").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("x") / F.col("n")))), lambda s: s["col2"]).alias("mean"))
    depth = F.least(F.lit(MAX_DEPTH), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / TILE)))).cast("int")
    means = means.select(F.struct("label", "dim").alias("set"), depth.alias("depth"), "mean")
    ready = common.skew_join(classes.withColumn("set", F.struct("label", "dim")), means, "set")
    fields = f"head bigint, label {label}, dim int, home array<bigint>, guest array<bigint>, table int, tile bigint, own boolean"
    ready = ready.select("head", "label", "dim", "v", "depth", "mean")
    placed = ready.mapInArrow(lambda b: _placed(b, tables, cosine, reach), fields)
    keys = ["label", "dim", "table", "tile"]
    placed = common.written(placed)
    sizes = placed.groupBy(*keys).agg(F.count_if("own").alias("owners"), F.count("*").alias("all"))
    sizes = sizes.where("owners > 0 and `all` > 1").select(F.struct(*keys).alias("place"), F.ceil(F.col("owners") / BLOCK).cast("int").alias("right"), F.ceil(F.col("all") / BLOCK).cast("int").alias("left"))
    dealt = common.skew_join(placed.withColumn("place", F.struct(*keys)), sizes, "place")
    # Everyone asks, owners answer: a block of askers meets every block of owners of its tile.
    spread = lambda own, other: F.struct(F.pmod(F.xxhash64("head", F.lit(3)), F.col(own)).cast("int").alias("at"), F.sequence(F.lit(0), F.col(other) - 1).alias("all"))
    ask = dealt.withColumn("_s", spread("left", "right")).select("*", F.col("_s.at").alias("q"), F.explode("_s.all").alias("c"), F.lit(0).alias("side"))
    answer = dealt.where("own").withColumn("_s", spread("right", "left")).select("*", F.explode("_s.all").alias("q"), F.col("_s.at").alias("c"), F.lit(1).alias("side"))
    columns = [*keys, "q", "c", "side", "head", "home", "guest"]
    least = wanted_collisions(DIRECTIONS, window, recall)
    # Vectors join last, and move once for each cell that they are in.
    cells = ask.select(*columns).union(answer.select(*columns))
    cells = cells.join(classes.select("head", "weight", "v"), "head").groupBy(*keys, "q", "c")
    found = common.written(cells.applyInArrow(lambda t: _cell(t, cosine, window, least, tables), "a bigint, b bigint, n bigint"))
    common.discard(placed)
    counts = found.where("n is not null").groupBy(F.col("a").alias("head")).agg(F.sum("n").alias("others"))
    reached = jaccard.components(found.where("n is null").select("a", "b"))
    named = classes.select("key", "head", "weight").join(counts, "head", "left").join(reached.withColumnRenamed("node", "head"), "head", "left")
    named = named.select("key", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "head").alias("first"))
    out = common.skew_join(brief, named, "key", "left").select("row", "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("first", "row").alias("first"))
    ids = brief.select(F.col("row").alias("first"), F.col("vec_id").alias("component_id"))
    named = common.skew_join(out, ids, "first", "left")
    return named.select("vec_id", "n_links", "component_id", (F.col("first").isNull() | (F.col("row") == F.col("first"))).alias("kept"))
