"""Exact n-gram Jaccard join with prefix filters under several global token orders.

Texts of one shingle set are one class. In every order a class shows its rarest shingles as a prefix, so long that
two sets of the wanted similarity must share a shingle in it. The orders put shingles of rarer count buckets
first and break ties differently. Classes meet by the first order's prefixes; what meets must share a shingle in the
prefixes of all other orders too, before any set is compared.

Prefix tokens of many classes do not make pairs: their classes are tied to the least one, and whatever is tied
together, by pairs or by such tokens, is a family. Families are compared in cells of bounded blocks that return
only links which join something new, so a large group of near copies costs no row for each of its pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from provena.llm import common

SHINGLE, PERCENT = 3, 90
ORDERS = 3
COUNT_BITS = 20
# Tokens of up to this many classes make pairs; classes of a block in a cell of a family.
PAIR_CLASSES, BLOCK_CLASSES = 32, 128
# Shingles of a block, on average at most (or one longer text).
BLOCK_SHINGLES = 1 << 18
# Bits that tell rows that a join keeps from others, 2 MB at most.
MEMBER_BITS = 1 << 24
_CHUNKS = 64
# Bytes of texts that a task takes apart at a time, and rows that it is sent at a time.
TEXT_BYTES = 1 << 19
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_SALTS = [(j + 1) * 0x632BE59BD9B4E019 % (1 << 64) for j in range(8)]


def shingle_sets(words: common.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after another, and their counts."""
    grams, inside = words.grams(size)
    at = np.flatnonzero(inside)
    owner, tokens = words.text_of()[at], grams[at]
    # A text of fewer words is one shingle as a whole.
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(few):
        short = [_whole(words.hash[words.first[t] : words.first[t + 1]]) for t in few]
        owner, tokens = np.concatenate([owner, few]), np.concatenate([tokens, np.array(short, np.uint64)])
    order = np.lexsort((tokens, owner))
    owner, tokens = owner[order], tokens[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[new], np.bincount(owner[new], minlength=len(words.count))


def _whole(hashes: np.ndarray) -> np.uint64:
    value = np.array([len(hashes)], np.uint64)
    for h in hashes:
        value = common.mixed(value * np.uint64(0x9E3779B97F4A7C15) + h)
    return value[0]


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return size - -(-size * percent // 100) + 1


def _bucket(tokens: np.ndarray, order: int) -> np.ndarray:
    return (common.mixed(tokens ^ np.uint64(_SALTS[order])) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch], shingle: int, orders: int) -> Iterator[pa.RecordBatch]:
    """Shingles of a partition by count bucket of each order, in a fixed number of packed rows."""
    common.release()
    total = np.zeros((orders, 1 << COUNT_BITS), np.int32)
    for batch in batches:
        for part in common.chunks(batch, "text", TEXT_BYTES):
            tokens, _ = shingle_sets(common.Words(part.column("text"), common.WHITE_LOWER), shingle)
            for j in range(orders):
                buckets, found = np.unique(_bucket(tokens, j), return_counts=True)
                total[j][buckets] += found.astype(np.int32)
    if total.any():
        yield _packed(enumerate(total.reshape(orders * _CHUNKS, -1)))


def _packed(slices: Iterable[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    numbers, counts = zip(*slices, strict=True)
    return common.batch_of(["slice", "counts"], [np.array(numbers, np.int32), pa.array([zlib.compress(x.astype(np.int32).tobytes(), 1) for x in counts], pa.binary())])


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), np.int32)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices that meet in a partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        # One slice at a time: a batch holds those of very many partitions.
        for slice_, counts in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
            own = _unpacked(counts.as_py()).astype(np.int64)
            total[slice_] = total[slice_] + own if slice_ in total else own
    if total:
        yield _packed((n, np.minimum(x, np.iinfo(np.int32).max)) for n, x in total.items())


def token_counts(texts: DataFrame, shingle: int, orders: int) -> np.ndarray:
    """Shingle counts over all texts, in 2^20 buckets for each order (4 MB an order, whatever the corpus).

    They only steer the orders: any counts give right results, better ones give shorter lists of candidates.
    """
    rows = texts.select("text").mapInArrow(lambda b: _counts(b, shingle, orders), "slice int, counts binary")
    rows = rows.repartition(_CHUNKS, "slice").mapInArrow(_added, "slice int, counts binary")
    total = np.zeros((orders * _CHUNKS, (1 << COUNT_BITS) // _CHUNKS), np.int32)
    for row in rows.toLocalIterator():
        total[row["slice"]] = _unpacked(row["counts"])
    return total.reshape(orders, -1)


def _profiles(batches: Iterator[pa.RecordBatch], shingle: int, percent: int, orders: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    common.release()
    names = ["doc_id", "n_shingles", "class", *[f"prefix{j}" for j in range(orders)]]
    for batch in batches:
        for part in common.chunks(batch, "text", TEXT_BYTES):
            tokens, sizes = shingle_sets(common.Words(part.column("text"), common.WHITE_LOWER), shingle)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            parts = [common.segment_sums(common.mixed(tokens + np.uint64(salt)), sizes) for salt in (1, 2)]
            parts = np.ascontiguousarray(np.stack([*parts, sizes.astype(np.uint64)], axis=1))
            classes = common.as_binaries(parts.ravel(), np.full(len(sizes), 3))
            take = np.where(sizes > 0, prefix_length(sizes, percent), 0)
            begins = np.cumsum(sizes) - sizes
            index = np.repeat(begins - (np.cumsum(take) - take), take) + np.arange(take.sum())
            prefixes = []
            for j in range(orders):
                # Rare first by the counts of this order, ties by its hash.
                place = counts[j][_bucket(tokens, j)].astype(np.uint64) << np.uint64(32) | common.mixed(tokens ^ np.uint64(_SALTS[j])) & np.uint64(0xFFFFFFFF)
                shown = tokens[np.lexsort((place, owner))][index]
                # Only the first order's shingles are looked up; the others are asked for overlaps, where half a hash drops no pair.
                prefixes.append(common.as_lists(pa.array(shown.astype(np.uint32).view(np.int32)) if j else common.signed(shown), take))
            yield common.batch_of(names, [part.column("doc_id"), sizes.astype(np.int64), classes, *prefixes])


# --- connected components ------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges(a, b): the least node reachable. Large-star and small-star steps in turn."""
    edges = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = common.skew_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = common.skew_join(large, least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct()
        edges = common.written(small)
        # Ids are never added up: sums of large ones leave a long.
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


# --- families ------------------------------------------------------------------------------------


def _links(tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray, groups: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets numbered ``left`` and sets numbered ``right`` that join two groups."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), sizes)
    _, at, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[at] > 1
    _, at = np.unique(at[shared], return_inverse=True)
    owner = owner[shared]
    common_n = np.zeros((len(left), len(right)), np.float32)
    place = np.full((2, len(tokens)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    for begin in range(0, int(at.max()) + 1 if len(at) else 0, 8192):
        own = (at >= begin) & (at < begin + 8192)
        sides = []
        for side, members in ((0, left), (1, right)):
            rows = place[side][owner[own]]
            matrix = np.zeros((len(members), 8192), np.float32)
            matrix[rows[rows >= 0], at[own][rows >= 0] - begin] = 1
            sides.append(matrix)
        common_n += sides[0] @ sides[1].T
    both = np.rint(common_n).astype(np.int64)
    near = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None] - both)
    # A small union-find keeps what joins something new.
    parent = {g: g for g in set(groups.tolist())}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    out = []
    for i, j in zip(*np.nonzero(near & (groups[left][:, None] != groups[right][None])), strict=True):
        a, b = root(int(groups[left[i]])), root(int(groups[right[j]]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(left[i]), int(right[j])))
    return out


def _cell(table: pa.Table, shingle: int, percent: int) -> pa.Table:
    """Compare the two sides of a cell; within a block both sides are the same rows."""
    common.release()
    ids, groups, side = table["node"].to_numpy(), table["label"].to_numpy(), table["side"].to_numpy()
    texts = table["text"].combine_chunks()
    tokens = []
    for part in common.chunks(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        flat, sizes = shingle_sets(common.Words(part.column("text"), common.WHITE_LOWER), shingle)
        tokens += np.split(flat, np.cumsum(sizes)[:-1])
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side != 0)
    links = _links(tokens, left, right, groups, percent) if len(left) and len(right) else []
    return pa.table({"a": pa.array([int(ids[i]) for i, _ in links], pa.int64()), "b": pa.array([int(ids[j]) for _, j in links], pa.int64())})


def _able(rows: DataFrame, key: str, members: DataFrame, own: str) -> DataFrame:
    """Rows whose ``key`` may be among ``members``: most others go where they are read, by a bitmap, before any is shuffled."""
    bits = min(MEMBER_BITS, 1 << max(6, (16 * members.count()).bit_length()))
    marked = lambda frame, c: frame.withColumn("_h", F.pmod(F.xxhash64(c), F.lit(bits))).withColumns({"_w": F.expr("shiftright(_h, 6)"), "_m": F.expr("shiftleft(1L, int(_h & 63))")})
    held = marked(members, own).groupBy("_w").agg(F.bit_or("_m").alias("_held"))
    return marked(rows, key).join(F.broadcast(held), "_w").where(F.expr("_held & _m") != 0).select(*rows.columns)


def _compared(cells: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """cells(node, label, family, left, right, side) with their texts, each cell compared in one task."""
    own = texts.join(cells, F.col("doc_id") == F.col("node")).select("node", "label", "family", "left", "right", "side", "text")
    return common.written(own.groupBy("family", "left", "right").applyInArrow(lambda t: _cell(t, shingle, percent), "a bigint, b bigint"))


def similar_sets(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """Groups of documents whose shingle sets link, directly or in chains.

    Takes documents(doc_id long, text); other columns are ignored. Two documents link when 100 * intersection >=
    percent * union of their sets of distinct ``shingle``-word shingles (words: runs of anything but ASCII white
    space, A-Z in lower case; a text of fewer words is one shingle). Returns one row a document: ``doc_id,
    n_shingles, class_id`` (least id of the same set) and ``component_id`` (least id reachable by links).

    Null, empty and wordless texts have no shingles and link with nothing. A row with a null id is a document of its own
    that links with nothing. Rows equal in id and text are one document, other texts under the same id are documents
    of their own. An empty table gives no rows.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if common.ids_repeat(texts.where("doc_id is not null"), "doc_id"):
        rows = common.numbered(common.folded(texts, "doc_id", ["text"]), "doc_id")
        found = similar_sets(rows.select(F.when(F.col("doc_id").isNotNull(), F.col("_row")).alias("doc_id"), "text"), shingle, percent, orders)
        # Numbers have the order of the ids, so the least number of a group is that of its least id.
        for name in ("doc_id", "class_id", "component_id"):
            ids = rows.select(F.col("_row").alias(name), F.col("doc_id").alias("_id"))
            found = common.skew_join(found, ids, name, "left").drop(name).withColumnRenamed("_id", name)
        return found.select("doc_id", "n_shingles", "class_id", "component_id")
    counts = spark.sparkContext.broadcast(token_counts(texts, shingle, orders))  # 4 MB an order at any size
    lists = [f"prefix{j}" for j in range(orders)]
    fields = "doc_id bigint, n_shingles bigint, class binary, " + ", ".join(f"{p} array<{'int' if j else 'bigint'}>" for j, p in enumerate(lists))
    profiles = common.written(texts.mapInArrow(lambda b: _profiles(b, shingle, percent, orders, counts.value), fields), FEW_ROWS)
    counts.destroy()  # the profiles are written
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = common.written(profiles.where(linked).groupBy(F.col("class").alias("key")).agg(F.min("doc_id").alias("head")))
    # Merge joins: what grows with the corpus is shuffled alike at every size.
    heads = profiles.join(classes.select(F.col("head").alias("doc_id")).hint("merge"), "doc_id")

    # Prefix tokens of the first order that several classes share.
    # Each step is written, so that what it shuffled goes before the next one shuffles.
    places = common.written(heads.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode(lists[0]).alias("token")))
    several = common.written(places.groupBy("token").agg(F.count("*").alias("held"), F.min("node").alias("least")).where("held > 1"))
    shared = common.written(common.skew_join(_able(places, "token", several, "token"), several, "token"))
    common.discard(places, several)
    few = shared.where(F.col("held") <= PAIR_CLASSES).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("x"))
    able = lambda a, b: 100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])
    met = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: (b["node"] > a["node"]) & able(a, b)), lambda b: F.struct(a["node"].alias("a"), b["node"].alias("b")))))
    pairs = common.written(few.select(F.explode(met).alias("p")).select("p.a", "p.b").distinct())
    # The other orders: what shares nothing in one of their prefixes can't be similar enough.
    for p in lists[1:]:
        one = heads.select(F.col("doc_id").alias("_id"), F.col(p).alias("_p")).hint("merge")
        asked = pairs.join(one, F.col("a") == F.col("_id")).select("a", "b", F.col("_p").alias("_q"))
        asked = asked.join(one, F.col("b") == F.col("_id")).where(F.arrays_overlap("_q", "_p")).select("a", "b")
        before, pairs = pairs, common.written(asked)
        common.discard(before)
    ties = shared.where((F.col("held") > PAIR_CLASSES) & (F.col("node") != F.col("least"))).select(F.col("least").alias("a"), F.col("node").alias("b"))
    families = common.written(components(pairs.union(ties)).select("node", F.col("component").alias("family")))
    brief = common.written(profiles.select("doc_id", "n_shingles", "class"))
    common.discard(shared, profiles, pairs)

    # First cells: every block in itself, and every block of a large family against its block 0.
    blocks = lambda classes, shingles: F.greatest(F.ceil(classes / BLOCK_CLASSES), F.ceil(shingles / F.lit(BLOCK_SHINGLES))).cast("int")
    families = families.join(brief.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n")), "node")
    sizes = families.groupBy("family").agg(blocks(F.count("*"), F.sum("n")).alias("blocks"))
    placed = common.skew_join(families, sizes, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = common.written(placed)
    own = placed.select("node", F.col("node").alias("label"), "family", F.col("block").alias("left"), F.col("block").alias("right"), F.lit(2).alias("side"))
    first = placed.where("blocks > 1 and block > 0").select("node", F.col("node").alias("label"), "family", F.lit(0).alias("left"), F.col("block").alias("right"), F.lit(1).alias("side"))
    pivot = placed.where("blocks > 1 and block = 0").select("node", F.col("node").alias("label"), "family", F.lit(0).alias("left"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("right"), F.lit(0).alias("side"))
    # Texts move once, those of families alone; the cells read them from there.
    members = placed.select(F.col("node").alias("_n"))
    able = _able(texts.select("doc_id", "text"), "doc_id", members, "_n")
    texts = common.written(able.join(members.hint("merge"), F.col("doc_id") == F.col("_n")).select("doc_id", "text"))
    links = _compared(own.union(first).union(pivot), texts, shingle, percent)

    # Large families: whoever is outside the largest part meets everyone else.
    large = placed.where("blocks > 2")
    if not large.isEmpty():
        joined = components(links)
        labelled = large.join(joined.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "n", "family", "block", "blocks", F.coalesce("component", "node").alias("label"))
        labelled = common.written(labelled)
        parts = labelled.groupBy("family", "label").agg(F.count("*").alias("classes"), F.sum("n").alias("n"))
        main = parts.groupBy("family").agg(F.max(F.struct("classes", F.col("label"))).alias("m")).select("family", F.col("m.label").alias("main"))
        rest = parts.join(main, "family").where(F.col("label") != F.col("main")).groupBy("family").agg(blocks(F.sum("classes"), F.sum("n")).alias("rows"))
        spread = common.skew_join(labelled, main.join(rest, "family"), "family")
        outside = spread.where(F.col("label") != F.col("main")).withColumn("left", F.pmod(F.xxhash64("node", F.lit(1)), F.col("rows")).cast("int"))
        outside = outside.select("node", "label", "family", "left", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("right"), F.lit(0).alias("side"))
        everyone = spread.select("node", "label", "family", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("left"), F.col("block").alias("right"), F.lit(1).alias("side"))
        links = links.union(_compared(outside.union(everyone), texts, shingle, percent))
    reached = components(links).select(F.col("node").alias("head"), "component")
    named = classes.join(reached, "head", "left").select("key", F.col("head").alias("class_id"), F.coalesce("component", "head").alias("component_id"))
    alone = F.encode(F.concat(F.lit("none "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8")
    everyone = brief.select("doc_id", "n_shingles", F.when(linked, F.col("class")).otherwise(alone).alias("key"))
    out = common.skew_join(everyone, named, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
