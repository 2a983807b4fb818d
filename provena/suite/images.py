"""Image-array queries. Images are built from document bytes, so every one grows with the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from provena.functions import codewords, crypto
from provena.session import cut_lineage, shuffle_partitions
from provena.operators import evidence, hamming, imaging, summaries
from provena.plans import cascade, generate
from provena.suite.base import query, table
from provena.suite.reports import _hmac_sql

WIDTH, TILE_ROWS = 256, 128
KEY = b"0123456789abcdef0123456789abcdef"


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Balance heavy per-image work while the rows are still narrow (text, not pixels)."""
    return frame.repartition(shuffle_partitions(frame.sparkSession), key)


def framed(text: Column, width: int, row_step: int) -> tuple[Column, Column]:
    """(height, RGB bytes): the whole text as pixels, repeated to fill a height of full steps."""
    data = F.encode(text, "UTF-8")
    size = F.greatest(F.lit(1), F.octet_length(data))
    height = (F.ceil(size / F.lit(3 * width * row_step)) * row_step).cast("int")
    total = height * (3 * width)
    # Bytes are repeated as a string and cut as bytes: neither cast looks at them.
    filled = F.repeat(data.cast("string"), F.ceil(total / size).cast("int")).cast("binary")
    return height, F.substring(filled, F.lit(1), total)


def _image_columns() -> list[Column]:
    height, rgb = framed(F.col("text"), WIDTH, TILE_ROWS)
    return [F.col("doc_id").cast("string").alias("image_id"), F.lit(WIDTH).alias("width"), height.alias("height"), rgb.alias("rgb")]


def images(spark: SparkSession, folder: str) -> DataFrame:
    """One image per document, 256 pixels wide and as many 128-row tiles high as its text needs."""
    docs = spread(table(spark, folder, "documents").where(F.length("text") > 0), "doc_id")
    return docs.select(*_image_columns())


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").where(F.length("text") > 0), "doc_id")
    # The codeword comes from Python while the row holds the text: what waits for it there are no pixels.
    tag = F.substring(crypto.pixel_sha256(framed(F.col("text"), WIDTH, TILE_ROWS)[1]), 1, 8)
    rows = docs.select("doc_id", "text", tag.alias("tag")).withColumn("codeword", codewords.encode_codeword(F.col("tag")))
    return rows.select(*_image_columns(), "codeword", F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))).alias("protected"))


@query("embed_codewords")
def embed_codewords(spark: SparkSession, folder: str) -> DataFrame:
    marked = imaging.embed_codewords(_tagged(spark, folder))
    return marked.select("image_id", "width", "height", F.sha2("rgb", 256).alias("digest"), "error")


# Tiles of a document image: two columns, and one row of tiles per started 256 x 128 pixels of text.
_TILES = """t AS (SELECT doc_id, unnest(range(0, CAST(ceil(octet_length(encode(text)) / (3 * 256 * 128)) AS BIGINT))) AS y FROM documents WHERE length(text) > 0),
  g AS (SELECT CAST(doc_id AS VARCHAR) AS image_id, CAST(x AS INTEGER) AS tile_x, CAST(y AS INTEGER) AS tile_y, CAST((x + 2 * y) % 4 AS INTEGER) AS phase FROM t, (SELECT unnest(range(0, 2)) AS x))"""


@query(
    "pilot_signal",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.75 * ("
    + " + ".join(f"sin((l_partkey * {fx} + l_suppkey * {fy}) * 2 * pi() + {p!r}::DOUBLE)" for (fx, fy), p in zip(imaging.PILOT_FREQUENCIES, imaging.pilot_phases()))
    + "), 6) AS pilot FROM lineitem",
)
def pilot_signal(spark: SparkSession, folder: str) -> DataFrame:
    value = imaging.pilot_value(F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(value, 6).alias("pilot"))


@query("extract_tile_scores", "WITH " + _TILES + " SELECT *, 64 AS bits FROM g")
def extract_tile_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = imaging.extract_tile_scores(images(spark, folder))
    return rows.select("image_id", "tile_x", "tile_y", "phase", F.size(F.filter("scores", lambda s: ~F.isnan(s))).alias("bits"))


@query("embed_extract_roundtrip")
def embed_extract_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Embed, extract and accept: bit errors of every image against its own codeword."""
    tagged = _tagged(spark, folder)
    marked = imaging.embed_codewords(tagged).where(F.col("error").isNull())
    seen = evidence.tile_observation(imaging.extract_tile_scores(marked))
    joined = seen.join(tagged.select("image_id", F.col("codeword").alias("wanted")), "image_id")
    return joined.select("image_id", codewords.acceptance(F.col("codeword"), F.col("wanted"), F.col("confidences")).alias("r")).select("image_id", "r.*")


@query(
    "aligned_tiles",
    "WITH " + _TILES + " SELECT image_id, tile_x, tile_y, phase, round((128 - CASE tile_x WHEN 0 THEN 2 ELSE 0 END) * (128 - CASE tile_y WHEN 0 THEN 3 ELSE 0 END) / 16384, 6) AS coverage FROM g",
)
def aligned_tiles(spark: SparkSession, folder: str) -> DataFrame:
    matrix = F.array(*map(F.lit, (1.0, 0.0, 2.0, 0.0, 1.0, 3.0, 0.0, 0.0, 1.0)))
    pairs = images(spark, folder).withColumn("homography", matrix).withColumn("target_width", F.lit(WIDTH)).withColumn("target_height", F.col("height"))
    rows = imaging.aligned_tiles(pairs)
    return rows.select("image_id", "tile_x", "tile_y", "phase", F.round("coverage", 6).alias("coverage"))


@query(
    "bright_ratio",
    """WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE length(text) > 0),
         s AS (SELECT doc_id, list_aggregate(list_transform(range(0, length(h) // 2), lambda i: CASE WHEN substr(h, CAST(2 * i + 1 AS INTEGER), 2) >= 'CD' THEN 1 ELSE 0 END), 'sum') / (length(h) // 2) AS r FROM b)
       SELECT CAST(doc_id AS VARCHAR) AS image_id, round(r, 6) AS bright_ratio, r >= 0.05 AS bright FROM s""",
)
def bright_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Share of bright pixels; every byte of a text is one gray pixel of a one-row image."""
    docs = spread(table(spark, folder, "documents").where(F.length("text") > 0), "doc_id")
    data = F.encode("text", "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("image_id"), F.octet_length(data).alias("width"), F.lit(1).alias("height"), F.unhex(F.regexp_replace(F.hex(data), "(..)", "$1$1$1")).alias("rgb")
    )
    return evidence.bright_ratio(imaging.gray_histogram(rows)).withColumn("bright_ratio", F.round("bright_ratio", 6))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents against their reversed text as image pairs of equal size."""
    docs = spread(table(spark, folder, "documents").where(F.length("text") > 0), "doc_id")
    height, first = framed(F.col("text"), 32, 16)
    second, third = framed(F.reverse("text"), 32, 16)[1], framed(F.translate("text", "aeiou", "eioua"), 32, 16)[1]
    return docs.select(
        F.col("doc_id").cast("string").alias("pair"), F.lit(32).alias("width"), height.alias("height"), first.alias("first"), second.alias("second"), third.alias("third")
    )


@query("quality_metrics")
def quality_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.quality_metrics(_pairs(spark, folder))


@query("residual_correlation")
def residual_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Vowel-shifted texts as marked images: do they correlate with the text seen from its reverse?"""
    mask = F.unhex(F.repeat(F.lit("01"), F.col("width") * F.col("height")))
    rows = _pairs(spark, folder).select(
        "pair", "width", "height", F.col("first").alias("query"), F.col("second").alias("original"), F.col("third").alias("watermarked"), mask.alias("mask")
    )
    return imaging.residual_correlation(rows).withColumn("residual", F.round("residual", 6))


@query(
    "registered_original",
    """SELECT CAST(doc_id AS VARCHAR) AS image_id FROM documents d WHERE length(text) > 0 AND EXISTS (SELECT 1 FROM documents o WHERE o.lang = 'en' AND o.text = d.text)""",
)
def registered_original(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as suspects against the English ones as registered originals."""
    docs = table(spark, folder, "documents").where(F.length("text") > 0)
    shaped = docs.select(F.col("doc_id").cast("string").alias("image_id"), F.lit(1).alias("height"), "lang", F.encode("text", "UTF-8").alias("raw"))
    # Whole texts as one-row images: padded to full pixels, so that the width follows the text.
    padded = F.concat(F.col("raw"), F.unhex(F.repeat(F.lit("00"), F.pmod(-F.octet_length("raw"), F.lit(3)).cast("int"))))
    shaped = shaped.withColumn("rgb", padded).withColumn("width", (F.octet_length("rgb") / 3).cast("int")).drop("raw")
    return imaging.registered_originals(shaped.drop("lang"), shaped.where(F.col("lang") == "en").drop("lang"))


@query("robust_homography")
def robust_homography(spark: SparkSession, folder: str) -> DataFrame:
    """Line items of a supplier as point matches with noise; similarity first."""
    lines = table(spark, folder, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = lines.select(
        F.col("l_suppkey").cast("string").alias("pair"), (F.row_number().over(order) - 1).alias("query_kp"),
        F.pmod("l_partkey", F.lit(800)).cast("double").alias("qx"), (F.col("l_quantity") * 11).alias("qy"),
        (F.pmod("l_partkey", F.lit(800)) * 1.02 + 4 + F.col("l_discount") * 20).alias("tx"), (F.col("l_quantity") * 11 * 1.02 + 7 + F.col("l_tax") * 20).alias("ty"),
        F.lit(800).alias("query_width"), F.lit(600).alias("query_height"), F.lit(820).alias("target_width"), F.lit(620).alias("target_height"),
    )
    found = imaging.robust_homography(rows)
    return found.select("pair", "method", "good_matches", "inliers", F.round("reprojection_error", 3).alias("reprojection_error"))


@query(
    "descriptor_matches",
    """WITH w AS (SELECT doc_id, string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+') AS l FROM documents WHERE text IS NOT NULL),
       k AS (SELECT doc_id, word, min(i) AS i FROM (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS i FROM w) GROUP BY ALL),
       p AS (SELECT doc_id, word, i, """
    + ", ".join(f"CAST('0x' || substr(sha256(word), {1 + 8 * j}, 8) AS BIGINT) AS d{j}" for j in range(8))
    + """ FROM k),
       c AS (SELECT a.doc_id, a.i, a.word, b.word AS other, CAST("""
    + " + ".join(f"CAST(bit_count(xor(a.d{j}, b.d{j})) AS INTEGER)" for j in range(8))
    + """ AS INTEGER) AS gap FROM p a JOIN p b ON b.doc_id = a.doc_id + 1),
       m AS (SELECT doc_id, i, min(gap) AS first, list_sort(list(gap))[2] AS second FROM c GROUP BY ALL)
       SELECT doc_id || '|' || (doc_id + 1) AS pair, count(*) AS good_matches, count(*) FILTER (first = 0) AS equal_words FROM m WHERE first < 0.75 * second GROUP BY doc_id""",
)
def descriptor_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Ratio-test matches themselves: 32-byte digests of words as descriptors of neighbouring documents."""
    docs = table(spark, folder, "documents")
    # Distinct words bound an image's keypoints to its vocabulary.
    words = docs.where(F.col("text").isNotNull()).select("doc_id", F.array_distinct(F.split("text", r"\s+")).alias("w"))
    # A document's points stay in its row, and its words, a fraction of their digests, are what is shuffled.
    points = words.select(F.col("doc_id").cast("string").alias("owner_id"), F.transform("w", lambda _, i: i).alias("kp_idx"), F.col("w").alias("descriptor"))
    pairs = docs.select(F.col("doc_id").cast("string").alias("query_owner"), (F.col("doc_id") + 1).cast("string").alias("target_owner"))
    pairs = pairs.withColumn("pair", F.concat_ws("|", "query_owner", "target_owner"))
    digests = lambda words: F.transform(words, lambda w: F.unhex(F.sha2(F.encode(w, "UTF-8"), 256)))
    found = hamming.descriptor_matches(pairs, points, points, describe=digests)
    return found.groupBy("pair").agg(F.count(F.lit(1)).alias("good_matches"), F.count_if(F.col("distance") == 0).alias("equal_words"))


_FIELD = lambda blob: f"unhex(lpad(printf('%x', octet_length({blob})), 8, '0')) || {blob}"
_GENERATED_TAG = _hmac_sql(
    KEY,
    " || ".join(
        [
            f"encode('{crypto.TAG_MESSAGE_PREFIX.decode()}')", _FIELD(f"encode('{crypto.CODEC}')"), _FIELD("encode('key-1')"),
            _FIELD("unhex(lpad(printf('%x', doc_id % 7), 16, '0'))"), _FIELD("unhex(pixels)"), _FIELD("encode(trace_id)"),
        ]
    ),
)


@query(
    "generate_batch",
    f"""WITH d AS (SELECT doc_id, text, source, octet_length(encode(text)) AS n, CAST(ceil(octet_length(encode(text)) / (3 * 256 * 128)) AS BIGINT) * 3 * 256 * 128 AS total FROM documents WHERE length(text) > 0),
       h AS (SELECT doc_id, text, source, total, sha256(array_slice(encode(repeat(text, CAST(ceil(total / n) AS BIGINT))), 1, total)) AS pixels FROM d),
       o AS (SELECT doc_id % 7 AS owner, pixels, total, 'old-' || min(doc_id) AS old FROM h WHERE doc_id % 2 = 0 GROUP BY ALL),
       f AS (SELECT doc_id % 7 AS owner, pixels, total, min(doc_id) AS first FROM h GROUP BY ALL),
       p AS (SELECT h.*, old, first, substr(sha256(doc_id || ':' || CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END), 1, 32) AS trace_id
             FROM h JOIN f ON f.owner = h.doc_id % 7 AND f.pixels = h.pixels AND f.total = h.total LEFT JOIN o ON o.owner = h.doc_id % 7 AND o.pixels = h.pixels AND o.total = h.total)
       SELECT doc_id AS request_id, CAST(doc_id % 7 AS INTEGER) AS owner_user_id, trace_id, upper(substr({_GENERATED_TAG}, 1, 16)) AS auth_tag, old AS reused_group, old IS NULL AND first = doc_id AS new_group,
              '{crypto.CODEC}' AS codec, 'key-1' AS key_id, source AS original_filename, 'active' AS status, md5(text) AS original_file_md5, sha256(text) AS original_file_sha256, pixels AS original_pixel_sha256 FROM p""",
)
def generate_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as upload requests: groups, tags, embedding and record rows in one job.

    Contents that an even document holds have a stored group, and those of every tenth document a record under the tag
    of its first attempt, so that groups are reused and tags tried again.
    """
    docs = spread(table(spark, folder, "documents").where(F.length("text") > 0), "doc_id")
    height, rgb = framed(F.col("text"), WIDTH, TILE_ROWS)
    protected = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    requests = docs.select(
        F.col("doc_id").alias("request_id"), (F.col("doc_id") % 7).cast("int").alias("owner_user_id"), F.col("source").alias("filename"), F.encode("text", "UTF-8").alias("content"),
        F.lit(WIDTH).alias("width"), height.alias("height"), rgb.alias("rgb"), protected.alias("protected"),
    )
    owner, pixels = F.col("owner_user_id"), F.col("original_image_sha256")
    seen = cut_lineage(requests.select("request_id", "owner_user_id", crypto.pixel_sha256(F.col("rgb")).alias("original_image_sha256"), F.col("width").alias("image_width"), F.col("height").alias("image_height")))
    content = ["owner_user_id", "original_image_sha256", "image_width", "image_height"]
    old = seen.where(F.col("request_id") % 2 == 0).groupBy(*content).agg(F.concat(F.lit("old-"), F.min("request_id").cast("string")).alias("source_group_id"))
    first_tag = crypto.auth_tag(KEY, F.lit(crypto.CODEC), F.lit("key-1"), owner, pixels, generate.trace_id(F.col("request_id"), 0))
    stored = seen.where(F.col("request_id") % 10 == 0).join(old, content).select("source_group_id", first_tag.alias("auth_tag"), F.lit("active").alias("status"))
    groups = old.select("source_group_id", *content)
    made = generate.generate_batch(requests, groups, stored, "key-1", KEY, generate.Versions("m", "f", "v"))
    rows = made["v4_records"].where(F.octet_length("watermarked_pixel_sha256") == 32)
    reused = F.when(F.col("source_group_id").startswith("old-"), F.col("source_group_id")).alias("reused_group")
    digests = [F.lower(F.hex(c)).alias(c) for c in ("original_file_md5", "original_file_sha256", "original_pixel_sha256")]
    brought = made["source_groups"].select("request_id", F.lit(True).alias("_new"))
    rows = rows.join(brought, "request_id", "left").withColumn("new_group", F.coalesce("_new", F.lit(False)))
    return rows.select("request_id", "owner_user_id", "trace_id", F.hex("auth_tag").alias("auth_tag"), reused, "new_group", "codec", "key_id", "original_filename", "status", *digests)


@query(
    "detector_cascade",
    """WITH q AS (SELECT doc_id AS query_id, sha256(text) AS s, source FROM documents), e AS (SELECT s, min(doc_id) AS record_id FROM (SELECT doc_id, sha256(text) AS s FROM documents WHERE lang = 'en') GROUP BY 1),
       c AS (SELECT source, min(doc_id) AS record_id FROM documents WHERE lang = 'es' GROUP BY 1)
       SELECT q.query_id, coalesce(e.record_id, c.record_id) AS record_id, CASE WHEN e.record_id IS NOT NULL THEN 'exact' ELSE 'source' END AS evidence FROM q LEFT JOIN e USING (s) LEFT JOIN c USING (source) WHERE coalesce(e.record_id, c.record_id) IS NOT NULL""",
)
def detector_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Two plug-in detectors: equal content, then the source's first Spanish document."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), "source", "lang", F.sha2(F.encode("text", "UTF-8"), 256).alias("s"))

    def found(rows: DataFrame, confidence: int, name: str) -> DataFrame:
        return rows.select("query_id", "record_id", F.lit(confidence).alias("confidence"), F.lit(name).alias("evidence"))

    def exact(asked: DataFrame, registry: DataFrame) -> DataFrame:
        first = registry.where(F.col("lang") == "en").groupBy("s").agg(F.min("query_id").alias("record_id"))
        return found(asked.join(first, "s"), 100, "exact")

    def by_source(asked: DataFrame, registry: DataFrame) -> DataFrame:
        first = registry.where(F.col("lang") == "es").groupBy("source").agg(F.min("query_id").alias("record_id"))
        return found(asked.join(first, "source"), 60, "source")

    return cascade.run_cascade(docs, docs, [exact, by_source]).select("query_id", "record_id", "evidence")


@query("embedding_plugin")
def embedding_plugin(spark: SparkSession, folder: str) -> DataFrame:
    """A plug-in that turns image bytes into a byte histogram; vectors come back validated."""

    def histogram(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            vectors = [np.bincount(np.frombuffer(r, np.uint8) >> 2, minlength=64).astype(np.float32) for r in batch["rgb"]]
            yield pd.DataFrame({"image_id": batch["image_id"], "view_index": 0, "embedding": vectors})

    rows = cascade.embed_views(images(spark, folder).select("image_id", "rgb"), histogram, 64)
    return rows.select("image_id", "view_index", F.round(F.array_max("embedding").cast("double"), 5).alias("peak"))


GRID_POINTS = 64


def _keypoints(frame: DataFrame, owner: Column) -> DataFrame:
    """A fixed grid of points per image, described by digests of the text and the position."""
    rows = frame.select(owner.cast("string").alias("owner_id"), "mark", "height", F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1))).alias("kp_idx"))
    x, y = (F.col("kp_idx") % 8) * (WIDTH // 8), F.floor(F.col("kp_idx") / 8) * F.col("height") / 8
    return rows.select("owner_id", "kp_idx", x.cast("float").alias("x"), y.cast("float").alias("y"), F.unhex(F.sha2(F.concat_ws(":", "mark", "kp_idx"), 256)).alias("descriptor"))


@query(
    "detect_batch",
    """SELECT doc_id AS query_id, 'success' AS outcome, min(doc_id) OVER (PARTITION BY text) AS record_id, CASE WHEN lang = 'en' THEN 'exact' ELSE 'authenticated' END AS stage
       FROM documents WHERE length(text) > 0""",
)
def detect_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Whole detection over documents as images: exact copies, then marked copies of registered texts.

    Each distinct text is one source group with one record; every document is a suspect. English
    suspects are the registered file itself, all others the marked image without its file.
    """
    from provena.plans.detect import Registry, Suspects
    from provena.plans.detect import detect_batch as detect

    height, rgb = framed(F.col("text"), WIDTH, TILE_ROWS)
    mark = F.sha2(F.encode("text", "UTF-8"), 256)
    docs = table(spark, folder, "documents").where(F.length("text") > 0).withColumn("mark", mark)
    # Most of what follows asks for no texts: digests and sizes are written once, and no text is shuffled for them.
    slim = cut_lineage(docs.select("doc_id", "mark", F.lit(WIDTH).alias("width"), height.alias("height")))
    first = slim.groupBy("mark").agg(F.min("doc_id").alias("doc_id"))
    # Texts meet while they are texts: pixels are made after the join, not shuffled for it.
    source = spread(docs.select("doc_id", "text", "mark").join(first, ["mark", "doc_id"], "left_semi"), "doc_id")
    source = source.select("doc_id", "text", "mark", F.lit(WIDTH).alias("width"), height.alias("height"), rgb.alias("rgb"))
    owner = F.lit(1)
    trace = F.concat(F.lit("trace-"), F.col("doc_id").cast("string"))
    tag = crypto.auth_tag(KEY, F.lit(crypto.CODEC), F.lit("key-1"), owner, crypto.pixel_sha256(F.col("rgb")), trace)
    content = F.encode("text", "UTF-8")
    coded = source.withColumn("auth_tag", tag).withColumn("codeword", codewords.encode_codeword(F.col("auth_tag")))
    stored = coded.select(
        F.col("doc_id").alias("record_id"), F.col("doc_id").alias("source_group_id"), owner.alias("owner_user_id"), F.lit("active").alias("status"), trace.alias("trace_id"),
        F.lit(crypto.CODEC).alias("codec"), F.lit("key-1").alias("key_id"), "auth_tag", crypto.pixel_sha256(F.col("rgb")).alias("original_pixel_sha256"),
        crypto.file_md5(content).alias("original_file_md5"), crypto.file_sha256(content).alias("original_file_sha256"),
        crypto.file_md5(F.col("rgb")).alias("watermarked_file_md5"), crypto.file_sha256(F.col("rgb")).alias("watermarked_file_sha256"), "mark", "codeword",
    )
    protected = F.array().cast("array<struct<x:int,y:int>>")
    kept = cut_lineage(stored)
    stored = kept.drop("mark", "codeword")
    # Texts get their codewords; pixels are made of them, and marked, where they are looked at.
    texts = docs.select(F.col("doc_id").alias("query_id"), "lang", "text", "mark").join(kept.select("mark", "codeword"), "mark").drop("mark")

    def marked(rows: DataFrame, extra: list[str]) -> DataFrame:
        rows = spread(rows, "query_id").withColumns({"image_id": F.col("query_id").cast("string"), "width": F.lit(WIDTH), "height": height, "protected": protected})
        return imaging.embed_codewords(rows.withColumn("rgb", rgb), extra)

    def pixels(rows: DataFrame) -> DataFrame:
        wanted = rows.drop("width", "height").join(texts.select("query_id", "text", "codeword"), "query_id")
        return marked(wanted, rows.drop("width", "height").columns).drop("image_id", "error")

    english = F.col("lang") == "en"
    queries = marked(texts, ["query_id", "lang", "text"]).select(
        "query_id", owner.alias("user_id"), F.lit(False).alias("cross_owner"), F.when(english, content).otherwise(F.concat(content, F.lit(bytearray(b"!")))).alias("content"), "width", "height", "rgb"
    )
    # Vectors from digests: equal texts meet, others are far apart.
    vector = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.conv(F.substr("mark", (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("float") - F.lit(127.5).cast("float")))
    source = slim.join(first, ["mark", "doc_id"], "left_semi")
    stored_views = source.select(F.col("doc_id").alias("source_group_id"), F.lit(0).alias("view_index"), owner.alias("owner_user_id"), vector.alias("embedding"))
    query_views = slim.select(F.col("doc_id").alias("query_id"), F.lit(0).alias("query_view"), vector.alias("embedding"))
    registry = Registry(
        stored, stored_views, _keypoints(source, F.col("doc_id")), source.select(F.col("doc_id").alias("source_group_id"), F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    )
    suspects = Suspects(queries, query_views, _keypoints(slim, F.col("doc_id")), pixels)
    return detect(suspects, registry, {"key-1": KEY})
