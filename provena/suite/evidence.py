"""Evidence queries: tiles, votes, geometry statistics, ranking, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from provena.functions import bits, geometry
from provena.operators import evidence, filters
from provena.suite.base import TILES_SQL, query, table, tiles
from provena.suite.registry import boxes

_MED = "list_aggregate(list_transform(scores, lambda v: abs(CAST(v AS DOUBLE))), 'median')"
_HEX64 = """lower(printf('%08x', CAST(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN b[i] = 1 THEN CAST(1 AS BIGINT) << CAST(32 - i AS INTEGER) ELSE 0 END)) AS BIGINT)) ||
  printf('%08x', CAST(list_sum(list_transform(range(33, 65), lambda i: CASE WHEN b[i] = 1 THEN CAST(1 AS BIGINT) << CAST(64 - i AS INTEGER) ELSE 0 END)) AS BIGINT)))"""

_OBS_SQL = f"""WITH {TILES_SQL}, u AS (SELECT *, (tile_x + tile_y) % 2 AS carrier, {_MED} AS energy FROM tiles WHERE coverage >= 0.7),
e AS (SELECT image_id, carrier, i, avg(CAST(scores[i] AS DOUBLE) / energy) AS m FROM u, (SELECT unnest(range(1, 65)) AS i) WHERE energy > 1e-9 GROUP BY ALL),
c AS (SELECT image_id, carrier, list(m ORDER BY i) AS m FROM e GROUP BY ALL),
s AS (SELECT image_id, carrier, count(*) AS n, count(DISTINCT phase) AS p, min(coverage) AS cov, list(DISTINCT phase) AS ph FROM u WHERE energy > 1e-9 GROUP BY ALL),
x AS (SELECT a.image_id, a.m AS ma, b.m AS mb, sa.n AS na, sb.n AS nb, sa.p AS pa, sb.p AS pb, sa.cov AS ca, sb.cov AS cb FROM c a JOIN c b ON a.image_id = b.image_id AND a.carrier = 0 AND b.carrier = 1
  JOIN s sa ON sa.image_id = a.image_id AND sa.carrier = 0 JOIN s sb ON sb.image_id = a.image_id AND sb.carrier = 1 WHERE len(list_distinct(list_concat(sa.ph, sb.ph))) >= 2)"""


def _hex(bits_sql: str) -> str:
    return _HEX64.replace("b[i]", f"({bits_sql})[i]")


def _observation(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.tile_observation(tiles(spark, folder), 1, 2, 0.7)


@query(
    "tile_observation",
    _OBS_SQL + f""" SELECT image_id, {_hex("list_transform(ma, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END)")} || {_hex("list_transform(mb, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END)")} AS codeword,
      na AS tiles_a, nb AS tiles_b, CAST(pa AS INTEGER) AS phases_a, CAST(pb AS INTEGER) AS phases_b, round(ca, 6) AS coverage_a, round(cb, 6) AS coverage_b,
      round(list_avg(list_transform(ma, lambda v: abs(v))), 6) AS signal_a, round(list_avg(list_transform(mb, lambda v: abs(v))), 6) AS signal_b FROM x""",
)
def tile_observation(spark: SparkSession, folder: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _observation(spark, folder).select(
        "image_id", F.lower(F.hex("codeword")).alias("codeword"), "tiles_a", "tiles_b", "phases_a", "phases_b", r("coverage_a"), r("coverage_b"), r("signal_a"), r("signal_b")
    )


@query(
    "byte_confidence",
    _OBS_SQL + """ SELECT image_id, CAST(k AS INTEGER) AS byte, round(v / (1 + v), 6) AS confidence FROM (
      SELECT image_id, k, list_min(list_transform(list_slice(list_concat(ma, mb), k * 8 + 1, k * 8 + 8), lambda w: abs(w))) AS v FROM x, (SELECT unnest(range(0, 16)) AS k))""",
)
def byte_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _observation(spark, folder).select("image_id", F.posexplode("confidences").alias("byte", "confidence")).withColumn("confidence", F.round("confidence", 6))


_SUM_SQL = f"""WITH {TILES_SQL}, e AS (SELECT image_id, i, sum(CAST(scores[i] AS DOUBLE)) AS s FROM tiles, (SELECT unnest(range(1, 65)) AS i) WHERE coverage >= 0.7 GROUP BY ALL),
n AS (SELECT image_id, count(*) AS tiles FROM tiles WHERE coverage >= 0.7 GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT image_id, list(s ORDER BY i) AS s FROM e JOIN n USING (image_id) GROUP BY 1),
first AS (SELECT image_id, list_transform(list(scores ORDER BY vec_id)[1], lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) AS w FROM tiles GROUP BY 1)"""


def _expected(spark: SparkSession, folder: str) -> DataFrame:
    """The sign bits of the first tile stand for the registered code of an image."""
    first = tiles(spark, folder).groupBy("image_id").agg(F.min_by("scores", "vec_id").alias("s"))
    code = bits.bits_to_code(F.transform("s", lambda v: F.when(v > 0, F.lit(1)).otherwise(F.lit(0))))
    return first.select("image_id", F.concat(F.lit("trace-"), F.col("image_id").cast("string")).alias("trace_id"), code.alias("code"))


@query(
    "soft_merge_v1",
    _SUM_SQL + f""" SELECT c.image_id, {_hex("list_transform(s, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END)")} AS code,
      CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (s[i] > 0) <> (w[i] = 1) THEN 1 ELSE 0 END)) AS INTEGER) AS bit_errors, tiles,
      round(list_avg(list_transform(s, lambda v: abs(v))) / tiles, 6) AS mean_abs_score FROM c JOIN n USING (image_id) JOIN first USING (image_id)""",
)
def soft_merge_v1(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence.soft_merge_v1(tiles(spark, folder), _expected(spark, folder))
    return rows.select("image_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("code"), "bit_errors", "tiles", F.round("mean_abs_score", 6).alias("mean_abs_score"))


@query(
    "phase_merge_v2",
    f"""WITH {TILES_SQL}, e AS (SELECT image_id, phase3, i, avg(CAST(scores[i] AS DOUBLE)) AS s FROM tiles, (SELECT unnest(range(1, 65)) AS i) WHERE coverage >= 0.7 GROUP BY ALL),
n AS (SELECT image_id, phase3, count(*) AS n FROM tiles WHERE coverage >= 0.7 GROUP BY ALL HAVING count(*) >= 2),
ok AS (SELECT image_id, list(n ORDER BY phase3) AS n FROM n GROUP BY 1 HAVING count(*) = 3),
c AS (SELECT image_id, list(s ORDER BY phase3, i) AS s FROM e JOIN ok USING (image_id) GROUP BY 1)
SELECT image_id, array_to_string(list_transform(s, lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), '') AS observed, array_to_string(list_transform(n, lambda v: CAST(v AS VARCHAR)), ',') AS phase_tiles,
  round(list_avg(list_transform(s, lambda v: abs(v))), 6) AS mean_abs_score FROM c JOIN ok USING (image_id)""",
)
def phase_merge_v2(spark: SparkSession, folder: str) -> DataFrame:
    """Per-phase averages as a 24-byte observation (acceptance itself is its own query)."""
    wanted = _expected(spark, folder).select("image_id", "trace_id", F.unhex(F.sha2(F.col("trace_id"), 256)).alias("c")).select("image_id", "trace_id", F.substring("c", 1, 24).alias("codeword"))
    rows = evidence.phase_merge_v2(tiles(spark, folder).withColumn("phase", F.col("phase3")), wanted)
    text = F.array_join(F.transform(bits.byte_values(F.col("observed"), 24), lambda b: F.lpad(F.bin(b), 8, "0")), "")
    return rows.select("image_id", text.alias("observed"), F.array_join(F.transform("phase_tiles", lambda n: n.cast("string")), ",").alias("phase_tiles"), F.round("mean_abs_score", 6).alias("mean_abs_score"))


@query(
    "clipped_merge_v3",
    f"""WITH {TILES_SQL}, u AS (SELECT *, greatest(1e-6, {_MED}) AS med, {[bits.phase_table(p, bits.PHASE_SEED_V3) for p in range(3)]}[phase3 + 1] AS perm FROM tiles WHERE coverage >= 0.7),
e AS (SELECT image_id, i, sum(greatest(-3, least(3, CAST(scores[perm[i] + 1] AS DOUBLE) / med))) AS s FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
n AS (SELECT image_id, count(*) AS tiles, count(DISTINCT phase3) AS phases FROM u GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT phase3) >= 2),
c AS (SELECT image_id, list(s ORDER BY i) AS s FROM e JOIN n USING (image_id) GROUP BY 1),
first AS (SELECT image_id, list_transform(list(scores ORDER BY vec_id)[1], lambda v: CASE WHEN v > 0 THEN 1 ELSE -1 END) AS w FROM tiles GROUP BY 1)
SELECT image_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (s[i] > 0) <> (w[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS bit_errors, tiles, CAST(phases AS INTEGER) AS phases,
  round(list_sum(list_transform(range(1, 65), lambda i: s[i] * w[i])) / 64 / tiles, 6) AS mean_signed_agreement, round(list_avg(list_transform(s, lambda v: abs(v))) / tiles, 6) AS mean_abs_score
FROM c JOIN n USING (image_id) JOIN first USING (image_id)""",
)
def clipped_merge_v3(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence.clipped_merge_v3(tiles(spark, folder).withColumn("phase", F.col("phase3")), _expected(spark, folder))
    return rows.select("image_id", "bit_errors", "tiles", "phases", F.round("mean_signed_agreement", 6).alias("mean_signed_agreement"), F.round("mean_abs_score", 6).alias("mean_abs_score"))


_MAJOR_SQL = f"""WITH {TILES_SQL}, e AS (SELECT image_id, i, count(*) FILTER (scores[i] > 0) AS o, count(*) AS n FROM tiles, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
c AS (SELECT image_id, list(CASE WHEN o * 2 > n THEN 1 ELSE 0 END ORDER BY i) AS b, avg(abs(2 * o - n) / n) AS confidence, max(n) AS tiles FROM e GROUP BY 1 HAVING max(n) >= 2)"""


@query("bit_majority", _MAJOR_SQL + f" SELECT image_id, {_HEX64} AS code, round(confidence, 6) AS confidence, 64 AS decided, tiles FROM c")
def bit_majority(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence.bit_majority(tiles(spark, folder))
    return rows.select("image_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("code"), F.round("confidence", 6).alias("confidence"), "decided", "tiles")


@query(
    "blind_code_pick",
    _MAJOR_SQL + f""", scans AS (SELECT image_id // 2 AS query_id, image_id, {_HEX64} AS code, confidence FROM c), reg AS (SELECT code, min(image_id) AS image_id FROM scans GROUP BY 1),
      h AS (SELECT s.query_id, s.confidence, 'trace-' || r.image_id AS trace_id FROM scans s JOIN reg r ON 'acd3' || substr(r.code, 5) = 'acd3' || substr(s.code, 5)
            QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY s.confidence DESC, trace_id DESC) = 1)
      SELECT query_id, trace_id, CAST(least(98, greatest(75, trunc(confidence * 100))) AS INTEGER) AS confidence FROM h WHERE confidence >= 0.08""",
)
def blind_code_pick(spark: SparkSession, folder: str) -> DataFrame:
    """Majority codes (magic put in front) of two images a query, looked up among themselves."""
    rows = evidence.bit_majority(tiles(spark, folder))
    code = F.shiftleft(F.lit(bits.MAGIC).cast("bigint"), 48).bitwiseOR(F.col("code").bitwiseAND(F.lit((1 << 48) - 1)))
    scans = rows.select(F.floor(F.col("image_id") / 2).cast("bigint").alias("query_id"), code.alias("code"), "confidence")
    registry = rows.select(F.concat(F.lit("trace-"), F.col("image_id").cast("string")).alias("trace_id"), code.alias("code"), F.col("image_id").alias("position"))
    return evidence.blind_code_pick(scans, registry)


# --- votes ---------------------------------------------------------------------------------------

_WIN_SQL = """w AS (SELECT event_id % 40 AS query_id, user_id AS trace_id, user_id % 2 = 0 AS persistent, event_type = 'error' AS by_short,
   least(value, 30) / 300 + 0.03 AS marker, value / 2000 AS cs, value / 2500 AS ss, value / 600 + 0.01 AS ts, 96 + 24 * (user_id % 3) AS tw, 96 + 24 * (event_id % 4) AS th FROM events)"""


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        (F.col("event_id") % 40).alias("query_id"), F.col("user_id").alias("trace_id"), (F.col("user_id") % 2 == 0).alias("persistent"), (F.col("event_type") == "error").alias("by_short_code"),
        (F.least(F.col("value"), F.lit(30.0)) / 300 + 0.03).alias("marker_score"), (F.col("value") / 2000).alias("code_strength"), (F.col("value") / 2500).alias("short_strength"),
        (F.col("value") / 600 + 0.01).alias("trace_score"), (F.lit(96) + 24 * (F.col("user_id") % 3)).alias("tile_w"), (F.lit(96) + 24 * (F.col("event_id") % 4)).alias("tile_h"),
    )


@query(
    "small_window_votes",
    f"""WITH {_WIN_SQL}, s AS (SELECT *, marker * 0.40 + greatest(cs, ss) * 2.8 + greatest(0, ts) * 0.24 AS score FROM w),
p AS (SELECT *, CAST(trunc(greatest(1, score * 10000) * greatest(1, least(5, round_even(tw * th / 9216.0, 0)))) AS BIGINT) AS weight FROM s
      WHERE marker >= 0.06 AND greatest(cs, ss) >= 0.005 AND ts >= 0.02 AND score >= 0.06 AND (NOT by_short OR ts >= 0.034)),
v AS (SELECT query_id, trace_id, count(*) AS hits, CAST(sum(weight) AS BIGINT) AS votes, sum(score * weight) / sum(weight) AS strength, bool_or(persistent) AS persistent FROM p GROUP BY ALL)
SELECT query_id, trace_id, hits, votes, round(strength, 6) AS strength, CAST(trunc(least(96, greatest(78, 72 + votes / 1200))) AS INTEGER) AS confidence FROM v
WHERE CASE WHEN persistent THEN hits >= 10 AND votes >= 36000 ELSE hits >= 5 AND votes >= 24000 END QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, strength DESC, trace_id DESC) = 1""",
)
def small_window_votes(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.small_window_votes(_windows(spark, folder)).withColumn("strength", F.round("strength", 6))


@query(
    "dot_matrix_votes",
    """WITH w AS (SELECT event_id % 40 AS query_id, user_id AS trace_id, least(value, 60) / 60 AS strength, 32 + 8 * (user_id % 9) AS size, event_id % 13 AS distance FROM events),
v AS (SELECT query_id, trace_id, CAST(sum(wt) AS BIGINT) AS votes, min(distance) AS distance, sum(strength * wt) / greatest(1, sum(wt)) AS strength FROM (SELECT *, greatest(1, CAST(trunc(strength * 100) AS BIGINT)) * greatest(1, size // 32) AS wt FROM w) GROUP BY ALL)
SELECT query_id, trace_id, votes, distance, round(strength, 6) AS strength, CAST(least(96, greatest(76, 72 + votes * 2)) AS INTEGER) AS confidence FROM v WHERE votes >= 12 AND distance <= 8
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, distance, trace_id) = 1""",
)
def dot_matrix_votes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        (F.col("event_id") % 40).alias("query_id"), F.col("user_id").alias("trace_id"), (F.least("value", F.lit(60.0)) / 60).alias("strength"),
        (F.lit(32) + 8 * (F.col("user_id") % 9)).alias("tile_size"), (F.col("event_id") % 13).alias("distance"),
    )
    return evidence.dot_matrix_votes(rows).withColumn("strength", F.round("strength", 6))


@query(
    "code_votes",
    """WITH h AS (SELECT event_id % 40 AS query_id, event_type AS scale, user_id AS trace_id, value / 100 AS score, 3 + user_id % 20 AS tiles FROM events),
v AS (SELECT query_id, scale, trace_id, count(*) AS hits, CAST(sum(wt) AS BIGINT) AS votes, sum(score * wt) / greatest(1, sum(wt)) AS strength FROM (SELECT *, CAST(trunc(greatest(1, score * 10000) * least(tiles, 16)) AS BIGINT) AS wt FROM h) GROUP BY ALL)
SELECT query_id, trace_id, hits, votes, round(strength, 6) AS strength, CAST(least(98, greatest(75, votes * 8 + 70)) AS INTEGER) AS confidence FROM v WHERE (hits >= 2 AND votes >= 30000) OR votes >= 23000
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, strength DESC, trace_id DESC) = 1""",
)
def code_votes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        (F.col("event_id") % 40).alias("query_id"), F.col("event_type").alias("scale"), F.col("user_id").alias("trace_id"), (F.col("value") / 100).alias("score"), (F.lit(3) + F.col("user_id") % 20).alias("tiles")
    )
    return evidence.code_votes(rows, persistent=True).withColumn("strength", F.round("strength", 6))


# --- geometry ------------------------------------------------------------------------------------

_PTS_SQL = """pts AS (SELECT l_suppkey AS pair, l_partkey AS qx, l_quantity * 20 AS qy, l_partkey * 1.01 + l_discount * 60 AS tx, l_quantity * 20.2 + l_tax * 60 AS ty FROM lineitem)"""
_MATRIX = [1.01, 0.0, 1.0, 0.0, 1.01, 1.0, 0.0, 0.00001, 1.0]


@query(
    "inlier_stats",
    f"""WITH {_PTS_SQL}, p AS (SELECT *, 0.00001 * qy + 1 AS w FROM pts), e AS (SELECT pair, sqrt(pow((1.01 * qx + 1) / w - tx, 2) + pow((1.01 * qy + 1) / w - ty, 2)) AS err FROM p),
a AS (SELECT pair, count(*) AS matches, count(*) FILTER (err <= 5) AS inliers, quantile_cont(err, 0.5) FILTER (err <= 5) AS med FROM e GROUP BY 1)
SELECT pair, matches, inliers, round(med, 6) AS median_error, round(inliers / matches, 6) AS ratio, coalesce(inliers >= 18 AND (inliers / matches >= 0.32 OR inliers >= 256) AND med <= 5, false) AS accepted FROM a""",
)
def inlier_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("pair"), F.col("l_partkey").cast("double").alias("qx"), (F.col("l_quantity") * 20).alias("qy"),
        (F.col("l_partkey") * 1.01 + F.col("l_discount") * 60).alias("tx"), (F.col("l_quantity") * 20.2 + F.col("l_tax") * 60).alias("ty"), F.array(*map(F.lit, _MATRIX)).alias("homography"),
    )
    return evidence.inlier_stats(rows).withColumn("median_error", F.round("median_error", 6)).withColumn("ratio", F.round("ratio", 6)).select("pair", "matches", "inliers", "median_error", "ratio", "accepted")


@query(
    "translation_vote",
    """WITH m AS (SELECT l_orderkey AS pair, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS kp,
                  (l_partkey + 130 + l_discount * 40) - CAST(l_partkey AS DOUBLE) AS mx, (l_quantity + 260 + l_tax * 40) - l_quantity AS my FROM lineitem),
       sup AS (SELECT a.pair, a.kp, a.mx, a.my, count(*) AS n FROM m a JOIN m b ON a.pair = b.pair AND sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my)) <= 6 GROUP BY ALL),
       seed AS (SELECT pair, mx AS ox, my AS oy FROM sup QUALIFY row_number() OVER (PARTITION BY pair ORDER BY n DESC, kp) = 1),
       c1 AS (SELECT pair, median(mx) AS ox, median(my) AS oy FROM m JOIN seed USING (pair) WHERE sqrt((mx - ox) * (mx - ox) + (my - oy) * (my - oy)) <= 6 GROUP BY 1),
       c2 AS (SELECT pair, median(mx) AS dx, median(my) AS dy FROM m JOIN c1 USING (pair) WHERE sqrt((mx - ox) * (mx - ox) + (my - oy) * (my - oy)) <= 5 GROUP BY 1 HAVING count(*) >= 3),
       e AS (SELECT pair, dx, dy, sqrt((mx - dx) * (mx - dx) + (my - dy) * (my - dy)) AS err FROM m JOIN c2 USING (pair))
       SELECT CAST(pair AS VARCHAR) AS pair, round(any_value(dx), 6) AS dx, round(any_value(dy), 6) AS dy, CAST(count(*) AS INTEGER) AS good_matches, CAST(count(*) FILTER (err <= 5) AS INTEGER) AS inliers,
              round(count(*) FILTER (err <= 5) / count(*), 6) AS ratio, round(median(err) FILTER (err <= 5), 6) AS median_error
       FROM e WHERE pair % 10 <> 0 GROUP BY pair HAVING count(*) FILTER (err <= 5) >= 3""",
)
def translation_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Line items of an order as point matches of one pair; every tenth order has a target far too large."""
    lines = table(spark, folder, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    side = F.when(F.col("l_orderkey") % 10 == 0, F.lit(10000)).otherwise(F.lit(1200))
    rows = lines.select(
        F.col("l_orderkey").cast("string").alias("pair"), (F.row_number().over(order) - 1).alias("query_kp"),
        F.col("l_partkey").cast("double").alias("qx"), F.col("l_quantity").alias("qy"), (F.col("l_partkey") + 130 + F.col("l_discount") * 40).alias("tx"), (F.col("l_quantity") + 260 + F.col("l_tax") * 40).alias("ty"),
        F.lit(0.0).alias("rotation_degrees"), F.lit(1.0).alias("scale"), F.lit(None).cast("int").alias("offset_x"), F.lit(None).cast("int").alias("offset_y"),
        F.lit(1000).alias("query_width"), F.lit(1000).alias("query_height"), side.alias("target_width"), side.alias("target_height"),
    )
    found = evidence.translation_vote(rows)
    return found.select("pair", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"), "good_matches", "inliers", F.round("ratio", 6).alias("ratio"), F.round("median_error", 6).alias("median_error"))


@query(
    "geometry_confirm_filter",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE CAST(l_quantity AS INTEGER) >= 18 AND l_discount * 10 BETWEEN 0.32 AND 1.0 AND l_tax * 100 <= 5
       AND (0.5 + l_partkey / 1000.0) * (0.5 + l_partkey / 1000.0) BETWEEN 0.01 AND 100 AND (0.5 + l_partkey / 1000.0) * 800 + l_suppkey * 100 <= 8000 AND (0.5 + l_partkey / 1000.0) * 600 <= 6000""",
)
def geometry_confirm_filter(spark: SparkSession, folder: str) -> DataFrame:
    scale = F.lit(0.5) + F.col("l_partkey") / 1000.0
    zero = F.lit(0.0)
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("inliers"), (F.col("l_discount") * 10).alias("ratio"), (F.col("l_tax") * 100).alias("reprojection_error"),
        F.array(scale, zero, (F.col("l_suppkey") * 100).cast("double"), zero, scale, zero, zero, zero, F.lit(1.0)).alias("homography"),
        F.lit(800).alias("query_width"), F.lit(600).alias("query_height"), F.lit(800).alias("target_width"), F.lit(600).alias("target_height"),
    )
    return filters.geometry_confirmed(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "homography_plausible",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s * s BETWEEN 0.02 AND 4 AND s * 800 + dx <= 1600 AND s * 600 <= 1200 AS plausible
       FROM (SELECT *, 0.1 + l_quantity / 25.0 AS s, l_suppkey AS dx FROM lineitem)""",
)
def homography_plausible(spark: SparkSession, folder: str) -> DataFrame:
    scale, zero = F.lit(0.1) + F.col("l_quantity") / 25.0, F.lit(0.0)
    matrix = F.array(scale, zero, F.col("l_suppkey").cast("double"), zero, scale, zero, zero, zero, F.lit(1.0))
    size = [F.lit(800), F.lit(600), F.lit(800), F.lit(600)]
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geometry.plausible_matched(matrix, *size).alias("plausible"))


@query(
    "translation_refinements",
    """WITH m AS (SELECT o_orderkey, o_totalprice / 7 AS x, o_custkey / 2.0 AS y FROM orders), r AS (SELECT *, round_even(x, 0) AS rx, round_even(y, 0) AS ry FROM m)
       SELECT o_orderkey, round(x, 6) AS dx, round(y, 6) AS dy FROM r UNION ALL SELECT o_orderkey, rx, ry FROM r WHERE rx <> x OR ry <> y
       UNION ALL SELECT o_orderkey, rx + a, ry + b FROM r, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)) v(a, b)""",
)
def translation_refinements(spark: SparkSession, folder: str) -> DataFrame:
    one, zero = F.lit(1.0), F.lit(0.0)
    matrix = F.array(one, zero, F.col("o_totalprice") / 7, zero, one, F.col("o_custkey") / 2.0, zero, zero, one)
    rows = table(spark, folder, "orders").select("o_orderkey", F.explode(geometry.translation_refinements(matrix)).alias("m"))
    return rows.select("o_orderkey", F.round(F.element_at("m", 3), 6).alias("dx"), F.round(F.element_at("m", 6), 6).alias("dy"))


@query(
    "view_boxes",
    """WITH s AS (SELECT doc_id, n_chars AS w, doc_id % 40 + 1 AS h FROM documents), f AS (SELECT doc_id, 0 AS o, 'full' AS kind, 0 AS x, 0 AS y, w, h FROM s
  UNION ALL SELECT doc_id, k * 9 + j * 3 + i + 1, kind, CASE i WHEN 0 THEN 0 WHEN 1 THEN (w - cw) // 2 ELSE w - cw END, CASE j WHEN 0 THEN 0 WHEN 1 THEN (h - ch) // 2 ELSE h - ch END, cw, ch FROM
   (SELECT doc_id, w, h, k, kind, greatest(1, CAST(round_even(w * f, 0) AS BIGINT)) AS cw, greatest(1, CAST(round_even(h * f, 0) AS BIGINT)) AS ch FROM s, (VALUES (0, 'overlap_75', 0.75), (1, 'overlap_50', 0.5)) v(k, kind, f)),
   (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 3)) AS j)),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, x, y, w, h ORDER BY o) = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS view_index, kind, x, y, w, h FROM d""",
)
def view_boxes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.inline(geometry.view_boxes(F.col("n_chars"), F.col("doc_id") % 40 + 1)))
    return rows.select("doc_id", "view_index", "kind", "x", "y", "w", "h")


@query(
    "suppress_overlaps",
    """WITH RECURSIVE k AS (
  SELECT l_suppkey AS image_id, l_returnflag AS kind, l_partkey % 1800 AS x0, l_suppkey * 9 AS y0, l_partkey % 1800 + CAST(trunc(l_quantity * 8) AS BIGINT) AS x1, l_suppkey * 9 + CAST(trunc(l_quantity * 6) AS BIGINT) AS y1,
         l_extendedprice AS confidence, concat_ws('|', l_orderkey, l_linenumber, l_partkey, CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS box_id FROM lineitem),
d AS (SELECT image_id, kind, x0, y0, x1, y1, min({'c': -confidence, 'i': box_id}) AS o FROM k GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY image_id, kind ORDER BY o) AS n FROM d),
walk AS (
  SELECT image_id, kind, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT, box_id VARCHAR)[]) AS kept FROM (SELECT DISTINCT image_id, kind FROM d)
  UNION ALL
  SELECT n.image_id, n.kind, n.n,
         CASE WHEN len(list_filter(kept, lambda k: greatest(0, least(k.x1, n.x1) - greatest(k.x0, n.x0)) * greatest(0, least(k.y1, n.y1) - greatest(k.y0, n.y0))
           >= 0.55 * greatest(1, (k.x1 - k.x0) * (k.y1 - k.y0) + (n.x1 - n.x0) * (n.y1 - n.y0) - greatest(0, least(k.x1, n.x1) - greatest(k.x0, n.x0)) * greatest(0, least(k.y1, n.y1) - greatest(k.y0, n.y0))))) > 0
         THEN kept ELSE list_append(kept, {'x0': n.x0, 'y0': n.y0, 'x1': n.x1, 'y1': n.y1, 'box_id': n.o.i}) END
  FROM walk w JOIN n ON n.image_id = w.image_id AND n.kind = w.kind AND n.n = w.n + 1),
ends AS (SELECT image_id, kind, unnest(kept) AS b FROM walk QUALIFY row_number() OVER (PARTITION BY image_id, kind ORDER BY n DESC) = 1)
SELECT image_id, kind, b.box_id AS box_id, b.x0 AS "left", b.y0 AS top, b.x1 AS "right", b.y1 AS bottom FROM ends""",
)
def suppress_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as boxes of a supplier's image; the SQL goes through them from the strongest on."""
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint").cast("string")
    box_id = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")], cents("l_quantity"), cents("l_extendedprice"))
    rows = boxes(spark, folder, box_id).withColumn("image_id", F.floor(F.col("top") / 9))
    return evidence.suppress_overlaps(rows).drop("confidence")


@query(
    "keypoint_quota",
    """WITH k AS (SELECT l_suppkey AS image_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount, l_tax, l_shipdate, l_extendedprice) - 1 AS INTEGER) AS kp_idx,
         l_partkey % 800 AS x, l_extendedprice % 600 AS y, l_extendedprice AS response, l_linenumber AS octave FROM lineitem),
c AS (SELECT *, least(7, x * 8 // 800) AS cx, least(7, CAST(floor(y * 8 / 600) AS INTEGER)) AS cy, least(7, greatest(0, octave)) AS oct FROM k WHERE kp_idx < 12288),
a AS (SELECT *, row_number() OVER (PARTITION BY image_id, cx, cy, oct ORDER BY response DESC, kp_idx) <= 6 AS f FROM c),
b AS (SELECT *, count(*) FILTER (f) OVER (PARTITION BY image_id, cx, cy) AS n1, row_number() OVER (PARTITION BY image_id, cx, cy, f ORDER BY response DESC, kp_idx) AS r2 FROM a),
p AS (SELECT *, CASE WHEN f THEN 1 WHEN r2 <= 48 - n1 THEN 2 ELSE 3 END AS selection_pass FROM b),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY selection_pass, response DESC, kp_idx) AS INTEGER) AS rank FROM p)
SELECT image_id, kp_idx, selection_pass, rank FROM r WHERE rank <= 3072""",
)
def keypoint_quota(spark: SparkSession, folder: str) -> DataFrame:
    """Line items of a supplier as detected keypoints, in detector order."""
    from provena.operators.scale import ranked

    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % 800).alias("x"), (F.col("l_extendedprice") % 600).alias("y"), F.col("l_extendedprice").alias("response"),
        F.col("l_linenumber").alias("octave"), F.lit(800).alias("width"), F.lit(600).alias("height"), F.struct("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate").alias("k"),
    )
    points = ranked(lines, ["image_id"], ["k", "response"], "_r").withColumn("kp_idx", (F.col("_r") - 1).cast("int"))
    return evidence.keypoint_quota(points)


# --- ranking and verdicts ------------------------------------------------------------------------

_CAND_SQL = """cand AS (SELECT l_orderkey AS query_id, l_partkey AS record_id, max(CAST(l_quantity AS INTEGER)) AS match_count, max(l_discount) AS match_quality, min(l_tax) AS thumbnail_distance, max(l_linenumber) AS recency,
   max(l_extendedprice) AS price FROM lineitem GROUP BY ALL)"""


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("record_id")).agg(
        F.max(F.col("l_quantity").cast("int")).alias("match_count"), F.max("l_discount").alias("match_quality"), F.min("l_tax").alias("thumbnail_distance"),
        F.max("l_linenumber").alias("recency"), F.max("l_extendedprice").alias("price"),
    )


@query(
    "rank_with_reserved_seat",
    f"""WITH {_CAND_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match_count DESC, match_quality DESC, thumbnail_distance, record_id) AS rank FROM cand),
s AS (SELECT * FROM t WHERE rank > 2 AND recency <= 5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY recency, record_id) = 1)
SELECT query_id, record_id, CAST(rank AS INTEGER) AS rank, false AS reserved FROM t WHERE rank <= 2 UNION ALL SELECT query_id, record_id, 3, true FROM s""",
)
def rank_with_reserved_seat(spark: SparkSession, folder: str) -> DataFrame:
    rows = _candidates(spark, folder)
    recent = rows.where(F.col("recency") <= 5).select("query_id", "record_id", "recency")
    ranked = evidence.rank_with_reserved_seat(rows.drop("recency", "price"), recent)
    return ranked.select("query_id", "record_id", "rank", "reserved")


@query(
    "rank_three_tiers",
    f"""WITH {_CAND_SQL}, m AS (SELECT query_id, record_id, record_id % 50 AS trace, match_count AS good, match_quality AS quality, CASE WHEN recency <= 3 THEN recency - 1 END AS recency, CASE WHEN price > 20000 THEN price END AS rd FROM cand),
x AS (SELECT m.*, EXISTS (SELECT 1 FROM m s WHERE s.query_id = m.query_id AND s.trace = m.trace AND s.good >= 40) AS st FROM m),
y AS (SELECT *, CASE WHEN good < 40 AND NOT st AND recency < 2 THEN row_number() OVER (PARTITION BY query_id, good < 40 AND NOT st AND coalesce(recency, 9) < 2 ORDER BY recency, record_id) END AS seat FROM x),
z AS (SELECT *, CASE WHEN good >= 40 THEN 1 WHEN seat <= 2 THEN 2 ELSE 3 END AS tier FROM y)
SELECT query_id, record_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE tier WHEN 1 THEN -good WHEN 2 THEN recency ELSE coalesce(rd, 'Infinity'::DOUBLE) END, CASE WHEN tier = 1 THEN -quality ELSE 0 END, record_id) AS rank FROM z""",
)
def rank_three_tiers(spark: SparkSession, folder: str) -> DataFrame:
    rows = _candidates(spark, folder).select(
        "query_id", "record_id", (F.col("record_id") % 50).alias("trace_id"), F.col("record_id").alias("position_index"), F.col("match_count").alias("good_matches"), F.col("match_quality").alias("quality"),
        F.when(F.col("recency") <= 3, F.col("recency") - 1).alias("recency"), F.when(F.col("price") > 20000, F.col("price")).alias("ratio_distance"),
    )
    return evidence.rank_three_tiers(rows, min_good=40).select("query_id", "record_id", "tier", "rank")


@query(
    "recent_candidates",
    """WITH a AS (SELECT o_custkey AS query_id, o_orderpriority AS trace_id, 0 AS s, o_orderkey AS p FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, o_orderpriority || '!', 1, o_orderkey FROM orders WHERE o_orderstatus = 'F'),
       f AS (SELECT query_id, trace_id, min((s, p)) AS k FROM a GROUP BY ALL), r AS (SELECT query_id, trace_id, row_number() OVER (PARTITION BY query_id ORDER BY k, trace_id) AS rn FROM f)
       SELECT query_id, trace_id, CAST(rn - 1 AS INTEGER) AS recency, rn <= 2 AS reserved FROM r WHERE rn <= 4""",
)
def recent_candidates(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    session = orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("trace_id"), F.col("o_orderkey").alias("session_order"))
    stored = orders.where(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("query_id"), F.concat("o_orderpriority", F.lit("!")).alias("trace_id"), F.col("o_orderkey").alias("position_index"), F.col("o_orderdate").alias("created_at")
    )
    return evidence.recent_candidates(session, stored)


@query(
    "best_evidence",
    """SELECT l_orderkey AS query_id, l_suppkey AS record_id, l_partkey AS refinement, CAST(l_quantity AS INTEGER) AS bit_errors FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY CAST(l_quantity AS INTEGER), l_linenumber, CAST(l_discount * 100 AS INTEGER), -l_extendedprice, l_partkey) = 1""",
)
def best_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("record_id"), F.col("l_partkey").alias("refinement"), F.col("l_quantity").cast("int").alias("bit_errors"),
        F.col("l_linenumber").alias("corrected_symbols"), F.rint(F.col("l_discount") * 100).cast("int").alias("erasure_count"), F.col("l_extendedprice").alias("mean_abs_score"),
    )
    return evidence.best_evidence(rows).select("query_id", "record_id", "refinement", "bit_errors")


_RES_SQL = f"""{_CAND_SQL}, c AS (SELECT query_id, record_id, match_count AS inliers, match_quality * 10 AS ratio, thumbnail_distance * 3 AS residual, record_id % 5 <> 0 AS robust FROM cand)"""


def _visual(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder).select(
        "query_id", "record_id", F.concat(F.lit("t"), F.col("record_id").cast("string")).alias("trace_id"), F.col("match_count").alias("inliers"), (F.col("match_quality") * 10).alias("ratio"),
        (F.col("thumbnail_distance") * 3).alias("residual"), (F.col("record_id") % 5 != 0).alias("robust_watermark"),
    )


@query(
    "residual_evidence",
    f"""WITH {_RES_SQL} SELECT query_id, record_id, inliers, round(ratio, 6) AS ratio, round(residual, 6) AS residual FROM (SELECT * FROM c WHERE robust AND ((inliers >= 18 AND ratio >= 0.32 AND residual >= 0.08) OR (inliers >= 30 AND ratio >= 0.65 AND residual >= 0.06))
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY residual DESC, inliers DESC, ratio DESC, record_id) = 1) WHERE residual >= 0.12""",
)
def residual_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence.residual_evidence(_visual(spark, folder))
    return rows.select("query_id", "record_id", "inliers", F.round("ratio", 6).alias("ratio"), F.round("residual", 6).alias("residual"))


@query(
    "visual_match_verdict",
    f"""WITH {_RES_SQL}, d AS (SELECT * REPLACE (inliers * 3 AS inliers) FROM c) SELECT query_id, record_id, inliers, round(ratio, 6) AS ratio, CAST(least(96, greatest(75, trunc(75 + residual * 25))) AS INTEGER) AS confidence FROM
       (SELECT * FROM d WHERE robust AND (NOT (inliers >= 80 AND ratio >= 0.8) OR residual >= 0.18) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY inliers DESC, ratio DESC, record_id) = 1) WHERE inliers >= 80 AND ratio >= 0.8""",
)
def visual_match_verdict(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence.visual_match_verdict(_visual(spark, folder).withColumn("inliers", F.col("inliers") * 3))
    return rows.select("query_id", "record_id", "inliers", F.round("ratio", 6).alias("ratio"), "confidence")


@query(
    "layer_snr",
    """SELECT label AS image_id, i AS trace_id, count(*) AS n, round(CASE WHEN count(*) < 16 THEN 0 ELSE greatest(0, avg(v * s) / (stddev_pop(v * s) + 1e-6)) END, 6) AS score FROM
       (SELECT label, i % 4 AS i, CAST(embedding[i + 1] AS DOUBLE) AS v, CASE WHEN (vec_id + i) % 3 = 0 THEN 1 ELSE -1 END AS s FROM embeddings, (SELECT unnest(range(0, 64)) AS i)) GROUP BY ALL""",
)
def layer_snr(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).select(
        F.col("label").alias("image_id"), (F.col("i") % 4).cast("bigint").alias("trace_id"), F.col("v").cast("double").alias("value"), F.when((F.col("vec_id") + F.col("i")) % 3 == 0, F.lit(1)).otherwise(F.lit(-1)).alias("sign")
    )
    return evidence.layer_snr(rows).withColumn("score", F.round("score", 6))


@query(
    "spectrum_snr",
    """SELECT label AS image_id, i AS trace_id, count(*) FILTER (s) AS n, round(CASE WHEN count(*) FILTER (s) < 10 THEN 0 ELSE greatest(0, (avg(v) FILTER (s) - avg(v) FILTER (NOT s)) / (stddev_pop(v) FILTER (NOT s) + 1e-6)) END, 6) AS score FROM
       (SELECT label, i % 4 AS i, abs(CAST(embedding[i + 1] AS DOUBLE)) AS v, (vec_id + i) % 3 = 0 AS s FROM embeddings, (SELECT unnest(range(0, 64)) AS i)) GROUP BY ALL""",
)
def spectrum_snr(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).select(
        F.col("label").alias("image_id"), (F.col("i") % 4).cast("bigint").alias("trace_id"), F.abs(F.col("v").cast("double")).alias("value"), ((F.col("vec_id") + F.col("i")) % 3 == 0).alias("selected")
    )
    return evidence.spectrum_snr(rows).withColumn("score", F.round("score", 6))


@query(
    "signal_match",
    """WITH mk AS (SELECT embedding AS m FROM embeddings ORDER BY vec_id LIMIT 1),
       w AS (SELECT e.label AS query_id, vec_id AS window_id, embedding AS s, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(m AS DOUBLE[])) * 30 / 64 AS marker FROM embeddings e, mk),
       p AS (SELECT label AS query_id, vec_id AS trace_id, embedding AS p FROM embeddings),
       d AS (SELECT w.query_id, window_id, trace_id, marker, list_inner_product(CAST(s AS DOUBLE[]), CAST(p AS DOUBLE[])) * 30 / 64 AS sc, row_number() OVER (PARTITION BY w.query_id, window_id ORDER BY list_inner_product(CAST(s AS DOUBLE[]), CAST(p AS DOUBLE[])) DESC, trace_id) AS rk
             FROM w JOIN p USING (query_id) WHERE marker >= 0.055 QUALIFY rk <= 2)
       SELECT query_id, window_id, max(CASE WHEN rk = 1 THEN trace_id END) AS trace_id, round(max(marker) * 0.7 + max(CASE WHEN rk = 1 THEN sc END) * 0.3, 6) AS score, round(coalesce(max(CASE WHEN rk = 2 THEN sc END), -1), 6) AS second_score FROM d GROUP BY ALL""",
)
def signal_match(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as tile signals; all vectors of a label are its candidate patterns."""
    rows = table(spark, folder, "embeddings")
    scaled = F.transform("embedding", lambda v: v.cast("double") * 30)
    windows = rows.select(F.col("label").alias("query_id"), F.col("vec_id").alias("window_id"), scaled.alias("signal"))
    patterns = rows.select(F.col("label").alias("query_id"), F.col("vec_id").alias("trace_id"), F.col("embedding").alias("pattern"))
    marker = rows.agg(F.min_by("embedding", "vec_id").alias("marker"))
    found = evidence.signal_match(windows, patterns, marker)
    return found.select("query_id", "window_id", "trace_id", F.round("score", 6).alias("score"), F.round("second_score", 6).alias("second_score"))


@query(
    "aligned_verdict",
    """WITH d AS (SELECT l_orderkey AS query_id, l_partkey AS record_id, l_linenumber AS rk, l_linenumber % 3 + 1 AS version, l_quantity <= 8 AS ok, CAST(l_quantity AS INTEGER) AS e FROM lineitem),
       g AS (SELECT query_id, count(*) AS n, max(record_id) AS record_id, max(version) AS version, max(e) AS bit_errors FROM d WHERE rk <= 8 AND ok GROUP BY 1 HAVING count(*) = 1)
       SELECT query_id, record_id, bit_errors, least(99, greatest(80, 99 - bit_errors * 6)) AS confidence, CASE version WHEN 1 THEN 'homography_aligned_robust_64' WHEN 2 THEN 'homography_aligned_rs_24_8_three_phase' ELSE 'homography_aligned_hmac64_full_repeat_v3' END AS method FROM g""",
)
def aligned_verdict(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("record_id"), F.col("l_partkey").cast("string").alias("trace_id"), F.col("l_linenumber").alias("candidate_rank"),
        (F.col("l_linenumber") % 3 + 1).alias("version"), (F.col("l_quantity") <= 8).alias("accepted"), F.col("l_quantity").cast("int").alias("bit_errors"),
    )
    return evidence.aligned_verdict(rows).select("query_id", "record_id", "bit_errors", "confidence", "method")


@query(
    "thumbnail_distance",
    """SELECT a.vec_id, round(list_avg(list_transform(range(1, 65), lambda i: abs(CAST(floor((a.embedding[i] + 1) * 100) AS INTEGER) - CAST(floor((b.embedding[i] + 1) * 100) AS INTEGER)))) / 255, 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def thumbnail_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Quantised embeddings as small thumbnails of neighbouring rows."""
    hexes = F.transform("embedding", lambda v: F.lpad(F.hex(F.floor((v + F.lit(1).cast("float")) * F.lit(100).cast("float")).cast("bigint")), 2, "0"))
    rows = table(spark, folder, "embeddings").select("vec_id", F.unhex(F.array_join(hexes, "")).alias("query_thumb"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("query_thumb").alias("target_thumb"))
    return evidence.thumbnail_distance(rows.join(other, "vec_id")).select("vec_id", F.round("thumbnail_distance", 6).alias("distance"))
