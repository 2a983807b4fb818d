"""Scalar rules over texts, paths, times, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from provena.functions import text
from provena.suite.base import query, table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


@query(
    "byte_size_text",
    """SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) ELSE printf('%.1f MB', b / 1048576.0::DOUBLE) END AS size
       FROM (SELECT o_orderkey, CAST(trunc(o_totalprice * o_custkey / 100) AS BIGINT) AS b FROM orders)""",
)
def byte_size_text(spark: SparkSession, folder: str) -> DataFrame:
    size = (F.col("o_totalprice") * F.col("o_custkey") / 100).cast("bigint")
    return table(spark, folder, "orders").select("o_orderkey", text.byte_size_text(size).alias("size"))


@query(
    "evidence_id_parts",
    """WITH e AS (SELECT doc_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-' || substr(s, 13, 20) AS e FROM (SELECT doc_id, md5(text) AS s FROM documents))
       SELECT doc_id, substr(e, 1, 8) AS head, right(e, 8) AS tail, upper(replace(e, '-', '')) AS plain, substr(upper(replace(e, '-', '')), 1, 4) AS old_head, right(upper(replace(e, '-', '')), 4) AS old_tail FROM e""",
)
def evidence_id_parts(spark: SparkSession, folder: str) -> DataFrame:
    s = F.md5(F.encode("text", "UTF-8"))
    rows = _docs(spark, folder).select("doc_id", F.concat_ws("-", F.substring(s, 1, 8), F.substring(s, 9, 4), F.substring(s, 13, 20)).alias("e"))
    head, tail = text.evidence_head_tail(F.col("e"))
    plain, old_head, old_tail = text.evidence_fields_legacy(F.col("e"))
    return rows.select("doc_id", head.alias("head"), tail.alias("tail"), plain.alias("plain"), old_head.alias("old_head"), old_tail.alias("old_tail"))


@query(
    "mask_url_password",
    r"""SELECT page_id, regexp_replace(replace(url, '://', '://user:p' || page_id || '@'), '://([^:/@]+):([^@]+)@', '://\1:****@', 'g') AS url FROM pages""",
)
def mask_url_password(spark: SparkSession, folder: str) -> DataFrame:
    with_password = F.replace("url", F.lit("://"), F.concat(F.lit("://user:p"), F.col("page_id").cast("string"), F.lit("@")))
    return table(spark, folder, "pages").select("page_id", text.mask_url_password(with_password).alias("url"))


@query(
    "parse_settings",
    """SELECT event_id, event_type IN ('view') AS flag, CASE WHEN event_type = 'error' THEN 75.0 ELSE greatest(60.0, least(95.0, value)) END AS quality,
         CASE WHEN event_type = 'signup' THEN 0.75 ELSE greatest(0.25, least(1.25, value / 10)) END AS amplitude FROM events""",
)
def parse_settings(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    flag = F.when(kind == "view", F.lit("Yes")).when(kind == "click", F.lit("")).otherwise(F.lit("off"))
    quality = F.when(kind == "error", F.lit("high")).otherwise(F.col("value").cast("string"))
    amplitude = F.when(kind == "signup", F.lit("NaN")).otherwise((F.col("value") / 10).cast("string"))
    return table(spark, folder, "events").select(
        "event_id", text.parse_bool(flag).alias("flag"), text.clamp_text(quality, 75.0, 60.0, 95.0).alias("quality"), text.clamp_text(amplitude, 0.75, 0.25, 1.25).alias("amplitude")
    )


@query(
    "normalize_modes",
    """WITH m AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '最快 LSB' WHEN 1 THEN 'FFT mode' WHEN 2 THEN 'Dwt' WHEN 3 THEN '全部算法' WHEN 4 THEN '空间域' ELSE p_name END AS raw, p_size % 6 AS k, p_size FROM part),
         n AS (SELECT *, CASE k WHEN 0 THEN 'lsb' WHEN 1 THEN 'fft' WHEN 2 THEN 'dwt' WHEN 3 THEN 'hybrid' WHEN 4 THEN 'lsb' ELSE 'dct' END AS mode FROM m)
       SELECT p_partkey, mode, CASE mode WHEN 'lsb' THEN '仅空间域' WHEN 'fft' THEN 'FFT + 空间域' WHEN 'dwt' THEN 'DWT + 空间域' WHEN 'hybrid' THEN '全部算法' ELSE 'DCT + 空间域' END AS label,
              CASE WHEN p_size IN (2, 3, 4) THEN p_size ELSE 1 END AS version, round(1 - least(1, greatest(0, p_size / 50.0)) * 0.72, 6) AS strength FROM n""",
)
def normalize_modes(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_size") % 6
    names = ["最快 LSB", "FFT mode", "Dwt", "全部算法", "空间域"]
    raw = F.col("p_name")
    for i, name in enumerate(names):
        raw = F.when(k == i, F.lit(name)).otherwise(raw)
    mode = text.normalize_mode(raw)
    return table(spark, folder, "part").select(
        "p_partkey", mode.alias("mode"), text.mode_label(mode).alias("label"), text.normalize_version(F.col("p_size").cast("string")).alias("version"),
        F.round(text.fidelity_to_strength((F.col("p_size") / 50.0).cast("string")), 6).alias("strength"),
    )


@query(
    "timestamp_checks",
    """SELECT event_id, event_type <> 'error' AS rfc3339, event_type NOT IN ('error', 'click') AS canonical, CASE WHEN event_type <> 'error' THEN epoch_ms(date_trunc('second', ts)) // 1000 - CASE event_type WHEN 'click' THEN 7200 ELSE 0 END END AS epoch,
       event_type <> 'error' AND user_id >= 10 AS ordered FROM events""",
)
def timestamp_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Event times as text: errors lose their zone, clicks carry an offset of two hours."""
    kind, plain = F.col("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    value = F.when(kind == "error", plain).when(kind == "click", F.concat(plain, F.lit("+02:00"))).otherwise(F.concat(plain, F.lit("Z")))
    rows = table(spark, folder, "events").select("event_id", "user_id", value.alias("v"))
    at = text.rfc3339_time(F.col("v"))
    later = at + F.make_interval(secs=F.when(F.col("user_id") >= 10, F.lit(5)).otherwise(F.lit(-5)))
    return rows.select(
        "event_id", text.is_rfc3339(F.col("v")).alias("rfc3339"), text.is_canonical_utc(F.col("v")).alias("canonical"), F.unix_timestamp(at).alias("epoch"), F.coalesce(at <= later, F.lit(False)).alias("ordered")
    )


@query(
    "safe_paths",
    """WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '../' || page_id || '.png' WHEN 1 THEN 'C:/x/' || page_id || '.JPG' WHEN 2 THEN 'in/./A' || page_id || '.JPG' WHEN 3 THEN 'in/b' || page_id || '.gif' ELSE url END AS path FROM pages)
       SELECT page_id, page_id % 5 IN (2, 3) OR (page_id % 5 = 4) AS safe, page_id % 5 IN (2, 3) AS under_prefix, page_id % 5 IN (0, 1, 2) AS image, CASE WHEN page_id % 5 = 2 THEN 'in/a' || page_id || '.jpg' END AS normalized FROM p""",
)
def safe_paths(spark: SparkSession, folder: str) -> DataFrame:
    key, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    path = (
        F.when(k == 0, F.concat(F.lit("../"), key, F.lit(".png"))).when(k == 1, F.concat(F.lit("C:/x/"), key, F.lit(".JPG")))
        .when(k == 2, F.concat(F.lit("in/./A"), key, F.lit(".JPG"))).when(k == 3, F.concat(F.lit("in/b"), key, F.lit(".gif"))).otherwise(F.col("url"))
    )
    rows = table(spark, folder, "pages").select("page_id", path.alias("p"))
    return rows.select(
        "page_id", text.is_safe_path(F.col("p")).alias("safe"), text.is_safe_path(F.col("p"), "in").alias("under_prefix"), text.has_image_extension(F.col("p")).alias("image"),
        F.when(F.col("page_id") % 5 == 2, text.normalized_path(F.col("p"))).alias("normalized"),
    )


@query(
    "packet_valid",
    """SELECT doc_id, lang IN ('en', 'es') AND source <> 'src3' AS valid FROM documents""",
)
def packet_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Packets with a valid id and evidence; German ones have an upper-case id, French ones a wrong mode."""
    h = F.md5(F.encode("text", "UTF-8"))
    packet = F.to_json(
        F.struct(
            F.when(F.col("lang") == "de", F.concat(F.lit("Z"), F.substring(h, 2, 31))).otherwise(h).alias("id"), F.when(F.col("source") == "src3", F.lit(" ")).otherwise(F.lit("t")).alias("trace_id"),
            F.lit("u").alias("user_id"), F.when(F.col("lang") == "fr", F.lit("xyz")).otherwise(F.lit("dct")).alias("mode"), F.lit("2026-01-01").alias("created_at"), F.upper(h).alias("evidence_uuid"),
        )
    )
    return _docs(spark, folder).select("doc_id", text.packet_valid(packet).alias("valid"))


@query(
    "decode_menus",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user,menu' || turn WHEN 'assistant' THEN 'a' ELSE '' END AS menus FROM conversations""",
)
def decode_menus(spark: SparkSession, folder: str) -> DataFrame:
    """Menu lists as JSON: repeats, numbers and blanks drop out, broken text is an empty list."""
    raw = (
        F.when(F.col("role") == "user", F.concat(F.lit('["user", "menu'), F.col("turn").cast("string"), F.lit('", "user", 5, ""]')))
        .when(F.col("role") == "assistant", F.lit('["a", null]')).otherwise(F.lit("{not json"))
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(text.decode_menus(raw), ",").alias("menus"))


@query("visible_text_id", "SELECT doc_id, 'VISIBLE-' || upper(substr(sha1(text), 1, 12)) AS visible_id FROM documents")
def visible_text_id(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", text.visible_text_id(F.col("text")).alias("visible_id"))


@query(
    "safe_file_id",
    """SELECT page_id, nullif(regexp_replace(url, '[^A-Za-z0-9_-]', '', 'g'), '') AS file_id,
         CASE page_id % 3 WHEN 0 THEN 'feature_index/' || regexp_replace(url, '[^A-Za-z0-9_-]', '', 'g') || '.npz' WHEN 1 THEN 'x/' || page_id || '.npz' END AS index_path FROM pages""",
)
def safe_file_id(spark: SparkSession, folder: str) -> DataFrame:
    k, key = F.col("page_id") % 3, F.col("page_id").cast("string")
    stored = F.when(k == 1, F.concat(F.lit("x\\"), key, F.lit(".npz"))).when(k == 2, F.concat(F.lit("../"), key))
    return table(spark, folder, "pages").select("page_id", text.safe_file_id(F.col("url")).alias("file_id"), text.feature_index_path(stored, F.col("url")).alias("index_path"))


@query(
    "display_fields",
    """SELECT event_id, CASE event_type WHEN 'error' THEN '-' WHEN 'view' THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS shown, CASE event_type WHEN 'click' THEN '-' ELSE printf('%.1f%%', v + CASE WHEN v * 4 = floor(v * 4) AND CAST(floor(v * 4) AS BIGINT) % 2 = 1 THEN 0.01 ELSE 0 END) END AS percent FROM (SELECT *, round(value, 2) / 100 * 100 AS v FROM events)""",
)
def display_fields(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    raw = F.when(kind == "error", F.lit("  ")).when(kind == "view", F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    share = F.when(kind != "click", F.round("value", 2) / 100)
    return table(spark, folder, "events").select("event_id", text.display_time(raw).alias("shown"), text.percent_text(share).alias("percent"))


@query("safe_image_url", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/p/' || page_id ELSE '' END AS url FROM pages")
def safe_image_url(spark: SparkSession, folder: str) -> DataFrame:
    k, key = F.col("page_id") % 4, F.col("page_id").cast("string")
    raw = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("/p/"), key)).when(k == 2, F.concat(F.lit("//h/"), key)).otherwise(F.concat(F.lit("javascript:"), key))
    return table(spark, folder, "pages").select("page_id", text.safe_image_url(raw).alias("url"))


@query(
    "dated_keys",
    "SELECT event_id, event_type || ':' || strftime(ts, '%Y-%m-%d') AS counter_key, epoch_ms(date_trunc('second', ts)) // 1000 // 300 * 300 AS bucket FROM events",
)
def dated_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", "event_type", "ts", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("e"))
    return rows.select("event_id", text.daily_key(F.col("event_type"), F.col("ts")).alias("counter_key"), text.rate_bucket(F.col("e")).alias("bucket"))


@query(
    "confidence_rules",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(99, greatest(80, 99 - l_linenumber * 4)) AS v4, least(99, greatest(80, 99 - l_linenumber * 6)) AS aligned, CAST(least(96, greatest(76, 72 + l_linenumber * 2)) AS INTEGER) AS dots,
         CAST(trunc(least(96, greatest(78, 72 + l_extendedprice / 1200))) AS INTEGER) AS small_crop, CAST(least(96, greatest(75, trunc(75 + l_discount * 10 * 25))) AS INTEGER) AS residual, CASE WHEN l_returnflag = 'R' THEN 98 ELSE 92 END AS packet FROM lineitem""",
)
def confidence_rules(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.confidence_v4(n).alias("v4"), text.confidence_aligned(n).alias("aligned"), text.confidence_dots(n).alias("dots"),
        text.confidence_small_crop(F.col("l_extendedprice")).alias("small_crop"), text.confidence_residual(F.col("l_discount") * 10).alias("residual"), text.confidence_packet(F.col("l_returnflag") == "R").alias("packet"),
    )


@query(
    "normalize_legacy_documents",
    """SELECT 'unknown role' AS problem, 'u' || c_custkey AS key FROM customer WHERE c_mktsegment = 'MACHINERY'
       UNION ALL SELECT 'duplicate image id', 'i' || c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 1""",
)
def normalize_legacy_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as JSON documents, one a nation: users name their segment as role, images their nation."""
    from provena.sources.documents import normalize_legacy_documents as load

    users = table(spark, folder, "customer")
    name = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    entry = F.struct(name.alias("key"), F.struct(F.lit("pw").alias("password"), F.col("c_mktsegment").alias("role")).alias("value"))
    docs = users.groupBy("c_nationkey").agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("users"))).alias("users"),
        F.to_json(F.collect_list(F.struct(F.concat(F.lit("i"), F.col("c_nationkey").cast("string")).alias("id")))).alias("images"),
    )
    menus = F.struct(F.lit("x").alias("label"), F.array(F.lit("trace"), F.lit(" trace "), F.lit("")).alias("menus"))
    roles = users.where(F.col("c_mktsegment") != "MACHINERY").select("c_mktsegment").distinct().agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("c_mktsegment").alias("key"), menus.alias("value")))).alias("roles"))).alias("document")
    )
    tables = load(docs.select(F.col("images").alias("document")), roles, docs.select(F.col("users").alias("document")))
    return tables["problems"]
