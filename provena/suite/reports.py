"""Reporting queries: summaries, distributions, verdicts, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from provena.functions import crypto
from provena.operators import gates, listing, summaries
from provena.sources import registry as reader, sinks
from provena.suite.base import CASES_SQL, cases, query, table

_ATTACK_SQL = "WITH " + CASES_SQL + """,
g AS (
  SELECT 'total' AS grouping, '' AS key, * FROM (SELECT case_type, success, correct_trace FROM cases)
  UNION ALL SELECT 'attack', attack, case_type, success, correct_trace FROM cases WHERE case_type = 'watermarked'
  UNION ALL SELECT 'round', CAST(round AS VARCHAR), case_type, success, correct_trace FROM cases),
m AS (SELECT grouping, key, count(*) FILTER (case_type = 'watermarked') AS positive_total,
  count(*) FILTER (case_type = 'watermarked' AND correct_trace) AS correct,
  count(*) FILTER (case_type = 'watermarked' AND success AND NOT correct_trace) AS wrong,
  count(*) FILTER (case_type = 'watermarked' AND NOT success) AS missed,
  count(*) FILTER (case_type <> 'watermarked') AS negative_total,
  count(*) FILTER (case_type <> 'watermarked' AND success) AS false_positive FROM g GROUP BY ALL),
summary AS (SELECT *, CASE WHEN positive_total > 0 THEN round(correct / positive_total, 4) ELSE 0 END AS recall,
  CASE WHEN positive_total > 0 THEN round(wrong / positive_total, 4) ELSE 0 END AS wrong_rate,
  CASE WHEN negative_total > 0 THEN round(false_positive / negative_total, 4) ELSE 0 END AS false_positive_rate FROM m)"""
_CROP_SQL = _ATTACK_SQL.replace(
    "SELECT 'attack', attack, case_type, success, correct_trace FROM cases WHERE case_type = 'watermarked'",
    "SELECT 'scale', CAST(scale_factor AS VARCHAR), case_type, success, correct_trace FROM cases WHERE case_type = 'watermarked'",
).replace(
    "SELECT 'round', CAST(round AS VARCHAR), case_type, success, correct_trace FROM cases",
    "SELECT 'crop', CAST(crop_ratio AS VARCHAR), case_type, success, correct_trace FROM cases WHERE case_type = 'watermarked'",
)


@query(
    "scan_manifest",
    "SELECT conv_id AS manifest_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS index, role AS category, 'c/' || turn AS relative_path FROM conversations",
)
def scan_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as manifests: one JSON document each, exploded with the array index kept."""
    turns = table(spark, folder, "conversations")
    item = F.struct(F.col("turn"), F.struct(F.concat(F.lit("s"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("category"), F.concat(F.lit("c/"), F.col("turn").cast("string")).alias("relative_path")).alias("item"))
    manifests = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items")).select(
        F.col("conv_id").alias("manifest_id"), F.to_json(F.struct(F.transform("items", lambda i: i["item"]).alias("samples"))).alias("document")
    )
    return reader.manifest_items(manifests, "samples").select("manifest_id", "index", "category", "relative_path")


@query(
    "scan_case_results",
    "WITH " + CASES_SQL + " SELECT attack, case_type, count(*) AS cases, count(*) FILTER (success) AS found FROM cases GROUP BY ALL",
)
def scan_case_results(spark: SparkSession, folder: str) -> DataFrame:
    """Case rows written as report JSON (one report an order) and read back typed."""
    all_cases = cases(spark, folder).withColumn("report_id", F.xxhash64("detection_ms", "scale_factor"))
    reports = all_cases.groupBy("report_id").agg(
        F.to_json(F.struct(F.collect_list(F.struct("round", "attack", "case_type", "success", "correct_trace", "detection_ms")).alias("cases"))).alias("report")
    )
    return reader.scan_case_results(reports).groupBy("attack", "case_type").agg(F.count(F.lit(1)).alias("cases"), F.count_if("success").alias("found"))


@query("attack_summary", _ATTACK_SQL + " SELECT * FROM summary")
def attack_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.attack_summary(cases(spark, folder))


@query("crop_summary", _CROP_SQL + " SELECT * FROM summary")
def crop_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.crop_summary(cases(spark, folder))


@query(
    "negative_summary",
    "WITH " + CASES_SQL + """, g AS (SELECT 'total' AS grouping, '' AS key, category, success FROM cases UNION ALL SELECT 'category', category, category, success FROM cases)
       SELECT grouping, key, count(*) AS total, count(*) FILTER (success) AS false_positive, count(*) FILTER (success AND NOT starts_with(category, 'synthetic_')) AS source_false_positive,
              round(count(*) FILTER (success) / count(*), 4) AS false_positive_rate FROM g GROUP BY ALL""",
)
def negative_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.negative_summary(cases(spark, folder))


_PROFILE_SQL = "WITH " + CASES_SQL + """, g AS (SELECT 'total' AS grouping, '' AS key, * FROM cases UNION ALL SELECT 'profile', attack, * FROM cases)
  SELECT grouping, key, count(*) FILTER (case_type = 'watermarked' AND correct_trace) AS correct, count(*) FILTER (case_type = 'watermarked') AS total,
    count(*) FILTER (case_type = 'watermarked' AND success AND NOT correct_trace) AS wrong_trace,
    count(*) FILTER (case_type <> 'watermarked' AND success) AS negative_false_positives, count(*) FILTER (case_type <> 'watermarked') AS negative_total,
    round(count(*) FILTER (case_type = 'watermarked' AND correct_trace) / count(*) FILTER (case_type = 'watermarked'), 6) AS recall FROM g GROUP BY ALL"""


@query("profile_summary", _PROFILE_SQL)
def profile_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = cases(spark, folder).select(
        F.col("attack").alias("profile"), (F.col("case_type") == "watermarked").alias("expected_watermarked"), F.col("success").alias("detected"),
        F.col("correct_trace").alias("correct"), (F.col("success") & ~F.col("correct_trace")).alias("wrong_trace"),
    )
    return summaries.profile_summary(rows)


_CONFIG_SQL = "WITH " + CASES_SQL + """,
q AS (SELECT l_linenumber / 10.0 AS fidelity, min(l_extendedprice / 1000) AS min_psnr, min(1 - l_tax) AS min_ssim, bool_and(l_extendedprice / 1000 >= 0.9 AND 1 - l_tax >= 0.92 ) AS quality_pass FROM lineitem GROUP BY 1),
p AS (SELECT round / 10.0 AS fidelity, count(*) FILTER (case_type = 'watermarked') AS probe_total, count(*) FILTER (case_type = 'watermarked' AND correct_trace) AS probe_correct,
  count(*) FILTER (case_type = 'watermarked' AND success AND NOT correct_trace) AS wrong, count(*) FILTER (case_type <> 'watermarked') AS negative_total, count(*) FILTER (case_type <> 'watermarked' AND success) AS false_positive FROM cases GROUP BY 1),
configs AS (SELECT CAST(fidelity AS DOUBLE) AS fidelity, min_psnr, min_ssim, quality_pass, probe_total, probe_correct, round(probe_correct / probe_total, 6) AS probe_recall, wrong, negative_total, false_positive FROM q JOIN p USING (fidelity))"""


def _configs(spark: SparkSession, folder: str) -> DataFrame:
    quality = table(spark, folder, "lineitem").select(
        (F.col("l_linenumber") / 10.0).alias("fidelity"), (F.col("l_extendedprice") / 1000).alias("psnr"), (1 - F.col("l_tax")).alias("ssim")
    ).withColumn("pass", gates.quality_pass(0.9, 0.92))
    return summaries.config_summary(quality, cases(spark, folder).withColumn("fidelity", F.col("round") / 10.0))


@query("config_summary", _CONFIG_SQL + " SELECT * REPLACE (round(min_psnr, 6) AS min_psnr, round(min_ssim, 6) AS min_ssim) FROM configs")
def config_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _configs(spark, folder).withColumn("min_psnr", F.round("min_psnr", 6)).withColumn("min_ssim", F.round("min_ssim", 6))


@query(
    "quality_verdict",
    _CONFIG_SQL + """ SELECT fidelity, CASE WHEN quality_pass AND wrong = 0 AND false_positive = 0 AND probe_recall >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS verdict,
       concat_ws(',', CASE WHEN NOT quality_pass THEN 'quality_gate' END, CASE WHEN wrong > 0 THEN 'wrong_trace' END, CASE WHEN false_positive > 0 THEN 'false_positive' END,
                 CASE WHEN probe_recall < 0.95 THEN 'probe_recall' END) AS reasons FROM configs""",
)
def quality_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return gates.rejected_reasons(_configs(spark, folder)).select("fidelity", "verdict", F.concat_ws(",", "rejected_reasons").alias("reasons"))


@query(
    "recommend_config",
    """WITH c AS (SELECT l_orderkey / 10.0 AS fidelity, l_extendedprice / 1000 AS psnr, 1 - l_tax AS ssim, l_linestatus = 'O' AS marked, l_discount > 0.03 AS success, l_discount > 0.03 AND l_tax < 0.07 AS correct FROM lineitem),
       g AS (SELECT CAST(fidelity AS DOUBLE) AS fidelity, min(psnr) AS min_psnr, min(ssim) AS min_ssim, bool_and(psnr >= 2 AND ssim >= 0.95) AS quality_pass, count(*) FILTER (marked AND success AND NOT correct) AS wrong,
                count(*) FILTER (NOT marked AND success) AS false_positive, coalesce(round(count(*) FILTER (marked AND correct) / nullif(count(*) FILTER (marked), 0), 6), 0) AS probe_recall FROM c GROUP BY 1)
       SELECT 'PASS' AS verdict, fidelity, round(min_ssim, 6) AS min_ssim, round(min_psnr, 6) AS min_psnr, probe_recall FROM g
       WHERE quality_pass AND wrong = 0 AND false_positive = 0 AND probe_recall >= 0.95 ORDER BY g.min_ssim DESC, g.min_psnr DESC, probe_recall DESC, fidelity DESC LIMIT 1""",
)
def recommend_config(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as configurations: each of the four gates turns some of them down."""
    lines = table(spark, folder, "lineitem").withColumn("fidelity", F.col("l_orderkey") / 10.0)
    quality = lines.select("fidelity", (F.col("l_extendedprice") / 1000).alias("psnr"), (1 - F.col("l_tax")).alias("ssim")).withColumn("pass", gates.quality_pass(2.0, 0.95))
    found = F.col("l_discount") > 0.03
    probes = lines.select(
        "fidelity", F.when(F.col("l_linestatus") == "O", F.lit("watermarked")).otherwise(F.lit("unwatermarked")).alias("case_type"), found.alias("success"), (found & (F.col("l_tax") < 0.07)).alias("correct_trace"),
    )
    best = summaries.recommend_config(summaries.config_summary(quality, probes))
    return best.withColumn("min_ssim", F.round("min_ssim", 6)).withColumn("min_psnr", F.round("min_psnr", 6))


@query(
    "manifest_counts",
    "SELECT count(*) AS slots, count(*) FILTER (o_orderstatus = 'O') AS collected, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders",
)
def manifest_counts(spark: SparkSession, folder: str) -> DataFrame:
    names = F.create_map(F.lit("O"), F.lit("collected"), F.lit("P"), F.lit("pending_collection"))
    return summaries.manifest_counts(table(spark, folder, "orders").select(F.try_element_at(names, F.col("o_orderstatus")).alias("status")))


@query(
    "metric_distribution",
    """SELECT l_returnflag AS fidelity, round(min(l_extendedprice), 6) AS min, round(quantile_cont(l_extendedprice, 0.05), 6) AS p5, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
       round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY 1""",
)
def metric_distribution(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("fidelity"), F.col("l_extendedprice").alias("psnr"))
    return summaries.metric_distribution(rows, ["fidelity"], "psnr")


@query(
    "latency_percentiles",
    "WITH " + CASES_SQL + """ SELECT case_type, quantile_disc(detection_ms, 0.5) AS p50, quantile_disc(detection_ms, 0.95) AS p95, max(detection_ms) AS max FROM cases GROUP BY 1""",
)
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.latency_percentiles(cases(spark, folder), ["case_type"])


@query(
    "stage_timing",
    """SELECT event_type AS stage, count(*) AS events, sum(CAST(user_id AS BIGINT))::BIGINT AS candidates, count(*) FILTER (value > 10) AS fallbacks, round(min(value), 6) AS min,
       round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1""",
)
def stage_timing(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"), F.col("user_id").alias("candidate_count"), (F.col("value") > 10).cast("int").alias("fallback_count")
    )
    return summaries.stage_timing(rows)


@query(
    "attack_verdict",
    _ATTACK_SQL + """, f AS (
       SELECT -2.0 AS a, 0 AS b, 'wrong_trace' AS gate FROM summary WHERE grouping = 'total' AND wrong > 0
       UNION ALL SELECT -1.0, 0, 'false_positive' FROM summary WHERE grouping = 'total' AND false_positive > 0
       UNION ALL SELECT CAST(key AS DOUBLE), 0, 'round_' || key || '_recall' FROM summary WHERE grouping = 'round' AND recall < 0.95
       UNION ALL SELECT CAST(key AS DOUBLE), 1, 'round_' || key || '_wrong_trace' FROM summary WHERE grouping = 'round' AND wrong > 0
       UNION ALL SELECT CAST(key AS DOUBLE), 2, 'round_' || key || '_false_positive' FROM summary WHERE grouping = 'round' AND false_positive > 0)
       SELECT CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, coalesce(string_agg(gate, ',' ORDER BY a, b), '') AS failed_gates FROM f""",
)
def attack_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return gates.attack_verdict(summaries.attack_summary(cases(spark, folder))).withColumn("failed_gates", F.concat_ws(",", "failed_gates"))


@query(
    "crop_verdict",
    _CROP_SQL + """, f AS (
       SELECT -3.0 AS a, 'wrong_trace' AS gate FROM summary WHERE grouping = 'total' AND wrong > 0
       UNION ALL SELECT -2.0, 'false_positive' FROM summary WHERE grouping = 'total' AND false_positive > 0
       UNION ALL SELECT -1.0, 'overall_recall' FROM summary WHERE grouping = 'total' AND recall < 0.95
       UNION ALL SELECT CAST(key AS DOUBLE), 'crop_' || key || '_recall' FROM summary WHERE grouping = 'crop' AND recall < CASE WHEN CAST(key AS DOUBLE) <= 0.3 THEN 0.8 ELSE 0.95 END)
       SELECT CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, coalesce(string_agg(gate, ',' ORDER BY a), '') AS failed_gates FROM f""",
)
def crop_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return gates.crop_verdict(summaries.crop_summary(cases(spark, folder))).withColumn("failed_gates", F.concat_ws(",", "failed_gates"))


@query(
    "negative_verdict",
    "WITH " + CASES_SQL + """, s AS (SELECT count(*) AS n, count(*) FILTER (success) AS fp, count(*) FILTER (success AND NOT starts_with(category, 'synthetic_')) AS sfp FROM cases)
       SELECT CASE WHEN sfp > 0 OR fp / n >= 0.001 THEN 'FAIL' ELSE 'PASS' END AS verdict,
              concat_ws(',', CASE WHEN sfp > 0 THEN 'source_false_positive' END, CASE WHEN fp / n >= 0.001 THEN 'false_positive_rate' END) AS failed_gates FROM s""",
)
def negative_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return gates.negative_verdict(summaries.negative_summary(cases(spark, folder))).withColumn("failed_gates", F.concat_ws(",", "failed_gates"))


def _release_reports(spark: SparkSession, folder: str) -> DataFrame:
    """One release report a supplier, its measures taken from the supplier's line items."""
    m = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("report_id")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("l_discount") < 0.1).cast("double")).alias("rate"), F.min("l_quantity").alias("low"),
        F.max("l_quantity").alias("high"), F.count_if((F.col("l_tax") > 0.07) & (F.col("l_quantity") > 49)).alias("wrong"),
    )
    names = lambda items, value: F.create_map(*[x for i in items for x in (F.lit(i), value)])
    measure = F.struct(F.lit(1).alias("samples"), F.lit(0).alias("wrong_traces"))
    quality = F.struct((F.col("high") - 10).alias("psnr"), F.lit(0.96).alias("ssim"))
    suites = F.struct(
        names(("full", "resize", "jpeg", "crop"), F.round("rate", 2) + 0.09).alias("recall"),
        F.struct(F.lit(0.97).alias("rate"), F.lit(0).alias("wrong_traces")).alias("attribution"),
        F.struct((F.col("n") * 5).alias("independent_count"), F.lit(0).alias("wrong_attributions")).alias("negative"),
        F.struct((F.col("n") * 2).alias("same_source_versions"), F.lit(True).alias("indexed_lookup")).alias("scale"),
        names(gates.ATTACKS, measure).alias("attacks"), names(gates.QUALITY_STRATA, quality).alias("quality"),
        F.struct(
            F.lit(100.0).alias("standard_p95_seconds"), (F.col("high") * 6).alias("standard_max_seconds"), F.lit(900.0).alias("deep_max_seconds"),
            names(("decode",), F.array(F.lit(1.0))).alias("stage_timings"),
        ).alias("performance"),
    )
    digest = lambda salt: F.array(F.sha2(F.concat(F.lit(salt), F.col("report_id").cast("string")), 256))
    report = F.struct(
        F.lit("c0ffee1234" * 4).alias("git_commit"), F.lit("v4").alias("schema_id"), F.lit(crypto.CODEC).alias("codec"),
        names(("dinov2", "superpoint", "lightglue"), F.lit("2025.2")).alias("model_versions"), names(("dinov2", "superpoint", "lightglue"), F.lit(True)).alias("model_health"),
        F.create_map(F.lit("development"), digest("d"), F.lit("release"), digest("r"), F.lit("blind"), digest("b")).alias("manifest_hashes"),
        F.lit(90210).alias("random_seed"), names(("cpu", "gpu", "ram_bytes"), F.lit("32")).alias("hardware"), digest("x").alias("raw_artifact_hashes"),
        F.lit(True).alias("query_plan_ok"), F.col("wrong").alias("sensitive_log_leaks"), suites.alias("suites"),
    )
    return m.select("report_id", F.to_json(report).alias("report"))


@query(
    "release_gate",
    """WITH m AS (SELECT l_suppkey AS report_id, count(*) AS n, round(avg(CASE WHEN l_discount < 0.1 THEN 1.0 ELSE 0.0 END), 2) + 0.09 AS rate, max(l_quantity) AS high,
                  count(*) FILTER (l_tax > 0.07 AND l_quantity > 49) AS wrong FROM lineitem GROUP BY 1),
       f AS (SELECT report_id, CASE WHEN wrong <> 0 THEN 'sensitive log leak' WHEN rate < 0.99 THEN 'full recall below threshold'
          WHEN n * 5 < 3000 THEN 'negative gate requires 3000 independent samples' WHEN n * 2 < 1000 THEN 'scale gate requires 1000 same-source versions'
          WHEN high - 10 < 38 THEN 'high_texture PSNR below 38' WHEN high * 6 > 300 THEN 'standard request exceeds 300 seconds' END AS failure FROM m)
       SELECT report_id, failure, CASE WHEN failure IS NULL THEN 'PASS' ELSE 'FAIL' END AS verdict FROM f""",
)
def release_gate(spark: SparkSession, folder: str) -> DataFrame:
    return gates.release_gate(_release_reports(spark, folder))


_REPORT_KEY = b"release-report-signing-key-for-tests-only"


def _hmac_sql(key: bytes, message: str) -> str:
    """SQL text of HMAC-SHA256 (hex) over a BLOB expression."""
    block = key.ljust(64, b"\0")
    pads = ["".join(f"{b ^ x:02x}" for b in block) for x in (0x36, 0x5C)]
    return f"sha256(unhex('{pads[1]}') || unhex(sha256(unhex('{pads[0]}') || ({message}))))"


@query(
    "signed_report",
    f"""SELECT doc_id AS report_id, CASE WHEN lang = 'de' THEN 'release report signature is invalid' WHEN lang = 'fr' THEN 'release report is stale' END AS failure,
         {_hmac_sql(_REPORT_KEY, "encode(text)")} AS signature FROM documents""",
)
def signed_report(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as canonical report texts; German ones carry a wrong signature, French ones an old commit."""
    signature = crypto.report_signature(_REPORT_KEY, F.col("text"))
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("report_id"), F.col("text").alias("report"), F.when(F.col("lang") == "de", F.lit("0")).otherwise(signature).alias("signature"),
        F.when(F.col("lang") == "fr", F.lit("old")).otherwise(F.lit("new")).alias("git_commit"), signature.alias("expected"),
    )
    checked = gates.signed_report_valid(rows, _REPORT_KEY, "new")
    return checked.join(rows.select("report_id", F.col("expected").alias("signature")), "report_id")


@query(
    "report_reusable",
    """SELECT event_id AS report_id, user_id % 2 = 0 AND event_type <> 'error' AND user_id < 100 AS reusable,
         ts >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 2 SECOND AND ts <= TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 2 SECOND AS fresh FROM events""",
)
def report_reusable(spark: SparkSession, folder: str) -> DataFrame:
    even = F.col("user_id") % 2 == 0
    settings = F.create_map(F.lit("scales"), F.lit("[0.5,1.0]"), F.lit("fidelity"), F.when(even, F.lit("0.950")).otherwise(F.lit("0.90")), F.lit("mode"), F.lit('"Hybrid"'))
    extra = F.map_concat(settings, F.create_map(F.lit("extra"), F.lit("1")))
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("report_id"), F.lit("attack").alias("benchmark"), F.lit("4").alias("algorithm_version"), F.lit(7).alias("seed"),
        F.when(F.col("event_type") == "error", F.lit("UNKNOWN")).otherwise(F.lit("PASS")).alias("verdict"), F.lit(1).alias("schema_version"),
        F.col("ts").alias("generated_at"), F.when(F.col("user_id") < 100, settings).otherwise(extra).alias("settings"),
    )
    kind = dict(rows.dtypes)["generated_at"]
    at = lambda t: F.lit(t).cast(kind)
    wanted = {"scales": "[0.5,1.0]", "fidelity": "0.95", "mode": '"Hybrid"'}
    return gates.report_reusable(rows, wanted, "attack", "4", 7, at("2024-01-10 00:00:00"), at("2024-01-20 00:00:00"))


@query(
    "write_report",
    """WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS report_id, l_discount > 0.03 AS success, l_discount > 0.03 AND l_tax < 0.07 AS correct_trace, l_extendedprice AS detection_ms FROM lineitem)
       SELECT report_id, 'attack' AS benchmark, 7 AS seed, count(*) AS total, count(*) FILTER (success) AS found,
       CASE WHEN count(*) FILTER (success AND NOT correct_trace) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) AS case_rows, round(sum(detection_ms), 2) AS case_ms FROM c GROUP BY 1""",
)
def write_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as reports with their lines as case rows (a few each), read back from their JSON."""
    found = F.col("l_discount") > 0.03
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("report_id"), F.col("l_linestatus").alias("case_type"), found.alias("success"),
        (found & (F.col("l_tax") < 0.07)).alias("correct_trace"), F.col("l_extendedprice").alias("detection_ms"),
    )
    m = rows.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("found"), F.count_if(F.col("success") & ~F.col("correct_trace")).alias("wrong"),
        F.collect_list(F.struct("case_type", "success", "correct_trace", "detection_ms")).alias("cases"),
    )
    verdict = F.when(F.col("wrong") > 0, F.lit("FAIL")).otherwise(F.lit("PASS"))
    body = sinks.report_rows(
        F.col("report_id"), F.struct(F.lit("attack").alias("benchmark"), F.lit(7).alias("seed")), F.struct("total", "found"), F.col("cases"),
        F.struct(F.lit(1).alias("rounds")), verdict, F.when(F.col("wrong") > 0, F.array(F.lit("wrong_trace"))).otherwise(F.array().cast("array<string>")),
    )
    get = lambda p, t: F.get_json_object("report", p).cast(t)
    back = F.from_json(F.get_json_object("report", "$.cases"), "array<struct<case_type:string,detection_ms:double>>")
    return m.select(*body).select(
        "report_id", get("$.metadata.benchmark", "string").alias("benchmark"), get("$.metadata.seed", "int").alias("seed"), get("$.summary.total", "bigint").alias("total"),
        get("$.summary.found", "bigint").alias("found"), get("$.verdict", "string").alias("verdict"), F.size(back).cast("bigint").alias("case_rows"),
        F.round(F.aggregate(back, F.lit(0.0), lambda n, c: n + c["detection_ms"]), 2).alias("case_ms"),
    )


@query(
    "report_contract",
    """SELECT doc_id AS report_id, CASE lang WHEN 'de' THEN 'missing cases' WHEN 'fr' THEN 'PASS verdict requires no failed gates' WHEN 'es' THEN 'metadata.seed must be an integer' END AS message
       FROM documents WHERE lang <> 'en'""",
)
def report_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as report JSON with one broken rule per language."""
    from provena.operators import validators

    es, fr, de = (F.col("lang") == x for x in ("es", "fr", "de"))
    head = F.concat(
        F.lit('{"metadata":{"schema_version":1,"benchmark":"b","algorithm_version":"4","seed":'), F.when(es, F.lit('"7"')).otherwise(F.lit("7")),
        F.lit(',"generated_at":"2026-07-29T10:00:00Z","python_version":"3","platform":"p","configuration":{}},"summary":'), F.to_json(F.struct("source")),
        F.when(de, F.lit("")).otherwise(F.lit(',"cases":[]')), F.lit(',"settings":{},"verdict":"PASS","failed_gates":'), F.when(fr, F.lit('["x"]')).otherwise(F.lit("[]")), F.lit("}"),
    )
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("report_id"), head.alias("report"))
    return validators.report_errors(rows, ()).select("report_id", "message")


@query(
    "negative_manifest_errors",
    """WITH s AS (SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS index, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
       SELECT conv_id AS manifest_id, -1 AS index, 'samples length must equal expected_slots (6)' AS message FROM s WHERE n <> 6 GROUP BY 1
       UNION ALL SELECT conv_id, index, 'category must be one of: photo, illustration, ui, low_texture, high_texture, similar_composition' FROM s WHERE role = 'system'
       UNION ALL SELECT conv_id, index, 'sha256 must be null for pending sample' FROM s WHERE role = 'assistant'""",
)
def negative_manifest_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as manifests of samples; roles decide which rule a sample breaks."""
    from provena.operators import validators

    user = F.col("role") == "user"
    name = F.concat(F.lit("s"), F.col("turn").cast("string"))
    sample = F.struct(
        name.alias("id"), F.when(F.col("role") == "system", F.lit("other")).otherwise(F.lit("photo")).alias("category"),
        F.concat(F.lit(validators.NEGATIVE_PREFIX + "/"), name, F.lit(".png")).alias("relative_path"), F.lit("pending_collection").alias("status"),
        F.when(~user & (F.col("role") != "system"), F.sha2("text", 256)).alias("sha256"),
    )
    lists = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", sample.alias("s")))).alias("l"))
    doc = F.struct(F.lit(1).alias("schema_version"), F.lit("d").alias("dataset_id"), F.lit(6).alias("target_slots"), F.transform("l", lambda x: x["s"]).alias("samples"))
    manifests = lists.select(F.col("conv_id").alias("manifest_id"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))
    return validators.negative_manifest_errors(manifests, 6).select("manifest_id", "index", "message")


@query(
    "route_manifest_errors",
    """WITH r AS (SELECT o_custkey AS manifest_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS index, * FROM orders)
       SELECT manifest_id, index, 'rejection_reason must be nonempty when pending route contains evidence' AS message FROM r WHERE o_orderstatus = 'P'
       UNION ALL SELECT manifest_id, index, 'notes must be nonempty when pending route contains evidence' FROM r WHERE o_orderstatus = 'P'
       UNION ALL SELECT manifest_id, index, 'reviewer must differ from operator for collected route' FROM r WHERE o_orderstatus = 'F'
       UNION ALL SELECT manifest_id, -1, 'routes must include route ''' || k || '''' FROM (SELECT DISTINCT o_custkey AS manifest_id FROM orders), (VALUES ('wechat', '1'), ('browser', '2'), ('target_platform', '3')) v(k, p)
         WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = manifest_id AND CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '1' WHEN '2' THEN '2' ELSE '3' END = p)""",
)
def route_manifest_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as manifests, orders as route attempts with evidence by order status."""
    from provena.operators import validators

    first = F.substring("o_orderpriority", 1, 1)
    route = F.when(first == "1", F.lit("wechat")).when(first == "2", F.lit("browser")).otherwise(F.lit("target_platform"))
    sid = F.concat(F.lit("src"), F.col("o_orderkey").cast("string"))
    done, open_ = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P"
    sha = F.sha2(sid, 256)
    filled = lambda value: F.when(done, value).otherwise(F.lit(""))
    item = F.struct(
        sid.alias("source_id"), route.alias("route"), F.lit(1).alias("attempt"), F.when(done, F.lit("2026-07-29T10:00:00Z")).alias("sent_at"),
        F.when(done, F.lit("2026-07-29T10:00:05Z")).alias("received_at"), F.concat(F.lit(validators.SOURCE_PREFIX + "/"), sid, F.lit(".png")).alias("source_relative_path"),
        F.concat(F.lit(validators.RECEIVED_PREFIX + "/"), sid, F.lit("--"), route, F.lit("--attempt-001.png")).alias("output_relative_path"),
        F.when(done, sha).alias("source_sha256"), F.when(done, sha).alias("received_sha256"), F.when(done, F.lit("collected")).otherwise(F.lit("pending_collection")).alias("status"),
        filled(F.lit("ann")).alias("operator"), F.when(done | open_, F.lit("phone")).otherwise(F.lit("")).alias("device"), filled(F.lit("app")).alias("software"), filled(F.lit("1")).alias("software_version"),
        filled(F.lit("c")).alias("account_channel"), filled(F.lit("n")).alias("notes"), filled(F.lit("ann")).alias("reviewer"), F.lit("").alias("rejection_reason"),
    )
    lists = table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("s")))).alias("l"))
    doc = F.struct(F.lit(1).alias("schema_version"), F.lit("d").alias("dataset_id"), F.transform("l", lambda x: x["s"]).alias("routes"))
    manifests = lists.select(F.col("o_custkey").alias("manifest_id"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))
    return validators.route_manifest_errors(manifests).select("manifest_id", "index", "message")
