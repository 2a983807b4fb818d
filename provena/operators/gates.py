"""Verdicts as rule tables over summaries: every failed rule is a named row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provena.functions import crypto

# Evidence names the release contract asks for.
ATTACKS = (
    "crop", "dct_attenuation", "denoise", "jpeg", "noise", "overwrite", "pilot_notch", "recompression",
    "rotation", "same_source_collusion", "screen_photo", "screenshot", "sharpen",
)
QUALITY_STRATA = ("high_texture", "low_texture", "photo", "synthetic", "text", "ui")


def _verdict(failed: DataFrame) -> DataFrame:
    """(order, gate) rows to one verdict row; the rule list bounds the collected names."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "gate"))), lambda g: g["gate"])
    return failed.agg(names.alias("failed_gates")).select(
        F.when(F.size("failed_gates") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("verdict"), "failed_gates"
    )


def _failed(summary: DataFrame, rules: list[tuple[Column, Column, Column]]) -> DataFrame:
    """rules: (condition of failure, place, gate name)."""
    entries = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(place.alias("place"), gate.alias("gate"))) for cond, place, gate in rules])
    return summary.select(F.inline(F.array_compact(entries)))


def _at(major: Column | int, minor: int) -> Column:
    head = F.lit(float(major)) if isinstance(major, int) else major.cast("double")
    return F.struct(head.alias("a"), F.lit(minor).alias("b"))


def attack_verdict(summary: DataFrame, min_recall: float = 0.95) -> DataFrame:
    total, rounds = F.col("grouping") == "total", F.col("grouping") == "round"
    number = F.col("key").try_cast("double")
    name = lambda tail: F.concat(F.lit("round_"), F.col("key"), F.lit(tail))
    return _verdict(
        _failed(
            summary,
            [
                (total & (F.col("wrong") > 0), _at(-2, 0), F.lit("wrong_trace")),
                (total & (F.col("false_positive") > 0), _at(-1, 0), F.lit("false_positive")),
                (rounds & (F.col("recall") < min_recall), _at(number, 0), name("_recall")),
                (rounds & (F.col("wrong") > 0), _at(number, 1), name("_wrong_trace")),
                (rounds & (F.col("false_positive") > 0), _at(number, 2), name("_false_positive")),
            ],
        )
    )


def crop_verdict(summary: DataFrame) -> DataFrame:
    total, crop = F.col("grouping") == "total", F.col("grouping") == "crop"
    number = F.col("key").try_cast("double")
    floor = F.when(number <= 0.3, F.lit(0.80)).otherwise(F.lit(0.95))
    return _verdict(
        _failed(
            summary,
            [
                (total & (F.col("wrong") > 0), _at(-3, 0), F.lit("wrong_trace")),
                (total & (F.col("false_positive") > 0), _at(-2, 0), F.lit("false_positive")),
                (total & (F.col("recall") < 0.95), _at(-1, 0), F.lit("overall_recall")),
                (crop & (F.col("recall") < floor), _at(number, 0), F.concat(F.lit("crop_"), F.col("key"), F.lit("_recall"))),
            ],
        )
    )


def negative_verdict(summary: DataFrame) -> DataFrame:
    total = F.col("grouping") == "total"
    raw = F.when(F.col("total") > 0, F.col("false_positive") / F.col("total")).otherwise(F.lit(0.0))
    return _verdict(
        _failed(
            summary,
            [
                (total & (F.col("source_false_positive") > 0), _at(0, 0), F.lit("source_false_positive")),
                (total & (raw >= 0.001), _at(1, 0), F.lit("false_positive_rate")),
            ],
        )
    )


def quality_pass(min_psnr: float = 38.0, min_ssim: float = 0.95) -> Column:
    return (F.col("psnr") >= min_psnr) & (F.col("ssim") >= min_ssim)


def rejected_reasons(configs: DataFrame, min_recall: float = 0.95) -> DataFrame:
    """Ordered reasons why a configuration is rejected (empty = accepted)."""
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("quality_pass"), F.lit("quality_gate")),
            F.when(F.col("wrong") > 0, F.lit("wrong_trace")),
            F.when(F.col("false_positive") > 0, F.lit("false_positive")),
            F.when(F.col("probe_recall") < min_recall, F.lit("probe_recall")),
        )
    )
    return configs.withColumn("rejected_reasons", reasons).withColumn(
        "verdict", F.when(F.size("rejected_reasons") == 0, F.lit("PASS")).otherwise(F.lit("FAIL"))
    )


_MEASURE = "struct<samples:bigint,wrong_traces:bigint>"
_QUALITY = "struct<psnr:double,ssim:double>"
RELEASE_SCHEMA = (
    "struct<git_commit:string,schema_id:string,codec:string,model_versions:map<string,string>,"
    "model_health:map<string,boolean>,manifest_hashes:map<string,array<string>>,random_seed:bigint,"
    "hardware:map<string,string>,raw_artifact_hashes:array<string>,query_plan_ok:boolean,sensitive_log_leaks:bigint,"
    "suites:struct<recall:map<string,double>,attribution:struct<rate:double,wrong_traces:bigint>,"
    "negative:struct<independent_count:bigint,wrong_attributions:bigint>,"
    "scale:struct<same_source_versions:bigint,indexed_lookup:boolean>,"
    f"attacks:map<string,{_MEASURE}>,quality:map<string,{_QUALITY}>,"
    "performance:struct<standard_p95_seconds:double,standard_max_seconds:double,deep_max_seconds:double,"
    "stage_timings:map<string,array<double>>>>>"
)


def release_rules(report: str = "r") -> list[tuple[Column, str]]:
    """(condition that must hold, message) in evaluation order; NULL counts as not met."""
    r = lambda path: F.col(f"{report}.{path}")
    at = lambda path, key: F.try_element_at(r(path), F.lit(key))
    rules: list[tuple[Column, str]] = []
    for name in ("git_commit", "schema_id", "codec"):
        rules.append((r(name).isNotNull(), f"missing {name}"))
    for name in ("model_versions", "model_health", "manifest_hashes"):
        rules.append((F.size(r(name)) > 0, f"missing {name}"))
    rules.append((r("random_seed").isNotNull(), "missing random_seed"))
    for name in ("hardware", "raw_artifact_hashes"):
        rules.append((F.size(r(name)) > 0, f"missing {name}"))
    rules.append((r("suites").isNotNull(), "missing suites"))
    healthy, complete = F.lit(True), F.lit(True)
    for name in ("dinov2", "superpoint", "lightglue"):
        healthy = healthy & F.coalesce(at("model_health", name), F.lit(False))
    for name in ("cpu", "gpu", "ram_bytes"):
        complete = complete & ~F.coalesce(at("hardware", name), F.lit("")).isin("", "0")
    rules += [(healthy, "model_health failed"), (complete, "hardware metadata incomplete")]
    splits = F.array_sort(F.map_keys(r("manifest_hashes"))) == F.array(*map(F.lit, ("blind", "development", "release")))
    filled = F.forall(F.map_values(r("manifest_hashes")), lambda v: F.size(v) > 0)
    flat = F.flatten(F.map_values(r("manifest_hashes")))
    rules += [
        (splits & filled, "manifest_hashes incomplete"),
        (F.size(flat) == F.size(F.array_distinct(flat)), "dataset manifests overlap"),
        (r("query_plan_ok"), "indexed query plan failed"),
        (r("sensitive_log_leaks") == 0, "sensitive log leak"),
        (F.size(r("suites.recall")) > 0, "missing recall"),
    ]
    for name, floor in (("full", 0.99), ("resize", 0.99), ("jpeg", 0.99), ("crop", 0.95)):
        rules.append((at("suites.recall", name) >= floor, f"{name} recall below threshold"))
    rules += [
        (r("suites.attribution").isNotNull(), "missing attribution"),
        (r("suites.attribution.rate") >= 0.95, "final attribution below 95%"),
        (r("suites.attribution.wrong_traces") == 0, "wrong trace detected"),
        (r("suites.negative").isNotNull(), "missing negative"),
        (r("suites.negative.independent_count") >= 3000, "negative gate requires 3000 independent samples"),
        (r("suites.negative.wrong_attributions") == 0, "wrong attribution in negative gate"),
        (r("suites.scale").isNotNull(), "missing scale"),
        (r("suites.scale.same_source_versions") >= 1000, "scale gate requires 1000 same-source versions"),
        (r("suites.scale.indexed_lookup"), "scale lookup must be indexed"),
        (F.size(r("suites.attacks")) > 0, "missing attacks"),
    ]
    present, sampled, clean = F.lit(True), F.lit(True), F.lit(True)
    for name in ATTACKS:
        item = at("suites.attacks", name)
        present = present & item.isNotNull()
        sampled = sampled & F.coalesce(item["samples"] > 0, F.lit(False))
        clean = clean & F.coalesce(item["wrong_traces"] == 0, F.lit(False))
    rules += [
        (present, "required attack evidence missing"),
        (sampled, "required attack samples missing"),
        (clean, "wrong trace in attack gate"),
        (F.size(r("suites.quality")) > 0, "missing quality"),
    ]
    strata = F.lit(True)
    for name in QUALITY_STRATA:
        strata = strata & at("suites.quality", name).isNotNull()
    rules.append((strata, "quality stratum missing"))
    for name in QUALITY_STRATA:
        rules.append((at("suites.quality", name)["psnr"] >= 38, f"{name} PSNR below 38"))
        rules.append((at("suites.quality", name)["ssim"] >= 0.95, f"{name} SSIM below 0.95"))
    rules += [
        (r("suites.performance").isNotNull(), "missing performance"),
        (r("suites.performance.standard_p95_seconds") <= 120, "standard P95 exceeds 120 seconds"),
        (r("suites.performance.standard_max_seconds") <= 300, "standard request exceeds 300 seconds"),
        (r("suites.performance.deep_max_seconds") <= 1000, "deep job exceeds 1000 seconds"),
        (F.size(r("suites.performance.stage_timings")) > 0, "missing stage_timings"),
    ]
    return rules


def release_gate(reports: DataFrame) -> DataFrame:
    """(report_id, report JSON) to verdict and the first failure message; missing evidence fails."""
    parsed = reports.select("report_id", F.from_json("report", RELEASE_SCHEMA).alias("r"))
    first = F.coalesce(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(message)) for cond, message in release_rules()])
    return parsed.select("report_id", first.alias("failure")).withColumn(
        "verdict", F.when(F.col("failure").isNull(), F.lit("PASS")).otherwise(F.lit("FAIL"))
    )


def signed_report_valid(reports: DataFrame, key: bytes, commit: str) -> DataFrame:
    """(report_id, canonical JSON without signature, signature, git_commit): signature and commit checks."""
    good = crypto.report_signature(key, F.col("report")) == F.col("signature")
    problem = F.when(~F.coalesce(good, F.lit(False)), F.lit("release report signature is invalid")).when(
        ~F.coalesce(F.col("git_commit") == commit, F.lit(False)), F.lit("release report is stale")
    )
    return reports.select("report_id", problem.alias("failure"))


def settings_equal(settings: Column, expected: dict[str, str]) -> Column:
    """MAP<STRING, JSON text> equals the expected settings of a stage: same names, none extra.

    Numbers compare by value, texts by case, other values by their JSON text.
    """
    same = F.size(settings) == len(expected)
    for name, wanted in expected.items():
        value = F.try_element_at(settings, F.lit(name))
        if wanted.startswith('"'):
            equal = value == wanted
        else:
            number = value.try_cast("decimal(38,10)")
            equal = F.coalesce(number == F.lit(wanted).try_cast("decimal(38,10)"), value == wanted)
        same = same & F.coalesce(equal, F.lit(False))
    return F.coalesce(same, F.lit(False))


def report_reusable(reports: DataFrame, expected: dict[str, str], benchmark: str, version: str, seed: int, started: Column, now: Column) -> DataFrame:
    """Reusable and fresh flags. reports: report_id, benchmark, algorithm_version, seed, verdict,
    schema_version, generated_at (timestamp), settings (MAP<STRING, STRING> of JSON texts)."""
    head = (
        (F.col("schema_version") == 1)
        & (F.col("benchmark") == benchmark)
        & (F.col("algorithm_version") == version)
        & (F.col("seed") == seed)
        & F.col("verdict").isin("PASS", "FAIL")
    )
    slack = F.expr("INTERVAL 2 SECONDS")
    fresh = (F.col("generated_at") >= started - slack) & (F.col("generated_at") <= now + slack)
    return reports.select(
        "report_id",
        F.coalesce(head & settings_equal(F.col("settings"), expected), F.lit(False)).alias("reusable"),
        F.coalesce(fresh, F.lit(False)).alias("fresh"),
    )
