"""Text, path, time and setting rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted words, labels and patterns.
TRUE_WORDS = ("1", "true", "yes", "on", "启用")
MODE_LABELS = {
    "lsb": "仅空间域",
    "dct": "DCT + 空间域",
    "dwt": "DWT + 空间域",
    "fft": "FFT + 空间域",
    "hybrid": "全部算法",
}
PACKET_MODES = ("lsb", "dct", "dwt", "fft", "hybrid")
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
CANONICAL_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
SHA256_TEXT = r"^[0-9a-fA-F]{64}$"
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")


def _default(value: Column, other: str = "") -> Column:
    return F.coalesce(value, F.lit(other))


def _tenths(number: Column, unit: int) -> Column:
    """number / unit with one decimal, ties to even, in whole-number arithmetic."""
    scaled = number.cast("bigint") * 10
    whole = F.floor(scaled / unit).cast("bigint")
    twice = F.pmod(scaled, F.lit(unit)) * 2
    up = (twice > unit) | ((twice == unit) & (F.pmod(whole, F.lit(2)) == 1))
    tenths = whole + up.cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def byte_size_text(size: Column) -> Column:
    return (
        F.when(size.isNull() | (size < 0), F.lit("-"))
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(_tenths(size, 1024), F.lit(" KB")))
        .otherwise(F.concat(_tenths(size, 1024 * 1024), F.lit(" MB")))
    )


def evidence_head_tail(evidence: Column) -> tuple[Column, Column]:
    """First and last eight characters of the dashed id."""
    return F.substring(evidence, 1, 8), F.right(evidence, F.lit(8))


def evidence_fields_legacy(evidence: Column) -> tuple[Column, Column, Column]:
    """Upper hex without dashes, its first four and last four characters."""
    plain = F.upper(F.replace(evidence, F.lit("-"), F.lit("")))
    return plain, F.substring(plain, 1, 4), F.right(plain, F.lit(4))


def fill_missing(current: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(current, F.lit("")), F.nullif(fallback, F.lit("")), current)


def mask_url_password(url: Column) -> Column:
    return F.regexp_replace(url, r"://([^:/@]+):([^@]+)@", "://$1:****@")


def parse_bool(raw: Column) -> Column:
    return F.lower(_default(raw)).isin(*TRUE_WORDS)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def clamp_text(raw: Column, default: float, low: float, high: float) -> Column:
    """Number from text, or the default, clamped; NaN counts as missing."""
    number = raw.try_cast("double")
    number = F.when(number.isNotNull() & ~F.isnan(number), number).otherwise(F.lit(float(default)))
    return clamp(number, float(low), float(high))


def normalize_mode(raw: Column) -> Column:
    text = _default(raw)
    lower = F.lower(text)
    return (
        F.when(lower.contains("lsb") | text.contains("空间") | text.contains("最快"), F.lit("lsb"))
        .when(text.contains("全部") | lower.contains("hybrid") | text.contains("最强"), F.lit("hybrid"))
        .when(lower.contains("dwt"), F.lit("dwt"))
        .when(lower.contains("fft"), F.lit("fft"))
        .otherwise(F.lit("dct"))
    )


def mode_label(mode: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MODE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, mode), F.lit(MODE_LABELS["dct"]))


def normalize_version(raw: Column) -> Column:
    """1 to 4; anything else is 1."""
    number = raw.try_cast("int")
    return F.when(number.isin(2, 3, 4), number).otherwise(F.lit(1))


def fidelity_to_strength(raw: Column) -> Column:
    return F.lit(1.0) - clamp_text(raw, 0.75, 0.0, 1.0) * 0.72


def is_rfc3339(value: Column) -> Column:
    return F.coalesce(value.rlike(RFC3339) & F.try_to_timestamp(value).isNotNull(), F.lit(False))


def rfc3339_time(value: Column) -> Column:
    return F.when(value.rlike(RFC3339), F.try_to_timestamp(value))


def is_canonical_utc(value: Column) -> Column:
    return F.coalesce(
        value.rlike(CANONICAL_UTC) & F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull(), F.lit(False)
    )


def is_safe_path(path: Column, prefix: str | None = None) -> Column:
    """Relative POSIX path without drive, backslash or parent steps, optionally under a prefix."""
    parts = F.split(path, "/")
    safe = (
        (F.length(path) > 0)
        & ~path.contains("\\")
        & ~path.rlike(r"^[A-Za-z]:")
        & ~path.startswith("/")
        & (path != ".")
        & ~F.array_contains(parts, "..")
    )
    if prefix:
        safe = safe & path.startswith(prefix + "/")
    return F.coalesce(safe, F.lit(False))


def extension(path: Column) -> Column:
    """Lower-case suffix of the file name with its dot, or ''."""
    name = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def has_image_extension(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def normalized_path(path: Column) -> Column:
    """Empty and '.' steps removed, lower case (safe paths hold no '..')."""
    return F.lower(F.array_join(F.array_remove(F.array_remove(F.split(path, "/"), ""), "."), "/"))


def packet_valid(payload: Column) -> Column:
    """Packet JSON: required texts, id of 32 lower hex, evidence of 32 upper hex, known mode."""
    get = lambda name: F.get_json_object(payload, f"$.{name}")
    filled = F.lit(True)
    for name in ("id", "trace_id", "user_id", "mode", "created_at"):
        filled = filled & (F.length(F.trim(get(name))) > 0)
    ok = (
        filled
        & get("id").rlike(r"^[0-9a-f]{32}$")
        & get("evidence_uuid").rlike(r"^[0-9A-F]{32}$")
        & get("mode").isin(*PACKET_MODES)
    )
    return F.coalesce(ok, F.lit(False))


def decode_menus(raw: Column) -> Column:
    """JSON list of texts to ordered distinct non-empty texts; anything else to an empty list."""
    parsed = F.from_json(F.when(F.trim(raw).startswith("["), raw), "array<variant>")
    texts = F.transform(
        F.filter(parsed, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.variant_get(v, "$", "string")
    )
    return F.coalesce(F.array_distinct(F.filter(texts, lambda s: F.length(s) > 0)), F.array().cast("array<string>"))


def visible_text_id(text: Column) -> Column:
    return F.concat(F.lit("VISIBLE-"), F.upper(F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 12)))


def safe_file_id(raw: Column) -> Column:
    """Letters, digits, '_' and '-' only; NULL marks an id with nothing left."""
    return F.nullif(F.regexp_replace(_default(raw), r"[^A-Za-z0-9_-]", ""), F.lit(""))


def feature_index_path(stored: Column, record_id: Column) -> Column:
    """Stored relative path when trustworthy, else the usual place by id; NULL when neither works."""
    raw = F.replace(F.trim(_default(stored)), F.lit("\\"), F.lit("/"))
    bad = raw.startswith("/") | F.exists(F.split(raw, "/"), lambda p: p == "..")
    usual = F.concat(F.lit("feature_index/"), safe_file_id(record_id), F.lit(".npz"))
    return F.when(raw == "", usual).when(~bad, raw)


def display_time(raw: Column) -> Column:
    text = F.trim(_default(raw))
    pattern = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})"
    return (
        F.when(text == "", F.lit("-"))
        .when(text.rlike(pattern), F.concat_ws(" ", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)))
        .otherwise(text)
    )


def percent_text(value: Column) -> Column:
    """One-decimal percent of a share, rounded on the exact binary value with ties up.

    A double below 128 is a whole number of 2^-56 (from 1/16 up), one below 2^17 of 2^-46 (from 64
    up), so scaling is exact and the tenths are whole-number arithmetic.
    """
    percent = value * 100

    def exact(fraction_bits: int) -> Column:
        mask = F.lit(2**fraction_bits - 1)
        scaled = (percent * float(2**fraction_bits)).cast("bigint")
        part = scaled.bitwiseAND(mask) * 10
        tenths = F.shiftright(scaled, fraction_bits) * 10 + F.shiftright(part, fraction_bits)
        tenths = tenths + (part.bitwiseAND(mask) >= 2 ** (fraction_bits - 1)).cast("bigint")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("%"))

    return (
        F.when(value.isNull() | F.isnan(value), F.lit("-"))
        .when((percent >= 0) & (percent < 127), exact(56))
        .when((percent >= 0) & (percent < 2**16), exact(46))
        .otherwise(F.format_string("%.1f%%", percent))
    )


def safe_image_url(raw: Column) -> Column:
    url = _default(raw)
    return F.when(url.rlike(r"^(?i)(https?://|/(?!/))"), url).otherwise(F.lit(""))


def daily_key(key: Column, when: Column) -> Column:
    return F.concat(key, F.lit(":"), F.date_format(when, "yyyy-MM-dd"))


def rate_bucket(epoch: Column, window: int = 300) -> Column:
    return epoch - F.pmod(epoch, F.lit(window))


def confidence_v4(bit_errors: Column) -> Column:
    return F.least(F.lit(99), F.greatest(F.lit(80), F.lit(99) - bit_errors * 4))


def confidence_aligned(bit_errors: Column) -> Column:
    return F.least(F.lit(99), F.greatest(F.lit(80), F.lit(99) - bit_errors * 6))


def confidence_dots(votes: Column) -> Column:
    return F.least(F.lit(96), F.greatest(F.lit(76), F.lit(72) + votes * 2)).cast("int")


def confidence_small_crop(votes: Column) -> Column:
    return F.least(F.lit(96.0), F.greatest(F.lit(78.0), F.lit(72.0) + votes / 1200.0)).cast("int")


def confidence_residual(residual: Column) -> Column:
    return F.least(F.lit(96), F.greatest(F.lit(75), (F.lit(75.0) + residual * 25.0).cast("int")))


def confidence_packet(has_record: Column) -> Column:
    return F.when(has_record, F.lit(98)).otherwise(F.lit(92))
