"""Document validators: every broken rule of a manifest or report is a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from provena.functions import text
from provena.operators.scale import pinned
from provena.session import OPTIMISED_METHODS, cut_lineage

# Fixed values of the two manifests and the report contract.
NEGATIVE_CATEGORIES = ("photo", "illustration", "ui", "low_texture", "high_texture", "similar_composition")
STATUSES = ("pending_collection", "collected")
ROUTES = ("wechat", "browser", "target_platform")
ROUTE_FIELDS = (
    "source_id", "route", "attempt", "sent_at", "received_at", "source_relative_path", "output_relative_path",
    "source_sha256", "received_sha256", "status", "operator", "device", "software", "software_version",
    "account_channel", "notes", "reviewer", "rejection_reason",
)
ROUTE_TEXTS = ("operator", "device", "software", "software_version", "account_channel", "notes", "reviewer", "rejection_reason")
REPORT_FIELDS = ("metadata", "summary", "cases", "settings", "verdict", "failed_gates")
METADATA_TEXTS = ("benchmark", "algorithm_version", "generated_at", "python_version", "platform")


# Folders that collected files must lie under; pass others where a dataset keeps them elsewhere.
NEGATIVE_PREFIX = "samples/negative"
SOURCE_PREFIX = "samples/real-platform/source"
RECEIVED_PREFIX = "samples/real-platform/received"


class Item:
    """Typed access to one JSON object held as VARIANT."""

    def __init__(self, column: str = "item", pinned_fields: tuple[str, ...] = ()):
        self.column = F.col(column)
        self.pinned_fields = pinned_fields

    def pin(self, frame: DataFrame) -> DataFrame:
        """Read kind and text of the named fields once a row; the rules then use plain columns."""
        # One pass over the object takes all fields; a path a field would search its keys again for each. NULL where it is none.
        shape = ", ".join(f"`{name}`: variant" for name in self.pinned_fields)
        frame = pinned(frame, item__fields=F.try_variant_get(self.column, "$", f"struct<{shape}>"))
        columns = {"item__object": F.col("item__fields").isNotNull()}
        for name in self.pinned_fields:
            field = F.col("item__fields")[name]
            columns[f"{name}__kind"] = F.schema_of_variant(field)
            columns[f"{name}__text"] = F.try_variant_get(field, "$", "string")
        return frame.withColumns(columns).drop("item__fields")

    def kind(self, name: str) -> Column:
        """Schema name of the field; NULL when the field is absent, VOID for JSON null."""
        if name in self.pinned_fields:
            return F.col(f"{name}__kind")
        return F.schema_of_variant(F.try_variant_get(self.column, f"$.{name}", "variant"))

    def has(self, name: str) -> Column:
        return self.kind(name).isNotNull()

    def text(self, name: str) -> Column:
        value = F.col(f"{name}__text") if name in self.pinned_fields else F.try_variant_get(self.column, f"$.{name}", "string")
        return F.when(self.kind(name) == "STRING", value)

    def integer(self, name: str) -> Column:
        value = F.col(f"{name}__text").try_cast("bigint") if name in self.pinned_fields else F.try_variant_get(self.column, f"$.{name}", "bigint")
        return F.when(self.kind(name) == "BIGINT", value)

    def is_null(self, name: str) -> Column:
        return ~self.has(name) | (self.kind(name) == "VOID")

    def filled(self, name: str) -> Column:
        return F.coalesce(F.length(self.text(name)) > 0, F.lit(False))


def _of_objects(rules: list[tuple[Column, Column | str]]) -> list[tuple[Column, Column | str]]:
    """A pinned item that is not an object breaks one rule; the others hold for objects only."""
    is_object = F.col("item__object")
    return [(~is_object, "must be an object"), *[(is_object & broken, message) for broken, message in rules]]


def _quoted(value: Column) -> Column:
    """A text between quotes: single ones, or double ones if it holds single quotes only."""
    plain = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


# Rules that are worked out in one step: compiled code of too many of them at once is too long to be optimised.
_RULES_A_STEP = 6


def _places(rules: dict[int, Column]) -> Column:
    """Places of the broken rules, as numbers and without a lambda, for which Spark would interpret all rules row by row."""
    return F.array_remove(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(place)).otherwise(F.lit(-1)) for place, broken in rules.items()]), -1)


def _with_broken(frame: DataFrame, rules: dict[int, Column], name: str = "_broken") -> DataFrame:
    """Places of the broken rules beside each row."""
    columns, places = frame.columns, list(rules)
    steps = {f"_r{i}": _places({place: rules[place] for place in places[i : i + _RULES_A_STEP]}) for i in range(0, len(places), _RULES_A_STEP)}
    for step, found in steps.items():
        frame = pinned(frame, **{step: found})
    return frame.select(*columns, F.concat(*steps).alias(name))


def _messages(frame: DataFrame, keys: list[str], messages: list[Column | str], broken: Column) -> DataFrame:
    """Broken rules as rows; messages are made for these alone."""
    found = frame.select("*", F.explode(broken).alias("rule"))
    fixed = F.array(*[F.lit(m if isinstance(m, str) else None).cast("string") for m in messages])
    message = F.element_at(fixed, F.col("rule") + 1)
    for place, made in enumerate(messages):
        if not isinstance(made, str):
            message = F.when(F.col("rule") == place, made).otherwise(message)
    return found.select(*keys, "rule", message.alias("message"))


def _rows(frame: DataFrame, keys: list[str], rules: list[tuple[Column, Column | str]]) -> DataFrame:
    """Broken rules as rows; rules are (broken, message)."""
    marked = _with_broken(frame, {place: broken for place, (broken, _) in enumerate(rules)})
    return _messages(marked, keys, [message for _, message in rules], F.col("_broken"))


def explode_items(manifests: DataFrame, field: str) -> DataFrame:
    """(manifest_id, document JSON) to (manifest_id, index, item VARIANT) with the array index kept."""
    parsed = manifests.select("manifest_id", F.try_parse_json("document").alias("doc"))
    items = F.try_variant_get("doc", f"$.{field}", "array<variant>")
    return parsed.select("manifest_id", F.posexplode(items).alias("index", "item"))


def _headed(manifests: DataFrame, field: str) -> DataFrame:
    """(manifest_id, head): the header fields and the list of items in one pass, without the schema of all that it holds; NULL if no object."""
    shape = f"struct<schema_version: variant, dataset_id: variant, `{field}`: array<variant>>"
    return pinned(manifests.select("manifest_id", F.try_parse_json("document").alias("doc")), head=F.try_variant_get("doc", "$", shape)).drop("doc")


def _header_rules(field: str) -> list[tuple[Column, Column | str]]:
    is_object, version, name = F.col("head").isNotNull(), F.col("head.schema_version"), F.col("head.dataset_id")
    first = F.when(F.schema_of_variant(version) == "BIGINT", F.try_variant_get(version, "$", "bigint") == 1)
    named = F.when(F.schema_of_variant(name) == "STRING", F.length(F.try_variant_get(name, "$", "string")) > 0)
    return [
        (~is_object, "manifest must be an object"),
        (is_object & ~F.coalesce(first, F.lit(False)), "schema_version must equal 1"),
        (is_object & ~F.coalesce(named, F.lit(False)), "dataset_id must be a nonempty string"),
        (is_object & F.col("head")[field].isNull(), f"{field} must be a list"),
    ]


def header_errors(manifests: DataFrame, field: str) -> DataFrame:
    return _rows(_headed(manifests, field), ["manifest_id"], _header_rules(field))


def _repeats(items: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Items with a flag for each key: whether it appeared at an earlier index of the manifest; a NULL key repeats nothing.

    The least index of a key is taken over narrow rows, where those without a key stand alone; the few that repeat
    then join the items once.
    """
    narrow = items.select("manifest_id", "index", *[key.alias(name) for name, key in keys.items()])
    for name in keys:
        alone = F.when(F.col(name).isNull(), F.col("index"))
        first = F.min("index").over(Window.partitionBy("manifest_id", name, alone))
        narrow = narrow.withColumn(name, F.col(name).isNotNull() & (F.col("index") > first))
    marked = narrow.where(reduce(Column.__or__, map(F.col, keys)))
    return items.join(marked, ["manifest_id", "index"], "left")


def _with_files(items: DataFrame, path: Column, files: DataFrame | None, prefix: str) -> DataFrame:
    """Left join of file evidence (path, byte_size, sha256, format) under a column prefix."""
    names = ("byte_size", "sha256", "format")
    if files is None:
        types = ("bigint", "string", "string")
        return items.select("*", *[F.lit(None).cast(t).alias(f"{prefix}{n}") for n, t in zip(names, types)])
    renamed = files.select(F.col("path").alias(f"{prefix}path"), *[F.col(n).alias(f"{prefix}{n}") for n in names])
    return items.join(renamed, path == F.col(f"{prefix}path"), "left").drop(f"{prefix}path")


def _file_rules(checked: Column, path_field: str, hash_field: str, expected: Column, extension: Column, prefix: str, noun: str, artifact: str = "") -> list:
    missing = F.col(f"{prefix}byte_size").isNull()
    size, found, form = F.col(f"{prefix}byte_size"), F.col(f"{prefix}sha256"), F.col(f"{prefix}format")
    formats = F.create_map(
        *[F.lit(v) for pair in {".png": "PNG", ".jpg": "JPEG", ".jpeg": "JPEG", ".webp": "WEBP", ".bmp": "BMP", ".tif": "TIFF", ".tiff": "TIFF"}.items() for v in pair]
    )
    there = checked & ~missing & (size > 0)
    return [
        (checked & missing, f"{path_field} does not exist for collected {noun}"),
        (checked & (size == 0), f"{path_field} is empty for collected {noun}"),
        (there & expected.rlike(text.SHA256_TEXT) & (F.lower(found) != F.lower(expected)), f"{hash_field} does not match {artifact}file bytes"),
        (there & form.isNull(), f"{path_field} is not a decodable image"),
        (there & form.isNotNull() & (form != F.try_element_at(formats, extension)), F.concat(F.lit(f"{path_field} decoded format "), form, F.lit(" does not match suffix "), extension)),
    ]


def negative_manifest_errors(
    manifests: DataFrame, expected_slots: int, files: DataFrame | None = None, prefix: str = NEGATIVE_PREFIX
) -> DataFrame:
    """(manifest_id, index, rule, message); index -1 is the manifest itself.

    ``files`` is the file evidence table of the media manifest (path, byte_size, sha256, format);
    without it the file rules are not evaluated.
    """
    doc = Item(pinned_fields=("id", "category", "relative_path", "status", "sha256"))
    head_doc = Item()
    items = cut_lineage(doc.pin(explode_items(manifests, "samples")))
    sizes = items.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("n"))
    top = manifests.select("manifest_id", F.try_parse_json("document").alias("item")).join(sizes, "manifest_id", "left")
    slot_rules = [
        (head_doc.integer("target_slots").isNull(), "target_slots must be an integer"),
        (head_doc.integer("target_slots") != expected_slots, f"target_slots must equal expected_slots ({expected_slots})"),
        (F.coalesce("n", F.lit(0)) != expected_slots, f"samples length must equal expected_slots ({expected_slots})"),
    ]
    head = header_errors(manifests, "samples").unionByName(
        _rows(top, ["manifest_id"], slot_rules).withColumn("rule", F.col("rule") + 10)
    )
    path = doc.text("relative_path")
    safe = text.is_safe_path(path, prefix)
    status = doc.text("status")
    marked = _repeats(items, {"dup_id": F.when(doc.filled("id"), doc.text("id")), "dup_path": F.when(safe, text.normalized_path(path))})
    marked = _with_files(marked, path, files, "f_")
    good_ext = text.has_image_extension(path)
    rules = [
        (~doc.filled("id"), "id must be a nonempty string"),
        (F.col("dup_id"), F.concat(F.lit("id duplicates '"), doc.text("id"), F.lit("'"))),
        (~F.coalesce(doc.text("category").isin(*NEGATIVE_CATEGORIES), F.lit(False)), "category must be one of: " + ", ".join(NEGATIVE_CATEGORIES)),
        (~doc.has("sha256"), "sha256 is required"),
        (~safe, f"relative_path must be a safe POSIX path under {prefix}"),
        (F.col("dup_path"), F.concat(F.lit("relative_path duplicates normalized path '"), path, F.lit("'"))),
        (safe & ~good_ext, "relative_path must use a supported image extension"),
        (~F.coalesce(status.isin(*STATUSES), F.lit(False)), "status must be one of: " + ", ".join(STATUSES)),
        ((status == "pending_collection") & ~doc.is_null("sha256"), "sha256 must be null for pending sample"),
        (
            (status == "collected") & doc.has("sha256") & ~F.coalesce(doc.text("sha256").rlike(text.SHA256_TEXT), F.lit(False)),
            "sha256 must be 64 hexadecimal characters for collected sample",
        ),
    ]
    if files is not None:
        rules += _file_rules((status == "collected") & safe & good_ext, "relative_path", "sha256", doc.text("sha256"), text.extension(path), "f_", "sample")
    body = _rows(marked, ["manifest_id", "index"], _of_objects(rules))
    return head.select("manifest_id", F.lit(-1).alias("index"), "rule", "message").unionByName(body)


def route_manifest_errors(
    manifests: DataFrame, files: DataFrame | None = None, source_prefix: str = SOURCE_PREFIX, received_prefix: str = RECEIVED_PREFIX
) -> DataFrame:
    """(manifest_id, index, rule, message) for platform route manifests."""
    doc = Item(pinned_fields=ROUTE_FIELDS)
    status, attempt = doc.text("status"), doc.integer("attempt")
    name = lambda p: F.substring_index(p, "/", -1)
    suffix = lambda p: F.regexp_extract(name(p), r"^.+(\.[^.]+)$", 1)
    source, output = doc.text("source_relative_path"), doc.text("output_relative_path")
    good_route = F.coalesce(doc.text("route").isin(*ROUTES), F.lit(False))
    good_attempt = F.coalesce(attempt > 0, F.lit(False))
    stem = F.concat(doc.text("source_id"), F.lit("--"), doc.text("route"), F.lit("--attempt-"), F.when(attempt < 1000, F.lpad(attempt.cast("string"), 3, "0")).otherwise(attempt.cast("string")))
    evidence = ~doc.is_null("sent_at") | ~doc.is_null("received_at") | ~doc.is_null("received_sha256")
    for f in ("operator", "device", "software", "software_version", "account_channel", "reviewer"):
        evidence = evidence | doc.filled(f)
    # What several rules ask is worked out once an item.
    facts = {
        "source_id": doc.text("source_id"), "route": doc.text("route"), "attempt": attempt, "source": source, "output": output,
        "safe_source": text.is_safe_path(source, source_prefix), "safe_output": text.is_safe_path(output, received_prefix),
        "image_source": text.has_image_extension(source), "image_output": text.has_image_extension(output),
        "name_source": name(source), "name_output": name(output), "suffix_source": suffix(source), "suffix_output": suffix(output),
        "good_route": good_route, "good_attempt": good_attempt, "keyed": doc.filled("source_id") & good_route & good_attempt, "stem": stem,
        "normal_output": text.normalized_path(output), "sent": text.rfc3339_time(doc.text("sent_at")), "received": text.rfc3339_time(doc.text("received_at")),
        "evidence": evidence,
    }
    fact = lambda k: F.col(f"fact_{k}")
    safe_source, safe_output, good_route, good_attempt, keyed, stem, sent, received = map(fact, ("safe_source", "safe_output", "good_route", "good_attempt", "keyed", "stem", "sent", "received"))
    source_id, route, attempt, source, output = map(fact, ("source_id", "route", "attempt", "source", "output"))
    dup_attempt, dup_path = F.col("dup_attempt"), F.col("dup_path")
    pending, collected = status == "pending_collection", status == "collected"

    rules = [(~doc.has(f), f"{f} is required") for f in ROUTE_FIELDS]
    rules += [
        (~doc.filled("source_id"), "source_id must be a nonempty string"),
        (~good_route, "route must be one of: " + ", ".join(ROUTES)),
        (~good_attempt, "attempt must be a positive integer"),
        (dup_attempt, F.concat(F.lit("duplicates source_id/route/attempt ("), _quoted(source_id), F.lit(", "), _quoted(route), F.lit(", "), attempt.cast("string"), F.lit(")"))),
    ]
    rules += [(doc.has(f) & doc.text(f).isNull(), f"{f} must be a string") for f in ROUTE_TEXTS]
    for f in ("sent_at", "received_at"):
        rules.append((pending & ~doc.is_null(f) & ~text.is_rfc3339(doc.text(f)), f"{f} must be null or an RFC3339 timestamp"))
    for f in ("source_sha256", "received_sha256"):
        ok = F.coalesce(doc.text(f).rlike(text.SHA256_TEXT), F.lit(False))
        rules.append((pending & ~doc.is_null(f) & ~ok, f"{f} must be null or 64 hexadecimal characters"))
        rules.append((collected & doc.has(f) & ~ok, f"{f} must be 64 hexadecimal characters for collected route"))
    rules += [
        (collected & doc.has("sent_at") & sent.isNull(), "sent_at must be a nonempty RFC3339 timestamp for collected route"),
        (collected & doc.has("received_at") & received.isNull(), "received_at must be a nonempty RFC3339 timestamp for collected route"),
        (collected & (received < sent), "received_at must be at or after sent_at for collected route"),
    ]
    for f in ("operator", "device", "software", "software_version", "account_channel", "notes", "reviewer"):
        rules.append((collected & doc.has(f) & ~doc.filled(f), f"{f} must be nonempty for collected route"))
    rules += [
        (collected & doc.filled("reviewer") & (doc.text("reviewer") == doc.text("operator")), "reviewer must differ from operator for collected route"),
        (collected & ~F.coalesce(doc.text("rejection_reason") == "", F.lit(False)), "rejection_reason must be empty for collected route"),
        (~safe_source, f"source_relative_path must be a safe POSIX path under {source_prefix}"),
        (safe_source & ~fact("image_source"), "source_relative_path must use a supported image extension"),
        (safe_source & doc.filled("source_id") & (fact("name_source") != F.concat(source_id, fact("suffix_source"))),
         F.concat(F.lit("source_relative_path basename must equal '"), source_id, F.lit(".<image-ext>'"))),
        (~safe_output, f"output_relative_path must be a safe POSIX path under {received_prefix}"),
        (safe_output & ~fact("image_output"), "output_relative_path must use a supported image extension"),
        (safe_output & keyed & (fact("name_output") != F.concat(stem, fact("suffix_output"))),
         F.concat(F.lit("output_relative_path basename must equal '"), stem, F.lit(".<image-ext>'"))),
        (dup_path, F.concat(F.lit("output_relative_path duplicates normalized path '"), output, F.lit("'"))),
    ]
    evidence = fact("evidence") if files is None else fact("evidence") | F.col("o_byte_size").isNotNull()
    evidence_rules = [
        (pending & evidence & ~doc.filled("rejection_reason"), "rejection_reason must be nonempty when pending route contains evidence"),
        (pending & evidence & ~doc.filled("notes"), "notes must be nonempty when pending route contains evidence"),
        (pending & ~evidence & doc.filled("rejection_reason") & ~doc.filled("notes"), "notes must be nonempty when rejection_reason is nonempty"),
    ]
    rules += [*evidence_rules, (~F.coalesce(status.isin(*STATUSES), F.lit(False)), "status must be one of: " + ", ".join(STATUSES))]
    file_rules = []
    if files is not None:
        for path, safe, field, digest, prefix, artifact in (
            (source, safe_source & fact("image_source"), "source_relative_path", "source_sha256", "s_", "source "),
            (output, safe_output & fact("image_output"), "output_relative_path", "received_sha256", "o_", "output "),
        ):
            file_rules += _file_rules(collected & safe, field, digest, doc.text(digest), text.extension(path), prefix, "route", artifact)
    rules += file_rules
    # Rules on an item alone are settled where it is parsed; repeats and file evidence come from other rows.
    by_others = {id(broken) for broken in (dup_attempt, dup_path, *[broken for broken, _ in (*evidence_rules, *file_rules) if files is not None])}
    late = {place for place, (broken, _) in enumerate(rules, 1) if id(broken) in by_others}
    rules = _of_objects(rules)
    messages = [message for _, message in rules]
    own, rest = ({place: broken for place, (broken, _) in enumerate(rules) if (place in late) == other} for other in (False, True))

    head_rules = _header_rules("routes")
    parsed = _with_broken(_headed(manifests, "routes"), {place: broken for place, (broken, _) in enumerate(head_rules)}, "_head")
    # A manifest without items keeps one row, whose index is NULL.
    items = parsed.select("manifest_id", "_head", F.posexplode_outer("head.routes").alias("index", "item"))
    items = doc.pin(items).drop("item").withColumns({f"fact_{k}": v for k, v in facts.items()}).withColumn("_broken", _places(own))
    # Parsed once and written, with what is still asked: heads, repeats and coverage read it again.
    asked = ["manifest_id", "index", "_head", "_broken", "item__object", *[f"fact_{k}" for k in ("source_id", "route", "attempt", "output", "stem", "keyed", "safe_output", "normal_output")]]
    items = cut_lineage(items if files is not None else items.select(asked), OPTIMISED_METHODS)

    tops = items.where(F.coalesce("index", F.lit(0)) == 0)
    items = items.where(F.col("index").isNotNull())
    present = items.select("manifest_id", route.alias("route")).distinct()
    wanted = tops.select("manifest_id", F.explode(F.array(*map(F.lit, ROUTES))).alias("route"))
    absent = wanted.join(present, ["manifest_id", "route"], "left_anti").select(
        "manifest_id", F.lit(10).alias("rule"), F.concat(F.lit("routes must include route '"), "route", F.lit("'")).alias("message")
    )
    head = _messages(tops, ["manifest_id"], [message for _, message in head_rules], F.col("_head")).unionByName(absent)

    attempt_key = F.when(keyed, F.concat_ws("\u0001", source_id, route, attempt.cast("string")))
    marked = _repeats(items, {"dup_attempt": attempt_key, "dup_path": F.when(safe_output, fact("normal_output"))})
    if files is not None:
        marked = _with_files(_with_files(marked, source, files, "s_"), output, files, "o_")
    body = _messages(_with_broken(marked, rest, "_late"), ["manifest_id", "index"], messages, F.concat("_broken", "_late"))
    return head.select("manifest_id", F.lit(-1).alias("index"), "rule", "message").unionByName(body)


def report_errors(reports: DataFrame, allowed_configuration: tuple[str, ...]) -> DataFrame:
    """(report_id, rule, message) for benchmark reports held as JSON text."""
    doc = Item()
    parsed = reports.select("report_id", F.try_parse_json("report").alias("item"))
    shape = F.schema_of_variant("item")
    is_object = F.coalesce(shape.startswith("OBJECT"), F.lit(False))
    meta = lambda f: f"metadata.{f}"
    with_meta = is_object & F.coalesce(doc.kind("metadata").startswith("OBJECT"), F.lit(False))
    rules: list = [(~is_object, "report must be an object")]
    rules += [(is_object & ~doc.has(f), f"missing {f}") for f in REPORT_FIELDS]
    rules.append((is_object & doc.has("metadata") & ~with_meta, "metadata must be an object"))
    for f in ("schema_version", *METADATA_TEXTS, "seed", "configuration"):
        rules.append((with_meta & ~doc.has(meta(f)), f"missing metadata.{f}"))
    has = lambda f: with_meta & doc.has(meta(f))
    rules.append((has("schema_version") & ~F.coalesce(doc.integer(meta("schema_version")) == 1, F.lit(False)), "invalid schema_version"))
    for f in METADATA_TEXTS:
        filled = F.coalesce(F.length(F.trim(doc.text(meta(f)))) > 0, F.lit(False))
        rules.append((has(f) & ~filled, f"metadata.{f} must be a nonempty string"))
        if f == "generated_at":
            rules.append((has(f) & filled & ~text.is_canonical_utc(doc.text(meta(f))), "metadata.generated_at must be a canonical UTC timestamp"))
    rules.append((has("seed") & doc.integer(meta("seed")).isNull(), "metadata.seed must be an integer"))
    rules.append((has("configuration") & ~F.coalesce(doc.kind(meta("configuration")).startswith("OBJECT"), F.lit(False)), "metadata.configuration must be an object"))
    for f, kind, noun in (("summary", "OBJECT", "an object"), ("cases", "ARRAY", "a list"), ("settings", "OBJECT", "an object")):
        rules.append((is_object & doc.has(f) & ~F.coalesce(doc.kind(f).startswith(kind), F.lit(False)), f"{f} must be {noun}"))
    verdict = doc.text("verdict")
    good_verdict = F.coalesce(verdict.isin("PASS", "FAIL"), F.lit(False))
    gates = F.try_variant_get("item", "$.failed_gates", "array<variant>")
    good_gates = F.coalesce(
        doc.kind("failed_gates").startswith("ARRAY") & F.forall(gates, lambda g: F.schema_of_variant(g) == "STRING"), F.lit(False)
    )
    rules += [
        (is_object & doc.has("verdict") & ~good_verdict, "verdict must be PASS or FAIL"),
        (is_object & doc.has("failed_gates") & ~good_gates, "failed_gates must be a list of strings"),
        (good_verdict & good_gates & (verdict == "PASS") & (F.size(gates) > 0), "PASS verdict requires no failed gates"),
        (good_verdict & good_gates & (verdict == "FAIL") & (F.size(gates) == 0), "FAIL verdict requires at least one failed gate"),
    ]
    fixed = _rows(parsed, ["report_id"], rules)
    entries = parsed.select("report_id", F.explode(F.try_variant_get("item", "$.metadata.configuration", "map<string,variant>")).alias("name", "value"))
    extra = entries.select(
        "report_id",
        F.inline(
            F.array_compact(
                F.array(
                    F.when(~F.col("name").isin(*allowed_configuration), F.struct(F.lit(100).alias("rule"), F.concat(F.lit("metadata.configuration contains unknown key '"), "name", F.lit("'")).alias("message"))),
                    F.when(F.schema_of_variant("value") != "STRING", F.struct(F.lit(101).alias("rule"), F.concat(F.lit("metadata.configuration."), "name", F.lit(" must be a string")).alias("message"))),
                )
            )
        ),
    )
    return fixed.unionByName(extra)
