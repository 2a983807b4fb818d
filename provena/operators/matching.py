"""Equi-joins of the registry: fingerprints, tags, groups, enrichment, integrity and diffs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from provena.functions import text
from provena import schemas
from provena.operators.filters import check_violations
from provena.operators.scale import split_hot_keys
from provena.session import SMALL_TASKS, cut_lineage

MAX_RECALLED_GROUPS = 40


def file_digests(records: DataFrame, order: str | None = None, with_pixels: bool = False) -> DataFrame:
    """Records un-pivoted to one row per stored file (0 = original, 1 = watermarked)."""
    extra = [order] if order else []
    kinds = []
    for position, kind in enumerate(("original", "watermarked")):
        fields = [
            F.lit(position).alias("type_order"),
            F.lit(kind).alias("file_type"),
            F.col(f"{kind}_file_md5").alias("md5"),
            F.col(f"{kind}_file_sha256").alias("sha256"),
        ]
        if with_pixels:
            fields.append(F.col(f"{kind}_image_sha256").alias("image_sha256"))
        kinds.append(F.struct(*fields))
    return records.select("record_id", *extra, *[c for c in ("owner_user_id",) if c in records.columns], F.inline(F.array(*kinds)))


def digest_index(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active records by digest pair, per owner and over all owners: record count and smallest id.

    A digest shared by very many records is one row, so it never multiplies rows of a lookup.
    """
    files = (
        file_digests(records.where(F.col("status") == "active"))
        .select("owner_user_id", "md5", "sha256", "record_id")
        .distinct()
    )
    by_owner = files.groupBy("owner_user_id", "md5", "sha256").agg(
        F.count(F.lit(1)).alias("n_records"), F.min("record_id").alias("first_id")
    )
    return by_owner, by_owner.groupBy("md5", "sha256").agg(F.sum("n_records").alias("n_records"), F.min("first_id").alias("first_id"))


def exact_file_match(queries: DataFrame, records: DataFrame) -> DataFrame:
    """Verdict per query from (md5, sha256) equality with either stored file of an active record; queries carry their scope."""
    return indexed_file_match(queries, *digest_index(records))


def indexed_file_match(queries: DataFrame, by_owner: DataFrame, by_all: DataFrame) -> DataFrame:
    """``exact_file_match`` against a registry that ``digest_index`` has reduced."""
    scoped = queries.where(~F.col("cross_owner")).join(
        by_owner.withColumnRenamed("owner_user_id", "user_id"), ["user_id", "md5", "sha256"], "left"
    )
    crossing = queries.where(F.col("cross_owner")).join(by_all, ["md5", "sha256"], "left")
    hits = scoped.unionByName(crossing.select(*scoped.columns))
    return outcome_columns(hits, "n_records", "first_id", nothing="continue")


def outcome_columns(frame: DataFrame, count: str, record: str, nothing: str = "not_found") -> DataFrame:
    """One hit is a success and shows its record; several are ambiguous; none is ``nothing``."""
    n = F.coalesce(F.col(count), F.lit(0)).cast("bigint")
    outcome = F.when(n == 1, F.lit("success")).when(n > 1, F.lit("ambiguous")).otherwise(F.lit(nothing))
    return frame.select(
        "query_id", n.alias("n_records"), outcome.alias("outcome"), F.when(n == 1, F.col(record)).alias("record_id")
    )


def tiered_fingerprint_match(queries: DataFrame, records: DataFrame) -> DataFrame:
    """First match per query: byte tiers (md5+sha256, or sha256 where no md5 is stored), then pixels.

    Within the byte tiers and within the pixel tier the record order decides, then original before
    watermarked. The registry is reduced to its first row per digest before the joins.
    """
    upper = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
    files = file_digests(records, "position_index", True).select(
        "record_id", "position_index", "type_order", "file_type",
        upper("md5").alias("md5"), upper("sha256").alias("sha256"), upper("image_sha256").alias("image_sha256"),
    )
    first = F.min(F.struct("position_index", "type_order", "record_id", "file_type"))
    has_sha = files.where(F.col("sha256") != "")
    full = has_sha.where(F.col("md5") != "").groupBy("md5", "sha256").agg(first.alias("hit_full"))
    bare = has_sha.where(F.col("md5") == "").groupBy("sha256").agg(first.alias("hit_bare"))
    pixel = files.where(F.col("image_sha256") != "").groupBy("image_sha256").agg(first.alias("hit_pixel"))
    keyed = queries.select("query_id", *[F.upper(F.col(c)).alias(c) for c in ("md5", "sha256", "image_sha256")])
    joined = keyed.join(full, ["md5", "sha256"], "left").join(bare, "sha256", "left").join(pixel, "image_sha256", "left")

    def tagged(hit: str, kind: str) -> Column:
        order = F.struct(F.col(hit)["position_index"], F.col(hit)["type_order"])
        return F.when(
            F.col(hit).isNotNull(),
            F.struct(order.alias("o"), F.col(hit)["record_id"].alias("record_id"), F.col(hit)["file_type"].alias("file_type"), F.lit(kind).alias("hash_type")),
        )

    best = F.coalesce(
        F.least(tagged("hit_full", "file_md5_sha256"), tagged("hit_bare", "file_sha256")), tagged("hit_pixel", "image_pixels")
    )
    return joined.withColumn("b", best).where(F.col("b").isNotNull()).select(
        "query_id", F.col("b.record_id").alias("record_id"), F.col("b.file_type").alias("matched_file_type"), F.col("b.hash_type").alias("matched_hash_type")
    )


def _scope(queries_user: str = "user_id") -> Column:
    return F.col("cross_owner") | (F.col("owner_user_id") == F.col(queries_user))


def match_group_tag(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(source_group_id, auth_tag) of a query to its active record in scope."""
    active = records.where(F.col("status") == "active").select("source_group_id", "auth_tag", "record_id", "owner_user_id")
    return queries.join(active, ["source_group_id", "auth_tag"]).where(_scope())


def records_of_groups(recalled: DataFrame, records: DataFrame) -> DataFrame:
    """Active records in scope of every recalled group; hot groups are split on both sides."""
    active = records.where(F.col("status") == "active").select("source_group_id", "record_id", "owner_user_id")
    return split_hot_keys(active, recalled, ["source_group_id"], "record_id", spread_right="query_id").where(_scope()).select(
        "query_id", "source_group_id", "record_id"
    )


def features_of_groups(wanted: DataFrame, groups: DataFrame, features: DataFrame) -> DataFrame:
    """Features of up to 40 distinct active groups a query; a query over the cap yields one error row."""
    distinct = wanted.select("query_id", "user_id", "cross_owner", "source_group_id").distinct()
    sizes = distinct.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_groups"))
    over = sizes.where(F.col("n_groups") > MAX_RECALLED_GROUPS).select(
        "query_id",
        F.lit(None).cast("string").alias("source_group_id"),
        F.lit(None).cast("string").alias("feature_kind"),
        F.lit("too_many_groups").alias("error"),
    )
    within = distinct.join(sizes.where(F.col("n_groups") <= MAX_RECALLED_GROUPS), "query_id", "left_semi")
    active = groups.where(F.col("status") == "active").select("source_group_id", "owner_user_id")
    rows = (
        within.join(active, "source_group_id").where(_scope())
        .join(features.select("source_group_id", "feature_kind"), "source_group_id")
        .select("query_id", F.col("source_group_id").cast("string"), "feature_kind", F.lit(None).cast("string").alias("error"))
    )
    return rows.unionByName(over)


def record_enrichment(records: DataFrame, groups: DataFrame, media: DataFrame, users: DataFrame) -> DataFrame:
    """Listing row of each record: group, three media objects and the owner's name in one job."""

    def media_as(prefix: str, key: str) -> DataFrame:
        return media.select(F.col("media_id").alias(key), F.col("byte_size").alias(f"{prefix}_byte_size"))

    joined = (
        records.join(groups.select("source_group_id", "original_media_id"), "source_group_id", "left")
        .join(media_as("original", "original_media_id"), "original_media_id", "left")
        .join(media_as("output", "output_media_id"), "output_media_id", "left")
        .join(media_as("thumbnail", "thumbnail_media_id"), "thumbnail_media_id", "left")
        .join(users.select(F.col("user_id").alias("owner_user_id"), "username"), "owner_user_id", "left")
    )
    head, tail = text.evidence_head_tail(F.coalesce(F.col("evidence_uuid"), F.lit("")))
    return joined.select(
        F.col("record_id").alias("id"),
        F.col("original_filename").alias("name"),
        text.byte_size_text(F.col("output_byte_size")).alias("size"),
        F.coalesce(F.nullif(F.trim("username"), F.lit("")), F.col("owner_user_id").cast("string")).alias("user_id"),
        "trace_id",
        head.alias("evidence_uuid_head"),
        tail.alias("evidence_uuid_tail"),
        F.col("original_byte_size"),
        F.col("thumbnail_byte_size"),
    )


def tag_collision(batch: DataFrame, records: DataFrame) -> DataFrame:
    """Batch rows (request_id, source_group_id, auth_tag) with clashes in the registry and the batch."""
    keys = ["source_group_id", "auth_tag"]
    taken = records.where(F.col("status") != "deleted").select(*keys).distinct().withColumn("_taken", F.lit(True))
    repeats = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (
        batch.join(taken, keys, "left").join(repeats, keys, "left")
        .select("request_id", *keys, F.coalesce("_taken", F.lit(False)).alias("in_registry"), (F.col("_n") > 1).alias("in_batch"))
    )


def group_id(owner: Column, digest: Column) -> Column:
    """Deterministic group id of (owner, pixel digest), shaped like a UUID."""
    h = F.sha2(F.concat(F.encode(owner.cast("string"), "UTF-8"), F.lit(bytearray(b":")), digest), 256)
    cut = lambda start, size: F.substring(h, start, size)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def find_or_create_groups(batch: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per (owner, pixel digest, size) of the batch: existing group id, or a new one."""
    keys = ["owner_user_id", "original_image_sha256", "image_width", "image_height"]
    wanted = batch.select(*keys).distinct()
    existing = groups.select(*keys, "source_group_id")
    return wanted.join(existing, keys, "left").select(
        *keys,
        F.coalesce(
            F.col("source_group_id"),
            group_id(
                F.concat_ws("x", "owner_user_id", "image_width", "image_height"), F.col("original_image_sha256")
            ),
        ).alias("source_group_id"),
        F.col("source_group_id").isNull().alias("created"),
    )


def duplicate_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphan_rows(child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]) -> DataFrame:
    """Child rows whose (composite) key is set but has no parent."""
    known = parent.select(*[F.col(p).alias(f"_p_{c}") for p, c in zip(parent_keys, child_keys)]).distinct()
    complete = child
    for key in child_keys:
        complete = complete.where(F.col(key).isNotNull())
    match = [F.col(c) == F.col(f"_p_{c}") for c in child_keys]
    return complete.join(known, match, "left_anti")


def constraint_violations(tables: dict[str, DataFrame], rules: dict[str, schemas.Constraints] | None = None) -> DataFrame:
    """(table, kind, rule, row_key) of everything that breaks the declared rules of the given tables.

    ``check`` and ``foreign`` name the row, ``unique`` the values of the repeated key. Rules on tables, or on child columns, that are not
    given are left out; NULL passes checks and keys with a NULL never clash, as in SQL. All rules are settled here, in tasks of few keys.
    """
    rules = schemas.constraints() if rules is None else rules
    found = []

    def add(rows: DataFrame, table: str, kind: str, rule: Column, key: Column) -> None:
        found.append(rows.select(F.lit(table).alias("table"), F.lit(kind).alias("kind"), rule.alias("rule"), key.cast("string").alias("row_key")))

    for name, frame in tables.items():
        own = rules[name]
        shown_key = F.hex(own.key) if isinstance(frame.schema[own.key].dataType, T.BinaryType) else F.col(own.key)
        if own.checks:
            add(check_violations(frame, own.key, own.checks), name, "check", F.col("constraint"), shown_key)
        for rule, keys in own.unique.items():
            shown = [(F.hex(k) if t == "binary" else F.col(k).cast("string")).alias(k) for k, t in frame.select(*keys).dtypes]
            whole = frame.dropna(subset=list(keys)).select(*shown)
            add(duplicate_keys(whole, keys), name, "unique", F.lit(rule), F.concat_ws("|", *keys))
        for rule, (child_keys, parent, parent_keys) in own.foreign.items():
            if parent in tables and {*child_keys} <= {*frame.columns}:
                add(orphan_rows(frame, child_keys, tables[parent], parent_keys), name, "foreign", F.lit(rule), shown_key)
    return cut_lineage(reduce(DataFrame.unionByName, found), SMALL_TASKS)


def region_tiles(regions: DataFrame, tile_size: int = 128) -> DataFrame:
    """Complete tiles that touch a region; columns image_id, image_width, image_height, left..bottom."""
    size = F.lit(tile_size)
    floor_div = lambda a: F.floor(a / size).cast("int")
    zero = F.lit(0)
    spans = regions.select(
        "image_id",
        F.greatest(zero, floor_div(F.col("left"))).alias("x0"),
        F.least(floor_div(F.col("image_width")) - 1, floor_div(F.col("right") - 1)).alias("x1"),
        F.greatest(zero, floor_div(F.col("top"))).alias("y0"),
        F.least(floor_div(F.col("image_height")) - 1, floor_div(F.col("bottom") - 1)).alias("y1"),
    ).where((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")))
    return (
        spans.distinct()
        .withColumn("tile_x", F.explode(F.sequence("x0", "x1")))
        .withColumn("tile_y", F.explode(F.sequence("y0", "y1")))
        .select("image_id", "tile_x", "tile_y").distinct()
    )


def role_menus(roles: DataFrame, links: DataFrame, known_menus: DataFrame) -> DataFrame:
    """Roles with their known menus in position order; a role without menus keeps an empty list.

    Links are reduced to one row per (role, menu), so a list is never longer than the menu table.
    """
    first = (
        links.join(known_menus.select("menu_key").distinct(), "menu_key", "left_semi")
        .groupBy("role_key", "menu_key").agg(F.min("position_index").alias("position_index"))
        .groupBy("role_key")
        .agg(F.array_sort(F.collect_list(F.struct("position_index", "menu_key"))).alias("_m"))
        .select("role_key", F.transform("_m", lambda m: m["menu_key"]).alias("menus"))
    )
    return roles.join(first, "role_key", "left").withColumn(
        "menus", F.coalesce("menus", F.array().cast("array<string>"))
    )


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are missing, extra or changed between two snapshots with the same columns."""
    values = sorted(c for c in before.columns if c not in keys)

    def packed(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(*keys, F.struct(*values).alias(name), F.lit(True).alias(f"has_{name}"))

    joined = packed(before, "old").join(packed(after, "new"), list(keys), "full_outer")
    change = (
        F.when(F.col("has_new").isNull(), F.lit("missing"))
        .when(F.col("has_old").isNull(), F.lit("extra"))
        .when(~F.col("old").eqNullSafe(F.col("new")), F.lit("changed"))
    )
    return joined.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def checksum_verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest (path, sha256 hex) against files (path, sha256 hex): missing, unexpected, mismatch."""
    wanted = manifest.select("path", F.lower("sha256").alias("expected"))
    found = files.select("path", F.lower("sha256").alias("actual"))
    problem = (
        F.when(F.col("actual").isNull(), F.lit("missing"))
        .when(F.col("expected").isNull(), F.lit("unexpected"))
        .when(F.col("actual") != F.col("expected"), F.lit("mismatch"))
    )
    return wanted.join(found, "path", "full_outer").select("path", problem.alias("problem")).where(F.col("problem").isNotNull())


def packet_lookup(packets: DataFrame, records: DataFrame) -> DataFrame:
    """Decoded packets with the first record of their trace; evidence fields filled when missing."""
    first = records.groupBy("trace_id").agg(
        F.min_by(F.struct("record_id", "evidence_uuid"), F.struct("position_index", "record_id")).alias("r")
    )
    return packets.join(first, "trace_id", "left").select(
        "query_id",
        "trace_id",
        F.col("r.record_id").alias("record_id"),
        text.confidence_packet(F.col("r").isNotNull()).alias("confidence"),
        text.fill_missing(F.col("evidence_uuid"), F.col("r.evidence_uuid")).alias("evidence_uuid"),
    )
