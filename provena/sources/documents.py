"""Legacy JSON documents (images, roles, users, stats) to relational tables, with their gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from provena.operators.matching import duplicate_keys, orphan_rows

# Menu keys and labels in their usual order, and the built-in roles.
MENU_KEYS = ("watermark", "trace", "manage", "role")
SYSTEM_ROLES = ("admin", "operator", "viewer")

ROLES_SCHEMA = "struct<roles:map<string,struct<label:string,menus:array<string>>>>"
USERS_SCHEMA = "struct<users:map<string,struct<password:string,role:string>>>"


def image_rows(documents: DataFrame) -> DataFrame:
    """(document JSON array) to (position_index, id, data)."""
    items = F.from_json("document", "array<string>")
    return documents.select(F.posexplode(items).alias("position_index", "data")).select(
        "position_index", F.coalesce(F.get_json_object("data", "$.id"), F.lit("")).alias("id"), "data"
    )


def normalize_roles(documents: DataFrame, known_menus: tuple[str, ...] = MENU_KEYS) -> dict[str, DataFrame]:
    """Roles, menus and links: keys trimmed, blank and repeated menus dropped, order kept."""
    entries = documents.select(F.explode(F.from_json("document", ROLES_SCHEMA)["roles"]).alias("raw_key", "info"))
    roles = entries.select(
        F.trim("raw_key").alias("role_key"),
        F.coalesce(F.nullif("info.label", F.lit("")), F.trim("raw_key")).alias("label"),
        F.trim("raw_key").isin(*SYSTEM_ROLES).alias("is_system"),
        F.array_distinct(F.filter(F.transform(F.coalesce("info.menus", F.array().cast("array<string>")), lambda m: F.trim(m)), lambda m: m != "")).alias("menus"),
        F.col("info.menus").isNotNull().alias("has_menus"),
    )
    links = roles.select("role_key", F.posexplode("menus").alias("position_index", "menu_key"))
    order = F.array_position(F.array(*map(F.lit, known_menus)), F.col("menu_key"))
    menus = links.select("menu_key").distinct().withColumn("known", order > 0).withColumn(
        "sort_order", F.when(order > 0, order - 1)
    )
    return {"roles": roles.drop("menus"), "role_menus": links, "menus": menus}


def user_rows(documents: DataFrame) -> DataFrame:
    entries = documents.select(F.explode(F.from_json("document", USERS_SCHEMA)["users"]).alias("username", "info"))
    return entries.select("username", F.col("info.password").alias("password_hash"), F.coalesce("info.role", F.lit("")).alias("role_key"))


def snapshot_problems(images: DataFrame, roles: DataFrame, users: DataFrame) -> DataFrame:
    """(problem, key) rows; an empty result means that the snapshot may be loaded."""
    row = lambda name, key: [F.lit(name).alias("problem"), key.cast("string").alias("key")]
    parts = [
        images.where(F.col("id") == "").select(*row("image without id", F.col("position_index"))),
        duplicate_keys(images.where(F.col("id") != ""), ["id"]).select(*row("duplicate image id", F.col("id"))),
        roles.where((F.col("role_key") == "") | ~F.col("has_menus")).select(*row("invalid role", F.col("role_key"))),
        users.where(F.col("username") == "").select(*row("user without name", F.col("username"))),
        duplicate_keys(users.where(F.col("username") != ""), ["username"]).select(*row("duplicate user", F.col("username"))),
        users.where(F.coalesce("password_hash", F.lit("")) == "").select(*row("empty password hash", F.col("username"))),
        orphan_rows(users, ["role_key"], roles, ["role_key"]).select(*row("unknown role", F.col("username"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def normalize_legacy_documents(images: DataFrame, roles: DataFrame, users: DataFrame, root: str | None = None) -> dict[str, DataFrame]:
    """Relational tables and their problems; written as parquet only when there are no problems."""
    role_tables = normalize_roles(roles)
    tables = {"images": image_rows(images), "users": user_rows(users), **role_tables}
    problems = snapshot_problems(tables["images"], tables["roles"], tables["users"])
    if root is not None:
        if not problems.isEmpty():
            raise ValueError("snapshot has problems; see snapshot_problems")
        for name, frame in tables.items():
            frame.write.mode("overwrite").parquet(f"{root}/{name}")
    return {**tables, "problems": problems}
