"""Writers: generation batches, exports, reports, upserts, back-fills and deletes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from provena import schemas
from provena.operators.listing import keep_latest
from provena.session import cut_lineage
from provena.sources import folders

LOG = "_log"
# Header of the listing export.
CSV_HEADER = ("文件名", "用户", "Trace ID", "水印版本", "嵌入时间", "状态", "置信度", "原图", "水印图")


# --- commit log ----------------------------------------------------------------------------------
#
# A registry folder holds, for each table, base files, appended batches and compacted versions. Commit n is the file n of
# the log, which only one writer can create: {"kind": "batch", "batch_id", "tables"} makes a batch count, and
# {"kind": "compact", "upto", "tables"} says that version ``upto`` of a table stands for its base and all commits so far.


def _entry(number: int) -> str:
    return f"{number:020d}"


def commits(spark: SparkSession, root: str) -> list[dict]:
    """Entries of the log in order, each with its number."""
    found = [n for n in folders.listed(spark, f"{root}/{LOG}") if n.isdigit()]
    if not found:
        return []
    lines = spark.read.text([f"{root}/{LOG}/{n}" for n in found]).select("value", F.col("_metadata.file_name").alias("name")).collect()
    return sorted(({**json.loads(r.value), "number": int(r.name)} for r in lines), key=lambda e: e["number"])


def _folder(root: str, table: str, batch_id: str) -> str:
    return f"{root}/{table}/batches/batch_id={batch_id}"


def _paths(spark: SparkSession, root: str, table: str, log: list[dict], after: int | None = None) -> dict[str, str]:
    """Folders that hold the rows of a table, by the name of the part; with ``after`` only later batches."""
    batches = [e for e in log if e["kind"] == "batch" and table in e["tables"]]
    if after is not None:
        return {e["batch_id"]: _folder(root, table, e["batch_id"]) for e in batches if e["number"] > after}
    versions = [e["upto"] for e in log if e["kind"] == "compact" and table in e["tables"]]
    first = {}
    if versions:
        first[f"compact-{max(versions)}"] = f"{root}/{table}/compact/version={max(versions)}"
        batches = [e for e in batches if e["number"] > max(versions)]
    elif folders.exists(spark, f"{root}/{table}/base"):
        first["base"] = f"{root}/{table}/base"
    return first | {e["batch_id"]: _folder(root, table, e["batch_id"]) for e in batches}


def _read(spark: SparkSession, table: str, paths: list[str]) -> DataFrame:
    schema = schemas.table_schema(table)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of one table as of the last commit."""
    return _read(spark, table, list(_paths(spark, root, table, commits(spark, root)).values()))


def committed_parts(spark: SparkSession, root: str, table: str) -> dict[str, DataFrame]:
    """The same rows by part: those of the base and of each batch, as long as all of their files are there."""
    log = commits(spark, root)
    whole = _paths(spark, root, table, [e for e in log if e["kind"] == "batch"])
    if not all(folders.exists(spark, f"{p}/_SUCCESS") for name, p in whole.items() if name != "base"):
        whole = _paths(spark, root, table, log)
    return {name: _read(spark, table, [path]) for name, path in whole.items()}


def compact(spark: SparkSession, root: str, tables: list[str] | None = None) -> int | None:
    """Rewrite what is committed as one version a table; returns the number that it reaches, None without commits.

    Batches that others commit meanwhile stay beside the version, and readers see one state or the other.
    """
    log = commits(spark, root)
    if not log:
        return None
    upto = log[-1]["number"]
    names = tables or sorted({t for e in log for t in e["tables"]})
    for name in names:
        rows = _read(spark, name, list(_paths(spark, root, name, log).values()))
        rows.write.mode("overwrite").parquet(f"{root}/{name}/compact/version={upto}")
    number = upto + 1
    while not folders.create(spark, f"{root}/{LOG}/{_entry(number)}", json.dumps({"kind": "compact", "upto": upto, "tables": names})):
        number += 1
    return upto


def remove_compacted(spark: SparkSession, root: str) -> None:
    """Delete batches and versions that the last but one compaction had taken in; readers of the last one need none."""
    log = commits(spark, root)
    versions = [e for e in log if e["kind"] == "compact"]
    if len(versions) < 2:
        return
    old = versions[-2]
    for table in old["tables"]:
        gone = [_folder(root, table, e["batch_id"]) for e in log if e["kind"] == "batch" and e["number"] <= old["upto"]]
        gone += [f"{root}/{table}/compact/version={e['upto']}" for e in versions[:-2] if e["upto"] != old["upto"]]
        folders.remove(spark, *gone)


IDENTITIES = {"owner_trace": ["owner_user_id", "trace_id"], "group_tag": ["source_group_id", "auth_tag"]}


def split_collisions(batch: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected rows with a reason) under the two identity rules of a record.

    The same as adding record by record in the order of their ids: what clashes with the registry or with a row that
    went in is rejected, and blocks nobody itself. Rows with a null in an identity don't clash by it.

    Works in rounds: a row that is the least undecided one of all its identities goes in, and the others of those
    identities are out. Every round decides the least undecided row, and most rows need one round.
    """
    key = {name: F.when(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0, F.struct(*columns)) for name, columns in IDENTITIES.items()}
    keyed = cut_lineage(batch.select("record_id", *[expression.alias(name) for name, expression in key.items()]))
    taken = {name: records.select(expression.alias(name)).where(F.col(name).isNotNull()).distinct() for name, expression in key.items()}
    undecided = keyed
    for name in IDENTITIES:
        undecided = undecided.join(taken[name], name, "left_anti")
    undecided = cut_lineage(undecided)
    went_in: DataFrame | None = None
    while not undecided.isEmpty():
        marked = undecided
        for name in IDENTITIES:
            least = undecided.groupBy(name).agg(F.min("record_id").alias(f"_{name}"))
            marked = marked.join(least, name, "left")
        first = cut_lineage(marked.where(" AND ".join(f"({n} IS NULL OR record_id = _{n})" for n in IDENTITIES)).select(keyed.columns))
        went_in = first if went_in is None else went_in.unionByName(first)
        undecided = undecided.join(first.select("record_id"), "record_id", "left_anti")
        for name in IDENTITIES:
            undecided = undecided.join(first.select(name), name, "left_anti")
        undecided = cut_lineage(undecided)
    if went_in is None:
        went_in = keyed.limit(0)
    accepted = batch.join(went_in.select("record_id"), "record_id", "left_semi").select(*batch.columns)
    marked = keyed.join(went_in.select("record_id"), "record_id", "left_anti")
    for name in IDENTITIES:
        held = went_in.where(F.col(name).isNotNull()).select(name, F.col("record_id").alias(f"_in_{name}"))
        marked = marked.join(held, name, "left").join(taken[name].withColumn(f"_taken_{name}", F.lit(True)), name, "left")
    reason = F.coalesce(*[F.when(F.col(f"_taken_{n}") | (F.col(f"_in_{n}") < F.col("record_id")), F.lit(f"collision:{n}")) for n in IDENTITIES])
    rejected = batch.join(marked.select("record_id", reason.alias("reason")), "record_id").select(*batch.columns, "reason")
    return accepted, rejected


def stage_batch(root: str, batch_id: str, tables: dict[str, DataFrame]) -> bool:
    """Write the data of a batch; it counts once it is committed. False if the batch is committed already."""
    spark = next(iter(tables.values())).sparkSession
    if any(e.get("batch_id") == batch_id for e in commits(spark, root)):
        return False
    for name, frame in tables.items():
        ordered = frame.select(*[F.col(f.name).cast(f.dataType) for f in schemas.table_schema(name).fields])
        ordered.write.mode("overwrite").parquet(_folder(root, name, batch_id))
    return True


def commit_batch(spark: SparkSession, root: str, batch_id: str, tables: list[str]) -> bool:
    """Make a staged batch count, if no record clashes with what is committed; False if it was committed before.

    The number of a commit is taken by creating its file, so that of several writers one gets it. The others look at
    what was committed meanwhile, test their records against that, and try the next number.
    """
    checked: int | None = None
    while True:
        log = commits(spark, root)
        if any(e.get("batch_id") == batch_id for e in log):
            return False
        if "v4_records" in tables:
            others = _read(spark, "v4_records", list(_paths(spark, root, "v4_records", log, checked).values()))
            _, rejected = split_collisions(_read(spark, "v4_records", [_folder(root, "v4_records", batch_id)]), others)
            clash = rejected.select("record_id", "reason").first()
            if clash:
                folders.remove(spark, *[_folder(root, t, batch_id) for t in tables])
                raise ValueError(f"record {clash.record_id}: {clash.reason}")
        checked = log[-1]["number"] if log else -1
        if folders.create(spark, f"{root}/{LOG}/{_entry(checked + 1)}", json.dumps({"kind": "batch", "batch_id": batch_id, "tables": sorted(tables)})):
            return True


def append_generation_batch(root: str, batch_id: str, tables: dict[str, DataFrame]) -> bool:
    """Append all tables of a batch or none: data first, its commit last.

    Records that clash by an identity fail the batch (``split_collisions`` tells which to leave out beforehand), also
    when the other record was committed by another writer meanwhile. Repeating a batch id is a no-op once it is
    committed; a half-written batch is overwritten.
    """
    spark = next(iter(tables.values())).sparkSession
    return stage_batch(root, batch_id, tables) and commit_batch(spark, root, batch_id, list(tables))


def csv_projection(records: DataFrame) -> DataFrame:
    confidence = F.coalesce(F.nullif(F.col("confidence").cast("double"), F.lit(0.0)), F.col("conf").cast("double"), F.lit(0.0))
    values = ("name", "user_id", "trace_id", None, "created_at", "status", None, "original_url", "download_url")
    columns = [F.coalesce(F.col(v).cast("string"), F.lit("")) if v else None for v in values]
    columns[3], columns[6] = F.lit("V4"), F.format_string("%s", number_text(confidence))
    return records.select(*[c.alias(h) for c, h in zip(columns, CSV_HEADER)])


def number_text(value: Column) -> Column:
    """Whole numbers without a decimal point."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def csv_lines(records: DataFrame) -> DataFrame:
    """One export line per record: every cell quoted, quotes doubled."""
    rows = csv_projection(records)
    cells = [F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"')) for c in rows.columns]
    return rows.select(F.concat_ws(",", *cells).alias("line"))


def export_csv(records: DataFrame, path: str) -> None:
    """Distributed export: one quoted CSV with header per partition."""
    csv_projection(records).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def report_rows(report_id: Column, metadata: Column, summary: Column, cases: Column, settings: Column, verdict: Column, failed_gates: Column) -> list[Column]:
    body = F.struct(
        metadata.alias("metadata"), summary.alias("summary"), cases.alias("cases"), settings.alias("settings"),
        verdict.alias("verdict"), failed_gates.alias("failed_gates"),
    )
    return [report_id.alias("report_id"), F.to_json(body).alias("report")]


def write_report(summary: DataFrame, verdict: DataFrame, cases: DataFrame, path: str, metadata: dict, settings: dict) -> None:
    """Report folder: the case rows as JSON lines next to one head document (run facts are arguments)."""
    cases.write.mode("overwrite").json(f"{path}/cases")
    summary.write.mode("overwrite").json(f"{path}/summary")
    pairs = lambda d: F.create_map(*[F.lit(str(v)) for kv in d.items() for v in kv])
    verdict.select(
        pairs(metadata).alias("metadata"), pairs(settings).alias("settings"), "verdict", "failed_gates"
    ).write.mode("overwrite").json(f"{path}/head")


def upsert_features(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or replace by (source_group_id, feature_kind); batch rows carry ``sequence`` > 0."""
    merged = current.withColumn("sequence", F.lit(0).cast("bigint")).unionByName(batch.withColumn("sequence", F.col("sequence").cast("bigint")))
    return keep_latest(merged, ["source_group_id", "feature_kind"], "sequence").drop("sequence")


def backfill_owners(records: DataFrame, owner: int) -> tuple[DataFrame, DataFrame]:
    """(records with owners set, one-row count of changed rows)."""
    changed = records.agg(F.count_if(F.col("owner_user_id").isNull()).alias("changed"))
    return records.withColumn("owner_user_id", F.coalesce("owner_user_id", F.lit(owner))), changed


def delete_records(records: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scoped hard delete; requests: record_id, user_id, cross_owner. Returns (kept, deleted count)."""
    wanted = requests.select("record_id", F.when(~F.col("cross_owner"), F.col("user_id")).alias("_owner")).distinct()
    match = (records["record_id"] == wanted["record_id"]) & (wanted["_owner"].isNull() | (records["owner_user_id"] == wanted["_owner"]))
    return records.join(wanted, match, "left_anti"), records.join(wanted, match, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def delete_groups(groups: DataFrame, children: dict[str, DataFrame], group_ids: DataFrame) -> dict[str, DataFrame]:
    """Groups without the given ids, and their embeddings, features and records without those groups."""
    gone = group_ids.select("source_group_id").distinct()
    tables = {"source_groups": groups, **children}
    return {name: frame.join(gone, "source_group_id", "left_anti") for name, frame in tables.items()}
