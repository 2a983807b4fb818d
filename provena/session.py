"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for the plans in this package; a cluster may override any of them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go when their frame goes.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "provena", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to executors that don't have it installed, as a zip made on the driver.

    Arrow functions are pickled by name, so workers import ``provena``. Needless where every node has the package
    installed, or where ``--py-files`` named it.
    """
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="provena-package-")) / "provena.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to a temporary one in local mode only."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="provena-checkpoint-")
    context.setCheckpointDir(folder)


# Spark drops the shuffle files of a query once it has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# The JVM optimises no method that is longer than this. A stage whose code has longer ones then runs operator by operator,
# whose expressions Spark compiles as many short methods: for rows that are asked very many things at once.
OPTIMISED_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}

# Short keys shrink so far in a shuffle that tasks of the usual 64 MB, or map tasks of 128 MB, hold many millions of them in
# memory, and a branch of a union may get one task for all of its rows. These bound the rows of a task instead.
SMALL_TASKS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m", "spark.sql.files.maxPartitionBytes": "16m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


def cut_lineage(frame: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """Reliable checkpoint: survives executor loss and fixes values that depend on partition ids.

    What was shuffled for it is dropped from the executors' disks once it stands. ``settings`` hold while it is made.
    """
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    held = {CLEAN_SHUFFLES: "true", **(settings or {})}
    kept = {name: spark.conf.get(name, None) for name in held}
    for name, value in held.items():
        spark.conf.set(name, value)
    try:
        # A frame of its own: shuffles of the caller's are not those that go.
        return frame.select("*").checkpoint(eager=True)
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder, for tables that are written once and reread."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables-{uuid.uuid4().hex}"


def written(frame: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: lineage ends, sizes are known. ``settings`` hold
    while it is written."""
    spark = frame.sparkSession
    path = scratch_folder(spark)
    # What was shuffled for the table is of no use once the table is written.
    held = {CLEAN_SHUFFLES: "true", **(settings or {})}
    kept = {name: spark.conf.get(name, None) for name in held}
    for name, value in held.items():
        spark.conf.set(name, value)
    try:
        frame.write.parquet(path)
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    table = spark.read.schema(frame.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: all that used them is itself written."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
