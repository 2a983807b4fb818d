"""Streaming queries: the events table as a file stream, drained and compared with its batch form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from provena import schemas
from provena.session import cut_lineage, ensure_checkpoint_dir
from provena.sources import sinks
from provena.sources.registry import scan_events_stream, scan_registry
from provena.streaming import monitors
from provena.suite.base import query, records, table

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one stream, inside the shared checkpoint folder of the cluster."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/streams/{name}-{uuid.uuid4().hex}"


def table_files(folder: str, name: str) -> str:
    """The files of a table that is one file or a folder of part files; a stream takes a single file by a pattern only."""
    return f"{folder}/{name}.parque[t]"


def table_stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(table_files(folder, name))


def events_stream(spark: SparkSession, folder: str, delay: str = "10 minutes") -> DataFrame:
    raw = table_stream(spark, folder, "events", EVENTS)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


@query("scan_events_stream", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def scan_events(spark: SparkSession, folder: str) -> DataFrame:
    out = work_folder(spark, "scan")
    schema = EVENTS.replace("timestamp_ntz", "timestamp")
    stream = scan_events_stream(spark, table_files(folder, "events"), schema)
    monitors.run_available(stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")), out)
    return monitors.latest_rows(spark, out, ["event_type"]).select("event_type", "n", "total")


_THROTTLE_SQL = """WITH a AS (SELECT epoch_ms(date_trunc('second', ts)) // 1000 // 300 * 300 AS w, 'account' AS kind, 'user' || user_id % 20 AS subject FROM events WHERE event_type = 'error'
   UNION ALL SELECT epoch_ms(date_trunc('second', ts)) // 1000 // 300 * 300, 'ip', 'ip' || user_id % 3 FROM events WHERE event_type = 'error')
   SELECT w AS window_start, kind, subject, count(*) AS attempts FROM a GROUP BY ALL HAVING count(*) > 1"""


@query("login_throttle", _THROTTLE_SQL)
def login_throttle(spark: SparkSession, folder: str) -> DataFrame:
    """Failed events as login attempts (limit 1 here, so that windows fire)."""
    out = work_folder(spark, "throttle")
    failed = events_stream(spark, folder).where(F.col("event_type") == "error").select(
        "ts", F.concat(F.lit("USER"), (F.col("user_id") % 20).cast("string")).alias("username"), F.concat(F.lit("ip"), (F.col("user_id") % 3).cast("string")).alias("client_ip")
    )
    monitors.run_available(monitors.login_throttle(failed, 1), out)
    rows = monitors.latest_rows(spark, out, ["window_start", "kind", "subject"])
    return rows.select(F.unix_timestamp("window_start").alias("window_start"), "kind", "subject", "attempts")


@query(
    "running_counters",
    """WITH d AS (SELECT user_id AS owner_user_id, event_type AS k, ts FROM events), e AS (SELECT owner_user_id, k AS counter_key FROM d UNION ALL SELECT owner_user_id, k || ':' || strftime(ts, '%Y-%m-%d') FROM d)
       SELECT owner_user_id, counter_key, count(*) AS counter_value FROM e GROUP BY ALL""",
)
def running_counters(spark: SparkSession, folder: str) -> DataFrame:
    out = work_folder(spark, "counters")
    rows = events_stream(spark, folder).select("ts", F.col("user_id").alias("owner_user_id"), F.col("event_type").alias("counter_key"), F.lit(1).alias("delta"))
    monitors.counter_sink(rows, out)
    return monitors.counter_totals(spark, out)


@query(
    "stage_metrics",
    """WITH e AS (SELECT epoch_ms(date_trunc('second', ts)) // 1000 // 60 * 60 AS m, event_type, value, user_id, epoch_ms(ts) AS t FROM events), w AS (SELECT m - 60 * k AS s, * FROM e, (SELECT unnest(range(0, 10)) AS k))
       SELECT s AS window_start, event_type AS stage, count(*) AS events, round(avg(value), 6) AS mean_ms, max(value) AS max_ms, CAST(sum(user_id) AS BIGINT) AS candidates, count(*) FILTER (value > 10) AS fallbacks FROM w GROUP BY ALL""",
)
def stage_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = work_folder(spark, "stages")
    rows = events_stream(spark, folder).select(
        "ts", F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"), F.col("user_id").alias("candidate_count"), (F.col("value") > 10).cast("int").alias("fallback_count")
    )
    monitors.run_available(monitors.stage_metrics(rows), out)
    rows = monitors.latest_rows(spark, out, ["window_start", "stage"])
    return rows.select(F.unix_timestamp("window_start").alias("window_start"), "stage", "events", F.round("mean_ms", 6).alias("mean_ms"), "max_ms", "candidates", "fallbacks")


# One step an event of a token: what its session was, and what the event makes of it.
_SESSIONS_SQL = f"""WITH RECURSIVE k AS (
  SELECT user_id || ':' || strftime(ts, '%Y%m%d') AS token, user_id, epoch_us(ts) AS moment, CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 2 ELSE 1 END AS kind FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY moment, kind) AS n FROM k),
walk AS (
  SELECT token, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS BIGINT) AS moment, CAST(NULL AS BIGINT) AS issued, CAST(NULL AS BIGINT) AS used, false AS gone, '' AS event
  FROM (SELECT DISTINCT token FROM k)
  UNION ALL
  SELECT token, n, user_id, moment, CASE kind WHEN 0 THEN moment ELSE issued END, CASE WHEN kind = 0 OR event = 'accepted' THEN moment ELSE used END, kind <> 0 AND (gone OR event IN ('expired', 'revoked')), event
  FROM (SELECT w.token, e.n, e.user_id, e.moment, e.kind, w.issued, w.used, w.gone,
          CASE WHEN kind = 0 THEN 'issued' WHEN issued IS NULL OR gone THEN 'rejected' WHEN e.moment >= least(used + {monitors.IDLE_SECONDS * 10**6}, issued + {monitors.ABSOLUTE_SECONDS * 10**6}) THEN 'expired'
               WHEN kind = 2 THEN 'revoked' ELSE 'accepted' END AS event
        FROM walk w JOIN e ON e.token = w.token AND e.n = w.n + 1))
SELECT token, user_id, moment, event FROM walk WHERE n > 0"""


@query("sessions", _SESSIONS_SQL)
def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """User-days as tokens: sign-ups issue, errors revoke, every other event is a use."""
    out = work_folder(spark, "sessions")
    kind = F.when(F.col("event_type") == "signup", F.lit("issue")).when(F.col("event_type") == "error", F.lit("revoke")).otherwise(F.lit("use"))
    rows = events_stream(spark, folder).select("ts", F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("token"), "user_id", kind.alias("kind"))
    monitors.session_sink(rows, out)
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{out}/rows")
    return rows.select("token", "user_id", F.unix_micros("at").alias("moment"), "event")


# One step an event of a job: what has come due before it, then what it changes; timers at the watermark last.
_LEASES_SQL = """WITH RECURSIVE k AS (
  SELECT user_id || ':' || strftime(ts, '%Y%m%d') AS job_id, CAST(event_id % 2 AS VARCHAR) AS worker, epoch_us(ts) AS moment,
         CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 9 END AS kind FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY moment, kind, worker) AS n FROM k),
ends AS (SELECT max(moment) - 600000000 AS mark FROM k),
walk AS (
  SELECT job_id, CAST(0 AS BIGINT) AS n, '' AS status, '' AS owner, CAST(0 AS BIGINT) AS lease, CAST(0 AS BIGINT) AS deadline, false AS told, CAST(NULL AS BIGINT) AS lease_out, CAST(NULL AS BIGINT) AS past_out
  FROM (SELECT DISTINCT job_id FROM k)
  UNION ALL
  SELECT job_id, n,
         CASE WHEN made THEN 'queued' WHEN taken THEN 'running' WHEN done THEN 'finished' ELSE status END, CASE WHEN taken THEN worker ELSE owner END,
         CASE WHEN taken THEN moment + 30000000 ELSE lease END, CASE WHEN made THEN moment + 1000000000 ELSE deadline END, NOT (made OR taken) AND told, lease_out, past_out
  FROM (SELECT *, kind = 0 AND status = '' AS made,
               moment < deadline AND ((kind = 1 AND (status = 'queued' OR (status = 'running' AND lease < moment))) OR (kind = 2 AND status = 'running' AND owner = worker)) AS taken,
               kind IN (3, 4) AND status = 'running' AND owner = worker AS done
        FROM (SELECT job_id, n, moment, kind, worker, owner, lease, deadline, told OR lease_due OR past_due AS told, CASE WHEN past_due THEN 'overdue' ELSE status END AS status,
                     CASE WHEN lease_due THEN lease END AS lease_out, CASE WHEN past_due THEN deadline END AS past_out
              FROM (SELECT w.job_id, e.n, e.moment, e.kind, e.worker, w.status, w.owner, w.lease, w.deadline, w.told,
                           status = 'running' AND NOT told AND lease < e.moment AND lease <= deadline AS lease_due, status IN ('queued', 'running') AND deadline <= e.moment AS past_due
                    FROM walk w JOIN e ON e.job_id = w.job_id AND e.n = w.n + 1)))),
last AS (SELECT *, (SELECT mark FROM ends) AS mark FROM walk QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1)
SELECT job_id, lease_out AS moment, 'lease_expired' AS event FROM walk WHERE lease_out IS NOT NULL
UNION ALL SELECT job_id, past_out, 'past_deadline' FROM walk WHERE past_out IS NOT NULL
UNION ALL SELECT job_id, lease, 'lease_expired' FROM last WHERE status = 'running' AND NOT told AND lease <= deadline AND lease + 1000 < mark
UNION ALL SELECT job_id, deadline, 'past_deadline' FROM last WHERE status IN ('queued', 'running') AND deadline < mark"""


@query("lease_monitor", _LEASES_SQL)
def lease_monitor(spark: SparkSession, folder: str) -> DataFrame:
    """Users as jobs: sign-ups create, views claim, clicks renew, purchases complete, errors fail."""
    out = work_folder(spark, "leases")
    names = F.create_map(*[F.lit(x) for x in ("signup", "create", "view", "claim", "click", "renew", "purchase", "complete", "error", "fail")])
    rows = events_stream(spark, folder).select("ts", F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("job_id"), (F.col("event_id") % 2).cast("string").alias("worker_id"), F.element_at(names, F.col("event_type")).alias("kind"))
    monitors.lease_sink(rows, out)
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{out}/rows")
    return rows.select("job_id", F.unix_micros("at").alias("moment"), "event")


@query(
    "exact_match_stream",
    """WITH q AS (SELECT min(doc_id) AS d, doc_id * 3 % 7 AS user_id, lang = 'es' AS cross_owner, md5(text) AS md5, sha256(text) AS sha256 FROM documents GROUP BY ALL),
         r AS (SELECT doc_id, doc_id % 7 AS owner, text FROM documents WHERE lang NOT IN ('de', 'fr')), f AS (SELECT DISTINCT doc_id, owner, md5(text) AS md5, sha256(text) AS sha256 FROM r UNION SELECT DISTINCT doc_id, owner, md5(lower(text)), sha256(lower(text)) FROM r),
         h AS (SELECT q.user_id, q.cross_owner, q.sha256, count(DISTINCT f.doc_id) AS n FROM (SELECT DISTINCT user_id, cross_owner, md5, sha256 FROM q) q LEFT JOIN f ON f.md5 = q.md5 AND f.sha256 = q.sha256 AND (q.cross_owner OR f.owner = q.user_id) GROUP BY ALL)
       SELECT CASE n WHEN 0 THEN 'continue' WHEN 1 THEN 'success' ELSE 'ambiguous' END AS outcome, count(*) AS n FROM h GROUP BY 1""",
)
def exact_match_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Documents arrive as suspects against the document registry; outcomes are counted."""
    out = work_folder(spark, "exact")
    text = F.encode("text", "UTF-8")
    raw = table_stream(spark, folder, "documents", DOCUMENTS)
    asked = raw.select(
        F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") % 60).alias("ts"), F.col("doc_id").alias("query_id"), (F.col("doc_id") * 3 % 7).alias("user_id"), (F.col("lang") == "es").alias("cross_owner"),
        F.md5(text).alias("md5"), F.sha2(text, 256).alias("sha256"),
    )
    monitors.run_available(monitors.exact_match_stream(asked, records(spark, folder)), out, "append")
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{out}/rows")
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _digest(text: Column, f: Callable[[Column], Column]) -> Column:
    return F.unhex(f(F.encode(text, "UTF-8")))


def _sha(data: Column) -> Column:
    return F.sha2(data, 256)


def _digested(docs: DataFrame) -> DataFrame:
    """Documents with the digests of their texts and lower-cased texts in place of the texts."""
    digests = {
        f"{kind}_{name}": _digest(text, f)
        for kind, text in (("original", F.col("text")), ("watermarked", F.lower("text"))) for name, f in (("md5", F.md5), ("sha256", _sha))
    }
    return docs.select("doc_id", "lang", *[digest.alias(name) for name, digest in digests.items()])


def _stored_records(docs: DataFrame) -> DataFrame:
    """Digested documents as rows of the record table, with their doc_id beside."""
    held = {
        "record_id": F.col("doc_id").cast("string"), "owner_user_id": F.col("doc_id") % 7, "trace_id": F.concat(F.lit("trace-"), F.col("doc_id").cast("string")),
        "status": F.when(F.col("lang").isin("de", "fr"), F.lit("deleted")).otherwise(F.lit("active")),
        **{f"{kind}_file_{name}": F.col(f"{kind}_{name}") for kind in ("original", "watermarked") for name in ("md5", "sha256")},
    }
    fields = schemas.table_schema("v4_records").fields
    return docs.select("doc_id", *[held.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


@query(
    "scan_committed",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id, CAST(doc_id % 7 AS INTEGER) AS owner_user_id, 'trace-' || doc_id AS trace_id, CASE WHEN lang IN ('de', 'fr') THEN 'deleted' ELSE 'active' END AS status,
              md5(text) AS original_file_md5 FROM documents WHERE text IS NOT NULL""",
)
def scan_committed(spark: SparkSession, folder: str) -> DataFrame:
    """The registry's typed reader over four committed batches, the first two of them compacted, and one that is not."""
    root = f"{work_folder(spark, 'committed')}/registry"
    stored = _stored_records(cut_lineage(_digested(table(spark, folder, "documents").where(F.col("text").isNotNull()))))
    for part in range(4):
        rows = {"v4_records": stored.where(F.pmod("doc_id", F.lit(4)) == part).drop("doc_id")}
        sinks.append_generation_batch(root, f"batch-{part}", rows)
        if part == 1:
            sinks.compact(spark, root)
    sinks.stage_batch(root, "staged", {"v4_records": stored.drop("doc_id")})
    rows = scan_registry(spark, root, ("v4_records",))["v4_records"]
    return rows.select("record_id", "owner_user_id", "trace_id", "status", F.lower(F.hex("original_file_md5")).alias("original_file_md5"))


@query(
    "exact_match_refreshed",
    """WITH d AS (SELECT doc_id, doc_id * 3 % 7 AS user_id, lang = 'es' AS cross_owner, md5(text) AS h, doc_id % 3 = 0 AS early FROM documents WHERE text IS NOT NULL),
       q AS (SELECT user_id, cross_owner, h, bool_or(early) AS early FROM d GROUP BY ALL),
       r AS (SELECT doc_id, doc_id % 7 AS owner, text, doc_id % 2 = 0 AS stored FROM documents WHERE text IS NOT NULL AND lang NOT IN ('de', 'fr')),
       f AS (SELECT doc_id, owner, stored, md5(text) AS h FROM r UNION SELECT doc_id, owner, stored, md5(lower(text)) FROM r),
       n AS (SELECT q.user_id, q.cross_owner, q.h, count(DISTINCT f.doc_id) AS n FROM q LEFT JOIN f ON f.h = q.h AND (q.cross_owner OR f.owner = q.user_id) AND (f.stored OR NOT q.early) GROUP BY ALL)
       SELECT CASE n WHEN 0 THEN 'continue' WHEN 1 THEN 'success' ELSE 'ambiguous' END AS outcome, count(*) AS n FROM n GROUP BY 1""",
)
def exact_match_refreshed(spark: SparkSession, folder: str) -> DataFrame:
    """Suspects of two arrivals against a registry that a second batch joins in between; the index is kept and extended."""
    out = work_folder(spark, "refreshed")
    # Texts are read and digested once; both arrivals and both batches take theirs from the digests.
    docs = cut_lineage(_digested(table(spark, folder, "documents").where(F.col("text").isNotNull())))
    stored = _stored_records(docs)
    asked = docs.select(
        F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") % 60).alias("ts"), F.col("doc_id").alias("query_id"), (F.col("doc_id") * 3 % 7).alias("user_id"), (F.col("lang") == "es").alias("cross_owner"),
        F.col("original_md5").alias("md5"), F.col("original_sha256").alias("sha256"),
    )
    early = F.col("query_id") % 3 == 0
    for batch, arriving in ((0, early), (1, ~early)):
        sinks.append_generation_batch(f"{out}/registry", f"batch-{batch}", {"v4_records": stored.where(F.col("doc_id") % 2 == batch).drop("doc_id")})
        asked.where(arriving).write.mode("append").parquet(f"{out}/in")
        monitors.match_sink(spark.readStream.schema(asked.schema).parquet(f"{out}/in"), f"{out}/registry", out)
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{out}/rows")
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("audit_append", "SELECT CAST(event_id AS VARCHAR) AS event_id, user_id AS actor_user_id, event_type AS action FROM events")
def audit_append(spark: SparkSession, folder: str) -> DataFrame:
    out = work_folder(spark, "audit")
    rows = events_stream(spark, folder).select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").alias("actor_user_id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"), F.col("props").alias("details")
    )
    monitors.audit_sink(rows, out)
    return spark.read.parquet(f"{out}/rows").select("event_id", "actor_user_id", "action")


ARRIVALS = 4


@query(
    "late_events",
    f"""WITH a AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_id % 101 % {ARRIVALS} AS arrival FROM events),
       m AS (SELECT arrival, max(ts) AS latest FROM a GROUP BY 1)
       SELECT event_id FROM a WHERE ts < (SELECT max(latest) FROM m WHERE m.arrival < a.arrival) - INTERVAL 10 DAY""",
)
def late_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events dealt into four arrivals, one micro-batch each; what is ten days late goes to the side table."""
    out = work_folder(spark, "late")
    rows = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 101 % ARRIVALS).alias("arrival"))
    for arrival in range(ARRIVALS):
        rows.where(F.col("arrival") == arrival).write.mode("append").parquet(f"{out}/in")
        # No file limit: what has arrived since the last start is one micro-batch, of however many files.
        monitors.late_sink(spark.readStream.schema(rows.schema).parquet(f"{out}/in"), out, "10 days")
    return spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{out}/late").select("event_id")
