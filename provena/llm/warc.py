"""WARC archives: writing segmented records with chunked transfer framing, and reassembling them.

Archives are text files whose line separator is the end of a record, so Spark's own writer makes them. A block
longer than a segment goes out as a first record and continuations; a segment bounds the size of a record, and
records per file bound the size of an archive. Archives are gzipped. Reading parses whole archives, groups segments by the id of their
origin, orders them by number, verifies the total length and takes the chunked framing off.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from provena.llm import common

SEGMENT_BYTES, FRAME_BYTES, FILE_RECORDS = 4096, 1000, 2048
REVISIT_FROM = 1000
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b"
URN = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def framed(payload: bytes, size: int = FRAME_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0" + END


def unframed(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are skipped. Raises ValueError if it is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk without size")
        digits = body[at:line].split(b";")[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("chunk without size")
        size = int(digits, 16)
        if size == 0:
            return b"".join(out)
        begin = line + 2
        if body[begin + size : begin + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[begin : begin + size])
        at = begin + size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _records(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.chunks(batch, "payload"):
            out = []
            for page, url, payload, digest, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                name = f"<{URN}{page}>"
                fields = [("WARC-Date", "2025-01-01T00:00:00Z"), ("WARC-Target-URI", quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
                if refers is not None:
                    out.append(_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Refers-To", f"<{URN}{refers}>"), ("WARC-Profile", PROFILE), *fields], head))
                    continue
                block = head + framed(payload)
                if len(block) <= segment:
                    out.append(_record([("WARC-Type", "response"), ("WARC-Record-ID", name), *fields], block))
                    continue
                count = -(-len(block) // segment)
                out.append(_record([("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Segment-Number", "1"), *fields], block[:segment]))
                for number in range(2, count + 1):
                    more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{URN}{page}:{number}>"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(number))]
                    if number == count:
                        more.append(("WARC-Segment-Total-Length", str(len(block))))
                    out.append(_record(more, block[(number - 1) * segment : number * segment]))
            yield common.batch_of(["value"], [pa.array(out, pa.binary())])


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Write pages(page_id, url, payload, digest, refers_to) below ``path``; rows with ``refers_to`` become revisits."""
    records = pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(lambda b: _records(b, segment), "value binary")
    # Bytes pass through unchanged: the cast relabels them, and the writer copies them.
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of archives: id and origin, kind, segment number, total length, fields of the first segment, block."""
    kind = pa.schema([("origin", pa.string()), ("type", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary())])
    for batch in batches:
        for content in batch.column("content"):
            data, at, rows, held = content.as_buffer().to_pybytes(), 0, [], 0
            if data.startswith(GZIP):
                data = gzip.decompress(data)
            while data.startswith(b"WARC/", at):
                stop = data.index(END, at)
                fields = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
                length, begin = int(fields["Content-Length"]), stop + len(END)
                block = data[begin : begin + length]
                total = fields.get("WARC-Segment-Total-Length")
                rows.append({"origin": fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), "type": fields["WARC-Type"], "number": int(fields.get("WARC-Segment-Number", 1)), "total": int(total) if total else (None if "WARC-Segment-Number" in fields else length), "refers_to": fields.get("WARC-Refers-To"), "digest": fields.get("WARC-Payload-Digest"), "block": block})
                held += length
                at = begin + length + len(END)
                if held > common.CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows, held = [], 0
            if at != len(data):
                raise ValueError("archive has bytes outside its records")
            yield pa.RecordBatch.from_pylist(rows, kind)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "type", "refers_to", "digest", "payload", "problem"]
    for batch in batches:
        out: dict[str, list] = {n: [] for n in names}
        for origin, segments in zip(batch.column("origin").to_pylist(), batch.column("segments").to_pylist(), strict=True):
            by_number = {s["number"]: s for s in segments}  # a segment that occurs twice counts once
            ordered = [by_number[n] for n in sorted(by_number)]
            first, block = ordered[0], b"".join(s["block"] for s in ordered)
            total = next((s["total"] for s in ordered if s["total"] is not None), None)
            problem, payload = None, None
            if [s["number"] for s in ordered] != list(range(1, len(ordered) + 1)):
                problem = "segments are missing"
            elif total != len(block):
                problem = "total length differs"
            elif first["type"] == "response":
                head, _, body = block.partition(END)
                try:
                    payload = unframed(body) if b"transfer-encoding: chunked" in head.lower() else body
                    if first["digest"] and first["digest"].removeprefix("sha1:") != hashlib.sha1(payload).hexdigest():
                        problem = "payload digest differs"
                except ValueError as error:
                    problem = str(error)
            for name, value in zip(names, (origin, first["type"], first["refers_to"], first["digest"], payload, problem), strict=True):
                out[name].append(value)
        yield common.batch_of(names, [pa.array(out[n], pa.binary() if n == "payload" else pa.string()) for n in names])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Reassembled records below ``path``: ``record_id, type, refers_to, digest, payload, problem``.

    Ids stand without their brackets, digests without their label. ``problem`` tells why a record could not be
    put together (missing segments, another total length, broken chunks, another digest); it is null otherwise.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    records = files.mapInArrow(_parsed, "origin string, type string, number int, total bigint, refers_to string, digest string, block binary")
    grouped = records.groupBy("origin").agg(F.collect_list(F.struct("type", "number", "total", "refers_to", "digest", "block")).alias("segments"))
    whole = grouped.mapInArrow(_assembled, "record_id string, type string, refers_to string, digest string, payload binary, problem string")

    def bare(name: str):
        return F.regexp_replace(name, "^<|>$", "").alias(name)

    return whole.select(bare("record_id"), "type", bare("refers_to"), F.regexp_replace("digest", "^sha1:", "").alias("digest"), "payload", "problem")


def archive_plan(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """pages(page_id, url, html) with ``payload, digest, refers_to``: of equal payloads of at least
    ``revisit_from`` bytes the row with the largest id is the response, the others refer to it.

    With a column ``_row`` (numbers in the order of the ids), records are named by id and number."""
    own = ["_row"] if "_row" in pages.columns else []
    rows = pages.select("page_id", *own, "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.length("payload") >= revisit_from)
    last = [F.max(F.when(F.col("page_id").isNotNull(), F.col(c))).alias("_head_row") for c in own]
    heads = large.groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("copies"), *last).where("copies > 1 and head is not null").drop("copies")
    # A written table has a known size: a short list of heads is broadcast and the payloads stay where they are; a
    # long one is shuffled with the pages, where a hot digest can be split.
    found = rows.join(common.written(heads), "digest", "left")
    found = found.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")))
    if own:
        name = lambda id_, row: F.concat(F.coalesce(F.concat(F.col(id_).cast("string"), F.lit("#")), F.lit("")), F.col(row))
        found = found.withColumns({"page_id": name("page_id", "_row"), "refers_to": F.when(F.col("refers_to").isNotNull(), name("refers_to", "_head_row"))})
    return found.drop("head", "_row", "_head_row")


def round_trip(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Write pages(page_id, url, html) as archives below ``path`` and read them back: one row a page with
    ``page_id, payload_bytes, payload_digest, record_type, refers_to, problem``, all taken from the archives.

    A null html is an empty payload, a null url becomes about:blank, a null page_id is a page of its own (one that
    never is the response of others). Rows equal in id, url and html are one page, other content under the same id is a
    page of its own. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html")
    repeat = common.ids_repeat(rows, "page_id")
    if repeat:
        rows = common.numbered(common.folded(rows, "page_id", ["url", "html"]), "page_id")
    write_archives(archive_plan(rows), path, segment)
    records = read_archives(spark, path).select("record_id", "type", "refers_to", "digest", F.length("payload").cast("bigint").alias("bytes"), "problem")
    records = common.written(records)
    sizes = records.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("bytes").alias("_bytes"), F.col("digest").alias("_digest"))
    joined = common.skew_join(records.where("type = 'revisit'").drop("bytes"), sizes, "refers_to", "left")
    revisits = joined.select("record_id", "type", "refers_to", "digest", F.col("_bytes").alias("bytes"), F.when(F.col("_digest") != F.col("digest"), F.lit("payload digest differs")).otherwise(F.col("problem")).alias("problem"))
    kind = pages.schema["page_id"].dataType

    def page(name: str, alias: str):
        bare = F.regexp_replace(name, "^" + URN, "")
        # A page without id has a number only.
        return (F.when(bare.rlike("#[0-9]+$"), F.regexp_replace(bare, "#[0-9]+$", "")) if repeat else bare).try_cast(kind).alias(alias)

    both = records.where("type = 'response'").select(revisits.columns).unionByName(revisits)
    return both.select(page("record_id", "page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to", "refers_to"), "problem")
