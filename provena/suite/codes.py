"""Code queries: digests, tags, codewords, Hamming matching, bit rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from provena.functions import bits, codewords, crypto
from provena.operators import hamming
from provena.operators.scale import pinned
from provena.suite.base import SIGN_SQL, query, sign_code, table
from provena.suite.reports import _hmac_sql

_KEY = b"0123456789abcdef0123456789abcdef"
_MAGIC = bits.MAGIC


def _utf8(column: str = "text"):
    return F.encode(column, "UTF-8")


# --- digests and tags ----------------------------------------------------------------------------


@query("file_digests", "SELECT doc_id, upper(md5(text)) AS md5, upper(sha256(text)) AS sha256 FROM documents")
def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", crypto.file_md5_hex(_utf8()).alias("md5"), crypto.file_sha256_hex(_utf8()).alias("sha256"))


@query(
    "pixel_digest_sized",
    "SELECT doc_id, upper(sha256(encode(n_chars || 'x' || (doc_id + 1) || ':RGB:') || encode(text))) AS digest FROM documents",
)
def pixel_digest_sized(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", crypto.pixel_sha256_sized(F.col("n_chars"), F.col("doc_id") + 1, _utf8()).alias("digest"))


@query("pixel_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def pixel_digest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.lower(F.hex(crypto.pixel_sha256(_utf8()))).alias("digest"))


def _field_sql(blob: str) -> str:
    return f"unhex(lpad(printf('%x', octet_length({blob})), 8, '0')) || {blob}"


_TAG_SQL = _hmac_sql(
    _KEY,
    " || ".join(
        [
            f"encode('{crypto.TAG_MESSAGE_PREFIX.decode()}')", _field_sql(f"encode('{crypto.CODEC}')"), _field_sql("encode('key-1')"),
            _field_sql("unhex(lpad(printf('%x', doc_id), 16, '0'))"), _field_sql("unhex(sha256(text))"), _field_sql("encode('trace-' || doc_id)"),
        ]
    ),
)


@query("auth_tag", f"SELECT doc_id, substr({_TAG_SQL}, 1, 16) AS tag FROM documents")
def auth_tag(spark: SparkSession, folder: str) -> DataFrame:
    tag = crypto.ring_tag(
        {"key-1": _KEY}, F.lit(crypto.CODEC), F.lit("key-1"), F.col("doc_id"), crypto.file_sha256(_utf8()), F.concat(F.lit("trace-"), F.col("doc_id").cast("string"))
    )
    return table(spark, folder, "documents").select("doc_id", F.lower(F.hex(tag)).alias("tag"))


@query("trace_code_v3", "SELECT doc_id, substr(" + _hmac_sql(_KEY, "encode('robust-v3:trace-' || doc_id)") + ", 1, 16) AS code FROM documents")
def trace_code_v3(spark: SparkSession, folder: str) -> DataFrame:
    code = crypto.v3_code(_KEY, F.concat(F.lit("trace-"), F.col("doc_id").cast("string")))
    return table(spark, folder, "documents").select("doc_id", F.lower(F.hex(code)).alias("code"))


@query("trace_codes")
def trace_codes(spark: SparkSession, folder: str) -> DataFrame:
    """64-bit code, 48-bit payload of every trace id (blake2b has no SQL form)."""
    trace = F.concat(F.lit("trace-"), F.col("doc_id").cast("string"))
    return table(spark, folder, "documents").select("doc_id", codewords.trace_code64(trace).alias("code"), codewords.trace_payload48(trace).alias("payload"))


@query("encode_codewords")
def encode_codewords(spark: SparkSession, folder: str) -> DataFrame:
    """Systematic RS(16,8) and RS(24,8) codewords of every document's tag."""
    tag = F.substring(crypto.file_sha256(_utf8()), 1, 8)
    return table(spark, folder, "documents").select(
        "doc_id", F.hex(tag).alias("tag"), F.hex(codewords.encode_codeword(tag)).alias("codeword"), F.hex(codewords.encode_codeword(tag, 16)).alias("codeword_v2")
    )


@query(
    "signed_urls",
    "SELECT doc_id, 'https://h/api/media/m' || doc_id || '?expires=' || (1700000000 + n_chars) || '&signature=' || "
    + _hmac_sql(_KEY, " || ".join(_field_sql(f"encode({f})") for f in (f"'{crypto.MEDIA_URL_PREFIX}'", "'m' || doc_id", "'original'", "CAST(doc_id % 7 AS VARCHAR)", "CAST(1700000000 + n_chars AS VARCHAR)")))
    + " AS url, '/uploads/' || doc_id || '?expire_time=' || (1700000000 + n_chars) || '&signature=' || "
    + _hmac_sql(_KEY, "encode('v1' || chr(10) || (1700000000 + n_chars) || chr(10) || '/uploads/' || doc_id)")
    + " AS legacy_url, 1700001000 <= 1700000000 + n_chars AS still_valid FROM documents",
)
def signed_urls(spark: SparkSession, folder: str) -> DataFrame:
    media, owner = F.concat(F.lit("m"), F.col("doc_id").cast("string")), F.col("doc_id") % 7
    expires = F.lit(1700000000).cast("bigint") + F.col("n_chars")
    signature = crypto.media_signature(_KEY, media, F.lit("original"), owner, expires)
    return table(spark, folder, "documents").select(
        "doc_id", crypto.media_url(_KEY, F.lit("https://h"), media, F.lit("original"), owner, expires).alias("url"),
        crypto.path_url(_KEY, F.concat(F.lit("/uploads/"), F.col("doc_id").cast("string")), expires).alias("legacy_url"),
        crypto.media_url_valid(_KEY, media, F.lit("original"), owner, expires, signature, F.lit(1700001000)).alias("still_valid"),
    )


# --- bits ----------------------------------------------------------------------------------------


@query(
    "hamming_distance",
    f"WITH {SIGN_SQL} SELECT a.vec_id, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM signs a JOIN signs b ON b.vec_id = a.vec_id + 1",
)
def hamming_distance(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", sign_code().alias("code"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("code").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", bits.hamming64(F.col("code"), F.col("other")).alias("distance"))


@query(
    "code_bits",
    """SELECT vec_id, array_to_string(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), '') AS bits,
       lower(string_agg(printf('%02x', b), '' ORDER BY i)) AS bytes FROM (SELECT vec_id, embedding, i,
         CAST(list_sum(list_transform(range(1, 9), lambda j: CASE WHEN embedding[i * 8 + j] > 0 THEN 1 << CAST(8 - j AS INTEGER) ELSE 0 END)) AS BIGINT) AS b
         FROM embeddings, (SELECT unnest(range(0, 8)) AS i)) GROUP BY vec_id, embedding""",
)
def code_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Code to bits and to bytes, most significant first."""
    rows = table(spark, folder, "embeddings").select("vec_id", sign_code().alias("code"))
    values = bits.code_bits(F.col("code"))
    return rows.select("vec_id", F.array_join(F.transform(values, lambda b: b.cast("string")), "").alias("bits"), F.lower(F.hex(bits.bits_to_bytes(values, 8))).alias("bytes"))


@query(
    "carrier_order",
    "SELECT vec_id, phase, round(CAST(embedding[t[phase + 1][1] + 1] AS DOUBLE), 6) AS first_score, round(CAST(embedding[t[phase + 1][64] + 1] AS DOUBLE), 6) AS last_score FROM "
    "(SELECT vec_id, embedding, CAST(vec_id % 4 AS INTEGER) AS phase, " + str([bits.phase_table(p, bits.PHASE_SEED_V4) for p in range(4)]) + " AS t FROM embeddings)",
)
def carrier_order(spark: SparkSession, folder: str) -> DataFrame:
    """Scores from physical cell order to logical bit order by the tile's phase."""
    phase = (F.col("vec_id") % 4).cast("int")
    rows = table(spark, folder, "embeddings").select("vec_id", phase.alias("phase"), bits.to_logical_order(F.col("embedding"), phase, bits.PHASE_SEED_V4, 4).alias("s"))
    at = lambda i: F.round(F.element_at("s", i).cast("double"), 6)
    return rows.select("vec_id", "phase", at(1).alias("first_score"), at(64).alias("last_score"))


@query(
    "tile_phase",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey + 2 * l_suppkey) % 4 AS phase, (l_partkey + 2 * l_suppkey) % 3 AS phase3, (l_partkey + l_suppkey) % 2 AS carrier FROM lineitem",
)
def tile_phase(spark: SparkSession, folder: str) -> DataFrame:
    x, y = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", bits.tile_phase(x, y).alias("phase"), bits.tile_phase(x, y, 3).alias("phase3"), bits.carrier_class(x, y).alias("carrier")
    )


@query(
    "repetition_decode",
    f"""WITH {SIGN_SQL}, b AS (SELECT vec_id, i, CAST(CASE WHEN i < 32 THEN (hi >> CAST(31 - i AS INTEGER)) & 1 ELSE (lo >> CAST(63 - i AS INTEGER)) & 1 END AS INTEGER) AS bit FROM signs, (SELECT unnest(range(0, 64)) AS i)),
       v AS (SELECT vec_id, i % 48 AS p, sum(bit) AS ones, count(*) AS n FROM b GROUP BY ALL)
       SELECT vec_id, CAST(sum(CASE WHEN ones * 2 >= n THEN CAST(1 AS BIGINT) << CAST(47 - p AS INTEGER) ELSE 0 END) AS BIGINT) AS payload, CAST(sum(least(ones, n - ones)) AS INTEGER) AS corrections FROM v GROUP BY vec_id""",
)
def repetition_decode(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", sign_code().alias("code"))
    payload, corrections = bits.repetition_decode(F.col("code"))
    return rows.select("vec_id", payload.alias("payload"), corrections.alias("corrections"))


@query(
    "radius_probability",
    """WITH RECURSIVE c(k, v) AS (SELECT 0, CAST(1 AS DOUBLE) UNION ALL SELECT k + 1, v * (64 - k) / (k + 1) FROM c WHERE k < 63)
       SELECT label, round(sum(v) / pow(2, 64) * 1e9, 6) AS per_billion FROM (SELECT DISTINCT label FROM embeddings) JOIN c ON k <= label GROUP BY label""",
)
def radius_probability(spark: SparkSession, folder: str) -> DataFrame:
    """Chance of a random code inside the radius, for every radius used as a label."""
    labels = table(spark, folder, "embeddings").select("label").distinct()
    chain = None
    for errors in range(65):
        value = bits.radius_probability(errors)
        chain = F.when(F.col("label") == errors, value) if chain is None else chain.when(F.col("label") == errors, value)
    return labels.select("label", F.round(chain * 1e9, 6).alias("per_billion"))


# --- codeword acceptance -------------------------------------------------------------------------

# Expected and observed codewords of a document: bytes of its digest, with some bytes taken from a
# second digest; byte confidences from a third.
_CODEWORD_SQL = """docs AS (SELECT doc_id, sha256(text) AS e, sha256(lower(text) || 'o') AS o, sha256(text || 'c') AS c, n_chars % 17 AS broken FROM documents),
bytes AS (SELECT doc_id, i, CAST('0x' || substr(e, CAST(1 + 2 * i AS INTEGER), 2) AS INTEGER) AS eb,
   CASE WHEN CAST('0x' || substr(c, CAST(1 + 2 * i AS INTEGER), 2) AS INTEGER) % 17 < broken THEN CAST('0x' || substr(o, CAST(1 + 2 * i AS INTEGER), 2) AS INTEGER) ELSE CAST('0x' || substr(e, CAST(1 + 2 * i AS INTEGER), 2) AS INTEGER) END AS ob,
   CAST('0x' || substr(c, CAST(33 + i AS INTEGER), 1) AS INTEGER) / 16.0 AS conf FROM docs, (SELECT unnest(range(0, {n})) AS i)),
m AS (SELECT doc_id, i, eb <> ob AS wrong, bit_count(xor(eb, ob)) AS errs, row_number() OVER (PARTITION BY doc_id ORDER BY conf, i) - 1 AS pos FROM bytes),
t AS (SELECT doc_id, CAST(sum(errs) AS INTEGER) AS bit_errors, count(*) FILTER (wrong) AS wrongs FROM m GROUP BY 1),
f AS (SELECT doc_id, f, count(*) FILTER (wrong AND pos >= f) AS e FROM m, (SELECT unnest({counts}) AS f) GROUP BY ALL),
r AS (SELECT doc_id, min(f) AS f FROM f WHERE 2 * e + f <= {parity} GROUP BY 1)
SELECT doc_id, r.f IS NOT NULL OR bit_errors <= {radius} AS accepted,
  CAST(CASE WHEN r.f IS NOT NULL THEN r.f WHEN bit_errors <= {radius} THEN 0 END AS INTEGER) AS erasure_count,
  CAST(CASE WHEN r.f IS NOT NULL THEN r.f + f.e WHEN bit_errors <= {radius} THEN wrongs END AS INTEGER) AS corrected_symbols,
  CASE WHEN r.f IS NOT NULL OR bit_errors <= {radius} THEN bit_errors END AS bit_errors,
  CASE WHEN r.f IS NOT NULL THEN 'reed_solomon' WHEN bit_errors <= {radius} THEN 'expected_codeword_distance' END AS method
FROM t LEFT JOIN r USING (doc_id) LEFT JOIN f ON f.doc_id = t.doc_id AND f.f = r.f"""


def _observed(spark: SparkSession, folder: str, size: int) -> DataFrame:
    sha = lambda c: F.unhex(F.sha2(F.encode(c, "UTF-8"), 256))
    docs = table(spark, folder, "documents").select(
        "doc_id", "n_chars", sha(F.col("text")).alias("e"), sha(F.concat(F.lower("text"), F.lit("o"))).alias("o"), F.sha2(F.encode(F.concat("text", F.lit("c")), "UTF-8"), 256).alias("c")
    )
    eb, ob = bits.byte_values(F.col("e"), size), bits.byte_values(F.col("o"), size)
    cb = bits.byte_values(F.unhex("c"), size)
    mixed = F.transform(
        F.arrays_zip(eb.alias("e"), ob.alias("o"), cb.alias("c")), lambda z: F.when(z["c"] % 17 < F.col("n_chars") % 17, z["o"]).otherwise(z["e"])
    )
    joined = F.unhex(F.array_join(F.transform(mixed, lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    confidence = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substr("c", (i + 33).cast("int"), F.lit(1)), 16, 10).cast("double") / 16)
    return pinned(docs, expected=F.substring("e", 1, size), observed=joined, confidences=confidence).select("doc_id", "expected", "observed", "confidences")


@query("codeword_acceptance", "WITH " + _CODEWORD_SQL.format(n=16, counts="range(0, 9)", parity=8, radius=16))
def codeword_acceptance(spark: SparkSession, folder: str) -> DataFrame:
    rows = _observed(spark, folder, 16)
    return pinned(rows, r=codewords.acceptance(F.col("observed"), F.col("expected"), F.col("confidences"))).select("doc_id", "r.*")


@query("codeword_acceptance_v2", "WITH " + _CODEWORD_SQL.format(n=24, counts="[0, 2, 4, 6]", parity=16, radius=32))
def codeword_acceptance_v2(spark: SparkSession, folder: str) -> DataFrame:
    rows = _observed(spark, folder, 24)
    return pinned(rows, r=codewords.acceptance_v2(F.col("observed"), F.col("expected"), F.col("confidences"))).select("doc_id", "r.*")


@query(
    "codeword_match",
    """WITH docs AS (SELECT doc_id, source, lang, sha256(text) AS e, sha256(text || 'c') AS c, n_chars FROM documents),
obs AS (SELECT doc_id AS query_id, source, doc_id % 7 AS user_id, lang = 'es' AS cross_owner, i, CASE WHEN CAST('0x' || substr(c, CAST(1 + 2 * i AS INTEGER), 2) AS INTEGER) % 17 < n_chars % 7
   THEN CAST('0x' || substr(e, CAST(1 + 2 * i AS INTEGER), 2) AS INTEGER) ELSE xor(CAST('0x' || substr(e, CAST(1 + 2 * i AS INTEGER), 2) AS INTEGER), 1) END AS b, CAST('0x' || substr(c, CAST(33 + i AS INTEGER), 1) AS INTEGER) / 16.0 AS conf,
   row_number() OVER (PARTITION BY doc_id ORDER BY CAST('0x' || substr(c, CAST(33 + i AS INTEGER), 1) AS INTEGER), i) - 1 AS pos FROM docs, (SELECT unnest(range(0, 16)) AS i)),
rec AS (SELECT doc_id AS record_id, source, doc_id % 7 AS owner, i, CAST('0x' || substr(e, CAST(1 + 2 * i AS INTEGER), 2) AS INTEGER) AS b FROM docs, (SELECT unnest(range(0, 16)) AS i) WHERE lang <> 'de'),
m AS (SELECT query_id, record_id, o.source, pos, o.b <> r.b AS wrong, bit_count(xor(o.b, r.b)) AS errs FROM obs o JOIN rec r ON o.source = r.source AND o.i = r.i WHERE o.cross_owner OR o.user_id = r.owner),
t AS (SELECT query_id, record_id, source, CAST(sum(errs) AS INTEGER) AS bit_errors, count(*) FILTER (wrong) AS wrongs, """
    + ", ".join(f"count(*) FILTER (wrong AND pos >= {f}) AS e{f}" for f in range(9))
    + """ FROM m GROUP BY ALL),
a AS (SELECT *, CASE """
    + " ".join(f"WHEN 2 * e{f} + {f} <= 8 THEN {f}" for f in range(9))
    + """ END AS f FROM t),
k AS (SELECT *, e0 <= 4 AS blind, bool_or(e0 <= 4) OVER (PARTITION BY query_id) AS any_blind FROM a WHERE f IS NOT NULL OR bit_errors <= 16)
SELECT query_id, record_id, bit_errors, CAST(coalesce(f, 0) AS INTEGER) AS erasure_count FROM k WHERE blind OR NOT any_blind""",
)
def codeword_match(spark: SparkSession, folder: str) -> DataFrame:
    """Observed codewords against the records of their source; most observations carry one-bit errors."""
    docs = table(spark, folder, "documents")
    full = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))
    marks = F.sha2(F.encode(F.concat("text", F.lit("c")), "UTF-8"), 256)
    group = F.substring("source", 4, 3).cast("bigint").alias("source_group_id")
    base = docs.select("doc_id", "lang", "n_chars", group, F.substring(full, 1, 16).alias("codeword"), marks.alias("c"))
    noisy = F.transform(
        F.arrays_zip(bits.byte_values(F.col("codeword"), 16).alias("e"), bits.byte_values(F.unhex("c"), 16).alias("c")),
        lambda z: F.when(z["c"] % 17 < F.col("n_chars") % 7, z["e"]).otherwise(z["e"].bitwiseXOR(F.lit(1))),
    )
    seen = base.select(
        F.col("doc_id").alias("query_id"), (F.col("doc_id") % 7).alias("user_id"), (F.col("lang") == "es").alias("cross_owner"), "source_group_id",
        F.unhex(F.array_join(F.transform(noisy, lambda b: F.lpad(F.hex(b), 2, "0")), "")).alias("codeword"),
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substr("c", (i + 33).cast("int"), F.lit(1)), 16, 10).cast("double") / 16).alias("confidences"),
    )
    status = F.when(F.col("lang") == "de", F.lit("deleted")).otherwise(F.lit("active")).alias("status")
    stored = base.select(F.col("doc_id").alias("record_id"), (F.col("doc_id") % 7).alias("owner_user_id"), "source_group_id", "codeword", status)
    return hamming.codeword_match(seen, stored).select("query_id", "record_id", "bit_errors", "erasure_count")


# --- Hamming matching ----------------------------------------------------------------------------

_CODES_SQL = f"""{SIGN_SQL}, reg AS (SELECT doc_id, 'trace-' || doc_id AS trace_id, {_MAGIC * 65536} + CAST('0x' || substr(sha256(text), 1, 4) AS BIGINT) AS hi,
   CAST('0x' || substr(sha256(text), 5, 8) AS BIGINT) AS lo FROM documents)"""


def _registry_codes(spark: SparkSession, folder: str) -> DataFrame:
    h = F.sha2(_utf8(), 256)
    code = bits.hex_to_code(F.concat(F.lit(f"{_MAGIC:04x}"), F.substring(h, 1, 12)))
    return table(spark, folder, "documents").select(F.concat(F.lit("trace-"), F.col("doc_id").cast("string")).alias("trace_id"), code.alias("code"), F.col("doc_id").alias("position"))


def _observed_codes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), sign_code().alias("observed"))


@query(
    "hamming_nearest",
    f"""WITH {_CODES_SQL}, gated AS (SELECT *, bit_count(xor(hi >> 16, {_MAGIC})) <= 6 AS passed FROM signs),
       d AS (SELECT vec_id, trace_id, bit_count(xor(g.hi, r.hi)) + bit_count(xor(g.lo, r.lo)) AS distance, doc_id FROM gated g JOIN reg r ON g.passed
             QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, doc_id) = 1)
       SELECT s.vec_id AS query_id, CASE WHEN d.distance <= 22 THEN d.trace_id END AS trace_id, CAST(coalesce(d.distance, 65) AS INTEGER) AS distance FROM signs s LEFT JOIN d USING (vec_id)""",
)
def hamming_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Sign codes of the embeddings against digest codes of the documents (radius 22, so that some hit)."""
    return hamming.hamming_nearest(_observed_codes(spark, folder), _registry_codes(spark, folder), max_errors=22)


@query(
    "exact_code_lookup",
    """SELECT d.doc_id AS query_id, 'trace-' || min(r.doc_id) AS trace_id FROM documents d JOIN documents r ON substr(sha256(r.text), 1, 12) = substr(sha256(d.text), 1, 12)
       WHERE d.lang <> 'de' GROUP BY d.doc_id""",
)
def exact_code_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Document codes looked up in the document registry; German ones carry another magic."""
    h = F.sha2(_utf8(), 256)
    magic = F.when(F.col("lang") == "de", F.lit("0000")).otherwise(F.lit(f"{_MAGIC:04x}"))
    asked = table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), bits.hex_to_code(F.concat(magic, F.substring(h, 1, 12))).alias("observed"))
    return hamming.exact_code_lookup(asked, _registry_codes(spark, folder))


def _payload_hex(digest):
    """Stand-in payload: magic, 16 bits of a digest and their lower half again as the checksum."""
    return F.concat(F.lit(f"{_MAGIC:04x}"), F.substring(digest, 1, 4), F.substring(digest, 1, 4))


def _stand_in_checksum(head):
    return head.bitwiseAND(F.lit(65535).cast("bigint"))


_PAYLOAD_SQL = f"""WITH reg AS (SELECT doc_id, 'trace-' || doc_id AS trace_id, CAST('0x' || substr(sha256(text), 1, 4) AS BIGINT) AS b FROM documents),
   regp AS (SELECT doc_id, trace_id, CAST({_MAGIC} AS BIGINT) * 4294967296 + b * 65536 + b AS p FROM reg),
   obs AS (SELECT doc_id AS query_id, xor(CAST({_MAGIC} AS BIGINT) * 4294967296 + CAST('0x' || substr(sha256(text), 1, 4) AS BIGINT) * 65537, (n_chars % 4) * 4294967296 + (doc_id % 8) * 1048576 + n_chars % 1024) AS p, n_chars % 3 AS corrections FROM documents),
   g AS (SELECT *, bit_count(xor(p >> 32, {_MAGIC})) AS md, bit_count(xor(p & 65535, (p >> 16) & 65535)) AS cd FROM obs),
   d AS (SELECT g.query_id, r.trace_id, r.doc_id, bit_count(xor(g.p, r.p)) AS dist, md, cd, corrections, row_number() OVER (PARTITION BY g.query_id ORDER BY bit_count(xor(g.p, r.p)), r.doc_id) AS rk
         FROM g JOIN regp r ON g.md <= {{magic}} AND g.cd <= {{check}} QUALIFY rk <= 2),
   n AS (SELECT query_id, max(CASE WHEN rk = 1 THEN trace_id END) AS t, max(CASE WHEN rk = 1 THEN dist END) AS d1, max(CASE WHEN rk = 2 THEN dist END) AS d2, any_value(md) AS md, any_value(cd) AS cd, any_value(corrections) AS corrections FROM d GROUP BY 1)
   SELECT query_id, CASE WHEN d1 <= {{distance}} AND d1 + md + cd + corrections <= {{total}} AND d2 - d1 >= {{gap}} THEN t END AS trace_id, CAST(d1 AS INTEGER) AS best_distance, CAST(d2 AS INTEGER) AS second_distance,
     CAST(d1 + md + cd + corrections AS BIGINT) AS total_distance FROM n"""


def _payload_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    h = F.sha2(_utf8(), 256)
    payload = F.conv(_payload_hex(h), 16, 10).cast("bigint")
    docs = table(spark, folder, "documents")
    noise = (F.col("n_chars") % 4) * F.lit(4294967296) + (F.col("doc_id") % 8) * 1048576 + F.col("n_chars") % 1024
    asked = docs.select(F.col("doc_id").alias("query_id"), payload.bitwiseXOR(noise).alias("payload"), (F.col("n_chars") % 3).alias("corrections"))
    stored = docs.select(F.concat(F.lit("trace-"), F.col("doc_id").cast("string")).alias("trace_id"), payload.alias("code"), F.col("doc_id").alias("position"))
    return asked, stored


def _gated(name: str, gates: hamming.PayloadGates) -> None:
    sql = _PAYLOAD_SQL.format(magic=gates.magic, check=gates.checksum, distance=gates.distance, total=gates.total, gap=-99 if gates.gap is None else gates.gap)

    @query(name, sql)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        asked, stored = _payload_rows(spark, folder)
        rows = hamming.gated_payload_match(asked, stored, gates, _stand_in_checksum)
        return rows.withColumn("total_distance", F.col("total_distance").cast("bigint"))


_gated("gated_payload_match", hamming.SMALL_CROP)
_gated("gated_payload_match_code_layer", hamming.CODE_LAYER)
_gated("gated_payload_match_dot_matrix", hamming.DOT_MATRIX)


@query(
    "short_code_match",
    """WITH reg AS (SELECT doc_id, CAST('0x' || substr(sha256(text), 1, 4) AS BIGINT) AS c FROM documents), obs AS (SELECT vec_id AS query_id, CAST('0x' || substr(sha256(CAST(vec_id AS VARCHAR)), 1, 4) AS BIGINT) AS c FROM embeddings),
       d AS (SELECT query_id, doc_id, bit_count(xor(o.c, r.c)) AS dist, row_number() OVER (PARTITION BY query_id ORDER BY bit_count(xor(o.c, r.c)), doc_id) AS rk FROM obs o, reg r QUALIFY rk <= 2),
       n AS (SELECT query_id, max(CASE WHEN rk = 1 THEN doc_id END) AS t, max(CASE WHEN rk = 1 THEN dist END) AS d1, max(CASE WHEN rk = 2 THEN dist END) AS d2 FROM d GROUP BY 1)
       SELECT query_id, CASE WHEN d1 <= 4 AND d2 - d1 >= 2 THEN 'trace-' || t END AS trace_id, CAST(d1 AS INTEGER) AS best_distance, CAST(d2 AS INTEGER) AS second_distance FROM n""",
)
def short_code_match(spark: SparkSession, folder: str) -> DataFrame:
    short = lambda h: F.conv(F.substring(h, 1, 4), 16, 10).cast("bigint")
    stored = table(spark, folder, "documents").select(
        F.concat(F.lit("trace-"), F.col("doc_id").cast("string")).alias("trace_id"), short(F.sha2(_utf8(), 256)).alias("code"), F.col("doc_id").alias("position")
    )
    asked = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), short(F.sha2(F.encode(F.col("vec_id").cast("string"), "UTF-8"), 256)).alias("observed")
    )
    return hamming.short_code_match(asked, stored)


@query(
    "best_second_gap",
    f"""WITH {_CODES_SQL}, d AS (SELECT vec_id, bit_count(xor(g.hi, r.hi)) + bit_count(xor(g.lo, r.lo)) AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY bit_count(xor(g.hi, r.hi)) + bit_count(xor(g.lo, r.lo))) AS rk
         FROM signs g, reg r QUALIFY rk <= 2)
       SELECT vec_id AS query_id, CAST(min(dist) AS INTEGER) AS best_distance, CAST(max(dist) AS INTEGER) AS second_distance, CAST(max(dist) - min(dist) AS INTEGER) AS gap FROM d GROUP BY 1""",
)
def best_second_gap(spark: SparkSession, folder: str) -> DataFrame:
    asked = _observed_codes(spark, folder)
    near = hamming.best_second_gap(hamming.nearest_codes(asked, _registry_codes(spark, folder)))
    return asked.join(near, "observed").select("query_id", "best_distance", "second_distance", "gap")


_KP_SQL = f"""{SIGN_SQL}, kp AS (SELECT vec_id // 20 AS owner, vec_id % 20 AS kp, hi, lo FROM signs),
   d AS (SELECT q.owner AS a, t.owner AS b, q.kp, bit_count(xor(q.hi, t.hi)) + bit_count(xor(q.lo, t.lo)) AS dist, row_number() OVER (PARTITION BY q.owner, t.owner, q.kp ORDER BY bit_count(xor(q.hi, t.hi)) + bit_count(xor(q.lo, t.lo)), t.kp) AS rk
         FROM kp q JOIN kp t ON t.owner BETWEEN q.owner + 1 AND q.owner + 3 QUALIFY rk <= 2),
   g AS (SELECT a, b, kp, max(CASE WHEN rk = 1 THEN dist END) AS d1, max(CASE WHEN rk = 2 THEN dist END) AS d2 FROM d GROUP BY ALL)
   SELECT a || '|' || b AS pair, count(*) FILTER (d1 < 0.9 * d2) AS good_matches, round(count(*) FILTER (d1 < 0.9 * d2) / 20, 6) AS quality FROM g GROUP BY a, b"""


@query("descriptor_ratio_match", f"WITH {_KP_SQL}")
def descriptor_ratio_match(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as 8-byte descriptors, 20 an image; each image is compared with the next three."""
    points = table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 20).cast("string").alias("owner_id"), (F.col("vec_id") % 20).cast("int").alias("kp_idx"), bits.bits_to_bytes(bits.code_bits(sign_code()), 8).alias("descriptor")
    )
    owners = points.select("owner_id").distinct()
    pairs = owners.select(F.col("owner_id").alias("query_owner"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("d")).select(
        "query_owner", (F.col("query_owner").cast("bigint") + F.col("d")).cast("string").alias("target_owner")
    )
    pairs = pairs.join(owners.withColumnRenamed("owner_id", "target_owner"), "target_owner", "left_semi")
    pairs = pairs.withColumn("pair", F.concat_ws("|", "query_owner", "target_owner"))
    return hamming.descriptor_ratio_match(pairs, points, points, 0.9)
