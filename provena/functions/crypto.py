"""Digests and keyed tags as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the message formats.
TAG_MESSAGE_PREFIX = b"trace-v4-authentication-context-v1"
CODEC = "hmac64_rs_16_8_split_repeat_sync_v4"
V3_MESSAGE_PREFIX = b"robust-v3:"
MEDIA_URL_PREFIX = "v4-media-url-v1"
MIN_KEY_BYTES = 32


def as_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a BINARY column under a driver-side key, as BINARY(32)."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    first = F.unhex(F.sha2(F.concat(inner, message), 256))
    return F.unhex(F.sha2(F.concat(outer, first), 256))


def sized_field(data: Column) -> Column:
    """Length as four big-endian bytes, then the bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")), data)


def tag_message(codec: Column, key_id: Column, owner: Column, pixel_sha256: Column, trace_id: Column) -> Column:
    owner_bytes = F.unhex(F.lpad(F.hex(owner.cast("bigint")), 16, "0"))
    fields = [as_bytes(codec), as_bytes(key_id), owner_bytes, pixel_sha256, as_bytes(trace_id)]
    return F.concat(F.lit(bytearray(TAG_MESSAGE_PREFIX)), *map(sized_field, fields))


def _checked(key: bytes) -> bytes:
    if len(key) < MIN_KEY_BYTES:
        raise ValueError("authentication key must contain at least 32 bytes")
    return key


def auth_tag(key: bytes, codec: Column, key_id: Column, owner: Column, pixel_sha256: Column, trace_id: Column) -> Column:
    """8-byte authentication tag of one record context."""
    return F.substring(hmac_sha256(_checked(key), tag_message(codec, key_id, owner, pixel_sha256, trace_id)), 1, 8)


def ring_tag(keys: dict[str, bytes], codec: Column, key_id: Column, owner: Column, pixel_sha256: Column, trace_id: Column) -> Column:
    """Tag under the key named by ``key_id``; NULL for an unknown key."""
    chain = None
    for name, key in keys.items():
        value = auth_tag(key, codec, key_id, owner, pixel_sha256, trace_id)
        chain = F.when(key_id == name, value) if chain is None else chain.when(key_id == name, value)
    return chain


def v3_code(key: bytes, trace_id: Column) -> Column:
    message = F.concat(F.lit(bytearray(V3_MESSAGE_PREFIX)), as_bytes(trace_id))
    return F.substring(hmac_sha256(_checked(key), message), 1, 8)


def file_md5_hex(content: Column) -> Column:
    return F.upper(F.md5(content))


def file_sha256_hex(content: Column) -> Column:
    return F.upper(F.sha2(content, 256))


def file_md5(content: Column) -> Column:
    return F.unhex(F.md5(content))


def file_sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def pixel_sha256_sized(width: Column, height: Column, rgb: Column) -> Column:
    """Upper-hex pixel digest that also covers the dimensions."""
    head = F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":RGB:"))
    return F.upper(F.sha2(F.concat(as_bytes(head), rgb), 256))


def pixel_sha256(rgb: Column) -> Column:
    """Pixel digest without dimensions, as BINARY(32)."""
    return F.unhex(F.sha2(rgb, 256))


def media_signature(key: bytes, media_id: Column, variant: Column, owner: Column, expires: Column) -> Column:
    fields = [F.lit(MEDIA_URL_PREFIX), media_id, variant, owner.cast("string"), expires.cast("string")]
    message = F.concat(*[sized_field(as_bytes(f)) for f in fields])
    return F.lower(F.hex(hmac_sha256(key, message)))


def media_url(key: bytes, base: Column, media_id: Column, variant: Column, owner: Column, expires: Column) -> Column:
    signature = media_signature(key, media_id, variant, owner, expires)
    return F.concat(base, F.lit("/api/media/"), media_id, F.lit("?expires="), expires.cast("string"), F.lit("&signature="), signature)


def media_url_valid(key: bytes, media_id: Column, variant: Column, owner: Column, expires: Column, signature: Column, now: Column) -> Column:
    return (now <= expires) & (media_signature(key, media_id, variant, owner, expires) == signature)


def path_signature(key: bytes, path: Column, expires: Column) -> Column:
    """Older form: version, expiry and path on three lines."""
    message = as_bytes(F.concat(F.lit("v1\n"), expires.cast("string"), F.lit("\n"), path))
    return F.lower(F.hex(hmac_sha256(key, message)))


def path_url(key: bytes, path: Column, expires: Column) -> Column:
    return F.concat(path, F.lit("?expire_time="), expires.cast("string"), F.lit("&signature="), path_signature(key, path, expires))


def report_signature(key: bytes, canonical_json: Column) -> Column:
    return F.lower(F.hex(hmac_sha256(key, as_bytes(canonical_json))))
