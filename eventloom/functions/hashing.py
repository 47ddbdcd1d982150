"""Digests, name-based UUIDs and URL-safe base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INLINE_PREFIX = "inline://json/"


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def dedupe_key(stream_name: Column | str, payload: Column) -> Column:
    """sha256("<stream>:" + sha256(payload))."""
    stream = F.lit(stream_name) if isinstance(stream_name, str) else stream_name
    return sha256_hex(F.concat(stream, F.lit(":"), sha256_hex(payload)))


def batch_checksum(tag: Column, payload: Column) -> Column:
    """sha256 of tag, one zero byte, payload."""
    return F.sha2(F.concat(tag.cast("binary"), F.unhex(F.lit("00")), payload.cast("binary")), 256)


def md5_batch_id(payload: Column) -> Column:
    return F.md5(payload.cast("binary"))


def uuid_from_md5(text: Column) -> Column:
    """Name-based (version 3) UUID of the UTF-8 bytes of ``text``."""
    digest = F.md5(text.cast("binary"))
    variant_nibble = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-3"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant_nibble,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def base64url_encode(text: Column) -> Column:
    """URL-safe base64 of the UTF-8 bytes, without padding."""
    plain = F.base64(text.cast("binary"))
    for part, other in (("\r\n", ""), ("+", "-"), ("/", "_")):  # translate looks up each character
        plain = F.replace(plain, F.lit(part), F.lit(other))
    return F.rtrim(plain, F.lit("="))


def base64url_decode(text: Column) -> Column:
    """UTF-8 text of URL-safe base64, padding optional; NULL when it is not base64."""
    body = F.replace(F.replace(text, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    padding = F.repeat(F.lit("="), F.pmod(F.lit(4) - F.length(body) % 4, F.lit(4)))
    data = F.try_to_binary(F.concat(body, padding), F.lit("base64"))
    return F.when(text.rlike("^[A-Za-z0-9_-]*={0,2}$"), F.make_valid_utf8(data.cast("string")))


def inline_reference(payload: Column) -> Column:
    return F.concat(F.lit(INLINE_PREFIX), base64url_encode(payload))
