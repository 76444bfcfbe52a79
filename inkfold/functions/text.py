"""Scalar column functions on text, ids, URIs and timestamps. All stay in the JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespace of chunk point ids (fixed value).
POINT_NAMESPACE = uuid.UUID("7b93c9e3-ff1f-4c8f-a3bf-ca3f1bf9a0e0")

# Characters that Python's str.strip removes (fixed values).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPLIT_BUCKETS = 10000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Strip Unicode white space at both ends, as Python's ``str.strip`` does."""
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def chunk_array(c: Column | str, size: int = 500, overlap: int = 50) -> Column:
    """Overlapping character chunks of the stripped text, as an array.

    One regex pass: each match consumes ``size - overlap`` characters and its lookahead captures
    up to ``size``, so a long text costs linear time (a ``substring`` per chunk would rescan the
    text from its start each time)."""
    step = max(size - overlap, 1)
    text = py_strip(c)
    pattern = f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"
    return (
        F.when(F.coalesce(F.char_length(text), F.lit(0)) == 0, F.array().cast("array<string>"))
        .when(F.char_length(text) <= size, F.array(text))
        .otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    )


def point_id(document_id: Column | str, chunk_index: Column | str) -> Column:
    """Name-based (SHA-1) UUID of ``document_id:chunk_index``: the same chunk keeps its id."""
    name = F.concat(_col(document_id).cast("string"), F.lit(":"), _col(chunk_index).cast("string"))
    digest = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE.hex)), F.encode(name, "UTF-8")))
    variant_digit = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(variant_digit.bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def split_bucket(c: Column | str) -> Column:
    """SHA-256 of the id's text, read as one 256-bit number, modulo 10000.

    The number exceeds 64 bits, so it is reduced in eight 32-bit limbs."""
    digest = F.sha2(_col(c).cast("string").cast("binary"), 256)
    total = F.lit(0).cast("bigint")
    for i in range(8):
        limb = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
        weight = pow(16, 8 * (7 - i), SPLIT_BUCKETS)
        total = total + (limb % SPLIT_BUCKETS) * weight
    return total % SPLIT_BUCKETS


def parse_s3_uri(c: Column | str) -> Column:
    """``struct<bucket, key>``; null unless the scheme is s3 and the bucket is not empty.
    Leading slashes of the key go, a trailing one stays."""
    url = F.regexp_replace(_col(c), r"^[\x00-\x20]+|[\t\r\n]", "")
    pattern = r"^(?i:s3)://([^/?#]+)(?:/+([^?#]*))?"
    bucket = F.regexp_extract(url, pattern, 1)
    return F.when(
        bucket != "",
        F.struct(bucket.alias("bucket"), F.regexp_extract(url, pattern, 2).alias("key")),
    )


def normalize_user(c: Column | str) -> Column:
    """Blank user -> null."""
    return F.nullif(_col(c).cast("string"), F.lit(""))


def normalize_session(c: Column | str) -> Column:
    """Blank or missing session -> 'anonymous'."""
    return F.coalesce(F.nullif(_col(c).cast("string"), F.lit("")), F.lit("anonymous"))


def metadata_field(c: Column | str, name: str, default: str | None = None) -> Column:
    """One top-level field of a JSON metadata object; ``default`` where it is absent."""
    value = F.get_json_object(_col(c), f"$.{name}")
    return value if default is None else F.coalesce(value, F.lit(default))


def iso_millis(c: Column | str) -> Column:
    """UTC timestamp as ISO-8601 with milliseconds and 'Z' (the event form)."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_offset(c: Column | str) -> Column:
    """UTC timestamp as ISO-8601 with '+00:00'; microseconds only where not zero (archive form)."""
    ts = _col(c)
    whole = F.unix_micros(ts) % 1000000 == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    )


def date_of(c: Column | str) -> Column:
    """UTC date as YYYY-MM-DD text."""
    return F.date_format(_col(c), "yyyy-MM-dd")
