"""Ids of chunks, and the hashed bucket of a word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(text: Column, suffix: Column) -> Column:
    """The first 16 hex digits of the sha256 of text and suffix."""
    return F.substring(F.sha2(F.concat(text, suffix), 256), 1, 16)


#: Fixed value: the DNS namespace of name-based UUIDs.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The name-based UUID (version 5, DNS namespace) of name: a table's storage key."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), name.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def hash_bucket(word: Column, dims: int) -> Column:
    """md5 of the word, as a number, modulo dims; the digest is cut into three numbers that fit."""
    digest = F.md5(word)
    part = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("bigint") % dims
    wide = pow(2, 60, dims)
    return (part(1, 2) * (wide * wide % dims) + part(3, 15) * wide + part(18, 15)) % dims
