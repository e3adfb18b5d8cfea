"""Stable ids and hash-based numbers: the same in every engine that has SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column | str, separator: str = "||", length: int | None = 24) -> Column:
    """First ``length`` hex digits of the SHA-256 of the parts joined by the separator; a null part is empty text."""
    texts = [F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts]
    digest = F.sha2(F.concat_ws(separator, *texts), 256)
    return F.substring(digest, 1, length) if length else digest


def joined_id(*parts: Column, length: int | None = 20) -> Column:
    """First ``length`` hex digits of the SHA-256 of all parts, each with a zero byte behind it; a null part is empty text."""
    texts = [F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\x00")) for p in parts]
    digest = F.sha2(F.concat(*texts), 256)
    return F.substring(digest, 1, length) if length else digest


def unit_hash(text: Column, digits: int = 16, divisor: float | None = None) -> Column:
    """The first hex digits of a SHA-256 as a double in [0, 1); divisor: 2^(4 x digits) unless given."""
    number = F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("decimal(20,0)").cast("double")
    return number / F.lit(divisor or 16.0**digits)


def hash_bucket(text: Column, buckets: int, digits: int = 8) -> Column:
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("long"), F.lit(buckets))
