"""Order-free SHA-256 digests that merge, so they run as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNKS = 8  # 8 x 32 bit; 64-bit chunks would overflow a signed long


def _chunk(hexdigest: Column, i: int) -> Column:
    return F.conv(F.substring(hexdigest, 8 * i + 1, 8), 16, 10).cast("long")


def xor_sha256(text: Column) -> Column:
    """Aggregate: XOR of the SHA-256 of every non-null ``text``, as 64 hex digits."""
    digest = F.sha2(text, 256)
    parts = [
        F.lpad(F.lower(F.hex(F.coalesce(F.bit_xor(_chunk(digest, i)), F.lit(0)))), 8, "0")
        for i in range(_CHUNKS)
    ]
    return F.concat(*parts)


def counted_digest(text: Column) -> Column:
    """Aggregate: ``count:xor`` signature of a set of lines."""
    return F.concat(F.count(text).cast("string"), F.lit(":"), xor_sha256(text))
