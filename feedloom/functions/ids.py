"""Time-ordered identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Crockford's base 32. A fixed value.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _encode(n: Column, width: int) -> Column:
    digit = lambda i: F.substr(F.lit(ALPHABET), (F.floor(n / F.pow(F.lit(32), F.lit(width) - i)) % 32 + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(width)), digit), "")


def ulid(ms: Column, seq: Column) -> Column:
    """26 characters: ten for the milliseconds, sixteen for a sequence number in place of the random part."""
    return F.concat(_encode(ms, 10), _encode(seq, 16))


def ulid_time(ulid: Column) -> Column:
    """Milliseconds of an identifier; 0 if it is malformed."""
    digits = F.split(F.substring(ulid, 1, 10), "")
    total = F.aggregate(digits, F.lit(0).cast("long"), lambda a, c: a * 32 + F.position(c, F.lit(ALPHABET)) - 1)
    return F.when(F.rlike(ulid, F.lit(f"^[{ALPHABET}]{{26}}$")), total).otherwise(F.lit(0).cast("long"))
