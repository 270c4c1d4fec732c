"""Column expressions that several text operators share; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of `[^\\x20\\x09-\\x0D]+`; 0 for null: the parts between white space, less an empty first and last."""
    parts = F.split(text, WHITE)
    inner = F.size(parts)
    return (F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(inner - F.rlike(text, F.lit(r"^[\x20\x09-\x0D]")).cast("int") - (F.rlike(text, F.lit(r"[\x20\x09-\x0D]\z")) & (inner > 1)).cast("int"))).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on `parts` alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))
