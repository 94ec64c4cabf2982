"""64-bit fingerprints held in signed longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 64

# Fixed values ---------------------------------------------------------------------------------------------------------
EXACT_LABEL = "Exata (100%)"
VISUAL_LABEL = "Visual (Perceptual)"
MIXED_LABEL = "Exata + Visual"
CASE_VISUAL_LABEL = "Visual"
LEGACY_THRESHOLD = 8
PHASE_THRESHOLD = 2
# ----------------------------------------------------------------------------------------------------------------------


def hex_to_long(c: Column) -> Column:
    """Sixteen hex digits as a two's-complement long (Spark has no unsigned long)."""
    return F.conv(c, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(distance: Column) -> Column:
    """Percentage with one decimal, ties to even."""
    return F.bround(F.greatest(F.lit(0.0), (1 - distance / HASH_BITS) * 100), 1)


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)
