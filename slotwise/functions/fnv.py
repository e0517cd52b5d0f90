"""FNV-1a, 64 bits, of UTF-8 strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the hash: the offset basis that cache sketches here start from, the published one, and the prime.
OFFSET, PUBLISHED_OFFSET, PRIME = 1469598103934665603, 0xCBF29CE484222325, 0x100000001B3


def fnv1a(text: str, offset: int = OFFSET) -> int:
    h = offset
    for b in text.encode():
        h = ((h ^ b) * PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_64(text: Column | str, offset: int = OFFSET) -> Column:
    """As a signed long; null stays null."""

    @F.pandas_udf(T.LongType())
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else (fnv1a(t, offset) + (1 << 63)) % (1 << 64) - (1 << 63)).astype("Int64")

    return hashed(text)
