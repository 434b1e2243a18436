"""Held-out rows, told by a checksum of the document's number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(folds: int = 5, fold: int = 0, key: str = "doc_id") -> Column:
    """True where crc32 of the number as text, modulo ``folds``, is ``fold``; a null number counts as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(True))
