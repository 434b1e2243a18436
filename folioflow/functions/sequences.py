"""Edit distance over sequences of words or clusters, and the error rates that rest on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from folioflow.functions.text import graphemes, trim


def distance(a: list, b: list) -> int:
    """Edits between two sequences, a row of the table at a time."""
    codes: dict = {}
    left, right = (np.array([codes.setdefault(x, len(codes)) for x in seq], np.int64) for seq in (a, b))
    steps = np.arange(len(right) + 1)
    row = steps
    for i, x in enumerate(left, 1):
        best = np.minimum(row[:-1] + (right != x), row[1:] + 1)
        row = np.minimum.accumulate(np.append(i, best) - steps) + steps
    return int(row[-1])


@F.pandas_udf(IntegerType())
def sequence_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def words(x: Column) -> Column:
    t = trim(F.coalesce(x, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def text_metrics(truth: Column, read: Column) -> Column:
    """STRUCT cer, wer, grapheme_error of a reading against the truth; rates are shares of the truth's length, of 1 at least."""
    rate = lambda d, n: d / F.greatest(F.lit(1), n)
    return F.struct(
        rate(F.levenshtein(F.coalesce(truth, F.lit("")), F.coalesce(read, F.lit(""))), F.length(F.coalesce(truth, F.lit("")))).alias("cer"),
        rate(sequence_distance(words(truth), words(read)), F.size(words(truth))).alias("wer"),
        rate(sequence_distance(graphemes(truth), graphemes(read)), F.size(graphemes(truth))).alias("grapheme_error"),
    )
