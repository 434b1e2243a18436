"""Recognition of regions through a provider: gate first, distinct work only, a fast pass, a retry only where it failed.

A provider is any picklable function ``(image, language) -> (text, confidence 0-1)``. The gate is column expressions, so regions
that are no text never reach Python; equal crops are recognised once and joined back.
"""

from __future__ import annotations

import concurrent.futures
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.providers import images

Provider = Callable[[np.ndarray, str], tuple[str, float]]
FAST, RETRY, ACCEPT, SECONDS = ("original", "upscale2"), ("upscale4", "clahe"), 0.88, 15.0


def fake_provider(image: np.ndarray, language: str) -> tuple[str, float]:
    """A stand-in that reads the count of dark runs: deterministic, for tests and dry runs."""
    dark = images.binary(images.grey(image))
    n = len(images.components(dark))
    return f"{n} marks", min(0.99, 0.5 + image.shape[0] / 400)


def _attempts(provider: Provider, names: tuple[str, ...], seconds: float):
    def run(frames):
        pool = concurrent.futures.ThreadPoolExecutor(1)
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                image = np.frombuffer(r.image, np.uint8).reshape(r.height, r.width)
                for no, name in enumerate(names):
                    try:
                        text, confidence = pool.submit(provider, images.variant(image, name), r.language).result(seconds)
                    except concurrent.futures.TimeoutError:
                        pool, text, confidence = concurrent.futures.ThreadPoolExecutor(1), "", 0.0
                    out.append((r.work, name, no, text, float(confidence)))
            yield pd.DataFrame(out, columns=["work", "name", "attempt_no", "text", "confidence"])

    return run


def recognise(regions: DataFrame, provider: Provider, fast: tuple[str, ...] = FAST, retry: tuple[str, ...] = RETRY, accept: float = ACCEPT, seconds: float = SECONDS) -> DataFrame:
    """(region_id, region_type, language, height, width, image: grey bytes) to (region_id, status, text, confidence, n_attempts).

    Attempts are scored by confidence and length; the first of equals stays. What the retry leaves below ``accept`` goes to
    review, never away.
    """
    text = F.coalesce(F.col("region_type") == "text", F.lit(False))
    gated = regions.where(text).withColumn("work", F.sha2(F.concat_ws("|", F.col("image"), "language", "height", "width"), 256))
    work = gated.groupBy("work").agg(F.first("image").alias("image"), F.first("language").alias("language"), F.first("height").alias("height"), F.first("width").alias("width"))
    kind = "work string, name string, attempt_no int, text string, confidence double"
    score = F.col("confidence") * 0.58 + F.when(F.length("text") >= 3, 0.08).otherwise(0.0)
    best = lambda a: a.withColumn("no", F.row_number().over(Window.partitionBy("work").orderBy(score.desc(), "attempt_no"))).where("no = 1").select("work", "text", "confidence")
    first = work.mapInPandas(_attempts(provider, fast, seconds), kind)
    weak = best(first).where(F.col("confidence") < accept).select("work")
    second = work.join(weak, "work", "left_semi").mapInPandas(_attempts(provider, retry, seconds), kind).withColumn("attempt_no", F.col("attempt_no") + len(fast))
    every = first.unionByName(second)
    chosen = best(every).join(every.groupBy("work").agg(F.count(F.lit(1)).alias("n_attempts")), "work")
    read = gated.join(chosen, "work").select("region_id", F.when(F.col("confidence") >= accept, "verified").otherwise("review_required").alias("status"), "text", "confidence", "n_attempts")
    skipped = regions.where(~text).select("region_id", F.lit("confirmed_non_text").alias("status"), F.lit("").alias("text"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("n_attempts"))
    return read.unionByName(skipped)
