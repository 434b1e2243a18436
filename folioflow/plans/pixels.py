"""Image kernels on small images against SQL over their pixels.

Every hundred parts are an image of ten by ten; colours come from part keys, every seventh row is dark.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.plans.registry import query
from folioflow.providers import images, recognise
from folioflow.session import table

SIDE = 10
_COLOURS = ", ".join(f"CASE WHEN y % 7 = 3 AND x < 3 + image % 7 THEN {dark} ELSE (k * {a} + {b}) % 256 END AS {name}" for name, a, b, dark in (("r", 37, 11, 20), ("g", 91, 13, 30), ("b", 151, 7, 10)))
PIXELS = f"(SELECT image, y, x, {_COLOURS} FROM (SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS image, CAST(floor(p_partkey % 100 / 10) AS INT) AS y, CAST(p_partkey % 10 AS INT) AS x, p_partkey * 7 AS k FROM part) AS p)"

KERNELS = {
    "grey": images.grey, "blue": images.blue, "mean_threshold": lambda x: images.mean_threshold(images.grey(x)), "text_mask": lambda x: images.text_mask(images.grey(x)), "contrast": lambda x: images.contrast(images.grey(x)), "colour_mask": images.colour_mask,
    "sharpen": lambda x: images.sharpen(images.grey(x)), "flattened": lambda x: images.flattened(images.grey(x), 2), "adaptive": lambda x: images.adaptive(images.grey(x), 2), "threshold": lambda x: images.variant(x, "threshold"),
}


def _images(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(f"SELECT image, transform(sort_array(collect_list(struct(y, x, r, g, b))), p -> array(p.r, p.g, p.b)) AS pixels FROM {PIXELS} AS a GROUP BY image")


def _each(rows: DataFrame, make, schema: str) -> DataFrame:
    """Rows of ``make(image, rgb)`` for each image."""

    def run(frames):
        import pandas as pd

        for f in frames:
            out = [r for i, p in zip(f["image"], f["pixels"], strict=True) for r in make(i, np.array([list(c) for c in p], np.uint8).reshape(SIDE, SIDE, 3))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(run, schema)


_GREY = f"(SELECT image, y, x, r, g AS green, b, CAST(floor(r * 0.299e0 + g * 0.587e0 + b * 0.114e0 + 0.5e0) AS INT) AS g FROM {PIXELS} AS a)"
_NEAR = lambda radius: f"(SELECT a.image, a.y, a.x, avg(b.g * 1e0) AS m, avg(CASE WHEN b.g < 100 THEN 1e0 ELSE 0e0 END) AS dark FROM {_GREY} AS a JOIN {_GREY} AS b ON b.image = a.image AND abs(b.y - a.y) <= {radius} AND abs(b.x - a.x) <= {radius} GROUP BY a.image, a.y, a.x)"
_OTSU = f"""(SELECT image, CAST(least(255, greatest(0, coalesce(min(CASE WHEN between_ = top AND between_ IS NOT NULL THEN g END), 160))) AS INT) AS t FROM (SELECT *, max(between_) OVER (PARTITION BY image) AS top FROM
    (SELECT image, g, CASE WHEN n < total THEN n * (total - n) * ((s / n - (sums - s) / (total - n)) ** 2) END AS between_ FROM (SELECT image, g, sum(c) OVER w * 1e0 AS n, sum(c * g) OVER w * 1e0 AS s, sum(c) OVER (PARTITION BY image) * 1e0 AS total, sum(c * g) OVER (PARTITION BY image) * 1e0 AS sums FROM (SELECT image, g, count(*) AS c FROM {_GREY} AS h GROUP BY image, g) AS i WINDOW w AS (PARTITION BY image ORDER BY g)) AS j) AS k) AS l GROUP BY image)"""
_CLIP = lambda x: f"CAST(least(255e0, greatest(0e0, round_even({x}, 0))) AS INT)"
_SIDES = " + ".join(f"coalesce({f}(g) OVER (PARTITION BY image, {keep} ORDER BY {move}), g)" for f, move, keep in (("lag", "y", "x"), ("lead", "y", "x"), ("lag", "x", "y"), ("lead", "x", "y")))
_INK = "(r > 205 AND green > 205 AND b > 205) OR (r > 120 AND r - b > 45 AND green > 70) OR (r < 90 AND green < 90 AND b < 90)"


@query(
    "image_kernels",
    f"""WITH g AS (SELECT *, avg(g * 1e0) OVER (PARTITION BY image) AS mean, {_SIDES} AS sides FROM {_GREY} AS a), n AS (SELECT * FROM {_NEAR(2)} AS b), t AS (SELECT * FROM {_OTSU} AS c),
    v AS (SELECT g.image, g.y, g.x, unnest(['grey', 'blue', 'mean_threshold', 'text_mask', 'contrast', 'colour_mask', 'sharpen', 'flattened', 'adaptive', 'threshold']) AS kernel, unnest([g.g, {_CLIP('128 + (b - (r + green) / 2e0) * 1.8e0')}, CASE WHEN g.g < mean - 8 THEN 0 ELSE 255 END, CASE WHEN g.g < mean - 28 THEN 0 ELSE 255 END, {_CLIP('(g.g - 128e0) * 1.4e0 + 128')}, CASE WHEN {_INK} THEN 0 ELSE 255 END,
      {_CLIP('2.8e0 * g.g - 0.45e0 * sides')}, {_CLIP('128 + (g.g - m) * 2.25e0')}, CASE WHEN g.g < m - 9 THEN 0 ELSE 255 END, CASE WHEN g.g < t.t THEN 0 ELSE 255 END]) AS v FROM g JOIN n ON n.image = g.image AND n.y = g.y AND n.x = g.x JOIN t ON t.image = g.image)
    SELECT image, kernel, sum(v)::BIGINT AS total, sum(v * (1 + y * 10 + x))::BIGINT AS weighted FROM v GROUP BY image, kernel""",
)
def image_kernels(spark, sf_dir):
    """What the kernels make of each image: sums over its pixels, plain and weighted by place."""
    weight = 1 + np.arange(SIDE * SIDE).reshape(SIDE, SIDE)

    def make(i, rgb):
        for name, f in KERNELS.items():
            v = f(rgb).astype(np.int64)
            yield i, name, int(v.sum()), int((v * weight).sum())

    return _each(_images(spark, sf_dir), make, "image long, kernel string, total long, weighted long")


@query(
    "image_measures",
    f"""WITH g AS (SELECT * FROM {_GREY} AS a), rows_ AS (SELECT image, y, count(*) FILTER (WHERE g < 165) AS dark FROM g GROUP BY image, y), n AS (SELECT image, sum(dark) AS near_ FROM {_NEAR(1)} AS b GROUP BY image)
    SELECT t.image, t.t AS otsu, round(CASE WHEN p.total < 0.3 THEN 0e0 ELSE p.score END, 6) AS projection, round(n.near_, 6) AS dark_near FROM {_OTSU} AS t JOIN (SELECT image, sum(dark) AS total, var_pop(dark) AS score FROM rows_ GROUP BY image) AS p ON p.image = t.image JOIN n ON n.image = t.image""",
)
def image_measures(spark, sf_dir):
    """Threshold, evenness of rows, and how much dark lies near each pixel."""

    def make(i, rgb):
        g = images.grey(rgb)
        yield i, images.otsu(g), round(images.projection_score(g), 6), round(float(images.dark_near(g < 100).sum()), 6)

    return _each(_images(spark, sf_dir), make, "image long, otsu int, projection double, dark_near double")


@query(
    "dark_runs",
    f"""WITH d AS (SELECT image, y, x FROM {_GREY} AS a WHERE g < 100), i AS (SELECT image, y, x, sum(new) OVER (PARTITION BY image, y ORDER BY x) AS run FROM (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY image, y ORDER BY x) <= 2 THEN 0 ELSE 1 END AS new FROM d) AS b),
    l AS (SELECT image, y, max(n) AS longest FROM (SELECT image, y, run, max(x) - min(x) + 1 AS n FROM i GROUP BY image, y, run) AS c GROUP BY image, y)
    SELECT p.image, p.y, coalesce(l.longest, 0)::INT AS longest FROM (SELECT DISTINCT image, y FROM {PIXELS} AS q) AS p LEFT JOIN l ON l.image = p.image AND l.y = p.y""",
)
def dark_runs(spark, sf_dir):
    """The longest dark run of each row, bridging single gaps."""

    def make(i, rgb):
        dark = images.grey(rgb) < 100
        return [(i, y, images.longest_run(dark[y], 1)) for y in range(SIDE)]

    return _each(_images(spark, sf_dir), make, "image long, y int, longest int")


@query("region_hashes", "SELECT count(*) AS n, count(DISTINCT p_name || '|' || p_size) AS n_distinct FROM part")
def region_hashes(spark, sf_dir):
    """Keys of regions: as many as there are different regions."""

    def run(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"h": [images.region_hash([a, b]) for a, b in zip(f["p_name"], f["p_size"], strict=True)]})

    t = table(spark, sf_dir, "part").select("p_name", F.col("p_size").cast("string").alias("p_size"))
    return t.mapInPandas(run, "h string").agg(F.count("*").alias("n"), F.countDistinct("h").alias("n_distinct"))


def dark_pixels(image, language: str) -> tuple[str, float]:
    """A provider that reads how many pixels are dark, and is the surer the more there are."""
    n = int((image < 100).sum())
    return f"{n} dark", min(0.99, n / 200)


_TRIES = "[1, 4, 16, 36]"


@query(
    "recognised_regions",
    f"""WITH n AS (SELECT image, count(*) FILTER (WHERE g < 100) AS n FROM {_GREY} AS a GROUP BY image),
    t AS (SELECT image, unnest(range(4)) + 1 AS no, unnest({_TRIES}) * n AS dark FROM n), c AS (SELECT *, least(0.99e0, dark / 200e0) AS confidence FROM t),
    f AS (SELECT image, max(confidence) < 0.88 AS again FROM c WHERE no <= 2 GROUP BY image), b AS (SELECT c.*, again, row_number() OVER (PARTITION BY c.image ORDER BY confidence DESC, no) AS best FROM c JOIN f ON f.image = c.image WHERE again OR no <= 2)
    SELECT image AS region_id, CASE WHEN image % 3 = 2 THEN 'confirmed_non_text' WHEN confidence >= 0.88 THEN 'verified' ELSE 'review_required' END AS status, CASE WHEN image % 3 = 2 THEN '' ELSE dark || ' dark' END AS text, CASE WHEN image % 3 = 2 THEN 0e0 ELSE round(confidence, 6) END AS confidence, CASE WHEN image % 3 = 2 THEN 0 WHEN again THEN 4 ELSE 2 END::BIGINT AS n_attempts FROM b WHERE best = 1""",
)
def recognised_regions(spark, sf_dir):
    """Regions through a provider: what is no text is skipped, two quick tries, two more where they aren't sure, review below that."""
    grey = _each(_images(spark, sf_dir), lambda i, rgb: [(i, images.grey(rgb).tobytes())], "region_id long, image binary")
    regions = grey.select("region_id", F.when(F.col("region_id") % 3 == 2, "logo").otherwise("text").alias("region_type"), F.lit("tha").alias("language"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), "image")
    found = recognise.recognise(regions, dark_pixels, ("original", "upscale2"), ("upscale4", "upscale6"))
    return found.withColumn("confidence", F.round("confidence", 6))
