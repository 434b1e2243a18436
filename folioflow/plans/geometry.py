"""Geometry of pages: boxes that overlap, nearest neighbours, clusters of positions, percentiles."""

from __future__ import annotations

from folioflow.plans.dialect import both

_BOX = "p_partkey AS id, CAST(floor(p_partkey / 12) AS BIGINT) AS page, (p_partkey * 53) % 37 * 1e0 AS x, (p_partkey * 29) % 23 * 1e0 AS y, 40e0 + p_partkey % 60 AS w, 20e0 + p_partkey % 40 AS h"


def boxes(rest: int | None = None) -> str:
    """All boxes, or by role: what was predicted (0), what is true (1), barcodes (2)."""
    return f"(SELECT {_BOX} FROM part{'' if rest is None else f' WHERE p_partkey % 3 = {rest}'})"


INTER = "greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
IOU = f"({INTER}) / (a.w * a.h + b.w * b.h - ({INTER}))"
SMALLER = f"({INTER}) / least(a.w * a.h, b.w * b.h)"


@both("region_iou")
def region_iou(d):
    """Pairs of predicted and true boxes of a page that overlap by at least 0.35 of their union."""
    return f"SELECT a.id AS predicted, b.id AS truth, round(CAST({IOU} AS DOUBLE), 6) AS iou FROM {boxes(0)} AS a JOIN {boxes(1)} AS b ON a.page = b.page AND {IOU} >= 0.35"


@both("region_precision_recall")
def precision_recall(d):
    p = f"(SELECT count(*) AS n, {d.if_('hit')} AS hits FROM (SELECT a.id, max(CASE WHEN {IOU} >= 0.35 THEN 1 ELSE 0 END) = 1 AS hit FROM {boxes(0)} AS a LEFT JOIN {boxes(1)} AS b ON a.page = b.page GROUP BY a.id) AS u)"
    r = f"(SELECT count(*) AS n, {d.if_('hit')} AS hits FROM (SELECT b.id, max(CASE WHEN {IOU} >= 0.35 THEN 1 ELSE 0 END) = 1 AS hit FROM {boxes(1)} AS b LEFT JOIN {boxes(0)} AS a ON a.page = b.page GROUP BY b.id) AS v)"
    return f"SELECT round(p.hits * 1.0 / p.n, 6) * 1e0 AS precision_share, round(r.hits * 1.0 / r.n, 6) * 1e0 AS recall_share FROM {p} AS p CROSS JOIN {r} AS r"


@both("overlap_antijoin")
def overlap_antijoin(d):
    """Regions that no barcode of the page covers by more than 0.22 of the smaller box."""
    return f"SELECT a.id, a.page FROM {boxes(0)} AS a WHERE NOT EXISTS (SELECT 1 FROM {boxes(2)} AS b WHERE b.page = a.page AND b.w < 48 AND {SMALLER} > 0.22)"


@both("duplicate_zones")
def duplicate_zones(d):
    """Boxes that an earlier box of the page covers by at least 0.55 of the smaller one."""
    return f"SELECT DISTINCT a.id FROM {boxes()} AS a JOIN {boxes()} AS b ON a.page = b.page AND b.id < a.id AND {SMALLER} >= 0.55"


@both("barcode_nearest")
def barcode_nearest(d):
    """For each barcode the block of its page whose vertical centre is nearest."""
    far = "abs((a.y + a.h / 2) - (b.y + b.h / 2))"
    return f"SELECT id, block, CAST(distance AS DOUBLE) AS distance FROM (SELECT b.id, a.id AS block, {far} AS distance, row_number() OVER (PARTITION BY b.id ORDER BY {far}, a.id) AS no FROM {boxes(2)} AS b JOIN {boxes(0)} AS a ON a.page = b.page) AS c WHERE no = 1"


@both("normalized_boxes")
def normalized_boxes(d):
    """Boxes held within a page of 90 by 50, at least one unit wide and high."""
    return f"SELECT id, x, y, greatest(1.0, least(x + w, 90e0) - x) AS w, greatest(1.0, least(y + h, 50e0) - y) AS h FROM {boxes()} AS a"


@both("deduped_lines")
def deduped_lines(d):
    """Of words at one place, to three units, with one text the last; with how much of the page the words cover."""
    key = "page, CAST(round(x / 3) AS BIGINT), CAST(round(y / 3) AS BIGINT), p_name"
    rows = f"(SELECT {_BOX}, p_name FROM part)"
    kept = f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY id DESC) AS no FROM {rows} AS a)"
    return f"SELECT page, count(*) AS n_words, round(CAST(least(1.0, sum(w * h) / (140e0 * 90e0)) AS DOUBLE), 6) AS coverage FROM {kept} AS b WHERE no = 1 GROUP BY page"


@both("position_clusters")
def position_clusters(d):
    """Positions of a page in clusters wherever the gap is over 1: rounded mean and size of each."""
    gaps = f"(SELECT page, y, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y, id) <= 1 THEN 0 ELSE 1 END AS new, id FROM (SELECT {_BOX} FROM part) AS a)"
    return f"SELECT page, CAST(c AS BIGINT) AS cluster, CAST(floor(avg(y) + 0.5) AS BIGINT) AS position, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y, id) AS c FROM {gaps} AS g) AS h GROUP BY page, c"


@both("active_runs")
def active_runs(d):
    """Runs of orders over a threshold in a customer's sequence, two or more long, bridging a gap of one."""
    on = "(SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_totalprice > 40000 AS hot FROM orders)"
    runs = f"(SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY o_custkey ORDER BY i) <= 2 THEN 0 ELSE 1 END AS new FROM {on} AS a WHERE hot)"
    return f"SELECT o_custkey, min(i) AS first_i, max(i) AS last_i, max(i) - min(i) + 1 AS length FROM (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY i) AS run FROM {runs} AS b) AS c GROUP BY o_custkey, run HAVING max(i) - min(i) + 1 >= 2"


@both("nearest_rank")
def nearest_rank(d):
    """Nearest-rank percentiles, mean and deviation of heights on each page."""
    at = lambda q: d.sorted_at("h", f"least(count(*) - 1, floor(count(*) * {q}))")
    return f"SELECT page, CAST({at(0.5)} AS DOUBLE) AS p50, CAST({at(0.58)} AS DOUBLE) AS p58, CAST({at(0.9)} AS DOUBLE) AS p90, round(CAST(avg(h) AS DOUBLE), 6) AS mean, round(CAST(stddev_pop(h) AS DOUBLE), 6) AS deviation FROM (SELECT {_BOX} FROM part) AS a GROUP BY page"


@both("layout_text")
def layout_text(d):
    """Lines of a page from top to bottom; an empty line where the gap is over 1.25 line heights."""
    w = "OVER (PARTITION BY page ORDER BY y, x, id)"
    lines = f"(SELECT page, id, x, y, p_name, CASE WHEN 60 * y - (60 * lag(y) {w} + lag(h) {w}) > 1.25 * greatest(h, lag(h) {w}) THEN chr(10) || p_name ELSE p_name END AS t FROM (SELECT {_BOX}, p_name FROM part) AS a)"
    return f"SELECT page, {d.agg('t', chr(10), 'y, x, id')} AS text FROM {lines} AS b GROUP BY page"
