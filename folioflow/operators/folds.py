"""Order-dependent operators, one page at a time: reading order, words to lines, blocks to lines, flow.

Each is a fold over a page's rows in a stated order, run by ``applyInPandas`` with the page as key; a page is what a
task holds.
"""

from __future__ import annotations

from functools import cmp_to_key

import pandas as pd
from pyspark.sql import DataFrame

PRIORITY = {k: i for i, k in enumerate("title numbered_list paragraph publisher_info address phone isbn barcode price unknown".split())}


def reading_order(blocks: DataFrame) -> DataFrame:
    """(page, id, type, top, lft, height) with no: bands of 0.55 of the greater height, then type, then left.

    The comparison isn't transitive, so the result is that of a stable sort over input order by id.
    """

    def compare(a, b) -> float:
        if abs(a.top - b.top) > max(a.height or 1, b.height or 1) * 0.55:
            return a.top - b.top
        return PRIORITY.get(a.type, 9) - PRIORITY.get(b.type, 9) or a.lft - b.lft

    def one(f: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(f.sort_values("id").itertuples(index=False), key=cmp_to_key(compare))
        return pd.DataFrame([(r.page, r.id, i) for i, r in enumerate(rows)], columns=["page", "id", "no"])

    return blocks.groupBy("page").applyInPandas(one, "page long, id long, no int")


def word_lines(words: DataFrame) -> DataFrame:
    """(page, id, x, y, w, h, text) words to lines (page, line, text, n_words): the first line whose running mean centre is near takes a word."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        lines: list[dict] = []
        for r in f.assign(centre=f["y"] + f["h"] / 2).sort_values(["centre", "x", "id"]).itertuples(index=False):
            line = next((m for m in lines if abs(m["centre"] - r.centre) <= max(3.0, 0.48 * max(r.h, m["h"]))), None)
            if line is None:
                line = {"centre": r.centre, "h": r.h, "words": []}
                lines.append(line)
            line["words"].append(r)
            n = len(line["words"])
            line["centre"] += (r.centre - line["centre"]) / n
            line["h"] = max(line["h"], r.h)
        lines.sort(key=lambda m: m["centre"])
        page = int(f["page"].iloc[0])
        return pd.DataFrame([(page, i, " ".join(w.text for w in sorted(m["words"], key=lambda w: (w.x, w.id))), len(m["words"])) for i, m in enumerate(lines)], columns=["page", "line", "text", "n_words"])

    return words.groupBy("page").applyInPandas(one, "page long, line int, text string, n_words int")


def merged_boxes(boxes: DataFrame, gap_x: float = 12.0, gap_y: float = 6.0) -> DataFrame:
    """(page, id, x, y, w, h) boxes merged with the one before where they nearly touch, from top to bottom."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        out: list[list[float]] = []
        for r in f.sort_values(["y", "x", "id"]).itertuples(index=False):
            if out:
                a = out[-1]
                if r.x <= a[2] + gap_x and r.x + r.w >= a[0] - gap_x and r.y <= a[3] + gap_y:
                    out[-1] = [min(a[0], r.x), min(a[1], r.y), max(a[2], r.x + r.w), max(a[3], r.y + r.h)]
                    continue
            out.append([r.x, r.y, r.x + r.w, r.y + r.h])
        page = int(f["page"].iloc[0])
        return pd.DataFrame([(page, i, a, b, c - a, d - b) for i, (a, b, c, d) in enumerate(out)], columns=["page", "no", "x", "y", "w", "h"])

    return boxes.groupBy("page").applyInPandas(one, "page long, no int, x double, y double, w double, h double")


def cover_groups(blocks: DataFrame) -> DataFrame:
    """(page, id, type, text, confidence, top, lft, height): blocks of one line as one, unless protected; least confidence holds."""
    protected = {"person_name", "school_name", "organization_name", "class_level"}

    def one(f: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in f.sort_values(["top", "lft", "id"]).itertuples(index=False):
            p = out[-1] if out else None
            if p and abs(p["top"] - r.top) <= max(6.0, r.height * 0.42) and abs(p["height"] - r.height) <= max(8.0, r.height * 0.5) and r.type == p["type"] and r.type not in protected:
                p["text"] = f"{p['text']} {r.text}".strip()
                p["confidence"] = min(p["confidence"], r.confidence)
                p["n"] += 1
            else:
                out.append({"page": r.page, "type": r.type, "text": r.text, "confidence": r.confidence, "top": r.top, "height": r.height, "n": 1})
        return pd.DataFrame([(g["page"], i, g["type"], g["text"], g["confidence"], g["n"]) for i, g in enumerate(out)], columns=["page", "no", "type", "text", "confidence", "n"])

    return blocks.groupBy("page").applyInPandas(one, "page long, no int, type string, text string, confidence double, n int")


def pdf_lines(items: DataFrame) -> DataFrame:
    """(page, id, x, y, w, h, text) items of a PDF page, y upwards, to its text: lines by height, blanks at gaps, an empty line at wide ones."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        lines: list[dict] = []
        for r in f.sort_values(["y", "x", "id"], ascending=[False, True, True]).itertuples(index=False):
            line = lines[-1] if lines and abs(lines[-1]["y"] - r.y) <= max(2.5, 0.45 * r.h) else None
            if line is None:
                lines.append(line := {"y": r.y, "h": r.h, "items": []})
            line["items"].append(r)
        text, before = [], None
        for line in lines:
            if before and before["y"] - line["y"] > 1.75 * max(line["h"], before["h"]):
                text.append("")
            s, end = "", None
            for r in sorted(line["items"], key=lambda r: (r.x, r.id)):
                if end is not None and r.x - end > max(2.5, 0.18 * r.h) and r.text[:1] not in ",.;:!?)":
                    s += " "
                s, end = s + r.text, r.x + r.w
            text.append(s)
            before = line
        return pd.DataFrame([(int(f["page"].iloc[0]), "\n".join(text))], columns=["page", "text"])

    return items.groupBy("page").applyInPandas(one, "page long, text string")
