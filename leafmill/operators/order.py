"""Panels, reading order and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.grouped import Rows, grouped


def assign_panels(items: DataFrame, panels: DataFrame) -> DataFrame:
    """The panel of each item: the first that holds its centre, else the one with the nearest centre.

    ``panels`` is a page layout of fixed size (panel_idx, px0, py0, px1, py1)."""
    cx2, cy2 = F.col("x0") + F.col("x1"), F.col("y0") + F.col("y1")
    layout = panels.agg(F.array_sort(F.collect_list(F.struct("panel_idx", "px0", "py0", "px1", "py1"))).alias("layout"))
    # the layout is one small row: each item picks among its panels without meeting other items

    def rank(p) -> Column:
        inside = cx2.between(2 * p["px0"], 2 * p["px1"]) & cy2.between(2 * p["py0"], 2 * p["py1"])
        far = F.pow(p["px0"] + p["px1"] - cx2, 2) + F.pow(p["py0"] + p["py1"] - cy2, 2)
        return F.struct((~inside).cast("int").alias("out"), F.when(inside, 0.0).otherwise(far).alias("far"), p["panel_idx"].alias("panel_idx"))

    return items.join(F.broadcast(layout)).select(*items.columns, F.array_min(F.transform("layout", rank))["panel_idx"].alias("panel_idx"))


def row_major(boxes: list[tuple], overlap: float) -> list[int]:
    """Places of boxes (x0, y0, x1, y1) in reading order.

    Rows grow by vertical overlap; then a box that stands between the items of an earlier row and
    starts less than 25 below its end moves into it, until nothing moves."""
    rows: list[list] = []  # [top, bottom, members]
    for i in sorted(range(len(boxes)), key=lambda i: boxes[i][1]):
        _, top, _, bottom = boxes[i]
        for row in rows:
            span = min(row[1] - row[0], bottom - top)
            if span > 0 and max(0, min(row[1], bottom) - max(row[0], top)) / span >= overlap:
                row[0], row[1] = min(row[0], top), max(row[1], bottom)
                row[2].append(i)
                break
        else:
            rows.append([top, bottom, [i]])
    moved = True
    while moved:
        moved = False
        for r, row in enumerate(rows[:-1]):
            left, right = min(boxes[i][0] for i in row[2]), max(boxes[i][2] for i in row[2])
            limit = row[1] + 25
            pulled = [(other, i) for other in rows[r + 1 :] for i in other[2] if left <= boxes[i][0] and boxes[i][2] <= right and boxes[i][1] < limit]
            for other, i in pulled:
                other[2].remove(i)
                row[2].append(i)
                row[0], row[1] = min(row[0], boxes[i][1]), max(row[1], boxes[i][3])
            if pulled:
                rows = [x for x in rows if x[2]]
                moved = True
                break
    rows.sort(key=lambda x: x[0])
    return [i for row in rows for i in sorted(row[2], key=lambda i: (boxes[i][0], boxes[i][1]))]


def reading_order(items: DataFrame, key: list[str], overlap: float = 0.25) -> DataFrame:
    """(key, seq, place): places from 1 within each group; a group is one page or panel."""
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}

    def order(rows: Rows) -> Rows:
        at = row_major(list(zip(rows["x0"], rows["y0"], rows["x1"], rows["y1"])), overlap)
        return {c: [rows[c][i] for i in at] for c in [*key, "seq"]} | {"place": list(range(1, len(at) + 1))}

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*key, "seq"]) + ", place int"
    return grouped(items.select(*key, "seq", "x0", "y0", "x1", "y1"), key, ["seq"], order, schema)


def page_reading_order(items: DataFrame, panels: DataFrame) -> DataFrame:
    """Panel of each item and its reading index on the page: panels in order, each read whole."""
    boxed = assign_panels(items.select("page_id", "seq", "x0", "y0", "x1", "y1"), panels)
    placed = reading_order(boxed, ["page_id", "panel_idx"])
    index = F.row_number().over(Window.partitionBy("page_id").orderBy("panel_idx", "place"))
    return placed.select("page_id", "seq", "panel_idx", "place", index.alias("reading_index"))


def baseline_order(items: DataFrame, share: float = 0.45, least: float = 8.0) -> DataFrame:
    """(page_id, seq, row, place): rows of lines that share a baseline, read from the left.

    Lines come by the height of their middle; a line joins the first row whose mean middle is nearer
    than ``share`` of the page's median line height. The mean moves as lines join, so each page is
    one group of its (few) lines."""

    def order(rows: Rows) -> Rows:
        heights = sorted(max(1, b - a) for a, b in zip(rows["y0"], rows["y1"]))
        n = len(heights)
        near = max(least, share * (heights[n // 2] if n % 2 else (heights[n // 2 - 1] + heights[n // 2]) / 2))
        bands: list[list] = []  # [sum of middles, members]
        middle = [(a + b) / 2 for a, b in zip(rows["y0"], rows["y1"])]
        for i in sorted(range(n), key=lambda i: middle[i]):
            home = next((x for x in bands if abs(middle[i] - x[0] / len(x[1])) < near), None)
            if home is None:
                bands.append([middle[i], [i]])
            else:
                home[0] += middle[i]
                home[1].append(i)
        bands.sort(key=lambda x: x[0] / len(x[1]))
        at = [(r, i) for r, x in enumerate(bands, 1) for i in sorted(x[1], key=lambda i: rows["x0"][i])]
        return {c: [rows[c][i] for _, i in at] for c in ("page_id", "seq")} | {"row": [r for r, _ in at], "place": list(range(1, n + 1))}

    return grouped(items.select("page_id", "seq", "x0", "y0", "x1", "y1"), ["page_id"], ["seq"], order, "page_id long, seq int, row int, place int")


def banded(items: DataFrame, band: int) -> DataFrame:
    """Places 1..N on each page by bands of ``band`` pixels, then from the left."""
    order = Window.partitionBy("page_id").orderBy(F.floor(F.col("y0") / band), "x0", "seq")
    return items.withColumn("place", F.row_number().over(order))


def mask_runs(mask: DataFrame, key: list[str], least: int) -> DataFrame:
    """Runs of true values (pos, on) of at least ``least`` places: start and end (exclusive)."""
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*key).orderBy("pos"))
    runs = mask.where("on").withColumn("island", island).groupBy(*key, "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    return runs.where(F.col("end") - F.col("start") >= least).select(*key, "start", "end")


def content_segments(runs: DataFrame, key: list[str], total: int, least: int) -> DataFrame:
    """What lies between the runs, before the first and after the last, of at least ``least``."""
    tail = runs.select(*key).distinct().select(*key, F.lit(total).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    order = Window.partitionBy(*key).orderBy("start", F.col("end").asc_nulls_last())
    parts = runs.select(*key, F.col("start").cast("long"), F.col("end").cast("long")).unionByName(tail)
    parts = parts.select(*key, F.coalesce(F.lag("end").over(order), F.lit(0)).alias("seg_start"), F.col("start").alias("seg_end"))
    return parts.where(F.col("seg_end") - F.col("seg_start") >= least)
