"""Items of a page meet without being sent by band, with the pairs that all with all gives."""

import random
import re

from pyspark.sql import functions as F

from leafmill.functions.geometry import Box
from leafmill.operators import matching as mt

LINE, RECT = "page_id long, seq int, x0 int, y0 int, x1 int, y1 int", "page_id long, rect_idx int, x0 int, y0 int, x1 int, y1 int"


def _boxes(r, n):
    return [(page, i + 1, x, y, x + r.randint(5, 150), y + r.randint(5, 150)) for page, m in ((1, n), (2, 3), (3, 1)) for i in range(m) for x, y in [(r.randint(-50, 600), r.randint(-150, 500))]]


def _tables(spark):
    r = random.Random(5)
    return spark.createDataFrame(_boxes(r, 90), LINE), spark.createDataFrame([*_boxes(r, 40), (9, 1, 0, 0, 5, 5)], RECT)


def _exchanges(df):
    return re.findall(r"Exchange (.*)", df._jdf.queryExecution().executedPlan().toString())


def test_nearest_rectangles_by_all_pairs(spark):
    lines, rects = _tables(spark)
    r = rects.select("page_id", "rect_idx", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    line, rect = Box.of(), Box.of("r_")
    met = lines.join(r, "page_id").select("page_id", "seq", "rect_idx", (line.intersection(rect) >= 0.5 * F.greatest(F.lit(1), line.area)).alias("claim"), (line.gap_x(rect) * line.gap_x(rect) + line.gap_y(rect) * line.gap_y(rect)).alias("square"))
    want = {}
    for x in met.collect():
        want.setdefault((x.page_id, x.seq), []).append(x)
    want = {k: min((x.square, x.rect_idx) for x in v) for k, v in want.items() if not any(x.claim for x in v)}
    want = sorted((*k, i, s) for k, (s, i) in want.items() if s <= 1600)
    assert want and sorted(map(tuple, mt.nearest_rect(lines, rects).collect())) == want


def test_lines_are_not_sent_by_band(spark):
    lines, rects = _tables(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (mt.nearest_rect(lines, rects), mt.best_match(rects, lines), mt.claim_lines(lines, rects)):
            sent = _exchanges(found)
            assert len(sent) == 2 and not any("band" in s for s in sent), sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
