"""Line clusters, reading order and duplicates on cases with known results."""

import random

from pyspark.sql import functions as F

from leafmill.functions import geometry as geo
from leafmill.functions.lettering import largest_rectangle
from leafmill.operators import lines as ln
from leafmill.operators import matching as mt
from leafmill.operators import order as od
from leafmill.sources.tables import view

LINE = "page_id long, seq int, x0 int, y0 int, x1 int, y1 int"


def lines(spark, *boxes, conf=90):
    return spark.createDataFrame([(1, i + 1, *b) for i, b in enumerate(boxes)], LINE).withColumn("conf_pct", F.lit(conf))


def clusters(df):
    out = {}
    for r in ln.cluster_lines(df).collect():
        out.setdefault((r.cluster, r.side, r.lobe), set()).add(r.seq)
    return sorted(map(sorted, out.values()))


def test_centred_lines_are_one_cluster(spark):
    assert clusters(lines(spark, (130, 100, 170, 120), (80, 125, 220, 145), (125, 150, 175, 170))) == [[1, 2, 3]]


def test_columns_stay_apart(spark):
    assert clusters(lines(spark, (926, 1242, 1287, 1281), (1305, 1278, 1704, 1320))) == [[1], [2]]
    assert clusters(lines(spark, (100, 100, 200, 130), (250, 105, 380, 135))) == [[1], [2]]


def test_pairs_do_not_depend_on_the_band(spark):
    df = lines(spark, *[((i * 37) % 300, (i * 53) % 400, (i * 37) % 300 + 90, (i * 53) % 400 + 20) for i in range(60)])
    found = [sorted(map(tuple, ln.line_pairs(df, band=b).collect())) for b in (16, 64, 4096)]
    assert found[0] == found[1] == found[2] and found[0]


def test_stacked_lobes_part_at_the_gap(spark):
    df = lines(spark, (100, 100, 150, 120), (100, 122, 150, 142), (100, 182, 150, 202), (100, 204, 150, 224))
    got = {r.seq: r.lobe for r in ln.split_stacked(df, ["page_id"]).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


def test_sentence_break_parts_with_text(spark):
    df = lines(spark, (100, 100, 150, 140), (100, 145, 150, 185), (100, 193, 150, 233), (100, 238, 150, 278))
    df = df.withColumn("text", F.element_at(F.array(*map(F.lit, ["HEY", "YOU.", "Come", "here"])), F.col("seq")))
    assert {r.seq: r.lobe for r in ln.split_stacked(df, ["page_id"], with_text=True).collect()} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_middle_speaker_is_read_in_between():
    boxes = [(86, 83, 355, 201), (554, 86, 906, 197), (348, 165, 555, 247)]
    assert od.row_major(boxes, 0.25) == [0, 2, 1]


def test_panels_are_read_whole(spark):
    panels = spark.createDataFrame([(1, 0, 0, 500, 500), (2, 550, 0, 1050, 500)], "panel_idx int, px0 int, py0 int, px1 int, py1 int")
    df = lines(spark, (600, 80, 800, 140), (50, 350, 200, 420), (600, 200, 800, 260), (50, 50, 200, 100))
    got = sorted((r.reading_index, r.seq, r.panel_idx) for r in od.page_reading_order(df, panels).collect())
    assert got == [(1, 4, 1), (2, 2, 1), (3, 1, 2), (4, 3, 2)]


def test_gutter_item_goes_to_the_nearer_panel(spark):
    panels = spark.createDataFrame([(0, 0, 0, 400, 500), (1, 500, 0, 900, 500)], "panel_idx int, px0 int, py0 int, px1 int, py1 int")
    got = {r.seq: r.panel_idx for r in od.assign_panels(lines(spark, (405, 100, 415, 150), (470, 100, 490, 150)).drop("conf_pct"), panels).collect()}
    assert got == {1: 0, 2: 1}


def greedy(boxes, iou=0.40, contained=0.65):
    """The suppression rule restated for whole lists, best score first."""
    kept = []
    for i, (x0, y0, x1, y1, s, key) in sorted(enumerate(boxes), key=lambda e: (-e[1][4], e[0])):
        area = max(1, (x1 - x0) * (y1 - y0))
        for j in kept:
            a0, b0, a1, b1, _, other = boxes[j]
            size = max(1, (a1 - a0) * (b1 - b0))
            inter = max(0, min(x1, a1) - max(x0, a0)) * max(0, min(y1, b1) - max(y0, b0))
            over = inter and (inter / (area + size - inter) >= iou or max(inter / area, inter / size) >= contained)
            if over and not (key and other and key != other and max(inter / area, inter / size) < 0.88):
                break
        else:
            kept.append(i)
    return sorted(kept)


def test_suppression_against_restatement(spark):
    import random

    rng = random.Random(3)
    boxes = [(x, y, x + rng.randint(20, 120), y + rng.randint(20, 90), rng.randint(0, 50), rng.choice(["", "a", "b"])) for x, y in ((rng.randint(0, 200), rng.randint(0, 200)) for _ in range(80))]
    df = spark.createDataFrame([(1, i, *b) for i, b in enumerate(boxes)], LINE + ", score int, text_key string")
    assert sorted(r.seq for r in mt.suppress(df).collect() if r.kept) == greedy(boxes)


def test_polygon_and_rectangle(spark):
    ring = "array(array(0,0), array(10,0), array(10,10), array(0,10))"
    x = spark.sql(f"SELECT {ring} AS p, * FROM VALUES (5.0, 5.0), (0.0, 5.0), (10.0, 10.0), (10.1, 5.0), (-1.0, 0.0) AS t(x, y)")
    assert [r[0] for r in x.select(geo.in_polygon(F.col("p"), F.col("x"), F.col("y"))).collect()] == [True, True, True, False, False]
    assert x.select(geo.polygon_area(F.col("p"))).first()[0] == 100
    assert largest_rectangle([2, 1, 5, 6, 2, 3]) == 10 and largest_rectangle([]) == 0


def test_masks(spark):
    df = spark.createDataFrame([(1, p, p in (0, 1, 2, 6, 9, 10)) for p in range(12)], "k int, pos long, on boolean")
    runs = od.mask_runs(df, ["k"], 2)
    assert sorted((r.start, r.end) for r in runs.collect()) == [(0, 3), (9, 11)]
    assert [(r.seg_start, r.seg_end) for r in od.content_segments(runs, ["k"], 12, 2).collect()] == [(3, 9)]


def pieces_by_definition(mask, box, depth, share, low, thick):
    """The cut restated by recursion over plain lists."""
    x0, y0, x1, y1 = box
    if depth == 5 or x1 - x0 < int(low * 1.5) or y1 - y0 < int(low * 1.5):
        return [box]
    lines = ([sum(mask[y][x0:x1]) / (x1 - x0) >= share for y in range(y0, y1)], [sum(mask[y][x] for y in range(y0, y1)) / (y1 - y0) >= share for x in range(x0, x1)])
    for axis, line in enumerate(lines):
        segments, prev, i = [], 0, 0
        while i < len(line):
            j = i
            while j < len(line) and line[j]:
                j += 1
            if j - i >= thick:
                segments, prev = [*segments, (prev, i)], j
            i = max(j, i + 1)
        segments = [(a, b) for a, b in [*segments, (prev, len(line))] if b - a >= low]
        if len(segments) > 1:
            boxes = [(x0, y0 + a, x1, y0 + b) if axis == 0 else (x0 + a, y0, x0 + b, y1) for a, b in segments]
            return [p for b in boxes for p in pieces_by_definition(mask, b, depth + 1, share, low, thick)]
    return [box]


def test_panels_of_a_page(spark):
    import random

    import numpy as np

    from leafmill.functions.pages import cut_panels, panels_of

    page = np.zeros((300, 200), bool)
    page[140:150], page[:140, 95:105] = True, True
    assert cut_panels(page) == [(0, 0, 95, 140), (105, 0, 200, 140), (0, 150, 200, 300)]
    assert cut_panels(np.ones((60, 60), bool)) == [(0, 0, 60, 60)]
    rng = random.Random(4)
    for _ in range(60):
        mask = [[rng.random() < 0.6 for _ in range(14)] for _ in range(12)]
        for _ in range(rng.randint(0, 3)):
            mask[rng.randrange(12)] = [True] * 14
            column = rng.randrange(14)
            for row in mask:
                row[column] = True
        want = [p for p in pieces_by_definition(mask, (0, 0, 14, 12), 0, 0.8, 2, 1) if p[2] - p[0] >= 2 and p[3] - p[1] >= 2]
        assert cut_panels(np.array(mask), share=0.8, least=2, thick=1) == (want or [(0, 0, 14, 12)])
    df = spark.createDataFrame([([[True, False], [False, False]],), ([],), (None,)], "m array<array<boolean>>")
    assert [len(r[0]) for r in df.select(panels_of(least=1, thick=1)("m")).collect()] == [1, 0, 0]


def test_nearest_signatures_by_cells(spark, monkeypatch):
    import math
    import random

    from leafmill.operators import matching

    rng = random.Random(4)
    point = lambda: [float(rng.randint(0, 60)) for _ in range(3)]
    known = {f"s{i}": point() for i in range(120)}
    asked = {i: point() for i in range(80)}
    signatures, queries = spark.createDataFrame(list(known.items()), "name string, v array<double>"), spark.createDataFrame(list(asked.items()), "id int, v array<double>")
    want = {i: min((math.dist(v, s), n) for n, s in known.items())[1] for i, v in asked.items()}
    for block, pivots in ((4096, 64), (30, 8), (7, 1)):
        monkeypatch.setattr(matching, "BLOCK_SIGNATURES", block)
        monkeypatch.setattr(matching, "PIVOTS", pivots)
        assert {r.id: r.name for r in matching.nearest_signature(queries, signatures, least=-1e9).collect()} == want


def _spread(spark):
    """Pages of all sizes, a crowded one, and lines without a place, an end or a page."""
    r = random.Random(3)
    rows = []
    for page, n in [(7, 700), *((p, p % 9 + 1) for p in range(20, 400))]:
        for i in range(n):
            x, y = r.randint(0, 600), r.randint(0, 400)
            rows.append((page, i + 1, x, y, x + r.randint(20, 160), y + r.randint(5, 40), r.randint(50, 100)))
    rows += [(900, 1, None, 10, None, 30, 9), (900, 2, 5, 12, None, 40, 9), (900, 3, 200, 14, 230, 30, 9), (901, 1, 5, None, 50, None, 9), (901, 2, 5, 10, 50, 30, 9), (None, 1, 1, 1, 9, 9, 9)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, LINE + ", conf_pct int")


def test_pages_of_a_batch_cluster_as_joins_and_windows_do(spark):
    df = _spread(spark).repartition(3).cache()
    found = df.join(ln.page_components(df, ln.line_pairs(df)), ["page_id", "seq"])
    want = ln.split_stacked(ln.split_columns(found, ["page_id", "cluster"]).drop("split_x"), ["page_id", "cluster", "side"])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "10000"):  # pages go over several batches, and several in one
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = ln.cluster_lines(df).select(*want.columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert want.where("side = 1").count() and want.where("lobe = 1").count()


def test_clustering_sends_lines_once(spark, sf):
    plan = ln.cluster_lines(view(spark, sf, "lines_v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1


def test_envelopes_have_the_median_of_heights(spark):
    df = lines(spark, (1, 1, 9, 5), (1, 2, 9, 12), (1, 3, 9, 9), (1, 4, 9, 24)).withColumn("k", F.when(F.col("seq") < 4, 1).otherwise(2))
    got = {(r.k, r.members, r.median_height) for r in ln.envelopes(df, ["page_id", "k"]).collect()}
    assert got == {(1, "1,2,3", 6.0), (2, "4", 20.0)}
    assert ln.envelopes(df.where("seq > 2"), ["page_id"]).first().median_height == 13.0
