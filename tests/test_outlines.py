"""Polygons and lobes against plain restatements."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from leafmill.functions import polygons as pg
from leafmill.operators import lobes as lb
from leafmill.plans.outlines import _shapes


def star(rng, n, size=200):
    """A simple ring: whole points around a middle, by angle."""
    angles = sorted(rng.sample(range(360), n))
    reach = [rng.randint(size // 5, size) for _ in angles]
    return [[round(300 + r * math.cos(math.radians(a))), round(250 + r * math.sin(math.radians(a)))] for a, r in zip(angles, reach)]


def edges_of(ring):
    return list(zip(ring, ring[1:] + ring[:1]))


def area_of(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in edges_of(ring))) / 2


def hull_of(ring):
    """Corners of the hull: points that are no convex mixture, by testing each way out of them."""
    spots = sorted(set(map(tuple, ring)))
    out = []
    for p in spots:
        others = sorted(math.atan2(q[1] - p[1], q[0] - p[0]) for q in spots if q != p)
        gaps = [b - a for a, b in zip(others, others[1:])] + [others[0] + 2 * math.pi - others[-1]] if others else [7]
        if max(gaps) > math.pi + 1e-9:
            out.append(p)
    return out


def distance_of(ring, x, y):
    far, odd = math.inf, False
    for (ax, ay), (bx, by) in edges_of(ring):
        length = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if not length else min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length))
        far = min(far, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return far if odd else -far


def off_line(a, b, p):
    length = math.hypot(b[0] - a[0], b[1] - a[1])
    return abs((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / length if length else math.dist(a, p)


def kept_corners(ring, tolerance):
    n = len(ring)
    far = lambda i: max(range(n), key=lambda j: (math.dist(ring[i], ring[j]), -j))
    a = far(0)
    b = a + (far(a) - a) % n
    kept = set()

    def walk(s, e):
        inner = [(off_line(ring[s % n], ring[e % n], ring[i % n]), -i) for i in range(s + 1, e)]
        if inner and max(inner)[0] > tolerance:
            walk(s, -max(inner)[1])
            walk(-max(inner)[1], e)
        else:
            kept.add(s % n)

    walk(a, b)
    walk(b, a + n)
    return sorted(kept)


def defects_of(ring):
    """(depth, place) of the deepest point under each side of the hull."""
    n, on = len(ring), [i for i, p in enumerate(ring) if tuple(p) in set(hull_of(ring))]
    out = []
    for s, e in zip(on, on[1:] + [on[0] + n]):
        inner = [(off_line(ring[s % n], ring[e % n], ring[i % n]), -i) for i in range(s + 1, e)]
        if inner:
            out.append((max(inner)[0], -max(inner)[1] % n))
    return out


@pytest.fixture(scope="module")
def rings():
    rng = random.Random(4)
    fixed = [[[0, 0], [100, 0], [100, 50], [0, 50]], [[0, 0], [50, 0], [100, 0], [100, 50], [50, 50], [0, 50]], [[0, 0], [10, 0], [5, 0]], [[3, 3], [3, 3]], [[0, 0], [100, 0], [100, 100], [50, 50], [0, 100]]]
    return fixed + [star(rng, rng.randint(4, 30)) for _ in range(60)]


@pytest.fixture(scope="module")
def frame(spark, rings):
    return spark.createDataFrame([(i, [[float(v) for v in p] for p in r]) for i, r in enumerate(rings)], "i int, ring array<array<double>>")


def test_area_hull_and_solidity(frame, rings):
    r = F.col("ring")
    got = frame.select("i", pg.area(r).alias("area"), pg.hull(r).alias("hull"), pg.solidity(r).alias("solidity"), pg.perimeter(r).alias("perimeter")).collect()
    for row in got:
        ring = rings[row.i]
        assert row.area == area_of(ring) and math.isclose(row.perimeter, sum(math.dist(a, b) for a, b in edges_of(ring)))
        if area_of(ring) == 0:
            assert row.solidity == 1.0
            continue
        assert sorted((int(p.x), int(p.y)) for p in row.hull) == sorted(hull_of(ring))
        assert all(ring[p.i] == [p.x, p.y] for p in row.hull)
        assert math.isclose(row.solidity, area_of(ring) / area_of([[p.x, p.y] for p in row.hull])) and row.solidity <= 1 + 1e-12


def test_signed_distance(spark, frame, rings):
    rng = random.Random(1)
    points = [(rng.randint(0, 600), rng.randint(0, 500)) for _ in range(40)] + [(50, 0), (100, 25), (0, 0)]
    asked = spark.createDataFrame(points, "x int, y int")
    rows = frame.where("size(ring) > 2").crossJoin(asked).select("i", "x", "y", pg.signed_distance(F.col("ring"), F.col("x"), F.col("y")).alias("d")).collect()
    for r in rows:
        want = distance_of(rings[r.i], r.x, r.y)
        assert math.isclose(abs(r.d), abs(want), abs_tol=1e-9) and (abs(want) < 1e-9 or (r.d > 0) == (want > 0))


def test_corners_and_plain_rectangles(frame, rings):
    r = F.col("ring")
    got = frame.select("i", pg.simplified(r, F.lit(8.0)).alias("kept"), pg.simplified(r, F.lit(0.0)).alias("every"), pg.plain_rectangle(r).alias("plain")).collect()
    for row in got:
        ring = rings[row.i]
        if len(ring) > 2:
            assert row.kept == kept_corners(ring, 8.0) and row.every == kept_corners(ring, 0.0)
    plain = {row.i: row.plain for row in got}
    assert plain[0] and plain[1] and not plain[4]


def test_defects(frame, rings):
    for row in frame.select("i", pg.defects(F.col("ring")).alias("d")).collect():
        if area_of(rings[row.i]):
            want, got = sorted(defects_of(rings[row.i])), sorted((d.depth, d.far) for d in row.d)
            assert [p for _, p in got] == [p for _, p in want] and all(math.isclose(a[0], b[0], abs_tol=1e-9) for a, b in zip(got, want))


def middle(line):
    return (line.x0 + line.x1) // 2, (line.y0 + line.y1) // 2


def meets_text(lines, p, q):
    n = max(10, int(math.dist(p, q) / 4))
    for line in lines:
        half = max(3.0, max(1, line.y1 - line.y0) * 0.25)
        for k in range(n):
            x, y = p[0] + (q[0] - p[0]) * k / (n - 1), p[1] + (q[1] - p[1]) * k / (n - 1)
            if line.x0 + 4 <= x <= line.x1 - 4 and abs(y - middle(line)[1]) <= half:
                return True
    return False


def restated(ring, lines, path="1", turns=2):
    """The lobes of one outline, each as (path, ring, seqs of its lines)."""
    here = [(path, ring, [s.seq for s in lines])]
    if len(ring) < 10 or len(lines) < 2 or area_of(ring) < 3500:
        return here
    xs, ys, cx, cy = [p[0] for p in ring], [p[1] for p in ring], [middle(s)[0] for s in lines], [middle(s)[1] for s in lines]
    w, h, stacked = max(xs) - min(xs), max(ys) - min(ys), max(cy) - min(cy) >= 0.8 * (max(cx) - min(cx))
    bends = sorted((d for d in defects_of(ring) if d[0] >= 11.25), key=lambda d: (-d[0], d[1]))[:12]
    best = None
    for m, (_, i) in enumerate(bends):
        for _, j in bends[m + 1 :]:
            p, q = ring[min(i, j)], ring[max(i, j)]
            one, two = ring[min(i, j) : max(i, j) + 1], ring[max(i, j) :] + ring[: min(i, j) + 1]
            length, tilt = math.dist(p, q), abs(p[1] - q[1]) <= max(55, h * 0.35) if stacked else abs(p[0] - q[0]) <= max(55, w * 0.35)
            ok = max(4, min(12, min(w, h) * 0.15)) <= length < min(w, h) * 0.95 and tilt and min(area_of(one), area_of(two)) >= max(1200, area_of(ring) * 0.1)
            ok = ok and distance_of(ring, (p[0] + q[0]) // 2, (p[1] + q[1]) // 2) >= 0 and not meets_text(lines, p, q)
            if ok and (best is None or length < best[0]):
                best = (length, one, two)
    if best is None:
        return here
    parts = sorted(best[1:], key=lambda r: (min(p[1] for p in r), min(p[0] for p in r)))
    far = [[distance_of(r, *middle(s)) for r in parts] for s in lines]
    to = [0 if a >= b else 1 for a, b in far]
    if {t for t, f in zip(to, far) if max(f) >= -15} != {0, 1}:
        order = sorted(range(len(lines)), key=lambda k: (cy[k] if stacked else cx[k], lines[k].seq))
        to = [0] * len(lines)
        for k in order[(len(lines) + 1) // 2 :]:
            to[k] = 1
    out = []
    for t, part in enumerate(parts):
        own = sorted((s for s, x in zip(lines, to) if x == t), key=lambda s: (s.y0, s.x0, s.seq))
        out += restated(part, own, f"{path}.{t + 1}", turns - 1) if turns > 1 and len(own) >= 4 else [(f"{path}.{t + 1}", part, [s.seq for s in own])]
    return out


def test_lobes_equal_their_restatement(spark, sf):
    shapes = _shapes(spark, sf)
    got = {(r.page_id, r.lobe): (r.ring, [s.seq for s in r.lines]) for r in lb.split_lobes(shapes).collect()}
    want = {(r.page_id, path): (ring, seqs) for r in shapes.collect() for path, ring, seqs in restated(r.ring, r.lines)}
    assert got == want
    assert {path.count(".") for _, path in got} == {0, 1, 2}  # uncut, cut once, cut again


def test_lines_go_to_the_nearest_lobe_within_reach(spark):
    square = lambda x: [[x, 0.0], [x + 50.0, 0.0], [x + 50.0, 50.0], [x, 50.0]]
    lobes = spark.createDataFrame([(1, 1, square(0.0)), (1, 2, square(60.0)), (2, 1, square(0.0))], "page_id long, lobe int, ring array<array<double>>")
    box = lambda x, y: (x - 5, y - 5, x + 5, y + 5)
    rows = [(1, 1, *box(25, 25)), (1, 2, *box(58, 25)), (1, 3, *box(55, 25)), (1, 4, *box(85, 64)), (1, 5, *box(85, 66)), (2, 1, *box(300, 300)), (3, 1, *box(5, 5))]
    lines = spark.createDataFrame(rows, "page_id long, seq int, x0 int, y0 int, x1 int, y1 int")
    got = {(r.page_id, r.seq): (r.lobe, r.distance) for r in lb.lines_to_lobes(lines, lobes).collect()}
    assert got == {(1, 1): (1, 25.0), (1, 2): (2, -2.0), (1, 3): (1, -5.0), (1, 4): (2, -14.0), (1, 5): (None, None), (2, 1): (None, None), (3, 1): (None, None)}


def test_measures_of_many_large_rings(spark):
    """Folds over arrays took seconds for one such ring."""
    rng = random.Random(6)
    rings = [[[float(v) for v in p] for p in star(rng, 200)] for _ in range(300)]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate([*rings, None, []])], "i int, ring array<array<double>>")
    began = time.time()
    got = {r.i: r for r in frame.select("i", pg.measures(F.col("ring")).alias("m"), pg.defects(F.col("ring")).alias("d")).collect()}
    assert time.time() - began < 60
    assert got[300].m is None and got[300].d is None and got[301].m.corners == 0 and got[301].d == []
    for i, ring in enumerate(rings[:20]):
        m = got[i].m
        assert m.area == area_of(ring) and m.hull_area == area_of([list(p) for p in sorted(hull_of(ring), key=lambda p: math.atan2(p[1] - 250, p[0] - 300))])
        assert m.corners == len(kept_corners(ring, 0.02 * m.perimeter))


@pytest.mark.parametrize("name", ["gate_contour_extraction", "lines_to_lobes", "split_lobes"])
def test_rings_are_not_broadcast(spark, sf, name):
    """Spark takes rings for a few bytes each: a broadcast of them ended the driver."""
    from leafmill.plans.catalog import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_necks_are_sought_for_all_outlines_at_once(spark):
    """Folds over arrays for each chord took most of the time; odd outlines are left whole."""
    ring = [[0.0, 0.0], [100.0, 0.0], [100.0, 90.0], [60.0, 100.0], [100.0, 110.0], [100.0, 200.0], [50.0, 205.0], [0.0, 200.0], [0.0, 110.0], [40.0, 100.0], [0.0, 90.0]]
    lines = [(1, 20, 20, 80, 40), (2, 20, 150, 80, 170)]
    rows = [(1, ring, lines), (2, None, lines), (3, [], lines), (4, ring, None), (5, ring, []), (6, [[float("nan"), 0.0], *ring], lines), (7, ring, [(1, None, 20, 80, 40), lines[1]]), (8, ring, lines)]
    shapes = spark.createDataFrame(rows, "k int, ring array<array<double>>, lines array<struct<seq:int,x0:int,y0:int,x1:int,y1:int>>")
    cut = lb.cut_at_neck(shapes.coalesce(1), F.col("k") != 8)
    got = {r.k: r.pieces and [(p.ring, [s.seq for s in p.lines]) for p in r.pieces] for r in cut.collect()}
    upper = [*ring[9:], *ring[:4]]
    assert got.pop(1) == [(upper, [1]), (ring[3:10], [2])] and not any(got.values()) and len(got) == 7
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
