"""Queries over outlines: measures of polygons, lines and lobes, cuts at necks, shapes of captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import lettering
from leafmill.functions import maskarrays as ma
from leafmill.functions import polygons as pg
from leafmill.operators import lobes as lb
from leafmill.operators import masks as mk
from leafmill.plans.registry import register
from leafmill.sources.tables import table, view

# half widths of an outline at nine levels
HALVES = ("a - 40", "a", "a", "n1", "a - 10", "a - 10", "n2", "a - 20", "a - 60")


def _points(first: int, last: int) -> list[tuple[str, str]]:
    """Points down one side and up the other, between two levels, as SQL both engines read."""
    levels = [*((k, "+") for k in range(first, last + 1)), *((k, "-") for k in range(last, first - 1, -1))]
    out = []
    for k, sign in levels:
        side = f"m {sign} ({HALVES[k]})"
        out.append((f"CASE WHEN across THEN {10 + 100 * k} ELSE {side} END", f"CASE WHEN across THEN {side} ELSE {10 + 50 * k} END"))
    return out


def ring_sql(first: int = 0, last: int = 8) -> str:
    return f"[{', '.join(f'[{x}, {y}]' for x, y in _points(first, last))}]"


def outline_ring(first: int = 0, last: int = 8):
    return F.array(*[F.array(F.expr(x), F.expr(y)) for x, y in _points(first, last)]).cast("array<array<double>>")


LOBES = ((0, 3), (3, 6), (6, 8))

# ---- rings in SQL: points, edges, hull, corners ----

MEASURES = """n AS (SELECT *, len(ring) AS k FROM rings),
pt AS (SELECT page_id, k, i, CAST(ring[i][1] AS DOUBLE) AS x, CAST(ring[i][2] AS DOUBLE) AS y, CAST(ring[i % k + 1][1] AS DOUBLE) AS nx, CAST(ring[i % k + 1][2] AS DOUBLE) AS ny FROM (SELECT page_id, ring, k, unnest(range(1, k + 1)) AS i FROM n)),
plain AS (SELECT page_id, abs(sum(x * ny - nx * y)) / 2 AS area, list_reduce(list(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) ORDER BY i), lambda p, q: p + q) AS perimeter, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n_points FROM pt GROUP BY page_id),
spots AS (SELECT DISTINCT page_id, x, y FROM pt),
side AS (SELECT a.page_id, a.x AS ax, a.y AS ay, b.x AS ux, b.y AS uy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn, (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) AS along, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS len2
  FROM spots a JOIN spots b ON a.page_id = b.page_id AND (a.x <> b.x OR a.y <> b.y) JOIN spots c ON c.page_id = a.page_id),
rim AS (SELECT page_id, ax * uy - ux * ay AS part FROM side GROUP BY page_id, ax, ay, ux, uy HAVING min(turn) >= 0 AND count(*) FILTER (WHERE turn = 0 AND (along < 0 OR along > len2)) = 0),
hulls AS (SELECT page_id, sum(part) / 2 AS hull_area FROM rim GROUP BY page_id)"""

_D2 = lambda i, j: f"(ring[{i}][1] - ring[{j}][1]) * (ring[{i}][1] - ring[{j}][1]) + (ring[{i}][2] - ring[{j}][2]) * (ring[{i}][2] - ring[{j}][2])"
_AT = lambda i, c: f"CAST(ring[({i}) % k + 1][{c}] AS DOUBLE)"
_DX, _DY = f"({_AT('e', 1)} - {_AT('s', 1)})", f"({_AT('e', 2)} - {_AT('s', 2)})"
_OFF = f"abs({_DX} * ({_AT('i', 2)} - {_AT('s', 2)}) - {_DY} * ({_AT('i', 1)} - {_AT('s', 1)})) / sqrt({_DX} * {_DX} + {_DY} * {_DY})"
_FAR = f"list_max(list_transform(range(s + 1, e), lambda i: {{'d': {_OFF}, 'p': -i}}))"
CORNERS = f"""anchor AS (SELECT *, -list_max(list_transform(range(0, k), lambda j: {{'d': {_D2('j + 1', '1')}, 'p': -j}})).p AS a FROM n JOIN plain USING (page_id)),
anchors AS (SELECT *, -list_max(list_transform(range(0, k), lambda j: {{'d': {_D2('j + 1', 'a + 1')}, 'p': -j}})).p AS b FROM anchor),
span AS (SELECT page_id, ring, k, perimeter * CAST(0.02 AS DOUBLE) AS tol, s, e, {_FAR} AS far FROM (SELECT *, unnest([a, a + (b - a + k) % k]) AS s, unnest([a + (b - a + k) % k, a + k]) AS e FROM anchors)
  UNION ALL SELECT page_id, ring, k, tol, s, e, {_FAR} FROM (SELECT page_id, ring, k, tol, unnest([s, -far.p]) AS s, unnest([-far.p, e]) AS e FROM span WHERE far.d > tol)),
cornered AS (SELECT page_id, count(DISTINCT s % k) AS n_corners FROM span WHERE far IS NULL OR NOT far.d > tol GROUP BY page_id)"""


@register(f"""WITH RECURSIVE rings AS (SELECT page_id, {ring_sql()} AS ring FROM outlines_v), {MEASURES}, {CORNERS}
SELECT page_id, n_points, area, perimeter, hull_area, area / hull_area AS solidity, CAST(n_corners AS INT) AS n_corners FROM plain JOIN hulls USING (page_id) JOIN cornered USING (page_id)""")
def polygon_measures(spark, sf):
    # dealt by page: the file of orders may be a single split
    x = view(spark, sf, "outlines_v").repartition("page_id").select("page_id", outline_ring().alias("ring"))
    x = x.select("page_id", F.size("ring").cast("long").alias("n_points"), pg.measures(F.col("ring")).alias("m"))
    return x.select("page_id", "n_points", "m.area", "m.perimeter", "m.hull_area", (F.col("m.area") / F.col("m.hull_area")).alias("solidity"), F.col("m.corners").alias("n_corners"))


@register(f"""WITH b AS (SELECT page_id, unnest([{', '.join(ring_sql(*x) for x in LOBES)}]) AS ring, unnest([1, 2, 3]) AS lobe FROM outlines_v),
e AS (SELECT page_id, lobe, CAST(ring[i][1] AS DOUBLE) AS ax, CAST(ring[i][2] AS DOUBLE) AS ay, CAST(ring[i % len(ring) + 1][1] AS DOUBLE) AS ux, CAST(ring[i % len(ring) + 1][2] AS DOUBLE) AS uy FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM b)),
q AS (SELECT page_id, seq, (x0 + x1) // 2 AS x, (y0 + y1) // 2 AS y FROM lines_v),
d AS (SELECT q.page_id, q.seq, e.lobe, (ux - ax) * (x - ax) + (uy - ay) * (y - ay) AS along, (ux - ax) * (ux - ax) + (uy - ay) * (uy - ay) AS len2, (ux - ax) * (y - ay) - (uy - ay) * (x - ax) AS turn,
  least((x - ax) * (x - ax) + (y - ay) * (y - ay), (x - ux) * (x - ux) + (y - uy) * (y - uy)) AS ends, (ay > y) <> (uy > y) AND ((uy > ay) = ((ux - ax) * (y - ay) - (uy - ay) * (x - ax) > 0)) AND (ux - ax) * (y - ay) - (uy - ay) * (x - ax) <> 0 AS crosses FROM q JOIN e USING (page_id)),
s AS (SELECT page_id, seq, lobe, min(CASE WHEN len2 > 0 AND along BETWEEN 0 AND len2 THEN turn * turn / len2 ELSE ends END) * CASE WHEN count(*) FILTER (WHERE crosses) % 2 = 1 THEN 1 ELSE -1 END AS far FROM d GROUP BY page_id, seq, lobe),
t AS (SELECT page_id, seq, arg_max(lobe, [far, -lobe]) AS lobe, max(far) AS far FROM s GROUP BY page_id, seq)
SELECT q.page_id, q.seq, CASE WHEN far >= -225 THEN lobe END AS lobe, CASE WHEN far >= -225 THEN sign(far) * sqrt(abs(far)) + 0.0 END AS distance FROM q LEFT JOIN t USING (page_id, seq)""")
def lines_to_lobes(spark, sf):
    o = view(spark, sf, "outlines_v").repartition("page_id")  # rings are made where they are met
    lobes = o.select("page_id", F.posexplode(F.array(*[outline_ring(*x) for x in LOBES])).alias("k", "ring")).select("page_id", (F.col("k") + 1).alias("lobe"), "ring")
    return lb.lines_to_lobes(view(spark, sf, "lines_v"), lobes)


def _shapes(spark, sf):
    lines = view(spark, sf, "lines_v").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x0", "y0", "x1", "y1"))).alias("lines"))
    return view(spark, sf, "outlines_v").hint("merge").join(lines, "page_id").select("page_id", outline_ring().alias("ring"), "lines")


@register()
def split_lobes(spark, sf):
    x = lb.split_lobes(_shapes(spark, sf))
    return x.select("page_id", "lobe", F.size("ring").alias("n_points"), pg.area(F.col("ring")).alias("area"), F.array_join(F.transform("lines", lambda s: s["seq"].cast("string")), " ").alias("lines"))


@register()
def fitted_text(spark, sf):
    """What is said in a conversation, set into the outline of its page at the largest size that fits.

    Null size and lines where no size does."""
    said = table(spark, sf, "conversations").select(F.col("conv_id").alias("page_id"), "turn", "text")
    rings = mk.shapes_of(view(spark, sf, "outlines_v").join(said.select("page_id").distinct(), "page_id", "left_semi"), ["page_id"], outline_ring(), "rings")

    def each(page):
        return ma.widest(page.rings("rings", 450, 1))

    free = mk.by_page(rings, ["page_id"], each, "top int, spans array<struct<s:int,e:int>>")
    # hundreds of spans a page, which Spark takes for a few bytes: no broadcast of them; and few bytes that
    # take long, so the parts are not merged by their bytes
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = said.repartition(n, "page_id").join(free.repartition(n, "page_id").hint("merge"), "page_id").withColumn("f", lettering.fitting()("text", "top", "spans"))
    return x.select(F.col("page_id").alias("conv_id"), "turn", F.col("f.size").alias("size"), F.transform("f.lines", lambda s: F.concat_ws(" ", s["x"], s["y"], s["text"])).alias("lines"))
