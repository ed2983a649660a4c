"""The rule engine: errors as events, clusters as records, stages in a row."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import clusters as cl
from leafmill.operators import lines as ln
from leafmill.operators import quality as qa


def rule(name, detect, updates=None, **more):
    return qa.Rule(name, "s", detect, updates or {}, **more)


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    assert spark.conf.get("spark.sql.ansi.enabled") == request.param
    spark.conf.set("spark.sql.ansi.enabled", before)


def test_errors_are_events(spark, ansi):
    c = F.col
    made = (
        rule("divides", lambda: c("a") / c("b") > 1, {"a": lambda: F.lit(0)}, inputs=("a", "b")),
        rule("casts", lambda: c("t").cast("int") > 3, inputs=("t",)),
        rule("mends", lambda: c("b") == 7, {"a": lambda: c("t").cast("int")}, inputs=("b", "t")),
        rule("looks", lambda: F.element_at(F.array(F.lit(1)), c("b") + 1) == 1, inputs=("b",)),
        rule("grows", lambda: c("big") * 2 > 0, inputs=("big",), severity="flag_for_review"),
        rule("drops", lambda: c("a") == 5, drop=True),
    )
    df = spark.createDataFrame([(1, 4, 1, "9", 1), (2, 4, 0, "x", 2**31 - 1), (3, 8, 7, "y", None), (4, 5, 1, "1", None), (5, None, 0, None, None)], "i int, a int, b int, t string, big int")
    got = {r.i: (r.a, [(e.pattern_name, e.severity, e.action_taken) for e in r.events], r.dropped) for r in qa.apply_stage(df, "s", made).collect()}
    fixed, error = lambda n: (n, "auto_fix", "resolved"), lambda n: (n, "error", "exception_in_gate")
    flagged = ("grows", "flag_for_review", "resolved")
    assert got[1] == (0, [fixed("divides"), fixed("casts"), error("looks"), flagged], False)
    # nothing of a record changes by a rule that breaks on it; what follows goes on
    assert got[2][0] == 4 and got[2][1][:2] == [error("divides"), error("casts")] and not got[2][2]
    assert got[3] == (0 if 8 / 7 > 1 else 8, [fixed("divides"), error("casts"), error("mends"), error("looks")], False)
    assert got[2][1][2] == fixed("looks")
    assert got[4] == (0, [fixed("divides"), error("looks")], False) and got[5][1] == [fixed("looks")]


def test_clusters_are_cut_as_by_windows(spark):
    rng = random.Random(3)
    rows = []
    for page in range(120):
        for seq in range(1, rng.randint(2, 9)):
            x, y = rng.choice([0, 20, 160, 200]) + rng.randint(0, 9), rng.randint(0, 260)
            rows.append((page, seq, x, y, x + rng.randint(20, 90), y + rng.randint(8, 30)))
    lines = spark.createDataFrame(rows, "page_id long, seq int, x0 int, y0 int, x1 int, y1 int")
    whole = lines.groupBy("page_id").agg(F.collect_list(F.struct("seq", "x0", "y0", "x1", "y1")).alias("lines"))
    seqs = lambda parts: F.transform(parts, lambda p: F.array_sort(F.transform(p, lambda s: s["seq"])))
    got = {r.page_id: (r.a, r.b) for r in whole.select("page_id", seqs(cl.cut_columns(F.col("lines"))).alias("a"), seqs(cl.cut_stacked(F.col("lines"))).alias("b")).collect()}
    for k, (df, column) in enumerate(((ln.split_columns(lines, ["page_id"]), "side"), (ln.split_stacked(lines, ["page_id"]), "lobe"))):
        want = {}
        for r in df.collect():
            want.setdefault(r.page_id, ([], []))[r[column]].append(r.seq)
        assert {p: v[k] for p, v in got.items()} == {p: [sorted(x) for x in parts if x] for p, parts in want.items()}
        assert any(len(v[k]) == 2 for v in got.values()) and any(len(v[k]) == 1 for v in got.values())


def test_ids_and_stages(spark):
    df = spark.createDataFrame([(1, [(5, 500, 100), (5, 200, 100), (1, 100, 100)], "said"), (2, [(1, 0, 0), (2, 5, 0)], " "), (3, [], "said")], "i int, bubbles array<struct<id:int,y0:int,x0:int>>, original_text string")
    done = qa.apply_stages(df, ["bubble_list_indexing", "bubble_validation"])
    got = {r.i: ([(b.id, b.y0) for b in r.bubbles], [e.pattern_name for e in r.events], r.dropped) for r in done.collect()}
    assert got == {1: ([(1, 100), (2, 200), (3, 500)], ["duplicate_bubble_id"], False), 2: ([(1, 0), (2, 5)], ["empty_fragment"], True), 3: ([], [], False)}
    again = {r.i: [e.pattern_name for e in r.events] for r in qa.apply_stages(df, ["bubble_validation", "bubble_list_indexing"]).collect()}
    assert again == {1: ["duplicate_bubble_id"], 2: ["empty_fragment"], 3: []}


def test_all_stages_read_lines_once_and_draw_no_ellipse(spark, sf):
    from leafmill.plans.catalog import QUERIES

    plan = QUERIES["gate_all_stages"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_linenumber") and plan.count("FileScan") == 2
    assert "collect_list" in plan and "ObjectHashAggregate" not in plan and "rint" not in plan.lower()
