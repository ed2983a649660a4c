"""Dictionaries of many terms, and texts set into outlines, against plain loops."""

import itertools
import random
import time
import re
import time

from pyspark.sql import functions as F

from leafmill.functions import lettering as lt
from leafmill.operators import lexicon as lx


def loop(text, glossary):
    """One pattern a term, longest first."""
    for k, v in sorted(glossary.items(), key=lambda kv: -len(kv[0])):
        text = re.sub(rf"\b{re.escape(k)}\b", lambda m, v=v: lx.like_case(m[0], v), text, flags=re.I)
    return text


def many_terms(rng, n):
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    terms = {w if rng.random() < 0.7 else f"{w} {rng.choice(words)}": f"q{i}x" for i, w in enumerate(words)}
    return words, dict(list(terms.items())[:n])


def test_twenty_thousand_terms_equal_the_loop(spark):
    rng = random.Random(6)
    words, terms = many_terms(rng, 30_000)
    assert len(terms) >= 20_000
    case = [str.lower, str.upper, str.capitalize, lambda w: w[:1] + w[1:].upper()]
    texts = [" ".join(rng.choice(case)(rng.choice(words)) + rng.choice(["", "", ",", ".", "-", "_", "'s"]) for _ in range(25)) for _ in range(6)]
    texts += ["", "Ünder the bakó", "ba-ba_ba ba"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {r.i: r.x for r in df.select("i", lx.enforcement(terms, spark)("t").alias("x")).collect()}
    assert got[len(texts)] is None
    for i, t in enumerate(texts):
        assert got[i] == loop(t, terms)


def test_time_does_not_grow_with_the_terms():
    rng = random.Random(1)
    words, terms = many_terms(rng, 40_000)
    text = " ".join(rng.choice(words) for _ in range(20_000))
    some = [w for w in words[:200]]
    took = []
    for terms_ in ([t for t in some], [*some, *(t + "zz" for t in terms)]):  # the same matches
        d = lx.Dictionary(terms_)
        best = min(_timed(d, text) for _ in range(3))
        took.append(best)
    assert took[1] < 4 * took[0] + 0.05


def _timed(d, text):
    began = time.perf_counter()
    d.matches(text)
    return time.perf_counter() - began


def test_a_dictionary_in_parts_gives_the_same(spark, monkeypatch):
    rng = random.Random(2)
    words, terms = many_terms(rng, 400)
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    whole = df.select(lx.enforcement(terms, spark)("t")).collect()
    monkeypatch.setattr(lx, "MOST_LETTERS", 300)
    assert df.select(lx.enforcement(terms, spark)("t")).collect() == whole


def test_names_come_back_from_translation(spark):
    mask, unmask = lx.masking([("Spider-Man", "XNAME_SPIDER_MAN_X"), ("Spider", "XNAME_SPIDER_X")], spark)
    rows = [("spider man, SPIDER-MAN and Spiderman; spider\tman, spiders, a spider",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(mask("t").alias("m"))
    m = "XNAME_SPIDER_MAN_X"
    assert [r.m for r in df.collect()] == [f"{m}, {m} and {m}; {m}, spiders, a XNAME_SPIDER_X", None]
    from pyspark.sql import functions as F

    back = F.create_map(F.lit(m), F.lit("O"))
    said = spark.createDataFrame([(f"{m.lower()} xname_spider_manning_X, Jonasi JAMISON",), (None,)], "t string")
    assert [r[0] for r in said.select(unmask("t", back)).collect()] == ["O O'rgimchak-Odam, Jona Jeymson", None]


def every_way(text, top, spans, sizes, clearance=4):
    """All sizes, line counts, places and ways to break lines; the largest size that has one."""
    words = text.split()
    for size in sorted(sizes, reverse=True):
        high = int(size * 1.15)
        for n in range(1, len(words) + 1):
            for y in lt.placements(top, top + len(spans), n * high) if n * high <= len(spans) else ():
                room = [spans[y - top + k * high : y - top + (k + 1) * high] for k in range(n)]
                widths = [min(e for _, e in r) - max(s for s, _ in r) - 2 * clearance for r in room]
                for cuts in itertools.combinations(range(1, len(words)), n - 1):
                    lines = [" ".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)])]
                    if all(lt.measured(x, size) <= w + 1e-9 for x, w in zip(lines, widths)):
                        return size, n, y
    return None


def test_a_fitted_text_has_the_largest_size(spark):
    rng = random.Random(7)
    found = 0
    for _ in range(60):
        h = rng.randint(10, 90)
        half = [rng.randint(20, 70) if rng.random() < 0.1 else int(70 - abs(k - h / 2) * rng.uniform(0.5, 0.6)) for k in range(h)]
        spans = [(100 - max(1, x), 100 + max(1, x)) for x in half]
        text = " ".join(rng.choice(["a", "Will", "hammer", "on", "WONDER", "it."]) for _ in range(rng.randint(1, 8)))
        got, want = lt.fitted(text, 20, spans, range(10, 27)), every_way(text, 20, spans, range(10, 27))
        assert (got is None) == (want is None)
        if got:
            found += 1
            size, lines = got
            assert (size, len(lines), lines[0][2]) == want and " ".join(x for x, _, _ in lines) == text
            high = int(size * 1.15)
            for line, x, y in lines:
                rows = spans[y - 20 : y - 20 + high]
                assert max(s for s, _ in rows) + 3 <= x and x + lt.measured(line, size) <= min(e for _, e in rows) - 3
    assert found > 20
    assert lt.fitted("", 0, [(0, 100)] * 50, range(10, 20)) is None and lt.fitted("word", 0, [], range(10, 20)) is None


def test_words_too_few_for_their_rows_are_told_at_once():
    began = time.time()
    assert lt.breaks([3] * 15_000, 1, [18, 24] * 8_000) is None  # each row takes a word
    assert lt.breaks([3] * 900, 1, [18, 24] * 150, 0.82)[-1] == 900 and lt.breaks([], 1, []) == [] and lt.breaks([1], 1, []) is None
    assert time.time() - began < 20


def plain_breaks(sizes, space, widths, fill=0.82):
    """The least cost over all ways to break, and whether there is one."""
    costs = []
    for cuts in itertools.combinations(range(1, len(sizes)), len(widths) - 1):
        lines = [sum(sizes[a:b]) + space * (b - a - 1) for a, b in zip([0, *cuts], [*cuts, len(sizes)])]
        if all(x <= w for x, w in zip(lines, widths)):
            costs.append(sum((fill * w - x) ** 2 for x, w in zip(lines, widths)))
    return min(costs, default=None)


def test_breaks_within_their_bounds_are_the_best_of_all():
    rng, found = random.Random(4), 0
    for _ in range(400):
        sizes, widths = [rng.randint(1, 9) for _ in range(rng.randint(1, 9))], [rng.randint(3, 26) for _ in range(rng.randint(1, 5))]
        ends, want = lt.breaks(sizes, 1, widths), plain_breaks(sizes, 1, widths)
        assert (ends is None) == (want is None)
        if ends:
            found += 1
            lines = [sum(sizes[a:b]) + b - a - 1 for a, b in zip([0, *ends], ends)]
            assert all(b > a for a, b in zip([0, *ends], ends)) and abs(sum((0.82 * w - x) ** 2 for x, w in zip(lines, widths)) - want) < 1e-9
    assert found > 50


def test_balanced_texts_take_as_many_rows_as_they_need(spark, sf):
    """With 400 rows for every text, those of fewer words had no lines at all."""
    rng = random.Random(9)
    for _ in range(300):
        sizes, pattern = [rng.randint(1, 12) for _ in range(rng.randint(0, 8))], [rng.randint(4, 11) for _ in range(rng.randint(1, 3))]
        ways = [(pattern * 9)[:k] for k in range(len(sizes) + 1)]
        assert lt.fewest_rows(sizes, 1, pattern) == next((w for w in ways if (plain_breaks(sizes, 1, w) is not None if sizes and w else not sizes)), None)
    from leafmill.plans.gates import balanced_lines

    said = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = {(r.conv_id, r.turn): r.lines for r in balanced_lines(spark, sf).collect()}
    assert got.keys() == said.keys()
    for k, lines in got.items():
        words = (said[k] or "").split()
        assert lines is not None or max(map(len, words)) > 18
        assert lines is None or " ".join(lines) == " ".join(words) and all(len(x) <= (24 if i % 2 else 18) for i, x in enumerate(lines))
    long = [3] * 30_000
    began = time.time()
    assert len(lt.balanced(["abc"] * 30_000, lt.fewest_rows(long, 1, [18, 24]))) == 6_000  # ten words to two rows
    assert time.time() - began < 20


def test_a_text_is_set_soon():
    """Each block of lines tried was a walk over all its rows and words: some tenths of a second a text."""
    spans = [(150 - 40 - abs(y % 200 - 100), 150 + 60 + abs(y % 170 - 80)) for y in range(400)]
    texts = [" ".join(["hammer", "on", "it"] * n) for n in range(30, 110)]
    began = time.time()
    assert sum(lt.fitted(x, 10, spans, range(10, 27)) is not None for x in texts) > 30
    assert time.time() - began < 2.5


def test_texts_reach_dictionaries_in_batches_of_bounded_bytes(spark):
    from leafmill.session import BATCH_BYTES

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.unset(setting)
    try:
        rows = spark.range(40, numPartitions=1).select(F.repeat(F.lit("the thing "), 100_000).alias("t"))  # 40 MB in one part
        done = rows.select(lx.enforcement({"thing": "narsa"}, spark)("t").alias("x"))
        assert spark.conf.get(setting) == str(BATCH_BYTES)
        assert done.where(F.length("x") == 1_000_000).count() == 40
    finally:
        spark.conf.set(setting, before)
