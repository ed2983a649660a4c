"""Queries over small tables whose rows used to be cut, against plain restatements."""

import random
import re
import statistics
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from leafmill.functions.similarity import Known, fuzzy_unique, similarity
from leafmill.operators import order as od
from leafmill.plans.catalog import QUERIES


@pytest.fixture
def put(tmp_path):
    def write(**tables):
        for name, rows in tables.items():
            pq.write_table(pa.Table.from_pylist(rows), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


def documents(*texts):
    return [{"doc_id": i, "text": t, "lang": "en", "source": "web", "n_chars": len(t)} for i, t in enumerate(texts, 1)]


def turns(*texts, conv=1):
    return [{"conv_id": conv, "turn": i, "role": "user" if i % 2 == 0 else "assistant", "text": t} for i, t in enumerate(texts)]


def test_distinct_corpus_keeps_whole_texts(spark, put):
    long = "same start " * 10
    sf = put(documents=documents(long + "one", long + "two", long + "one", "short"), conversations=turns("short"))
    got = {(r.text, r.priority, r.id) for r in QUERIES["distinct_corpus"](spark, sf).collect()}
    assert got == {(long + "one", 2, 1), (long + "two", 2, 2), ("short", 1, 1)}


def test_token_jaccard_meets_every_item(spark, put):
    texts = ["the red fox ran", "nothing here", "das grüne Haus über dem Fluß", "", "ran ran far über"]
    items = ["a fox ran", "red red the", "Über alles", "zzz"]
    rows = [{"item_id": i, "text": t} for i, t in enumerate(items, 100)]
    cut = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    pairs = [(d, i, cut(a), cut(b)) for d, a in enumerate(texts, 1) for i, b in enumerate(items, 100)]
    sf = put(documents=documents(*texts), benchmark=rows)
    got = [(r.doc_id, r.item_id, r.shared, r.together) for r in QUERIES["token_jaccard"](spark, sf).collect()]
    assert sorted(got) == sorted((d, i, len(a & b), len(a | b)) for d, i, a, b in pairs if a & b)


MIXED = ["The Große Haus über BOOOM thüing Red Maß Fluß", "Anna Maria Maßlos saw the Green Fox", "plain the the zzxkp BOOM thrrr'ed", "été à Paris Nord"]


def plausible(word):
    w = re.sub("[^A-Z]", "", word.upper())
    vowels = re.sub("[^AEIOUY]", "", w)
    return len(w) >= 2 and len(set(w)) > 1 and len(vowels) > 0 and not (len(w) > 6 and len(vowels) / len(w) < 0.12) and not re.search("[B-DF-HJ-NP-TV-XZ]{5}", w)


def test_words_of_all_languages(spark, put):
    sf = put(documents=documents(*MIXED))
    words = Counter(w for t in MIXED for w in t.split())
    assert {(r.w, r.plausible, r.n) for r in QUERIES["phonotactic_words"](spark, sf).collect()} == {(w, plausible(w), n) for w, n in words.items()}
    entities = Counter(e for t in MIXED for e in re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", t))
    assert {(r.entity, r.n) for r in QUERIES["entity_extract"](spark, sf).collect()} == set(entities.items())


def test_sounds_of_all_languages_and_confidences(spark, put):
    got = {(r.id, r.word, r.kind, r.confidence) for r in QUERIES["sfx_dictionary_join"](spark, put(documents=documents(*MIXED))).collect()}
    assert got == {(1, "The", "web_speed", 99), (1, "BOOOM", "impact_explosion", 95), (1, "thüing", "impact_explosion", 99), (2, "the", "web_speed", 99), (3, "the", "web_speed", 99), (3, "BOOM", "impact_explosion", 99)}


def test_turns_of_all_languages(spark, put):
    sf = put(conversations=turns("Das grüne Haus. Größe über alles!", "grüne Größe", "été", "hiver"))
    got = {(r.turn, r.i): r.reason for r in QUERIES["junk_reason"](spark, sf).collect()}
    assert sorted(got) == [(0, 1), (0, 2), (0, 3), (1, 1), (2, 1), (3, 1)] and got[0, 2] == got[1, 1] == "valid" and got[0, 3] == "empty"
    assert {(r.bubble_id, r.agree) for r in QUERIES["translation_agreement"](spark, sf).collect()} == {(0, True), (1, False), (2, False)}


def test_edits_are_compared_whole(spark, put):
    head = "many words that stand at the start of each line " * 6
    texts = [head + "one two", "Answer number one is given", head + "one two", head + "and now a quite different end of the line, with " * 3, head + "three four " * 15, "So is the second answer, in other words"]
    sf = put(conversations=turns(*texts))
    got = {r.seq % 100: r.outcome for r in QUERIES["edit_capture"](spark, sf).collect()}
    # 3: like the line of 1 up to character 200 only; 4: another source than 0, though it starts the same
    assert got == {0: "added", 1: "added", 2: "updated", 3: "added", 4: "added"}


def test_known_lines_are_found_as_by_full_comparison():
    rng = random.Random(5)
    words = ["abc", "of", "the", "Haus", "grün", "line", "two", "ß", "running", "x"]
    known, plain, seen = Known(0.94), {}, set()
    for i in range(400):
        line = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        if plain and rng.random() < 0.7:
            line = list(rng.choice(list(plain.values())))
            for _ in range(rng.randint(0, max(1, len(line) // 12))):
                line.insert(rng.randrange(len(line) + 1), rng.choice("abc dß")) if rng.random() < 0.5 or not line else line.pop(rng.randrange(len(line)))
            line = "".join(line)
        want = any(similarity(line, k) >= 0.94 for k in plain.values())
        assert known.similar(line) == want
        seen.add(want)
        source = str(rng.randrange(120))
        known[source] = plain[source] = line
        assert source in known and known[source] == line
    assert seen == {True, False}


def test_unique_facts_are_found_as_by_full_comparison():
    rng = random.Random(7)
    words = "he is a doctor likes trains and the old house by sea no one".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(300)] + ["", "  ", "He is a Doctor!"]
    kept, want = [], []
    for text in texts:
        want.append(bool(text.strip()) and all(similarity(text, k) < 0.65 for k in kept))
        kept += [text] * want[-1]
    assert fuzzy_unique(texts) == want and any(want) and not all(want)


def test_cross_check_by_similarity(spark, put):
    sf = put(conversations=turns("One two. Three four.", "One two three four", "quite other words", "one two three four"))
    got = {(r.bubble_id, r.pattern_name) for r in QUERIES["gate_translation_events"](spark, sf).collect()}
    assert got == {(0, "translation_sentence_drop"), (1, "translation_cross_check_mismatch"), (2, "translation_cross_check_mismatch")}


def test_baselines_against_plain_rows(spark):
    rng = random.Random(3)
    rows = [(p, i, rng.randint(0, 300), y := rng.randint(0, 200), 0, y + rng.randint(0, 40)) for p in range(12) for i in range(rng.randint(1, 25))]
    rows = [(p, i, x0, y0, x0 + 30, y1) for p, i, x0, y0, _, y1 in rows]
    got = {(r.page_id, r.seq): (r.row, r.place) for r in od.baseline_order(spark.createDataFrame(rows, "page_id long, seq int, x0 int, y0 int, x1 int, y1 int")).collect()}
    for page in range(12):
        own = [r for r in rows if r[0] == page]
        near = max(8.0, 0.45 * float(statistics.median(max(1, r[5] - r[3]) for r in own)))
        bands = []
        for r in sorted(own, key=lambda r: (r[3] + r[5]) / 2):
            middle = (r[3] + r[5]) / 2
            home = [b for b in bands if abs(middle - statistics.fmean((x[3] + x[5]) / 2 for x in b)) < near][:1]
            home[0].append(r) if home else bands.append([r])
        bands.sort(key=lambda b: statistics.fmean((x[3] + x[5]) / 2 for x in b))
        order = [(n, x[1]) for n, b in enumerate(bands, 1) for x in sorted(b, key=lambda x: x[2])]
        assert [(got[page, s][0], got[page, s][1]) for _, s in order] == [(n, k) for k, (n, _) in enumerate(order, 1)]


def test_equal_items_keep_their_panels(spark):
    items = spark.createDataFrame([(1, 7, 0, 0, 10, 10), (1, 7, 0, 0, 10, 10), (1, 8, 500, 0, 510, 10)], "page_id long, seq int, x0 int, y0 int, x1 int, y1 int")
    panels = spark.createDataFrame([(1, 0, 0, 390, 190), (2, 410, 0, 850, 190)], "panel_idx int, px0 int, py0 int, px1 int, py1 int")
    assert sorted((r.seq, r.panel_idx) for r in od.assign_panels(items, panels).collect()) == [(7, 1), (7, 1), (8, 2)]
