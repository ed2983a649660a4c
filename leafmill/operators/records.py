"""Record-level derivations and decisions over page items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import sounds as sound
from leafmill.functions.geometry import coerced


def rescaled(contour: Column, sx: float, sy: float) -> Column:
    """A polygon in another page size; coordinates are rounded half to even."""
    return F.transform(contour, lambda p: F.array(F.bround(p[0] * sx).cast("int"), F.bround(p[1] * sy).cast("int")))


def unit_vector(dx: Column, dy: Column) -> Column:
    """(x, y) of length one, or zeros."""
    n = F.hypot(dx, dy)
    return F.struct(F.when(n > 0, dx / n).otherwise(0.0).alias("x"), F.when(n > 0, dy / n).otherwise(0.0).alias("y"))


def projected(x: Column, y: Column, dx: Column, dy: Column, length: Column, panel: tuple[Column, ...], slack: int = 5) -> Column:
    """Where a ray ends, held inside of the panel by ``slack`` pixels, truncated to whole ones."""
    px0, py0, px1, py1 = panel
    hold = lambda v, lo, hi: F.greatest(lo + slack, F.least(hi - slack, v.cast("int")))
    return F.struct(hold(x + dx * length, px0, px1).alias("x"), hold(y + dy * length, py0, py1).alias("y"))


def step(value: Column, bounds: list[tuple[float, float]], rest: float) -> Column:
    """The result of the first bound that the value stays under."""
    out = F.when(F.lit(False), rest)
    for limit, result in bounds:
        out = out.when(value < limit, result)
    return out.otherwise(rest)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def newer(version: Column, than: Column) -> Column:
    """Whether a version's numbers come later."""
    numbers = lambda v: F.transform(F.regexp_extract_all(v, F.lit("(\\d+)")), lambda x: x.cast("int"))
    return numbers(version) > numbers(than)


def reread(own_text: Column, own_conf: Column, other_text: Column, other_conf: Column, sure: float) -> Column:
    """Keep a sure reading; else the other one where it differs and is surer."""
    return F.when((own_conf >= sure) | other_text.isNull(), own_text).when((other_text != own_text) & (other_conf > own_conf), other_text).otherwise(own_text)


def speaker(shape: Column, has_tail: Column, off_panel: Column, candidate: Column, known: list[str], blocked: list[str], nearest: Column, nearest_conf: Column, least: float = 0.5) -> Column:
    """(speaker, confidence in hundredths) by the first rule that matches."""
    pick = lambda name, n: F.struct(name.cast("string").alias("speaker"), F.lit(n).cast("int").alias("confidence"))
    return (
        F.when((shape == "rectangle") & ~has_tail, pick(F.lit("narrator"), 95)).when(off_panel, pick(F.coalesce(candidate, F.lit("off_panel")), 90))
        .when(candidate.isin(*known) & ~candidate.isin(*blocked), pick(candidate, 92))
        .when(nearest_conf >= least, F.struct(nearest.cast("string").alias("speaker"), F.floor(nearest_conf * 100).cast("int").alias("confidence")))
        .otherwise(pick(F.lit(None), 0))
    )


def visible(df: DataFrame) -> DataFrame:
    """Items of active, printable layers that are not hidden, lowest layer first."""
    return df.where(F.col("active") & F.col("printable") & ~F.col("hidden")).withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("z_order", "y0", "seq")))


def anomalies(items: DataFrame, width: int, height: int, slack: int = 50) -> DataFrame:
    """Items that reach out of their page, with the first side that does."""
    why = F.when(F.col("x0") < 0, "left").when(F.col("y0") < 0, "top").when(F.col("x1") > width + slack, "right").when(F.col("y1") > height + slack, "bottom")
    return items.withColumn("why", why).where("why is not null")


def first_text(*texts: Column) -> Column:
    """The first text that is not blank."""
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts])


def routed(items: DataFrame, least: float) -> DataFrame:
    """Mean confidence of each page and where it goes."""
    mean = F.avg("conf_pct")
    return items.groupBy("page_id").agg(mean.alias("mean_conf"), F.when(mean < least, "second_reader").otherwise("done").alias("route"))


def deltas(steps: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each step's value and its change from the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return steps.select(key, order, value, (F.col(value) - F.coalesce(before, F.lit(0))).alias("delta"))


def outlier_runs(values: DataFrame, key: str, pos: str, value: str, factor: float = 1.2) -> DataFrame:
    """Runs of neighbouring places whose value lies over the third quartile by ``factor`` spreads."""
    quartiles = values.groupBy(key).agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"))
    hits = values.join(quartiles, key).where(F.col(value) > F.col("q3") + factor * (F.col("q3") - F.col("q1")))
    island = F.col(pos) - F.row_number().over(Window.partitionBy(key).orderBy(pos))
    return hits.withColumn("island", island).groupBy(key, "island").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.max(value).alias("peak")).drop("island")


def clause_split(clauses: DataFrame, key: list[str], share: float) -> DataFrame:
    """The number of clauses whose length together comes nearest to ``share`` of all, the fewest of equals (in thousandths)."""
    over = Window.partitionBy(*key)
    run = F.sum("size").over(over.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    x = clauses.withColumn("off", F.abs(1000 * run - F.lit(int(share * 1000)) * F.sum("size").over(over)))
    return x.groupBy(*key).agg(F.min(F.struct("off", "i")).alias("m")).select(*key, F.col("m.i").alias("n_first"))


def top_two(scored: DataFrame, key: list[str], least: int, apart: int) -> DataFrame:
    """The best place of each group, and the second if it scores ``least`` and lies ``apart`` from it."""
    over = Window.partitionBy(*key)
    x = scored.withColumn("r", F.row_number().over(over.orderBy(F.desc("score"), "pos"))).where("r <= 2")
    x = x.withColumn("best", F.max(F.when(F.col("r") == 1, F.col("pos"))).over(over))
    return x.where((F.col("r") == 1) | ((F.col("score") >= least) & (F.abs(F.col("pos") - F.col("best")) >= apart))).select(*key, "pos", "score", "r")


def rule_hits(texts: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """How many texts each rule matches: one scan, one row a rule."""
    hits = texts.agg(*[F.count_if(F.col("text").rlike(p)).alias(n) for n, p in patterns], F.count("*").alias("all_texts"))
    return hits.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("hits"), F.col("all_texts")) for n, _ in patterns])).alias("r")).select("r.*")


def neck(profile: Column, most: float) -> Column:
    """(at, ratio): the narrowest place in the middle half of a width profile, if it is at most
    ``most`` of the smaller peak of the outer quarters; else null. Ratio in thousandths."""
    n = F.size(profile)
    q = F.floor(n / 4).cast("int")
    left, right = F.array_max(F.slice(profile, F.lit(1), q)), F.array_max(F.slice(profile, n - q + 1, q))
    middle = F.slice(profile, q + 1, n - 2 * q)
    low = F.array_min(middle)
    at = q + F.array_position(middle, low).cast("int")
    ratio = F.floor(1000 * low / F.greatest(F.lit(1), F.least(left, right))).cast("long")
    return F.when((q > 0) & (ratio <= int(1000 * most)), F.struct(at.alias("at"), ratio.alias("ratio")))


def image_statistics(pixels: DataFrame, key: list[str], bright: int = 170, dark: int = 130) -> DataFrame:
    """Statistics of images whose pixels are rows (key, v): n, mean, median, p75, std, max_val, n_bright, n_dark.

    The deviation is taken from whole-number sums, so that it does not depend on their order."""
    v, n = F.col("v").cast("long"), F.count("v")
    spread = F.sqrt((n * F.sum(v * v) - F.sum(v) * F.sum(v)).cast("double")) / n
    return pixels.groupBy(*key).agg(n.alias("n"), (F.sum(v) / n).alias("mean"), F.percentile("v", 0.5).alias("median"), F.percentile("v", 0.75).alias("p75"), spread.alias("std"), F.max("v").alias("max_val"), F.count_if(v > bright).alias("n_bright"), F.count_if(v < dark).alias("n_dark"))


# Marks and words of speech, and what signs of places end on.
SPEECH_MARKS = ('"', "'", "“", "”", "...", "…", "!", "?", ",", ";", ":")
SPEECH_WORDS = (
    "you i we he she they it are is was were am my your his her their our the this that not no to in on at by for with from and but or so if "
    "what why how when where who yes yeah ok okay"
).split()
PLACES = "INSTITUTE|UNIVERSITY|HOSPITAL|LABORATORY|BUILDING|CENTER|TOWER|CORP|DEPARTMENT|POLICE|STATION|ACADEMY|AVENUE|STREET|BLVD|HIGH SCHOOL"
SIGN = f"(?i)^(THE\\s+)?([A-Z0-9\\s-]+)?({PLACES})$"


def reads_as_speech(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"))
    marked = F.lit(False)
    for mark in SPEECH_MARKS:
        marked = marked | text.contains(mark)
    return marked | (F.size(words) >= 4) | F.exists(words, lambda w: w.isin(*SPEECH_WORDS))


def candidate_verdict(text: Column, kind: Column, width: Column, height: Column, top: Column, page_height: Column, is_sound: Column, p90: Column | None = None) -> Column:
    """Why a text candidate is no dialogue, the first rule that matches, else 'kept'.

    ``kind`` is what the reader took it for; ``p90`` the brightness of its crop, where known."""
    t = F.trim(text)
    letters, aspect = F.length(F.regexp_replace(t, "[^a-zA-Z]+", "")), width / height
    loose = ~reads_as_speech(t) & (kind != "speech")
    small = loose & (letters < 4) & ((aspect >= 5) | ((top < F.floor(page_height * 0.05)) & (aspect >= 4)))
    if p90 is not None:
        small = small | (loose & (letters < 4) & (p90 < 100))
    return (
        F.when((width <= 10) | (height <= 10), "too small").when(letters < 1, "no letters")
        .when(is_sound & ~kind.isin("speech", "caption", "thought"), "sound").when(loose & t.rlike(SIGN) & (aspect >= 3), "sign")
        .when(small, "background").otherwise("kept")
    )


def fragments(lines: DataFrame, boxes: DataFrame, margin: int = 15) -> DataFrame:
    """Each box (page_id, rect_idx, ...) with its lines in order: those whose middle is at most ``margin`` outside."""
    b = boxes.select("page_id", "rect_idx", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = F.expr("(x0 + x1) div 2"), F.expr("(y0 + y1) div 2")
    near = cx.between(F.col("r_x0") - margin, F.col("r_x1") + margin) & cy.between(F.col("r_y0") - margin, F.col("r_y1") + margin)
    return lines.join(b, "page_id").where(near).groupBy("page_id", "rect_idx").agg(F.array_sort(F.collect_list("seq")).alias("lines"))


def better_base(own: Column, other: Column, own_score: Column, other_score: Column, agrees: Column) -> Column:
    """(text, source): the other translation where it agrees and is more natural, else the own one."""
    wins = F.coalesce(agrees & (other_score > own_score), F.lit(False))
    return F.struct(F.when(wins, other).otherwise(own).alias("text"), F.when(wins, "other").otherwise("own").alias("source"))


def completed(items: DataFrame) -> DataFrame:
    """Items with what they lack: a box of usual size, the clean text from the original one, and the kind
    of a text that is a sound effect (exact matches of the dictionary)."""
    box = coerced()
    text = F.coalesce(first_text(F.col("clean_text"), F.col("original_text")), F.lit(""))
    return items.withColumns({"x1": box.x1, "y1": box.y1, "clean_text": text}).withColumn("sfx_category", _kinds()[sound.letters_of(F.upper("clean_text"))]).withColumn("is_sfx", F.col("sfx_category").isNotNull())


def _kinds() -> Column:
    first: dict[str, str] = {}
    for name, kind, _, _ in sound.dictionary():
        first.setdefault(name, kind)
    return F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
