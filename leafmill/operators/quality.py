"""A rule engine for record quality: staged rules that detect, resolve and log, in one projection.

Rules of a stage run in registry order; each sees what the ones before it have changed. A hit adds
an event and applies the rule's updates; a rule may drop its record. Data and event log come from
the same scan."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import clusters as cl
from leafmill.functions import text as tx
from leafmill.functions.polygons import bound

Build = Callable[[], Column]


@dataclass(frozen=True)
class Rule:
    name: str
    stage: str
    detect: Build
    updates: dict[str, Build] = field(default_factory=dict)
    severity: str = "auto_fix"
    drop: bool = False
    #: What the condition and the updates are made of; where none of it is null, a null result is an error.
    inputs: tuple[str, ...] = ()


def _col(name: str) -> Build:
    return lambda: F.col(name)


# Thresholds are the record model's; learned ones can be given to ``rules``. Where ``contained`` is given as an
# expression and not as a column, only what is used of it is computed.
def rules(constriction: float = 0.65, margin: float = 12.0, tolerance: float = 35.0, contained: Build = _col("contained")) -> tuple[Rule, ...]:
    c = F.col
    dark = lambda: (c("mean_luminance") < 140) & (c("percentile_75") < 180)
    banner = lambda: (c("line_w") / F.greatest(F.lit(1), c("line_h")) >= 4) & (c("mean_saturation") >= 60)
    tint = lambda: ~banner() & (c("mean_luminance") >= 120) & (c("percentile_75") >= 155) & (c("max_val") >= 160) & ((c("sat_std") <= 22) | (c("sat_std") <= 0.4 * F.greatest(F.lit(1.0), c("mean_saturation"))))
    return (
        Rule("sfx_false_positive", "ocr_filtering", lambda: dark() | banner() | (~tint() & (c("mean_saturation") > 85) & (c("bright_ratio") < 0.15)), drop=True),
        Rule("diamond_rule_line_split", "line_pairing", lambda: (c("gap_y") <= c("max_dy")) & (c("gap_x") > 0) & (c("c_dist") <= F.greatest(c("wider_half") * c("tolerance"), c("max_dx"))), {"allow_connection": lambda: F.lit(True)}),
        Rule("adjacent_bubble_merging_cross_column", "line_clustering", lambda: cl.column_cut(c("lines")).isNotNull(), {"clusters": lambda: cl.cut_columns(c("lines"))}),
        Rule("figure8_double_lobed_bubble", "figure8_clustering", lambda: cl.stacked_cut(c("lines")).isNotNull(), {"clusters": lambda: cl.cut_stacked(c("lines"))}),
        Rule("background_art_leak", "contour_extraction", lambda: c("misplaced") | c("low_solidity") | (c("ratio_to_text") > c("effective_ratio_cap")) | (c("border_touch") & (c("ratio_to_roi") > c("roi_leak_ratio"))), {"contour": lambda: contained()["points"], "is_rectangular_fill": lambda: contained()["is_rectangle"]}),
        Rule("earpiece_rect_misclassification", "bubble_inpainting", lambda: (c("z_order") == 0) & (c("shape_type") == "rectangle"), {"shape_type": lambda: F.lit("oval")}),
        Rule("empty_fragment", "bubble_validation", lambda: F.trim(F.coalesce("original_text", F.lit(""))) == "", drop=True),
        Rule("duplicate_bubble_id", "bubble_list_indexing", lambda: cl.out_of_order(F.transform("bubbles", lambda b: b["id"])), {"bubbles": lambda: cl.renumbered(c("bubbles"))}),
        Rule("sliver_too_small_for_text", "fragment_processing", lambda: (F.length(F.trim("text")) >= 8) & ((c("area") < 1200) | (c("h") < 15) | (c("w") < 25)), {"quality_warning": lambda: F.lit("sliver_too_small_for_text")}, "flag_for_review"),
        Rule("residual_ink_under_lettering", "post_clean", lambda: c("residual_ink_count") > 30, {"needs_second_pass": lambda: F.lit(True)}),
        Rule("conjoined_bubble_constriction_split", "bubble_segmentation", lambda: ((c("constriction_ratio") <= 0.88) | c("is_multi_lobe")) & c("has_split_lines"), {"is_split": lambda: F.lit(True)}),
        Rule("caption_shape_destruction", "bubble_inpainting", lambda: ((c("fill_ratio") < 0.94) | (c("corners") > 5)) & ((c("shape_type") == "rectangle") | c("is_rectangular_fill")), {"shape_type": lambda: F.lit("shaped_caption"), "is_rectangular_fill": lambda: F.lit(False)}),
        Rule("touching_bubbles_merged", "bubble_review_edit", lambda: (c("has_split_lines") & (c("constriction_ratio") <= constriction)) | c("is_touching_merged"), {"is_split": lambda: F.lit(True)}),
        Rule("clipped_bubble_edge", "bubble_review_edit", lambda: (c("text_contour_margin") < margin) | c("is_clipped_edge"), {"suggested_tolerance": lambda: F.lit(tolerance), "is_expanded": lambda: F.lit(True)}),
        Rule("tinted_spectral_bubble_preservation", "bubble_inpainting", lambda: c("is_tinted") | c("bg_is_tinted") | c("text_is_spectral") | F.exists(F.coalesce("tint", F.array().cast("array<int>")), lambda v: v != 255), {"is_tinted": lambda: F.lit(True)}),
        Rule("occluded_crescent_text_tuck", "lettering", lambda: c("is_occluded") & c("top_rect_y1").isNotNull(), {"y1_pos": lambda: c("top_rect_y1") - 3}),
        Rule("translation_sentence_drop", "translation_validation", lambda: tx.drops_sentence(c("source_text"), c("target_text")), {"needs_review": lambda: F.lit(True), "quality_warning": lambda: F.lit("translation_sentence_drop")}, "flag_for_review"),
        Rule("translation_cross_check_mismatch", "translation_validation", lambda: c("cross_check_mismatch"), {"needs_review": lambda: F.lit(True)}, "flag_for_review"),
    )


#: Measures that a record may lack, and what then holds.
OPTIONAL = {"corners": 4}

EVENT = "array<struct<pattern_name:string,stage:string,severity:string,action_taken:string>>"


@contextmanager
def lenient(spark: SparkSession):
    """Expressions that are made inside give null where they would end the job: a division by zero,
    a cast that fails, an overflow, a place that an array lacks."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _event(rule: Rule, severity: str, action: str) -> Column:
    return F.struct(F.lit(rule.name).alias("pattern_name"), F.lit(rule.stage).alias("stage"), F.lit(severity).alias("severity"), F.lit(action).alias("action_taken"))


def apply_stage(df: DataFrame, stage: str, registry: tuple[Rule, ...] | None = None) -> DataFrame:
    """``df`` after all rules of ``stage``, with ``events`` and ``dropped`` added.

    A rule whose condition is null does not hit. Updates that name a missing column add it. A rule
    never ends the job: where its condition, or an update of a hit, is null although none of its
    ``inputs`` is, the record stays as it was and the rule adds an event of severity "error"."""
    added = {name: F.lit(value) for name, value in OPTIONAL.items() if name not in df.columns}
    out = df.withColumns({**added, "events": F.array().cast(EVENT), "dropped": F.lit(False)})
    with lenient(df.sparkSession):
        for r in registry or rules():
            if r.stage == stage:
                out = _applied(out, r)
    return out.drop(*added)


def _applied(out: DataFrame, r: Rule) -> DataFrame:
    given = F.lit(bool(r.inputs))
    for name in r.inputs:
        given = given & F.col(name).isNotNull()
    out = out.withColumn("_met", r.detect()).withColumn("_hit", F.coalesce("_met", F.lit(False)) & ~F.col("dropped"))
    broken = given & F.col("_met").isNull() & ~F.col("dropped")
    for value in r.updates.values():
        broken = broken | (given & F.col("_hit") & value().isNull())
    out = out.withColumn("_broken", F.coalesce(broken, F.lit(False))).withColumn("_hit", F.col("_hit") & ~F.col("_broken"))
    updates = {}
    for name, value in r.updates.items():
        old = F.col(name) if name in out.columns else F.lit(None)
        updates[name] = F.when(F.col("_hit"), value()).otherwise(old)
    event = F.when(F.col("_broken"), _event(r, "error", "exception_in_gate")).when(F.col("_hit"), _event(r, r.severity, "dropped" if r.drop else "resolved"))
    updates["events"] = F.when(F.col("_hit") | F.col("_broken"), F.concat("events", F.array(event))).otherwise(F.col("events"))
    if r.drop:
        updates["dropped"] = F.col("dropped") | F.col("_hit")
    return out.withColumns(updates).drop("_met", "_hit", "_broken")


def apply_stages(df: DataFrame, stages: list[str], registry: tuple[Rule, ...] | None = None) -> DataFrame:
    """``df`` after several stages, one after the other, with the events of all; what one drops the next leave alone."""
    log = F.array().cast(EVENT)
    out = df.withColumns({"log": log, "gone": F.lit(False)})
    for stage in stages:
        out = apply_stage(out, stage, registry)
        # what a stage gives is computed once, however many stages follow
        out = bound(out, log=F.when(F.col("gone"), F.col("log")).otherwise(F.concat("log", "events")), gone=F.col("gone") | F.col("dropped")).drop("events", "dropped")
    return out.withColumnsRenamed({"log": "events", "gone": "dropped"})


def event_log(applied: DataFrame, *key: str) -> DataFrame:
    return applied.select(*key, F.explode("events").alias("e")).select(*key, "e.*")


def pattern_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("pattern_name").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq")


def severity_split(events: DataFrame) -> DataFrame:
    """Per page: events, fixes, flags, and the names of the flagged patterns."""
    flag = F.col("severity") == "flag_for_review"
    return events.groupBy("page_id").agg(F.count("*").alias("n_events"), F.count_if(~flag).alias("n_fixed"), F.count_if(flag).alias("n_flagged"), F.array_join(F.array_sort(F.collect_set(F.when(flag, F.col("pattern_name")))), ",").alias("flagged"))
