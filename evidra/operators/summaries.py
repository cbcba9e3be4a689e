"""Counts per candidate and over whole runs, and the constraints that stored records must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra import config
from evidra.functions import text

KEY = ("run_id", "candidate_record_id")
STATUSES = ("completed", "failed", "not_attempted")


def _n(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def normalization_summary(screens: DataFrame) -> DataFrame:
    """Six counts per candidate: formal or not, by normalization status."""
    formal = F.coalesce("is_formal", F.lit(False))
    cells = [_n((formal if k == "formal" else ~formal) & (F.col("normalization_status") == s)).alias(f"{k}_normalization_{s}_count") for k in ("formal", "nonformal") for s in STATUSES]
    return screens.groupBy(*KEY).agg(*cells)


def aggregation_summary(screens: DataFrame) -> DataFrame:
    """Formal screens: counts by status, sums of lines and characters. new_char_count holds uncertain characters too, new_segment_count does not."""
    f = F.coalesce("is_formal", F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(f, c)), F.lit(0))
    return screens.groupBy(*KEY).agg(
        _n(f).alias("formal_screen_count"), *(_n(f & (F.col("aggregation_status") == s)).alias(f"{s}_screen_count") for s in ("completed", "partial", "failed")),
        *(total(F.greatest(F.size(c), F.lit(0))).alias(f"{n}_segment_count") for c, n in (("matched", "matched"), ("new", "new"), ("uncertain", "uncertain"))),
        *(total(F.coalesce(c, F.lit(0))).alias(f"{n}_char_count") for c, n in (("overlap_char_count", "matched"), ("new_text_char_count", "new"), ("uncertain_char_count", "uncertain"))),
    )


CLASSES = ("exact_same", "high_similarity_with_effective_new", "high_similarity_without_effective_new", "changed_with_effective_new", "changed_without_effective_new", "empty_or_unavailable", "uncertain")


def similarity_summary(screens: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Counts per candidate by status, class and effective-new status, and warnings in canonical order; candidates without screens get zeros."""
    eff = F.col("effective.status") if "effective" in screens.columns else F.col("effective_new_status")
    has = lambda w: F.sum(F.size(F.filter("warning_codes", lambda x: x == w)))
    per = screens.withColumn("warning_codes", F.coalesce("warning_codes", F.array().cast("array<string>"))).groupBy(*KEY).agg(
        F.count("*").alias("screen_count"),
        *(_n(F.col("similarity_status") == s).alias(f"{s}_screen_count") for s in ("not_attempted", "completed", "partial", "failed", "unavailable", "no_reference")),
        *(_n(F.col("comparison_class") == s).alias(f"{s}_class_count") for s in CLASSES),
        *(_n(eff == s).alias(f"effective_{s}_screen_count") for s in ("present", "possible", "none", "unavailable")),
        F.sum(F.size("warning_codes")).cast("int").alias("warning_count"), *(has(w).alias(f"_w{k}") for k, w in enumerate(config.WARNINGS)),
    )
    tally = F.filter(F.array(*(F.struct(F.lit(w).alias("code"), F.col(f"_w{k}").cast("int").alias("count")) for k, w in enumerate(config.WARNINGS))), lambda t: t["count"] > 0)
    per = per.withColumn("warning_code_counts", tally).drop(*(f"_w{k}" for k in range(len(config.WARNINGS))))
    if candidates is not None:
        per = candidates.select(*KEY).distinct().join(per, list(KEY), "left").na.fill(0)
        per = per.withColumn("warning_code_counts", F.coalesce("warning_code_counts", F.array().cast(per.schema["warning_code_counts"].dataType)))
    return per


def summary_or_counts(screens: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """similarity_summary that never fails a candidate: where its breakdowns do not add up, those by class and effectiveness are null and `fallback` is true."""
    s = summary_violations(similarity_summary(screens, candidates))
    bad = F.size("violations") > 0
    for c in s.columns:
        if c.endswith("_class_count") or c.startswith("effective_"):
            s = s.withColumn(c, F.when(~bad, F.col(c)))
    return s.withColumn("fallback", bad).drop("violations")


def capture_summary(screens: DataFrame) -> DataFrame:
    """Per candidate: distinct formal screens, attempts, scroll attempts and retries, last index."""
    f = F.coalesce("is_formal", F.lit(False))
    return screens.groupBy(*KEY).agg(
        F.countDistinct(F.when(f, F.col("screen_index"))).alias("actual_screen_count"), F.count("*").alias("ocr_attempt_count"),
        _n(F.col("capture_type") == "scroll_confirmation").alias("scroll_attempt_count"), _n((F.col("capture_type") == "scroll_confirmation") & (F.col("attempt_index") > 1)).alias("scroll_retry_count"), F.max(F.when(f, F.col("screen_index"))).alias("end_screen_index"),
    )


def tenth(x: Column) -> Column:
    """The tenth that a number in 0..1 falls in, as "0.3-0.4"; 1 falls in "1.0-1.0"."""
    k = F.floor(x * 10)
    return F.format_string("%.1f-%.1f", k / 10.0, F.least(F.lit(1.0), (k + 1) / 10.0))


def statistics(screens: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(kind, value, n): histograms of statuses, classes, warnings, reasons, scores and ratios over all screens."""
    eff = "effective.status" if "effective" in screens.columns else "effective_new_status"
    one = lambda kind, c: screens.select(F.lit(kind).alias("kind"), c.alias("value"))
    parts = [one("similarity_status", F.col("similarity_status")), one("comparison_class", F.col("comparison_class")), one("effective_new_status", F.col(eff)), one("similarity_score", tenth(F.col("similarity_score"))), screens.select(F.lit("warning").alias("kind"), F.explode("warning_codes").alias("value"))]
    if "accounting" in screens.columns:
        parts += [one("ratio", tenth(F.col(f"accounting.{r}"))) for r in ("overlap_ratio", "new_ratio", "uncertain_ratio")]
    if decisions is not None:
        parts.append(decisions.select(F.lit("reason").alias("kind"), F.col("reason").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))


def one_identity(rows: DataFrame, *columns: str) -> DataFrame:
    """(identities, consistent): how many different identity triples rows carry."""
    return rows.agg(F.countDistinct(*columns).alias("identities")).withColumn("consistent", F.col("identities") == 1)


# --- constraints: what a record violates is data -----------------------------------------------------------------


def _violations(*pairs) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in pairs]))


def layout_violations(s: DataFrame) -> DataFrame:
    """screens of the layout layer with violations."""
    ids = F.flatten(F.transform("lines", lambda x: x.box_ids))
    failed = F.col("normalization_status") == "failed"
    return s.withColumn("violations", _violations(
        ("boxes_split_by_confidence", failed | (F.col("eligible_box_count") + F.col("low_confidence_box_count") == F.greatest(F.size("boxes"), F.lit(0)))),
        ("eligible_boxes_partition", failed | (F.size("ordered_box_ids") + F.size("suppressed_duplicate_box_ids") + F.col("empty_normalized_box_count") == F.col("eligible_box_count"))),
        ("lines_are_the_order", ids == F.col("ordered_box_ids")),
        ("gray_pairs_mean_risk", (F.col("duplicate_gray_pair_count") > 0) == F.col("duplicate_risk")),
        ("failure_has_a_type", failed == F.col("normalization_error_type").isNotNull()),
        ("text_is_the_lines", failed | (F.col("normalized_text") == F.array_join(F.transform("lines", lambda x: x.normalized_text), "\n"))),
    ))


def screen_violations(s: DataFrame) -> DataFrame:
    """screens of the document layer with violations."""
    every = F.array_sort(F.concat("matched", "new", "uncertain"))
    done = F.col("aggregation_status").isin("completed", "partial")
    matched = F.array_sort(F.array_distinct(F.flatten(F.transform("match_evidence", lambda e: e.current_lines))))
    return s.withColumn("violations", _violations(
        ("lines_partition", ~done | (F.size("segments") == 0) & (F.size(every) == 0) | (every == F.sequence(F.lit(0), F.greatest(F.size("segments") - 1, F.lit(0))))),
        ("lists_in_order", (F.array_sort("matched") == F.col("matched")) & (F.array_sort("new") == F.col("new")) & (F.array_sort("uncertain") == F.col("uncertain"))),
        ("evidence_is_the_matches", matched == F.col("matched")),
        ("completed_is_certain", (F.col("aggregation_status") != "completed") | (F.size("uncertain") == 0) & (F.size("warnings") == 0)),
        ("partial_is_elevated", (F.col("aggregation_status") != "partial") | (F.col("duplicate_risk") == "elevated")),
        ("counts_are_the_lists", ~done | (F.col("overlap_segment_count") == F.size("matched")) & (F.col("new_segment_count") == F.size("new") + F.size("uncertain"))),
    ))


def document_violations(c: DataFrame) -> DataFrame:
    """candidates of the document layer with violations."""
    ids = F.flatten(F.transform("screens", lambda s: F.transform(s.match_evidence, lambda e: e.match_id)))
    known = F.transform("screens", lambda s: s.screen_id)
    return c.withColumn("violations", _violations(
        ("text_is_the_segments", F.col("document_text").isNull() | (F.col("document_text") == F.array_join(F.transform("document_segments", lambda x: x.normalized_text), "\n"))),
        ("match_ids_unique", F.size(ids) == F.size(F.array_distinct(ids))),
        ("occurrences_exist", F.forall("document_segments", lambda d: F.forall(d.occurrences, lambda o: F.array_contains(known, o.screen_id)))),
        ("first_occurrence_is_an_origin", F.forall("document_segments", lambda d: F.element_at(d.occurrences, 1).role.isin("origin", "uncertain_origin"))),
    ))


def outcome_violations(c: DataFrame) -> DataFrame:
    """candidates with capture_status, end_reason, abort_reason: exactly one reason, fitting the status."""
    return c.withColumn("violations", _violations(
        ("one_reason", F.col("end_reason").isNotNull() != F.col("abort_reason").isNotNull()),
        ("reason_fits", F.when(F.col("capture_status").isin("completed", "completed_with_limit"), F.col("end_reason").isNotNull()).otherwise(F.col("abort_reason").isNotNull())),
    ))


def line_id_violations(s: DataFrame) -> DataFrame:
    """screens (screen_id, segments with segment_id, order, screen_index) with violations: ids are screen:line:n, orders contiguous from 0, one index of 1 or more, texts not empty and without white space."""
    at = lambda f: F.forall(F.zip_with("segments", F.transform("segments", lambda x, i: i), f), lambda ok: F.coalesce(ok, F.lit(False)))
    return s.withColumn("violations", _violations(
        ("screen_is_not_empty", F.size("segments") > 0),
        ("line_ids", at(lambda x, i: x.segment_id == F.concat_ws(":", "screen_id", F.lit("line"), i))),
        ("order_is_contiguous", at(lambda x, i: x.order == i)),
        ("one_screen_index", at(lambda x, i: (x.screen_index == F.element_at("segments", 1).screen_index) & (x.screen_index >= 1))),
        ("texts", at(lambda x, i: (x.normalized_text != "") & (x.comparison_text != "") & ~x.comparison_text.rlike(text.SPACE))),
    ))


def source_box_violations(s: DataFrame) -> DataFrame:
    """screens (boxes, ordered_box_ids, segments) with violations: every segment's boxes are known, follow the reading order, and belong to one segment."""
    ids = F.flatten(F.transform("segments", lambda x: x.box_ids))
    return s.withColumn("violations", _violations(
        ("boxes_are_known", F.size(F.array_except(ids, F.transform("boxes", lambda b: b.box_id))) == 0),
        ("boxes_in_order", F.transform(ids, lambda i: F.array_position("ordered_box_ids", i)) == F.array_sort(F.transform(ids, lambda i: F.array_position("ordered_box_ids", i)))),
        ("boxes_are_unique", F.size(ids) == F.size(F.array_distinct(ids))),
    ))


def id_ok(ids: Column, pattern: str) -> Column:
    """Whether all ids match a grammar and are distinct."""
    return F.forall(ids, lambda i: i.rlike(pattern)) & (F.size(ids) == F.size(F.array_distinct(ids)))


def summary_violations(s: DataFrame) -> DataFrame:
    """similarity summaries whose breakdowns do not each sum to screen_count."""
    add = lambda suffix: sum((F.col(c) for c in s.columns if c.endswith(suffix)), F.lit(0))
    eff = sum((F.col(c) for c in s.columns if c.startswith("effective_") and c.endswith("_screen_count")), F.lit(0))
    status = sum((F.col(f"{k}_screen_count") for k in ("not_attempted", "completed", "partial", "failed", "unavailable", "no_reference")), F.lit(0))
    return s.withColumn("violations", _violations(("status", status == F.col("screen_count")), ("class", add("_class_count") == F.col("screen_count")), ("effective", eff == F.col("screen_count"))))
