"""What is new on a screen: reference, similarity signals, overlap accounting, decisions per line, class.

All of it is column expressions, equi-joins and windows on the candidate's key; candidates have few screens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from evidra import config
from evidra.functions import geometry, text

KEY = ("run_id", "candidate_record_id")
CURRENT_SCHEMAS = ("1.3.0", "1.4.0")


def ordered_warnings(codes: Column) -> Column:
    """Distinct codes in the canonical order."""
    return F.filter(F.array(*map(F.lit, config.WARNINGS)), lambda w: F.array_contains(codes, w))


def _codes(*pairs) -> Column:
    """An array of the codes whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))


def _index_before() -> WindowSpec:
    """A candidate's screens of the index before."""
    return Window.partitionBy(*KEY).orderBy(F.col("screen_index").cast("long")).rangeBetween(-1, -1)


def resolve_references(screens: DataFrame) -> DataFrame:
    """screens with reference: struct<status, screen_id, screen_index, source, warning>.

    A formal screen n refers to the formal screen n - 1 of its candidate (windows on one deal by candidate);
    the first has none; no such screen is missing, several are a conflict. Other screens refer to
    `explicit_reference_id`, if the column is there, by the relations that are allowed; an id that only another
    candidate or run has is a mismatch. A screen that comes after a repeated id in its candidate has a conflict.
    """
    s = screens
    for c, kind in (("capture_type", "string"), ("attempt_index", "int"), ("source_schema_version", "string")):
        if c not in s.columns:
            s = s.withColumn(c, F.lit(None).cast(kind))
    explicit = "explicit_reference_id" in screens.columns
    if not explicit:
        s = s.withColumn("explicit_reference_id", F.lit(None).cast("string"))
    place = F.struct(F.coalesce("screen_index", F.lit(0)), F.coalesce("attempt_index", F.lit(0)))
    again = F.row_number().over(Window.partitionBy(*KEY, "screen_id").orderBy(place)) == 2
    s = s.repartition(*KEY).withColumn("_again", F.when(again, place)).withColumn("_twice", F.coalesce(F.min("_again").over(Window.partitionBy(*KEY)) < place, F.lit(False))).drop("_again")
    formal = lambda c: F.when(F.col("is_formal"), c)
    before = _index_before()
    j = s.withColumn("_t", formal(F.col("screen_index") - 1)).withColumn("_n", F.nullif(F.count(formal(F.lit(1))).over(before), F.lit(0))).withColumn("_id", F.min(formal(F.col("screen_id"))).over(before))
    j = j.withColumn("_e", F.when(~F.col("is_formal"), F.col("explicit_reference_id")))
    if explicit:
        fields = F.struct(F.col("is_formal").alias("f"), F.col("screen_index").alias("i"), F.col("capture_type").alias("c"), F.col("attempt_index").alias("a"))
        by_id = s.groupBy(*KEY, F.col("screen_id").alias("_e")).agg(F.min(fields).alias("_x"))
        others = s.groupBy(F.col("screen_id").alias("_e")).agg(F.collect_set("run_id").alias("_runs"))
        j = j.join(by_id, [*KEY, "_e"], "left").join(others, "_e", "left")
        j = j.select(*s.columns, "_t", "_n", "_id", "_e", F.col("_x.f").alias("_f"), F.col("_x.i").alias("_i"), F.col("_x.c").alias("_c"), F.col("_x.a").alias("_a"), "_runs")
    else:
        none = {"_f": "boolean", "_i": "int", "_c": "string", "_a": "int", "_runs": "array<string>"}
        j = j.select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    current = F.coalesce(F.col("source_schema_version").isin(*CURRENT_SCHEMAS), F.lit(True))
    related = ((F.col("capture_type") == "scroll_confirmation") & F.col("_f") & (F.col("_i") == F.col("screen_index"))) | (
        (F.col("capture_type") == "load_retry") & F.col("_c").isin("load_check", "load_retry") & (F.col("_a") < F.col("attempt_index"))
    )
    none = F.lit(None)
    source = F.when(current, "formal_previous_index").otherwise("reconstructed_formal_index")

    def out(status, sid=none, index=none, src=none, warning=none):
        cast = lambda x, t, n: (x if isinstance(x, Column) else F.lit(x)).cast(t).alias(n)
        return F.struct(cast(status, "string", "status"), cast(sid, "string", "screen_id"), cast(index, "int", "screen_index"), cast(src, "string", "source"), cast(warning, "string", "warning"))

    formal_case = (
        F.when(F.col("screen_index") == 1, out("no_reference", src="none"))
        .when(F.col("screen_index").isNull() | (F.col("screen_index") < 1), out("unavailable", src="formal_previous_index", warning="reference_index_invalid"))
        .when(F.col("_n").isNull(), out("unavailable", src=source, warning="reference_missing"))
        .when(F.col("_n") > 1, out("unavailable", src=source, warning="reference_conflict"))
        .otherwise(out("resolved", F.col("_id"), F.col("_t"), source))
    )
    other = (
        F.when(~current & F.col("explicit_reference_id").isNull(), out("unavailable", src="explicit_record", warning="legacy_reference_unavailable"))
        .when(F.col("_f").isNull() & F.col("_runs").isNotNull() & ~F.array_contains("_runs", F.col("run_id")), out("unavailable", src="explicit_record", warning="reference_run_mismatch"))
        .when(F.col("_f").isNull() & F.col("_runs").isNotNull(), out("unavailable", src="explicit_record", warning="reference_candidate_mismatch"))
        .when(F.col("_c").isNull() & F.col("_f").isNull(), out("unavailable", src="explicit_record", warning="reference_missing"))
        .when(F.coalesce(related, F.lit(False)), out("resolved", F.col("_e"), F.col("_i"), "explicit_record"))
        .otherwise(out("unavailable", src="explicit_record", warning="reference_capture_invalid"))
    )
    twice = out("unavailable", src="formal_previous_index", warning="duplicate_screen_id_conflict")
    return j.withColumn("reference", F.when(F.col("_twice"), twice).when(F.col("is_formal"), formal_case).otherwise(other)).select(*screens.columns, "reference")


def _one(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key, the least, so that reruns agree."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*")


def signals(screens: DataFrame, adjacent: bool = False) -> DataFrame:
    """screens (with reference) with ref_text, exact_same, similarity_score, ngram_scores, simhash, reference_simhash, hamming_distance, simhash_score, signal_warnings.

    `adjacent`: references are those of resolve_references and none is explicit, so that texts need not be moved
    again: the screen before lies in the same window.
    """
    if "similarity_hash" not in screens.columns:
        screens = screens.withColumn("similarity_hash", text.simhash(F.when(F.col("normalization_status") == "completed", F.col("comparison_text"))))
    held = {"ref_text": "comparison_text", "_h": "exact_hash", "_v": "fingerprint_version", "_s": "normalization_status", "_sim": "similarity_hash"}
    j = screens.withColumn("_r", F.when(F.col("reference.status") == "resolved", F.col("reference.screen_id")))
    if adjacent:
        least = F.min(F.struct(*(F.col(c).alias(n) for n, c in held.items()))).over(Window.partitionBy(*KEY, "screen_id"))
        j = j.withColumn("_least", least).withColumn("_least", F.min(F.when(F.col("is_formal"), F.col("_least"))).over(_index_before()))
        j = j.select("*", *(F.when(F.col("_r").isNotNull(), F.col(f"_least.{n}")).alias(n) for n in held)).drop("_least")
    else:
        ref = screens.select(*KEY, F.col("screen_id").alias("_r"), *(F.col(c).alias(n) for n, c in held.items()))
        j = j.join(_one(ref, [*KEY, "_r"]), [*KEY, "_r"], "left")
    there = F.col("_r").isNotNull()
    hashes = F.coalesce(F.col("exact_hash").rlike("^[0-9a-f]{64}$") & F.col("_h").rlike("^[0-9a-f]{64}$"), F.lit(False))
    versions = F.coalesce((F.col("fingerprint_version") == "r03-v1") & (F.col("_v") == "r03-v1"), F.lit(False))
    ready = there & F.coalesce((F.col("normalization_status") == "completed") & (F.col("_s") == "completed"), F.lit(False))
    d = text.dice(F.when(ready, F.col("ref_text")), F.when(ready, F.col("comparison_text")))
    j = j.withColumn("_d", d)
    short = F.col("_d.warning").isNull()
    far = F.when(ready & short, text.hamming(F.col("similarity_hash"), F.col("_sim")))
    warn = _codes(
        (there & ~hashes, "exact_hash_unavailable"), (there & hashes & ~versions, "fingerprint_version_mismatch"),
        (there & ~ready, "r04_not_completed"), (F.col("_d.warning").isNotNull(), "comparison_text_too_long"),
    )
    out = (
        j.withColumn("exact_same", F.when(there & hashes & versions, F.col("exact_hash") == F.col("_h")))
        .withColumn("similarity_score", F.col("_d.score")).withColumn("ngram_scores", F.col("_d.scores"))
        .withColumn("simhash", F.when(ready & short, F.col("similarity_hash"))).withColumn("reference_simhash", F.when(ready & short, F.col("_sim")))
        .withColumn("hamming_distance", far).withColumn("simhash_score", 1 - far / F.lit(64.0)).withColumn("signal_warnings", warn)
    )
    return out.drop("_r", "_h", "_v", "_s", "_sim", "_d")


def _field(name: str):
    return lambda g: g[name]


def _size_of(at: str) -> Column:
    return F.aggregate(F.col(at), F.lit(0), lambda a, k: a + F.length(F.element_at("segments", k + 1).comparison_text))


def accounting(screens: DataFrame) -> DataFrame:
    """screens with accounting: counts and ratios of matched, new and uncertain lines, or not verifiable.

    The three lists of line numbers must part the lines exactly, each in order, and the stored counts must
    be those of the lists; nothing is repaired. Ratios keep their numerators and denominator.
    """
    n = F.size("segments")
    every = F.concat("matched", "new", "uncertain")
    whole = (F.array_sort(every) == F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: k)).otherwise(F.array().cast("array<int>"))) & (
        (F.array_sort("matched") == F.col("matched")) & (F.array_sort("new") == F.col("new")) & (F.array_sort("uncertain") == F.col("uncertain"))
    )
    tried, failed = F.col("aggregation_status").isin("completed", "partial"), F.col("aggregation_status") == "failed"
    spaced = F.exists("segments", lambda s: text.has_space(s.comparison_text))
    s = screens.withColumn("_o", F.when(whole, _size_of("matched"))).withColumn("_n", F.when(whole, _size_of("new"))).withColumn("_u", F.when(whole, _size_of("uncertain")))
    stored = (
        (F.col("overlap_char_count") == F.col("_o")) & (F.col("new_text_char_count") == F.col("_n") + F.col("_u")) & (F.col("uncertain_char_count") == F.col("_u"))
        & (F.col("overlap_segment_count") == F.size("matched")) & (F.col("new_segment_count") == F.size("new") + F.size("uncertain"))
        & (F.col("certain_new_segment_count") == F.size("new")) & (F.col("uncertain_segment_count") == F.size("uncertain"))
    )
    stored = F.coalesce(stored, F.lit(False))
    ok = tried & whole & ~spaced & stored
    total = F.col("_o") + F.col("_n") + F.col("_u")
    warn = _codes(
        (failed, "r05_failed"), (~tried & ~failed | F.col("aggregation_status").isNull(), "r05_not_attempted"), (F.col("aggregation_status") == "partial", "r05_partial"),
        (tried & ~whole, "segment_partition_invalid"), (tried & whole & spaced, "accounting_mismatch"), (tried & whole & ~spaced & ~stored, "r05_projection_mismatch"), (ok & (total == 0), "zero_effective_char_denominator"),
    )
    keep = lambda c, name: F.when(ok, c).alias(name)
    ratio = lambda c, name: F.when(ok & (total > 0), c / F.nullif(total, F.lit(0))).alias(name)
    return s.withColumn(
        "accounting",
        F.struct(
            F.coalesce(ok, F.lit(False)).alias("verifiable"), keep(F.col("_o"), "overlap_chars"), keep(F.col("_n"), "new_chars"), keep(F.col("_u"), "uncertain_chars"), keep(total, "chars"),
            ratio(F.col("_o"), "overlap_ratio"), ratio(F.col("_n"), "new_ratio"), ratio(F.col("_u"), "uncertain_ratio"), warn.alias("warnings"),
        ),
    ).drop("_o", "_n", "_u")


def line_decisions(screens: DataFrame, c: dict = config.NOVELTY) -> DataFrame:
    """(key, screen_id, line, kind, decision, reason, chars) for every new or uncertain line.

    Repeated furniture is found over the candidate's formal screens so far: a text on three or more of them
    whose boxes stay where they are and keep their size. The windows run over one text of one candidate.
    """
    if "boxes" not in screens.columns:
        return _decided(_lines_of(screens), c)
    s = screens
    if "duplicate_groups" not in s.columns:
        s = s.withColumn("duplicate_groups", F.lit(None).cast("array<struct<retained_box_id:string,suppressed_duplicate_box_ids:array<string>,pair_evidence:array<struct<decision:string>>>>"))
    rows = _lines_of(s, "screen_index", "is_formal", "boxes", "duplicate_groups", F.size("new").alias("_news"))
    first = F.filter("boxes", lambda b: b.box_id == F.element_at("_ids", 1))
    known = F.coalesce(F.size("_ids") > 0, F.lit(False)) & F.coalesce(F.forall("_ids", lambda i: F.exists("boxes", lambda b: b.box_id == i)), F.lit(False))
    rows = rows.withColumn("_box", F.when(known, F.element_at(first, 1)))
    rows = rows.withColumn("_g", geometry.bounds(F.col("_box.bbox")))
    # the first formal screens of a candidate make the context, one box per screen and text, the last line's
    first_ones = F.col("is_formal") & (F.dense_rank().over(Window.partitionBy(*KEY).orderBy(F.when(F.col("is_formal"), F.col("screen_index")).asc_nulls_last())) <= c["max_formal_screens"])
    per = rows.withColumn("_in", first_ones).where("_in and _box is not null").groupBy(*KEY, "_c", "screen_index").agg(F.max_by("_g", "line").alias("_g"))
    w = Window.partitionBy(*KEY, "_c").orderBy("screen_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("_all", F.collect_list("_g").over(w))
    count = F.size("_all")
    polygons = F.forall("_all", lambda g: g.error.isNull() & (g["shape"] == "polygon"))
    mean_x, mean_y = (F.aggregate(F.transform("_all", _field(k)), F.lit(0.0), lambda a, x: a + x) / count for k in ("center_x", "center_y"))
    middle = F.element_at(F.array_sort(F.transform("_all", lambda g: g.height)), F.floor(count / 2).cast("int") + 1)
    base = F.element_at("_all", 1)
    near = F.forall("_all", lambda g: F.hypot(g.center_x - mean_x, g.center_y - mean_y) <= F.greatest(F.lit(c["ui_center_tolerance_min_px"]), middle * c["ui_center_tolerance_height_ratio"]))
    alike = (base.width > 0) & (base.height > 0) & F.forall("_all", lambda g: (g.width > 0) & (g.height > 0) & (F.least(F.least(g.width, base.width) / F.nullif(F.greatest(g.width, base.width), F.lit(0.0)), F.least(g.height, base.height) / F.nullif(F.greatest(g.height, base.height), F.lit(0.0))) >= c["ui_min_size_similarity"]))
    enough = count >= c["ui_min_formal_screen_occurrences"]
    fixed = F.coalesce(polygons & near & alike, F.lit(False))
    per = per.select(*KEY, "_c", "screen_index", (enough & fixed).alias("_noise"), F.when(enough, ~fixed).otherwise(count >= 2).alias("_unproved"))
    j = rows.join(per, [*KEY, "_c", "screen_index"], "left")
    has_box = F.col("_box").isNotNull()
    noise = has_box & ~F.col("_protected") & F.coalesce("_noise", F.lit(False))
    unproved = ~F.col("_protected") & (~has_box | F.coalesce("_unproved", F.lit(False)))
    low = (
        (F.col("_news") == 1) & has_box & (F.size("_ids") == 1)
        & F.coalesce(F.col("_box.confidence").between(c["effective_min_confidence"], c["effective_min_confidence"] + c["low_confidence_delta"]), F.lit(False))
        & (F.length("_c") <= c["low_confidence_max_chars"]) & ~F.col("_protected") & ~text.has_content(F.col("_c"))
    )
    # the layout layer never marks pairs "duplicate", so this stays false for its output
    artifact = has_box & F.coalesce(F.exists("duplicate_groups", lambda g: (F.size(g.pair_evidence) > 0) & F.forall(g.pair_evidence, lambda p: p.decision == "duplicate") & F.arrays_overlap(F.array_append(g.suppressed_duplicate_box_ids, g.retained_box_id), F.col("_ids"))), F.lit(False))
    return _decided(j.withColumn("_noise_", noise).withColumn("_open", unproved).withColumn("_low", low).withColumn("_artifact", artifact), c)


def _lines_of(screens: DataFrame, *more) -> DataFrame:
    """A row for every line of screens: texts (_c, _t), box ids, protection."""
    rows = screens.select(*KEY, "screen_id", "new", "uncertain", *more, F.posexplode("segments").alias("line", "seg"))
    rows = rows.select("*", F.col("seg.comparison_text").alias("_c"), F.col("seg.normalized_text").alias("_t"), F.col("seg.box_ids").alias("_ids")).drop("seg")
    return rows.withColumn("_protected", text.is_protected(F.col("_c"), F.col("_t")))


def _decided(rows: DataFrame, c: dict) -> DataFrame:
    """Decisions and reasons of lines; without evidence of boxes no line is noise, and only protected ones are proved."""
    there = "_open" in rows.columns
    noise, low, artifact = (F.col(x) if there else F.lit(False) for x in ("_noise_", "_low", "_artifact"))
    unproved = F.col("_open") if there else ~F.col("_protected")
    fresh, unsure = F.array_contains("new", F.col("line")), F.array_contains("uncertain", F.col("line"))
    reason = _reason(F.col("_c"), unsure, F.col("_protected"), unproved, artifact, low, noise)
    rows = rows.where(fresh | unsure).withColumn("reason", reason)
    return rows.select(*KEY, "screen_id", "line", F.when(fresh, "new").otherwise("uncertain").alias("kind"), _decision(F.col("reason")).alias("decision"), "reason", F.length("_c").alias("chars"), (fresh & (F.col("reason") == "evidence_insufficient") & unproved).alias("ui_insufficient"))


def _reason(c: Column, unsure: Column, protected: Column, unproved: Column, artifact: Column, low: Column, noise: Column) -> Column:
    return (
        F.when(unsure, "source_uncertain")
        .when(~protected & text.format_chars(c), "format_only").when(artifact, "duplicate_artifact").when(low, "low_confidence_noise")
        .when(noise, "likely_repeated_ui_noise").when(protected, "short_text_protected").when(unproved, "evidence_insufficient")
        .when(text.has_content(c), "effective_content").otherwise("evidence_insufficient")
    )


def _decision(reason: Column) -> Column:
    return F.when(reason.isin("short_text_protected", "effective_content"), "effective").when(reason.isin("source_uncertain", "evidence_insufficient"), "uncertain").otherwise("ineffective")


def effective_own(screens: DataFrame) -> DataFrame:
    """effective_new of screens without boxes and their line_decisions, screen by screen: no line needs others, so no row moves."""
    no = F.lit(False)

    def line(x, i):
        fresh, unsure, protected = F.array_contains("new", i), F.array_contains("uncertain", i), text.is_protected(x.comparison_text, x.normalized_text)
        return geometry.let(F.struct(fresh.alias("f"), unsure.alias("u"), protected.alias("p"), x.comparison_text.alias("c")), reasoned)

    def reasoned(x):
        reason = F.when(x.f | x.u, _reason(x.c, x.u, x.p, ~x.p, no, no, no))
        return F.struct(reason.alias("reason"), F.length(x.c).alias("chars"), x.f.alias("f"))

    s = screens.withColumn("_lines", F.filter(F.transform("segments", line), lambda x: x.reason.isNotNull()))
    of = lambda d: F.filter("_lines", lambda x: _decision(x.reason) == d)
    chars = lambda d: F.aggregate(of(d), F.lit(0), lambda a, x: a + x.chars)
    weak = F.exists("_lines", lambda x: x.f & (x.reason == "evidence_insufficient"))  # without boxes such lines are never protected
    per = {"_e": F.size(of("effective")), "_i": F.size(of("ineffective")), "_p": F.size(of("uncertain")), "_ec": chars("effective"), "_pc": chars("uncertain"), "_w": weak}
    per = {k: F.when(F.size("_lines") > 0, v) for k, v in per.items()}
    return _effective(s.withColumns(per).drop("_lines"))


def effective_new(screens: DataFrame, decisions: DataFrame) -> DataFrame:
    """screens (with accounting) with effective: status, counts and characters; unavailable without verifiable accounting."""
    by = lambda d: F.sum(F.when(F.col("decision") == d, 1).otherwise(0))
    chars = lambda d: F.sum(F.when(F.col("decision") == d, F.col("chars")).otherwise(0))
    per = decisions.groupBy(*KEY, "screen_id").agg(by("effective").alias("_e"), by("ineffective").alias("_i"), by("uncertain").alias("_p"), chars("effective").alias("_ec"), chars("uncertain").alias("_pc"), F.max("ui_insufficient").alias("_w"))
    return _effective(screens.join(per, [*KEY, "screen_id"], "left"))


def _effective(screens: DataFrame) -> DataFrame:
    """screens with effective for the counts _e, _i, _p, the characters _ec, _pc and the warning _w of their lines."""
    touched = F.coalesce(F.exists("match_evidence", lambda e: F.arrays_overlap(e.current_lines, F.concat("new", "uncertain"))), F.lit(False)) if "match_evidence" in screens.columns else F.lit(False)
    ok = F.col("accounting.verifiable") & ~touched
    zero = lambda c: F.when(ok, F.coalesce(c, F.lit(0)))
    e, p = zero("_e"), zero("_p")
    status = F.when(~ok, "unavailable").when(e > 0, "present").when(p > 0, "possible").otherwise("none")
    warn = _codes((touched, "segment_partition_invalid"), (ok & F.coalesce("_w", F.lit(False)), "ui_evidence_insufficient"))
    return screens.withColumn("effective", F.struct(status.alias("status"), e.cast("int").alias("effective_count"), zero("_i").cast("int").alias("ineffective_count"), p.cast("int").alias("possible_count"), zero("_ec").cast("int").alias("effective_chars"), zero("_pc").cast("int").alias("possible_chars"), (e > 0).alias("has_effective_new_text"), warn.alias("warnings"))).drop("_e", "_i", "_p", "_ec", "_pc", "_w")


def _own_facts() -> Column:
    """What classify asks of a screen's own lists: whether there are new or uncertain lines, and whether a list that it needs is not there."""
    failed = F.col("segments").isNull() | F.col("new").isNull() | F.col("uncertain").isNull() | F.col("matched").isNull() | (F.col("screen_index") < 0)
    failed = F.coalesce(failed & F.col("aggregation_status").isin("completed", "partial"), F.lit(False))
    return F.struct((F.size("new") + F.size("uncertain") > 0).alias("news"), failed.alias("failed"))


def classify(screens: DataFrame, c: dict = config.NOVELTY) -> DataFrame:
    """screens (with reference, signals, accounting, effective) with similarity_status, comparison_class, warning_codes."""
    ref, acc, eff = F.col("reference.status"), F.col("accounting"), F.col("effective.status")
    has = lambda w: F.array_contains("signal_warnings", w)
    status = (
        F.when(ref == "no_reference", "no_reference").when((ref != "resolved") | has("r04_not_completed"), "unavailable")
        .when(has("comparison_text_too_long") | ~acc.verifiable | F.array_contains(acc.warnings, "r05_partial") | (eff == "unavailable"), "partial").otherwise("completed")
    )
    facts = _own_facts()
    if "_own" in screens.columns:
        facts = F.col("_own")
    conflict = F.coalesce(F.col("exact_same"), F.lit(False)) & (
        F.coalesce(F.col("ref_text") != F.col("comparison_text"), F.lit(False)) | F.coalesce(F.abs(F.col("similarity_score") - 1) > c["floating_point_tolerance"], F.lit(False)) | facts.news
    )
    conflict = conflict & (eff != "unavailable")
    status = F.when(conflict & (status == "completed"), "partial").otherwise(status)
    blank = (ref == "resolved") & ((F.coalesce("comparison_text", F.lit("")) == "") | (F.coalesce("ref_text", F.lit("")) == ""))
    more = lambda a, b: F.when(eff == "present", a).otherwise(b)
    klass = (
        F.when(eff == "unavailable", "uncertain")
        .when(status.isin("no_reference", "unavailable") | blank, "empty_or_unavailable")
        .when(conflict | (eff == "possible"), "uncertain")
        .when(F.col("exact_same"), "exact_same")
        .when(F.col("similarity_score").isNull(), "uncertain")
        .when(F.col("similarity_score") >= c["high_similarity_threshold"], more(F.lit("high_similarity_with_effective_new"), F.lit("high_similarity_without_effective_new")))
        .otherwise(more(F.lit("changed_with_effective_new"), F.lit("changed_without_effective_new")))
    )
    # a screen without the lists that the layer reads fails by itself, with a code and no content
    failed = facts.failed
    codes = F.concat(F.array_compact(F.array("reference.warning")), "signal_warnings", acc.warnings, F.col("effective.warnings"), _codes((conflict, "cross_layer_similarity_conflict")))
    codes = F.when(failed, F.concat(F.array_compact(F.array("reference.warning")), F.array(F.lit("evaluation_failed")))).otherwise(codes)
    status, klass = F.when(failed, "failed").otherwise(status), F.when(failed, "empty_or_unavailable").otherwise(klass)
    return screens.withColumn("similarity_status", status).withColumn("comparison_class", klass).withColumn("warning_codes", ordered_warnings(codes))


def evaluate(screens: DataFrame) -> DataFrame:
    """The whole layer over screens with their document result (see operators.document): one row per screen.

    What a screen's own lists give is made first, so that screens of which the rest is not asked move without them.
    """
    s = accounting(screens).withColumn("_own", _own_facts())
    s = effective_new(s, line_decisions(s)) if "boxes" in screens.columns else effective_own(s)
    s = signals(resolve_references(s), adjacent="explicit_reference_id" not in screens.columns)
    return classify(s).drop("_own")


def with_identity(screens: DataFrame) -> DataFrame:
    """screens with similarity_identity: struct<version, config_version, config_digest> of the layer, which every stored result carries."""
    snapshot = config.novelty_snapshot()
    return screens.withColumn("similarity_identity", F.struct(F.lit(snapshot["similarity_version"]).alias("version"), F.lit(snapshot["similarity_config_version"]).alias("config_version"), F.lit(config.digest(snapshot)).alias("config_digest")))


def failed_similarity(screens: DataFrame) -> DataFrame:
    """screens (is_formal) as typed failures of the layer: reference unavailable, class unavailable, the one code evaluation_failed, no scores."""
    source = F.when(F.coalesce("is_formal", F.lit(False)), "formal_previous_index").otherwise("explicit_record")
    none = F.lit(None).cast("string")
    reference = F.struct(F.lit("unavailable").alias("status"), none.alias("screen_id"), F.lit(None).cast("int").alias("screen_index"), source.alias("source"), F.lit("evaluation_failed").alias("warning"))
    s = screens.withColumn("reference", reference).withColumn("similarity_status", F.lit("failed")).withColumn("comparison_class", F.lit("empty_or_unavailable")).withColumn("warning_codes", F.array(F.lit("evaluation_failed")))
    for c, t in (("similarity_score", "double"), ("similarity_hash", "string"), ("overlap_ratio", "double"), ("new_text_ratio", "double"), ("has_effective_new_text", "boolean")):
        s = s.withColumn(c, F.lit(None).cast(t))
    return with_identity(s)
