"""When a scan may stop: position of each screen, its control decision, stored replays, candidate switches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("run_id", "candidate_record_id")
SLOTS, NO_NEW_LIMIT = 8, 2


def _get(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def uncertain_evidence(df: DataFrame) -> Column:
    """Whether a screen's document or novelty result is in doubt."""
    warn = F.concat(F.coalesce(_get(df, "warning_codes", "array<string>"), F.array().cast("array<string>")), F.coalesce(_get(df, "warnings", "array<string>"), F.array().cast("array<string>")))
    parts = (
        ~F.coalesce(_get(df, "aggregation_status", "string"), F.lit("completed")).isin("not_attempted", "completed"),
        F.size(F.coalesce(_get(df, "uncertain", "array<int>"), F.array().cast("array<int>"))) > 0,
        F.coalesce(_get(df, "uncertain_segment_count", "int"), F.lit(0)) > 0,
        F.coalesce(_get(df, "uncertain_char_count", "int"), F.lit(0)) > 0,
        F.coalesce(_get(df, "duplicate_risk", "string") == "elevated", F.lit(False)),
        F.coalesce(_get(df, "effective_new_status", "string") == "possible", F.lit(False)),
        F.coalesce(_get(df, "comparison_class", "string") == "uncertain", F.lit(False)),
        F.coalesce(_get(df, "similarity_status", "string").isin("partial", "failed", "unavailable"), F.lit(False)),
        F.exists(warn, lambda w: F.lower(w).rlike("possible|uncertain|conflict|mismatch")),
    )
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


#: Warnings that an exact duplicate brings with it.
BENIGN = ("r05_partial", "cross_layer_similarity_conflict", "exact_hash_unavailable")


def blocking_uncertainty(df: DataFrame, exact_same: Column) -> Column:
    """Doubt that forbids "same": any for differing hashes; for equal ones only what a duplicate does not bring with it."""
    status = F.coalesce(_get(df, "aggregation_status", "string"), F.lit("not_attempted"))
    own = F.coalesce(_get(df, "warnings", "array<string>"), F.array().cast("array<string>"))
    codes = F.coalesce(_get(df, "warning_codes", "array<string>"), F.array().cast("array<string>"))
    sim, klass = _get(df, "similarity_status", "string"), _get(df, "comparison_class", "string")
    equal = (
        F.when(F.exists(own, lambda w: w != "screen_aggregation_partial"), True)
        .when(sim.isNull(), False)
        .when(sim.isin("failed", "unavailable"), status != "not_attempted")
        .when(F.exists(codes, lambda w: ~w.isin(*BENIGN)), True)
        .otherwise(F.coalesce((klass == "uncertain") & (status != "partial"), F.lit(False)))
    )
    return F.when(status == "failed", True).when(exact_same, equal).otherwise(uncertain_evidence(df))


def new_content(df: DataFrame, strict: bool = True) -> Column:
    """Positive evidence of new text; strict does not count a bare flag beside a status of "possible" without lines."""
    status = _get(df, "effective_new_status", "string")
    count = F.coalesce(_get(df, "effective_new_segment_count", "int"), F.lit(0))
    flag = F.coalesce(_get(df, "has_effective_new_text", "boolean"), F.lit(False))
    if strict:
        flag = flag & ~F.coalesce((status == "possible") & (count == 0), F.lit(False))
    return F.coalesce(status == "present", F.lit(False)) | (count > 0) | flag


def classify_positions(screens: DataFrame) -> DataFrame:
    """screens (KEY, screen_index, screen_id, exact_hash, fingerprint_version, health and layer columns) with position_status, page_change_status, position_reason, reference_screen_id.

    The reference is the last screen before that was initial, same or changed, which depends on earlier
    results only through what they are compared with: a failed or doubtful screen does not replace it. Doubt
    and health do not depend on the reference, but equality does, so the reference is found by taking the
    screens whose verdict cannot fail (healthy and free of doubt whether equal or not) in a window; the
    others are resolved by a fold over the candidate's few screens.
    """
    cols = [c for c in screens.columns]
    s = screens.withColumn("_health", F.coalesce(_get(screens, "load_health", "boolean") & _get(screens, "ocr_health", "boolean") & _get(screens, "identity_health", "boolean"), F.lit(False)) & F.col("exact_hash").isNotNull() & F.col("fingerprint_version").isNotNull())
    s = s.withColumn("_doubt_same", blocking_uncertainty(screens, F.lit(True))).withColumn("_doubt", blocking_uncertainty(screens, F.lit(False))).withColumn("_new", new_content(screens)).withColumn("_saved", F.coalesce(_get(screens, "saved", "boolean"), F.lit(True)))
    per = s.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("screen_index", "screen_id", "exact_hash", "_health", "_doubt_same", "_doubt", "_new", "_saved"))).alias("a"))
    verdict = "struct<status:string,page:string,reason:string,reference:string>"
    start = F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("hash"), F.array().cast(f"array<{verdict}>").alias("out"))

    def step(acc, x):
        same = acc.hash == x.exact_hash
        doubt = F.when(same, x._doubt_same).otherwise(x._doubt)
        status = F.when(acc.id.isNull(), "initial").when(~x._health, "unavailable").when(doubt, "uncertain").when(same & ~x._new, "same").otherwise("changed")
        page = F.when(acc.id.isNull(), "initial").when(~x._health, "unavailable").when(same, "same").otherwise("changed")
        reason = F.when(status == "initial", "initial_screen").when(status == "unavailable", "position_unavailable").when(status == "uncertain", "position_uncertain").when(status == "same", "exact_same").when(x._new, "effective_new_content").otherwise("exact_different")
        moves = status.isin("initial", "same", "changed") & x._saved
        v = F.struct(status.alias("status"), page.alias("page"), reason.alias("reason"), acc.id.alias("reference"))
        return F.struct(F.when(moves, x.screen_id).otherwise(acc.id).alias("id"), F.when(moves, x.exact_hash).otherwise(acc.hash).alias("hash"), F.concat(acc.out, F.array(v)).alias("out"))

    per = per.withColumn("v", F.aggregate("a", start, step, lambda a: a.out))
    rows = per.select(*KEY, F.explode(F.arrays_zip("a", "v")).alias("z")).select(*KEY, F.col("z.a.screen_id").alias("screen_id"), F.col("z.a.screen_index").alias("screen_index"), "z.v.*")
    rows = rows.withColumnsRenamed({"status": "position_status", "page": "page_change_status", "reason": "position_reason", "reference": "reference_screen_id"})
    return screens.select(*[c for c in cols if c not in ("position_status", "page_change_status", "position_reason", "reference_screen_id")]).join(rows, [*KEY, "screen_id", "screen_index"])


def control(screens: DataFrame, mode: str = "full", limit: int = NO_NEW_LIMIT, slots: int = SLOTS) -> DataFrame:
    """(KEY, stop_index, stop_reason) from screens with position_status in order of screen_index: the first stop by priority.

    interrupted, then failed, then the last slot, then a bottom confirmed by `scroll_bottom_confirmed`, then, in
    full mode, `limit` healthy changed screens in a row without new text. In mode "off" and "shadow" only the
    first three stop; "shadow" gives its prediction in the same columns with shadow_ before them.
    """
    w = Window.partitionBy(*KEY).orderBy("screen_index")
    flag = lambda c: F.coalesce(_get(screens, c, "boolean"), F.lit(False))
    slot = no_new_slot(screens)
    s = screens.withColumn("_n", F.row_number().over(w)).withColumn("_slot", slot)
    s = s.withColumn("_run", F.when(F.col("_slot"), F.col("_n") - F.coalesce(F.max(F.when(~F.col("_slot"), F.col("_n"))).over(w), F.lit(0))).otherwise(0))
    hard = F.when(flag("interrupted"), "interrupted").when(flag("failed"), "failed").when(F.col("screen_index") >= slots, "max_screens")
    soft = F.when(flag("scroll_bottom_confirmed"), "scroll_bottom").when(F.lit(mode in ("full", "shadow")) & (F.col("_run") >= limit), "no_new_text")
    s = s.withColumn("_hard", hard).withColumn("_soft", F.when(F.lit(mode != "off"), soft))
    stop = F.coalesce("_hard", F.when(F.lit(mode in ("safe", "full")), F.col("_soft")))
    first = lambda c: F.min_by(F.struct(F.col("screen_index").alias("i"), c.alias("r")), F.when(c.isNotNull(), F.col("_n")))
    out = s.groupBy(*KEY).agg(first(stop).alias("x"), first(F.col("_soft")).alias("y"))
    return out.select(*KEY, F.col("x.i").alias("stop_index"), F.col("x.r").alias("stop_reason"), F.col("y.i").alias("shadow_stop_index"), F.col("y.r").alias("shadow_stop_reason"))


def no_new_slot(df: DataFrame) -> Column:
    """A formal, changed screen, complete and free of doubt, without new text."""
    return F.coalesce(
        F.col("is_formal") & (F.col("position_status") == "changed") & (_get(df, "aggregation_status", "string") == "completed") & (_get(df, "similarity_status", "string") == "completed") & (_get(df, "effective_new_status", "string") == "none") & ~uncertain_evidence(df) & ~new_content(df, strict=False),
        F.lit(False),
    )


def replay(screens: DataFrame, candidates: DataFrame) -> DataFrame:
    """Stored scans read again: one row per candidate of candidates (KEY, first_predicted_end_screen, first_predicted_end_reason, prediction_* flags, capture_status, abort_reason).

    Returns consecutive_no_new_count, no_new_text_candidate, offline_bottom_status, prediction_would_miss_content,
    prediction_would_miss_rule_match, prediction_observation_complete, prediction_evidence_complete,
    legacy_rule_completed, insufficient_evidence. A stored prediction is at most a possible bottom.
    """
    order = "attempt_order" if "attempt_order" in screens.columns else "screen_index"
    w = Window.partitionBy(*KEY).orderBy(order)
    known = F.coalesce(F.col("position_status").isin("initial", "same", "changed", "uncertain", "unavailable"), F.lit(False))
    s = screens.withColumn("_n", F.row_number().over(w)).withColumn("_known", known).withColumn("_slot", no_new_slot(screens))
    s = s.withColumn("_p", F.when(F.col("_known"), F.col("position_status")).when(F.col("_n") == 1, "initial").otherwise("unavailable"))
    s = s.withColumn("_run", F.when(F.col("_slot"), F.col("_n") - F.coalesce(F.max(F.when(~F.col("_slot"), F.col("_n"))).over(w), F.lit(0))).otherwise(0))
    rule = F.coalesce((_get(screens, "capture_type", "string") == "rule_confirmation") & _get(screens, "legacy_match", "boolean"), F.lit(False))
    s = s.withColumn("_rule", rule).withColumn("_new", new_content(screens, strict=False))
    c = candidates.select(*KEY, F.col("first_predicted_end_screen").alias("_at"))
    s = s.join(c, list(KEY)).withColumn("_after", F.coalesce(F.col("screen_index") >= F.col("_at"), F.lit(False)))
    any_ = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    per = s.groupBy(*KEY).agg(
        F.max_by("_run", "_n").alias("consecutive_no_new_count"), F.max("_run").alias("_top"), any_(~F.col("_known") | F.col("_p").isin("uncertain", "unavailable")).alias("_gap"),
        any_(F.col("_after")).alias("_seen"), any_(F.col("_after") & F.col("_rule")).alias("_rule_after"), any_(F.col("_after") & F.col("_new")).alias("_new_after"), any_(F.col("_rule")).alias("legacy_rule_completed"),
    )
    j = candidates.join(per, list(KEY), "left")
    aborted = F.col("abort_reason").isNotNull()
    none = F.col("first_predicted_end_screen").isNull()
    void = none | aborted
    obs, evi = F.col("prediction_observation_complete"), F.col("prediction_evidence_complete")
    whole = ~none & F.coalesce(obs, F.lit(True)) & F.coalesce(evi, F.lit(True)) & (obs.isNotNull() | evi.isNotNull())
    bottom = ~none & (F.col("first_predicted_end_reason") == "possible_scroll_bottom") & F.col("_seen") & ~aborted & whole
    content = F.when(F.col("_rule_after"), F.when(F.col("_new_after"), True)).when(F.col("_new_after"), True).otherwise(F.col("prediction_would_miss_content"))
    missed = F.when(F.col("_rule_after"), True).otherwise(F.col("prediction_would_miss_rule_match"))
    bottom = F.coalesce(bottom, F.lit(False))
    return j.select(
        *KEY, F.coalesce("consecutive_no_new_count", F.lit(0)).alias("consecutive_no_new_count"), F.coalesce(F.col("_top") >= NO_NEW_LIMIT, F.lit(False)).alias("no_new_text_candidate"),
        F.when(bottom, "possible_scroll_bottom").otherwise("insufficient_evidence").alias("offline_bottom_status"),
        F.when(~void, content).alias("prediction_would_miss_content"), F.when(~void, missed).alias("prediction_would_miss_rule_match"),
        F.when(~void, obs).alias("prediction_observation_complete"), F.when(~void, evi).alias("prediction_evidence_complete"), F.coalesce("legacy_rule_completed", F.lit(False)).alias("legacy_rule_completed"),
        (F.coalesce("_gap", F.lit(False)) | aborted | F.coalesce(F.col("capture_status").isin("aborted", "interrupted"), F.lit(False)) | ~bottom).alias("insufficient_evidence"),
    )


def comparable(hash_: Column, version: Column) -> Column:
    return F.coalesce(hash_.rlike("^[0-9a-f]{64}$") & (F.length(version) > 0), F.lit(False))


def same_fingerprint(h1: Column, v1: Column, h2: Column, v2: Column) -> Column:
    """True, false, or null if either side cannot be compared."""
    return F.when(comparable(h1, v1) & comparable(h2, v2) & (v1 == v2), h1 == h2)


def matches_any(hash_: Column, version: Column, previous: Column) -> Column:
    """Whether a fingerprint is among `previous` (array of struct hash, version): null if there are none, or if one cannot be compared and none is equal."""
    each = F.transform(previous, lambda p: same_fingerprint(hash_, version, p.hash, p.version))
    return F.when(F.size(previous) <= 0, F.lit(None)).when(F.exists(each, lambda x: F.coalesce(x, F.lit(False))), True).when(F.exists(each, lambda x: x.isNull()), F.lit(None)).otherwise(False)


def differs_from_all(hash_: Column, version: Column, previous: Column) -> Column:
    """Whether a fingerprint is provably none of `previous`: null where matches_any is."""
    return ~matches_any(hash_, version, previous)


def benign_warning(code: Column) -> Column:
    """Whether a code is one that an exact duplicate brings with it."""
    return code.isin(*BENIGN_CODES)


#: Codes that come with exact duplicates.
BENIGN_CODES = ("r05_partial", "cross_layer_similarity_conflict", "exact_hash_unavailable", "screen_aggregation_partial", "ui_evidence_insufficient")


def bind_screen_index(observations: DataFrame, index: str) -> DataFrame:
    """observations (fingerprint struct or null, index) with the index in the fingerprint; an index under 1 fails the query."""
    i = F.when(F.col(index) >= 1, F.col(index)).otherwise(F.raise_error(F.lit("screen_index must be 1 or more")).cast("int"))
    return observations.withColumn("fingerprint", F.when(F.col("fingerprint").isNotNull(), F.col("fingerprint").withField("screen_index", i.cast("int"))))


def attach_positions(screens: DataFrame, verdicts: DataFrame) -> DataFrame:
    """screens with the columns of verdicts (KEY, screen_id, ...); a screen that has been given a position keeps it."""
    names = [c for c in verdicts.columns if c not in (*KEY, "screen_id")]
    v = verdicts.select(*KEY, "screen_id", *(F.col(c).alias(f"_v_{c}") for c in names))
    j = screens.join(v, [*KEY, "screen_id"], "left")
    return j.select(*(c for c in screens.columns if c not in names), *((F.coalesce(F.col(c), F.col(f"_v_{c}")) if c in screens.columns else F.col(f"_v_{c}")).alias(c) for c in names))


SCAN_FACTS = (
    "dynamic_end_mode", "dynamic_end_reason", "abort_reason", "scan_slot_count", "normal_scroll_count", "unique_position_count", "ocr_attempt_count", "scroll_retry_count", "focus_restore_count",
    "first_predicted_end_screen", "first_predicted_end_reason", "prediction_would_miss_content", "prediction_would_miss_rule_match", "prediction_observation_complete", "prediction_evidence_complete",
)


def attach_scan(candidates: DataFrame, scans: DataFrame, version: str = "r07-v1") -> DataFrame:
    """candidates (KEY, versions map, ...) with the facts of their scan (KEY, columns of SCAN_FACTS); versions gains dynamic_end where there was a scan."""
    facts = [c for c in SCAN_FACTS if c in scans.columns]
    j = candidates.drop(*facts).join(scans.select(*KEY, *facts), list(KEY), "left")
    there = F.col("dynamic_end_mode").isNotNull()
    return j.withColumn("versions", F.when(there, F.map_concat(F.map_filter("versions", lambda k, v: k != "dynamic_end"), F.create_map(F.lit("dynamic_end"), F.lit(version)))).otherwise(F.col("versions")))


def complete_evidence(df: DataFrame) -> Column:
    """Whether document and novelty layer are complete and say that there is, or is not, new text."""
    return F.coalesce((_get(df, "aggregation_status", "string") == "completed") & (_get(df, "similarity_status", "string") == "completed") & _get(df, "effective_new_status", "string").isin("none", "present"), F.lit(False))


def predictions(screens: DataFrame, limit: int = NO_NEW_LIMIT) -> DataFrame:
    """(KEY, first_predicted_end_screen, first_predicted_end_reason) of a scan in shadow mode: the earliest screen at which it would have stopped; later ones change nothing.

    A certain "same" is a possible bottom; `limit` healthy changed screens in a row, complete and without new
    text, are candidates for no new text. Doubtful positions and same ones end such a row.
    """
    w = Window.partitionBy(*KEY).orderBy("screen_index")
    healthy = F.coalesce(_get(screens, "load_health", "boolean") & _get(screens, "ocr_health", "boolean") & _get(screens, "identity_health", "boolean") & F.coalesce(_get(screens, "saved", "boolean"), F.lit(True)), F.lit(False))
    quiet = (F.col("position_status") == "changed") & complete_evidence(screens) & ~uncertain_evidence(screens) & ~new_content(screens, strict=False)
    s = screens.withColumn("_h", healthy).where("_h").withColumn("_q", F.coalesce(quiet, F.lit(False))).withColumn("_n", F.row_number().over(w))
    s = s.withColumn("_run", F.when(F.col("_q"), F.col("_n") - F.coalesce(F.max(F.when(~F.col("_q"), F.col("_n"))).over(w), F.lit(0))).otherwise(0))
    sure = ~F.coalesce(_get(screens, "insufficient_evidence", "boolean"), F.lit(True))
    why = F.when((F.col("position_status") == "same") & sure, "possible_scroll_bottom").when(F.col("_run") >= limit, "no_new_text_candidate")
    s = s.withColumn("_why", why)
    x = F.min_by(F.struct("screen_index", "_why"), F.when(F.col("_why").isNotNull(), F.col("_n")))
    return s.groupBy(*KEY).agg(x.alias("x")).select(*KEY, F.col("x.screen_index").alias("first_predicted_end_screen"), F.col("x._why").alias("first_predicted_end_reason"))


def prediction_outcomes(screens: DataFrame, predicted: DataFrame, scans: DataFrame) -> DataFrame:
    """What a prediction would have missed: one row per candidate of scans (KEY, completed, interrupt_reason, rule_early_stop).

    Evidence are the saved screens after the predicted one. Without a prediction all is null; a lost record, a
    technical failure or an interruption leave nothing to say; an early stop by a rule means that a match would
    have been missed; else content is missed if some later screen has new text, not missed if all are complete.
    """
    s = screens.join(predicted.select(*KEY, "first_predicted_end_screen"), list(KEY)).where(F.col("screen_index") > F.col("first_predicted_end_screen"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    saved = F.coalesce(_get(screens, "saved", "boolean"), F.lit(True))
    healthy = F.coalesce(_get(screens, "load_health", "boolean") & _get(screens, "ocr_health", "boolean") & _get(screens, "identity_health", "boolean"), F.lit(False))
    firm = ~F.coalesce(F.col("position_status").isin("unavailable", "uncertain"), F.lit(True))
    per = s.groupBy(*KEY).agg(any_(~saved | ~healthy).alias("_broken"), any_(firm & new_content(screens)).alias("_new"), F.coalesce(F.bool_and(firm & complete_evidence(screens)), F.lit(True)).alias("_whole"))
    j = scans.join(predicted.select(*KEY, "first_predicted_end_screen", "first_predicted_end_reason"), list(KEY), "left").join(per, list(KEY), "left")
    none = F.col("first_predicted_end_screen").isNull()
    broken = F.coalesce("_broken", F.lit(False)) | F.col("interrupt_reason").isNotNull()
    rule, done = F.coalesce("rule_early_stop", F.lit(False)), F.coalesce("completed", F.lit(False))
    whole, new = F.coalesce("_whole", F.lit(True)), F.coalesce("_new", F.lit(False))
    ended = ~none & ~broken & ~rule & done
    return j.select(
        *KEY, "first_predicted_end_screen", "first_predicted_end_reason",
        F.when(ended, F.when(new, True).when(whole, False)).alias("prediction_would_miss_content"),
        F.when(~none & ~broken & rule, True).when(ended, False).alias("prediction_would_miss_rule_match"),
        F.when(~none, ended).alias("prediction_observation_complete"), F.when(~none, ended & whole).alias("prediction_evidence_complete"),
    )


def one_recovery(observations: DataFrame, order: str) -> DataFrame:
    """observations without position confirmations beyond each candidate's first: a scan looks again once at most."""
    extra = F.count_if(F.col("capture_type") == "position_confirmation").over(Window.partitionBy(*KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return observations.withColumn("_extra", extra).where((F.col("capture_type") != "position_confirmation") | (F.col("_extra") <= 1)).drop("_extra")


def switch_references(screens: DataFrame, before_switch: DataFrame) -> DataFrame:
    """(KEY, references, reason): what the next page is told apart from, the formal fingerprints in order and the observation before the switch.

    screens (KEY, is_formal, screen_index, exact_hash, fingerprint_version), before_switch (KEY, exact_hash,
    fingerprint_version, load_ready). Typed reasons instead of references: formal_fingerprint_invalid (an index
    outside 1..SLOTS or twice), pre_switch_unavailable (no loaded, comparable observation, or several).
    """
    ok = comparable(F.col("exact_hash"), F.col("fingerprint_version"))
    f = screens.where(F.col("is_formal") & ok & F.col("screen_index").isNotNull())
    formal = f.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("screen_index", F.col("exact_hash").alias("hash"), F.col("fingerprint_version").alias("version")))).alias("_formal"),
        (F.coalesce(F.bool_and(F.col("screen_index").between(1, SLOTS)), F.lit(True)) & (F.count("*") == F.countDistinct("screen_index"))).alias("_valid"),
    )
    good = before_switch.where(ok & F.coalesce("load_ready", F.lit(False))).groupBy(*KEY).agg(F.count("*").alias("_n"), F.min(F.struct(F.lit(None).cast("int").alias("screen_index"), F.col("exact_hash").alias("hash"), F.col("fingerprint_version").alias("version"))).alias("_pre"))
    j = screens.select(*KEY).distinct().join(formal, list(KEY), "left").join(good, list(KEY), "left")
    reason = F.when(F.col("_valid") == F.lit(False), "formal_fingerprint_invalid").when(F.coalesce("_n", F.lit(0)) != 1, "pre_switch_unavailable")
    every = F.concat(F.coalesce("_formal", F.array().cast(j.schema["_formal"].dataType)), F.array("_pre"))
    return j.select(*KEY, F.when(reason.isNull(), every).alias("references"), reason.alias("reason"))


def switch_observations(observations: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """observations (key, order, load_ready, hash, version, previous) with relation and switch_status.

    previous: array of struct<hash, version> of the candidate before. Two equal relations with equal hashes in
    a row settle: old pages mean unchanged, new ones confirmed.
    """
    w = Window.partitionBy(*key).orderBy(order)
    hit = matches_any(F.col("hash"), F.col("version"), F.col("previous"))
    ready = F.col("load_ready") & comparable(F.col("hash"), F.col("version")) & hit.isNotNull()
    s = observations.withColumn("relation", F.when(ready, F.when(hit, "old").otherwise("new")))
    last = lambda c: F.lag(c).over(w)
    stable = same_fingerprint(last("hash"), last("version"), F.col("hash"), F.col("version"))
    settled = F.coalesce((last("relation") == F.col("relation")) & stable, F.lit(False))
    status = F.when(F.col("load_ready") == F.lit(False), "switch_loading").when(F.col("relation").isNull(), "switch_unverifiable").when(settled & (F.col("relation") == "old"), "switch_unchanged").when(settled, "switch_confirmed").otherwise("switch_observing")
    return s.withColumn("switch_status", status)


def within_budget(observations: DataFrame, key: tuple[str, ...], action: str, order: str, actions: int = 2, each: int = 6) -> DataFrame:
    """The observations of at most `actions` actions, `each` apiece, up to the first settled one."""
    w = Window.partitionBy(*key, action).orderBy(order)
    s = observations.withColumn("_k", F.row_number().over(w)).where((F.col("_k") <= each) & (F.col(action) <= actions)).drop("_k")
    before = Window.partitionBy(*key).orderBy(action, order).rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("_done", F.coalesce(F.max((F.col("switch_status") == "switch_confirmed").cast("int")).over(before), F.lit(0))).where("_done = 0").drop("_done")


def attempts(screens: DataFrame, order: str) -> DataFrame:
    """screens with attempt_index: the count so far within capture family and screen."""
    family = F.when(F.col("capture_type").isin("load_check", "load_retry"), "load").otherwise(F.col("capture_type"))
    return screens.withColumn("attempt_index", F.row_number().over(Window.partitionBy(*KEY, family, "screen_index").orderBy(order)))


def stable_hash(screens: DataFrame) -> DataFrame:
    """screens with hash_stable: equal to the hash before (null if either cannot be compared)."""
    w = Window.partitionBy(*KEY).orderBy("screen_index")
    return screens.withColumn("hash_stable", same_fingerprint(F.lag("exact_hash").over(w), F.lag("fingerprint_version").over(w), F.col("exact_hash"), F.col("fingerprint_version")))


#: Reasons that an observation may name itself.
FAILURES = ("load_failed", "switch_failed", "scroll_failed", "ocr_failed", "focus_restore_failed", "position_unresolved", "store_failed", "unexpected_error")


def failure_reason(df: DataFrame, confirming: bool = False) -> Column:
    """Why a saved observation cannot support an end, null if it can: its own reason, then store, load, recognition, switch, position.

    `confirming` also asks that the position is "same" and certain.
    """
    bad = lambda c: ~F.coalesce(_get(df, c, "boolean"), F.lit(False))
    position, own = _get(df, "position_status", "string"), _get(df, "failure_reason", "string")
    first = F.when(own.isin(*FAILURES), own).when(bad("saved"), "store_failed")
    if confirming:
        first = first.when(position.isNull(), "position_unresolved")
    out = first.when(bad("load_health"), "load_failed").when(bad("ocr_health"), "ocr_failed").when(bad("identity_health"), "switch_failed")
    if confirming:
        unsure = F.coalesce(_get(df, "insufficient_evidence", "boolean"), F.lit(True))
        return out.when((position != "same") | unsure, "position_unresolved")
    return out.when(position.isNull(), "position_unresolved")


def rule_confirmations(observations: DataFrame, order: str) -> DataFrame:
    """observations (KEY, order, capture_type, rule_index) with confirmed: a second look that matches the same rule as the look before."""
    before = F.lag("rule_index").over(Window.partitionBy(*KEY).orderBy(order))
    return observations.withColumn("confirmed", (F.col("capture_type") == "rule_confirmation") & F.coalesce(before == F.col("rule_index"), F.lit(False)))


def promoted(observations: DataFrame, order: str, slots: int = SLOTS) -> DataFrame:
    """observations with capture_type, is_formal, screen_index: a position confirmation whose position is "changed" becomes the next formal screen."""
    up = (F.col("capture_type") == "position_confirmation") & (F.col("position_status") == "changed")
    formal = F.col("is_formal") | up
    n = F.count_if(formal).over(Window.partitionBy(*KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = observations.withColumn("_n", n).withColumn("_up", up)
    return (
        s.withColumn("screen_index", F.when(F.col("_up"), F.least(F.lit(slots), F.col("_n")).cast("int")).otherwise(F.col("screen_index")))
        .withColumn("is_formal", F.col("is_formal") | F.col("_up")).withColumn("capture_type", F.when(F.col("_up"), "formal_screen").otherwise(F.col("capture_type"))).drop("_n", "_up")
    )


def load_attempts(observations: DataFrame, order: str, limit: int = 4) -> DataFrame:
    """(KEY, loaded, attempts, action) of looks (KEY, order, loaded): the first of `limit` that is loaded, else recover."""
    k = F.row_number().over(Window.partitionBy(*KEY).orderBy(order))
    s = observations.withColumn("_k", k).where(F.col("_k") <= limit)
    first = F.min(F.when(F.col("loaded"), F.col("_k")))
    return s.groupBy(*KEY).agg(first.isNotNull().alias("loaded"), F.coalesce(first, F.max("_k")).cast("int").alias("attempts")).withColumn("action", F.when(F.col("loaded"), "scan").when(F.col("attempts") < limit, "retry").otherwise("recover"))


def previous_pages(screens: DataFrame) -> DataFrame:
    """(KEY, previous, reason): the comparable hashes of a candidate's formal screens, against which the next page is told apart; a reason where there are none."""
    ok = F.col("is_formal") & comparable(F.col("exact_hash"), F.col("fingerprint_version"))
    per = screens.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.when(ok, F.struct(F.col("exact_hash").alias("hash"), F.col("fingerprint_version").alias("version"))))).alias("previous"))
    return per.withColumn("reason", F.when(F.size("previous") == 0, "previous_fingerprints_unavailable"))


def capture_outcome(stop_reason: Column, interrupt_reason: Column | None = None, abort_reason: Column | None = None) -> Column:
    """(capture_status, end_reason, abort_reason) of a scan.

    Interruptions and aborts come first; a bottom, no new text or the last slot complete it with a limit;
    else it completed in its ordinary course.
    """
    none = F.lit(None).cast("string")
    stop_by = none if interrupt_reason is None else interrupt_reason
    abort = none if abort_reason is None else F.when(F.length(abort_reason) > 0, abort_reason)
    limit = F.when(stop_reason.isin("scroll_bottom", "no_new_text"), stop_reason).when(stop_reason.isin("max_screens", "max_screen_limit"), "max_screen_limit")
    interrupted = F.coalesce(stop_by.isin("user_interrupted", "runtime_expired"), F.lit(False)) | F.coalesce(stop_reason == "interrupted", F.lit(False))
    abort = F.coalesce(abort, F.when(stop_reason == "failed", "failed"))
    status = F.when(interrupted, "interrupted").when(abort.isNotNull(), "aborted").when(limit.isNotNull(), "completed_with_limit").otherwise("completed")
    end = F.when(~interrupted & abort.isNull(), F.coalesce(limit, F.lit("existing_flow_completed")))
    return F.struct(status.alias("capture_status"), end.alias("end_reason"), F.when(end.isNull(), F.coalesce(stop_by, abort, F.lit("interrupted"))).alias("abort_reason"))
