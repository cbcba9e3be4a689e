"""Screening: model input and reply contracts, attempts, error codes, decisions, profiles, the model benchmark's report."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import rules, text

MAX_ATTEMPTS, MAX_MESSAGE = 3, 512
# Provider codes that stand for billing and model trouble.
BILLING_CODES = ("Arrearage", "AllocationQuota.FreeTierOnly", "CommodityNotPurchased", "PrepaidBillOverdue", "PostpaidBillOverdue")
MODEL_CODES = ("Model.AccessDenied", "ModelNotFound", "model_not_found", "model_not_supported")


def read_reply(raw: str | None, ids: list[str]) -> tuple[dict | None, str | None]:
    """(results in the order of ids, error) of a model's reply: strict JSON, exact members, real booleans, each id once."""

    def members(pairs):
        if len(dict(pairs)) < len(pairs):
            raise LookupError
        return dict(pairs)

    def constant(_):
        raise ArithmeticError

    try:
        v = json.loads(raw or "", object_pairs_hook=members, parse_constant=constant)
    except LookupError:
        return None, "duplicate_member"
    except ArithmeticError:
        return None, "non_json_constant"
    except (ValueError, RecursionError):
        return None, "invalid_json"
    if not isinstance(v, dict):
        return None, "not_an_object"
    if set(v) != {"criteria_results"}:
        return None, "top_level_schema"
    if not isinstance(v["criteria_results"], list):
        return None, "results_not_an_array"
    got: dict[str, bool] = {}
    for x in v["criteria_results"]:
        if not isinstance(x, dict):
            return None, "item_not_an_object"
        if set(x) != {"criterion_id", "passed"}:
            return None, "item_schema"
        if not isinstance(x["criterion_id"], str):
            return None, "criterion_id_not_a_string"
        if not isinstance(x["passed"], bool):
            return None, "passed_not_a_boolean"
        if x["criterion_id"] in got:
            return None, "duplicate_criterion"
        got[x["criterion_id"]] = x["passed"]
    if set(got) != set(ids):
        return None, "criteria_incomplete_or_unknown"
    return {i: got[i] for i in ids}, None


@text.arrow("struct<results:map<string,boolean>,error:string>")
def _replies(raw: pd.Series, ids: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_reply(r, list(i)) for r, i in zip(raw, ids)], columns=["results", "error"])


def validate_replies(raw: Column, ids: Column) -> Column:
    """struct<results, error> of replies against an array of criterion ids."""
    return _replies(raw, ids)


def same_ids(returned: Column, expected: Column) -> Column:
    """Whether two id arrays hold the same ids, each once."""
    return (F.size(F.array_except(returned, expected)) == 0) & (F.size(F.array_except(expected, returned)) == 0) & (F.size(returned) == F.size(F.array_distinct(returned)))


def candidate_input(document_text: Column) -> Column:
    """The text, null if it is blank."""
    return F.when(F.coalesce(text.strip(document_text), F.lit("")) != "", document_text)


def prompt_payload(criteria: Column, document_text: Column) -> Column:
    """Compact JSON of criteria (array of struct criterion_id, criterion_text) and text."""
    short = F.transform(criteria, lambda c: F.struct(c.criterion_id.alias("criterion_id"), c.criterion_text.alias("criterion_text")))
    return F.to_json(F.struct(short.alias("criteria"), document_text.alias("resume_text")), {"ignoreNullFields": "false"})


def attempt_outcomes(attempts: DataFrame, ids: Column) -> DataFrame:
    """attempts (run_id, candidate_record_id, attempt_number, document_text, provider_error, raw_response) with ai_status, criteria_results, failure_stage, failure_type, message."""
    reply = validate_replies(F.when(F.col("provider_error").isNull(), F.col("raw_response")), ids)
    s = attempts.withColumn("_r", reply)
    stage = F.when(candidate_input(F.col("document_text")).isNull(), "candidate_input").when(F.col("provider_error").isNotNull(), "provider_runtime").when(F.col("_r.error").isNotNull(), "response_contract")
    kind = F.when(stage == "candidate_input", "ValueError").when(stage == "provider_runtime", "LLMRuntimeError").when(stage == "response_contract", "AIScreeningContractError")
    message = F.when(stage == "provider_runtime", F.col("provider_error")).when(stage == "response_contract", F.col("_r.error")).when(stage == "candidate_input", "document text is blank")
    return (
        s.withColumn("ai_status", F.when(stage.isNull(), "completed").otherwise("failed")).withColumn("criteria_results", F.when(stage.isNull(), F.col("_r.results")))
        .withColumn("failure_stage", stage).withColumn("failure_type", kind).withColumn("message", F.substring(message, 1, MAX_MESSAGE)).drop("_r")
    )


def final_outcomes(outcomes: DataFrame) -> DataFrame:
    """One row per candidate: the first completed of the first three attempts, else the last of them, and attempts_used."""
    w = Window.partitionBy("run_id", "candidate_record_id").orderBy("attempt_number")
    s = outcomes.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= MAX_ATTEMPTS)
    done = F.col("ai_status") == "completed"
    x = F.coalesce(F.min_by(F.struct("ai_status", "criteria_results", "_k"), F.when(done, F.col("_k"))), F.max_by(F.struct("ai_status", "criteria_results", "_k"), "_k"))
    return s.groupBy("run_id", "candidate_record_id").agg(x.alias("x")).select("run_id", "candidate_record_id", "x.ai_status", "x.criteria_results", F.col("x._k").alias("attempts_used"))


def error_log(outcomes: DataFrame) -> DataFrame:
    """The failures among the first three attempts, up to the first success."""
    w = Window.partitionBy("run_id", "candidate_record_id").orderBy("attempt_number")
    s = outcomes.withColumn("_k", F.row_number().over(w)).withColumn("_ok", F.max((F.col("ai_status") == "completed").cast("int")).over(w))
    return s.where((F.col("_k") <= MAX_ATTEMPTS) & (F.col("_ok") == 0)).drop("_k", "_ok")


def error_code(provider: Column, operation: Column, kind: Column, status: Column, code: Column) -> Column:
    """The runtime error code of a provider's failure; kind is the failure's class (timeout, connection, ...)."""
    aliyun = provider == "aliyun_bailian"
    c = lambda x: F.coalesce(x, F.lit(False))
    return (
        F.when(c((provider == "deepseek") & (status == 402)) | c(aliyun & code.isin(*BILLING_CODES)), "quota_or_billing")
        .when(c(aliyun & (operation == "complete") & code.isin(*MODEL_CODES)), "model_unavailable")
        .when(c(aliyun & operation.isin("list_models", "test_connection") & status.isin(404, 405)), "capability_unavailable")
        .when(c(kind == "timeout") | c(status == 408), "timeout").when(c(kind == "connection"), "network")
        .when(c(kind == "authentication") | c(status.isin(401, 403)), "authentication").when(c(kind == "rate_limit") | c(status == 429), "rate_limit")
        .when(c(kind.isin("bad_request", "unprocessable")) | c(status.isin(400, 422)), "invalid_request")
        .when(c(kind == "internal") | c(status.between(500, 599)), "provider_server_error")
        .when(c((operation == "complete") & (status == 404)), "model_unavailable").when(c(status.isin(404, 405)), "invalid_request").otherwise("unknown")
    )


def decide(ai_status: Column, results: Column, rule_texts: list[str]) -> Column:
    """ai_failed, qualified or rejected; null where a criterion that a rule names is missing."""
    hit = rules.rule_set(results, rule_texts)
    return F.when(ai_status == "failed", "ai_failed").when(hit, "qualified").when(~hit, "rejected")


def shadow_comparison(legacy_text: Column, layout_text: Column, layout_status: Column, parsed: list) -> Column:
    """How two texts of a screen fare under keyword rules: struct<outcome, legacy_rule_index, layout_rule_index>."""
    a, b = rules.first_rule(legacy_text, parsed), F.when(layout_status == "completed", rules.first_rule(layout_text, parsed))
    out = (
        F.when(layout_status != "completed", "normalization_failed").when(a.isNotNull() & b.isNotNull(), "same_match").when(a.isNull() & b.isNull(), "same_no_match")
        .when(a.isNotNull(), "legacy_only").otherwise("r04_only")
    )
    return F.struct(out.alias("outcome"), a.alias("legacy_rule_index"), b.alias("layout_rule_index"))


OUTCOMES = ("same_match", "same_no_match", "legacy_only", "r04_only", "normalization_failed")


def comparison_columns(df: DataFrame, comparison: str) -> DataFrame:
    """df with the struct `comparison` (see shadow_comparison) laid out in the columns that screens store, and violations."""
    out, a, b = (F.col(f"{comparison}.{x}") for x in ("outcome", "legacy_rule_index", "layout_rule_index"))
    s = df.select("*", F.lit("legacy_shadow").alias("rule_evaluation_mode"), a.isNotNull().alias("legacy_match"), F.when(out != "normalization_failed", b.isNotNull()).alias("r04_match"), out.alias("comparison_outcome"), a.alias("legacy_rule_index"), b.alias("r04_rule_index"))
    bad = lambda name, cond: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    known = F.coalesce(F.col("comparison_outcome").isin(*OUTCOMES), F.lit(False))
    return s.withColumn("violations", F.array_compact(F.array(bad("unknown_outcome", ~known), bad("negative_index", (F.col("legacy_rule_index") < 0) | (F.col("r04_rule_index") < 0)))))


# --- profiles: versions 1..n of an array of criteria (criterion_id, criterion_text, rule) ---------------------


def criteria_digest(criteria: Column) -> Column:
    """sha256: and the digest of the criteria in the order of their numbers."""
    ordered = F.array_sort(F.transform(criteria, lambda c: F.struct(F.substring(c.criterion_id, 2, 20).cast("long").alias("n"), c.criterion_id.alias("criterion_id"), c.criterion_text.alias("criterion_text"), c["rule"].alias("rule"))))
    plain = F.transform(ordered, lambda c: F.struct(c.criterion_id.alias("criterion_id"), c.criterion_text.alias("criterion_text"), c["rule"].alias("rule")))
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(plain, {"ignoreNullFields": "false"}), 256))


def latest_versions(versions: DataFrame) -> DataFrame:
    """The last version of each profile, and whether its versions are 1..n."""
    return versions.groupBy("screening_profile_id").agg(
        F.max_by(F.struct("profile_version", "criteria"), "profile_version").alias("x"), (F.max("profile_version").eqNullSafe(F.countDistinct("profile_version")) & (F.count("*") == F.countDistinct("profile_version")) & (F.min("profile_version") == 1)).alias("contiguous")
    ).select("screening_profile_id", "x.*", "contiguous")


def next_criterion_id(criteria_history: DataFrame, draft: DataFrame) -> DataFrame:
    """(screening_profile_id, next_id): one over the greatest number ever used in versions or draft."""
    used = criteria_history.select("screening_profile_id", F.explode("criteria.criterion_id").alias("c")).union(draft.select("screening_profile_id", F.explode("criteria.criterion_id")))
    n = F.max(F.substring("c", 2, 20).cast("long")) + 1
    return used.groupBy("screening_profile_id").agg(F.concat(F.lit("C"), F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), F.lit("0"))).alias("next_id"))


def new_versions(drafts: DataFrame, versions: DataFrame) -> DataFrame:
    """What saving drafts (screening_profile_id, base_profile_version, criteria) adds, with status saved, unchanged, stale, empty or duplicate_id.

    A draft saves over the latest version it was made from only, and only if its criteria differ.
    """
    last = latest_versions(versions).select("screening_profile_id", F.col("profile_version").alias("_v"), F.col("criteria").alias("_c"))
    j = drafts.join(last, "screening_profile_id", "left")
    ids = F.col("criteria.criterion_id")
    status = (
        F.when(F.size("criteria") <= 0, "empty").when(F.size(ids) != F.size(F.array_distinct(ids)), "duplicate_id")
        .when(~F.col("base_profile_version").eqNullSafe(F.col("_v")), "stale").when(F.col("criteria").eqNullSafe(F.col("_c")), "unchanged").otherwise("saved")
    )
    return j.select("screening_profile_id", F.when(status == "saved", F.coalesce("_v", F.lit(0)) + 1).alias("profile_version"), "criteria", F.when(status == "saved", criteria_digest(F.col("criteria"))).alias("criteria_digest"), status.alias("status"))


def edit_criteria(criteria: Column, edits: dict[str, str | None], add: list[tuple[str, str]] = ()) -> Column:
    """Criteria with texts replaced (None deletes) and (id, text) pairs appended."""
    out = F.filter(criteria, lambda c: ~c.criterion_id.isin(*[k for k, v in edits.items() if v is None])) if any(v is None for v in edits.values()) else criteria
    def rewritten(k, v):
        return lambda c: F.struct(c.criterion_id.alias("criterion_id"), F.when(c.criterion_id == k, F.lit(v)).otherwise(c.criterion_text).alias("criterion_text"), c["rule"].alias("rule"))

    for k, v in edits.items():
        if v is not None:
            out = F.transform(out, rewritten(k, v))
    for k, v in add:
        out = F.concat(out, F.array(F.struct(F.lit(k).alias("criterion_id"), F.lit(v).alias("criterion_text"), F.lit(None).cast("string").alias("rule"))))
    return out


# --- the model benchmark's report ------------------------------------------------------------------------------


def estimated_cost(input_tokens: Column, output_tokens: Column, input_price: str, output_price: str, tier: int) -> Column:
    """Cost by prices per million tokens, null above the tier."""
    d = lambda c, p: c.cast("decimal(18,0)") * F.lit(p).cast("decimal(12,6)") / F.lit(1000000)
    return F.when(input_tokens <= tier, d(input_tokens, input_price) + d(output_tokens, output_price))


def benchmark_report(rows: DataFrame) -> DataFrame:
    """One row of counts, latencies, tokens and costs of rows (status, call_attempted, provider_call_succeeded, contract_valid, latency_ms, *_tokens, estimated_cost)."""
    c = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    call, ok = F.coalesce("call_attempted", F.lit(False)), F.coalesce(F.col("call_attempted") & F.col("provider_call_succeeded"), F.lit(False))
    late = F.when(call, F.col("latency_ms"))
    used = ok & F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull() & F.col("total_tokens").isNotNull()
    cost = F.when(ok, F.col("estimated_cost"))
    return rows.agg(
        F.count("*").alias("rows_recorded"), c(call).alias("calls_attempted"), c(ok).alias("provider_successes"), c(call & (F.col("status") == "provider_error")).alias("provider_errors"),
        c(ok & F.col("contract_valid")).alias("contract_valid"), c(ok & ~F.col("contract_valid")).alias("contract_invalid"), c(F.col("status") == "no_document_text").alias("no_document_text"),
        F.round(F.median(late), 1).alias("latency_median"), F.round(F.percentile(late, 0.9), 1).alias("latency_p90"), F.round(F.min(late), 1).alias("latency_min"), F.round(F.max(late), 1).alias("latency_max"),
        *(F.coalesce(F.sum(F.when(used, F.col(f"{k}_tokens"))), F.lit(0)).alias(f"{k}_tokens_total") for k in ("input", "output", "total")),
        F.sum(cost).alias("estimated_total_cost"), F.avg(cost).alias("mean_cost"), (F.avg(cost) * 1000).alias("estimated_cost_per_1000"),
    )


def not_yet_recorded(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    return candidates.join(rows.select("candidate_record_id"), "candidate_record_id", "left_anti")


def draft_violations(drafts: DataFrame) -> DataFrame:
    """drafts (criteria) with violations: criteria are there, ids are C and three digits or more and unique, texts not blank and unique."""
    ids, texts = F.col("criteria.criterion_id"), F.transform("criteria", lambda c: F.trim(c.criterion_text))
    bad = lambda name, ok: F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    return drafts.withColumn("violations", F.array_compact(F.array(
        bad("empty", F.size("criteria") > 0), bad("id_grammar", F.forall(ids, lambda i: i.rlike("^C[0-9]{3,}$"))), bad("duplicate_id", F.size(ids) == F.size(F.array_distinct(ids))),
        bad("blank_text", F.forall(texts, lambda t: t != "")), bad("duplicate_text", F.size(texts) == F.size(F.array_distinct(texts))),
    )))


def usable_tokens(count: Column) -> Column:
    """A token count that is a whole number of 0 or more, else null."""
    return F.when(count >= 0, count.cast("long"))


def model_ids(ids: Column) -> Column:
    """Names that are not blank, each once, in order."""
    return F.array_distinct(F.filter(ids, lambda i: F.coalesce(F.trim(i), F.lit("")) != ""))
