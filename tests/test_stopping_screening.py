import json

import pytest
from pyspark.sql import functions as F

from evidra.operators import screening, stopping, summaries
from evidra.sources import runs
from evidra.streaming import scan

H = {k: k * 64 for k in "abc"}


def observations(spark, rows):
    """rows: (index, hash letter, extra)"""
    base = {"load_health": True, "ocr_health": True, "identity_health": True, "is_formal": True, "aggregation_status": "completed", "similarity_status": "completed", "comparison_class": "changed_with_effective_new", "effective_new_status": "none", "effective_new_segment_count": 0, "warning_codes": [], "warnings": [], "uncertain_segment_count": 0, "interrupted": False, "failed": False, "scroll_bottom_confirmed": False, "legacy_match": False, "capture_type": "formal_screen"}
    schema = "run_id string, candidate_record_id string, screen_index int, screen_id string, exact_hash string, fingerprint_version string, load_health boolean, ocr_health boolean, identity_health boolean, is_formal boolean, aggregation_status string, similarity_status string, comparison_class string, effective_new_status string, effective_new_segment_count int, warning_codes array<string>, warnings array<string>, uncertain_segment_count int, interrupted boolean, failed boolean, scroll_bottom_confirmed boolean, legacy_match boolean, capture_type string"
    names = [c.split()[0] for c in schema.split(", ")]
    out = []
    for i, h, extra in rows:
        v = base | {"run_id": "r", "candidate_record_id": "c", "screen_index": i, "screen_id": f"s{i}", "exact_hash": H.get(h), "fingerprint_version": "r03-v1"} | extra
        out.append(tuple(v[n] for n in names))
    return spark.createDataFrame(out, schema)


def test_positions(spark):
    df = observations(spark, [(1, "a", {}), (2, "a", {}), (3, "b", {"load_health": None}), (4, "b", {"aggregation_status": "failed"}), (5, "a", {}), (6, "b", {}), (7, None, {}), (8, "b", {"effective_new_status": "present"})])
    got = [(r["position_status"], r["reference_screen_id"]) for r in stopping.classify_positions(df).orderBy("screen_index").collect()]
    assert got == [("initial", None), ("same", "s1"), ("unavailable", "s2"), ("uncertain", "s2"), ("same", "s2"), ("changed", "s5"), ("unavailable", "s6"), ("changed", "s6")]


def test_equal_hashes_pass_over_benign_doubt(spark):
    ok = {"aggregation_status": "partial", "similarity_status": "partial", "comparison_class": "uncertain", "effective_new_status": "possible", "warning_codes": ["r05_partial", "cross_layer_similarity_conflict"], "warnings": ["screen_aggregation_partial"]}
    df = observations(spark, [(1, "a", {}), (2, "a", ok), (3, "a", ok | {"warnings": ["historical_duplicate_ambiguous"]}), (4, "b", ok)])
    assert [r["position_status"] for r in stopping.classify_positions(df).orderBy("screen_index").collect()] == ["initial", "same", "uncertain", "uncertain"]


@pytest.mark.parametrize("mode,extra,want", [("full", {}, (3, "no_new_text")), ("safe", {}, (None, None)), ("full", {"scroll_bottom_confirmed": True}, (2, "scroll_bottom")), ("full", {"scroll_bottom_confirmed": True, "failed": True}, (2, "failed")), ("off", {"interrupted": True, "failed": True}, (2, "interrupted"))])
def test_control(spark, mode, extra, want):
    df = observations(spark, [(1, "a", {}), (2, "b", extra), (3, "c", {})])
    r = stopping.control(stopping.classify_positions(df), mode).first()
    assert (r["stop_index"], r["stop_reason"]) == want


def test_slots(spark):
    df = observations(spark, [(i, "ab"[i % 2], {"effective_new_status": "present"}) for i in range(1, 10)])
    assert stopping.control(stopping.classify_positions(df)).first()["stop_index"] == 8


def test_stream_is_batch(spark, tmp_path):
    rows = [("r", c, i, f"{c}{i}", H["abc"[(i * k) % 3]], True, i == 4, False, False, i > 2, False, False, False) for k, c in enumerate(("x", "y", "z"), 1) for i in range(1, 7)]
    df = spark.createDataFrame(rows, scan.INPUT)
    for part, piece in enumerate((df.where("screen_index <= 3"), df.where("screen_index > 3"))):
        piece.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if part == 0:
            continue
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = scan.control_stream(stream).writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    key = lambda r: (r["candidate_record_id"], r["screen_index"])
    assert sorted(spark.table("verdicts").collect(), key=key) == sorted(scan.control_batch(df).collect(), key=key)


def test_replay(spark):
    df = stopping.classify_positions(observations(spark, [(1, "a", {}), (2, "b", {}), (3, "c", {}), (4, "a", {"effective_new_status": "present"})]))
    cands = [("r", "c", 3, "possible_scroll_bottom", False, False, True, True, "completed", None), ("r", "none", None, None, None, None, None, None, "completed", None)]
    c = spark.createDataFrame(cands, "run_id string, candidate_record_id string, first_predicted_end_screen int, first_predicted_end_reason string, prediction_would_miss_content boolean, prediction_would_miss_rule_match boolean, prediction_observation_complete boolean, prediction_evidence_complete boolean, capture_status string, abort_reason string")
    r = {x["candidate_record_id"]: x for x in stopping.replay(df, c).collect()}
    assert r["c"]["offline_bottom_status"] == "possible_scroll_bottom" and r["c"]["prediction_would_miss_content"] is True and r["c"]["no_new_text_candidate"] and r["c"]["consecutive_no_new_count"] == 0
    assert r["none"]["insufficient_evidence"] and r["none"]["prediction_would_miss_content"] is None


def test_switches(spark):
    prev = [{"hash": H["a"], "version": "v"}]
    rows = [(1, False, H["a"], prev), (2, None, H["a"], prev), (3, True, H["a"], prev), (4, True, H["a"], prev), (5, True, H["b"], prev), (6, True, H["b"], prev), (7, True, None, prev), (8, True, H["b"], [])]
    df = spark.createDataFrame([("k", i, ready, h, "v", p) for i, ready, h, p in rows], "k string, i int, load_ready boolean, hash string, version string, previous array<struct<hash:string,version:string>>")
    got = [r["switch_status"].removeprefix("switch_") for r in stopping.switch_observations(df, ("k",), "i").orderBy("i").collect()]
    assert got == ["loading", "unverifiable", "observing", "unchanged", "observing", "confirmed", "unverifiable", "unverifiable"]


GOOD = '{"criteria_results":[{"criterion_id":"C001","passed":true},{"criterion_id":"C002","passed":false}]}'


@pytest.mark.parametrize(
    "raw,error",
    [
        (GOOD, None), (None, "invalid_json"), ("[]", "not_an_object"), ('{"criteria_results":[],"x":1}', "top_level_schema"), ('{"criteria_results":{}}', "results_not_an_array"), ('{"criteria_results":[1]}', "item_not_an_object"),
        (GOOD.replace("true", '"true"'), "passed_not_a_boolean"), (GOOD.replace("true", "1"), "passed_not_a_boolean"), (GOOD.replace("true", "NaN"), "non_json_constant"), (GOOD.replace("C002", "C001"), "duplicate_criterion"),
        (GOOD.replace("C002", "C003"), "criteria_incomplete_or_unknown"), (GOOD.replace('"passed":true', '"passed":true,"passed":true'), "duplicate_member"), (GOOD.replace('"C001"', "1"), "criterion_id_not_a_string"), ("{", "invalid_json"),
    ],
)
def test_reply_contract(raw, error):
    got, e = screening.read_reply(raw, ["C002", "C001"])
    assert e == error and (e or list(got.items()) == [("C002", False), ("C001", True)])


def test_attempts_and_decisions(spark):
    rows = [("r", "a", 1, "text", "timeout", None), ("r", "a", 2, "text", None, GOOD), ("r", "a", 3, "text", None, GOOD), ("r", "b", 1, " ", None, GOOD), ("r", "c", 1, "t", "x" * 600, None), ("r", "c", 2, "t", None, "{"), ("r", "c", 3, "t", "e", None), ("r", "c", 4, "t", None, GOOD)]
    df = spark.createDataFrame(rows, "run_id string, candidate_record_id string, attempt_number int, document_text string, provider_error string, raw_response string")
    o = screening.attempt_outcomes(df, F.array(F.lit("C001"), F.lit("C002")))
    f = {r["candidate_record_id"]: r for r in screening.final_outcomes(o).withColumn("d", screening.decide(F.col("ai_status"), F.col("criteria_results"), ["C001 AND C002", "C001"])).collect()}
    assert (f["a"]["ai_status"], f["a"]["attempts_used"], f["a"]["d"]) == ("completed", 2, "qualified")
    assert (f["b"]["d"], f["c"]["d"], f["c"]["attempts_used"]) == ("ai_failed", "ai_failed", 3)
    log = screening.error_log(o).collect()
    assert len(log) == 5 and {r["failure_stage"] for r in log} == {"candidate_input", "provider_runtime", "response_contract"} and max(len(r["message"]) for r in log) == 512


def test_profiles(spark):
    crit = "array<struct<criterion_id:string,criterion_text:string,rule:string>>"
    v = spark.createDataFrame([("p", 1, [("C002", "b", None), ("C001", "a", None)]), ("p", 2, [("C001", "a", None), ("C1000", "z", None)]), ("q", 2, [("C001", "a", None)])], f"screening_profile_id string, profile_version int, criteria {crit}")
    assert {r["screening_profile_id"]: r["contiguous"] for r in screening.latest_versions(v).collect()} == {"p": True, "q": False}
    d = spark.createDataFrame([("p", 2, [("C001", "new", None)]), ("n", None, [("C001", "a", None)]), ("q", 1, [("C001", "x", None)])], f"screening_profile_id string, base_profile_version int, criteria {crit}")
    s = {r["screening_profile_id"]: r for r in screening.new_versions(d, v).collect()}
    assert (s["p"]["status"], s["p"]["profile_version"]) == ("saved", 3) and (s["n"]["status"], s["n"]["profile_version"]) == ("saved", 1) and s["q"]["status"] == "stale"
    assert {r["screening_profile_id"]: r["next_id"] for r in screening.next_criterion_id(v, d).collect()}["p"] == "C1001"
    a, b = (v.select(screening.criteria_digest(c).alias("x")).first()["x"] for c in (F.col("criteria"), F.reverse("criteria")))
    import hashlib

    want = json.dumps([{"criterion_id": "C001", "criterion_text": "a", "rule": None}, {"criterion_id": "C002", "criterion_text": "b", "rule": None}], separators=(",", ":"))
    assert a == b == "sha256:" + hashlib.sha256(want.encode()).hexdigest()
    e = v.where("profile_version = 1").select(screening.edit_criteria(F.col("criteria"), {"C001": None, "C002": "B"}, [("C003", "c")]).alias("c")).first()["c"]
    assert [(x["criterion_id"], x["criterion_text"]) for x in e] == [("C002", "B"), ("C003", "c")]


def test_run_directory(spark, tmp_path):
    good = {"run_id": "r", "candidate_record_id": "a", "screen_id": "s1", "screen_index": 1, "record_type": "screen", "storage_schema_version": "1.4.0", "new_member": 1}
    lines = [json.dumps(good), "{broken", "[1]", json.dumps(good | {"storage_schema_version": 1}), json.dumps(good | {"storage_schema_version": "9"}), json.dumps({k: v for k, v in good.items() if k != "storage_schema_version"}), json.dumps(good | {"screen_index": "x"}), "", json.dumps(good | {"candidate_record_id": "b"})]
    (tmp_path / "screens.jsonl").write_text("\n".join(lines))
    (tmp_path / "candidates.jsonl").write_text(json.dumps({"run_id": "r", "candidate_record_id": "a", "storage_schema_version": "1.0.0", "document_version": "old"}))
    (tmp_path / "errors.jsonl").write_text(json.dumps({"run_id": "r", "storage_schema_version": "1.0.0", "record_type": "error", "context": {"candidate_record_id": "a", "secret": "x"}}))
    (tmp_path / "run.json").write_text(json.dumps({"run_id": "r"}, indent=1))
    run = runs.load_run(spark, str(tmp_path))
    assert sorted(r["issue"] for r in run["issues"].collect()) == ["invalid_version_type", "malformed", "malformed", "malformed", "missing_version", "unsupported_version", "unsupported_version"]
    assert run["screens"].count() == 2 and runs.screens(spark, str(tmp_path), candidate_record_id="b").count() == 1
    assert runs.errors(spark, str(tmp_path), candidate_record_id="a").count() == 1
    with pytest.raises(Exception, match="unusable line"):
        runs.screens(spark, str(tmp_path), strict=True).collect()
    assert dict(run["errors"].select(runs.safe_context(F.col("context")).alias("c")).first()["c"]) == {"candidate_record_id": "a"}
    with pytest.raises(Exception):
        runs.create(run["screens"], str(tmp_path / "screens.jsonl"))
    m = runs.identity_mismatches(run["screens"].withColumn("v", F.lit("x")), spark.createDataFrame([("r", "y")], "run_id string, v string"), ("v",))
    assert m.first()["mismatch"] == ["v"]


def test_breaker():
    b, calls = runs.Breaker(), []

    def bad():
        calls.append(1)
        raise OSError

    assert [b.run(bad) for _ in range(5)] == [False] * 5 and len(calls) == 3


def test_statistics(spark):
    assert [r["x"] for r in spark.createDataFrame([(0.0,), (0.37,), (1.0,)], "v double").select(summaries.tenth(F.col("v")).alias("x")).collect()] == ["0.0-0.1", "0.3-0.4", "1.0-1.0"]


def test_small_state_machines(spark):
    key = "run_id string, candidate_record_id string"
    looks = spark.createDataFrame([("r", "a", 1, False), ("r", "a", 2, True), ("r", "b", 1, False)] + [("r", "c", k, False) for k in range(1, 7)], f"{key}, k int, loaded boolean")
    got = {r["candidate_record_id"]: (r["attempts"], r["action"]) for r in stopping.load_attempts(looks, "k").collect()}
    assert got == {"a": (2, "scan"), "b": (1, "retry"), "c": (4, "recover")}
    obs = spark.createDataFrame([("r", "a", 1, "formal_screen", 0, "initial", True, 1), ("r", "a", 2, "rule_confirmation", 0, "same", False, None), ("r", "a", 3, "position_confirmation", 1, "changed", False, None)], f"{key}, k int, capture_type string, rule_index int, position_status string, is_formal boolean, screen_index int")
    assert [r["confirmed"] for r in stopping.rule_confirmations(obs, "k").orderBy("k").collect()] == [False, True, False]
    assert [(r["capture_type"], r["screen_index"]) for r in stopping.promoted(obs, "k").orderBy("k").collect()][2] == ("formal_screen", 2)
    f = spark.createDataFrame([(None, True, True, True, True, "same", False), ("ocr_failed", True, True, True, True, "same", False), (None, False, True, True, True, "same", False), (None, True, False, True, True, "same", False), (None, True, True, True, True, "changed", False)], "failure_reason string, saved boolean, load_health boolean, ocr_health boolean, identity_health boolean, position_status string, insufficient_evidence boolean")
    rows = f.select(stopping.failure_reason(f).alias("a"), stopping.failure_reason(f, True).alias("b")).collect()
    assert [r["a"] for r in rows] == [None, "ocr_failed", "store_failed", "load_failed", None] and rows[4]["b"] == "position_unresolved"
    o = spark.createDataFrame([("no_new_text",), ("interrupted",), ("failed",), (None,), ("max_screens",)], "s string").select(stopping.capture_outcome(F.col("s")).alias("o"))
    assert [r["o"]["capture_status"] for r in o.collect()] == ["completed_with_limit", "interrupted", "aborted", "completed", "completed_with_limit"]
    assert summaries.outcome_violations(o.select("o.*")).where("size(violations) > 0").count() == 0


def test_manifest(spark, tmp_path):
    run = spark.createDataFrame([("r", "running")], "run_id string, status string")
    rows = spark.createDataFrame([("r",), ("r",)], "run_id string")
    m = runs.finished(run, rows, rows.limit(1), rows.limit(0), "completed", "2024-01-01T00:00:00Z")
    runs.write_manifest(m, str(tmp_path / "run.json"))
    r = runs.manifest(spark, str(tmp_path)).first()
    assert (r["screen_record_count"], r["candidate_record_count"], r["error_count"], r["status"]) == (2, 1, 0, "completed")
    runs.batch_sink(str(tmp_path / "sink"))(rows, 3)
    runs.batch_sink(str(tmp_path / "sink"))(rows, 3)
    assert spark.read.json(str(tmp_path / "sink")).count() == 2
