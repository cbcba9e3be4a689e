import json
import random

import pytest
from pyspark.sql import functions as F

from evidra import config
from evidra.operators import document, layout, novelty, rebuild, summaries


def box(i, text, x, y, w=100, h=20, conf=0.95, poly=False):
    b = [[x, y], [x + w, y], [x + w, y + h], [x, y + h]] if poly else [x, y, x + w, y + h]
    return {"box_id": f"b{i:03d}", "raw_text": text, "confidence": conf, "bbox": json.dumps(b), "original_index": i}


def norm(boxes, **c):
    return layout.normalise(boxes, None, config.LAYOUT | c)


def test_reading_order_does_not_depend_on_input_order():
    boxes = [box(k, f"w{k}", 120 * (k % 5), 30 * (k // 5) + (k % 3)) for k in range(40)]
    want = norm(boxes)["normalized_text"]
    assert want.split("\n")[0] == "w0 w1 w2 w3 w4"
    for seed in range(5):
        mixed = boxes[:]
        random.Random(seed).shuffle(mixed)
        assert norm(mixed)["normalized_text"] == want


def test_separators():
    c, a = config.LAYOUT, layout.Rect(0, 0, 10, 20)
    near, far = layout.Rect(13, 0, 20, 20), layout.Rect(40, 0, 50, 20)
    sep = lambda x, y, b: layout.separator(x, y, a, b, 20.0, c)
    assert sep("a", "b", layout.Rect(5, 0, 9, 20)) == "" and sep("a", "b", near) == "" and sep("a", "b", far) == " "
    assert sep("（", "x", far) == "" and sep("x", "，", far) == "" and sep("中，", "x", far) == "" and sep("中", "文", far) == ""
    assert sep("C+", "b", near) == "" and sep("C+", "b", far) == " "


def test_confidence_bounds():
    r = norm([box(0, "a", 0, 0, conf=0.84), box(1, "b", 0, 40, conf=0.85), box(2, "c", 0, 80, conf=None)])
    assert r["normalized_text"] == "b\nc" and (r["eligible_box_count"], r["low_confidence_box_count"]) == (2, 1)
    assert norm([box(0, "a", 0, 0, conf=1.5)])["normalization_error_type"] == "reading_order_build_failed"


def test_failures_are_typed():
    bad = box(0, "a", 0, 0) | {"bbox": "[1,2]"}
    r = norm([bad, box(1, "b", 0, 40)])
    assert r["normalization_status"] == "failed" and r["normalization_error_type"] == "layout_degraded" and r["warnings"] == [{"box_id": "b000", "code": "bbox_invalid_flat_count"}]
    assert norm([box(0, None, 0, 0)])["normalization_error_type"] == "all_box_text_normalization_failed"
    assert norm([box(0, "a", 0, 0), box(0, "b", 0, 40)])["normalization_error_type"] == "reading_order_build_failed"
    assert norm([])["normalization_status"] == "completed" and norm([])["normalized_text"] == ""
    assert norm([box(0, "  ", 0, 0)])["excluded_empty_box_ids"] == ["b000"]


def test_duplicates():
    r = norm([box(k, "same", 0, 0, conf=0.9 + k / 10000) for k in range(500)])
    assert r["deduplicated_box_count"] == 1 and r["duplicate_groups"][0]["retained_box_id"] == "b499"
    far = norm([box(k, "same", 0, 50 * k) for k in range(300)])
    assert far["deduplicated_box_count"] == 300 and not far["duplicate_risk"]
    gray = norm([box(0, "same", 0, 0, w=100), box(1, "same", 18, 0, w=100)])
    assert gray["deduplicated_box_count"] == 2 and gray["duplicate_gray_pair_count"] == 1 and gray["duplicate_risk"]
    flat = norm([box(0, "s", 0, 0, h=0), box(1, "s", 0, 0, h=0)])
    assert flat["deduplicated_box_count"] == 1 and "exact_zero_area_geometry" in flat["duplicate_groups"][0]["pair_evidence"][0]["basis"]


def test_three_reading_orders():
    boxes = [box(0, "b", 200, 3, poly=True), box(1, "a", 0, 0, poly=True), box(2, "c", 0, 60, poly=True)]
    assert [b["raw_text"] for b in layout.fingerprint_order(boxes)] == ["a", "b", "c"]
    assert [b["raw_text"] for b in layout.anchor_order([*boxes, box(3, "z", 0, 0) | {"bbox": None}])] == ["a", "b", "c", "z"]
    assert layout.fingerprint(boxes, 0.85)["exact_hash"] == layout.fingerprint([b | {"raw_text": f"  {b['raw_text']} "} for b in boxes], 0.85)["exact_hash"]
    assert layout.fingerprint([box(0, "b", 0, 0) | {"bbox": None}], 0.85)["exact_hash"] is None


def test_frames(spark):
    boxes = [(s, *box(k, f"word{k}", 120 * (k % 4), 30 * (k // 4)).values()) for s in ("s1", "s2") for k in range(8)]
    df = layout.gather(spark.createDataFrame(boxes, "screen string, box_id string, raw_text string, confidence double, bbox string, original_index int").orderBy(F.rand(3)), ("screen",))
    out = layout.fingerprint_screens(layout.normalise_screens(df)).collect()
    assert len(out) == 2 and out[0]["normalized_text"] == out[1]["normalized_text"] and out[0]["exact_hash"] == out[1]["exact_hash"]
    assert summaries.layout_violations(layout.normalise_screens(df)).where("size(violations) > 0").count() == 0


def screen(i, lines, formal=True, sid=None, status="completed"):
    segs = [{"normalized_text": t, "comparison_text": layout.plain(t), "box_ids": [f"x{i}:{k}"]} for k, t in enumerate(lines)]
    return {"screen_id": sid or f"s{i}", "screen_index": i, "is_formal": formal, "normalization_status": status, "segments": segs}


LINES = [f"line{k:02d}" + "abcdefghij"[k % 10] * 14 for k in range(40)]


def test_exact_overlap_bounds():
    ok = lambda lines: document.fold([screen(1, ["z" * 30, *lines]), screen(2, [*lines, "n" * 30])], None)["screens"][1]
    assert ok(["a" * 12, "b" * 12])["matched"] == [0, 1]  # 24 characters
    assert ok(["a" * 12, "b" * 11])["uncertain"][:2] == [0, 1]  # 23
    assert ok(["a" * 8, "b" * 8, "c" * 8])["matched"] == []  # no line over 8
    assert ok(["a" * 9, "b" * 8, "c" * 8])["matched"] == [0, 1, 2]
    single = lambda n: document.fold([screen(1, ["q" * 30, "a" * n]), screen(2, ["a" * n])], None)["screens"][1]
    assert single(48)["matched"] == [0] and single(47)["uncertain"] == [0]


def test_fuzzy_overlap():
    r = document.fold([screen(1, ["A" * 40 + "B" * 40]), screen(2, ["A" * 40, "B" * 40, "new"])], None)["screens"][1]
    assert r["matched"] == [0, 1] and r["new"] == [2] and r["match_evidence"][0]["match_type"] == "adjacent_fuzzy_1_2" and r["duplicate_risk"] == "low"
    r = document.fold([screen(1, ["A" * 40, "B" * 40]), screen(2, ["A" * 40 + "B" * 40])], None)["screens"][1]
    assert r["match_evidence"][0]["match_type"] == "adjacent_fuzzy_2_1"
    long = lambda n: document.fold([screen(1, ["a" * n]), screen(2, ["a" * (n - 1) + "b", "z" * 9])], None)["screens"][1]
    assert long(512)["matched"] == [0] and long(513)["uncertain"][:1] == [0]
    assert sum(len(document.tilings(d, c)) for d in range(1, 5) for c in range(1, 5)) == 26


def test_historical_overlap():
    a = LINES[:8]
    again = ["fresh one" * 3, *a[1:6], "fresh two" * 3]
    f = document.fold([screen(1, a), screen(2, ["0123456789" * 3, "qwertyuiop" * 3]), screen(3, again)], None)["screens"][2]
    kinds = [e["match_type"] for e in f["match_evidence"]]
    assert kinds == ["historical_exact"] and f["matched"] == [2, 3, 4] and "historical_context_insufficient" in f["warnings"]


def test_order_and_identity_of_screens():
    r = document.fold([screen(1, LINES[:3]), screen(3, LINES[3:6]), screen(1, LINES[6:9], sid="other"), screen(1, LINES[9:12]), screen(2, [], formal=False)], None)
    assert [s["warnings"][:1] for s in r["screens"]] == [[], ["formal_screen_out_of_order"], ["duplicate_formal_screen_index"], ["duplicate_screen_id_conflict"], []]
    assert len(r["document_segments"]) == 12 and r["document_build_status"] == "partial"
    assert document.fold([screen(1, LINES[:3])] * 2, None)["formal_screen_count"] == 1
    assert document.fold([], None)["document_build_status"] == "not_attempted"
    assert document.fold([screen(1, LINES[:2], status="failed")], None)["document_build_status"] == "failed"
    assert document.fold([screen(1, LINES[:2])], "aborted")["document_warnings"] == ["candidate_aborted"]
    assert document.fold([screen(1, ["x" * 9] * 257)], None)["screens"][0]["warnings"] == ["screen_segment_limit_exceeded"]


def test_tolerant_fold():
    t = document.fold([screen(2, LINES[4:8]), screen(1, LINES[:5])], None, tolerant=True)
    assert [(s["screen_index"], s["warnings"]) for s in t["screens"]] == [(2, ["formal_screen_out_of_order"]), (1, ["formal_screen_out_of_order"])]
    assert [x["normalized_text"] for x in t["document_segments"]] == [*LINES[:5], *LINES[4:8]]
    why = lambda *ss: list(document.distrusted(list(ss)).values())
    assert why(screen(1, LINES[:2]), screen(3, LINES[:2])) == [] and why(screen(9, [], formal=False), screen(1, [])) == []
    assert why(screen(1, LINES[:2]), screen(1, LINES[:2], sid="x"), screen(2, [])) == ["formal_screen_out_of_order", "duplicate_formal_screen_index", "formal_screen_out_of_order"]
    assert why(screen(1, LINES[:2]), screen(2, LINES[:2], sid="s1")) == ["duplicate_screen_id_conflict"]
    assert why(screen(None, []), screen(1, [])) == ["formal_screen_out_of_order"] and len(why(screen(0, []), screen(1, []))) == 2
    plain = [screen(1, LINES[:6]), screen(2, LINES[4:10])]
    assert document.fold(plain, None, tolerant=True) == document.fold(plain, None)


def _frame(spark, candidates):
    rows = [("run", c, s["screen_id"], s["screen_index"], s["is_formal"], s["normalization_status"], s["segments"]) for c, ss in candidates.items() for s in ss]
    return spark.createDataFrame(rows, f"run_id string, candidate_record_id string, screen_id string, screen_index int, is_formal boolean, normalization_status string, segments array<{document.SEGMENT}>")


def _layers(spark, candidates):
    s = _frame(spark, candidates)
    d = document.build_documents(s)
    t = F.array_join(F.transform("segments", lambda x: x.comparison_text), "")
    extra = s.select(*novelty.KEY, "screen_id", t.alias("comparison_text"), t.alias("normalized_text"), F.sha2(t, 256).alias("exact_hash"), F.lit("r03-v1").alias("fingerprint_version"), "normalization_status")
    return d, novelty.evaluate(rebuild.screens_of(d, extra))


def test_novelty(spark):
    d, e = _layers(spark, {"a": [screen(1, LINES[:6]), screen(2, LINES[4:10]), screen(3, LINES[4:10])], "b": [screen(1, LINES[:4]), screen(2, ["…", "。。"]), screen(3, [])]})
    assert summaries.document_violations(d).where("size(violations) > 0").count() == 0
    got = {(r["candidate_record_id"], r["screen_index"]): r for r in e.collect()}
    assert got["a", 1]["similarity_status"] == "no_reference" and got["a", 1]["comparison_class"] == "empty_or_unavailable"
    assert got["a", 2]["accounting"]["overlap_chars"] == sum(map(len, LINES[4:6])) and got["a", 2]["effective"]["status"] == "present"
    assert got["a", 3]["exact_same"] is True
    assert got["b", 3]["comparison_class"] == "empty_or_unavailable" and "zero_effective_char_denominator" in got["b", 3]["warning_codes"]
    s = summaries.similarity_summary(e)
    assert summaries.summary_violations(s).where("size(violations) > 0").count() == 0
    assert summaries.screen_violations(e).where("size(violations) > 0").count() == 0


def test_references(spark):
    s = _frame(spark, {"a": [screen(1, []), screen(2, []), screen(4, []), screen(2, [], sid="twin"), screen(3, [])]})
    r = {x["screen_id"]: x["reference"] for x in novelty.resolve_references(s).collect()}
    assert r["s1"]["status"] == "no_reference" and r["s2"]["screen_id"] == "s1" and r["s3"]["warning"] == "reference_conflict" and r["s4"]["screen_id"] == "s3"


def test_rebuild(spark):
    s = _frame(spark, {"a": [screen(1, LINES[:6]), screen(2, LINES[4:10])], "b": [screen(1, LINES[:3]), screen(1, LINES[3:6], sid="x")], "c": [screen(2, LINES[:3])]})
    stored = document.build_documents(s, tolerant=True)
    again = {r["candidate_record_id"]: r for r in rebuild.rebuild_documents(s, stored).collect()}
    assert not any(r["differences"] for r in again.values())
    assert [again[c]["issues"] for c in "abc"] == [[], ["duplicate_formal_screen_index", "formal_screen_out_of_order"], []]
    strict = {r["candidate_record_id"]: r for r in rebuild.rebuild_documents(s, stored, tolerant=False).collect()}
    assert strict["b"]["issues"] == ["DuplicateOrOutOfOrderFormalScreenError"] and strict["b"]["document_text"] is None and strict["b"]["differences"] is None and strict["a"]["differences"] == []
    other = rebuild.rebuild_documents(s, stored.withColumns({"document_text": F.lit("x"), "screens": F.slice("screens", 1, 1)})).where("candidate_record_id = 'a'")
    assert other.first()["differences"] == ["document_text", "screens"]
    assert rebuild.rebuild_documents(s.limit(0), stored).where("document_text is null").count() == 3


def test_similarity_is_rebuilt(spark):
    _, e = _layers(spark, {"a": [screen(1, LINES[:6]), screen(2, LINES[4:10])], "b": [screen(1, LINES[:4])]})
    inputs = [c for c in e.columns if c not in (*rebuild.SIMILARITY_COLUMNS, "reference", "ref_text", "ngram_scores", "simhash", "reference_simhash", "hamming_distance", "simhash_score", "signal_warnings")]
    stored = e.select(*inputs, *rebuild.SIMILARITY_COLUMNS)
    assert rebuild.rebuild_similarity(stored).where("size(differences) > 0").count() == 0
    wrong = stored.withColumn("similarity_score", F.when(F.col("screen_id") == "s2", 0.1))
    assert {(r["screen_id"], *r["differences"]) for r in rebuild.rebuild_similarity(wrong).where("size(differences) > 0").collect()} == {("s2", "similarity_score")}


def test_stored_screens_of_every_version_upgrade_alike(spark):
    def with_boxes(c, i):
        b = [box(k, f"line {i + k // 2 if k < 4 else 10 * i + k} of the page number", 0, 40 * k, w=300, poly=True) for k in range(6)]
        return ("run", c, f"s{i}", i, True, [x | {"box_id": f"s{i}:{x['box_id']}"} for x in b])

    def of(name, version):
        rows = [with_boxes(name, i) for i in (1, 2, 3)]
        df = spark.createDataFrame(rows, f"run_id string, candidate_record_id string, screen_id string, screen_index int, is_formal boolean, boxes array<{layout.BOX}>")
        return df.withColumn("storage_schema_version", F.lit(version))

    whole = rebuild.upgrade(of("x", "1.0.0"))
    versions = {"a": "1.0.0", "b": "1.1.0", "c": "1.2.0", "d": "1.4.0", "e": "9.0.0"}
    stored = None
    for name, version in versions.items():
        s = whole.drop("reference", "similarity_hash", "storage_schema_version").withColumn("candidate_record_id", F.lit(name)).withColumn("storage_schema_version", F.lit(version))
        empty = {"a": [*rebuild.LAYOUT_COLUMNS, "segments"], "b": ["matched", "new", "aggregation_status"]}.get(name, [])
        s = s.withColumns({c: F.lit(None).cast(s.schema[c].dataType) for c in empty})
        stored = s if stored is None else stored.unionByName(s)
    columns = ["screen_id", "similarity_score", "comparison_class", "normalized_text", "matched", "new", "warning_codes"]
    got = {n: sorted(map(tuple, rebuild.upgrade_stored(stored).where(F.col("candidate_record_id") == n).select(*columns).collect())) for n in versions}
    want = sorted(map(tuple, whole.select(*columns).collect()))
    assert len(want) == 3 and all(got[n] == want for n in "abcd") and got["e"] == []


def test_sources_of_rebuilds(spark):
    c = spark.createDataFrame([("r", "1.4.0", False), ("r", "1.3.0", False), ("q", "1.4.0", True), ("x", "1.4.0", False), ("r", "1.2.0", False), ("r", "1.0.0", False), ("r", None, False)], "run_id string, storage_schema_version string, has_similarity boolean")
    m = spark.createDataFrame([("r", "1.4.0", "record", "d", "d"), ("q", "1.4.0", "disabled", None, None)], "run_id string, storage_schema_version string, similarity_mode string, similarity_config_digest string, similarity_snapshot_digest string")
    got = lambda **k: [(r["similarity_source"], r["similarity_issue"]) for r in rebuild.similarity_source(c.coalesce(1).withColumn("n", F.monotonically_increasing_id()), m, **k).orderBy("n").collect()]
    no = lambda x: ("unavailable", x)
    missing = no("HistoricalSimilarityConfigRequiredError")
    assert got() == [("manifest", None), no("ManifestSchemaMismatchError"), no("DisabledSimilarityMismatchError"), no("ManifestSchemaMismatchError"), missing, missing, missing]
    assert got(similarity=True)[0] == no("SimilarityConfigOverrideError") and got(similarity=True)[4:6] == [("caller_config", None), no("HistoricalAggregationConfigRequiredError")]
    assert got(similarity=True, documents=True, text=True)[4:] == [("caller_config", None), ("caller_config", None), no("UnsupportedStorageSchemaError")]


def test_repeated_furniture(spark):
    def with_boxes(i):
        b = [box(0, "Menu bar!", 5, 5, poly=True), *[box(k + 1, f"text number {i} {k} longer", 0, 60 + 40 * k, w=300, poly=True) for k in range(3)]]
        return ("run", "a", f"s{i}", i, True, [x | {"box_id": f"s{i}:{x['box_id']}"} for x in b])

    df = spark.createDataFrame([with_boxes(i) for i in (1, 2, 3)], f"run_id string, candidate_record_id string, screen_id string, screen_index int, is_formal boolean, boxes array<{layout.BOX}>")
    got = {r["screen_index"]: r for r in rebuild.upgrade(df).collect()}
    assert got[3]["effective"]["status"] in ("present", "possible") and got[1]["aggregation_status"] == "completed"


@pytest.mark.parametrize("n,chars,loaded", [(0, 0, False), (5, 29, False), (5, 30, True), (6, 1, True)])
def test_load_gate(spark, n, chars, loaded):
    assert spark.range(1).select(layout.load_gate(F.lit(n), F.lit(chars)).alias("g")).first()["g"]["loaded"] is loaded


def test_sources_of_documents(spark):
    names = "run_id string, storage_schema_version string, aggregation_mode string, aggregation_config_version string, aggregation_config_digest string, aggregation_snapshot_digest string, similarity_mode string"
    m = spark.createDataFrame([("good", "1.4.0", "record", "v", "d", "d", "record"), ("lost", "1.4.0", "record", "v", "d", None, "record"), ("other", "1.4.0", "record", "w", "d", "d", "record"), ("off", "1.4.0", "disabled", None, None, None, "disabled"), ("plain", "1.4.0", "record", "v", "d", "d", "disabled"), ("odd", "1.4.0", "record", "v", "d", "d", None)], names)
    runs_ = ["good", "lost", "other", "off", "plain", "odd", "none"]
    c = spark.createDataFrame([(r, "1.4.0", s, "completed" if s else "not_attempted", "v", "d") for r in runs_ for s in (True, False)], "run_id string, storage_schema_version string, has_similarity boolean, document_build_status string, aggregation_config_version string, aggregation_config_digest string")
    got = {(r["run_id"], r["has_similarity"]): (r["document_source"], r["document_issue"]) for r in rebuild.document_source(c, m).collect()}
    no = lambda x: ("unavailable", x)
    yes = ("manifest", None)
    assert got["good", True] == yes and got["good", False] == no("ManifestSimilarityConfigMismatchError")
    assert got["lost", True] == no("ManifestAggregationConfigError") and got["other", True] == no("ManifestAggregationConfigMismatchError")
    assert got["off", False] == ("manifest_disabled", None) and got["off", True] == no("DisabledAggregationMismatchError")
    assert got["plain", False] == yes and got["plain", True] == no("DisabledSimilarityMismatchError")
    assert got["odd", True] == no("ManifestSimilarityModeError") and got["none", True] == no("ManifestRunMismatchError")
