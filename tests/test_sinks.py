"""Guarded sinks and recorded sequences."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidra.sources import runs


def texts(path):
    return [json.loads(x) for p in sorted(Path(path).glob("part-*")) for x in p.read_text().splitlines()]


def screens(spark, rows):
    return spark.createDataFrame(rows, "run_id string, candidate_record_id string, screen_id string, screen_index int, sequence_number int, is_formal boolean, version string")


ROWS = [("r", "b", "s3", 1, 2, True, "v"), ("r", "a", "s2", 2, 1, True, None), ("r", "a", "s1", 1, 1, True, "v"), ("r", "a", "s0", None, 1, False, "v")]


def test_only_screens_of_their_run_are_saved(spark, tmp_path):
    run = spark.createDataFrame([("r", "v")], "run_id string, version string")
    refused = runs.save_screens(screens(spark, ROWS), run, str(tmp_path / "screens"), ("version",)).collect()
    assert [(r["screen_id"], r["mismatch"]) for r in refused] == [("s2", ["version"])]
    saved = {x["screen_id"]: x for x in texts(tmp_path / "screens")}
    assert set(saved) == {"s0", "s1", "s3"} and all(len(x["record_digest"]) == 64 for x in saved.values()) and saved["s0"]["screen_index"] is None


def test_sidecar_is_ordered_and_exclusive(spark, tmp_path):
    runs.sidecar(screens(spark, ROWS), str(tmp_path), "a" * 64, {"run_id": "r"})
    first, *rest = texts(tmp_path / f"r06-sidecar-{'a' * 64}.jsonl")
    assert first["record_type"] == "r06_sidecar_manifest" and first["run_id"] == "r"
    assert [x["screen_id"] for x in rest] == ["s1", "s2", "s3"] and rest[1]["version"] is None and len(rest[0]["source_screen_digest"]) == 64
    with pytest.raises(Exception, match="(?i)exist"):
        runs.sidecar(screens(spark, ROWS), str(tmp_path), "a" * 64)
    with pytest.raises(ValueError):
        runs.sidecar(screens(spark, ROWS), str(tmp_path), "../x")


def test_screening_logs_are_created_together(spark, tmp_path):
    row = spark.range(2)
    logs = dict.fromkeys(runs.SCREENING_LOGS, row)
    with pytest.raises(ValueError):
        runs.screening_logs(str(tmp_path), {"decisions": row})
    (tmp_path / "decisions.jsonl").mkdir()
    with pytest.raises(FileExistsError):
        runs.screening_logs(str(tmp_path), logs)
    assert not (tmp_path / "ai_results.jsonl").exists()
    (tmp_path / "decisions.jsonl").rmdir()
    runs.screening_logs(str(tmp_path), logs)
    assert all(len(texts(tmp_path / f"{n}.jsonl")) == 2 for n in runs.SCREENING_LOGS)


def test_error_rows(spark):
    f = spark.createDataFrame([("r", "t", "save_screen", "some text of a page", {"screen_id": "s", "text": "secret"})], "run_id string, occurred_at string, operation string, error_type string, context map<string,string>")
    r = runs.error_rows(f).first()
    assert (r["operation"], r["error_type"], r["context"]) == ("save_screen", "unexpected_error", {"screen_id": "s"})


def test_digests_are_released_with_their_candidate(spark):
    s = screens(spark, ROWS)
    assert runs.owned_digests(s).count() == 4
    left = runs.owned_digests(s, s.where("candidate_record_id = 'a'")).collect()
    assert [r["screen_id"] for r in left] == ["s3"]


def test_two_phases_write_a_batch_once(spark, tmp_path):
    write = runs.two_phase_sink(str(tmp_path))
    write(spark.range(3), 0)
    write(spark.range(5), 0)
    assert len(texts(tmp_path / "batch=0")) == 3 and [p.name for p in tmp_path.iterdir()] == ["batch=0"]


def test_sequence_is_read_file_by_file(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for k, name in enumerate(("c", "a", "b")):  # by time, not by name
        (source / f"{name}.json").write_text(json.dumps({"n": k}) + "\n")
        os.utime(source / f"{name}.json", (1_700_000_000 + 10 * k,) * 2)
    s = runs.sequence(spark, str(source), "n int")
    q = s.writeStream.foreachBatch(runs.two_phase_sink(str(sink))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [[x["n"] for x in texts(sink / f"batch={k}")] for k in range(3)] == [[0], [1], [2]]


def test_profiles(spark, tmp_path):
    for v in (1, 2):
        p = tmp_path / "sp_x" / "versions"
        p.mkdir(parents=True, exist_ok=True)
        (p / f"{v}.json").write_text(json.dumps({"screening_profile_id": "sp_x", "profile_version": v, "criteria": [], "criteria_digest": "d", "created_at": "t"}, indent=1))
    all_ = runs.profiles(spark, str(tmp_path))
    assert all_.count() == 2 and runs.profile(all_, "sp_x").first()["profile_version"] == 2 and runs.profile(all_, "sp_x", 1).first()["profile_version"] == 1
    assert runs.profile(all_.where(F.lit(False)), "sp_x").count() == 0
