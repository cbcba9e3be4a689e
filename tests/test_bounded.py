"""Work on pieces of batches, and candidates that are gathered where their lines are."""

import pyarrow as pa

from evidra.operators import document
from evidra.plans import queries


def test_batches_are_halved():
    batch = pa.RecordBatch.from_pylist([{"k": k, "t": ["x" * 1000] * (k % 50)} for k in range(2000)] + [{"k": 2000, "t": ["y" * 5_000_000]}])
    parts = list(document.pieces(batch))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(2001))
    assert len(parts) > 20 and all(p.num_rows == 1 or p.nbytes <= 1 << 20 for p in parts)


def test_candidates_are_gathered_without_a_shuffle(spark, tmp_path):
    rows = [(k, "\n".join(f"word{k}x{i} and{i}" for i in range(n))) for k, n in enumerate((0, 1, 6, 7, 34, 35, 80))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = queries._candidates(spark, str(tmp_path))
    got = {r["candidate_record_id"]: [len(s["segments"]) for s in r["screens"]] for r in c.collect()}
    assert got == {"1:0": [1], "2:0": [6], "3:0": [6, 3], "4:0": [6] * 8, "5:0": [6] * 8, "5:1": [3], "6:0": [6] * 8, "6:1": [6] * 8, "6:2": [6] * 3 + [4]}
    assert queries._candidates(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # the deal of texts


def test_own_lines_give_what_decisions_give(spark):
    from pyspark.sql import functions as F

    from evidra.operators import novelty

    seg = lambda *t: [(x, x, []) for x in t]
    rows = [("run", "a", "1", seg("...", "word", "、。", "x1"), [0], [1, 2], [3]), ("run", "a", "2", seg("--"), [], [0], []), ("run", "b", "3", [], [], [], []), ("run", "b", "4", None, [], None, [0]), ("run", "b", "5", seg("€", "v"), [1], [], [0])]
    s = spark.createDataFrame(rows, "run_id string, candidate_record_id string, screen_id string, segments array<struct<normalized_text:string,comparison_text:string,box_ids:array<string>>>, matched array<int>, new array<int>, uncertain array<int>")
    s = s.withColumn("accounting", F.struct(F.lit(True).alias("verifiable")))
    plain = lambda df: {r["screen_id"]: r["effective"] for r in df.collect()}
    assert plain(novelty.effective_own(s)) == plain(novelty.effective_new(s, novelty.line_decisions(s)))
