"""Queries over documents read all of their lines."""

import hashlib

from evidra.plans.registry import QUERIES


def table(spark, path):
    rows = [(k, "\n".join(f"word{k}x{i} and{i} more{i}" for i in range(n)), "en", "s", 0) for k, n in enumerate((1, 6, 7, 80))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return {k: t.split("\n") for k, t, *_ in rows}


def test_reading_order(spark, tmp_path):
    lines = table(spark, tmp_path)
    want = {(k, i // 6 + 1): t[i : i + 6] for k, t in lines.items() for i in range(0, len(t), 6)}
    got = {(r["doc_id"], r["screen_index"]): (r["n_lines"], r["text_sha256"]) for r in QUERIES["reading_order"](spark, str(tmp_path)).collect()}
    assert got == {k: (len(t), hashlib.sha256("\n".join(t).encode()).hexdigest()) for k, t in want.items()}
