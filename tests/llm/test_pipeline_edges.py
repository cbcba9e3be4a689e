"""Pipeline stages on empty tables, nulls, repeated rows and columns named like the operators' own."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, n_lines long, keep_0 string, id long, same long, row int, col int, gone_id long, _copy int"


@pytest.mark.parametrize("empty", [True, False])
def test_stages_keep_columns(spark, tmp_path, empty):
    import corpus_pipeline as p

    r = random.Random(4)
    text = lambda k: " ".join(f"w{r.randrange(500)}" for _ in range(60 + k))
    rows = [] if empty else [(k, text(k), "en", ["a", None][k % 2], 1) for k in range(8)] + [(3, None, None, None, None), (None, text(9), "en", "a", 2), (None, "", "en", "a", 0)]
    rows = rows + rows[:2]
    docs = spark.createDataFrame([x + (7, False, 8, "k", 9, 10, 11, 12, 13, 14) for x in rows], SCHEMA)
    spark.createDataFrame([(1, 1, 0)] if not empty else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (name, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(p.STAGES) - 1:
            assert docs.columns == SCHEMA.replace(",", "").split()[::2], name
        docs.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        n = docs.count()
        assert n == 0 if empty else n > 0, name
        if k < len(p.STAGES) - 1:
            assert all((x["n_words"], x["kept"], x["_copy"], x["gone_id"]) == (7, False, 14, 13) for x in docs.collect())
