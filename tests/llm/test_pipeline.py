"""The pipeline stage by stage against what its operators do, and its SQL twins on a small table."""

import duckdb
import pytest

from evidra.llm import line_dedup, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline as p

    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, f) in enumerate(p.STAGES):
        new = f(spark, docs, SF)
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        new.write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_stages(stages, spark):
    import corpus_pipeline as p
    from evidra.llm import simhash

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _, _ in stages] == [n for n, _ in p.STAGES] and all(b.columns == cols for _, _, b in stages[:-1])
    (_, raw, kept), (_, _, lines), (_, _, one), (_, _, mixed), (_, _, coded) = stages
    lab = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    long = {r["doc_id"] for r in raw.collect() if len((r["text"] or "").split()) >= 50}
    good, bad = [i for i in long if lab.get(i) == 1], [i for i in lab if lab[i] == 0]
    assert sum(i in ids for i in good) >= 0.95 * len(good) and sum(i in ids for i in bad) <= 0.1 * len(bad) + 1
    assert lines.count() == kept.count()
    sets = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5)) for r in lines.collect()}
    left = {r["doc_id"] for r in one.collect()}
    for a in left:
        for b in left:
            if a < b and sets[a]:
                assert len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b]) + 1
    assert {r["doc_id"] for r in mixed.collect()} <= left
    assert coded.count() == mixed.count() and all(r["whole"] for r in coded.collect())


@pytest.mark.parametrize("name,sql", [("lines", line_dedup.OP5_SQL), ("mix", mixing.OP6_SQL)])
def test_stage_sql(stages, name, sql, tmp_path):
    docs = stages[1][1] if name == "lines" else stages[3][1]
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    rows = con.execute(sql).fetchall()
    cols = [c[0] for c in con.description]
    if name == "lines":
        want = {r[cols.index("doc_id")]: r[cols.index("kept_sha256")] for r in rows}
        import hashlib

        assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in stages[1][2].collect()} == want
    else:
        from collections import Counter

        want = {r[cols.index("doc_id")]: r[cols.index("taken")] // r[cols.index("size")] for r in rows if r[cols.index("taken")]}
        assert Counter(r["doc_id"] for r in stages[3][2].collect()) == want
