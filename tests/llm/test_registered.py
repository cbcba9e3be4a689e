"""Registered queries over whole test tables: against libraries, plain loops and held-out labels."""

import re
import zlib

import duckdb
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from evidra.llm.queries import QUERIES, SQL

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(spark, name, sf):
    got = [r.asDict() for r in QUERIES[name](spark, sf).collect()]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    return got, texts


def labels(spark, sf, name, part, kept):
    """Labels of rows that were not learnt from."""
    return {r["doc_id"]: r[name] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r[name] is not None and zlib.crc32(str(r["doc_id"]).encode()) % part == kept}


def test_token_counts(spark):
    got, texts = rows(spark, "op2_token_counts", SMALL)
    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    plain.no_truncation()
    plain.no_padding()
    for r in got:
        t = texts[r["doc_id"]]
        n = len(plain.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)


def test_fingerprints_and_components(spark):
    got, texts = rows(spark, "op3_simhash_golay", SMALL)
    prints = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(len(w) - 2, min(len(w), 1)))]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    of, todo = {}, sorted(prints)
    for first in todo:
        if first in of:
            continue
        of[first], reach = first, [first]
        while reach:
            a = prints[reach.pop()]
            for j in todo:
                if j not in of and (a ^ prints[j]).bit_count() <= 2:
                    of[j] = first
                    reach.append(j)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", of[i]) for i in prints}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    got = QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute(SQL[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    assert names == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


def test_quality_rules(spark):
    got, texts = rows(spark, "op7_quality_rules", MORE)
    for r in got:
        w = WORD.findall(texts[r["doc_id"]])
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {x for x in windows if windows.count(x) > 1} if len(set(windows)) < len(windows) else set()
        repeated = len({k + d for k, x in enumerate(windows) if x in again for d in range(3)})
        lines = [x for x in texts[r["doc_id"]].split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), repeated, len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * repeated > 50 * len(w)) and not (r["kept"] and r["base_failed"])
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    judged = [(r["kept"], quality[r["doc_id"]]) for r in got if not r["base_failed"] and quality.get(r["doc_id"]) is not None]
    assert len(judged) > 50 and sum(k == bool(q) for k, q in judged) > 0.9 * len(judged)


@pytest.mark.parametrize("name,label,part,kept,threshold", [("op9_toxicity_bigru", "toxic", 4, 2, 0.3), ("op10_bradley_terry", "quality", 3, 1, 0.5)])
def test_scores_of_rows_that_were_held_out(spark, name, label, part, kept, threshold):
    got, _ = rows(spark, name, MORE)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % part == kept)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    truth = labels(spark, MORE, label, part, kept)
    of = {r["doc_id"]: r["score"] for r in got}
    ones, zeros = [of[i] for i, y in truth.items() if y == 1], [of[i] for i, y in truth.items() if y == 0]
    assert len(ones) > 5 and len(zeros) > 5
    better = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / len(ones) / len(zeros)
    assert better > (0.95 if label == "quality" else 0.7)
