import json

import pytest
from pyspark.sql import functions as F

from evidra import config
from evidra.functions import geometry, rules, text


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def test_config_digests():
    assert config.digest(config.LAYOUT) == "3597727e595b16c3aba7bfa41653b617f11277e78ce52379c99ee3afafcb84d5"
    assert config.digest(config.DOCUMENT) == "047ec8c40aab9b28ed3a7a6a63695f416677e1a73c25f3c398d77eca3b31ff7a"
    assert config.digest(config.novelty_snapshot()) == "a2326fa9294a79cdf7bbb0ae13ed84e1b467a4461f1253a9f99ead75efa6bcb0"
    assert config.restored(dict(config.LAYOUT), config.LAYOUT) == config.LAYOUT
    with pytest.raises(ValueError):
        config.restored(config.LAYOUT | {"more": 1}, config.LAYOUT)
    with pytest.raises(ValueError):
        config.restored(config.LAYOUT | {"line_tolerance_min_px": True}, config.LAYOUT)


def test_texts(spark):
    rows = spark.createDataFrame([("广东 工贸\n职业技术学院 ＡＩ",), ("  é  x　y\x1cz ",), ("",), (None,)], "t string")
    got = rows.select(text.comparison_text(F.col("t")).alias("c"), text.box_text(F.col("t")).alias("b")).collect()
    assert got[0]["c"] == "广东工贸职业技术学院ai"
    assert got[1]["c"] == "éxyz" and got[1]["b"] == "é x y z"
    assert got[2]["c"] == "" and got[3]["c"] is None


def test_tokens_are_lossless(spark):
    t = "使用 C++/C# 与 .NET-6，v1.2_x ... 结束"
    parts = one(spark, text.token_parts(F.col("t")), t=t)
    assert "".join(p["text"] for p in parts) == t
    assert "C++/C#" in [p["text"] for p in parts if p["is_protected"]] and "..." not in [p["text"] for p in parts if p["is_protected"]]
    assert one(spark, text.protected_tokens(F.col("t")), t=t) == [p["text"] for p in parts if p["is_protected"]]


@pytest.mark.parametrize("a,b,score", [("aaaa", "aa", 0.1), ("", "", 1.0), ("", "x", 0.0), ("x", "x", 1.0), ("x", "y", 0.0)])
def test_dice(spark, a, b, score):
    assert one(spark, text.dice(F.col("a"), F.col("b")), a=a, b=b)["score"] == pytest.approx(score)


def test_dice_length_gate(spark):
    r = spark.createDataFrame([("a" * 100_000, "a" * 100_000), ("a" * 100_001, "a")], "a string, b string").select(text.dice(F.col("a"), F.col("b")).alias("d")).collect()
    assert r[0]["d"]["score"] == 1.0 and r[1]["d"]["score"] is None and r[1]["d"]["warning"] == "comparison_text_too_long"


def test_simhash(spark):
    r = spark.createDataFrame([("C++",), ("abc",), ("abd",), ("",)], "t string").select(text.simhash(F.col("t")).alias("h")).collect()
    assert r[0]["h"] == "09a2fb5099b81c5a" and r[3]["h"] is None
    assert one(spark, text.hamming(F.lit(r[1]["h"]), F.lit(r[2]["h"]))) == 28


def test_offset_timestamps(spark):
    r = spark.createDataFrame([("2024-01-02T03:04:05+08:00",), ("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05",), ("2024-13-02T03:04:05Z",)], "t string").select(text.offset_timestamp(F.col("t")).isNotNull().alias("x")).collect()
    assert [x["x"] for x in r] == [True, True, False, False]


@pytest.mark.parametrize(
    "bbox,error",
    [
        ([0, 1, 10, 21], None), ([[0, 1], [10, 21]], None), ([[3, 4]], None), ("null", "bbox_missing"), (None, "bbox_missing"), ('"x"', "bbox_invalid_type"), ([], "bbox_empty"), ([1, 2, 3], "bbox_invalid_flat_count"),
        ([[1, 2], 3], "bbox_mixed_format"), ([[1, 2, 3]], "bbox_invalid_point"), ([True, 0, 1, 1], "bbox_invalid_number"), (["1", 0, 1, 1], "bbox_invalid_number"), ([5, 0, 1, 1], "bbox_negative_size"), ("{", "bbox_invalid_type"),
    ],
)
def test_bounds_agree(spark, bbox, error):
    from evidra.operators.layout import rect

    t = bbox if bbox is None or isinstance(bbox, str) else json.dumps(bbox)
    g = spark.createDataFrame([(t,)], "b string").select(geometry.bounds(F.col("b")).alias("g")).first()["g"]
    assert g["error"] == error
    if error is None:
        r = rect(t)
        assert (g["x_min"], g["y_min"], g["x_max"], g["y_max"]) == (r.x0, r.y0, r.x1, r.y1)
    else:
        with pytest.raises(ValueError, match=error):
            rect(t)


@pytest.mark.parametrize("bad", ["a", '"a', '"a" and', '"a" "b"', 'not "a"', '"a" and not not "b"', '"a" xor "b"', ';"a"', '"a";;"b"', 'any("a","a")', "any()", 'any("a" "b")', 'any(any("a"))', '" "', '"a"and "b"', '"a" and not("b")', '"a" or not "b"'])
def test_keyword_syntax_errors(bad):
    with pytest.raises(rules.RuleSyntaxError):
        rules.parse_keyword_rules(bad)


def test_keyword_rules(spark):
    parsed = rules.parse_keyword_rules('"A" AND not any("b", "C ") or "D"; "E" ;')
    assert [r.source for r in parsed] == ['"A" and not any("b", "C ") or "D"', '"E"']
    assert rules.parse_keyword_rules("  ") == []
    texts = [("xa",), ("ab",), ("ac d",), ("e",), ("zz",)]
    r = spark.createDataFrame(texts, "t string").select(rules.first_rule(text.comparison_text(F.col("t")), parsed).alias("i")).collect()
    assert [x["i"] for x in r] == [0, None, 0, 1, None]


@pytest.mark.parametrize("bad", ["", "C01", "C000", "c001", "C001 and C002", "C001 AND", "(C001", "C001)", "C001 C002", "C001ANDC002", "NOT C001", "AND C001", "()"])
def test_criterion_syntax_errors(bad):
    with pytest.raises(rules.RuleSyntaxError):
        rules.parse_criterion_rule(bad)


@pytest.mark.parametrize("a", [True, False])
@pytest.mark.parametrize("b", [True, False])
@pytest.mark.parametrize("c", [True, False])
def test_criterion_truth(spark, a, b, c):
    m = F.create_map(F.lit("C001"), F.lit(a), F.lit("C002"), F.lit(b), F.lit("C003"), F.lit(c))
    assert one(spark, rules.rule_set(m, ["C001 AND C002 OR C003"])) == (a and b or c)
    assert one(spark, rules.rule_set(m, ["C001 AND (C002 OR C003)"])) == (a and (b or c))
    assert one(spark, rules.rule_set(m, ["C001", "C002"])) == (a or b)


def test_missing_criterion_is_never_passed_over(spark):
    m = F.create_map(F.lit("C001"), F.lit(True))
    assert one(spark, rules.rule_set(m, ["C001 OR C009"])) is None


def test_protected(spark):
    r = spark.createDataFrame([("2023年",), ("2023-05",), ("3-5年",), ("v1.2.3",), ("主美",), ("。、",), ("",), ("…　",)], "t string")
    got = r.select(text.is_protected(F.col("t"), F.col("t")).alias("p"), text.format_only(F.col("t"), F.col("t")).alias("f")).collect()
    assert [x["p"] for x in got] == [True] * 5 + [False] * 3
    assert [x["f"] for x in got] == [False] * 5 + [True, False, True]


def test_functions_of_texts_work_on_pieces(monkeypatch, spark):
    import pyarrow as pa

    monkeypatch.setattr(text.F, "arrow_udf", lambda run, schema: lambda *columns: run)
    seen = []
    run = text.bounded("string")(lambda s: seen.append(sum(len(t or "") for t in s)) or s)("c")
    texts = ["a" * 100_000] * 50 + [None, "", "b" * 600_000]
    assert run(pa.array(texts)).to_pylist() == texts
    assert len(seen) > 10 and sorted(seen)[-2] <= 1 << 18
    parts = text._parts("c")(pa.array([None, "", "a b", "…", *texts[:9]])).to_pylist()
    assert parts[:4] == [None, [], [{"text": "a", "is_protected": True}, {"text": " ", "is_protected": False}, {"text": "b", "is_protected": True}], [{"text": "…", "is_protected": False}]]
    assert text._simhash("c")(pa.array(texts)).to_pylist()[50:52] == [None, None]
    assert text._dice("a", "b")(pa.array(["abc", None]), pa.array(["abc", "x"])).to_pylist()[0]["score"] == 1.0
