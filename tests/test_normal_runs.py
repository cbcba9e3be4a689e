"""Normal forms of texts whose runs alone go through Python."""

import random
import unicodedata

from pyspark.sql import functions as F

from evidra.functions import text

SOME = "ab \n\r\t\0éßÇ中，。ﬁ…①½̸̧́  \u0085e=ſſ̈́가각각゙かが𝐀😀क़োיִÅÅΩ"


def test_runs_give_the_normal_form_of_the_whole(spark):
    rnd = random.Random(5)
    texts = ["", None, "plain", "é\n", *("".join(rnd.choices(SOME, k=rnd.randint(1, 25))) for _ in range(3000)), *("".join(chr(rnd.choice((rnd.randint(0, 0x3400), rnd.randint(0x9FF0, 0xD7FF), rnd.randint(0xF900, 0x1FFFF)))) for _ in range(20)) for _ in range(2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = df.select("k", text.normal_form(F.col("t"), "NFC").alias("c"), text.normal_form(F.col("t"), "NFKC").alias("kc")).collect()
    for r in rows:
        t = texts[r["k"]]
        assert (r["c"], r["kc"]) == ((None, None) if t is None else (unicodedata.normalize("NFC", t), unicodedata.normalize("NFKC", t))), ascii(t)


def test_letters_with_marks_do_not_go_through_python(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(form):
        def run(texts):
            seen.add(sum(t is not None for t in texts))
            return [None if t is None else unicodedata.normalize(form, t) for t in texts]

        return text.bounded("string")(run)

    real, text._normal = text._normal, count
    try:
        df = spark.createDataFrame([("Éte ñ ß 中文",), ("x" * 1000 + "ﬁ",)], "t string")
        assert sorted(len(r[0]) for r in df.select(text.normal_form(F.col("t"), "NFKC")).collect()) == [10, 1002]
    finally:
        text._normal = real
    assert seen.value == 1
