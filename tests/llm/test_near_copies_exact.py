"""Near copies of texts with more shingles than a sketch holds are decided on all of them."""

import random

from evidra.llm import simhash


def test_long_pairs_close_to_the_threshold(spark):
    r = random.Random(3)
    rows = []
    for k in range(60):
        base = [f"p{k}w{i}" for i in range(1000)]
        cut = 883 if k % 2 else 895  # 879 or 891 of 996 shingles are shared: 0.79 or 0.809
        at = r.randrange(1000 - cut + 1)
        t = [w if at <= i < at + cut else f"q{k}w{i}" for i, w in enumerate(base)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(t))]
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in rows]
    got = {x["id"]: x["rep"] for x in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    similar = [len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1]) for k in range(60)]
    assert sum(similar) == 30
    assert [got[2 * k] == got[2 * k + 1] for k in range(60)] == similar


def groups(texts, similarity=0.8):
    """Classes by comparing every two texts."""
    sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
    top = list(range(len(texts)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [find(k) for k in range(len(texts))]


def test_large_loose_groups_lose_no_link(spark, monkeypatch):
    """A template with many variants: some alike only through others, a base near all, pairs of twins; small blocks, so that many meet."""
    monkeypatch.setattr(simhash, "BLOCK", 32)
    r = random.Random(8)
    texts = []
    for size, edits, n in ((300, 5, 150), (240, 4, 90), (120, 2, 60)):
        base = [f"s{size}w{i}" for i in range(size)]
        for k in range(n):
            t = list(base)
            for at in r.sample(range(size), edits + r.randrange(3)):
                t[at] = f"e{r.randrange(10**9)}"
            texts.append(t)
            if k % 10 == 0:  # a twin, one word away
                t = list(t)
                t[r.randrange(size)] = "twin"
                texts.append(t)
        texts.insert(r.randrange(len(texts)), base)
    texts = [" ".join(t) for t in texts]
    r.shuffle(texts)
    want = groups(texts)
    assert 5 < len(set(want)) < len(texts) - 60
    got = {x["id"]: x["rep"] for x in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert [got[k] for k in range(len(texts))] == want
