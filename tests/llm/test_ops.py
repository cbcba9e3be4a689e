"""Operators on training data against brute force, and their edge cases."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evidra.llm import common, fingerprints, line_dedup, mixing, pairwise_quality, quality_rules, sentencepieces, simhash, token_counts, tool_calls, toxicity
from evidra.llm.textstats import Batch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, keys int, size string, score int, raw string"


def corpus(n=60, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts = []
    for _ in range(n):
        lines = [" ".join(r.choice(words) for _ in range(r.randint(3, 25))) + "." for _ in range(r.randint(1, 8))]
        texts.append("\n".join(lines))
    texts[5] = texts[2]
    texts[9] = texts[2] + " end"
    texts[11] = "  " + texts[3].upper()
    shared = "A passage that several documents share, word for word."
    for k in (1, 4, 8, 12, 20):
        texts[k] += "\n" + shared
    edges = [None, "", " \n\t\n", "x", "é中😀 <|endoftext|> a  b\n\n c\x1cd", "word " * 3000, "z" * 5000]
    return [(k * 3, t, "en", [None, "s1", "s2", "s3"][k % 4], len(t or "")) for k, t in enumerate(texts + edges)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


def odd(spark):
    """Null ids, repeated rows, clashing columns."""
    rows = [(None, "a b c d e f", "en", None, 11), (7, "same text here for all " * 5, None, "s", None), (7, "same text here for all " * 5, None, "s", None), (8, None, None, None, None), (9, "", None, "s", None)]
    return spark.createDataFrame([r + (1, "x", 2, "y", 3, "z") for r in rows], EXTRA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def labels(spark, n, seed=0):
    r = random.Random(seed)
    return spark.createDataFrame([(k, r.randint(0, 1), r.randint(0, 1)) for k in range(n)], "doc_id long, quality int, toxic int")


ALL = {
    "op1": lambda d, s: fingerprints.compare_with_next(d),
    "op2": lambda d, s: token_counts.token_counts(d),
    "op3": lambda d, s: simhash.near_duplicates(d),
    "op3b": lambda d, s: simhash.drop_near_copies(d),
    "op5": lambda d, s: line_dedup.dedup_lines(d),
    "op6": lambda d, s: mixing.mix(d),
    "op7": lambda d, s: quality_rules.apply_rules(d, quality_rules.Model.fit([], [])),
    "op8": lambda d, s: sentencepieces.encode(d, decoded=True),
    "op9": lambda d, s: toxicity.score(d, toxicity.Network()),
    "op10": lambda d, s: pairwise_quality.classify(d, labels(s, 20)),
}


@pytest.mark.parametrize("name", ALL)
def test_edges(spark, name):
    f = ALL[name]
    assert f(spark.createDataFrame([], DOCS), spark).count() == 0
    out = f(odd(spark), spark)
    got = Counter(r["doc_id"] for r in out.collect())
    if name == "op3b":
        assert got == {None: 1, 7: 2, 8: 1}
    else:
        assert got == {None: 1, 7: 2, 8: 1, 9: 1}


def test_op1(spark, docs):
    got = by_id(fingerprints.compare_with_next(docs))
    order = sorted(ROWS)
    for k, (i, t, *_) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i]["edited_text"] == e and got[i]["n_chars"] == len(t)
        a, b, c = (Counter(p for p in x.replace(". ", ".\n").split("\n") if p and not p.isspace()) for x in (t, e, n))
        for x, name in ((b, "near_edited"), (c, "near_next")):
            total = a.total() + x.total()
            assert got[i][name] == pytest.approx(2 * (a & x).total() / total if total else 1.0)
    same = [i for i, t, *_ in ROWS if t == ROWS[2][1]]
    assert len({got[i]["fingerprint"] for i in same}) == 1
    one = fingerprints.compare_with_next(spark.createDataFrame([(5, "abcd", None, None, 4)], DOCS)).first()
    assert one["edited_text"] == "abab" and one["near_next"] == 1.0


@pytest.mark.parametrize("buckets", [1, 2, 7, 200])
def test_op1_any_number_of_buckets(docs, buckets, monkeypatch):
    rows = [r for r in fingerprints.with_next(docs, buckets).collect()]
    assert sorted(r["id"] for r in rows if not r["guest"]) == sorted(r[0] for r in ROWS)


def test_op1_peeling_recovers_the_differences():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 40, 700):
        both = r.integers(0, 2**63, 50).astype(np.uint64)
        a, b = r.integers(0, 2**63, n).astype(np.uint64), r.integers(0, 2**63, n // 2).astype(np.uint64)
        (x, y), (p, q) = fingerprints.reconcile([np.concatenate([both, a]), both], [np.concatenate([both, b]), both])
        assert set(x) == set(a) and set(y) == set(b) and not len(p) and not len(q)


def test_op2(docs):
    got, tok = by_id(token_counts.token_counts(docs)), token_counts.load("byte_bpe_50k.json")
    for i, t, *_ in ROWS:
        n = len(tok.encode(t or "", add_special_tokens=False))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024)


def test_op2_slices_and_repeats_change_nothing():
    c = token_counts.Counter("byte_bpe_50k.json")
    r = random.Random(2)
    texts = ["".join(r.choice(" ab\n\tcé.<|endoftext|>") for _ in range(400)) for _ in range(60)]
    want = [len(c.tok.encode(t, add_special_tokens=False)) for t in texts]
    assert c.counts(texts) == want and c.counts(texts) == want
    for t in texts:
        assert "".join(token_counts.safe_slices(t, 20)) == t
        assert sum(len(c.tok.encode(s, add_special_tokens=False)) for s in token_counts.safe_slices(t, 20)) == len(c.tok.encode(t, add_special_tokens=False))


def _components(fps, bits):
    ids, parent = list(fps), {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _brute_fp(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op3(docs):
    fps = {i: _brute_fp(t) for i, t, *_ in ROWS}
    want, got = _components(fps, 2), by_id(simhash.near_duplicates(docs))
    assert all(got[i]["fingerprint"] == f"{fps[i]:016x}" and got[i]["component_id"] == want[i] for i in fps)


def _variants(n, seed):
    """Fingerprints in clusters: chains of one to three flipped bits."""
    r, out = random.Random(seed), {}
    for k in range(n):
        out[k] = r.getrandbits(64) if not out or r.random() < 0.1 else out[r.randrange(k)] ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3])))
    return out


@pytest.mark.parametrize("light", [64, 3])
def test_op3_links_of_clusters(spark, monkeypatch, light):
    monkeypatch.setattr(simhash, "LIGHT", light)
    fps = {k: v for k, v in _variants(400, 5).items()}
    uniq = {}
    for k, v in fps.items():
        uniq.setdefault(v, k)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for v, k in uniq.items()], "fp long, rep long")
    got = {r["node"]: r["component"] for r in common.components(simhash.links(nodes)).collect()}
    want = _components({k: v for v, k in uniq.items()}, 2)
    assert all(got.get(k, k) == c for k, c in want.items())


def test_golay_guarantees():
    r = np.random.default_rng(0)
    w = r.integers(0, 1 << 23, 400)
    for flips in (0, 1, 2):
        v = w.copy()
        for k in range(len(v)):
            for b in r.choice(23, flips, replace=False):
                v[k] ^= 1 << b
        (a, ma), (b, mb) = simhash.golay_indices(w), simhash.golay_indices(v)
        assert all(set(x[m]) & set(y[n]) for x, m, y, n in zip(a, ma, b, mb))
    assert set(simhash.golay_indices(w)[1].sum(1)) <= {1, 6}


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(80)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert all(got.get(n, n) == find(n) for n in list(parent))


def test_near_copies(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(2000)]
    rows, base = [], None
    for k in range(90):
        if k % 3 == 0:
            base = [r.choice(words) for _ in range(r.randint(30, 200))]
        t = base[:]
        for _ in range(k % 3):
            t[r.randrange(len(t))] = "new"
        rows.append((k, " ".join(t), "en", "s", 0))
    rows += [(200 + k, rows[0][1], "en", "s", 0) for k in range(40)] + [(300, None, "en", "s", 0), (301, " ", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    sets = {i: set(simhash.shingle_hashes(t or "", 5)) for i, t, *_ in rows}
    got = {r["id"]: r["rep"] for r in simhash.near_copies(df).collect()}
    for a in sets:
        for b in sets:
            j = 1.0 if sets[a] == sets[b] else len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if a < b and j >= 0.8:
                assert got[a] == got[b]
    kept = {r["doc_id"] for r in simhash.drop_near_copies(df).collect()}
    assert kept == set(got.values()) and 0 in kept and 300 in kept and 301 not in kept


def test_near_copies_of_a_hub(spark):
    """Many variants of one text, similar to it but not to one another, the text's id in the middle."""
    r = random.Random(11)
    n, rows = 2000, []
    base = [f"b{k}" for k in range(244)]
    for k in range(n + 1):
        t = base[:]
        for i in r.sample(range(244), 4) if k != n // 2 else ():
            t[i] = f"v{k}x{i}"
        rows.append((k, " ".join(t), "en", "s", 0))
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t, *_ in rows]
    linked = [k for k in range(n + 1) if len(sets[k] & sets[n // 2]) >= 0.8 * len(sets[k] | sets[n // 2])]
    assert len(linked) > 0.9 * n
    got = {x["id"]: x["rep"] for x in simhash.near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    assert len({got[k] for k in linked}) == 1


def _calls(turns):
    return json.dumps({"tool_calls": turns})


def test_op4(spark):
    schemas = {"add": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}, "k": {"enum": ["a", 1]}}, "required": ["x"], "additionalProperties": False}}
    m = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", _calls([{"id": "b", "name": "add", "arguments": {"x": 1.0}, "after": ["a"]}, {"id": "c", "name": "add", "arguments": '{"x": -1}'}])),
        (1, 2, "assistant", _calls([{"id": "a", "name": "add", "arguments": {"k": "a", "x": 2}}])),
        (1, 0, "tool", json.dumps({"tool_call_id": "a", "content": "ok"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})),
        (2, 0, "assistant", _calls([{"id": "p", "name": "add", "arguments": {"x": 1}, "after": ["q"]}, {"id": "q", "name": "no", "arguments": {}, "after": ["p"]}])),
        (None, None, None, None),
    ]
    out = tool_calls.link(spark.createDataFrame(m, "conv_id long, turn long, role string, text string"), schemas).collect()
    e = {(r["conv_id"], r["kind"], r["call_id"]): r for r in out}
    place = lambda *k: (e[k]["order_turn"], e[k]["order_depth"])
    assert place(1, "call", "a") < place(1, "result", "a") and place(1, "call", "a") < place(1, "call", "b")
    assert e[1, "call", "a"]["linked"] and not e[1, "call", "b"]["linked"] and not e[1, "result", "zz"]["linked"]
    assert e[1, "call", "b"]["valid"] and e[1, "call", "c"]["error"] == "$.x: out of bounds" and e[2, "call", "q"]["error"] == "$: unknown tool"
    assert not e[2, "call", "p"]["valid"] and e[2, "call", "p"]["order_depth"] is None
    assert e[1, "call", "b"]["canonical"] == '{"arguments":{"x":1},"id":"b","name":"add"}'
    assert e[None, "message", None]["canonical"] == '{"content":"","role":null}'
    assert tool_calls.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), schemas).count() == 0


def test_op4_query(spark, tmp_path):
    """The registered query against plain loops over each conversation."""
    rows = [(c, t, r.choice(["user", "assistant", "system"]), r.choice(["", None, 'say "hi"\nthere', "a b\tc é"])) for c in range(30) for r in [random.Random(c)] for t in range(r.randint(1, 9))]
    r = random.Random(5)
    r.shuffle(rows)
    rows += [(None, 0, "user", "no conversation"), (77, None, "user", "no turn")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(x["conv_id"], x["turn"]): x for x in tool_calls.op4_tool_call_linking(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    role = {(c, t): x for c, t, x, _ in rows}
    call = lambda c, t: role.get((c, t)) in ("user", "system") and t is not None
    depth: dict = {}
    for c, t, kind, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)):
        x, text = got[c, t], text or ""
        if t is None:
            assert (x["kind"], x["linked"], x["valid"]) == ("message", False, True)
            continue
        assert x["kind"] == ("result" if kind == "assistant" else "call") and x["order_turn"] == t and x["order_depth"] == 0
        if kind == "assistant":
            want = {"content": text, "id": str(t - 1)}
            assert x["linked"] == call(c, t - 1) and x["valid"]
        else:
            want = {"arguments": {"prompt": text, "words": len(text.encode().split())}, "id": str(t), "name": kind}
            problem = "$.prompt: length" if not text else "$.words: out of bounds" if not text.split() else None
            assert x["linked"] == (role.get((c, t + 1)) == "assistant") and x["error"] == problem and x["valid"] == (problem is None)
        assert x["canonical_sha256"] == hashlib.sha256(json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_op4_dialogue(spark):
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", ""), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    e = {(r["conv_id"], r["turn"]): r for r in tool_calls.link(m, tool_calls.DIALOGUE_SCHEMAS, dialogue=True).collect()}
    assert [e[1, t]["linked"] for t in range(4)] == [False, True, True, False] and not e[2, 0]["linked"] and not e[1, 3]["valid"]


def test_op4_edges(spark):
    """Columns of clashing names, repeated rows, very long texts and arguments."""
    long = json.dumps({"tool_calls": [{"id": "a", "name": "t", "arguments": {"x": "y" * 3_000_000}}]})
    rows = [(1, 0, "user", "z" * 5_000_000), (1, 1, "assistant", long), (1, 1, "assistant", long), (1, 2, "tool", '{"tool_call_id":"a"}')]
    df = spark.createDataFrame([x + ("k", 1, True, None) for x in rows], "conv_id long, turn long, role string, text string, kind string, seq int, cyclic boolean, call_turn long")
    out = tool_calls.link(df, {"t": {"type": "object"}}).collect()
    assert [x["kind"] for x in sorted(out, key=lambda x: x["turn"])] == ["message", "call", "call", "result"]
    assert all(x["copies"] == 2 and x["linked"] for x in out if x["kind"] == "call") and all(x["valid"] for x in out)


def _chains(n, r):
    """Calls of one conversation with chains in and out of order, over several turns, circles, and calls behind circles."""
    ids = [f"c{k}" for k in range(n)]
    after = {i: r.sample(ids[:k], min(k, r.choice([0, 1, 2]))) for k, i in enumerate(ids)}
    after |= {"x": ["y"], "y": ["z", "c3"], "z": ["x"], "w": ["x", "c1"], "me": ["me"]}
    turns: dict = {}
    for i in r.sample(list(after), len(after)):
        turns.setdefault(r.randrange(4), []).append({"id": i, "name": "t", "arguments": {}, "after": after[i]})
    at = {c["id"]: t for t, cs in turns.items() for c in cs}
    return after, at, [(t, json.dumps({"tool_calls": cs})) for t, cs in turns.items()]


@pytest.mark.parametrize("gather", [10**6, 0])
def test_op4_order_of_any_chain(spark, monkeypatch, gather):
    """Joins, then one by one or by peeling, against a plain topological order."""
    monkeypatch.setattr(tool_calls, "ROUNDS", 2)
    monkeypatch.setattr(tool_calls, "GATHER", gather)
    rows, want = [], {}
    for c in range(3):
        after, at, made = _chains(12, random.Random(c))
        rows += [(c, t, "assistant", text) for t, text in made]
        place, todo = {}, dict(after)
        while ready := [i for i in todo if all(x in place for x in todo[i])]:
            for i in ready:
                t, d = max([place[x] for x in todo.pop(i)], default=(-1, 0))
                place[i] = (t, d + 2) if t >= at[i] else (at[i], 0)
        turn = {i: at[i] for i in todo}
        for _ in todo:
            turn = {i: max([at[i], *(turn[x] if x in turn else place[x][0] for x in after[i])]) for i in todo}
        want |= {(c, i): (*place[i], True) for i in place} | {(c, i): (turn[i], None, False) for i in todo}
    out = tool_calls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"t": {"type": "object"}}).collect()
    assert {(x["conv_id"], x["call_id"]): (x["order_turn"], x["order_depth"], x["valid"]) for x in out} == want


@pytest.mark.parametrize("bad", ['{"a":1,"a":2}', '{"a":NaN}', "{", "[1"])
def test_op4_strict_json(bad):
    with pytest.raises(ValueError):
        tool_calls.strict_json(bad)


def _brute_lines(rows):
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(line_dedup._LOWER)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    drop = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return {i: [x for x in (t or "").split("\n") if key(x) not in drop or drop[key(x)] == i] for i, t, *_ in rows}


@pytest.mark.parametrize("broadcast", [1 << 24, 0])
def test_op5(docs, broadcast, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", broadcast)
    want, got = _brute_lines(ROWS), by_id(line_dedup.dedup_lines(docs))
    for i, t, *_ in ROWS:
        n = len((t or "").split("\n"))
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(want[i]), n, n - len(want[i]))
    assert sum(r["n_dropped"] for r in got.values()) >= 4


@pytest.mark.parametrize("broadcast", [1 << 24, 0])
def test_op5_deletion_is_the_inverse_of_insertion(spark, docs, broadcast, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", broadcast)
    index = line_dedup.LineIndex.of(docs)
    shared = "A passage that several documents share, word for word."
    more = spark.createDataFrame([(900 + k, shared + "\nanother line that all of these have", None, None, 0) for k in range(3)], DOCS)
    rows = lambda x: sorted((r["h1"], r["h2"], r["n"], r["last"]) for r in x.counts.collect())
    drops = lambda x: sorted((r["id"], sorted(r["keys"])) for r in x.drops().collect())
    before = rows(index), drops(index)
    grown = index.insert(more)
    assert rows(grown) != before[0] and len(rows(grown)) == len(before[0]) + 1
    assert rows(grown.insert(more)) == rows(grown)  # documents that are there already change nothing
    back = grown.delete(more).compacted()
    assert (rows(back), drops(back)) == before


def test_op5_grows_to_twenty_times_its_size(spark, monkeypatch):
    """Filters fill, are built anew with more shards, and still answer for every key; deletion leads back."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 64)
    rows = lambda lo, hi: [(k, "\n".join(f"shared line number {k // 4 * 10 + j} of some length" for j in range(10)), None, None, 0) for k in range(lo, hi)]
    first, rest = (spark.createDataFrame(rows(*x), DOCS).repartition(2) for x in ((0, 40), (40, 800)))
    small = line_dedup.LineIndex.of(first)
    n = small.built_filters().count()
    grown = small.insert(rest)
    want = line_dedup.LineIndex.of(first.union(rest))
    got = sorted((r["id"], sorted(r["keys"])) for r in grown.drops().collect())
    assert got == sorted((r["id"], sorted(r["keys"])) for r in want.drops().collect()) and len(got) == 600
    assert grown.built_filters().count() > n and not any(r["full"] for r in grown.filters.collect())
    back = grown.delete(rest.select("doc_id"))
    assert sorted(r["id"] for r in back.drops().collect()) == sorted(r["id"] for r in small.drops().collect())


def test_op5_repeated_ids_are_one_document(spark, tmp_path):
    """As in the SQL: (3, L), (7, L), (7, L) are two documents; with a third id, all rows of the largest keep the line."""
    import duckdb

    line = "a line of more than twenty characters"
    for extra in ([], [(5, line, None, None, 0), (None, line + "\nown", None, None, 0)]):
        rows = [(3, line, None, None, 0), (7, line, None, None, 0), (7, line + "\nmore", None, None, 0), (8, None, None, None, 0), *extra]
        path = str(tmp_path / f"{len(extra)}")
        spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
        got = sorted(tuple(r) for r in line_dedup.op5_line_dedup(spark, path).fillna(-1).collect())
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
        assert got == sorted((-1 if r[0] is None else r[0], *r[1:]) for r in con.execute(line_dedup.OP5_SQL).fetchall())


def test_cuckoo_filter():
    r, f = random.Random(1), line_dedup.CuckooFilter(3000)
    keys = [r.getrandbits(64) for _ in range(3000)]
    for k in keys:
        f.insert(k)
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(np.array(keys, np.uint64)).all()
    assert f.contains(np.array([r.getrandbits(64) for _ in range(5000)], np.uint64)).mean() < 0.01
    for k in keys[:1500]:
        assert f.delete(k)
    assert f.contains(np.array(keys[1500:], np.uint64)).all() and f.contains(np.array(keys[:1500], np.uint64)).mean() < 0.01
    full = line_dedup.CuckooFilter(4)
    for k in keys[:200]:
        full.insert(k)
    assert full.contains(np.array(keys[:200], np.uint64)).all()


def test_op6(docs):
    got, again = by_id(mixing.mix(docs)), by_id(mixing.mix(docs.repartition(5)))
    assert got == again
    size = {i: len([w for w in (t or "").encode().split()]) for i, t, *_ in ROWS}
    src = {i: s for i, _, _, s, _ in ROWS}
    total = Counter()
    for i in size:
        total[src[i]] += size[i]
    order = sorted((s for s in total if s is not None)) + [None]
    weight, cap = {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}, {s: 2.0 * total[s] for s in order}
    target, left, free = {}, 1.5 * sum(total.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        free -= over
    taken = Counter()
    for i in size:
        r = got[i]
        assert r["size"] == size[i] and r["source_size"] == total[src[i]] and r["target"] == pytest.approx(target[src[i]])
        assert r["taken"] in (0, size[i], 2 * size[i])
        taken[src[i]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(size[i] for i in size if src[i] == s) / 2 + 1


def test_op6_repeats_documents(docs):
    out = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert out == {i: r["taken"] // r["size"] for i, r in by_id(mixing.mix(docs)).items() if r["taken"]}
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_op7_base_counts(docs):
    got = by_id(quality_rules.apply_rules(docs, quality_rules.Model.fit([], [])))
    for i, t, *_ in ROWS:
        t = t or ""
        w = t.encode().split()
        grams = Counter(zip(w, w[1:], w[2:]))
        rep = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            dup += x in seen and bool(x.encode().strip())
            seen.add(x)
        want = (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(rep))
        assert tuple(got[i][1:6]) == want
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_op7_classifier_parts_held_out_texts():
    r = random.Random(6)
    good = [" ".join(r.choice(["the", "of", "stone", "river", "and"]) for _ in range(80)) for _ in range(80)]
    bad = [" ".join(r.choice(["BUY!!", "NOW$$$", "the", "WIN%%"]) for _ in range(80)) for _ in range(80)]
    m = quality_rules.Model.fit(good[:60] + bad[:60], [1] * 60 + [0] * 60)
    assert (m.scores(Batch(good[60:])) >= 0.5).all() and (m.scores(Batch(bad[60:])) < 0.5).all()
    one, many = m.scores(Batch([good[0]])), m.scores(Batch([bad[0], good[0], "", None]))
    assert one[0] == pytest.approx(many[1])


def test_op8_round_trip_and_parity(docs):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = by_id(sentencepieces.encode(docs, decoded=True))
    for i, t, *_ in ROWS:
        assert list(got[i]["ids"]) == sp.encode(t or "") and got[i]["decoded_text"] == sp.decode(sp.encode(t or ""))
    back = by_id(sentencepieces.decode(sentencepieces.encode(docs)))
    assert all(back[i]["text"] == (t or "") for i, t, *_ in ROWS)
    c, r = sentencepieces.Codec("piece_bpe_32k.model"), random.Random(3)
    fuzz = ["".join(r.choice(" ab▁\n\t😀éßthe  ing中文\x00.<s>0") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    assert c.encode(fuzz) == sp.encode(fuzz) and c.decode(c.encode(fuzz)) == sp.decode(sp.encode(fuzz))


def test_op8_long_texts_are_cut_safely(monkeypatch):
    c = sentencepieces.Codec("piece_bpe_32k.model")
    t = "some  words here\nand more " * 50
    whole = c.encode([t])
    monkeypatch.setattr(sentencepieces, "SLICE", 17)
    assert c.encode([t]) == whole


def _sp_model(kind, pieces, byte=False):
    """A model file written by hand: field by field, with the pieces (text, score, type)."""
    import struct

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(n, kind, v):
        return number(n << 3 | kind) + (number(len(v)) + v if kind == 2 else number(v) if kind == 0 else v)

    def piece(p, s, t):
        return field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, t))

    data = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256 * byte)) + b"".join(piece(*p) for p in pieces)
    return data + field(2, 2, field(3, 0, kind) + field(35, 0, int(byte))) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))


@pytest.mark.parametrize("kind", [sentencepieces.UNIGRAM, sentencepieces.BPE])
@pytest.mark.parametrize("byte", [False, True])
@pytest.mark.parametrize("own", [[], ["zz", "<sep>", "q▁q", "$$$"]])
def test_op8_parity_for_other_models(kind, byte, own, tmp_path):
    """Unigram and BPE models with and without byte fallback and user-defined pieces, many scores tied, on random texts."""
    import sentencepiece

    r = random.Random(1)
    pieces = dict.fromkeys("▁abcdez$q<>spé")
    while len(pieces) < 160:
        pieces[r.choice(["▁", "", "", ""]) + "".join(r.choice("abcdez$qé") for _ in range(r.randint(1, 4)))] = None
    if kind == sentencepieces.BPE:
        scored = [(p, -float(k), 1) for k, p in enumerate(sorted(pieces, key=lambda p: (len(p) == 1, len(p))))]
    else:
        scored = [(p, -float(r.randint(4, 10)) - r.choice([0, 0.25, 0.1]), 1) for p in pieces]
    path = tmp_path / "m.model"
    path.write_bytes(_sp_model(kind, [(p, 0.0, 4) for p in own] + [x for x in scored if x[0] not in own], byte))
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["".join(r.choice("  aabbccddeezzz$$qqé<sep>x😀") for _ in range(r.randint(0, 60))) for _ in range(600)]
    codec = sentencepieces.Codec(str(path))
    assert [list(x) for x in codec.encode(texts)] == sp.encode(texts) and codec.decode(sp.encode(texts)) == sp.decode(sp.encode(texts))
    alone = sentencepieces.Codec(str(path), check=False).encode(texts)
    assert sum(list(x) != y for x, y in zip(alone, sp.encode(texts))) <= (60 if kind == sentencepieces.UNIGRAM else 0)


def test_op8_refuses_models_that_differ(tmp_path, monkeypatch):
    path = tmp_path / "m.model"
    path.write_bytes(_sp_model(sentencepieces.BPE, [(p, -float(k), 1) for k, p in enumerate(["▁a", "ab", "▁", "a", "b"])]))
    sentencepieces.Codec(str(path))
    monkeypatch.setattr(sentencepieces.Model, "merges", lambda self: [])
    with pytest.raises(ValueError):
        sentencepieces.Codec(str(path))


def _toxic(n, seed):
    r = random.Random(seed)
    w = [f"w{k}" for k in range(200)]
    out = []
    for k in range(n):
        t = [r.choice(w) for _ in range(r.randint(20, 150))]
        if k % 2:
            for _ in range(1 + len(t) // 50):
                t[r.randrange(len(t))] = r.choice(["idiot", "scum.", "Moron,", "grubelnix" + r.choice("abcdef")])
        out.append((" ".join(t), k % 2))
    return out


def test_op9_learns_and_scores_all_windows(spark):
    rows = _toxic(300, 1)
    net = toxicity.fit([t for t, _ in rows[:220]], [y for _, y in rows[:220]])
    p = net.scores([t for t, _ in rows[220:]])
    y = np.array([y for _, y in rows[220:]])
    assert ((p >= 0.3) == y).mean() >= 0.9
    late = " ".join(["w1"] * 400 + ["idiot", "scum"])
    assert net.scores([late])[0] > net.scores([" ".join(["w1"] * 402)])[0]
    b = toxicity.Tokens([late, "", None, "a"])
    first, size, text = b.windows()
    covered = np.concatenate([np.arange(f, f + n) for f, n in zip(first, size)])
    assert set(covered) == set(range(b.sizes.sum())) and set(text) == {0, 3}
    e = net.scores(["", None])
    assert e[0] == e[1] < 0.3


def _plain_tokens(text):
    out, run = [], ""
    for c in (text or "") + " ":
        o = ord(c)
        if (c.isascii() and c.isalnum()) or (o > 0xBF and not 0x2000 <= o <= 0x206F and not 0x3000 <= o <= 0x303F):
            run += c.lower() if c.isascii() else c
            continue
        while len(run) > toxicity.PIECE:
            out.append(run[: toxicity.PIECE])
            run = run[toxicity.PIECE - toxicity.OVERLAP :]
        if run:
            out.append(run)
        run = ""
    return out


def test_op9_scores_are_those_of_plain_loops(monkeypatch):
    """Tokens, windows, the forward pass and the highest window, one step at a time."""
    monkeypatch.setattr(toxicity, "SLICE", 150)
    texts = [" ".join(f"w{k % 7}-é{k % 5}" for k in range(70)), "x" * 100 + "/Ab", None, "", "IDIOT!"]
    t = toxicity.Tokens(texts)
    plain = [_plain_tokens(x) for x in texts]
    assert list(t.sizes) == list(map(len, plain))
    flat = [w for p in plain for w in p]
    seen = {}
    for w, k in zip(flat, t.which):  # equal tokens have equal inputs, others (but for chance) not
        key = (int(t.word[k]), tuple(t.chars[t.start[k] : t.start[k + 1]]))
        assert seen.setdefault(w, key) == key and len(key[1]) == len(w)
    assert len(set(seen.values())) == len(seen)
    net = toxicity.Network(4)
    p = {k: v.astype(float) for k, v in net.p.items()}
    vec = lambda w: p["word"][seen[w][0]] + sum(p["char"][c] for c in seen[w][1]) / np.sqrt(len(w))
    h = toxicity.HIDDEN

    def states(xs, d):
        s, out = np.zeros(h), []
        for x in xs:
            a, u = x @ p["w" + d] + p["c" + d], s @ p["u" + d]
            z, r = (np.clip(0.25 * (a + u)[k * h : (k + 1) * h] + 0.5, 0, 1) for k in (0, 1))
            n = a[2 * h :] + r * u[2 * h :]
            s = (1 - z) * n / (1 + abs(n)) + z * s
            out.append(s)
        return out

    for k, words in enumerate(plain):
        top = p["bias"][0] - 4
        if words:
            logits = []
            for at in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
                xs = [vec(w) for w in words[at : at + toxicity.WINDOW]]
                hid = np.concatenate([states(xs, "f"), states(xs[::-1], "b")[::-1]], 1)
                e = np.exp(hid @ p["att"])
                logits.append((e / e.sum()) @ hid @ p["out"] + p["bias"][0])
            top = max(logits)
        assert net.scores(texts)[k] == pytest.approx(1 / (1 + np.exp(-top)), abs=1e-5)


def test_op9_gradient():
    rows = _toxic(4, 2)
    net = toxicity.Network(1)
    t = toxicity.Tokens([x for x, _ in rows])
    first, size, text = t.windows()
    y = np.array([y for _, y in rows])[text].astype(float)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w = np.full(len(y), 1 / len(y))
    g = net.gradient(t, first, size, y, w)

    def loss():
        z = net.window_logits(t, first, size).astype(float)
        q = 1 / (1 + np.exp(-z))
        return -(w * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum()

    r = np.random.default_rng(0)
    for k in ("att", "out", "uf", "ub", "wf", "cb", "word", "char"):
        flat = net.p[k].reshape(-1)
        hot = np.flatnonzero(np.abs(g[k]).reshape(-1) > 1e-4)
        for at in r.choice(hot, 3):
            was, h = flat[at], 1e-2
            flat[at] = was + h
            up = loss()
            flat[at] = was - h
            down = loss()
            flat[at] = was
            assert g[k].reshape(-1)[at] == pytest.approx((up - down) / 2 / h, abs=2e-4, rel=0.1)


def test_held_out_rows_are_never_learnt(spark):
    d = spark.createDataFrame([(k, f"text {k}", None, None, 0) for k in range(200)], DOCS)
    for module, n, rest in ((toxicity, 4, 2), (pairwise_quality, 3, 1)):
        out = module.score(d, toxicity.Network()) if module is toxicity else module.classify(d, labels(spark, 200))
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == rest) for r in out.collect())
    from evidra.llm.textstats import labelled_sample

    rows = labelled_sample(d, pairwise_quality.learnable(labels(spark, 200)), 500, 100)
    assert rows and all(zlib.crc32(str(i).encode()) % 3 != 1 for _, _, i in rows)
    assert len(labelled_sample(d, pairwise_quality.learnable(labels(spark, 200)), 10, 100)) == 20


def test_op10(spark):
    r = random.Random(7)
    rows, lab = [], []
    for k in range(240):
        y = int(k % 6 != 0)
        words = ["the", "of", "river", "stone", "and", "light"] if y else ["BUY!!", "###", "WIN", "$$$"]
        rows.append((k, " ".join(r.choice(words) for _ in range(r.randint(20, 80))), None, None, 0))
        lab.append((k, y, 0))
    out = pairwise_quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")).collect()
    held = [x for x in out if x["held_out"]]
    assert len(held) > 40 and all(x["predicted"] == lab[x["doc_id"]][1] and (x["score"] >= 0.5) == bool(x["predicted"]) for x in held)


def test_sha_of_query_columns(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(line_dedup.op5_line_dedup(spark, str(tmp_path)))
    want = _brute_lines(ROWS)
    assert all(got[i]["kept_sha256"] == hashlib.sha256("\n".join(want[i]).encode()).hexdigest() for i in want)
    one = by_id(fingerprints.op1_iblt_fingerprints(spark, str(tmp_path)))
    assert one[0]["edited_sha256"] == hashlib.sha256(by_id(fingerprints.compare_with_next(docs))[0]["edited_text"].encode()).hexdigest()
    assert F.col("x") is not None
