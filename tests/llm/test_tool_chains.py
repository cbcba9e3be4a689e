"""Chains of calls of any length are ordered; only circles, and what waits for them, are not."""

import json

from evidra.llm import tool_calls


def test_long_chain(spark):
    n = 150
    call = lambda i, after: {"id": i, "name": "t", "arguments": {}, "after": after}
    chain = [call(f"c{k}", [f"c{k - 1}"] if k else []) for k in range(n)]
    circle = [call("x", ["y"]), call("y", ["x"]), call("z", ["x", "c0"])]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": chain + circle})), (2, 0, "assistant", json.dumps({"tool_calls": chain[:3]}))]
    out = tool_calls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"t": {"type": "object"}}).collect()
    got = {(r["conv_id"], r["call_id"]): r for r in out}
    assert len(out) == n + 6
    for c, k in [(1, k) for k in range(n)] + [(2, k) for k in range(3)]:
        r = got[c, f"c{k}"]
        assert r["valid"] and r["error"] is None and (r["order_turn"], r["order_depth"]) == (0, 2 * k)
    for i in "xyz":
        assert not got[1, i]["valid"] and got[1, i]["order_depth"] is None and got[1, i]["error"] == "$: waits for itself"
