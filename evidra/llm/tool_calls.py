"""Tool-call linking: calls and results joined by identifier, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import written

#: Rounds of joins after which conversations whose order is still open are finished in another way (see `order`), and
#: the most identifiers of a conversation that are gathered for it.
ROUNDS, GATHER = 64, 200_000
#: Schemas of the tools that plain dialogues stand for (see `dialogue`).
DIALOGUE_SCHEMAS = {
    name: {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1}}, "required": ["prompt", "words"], "additionalProperties": False}
    for name in ("user", "system")
}
_EVENTS = "conv_id long, turn long, seq int, role string, kind string, call_id string, name string, after array<string>, valid boolean, error string, canonical string"


def canonical(value) -> str:
    """JSON with keys in order of code points, no blanks, characters as they are; whole floats as integers, no NaN."""

    def plain(v):
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("not a JSON number")
            return int(v) if v.is_integer() and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def strict_json(text: str):
    """The value of a JSON text; repeated members and NaN are errors."""

    def members(pairs):
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("repeated member")
        return out

    def constant(name):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=members, parse_constant=constant)


_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
}


def problem(value, schema: dict, at: str = "$") -> str | None:
    """What first goes against a schema (type, enum, const, required, properties, additionalProperties, items, bounds), or None."""
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: not of type {kinds}"
    same = [canonical(value)] if "enum" in schema or "const" in schema else []
    if "const" in schema and same[0] != canonical(schema["const"]) or "enum" in schema and same[0] not in map(canonical, schema["enum"]):
        return f"{at}: not an allowed value"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        return f"{at}: length"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        return f"{at}: out of bounds"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", ()):
            if k not in value:
                return f"{at}: {k} is missing"
        for k in sorted(value):
            extra = schema.get("additionalProperties", True)
            if k not in known and extra is False:
                return f"{at}: {k} is not allowed"
            inner = known.get(k, extra if isinstance(extra, dict) else None)
            if inner is not None and (e := problem(value[k], inner, f"{at}.{k}")):
                return e
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if e := problem(x, schema["items"], f"{at}[{i}]"):
                return e
    return None


def read_message(conv, turn, role, text, schemas: dict, dialogue: bool) -> list[tuple]:
    """The events of a message: calls, a result, or a plain message.

    A text that is a JSON object with tool_calls (id, name, arguments, and ids it comes after) makes calls,
    one with tool_call_id a result. Other texts are plain messages; in a dialogue the turn of a user or the
    system is a call of the tool named like the role, and that of an assistant the result of the call one
    turn before.
    """
    text = text or ""

    def event(seq, kind, call_id=None, name=None, after=(), error=None, body=None):
        return (conv, turn, seq, role, kind, call_id, name, list(after), error is None, error, canonical(body if body is not None else {"content": text, "role": role}))

    value = None
    if text.lstrip()[:1] == "{":
        try:
            value = strict_json(text)
            canonical(value)
        except (ValueError, RecursionError):
            value = None
    if isinstance(value, dict) and isinstance(value.get("tool_calls"), list):
        out = []
        for k, c in enumerate(value["tool_calls"]):
            c = c if isinstance(c, dict) else {}
            name, args, after = c.get("name"), c.get("arguments"), c.get("after", [])
            if isinstance(args, str):
                try:
                    args = strict_json(args)
                    canonical(args)
                except (ValueError, RecursionError):
                    args = c.get("arguments")
            error = None if isinstance(c.get("id"), str) else "$: no id"
            if error is None:
                error = problem(args, schemas[name]) if isinstance(name, str) and name in schemas else "$: unknown tool"
            after = [x for x in after if isinstance(x, str)] if isinstance(after, list) else []
            out.append(event(k, "call", c["id"] if isinstance(c.get("id"), str) else None, name if isinstance(name, str) else None, after, error, {"arguments": args, "id": c.get("id"), "name": name}))
        return out or [event(0, "message")]
    if isinstance(value, dict) and isinstance(value.get("tool_call_id"), str):
        return [event(0, "result", value["tool_call_id"], value.get("name") if isinstance(value.get("name"), str) else None, body={"content": value.get("content"), "id": value["tool_call_id"]})]
    if dialogue and turn is not None and role in ("user", "system"):
        args = {"prompt": text, "words": len(text.split())}
        error = problem(args, schemas[role]) if role in schemas else "$: unknown tool"
        return [event(0, "call", str(turn), role, (), error, {"arguments": args, "id": str(turn), "name": role})]
    if dialogue and turn is not None and role == "assistant":
        return [event(0, "result", str(turn - 1), body={"content": text, "id": str(turn - 1)})]
    return [event(0, "message")]


def events(messages: DataFrame, schemas: dict, dialogue: bool = False) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [e for m in zip(*(c.to_pylist() for c in b.columns)) for e in read_message(*m, schemas, dialogue)]
            types = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.string()), pa.bool_(), pa.string(), pa.string()]
            cols = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _EVENTS.split(", ")])

    return messages.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text").mapInArrow(run, _EVENTS)


def link(messages: DataFrame, schemas: dict, dialogue: bool = False) -> DataFrame:
    """One row per event of messages (conv_id, turn, role, text), linked and placed in topological order.

    Returns conv_id, turn, seq, role, kind (call, result, message), call_id, name, order_turn, order_depth,
    linked, copies, valid, error, canonical. In a conversation the order (order_turn, order_depth, turn, seq)
    puts every result after its call and every call after those it names: order_turn is the greatest turn
    among an event and all it depends on, order_depth counts the dependencies inside that turn. Both follow
    from hash joins by identifier, so the events of a conversation are never gathered (see `order`). Calls that
    wait for each other in a circle have order_depth null and are not valid.
    linked: a call has a result, a result has a call (else it is an orphan). copies: rows with the same
    identifier and kind; the first call (by turn, seq) is the one that results belong to. valid and error:
    the arguments against the tool's schema, unknown tools, missing ids. A null conv_id is a conversation of
    its own; a null turn comes first; a null text is empty; texts that are not strict JSON objects are plain
    messages. An empty table gives an empty result; other columns are not read.
    """
    ev = written(events(messages, schemas, dialogue), "events").withColumn("at", F.coalesce("turn", F.lit(-1)))
    ev = ev.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    calls = ev.where("kind = 'call' and call_id is not null")
    first = calls.groupBy("conv", "call_id").agg(F.min("at").alias("call_at"), F.count("*").alias("n_calls"))
    answers = ev.where("kind = 'result'").groupBy("conv", "call_id").agg(F.count("*").alias("n_results"))
    named = written(first.join(answers.hint("shuffle_hash"), ["conv", "call_id"], "full_outer"), "identifiers")
    placed = order(named, calls)
    out = ev.join(placed.hint("shuffle_hash"), ["conv", "call_id"], "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    own = F.greatest("at", F.when(is_call | is_result, F.col("call_turn")))
    # inside the turn at which its call is placed, a result is one deeper
    depth = F.when(is_call, F.when(F.col("call_turn") == own, F.col("call_depth")).otherwise(0)).when(is_result & (F.col("call_turn") == own), F.col("call_depth") + 1).otherwise(0)
    cyclic = is_call & F.coalesce(F.col("cyclic"), F.lit(False))
    return out.select(
        "conv_id", "turn", "seq", "role", "kind", "call_id", "name",
        own.alias("order_turn"), F.when(~cyclic, depth).cast("long").alias("order_depth"),
        F.when(is_call, F.coalesce(F.col("n_results") > 0, F.lit(False))).when(is_result, F.coalesce(F.col("n_calls") > 0, F.lit(False))).otherwise(False).alias("linked"),
        F.coalesce(F.when(is_call, F.col("n_calls")).when(is_result, F.col("n_results")), F.lit(1)).alias("copies"),
        (F.col("valid") & ~cyclic).alias("valid"), F.when(cyclic & F.col("error").isNull(), F.lit("$: waits for itself")).otherwise(F.col("error")).alias("error"), "canonical",
    )


def order(named: DataFrame, calls: DataFrame) -> DataFrame:
    """(conv, call_id, n_calls, n_results, call_turn, call_depth, cyclic) of identifiers, from what calls name in `after`.

    Each round of joins moves what is placed before one that it names; calls named in earlier turns are in
    place after the first. What is still open after ROUNDS rounds (circles, and long chains inside a turn) is
    finished exactly: conversations of at most GATHER identifiers one by one, larger ones by `peel`.
    """
    base = named.select("conv", "call_id", "n_calls", "n_results", F.col("call_at").alias("call_turn"), F.lit(0).alias("call_depth"))
    needs = calls.select("conv", "call_id", F.explode("after").alias("need")).distinct()
    needs = written(needs.join(named.where("call_at is not null").select("conv", F.col("call_id").alias("need"), "call_at").hint("shuffle_hash"), ["conv", "need"]), "needs")
    if needs.isEmpty():
        return base.withColumn("cyclic", F.lit(False))
    state = base
    for k in range(ROUNDS):
        from_ = state.select("conv", F.col("call_id").alias("need"), F.col("call_turn").alias("t"), F.col("call_depth").alias("d"))
        got = needs.join(from_.hint("shuffle_hash"), ["conv", "need"]).groupBy("conv", "call_id").agg(F.max(F.struct("t", "d")).alias("top"))
        new = state.join(got.hint("shuffle_hash"), ["conv", "call_id"], "left")
        turn = F.greatest("call_turn", "top.t")
        depth = F.when(F.col("top.t") == turn, F.greatest(F.when(F.col("call_turn") == turn, F.col("call_depth")).otherwise(0), F.col("top.d") + 2)).otherwise(F.col("call_depth"))
        new = new.select("conv", "call_id", "n_calls", "n_results", turn.alias("call_turn"), depth.cast("int").alias("call_depth"), (F.coalesce(turn != F.col("call_turn"), F.lit(False)) | F.coalesce(depth != F.col("call_depth"), F.lit(False))).alias("cyclic"))
        state = written(new, "order")
        if state.where("cyclic").isEmpty():
            return state
    open_ = state.where("cyclic").select("conv").distinct()
    size = written(named.join(open_, "conv", "left_semi").groupBy("conv").agg(F.count("*").alias("size")), "open")
    few, many = (size.where(c).select("conv") for c in (F.col("size") <= GATHER, F.col("size") > GATHER))
    after = needs.groupBy("conv", "call_id").agg(F.collect_list("need").alias("after"))
    rest = named.join(few, "conv", "left_semi").join(after, ["conv", "call_id"], "left")
    rest = rest.select("conv", "call_id", "n_calls", "n_results", "call_at", "after").groupBy("conv").applyInArrow(settle, state.schema)
    out = state.join(size, "conv", "left_anti").union(rest)
    if not many.isEmpty():
        out = out.union(peel(named.join(many, "conv", "left_semi"), needs.join(many, "conv", "left_semi")))
    return written(out, "order")


def peel(named: DataFrame, needs: DataFrame) -> DataFrame:
    """As `settle`, by joins for conversations of any size: each round places the calls all of whose needs are placed, until a round places none.

    What is left then waits for itself; it has the greatest turn that it reaches.
    """
    of = needs.groupBy("conv", "call_id").agg(F.count("*").alias("waits"))
    start = written(named.join(of, ["conv", "call_id"], "left").withColumn("waits", F.coalesce("waits", F.lit(0))), "waiting")
    keep = ["conv", "call_id", "n_calls", "n_results"]
    last = written(start.where("waits = 0").select(*keep, F.col("call_at").alias("call_turn"), F.lit(0).alias("call_depth")), "placed")
    # got: of each call how many of its needs are placed, and the last of those
    got, placed = None, last
    while not last.isEmpty():
        new = needs.join(last.select("conv", F.col("call_id").alias("need"), "call_turn", "call_depth"), ["conv", "need"]).groupBy("conv", "call_id").agg(F.count("*").alias("met"), F.max(F.struct(F.col("call_turn").alias("t"), F.col("call_depth").alias("d"))).alias("top"))
        got = written(new if got is None else got.union(new).groupBy("conv", "call_id").agg(F.sum("met").alias("met"), F.max("top").alias("top")), "met")
        ready = start.join(got.where("met is not null"), ["conv", "call_id"]).where("met = waits").join(placed.select("conv", "call_id"), ["conv", "call_id"], "left_anti")
        same = F.col("top.t") >= F.col("call_at")
        last = written(ready.select(*keep, F.greatest("call_at", "top.t").alias("call_turn"), F.when(same, F.col("top.d") + 2).otherwise(0).cast("int").alias("call_depth")), "placed")
        placed = written(placed.union(last), "placed")
    out = placed.withColumn("cyclic", F.lit(False))
    stuck = start.join(placed.select("conv", "call_id"), ["conv", "call_id"], "left_anti")
    turn = F.col("call_at") if got is None else F.greatest("call_at", "top.t")
    stuck = written((stuck if got is None else stuck.join(got, ["conv", "call_id"], "left")).select(*keep, turn.alias("call_turn")), "stuck")
    while True:
        reach = needs.join(stuck.select("conv", F.col("call_id").alias("need"), F.col("call_turn").alias("t")), ["conv", "need"]).groupBy("conv", "call_id").agg(F.max("t").alias("t"))
        new = stuck.join(reach, ["conv", "call_id"], "left").select(*keep, F.greatest("call_turn", "t").alias("call_turn"), F.coalesce(F.col("t") > F.col("call_turn"), F.lit(False)).alias("moved"))
        new = written(new, "stuck")
        stuck = new.drop("moved")
        if new.where("moved").isEmpty():
            return out.union(stuck.select(*keep, "call_turn", F.lit(0).alias("call_depth"), F.lit(True).alias("cyclic")))


def settle(t: pa.Table) -> pa.Table:
    """The order of one conversation's identifiers: those without open dependencies are placed first; what is left over is cyclic."""
    ids, at, after = (t.column(c).to_pylist() for c in ("call_id", "call_at", "after"))
    n = len(ids)
    place = {x: k for k, x in enumerate(ids)}
    needs = [[place[x] for x in a or ()] for a in after]
    waiting, dependents = [len(a) for a in needs], [[] for _ in range(n)]
    for k, a in enumerate(needs):
        for j in a:
            dependents[j].append(k)
    turn, depth = list(at), [0] * n
    free = [k for k in range(n) if not waiting[k]]
    for k in free:  # grows while it is read
        if needs[k]:
            top = max((turn[j], depth[j]) for j in needs[k])
            if top[0] >= turn[k]:
                turn[k], depth[k] = top[0], top[1] + 2
        for j in dependents[k]:
            waiting[j] -= 1
            if not waiting[j]:
                free.append(j)
    cyclic = [w > 0 for w in waiting]
    # the greatest turn that each of the others reaches, from the greatest down
    left = [k for k in range(n) if cyclic[k]]
    for k in left:
        turn[k] = max([turn[k], *(turn[j] for j in needs[k] if not cyclic[j])])
    seen = set()
    for k in sorted(left, key=lambda k: -turn[k]):
        todo = [k] if k not in seen else []
        seen.add(k)
        while todo:
            for j in dependents[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    turn[j] = turn[k]
                    todo.append(j)
    new = {"call_turn": pa.array(turn, pa.int64()), "call_depth": pa.array(depth, pa.int32()), "cyclic": pa.array(cyclic, pa.bool_())}
    return pa.table({c: t.column(c) for c in ("conv", "call_id", "n_calls", "n_results")} | new)


def as_tool_messages(turns: DataFrame) -> DataFrame:
    """Plain dialogue turns (conv_id, turn, role, text) as messages with tool calls and results, by columns.

    A turn of a user or the system becomes a call of the tool named like the role: its id is the turn, its
    arguments, a JSON text, are the prompt and its number of words, and it comes after the calls of the two turns
    before (those that are there). A turn of an assistant becomes the result of the call of the turn before.
    Turns without a number stay as they are.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    name = lambda k: (F.col("turn") - k).cast("string")
    arguments = F.to_json(F.struct(words.alias("words"), text.alias("prompt")))
    call = F.struct(name(0).alias("id"), F.col("role").alias("name"), arguments.alias("arguments"), F.array(name(2), name(1)).alias("after"))
    made = F.when(F.col("role").isin("user", "system"), F.to_json(F.struct(F.array(call).alias("tool_calls"))))
    made = made.when(F.col("role") == "assistant", F.to_json(F.struct(name(1).alias("tool_call_id"), text.alias("content"))))
    return turns.select("conv_id", "turn", "role", F.when(F.col("turn").isNotNull(), made).alias("made"), "text").select("conv_id", "turn", "role", F.coalesce("made", "text").alias("text"))


def op4_tool_call_linking(spark, sf_dir):
    """Every turn of `conversations` as a message with a tool call or a result (see as_tool_messages), linked, ordered and validated."""
    out = link(as_tool_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")), DIALOGUE_SCHEMAS)
    return out.withColumn("canonical_sha256", F.sha2("canonical", 256)).drop("canonical")
