"""Tool-call linking against plain Python over random conversations with repeats, cycles, orphans and bad arguments."""

import json
import random

from folio.llm import chat

DDL = "conv_id long, turn long, role string, text string, level string, status string"
KINDS = {"string": str, "integer": int, "boolean": bool, "array": list, "object": dict}


def canonical(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def conversations(seed, n=60):
    r, rows = random.Random(seed), []
    for c in range(n):
        tools = {f"t{k}": {r.choice("abc"): {"type": r.choice(list(KINDS))} for _ in range(r.randint(0, 3))} for k in range(3)}
        need = {t: [k for k in p if r.random() < 0.5] for t, p in tools.items()}
        rows.append((c, 0, "system", "Use " + "".join(f"<tool>{json.dumps({'name': t, 'parameters': {'properties': p, 'required': need[t]}})}</tool>" for t, p in tools.items())))
        ids = [f"i{k}" for k in range(6)]
        for turn in range(1, r.randint(2, 6)):
            if r.random() < 0.4:
                rows.append((c, turn, "tool", r.choice(["{bad", json.dumps({"content": "é x", "tool_call_id": r.choice(ids)}), json.dumps({"b": 1})])))
                continue
            text = "say "
            for _ in range(r.randint(0, 3)):
                call = {"name": r.choice(["t0", "t1", "t2", "other"]), "id": r.choice(ids), "arguments": {k: r.choice(["s", 3, True, [1], {"y": 2}]) for k in "abc" if r.random() < 0.6}}
                if r.random() < 0.5:
                    call["depends_on"] = r.sample(ids, r.randint(1, 2))
                text += "<tool_call>" + (json.dumps(call) if r.random() < 0.9 else "{oops") + "</tool_call>"
            rows.append((c, turn, "assistant", text))
    return rows


def expected(rows):
    import re

    out = []
    for c in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == c]
        tools, calls, results = {}, [], []
        for _, turn, role, text in own:
            if role == "system":
                for raw in re.findall(r"<tool>(.*?)</tool>", text):
                    tool = json.loads(raw)
                    tools.setdefault(tool["name"], tool["parameters"])
            if role == "tool":
                try:
                    results.append((turn, json.loads(text), text))
                except ValueError:
                    results.append((turn, None, text))
            else:
                out.append((c, turn, 0, 0, "message", None, "message", None, canonical({"content": re.sub(r"<tool_call>.*?</tool_call>", "", text).strip(" "), "role": role})))
            if role == "assistant":
                for at, raw in enumerate(re.findall(r"<tool_call>(.*?)</tool_call>", text)):
                    try:
                        calls.append((turn, at, json.loads(raw), raw))
                    except ValueError:
                        calls.append((turn, at, None, raw))
        named = [x for x in calls if x[2]]
        ids = {x[2]["id"] for x in named}
        needs = {i: {d for x in named if x[2]["id"] == i for d in x[2].get("depends_on", []) if d in ids} for i in ids}
        level = {}
        for step in range(len(ids) + 1):
            level |= {i: step for i in [i for i in ids if i not in level and needs[i] <= {j for j in level if level[j] < step}]}
        first = {i: min(x[0] for x in named if x[2]["id"] == i) for i in ids}
        reach = dict(first)
        for i in sorted(level, key=level.get):
            reach[i] = max([first[i], *[reach[d] for d in needs[i]]])
        answered = {d["tool_call_id"] for _, d, _ in results if d and "tool_call_id" in d}
        for turn, at, call, raw in calls:
            if not call:
                out.append((c, turn, 0, at + 1, "call", None, "malformed", None, canonical({"malformed": raw})))
                continue
            i, valid = call["id"], None
            if call["name"] in tools:
                p = tools[call["name"]]
                right = all(type(v) is KINDS[p["properties"][k]["type"]] for k, v in call["arguments"].items() if k in p["properties"])
                valid = right and all(k in call["arguments"] for k in p["required"])
            status = "repeated" if sum(x[2]["id"] == i for x in named) > 1 else "cyclic" if i not in level else "unanswered" if i not in answered else "linked"
            out.append((c, max([turn, *[reach[d] for d in needs[i] if i in level]]), level.get(i, 0), at + 1, "call", i, status, valid, canonical(call)))
        for turn, d, text in results:
            i = d.get("tool_call_id") if d else None
            out.append((c, max(turn, reach.get(i, 0)), level.get(i, 0), 1 << 40, "result", i, "linked" if i in first else "orphan", None, canonical(d if d else {"content": text})))
    return out


def test_random_conversations(spark):
    rows = conversations(5)
    got = chat.link(spark.createDataFrame([(*x, "a", "b") for x in rows], DDL)).collect()
    key = lambda x: tuple(map(str, x))
    want = expected(rows)
    assert sorted(map(key, want)) == sorted(key((x["conv_id"], x["order_turn"], x["level"], x["step"], x["kind"], x["id"], x["status"], x["valid"], x["json"])) for x in got)
    assert {x[6] for x in want} == {"message", "malformed", "repeated", "cyclic", "unanswered", "linked", "orphan"} and {x[7] for x in want} == {None, True, False}


def call(id, needs=(), args=None, name="t"):
    return "<tool_call>" + json.dumps({"name": name, "id": id, "arguments": args or {}, "depends_on": list(needs)}) + "</tool_call>"


def placed(spark, rows):
    got = chat.link(spark.createDataFrame([(*x, "a", "b") for x in rows], DDL)).collect()
    return {(x["conv_id"], x["kind"], x["id"]): (x["order_turn"], x["level"], x["step"]) for x in got if x["id"]}, got


def test_chains_over_turns(spark):
    answer = lambda i: json.dumps({"tool_call_id": i, "content": "x"})
    rows = [(1, 1, "assistant", call("c", ["b"]) + call("b", ["a"])), (1, 2, "tool", answer("b")), (1, 5, "assistant", call("a")), (1, 9, "tool", answer("c"))]
    r = random.Random(8)
    for c in range(2, 30):
        ids = [f"i{k}" for k in range(r.randint(2, 9))]
        for k, i in enumerate(ids):
            rows.append((c, r.randint(1, 12), "assistant", call(i, r.sample(ids[:k], r.randint(0, min(k, 3))))))
            rows.append((c, r.randint(1, 12), "tool", answer(i)))
    at, _ = placed(spark, rows)
    assert at[1, "call", "a"] == (5, 0, 1) and at[1, "call", "b"] == (5, 1, 2) and at[1, "call", "c"] == (5, 2, 1) and at[1, "result", "b"] == (5, 1, 1 << 40) and at[1, "result", "c"][0] == 9
    for c, _, role, text in rows:
        if role == "assistant":
            for raw in text.split("<tool_call>")[1:]:
                one = json.loads(raw.removesuffix("</tool_call>"))
                assert all(at[c, "call", d] < at[c, "call", one["id"]] for d in one["depends_on"])
                if (c, "result", one["id"]) in at:
                    assert at[c, "result", one["id"]] > at[c, "call", one["id"]]


def test_nested_schemas(spark):
    schema = {"properties": {"x": {"type": "object", "properties": {"y": {"type": "integer"}, "a.b": {"enum": ["u", 2, None]}}, "required": ["y"]}, "l": {"type": "array", "items": {"type": ["string", "null"]}}, "e": {"enum": [{"k": 1, "j": [1]}]}}, "required": ["x"]}
    cases = [
        ({"x": {"y": 1}}, True), ({"x": {"y": "no"}}, False), ({"x": {}}, False), ({}, False), ({"x": {"y": 1, "a.b": "u"}}, True), ({"x": {"y": 1, "a.b": 3}}, False), ({"x": {"y": 1, "a.b": None}}, True),
        ({"x": {"y": 1}, "l": ["a", None]}, True), ({"x": {"y": 1}, "l": ["a", 1]}, False), ({"x": {"y": 1}, "l": []}, True), ({"x": {"y": 1}, "e": {"j": [1], "k": 1}}, True), ({"x": {"y": 1}, "e": {"k": 1}}, False), ({"x": [1]}, False), ({"x": {"y": 1}, "z": 5}, True),
    ]
    rows = [(1, 0, "system", f"<tool>{json.dumps({'name': 't', 'parameters': schema})}</tool><tool>{json.dumps({'name': 'bare'})}</tool>")]
    rows += [(1, k + 1, "assistant", call(f"i{k}", args=a)) for k, (a, _) in enumerate(cases)] + [(1, 90, "assistant", call("bare", args={"q": 1}, name="bare") + call("none", name="unknown"))]
    got = {x["id"]: x["valid"] for x in placed(spark, rows)[1] if x["kind"] == "call"}
    assert got == {f"i{k}": v for k, (_, v) in enumerate(cases)} | {"bare": True, "none": None}


def test_empty_repeated_and_long(spark):
    assert chat.link(spark.createDataFrame([], DDL)).count() == 0
    long = "x" * 1_000_000
    got = chat.link(spark.createDataFrame([(1, 1, "user", long, "", "")] * 2 + [(1, 2, "tool", '{"tool_call_id":"a"}', "", "")] * 2, DDL)).collect()
    assert len(got) == 4 and not spark.catalog.listTables()
