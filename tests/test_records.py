"""Prompts, requests and responses against plain Python on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from clearledger.functions import messages as M
from clearledger.operators import records as X


# Turns of a conversation with the lines that its prompt shows for them.
CONVERSATIONS = {
    1: [("user", "one\nline two", "one\nline two")],
    2: [("user", "hi", "Conversation history:\nUser: hi"), ("assistant", "hello", "\nCurrent question: hello")],
    3: [
        ("SYSTEM", "be brief", "Conversation history:\nSystem: be brief"),
        ("user", "a", "User: a"),
        ("assistant", "b", "Assistant: b"),
        ("user", "c", "\nCurrent question: c"),
    ],
    4: [
        ("user", "a", "Conversation history:\nUser: a"),
        ("user", None, "User: None"),
        (None, "c", "None: c"),
        (None, None, "\nCurrent question: None"),
    ],
    None: [("user", "lost", "Conversation history:\nUser: lost"), ("user", "found", "\nCurrent question: found")],
}


def test_lines_of_prompts(spark):
    rows = [
        (key, i * 100 - 7, role, text)
        for key, turns in CONVERSATIONS.items()
        for i, (role, text, _) in enumerate(turns)
    ]
    df = spark.createDataFrame(rows, "key long, turn long, role string, text string").repartition(5)
    found = {(r.key, r.turn): (r.line, r.complete) for r in X.fold_prompts(df, "key", "turn", "role", "text").collect()}
    assert {k: line for k, (line, _) in found.items()} == {
        (key, i * 100 - 7): line for key, turns in CONVERSATIONS.items() for i, (_, _, line) in enumerate(turns)
    }
    assert sorted(k for k, (_, complete) in found.items() if not complete) == [(4, 93), (4, 193), (4, 293)]


@pytest.mark.parametrize("n", [1, 2, 257, 10_000])
def test_prompts_of_any_length(spark, n):
    turns = spark.range(n).selectExpr("1 AS key", "id * 3 AS turn", "'user' AS role", "concat('t', id) AS text")
    lines = [r.line for r in X.fold_prompts(turns, "key", "turn", "role", "text").orderBy("turn").collect()]
    assert len(lines) == n
    if n > 1:
        assert lines[0] == "Conversation history:\nUser: t0" and lines[-1] == f"\nCurrent question: t{n - 1}"
        assert lines[1:-1] == [f"User: t{i}" for i in range(1, n - 1)]
    else:
        assert lines == ["t0"]


def test_prompt_of_one_row(spark):
    rows = [(k or 0, [(role, text) for role, text, _ in turns]) for k, turns in CONVERSATIONS.items()] + [(9, [])]
    df = spark.createDataFrame(rows, "key long, messages array<struct<role:string,content:string>>")
    prompts = {r.key: r.prompt for r in df.select("key", M.prompt_of(F.col("messages")).alias("prompt")).collect()}
    assert prompts.pop(9) == ""
    assert prompts == {k or 0: "\n".join(line for _, _, line in turns) for k, turns in CONVERSATIONS.items()}


def test_deltas(spark):
    def event(i):
        if i % 5 == 4:
            return '{"messageStop":{}}'
        return json.dumps({"contentBlockDelta": {"delta": {"text": "" if i % 5 == 3 else f"<{i}é>"}}})

    rows = [(s, i, event(i)) for s in range(3) for i in range(700)] + [(9, 0, "broken {")]
    df = spark.createDataFrame(rows, "s long, i long, e string").repartition(4)
    found = X.assemble_deltas(df, "s", "i", "e").orderBy("s", "i").collect()
    assert [(r.s, r.i) for r in found] == [(s, i) for s in range(3) for i in range(700) if i % 5 < 4]
    for s in range(3):
        assert "".join(r.delta for r in found if r.s == s) == "".join(f"<{i}é>" for i in range(700) if i % 5 < 3)


def test_deltas_of_one_response(spark):
    stream = [{"contentBlockDelta": {"delta": {"text": "a"}}}, {"x": 1}, {"contentBlockDelta": {"delta": {"text": "b"}}}]
    df = spark.createDataFrame([(json.dumps(stream),)], "j string")
    events = F.try_variant_get(F.try_parse_json("j"), "$", "array<variant>")
    assert df.select(M.assembled_text(events)).first()[0] == "ab"


BODIES = {
    '{"messages":[{"role":"user","content":"hi"}]}': (200, None, "hi"),
    '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}': (
        200, None, "Conversation history:\nUser: a\n\nCurrent question: b",
    ),
    '{"prompt":"p","input":"i"}': (200, None, "p"),
    '{"prompt":"","input":"i"}': (200, None, "i"),
    '{"messages":[],"prompt":null,"inputText":"t"}': (200, None, "t"),
    '{"prompt":12}': (200, None, "12"),
    '{"prompt":0,"input":[]}': (400, "provide 'messages' or 'prompt'", None),
    "{}": (400, "provide 'messages' or 'prompt'", None),
    "not json": (400, "Body is not valid JSON", None),
    "": (400, "Body is not valid JSON", None),
    "[1]": (500, "Internal Server Error", None),
    '{"messages":"hi"}': (500, "Internal Server Error", None),
    '{"messages":["hi"]}': (500, "Internal Server Error", None),
    '{"messages":{"role":"user"}}': (500, "Internal Server Error", None),
    '{"messages":[{"role":"user"}]}': (500, "Internal Server Error", None),
    '{"messages":[{"content":"a"},{"content":"b"}]}': (500, "Internal Server Error", None),
    '{"messages":[{"content":"b"}]}': (200, None, "b"),
    '{"messages":[{"role":"user","content":null},{"role":"user","content":"b"}]}': (
        200, None, "Conversation history:\nUser: None\n\nCurrent question: b",
    ),
}


def test_a_body_too_large_is_not_called_malformed(spark, monkeypatch):
    monkeypatch.setattr(X, "MAX_BODY_BYTES", 20)
    df = spark.createDataFrame([('{"prompt":"' + "x" * 30 + '"}',), ('{"prompt":"x"}',), ("no",)], "body string")
    assert [r.status for r in X.normalise_requests(df, "body").collect()] == [413, 200, 400]
    routed = X.route_requests(df.withColumn("path", F.lit("/v1/chat/completions")), "path", "body", ROUTES)
    assert [r.status for r in routed.collect()] == [413, 400, 400]


def test_one_parse_for_route_and_session(spark):
    df = spark.createDataFrame([("/v1/chat/completions", GOOD + "}", "r")], "path string, body string, id string")
    routed = X.route_requests(X.parse_bodies(df, "body"), "path", "body", ROUTES)
    summary = X.request_summary(X.session_context(routed, "body", "id"))
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1, plan
    assert summary.count() == 1


def test_ids_tell_keys_apart(spark):
    rows = [(None, "x"), ("x", None), ("a:b", "c"), ("a", "b:c"), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(M.stable_id(F.col("a"), F.col("b")).alias("id"))
    assert len({r.id for r in df.collect()}) == len(rows)
    nobody = spark.createDataFrame([(None, "{}")], "id string, body string")
    assert X.session_context(nobody, "body", "id").first().session_id is None


def test_normalise(spark):
    df = spark.createDataFrame(list(enumerate(BODIES)), "i int, body string")
    rows = (
        X.normalise_requests(df, "body")
        .select("body", "status", "error", M.prompt_of(X.text_messages(F.col("messages"))).alias("prompt"))
        .collect()
    )
    assert {r.body: (r.status, r.error, r.prompt) for r in rows} == BODIES


def test_session(spark):
    bodies = {
        '{"chat_id":"c1","model_item":{"info":{"user_id":"u1"}}}': ("c1", "u1"),
        '{"chat_id":"c1","model_item":{"info":{}}}': ("c1", None),
        '{"chat_id":"c1","model_item":null}': ("c1", None),
    }
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "id string, body string")
    rows = X.session_context(df, "body", "id").collect()
    assert {r.body: (r.session_id, r.user_id) for r in rows} == bodies
    made = spark.createDataFrame([("a", "{}"), ("a", '{"chat_id":""}'), ("b", "{}")], "id string, body string")
    ids = [r.session_id for r in X.session_context(made, "body", "id").collect()]
    assert ids[0] == ids[1] != ids[2]
    assert all(len(i) >= 33 for i in ids)


def test_blocks(spark):
    body = {"messages": [
        {"role": "user", "content": "a"},
        {"role": "assistant", "content": [{"text": "b"}, {"text": "c"}]},
        {"role": "user", "content": ""},
        {"role": "user"},
        {"role": "user", "content": [{"type": "text", "text": "d"}, {"image": {"source": "i"}}]},
    ]}
    bodies = [json.dumps(body), '{"messages":["a"]}', '{"messages":"a"}', "{}"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    found, *unusable = (r.messages for r in X.block_messages(df, "body").collect())
    assert [(m.role, [json.loads(b.toJson()) for b in m.content]) for m in found] == [
        ("user", [{"text": "a"}]), ("assistant", [{"text": "b"}, {"text": "c"}]), ("user", [{"text": ""}]),
        ("user", [{"text": ""}]), ("user", [{"type": "text", "text": "d"}, {"image": {"source": "i"}}]),
    ]
    assert unusable == [None, None, None]


ROUTES = X.Routes(("one", "two"), default="one", default_model="plain")
GOOD = '{"messages":[{"role":"user","content":"x"}]'
ROUTED = [
    ("/v1/chat/completions", GOOD + "}", ("one", 200, None, "plain", False, 1)),
    ("/two/v1/chat/completions", GOOD + "}", ("two", 200, None, "two", False, 1)),
    ("/two/v1/chat/completions", GOOD + ',"model":"m","stream":true}', ("two", 200, None, "m", True, 1)),
    ("/two/v1/chat/completions", GOOD + ',"model":null}', ("two", 200, None, None, False, 1)),
    ("/three/v1/chat/completions", "not json", ("three", 404, "Unknown runtime: three", None, None, None)),
    ("/one/v1/chat/completions", "not json", ("one", 400, "invalid JSON body", None, None, None)),
    ("/one/v1/chat/completions", "{}", ("one", 400, "messages must not be empty", None, None, None)),
    ("/v1/chat/completions", '{"messages":[]}', ("one", 400, "messages must not be empty", None, None, None)),
    ("one", GOOD + "}", (None, 404, "Unknown runtime: one", None, None, None)),
    ("/one/v1/chat", GOOD + "}", (None, 404, "Unknown runtime: /one/v1/chat", None, None, None)),
    ("/one/v1/chat/completions", '{"messages":["x"]}', ("one", 500, "Internal Server Error", None, None, None)),
]


def test_routes_are_named_once():
    with pytest.raises(ValueError, match="twice"):
        X.Routes(("one", "one"), default="one", default_model="plain")


def test_routes(spark):
    rows = [(i, path, body) for i, (path, body, _) in enumerate(ROUTED)]
    df = spark.createDataFrame(rows, "i int, path string, body string")
    found = X.route_requests(df, "path", "body", ROUTES).orderBy("i").collect()
    assert [(r.route, r.status, r.error, r.model, r.stream, r.n_messages) for r in found] == [
        expected for _, _, expected in ROUTED
    ]


def test_completions_and_chunks(spark):
    text = 'say "hi"\nto é \\ all'
    df = spark.createDataFrame([(1, 2, "m", text)], "a long, b long, model string, answer string")
    row = X.completion_rows(df, ["a", "b"], "model", "answer").first()
    assert json.loads(row.completion) == {
        "id": row.completion_id,
        "object": "chat.completion",
        "model": "m",
        "choices": [{"index": 0, "message": {"role": "assistant", "content": text}, "finish_reason": "stop"}],
        "usage": {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0},
    }
    assert row.completion_id.startswith("chatcmpl-")
    assert len(row.completion_id) == len("chatcmpl-") + 12
    chunks = [r.chunk for r in X.chunk_rows(df, ["a", "b"], "model", "answer").orderBy("chunk_no").collect()]
    assert all(c.startswith("data: ") and c.endswith("\n\n") for c in chunks)
    first, last = (json.loads(c.removeprefix("data: ")) for c in chunks[:2])
    assert first["id"] == last["id"] == row.completion_id
    assert first["choices"] == [
        {"index": 0, "delta": {"role": "assistant", "content": text}, "finish_reason": None}
    ]
    assert last["choices"] == [{"index": 0, "delta": {}, "finish_reason": "stop"}]
    assert chunks[2] == "data: [DONE]\n\n"


def test_unwrap(spark):
    payloads = {'{"result":"r"}': ("r", "r"), '{"other":1}': ("", '{"other":1}'), '{"result":null}': (None, None)}
    df = spark.createDataFrame([(p,) for p in payloads], "p string")
    assert {r.p: (r.result, r.answer) for r in X.unwrap_results(df, "p").collect()} == payloads


def test_validity(spark):
    rows = [("user", "x", True), ("system", "", True), ("tool", "x", False), ("user", None, False), (None, "x", False)]
    df = spark.createDataFrame(rows, "role string, content string, expected boolean")
    assert all(r.valid == r.expected for r in X.with_validity(df, "role", "content").collect())
