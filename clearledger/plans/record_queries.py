"""Queries on chat requests, turns and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearledger.functions import jsonvalues as J
from clearledger.functions import messages as M
from clearledger.operators import records as X
from clearledger.plans.registry import query
from clearledger.sources.files import scan_table


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return scan_table(spark, folder, "conversations")


def _gappy_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns with gaps in their numbers and with roles and texts missing."""
    missing = (F.col("conv_id") + F.col("turn")) % 7
    return _turns(spark, folder).select(
        F.when(F.col("conv_id") % 50 > 0, F.col("conv_id")).alias("conv_id"),
        (F.col("conv_id") * 1000 + F.col("turn") * 300).alias("turn"),
        F.when(missing != 5, F.col("role")).alias("role"),
        F.when(missing != 6, F.col("text")).alias("text"),
    )


@query(
    """
    WITH turns AS (
        SELECT CASE WHEN conv_id % 50 > 0 THEN conv_id END AS conv_id, conv_id * 1000 + turn * 300 AS turn,
               CASE WHEN (conv_id + turn) % 7 <> 5 THEN role END AS role,
               CASE WHEN (conv_id + turn) % 7 <> 6 THEN text END AS text
        FROM conversations
    ), placed AS (
        SELECT *, turn = min(turn) OVER c AS is_first, turn = max(turn) OVER c AS is_last,
               coalesce(text, 'None') AS shown, coalesce(role, 'None') AS name
        FROM turns WINDOW c AS (PARTITION BY conv_id)
    )
    SELECT conv_id, turn,
           CASE WHEN is_first AND is_last THEN shown
                WHEN is_last THEN chr(10) || 'Current question: ' || shown
                ELSE CASE WHEN is_first THEN 'Conversation history:' || chr(10) ELSE '' END
                     || upper(name[1]) || lower(name[2:]) || ': ' || shown END AS line,
           text IS NOT NULL AND (role IS NOT NULL OR is_last) AS complete
    FROM placed
    """
)
def conversation_prompt(spark: SparkSession, folder: str) -> DataFrame:
    return X.fold_prompts(_gappy_turns(spark, folder), "conv_id", "turn", "role", "text")


@query(
    """
    WITH turns AS (
        SELECT CASE WHEN conv_id % 50 > 0 THEN conv_id END AS conv_id, conv_id * 1000 + turn * 300 AS turn,
               CASE WHEN (conv_id + turn) % 7 <> 5 THEN role END AS role,
               CASE WHEN (conv_id + turn) % 7 <> 6 THEN text END AS text
        FROM conversations
    ), numbered AS (
        SELECT *, coalesce(text, 'None') AS shown, coalesce(role, 'None') AS name,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n
        FROM turns
    )
    SELECT conv_id, CAST(0 AS BIGINT) AS piece,
           CASE WHEN max(n) = 1 THEN max(shown)
                ELSE 'Conversation history:' || chr(10)
                     || string_agg(upper(name[1]) || lower(name[2:]) || ': ' || shown, chr(10) ORDER BY turn) FILTER (place < n)
                     || chr(10) || chr(10) || 'Current question: ' || max(shown) FILTER (place = n) END AS text,
           bool_and(text IS NOT NULL AND (role IS NOT NULL OR place = n)) AS complete
    FROM numbered GROUP BY conv_id
    """
)
def prompt_text(spark: SparkSession, folder: str) -> DataFrame:
    """One prompt for each conversation."""
    return X.prompt_texts(_gappy_turns(spark, folder), "conv_id", "turn", "role", "text")


def _members(**members: Column) -> Column:
    return F.struct(*[v.alias(n) for n, v in members.items()])


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per turn, in the shapes a caller may send.

    ``shape`` 0 is a full request, 1 to 3 give a prompt under each name, 4 is
    empty, 5 is not JSON, 6 has two messages, 7 has content in blocks of
    several kinds. The messages of 8 are text and those of 9 a list of text;
    10 has a message without content, 11 an earlier one without role.
    """
    key, text, role = F.col("conv_id").cast("string"), F.col("text"), F.col("role")
    shape = (F.col("conv_id") + F.col("turn")) % 12
    user = _members(info=_members(user_id=F.concat(F.lit("user-"), key)))
    message = _members(role=role, content=text)
    brief = _members(role=F.lit("system"), content=F.lit("Be brief."))
    blocks = F.array(
        _members(type=F.lit("text"), text=text, image=F.lit(None).cast("string")),
        _members(type=F.lit("image"), text=F.lit(None).cast("string"), image=F.lit("i.png")),
    )
    no_messages = F.expr("CAST(array() AS ARRAY<STRING>)")
    nothing = F.lit(None).cast("string")
    bodies = (
        F.when(
            F.col("shape") == 0,
            J.to_json_text(
                _members(
                    messages=F.array(message),
                    chat_id=F.concat(F.lit("chat-"), key),
                    model_item=user,
                    stream=F.lit(True),
                )
            ),
        )
        .when(F.col("shape") == 1, J.to_json_text(_members(prompt=text)))
        .when(F.col("shape") == 2, J.to_json_text(_members(prompt=nothing, input=text)))
        .when(F.col("shape") == 3, J.to_json_text(_members(messages=no_messages, inputText=text)))
        .when(F.col("shape") == 4, J.to_json_text(_members(messages=no_messages, prompt=F.lit(""))))
        .when(F.col("shape") == 5, F.concat(F.lit("not json: "), text))
        .when(
            F.col("shape") == 6,
            J.to_json_text(
                _members(messages=F.array(brief, message), model=F.lit("small"), chat_id=F.lit(""))
            ),
        )
        .when(
            F.col("shape") == 7,
            J.to_json_text(
                _members(messages=F.array(_members(role=role, content=blocks)), chat_id=nothing)
            ),
        )
        .when(F.col("shape") == 8, J.to_json_text(_members(messages=text)))
        .when(F.col("shape") == 9, J.to_json_text(_members(messages=F.array(text))))
        .when(F.col("shape") == 10, J.to_json_text(_members(messages=F.array(_members(role=role)))))
        .otherwise(
            F.concat(
                F.lit('{"messages":[{"content":"first"},'), J.to_json_text(message), F.lit("]}")
            )
        )
    )
    request_id = F.concat_ws(":", key, F.col("turn").cast("string"))
    return (
        _turns(spark, folder)
        .withColumn("shape", shape)
        .select("conv_id", "turn", "shape", request_id.alias("request_id"), bodies.alias("body"))
    )


DUCK_SHAPES = """
    SELECT conv_id, turn, role, text, (conv_id + turn) % 12 AS shape,
           conv_id || ':' || turn AS request_id
    FROM conversations
"""
# VARIANT objects list their members by name.
DUCK_BLOCKS = """
    '[{"image":null,"text":' || to_json(text) || ',"type":"text"},{"image":"i.png","text":null,"type":"image"}]'
"""


@query(
    f"""
    SELECT conv_id, turn,
           CASE WHEN shape IN (4, 5) THEN 400 WHEN shape > 7 THEN 500 ELSE 200 END AS status,
           CASE WHEN shape = 5 THEN 'Body is not valid JSON' WHEN shape > 7 THEN 'Internal Server Error'
                WHEN shape = 4 THEN 'provide ''messages'' or ''prompt''' END AS error,
           CASE WHEN shape = 6 THEN 2 WHEN shape NOT IN (4, 5) AND shape < 8 THEN 1 END AS n_messages,
           CASE WHEN shape IN (0, 7) THEN role WHEN shape IN (1, 2, 3) THEN 'user'
                WHEN shape = 6 THEN 'system' END AS first_role,
           CASE WHEN shape IN (4, 5) OR shape > 7 THEN NULL
                WHEN shape = 6 THEN 'Conversation history:' || chr(10) || 'System: Be brief.'
                    || chr(10) || chr(10) || 'Current question: ' || text
                WHEN shape = 7 THEN {DUCK_BLOCKS} ELSE text END AS prompt
    FROM ({DUCK_SHAPES})
    """
)
def request_normalise(spark: SparkSession, folder: str) -> DataFrame:
    requests = X.normalise_requests(_requests(spark, folder), "body")
    texts = X.text_messages(F.col("messages"))
    return requests.select(
        "conv_id",
        "turn",
        "status",
        "error",
        F.when(F.col("messages").isNotNull(), F.size("messages")).alias("n_messages"),
        F.col("messages")[0]["role"].alias("first_role"),
        M.prompt_of(texts).alias("prompt"),
    )


@query(
    f"""
    SELECT conv_id, turn,
           CASE WHEN shape = 0 THEN 'chat-' || conv_id
                ELSE sha256('{{"k0":"' || request_id || '"}}') END AS session_id,
           CASE WHEN shape = 0 THEN 'user-' || conv_id END AS user_id
    FROM ({DUCK_SHAPES})
    """
)
def session_context(spark: SparkSession, folder: str) -> DataFrame:
    found = X.session_context(_requests(spark, folder), "body", "request_id")
    return found.select("conv_id", "turn", "session_id", "user_id")


@query(
    f"""
    WITH blocks AS (
        SELECT conv_id, turn, 0 AS message_no, role, 0 AS block_no, text AS block,
               shape = 7 AS typed, NULL AS image FROM ({DUCK_SHAPES}) WHERE shape IN (0, 7)
        UNION ALL
        SELECT conv_id, turn, 0, role, 1, NULL, true, 'i.png' FROM ({DUCK_SHAPES}) WHERE shape = 7
        UNION ALL
        SELECT conv_id, turn, 0, 'system', 0, 'Be brief.', false, NULL FROM ({DUCK_SHAPES}) WHERE shape = 6
        UNION ALL
        SELECT conv_id, turn, 1, role, 0, text, false, NULL FROM ({DUCK_SHAPES}) WHERE shape IN (6, 11)
        UNION ALL
        SELECT conv_id, turn, 0, role, 0, '', false, NULL FROM ({DUCK_SHAPES}) WHERE shape = 10
        UNION ALL
        SELECT conv_id, turn, 0, NULL, 0, 'first', false, NULL FROM ({DUCK_SHAPES}) WHERE shape = 11
    )
    SELECT conv_id, turn, message_no, role, block_no, block,
           CASE WHEN typed THEN '{{"image":' || coalesce('"' || image || '"', 'null') || ',"text":'
                || coalesce(CAST(to_json(block) AS VARCHAR), 'null') || ',"type":"'
                || CASE WHEN image IS NULL THEN 'text' ELSE 'image' END || '"}}'
                ELSE '{{"text":' || CAST(to_json(block) AS VARCHAR) || '}}' END AS block_json
    FROM blocks
    """
)
def content_blocks(spark: SparkSession, folder: str) -> DataFrame:
    requests = X.block_messages(_requests(spark, folder), "body")
    listed = requests.select("conv_id", "turn", F.posexplode("messages").alias("message_no", "m"))
    return listed.select(
        "conv_id",
        "turn",
        "message_no",
        F.col("m.role").alias("role"),
        F.posexplode("m.content").alias("block_no", "b"),
    ).select("*", M.block_text(F.col("b")).alias("block"), J.text_of(F.col("b")).alias("block_json")).drop("b")


def _stream_events(spark: SparkSession, folder: str) -> DataFrame:
    text = J.to_json_text(
        _members(contentBlockDelta=_members(delta=_members(text=F.col("text"))))
    )
    start = J.to_json_text(_members(messageStart=_members(role=F.col("role"))))
    event = (
        F.when(F.col("turn") % 4 == 3, start)
        .when(F.col("role") == "system", F.lit('{"contentBlockDelta":{"delta":{}}}'))
        .otherwise(text)
    )
    return _turns(spark, folder).select("conv_id", "turn", event.alias("event"))


@query(
    """
    SELECT conv_id, turn, text AS delta FROM conversations WHERE turn % 4 <> 3 AND role <> 'system'
    """
)
def delta_assembly(spark: SparkSession, folder: str) -> DataFrame:
    return X.assemble_deltas(_stream_events(spark, folder), "conv_id", "turn", "event")


@query(
    """
    SELECT conv_id, CAST(0 AS BIGINT) AS piece,
           coalesce(string_agg(text, '' ORDER BY turn) FILTER (turn % 4 <> 3 AND role <> 'system'), '') AS text
    FROM conversations GROUP BY conv_id
    """
)
def session_text(spark: SparkSession, folder: str) -> DataFrame:
    """One response for each session."""
    return X.session_texts(_stream_events(spark, folder), "conv_id", "turn", "event")


@query("SELECT conv_id, turn, text AS response FROM conversations")
def response_text(spark: SparkSession, folder: str) -> DataFrame:
    """Responses whose events are one list in the row: a start, two deltas, a stop."""
    half = F.floor(F.length("text") / 2).cast("int")

    def delta(part: Column) -> Column:
        return J.to_json_text(_members(contentBlockDelta=_members(delta=_members(text=part))))

    events = F.concat(
        F.lit('[{"messageStart":{}},'), delta(F.substring(F.col("text"), F.lit(1), half)), F.lit(","),
        delta(F.substring(F.col("text"), half + 1, F.length("text"))), F.lit(',{"messageStop":null}]'),
    )
    listed = F.try_variant_get(F.try_parse_json(events), "$", "array<variant>")
    return _turns(spark, folder).select("conv_id", "turn", M.assembled_text(listed).alias("response"))


MODEL = "assistant-1"


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    answers = _turns(spark, folder).where(F.col("role") == "assistant")
    return answers.withColumn("model", F.lit(MODEL))


DUCK_ANSWERS = """
    SELECT conv_id, turn, text, 'chatcmpl-' || substr(sha256('{"k0":"' || conv_id || '","k1":"' || turn || '"}'), 1, 12) AS id
    FROM conversations WHERE role = 'assistant'
"""


@query(
    f"""
    SELECT conv_id, turn, id AS completion_id,
           CAST(json_object('id', id, 'object', 'chat.completion', 'model', '{MODEL}',
               'choices', json_array(json_object('index', 0,
                   'message', json_object('role', 'assistant', 'content', text),
                   'finish_reason', 'stop')),
               'usage', json_object('prompt_tokens', 0, 'completion_tokens', 0, 'total_tokens', 0)
           ) AS VARCHAR) AS completion
    FROM ({DUCK_ANSWERS})
    """
)
def completion_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = X.completion_rows(_answers(spark, folder), ["conv_id", "turn"], "model", "text")
    return rows.select("conv_id", "turn", "completion_id", "completion")


def _duck_chunk(delta: str, reason: str) -> str:
    return f"""
        'data: ' || json_object('id', id, 'object', 'chat.completion.chunk', 'model', '{MODEL}',
            'choices', json_array(json_object('index', 0, 'delta', {delta},
                'finish_reason', {reason}))) || chr(10) || chr(10)
    """


@query(
    f"""
    SELECT conv_id, turn, 0 AS chunk_no,
           {_duck_chunk("json_object('role', 'assistant', 'content', text)", "NULL")} AS chunk
    FROM ({DUCK_ANSWERS})
    UNION ALL
    SELECT conv_id, turn, 1, {_duck_chunk("json_object()", "'stop'")} FROM ({DUCK_ANSWERS})
    UNION ALL
    SELECT conv_id, turn, 2, 'data: [DONE]' || chr(10) || chr(10) FROM ({DUCK_ANSWERS})
    """
)
def chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    return X.chunk_rows(_answers(spark, folder), ["conv_id", "turn"], "model", "text")


ROUTES = X.Routes(names=("main", "tools"), default="main", default_model="assistant")


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with a path: bare, to either known route, to an unknown one, or of no route's shape."""
    place = F.col("conv_id") % 5
    path = (
        F.when(place == 1, "/main/v1/chat/completions")
        .when(place == 2, "/tools/v1/chat/completions")
        .when(place == 3, "/other/v1/chat/completions")
        .when(place == 4, "main")
        .otherwise("/v1/chat/completions")
    )
    requests = X.parse_bodies(_requests(spark, folder).withColumn("path", path), "body")
    return X.route_requests(requests, "path", "body", ROUTES)


DUCK_ROUTED = f"""
    SELECT *,
           CASE WHEN status = 200 THEN CASE WHEN shape = 6 THEN 'small' WHEN place = 0 THEN 'assistant'
                ELSE route END END AS model,
           CASE WHEN status = 200 THEN shape = 0 END AS stream,
           CASE WHEN status = 200 THEN CASE WHEN shape IN (6, 11) THEN 2 ELSE 1 END END AS n_messages
    FROM (
        SELECT *, conv_id % 5 AS place,
               CASE conv_id % 5 WHEN 2 THEN 'tools' WHEN 3 THEN 'other' WHEN 4 THEN NULL ELSE 'main' END AS route,
               CASE WHEN conv_id % 5 > 2 THEN 404 WHEN shape IN (1, 2, 3, 4, 5) THEN 400
                    WHEN shape IN (8, 9) THEN 500 ELSE 200 END AS status
        FROM ({DUCK_SHAPES})
    )
"""


@query(
    f"""
    SELECT conv_id, turn, route, status, model, stream, n_messages,
           CASE WHEN status = 404 THEN 'Unknown runtime: ' || coalesce(route, 'main')
                WHEN status = 500 THEN 'Internal Server Error'
                WHEN shape = 5 THEN 'invalid JSON body'
                WHEN status = 400 THEN 'messages must not be empty' END AS error
    FROM ({DUCK_ROUTED})
    """
)
def route_status(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(spark, folder).drop("shape", "request_id", "body", "path", "document")


def _logged(spark: SparkSession, folder: str) -> DataFrame:
    return X.session_context(_routed(spark, folder), "body", "request_id")


@query(
    f"""
    SELECT conv_id, turn, route, model, n_messages, stream,
           CASE WHEN shape = 0 THEN 'chat-' || conv_id
                ELSE sha256('{{"k0":"' || request_id || '"}}') END AS session_id,
           CASE WHEN shape = 0 THEN 'user-' || conv_id END AS user_id
    FROM ({DUCK_ROUTED}) WHERE status = 200
    """
)
def request_log(spark: SparkSession, folder: str) -> DataFrame:
    return X.request_log(_logged(spark, folder), "conv_id", "turn")


@query(
    f"""
    SELECT route, model, count(*) AS n_requests, CAST(sum(n_messages) AS BIGINT) AS n_turns,
           count(*) FILTER (WHERE stream) AS n_streamed,
           count(*) FILTER (WHERE shape = 0) AS n_with_user
    FROM ({DUCK_ROUTED}) WHERE status = 200 GROUP BY route, model
    """
)
def request_summary(spark: SparkSession, folder: str) -> DataFrame:
    return X.request_summary(_logged(spark, folder))


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id") % 3
    payload = (
        F.when(key == 0, F.to_json(_members(result=F.col("event_type"))))
        .when(key == 1, F.lit('{"result":null}'))
        .otherwise(F.col("props"))
    )
    return scan_table(spark, folder, "events").select("event_id", payload.alias("payload"))


@query(
    """
    SELECT event_id,
           CASE event_id % 3 WHEN 0 THEN event_type WHEN 2 THEN '' END AS result,
           CASE event_id % 3 WHEN 0 THEN event_type WHEN 2 THEN props END AS answer
    FROM events
    """
)
def result_unwrap(spark: SparkSession, folder: str) -> DataFrame:
    return X.unwrap_results(_payloads(spark, folder), "payload").drop("payload")


@query(
    """
    SELECT conv_id, turn, role, text IS NOT NULL AND role IN ('user', 'assistant', 'system') AS valid
    FROM (
        SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'tool' ELSE role END AS role,
               CASE WHEN conv_id % 7 > 0 THEN text END AS text
        FROM conversations
    )
    """
)
def valid_messages(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder).select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 5 == 4, "tool").otherwise(F.col("role")).alias("role"),
        F.when(F.col("conv_id") % 7 > 0, F.col("text")).alias("text"),
    )
    return X.with_validity(turns, "role", "text").drop("text")
