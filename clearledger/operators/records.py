"""Chat requests, turns and responses as tables.

Request bodies are whole in their row, so most of these are projections. Turns
and stream events come one per row; what is joined from them is cut at a stated length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearledger.functions import jsonvalues as J
from clearledger.functions import messages as M
from clearledger.functions import text
from clearledger.operators import scans
from clearledger.sources.small import small_table

# Request members, route shape, status codes and messages.
PROMPT_MEMBERS = ("prompt", "input", "inputText")
ROUTE_PATTERN = r"^(?:/([^/]+))?/v1/chat/completions$"
STATUS_OK = 200
STATUS_BAD_REQUEST = 400
STATUS_NOT_FOUND = 404
STATUS_TOO_LARGE = 413
STATUS_FAILED = 500
NOT_JSON = "Body is not valid JSON"
INVALID_JSON = "invalid JSON body"
NO_INPUT = "provide 'messages' or 'prompt'"
NO_MESSAGES = "messages must not be empty"
UNKNOWN_ROUTE = "Unknown runtime: "
NOT_OBJECT = "Internal Server Error"
TOO_LARGE = "Body is too large"

MESSAGE_LIST = "array<struct<role:string,content:variant>>"
# Parsed bodies are bounded at 128 MiB and take up to four times their text.
MAX_BODY_BYTES = 32 * 1024 * 1024


def parse_bodies(df: DataFrame, body: str) -> DataFrame:
    """Adds ``document``. Operators that find it there don't parse again and leave it in place."""
    readable = F.when(F.octet_length(F.col(body)) <= MAX_BODY_BYTES, F.col(body))
    return df.withColumn("document", F.try_parse_json(readable))


def _parsed(df: DataFrame, body: str, *members: str) -> DataFrame:
    """Parse the body once and take members out once, as VARIANT columns.

    Adds ``document`` and ``member_<name>``; ``_dropped`` removes them. They
    are steps of their own so that what follows can refer to them repeatedly
    without repeating the work.
    """
    parsed = df if "document" in df.columns else parse_bodies(df, body)
    return parsed.withColumns({f"member_{m}": J.field(F.col("document"), m) for m in members})


def _dropped(df: DataFrame, given: DataFrame, *members: str) -> DataFrame:
    own = () if "document" in given.columns else ("document",)
    return df.drop(*own, *[f"member_{m}" for m in members])


def _objects(listed: Column) -> Column:
    """Whether a list of VARIANTs is there and holds objects only."""
    one = lambda m: F.coalesce(F.schema_of_variant(m).startswith("OBJECT<"), F.lit(False))
    return F.coalesce(F.forall(listed, one), F.lit(False))


def _too_large(body: str) -> Column:
    return F.octet_length(F.col(body)) > MAX_BODY_BYTES


def normalise_requests(df: DataFrame, body: str) -> DataFrame:
    """Adds ``status``, ``error`` and ``messages``.

    ``messages`` is the body's list or, if that is empty, the first non-empty
    of ``prompt``, ``input`` and ``inputText`` as one user message. A list whose
    entries are no objects, lack a content, or lack a role before the last one
    cannot be used, which is a failure; so is a value that is no list.
    """
    members = ("messages", *PROMPT_MEMBERS)
    given = F.col("member_messages")
    prompt = F.coalesce(
        *[
            F.when(J.is_truthy(F.col(f"member_{m}")), F.col(f"member_{m}"))
            for m in PROMPT_MEMBERS
        ]
    )
    from_prompt = F.array(
        F.struct(
            F.lit("user").alias("role"),
            J.text_of(F.col("prompt")).cast("variant").alias("content"),
        )
    )
    listed = F.col("listed")
    usable = listed.isNotNull() & ~(
        F.exists(listed, lambda m: m.isNull() | m["content"].isNull())
        | F.exists(F.slice(listed, F.lit(1), F.greatest(F.size(listed) - 1, F.lit(0))), lambda m: m["role"].isNull())
    )
    status = (
        F.when(_too_large(body), STATUS_TOO_LARGE)
        .when(F.col("document").isNull(), STATUS_BAD_REQUEST)
        .when(~J.begins_object(F.col(body)), STATUS_FAILED)
        .when(F.col("has_messages") & ~F.coalesce(usable, F.lit(False)), STATUS_FAILED)
        .when(~F.col("has_messages") & F.col("prompt").isNull(), STATUS_BAD_REQUEST)
        .otherwise(STATUS_OK)
    )
    error = (
        F.when(F.col("status") == STATUS_TOO_LARGE, TOO_LARGE)
        .when(F.col("document").isNull(), NOT_JSON)
        .when(F.col("status") == STATUS_FAILED, NOT_OBJECT)
        .when(F.col("status") == STATUS_BAD_REQUEST, NO_INPUT)
    )
    messages = F.when(
        F.col("status") == STATUS_OK,
        F.when(F.col("has_messages"), listed).otherwise(from_prompt),
    )
    normalised = (
        _parsed(df, body, *members)
        .withColumns(
            {
                "has_messages": J.is_truthy(given),
                "prompt": prompt,
                "listed": F.try_variant_get(given, "$", MESSAGE_LIST),
            }
        )
        .withColumn("status", status)
        .withColumn("error", error)
        .withColumn("messages", messages)
    )
    return _dropped(normalised, df, *members).drop("has_messages", "prompt", "listed")


def text_messages(messages: Column) -> Column:
    """Messages with their content as text, as ``prompt_of`` takes them."""
    return F.transform(
        messages,
        lambda m: F.struct(m["role"].alias("role"), J.text_of(m["content"]).alias("content")),
    )


def session_context(df: DataFrame, body: str, request_id: str) -> DataFrame:
    """Adds ``session_id`` (a stable digest where none is given) and ``user_id``.

    Without a chat nor a request id there is nothing to tell sessions apart by: NULL.
    """
    chat = F.col("member_chat_id")
    generated = F.when(F.col(request_id).isNotNull(), M.stable_id(F.col(request_id)))
    user = F.try_variant_get(F.col("document"), "$.model_item.info.user_id", "string")
    found = _parsed(df, body, "chat_id").withColumns(
        {
            "session_id": F.when(J.is_truthy(chat), J.text_of(chat)).otherwise(generated),
            "user_id": user,
        }
    )
    return _dropped(found, df, "chat_id")


def block_messages(df: DataFrame, body: str) -> DataFrame:
    """Adds ``messages`` with every content as a list of blocks, VARIANTs with all their members.

    NULL where the body's messages are no list of objects.
    """
    usable = _objects(F.try_variant_get(F.col("document"), "$.messages", "array<variant>"))
    listed = F.try_variant_get(F.col("document"), "$.messages", MESSAGE_LIST)
    normalised = F.transform(
        listed,
        lambda m: F.struct(
            m["role"].alias("role"),
            M.content_blocks(m["content"]).alias("content"),
        ),
    )
    return _dropped(_parsed(df, body).withColumn("messages", F.when(usable, normalised)), df)


@dataclass(frozen=True)
class Routes:
    """Known routes, the one a bare path means, and that one's model name."""

    names: Sequence[str]
    default: str
    default_model: str

    def __post_init__(self) -> None:
        if len(set(self.names)) != len(self.names):
            raise ValueError("A route is named twice")

    def table(self, spark: SparkSession) -> DataFrame:
        return small_table(spark, {"known_route": "string"}, [(n,) for n in self.names])


def route_requests(df: DataFrame, path: str, body: str, routes: Routes) -> DataFrame:
    """Adds ``route``, ``status``, ``error``, ``model``, ``stream`` and ``n_messages``.

    An unknown route is reported before a bad body, and that before missing
    messages. A bare path means the default route and model; a path of another
    shape has no route. Messages that are no list of objects are a failure.
    """
    document = F.col("document")
    named = text.empty_to_null(F.regexp_extract(F.col(path), ROUTE_PATTERN, 1))
    is_bare = F.col(path).rlike(ROUTE_PATTERN) & named.isNull()
    route = F.when(is_bare, routes.default).otherwise(named)
    members = ("messages", "model", "stream")
    given, model, stream = (F.col(f"member_{m}") for m in members)
    own_name = F.when(is_bare, routes.default_model).otherwise(F.col("route"))
    listed = F.try_variant_get(given, "$", "array<variant>")
    usable = _objects(listed)
    status = (
        F.when(F.col("known_route").isNull(), STATUS_NOT_FOUND)
        .when(_too_large(body), STATUS_TOO_LARGE)
        .when(document.isNull(), STATUS_BAD_REQUEST)
        .when(~J.begins_object(F.col(body)), STATUS_FAILED)
        .when(~J.is_truthy(given), STATUS_BAD_REQUEST)
        .when(~usable, STATUS_FAILED)
        .otherwise(STATUS_OK)
    )
    error = (
        F.when(F.col("status") == STATUS_NOT_FOUND, F.concat(F.lit(UNKNOWN_ROUTE), F.coalesce("route", F.col(path))))
        .when(F.col("status") == STATUS_TOO_LARGE, TOO_LARGE)
        .when(document.isNull(), INVALID_JSON)
        .when(F.col("status") == STATUS_FAILED, NOT_OBJECT)
        .when(F.col("status") == STATUS_BAD_REQUEST, NO_MESSAGES)
    )
    accepted = F.col("status") == STATUS_OK
    known = routes.table(df.sparkSession)
    routed = (
        _parsed(df, body, *members)
        .withColumn("route", route)
        .join(known, F.col("route") == F.col("known_route"), "left")
        .withColumn("status", status)
        .withColumn("error", error)
        .withColumns(
            {
                "model": F.when(accepted, F.when(model.isNull(), own_name).otherwise(J.text_of(model))),
                "stream": F.when(accepted, J.is_truthy(stream)),
                "n_messages": F.when(accepted, F.size(listed)),
            }
        )
    )
    return _dropped(routed, df, *members).drop("known_route")


def request_log(routed: DataFrame, *keys: str) -> DataFrame:
    """One row per accepted request: where it went, its size, and who sent it."""
    logged = ("route", "model", "n_messages", "stream", "session_id", "user_id")
    return routed.where(F.col("status") == STATUS_OK).select(*keys, *logged)


def request_summary(routed: DataFrame) -> DataFrame:
    """Accepted requests per route and model."""
    return (
        routed.where(F.col("status") == STATUS_OK)
        .groupBy("route", "model")
        .agg(
            F.count(F.lit(1)).alias("n_requests"),
            F.sum(F.col("n_messages").cast("bigint")).alias("n_turns"),
            F.count_if("stream").alias("n_streamed"),
            F.count_if(F.col("user_id").isNotNull()).alias("n_with_user"),
        )
    )


def unwrap_results(df: DataFrame, payload: str) -> DataFrame:
    """Adds ``result`` (empty if absent) and ``answer`` (the payload if absent)."""
    result = J.text_of(F.col("member_result"))
    present = F.col("member_result").isNotNull()
    unwrapped = _parsed(df, payload, "result").withColumns(
        {
            "result": F.when(present, result).otherwise(F.lit("")),
            "answer": F.when(present, result).otherwise(F.col(payload)),
        }
    )
    return _dropped(unwrapped, df, "result")


def with_validity(df: DataFrame, role: str, content: str) -> DataFrame:
    """Adds ``valid``: a known role and a text content."""
    known = F.col(role).isin(*M.ROLES) & F.col(content).isNotNull()
    return df.withColumn("valid", F.coalesce(known, F.lit(False)))


def completion_rows(df: DataFrame, key: Sequence[str], model: str, answer: str) -> DataFrame:
    """Adds ``completion_id`` and the ``completion`` record as JSON."""
    identifier = M.completion_id(*[F.col(k) for k in key])
    record = M.completion(F.col("completion_id"), F.col(model), F.col(answer))
    return df.withColumn("completion_id", identifier).withColumn(
        "completion", J.to_json_text(record)
    )


def chunk_rows(df: DataFrame, key: Sequence[str], model: str, answer: str) -> DataFrame:
    """Three stream records per row, numbered from 0."""
    identifier = M.completion_id(*[F.col(k) for k in key])
    records = M.chunks(identifier, F.col(model), F.col(answer))
    return df.select(*key, F.posexplode(records).alias("chunk_no", "chunk"))


def assemble_deltas(events: DataFrame, session: str, order: str, event: str) -> DataFrame:
    """The text deltas of each session, one row each, numbered as they came; other events are skipped.

    Read in the order of ``order`` they make up the response, whatever its length.
    A response whose events are whole in a row has ``M.assembled_text``.
    """
    delta = M.delta_text(F.try_parse_json(F.col(event)))
    return events.select(session, order, delta.alias("delta")).where(F.col("delta").isNotNull())


def fold_prompts(turns: DataFrame, key: str, order: str, role: str, content: str) -> DataFrame:
    """Each turn's lines of its conversation's prompt: ``key, order, line, complete``.

    Joined by line breaks in order, the lines of a key are its prompt. One row
    per turn, at any length. ``order`` must tell the turns of a key apart; a NULL
    key is a conversation too. A NULL role or content is shown as such and the row
    is not ``complete``; the question's role doesn't matter.

    Where a conversation begins and ends comes from one small aggregate, joined on
    key *and* order, so the turns of a long one are as spread as any.
    """
    ends = turns.groupBy(F.col(key).alias("end_key")).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    first = F.struct(F.col("first").alias("end_order"), F.lit(True).alias("is_first"), (F.col("first") == F.col("last")).alias("is_last"))
    last = F.struct(F.col("last").alias("end_order"), F.lit(False).alias("is_first"), F.lit(True).alias("is_last"))
    places = F.when(F.col("first") == F.col("last"), F.array(first)).otherwise(F.array(first, last))
    ends = ends.where(F.col("first").isNotNull()).select("end_key", F.inline(places))

    same = F.col(key).eqNullSafe(F.col("end_key")) & (F.col(order) == F.col("end_order"))
    joined = turns.join(ends, same, "left")
    line = M.history_line(F.col(role), F.col(content))
    shown = (
        F.when(F.col("is_first") & F.col("is_last"), M.shown(F.col(content)))
        .when(F.col("is_first"), F.concat_ws("\n", F.lit(M.HISTORY_HEADING), line))
        .when(F.col("is_last"), M.question_lines(F.col(content)))
        .otherwise(line)
    )
    complete = F.col(content).isNotNull() & (F.col(role).isNotNull() | F.coalesce("is_last", F.lit(False)))
    return joined.select(key, order, shown.alias("line"), complete.alias("complete"))


def session_texts(
    events: DataFrame, session: str, order: str, event: str, limit: int = scans.TEXT_LIMIT
) -> DataFrame:
    """``session, piece, text``: the response of each session, its text deltas joined as they came.

    A row holds at most ``limit`` code points, and a longer response goes on in the next pieces. A
    session without any text has an empty response; a NULL session is one too.
    """
    delta = M.delta_text(F.try_parse_json(F.col(event)))
    return scans.ordered_texts(events.select(session, order, delta.alias("delta")), [session], [order], "delta", limit=limit)


def prompt_texts(
    turns: DataFrame, key: str, order: str, role: str, content: str, limit: int = scans.TEXT_LIMIT
) -> DataFrame:
    """``key, piece, text, complete``: the prompt of each conversation, the lines of ``fold_prompts`` joined.

    A row holds at most ``limit`` code points, and a longer prompt goes on in the next pieces. ``complete`` is
    that of all its lines.
    """
    lines = fold_prompts(turns, key, order, role, content)
    texts = scans.ordered_texts(lines, [key], [order], "line", separator="\n", limit=limit)
    whole = lines.groupBy(F.col(key).alias("whole_key")).agg(F.bool_and("complete").alias("complete"))
    return texts.join(whole, F.col(key).eqNullSafe(F.col("whole_key"))).select(key, "piece", "text", "complete")
