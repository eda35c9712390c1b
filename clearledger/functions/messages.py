"""Chat messages held in one row: no grouping, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearledger.functions import jsonvalues as J

# Prompt wording, roles, completion and chunk record texts.
HISTORY_HEADING = "Conversation history:"
QUESTION_HEADING = "Current question: "
ROLES = ("user", "assistant", "system")
COMPLETION_ID_PREFIX = "chatcmpl-"
COMPLETION_OBJECT = "chat.completion"
CHUNK_OBJECT = "chat.completion.chunk"
FINISH_REASON = "stop"
CHUNK_PREFIX = "data: "
CHUNK_END = "\n\n"
STREAM_END = "data: [DONE]\n\n"
NO_VALUE = "None"


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def shown(c: Column) -> Column:
    """A text as a prompt shows it: a NULL has its place there, it is never left out."""
    return F.coalesce(c, F.lit(NO_VALUE))


def history_line(role: Column, content: Column) -> Column:
    return F.concat(capitalized(shown(role)), F.lit(": "), shown(content))


def question_lines(content: Column) -> Column:
    return F.concat(F.lit("\n" + QUESTION_HEADING), shown(content))


def prompt_of(messages: Column) -> Column:
    """Fold an ``ARRAY<STRUCT<role, content>>`` into one prompt.

    The last message is the question whatever its role; a single message is
    the prompt itself, and no message gives ``''``.
    """
    last = F.try_element_at(messages, F.lit(-1))["content"]
    history = F.transform(
        F.slice(messages, F.lit(1), F.size(messages) - 1),
        lambda m: history_line(m["role"], m["content"]),
    )
    folded = F.concat_ws(
        "\n", F.lit(HISTORY_HEADING), F.array_join(history, "\n"), question_lines(last)
    )
    return (
        F.when(F.size(messages) == 0, F.lit(""))
        .when(F.size(messages) == 1, last)
        .when(F.size(messages) > 1, folded)
    )


def content_blocks(content: Column) -> Column:
    """VARIANT content as ``ARRAY<VARIANT>`` of blocks.

    A list stays as it is, block by block with all members. Text becomes one
    block, as does absent content, which counts as empty text. Any other value
    is a block itself.
    """
    text = F.coalesce(J.text_of(content), F.lit(""))
    wrapped = F.array(F.to_variant_object(F.struct(text.alias("text"))))
    blocks = F.try_variant_get(content, "$", "array<variant>")
    return F.when(content.isNull() | J.is_text(content), wrapped).otherwise(F.coalesce(blocks, F.array(content)))


def block_text(block: Column) -> Column:
    return F.try_variant_get(block, "$.text", "string")


def delta_text(event: Column) -> Column:
    """Text of one VARIANT stream event; NULL for events without any."""
    return F.try_variant_get(event, "$.contentBlockDelta.delta.text", "string")


def assembled_text(events: Column) -> Column:
    """Text deltas of one ``ARRAY<VARIANT>`` response in arrival order."""
    return F.array_join(F.transform(events, delta_text), "")


def stable_id(*key: Column, digits: int = 64) -> Column:
    """Hex digest of a record key, in place of a random identifier.

    Taken of the key as a JSON object with NULL members, so that keys differ
    wherever a part does. Twelve digits collide from some ten million records
    on: keep the key columns beside a short identifier.
    """
    parts = F.struct(*[k.cast("string").alias(f"k{i}") for i, k in enumerate(key)])
    return F.substring(F.sha2(J.to_json_text(parts), 256), 1, digits)


def completion_id(*key: Column) -> Column:
    return F.concat(F.lit(COMPLETION_ID_PREFIX), stable_id(*key, digits=12))


def completion(identifier: Column, model: Column, text: Column) -> Column:
    message = F.struct(F.lit("assistant").alias("role"), text.alias("content"))
    choice = F.struct(
        F.lit(0).alias("index"),
        message.alias("message"),
        F.lit(FINISH_REASON).alias("finish_reason"),
    )
    usage = F.struct(
        *[F.lit(0).alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")]
    )
    return F.struct(
        identifier.alias("id"),
        F.lit(COMPLETION_OBJECT).alias("object"),
        model.alias("model"),
        F.array(choice).alias("choices"),
        usage.alias("usage"),
    )


def _chunk(identifier: Column, model: Column, delta: Column, reason: Column) -> Column:
    choice = F.struct(
        F.lit(0).alias("index"), delta.alias("delta"), reason.alias("finish_reason")
    )
    body = F.struct(
        identifier.alias("id"),
        F.lit(CHUNK_OBJECT).alias("object"),
        model.alias("model"),
        F.array(choice).alias("choices"),
    )
    return F.concat(F.lit(CHUNK_PREFIX), J.to_json_text(body), F.lit(CHUNK_END))


def chunks(identifier: Column, model: Column, text: Column) -> Column:
    """The stream records of one finished text: content, stop, end mark."""
    content = F.struct(F.lit("assistant").alias("role"), text.alias("content"))
    nothing = F.expr("CAST(map() AS MAP<STRING, STRING>)")
    return F.array(
        _chunk(identifier, model, content, F.lit(None).cast("string")),
        _chunk(identifier, model, nothing, F.lit(FINISH_REASON)),
        F.lit(STREAM_END),
    )
