"""Conversations as training windows: turns in a template, with the spans that carry loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearledger.llm.common import columns_of, running_sums, stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, TARGET = "system", "assistant"
# Tokens of a window, and of the history that a window repeats from the one before.
BUDGET, HISTORY = 1024, 128
# Tokens that a turn's marks take.
MARKS = 4


def token_estimate(text: Column) -> Column:
    """A token for every four bytes begun; pass another column where a tokenizer's counts are known."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def escaped(text: Column) -> Column:
    """Free of control strings: every ``<|`` gets a backslash inside, one more if it has some."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _begins(turns: DataFrame) -> DataFrame:
    """Add ``begin``, the tokens of all earlier turns of the conversation, at any length of it.

    The rows are dealt by ranges of (conversation, turn). Sums per range give each range its
    offset, and within a range a window adds up its rows, so that a
    conversation with a third of all rows is as spread as any.
    """
    ranged = stored(
        turns.repartitionByRange("conv", "turn").withColumn("part", F.spark_partition_id()), "chat-turns"
    )
    sums = ranged.groupBy("conv", "part").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("conv").alias("c"), F.col("part").alias("p"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"),
    )
    within = Window.partitionBy("conv", "part").orderBy("turn", "role", "text")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    same = ranged["conv"].eqNullSafe(F.col("c")) & (ranged["part"] == F.col("p"))
    return (
        ranged.join(offsets, same)
        .withColumn("begin", F.col("offset") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .drop("c", "p", "offset", "part")
    )


def chat_windows(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """Windows ``conv_id, window, text, n_repeated, n_turns, loss_spans`` of all conversations.

    Prefix sums of the turns' tokens place each turn: with the system turn's tokens and the history taken
    off the budget, a window owns the turns that begin in one stride, half of what is
    left. So a window of turns no longer than a stride fits the budget, whatever is
    before it; a longer turn gets a window of its own and is never cut. A window after the first
    starts with the system turn, if the conversation begins with one, and with the last turns
    of the window before, as many as fit ``history``. These ``n_repeated`` turns carry no loss;
    ``loss_spans`` (code points) cover the texts of the window's own assistant turns.

    Turns are in the order of their number, then role and text; repeated rows are
    turns of their own. NULL texts and roles are empty, NULL turns come first, rows with a NULL
    conversation form one conversation. An empty table gives no windows. Columns not named are not read.
    """
    rows = columns_of(turns, conv=conv, turn=turn, role=role, text=text)
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")})
    rows = rows.withColumn("tokens", token_estimate(F.col("text")) + MARKS)
    placed = stored(_begins(rows), "chat-begins")
    first = (F.col("begin") == 0) & (F.col("role") == SYSTEM)
    heads = placed.where(first).select(
        F.col("conv").alias("c"), F.col("tokens").alias("head_tokens"), F.col("text").alias("head_text")
    )
    placed = placed.join(heads.drop("head_text"), placed["conv"].eqNullSafe(heads["c"]), "left").drop("c")
    room = F.coalesce("head_tokens", F.lit(0))
    placed = (
        placed.withColumn("stride", F.greatest(F.lit(history), F.floor((F.lit(budget - history) - room) / 2)))
        .withColumn("head", first)
        .withColumn("begin", F.when(first, F.lit(-1)).otherwise(F.col("begin") - room))
        .withColumn("end", F.when(first, F.lit(0)).otherwise(F.col("begin") + F.col("tokens")))
        .withColumn("step", F.greatest(F.lit(0), F.floor(F.col("begin") / F.col("stride"))))
        .withColumn("long", ~F.col("head") & (F.col("tokens") > F.col("stride")))
        .drop("head_tokens")
    )
    # A stride holds so few turns that their group is bounded. The window after it opens where its turns
    # end, or before its long turn, which is always the last.
    group = Window.partitionBy("conv", "step")
    placed = placed.withColumn(
        "next",
        F.coalesce(F.min(F.when(F.col("long"), F.col("begin"))).over(group), F.max("end").over(group)),
    )
    own = F.struct(
        (F.col("step") * 2 + F.col("long").cast("long")).alias("window"), F.lit(None).cast("long").alias("opens")
    )
    ahead = F.when(F.col("next") >= (F.col("step") + 1) * F.col("stride"), F.floor(F.col("next") / F.col("stride")))
    ahead = F.coalesce(ahead, F.col("step"))
    again = F.array(
        F.struct((ahead * 2).alias("window"), F.col("next").alias("opens")),
        F.struct((ahead * 2 + 1).alias("window"), F.col("next").alias("opens")),
    )
    repeats = ~F.col("head") & ~F.col("long") & (F.col("begin") >= F.col("next") - history)
    spread = placed.withColumn("to", F.explode(F.when(repeats, F.concat(F.array(own), again)).otherwise(F.array(own))))
    spread = spread.where(
        F.col("to.opens").isNull() | (F.col("to.window") != F.col("step") * 2 + F.col("long").cast("long"))
    )
    gathered = spread.groupBy("conv", F.col("to.window").alias("window")).agg(
        F.min(F.when(F.col("to.opens").isNull(), F.col("begin"))).alias("opened"),
        F.bool_or("head").alias("has_head"),
        F.collect_list(
            F.struct(F.col("begin"), F.col("to.opens").alias("opens"), F.col("role"), F.col("text"))
        ).alias("turns"),
    )
    gathered = gathered.where("opened IS NOT NULL")
    gathered = gathered.join(heads.drop("head_tokens"), gathered["conv"].eqNullSafe(heads["c"]), "left")
    gathered = gathered.withColumn(
        "turns",
        F.expr(
            f"""concat(
              CASE WHEN head_text IS NULL OR has_head THEN filter(turns, t -> false)
                   ELSE array(named_struct('begin', -1L, 'opens', 0L, 'role', '{SYSTEM}', 'text', head_text)) END,
              array_sort(filter(turns, t -> t.opens IS NULL OR t.opens = opened)))"""
        ),
    )
    gathered = gathered.withColumn(
        "parts",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n")).alias("open"),
                escaped(t["text"]).alias("body"),
                (t["opens"].isNull() & (t["role"] == TARGET)).alias("target"),
            ),
        ),
    )
    ends = f"{CLOSE}\n"
    sizes = f"transform(parts, p -> CAST(length(p.open) + length(p.body) + {len(ends)} AS BIGINT))"
    return gathered.withColumn("at", F.expr(running_sums(sizes))).select(
        F.col("conv").alias("conv_id"),
        "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["open"], p["body"], F.lit(ends))), "").alias("text"),
        F.size(F.filter("turns", lambda t: t["opens"].isNotNull())).alias("n_repeated"),
        F.size("turns").alias("n_turns"),
        F.expr(
            """filter(transform(parts, (p, i) -> CASE WHEN p.target THEN
                 named_struct('start', at[i] + length(p.open), 'length', CAST(length(p.body) AS BIGINT)) END),
               s -> s IS NOT NULL)"""
        ).alias("loss_spans"),
    )


def own_turns(windows: DataFrame) -> DataFrame:
    """Read windows back: their own ``turns`` and ``targets`` as they were, and ``chars``, the formatted length."""
    cut = F.split(F.col("text"), r"<\|im_start\|>", -1)
    pieces = F.slice(cut, F.col("n_repeated") + 2, F.col("n_turns") - F.col("n_repeated"))
    size = len(f"{CLOSE}\n")
    read = F.transform(
        pieces,
        lambda piece: F.struct(
            F.url_decode(F.substring_index(piece, "\n", 1)).alias("role"),
            unescaped(
                piece.substr(F.locate("\n", piece) + 1, F.length(piece) - F.locate("\n", piece) - size)
            ).alias("text"),
        ),
    )
    targets = F.transform("loss_spans", lambda s: unescaped(F.col("text").substr(s["start"] + 1, s["length"])))
    return windows.select(
        "conv_id", "window", read.alias("turns"), targets.alias("targets"), F.length("text").alias("chars")
    )


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows read back to, as counts and hashes.

    A hash of all text of a conversation needs that text in one row; it is the
    only step here that grows with a conversation, and the operator itself does without.
    """
    read = own_turns(windows)
    rows = read.select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(
                F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
            ).alias("all"),
            F.array_join("targets", "").alias("loss"),
        ).alias("part"),
        F.size("turns").alias("n"),
        "chars",
    )
    grouped = rows.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list("part")).alias("parts"),
    )
    joined = F.array_join(F.transform("parts", lambda p: p["all"]), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return grouped.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
