"""Messages, histories, renderings and request bodies of batch chats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.schema import CONTEXT_WINDOW, OPTIONS, RESPONSE_FORMAT, STOP_WORD
from lodestone.functions.text import trim_space

MESSAGES = "array<struct<role:string,content:string>>"

# Turns of one conversation that one task sorts at a time.
TURNS_PER_SLICE = 512


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def contents(context: Column, replies: Column | None = None) -> Column:
    """The context, empty when missing, and the replies so far."""
    first = F.array(F.coalesce(context, F.lit("")))
    return first if replies is None else F.concat(first, replies)


def messages(system: Column, content: Column, prompt: Column) -> Column:
    """System text, the contents that are not null as user messages, the prompt."""
    said = F.transform(F.filter(content, lambda c: c.isNotNull()), lambda c: message("user", c))
    return F.concat(
        F.array(message("system", system)), said, F.array(message("user", prompt))
    ).cast(MESSAGES)


def prompt_row(system: Column, content: Column, prompt: Column) -> Column:
    return F.struct(
        system.alias("system_message"), content.alias("content"), prompt.alias("prompt")
    )


def _prior(
    df: DataFrame, said: Column, conversation: str, turn: str, name: str
) -> DataFrame:
    """Adds the array of ``said`` (nulls skipped) over the earlier turns.

    Long conversations are cut into slices of turns. Each slice is collected
    in its own task, and the slices before it come in as ready arrays.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(turn) / TURNS_PER_SLICE)).withColumn(
        "_said", said
    )
    inside = (
        W.partitionBy(conversation, "_slice").orderBy(turn).rowsBetween(W.unboundedPreceding, -1)
    )
    whole = (
        sliced.where(F.col("_said").isNotNull())
        .groupBy(conversation, "_slice")
        .agg(F.sort_array(F.collect_list(F.struct(turn, "_said"))).alias("_turns"))
        .select(conversation, "_slice", F.transform("_turns", lambda t: t["_said"]).alias("_all"))
    )
    slices = sliced.select(conversation, "_slice").distinct()
    earlier = (
        slices.alias("s")
        .join(
            whole.alias("w"),
            (F.col(f"s.{conversation}") == F.col(f"w.{conversation}"))
            & (F.col("w._slice") < F.col("s._slice")),
        )
        .groupBy(F.col(f"s.{conversation}").alias(conversation), F.col("s._slice").alias("_slice"))
        .agg(F.sort_array(F.collect_list(F.struct("w._slice", "w._all"))).alias("_parts"))
        .select(
            conversation,
            "_slice",
            F.flatten(F.transform("_parts", lambda p: p["_all"])).alias("_before"),
        )
    )
    empty = F.array().cast("array<string>")
    return (
        sliced.withColumn("_inside", F.collect_list("_said").over(inside))
        .join(earlier, [conversation, "_slice"], "left")
        .withColumn(name, F.concat(F.coalesce("_before", empty), "_inside"))
        .drop("_slice", "_said", "_inside", "_before")
    )


def history(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    name: str = "replies",
    full_history: bool = False,
) -> DataFrame:
    """User turns with the replies given before them, oldest first.

    Earlier user prompts are not part of it unless ``full_history`` is set.
    """
    said = F.col(text) if full_history else F.when(F.col(role) == "assistant", F.col(text))
    if full_history:
        said = F.when(F.col(role).isin("assistant", "user"), said)
    return _prior(turns, said, conversation, turn, name).where(F.col(role) == "user")


def is_stop(text: Column, word: str = STOP_WORD) -> Column:
    return F.lower(trim_space(text)) == word


def until_stop(
    turns: DataFrame, stop: Column, conversation: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """Turns before the first one where ``stop`` holds; that turn is left out.

    One small row per stopped conversation joins the turns, so no window sorts
    a whole conversation.
    """
    ends = turns.where(stop).groupBy(conversation).agg(F.min(turn).alias("_end"))
    return (
        turns.join(ends, conversation, "left")
        .where(F.col("_end").isNull() | (F.col(turn) < F.col("_end")))
        .drop("_end")
    )


def rendered(layout: str, system: Column, content: Column, prompt: Column) -> Column:
    """A prompt as text in one of three layouts; ``content`` is an array of texts."""
    joined = F.array_join(content, "\n")
    answer = F.when(
        F.size(content) > 0, F.lit('"Answer strictly based on content"')
    ).otherwise(F.lit('"Answer based on knowledge"'))
    # The wording of the layouts.
    parts = {
        "tagged": ["<|system|>", system, "</s>\n<|content|>", joined, "</s>\n<|prompt|>", prompt, "</s>"],
        "labelled": ["System Message: ", system, "\nContent: ", joined, "\nPrompt: ", prompt],
        "conditional": [
            "System Message: ", system, "\nContent: ", joined, "\n    ", answer,
            "\nPrompt: ", prompt,
        ],
    }
    if layout not in parts:
        raise ValueError(f"unknown layout {layout!r}")
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts[layout]])


def options(values: Mapping[str, object] | None = None) -> Column:
    """A struct of all sampling settings, null where not given."""
    values = dict(values or {})
    unknown = set(values) - set(OPTIONS.names)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return F.struct(
        *[_literal(values.get(f.name), f.dataType).alias(f.name) for f in OPTIONS.fields]
    )


def _literal(value, kind) -> Column:
    if isinstance(value, Column):
        return value.cast(kind)
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def chat_options() -> Column:
    """The settings used when a chat carries its history."""
    return options({"num_ctx": CONTEXT_WINDOW})


def request_body(model: str | Column, said: Column, settings: Column | None = None) -> Column:
    """The JSON body of one request; settings that are null are left out."""
    fields = [
        (F.lit(model) if isinstance(model, str) else model).alias("model"),
        said.alias("messages"),
        F.lit(False).alias("stream"),
        F.lit(RESPONSE_FORMAT).alias("format"),
    ]
    if settings is not None:
        fields.append(settings.alias("options"))
    return F.to_json(F.struct(*fields))
