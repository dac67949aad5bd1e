"""Batch generation through a pluggable function, and its replies."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.schema import CHAT_RESPONSE
from lodestone.session import ship_package

Generator = Callable[[list[str]], list[str]]


def stub_generator(bodies: list[str]) -> list[str]:
    """Replies that only depend on the request: the last prompt's size and first word."""
    replies = []
    for body in bodies:
        request = json.loads(body)
        prompt = request["messages"][-1]["content"]
        answer = {"characters": len(prompt), "first": prompt.split(" ")[0]}
        reply = {
            "model": request["model"],
            "created_at": "1970-01-01T00:00:00Z",
            "message": {"role": "assistant", "content": json.dumps(answer, ensure_ascii=False)},
            "done": True,
        }
        replies.append(json.dumps(reply, ensure_ascii=False))
    return replies


def generate(
    df: DataFrame,
    start: Callable[[], Generator],
    body: str = "body",
    batch: int = 16,
    strict: bool = False,
) -> DataFrame:
    """Adds ``reply``, ``status`` (``ok`` or ``error``) and ``error`` per request.

    ``start`` runs once per task and returns the function that answers a list
    of bodies. When a batch fails its requests are tried one by one, so one
    bad request costs only its own reply; ``strict`` fails the job instead.
    """
    ship_package(df.sparkSession)
    fields = [
        T.StructField("reply", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
    schema = T.StructType(df.schema.fields + fields)

    def answer(generator, bodies):
        replies = generator(bodies)
        if len(replies) != len(bodies):
            raise ValueError("the generator returned another number of replies")
        return [(reply, "ok", None) for reply in replies]

    def tried(generator, bodies):
        try:
            return answer(generator, bodies)
        except Exception as failure:
            if strict:
                raise
            if len(bodies) == 1:
                return [(None, "error", str(failure))]
            return [row for one in bodies for row in tried(generator, [one])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = start()
        for frame in frames:
            bodies = frame[body].tolist()
            rows = []
            for first in range(0, len(bodies), batch):
                rows.extend(tried(generator, bodies[first : first + batch]))
            columns = pd.DataFrame(
                rows, columns=["reply", "status", "error"], index=frame.index, dtype=object
            )
            yield pd.concat([frame, columns], axis=1)

    return df.mapInPandas(run, schema)


def parse_reply(reply: Column) -> Column:
    return F.from_json(reply, CHAT_RESPONSE)


def reply_text(reply: Column) -> Column:
    """The message of a parsed reply."""
    return reply["message"]["content"]


def valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def checked_json(text: Column) -> Column:
    """The text when it is JSON; an error otherwise."""
    failed = F.raise_error(F.concat(F.lit("reply is not JSON: "), text)).cast("string")
    return F.when(valid_json(text), text).otherwise(failed)


def pretty_json(text: Column, schema: str | T.StructType) -> Column:
    """JSON of a known shape, indented."""
    return F.to_json(F.from_json(text, schema), {"pretty": "true"})


def usage_report(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Requests, tokens and time per model over parsed replies."""
    of = lambda name: F.col(f"{reply}.{name}")
    return replies.groupBy(of("model").alias("model")).agg(
        F.count(F.lit(1)).alias("replies"),
        F.sum(of("prompt_eval_count")).alias("prompt_tokens"),
        F.sum(of("eval_count")).alias("reply_tokens"),
        F.sum(of("total_duration")).alias("total_duration"),
    )
