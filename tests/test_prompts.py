import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.operators import generation as G
from lodestone.operators import prompts as P
from lodestone.schema import OPTIONS


def turns(spark, lengths=(9, 1, 40)):
    rows = []
    for conv, n in enumerate(lengths):
        for t in range(n):
            role = "system" if t == 0 and conv == 2 else ("user", "assistant")[t % 2]
            rows.append((conv, t, role, f"{conv}-{t}"))
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("size", [2, 7, 512])
@pytest.mark.parametrize("full", [False, True])
def test_history(spark, monkeypatch, size, full):
    monkeypatch.setattr(P, "TURNS_PER_SLICE", size)
    rows, df = turns(spark)
    said = ("assistant", "user") if full else ("assistant",)
    wanted = {
        (c, t): [x for c2, t2, r2, x in rows if c2 == c and t2 < t and r2 in said]
        for c, t, r, _ in rows
        if r == "user"
    }
    found = P.history(df, full_history=full).collect()
    assert {(r.conv_id, r.turn): r.replies for r in found} == wanted
    assert len(found) == len(wanted)


def test_history_of_turns_below_zero(spark, monkeypatch):
    monkeypatch.setattr(P, "TURNS_PER_SLICE", 2)
    rows = [(1, t, "user" if t % 2 else "assistant", f"x{t}") for t in range(-7, 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.turn: r.replies for r in P.history(df).collect()}
    assert found == {t: [f"x{u}" for u in range(-6, t, 2)] for t in range(-7, 4, 2)}


def test_until_stop(spark):
    rows = [(1, 0, "hi"), (1, 1, "ok"), (1, 2, "\t EXIT \n"), (1, 3, "late"), (1, 4, "exit"), (2, 0, "exit it")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    found = P.until_stop(df, P.is_stop(F.col("text"))).collect()
    assert sorted((r.conv_id, r.turn) for r in found) == [(1, 0), (1, 1), (2, 0)]


def body_of(spark, **columns):
    said = P.messages(F.lit("S"), P.contents(columns["context"], columns.get("replies")), F.lit("P"))
    return spark.range(1).select(P.request_body("m", said, columns.get("settings")).alias("b")).first().b


def test_request(spark):
    body = json.loads(body_of(spark, context=F.lit(None).cast("string"), settings=P.chat_options()))
    assert body == {
        "model": "m",
        "messages": [
            {"role": "system", "content": "S"},
            {"role": "user", "content": ""},
            {"role": "user", "content": "P"},
        ],
        "stream": False,
        "format": "json",
        "options": {"num_ctx": 128000},
    }
    replies = F.array(F.lit("r1"), F.lit(None).cast("string"), F.lit("r2"))
    body = json.loads(body_of(spark, context=F.lit("C"), replies=replies))
    assert [m["content"] for m in body["messages"]] == ["S", "C", "r1", "r2", "P"]
    assert "options" not in body


def test_options(spark):
    settings = P.options({"seed": 7, "stop": ["a", "b"], "temperature": 0.5, "numa": False})
    made = spark.range(1).select(settings.alias("o"))
    assert made.schema["o"].dataType.names == OPTIONS.names and len(OPTIONS) == 27
    text = made.select(F.to_json("o").alias("j")).first().j
    assert json.loads(text) == {"seed": 7, "stop": ["a", "b"], "temperature": 0.5, "numa": False}
    with pytest.raises(ValueError):
        P.options({"warmth": 1})


def test_layouts(spark):
    def made(layout, content):
        column = P.rendered(layout, F.lit("S"), content, F.lit("P"))
        return spark.range(1).select(column.alias("t")).first().t

    some, none = F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>")
    assert made("tagged", some) == "<|system|>S</s>\n<|content|>a\nb</s>\n<|prompt|>P</s>"
    assert made("labelled", none) == "System Message: S\nContent: \nPrompt: P"
    assert "strictly" in made("conditional", some) and "knowledge" in made("conditional", none)
    with pytest.raises(ValueError):
        P.rendered("other", F.lit("S"), some, F.lit("P"))


def test_failures_cost_one_reply(spark):
    def start():
        def answer(bodies):
            if any("bad" in b for b in bodies):
                raise RuntimeError("refused")
            return [b.upper() for b in bodies]

        return answer

    df = spark.createDataFrame([(i, "bad" if i == 3 else f"b{i}") for i in range(9)], "i int, body string")
    found = {r.i: (r.reply, r.status, r.error) for r in G.generate(df, start, batch=4).collect()}
    assert found[3] == (None, "error", "refused")
    assert all(found[i] == (f"B{i}", "ok", None) for i in range(9) if i != 3)
    with pytest.raises(PySparkException, match="refused"):
        G.generate(df, start, strict=True).collect()


def test_json_replies(spark):
    df = spark.createDataFrame([('{"a":1}',), ("not json",)], "t string")
    assert [r.v for r in df.select(G.valid_json(F.col("t")).alias("v")).collect()] == [True, False]
    pretty = df.limit(1).select(G.pretty_json(F.col("t"), "a int").alias("p")).first().p
    assert json.loads(pretty) == {"a": 1} and "\n" in pretty
    with pytest.raises(PySparkException, match="not JSON"):
        df.select(G.checked_json(F.col("t"))).collect()
