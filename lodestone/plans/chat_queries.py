"""Queries over conversations and JSON replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import generation as G
from lodestone.operators import prompts as P
from lodestone.plans.jobs import answered, prompt_batch, prompt_only
from lodestone.plans.registry import registered, table
from lodestone.plans.vector_queries import JOINED, lines_with_vectors, mean_queries
from lodestone.operators import retrieve as R
from lodestone.schema import CONTEXT_WINDOW

SYSTEM = "You answer from the given content."

# Replies before each user turn, in SQL.
PRIOR = """
    h AS (SELECT conv_id, turn, role, text,
      list(text) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS replies FROM conversations),
    u AS (SELECT conv_id, turn, text, coalesce(replies, []) AS replies FROM h WHERE role = 'user')"""


def _system_text(turns: DataFrame) -> DataFrame:
    """The system text of each conversation that has one."""
    return (
        turns.where("role = 'system'")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("system"))
    )


def user_turns(turns: DataFrame) -> DataFrame:
    """User turns with their history and the conversation's system text."""
    told = P.history(turns).join(_system_text(turns), "conv_id", "left")
    return told.withColumn("system", F.coalesce("system", F.lit(SYSTEM)))


SYSTEMS = f"""
    s AS (SELECT conv_id, min_by(text, turn) AS system FROM conversations
          WHERE role = 'system' GROUP BY conv_id),
    v AS (SELECT u.*, coalesce(s.system, '{SYSTEM}') AS system FROM u LEFT JOIN s USING (conv_id))"""


@registered(
    f"""WITH {PRIOR}
    SELECT conv_id, turn, CAST(len(replies) AS INTEGER) AS n, array_to_string(replies, '|') AS replies
    FROM u"""
)
def chat_history(spark, folder):
    told = P.history(table(spark, folder, "conversations"))
    return told.select(
        "conv_id", "turn", F.size("replies").alias("n"), F.array_join("replies", "|").alias("replies")
    )


@registered(
    """WITH h AS (SELECT conv_id, turn, role,
      count(*) FILTER (WHERE role <> 'system') OVER w AS n,
      string_agg(text, '|') FILTER (WHERE role <> 'system') OVER w AS said
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id, turn, CAST(n AS INTEGER) AS n, coalesce(said, '') AS said
    FROM h WHERE role = 'user'"""
)
def chat_full_history(spark, folder):
    told = P.history(table(spark, folder, "conversations"), name="said", full_history=True)
    return told.select(
        "conv_id", "turn", F.size("said").alias("n"), F.array_join("said", "|").alias("said")
    )


@registered(
    f"""WITH {PRIOR}, {SYSTEMS},
    m AS (
      SELECT conv_id, turn, 0 AS pos, 'system' AS role, system AS content FROM v
      UNION ALL SELECT conv_id, turn, 1, 'user', '' FROM v
      UNION ALL SELECT conv_id, turn, 1 + generate_subscripts(replies, 1), 'user', unnest(replies)
        FROM v
      UNION ALL SELECT conv_id, turn, 2 + len(replies), 'user', text FROM v)
    SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, role, content FROM m"""
)
def chat_messages(spark, folder):
    turns = user_turns(table(spark, folder, "conversations"))
    said = P.messages(
        F.col("system"),
        P.contents(F.lit(None).cast("string"), F.col("replies")),
        F.col("text"),
    )
    return turns.select("conv_id", "turn", F.posexplode(said).alias("pos", "m")).select(
        "conv_id", "turn", "pos", "m.role", "m.content"
    )


@registered(
    """WITH e AS (SELECT conv_id, min(turn) AS stop FROM conversations
      WHERE contains(text, chr(10)) AND turn >= 1 GROUP BY conv_id)
    SELECT c.conv_id, c.turn, c.role FROM conversations c LEFT JOIN e USING (conv_id)
    WHERE e.stop IS NULL OR c.turn < e.stop"""
)
def chat_until_exit(spark, folder):
    """Turns before the stopping one; here a follow-up of several lines stops a chat."""
    turns = table(spark, folder, "conversations")
    stop = F.contains("text", F.lit("\n")) & (F.col("turn") >= 1)
    return P.until_stop(turns, stop).select("conv_id", "turn", "role")


@registered(
    """WITH l AS (SELECT conv_id, turn, min(line_no) AS stop FROM (
        SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word,
          generate_subscripts(string_split(text, ' '), 1) - 1 AS line_no FROM conversations)
      WHERE lower(trim(word)) = 'exit' OR lower(trim(word)) = 'in' GROUP BY conv_id, turn)
    SELECT c.conv_id, c.turn, coalesce(l.stop, -1) AS stop
    FROM conversations c LEFT JOIN l USING (conv_id, turn)"""
)
def chat_stop_word(spark, folder):
    """Where a stop word first stands alone among the words of a message."""
    turns = table(spark, folder, "conversations")
    words = turns.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("at", "word"))
    stop = P.is_stop(F.col("word")) | P.is_stop(F.col("word"), "in")
    first = words.where(stop).groupBy("conv_id", "turn").agg(F.min("at").alias("stop"))
    return turns.join(first, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("stop", F.lit(-1)).cast("long").alias("stop")
    )


@registered(
    f"""WITH {PRIOR}, {SYSTEMS},
    j AS (SELECT conv_id, turn, system, text, replies, array_to_string(replies, chr(10)) AS c FROM v)
    SELECT conv_id, turn,
      '<|system|>' || system || '</s>' || chr(10) || '<|content|>' || c || '</s>' || chr(10)
        || '<|prompt|>' || text || '</s>' AS tagged,
      'System Message: ' || system || chr(10) || 'Content: ' || c || chr(10) || 'Prompt: ' || text
        AS labelled,
      'System Message: ' || system || chr(10) || 'Content: ' || c || chr(10) || '    '
        || CASE WHEN len(replies) > 0 THEN '"Answer strictly based on content"'
           ELSE '"Answer based on knowledge"' END
        || chr(10) || 'Prompt: ' || text AS conditional
    FROM j"""
)
def prompt_render(spark, folder):
    turns = user_turns(table(spark, folder, "conversations"))
    return turns.select(
        "conv_id",
        "turn",
        *[
            P.rendered(layout, F.col("system"), F.col("replies"), F.col("text")).alias(layout)
            for layout in ("tagged", "labelled", "conditional")
        ],
    )


@registered(
    f"""WITH {PRIOR}, {SYSTEMS}
    SELECT conv_id, turn, to_json(struct_pack(
      model := 'small',
      messages := [struct_pack(role := 'system', content := system)]
        || [struct_pack(role := 'user', content := '')]
        || list_transform(replies, lambda x: struct_pack(role := 'user', content := x))
        || [struct_pack(role := 'user', content := text)],
      stream := false, format := 'json',
      options := struct_pack(num_ctx := {CONTEXT_WINDOW})))::VARCHAR AS body
    FROM v"""
)
def request_json(spark, folder):
    turns = user_turns(table(spark, folder, "conversations"))
    said = P.messages(
        F.col("system"),
        P.contents(F.lit(None).cast("string"), F.col("replies")),
        F.col("text"),
    )
    return turns.select(
        "conv_id", "turn", P.request_body("small", said, P.chat_options()).alias("body")
    )


@registered(
    """SELECT conv_id, turn, CAST(turn AS INTEGER) AS seed,
      CAST(length(text) AS INTEGER) AS num_predict,
      text[1:4] AS first_stop, 2 AS set_options FROM conversations WHERE role = 'user'"""
)
def sampling_options(spark, folder):
    """Settings taken from columns; absent ones do not appear in the JSON."""
    turns = table(spark, folder, "conversations").where("role = 'user'")
    settings = P.options({"seed": F.col("turn"), "num_predict": F.length("text")})
    made = turns.withColumn("json", F.to_json(settings))
    with_stop = P.options({"stop": F.array(F.substring("text", 1, 4))})
    return made.select(
        "conv_id",
        "turn",
        F.get_json_object("json", "$.seed").cast("int").alias("seed"),
        F.get_json_object("json", "$.num_predict").cast("int").alias("num_predict"),
        F.get_json_object(F.to_json(with_stop), "$.stop[0]").alias("first_stop"),
        F.size(F.json_object_keys("json")).alias("set_options"),
    )


def _replies(spark, folder) -> DataFrame:
    """Assistant turns as JSON reply bodies."""
    turns = table(spark, folder, "conversations").where("role = 'assistant'")
    body = F.struct(
        F.concat(F.lit("m"), F.pmod("turn", F.lit(3)).cast("string")).alias("model"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        P.message("assistant", F.col("text")).alias("message"),
        F.lit(True).alias("done"),
        F.length("text").alias("prompt_eval_count"),
        F.size(F.split("text", " ")).alias("eval_count"),
        (F.col("turn") * 1_000_000).alias("total_duration"),
    )
    return turns.select("conv_id", "turn", F.to_json(body).alias("body"))


@registered(
    """SELECT conv_id, turn, 'm' || (turn % 3) AS model, text AS content, true AS done,
      CAST(length(text) AS INTEGER) AS prompt_eval_count,
      CAST(len(string_split(text, ' ')) AS INTEGER) AS eval_count,
      turn * 1000000 AS total_duration, CAST(NULL AS VARCHAR) AS done_reason
    FROM conversations WHERE role = 'assistant'"""
)
def reply_parse(spark, folder):
    parsed = _replies(spark, folder).withColumn("r", G.parse_reply(F.col("body")))
    return parsed.select(
        "conv_id", "turn", "r.model", G.reply_text(F.col("r")).alias("content"), "r.done",
        "r.prompt_eval_count", "r.eval_count", "r.total_duration", "r.done_reason",
    )


@registered(
    """SELECT 'm' || (turn % 3) AS model, count(*) AS replies,
      CAST(sum(length(text)) AS BIGINT) AS prompt_tokens,
      CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS reply_tokens,
      CAST(sum(turn * 1000000) AS BIGINT) AS total_duration
    FROM conversations WHERE role = 'assistant' GROUP BY 1"""
)
def usage_report(spark, folder):
    parsed = _replies(spark, folder).withColumn("reply", G.parse_reply(F.col("body")))
    return G.usage_report(parsed)


@registered(
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"""
)
def json_field(spark, folder):
    parsed = F.from_json("props", "k int")
    return table(spark, folder, "events").select("event_id", parsed["k"].alias("k"))


@registered(
    """SELECT 'event' AS kind, event_id AS id, json_valid(props) AS valid FROM events
    UNION ALL SELECT 'turn', conv_id * 1000 + turn, json_valid(text) FROM conversations"""
)
def reply_valid_json(spark, folder):
    events = table(spark, folder, "events").select(
        F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("text")
    )
    turns = table(spark, folder, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    return events.unionByName(turns).select("kind", "id", G.valid_json(F.col("text")).alias("valid"))


@registered(
    """SELECT conv_id, turn, 'ok' AS status, CAST(length(text) AS INTEGER) AS characters,
      string_split(text, ' ')[1] AS first FROM conversations WHERE role = 'user'"""
)
def generate_stub(spark, folder):
    """Prompts without retrieval, answered by the deterministic stub."""
    turns = table(spark, folder, "conversations").where("role = 'user'")
    replies = prompt_only(turns, SYSTEM, "small", lambda: G.stub_generator)
    answer = F.from_json("answer", "characters int, first string")
    return replies.select(
        "conv_id", "turn", "status", answer["characters"].alias("characters"),
        answer["first"].alias("first"),
    )


@registered(
    f"""{JOINED},
    c AS (SELECT r.query_id, string_agg(t.content, ' ' ORDER BY r.rank) AS context
          FROM r JOIN t USING (vec_id) WHERE rank <= 5 GROUP BY r.query_id)
    SELECT query_id, 3 AS messages, '{SYSTEM}' AS system, context,
      'Label ' || query_id AS prompt, {CONTEXT_WINDOW} AS num_ctx, 'ok' AS status FROM c"""
)
def rag_prompts(spark, folder):
    """Nearest content joined into one request per query, and answered."""
    lines = lines_with_vectors(spark, folder)
    queries = mean_queries(table(spark, folder, "embeddings")).withColumn(
        "text", F.concat(F.lit("Label "), F.col("query_id"))
    )
    found = R.retrieve(lines, queries, "nearest", 5, key=["vec_id"], vector="embedding")
    bodies = prompt_batch(
        queries.select("query_id", "text"), SYSTEM, "small", R.context_string(found),
        P.chat_options(),
    )
    replies = answered(bodies, lambda: G.stub_generator)
    field = lambda path: F.get_json_object("body", path)
    return replies.select(
        "query_id",
        F.size(F.from_json(field("$.messages"), P.MESSAGES)).alias("messages"),
        field("$.messages[0].content").alias("system"),
        field("$.messages[1].content").alias("context"),
        field("$.messages[2].content").alias("prompt"),
        field("$.options.num_ctx").cast("int").alias("num_ctx"),
        "status",
    )
