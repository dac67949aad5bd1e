"""Fixed values, stored schemas and nested types."""

from __future__ import annotations

from pyspark.sql import types as T

# Defaults of the load and search settings.
DIMENSION = 768
CHUNK_SIZE = 2048
CHUNK_OVERLAP = 256
NEIGHBOURS = 30
PROBES = 40
REFINE_FACTOR = 10
PARTITIONS = 100
SAMPLE_RATE = 256
MAX_ITERATIONS = 50
ROW_CAP = 1000
LOG_CONTEXT = 20
CONTEXT_WINDOW = 128000
RESPONSE_FORMAT = "json"
STOP_WORD = "exit"

# Words that mark log lines.
NOISE_WORDS = ("lineage",)
ERROR_WORDS = ("error", "exception")

# File extension -> language; other extensions are not loaded.
LANGUAGES = {
    "rs": "rust",
    "py": "python",
    "cpp": "cpp",
    "java": "java",
    "js": "javascript",
    "ts": "typescript",
    "tsx": "tsx",
    "c": "c",
    "h": "c",
    "go": "go",
    "scala": "scala",
    "txt": "text",
    "log": "log",
}

ROLES = ("user", "assistant", "system", "tool")


def vector_table(extra: bool = True) -> T.StructType:
    """One row per embedded line.

    ``path`` and ``line_no`` are additions: ``metadata`` is a base name, so
    two files may share it, and lines need an order within their chunk.
    """
    fields = [
        T.StructField("id", T.LongType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("metadata", T.StringType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType(), True), True),
        T.StructField("model", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("chunk_number", T.IntegerType(), True),
    ]
    if extra:
        fields += [
            T.StructField("path", T.StringType(), True),
            T.StructField("line_no", T.IntegerType(), True),
        ]
    return T.StructType(fields)


EMBED_RESPONSE = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("embeddings", T.ArrayType(T.ArrayType(T.FloatType()))),
    ]
)

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)

# Names and types of the optional sampling settings.
OPTIONS = T.StructType(
    [
        T.StructField("num_keep", T.IntegerType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("num_predict", T.IntegerType()),
        T.StructField("top_k", T.IntegerType()),
        T.StructField("top_p", T.FloatType()),
        T.StructField("min_p", T.FloatType()),
        T.StructField("typical_p", T.FloatType()),
        T.StructField("repeat_last_n", T.IntegerType()),
        T.StructField("temperature", T.FloatType()),
        T.StructField("repeat_penalty", T.FloatType()),
        T.StructField("presence_penalty", T.FloatType()),
        T.StructField("frequency_penalty", T.FloatType()),
        T.StructField("mirostat", T.IntegerType()),
        T.StructField("mirostat_tau", T.FloatType()),
        T.StructField("mirostat_eta", T.FloatType()),
        T.StructField("penalize_newline", T.BooleanType()),
        T.StructField("stop", T.ArrayType(T.StringType())),
        T.StructField("numa", T.BooleanType()),
        T.StructField("num_ctx", T.IntegerType()),
        T.StructField("num_batch", T.IntegerType()),
        T.StructField("num_gpu", T.IntegerType()),
        T.StructField("main_gpu", T.IntegerType()),
        T.StructField("low_vram", T.BooleanType()),
        T.StructField("vocab_only", T.BooleanType()),
        T.StructField("use_mmap", T.BooleanType()),
        T.StructField("use_mlock", T.BooleanType()),
        T.StructField("num_thread", T.IntegerType()),
    ]
)

# Fields of a chat reply.
CHAT_RESPONSE = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("message", MESSAGE),
        T.StructField("done_reason", T.StringType()),
        T.StructField("done", T.BooleanType()),
        T.StructField("context", T.ArrayType(T.IntegerType())),
        T.StructField("total_duration", T.LongType()),
        T.StructField("load_duration", T.LongType()),
        T.StructField("prompt_eval_count", T.IntegerType()),
        T.StructField("prompt_eval_duration", T.LongType()),
        T.StructField("eval_count", T.IntegerType()),
        T.StructField("eval_duration", T.LongType()),
    ]
)
