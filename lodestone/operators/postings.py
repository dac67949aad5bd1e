"""Term postings of a text column and keyword ranking over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordering import SALTS, top_k
from lodestone.session import has_at_most

# Letters and digits; the plain ones, which are told at once, stand first.
TERM = r"[a-z0-9\p{L}\p{N}]+"

# Query terms small enough to send to every task.
QUERY_TERMS = 200_000
# Bytes of text whose terms one task counts at a time.
COUNTED_BYTES = 16 << 20
# Constants of the ranking formula.
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def term_counts(df: DataFrame, text: str, key: str | Sequence[str] = "row_key") -> DataFrame:
    """One row per row key and term: ``tf`` and ``row_terms``, without positions.

    Texts are shuffled by row key before they are taken apart: a text is
    smaller than its terms, and counting then needs no shuffle, nor does
    anything later that groups by row key. A task counts the terms of so many
    bytes of text, whatever the size of the table.
    """
    keys = [key] if isinstance(key, str) else list(key)
    texts = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, 1 + size // COUNTED_BYTES)
    split = (
        texts.repartition(tasks, *keys)
        .select(*keys, terms(F.col("_text")).alias("_terms"))
    )
    # Exploding an expression keeps Catalyst from adding a filter on the terms
    # below the shuffle, which would take every text apart twice.
    some = F.when(F.size("_terms") > 0, F.col("_terms"))
    exploded = split.select(*keys, F.size("_terms").alias("row_terms"), F.explode(some).alias("term"))
    return exploded.groupBy(*keys, "term", "row_terms").agg(F.count(F.lit(1)).alias("tf"))


def postings(df: DataFrame, text: str, key: str | Sequence[str] = "row_key") -> DataFrame:
    """One row per row key and term: ``tf``, ``row_terms`` and the positions.

    A text's terms are sorted with their positions inside its own row, where
    equal terms then stand together, so building postings shuffles nothing.
    Every array is read more than once by the step after it; Catalyst then
    keeps it as a column instead of repeating the work.
    """
    keys = [key] if isinstance(key, str) else list(key)
    split = df.where(F.col(text).isNotNull()).select(*keys, terms(F.col(text)).alias("_terms"))
    placed = F.transform("_terms", lambda term, at: F.struct(term.alias("term"), at.alias("at")))
    ordered = split.select(
        *keys, F.size("_terms").alias("row_terms"), F.sort_array(placed).alias("_sorted")
    )

    def term_at(i):
        return F.get("_sorted", i)["term"]

    every = F.when(F.col("row_terms") > 0, F.sequence(F.lit(0), F.col("row_terms") - 1))
    heads = F.filter(every, lambda i: (i == 0) | (term_at(i) != term_at(i - 1)))
    headed = ordered.select(*keys, "row_terms", "_sorted", heads.alias("_heads"))

    def run(head, number):
        past = F.coalesce(F.get("_heads", number + 1), F.col("row_terms"))
        found = F.slice(F.col("_sorted"), head + 1, past - head)
        return F.struct(
            term_at(head).alias("term"), F.transform(found, lambda x: x["at"]).alias("positions")
        )

    runs = F.explode(F.transform("_heads", run)).alias("_run")
    return headed.select(*keys, "row_terms", runs).select(
        *keys,
        "_run.term",
        "row_terms",
        F.size("_run.positions").cast("long").alias("tf"),
        "_run.positions",
    )


def term_stats(index: DataFrame) -> DataFrame:
    """Rows and occurrences per term."""
    return index.groupBy("term").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("tf").alias("occurrences")
    )


def corpus_stats(df: DataFrame, text: str, stats: DataFrame) -> DataFrame:
    """One row: the number of texts and their mean number of terms.

    Terms are summed from the term statistics, so no text is taken apart again.
    """
    texts = df.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("rows")).scalar()
    total = stats.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("_total"))
    counted = total.select(texts.alias("rows"), "_total")
    return counted.select("rows", F.try_divide("_total", "rows").alias("mean_terms"))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """The distinct terms of each query."""
    distinct = F.array_distinct(terms(F.col(text)))
    return queries.select(query_id, F.explode(distinct).alias("term"))


def scores(
    index: DataFrame,
    stats: DataFrame,
    corpus: DataFrame,
    queries: DataFrame,
    key: str | Sequence[str] = "row_key",
    query_id: str = "query_id",
    text: str = "text",
) -> DataFrame:
    """The score of every row that shares a term with a query.

    ``sum(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)))``
    with ``idf = ln(1 + (rows - n + 0.5) / (n + 0.5))``.

    Few query terms go to every task. Otherwise both sides meet by term and a
    salt, because a common word may hold a large part of all postings.
    """
    keys = [key] if isinstance(key, str) else list(key)
    wanted = query_terms(queries, query_id, text)
    small = has_at_most(wanted, QUERY_TERMS)
    here = stats.select("term", "row_count")
    if small:
        here = here.join(F.broadcast(wanted), "term")
    else:
        here = here.join(wanted, "term")
    size = corpus.select(F.struct("rows", "mean_terms")).scalar()
    n = F.col("row_count")
    idf = F.log(1 + (size["rows"] - n + 0.5) / (n + 0.5))
    weighted = here.select(query_id, "term", idf.alias("_idf"))
    narrow = index.select(*keys, "term", "tf", "row_terms")
    if small:
        matched = narrow.join(F.broadcast(weighted), "term")
    else:
        salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")
        every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        weighted = weighted.select("*", every_salt)
        matched = narrow.withColumn("_salt", salt).join(weighted, ["term", "_salt"])
    tf = F.col("tf")
    length = 1 - B + B * F.col("row_terms") / size["mean_terms"]
    gain = F.col("_idf") * tf * (K1 + 1) / (tf + K1 * length)
    return (
        matched.withColumn("_gain", gain).groupBy(query_id, *keys).agg(F.sum("_gain").alias("score"))
    )


def keyword_search(
    index: DataFrame,
    stats: DataFrame,
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    key: str | Sequence[str] = "row_key",
    query_id: str = "query_id",
    text: str = "text",
    digits: int = 9,
) -> DataFrame:
    """The ``k`` best rows per query; ties go to the smaller key.

    Scores are rounded to ``digits`` first, since the order in which partial
    scores add up is not fixed.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ranked = scores(index, stats, corpus, queries, keys, query_id, text)
    ranked = ranked.withColumn("score", F.round("score", digits))
    return top_k(ranked, [query_id], [F.desc("score"), *keys], k)
