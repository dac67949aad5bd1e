"""Reading folders of text, source code and logs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import base_name, language_of
from lodestone.schema import LANGUAGES


def name_pattern(languages: Iterable[str] | None = None) -> str:
    """A pattern for the file names of some languages; of all by default."""
    wanted = [e for e, name in LANGUAGES.items() if languages is None or name in set(languages)]
    return "*.{" + ",".join(wanted) + "}"


def read_files(
    spark: SparkSession,
    path: str,
    strict: bool = True,
    languages: Iterable[str] | None = None,
    up_to: int | None = None,
) -> DataFrame:
    """Files of known types below a path (or the one file): ``path, metadata,
    language, text``.

    The type filter prunes the file listing, so other files are never read.
    Bytes that are not UTF-8 are an error, or skip the file when not
    ``strict``. Each file is one value, hence below 2 GB; ``read_lines`` has no
    such bound.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name_pattern(languages))
        .load(path)
    )
    if up_to is not None:
        files = files.where(F.col("length") <= up_to)
    language = language_of(F.col("path"))
    text = F.col("content").cast("string")
    if strict:
        text = F.decode(F.col("content"), "UTF-8")
    else:
        files = files.where(F.is_valid_utf8(text))
    return files.select(
        "path",
        base_name(F.col("path")).alias("metadata"),
        language.alias("language"),
        text.alias("text"),
    ).where(F.col("language").isNotNull())


def read_lines(
    spark: SparkSession, path: str, pattern: str = "*", strict: bool = True
) -> DataFrame:
    """Lines of text files: ``path, metadata, block, row, line``.

    Files are split over tasks, whatever their size. ``block``, the start of
    the split a line was read from, and ``row`` put the lines of a file in
    order. Bytes that are not UTF-8 are an error, or leave out the whole file
    when not ``strict``.
    """
    read = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("lineSep", "\n")
        .text(path)
    )
    lines = read.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("metadata"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )
    valid = F.is_valid_utf8("line")
    if strict:
        failed = F.raise_error(F.concat(F.lit("not UTF-8: "), "path")).cast("string")
        lines = lines.withColumn("line", F.when(valid, F.col("line")).otherwise(failed))
    else:
        broken = lines.where(~valid).select("path").distinct()
        lines = lines.join(broken, "path", "left_anti")
    return lines.withColumn("line", F.regexp_replace("line", r"\r$", ""))


def read_ended_lines(
    spark: SparkSession, path: str, languages: Iterable[str], larger_than: int = -1, strict: bool = True
) -> DataFrame:
    """Lines of text and code files with their line feeds: ``path, metadata, language, block, row, line``.

    Nothing of the text is lost: carriage returns stay, the last line has a line
    feed only if the file ends with one, and a byte order mark stays at the
    first. Both are told from the size of the file. Only files of more than
    ``larger_than`` bytes are read, in splits, whatever their size.
    """
    read = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name_pattern(languages))
        .option("lineSep", "\n")
        .text(path)
        .where(F.col("_metadata.file_size") > larger_than)
    )
    lines = read.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("metadata"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("_metadata.file_size").alias("_size"),
        F.is_valid_utf8("value").alias("_valid"),
        F.col("value").alias("line"),
    )
    place = F.struct("block", "row")
    files = lines.groupBy("path").agg(
        F.min(place).alias("first"),
        F.max(place).alias("last"),
        (F.sum(F.octet_length("line") + 1) - F.max("_size")).alias("over"),
        F.bool_and("_valid").alias("_valid"),
    )
    # read without the mark a file seems three bytes short, with a line feed too many one byte long
    ends = files.select(
        "path",
        "_valid",
        F.inline(
            F.array(
                F.struct("first.*", F.when(F.col("over") < -1, "\ufeff").otherwise("").alias("_mark"), F.lit(False).alias("_open")),
                F.struct("last.*", F.lit("").alias("_mark"), F.col("over").isin(1, -2).alias("_open")),
            )
        ),
    )
    if strict:
        failed = F.raise_error(F.concat(F.lit("not UTF-8: "), "path")).cast("string")
        lines = lines.withColumn("line", F.when(F.col("_valid"), F.col("line")).otherwise(failed))
    else:
        lines = lines.join(ends.where(~F.col("_valid")).select("path").distinct(), "path", "left_anti")
    # by place, not by path: a large file meets its two ends in as many tasks as it has lines
    marks = ends.groupBy("path", "block", "row").agg(F.max("_mark").alias("_mark"), F.max("_open").alias("_open"))
    feed = F.when(F.coalesce("_open", F.lit(False)), "").otherwise("\n")
    joined = lines.join(marks, ["path", "block", "row"], "left")
    return joined.select(
        "path",
        "metadata",
        language_of(F.col("path")).alias("language"),
        "block",
        "row",
        F.concat(F.coalesce("_mark", F.lit("")), "line", feed).alias("line"),
    )


def read_prompt(spark: SparkSession, path: str) -> str:
    """The full text of one file, as the caller's prompt."""
    found = spark.read.format("binaryFile").load(path).select("path", "length").limit(2).collect()
    if len(found) != 1:
        raise FileNotFoundError(f"not a single prompt file: {path}")
    if not found[0]["length"]:
        return ""
    return spark.read.text(path, wholetext=True).first()[0]


def spread(df: DataFrame) -> DataFrame:
    """A scan over at least as many tasks as the cluster has cores.

    Only a scan that yields fewer (one small file, one row group) is shuffled.
    Meant for plain scans: counting the tasks of a shuffled frame would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
