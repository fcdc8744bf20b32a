"""Corpora of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """path, size of the files in a folder itself (not below), the largest first, then by path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    return found.select("path", F.col("length").alias("size")).orderBy(F.desc("size"), "path")


def lines(spark: SparkSession, folder: str, pattern: str = "*.txt", charset: str = "utf-8") -> DataFrame:
    """file, split, line_no (from 0 in each file), text. UTF-8 files are split among tasks; of other charsets each file is decoded as a whole."""
    if charset.lower() in ("utf-8", "utf8"):
        raw = spark.read.option("pathGlobFilter", pattern).text(folder)
        # Rows of a split come in their order; splits are in the order of where they begin.
        rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
        size = rows.groupBy("file", "split").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))  # a row a split
        before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = size.select("file", "split", "least", before.alias("before"))
        return rows.join(at, ["file", "split"]).select("file", "split", (F.col("id") - F.col("least") + F.col("before")).alias("line_no"), F.regexp_replace("text", "^\ufeff", "").alias("text"))
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    text = F.regexp_replace(F.decode("content", charset), r"(\r\n|\r|\n)\z", "")
    rows = raw.select(F.col("path").alias("file"), F.posexplode(F.split(text, "\r\n|\r|\n")).alias("line_no", "text"))
    return rows.select("file", F.lit(0).cast("bigint").alias("split"), F.col("line_no").cast("bigint").alias("line_no"), "text")


def output_name(first_file: str, ngrams: int, cut_percent: float | None) -> str:
    """The name of a model's text file, after the largest file of the corpus."""
    stem, dot, ext = first_file.rpartition("/")[2].rpartition(".")
    stem, ext = (stem, dot + ext) if dot else (ext, "")
    return f"{stem}-({model_kind(ngrams, cut_percent)}){ext}"


def model_kind(ngrams: int, cut_percent: float | None) -> str:
    return f"{'ngram_1' if ngrams == 1 else f'ngrams_{ngrams}'}-cut_{0 if cut_percent is None else cut_percent:g}%"
