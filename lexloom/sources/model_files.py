"""Models as text files, as Parquet, and as binary shards."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_upper, is_blank, trim_text
from . import corpus

#: A number without a sign.
NUMBER = r"^(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_line(line: Column) -> Column:
    """term, prob of a line `term TAB probability`; anything else is an error.

    Probabilities are read in single precision and widened.
    """
    parts = F.filter(F.split(line, "\t"), lambda x: x != "")
    term, prob = F.trim(F.try_element_at(parts, F.lit(1))), F.trim(F.try_element_at(parts, F.lit(2)))
    ok = (F.size(parts) == 2) & ~is_blank(term) & prob.rlike(NUMBER)
    value = F.struct(term.alias("term"), prob.cast("float").cast("double").alias("prob"))
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit("wrong line in a model: "), F.coalesce(line, F.lit("null")))))


def paths_of(setting: str, folder: str = "") -> list[str]:
    """The paths of a setting, cut at semicolons and trimmed; empty ones are dropped, of those that differ in case alone the first stays."""
    names = [x.strip() for x in setting.split(";")]
    paths = [f"{folder.rstrip('/')}/{x}" if folder else x for x in names if x]
    return [p for i, p in enumerate(paths) if p.lower() not in {q.lower() for q in paths[:i]}]


def _records(spark: SparkSession, path: str, trim: bool = False) -> DataFrame:
    """line: those of each file from the first on that isn't a comment; comments after it are data. Large files are split among tasks.

    `trim` takes white space off the lines' ends and drops those without anything else.
    """
    lines = corpus.lines(spark, path, "*").select("file", "line_no", F.col("text").alias("line"))
    if trim:
        lines = lines.withColumn("line", trim_text(F.col("line"))).filter("line <> ''")
    data = lines.filter(~F.startswith("line", F.lit("#")))
    first = data.groupBy(F.col("file").alias("first_file")).agg(F.min("line_no").alias("first"))  # a row a file
    return lines.join(first, (F.col("file") == F.col("first_file")) & (F.col("line_no") >= F.col("first"))).select("line")


def read_text(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """lang, term, prob. Lines that start with # are skipped before the first record of a file only."""
    return _records(spark, path).select(F.lit(lang).cast("string").alias("lang"), parse_line(F.col("line")).alias("r")).select("lang", "r.term", "r.prob")


def read_text_folded(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """As read_text, in double precision and with upper-cased terms; lines are trimmed, blank ones skipped, and cut at their first tab. Others without a term and a probability are an error."""
    line = F.col("line")
    cut = F.instr(line, "\t")
    term, prob = trim_text(F.substring(line, F.lit(1), cut - 1)), trim_text(F.substring(line, cut + 1, F.length(line)))
    ok = (cut > 1) & (term != "") & prob.rlike(NUMBER)
    value = F.struct(fold_upper(term).alias("term"), prob.cast("double").alias("prob"))
    parsed = F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit("wrong line in a model: "), line)))
    return _records(spark, path, trim=True).select(F.lit(lang).cast("string").alias("lang"), parsed.alias("r")).select("lang", "r.term", "r.prob")


def write_text(model: DataFrame, path: str, header: str) -> None:
    """One file: the header line, then the records by falling probability and rising term, without those of 0."""
    body = model.filter("prob > 0").select("prob", "term", F.concat_ws("\t", "term", F.col("prob").cast("string")).alias("value"))
    head = model.sparkSession.createDataFrame([(float("inf"), "", f"#\t{header}")], "prob double, term string, value string")
    body.unionByName(head).orderBy(F.desc("prob"), "term").select("value").coalesce(1).write.text(path)


def write_parquet(model: DataFrame, path: str, shard_bytes: int = 0) -> None:
    """Partitioned by language; a file has about shard_bytes of records (0: no limit). An empty model is an error."""
    if model.isEmpty():
        raise ValueError("the model is empty")
    w = model.write.mode("overwrite").partitionBy("lang")
    if shard_bytes:
        mean = model.agg(F.avg(2 * F.length("term") + 10)).first()[0]
        w = w.option("maxRecordsPerFile", max(1, int(shard_bytes / mean)))
    w.parquet(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Paths that differ in case alone are one."""
    return spark.read.parquet(*{p.lower(): p for p in reversed(paths)}.values()).select("lang", "term", "prob")


def encode_record(term: str, prob: float) -> bytes:
    """A binary record: UTF-16 characters, a zero character, eight bytes of probability."""
    return term.encode("utf-16-le") + b"\0\0" + struct.pack("<d", prob)


def write_shards(model: DataFrame, folder: str, name: str, limit_bytes: int = 0) -> list[str]:
    """Writes the records by falling probability and rising term to <name>-1.bin, -2.bin and so on; returns the paths.

    A file ends with the record that takes it to limit_bytes (0: no limit); a
    single file has no number. An empty model is an error. Files of these names
    are replaced. A shard at a time goes through the driver.
    """
    spark = model.sparkSession
    jvm = spark._jvm

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()
        for b in batches:
            for term, prob in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                held += encode_record(term, prob)
                if 0 < limit_bytes <= len(held):
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], names=["content"])
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], names=["content"])

    # Where a file ends depends on all records before it: the ordered records go through one task, which holds one file.
    ordered = model.select("term", "prob").orderBy(F.desc("prob"), "term").coalesce(1)
    paths: list[str] = []
    for row in ordered.mapInArrow(cut, "content binary").toLocalIterator():
        paths.append(f"{folder.rstrip('/')}/{name}-{len(paths) + 1}.bin")
        path = jvm.org.apache.hadoop.fs.Path(paths[-1])
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(row["content"]))
        out.close()
    if not paths:
        raise ValueError("the model is empty")
    if len(paths) == 1:
        single = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.bin")
        files = single.getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(single, False)
        files.rename(jvm.org.apache.hadoop.fs.Path(paths[0]), single)
        paths = [f"{folder.rstrip('/')}/{name}.bin"]
    return paths


def decode_shard(content: bytes) -> Iterator[tuple[str, float]]:
    at = 0
    while at < len(content):
        end = at
        while content[end : end + 2] != b"\0\0":
            if end >= len(content):
                raise ValueError("a record is not whole")
            end += 2
        yield content[at:end].decode("utf-16-le"), struct.unpack_from("<d", content, end + 2)[0]
        at = end + 10


def read_shards(spark: SparkSession, path: str, lang: str | None = None, pattern: str = "*.bin") -> DataFrame:
    """shard_no, pos, lang, term, prob of binary shards; shards count in the order of their names."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(decode_shard(content))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array([t for t, _ in rows]), pa.array([p for _, p in rows], pa.float64())], names=["shard_no", "pos", "term", "prob"])

    return found.select("path", "content").mapInArrow(run, "shard_no string, pos bigint, term string, prob double").withColumn("lang", F.lit(lang).cast("string"))
