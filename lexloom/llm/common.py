"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialise, release, shared_dir

__all__ = ["SLICE", "WORD", "cols", "crc_mod", "fresh", "held_out", "map_columns", "materialise", "release", "shared_dir", "table"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch that are Python objects at a time.
SLICE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cols(names: list[str]) -> list[Column]:
    """Columns by name, whatever characters those have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in names]


def crc_mod(col: str = "doc_id", n: int = 4) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def held_out(col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(col) == 2, F.lit(False))


def map_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: str,
    fn: Callable[..., list[pa.Array]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds columns made by fn from Arrow batches; rows keep their place.

    fn takes the input columns as Python lists and returns one Arrow array a
    column of `outputs` (a DDL string). `keep` names the columns to carry; an
    output whose name one of them has gets underscores in front of it.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    keep = df.columns if keep is None else keep
    added = _parse_datatype_string(outputs)
    fields = [df.schema[c] for c in keep]
    for f in added.fields:
        taken = {x.name.lower() for x in fields}
        while f.name.lower() in taken:
            f.name = f"_{f.name}"
        fields.append(f)
    schema = StructType(fields)
    names = [f.name for f in schema.fields]

    need = list(dict.fromkeys([*keep, *inputs]))
    at = {c: i for i, c in enumerate(need)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            new = fn(*[b.column(at[c]).to_pylist() for c in inputs])
            old = [b.column(at[c]) for c in keep]
            yield pa.RecordBatch.from_arrays([*old, *new], names=names)

    # mapInArrow takes plain names alone.
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols(need))]).mapInArrow(run, schema)
