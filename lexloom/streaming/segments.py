"""Segmentation and term counting of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_upper, simple_tokens
from ..operators import segment as S


def segment_stream(stream: DataFrame, model, text: str = "text", langs: list[str] | None = None) -> DataFrame:
    """The best result of each row; rows are on their own, so there is no state."""
    return S.segment(stream, model, text, langs, out="best", give="best")


def term_counts(stream: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour", text: str = "text", by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """Counts of terms in windows of event time; state is dropped once the watermark is past a window."""
    words = stream.withWatermark(time, late).select(F.col(time), *by, F.explode(simple_tokens(fold_upper(F.col(text)))).alias("term"))
    return words.groupBy(F.window(time, window).alias("window"), *by, "term").agg(F.count(F.lit(1)).alias("freq"))
