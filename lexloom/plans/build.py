"""A model from a folder of texts, and its file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import model as M
from ..sources import corpus
from ..sources import model_files as MF
from ..sources.shared import materialise


def build_from_folder(spark: SparkSession, folder: str, lang: str = "", n: int = 1, cut_percent: float | None = None, charset: str = "utf-8", tokenize=U.with_words, **filters) -> DataFrame:
    """lang, term, freq, prob of the .txt files in a folder, by the exact tokenizer or another that adds `words` to rows with text.

    n-grams go on over line ends, but not over files or words that the filters
    drop. A folder without such files, or one of them without a word that stays,
    is an error.
    """
    found = [r["path"] for r in corpus.files(spark, folder).collect()]
    if not found:
        raise ValueError(f"no .txt files in {folder}")
    words = materialise(tokenize(corpus.lines(spark, folder, charset=charset)).select("file", "split", "line_no", "words"), "build-words")
    some = F.exists("words", lambda w: M.kept(w, **filters))
    full = {r["file"].rpartition("/")[2] for r in words.filter(some).select("file").distinct().collect()}
    if empty := [p for p in found if _name(p) not in {_name(x) for x in full}]:
        raise ValueError(f"no words in {empty}")
    rows = words if n == 1 else M.with_carry(words, n)
    return M.build_ngrams(rows.withColumn("lang", F.lit(lang)), n, cut_percent, carry=None if n == 1 else "carry", **filters)


def _name(path: str) -> str:
    from urllib.parse import unquote

    return unquote(path).rpartition("/")[2]


def write_model(spark: SparkSession, folder: str, out: str, n: int = 1, cut_percent: float | None = None, **options) -> str:
    """Builds the model of a folder and writes it below `out` as text, named after the largest file; returns the path."""
    model = build_from_folder(spark, folder, n=n, cut_percent=cut_percent, **options)
    first = _name(corpus.files(spark, folder).first()["path"])
    path = f"{out.rstrip('/')}/{corpus.output_name(first, n, cut_percent)}"
    MF.write_text(model, path, f"'{first}' ({corpus.model_kind(n, cut_percent)})")
    return path
