"""Unigram and n-gram models from counts, all in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Words of a window that n-grams are made of at a time.
_WINDOW = 1 << 17


def clean_words(words: DataFrame, max_length: int = 100, clear_cyrillics: bool = False, clear_digits: bool = False, word: str = "word") -> DataFrame:
    """Drops long words and, if asked, those with Cyrillic letters or ASCII digits."""
    return words.filter(kept(F.col(word), max_length, clear_cyrillics, clear_digits))


def kept(w: Column, max_length: int = 100, clear_cyrillics: bool = False, clear_digits: bool = False) -> Column:
    ok = F.length(w) <= max_length
    if clear_cyrillics and clear_digits:
        return ok & ~T.has_cyrillics_or_digits(w)
    return ok & ~T.has_cyrillics(w) if clear_cyrillics else ok & ~T.has_digits(w) if clear_digits else ok


def counts(words: DataFrame, by: tuple[str, ...] = ("lang",), term: str = "term") -> DataFrame:
    """by..., term, freq. Spark adds up in each task before the exchange."""
    return words.groupBy(*by, term).agg(F.count(F.lit(1)).alias("freq"))


def gram_counts(tokens: DataFrame, n: int, by: tuple[str, ...] = ("lang",), words: str = "words", own: str | None = None) -> DataFrame:
    """by..., term, freq: the n-grams of 1 to n words of arrays, joined by a space; none goes over a null.

    `own` names a column with how many words at an array's end count as last
    words. Windows of words are joined and counted as Arrow arrays, so that a
    task hands on counts, and long arrays need no more memory than a window.
    """
    keys = [f"k{i}" for i in range(len(by))]
    last = F.size(words) if own is None else F.col(own)
    plain = tokens.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(words).alias("words"), last.cast("int").alias("own"))
    schema = ", ".join([*(f"{k} {plain.schema[k].dataType.simpleString()}" for k in keys), "term string, n bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keys))
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().cast(pa.large_string())
            row = np.repeat(np.arange(b.num_rows), size)
            first = np.repeat(np.cumsum(size) - pc.fill_null(b.column(len(keys) + 1), 0).to_numpy(zero_copy_only=False), size)
            for lo in range(0, len(flat), _WINDOW):
                part = flat.slice(lo, _WINDOW + n - 1)
                joined, found, where = part, [], []
                for k in range(1, min(n, len(part)) + 1):
                    if k > 1:
                        joined = pc.binary_join_element_wise(joined.slice(0, len(part) - k + 1), part.slice(k - 1), pa.scalar(" ", pa.large_string()))
                    at = np.arange(lo, min(lo + _WINDOW, lo + len(joined)))
                    end = at + k - 1
                    ok = (row[at] == row[end]) & (end >= first[end])
                    found.append(joined.slice(0, len(at)).filter(pa.array(ok)))
                    where.append(row[at[ok]])
                rows = pa.array(np.concatenate(where))
                table = pa.table([*(b.column(i).take(rows) for i in range(len(keys))), pa.chunked_array(found).combine_chunks()], names=[*keys, "term"])
                counted = table.filter(pc.is_valid(table["term"])).group_by([*keys, "term"], use_threads=False).aggregate([([], "count_all")])
                yield from counted.select([*keys, "term", "count_all"]).rename_columns([*keys, "term", "n"]).cast(pa.schema([*(b.schema.field(i).with_name(k) for i, k in enumerate(keys)), ("term", pa.string()), ("n", pa.int64())])).to_batches()

    counted = plain.mapInArrow(run, schema)
    return counted.groupBy(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "term").agg(F.sum("n").alias("freq"))


def with_carry(lines: DataFrame, n: int, file: str = "file", split: str = "split", line_no: str = "line_no", words: str = "words", out: str = "carry") -> DataFrame:
    """Adds the n - 1 words before each line in its file (fewer at its start).

    Lines go by their split of the file, so that no file is one task; what the
    splits hand on, n - 1 words each, is put in order by file. Lines without
    words are left out.
    """
    if n < 2:
        return lines.filter(F.size(words) > 0).withColumn(out, F.array().cast("array<string>"))
    tail = lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - n + 2), F.lit(n - 1))
    none = F.array().cast("array<string>")
    before = lambda w: tail(F.concat(*[F.coalesce(F.lag("_tail", k).over(w), none) for k in range(n - 1, 0, -1)]))
    held = lines.filter(F.size(words) > 0).withColumn("_tail", tail(F.col(words)))
    held = held.withColumn("_before", before(Window.partitionBy(file, split).orderBy(line_no)))
    # The last words of a split may be from several of its lines.
    last = held.groupBy(file, split).agg(F.max_by(tail(F.concat("_before", "_tail")), line_no).alias("_tail"))
    handed = last.select(F.col(file).alias("_file"), F.col(split).alias("_split"), before(Window.partitionBy(file).orderBy(split)).alias("_handed"))
    both = held.join(handed, (F.col(file) == F.col("_file")) & (F.col(split) == F.col("_split")))
    return both.withColumn(out, tail(F.concat("_handed", "_before"))).drop("_tail", "_before", "_file", "_split", "_handed")


def probabilities(freqs: DataFrame, cut_percent: float | None = None, by: tuple[str, ...] = ("lang",), totals: DataFrame | None = None) -> DataFrame:
    """by..., term, freq, prob: freq over the number of unigrams, the rare tail cut.

    Terms are in the order of freq (falling) and term. Those stay whose running
    sum is no more than the share to leave, (100 - cut_percent) of a hundred, of
    all counts; that threshold is a product of single-precision numbers.

    The running sum needs no order of single terms across the cluster: counts of
    one size are added up first, and only the size at which the sum crosses is
    put in order of its terms, by their beginnings first (`first_terms`). What is
    known of a group is one row (a language's), which is broadcast, so that no
    group's terms, or those of one count, go to one task.
    """
    if cut_percent is None or totals is not None:
        total = (freqs if totals is None else totals).groupBy(*by).agg(F.sum("freq").alias("_words"))
    if cut_percent is None:
        return freqs.join(F.broadcast(total), list(by)).select(*by, "term", "freq", (F.col("freq") / F.col("_words")).alias("prob"))
    leave = 100 - cut_percent
    sizes = freqs.groupBy(*by, "freq").agg(F.count(F.lit(1)).alias("_n"))  # distinct counts are few
    order = Window.partitionBy(*by).orderBy(F.desc("freq"))
    mass = F.col("_n") * F.col("freq")
    everything = Window.partitionBy(*by)
    limit = (F.sum(mass).over(everything).cast("float") * F.lit(leave).cast("float")).cast("double") / 100
    upto = sizes.withColumn("_sum", F.sum(mass).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_limit", limit)
    # How many terms of this count fit: all, some, or none; all of a count fit only if all of the greater ones do.
    room = F.floor((F.col("_limit") - (F.col("_sum") - mass)) / F.col("freq"))
    upto = upto.withColumn("_room", F.greatest(F.lit(0), F.least(F.col("_n"), room)))
    some = (F.col("_room") > 0) & (F.col("_room") < F.col("_n"))  # one count a group at most
    known = upto.groupBy(*by).agg(F.sum(mass).alias("_words"), F.min(F.when(F.col("_room") == F.col("_n"), F.col("freq"))).alias("_whole"), F.max(F.when(some, F.col("freq"))).alias("_some"), F.max(F.when(some, F.col("_room"))).alias("_room"))
    if totals is not None:
        known = known.drop("_words").join(F.broadcast(total), list(by))
    marked = freqs.join(F.broadcast(known), list(by))
    prob = (F.col("freq") / F.col("_words")).alias("prob")
    whole = marked.filter(F.col("freq") >= F.col("_whole")).select(*by, "term", "freq", prob)
    ranked = first_terms(marked.filter(F.col("freq") == F.col("_some")).select(*by, "term", "freq", "_words", "_room"), by)
    return whole.unionByName(ranked.select(*by, "term", "freq", prob))


def first_terms(terms: DataFrame, by: tuple[str, ...], room: str = "_room", lengths: tuple[int, ...] = (3, 6)) -> DataFrame:
    """The first terms of each group, as many as `room` (of one value in a group) says.

    Terms are counted by their first characters, so that whole beginnings are in
    or out; only those of the beginning at which the count crosses are counted by
    longer ones, and at last put in order.
    """
    done, left = [], terms.withColumn("_left", F.col(room))
    for n in lengths:
        begin = F.left(F.col("term"), F.lit(n))
        counted = left.groupBy(*by, begin.alias("_begin")).agg(F.count(F.lit(1)).alias("_n"), F.first("_left").alias("_left"))
        upto = counted.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_begin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        # The last beginning that some room is left for.
        cross = upto.filter(F.col("_before") < F.col("_left")).groupBy(*by).agg(F.max("_begin").alias("_cross"), F.max_by(F.col("_left") - F.col("_before"), "_begin").alias("_rest"))
        both = left.join(F.broadcast(cross), list(by))
        done.append(both.filter(begin < F.col("_cross")).select(*terms.columns))
        left = both.filter(begin == F.col("_cross")).select(*terms.columns, F.col("_rest").alias("_left"))
    last = left.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("term"))).filter("_r <= _left").select(*terms.columns)
    for more in done:
        last = last.unionByName(more)
    return last


def places(model: DataFrame) -> DataFrame:
    """Adds `place`: the number of each record of a language by falling probability and rising term.

    Records are numbered within a probability and the term's first characters;
    only the numbers of these go through one task a language.
    """
    keys = ["lang", "prob", "_begin"]
    marked = model.withColumn("_begin", F.left("term", F.lit(3)))
    order = Window.partitionBy("lang").orderBy(F.desc("prob"), "_begin").rowsBetween(Window.unboundedPreceding, 0)
    before = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(order) - F.col("_n")).drop("_n")
    before = before.select(*[F.col(k).alias(f"_{k}_") for k in keys], "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys]
    found = marked.join(before, same).withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy("term")) + F.col("_before")).cast("int"))
    return found.select(*model.columns, "place")


def build(words: DataFrame, cut_percent: float | None = None, by: tuple[str, ...] = ("lang",), **filters) -> DataFrame:
    """A unigram model from by..., word; no words, no rows."""
    return probabilities(counts(words.filter(kept(F.col("word"), **filters)).withColumnRenamed("word", "term"), by), cut_percent, by)


def build_ngrams(tokens: DataFrame, n: int, cut_percent: float | None = None, by: tuple[str, ...] = ("lang",), words: str = "words", carry: str | None = None, **filters) -> DataFrame:
    """A model of 1 to n words from by..., words: an array a document, or a line with what is carried into it.

    Words that the filters drop break the history. Nothing is shuffled but counts.
    """
    only = lambda c: F.transform(c, lambda w: F.when(kept(w, **filters), w))
    every = only(F.col(words)) if carry is None else only(F.concat(carry, words))
    ready = tokens.select(*by, every.alias("_words"), F.size(words).alias("_own"))
    size = F.size(F.filter(F.col(words), lambda w: kept(w, **filters)))
    return probabilities(gram_counts(ready, n, by, "_words", "_own"), cut_percent, by, tokens.groupBy(*by).agg(F.sum(size).alias("freq")))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """lang, term, prob_a, prob_b of all records in which two models differ."""
    left, right = a.select("lang", "term", F.col("prob").alias("prob_a")), b.select("lang", "term", F.col("prob").alias("prob_b"))
    return left.join(right, ["lang", "term"], "full").filter(~F.col("prob_a").eqNullSafe(F.col("prob_b")))


def require_unique(model: DataFrame) -> DataFrame:
    """The model; evaluating it fails if a term is there twice."""
    n = F.count(F.lit(1))
    return model.groupBy("lang", "term").agg(F.max("prob").alias("prob"), n.alias("_n")).select(
        "lang", "term", F.when(F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate term: "), F.col("term"))).isNull(), F.col("prob")).alias("prob"))


def first_wins(shards: DataFrame) -> DataFrame:
    """lang, term, prob from shard_no, pos, lang, term, prob: the first record of each term."""
    first = F.min(F.struct("shard_no", "pos", "prob"))
    return shards.groupBy("lang", "term").agg(first.alias("_f")).select("lang", "term", F.col("_f.prob").alias("prob"))
