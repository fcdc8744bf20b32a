"""Mixing sources to target weights.

Words are counted by source. The total to take, a share of all words, goes to
sources by weight; no source gets over CAP times its words, and what is above
goes to the others by weight again. That is one level of water: with sources in
the order of cap / weight, the level is what the total less the caps before a
source gives a unit of the weight from it on, at its largest.

A document is taken floor(rate) times, and once more with the fraction as
probability. The draws are balanced, so that small sources come near their
targets too. Documents of like sizes are a class of their source; classes go
from the largest sizes to the smallest. A class gets as many further copies as
bring the words expected so far to what the fraction wants of the words so far,
rounded up or down by a hash of source and class; a document of the class gets
one if a hash of its source and id, seen as a number from 0 to 1, is below the
class's share of them. Over like documents the chance of a further copy is the
fraction; a document that is much of its source by itself shifts the chances of
the smaller ones, for which the words come out as wanted.

A null text has size 0; a null source is a source of its own, the last one.
Equal rows are taken alike. A source without words has rate 0. Very long texts
count whole. No document is taken more than CAP times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cols, fresh, materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
#: Sizes of so many leading bits in common are a class.
BITS = 9


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def class_of(size: Column) -> Column:
    """A number that rises with the size: how many bits it has, and the leading ones."""
    n = F.length(F.bin(size))
    return ((n * (1 << BITS)).cast("long") + F.call_function("shiftright", size, F.greatest(F.lit(0), n - BITS))).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target: from a row for each source (source, source_size).

    The windows are over the table of sources alone, one row for each.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(rank) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), kind.cast("int") + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", cap * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    fits = ranked.withColumn("level", level)
    # It rises while sources ahead are above the water and falls after: the level is the largest.
    fits = fits.withColumn("level", F.max("level").over(everything))
    even = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return fits.select("source", "source_size", F.coalesce(even, F.col("cap").cast("double")).alias("target"))


def fraction(*parts: Column) -> Column:
    """A number from 0 to below 1 that is always the same for the same parts."""
    text = F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def rates(sized: DataFrame, **options) -> DataFrame:
    """source, class, source_size, target, whole, part, from source, size: of all documents' copies, and of the class's documents that get one more."""
    counted = materialise(sized.groupBy("source", class_of(F.col("size")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-classes")
    each = F.struct((-F.col("class")).alias("below"), "n", "words", fraction(F.col("source"), F.col("class")).alias("u"))
    # Up to 256 classes each time sizes double: some thousands in a row at most.
    by_source = counted.groupBy("source").agg(F.sum("words").alias("source_size"), F.sort_array(F.collect_list(each)).alias("classes")).withColumnRenamed("source", "own")
    goal = targets(by_source.select(F.col("own").alias("source"), "source_size"), **options)
    both = goal.join(by_source.select("own", "classes"), F.col("source").eqNullSafe(F.col("own")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    both = both.withColumn("whole", F.floor(rate)).withColumn("more", rate - F.floor(rate))

    def draw(acc: Column, x: Column) -> Column:
        want = acc["want"] + F.col("more") * x["words"]
        mean = x["words"] / x["n"]
        some = F.when(x["words"] > 0, F.least(x["n"], F.greatest(F.lit(0), F.floor((want - acc["got"]) / mean + x["u"])))).otherwise(0).cast("long")
        out = F.concat(acc["out"], F.array(F.struct((-x["below"]).alias("class"), (some / x["n"]).alias("part"))))
        return F.struct(want.alias("want"), (acc["got"] + some * F.when(x["words"] > 0, mean).otherwise(0.0)).alias("got"), out.alias("out"))

    zero = F.struct(F.lit(0.0).alias("want"), F.lit(0.0).alias("got"), F.array().cast("array<struct<class:int,part:double>>").alias("out"))
    drawn = both.select("source", "source_size", "target", "whole", F.explode(F.aggregate("classes", zero, draw)["out"]).alias("x"))
    return materialise(drawn.select("source", "x.class", "source_size", "target", "whole", "x.part"), "mix-rates")


def copies(doc_id: Column, source: Column, whole: Column, part: Column) -> Column:
    return whole + F.when(fraction(source, doc_id) < part, 1).otherwise(0)


def plan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of each document; other columns are left out."""
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    goal = rates(sized.select("source", "size"), **options).withColumnsRenamed({"source": "goal_source", "class": "goal_class"})
    both = sized.join(goal, F.col("source").eqNullSafe(F.col("goal_source")) & (class_of(F.col("size")) == F.col("goal_class")))
    both = both.withColumn("copies", copies(F.col("doc_id"), F.col("source"), F.col("whole"), F.col("part")))
    return both.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the mix takes it, with their columns as they were."""
    goal = rates(docs.select("source", size_of(F.col("text")).alias("size")), **options)
    names = [fresh(docs, f"goal_{c}") for c in ("source", "class", "size", "target", "whole", "part")]
    n, size = fresh(docs, "goal_copies"), fresh(docs, "doc_size")
    goal = goal.toDF(*names)
    sized = docs.withColumn(size, size_of(F.col("text")))  # counted once, as the class looks at it several times
    both = sized.join(goal, F.col("source").eqNullSafe(F.col(names[0])) & (class_of(F.col(size)) == F.col(names[1])))
    times = copies(F.col("doc_id"), F.col("source"), F.col(names[4]), F.col(names[5]))
    return both.withColumn(n, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*cols(docs.columns))
