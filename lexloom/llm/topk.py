"""Exact top-k search over binary codes by incremental multi-index hashing.

A code has a bit for each component of a vector: 1 if it is above zero. Codes
are cut into m segments; the index has an entry for each segment of each
distinct code, keyed by the segment's value. In round r each query that is still
open looks up, in each segment, the values at r differing bits; what it finds is
verified by the whole distance. After round r every code within
m * r + m - 1 of the query has been seen: a query is closed once its k-th
verified distance is no larger. Rounds go on until all are closed.

Entries lie in cells: a segment and the leading bits of its value, so many that
a cell of evenly spread codes has CELL entries at most; a cell with more is dealt
out in parts. A task builds one cell's table at a time and takes the queries
that are routed to it, which are those whose leading bits are near enough. Equal
codes are one class, known by its smallest id and its number of rows. A query
keeps k classes, those of the smallest distance and id, as no other class can be
in its result; so a task returns k for each query at most, ties or not.

Neighbours rank by distance, then id; the query's own row counts as one of all
rows. Rows with a null or empty vector, a null component or a null id are in no
result and ask nothing. Vectors of other lengths are never compared. Repeated
rows count as often as they are there. Other columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

K = 10
CELL = 32_768
#: Look-ups that a task works on at a time.
PROBES = 1 << 20
_SEGMENT_BITS = 24


def code_of(vector: Column) -> Column:
    """A string of 0 and 1, a character for each component."""
    return F.array_join(F.transform(vector, lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0"))), "")


def codes(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, code of each row that can be compared."""
    ok = F.col(id_col).isNotNull() & (F.coalesce(F.size(vector), F.lit(0)) > 0) & ~F.exists(F.col(vector), lambda x: x.isNull())
    return vectors.filter(ok).select(F.col(id_col).alias("id"), code_of(F.col(vector)).alias("code"))


def pack(texts: list[str]) -> np.ndarray:
    """Codes of one length as rows of 64-bit words."""
    bits = np.frombuffer("".join(texts).encode(), np.uint8).reshape(len(texts), -1) - 48
    pad = -bits.shape[1] % 64
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)).view(np.uint64)


class Layout:
    """How codes of one length are cut: segments, and the leading bits of each that tell its cell."""

    def __init__(self, bits: int, n: int, cell: int):
        m = max(1, min(bits, round(bits / max(np.log2(n + 1), 4))))
        self.bits, self.m = bits, max(m, -(-bits // _SEGMENT_BITS))
        self.edges = np.linspace(0, bits, self.m + 1).astype(int)
        self.widths = np.diff(self.edges)
        lead = int(np.ceil(np.log2(max(1, n / cell))))
        self.leads = np.minimum(lead, self.widths)

    def values(self, texts: list[str]) -> list[np.ndarray]:
        """By segment: the values of the codes' segments."""
        bits = (np.frombuffer("".join(texts).encode(), np.uint8).reshape(len(texts), -1) - 48).astype(np.int64)
        return [bits[:, a:b] @ (1 << np.arange(b - a)[::-1]) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def cell(self, j: int, lead: np.ndarray) -> np.ndarray:
        return (np.int64(self.bits) << 40) | (np.int64(j) << 32) | lead.astype(np.int64)


def masks(width: int, r: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), r)], np.int64)


class Cell:
    """The entries of a part of a cell, sorted by the value of their segment's other bits."""

    def __init__(self, layout: Layout, cell: int, texts: list[str], first: np.ndarray, rows: np.ndarray):
        self.layout, self.j = layout, cell >> 32 & 0xFF
        self.rest = int(layout.widths[self.j] - layout.leads[self.j])
        value = layout.values(texts)[self.j] & ((1 << self.rest) - 1)
        order = np.argsort(value, kind="stable")
        self.value, self.words, self.first, self.rows = value[order], pack(texts)[order], first[order], rows[order]
        self.texts = [texts[i] for i in order]
        self.start = np.searchsorted(self.value, np.arange((1 << self.rest) + 1)) if self.rest <= 16 else None

    def look_up(self, asked: list[str], far: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, entry, distance of the k best entries for each query, at `far` differing bits and within `limit`."""
        value = self.layout.values(asked)[self.j] & ((1 << self.rest) - 1)
        words, out = pack(asked), []
        for r in np.unique(far):
            if r > self.rest:
                continue
            at = np.flatnonzero(far == r)
            few = comb(self.rest, int(r)) <= len(self.value)
            mask = masks(self.rest, int(r)) if few else None
            step = max(1, PROBES // (len(mask) if few else len(self.value)))
            for i in range(0, len(at), step):
                q = at[i : i + step]
                if few:
                    probe = (value[q, None] ^ mask).ravel()
                    a, b = (self.start[probe], self.start[probe + 1]) if self.start is not None else (np.searchsorted(self.value, probe), np.searchsorted(self.value, probe, "right"))
                    n = b - a
                    some = np.flatnonzero(n)
                    who, n, a = np.repeat(q, len(mask))[some], n[some], a[some]
                    entry = np.repeat(a - n.cumsum() + n, n) + np.arange(n.sum())
                    who = np.repeat(who, n)
                else:  # there are more values at that radius than entries: those are gone through
                    who, entry = np.nonzero(np.bitwise_count(value[q, None] ^ self.value) == r)
                    who = q[who]
                d = np.bitwise_count(self.words[entry] ^ words[who]).sum(axis=1).astype(np.int64)
                near = d <= limit[who]
                out.append(best_of(who[near], entry[near], d[near], self.first, k))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))


def best_of(who: np.ndarray, entry: np.ndarray, d: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k of the smallest distance, then id, of each query."""
    order = np.lexsort((first[entry], d, who))
    who, entry, d = who[order], entry[order], d[order]
    begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, int)
    rank = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
    return who[rank < k], entry[rank < k], d[rank < k]


def _entries(classes: DataFrame, layouts: dict[int, Layout]) -> DataFrame:
    """cell, code, first_id, rows: an entry for each segment of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for bits in set(map(len, texts)):
                at = [i for i, t in enumerate(texts) if len(t) == bits]
                lay, part = layouts[bits], b.take(pa.array(at))
                for j, v in enumerate(lay.values([texts[i] for i in at])):
                    cell = lay.cell(j, v >> int(lay.widths[j] - lay.leads[j]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *part.columns], names=["cell", "code", "first_id", "rows"])

    return classes.select("code", "first_id", "rows").mapInArrow(run, "cell bigint, code string, first_id bigint, rows bigint")


def _routes(open_queries: DataFrame, layouts: dict[int, Layout], r: int) -> DataFrame:
    """cell, query, far, limit: each query at the cells whose leading bits differ in some of r bits; far: how many of the other bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for bits in set(map(len, texts)):
                at = [i for i, t in enumerate(texts) if len(t) == bits]
                lay, asked, limit = layouts[bits], pa.array([texts[i] for i in at]), b.column(1).take(pa.array(at))
                for j, v in enumerate(lay.values(asked.to_pylist())):
                    lead, rest = int(lay.leads[j]), int(lay.widths[j] - lay.leads[j])
                    for near in range(max(0, r - rest), min(r, lead) + 1):
                        for mask in masks(lead, near):
                            cell = lay.cell(j, (v >> rest) ^ mask)
                            yield pa.RecordBatch.from_arrays([pa.array(cell), asked, pa.array(np.full(len(at), r - near, np.int32)), limit], names=["cell", "query", "far", "limit"])

    return open_queries.select("query", "limit").mapInArrow(run, "cell bigint, query string, far int, limit int")


def search(index: DataFrame, queries: DataFrame, k: int = K, cell: int = CELL) -> DataFrame:
    """index, queries: id, code. Returns query_id, rank, neighbor_id, distance (k rows a query, or all there are)."""
    least = Window.partitionBy("code").orderBy("id")
    # Spark prunes to k rows a code before the exchange.
    members = materialise(index.select("id", "code").withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k), "topk-members")
    classes = members.groupBy("code").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    sizes = classes.groupBy(F.length("code").alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a length
    layouts = {r["bits"]: Layout(r["bits"], r["n"], cell) for r in sizes}
    entries = materialise(_entries(classes, layouts), "topk-entries")
    parts = materialise(entries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("parts")), "topk-cells")
    salt = F.pmod(F.xxhash64("code"), F.col("parts")).cast("int")
    dealt = materialise(entries.join(parts, "cell").select("cell", salt.alias("part"), "code", "first_id", "rows"), "topk-dealt")
    lengths = sorted(layouts)
    far_off = F.lit(1 << 30).cast("int")
    asked = queries.select(F.col("code").alias("query")).distinct().filter(F.length("query").isin(lengths)) if lengths else queries.select(F.col("code").alias("query")).limit(0)
    open_queries = materialise(asked.withColumn("limit", far_off), "topk-open")
    best = open_queries.select("query", F.lit("").alias("code"), F.lit(0).alias("distance"), F.lit(0).cast("bigint").alias("first_id"), F.lit(0).cast("bigint").alias("rows")).limit(0)
    widest = max((int(x.widths.max()) for x in layouts.values()), default=-1)
    covered = lambda r: F.create_map(*[F.lit(x) for b, lay in layouts.items() for x in (b, lay.m * r + lay.m - 1)])[F.length("query")]
    closest = Window.partitionBy("query").orderBy("distance", "first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of a part of a cell, then the queries that come to it."""
        now, held, table = None, [], None
        for b in batches:
            cells, part, asks = (b.column(i).to_numpy() for i in (0, 1, 2))
            cut = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1]), [True]]))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                key, rows = (int(cells[lo]), int(part[lo])), b.slice(lo, hi - lo)
                if key != now:
                    now, held, table = key, [], None
                if not asks[lo]:
                    held.append(rows)
                    continue
                if table is None:
                    if not held:
                        continue
                    whole = pa.Table.from_batches(held)
                    held = []
                    table = Cell(layouts[key[0] >> 40], key[0], whole["code"].to_pylist(), whole["first_id"].to_numpy(), whole["rows"].to_numpy())
                texts = rows.column(3).to_pylist()
                who, entry, d = table.look_up(texts, rows.column(6).to_numpy(), rows.column(7).to_numpy(), k)
                if len(who):
                    yield pa.RecordBatch.from_arrays([pa.array([texts[i] for i in who]), pa.array([table.texts[i] for i in entry]), pa.array(d, pa.int32()), pa.array(table.first[entry]), pa.array(table.rows[entry])], names=["query", "code", "distance", "first_id", "rows"])

    for r in range(widest + 1):
        # Some queries go to many parts of few cells: each part is a group of its own.
        routed = _routes(open_queries, layouts, r).join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        none = F.lit(None)
        sides = dealt.select("cell", "part", F.lit(0).alias("asks"), "code", "first_id", "rows", none.cast("int").alias("far"), none.cast("int").alias("limit")).unionAll(
            routed.select("cell", "part", F.lit(1).alias("asks"), "query", none.cast("bigint"), none.cast("bigint"), "far", "limit"))
        found = sides.repartition("cell", "part").sortWithinPartitions("cell", "part", "asks").mapInArrow(run, "query string, code string, distance int, first_id bigint, rows bigint")
        both = best.unionByName(found).dropDuplicates(["query", "code"])
        best = materialise(both.withColumn("place", F.row_number().over(closest)).filter(F.col("place") <= k).drop("place"), "topk-best")
        # The k-th row's distance: where the rows of the classes so far come to k.
        upto = best.withColumn("upto", F.sum("rows").over(closest.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("upto") >= k)
        kth = upto.groupBy("query").agg(F.min("distance").alias("kth"))
        left = open_queries.drop("limit").join(kth, "query", "left").filter(F.coalesce(F.col("kth"), far_off) > covered(r))
        open_queries = materialise(left.select("query", F.coalesce(F.col("kth"), far_off).alias("limit")), "topk-open")
        if open_queries.isEmpty():
            break
    nearest = Window.partitionBy("query").orderBy("distance", "id")
    near = best.select("query", "code", "distance").join(members.drop("n"), "code").withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    near = near.select("query", "rank", F.col("id").alias("neighbor_id"), "distance")
    return queries.join(near, F.col("code") == F.col("query")).select(F.col("id").alias("query_id"), "rank", "neighbor_id", "distance")

