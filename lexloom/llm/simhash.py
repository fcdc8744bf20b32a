"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints at 3 or fewer differing bits are linked. Equal fingerprints are
one class first, so copies cost nothing further. Fingerprints are cut into m
segments; two linked ones agree in m - 3 of them at least, so each fingerprint
is dealt out once for each choice of m - 3 segments, keyed by their values. m
rises with the number of classes (4 to 6: keys of 16, 25 and 31 bits), so that
keys of evenly spread fingerprints stay small. Within a key the fingerprints are
sorted by Gray rank and a hierarchical index is built over them: a node holds
the bits on which all below it agree, an upper node those shared by its
children. A search goes down from the root with the differences in the shared
bits added up, each bit at the highest node that shares it; where they exceed 3
the whole group is pruned. A group already tied to the searching fingerprint is
pruned too, as only components are wanted: a cell returns spanning links, never
all pairs.

A key with over BLOCK fingerprints is dealt out again by the bits outside it:
of four parts of those two linked fingerprints agree in one. What is still over
BLOCK is dealt out as pairs of blocks, so that no task holds an unbounded group;
no link is lost.

A null text, or one without words, has fingerprint zero and is linked like any
other. Rows with equal ids and null ids stay rows of their own; a null id is
never a component's id unless all ids of the component are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import cols, fresh, map_columns, materialise

SHINGLE = 3
DISTANCE = 3
BLOCK = 4096
#: Segments, and how many classes they are for: 256 in each key of evenly spread ones.
SEGMENTS = {4: 1 << 24, 5: 1 << 33}
MOST_SEGMENTS = 6
#: Children of a node.
FAN = 8


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    ends = starts + size
    n = max(len(words) - width + 1, 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit number."""

    def run(texts: list[str | None]) -> list[pa.Array]:
        v = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
        return [pa.array(v.view(np.int64))]

    return map_columns(docs, [text], f"{out} bigint", run, keep)


def gray_rank(v: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in Gray order."""
    v = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(s)
    return v


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; the last level is the root's."""

    def __init__(self, sorted_fps: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # pattern, residual mask
        pattern, shared = sorted_fps, np.full(len(sorted_fps), ~np.uint64(0))
        full = [shared]
        patterns = [pattern]
        while len(pattern) > 1:
            at = np.arange(0, len(pattern), FAN)
            high, low = np.bitwise_or.reduceat(pattern, at), np.bitwise_and.reduceat(pattern, at)
            mask = np.bitwise_and.reduceat(shared, at) & ~(high ^ low)
            pattern, shared = low & mask, mask
            patterns.append(pattern)
            full.append(shared)
        for i, (p, m) in enumerate(zip(patterns, full, strict=True)):
            above = np.repeat(full[i + 1], FAN)[: len(m)] if i + 1 < len(full) else np.zeros(len(m), np.uint64)
            self.levels.append((p, m & ~above))  # a shared bit counts once, at the highest node

    def search(self, q: np.ndarray, who: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, fingerprint) within DISTANCE, but for those tied already. comp: each fingerprint's component."""
        one = [comp]
        for _ in self.levels[1:]:
            at = np.arange(0, len(one[-1]), FAN)
            low, high = np.minimum.reduceat(one[-1], at), np.maximum.reduceat(one[-1], at)
            one.append(np.where(low == high, low, -1))
            one[-1][np.minimum.reduceat(one[-2], at) < 0] = -1
        a, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        diff = np.zeros(len(q), np.uint8)
        for level in range(len(self.levels) - 1, -1, -1):
            p, m = self.levels[level]
            diff = diff + np.bitwise_count((q[a] ^ p[node]) & m[node])
            live = (diff <= DISTANCE) & (one[level][node] != comp[who[a]])
            a, node, diff = a[live], node[live], diff[live]
            if level:
                size = len(self.levels[level - 1][0])
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                a, diff = np.repeat(a, FAN), np.repeat(diff, FAN)
                there = node < size
                a, node, diff = a[there], node[there], diff[there]
        return who[a], node


class Union:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True

    def flat(self) -> np.ndarray:
        while (self.parent != self.parent[self.parent]).any():
            self.parent = self.parent[self.parent]
        return self.parent.copy()


def links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of the graph of distinct fingerprints within DISTANCE."""
    n, out = len(fps), []
    if n == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= DISTANCE else []
    order = np.argsort(gray_rank(fps), kind="stable")
    s, uf = fps[order], Union(n)

    def tie(i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if uf.join(x, y):
                out.append((int(order[x]), int(order[y])))

    for step in (1, 2, 3):  # neighbours in Gray order, which ties most of a dense group at once
        near = np.flatnonzero(np.bitwise_count(s[step:] ^ s[:-step]) <= DISTANCE)
        tie(near, near + step)
    if n > 4:
        index, block = GrayIndex(s), 256
        for i in range(0, n, block):
            who = np.arange(i, min(i + block, n))
            tie(*index.search(s[who], who, uf.flat()))
    else:
        i, j = np.triu_indices(n, 1)
        near = np.bitwise_count(s[i] ^ s[j]) <= DISTANCE
        tie(i[near], j[near])
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp) sorted by cell: the links of each cell."""
    rest: tuple[np.ndarray, np.ndarray] | None = None

    def solve(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        u, v = [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a > 1:
                part = fp[a:b]
                for i, j in links(part.view(np.uint64)):
                    u.append(int(part[i]))
                    v.append(int(part[j]))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for b in batches:
        cell, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
        if rest:
            cell, fp = np.concatenate([rest[0], cell]), np.concatenate([rest[1], fp])
        if not len(cell):
            continue
        whole = int(np.searchsorted(cell, cell[-1])) if (cell[1:] >= cell[:-1]).all() else int(np.flatnonzero(cell != cell[-1])[-1]) + 1
        if whole:
            yield solve(cell[:whole], fp[:whole])
        rest = cell[whole:], fp[whole:]
    if rest and len(rest[0]):
        yield solve(*rest)


def _joined(parts: list[tuple[Column, int]]) -> Column:
    """Values and their numbers of bits as one number."""
    out = F.lit(0).cast("bigint")
    for v, width in parts:
        out = F.shiftleft(out, width).bitwiseOR(v)
    return out


def _bits(v: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(v, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _keys(segments: int) -> list[tuple[Column, Column, int]]:
    """For each choice of segments: the cell, the other bits, and how many those are."""
    edges = [64 * i // segments for i in range(segments + 1)]
    one = [(_bits(F.col("fp"), a, b - a), b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    out = []
    for i, same in enumerate(combinations(range(segments), segments - DISTANCE)):
        others = [one[k] for k in range(segments) if k not in same]
        out.append((_joined([one[k] for k in same]) + F.lit(i << 40).cast("bigint"), _joined(others), sum(w for _, w in others)))
    return out


def _hot(dealt: DataFrame, block: int) -> DataFrame:
    """cell and blocks of each cell with over `block` fingerprints: no more than rows / block."""
    hot = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    return materialise(hot.select(F.col("cell").alias("hot_cell"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "simhash-hot")


def link_classes(classes: DataFrame, block: int = BLOCK, segments: int | None = None) -> DataFrame:
    """classes: distinct fp. Spanning links u, v among them (each cell gives its own)."""
    if segments is None:
        n = classes.count()
        segments = next((m for m, most in SEGMENTS.items() if n <= most), MOST_SEGMENTS)
    keys = _keys(segments)
    width = max(w for _, _, w in keys)
    dealt = classes.select("fp", F.explode(F.array(*[F.struct(cell.alias("cell"), rest.alias("rest")) for cell, rest, _ in keys])).alias("x")).select("fp", "x.cell", "x.rest")
    cells = dealt.select("cell", "fp")
    hot = _hot(dealt, block)
    if not hot.isEmpty():
        parts = [width * i // (DISTANCE + 1) for i in range(DISTANCE + 2)]
        both = dealt.join(hot, F.col("cell") == F.col("hot_cell"), "left")
        plain = both.filter("blocks is null").select("cell", "fp")
        # A clash of cells would only add true links.
        again = F.array(*[F.xxhash64("cell", F.lit(i), _bits(F.col("rest"), a, b - a)) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True))])
        dealt = materialise(both.filter("blocks is not null").select("fp", F.explode(again).alias("cell")), "simhash-again")
        hot = _hot(dealt, block)
        both = dealt.join(hot, F.col("cell") == F.col("hot_cell"), "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        split = both.filter("blocks is not null").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
        cells = plain.unionAll(both.filter("blocks is null").select("cell", "fp")).unionAll(split.select(F.xxhash64("cell", pair).alias("cell"), "fp"))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells, "u bigint, v bigint")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of each row of docs."""
    signed = materialise(fingerprints(docs, keep=["doc_id"]), "simhash-fp")
    return signed.join(class_components(signed), "fp").select("doc_id", "fp", "component_id")


def class_components(signed: DataFrame) -> DataFrame:
    """signed: doc_id, fp. Returns fp, component_id and root for each distinct fp.

    root is a fingerprint of the component: unlike an id it is never null, and no two components share it.
    """
    classes = materialise(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = graph.components(link_classes(classes.select("fp")), "simhash-links")
    tied = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return materialise(tied.join(least, "root").select("fp", "component_id", "root"), "simhash-components")


def hex_of(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with its columns as they were.

    That is the row of the smallest id (null ids last); of rows with equal ids
    the one that Spark's min picks by the rest of its key: fingerprint, then hash.
    Texts are shuffled once, for the join. Rows equal in id, text, source and
    language are told by 128 bits of hash; copies of such a row are folded in
    each task before the shuffle, so none of them gathers in one task.
    """
    fp, a, b = fresh(docs, "simhash_fp"), fresh(docs, "simhash_a"), fresh(docs, "simhash_b")
    known = [F.col(c) for c in ("doc_id", "text", "source", "lang") if c in docs.columns]
    parts_of = [*known, *(c.isNull() for c in known)]  # the hash skips nulls
    marked = docs.withColumn(a, F.xxhash64(*parts_of)).withColumn(b, F.xxhash64(F.lit(1), *parts_of))
    slim = fingerprints(marked, keep=["doc_id", a, b], out=fp).select("doc_id", F.col(fp).alias("fp"), F.col(a).alias("a"), F.col(b).alias("b"))
    slim = materialise(slim, "simhash-fp")
    parts = class_components(slim.select("doc_id", "fp")).withColumnRenamed("fp", "class_fp")
    joined = slim.join(parts, F.col("fp") == F.col("class_fp"))
    first = joined.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "a", "b")).alias("k"))
    best = first.select(F.col("k.a").alias(f"best_{a}"), F.col("k.b").alias(f"best_{b}"))
    same = (F.col(a) == F.col(f"best_{a}")) & (F.col(b) == F.col(f"best_{b}"))
    return marked.dropDuplicates([a, b]).join(best, same, "left_semi").select(*cols(docs.columns))
