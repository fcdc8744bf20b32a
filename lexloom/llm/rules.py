"""Quality rules: a decision list learned by sequential covering.

Each rule is a conjunction of thresholds on document statistics. It is grown by
information gain on two thirds of the sample and pruned on the rest; the rows
that it covers are taken out before the next one is grown. The list becomes one
Spark CASE expression over the statistics. Rules tell bad documents; what no
rule covers is kept. Without labels of both kinds there are no rules.

Base statistics follow the contract in textstats, over whole texts of any length;
a null text counts as empty. The learner sees a sample of labelled rows, about
SAMPLE_ROWS of them by a hash of the id; everything else is over all rows. Rows
with a null id are judged, but not learned from; an id with several labels or
rows counts once for each pair of them; equal rows get equal verdicts. Of
conditions of equal gain the first by name and value counts. Other columns are
left out by judge and kept by accept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textstats
from .common import cols, fresh, held_out, map_columns, materialise

SAMPLE_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS = 12, 4
#: A rule must be right about so large a share of the rows that it covers.
PRECISION = 0.9
INPUTS = tuple(n for n in textstats.RATIOS if n not in ("log_words", "log_chars"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # value >= at, or else value <= at
    at: float

    def column(self, of: Callable[[str], Column] = F.col) -> Column:
        return of(self.name) >= self.at if self.above else of(self.name) <= self.at

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.at if self.above else x[self.name] <= self.at

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.at:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the condition of the largest gain until only bad rows are covered."""
    rule: list[Condition] = []
    now = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (now & ~bad).any() and (now & bad).any():
        p, n = (now & bad).sum(), (now & ~bad).sum()
        best: tuple[float, Condition | None] = (1e-9, None)
        for name, v in x.items():
            order = np.argsort(v[now], kind="stable")
            s, b = v[now][order], bad[now][order]
            cut = np.flatnonzero(s[1:] > s[:-1])  # between cut and cut + 1
            if not len(cut):
                continue
            pos, tot = np.cumsum(b)[cut], cut + 1
            for above in (False, True):
                p1 = p - pos if above else pos
                n1 = (p + n - tot if above else tot) - p1
                gain = p1 * (np.log2((p1 + 1e-9) / (p1 + n1)) - np.log2(p / (p + n)))
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = float(gain[k]), Condition(name, above, float((s[cut[k]] + s[cut[k] + 1]) / 2))
        if best[1] is None:
            break
        rule.append(best[1])
        now &= best[1].holds(x)
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drops conditions from the end while that is no worse on rows not grown on."""

    def worth(r: Rule) -> float:
        c = covers(r, x)
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray) -> list[Rule]:
    """part: True for the rows to grow on; the others prune."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (left & bad).sum() >= 3:
        sub = lambda m: {k: v[m] for k, v in x.items()}
        # Where the part to grow on has too few bad rows left, all that are left serve.
        some = left & part if (left & part & bad).sum() >= 3 else left
        rule = grow(sub(some), bad[some])
        if not rule:
            break
        if (left & ~part & bad).any():
            rule = prune(rule, sub(left & ~part), bad[left & ~part])
        c = covers(rule, x) & left
        if (c & bad).sum() < PRECISION * max(c.sum(), 1):
            break
        rules.append(rule)
        left &= ~c
    return rules


def sampled(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, label, h of about sample_rows labels outside the held-out part, drawn by a hash of the id."""
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(3 << 20))
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("label"), h.alias("h"))
    rate = min(1.0, sample_rows / max(known.count(), 1))
    return materialise(known.filter(F.col("h") < rate * (3 << 20)), "rules-labels")


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rows: the INPUTS, label (0 is bad) and h of sampled labels; base checks' failures are left out."""
    got = rows.filter(~base_failed()).select(*INPUTS, "label", "h").orderBy("h", *INPUTS).limit(2 * sample_rows).collect()
    if not got:
        return []
    x = {c: np.array([r[c] for r in got], float) for c in INPUTS}
    bad = np.array([r["label"] == 0 for r in got])
    part = np.array([r["h"] % 3 != 0 for r in got])
    return [] if bad.all() or not bad.any() else learn(x, bad, part)


def expression(rules: list[Rule]) -> Column:
    """The number of the first rule that covers the row, from 1; 0 if none does."""
    out = F.lit(0)
    for i in range(len(rules), 0, -1):
        hit = F.lit(True)
        for c in rules[i - 1]:
            hit = hit & c.column()
        out = F.when(hit, F.lit(i)).otherwise(out)
    return out


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(map(str, r)) for r in rules]


def base_failed(of: Callable[[str], Column] = F.col) -> Column:
    return (of("n_words") < 10) | (100 * of("n_repeat_words") > 20 * of("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row of statistics and verdicts for each document (without text)."""
    stats = materialise(map_columns(docs, ["text"], textstats.DDL, textstats.columns, ["doc_id"]), "rules-stats")
    rules = fit(stats.join(sampled(labels), "doc_id"))
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(expression(rules)).cast("int"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The kept documents, with their columns as they were.

    The rules are learned from the sampled ones among these documents; one pass
    over all texts applies them, so that texts are never shuffled or stored.
    """
    known = F.broadcast(sampled(labels).withColumnRenamed("doc_id", "known_id"))  # about SAMPLE_ROWS rows
    some = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("known_id"))
    rules = fit(materialise(map_columns(some, ["text"], textstats.DDL, textstats.columns, ["label", "h"]), "rules-sample"))
    held = fresh(docs, "doc_stats")
    ddl = f"{held} struct<{textstats.DDL.replace(' ', ':')}>".replace(",:", ",")

    def packed(texts: list) -> list:
        import pyarrow as pa

        return [pa.StructArray.from_arrays(textstats.columns(texts), names=list(textstats.NAMES))]

    inside = lambda name: F.col(f"{held}.{name}")
    bad = base_failed(inside)
    for rule in rules:
        bad = bad | reduce(lambda a, b: a & b, [c.column(inside) for c in rule])
    return map_columns(docs, ["text"], ddl, packed).filter(~bad).select(*cols(docs.columns))
