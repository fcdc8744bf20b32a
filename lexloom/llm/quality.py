"""Quality scores by random Fourier features, ridge regression and isotonic calibration.

Statistics of each whole text (see textstats) are made once and written to the
shared folder. A seeded set of random Fourier features approximates a Gaussian
kernel over them. Each partition of labelled rows sums its part of the normal
equations; Spark adds the parts up, by fold and cell. The driver solves the
ridge systems (a few hundred unknowns, whatever the input), picks the penalty
and kernel width by cross-validation over the folds, which needs no further
pass over data, and calibrates out-of-fold scores by isotonic regression.

Null and empty texts have the statistics of an empty text and are scored like
any other. Without labelled rows, or with labels of one kind, the score is that
label's share (0.5 if there is none). Rows with a null label or a null id are
not learned from; a doc_id with several labels counts once a label. Very long
texts count whole; equal texts get equal scores. Other columns are left out by
classify. Of penalties and widths of equal error the first tried is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstats
from .common import crc_mod, held_out, map_columns, materialise

#: Inputs of the score.
INPUTS = textstats.RATIOS
#: Random features for each kernel width, and the widths (in standard deviations of the inputs).
FEATURES, WIDTHS, SEED = 96, (3.0, 8.0), 7
RIDGE = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)
THRESHOLD = 0.7
#: Scores are gathered into so many steps before the isotonic fit.
STEPS = 2000


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row of numbers for each document, without its text; all rows stay."""
    return map_columns(docs, [text], textstats.DDL, textstats.columns, ["doc_id"] if keep is None else keep)


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None  # with the intercept last
    raw: np.ndarray  # calibration: raw scores, rising, and
    shares: np.ndarray  # the share of label 1 at each

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        f = np.sqrt(2 / FEATURES) * np.cos(z @ self.waves + self.phases)
        return np.hstack([f, np.ones((len(f), 1))])

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.weights is None else self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        r = self.raw_scores(x)
        # A little of the raw score orders what the steps hold equal.
        return np.clip(0.999 * np.interp(r, self.raw, self.shares) + 0.001 / (1 + np.exp(-4 * (r - 0.5))), 0, 1)


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The rising values that are nearest to y by weighted squares."""
    blocks: list[list[float]] = []
    for v, n in zip(y, w, strict=True):
        blocks.append([v, n, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, n1, k1 = blocks.pop()
            v0, n0, k0 = blocks[-1]
            blocks[-1] = [(v0 * n0 + v1 * n1) / (n0 + n1), n0 + n1, k0 + k1]
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks]) if blocks else np.zeros(0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in INPUTS]).astype(float)


def fit(labelled: DataFrame) -> Scorer:
    """labelled: the INPUTS, `label` (0 or 1) and `fold` (a small integer); all its rows count."""
    moments = labelled.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share"), *(f(c).alias(f"{k}{c}") for c in INPUTS for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    rng = np.random.default_rng(SEED)
    waves = np.hstack([rng.standard_normal((len(INPUTS), FEATURES)) / w for w in WIDTHS])
    phases = rng.uniform(0, 2 * np.pi, waves.shape[1])
    share = 0.5 if moments["share"] is None else float(moments["share"])
    mean = np.array([moments[f"m{c}"] or 0 for c in INPUTS], float)
    scale = np.array([max(moments[f"s{c}"] or 0, 1e-6) for c in INPUTS], float)
    out = Scorer(mean, scale, waves, phases, None, np.array([0.0]), np.array([share]))
    if not moments["n"] or share in (0.0, 1.0):
        return out
    size = waves.shape[1] + 1
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's part of X'X, X'y and y'y, by fold."""
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x, y, fold = out.features(_matrix(b)), b.column(b.schema.get_field_index("label")).to_numpy().astype(float), b.column(b.schema.get_field_index("fold")).to_numpy()
            for k in np.unique(fold):
                a, t = x[fold == k], y[fold == k]
                part = np.concatenate([(a.T @ a)[upper], a.T @ t, [t @ t, len(t)]])
                total[int(k)] = total.get(int(k), 0) + part
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["fold", "cell", "v"])

    cells = labelled.select(*INPUTS, "label", "fold").mapInArrow(sums, "fold int, cell int, v double").groupBy("fold", "cell").agg(F.sum("v").alias("v")).collect()
    parts: dict[int, np.ndarray] = {}
    for r in cells:
        parts.setdefault(r["fold"], np.zeros(len(upper[0]) + size + 2))[r["cell"]] = r["v"]

    def system(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        g = np.zeros((size, size))
        g[upper] = v[: len(upper[0])]
        return g + np.triu(g, 1).T, v[len(upper[0]) : -2], v[-2], v[-1]

    total = sum(parts.values())
    halves = [np.arange(size - 1) < FEATURES, np.arange(size - 1) >= FEATURES, np.ones(size - 1, bool)]
    masks = [np.append(h, True) for h in halves]  # either kernel width, or both

    def solve(v: np.ndarray, mask: np.ndarray, ridge: float) -> np.ndarray:
        g, b, _, n = system(v)
        penalty = np.append(np.full(mask.sum() - 1, ridge), 1e-6)
        w = np.zeros(size)
        w[mask] = np.linalg.solve(g[np.ix_(mask, mask)] + np.diag(penalty), b[mask])
        return w

    def error(k: int, w: np.ndarray) -> float:
        g, b, yy, _ = system(parts[k])
        return yy - 2 * w @ b + w @ g @ w

    folds = [k for k in sorted(parts) if len(parts) > 1]
    tried = {(i, r): sum(error(k, solve(total - parts[k], masks[i], r)) for k in folds) for i in range(len(masks)) for r in RIDGE}
    i, ridge = min(tried, key=tried.get)
    without = {k: solve(total - parts[k], masks[i], ridge) for k in folds}
    out.weights = solve(total, masks[i], ridge)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many labels of each kind each step of the out-of-fold score holds."""
        for b in batches:
            if not b.num_rows:
                continue
            x, y, fold = out.features(_matrix(b)), b.column(b.schema.get_field_index("label")).to_numpy(), b.column(b.schema.get_field_index("fold")).to_numpy()
            raw = np.array([f @ without.get(int(k), out.weights) for f, k in zip(x, fold, strict=True)])
            at = np.round(np.clip(raw, -1, 2) * (STEPS / 3)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y.astype(np.int64))], names=["at", "label"])

    rows = labelled.select(*INPUTS, "label", "fold").mapInArrow(steps, "at int, label bigint").groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).orderBy("at").collect()
    n, ones = (np.array([r[c] for r in rows], float) for c in ("n", "ones"))
    out.raw = np.array([r["at"] for r in rows]) * (3 / STEPS)
    out.shares = isotonic(ones / n, n)
    return out


def score(stats: DataFrame, scorer: Scorer, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to rows that have the INPUTS."""
    shared = stats.sparkSession.sparkContext.broadcast(scorer)  # a few hundred numbers

    def run(*cols: list) -> list[pa.Array]:
        s = shared.value.scores(np.array(cols, float).T)
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return map_columns(stats, list(INPUTS), "score double, predicted int", run, keep)


def labelled_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of labelled rows outside the held-out part, with label and fold."""
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    return stats.filter(~held_out()).join(known, "doc_id").withColumn("fold", crc_mod().cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    stats = materialise(statistics(docs), "quality-stats")
    train = materialise(labelled_rows(stats, labels), "quality-train")
    return score(stats.withColumn("held_out", held_out()), fit(train), ["doc_id", "held_out"])
