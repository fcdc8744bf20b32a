"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 is fitted per language on a bounded sample of labelled
documents. All models are compiled into sorted arrays of 64-bit n-gram hashes,
each with a row of log probabilities (a column a language). A text gets the
language of the lowest cross-entropy per character; it is rejected when that
cross-entropy is far above what labelled texts of that language show.

Text is composed (NFKC) and lower-cased; each run of other characters than
letters is one space.
A null text, or one without a letter, is `und` with score 0 and rejected. Ties
go to the language first by code point. If nothing can be learned, every text
is `und`. Rows with a null lang are never learned from. Very long texts are
scored whole, a chunk of texts at a time; equal texts get equal scores. Other
columns stay; an output whose name exists gets underscores in front.

The model is dense by language: its size is the distinct strings of the sample
times the languages, which is small for tens of languages; over MAX_CELLS is an
error that says so.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cols, crc_mod, fresh, map_columns

ORDER = 4
#: Documents of a language that a model is fitted on, and as many that calibrate rejection (expected numbers).
SAMPLE_DOCS = 400
#: Cells (strings by languages) of a model that is sent to executors: 4 bytes each.
MAX_CELLS = 1 << 27
#: Labels are a vocabulary of languages; more distinct values than this are an error.
MAX_LANGS = 1000
#: Rejected: cross-entropy over so many deviations above a language's mean.
DEVIATIONS = 8.0
OUT = "lang_pred string, score double, rejected boolean, cross_entropy double, n_letters bigint"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_CHUNK = 1 << 19
#: Before the first text stands what stands between texts, so that a text's score is the same wherever it comes.
_LEAD = np.zeros(ORDER - 1, np.uint32)
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each with a space before and after it, and where each text starts."""
    joined = " " + " \x00 ".join(normalize("NFKC", t).lower() for t in texts) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = np.flatnonzero(cp == 0)
    if len(marks) != len(texts) - 1:  # a text holds NUL itself
        return normal([t.replace("\x00", " ") for t in texts])
    space = ~letter_table()[cp]
    keep = np.ones(len(cp), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[marks] = True
    keep[marks + 1] = True
    out = np.where(space, 32, cp)
    out[marks] = 0
    out = out[keep]
    at = np.flatnonzero(out == 0)
    starts = np.concatenate([[0], at + 1])
    return out, starts


def hashes(cp: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n code points that end at each place from n - 1 on."""
    c = cp.astype(np.uint64)
    h = np.zeros(max(len(c) - n + 1, 0), np.uint64)
    for i in range(n):  # the last character has the first multiplier
        h += c[n - 1 - i : len(c) - i] * _MIX[i]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class HashTable:
    """Sorted hashes with their values' rows; the leading bits index the order."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], rows[order]
        bits = max(1, min(20, int(np.ceil(np.log2(len(keys) + 1))) + 2))
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.start).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int32)
        p = (h >> self.shift).astype(np.int64)
        at, end = self.start[p], self.start[p + 1]
        hit = (self.keys[np.minimum(at, len(self.keys) - 1)] == h) & (at < end)
        got = np.where(hit, at, np.int32(-1))
        left = np.flatnonzero(~hit & (at + 1 < end))
        for step in range(1, self.most):
            if not len(left):
                break
            x = at[left] + step
            ok = self.keys[x] == h[left]
            got[left[ok]] = x[ok]
            left = left[~ok & (x + 1 < end[left])]
        return got


@dataclass
class Model:
    langs: list[str]
    full: HashTable  # order 4: log p(w | 3 characters)
    back: dict[int, HashTable]  # by length of context: log of the weight given to the lower order
    lower: dict[int, HashTable]  # orders 3, 2, 1: log p
    unknown: np.ndarray
    limits: np.ndarray  # by language: mean, variance of means, variance a character

    def log_probs(self, cp: np.ndarray) -> np.ndarray:
        """A row for each place from ORDER - 1 on."""
        h = hashes(cp, ORDER)
        at = self.full.find(h)
        out = self.full.rows[at] if len(self.full.keys) else np.zeros((len(h), len(self.langs)), np.float32)
        miss = np.flatnonzero(at < 0)
        out[miss] = 0
        grams = np.stack([cp[miss + i] for i in range(ORDER)]) if len(miss) else None
        n = ORDER
        while len(miss) and n > 1:
            ctx = _hash_columns(grams[ORDER - n : ORDER - 1])
            got = self.back[n - 1].find(ctx)
            out[miss[got >= 0]] += self.back[n - 1].rows[got[got >= 0]]
            n -= 1
            got = self.lower[n].find(_hash_columns(grams[ORDER - n :]))
            out[miss[got >= 0]] += self.lower[n].rows[got[got >= 0]]
            miss, grams = miss[got < 0], grams[:, got < 0]
        out[miss] += self.unknown
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropies (texts by languages) and the number of scored places of each text."""
        cp, starts = normal(texts)
        cp = np.concatenate([_LEAD, cp])
        p = self.log_probs(cp)  # place i is cp[i + ORDER - 1], that is place i of the texts
        p[np.flatnonzero(cp[ORDER - 1 :] == 0)] = 0
        lengths = np.diff(np.concatenate([starts, [len(cp) - ORDER + 2]])) - 1
        total = np.add.reduceat(p, starts, axis=0, dtype=np.float64)
        return -total / np.maximum(lengths, 1)[:, None], lengths

    def predict(self, texts: list[str | None]) -> list[pa.Array]:
        size = len(texts)
        best, score, far, ce, letters = [("und")] * size, np.zeros(size), np.ones(size, bool), np.full(size, np.nan), np.zeros(size, np.int64)
        table = letter_table()
        todo = [i for i, t in enumerate(texts) if t and self.langs and (t.isalpha() or _has_letter(t, table))]
        most = max(_CHUNK // max(1, len(self.langs) // 4), 1 << 14)
        for part in _parts(todo, texts, most):
            h, n = self.score([texts[i] for i in part])
            k = h.argmin(axis=1)
            low = h[np.arange(len(part)), k]
            mass = np.exp(-(h - low[:, None]) * np.minimum(n, 60)[:, None]).sum(axis=1)
            mean, a, b = self.limits[k].T
            for j, i in enumerate(part):
                best[i] = self.langs[k[j]]
            score[part], ce[part], letters[part] = 1 / mass, low, n
            far[part] = low > mean + DEVIATIONS * np.sqrt(a + b / np.maximum(n, 1))
        return [pa.array(best), pa.array(score), pa.array(far), pa.array(ce, from_pandas=True), pa.array(letters)]


def _has_letter(text: str, table: np.ndarray) -> bool:
    return any(map(str.isalpha, text[:64])) or bool(table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def _parts(todo: list[int], texts: list, most: int) -> Iterator[list[int]]:
    part, size = [], 0
    for i in todo:
        part.append(i)
        size += len(texts[i])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _hash_columns(grams: np.ndarray) -> np.ndarray:
    """As hashes(), of grams given as rows of code points."""
    h, n = np.zeros(grams.shape[1], np.uint64), len(grams)
    for i in range(n):
        h += grams[n - 1 - i].astype(np.uint64) * _MIX[i]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def compile_model(counts: dict[str, dict[str, int]]) -> Model:
    """counts: by language, how often each string of ORDER characters occurs."""
    langs = sorted(x for x in counts if counts[x])
    size = len({c for g in counts.values() for x in g for c in x}) + 1
    probs: dict[int, dict[str, np.ndarray]] = {n: {} for n in range(1, ORDER + 1)}
    back: dict[int, dict[str, np.ndarray]] = {n: {} for n in range(1, ORDER)}
    unknown = np.zeros(len(langs), np.float32)
    for j, lang in enumerate(langs):
        level = {ORDER: dict(counts[lang])}
        for n in range(ORDER - 1, 0, -1):  # in how many contexts each shorter string is found
            level[n] = {}
            for g in level[n + 1]:
                level[n][g[1:]] = level[n].get(g[1:], 0) + 1
        p: dict[int, dict[str, float]] = {0: {"": 1 / size}}
        gamma: dict[int, dict[str, float]] = {}
        for n in range(1, ORDER + 1):
            ones, twos = (sum(1 for c in level[n].values() if c == k) for k in (1, 2))
            cut = min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5
            total: dict[str, int] = {}
            kinds: dict[str, int] = {}
            for g, c in level[n].items():
                total[g[:-1]] = total.get(g[:-1], 0) + c
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            gamma[n - 1] = {x: cut * kinds[x] / total[x] for x in total}
            base = p[n - 1]
            p[n] = {g: max(c - cut, 0) / total[g[:-1]] + gamma[n - 1][g[:-1]] * base.get(g[1:], base.get("", 0)) for g, c in level[n].items()}
        unknown[j] = np.log(gamma[0][""] * p[0][""])
        for n in range(1, ORDER + 1):
            for g, v in p[n].items():
                probs[n].setdefault(g, np.full(len(langs), np.nan, np.float32))[j] = np.log(v)
        for n in range(1, ORDER):
            for g, v in gamma[n].items():
                back[n].setdefault(g, np.zeros(len(langs), np.float32))[j] = np.log(v)
    for n in range(1, ORDER + 1):  # what only another language has gets its lower-order value
        for g, row in probs[n].items():
            gap = np.isnan(row)
            if gap.any():
                low = probs[n - 1][g[1:]] if n > 1 else unknown
                row[gap] = (low + (back[n - 1].get(g[:-1], np.zeros(len(langs), np.float32)) if n > 1 else 0))[gap]

    def table(d: dict[str, np.ndarray], n: int) -> HashTable:
        grams = np.array([[ord(c) for c in g] for g in d], np.uint32).reshape(len(d), n).T
        return HashTable(_hash_columns(grams), np.array(list(d.values()), np.float32).reshape(len(d), len(langs)))

    if (cells := len(langs) * sum(map(len, [*probs.values(), *back.values()]))) > MAX_CELLS:
        raise ValueError(f"{cells} cells of {len(langs)} languages are over {MAX_CELLS}: fit with fewer sample_docs")
    tables = {n: table(probs[n], n) for n in probs}
    return Model(langs, tables.pop(ORDER), {n: table(back[n], n) for n in back}, tables, unknown, np.tile([np.inf, 0, 0], (max(len(langs), 1), 1)))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS, learn=None) -> Model:
    """Fits on the documents where `learn` (a condition; by default crc32(id) mod 4 is not 2) holds.

    Each language gives about `sample_docs` documents, drawn by the hash of id
    and text, to the model, and as many others to the calibration; both bounds
    are on rows alone, and whole texts are used. Of a language with fewer than
    `sample_docs` all are in the model; its rejection is calibrated on one half
    by a model of the other. What the driver holds are the distinct strings of
    four characters in those.
    """
    spark = docs.sparkSession
    learn = ~(F.coalesce(crc_mod(doc_id), F.lit(0)) == 2) if learn is None else learn
    usable = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = usable.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} distinct languages; is {lang} a language column?")
    if not sizes:
        return compile_model({})
    rate = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 2.0 * sample_docs / r["n"]))]), F.col(lang))
    draw = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.col(text), F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    part = F.pmod(F.xxhash64(F.lit(10), F.col(text), F.col(doc_id).cast("string")), F.lit(2)).cast("int")
    chosen = usable.filter(draw < rate).select(F.col(text).alias("text"), F.col(lang).alias("lang"), part.alias("part"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, int], list[str]] = {}
            for t, x, k in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found.setdefault((x, k), []).append(t)
            for (x, k), texts in found.items():
                cp, _ = normal(texts)
                cp = np.concatenate([_LEAD, cp])
                windows = np.lib.stride_tricks.sliding_window_view(cp, ORDER)
                windows = windows[(windows != 0).all(axis=1)]
                u, n = np.unique(np.ascontiguousarray(windows).view(f"V{4 * ORDER}").ravel(), return_counts=True)
                strings = [v.tobytes().decode("utf-32-le", "surrogatepass") for v in u]
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(u)), pa.array([k] * len(u), pa.int32()), pa.array(strings), pa.array(n, pa.int64())], names=["lang", "part", "gram", "n"])

    counted = chosen.mapInArrow(grams, "lang string, part int, gram string, n bigint").groupBy("lang", "part", "gram").agg(F.sum("n").alias("n"))
    counts: dict[int, dict[str, dict[str, int]]] = {0: {}, 1: {}}
    for r in counted.collect():
        counts[r["part"]].setdefault(r["lang"], {})[r["gram"]] = r["n"]
    fitted = 0 if len(counts[0]) >= len(counts[1]) else 1
    half = model = compile_model(counts[fitted])
    few = {r["lang"] for r in sizes if r["n"] < sample_docs} & counts[1 - fitted].keys()
    if few:
        both = {x: dict(Counter(counts[0].get(x, {})) + Counter(counts[1].get(x, {}))) for x in few}
        model = compile_model(counts[fitted] | both)
    got = _annotate(chosen.filter(F.col("part") == 1 - fitted), half, "text", ["lang"]).filter("lang = lang_pred")
    rows = got.select("lang", "cross_entropy", "n_letters").limit(8 * sample_docs * len(sizes)).collect()
    for j, lang_j in enumerate(model.langs):
        h, n = (np.array([r[i] for r in rows if r["lang"] == lang_j], float) for i in (1, 2))
        if len(h) < 5:
            continue
        mean = float(np.average(h, weights=n))
        per = float(np.average((h - mean) ** 2 * n, weights=1 + 0 * n))  # variance a character, were they independent
        model.limits[j] = mean, max(float(np.var(h[n >= np.median(n)])), 1e-4), max(per, 1.0)
    return model


def _annotate(df: DataFrame, model: Model, text: str, keep: list[str] | None, outputs: str = OUT) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of fit()
    return map_columns(df, [text], outputs, lambda texts: shared.value.predict(texts), keep)


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score, rejected, cross_entropy and n_letters; all rows stay."""
    return _annotate(df, model, text, keep)


def accept(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not rejected, with their columns as they were."""
    flag, names = fresh(df, "rejected"), df.columns
    outputs = ", ".join(f"{fresh(df, c.split()[0])} {c.split()[1]}" for c in OUT.split(", "))
    return _annotate(df, model, text, None, outputs).filter(~F.col(flag)).select(*cols(names))
