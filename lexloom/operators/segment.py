"""Words from texts without spaces: the Viterbi recurrence over a unigram model.

P[0] = 1; P[i] is the largest P[j] * g(text[j:i]), of equals the one with the
largest j. g is the model's probability, 1 for a single character that is no
letter or dash, else 0. Emitted probabilities are those of the prefix. Unknown
text never fails: its characters come out singly with probability 0.

Two plans give the same result. `segment` sends the model to the executors as
sorted hash arrays, which is done for models up to MAX_TERMS terms; nothing is
shuffled. Substrings are looked for from each start on while some term begins
so, for all languages at once, and the recurrence goes over blocks of positions
of texts side by side, so that memory is bounded by the block whatever a text's
length. `segment` gives larger models to the plan of `segment_by_join`: the
distinct texts are dealt out in parts, the substrings of each part that may be
terms, by tables of bits of bounded size, are joined with the model, each once a
part, and what is found is the part's own small model. Streams can't take that plan.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import materialise

#: A model of so many terms at most is sent to executors: about 32 bytes a term.
MAX_TERMS = 8_000_000
TPS = "array<struct<start:int,len:int,prob:double>>"
TERM_TPS = TPS.replace("start", "term:string,start")
MINIMUM = -1.7976931348623157e308
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Positions of texts side by side; positions of a block, and starts of terms in it.
_POSITIONS, _BLOCK, _STARTS = 1 << 20, 4096, 1 << 18
#: Most cells (term, language) of a model that are made into a table of probabilities.
_DENSE = 1 << 25
#: Characters, and rows, of texts that are worked on at a time.
_CHARS, _ROWS = 1 << 22, 16384
#: Words in a batch of rows.
_WORDS = 1 << 17
#: Characters of texts that share a model of their own in the plan by joins, and most bits of each of its tables.
_PART, _BITS = 1 << 19, 28


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Symbols of a tree's edges: those of frequent characters, one that digits of a rare one follow, and one that is on no edge.
_FREQUENT, _RARE, _NONE = 61, 61, 63
#: Of a node: the symbols that go on from it, its first child, and the term that ends there, or -1. They are read as one.
_NODE = np.dtype([("mask", np.uint64), ("child", np.int32), ("term", np.int32)])
_LOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


@dataclass
class Lexicon:
    """The terms of all languages as a tree of symbols, its nodes level by level: no substring is taken for a term by its hash.

    A node's children stand together, in the order of their symbols, so that a mask of symbols and the first child's place tell each.
    """

    langs: list[str]
    symbol: np.ndarray  # by code point
    rare: np.ndarray  # rising code points of characters that are written as digits
    digits: int
    nodes: np.ndarray  # of _NODE
    start: np.ndarray  # where each term's entries begin
    lang: np.ndarray  # an entry: the place of its language, and the term's probability there
    prob: np.ndarray
    longest: int

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "_table"}

    def weights(self, term: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The probability (or 0) of each term in each wanted language, or in the one that stands in its row of `want`."""
        kinds = len(self.langs)
        if (len(self.start) - 1) * kinds > _DENSE:
            first = self.start[term]
            count = self.start[term + 1] - first
            upto = np.cumsum(count)
            entry = np.repeat(first - upto + count, count) + np.arange(count.sum())
            row, out = np.repeat(np.arange(len(term)), count), np.zeros((len(term), want.shape[-1]))
            for k in range(want.shape[-1]):
                here = np.flatnonzero(self.lang[entry] == (want[k] if want.ndim == 1 else want[row, k]))
                out[row[here], k] = self.prob[entry[here]]
            return out
        if not hasattr(self, "_table"):  # made where it is needed, and never sent
            self._table = np.zeros((len(self.start) - 1, kinds))
            self._table[np.repeat(np.arange(len(self.start) - 1), np.diff(self.start)), self.lang] = self.prob
        if want.ndim == 1 and len(want) == kinds:
            return self._table.take(term, axis=0)
        return self._table.reshape(-1).take(term[:, None].astype(np.int64) * kinds + want)

    @staticmethod
    def of(rows: pa.Table, known: list[str] | None = None) -> Lexicon:
        """From lang, term, prob; of a repeated term of a language the first counts. `known` names languages that may have no terms."""
        rows = rows.filter(pa.compute.greater(pa.compute.utf8_length(rows["term"]), 0))
        names = rows["lang"].combine_chunks().dictionary_encode() if rows.num_rows else None
        langs = sorted({*(names.dictionary.to_pylist() if names is not None else ()), *(known or ())})
        n = rows.num_rows
        size = np.asarray(pa.compute.utf8_length(rows["term"])).astype(np.int64)
        parts = [part.slice(k, 1 << 18) for part in rows["term"].chunks for k in range(0, len(part), 1 << 18)]
        often = np.zeros(0x110000, np.int64)
        for part in parts:
            often += np.bincount(_codes("".join(part.to_pylist())), minlength=len(often))
        used = np.flatnonzero(often)
        used = used[np.argsort(-often[used], kind="stable")]
        symbol = np.full(0x110000, _NONE, np.uint8)
        symbol[used[:_FREQUENT]] = np.arange(min(len(used), _FREQUENT))
        symbol[used[_FREQUENT:]] = _RARE
        rare = np.sort(used[_FREQUENT:])
        digits = next(d for d in range(5) if 62**d >= len(rare))
        lex = Lexicon(langs, symbol, rare, digits, np.zeros(0, _NODE), np.zeros(1, np.int64), np.zeros(0, np.int16), np.zeros(0), int(size.max(initial=1)))
        flat, steps, at = [np.zeros(0, np.uint8)], size.copy(), 0
        for part in parts:
            here, code = size[at : at + len(part)], _codes("".join(part.to_pylist()))
            s = symbol[code]
            if len(odd := np.flatnonzero(s == _RARE)):
                times = np.ones(len(s), np.int64)
                times[odd] += digits
                end = np.cumsum(times)
                steps[at : at + len(part)] = np.add.reduceat(times, np.cumsum(here) - here)
                s = np.repeat(s, times)
                for d in range(digits):
                    s[end[odd] - digits + d] = lex._digit(code[odd], d)
            flat.append(s)
            at += len(part)
        found = lex._grow(np.concatenate(flat), steps)
        if n:
            place = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int16)
            lang, prob = place[np.asarray(names.indices)], np.asarray(rows["prob"]).astype(float)
            order = np.lexsort((lang, found))
            found, lang, prob = found[order], lang[order], prob[order]
            term = np.concatenate([[True], found[1:] != found[:-1]])
            entry = term | np.concatenate([[True], lang[1:] != lang[:-1]])
            lex.nodes["term"][found[term]] = np.arange(term.sum())
            lex.start, lex.lang, lex.prob = np.append((np.cumsum(entry) - 1)[term], entry.sum()), lang[entry], prob[entry]
        return lex

    def _digit(self, code: np.ndarray, d: int) -> np.ndarray:
        return (np.searchsorted(self.rare, code) // 62 ** (self.digits - 1 - d) % 62).astype(np.uint8)

    def _grow(self, flat: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Makes the nodes from the terms' symbols; gives the node of each term."""
        begin = np.cumsum(steps) - steps
        node, live, total = np.zeros(len(steps), np.int64), np.arange(len(steps)), 1
        masks, children, level = [], [], 1  # level: how many nodes the last one has
        for i in range(int(steps.max(initial=0)) + 1):
            live = live[steps[live] > i]
            low = total - level
            key, which = np.unique((node[live] - low) << 6 | flat[begin[live] + i], return_inverse=True)
            parent = key >> 6
            first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(key) else np.zeros(0, np.int64)
            mask, child = np.zeros(level, np.uint64), np.zeros(level, np.int32)
            if len(key):
                mask[parent[first]] = np.bitwise_or.reduceat(np.uint64(1) << (key & 63).astype(np.uint64), first)
                child[parent[first]] = total + first
            node[live] = total + which
            masks.append(mask)
            children.append(child)
            level = len(key)
            total += level
        self.nodes = np.zeros(total, _NODE)
        self.nodes["mask"], self.nodes["child"], self.nodes["term"] = np.concatenate(masks), np.concatenate(children), -1
        return node

    @staticmethod
    def _step(node: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a child by their symbol, and that child's place."""
        mask = node["mask"]
        live = np.flatnonzero(mask >> symbol & np.uint8(1))
        return live, node["child"][live] + np.bitwise_count(mask[live] & _LOW[symbol[live]])

    def walk(self, symbols: np.ndarray, codes: np.ndarray, at: np.ndarray, stride: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, place, term of the terms of n characters that start in places `at` of texts whose next character is `stride` places on."""
        begin = np.full(64, -1, np.int32)  # where each symbol leads from the root
        some, to = self._step(self.nodes[np.zeros(64, np.int32)], np.arange(64, dtype=np.uint8))
        begin[some] = to
        for n in range(1, self.longest + 1):
            if n == 1:
                place = begin[symbols[at]]
                live = np.flatnonzero(place >= 0)
                place = place[live]
            else:
                live, place = self._step(node, symbols[at])  # noqa: F821
            at = at[live]
            if len(self.rare) and len(odd := np.flatnonzero(symbols[at] == _RARE)):
                part, end = odd, place[odd]
                for d in range(self.digits):
                    some, end = self._step(self.nodes[end], self._digit(codes[at[part]], d))
                    part = part[some]
                place[odd] = -1
                place[part] = end
                live = np.flatnonzero(place >= 0)
                at, place = at[live], place[live]
            if not len(at):
                return
            node = self.nodes.take(place)
            term = node["term"]
            hit = np.flatnonzero(term >= 0)
            yield n, at[hit] - (n - 1) * stride, term[hit]
            at = at + stride


def _free(ch: str) -> bool:
    """Whether a single character weighs 1 on its own."""
    return unicodedata.category(ch)[0] != "L" and ch not in T.DASHES


_free_table = np.zeros(0, bool)


def _free_codes(cp: np.ndarray) -> np.ndarray:
    global _free_table
    if (top := int(cp.max(initial=0)) | 0xFFF) >= len(_free_table):
        more = range(len(_free_table), top + 1)
        _free_table = np.concatenate([_free_table, np.fromiter((_free(chr(i)) for i in more), bool, len(more))])
    return _free_table[cp]


@dataclass
class Words:
    """The words of texts in one language, text by text."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    prob: np.ndarray

    def only(self, some: np.ndarray) -> Words:
        return Words(self.text[some], self.start[some], self.length[some], self.prob[some])

    def scores(self, n: int) -> np.ndarray:
        """Of n texts: the sum of logarithms; the smallest number there is if a probability is 0."""
        zero = self.prob == 0
        total = np.bincount(self.text, np.log(np.where(zero, 1.0, self.prob)), n)
        return np.where(np.bincount(self.text[zero], minlength=n) > 0, MINIMUM, total)


def viterbi(texts: list[str], lexicon: Lexicon, langs: list[str], give: str = "all", own: np.ndarray | None = None) -> list[Words]:
    """The words of each (upper-cased) text in each language, or in the one of `langs` whose place `own` has for it.

    If scores alone are asked for, or the best language, a text of probability 0 that can't be the best is one word of probability 0.
    """
    want = np.unique([lexicon.langs.index(x) for x in langs])
    if own is not None:
        own = np.array([lexicon.langs.index(x) for x in langs])[own]
    parts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in (want if own is None else [0])]
    last = lexicon.langs.index(langs[-1]) if give == "best" and own is None else None  # the best of texts that have probability 0 in all
    spared = None if give == "all" or (own is not None and give == "best") else np.array([x != last for x in want[: len(parts)]])
    # Texts of like lengths go through the recurrence side by side.
    group: list[int] = []
    for i in [*sorted(range(len(texts)), key=lambda i: len(texts[i])), None]:
        if group and (i is None or (len(group) + 1) * len(texts[i]) > _POSITIONS):
            for k, found in enumerate(_group([texts[j] for j in group], lexicon, want if own is None else own[group][:, None], spared)):
                parts[k].append((np.array(group)[found[0]], *found[1:]))
            group = []
        if i is not None and texts[i]:
            group.append(i)
    out = []
    for found in parts:
        text, start, length, prob = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in (np.int64, np.int32, np.int32, float))
        order = _order(text, len(texts))
        out.append(Words(text[order], start[order], length[order], prob[order]))
    return out if own is not None else [out[np.searchsorted(want, lexicon.langs.index(x))] for x in langs]


def _order(place: np.ndarray, top: int) -> np.ndarray:
    """The stable order of numbers below `top`: small ones are sorted by their digits."""
    return np.argsort(place.astype(np.uint16) if top <= 1 << 16 else place, kind="stable")


def _group(texts: list[str], lex: Lexicon, want: np.ndarray, spared: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
    """For each wanted language (or for the one of each text, if it stands in a row of `want`): text, start, length, prob of all words.

    A place is a position of a text; those of all texts at one position stand together, and so do the cells (languages) of a place.
    Terms are handed on from their starts: in each step, from all cells of one position at once.
    """
    rows, size, kinds = len(texts), max(map(len, texts)), want.shape[-1]
    lengths, wide = np.array(list(map(len, texts))), rows * kinds
    codes = np.ascontiguousarray(_codes("".join(t.ljust(size, "\0") for t in texts)).reshape(rows, size).T)
    symbols = np.full((size + 1, rows), _NONE, np.uint8)
    symbols[:size] = lex.symbol[codes]
    if size != lengths.min():
        symbols[:size][np.arange(size)[:, None] >= lengths] = _NONE
    p = np.zeros((size + 1, wide))
    p[0] = 1
    step = np.ones((size + 1, wide), np.int16 if lex.longest < 1 << 15 else np.int32)
    cells, back = p.reshape(-1, kinds), step.reshape(-1, kinds)
    # A place's cells are put down as one value.
    whole, whole_back = (np.dtype((np.void, x.itemsize * kinds)) for x in (cells, back))
    put, put_back = cells.view(whole)[:, 0], back.view(whole_back)[:, 0]
    width, top = max(1, min(_BLOCK, _STARTS // rows)), size
    asked = lambda at: want if want.ndim == 1 else want[at % rows]
    for lo in range(0, size, width):
        alive = np.flatnonzero(p[lo : lo + lex.longest].max(axis=0).reshape(rows, kinds).max(axis=1))
        if not len(alive):
            top = lo
            break  # nothing but zeros: the rest comes out singly with probability 0
        hi = min(lo + width, size)
        weight = np.zeros((hi - lo, rows, kinds))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, step.dtype))]
        for n, at, term in lex.walk(symbols.reshape(-1), codes.reshape(-1), (np.arange(lo, hi)[:, None] * rows + alive).ravel(), rows):
            if n == 1:
                weight.reshape(-1, kinds)[at - lo * rows] = lex.weights(term, asked(at))
            else:
                found.append((at, term, np.full(len(at), n, step.dtype)))
        weight[_free_codes(codes[lo:hi]) & (np.arange(lo, hi)[:, None] < lengths)] = 1
        weight = weight.reshape(hi - lo, wide)
        at, term, length = (np.concatenate(x) for x in zip(*found, strict=True))
        place = ((at - lo * rows) // rows).astype(np.uint16)
        order = np.argsort(place, kind="stable")
        at, length = at[order], length[order]
        prob = lex.weights(term[order], asked(at))
        target = at + length.astype(np.int64) * rows
        bounds = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=hi - lo))]).tolist()
        for i in range(lo, hi):
            a, b = bounds[i - lo], bounds[i - lo + 1]
            if a < b:
                to = target[a:b]
                value, old, steps = cells.take(at[a:b], axis=0), cells.take(to, axis=0), back.take(to, axis=0)
                value *= prob[a:b]
                np.copyto(steps, length[a:b, None], where=value >= old)  # the nearest start comes last: it wins among equals
                put[to] = np.maximum(value, old, out=value).view(whole)[:, 0]
                put_back[to] = steps.view(whole_back)[:, 0]
            value = p[i] * weight[i - lo]
            better = value >= p[i + 1]
            np.copyto(p[i + 1], value, where=better)
            np.copyto(step[i + 1], 1, where=better)
    # What nothing but zeros leads to came singly.
    for lo in range(0, min(size, top + lex.longest) + 1, _BLOCK):
        np.copyto(step[lo : lo + _BLOCK], 1, where=p[lo : lo + _BLOCK] == 0)
    return _back(p.reshape(size + 1, rows, kinds), step.reshape(size + 1, rows, kinds), lengths, top, spared)


def _back(p: np.ndarray, step: np.ndarray, lengths: np.ndarray, top: int, spared: np.ndarray | None) -> list[tuple[np.ndarray, ...]]:
    """For each language: text, start, length, prob of the words that the steps lead back over; all are single from position `top` on.

    `spared` says for each language whether texts of probability 0 are one word there, in others they are so unless they have it in all.
    """
    _, rows, kinds = p.shape
    zero = p[lengths, np.arange(rows)] == 0
    one = np.zeros((rows, kinds), bool) if spared is None else zero & (spared | ~zero.all(axis=1, keepdims=True))
    if rows >= 4:
        wide = rows * kinds
        back, mark = step.reshape(-1), np.zeros(step.size, bool)
        whole = np.flatnonzero(~one)
        end = np.repeat(lengths, kinds)[whole]
        for r, e in zip(whole[end > top], end[end > top], strict=True):
            mark[r + (top + 1) * wide : r + e * wide + 1 : wide] = True
        cell = whole + np.minimum(end, top) * wide
        while len(cell):
            mark[cell] = True
            cell = cell - back[cell].astype(np.int64) * wide
            cell = cell[cell >= wide]
        marks = mark.reshape(p.shape).transpose(2, 1, 0)
    every = np.arange(rows)
    out = []
    for s in range(kinds):
        if rows < 4:
            ends = [(np.full(len(e), r), e) for r in range(rows) for e in [lengths[r : r + 1] if one[r, s] else _trace(step[:, r, s], int(lengths[r]))]]
            row, end = (np.concatenate(x) for x in zip(*ends, strict=True))
        elif (some := np.flatnonzero(~one[:, s])).size == rows:
            row, end = np.nonzero(np.ascontiguousarray(marks[s]))
        else:  # the marks of texts that are one word aren't looked for
            row, end = np.nonzero(np.ascontiguousarray(marks[s].take(some, axis=0)))
            row, end = np.append(some[row], every[one[:, s]]), np.append(end, lengths[one[:, s]])
        n = np.where(one[row, s], lengths[row], step[end, row, s]).astype(np.int32)
        out.append((row, end.astype(np.int32) - n, n, p[end, row, s]))
    return out


def _trace(step: np.ndarray, at: int) -> np.ndarray:
    """The ends of the words of one text, rising."""
    back, ends = memoryview(np.ascontiguousarray(step)), []
    while at > 0:
        ends.append(at)
        at -= back[at]
    return np.array(ends[::-1], np.int64)


def lexicon(model: DataFrame, max_terms: int | None = None) -> Lexicon:
    """The model as arrays. Its size is checked before anything is collected."""
    got = prepared(model, max_terms)
    if not isinstance(got, Lexicon):
        raise ValueError(f"the model has over {MAX_TERMS if max_terms is None else max_terms} terms: use segment_by_join")
    return got


def prepared(model: DataFrame, max_terms: int | None = None) -> Lexicon | DataFrame:
    """The model as arrays if it has up to MAX_TERMS terms, else as a table; segment() takes both. It is made once."""
    kept = materialise(model.select("lang", "term", "prob"), "segment-model")
    return kept if kept.count() > (MAX_TERMS if max_terms is None else max_terms) else Lexicon.of(kept.toArrow())


def languages(model: Lexicon | DataFrame) -> list[str]:
    return model.langs if isinstance(model, Lexicon) else sorted(r[0] for r in model.select("lang").distinct().collect())


def _slices(batch: pa.RecordBatch, texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to _CHARS characters (a longer text is alone) and _ROWS rows."""
    lo = chars = 0
    for i, t in enumerate(texts):
        if i > lo and (chars + len(t) > _CHARS or i - lo == _ROWS):
            yield lo, i
            lo, chars = i, 0
        chars += len(t)
    yield lo, len(texts)


def _places(whole: str, length: np.ndarray) -> np.ndarray:
    """Where, in bytes, each word begins that the text is cut into, and where the last one ends."""
    code = _codes(whole)
    size = np.concatenate([[0], np.cumsum(1 + (code > 0x7F).astype(np.int32) + (code > 0x7FF) + (code > 0xFFFF))])
    return size[np.concatenate([[0], np.cumsum(length)])]


def _cut(texts: list[str], kinds: int, length: np.ndarray) -> pa.Array:
    """The words of all texts, `kinds` times each: they cover their text, so that its bytes need no more than the places of the cuts."""
    whole = "".join(t for t in texts for _ in range(kinds))
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(_places(whole, length).astype(np.int32)), pa.py_buffer(whole.encode("utf-8", "surrogatepass")))


def _spaced(texts: list[str], kinds: int, length: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each text, `kinds` times, with a space between its words; `first` has the number of each one's first word, and of all words."""
    whole = "".join(t for t in texts for _ in range(kinds))
    place = _places(whole, length)
    inner = np.ones(len(length) + 1, bool)  # words that a space stands before
    inner[first] = False
    before = np.cumsum(inner)
    out = np.full(place[-1] + before[-1], ord(" "), np.uint8)
    letters = np.ones(len(out), bool)
    letters[(place + before - 1)[inner]] = False
    out[letters] = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer((place + before)[first]), pa.py_buffer(out)).cast(pa.string())


def segment(df: DataFrame, model: DataFrame | Lexicon, text: str = "text", langs: list[str] | None = None, out: str = "results", own: str | None = None, terms: bool = False, give: str = "all", view: str = "tps") -> DataFrame:
    """Adds an array with a struct (lang_idx, lang, score, tps) for each language, in the order of `langs`.

    tps has start and len in characters of the text, and the prefix probability.
    A null or blank text has empty tps, whose score is 0. `own` names a column
    with a row's language: it is the only one then, and one that isn't in
    `langs` (or null) is an error. `terms` adds the words (upper-cased) to tps.
    `give` is all, best (the struct of the highest score alone, of equals the last
    language's) or scores (no tps), so that no more leaves a task than is asked
    for; so does `view`, what stands for tps: tps themselves, words (the words
    in one string, a space between them) or last (n_terms, their number, and prob,
    the last one's, null if there is none). Works on streams too, if the model has up to MAX_TERMS terms.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    lex = model if isinstance(model, Lexicon) else prepared(model)
    known = languages(lex)
    langs = known if langs is None else langs
    if not langs:
        raise ValueError("no language models")
    if missing := [x for x in langs if x not in known]:
        raise ValueError(f"language not found: {missing}")
    if not isinstance(lex, Lexicon):
        return _segment_by_join(df, lex, text, langs, out, own, terms, give, view)
    shared = df.sparkSession.sparkContext.broadcast(lex)  # bounded by MAX_TERMS
    schema = StructType([*df.schema.fields, *_parse_datatype_string(f"{out} {_kind(give, terms, view)}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = _folded(b, text)
            owns = b.column(b.schema.get_field_index(own)).to_pylist() if own else None
            for lo, hi in _slices(b, texts):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, _results(texts[lo:hi], owns and owns[lo:hi], shared.value, langs, give, terms, view)], names=schema.names)

    return df.mapInArrow(run, schema)


def segment_rows(df: DataFrame, model: DataFrame | Lexicon, keep: list[str], own: str, text: str = "text") -> DataFrame:
    """A row for each word of each text in the language that `own` names: the columns of `keep`, place (of the word, from 0), start, len, term, prob.

    As segment(terms=True) and an explosion, but rows leave the task as they are, not as arrays of structs.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    lex = model if isinstance(model, Lexicon) else prepared(model)
    if not isinstance(lex, Lexicon):
        done = segment(df, lex, text, out="_results", own=own, terms=True).select(*keep, F.posexplode(F.col("_results")[0]["tps"]).alias("place", "_w"))
        return done.select(*keep, "place", "_w.start", "_w.len", "_w.term", "_w.prob")
    if not lex.langs:
        raise ValueError("no language models")
    shared = df.sparkSession.sparkContext.broadcast(lex)  # bounded by MAX_TERMS
    schema = StructType([*(df.schema[c] for c in keep), *_parse_datatype_string("place int, start int, len int, term string, prob double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, owns = _folded(b, text), b.column(b.schema.get_field_index(own)).to_pylist()
            for lo, hi in _slices(b, texts) if texts else ():
                (words,) = viterbi(texts[lo:hi], shared.value, shared.value.langs, own=_own_places(owns[lo:hi], shared.value.langs))
                size = np.bincount(words.text, minlength=hi - lo)
                place = np.arange(len(words.text)) - np.repeat(np.cumsum(size) - size, size)
                row = pa.array(words.text + lo)
                term = _cut(texts[lo:hi], 1, words.length)
                for k in range(0, len(row), _WORDS):
                    some = slice(k, k + _WORDS)
                    kept = [b.column(b.schema.get_field_index(c)).take(row[some]) for c in keep]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(place[some], pa.int32()), pa.array(words.start[some], pa.int32()), pa.array(words.length[some], pa.int32()), term[some], pa.array(words.prob[some])], names=schema.names)

    return df.mapInArrow(run, schema)


def _folded(b: pa.RecordBatch, text: str) -> list[str]:
    return ["" if blank(t) else T.fold(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]


def _own_places(owns: list[str | None], langs: list[str]) -> np.ndarray:
    if wrong := set(owns) - set(langs):
        raise ValueError(f"language not found: {sorted(map(str, wrong))}")
    place = {x: k for k, x in reversed([*enumerate(langs)])}
    return np.array([place[x] for x in owns], int)


def blank(t: str | None) -> bool:
    """As the column function: separators from U+001C to U+001F aren't white space."""
    return not t or (t.isspace() and not any(c in t for c in "\x1c\x1d\x1e\x1f"))


def _kind(give: str, terms: bool, view: str = "tps") -> str:
    """The type of segment()'s column."""
    views = {"tps": f",tps:{TERM_TPS if terms else TPS}", "words": ",words:string", "last": ",n_terms:int,prob:double"}
    kind = "struct<lang_idx:int,lang:string,score:double" + ("" if give == "scores" else views[view]) + ">"
    return kind if give == "best" else f"array<{kind}>"


def _results(texts: list[str], owns: list[str | None] | None, lex: Lexicon, langs: list[str], give: str, terms: bool, view: str = "tps") -> pa.Array:
    """segment()'s column of folded texts."""
    n = len(texts)
    if owns is None:
        each = viterbi(texts, lex, langs, give)
        kinds, lang = len(langs), np.tile(np.arange(len(langs)), n)
        scores = np.stack([w.scores(n) for w in each], axis=1)
        if give == "best":
            kinds, lang = 1, len(langs) - 1 - scores[:, ::-1].argmax(axis=1)
            scores = scores[np.arange(n), lang]
            each = [w.only(lang[w.text] == k) for k, w in enumerate(each)]
        scores, place = scores.ravel(), [w.text * kinds + (k if kinds > 1 else 0) for k, w in enumerate(each)]
    else:
        kinds, lang = 1, _own_places(owns, langs)
        each = viterbi(texts, lex, langs, give, lang)
        scores, place = each[0].scores(n), [each[0].text]
    flat = {"lang_idx": pa.array(lang, pa.int32()), "lang": pa.array([langs[k] for k in lang]), "score": pa.array(scores)}
    if give != "scores":
        place = np.concatenate(place)
        order = _order(place, n * kinds) if len(each) > 1 else slice(None)
        start, length, prob = (np.concatenate([getattr(w, c) for w in each])[order] for c in ("start", "length", "prob"))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=n * kinds))])
    if give != "scores" and view == "words":
        flat["words"] = _spaced(texts, kinds, length, offsets)
    elif give != "scores" and view == "last":
        flat["n_terms"] = pa.array(np.diff(offsets), pa.int32())
        flat["prob"] = pa.array(np.append(prob, 0.0)[offsets[1:] - 1], mask=np.diff(offsets) == 0)
    elif give != "scores":
        fields = {"start": pa.array(start, pa.int32()), "len": pa.array(length, pa.int32()), "prob": pa.array(prob)}
        if terms:
            fields = {"term": _cut(texts, kinds, length)} | fields
        flat["tps"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([*fields.values()], [*fields]))
    one = pa.StructArray.from_arrays([*flat.values()], [*flat])
    return one if give == "best" else pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * kinds, pa.int32()), one)


def best(results: str = "results") -> Column:
    """The result of the highest score; of equals the last language."""
    key = lambda r: F.struct(r["score"].alias("a"), r["lang_idx"].alias("b"), r.alias("c"))
    return F.array_max(F.transform(F.col(results), key))["c"]


def shares(results: str = "results", tps: bool = True) -> Column:
    """The results with `share`: exp(score / |least score|), over the sum of those of all languages.

    Blank texts have scores of 0 and no share (NaN).
    """
    low = F.abs(F.array_min(F.transform(F.col(results), lambda r: r["score"])))
    e = lambda r: F.when(low == 0, F.lit(float("nan"))).otherwise(F.exp(r["score"] / low))
    total = F.aggregate(F.transform(F.col(results), e), F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.col(results), lambda r: F.struct(r["lang_idx"].alias("lang_idx"), r["lang"].alias("lang"), r["score"].alias("score"), (e(r) / total).alias("share"), *([r["tps"].alias("tps")] if tps else [])))


def routed(results: str, lang: Column) -> Column:
    """The result of one language, the last one of that name; an unknown language is an error."""
    found = F.element_at(F.filter(F.col(results), lambda r: r["lang"] == lang), -1)
    return F.when(F.exists(F.col(results), lambda r: r["lang"] == lang), found).otherwise(F.raise_error(F.concat(F.lit("language not found: "), F.coalesce(lang, F.lit("null")))))


def terms(text: Column, tps: Column, folded: bool = True) -> Column:
    """The words as term (upper-cased as the model has them, or as the text has them) and prob. For short texts; segment(terms=True) gives those of any."""
    one = lambda t: F.transform(tps, lambda x: F.struct(F.substring(t, x["start"] + 1, x["len"]).alias("term"), x["prob"].alias("prob")))
    return T.let(T.fold_upper(text) if folded else text, one)


def segment_by_join(texts: DataFrame, model: DataFrame, id_col: str = "text_id", text: str = "text") -> DataFrame:
    """id, tps by joins, for models of any size (of one language)."""
    kept = materialise(model.select(F.lit("").alias("lang"), "term", "prob"), "segment-model")
    done = _segment_by_join(texts.select(F.col(id_col).alias("id"), F.col(text).alias("text")), kept, "text", [""], "results", None, False, "all")
    return done.select(F.col("id").alias(id_col), F.col("results")[0]["tps"].alias("tps"))


def _segment_by_join(df: DataFrame, model: DataFrame, text: str, langs: list[str], out: str, own: str | None, with_terms: bool, give: str, view: str = "tps") -> DataFrame:
    """segment() by joins: equal texts are done once."""
    if df.isStreaming:
        raise ValueError(f"streams take models of up to {MAX_TERMS} terms")
    key = "_text_key"
    folded = F.when(T.is_blank(F.col(text)), "").otherwise(T.fold_upper(F.col(text)))
    keyed = df.withColumn(key, F.sha2(folded if own is None else F.concat_ws("\0", F.col(own), folded), 256))
    base = keyed.select(F.col(key).alias("id"), folded.alias("t"), (F.lit(None).cast("string") if own is None else F.col(own)).alias("own")).dropDuplicates(["id"])
    found = _joined(base, model.filter(F.col("lang").isin(langs)), langs, own is not None, with_terms, give, view).select(F.col("id").alias(key), F.col("results").alias("_results"))
    return keyed.join(found.hint("merge"), key, "left").select(*[F.col(f"`{c}`") for c in df.columns], F.col("_results").alias(out))


def _hashed(texts: list[str], longest: int, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """at, n, first, second: the hashes of all substrings of n characters, n rising, by their place in the texts put together.

    Substrings are taken from each text's beginning alone, or, if `keep` is given, from each place for as long as it holds for the first hash.
    """
    code = _codes("".join(texts)).astype(np.uint64) + np.uint64(1)
    size = np.array(list(map(len, texts)), np.int64)
    end = np.cumsum(size)
    at, end = (end - size, end) if keep is None else (np.arange(len(code)), np.repeat(end, size))
    a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, longest + 1):
            inside = at + n <= end
            at, end, a, b = at[inside], end[inside], a[inside], b[inside]
            if not len(at):
                return
            c = code[at + n - 1]
            a, b = a * _A + c, b * _B + c
            h = _spread(a)
            if keep is not None:
                live = np.flatnonzero(keep(h))
                at, end, a, b, h = at[live], end[live], a[live], b[live], h[live]
            yield at, n, h, _spread(b)


def _tables(model: DataFrame) -> tuple[int, np.ndarray]:
    """The longest term's length and two tables of bits of one size, by leading bits of a hash: whether some term begins so, and whether there is such a term.

    Their size goes with the model's up to 2^_BITS bits each; beyond that they tell fewer substrings apart, and the join does the rest.
    """
    longest, chars = model.agg(F.max(F.length("term")), F.sum(F.length("term"))).first()
    longest, bits = longest or 1, max(10, min(_BITS, (8 * (chars or 1)).bit_length()))
    words = 1 << (bits - 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * words, np.uint64)

        def mark(h: np.ndarray, base: int) -> None:
            h = np.unique(h >> np.uint64(64 - bits))
            np.bitwise_or.at(table, (h >> np.uint64(6)).astype(np.int64) + base, np.uint64(1) << (h & np.uint64(63)))

        for whole in batches:
            for lo in range(0, whole.num_rows, 1 << 16):
                terms = [t for t in whole.column(0).slice(lo, 1 << 16).to_pylist() if t]
                size = np.array(list(map(len, terms)), np.int64)
                last = np.cumsum(size)
                for at, n, first, second in _hashed(terms, longest):
                    mark(first, 0)
                    mark(second[last[np.searchsorted(last, at, "right")] == at + n], words)
        at = np.flatnonzero(table)
        for lo in range(0, len(at), 1 << 16):
            k = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(table[k].view(np.int64))], names=["k", "bits"])

    rows = model.select("term").mapInArrow(run, "k bigint, bits bigint").groupBy("k").agg(F.bit_or("bits").alias("bits")).toArrow()  # bounded by _BITS
    table = np.zeros(2 * words, np.uint64)
    table[np.asarray(rows["k"])] = np.asarray(rows["bits"]).view(np.uint64)
    return longest, table


def _joined(base: DataFrame, model: DataFrame, langs: list[str], own: bool, with_terms: bool, give: str, view: str = "tps") -> DataFrame:
    """id, results (as segment() has them) of texts (id, t: folded, own).

    Each part's substrings that may be terms meet the model once; what is found
    is sent to the part's texts, never a row for a place of a text.
    """
    spark = base.sparkSession
    longest, table = _tables(model)
    shared = spark.sparkContext.broadcast(table)  # bounded by _BITS
    chars = base.agg(F.sum(F.length("t"))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    parts = max(cores, -(-chars // _PART))
    tasks = min(parts, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # A number of tasks of its own: texts are costly, and would be put together for their few bytes.
    dealt = base.withColumn("part", F.pmod(F.xxhash64("t"), F.lit(parts))).repartition(tasks, "part")

    def candidates(texts: pa.Table) -> pa.Table:
        whole = texts["t"].to_pylist()
        bits = shared.value
        words = len(bits) // 2
        shift = np.uint64(64 - (words.bit_length() + 5))

        def has(h: np.ndarray, base: int) -> np.ndarray:
            k = h >> shift
            return (bits[(k >> np.uint64(6)).astype(np.int64) + base] >> (k & np.uint64(63))) & np.uint64(1) > 0

        joined, out = "".join(whole), set()
        for at, n, _, second in _hashed(whole, longest, lambda h: has(h, 0)):
            out.update(joined[i : i + n] for i in at[np.flatnonzero(has(second, words))].tolist())
        return pa.table({"part": pa.array([texts["part"][0].as_py()] * len(out), pa.int64()), "term": pa.array(list(out), pa.string())})

    asked = dealt.groupBy("part").applyInArrow(candidates, "part bigint, term string")
    # What the candidates take isn't known to Spark, so neither side is broadcast.
    found = asked.join(model.select("lang", "term", "prob").hint("merge"), "term").select("part", "lang", "term", "prob").repartition(tasks, "part")
    schema = f"id {base.schema['id'].dataType.simpleString()}, results {_kind(give, with_terms, view)}"

    def run(texts: pa.Table, terms: pa.Table) -> pa.Table:
        # Of a repeated term the likeliest counts.
        lex = Lexicon.of(terms.select(["lang", "term", "prob"]).sort_by([("prob", "descending")]), langs)
        whole, owns = texts["t"].to_pylist(), texts["own"].to_pylist() if own else None
        done = [_results(whole[lo:hi], owns and owns[lo:hi], lex, langs, give, with_terms, view) for lo, hi in _slices(texts, whole)]
        return pa.table({"id": texts["id"], "results": pa.chunked_array(done)})

    return dealt.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, schema)
