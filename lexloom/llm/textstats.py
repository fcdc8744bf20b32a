"""Statistics of one text, shared by the quality classifier and the quality rules."""

from __future__ import annotations

from collections import Counter

import numpy as np

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further numbers, all of them ratios or logarithms, for the learned parts.
RATIOS = (
    "log_words", "log_chars", "word_len", "upper_ratio", "digit_ratio", "punct_ratio", "symbol_ratio", "bang_ratio",
    "bar_ratio", "other_ratio", "line_words", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "top_ratio",
    "same_next_ratio", "stop_end_ratio", "caps_word_ratio",
)
NAMES = BASE + RATIOS
DDL = ", ".join([*(f"{n} bigint" for n in BASE), *(f"{n} double" for n in RATIOS)])
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOL = [ord(c) for c in SYMBOLS]


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in some window of `width` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : n + i] for i in range(width)), strict=True))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def stats(text: str | None) -> list[float]:
    """The values of NAMES; a null text counts as an empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space alone
    n, chars = len(words), len(text)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    word_chars = chars - int(hist[[32, *range(9, 14)]].sum())
    symbols = int(hist[_SYMBOL].sum())
    upper, lower, digits = int(hist[65:91].sum()), int(hist[97:123].sum()), int(hist[48:58].sum())
    counts = Counter(words)
    w, c, k = max(n, 1), max(word_chars, 1), max(len(lines), 1)
    return [
        n, word_chars, symbols, dup_lines, repeats,
        float(np.log1p(n)), float(np.log1p(chars)), word_chars / w, upper / max(upper + lower, 1), digits / c,
        int(hist[_PUNCT].sum()) / c, symbols / w, int(hist[33]) / w, int(hist[124]) / w, int(hist[128:].sum()) / c,
        float(np.log1p(n / k)), dup_lines / k, repeats / w, len(counts) / w, max(counts.values(), default=0) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w, sum(map(_ends, words)) / w, sum(map(bytes.isupper, words)) / w,
    ]


def _ends(word: bytes) -> bool:
    return word[-1] in b".!?"


def columns(texts: list[str | None]) -> list:
    import pyarrow as pa

    rows = list(zip(*map(stats, texts), strict=True))
    return [pa.array(v, pa.int64() if i < len(BASE) else pa.float64()) for i, v in enumerate(rows)]
