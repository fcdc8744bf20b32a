"""Character and string functions as columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The dashes that count as part of a word, and white space.
DASHES = "‒–—―"
LETTER = r"\p{L}"
SPACE = r"[\t-\r \x{85}\x{A0}\p{Z}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once: it is bound to a lambda's variable, which inner lambdas don't make again."""
    return F.element_at(F.transform(F.array(value), use), 1)


@lru_cache(maxsize=1)
def upper_pairs() -> tuple[str, str]:
    """Characters beyond ASCII with an upper-case form of one character, and that form; Ё and ё become Е."""
    pairs = {chr(c): u for c in range(0x80, 0xFFFE) if not 0xD800 <= c < 0xE000 and len(u := chr(c).upper()) == 1 and u != chr(c) and ord(u) < 0xFFFE and chr(c) not in "ıſ"}
    pairs |= {"ё": "Е", "Ё": "Е"}
    return "".join(pairs), "".join(pairs.values())


def fold(text: str) -> str:
    """As fold_upper. Texts without characters that upper case takes otherwise (ß aside, which is ẞ meanwhile) take a short way."""
    if text.isascii():
        return text.upper()
    if _odd().search(text):
        return text.translate(_fold_table())
    return text.replace("ß", "ẞ").upper().replace("ẞ", "ß") if "ß" in text else text.upper()


@lru_cache(maxsize=1)
def _odd() -> re.Pattern[str]:
    table = _fold_table()
    return re.compile("[" + "".join(f"\\U{c:08x}" for c in range(0x80, 0x10000) if chr(c) != "ß" and (chr(c) == "ẞ" or chr(c).upper() != table.get(c, chr(c)))) + "\U00010000-\U0010FFFF]")


@lru_cache(maxsize=1)
def _fold_table() -> dict[int, str]:
    a, b = upper_pairs()
    return {ord(x): y for x, y in zip(a, b, strict=True)} | {c: chr(c - 32) for c in range(97, 123)}


def fold_upper(c: Column) -> Column:
    """Upper case, a character for a character, so that offsets stay. ASCII texts take the short way."""
    a, b = upper_pairs()
    low = "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.length(c), F.upper(c)).otherwise(F.translate(c, low + a, low.upper() + b))


def fold_upper_sql(c: str) -> str:
    a, b = upper_pairs()
    low = "abcdefghijklmnopqrstuvwxyz"
    return f"translate({c}, '{low}{a}', '{low.upper()}{b}')"


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"[^\t-\r \x{85}\x{A0}\p{Z}]")


def char_kinds(c: Column) -> Column:
    """What a single character is: letter, digit, white space, punctuation, a break of URLs, part of a scheme's name, dot, slash."""
    space, punct = c.rlike(rf"^{SPACE}\z"), c.rlike(r"^\p{P}\z")
    return F.struct(
        c.rlike(rf"^{LETTER}\z").alias("letter"), c.rlike(r"^\p{Nd}\z").alias("digit"), space.alias("space"), punct.alias("punct"),
        (space | (c == "\0") | (punct & (F.ascii(c) > 127))).alias("url_break"), c.rlike(r"^[A-Za-z-]\z").alias("scheme"), c.isin(".", "\uffff").alias("dot"), c.isin("/", "\\").alias("slash"),
    )


def has_digits(c: Column) -> Column:
    return c.rlike("[0-9]")


def has_cyrillics(c: Column) -> Column:
    return c.rlike("[А-яЁё]")


def has_cyrillics_or_digits(c: Column) -> Column:
    return c.rlike("[0-9А-яЁё]")


def is_letters(c: Column) -> Column:
    """All characters are letters; false for an empty text."""
    return c.rlike(rf"^{LETTER}+$")


def is_letters_or_dash(c: Column) -> Column:
    return c.rlike(rf"^[{LETTER}{DASHES}]+$")


def has_letters(c: Column) -> Column:
    return c.rlike(LETTER)


def has_cyrillic_letters(c: Column, percent: int) -> Column:
    """Whether so many of a hundred characters are from А to я, all characters or letters alone counted.

    Shares are single-precision products without their fraction, so one of 0 needs no Cyrillic letter among letters alone.
    """
    if percent <= 0:
        return F.lit(True)
    share = lambda n: F.floor((F.lit(percent / 100).cast("float") * n.cast("float")).cast("double"))
    cyr = F.regexp_count(c, F.lit("[А-я]"))
    return ((cyr > 0) & (cyr >= share(F.length(c)))) | (cyr >= share(F.regexp_count(c, F.lit(LETTER))))


def replace_invisible(c: Column) -> Column:
    """Control characters up to U+001E become spaces."""
    return F.regexp_replace(c, r"[\x00-\x1E]", " ")


def no_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def display_size(n: Column) -> Column:
    """Bytes as GB, MB, KB or bytes."""
    unit = lambda k, s: F.concat(F.format_number(n / float(k), 2), F.lit(s))
    return F.when(n > 1 << 30, unit(1 << 30, " GB")).when(n > 1 << 20, unit(1 << 20, " MB")).when(n > 1 << 10, unit(1 << 10, " KB")).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def trim_text(c: Column) -> Column:
    """Without white space at both ends, the byte order mark counted as such."""
    return F.regexp_replace(c, r"^[\t-\r \x{FEFF}\p{Z}]+|[\t-\r \x{FEFF}\p{Z}]+\z", "")


def wrap_text(c: Column, n: int = 50, mark: str = "<wbr/>") -> Column:
    """A mark after each n characters."""
    return F.regexp_replace(c, rf"(?s)(.{{{n}}})", rf"$1{mark}")


def limit_text(c: Column, n: int = 10_000) -> Column:
    """The recommended most of a request's text."""
    return F.substring(trim_text(c), 1, n)


def split_rows(c: Column) -> Column:
    """The pieces of a request's text: cut at line ends and spaces, blank ones dropped."""
    return F.filter(F.split(c, "[\r\n ]"), lambda x: ~is_blank(x))


#: What ends a word: white space and control characters up to U+001E.
_ENDS = r"\x00-\x1E \x{85}\x{A0}\p{Z}"


def simple_tokens(c: Column) -> Column:
    """Words, cut at white space and trimmed to letters; one that was trimmed to a single letter is dropped. Fold the text first for upper case.

    One expression goes over the text: from a word's first letter to its last, or a letter that is a word of its own.
    """
    return F.regexp_extract_all(c, F.lit(rf"{LETTER}[^{_ENDS}]*{LETTER}|(?<![^{_ENDS}]){LETTER}(?![^{_ENDS}])"), F.lit(0))
