"""URL spans and the exact word tokenizer, row by row in Arrow batches.

Both look at characters with memory of what came before, which column
expressions can't say; each row is on its own, so nothing is shuffled. Texts are
scanned by compiled expressions from left to right, in time that grows with
their length alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import fold

#: Top-level domains, by default.
DOMAINS = """
ac ad ae aero af ag ai al am an ao aq ar as asia at au aw az ba bb bd be bf bg bh bi biz bj bm bn bo br bs bt bv bw by bz ca cat cc cd cf cg ch ci ck cl cm cn co com coop
cr cu cv cx cy cz de dj dk dm do dz ec edu ee eg eh er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gov gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il
im in info int io iq ir is it je jm jo jobs jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md mg mh mil mk ml mm mn mo mobi mp mq mr ms mt mu
museum mv mw mx my mz na name nato nc ne net nf ng ni nl no np nr nu nz om org pa pe pf pg ph pk pl pm pn pr pro ps pt pw py qa re ro ru rw sa sb sc sd se sg sh si sj sk
sl sm sn so sr st su sv sy sz tc td tel tf tg th tj tk tm tn to tp tr travel tt tv tw tz ua ug uk um us uy uz va vc ve vg vi vn vu wf ws ye yt yu za zm zw ру рф нет орг
ком
"""
#: URI schemes that start a URL, by default.
SCHEMES = """
javascript jdbc acap adiumxtra attachment bitcoin chrome chrome-extension com-eventbrite-attendee cvs dns ed2k facetime file finger fish gizmoproject gopher http https iax imap
irc irc6 ircs jabber jar ldap mailto mms ms-help ms-settings-power ###########news snews nntp rtmp rtsp ftp sftp tftp skype snmp ssh telnet udp uuid urn ws wss xmpp magnet
"""
#: Characters that end a word besides punctuation; punctuation that doesn't; what a number may be written with.
ENDS_WORD = "¥©¤¦§®¶€™<>"
IN_WORD = "&'-._­՚՛՝‒–—―‘’‛"
IN_NUMBER = ";,:./\\- –〃´°"


@dataclass(frozen=True)
class Names:
    """Upper-cased top-level domains and URI schemes."""

    domains: frozenset[str]
    schemes: frozenset[str]


def names_of(domains: list[str], schemes: list[str]) -> Names:
    """Trimmed, upper-cased, without empty ones and repeats."""
    return Names(*(frozenset(fold(x.strip()) for x in v if x.strip()) for v in (domains, schemes)))


@lru_cache(maxsize=1)
def default_names() -> Names:
    return names_of(DOMAINS.split(), SCHEMES.split())


def kind(ch: str) -> str:
    """L letter, D digit, S white space, P punctuation, o other."""
    cat = unicodedata.category(ch)
    if ch in "\t\n\v\f\r\x85" or cat[0] == "Z":
        return "S"
    return "D" if cat == "Nd" else cat[0] if cat[0] in "LP" else "o"


class Scanner:
    """Expressions over the kinds of characters; one for each process."""

    def __init__(self) -> None:
        of: dict[str, list[str]] = {k: [] for k in "LDSPo"}
        for i in range(0x110000):
            of[kind(chr(i))].append(chr(i))

        def chars(*kinds: str, extra: str = "", less: Callable[[str], bool] = lambda _: False) -> str:
            codes = sorted({ord(c) for k in kinds for c in of[k] if not less(c)} | set(map(ord, extra)))
            spans, lo = [], codes[0]
            for a, b in zip(codes, [*codes[1:], -1], strict=True):
                if b != a + 1:
                    spans.append(f"\\U{lo:08x}-\\U{a:08x}")
                    lo = b
            return "".join(spans)

        ends = chars("P", extra=ENDS_WORD, less=lambda c: c in IN_WORD)
        space, both = chars("S"), chars("P", "S")
        #: What separates words (white space, or a character that ends words with all white space and punctuation after it), then a run.
        self.run = re.compile(f"(?:[{space}]|[{ends}][{both}]*+)*+([^{space}{ends}]*+)")
        self.word = re.compile(f"[{chars('L', 'D')}](?:.*[{chars('L', 'D')}])?", re.S)
        self.number = re.compile(f"[{chars('D', extra=IN_NUMBER)}]+")
        self.space = re.compile(f"[{space}]")
        self.stop = re.compile(f"[{chars('S', extra=chr(0))}{chars('P', less=lambda c: c < chr(0x80))}]")
        self.letters = re.compile(f"[{chars('L')}]*+")
        self.lead = re.compile(f"[{chars('P', 'S', less=lambda c: c == '/')}]*+")
        self.close = re.compile(f"[{chars('P', less=lambda c: c == '/')}]")
        self.mark = re.compile("[.:]")
        self.scheme = re.compile(r"[A-Z-]*\Z")


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def spans(text: str, names: Names, folded: bool = False) -> list[tuple[int, int]]:
    """Start and length of each URL, in the order of the mark that gave it; they may overlap.

    A dot gives one after www or before a top-level domain (of names joined by
    dots the last that is one), a colon after a scheme. It ends before the next
    break, less closing punctuation, if it has a path. One by its domain starts
    after the break before it, less leading punctuation.
    """
    if not folded:
        text = fold(text)
    text = text.partition("\0")[0]
    x, out, at = scanner(), [], 0
    longest_scheme, longest_domain = (max(map(len, v), default=0) for v in (names.schemes, names.domains))
    breaks = x.stop.finditer(text)
    coming = next(breaks, None)
    first, known_for = 0, -1  # where a URL after the last break starts, and for which break
    last = 0

    def right_end(at: int, least: int) -> int:
        m = x.stop.search(text, at)
        end = (m.start() if m else len(text)) - 1
        while end > least and x.close.match(text, end):
            end -= 1
        return max(end, least)

    def label_end(dot: int) -> int:
        """Where a known domain after the dot ends, or -1."""
        end = x.letters.match(text, dot + 1, dot + 2 + longest_domain).end()
        return end if text[dot + 1 : end] in names.domains else -1

    while m := x.mark.search(text, at):
        p = m.start()
        at = p + 1
        if m[0] == ":":
            name = x.scheme.search(text[max(0, p - longest_scheme - 2) : p])[0]
            if not name or len(name) > longest_scheme + 1:
                continue
            if name not in names.schemes:
                at = p + 2
                continue
            start, end = p - len(name), right_end(p, p)
        elif p >= 3 and text.startswith("WWW", p - 3):
            start, end = p - 3, right_end(p, p)
        else:
            dot, end = p, label_end(p)
            if end < 0:
                at = p + 2
                continue
            while end < len(text) and text[end] in ".￿" and (deeper := label_end(end)) >= 0:
                dot, end = end, deeper
            while coming is not None and coming.start() < p:
                last, coming = coming.end(), next(breaks, None)
            if known_for != last:
                first, known_for = x.lead.match(text, last).end(), last
            if first >= dot:
                continue
            start, end = first, right_end(end - 1, dot) if end < len(text) and text[end] in "/\\" else end - 1
        out.append((start, end + 1 - start))
        at = max(end + 2, p + 1)
    return out


def words(text: str, names: Names) -> Iterator[str]:
    """The words of a line. A number is dropped when a space or the like ends it."""
    text = fold(text).partition("\0")[0]
    x, at = scanner(), 0
    for start, size in [*spans(text, names, folded=True), (len(text), 0)]:
        for m in x.run.finditer(text, at, max(start, at)):
            if (run := m[1]).isalpha():  # letters alone: no number, and nothing to trim
                yield run
                continue
            if not run:
                continue
            a, b = m.span(1)
            if b < len(text) and (b == start or x.space.match(text, b)) and x.number.fullmatch(text, a, b + 1):
                continue
            w = x.word.search(text, a, b)
            if w and (w.end() - w.start() > 1 or b - a == 1):
                yield w[0]
        at = max(at, start + size)


def _batches(df: DataFrame, text: str, ddl: str, make: Callable[[list[str | None]], pa.Array]) -> DataFrame:
    """Adds a column of lists, one for each row."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(ddl).fields
    if clash := {f.name.lower() for f in added} & {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column of that name already: {sorted(clash)}")
    schema = StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                yield pa.RecordBatch.from_arrays([*b.columns, make(b.column(b.schema.get_field_index(text)).to_pylist())], names=schema.names)

    return df.mapInArrow(run, schema)


def with_urls(df: DataFrame, text: str = "text", out: str = "urls", values: bool = True, names: Names | None = None) -> DataFrame:
    """Adds the URLs of each text: start, len and, if wanted, value. A null text has none."""
    n = names or default_names()
    fields = [("start", pa.int32()), ("len", pa.int32()), *([("value", pa.string())] if values else [])]

    def make(texts: list[str | None]) -> pa.Array:
        rows = [[dict(start=a, len=k, **({"value": t[a : a + k]} if values else {})) for a, k in spans(t or "", n)] for t in texts]
        return pa.array(rows, pa.list_(pa.struct(fields)))

    return _batches(df, text, f"{out} array<struct<start:int,len:int{',value:string' if values else ''}>>", make)


def with_words(df: DataFrame, text: str = "text", out: str = "words", names: Names | None = None) -> DataFrame:
    """Adds the exact tokenizer's words of each text, line by line. A null text has none."""
    n = names or default_names()

    def make(texts: list[str | None]) -> pa.Array:
        return pa.array([[w for line in re.split("\r\n|\r|\n", t or "") for w in words(line, n)] for t in texts], pa.list_(pa.string()))

    return _batches(df, text, f"{out} array<string>", make)
