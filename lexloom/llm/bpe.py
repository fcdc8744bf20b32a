"""Byte-level BPE by the tiktoken library, from a local rank file.

Texts are cut into stretches at safe places before the library sees them, so
that its regular expression works on bounded strings. A place is safe where
every match of the pattern ends whatever stands around it; the ids are then
those of the whole text. Texts under another pattern are not cut. Null and empty
texts have no ids. Decoding joins the ids' raw bytes, which is exact for any
text. Rows stay as they are, repeated ones included; an output whose name exists
gets underscores in front. Where the library has a choice of merges it takes the
lowest rank, of equal ones the first.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_columns

FILE = "byte_bpe_multi_50k.tiktoken"
#: Stretches are cut at the first safe place from here on.
STRETCH = 1 << 16
_CUT = re.compile(r"(?<=\S)[\n ]")
#: Runs, too long for the library's expression, of what the pattern counts as white space.
_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{16384,}")


def rank_path(name: str = FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """The encoding of a rank file; one per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """Cuts before a line feed or space that follows anything but white space.

    No match of the pattern holds white space after another character, so a
    match ends there, and the next one starts at the white space. Python counts
    all as white space that the pattern does. A text without such a place stays
    whole.
    """
    out, start = [], 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    if start < len(text):
        out.append(text[start:])
    return out


def encode_text(enc, text: str | None, cut: bool = True) -> list[int]:
    """The ids of a text. `cut`: its pattern is the one that the safe places are for.

    The library's regular expression runs out of stack on very long white
    space. The pattern takes a run of it but for its last character as one
    match (at the end of the text all of it), so such runs go to the library
    as single pieces, without the expression.
    """
    if not text:
        return []
    if len(text) <= STRETCH or not cut:
        return enc.encode_ordinary(text)
    ids, start = [], 0
    for run in _BLANK.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        for part in stretches(text[start : run.start()]):
            ids += enc.encode_ordinary(part)
        ids += enc._core_bpe.encode_single_piece(text[run.start() : stop].encode())
        start = stop
    for part in stretches(text[start:]):
        ids += enc.encode_ordinary(part)
    return ids


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, ids: str = "ids", path: str | None = None, pattern: str | None = None, digests: bool = True, with_ids: bool = True) -> DataFrame:
    """Adds the ids of each text (array), and n_tokens with the digests of ids and decoded bytes.

    `path` is a rank file that every executor has; by default the installed one.
    """
    cols = [f"{ids} array<int>"] * with_ids + ["n_tokens bigint, ids_sha256 string, decoded_sha256 string"] * digests

    def run(texts: list[str | None]) -> list[pa.Array]:
        import public_tokenizers

        enc = encoder(path or rank_path(), pattern or public_tokenizers.PATTERN)
        cut = pattern in (None, public_tokenizers.PATTERN)
        names = _names(path or rank_path())
        out, n, a, b = [], [], [], []
        for t in texts:
            got = encode_text(enc, t, cut)
            if with_ids:
                out.append(np.array(got, np.int32))
            n.append(len(got))
            a.append(hashlib.sha256(",".join([names[i] for i in got]).encode()).hexdigest())
            b.append(hashlib.sha256(enc.decode_bytes(got)).hexdigest())
        return [pa.array(out, pa.list_(pa.int32()))] * with_ids + [pa.array(n, pa.int64()), pa.array(a), pa.array(b)] * digests

    return map_columns(df, [text], ", ".join(cols), run, keep)


@lru_cache(maxsize=2)
def _names(path: str) -> list[str]:
    with open(path, "rb") as f:
        return [str(i) for i in range(1 + max(int(x.split()[1]) for x in f))]


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the raw bytes of each list of ids; a null list gives none."""

    def run(rows: list[list[int] | None]) -> list[pa.Array]:
        import public_tokenizers

        enc = encoder(path or rank_path(), pattern or public_tokenizers.PATTERN)
        return [pa.array([enc.decode_bytes(r or []) for r in rows], pa.binary())]

    return map_columns(df, [ids], f"{out} binary", run)
