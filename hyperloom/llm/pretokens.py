"""Splitting text as the pre-tokenizer pattern of the public byte-level BPE vocabularies does, by array operations.

The pattern's classes are letters, numbers, white space and the rest. A run of one class is a piece; a blank
before a run other than white space goes with it; of white space before other text the last character stands
alone, unless it is such a blank; the seven contractions stand alone where a piece would start with them.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

LETTER, NUMBER, SPACE, OTHER = range(4)


@cache
def classes(library: str) -> np.ndarray:
    """The class of every code point in the tables of `tiktoken` or `tokenizers`; their Unicode versions differ."""
    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        if library == "tiktoken":
            only = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            found = bytes(only.encode_ordinary(text)).decode()
        else:
            found = "".join(x for x, _ in Split(Regex(f"(?:{name})+"), "removed", invert=True).pre_tokenize_str(text))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def piece_bounds(text: str, starts: np.ndarray | None = None, library: str = "tiktoken") -> np.ndarray:
    """The bounds of the pieces: 0, the ends of all pieces, in code points.

    `starts` are the places where another text starts, if `text` is many texts joined.
    """
    n = len(text)
    if not n:
        return np.zeros(1, np.int64)
    if text.isascii():
        points = np.frombuffer(text.encode("ascii"), np.uint8)
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes(library)[points]
    fresh = np.zeros(n + 1, bool)
    fresh[0] = fresh[n] = True
    if starts is not None:
        fresh[starts] = True
    cut = fresh.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    # white space before other text: its last character is cut off, and a blank joins what follows
    before = np.flatnonzero(cut[1:n] & ~fresh[1:n] & (kind[:-1] == SPACE)) + 1
    cut[before - 1] = True
    cut[before[points[before - 1] == 32]] = False
    # contractions: a lone apostrophe that starts a piece, then one of the endings
    quote = np.flatnonzero((points[: n - 1] == 39) & (kind[1:] == LETTER) & cut[: n - 1] & ~fresh[1:n])
    for q in quote.tolist():
        if text[q + 1] in "stmd":
            end = q + 2
        elif text[q + 1 : q + 3] in ("re", "ve", "ll") and not fresh[q + 2]:
            end = q + 3
        else:
            continue
        cut[q + 1] = False
        cut[end] = True
    return np.flatnonzero(cut)


def byte_bounds(data: np.ndarray, offsets: np.ndarray, library: str = "tiktoken", pattern: str = public_tokenizers.PATTERN) -> np.ndarray:
    """The bounds of all pieces, in bytes, of joined UTF-8 texts that start at `offsets`; each text's own bounds are among them."""
    if not len(data):
        return np.zeros(1, np.int64)
    text = data.tobytes().decode()
    firsts = np.flatnonzero((data & 0xC0) != 0x80) if len(text) < len(data) else None
    starts = offsets if firsts is None else np.searchsorted(firsts, offsets)
    if pattern == public_tokenizers.PATTERN:
        found = piece_bounds(text, starts, library)
    else:
        ends = [a + m.end() for a, b in zip(starts.tolist(), starts.tolist()[1:], strict=False) for m in regex.finditer(pattern, text[a:b])]
        found = np.unique(np.array([*starts.tolist(), *ends], np.int64))
    return found if firsts is None else np.append(firsts, len(data))[found]


def pieces(text: str, library: str = "tiktoken", pattern: str = public_tokenizers.PATTERN) -> list[str]:
    """The pieces of one text."""
    data = np.frombuffer(text.encode(), np.uint8)
    at = byte_bounds(data, np.array([0, len(data)]), library, pattern).tolist()
    return [data[a:b].tobytes().decode() for a, b in zip(at, at[1:], strict=False)]
