"""Which code points libraries take for letters, numbers and white space: their Unicode tables are of different years.

Each library is asked about every code point once, so what is built on the answers splits texts as that library does.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
ASKED = {LETTER: r"\p{L}", NUMBER: r"\p{N}", SPACE: r"\s"}
#: All code points that UTF-8 can hold.
ALL = [*range(0xD800), *range(0xE000, 0x110000)]


def _filled(found) -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ASKED.items():
        out[np.fromiter(map(ord, found(pattern)), np.int64)] = kind
    return out


@cache
def by_tiktoken() -> np.ndarray:
    """The class of every code point in tiktoken's patterns: what a pattern doesn't match is left out of its tokens."""
    import tiktoken

    text = "".join(map(chr, ALL))

    def found(pattern):
        e = tiktoken.Encoding("one", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        return bytes(e.encode_ordinary(text)).decode()

    return _filled(found)


@cache
def by_tokenizers() -> np.ndarray:
    """The same in the tokenizers library's patterns: what is left once all that isn't the class is cut out."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    def found(pattern):
        other = r"\S+" if pattern == r"\s" else pattern.replace("p", "P", 1) + "+"
        cut = Split(Regex(other), "removed")
        return "".join(x for at in range(0, len(ALL), 4096) for x, _ in cut.pre_tokenize_str("".join(map(chr, ALL[at : at + 4096]))))

    return _filled(found)


@cache
def by_regex() -> np.ndarray:
    """The same in the regex package's patterns."""
    import regex

    text = "".join(map(chr, ALL))
    return _filled(lambda pattern: regex.findall(pattern, text))


def ranges(wanted: np.ndarray) -> str:
    """The code points for which wanted holds, as the inside of a character class."""
    at = np.flatnonzero(wanted)
    ends = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.concatenate([[0], ends + 1])] if len(at) else at, at[np.concatenate([ends, [len(at) - 1]])] if len(at) else at
    return "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(first.tolist(), last.tolist()))


def differing(a: np.ndarray, b: np.ndarray) -> str:
    """A character class of the code points on which two tables differ; one that matches nothing if they are alike."""
    inside = ranges(a != b)
    return f"[{inside}]" if inside else r"(?!)"
