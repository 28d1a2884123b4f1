"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds
every token that occurs in a piece in one pass. A piece is then encoded from the longest match at each
position; two adjacent tokens are accepted only if byte-pair merging could have left that boundary
standing, which is worked out once for each pair of tokens and remembered. Where no token can follow,
the last one is given up for the next shorter. Each position is given up at most once, so the time is
linear in the piece, and the tokens are exactly those of merging by rank.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import letters
from .common import Memo, exact, shipped

#: Pieces that a worker remembers, pieces encoded at once of a huge text, characters that make it one, and rows of a result batch.
MEMO_PIECES, BLOCK_PIECES, HUGE_CHARS, ROWS = 500_000, 200_000, 1 << 20, 256

#: Texts of these characters alone are split alike by the standard library's re with FAST, which is quicker.
PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7e\\u00a0-\\u00a9\\u00ab-\\u00b1\\u00b4-\\u00b8\\u00ba\\u00bb\\u00bf-\\u024f\\u2010-\\u2027\\u2030-\\u203e\\u20ac]*")
FAST_CLASSES = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"))


def library_classes() -> tuple[str, ...]:
    """What tiktoken's patterns and the regex package's class differently, and tiktoken's letters, numbers and white space, as insides of character classes."""
    own = letters.by_tiktoken()
    return letters.ranges(own != letters.by_regex()), *(letters.ranges(own == k) for k in (letters.LETTER, letters.NUMBER, letters.SPACE))


def spelled(pattern: str, classes: tuple[str, ...]) -> str | None:
    """pattern for the standard library's re with these letters, numbers and white space in place of its classes; None if it has others."""
    of = dict(zip((r"\p{L}", r"\p{N}", r"\s"), classes[1:]))
    out, at, inside = "", 0, False
    while at < len(pattern):
        name = next((n for n in (*of, r"\S") if pattern.startswith(n, at)), None)
        if name is None:
            if pattern[at : at + 2].lower() in (r"\p", r"\w", r"\d"):
                return None
            step = 2 if pattern[at] == "\\" else 1
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out += pattern[at : at + step]
        elif name == r"\S":
            if inside:
                return None
            step = 2
            out += f"[^{of[chr(92) + 's']}]"
        else:
            step = len(name)
            out += of[name] if inside else f"[{of[name]}]"
        at += step
    return out


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The tokens and ranks of a vocabulary file with a base64 token and a number a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class ByteBPE:
    """Encodes and decodes by a table of ranks; pieces of a text are the matches of pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, classes: tuple[str, ...] | None = None):
        """classes: as from library_classes(), asked for if they aren't given."""
        import ahocorasick
        import regex

        self.ids = {t.decode("latin-1"): k for t, k in ranks.items()}
        self.text = {k: t for t, k in self.ids.items()}
        self.bytes_of = {str(k): t for t, k in ranks.items()}
        self.name = {k: str(k) for k in self.text}
        self.before_end = {k: len(t) - 1 for k, t in self.text.items()}
        if missing := [b for b in range(256) if chr(b) not in self.ids]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.longest_token = max(map(len, self.ids))
        self.beside = Memo(lambda pair: self.stands(*pair), 1 << 20)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, k in sorted(self.ids.items(), key=lambda x: x[1]):
            if len(t) == 1:
                self.parts[k] = None
            else:
                cut = next((s for i in range(1, len(t)) if (s := (self.ids.get(t[:i], -1), self.ids.get(t[i:], -1))) and min(s) >= 0 and max(s) < k and s[0] in self.parts and s[1] in self.parts and self.stands(*s, k)), None)
                if cut is None:  # merging never makes this token; it stands for a whole piece only
                    continue
                self.parts[k] = cut
            self.find.add_word(t, k)
        self.find.make_automaton()
        self.shorter = Memo(self.next_shorter, 1 << 20)
        self.pattern = regex.compile(pattern)
        # Texts with a code point that this package classes otherwise are split by tiktoken's classes spelled out, which is slower.
        classes = classes or library_classes()
        exactly = spelled(pattern, classes) if classes[0] else None
        self.odd, self.exactly = (re.compile(f"[{classes[0]}]"), re.compile(exactly)) if exactly else (None, None)
        fast = pattern
        for a, b in FAST_CLASSES[::-1]:
            fast = fast.replace(a, b)
        for a, b in ((r"[\p{L}]", FAST_CLASSES[0][1]), (r"[\p{N}]", FAST_CLASSES[1][1])):
            fast = fast.replace(a, b)
        self.fast = None if r"\p" in fast else re.compile(fast)
        self.pieces = Memo(lambda s: ",".join(map(self.name.__getitem__, self.encode_piece(s.encode()))), MEMO_PIECES)
        self.decoded = Memo(self.decode, MEMO_PIECES // 4)

    def stands(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether no merge below limit joins a and b across their boundary.

        Goes back through the merges that made both. At any time the tokens beside the boundary are on the
        right edge of a and the left edge of b; their pair merges if its rank comes before the merges
        that use either of them up, and on a tie before that on the right.
        """
        ids, text, parts = self.ids, self.text, self.parts
        while True:
            if (joint := ids.get(text[a] + text[b])) is not None and joint < limit:
                return False
            left, right = parts[a], parts[b]
            if left and (a > b or not right):
                limit, a = a, left[1]
            elif right:
                limit, b = b + 1, right[0]
            else:
                return True

    def next_shorter(self, k: int) -> int | None:
        """The longest token that token k begins with and that merging can make."""
        t = self.text[k]
        return next((x for i in range(len(t) - 1, 0, -1) if (x := self.ids.get(t[:i])) is not None and x in self.parts), None)

    def encode_piece(self, piece: bytes) -> list[int]:
        s = piece.decode("latin-1")
        if (k := self.ids.get(s)) is not None:
            return [k]
        # Longest matches one after the other; right at once if no boundary between them would have merged.
        out, last = [], None
        for _, k in self.find.iter_long(s):
            if last is not None and not self.beside[last, k]:
                break
            out.append(k)
            last = k
        else:
            return out
        n, size, beside = len(s), self.before_end, self.beside
        longest = [0] * n
        for end, k in self.find.iter(s):
            longest[end - size[k]] = k  # a later end is a longer match
        out = []
        last, dead, at, k = None, bytearray(n + 1), 0, longest[0]
        while True:
            end = at + size[k] + 1
            if not dead[end] and (last is None or beside[last, k]):
                out.append(k)
                if end == n:
                    return out
                last, at, k = k, end, longest[end]
                continue
            while (k := self.shorter[k]) is None:
                dead[at] = 1
                k = out.pop()
                at -= size[k] + 1
                last = out[-1] if out else None

    def split(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, in blocks."""
        pattern = self.fast if self.fast and PLAIN.fullmatch(text) else self.exactly if self.odd and self.odd.search(text) else self.pattern
        if len(text) <= HUGE_CHARS:
            yield pattern.findall(text)
        else:
            found = (m.group() for m in pattern.finditer(text))
            while block := list(islice(found, BLOCK_PIECES)):
                yield block

    def encode(self, text: str) -> Iterator[str]:
        """The ids in decimal, joined by commas, block by block (blocks are not empty)."""
        return (",".join(block) for block in self.encode_pieces(text))

    def encode_pieces(self, text: str) -> Iterator[list[str]]:
        get = self.pieces.__getitem__
        return (list(map(get, block)) for block in self.split(text) if block)

    def decode(self, ids: str) -> bytes:
        """The bytes of ids in decimal joined by commas."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""

    def decode_pieces(self, pieces: list[str]) -> bytes:
        """The same from the ids of pieces; what a piece's ids decode to is remembered."""
        return b"".join(map(self.decoded.__getitem__, pieces))

    def digest(self, text: str, ids: list[np.ndarray] | None = None) -> tuple[int, str, str]:
        """Number of tokens; SHA-256 of the ids joined by commas, and of the bytes decoded from them. Appends the ids, by blocks, to a list if given."""
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for pieces in self.encode_pieces(text):
            block = ",".join(pieces)
            of_ids.update((("," if n else "") + block).encode())
            of_bytes.update(self.decode_pieces(pieces))
            n += block.count(",") + 1
            if ids is not None:
                ids.append(np.array(block.split(","), np.int32))
        return n, of_ids.hexdigest(), of_bytes.hexdigest()


_CODECS: dict[tuple, ByteBPE] = {}


def _codec(vocabulary, pattern: str, classes: tuple[str, ...]) -> ByteBPE:
    """One codec a Python worker, kept with what it remembers while the worker lives."""
    data = vocabulary.value
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ByteBPE(read_ranks(data), pattern, classes)
    return _CODECS[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256, and with with_ids also ids (array<int>). A null
    text counts as empty: no tokens and the digests of nothing. Repeated rows give repeated results, a null id
    stays null, other columns are left out, and an empty table gives an empty one. A text is encoded in blocks of
    pieces; only its own ids are held, and those only if they are asked for.
    """
    vocabulary, classes = shipped(docs.sparkSession, path), library_classes()
    source = docs.select(exact(id_col).alias("id"), exact(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(vocabulary, pattern, classes)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                ids: list[np.ndarray] | None = [] if with_ids else None
                found = [codec.digest(x or "", ids) for x in batch.column(1).to_pylist()]
                cols = [batch.column(0), *(pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string())))]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids is not None:
                    ends = np.cumsum([0, *(x[0] for x in found)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(ends, np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    quoted = "`" + id_col.replace("`", "``") + "`"
    return source.mapInArrow(run, f"{quoted} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
