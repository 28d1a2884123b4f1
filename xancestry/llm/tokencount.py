"""Token counts of texts of any length by overlapping chunks that are spliced where they agree.

A huge text is cut into chunks that overlap. Each chunk is encoded with offsets, and neighbours are
spliced at a boundary inside their overlap that both encodings have and that is proven stable: a place
where no token of either reaches across and where neither normalisation nor the tokenizer's splitting can look
across. If an overlap holds no such boundary it is widened, at last to the rest of the text, so the count
is always that of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import exact, shipped

#: Characters of a chunk and of the overlap of two, and words that a worker remembers.
CHUNK_CHARS, OVERLAP_CHARS, MEMO_WORDS = 1 << 15, 256, 1_000_000

#: A white space character of ASCII is a starter that composes with nothing, and no token holds one once the
#: tokenizer drops white space; so a text can be cut on either side of it. Used by tokenizers for which
#: drops_white_space() holds.
SPACE = re.compile(r"[\t-\r ]")
#: Normalizers that look at no more than a character, its marks and a run of white space, so never across white space of ASCII.
LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}
#: What a splitting pattern may be made of so that no match holds white space: alternatives of plain letters and of classes without it.
UNSPACED = re.compile(r"(?:'[a-z]+|\[(?:\\p\{[LNM]\})+\]\+?|\\p\{[LNM]\}\+?|\[\^\\s(?:\\p\{[LNM]\})*\]\+?)")


class Counter:
    """Counts tokens with a tokenizers file; no special tokens, truncation or padding."""

    def __init__(self, data: bytes, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        from tokenizers import Tokenizer

        if not 0 < overlap < chunk:
            raise ValueError("an overlap has to be shorter than a chunk")
        # A Python worker has one core; the library's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok, self.chunk, self.overlap = Tokenizer.from_str(data.decode()), chunk, overlap
        self.parts = json.loads(data)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.by_word = self.drops_white_space() and not any(SPACE.search(x) for x in self.specials)
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.widened = 0

    def drops_white_space(self) -> bool:
        """Whether white space of ASCII gives no token and is always a boundary.

        Known from the tokenizer's parts: every normalizer is local or turns white space into a space, the first step of splitting
        keeps only matches of a pattern that can't hold white space, and what follows works within a match. Other tokenizers
        aren't cut. Probes with the tokenizer itself have to agree.
        """
        steps = lambda x, many: [] if x is None else x[many] if x["type"] == "Sequence" else [x]
        norms, splits = steps(self.parts["normalizer"], "normalizers"), steps(self.parts["pre_tokenizer"], "pretokenizers")
        local = all(x["type"] in LOCAL or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in norms)
        first = splits[0] if splits else {"type": None}
        split = first["type"] in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer") or (
            first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and all(map(UNSPACED.fullmatch, first["pattern"].get("Regex", " ").split("|")))
        )
        if not local or not split or any(x["type"] == "ByteLevel" and x["add_prefix_space"] for x in splits):
            return False
        ids = lambda x: self.tok.encode(x, add_special_tokens=False).ids
        probes = ["a", "a's", "'s", "12", ".,", "é", "é", "́", "ß", "中", "Σ"]
        return all(ids(a + s + b) == ids(a) + ids(b) and ids(s) == [] for s in "\t\n\v\f\r " for a in probes for b in probes)

    def of_words(self, text: str) -> int:
        """Of a text that fits a chunk. Words between white space are encoded each once and remembered.

        Two generations are kept: when the young one is full it takes the old one's place, and what is used of that comes
        back, so that the frequent words stay.
        """
        if not self.by_word:
            return len(self.tok.encode_batch_fast([text], add_special_tokens=False)[0])
        words, known = SPACE_RUN.split(text), self.words
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        new = set(words).difference(known)
        if len(known) + len(new) > MEMO_WORDS // 2:
            self.older, self.words = known, {}
            known, new = self.words, set(words)
        older = self.older
        if back := [w for w in new if w in older]:
            known.update((w, older[w]) for w in back)
            new.difference_update(back)
        new = list(new)
        known.update(zip(new, map(len, self.tok.encode_batch_fast(new, add_special_tokens=False))))
        return sum(map(known.__getitem__, words))

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return self.tok.encode(text, add_special_tokens=False).offsets

    def stable(self, text: str, lo: int, hi: int, left: list, right: list, left_at: int, right_at: int) -> int | None:
        """The last place in text[lo:hi] at which both encodings (offsets from left_at and right_at) can be cut and agree that no token crosses, or None."""
        crossed = [{p + at for a, b in found for p in range(a + 1, b)} for found, at in ((left, left_at), (right, right_at))] if hi - lo <= 4096 else None
        for p in range(hi - 1, lo - 1, -1):
            if not SPACE.match(text, p):
                continue
            if crossed is None:
                if any(a + at < p < b + at for found, at in ((left, left_at), (right, right_at)) for a, b in found):
                    continue
            elif p in crossed[0] or p in crossed[1]:
                continue
            return p
        return None

    def count(self, text: str) -> int:
        """Tokens of the whole text, as the tokenizer gives them for it in one piece."""
        n = len(text)
        if n <= self.chunk:
            return self.of_words(text)
        if not self.by_word:  # no boundary is proven stable for this tokenizer
            return len(self.tok.encode_batch_fast([text], add_special_tokens=False)[0])
        total, begin, end = 0, 0, self.chunk
        left = self.offsets(text[begin:end])
        while end < n:
            overlap = self.overlap
            while True:
                # The next chunk begins before the end of this one, by more each time that they don't align.
                start = max(begin, end - overlap)
                stop = min(n, start + max(self.chunk, 2 * overlap))
                right = self.offsets(text[start:stop])
                at = self.stable(text, start + 1, end - 1, left, right, begin, start)
                if at is not None or stop == n and start == begin:
                    break
                self.widened += 1
                if start == begin:  # nothing to splice at in this whole chunk: it grows
                    end = min(n, 2 * end - begin)
                    left = self.offsets(text[begin:end])
                    if end == n:
                        break
                overlap *= 2
            if at is None:
                if end < n:
                    end, left = n, self.offsets(text[begin:])
                break
            total += sum(b + begin <= at for _, b in left)
            begin, end, left = at, stop, [(a - at + start, b - at + start) for a, b in right if a + start >= at]
        return total + len(left)


SPACE_RUN = re.compile(r"[\t-\r ]+")
_COUNTERS: dict[tuple, Counter] = {}


def _counter(vocabulary, chunk: int, overlap: int) -> Counter:
    key = (hashlib.sha256(vocabulary.value).digest(), chunk, overlap)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(vocabulary.value, chunk, overlap)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts the tokens of every whole text with the tokenizers file at path.

    Returns id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). A null text counts as empty (0 bytes, 0
    tokens); repeated rows give repeated results, a null id stays null, other columns are left out, and an empty
    table gives an empty one.
    """
    vocabulary = shipped(docs.sparkSession, path)
    source = docs.select(exact(id_col).alias("id"), exact(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = _counter(vocabulary, chunk, overlap)
        for batch in batches:
            sizes, counts = [], []
            for x in batch.column(1).to_pylist():
                x = x or ""
                sizes.append(len(x.encode()))
                counts.append(counter.count(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    quoted = "`" + id_col.replace("`", "``") + "`"
    return source.mapInArrow(run, f"{quoted} {kind}, n_bytes long, n_tokens long, over_limit boolean")
