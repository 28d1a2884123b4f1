"""Scores texts by a unigram model of subword pieces, over all segmentations.

The pieces and their first scores come from a tokenizer's vocabulary. A word's lattice has an arc for every piece that it
contains; the forward recursion in log space adds up all ways through it, which gives the probability of the word
whatever way it is cut. No piece crosses the begin of a word, so a text's lattice is a chain of its words' lattices with the end
behind it, and its marginal probability is the product of theirs. Pieces, bytes and the end share one distribution, which is
learned from the training texts by expected counts over the same lattices (forward and backward), each word as often as they have it.

What the corpus tells is gathered as counts of words, each counted once a chunk of documents; a word's lattice is
worked out once for the whole corpus, whatever number of documents have it.

A second score beside it mixes that distribution of words with the training texts' own counts: an arc more over each whole known word,
with its share of the training words, and the share that words seen once have (Good and Turing's estimate of the unseen) for what
pieces spell. A text is an urn's sequence there: each drawn word is put back twice, with CONCENTRATION for the
size of the distribution, so that a word costs less each time that the text repeats it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, exact, shipped

#: Characters of text in a chunk of documents, longest word that is handled in arrays, words handled at once, rounds of learning.
CHUNK_CHARS, LONG_WORD, WORDS_AT_ONCE, ROUNDS = 12 << 20, 40, 20_000, 2
#: A count that every piece and byte has besides what was learned.
SMOOTHING = 0.1
#: How many words of a text weigh as much as the distribution that they are drawn from.
CONCENTRATION = 1000.0
#: Characters of a longer word go through the recursion one by one, with the way there kept at every BLOCKth.
ARRAYS, BLOCK = 1 << 16, 1 << 12
#: Stands for the begin of a word in the lattice; no text has it.
BEGIN = 0x110000
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
NONE = -np.inf
_K = 0x9E3779B97F4A7C15


class Pieces:
    """The pieces of a vocabulary as code points, with a hash table that finds many at once."""

    def __init__(self, pieces: list[str], begin: str = "▁"):
        seen: dict[tuple[int, ...], int] = {}
        for p in pieces:
            at = p.startswith(begin)
            rest = p[at:]
            if begin in rest or not p or any(c in rest for c in " \t\n\r\v\f") or rest != rest.translate({ord(a): b for a, b in zip(UPPER, LOWER)}):
                continue  # can't be in a folded word
            seen.setdefault((*([BEGIN] if at else []), *map(ord, rest)), len(seen))
        seen.setdefault((BEGIN,), len(seen))
        self.points = list(seen)
        self.n, self.longest = len(seen), max(map(len, seen))
        keys = np.zeros(self.n, np.uint64)
        with np.errstate(over="ignore"):
            for i, p in enumerate(self.points):
                h = np.uint64(0)
                for c in p:
                    h = self.step(h, np.uint64(c))
                keys[i] = h
        if len(np.unique(keys)) < self.n or 0 in keys:
            raise ValueError("two pieces have the same hash")
        self.bits = int(np.ceil(np.log2(self.n * 4)))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        self.tries = 1
        for i, k in enumerate(keys):
            at, t = int(k) >> (64 - self.bits), 1
            while self.slots[at] >= 0:
                at, t = (at + 1) & ((1 << self.bits) - 1), t + 1
            self.slots[at], self.tries = i, max(t, self.tries)

    @staticmethod
    def step(h, c):
        h = (h ^ (c + np.uint64(1))) * np.uint64(_K)
        return h ^ (h >> np.uint64(32))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1. Right up to a collision of 64-bit hashes with a piece's."""
        out, at, mask = np.full(h.shape, -1, np.int32), (h >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        open_ = np.arange(len(h))
        for _ in range(self.tries):
            s = self.slots[at[open_]]
            hit = (s >= 0) & (self.keys[s] == h[open_])
            out[open_[hit]] = s[hit]
            open_ = open_[~hit & (s >= 0)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & mask
        return out


class Lattice:
    """Words' probabilities under piece scores (natural logarithms); bytes[b] is the score of a byte of a character that no piece has."""

    def __init__(self, pieces: Pieces, scores: np.ndarray, byte_scores: np.ndarray):
        self.p, self.scores, self.bytes = pieces, scores, byte_scores

    def arcs(self, chars: np.ndarray):
        """For words of equal length n, chars[word, n + 1] with BEGIN first: pieces[length - 1][word, start]."""
        b, n = chars.shape
        h, out = np.zeros((b, n), np.uint64), []
        c = chars.astype(np.uint64)
        for length in range(1, min(n, self.p.longest) + 1):
            h = self.p.step(h[:, : n - length + 1], c[:, length - 1 :])
            out.append(self.p.find(h.ravel()).reshape(h.shape))
        return out

    def spelled(self, chars: np.ndarray) -> np.ndarray:
        """Scores of single characters by their bytes."""
        kinds, at = np.unique(chars, return_inverse=True)
        each = np.array([sum(self.bytes[x] for x in chr(c).encode("utf-8", "surrogatepass")) if c < BEGIN else NONE for c in kinds])
        return each[at].reshape(chars.shape)

    def group(self, chars: np.ndarray, weights: np.ndarray | None = None):
        """Scores of words of equal length; with weights also what they add to the expected counts of pieces and bytes."""
        b, n = chars.shape
        arcs = self.arcs(chars)
        score = [np.where(a >= 0, self.scores[a], NONE) for a in arcs]
        unknown = (arcs[0] < 0) & (chars != BEGIN)
        if unknown.any():
            score[0] = np.where(unknown, self.spelled(chars), score[0])
        alpha = np.full((n + 1, b), NONE)
        alpha[0] = 0
        for j in range(1, n + 1):
            alpha[j] = _logsum([alpha[j - k] + score[k - 1][:, j - k] for k in range(1, min(j, len(score)) + 1)])
        if weights is None:
            return alpha[n]
        beta = np.full((n + 1, b), NONE)
        beta[n] = 0
        for i in range(n - 1, -1, -1):
            beta[i] = _logsum([score[k - 1][:, i] + beta[i + k] for k in range(1, min(n - i, len(score)) + 1)])
        counts, of_bytes = np.zeros(self.p.n), np.zeros(256)
        for k, (a, s) in enumerate(zip(arcs, score), 1):
            for i in range(n - k + 1):
                use = np.flatnonzero(s[:, i] > NONE)
                if not len(use):
                    continue
                w = np.exp(alpha[i][use] + s[use, i] + beta[i + k][use] - alpha[n][use]) * weights[use]
                piece = a[use, i]
                counts += np.bincount(piece[piece >= 0], w[piece >= 0], self.p.n)
                for c, x in zip(chars[use[piece < 0], i], w[piece < 0]):
                    for y in chr(c).encode("utf-8", "surrogatepass"):
                        of_bytes[y] += x
        return alpha[n], counts, of_bytes

    def words(self, words: list[str], weights: np.ndarray | None = None):
        """Scores of words in their order, grouped by length; long words go through the same recursion one at a time."""
        out = np.zeros(len(words))
        counts, of_bytes = np.zeros(self.p.n), np.zeros(256)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            at_once = WORDS_AT_ONCE if size <= LONG_WORD else max(1, WORDS_AT_ONCE * LONG_WORD // int(size) ** 2)
            for i in range(0, len(rows), at_once):
                part = rows[i : i + at_once]
                if size > ARRAYS:
                    for k in part:
                        out[k] = self.long_word(words[k], None if weights is None else (counts, of_bytes, float(weights[k])))
                    continue
                text = "".join(words[k] for k in part)
                chars = np.full((len(part), size + 1), BEGIN, np.int64)
                chars[:, 1:] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size)
                got = self.group(chars, None if weights is None else weights[part])
                if weights is None:
                    out[part] = got
                else:
                    out[part] = got[0]
                    counts += got[1]
                    of_bytes += got[2]
        return out if weights is None else (out, counts, of_bytes)

    def long_word(self, word: str, learn: tuple[np.ndarray, np.ndarray, float] | None = None) -> float:
        """The forward recursion of one word of any length, with as much memory as the longest piece.

        learn: counts of pieces, of bytes, and a weight, by which what the word adds to expected counts is added there. The way back
        then takes the blocks from the last one on, and works out each block's way there again from what was kept at its begin.
        """
        if not hasattr(self, "by_points"):
            self.by_points = {p: (i, float(s)) for i, (p, s) in enumerate(zip(self.p.points, self.scores))}
        n, longest = len(word) + 1, self.p.longest

        def points(lo: int, hi: int) -> list[int]:
            return ([BEGIN] if lo == 0 else []) + list(map(ord, word[max(0, lo - 1) : hi - 1]))

        def ending(chars: list[int], j: int) -> list[tuple[int, int, float]]:
            """(length, piece or -1 for bytes, score) of the arcs that end before chars[j]."""
            out = []
            for k in range(1, min(j, longest) + 1):
                piece, s = self.by_points.get(tuple(chars[j - k : j]), (None, 0.0))
                if piece is not None:
                    out.append((k, piece, s))
                elif k == 1 and chars[j - 1] < BEGIN:
                    out.append((1, -1, sum(self.bytes[x] for x in chr(chars[j - 1]).encode("utf-8", "surrogatepass"))))
            return out

        def forward(lo: int, hi: int, last: list[float]) -> list[float]:
            """last: alphas of the places up to lo; returns these and those up to hi."""
            first = max(0, lo - longest + 1)
            chars, out = points(first, hi), list(last)
            for j in range(lo + 1, hi + 1):
                ways = [out[-k] + s for k, _, s in ending(chars, j - first)]
                top = max(ways, default=NONE)
                out.append(top + float(np.log(sum(np.exp(w - top) for w in ways))) if top > NONE else NONE)
            return out

        kept, last = [], [0.0]
        for lo in range(0, n, BLOCK):
            if learn:
                kept.append(last)
            last = forward(lo, min(n, lo + BLOCK), last)[-longest:]
        total = last[-1]
        if learn and total > NONE:
            counts, of_bytes, weight = learn
            beta = {n: 0.0}
            for lo in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
                hi, tail = min(n, lo + BLOCK), kept.pop()
                alpha, first = forward(lo, hi, tail), max(0, lo - longest + 1)
                chars, at = points(first, hi), lo - len(tail) + 1  # alpha[0] stands at that place
                for j in range(hi, lo, -1):
                    then = beta.pop(j, NONE)
                    for k, piece, s in ending(chars, j - first) if then > NONE else ():
                        i = j - k
                        beta[i] = float(np.logaddexp(beta.get(i, NONE), s + then))
                        w = weight * float(np.exp(alpha[i - at] + s + then - total))
                        if piece >= 0:
                            counts[piece] += w
                        else:
                            for y in chr(chars[i - first]).encode("utf-8", "surrogatepass"):
                                of_bytes[y] += w
        return float(total)


def _logsum(ways: list[np.ndarray]) -> np.ndarray:
    x = np.array(ways)
    top = x.max(0)
    top = np.where(top == NONE, 0, top)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - top).sum(0))


def vocabulary(data: bytes) -> tuple[list[str], np.ndarray]:
    """Pieces and scores of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [sp.id_to_piece(i) for i in ids], np.array([sp.get_score(i) for i in ids])


def first_scores(pieces: Pieces, names: list[str], scores: np.ndarray) -> np.ndarray:
    """Log probabilities to begin with. Scores of a merge-based vocabulary are ranks, so they are read by Zipf's law."""
    of = {}
    for p, s in zip(names, scores):
        at = p.startswith("▁")
        of.setdefault((*([BEGIN] if at else []), *map(ord, p[at:])), float(s))
    least = min(of.values(), default=0.0)
    s = np.array([of.get(p, least) for p in pieces.points])
    p = 1 / (10 + s.max() - s)
    return np.log(p / p.sum())


def normalised(pieces: np.ndarray, of_bytes: np.ndarray, ends: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Log probabilities from counts: pieces, bytes and the end share one distribution."""
    pieces, of_bytes, ends = pieces + SMOOTHING, of_bytes + SMOOTHING, ends + SMOOTHING
    total = pieces.sum() + of_bytes.sum() + ends
    return np.log(pieces / total), np.log(of_bytes / total), float(np.log(ends / total))


def log_rising(log_a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log(a (a + 1) ... (a + n - 1)) for n of 1 and more; a may be too small for a double."""
    a = np.exp(log_a)
    return log_a + np.where(n > 1, _lgamma(a + n) - _lgamma(a + 1), 0.0)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of gamma from 1 on, by Stirling's series at x + 8."""
    below = np.ones_like(x)
    for i in range(8):
        below *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(below)


def packed(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 byte by byte, compressed: most of their bytes are 0."""
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def gathered(docs: DataFrame) -> DataFrame:
    """Documents in chunks, each with its distinct words: a row a chunk.

    words and train[] (how often the chunk's training documents have each), docs (ids, fold, and packed the steps from one of its word numbers to the next, with counts).
    Chunks follow the partitions of the input and are closed at CHUNK_CHARS.
    """
    import uuid

    def run(batches):
        schema = pa.schema([("chunk", pa.int64()), ("words", pa.list_(pa.string())), ("train", pa.list_(pa.int64())), ("ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("at", pa.binary()), ("n", pa.binary()), ("ends", pa.list_(pa.int64()))])

        def closed():
            words = pa.array([w.decode("utf-8", "replace") for w in number])
            one = lambda x, t=None: pa.array([x], t) if t else pa.ListArray.from_arrays([0, len(x)], x)
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65]), one(words), one(pa.array(train[: len(number)])), one(pa.array(ids, id_type)), one(pa.array(held)), one(pa.array(sizes, pa.int64())),
                 pa.array([packed(np.concatenate(at))], pa.binary()), pa.array([packed(np.concatenate(n))], pa.binary()), one(pa.array(np.cumsum([len(x) for x in at]).astype(np.int64)))],
                schema=schema,
            )

        number: dict[bytes, int] = {}
        train, ids, held, sizes, at, n, chars = np.zeros(1 << 16, np.int64), [], [], [], [], [], 0
        for batch in batches:
            for id_, is_held, teaches, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                found = tokens(text.as_py())
                k = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
                if len(number) > len(train):
                    train = np.concatenate((train, np.zeros(max(len(train), len(number)), np.int64)))
                own, times = np.unique(k, return_counts=True)
                if teaches:
                    train[own] += times
                ids.append(id_)
                held.append(is_held)
                sizes.append(len(found))
                at.append(np.diff(own, prepend=0))
                n.append(times)
                chars += sum(map(len, found)) + len(found) + 16
                if chars >= CHUNK_CHARS:
                    yield closed()
                    number, train, ids, held, sizes, at, n, chars = {}, np.zeros(1 << 16, np.int64), [], [], [], [], [], 0
        if ids:
            yield closed()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["id"].dataType
    id_type = to_arrow_type(kind)
    return docs.select("id", "held", "teaches", "text").mapInArrow(run, f"chunk long, words array<string>, train array<long>, ids array<{kind.simpleString()}>, held array<boolean>, sizes array<long>, at binary, n binary, ends array<long>")


def score(docs: DataFrame, path: str, rounds: int = ROUNDS, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text", concentration: float = CONCENTRATION) -> DataFrame:
    """Log10 probabilities of all whole texts, learned from those whose id isn't held out (CRC-32 of the id as text, mod folds, is fold).

    Returns id_col, held_out, n_tokens (words and an end), n_known (of these with a count in training), train_tokens,
    base_score (word unigrams with add-half smoothing), score (the marginal over all segmentations) and urn_score (pieces mixed with
    the training words' counts, over the text's counts as an urn). A null text counts as empty: one token,
    the end. A row without an id isn't held out and teaches nothing. Repeated rows count each. Without training
    documents all counts are 0 and the model keeps its first scores. Other columns are left out, an empty table gives an empty one.
    The driver gets a number for each piece of the vocabulary, and nothing that grows with the corpus.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(exact(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
    source = docs.select(exact(id_col).alias("id"), held.alias("held"), (~held & exact(id_col).isNotNull()).alias("teaches"), exact(text_col).alias("text"))
    names, ranks = vocabulary(shipped(spark, path).value)
    pieces = Pieces(names)
    chunks = cut(gathered(source))
    ends = source.where("teaches").count()
    # Every distinct word of every chunk; counts are added up in part before the words are sent, so a frequent word is a few rows in its task.
    flat = chunks.select(F.col("chunk").alias("chunk"), F.posexplode(F.arrays_zip("words", "train")).alias("k", "w")).select("chunk", "k", F.col("w.words").alias("word"), F.col("w.train").alias("c"))
    distinct = cut(flat.groupBy("word").agg(F.sum("c").alias("c")))
    total = distinct.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    n_all, v_all = total[0] + ends, total[1] + (ends > 0)
    # The share of what pieces spell; without training texts that is all but the end.
    spelled = (total[2] + 0.5) / (n_all + 1) if total[0] else 1 - 1e-3
    log_spelled, log_known = float(np.log(spelled)), float(np.log1p(-spelled) - np.log(max(1, n_all)))
    urn_end = log_known + float(np.log(max(1, ends)))

    table, byte_scores, end_score = first_scores(pieces, names, ranks), np.full(256, np.log(1e-6)), float(np.log(1e-3))
    for _ in range(rounds if total[0] else 0):
        model = spark.sparkContext.broadcast((pieces, table, byte_scores))

        def expected(batches, model=model):
            p, t, b = model.value
            lattice, counts, of_bytes = Lattice(p, t, b), np.zeros(p.n), np.zeros(256)
            for batch in batches:
                words = batch.column(0).to_pylist()
                if words:
                    _, x, y = lattice.words(words, batch.column(1).to_numpy().astype(float))
                    counts += x
                    of_bytes += y
            both = np.concatenate((counts, of_bytes))
            some = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(both[some])], ["k", "n"])

        # Sums in decimals don't depend on the order in which tasks end.
        got = distinct.where("c > 0").select("word", "c").mapInArrow(expected, "k int, n double").groupBy("k").agg(F.sum(F.col("n").cast("decimal(38,9)")).cast("double").alias("n")).toPandas()
        both = np.zeros(pieces.n + 256)
        both[got["k"].to_numpy()] = got["n"].to_numpy()
        table, byte_scores, end_score = normalised(both[: pieces.n], both[pieces.n :], ends)
    model = spark.sparkContext.broadcast((pieces, table, byte_scores))

    def scored(batches):
        lattice = Lattice(*model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lattice.words(batch.column(0).to_pylist()), pa.float64())], ["word", "c", "s"])

    # A row a word against a row a word and chunk, which AQE may split where a word is in very many.
    values = flat.drop("c").join(cut(distinct.mapInArrow(scored, "word string, c long, s double")), "word").select("chunk", "k", "c", "s")

    def text_scores(left, right):
        names_ = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "urn_score"]
        k = right.column("k").to_numpy()
        c, s = np.zeros(len(k), np.int64), np.zeros(len(k))
        c[k], s[k] = right.column("c").to_numpy(), right.column("s").to_numpy()
        base = np.log10((c + 0.5) / (n_all + 0.5 * (v_all + 1)))
        word = np.logaddexp(log_spelled + s, np.where(c > 0, log_known + np.log(np.maximum(c, 1)), NONE))
        base_end = np.log10((ends + 0.5) / (n_all + 0.5 * (v_all + 1)))
        parts = []
        for row in range(left.num_rows):
            get = lambda name: left.column(name)[row].values  # noqa: B023, E731
            steps, n, stop = unpacked(left.column("at")[row].as_py()), unpacked(left.column("n")[row].as_py()), get("ends").to_numpy()
            sums = lambda x: np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(x)))[stop])))  # noqa: B023, E731
            size = get("sizes").to_numpy() + 1
            # Each text's own sum, so that what it is doesn't hang on its neighbours in the chunk.
            start = np.concatenate(([0], stop[:-1]))
            run = np.concatenate(([0], np.cumsum(steps)))
            at = run[1:] - np.repeat(run[start], stop - start)
            exactly = lambda x: np.array([x[a:b].sum() for a, b in zip(start, stop)])  # noqa: B023, E731
            put_in = np.log(concentration)
            drawn = exactly(log_rising(put_in + word[at], n)) + put_in + urn_end - log_rising(np.full(len(size), put_in), size)
            parts.append(pa.table([get("ids"), get("held"), pa.array(size), pa.array((sums(n * (c[at] > 0)) + (ends > 0)).astype(np.int64)), pa.array(np.full(len(size), n_all, np.int64)), pa.array(exactly(n * base[at]) + base_end), pa.array((exactly(n * s[at]) + end_score) / np.log(10)), pa.array(drawn / np.log(10))], names_))
        return pa.concat_tables(parts)

    quoted = "`" + id_col.replace("`", "``") + "`"
    kind = docs.schema[id_col].dataType.simpleString()
    # A chunk without a word has no values, but its documents have an end.
    own = chunks.select("chunk", "ids", "held", "sizes", "at", "n", "ends")
    return own.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(text_scores, f"{quoted} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, urn_score double")

