"""Language identification with error-correcting output codes.

Each language has a codeword of bits. One binary classifier a bit, over hashed character n-grams, tells the
languages with a 1 there from those with a 0. A text's bits are decoded to the codeword of least loss, each bit
weighed by how well its classifier tells its two sides apart; a narrow win is flagged as ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact

#: Letters in an n-gram and buckets that n-grams are hashed to; languages that a model may have at most, which
#: bounds what is sent to the driver; characters handled at once; wins below AMBIGUOUS are flagged.
GRAM, BUCKETS, MOST_LANGUAGES, BLOCK_CHARS, AMBIGUOUS, SMOOTHING = 3, 1 << 15, 256, 1 << 20, 0.6, 0.5

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def grams(text: str | None) -> list[np.ndarray]:
    """Buckets of the n-grams of a whole text, in blocks; case is folded and what isn't a letter counts as a space."""
    out = []
    text = text or ""
    for i in range(0, len(text), BLOCK_CHARS):
        # A block begins with the end of the last one, so that no n-gram is lost between them.
        part = text[max(0, i - GRAM + 1) : i + BLOCK_CHARS].lower()
        part = (" " * (i == 0)) + part + (" " * (i + BLOCK_CHARS >= len(text)))
        c = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        is_letter = letters()[c]
        c = np.where(is_letter, c, 32).astype(np.uint64)
        n = len(c) - GRAM + 1
        h, some = np.zeros(n, np.uint64), np.zeros(n, bool)
        for k in range(GRAM):
            h = (h + c[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            some |= is_letter[k : k + n]
        out.append((h[some] >> np.uint64(13)).astype(np.int64) & (BUCKETS - 1))
    return out


def codewords(n: int, seed: int = 17) -> np.ndarray:
    """n rows of -1 and 1: every split in two for up to seven languages, else the best of some seeded random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([[1.0 if (c >> k) & 1 else -1.0 for c in range(1, 1 << (n - 1))] for k in range(n - 1)] + [[-1.0] * ((1 << (n - 1)) - 1)])
    rng, best, bits = np.random.default_rng(seed), None, min(63, int(np.ceil(10 * np.log2(n))))
    for _ in range(64):
        m = rng.choice([-1.0, 1.0], (n, bits))
        m = m[:, np.abs(m.sum(0)) < n]
        apart = np.min((m.shape[1] - m @ m.T)[~np.eye(n, dtype=bool)])
        if best is None or apart > best[0]:
            best = apart, m
    return best[1]


class Model:
    """The classifiers: weights[bucket, bit] are mean log odds, trust[bit] the weight of a bit's loss."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts[lang, bucket]: n-grams of the training texts of each language."""
        self.langs, self.code = langs, codewords(len(langs))
        shares = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)  # languages weigh alike
        weights, trust = [], []
        for side in self.code.T if len(langs) > 1 else ():
            p, q = shares[side > 0].mean(0), shares[side < 0].mean(0)
            weights.append(np.log(p / q))
            trust.append(0.5 * np.abs(p - q).sum())  # total variation: 1 if the sides share no n-gram
        self.weights = np.array(weights).T if weights else np.zeros((BUCKETS, 1))
        self.trust = np.array(trust) if trust else np.ones(1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether it is ambiguous; und if there is no letter or no language."""
        total, n, with_letters = np.zeros(self.weights.shape[1]), 0, False
        for g in grams(text):
            with_letters |= len(g) > 0
            for i in range(0, len(g), 1 << 16):
                total += self.weights[g[i : i + (1 << 16)]].sum(0)
            n += len(g)
        if not with_letters or not self.langs:
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        margin = self.code * (total / np.sqrt(n))
        loss = (np.logaddexp(0, -margin) * self.trust).sum(1) / self.trust.sum()
        win = np.exp(loss.min() - loss)
        best = int(np.argmin(loss))  # on a tie the first by name
        score = float(1 / win.sum())
        top = np.sort(win)[-2]
        return self.langs[best], score, bool(1 / (1 + top) < AMBIGUOUS)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from all rows of docs whose language isn't null; counts are added up on the executors.

    The driver gets a number a language and bucket at most, whatever the size of the corpus; more than
    MOST_LANGUAGES languages are refused. Without any labelled text the model knows no language.
    """
    source = docs.where(exact(lang_col).isNotNull()).select(exact(lang_col).cast("string").alias("lang"), exact(text_col).alias("text"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for g in grams(text):
                    at += np.bincount(g, minlength=BUCKETS)
        for lang, at in sums.items():
            used = np.flatnonzero(at)
            used = used if len(used) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(at[used])], ["lang", "bucket", "n"])

    counted = source.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.limit(MOST_LANGUAGES * BUCKETS + 1).toPandas()
    langs = sorted(rows["lang"].unique())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((len(langs), BUCKETS))
    if len(rows):
        counts[np.searchsorted(langs, rows["lang"].to_numpy(object)), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return Model(langs, counts)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether the CRC-32 of the id as text leaves fold; a null id isn't held out."""
    return F.coalesce(F.crc32(exact(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows to learn from: those not held out; a row without an id isn't known to be one, so it teaches nothing."""
    return docs.where(exact(id_col).isNotNull() & ~held_out(id_col))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predicts the language of every whole text from the text alone.

    Returns id_col, lang_pred, score, ambiguous. A null text or one without letters is und with score 0 (and
    ambiguous); ties go to the first language by name; repeated rows give repeated results; other columns are left
    out; an empty table gives an empty one.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [known.value.predict(x) for x in batch.column(1).to_pylist()]
            cols = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, "lang_pred", "score", "ambiguous"])

    quoted = "`" + id_col.replace("`", "``") + "`"
    return docs.select(exact(id_col), exact(text_col)).mapInArrow(run, f"{quoted} {kind}, lang_pred string, score double, ambiguous boolean")


def with_language(docs: DataFrame, model: Model, text_col: str, pred: str, ambiguous: str) -> DataFrame:
    """docs with two more columns, the predicted language and whether it is ambiguous; names that docs doesn't have."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(ambiguous, T.BooleanType())])

    def run(batches):
        for batch in batches:
            found = [known.value.predict(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[2] for x in found], pa.bool_())], [*batch.schema.names, pred, ambiguous])

    return docs.mapInArrow(run, schema)
