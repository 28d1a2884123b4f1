"""Near-copies by the Jaccard similarity of word shingles, with SimHash and then MinHash bands for candidates.

A text is the set of its shingles of five words. SimHash fingerprints of these sets that differ in RADIUS bits at most are found by vantage-point
trees and verified first, which joins the closest copies; pairs near the threshold are further apart than any radius that the
trees prune, so MinHash bands find the rest among what is still apart. Each of BANDS bands hashes the minima of ROWS permutations of that set, so two
texts of similarity s share a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.99993 at 0.8. Candidates whose
sizes and bits (one of each permutation's minimum) may reach the threshold are verified on the whole sets, and only pairs that reach it are linked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import cut, deleted, exact, fresh, holding, linked, rows_a_batch
from .simhash import FOLD

SHINGLE_WORDS, SEED, BANDS, ROWS = 5, 42, 24, 5
#: Bits in which SimHash fingerprints of candidates differ at most.
RADIUS = 4
#: Standard deviations by which two sets' bits may fall short of what the threshold gives before a pair is left unverified.
SLACK = 6
#: Rows of an Arrow batch that are taken out of it at once, so that a worker holds few texts and sets as Python objects.
ROWS_AT_ONCE = 500
#: Shingles that are permuted at once.
BLOCK = 1 << 12
_RNG = np.random.default_rng(11)
TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a whole text's shingles, each once; a text of fewer words is one shingle, one without words none."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE_WORDS, len(words))
    return np.unique(np.array([h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64))


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of each permutation of a set that isn't empty."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(own), BLOCK):
        np.minimum(least, (own[i : i + BLOCK, None] * TIMES + PLUS).min(0), out=least)
    return least


def bands(own: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A number for each band of a set of shingles, and a bit of each permutation's minimum; none for the empty set."""
    if not len(own):
        return np.zeros(0, np.int64), b""
    least = minima(own)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ least[k::ROWS]) * MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64), np.packbits((least * MIX >> np.uint64(63)).astype(np.uint8)).tobytes()


def simhash_of(own: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles as a signed long; 0 for the empty set."""
    fp = simhash.majority(own[i : i + BLOCK] for i in range(0, len(own), BLOCK))
    return fp - (1 << 64) if fp >> 63 else fp


def close_fingerprints(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, sim) -> (pairs u > v whose fingerprints hang together within RADIUS bits, enough to connect all that do; a table to delete).

    A fingerprint is stood for by its smallest node, with which its other nodes make pairs.
    """
    least = cut(nodes.groupBy("sim").agg(F.min("node").alias("least")))
    own = nodes.join(least, "sim").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    near = simhash.links(least.select(F.col("sim").alias("fp")), least.count(), RADIUS)
    of = lambda c, name: least.select(F.col("sim").alias(c), F.col("least").alias(name))
    met = near.join(of("u", "a"), "u").join(of("v", "b"), "v").select("a", "b")
    return cut(own.union(met).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), least


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same) if len(both) else 1.0


def parts(batches):
    """Arrow batches in slices of ROWS_AT_ONCE rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def may_reach(threshold: float):
    """Whether two sets (structs of n and the halves lo and hi of their bits) may be as similar as that.

    Their sizes tell exactly. Of their bits, a share of (1 + similarity) / 2 is equal but for chance; SLACK standard deviations are
    allowed for.
    """
    bits = BANDS * ROWS
    equal = (1 + threshold) / 2
    most = math.floor(bits * (1 - equal) + SLACK * math.sqrt(bits * equal * (1 - equal)))

    def fits(x: Column, y: Column) -> Column:
        differ = F.bit_count(x["lo"].bitwiseXOR(y["lo"])) + F.bit_count(x["hi"].bitwiseXOR(y["hi"]))
        return (F.least(x["n"], y["n"]) >= threshold * F.greatest(x["n"], y["n"])) & (differ <= most)

    return fits


def rarest(sets: DataFrame, threshold: float):
    """For linked(): the keys of crowds by which no pair of their nodes that reaches the threshold is lost, and what has to hold of two of a key.

    sets: (node, own). Shingles are put in order by the number of these nodes that hold them, the rarest first. Two sets as similar as that share one
    within each one's first n - threshold * n + 1; and if the first that they share is the set's number at (from 0), at most n - at are shared, so
    the other set has `most` shingles at most. A copy whose own edits fill these places meets none, however many copies there are.
    """

    def spelled(batches):
        for batch in parts(batches):
            own = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            cols = [np.repeat(batch.column(0).to_numpy(), list(map(len, own))), np.concatenate(own) if own else np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["node", "key"])

    def keys(now: DataFrame) -> DataFrame:
        nodes = now.groupBy("node").agg(F.any_value("c").alias("c"), F.any_value("x").alias("x"))
        every = cut(sets.join(nodes.select("node"), "node", "left_semi").select("node", "own").mapInArrow(spelled, "node long, key long"))
        often = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        # Those of one node only come first and meet none: the rest begin after them.
        own = every.join(often, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own")).join(nodes, "node")
        size = F.col("x.n")
        first, reach = size - F.size("own"), size - F.ceil(size * threshold - 1e-6) + 1
        own = own.withColumn("first", first).where(reach > first).select("node", "c", "x", "first", F.posexplode(F.slice("own", 1, (reach - first).cast("int"))).alias("at", "key"))
        most = F.floor((size - F.col("first") - F.col("at")) * ((1 + threshold) / threshold) - size + 1e-6)
        own = cut(own.select("node", "c", F.col("key.key").alias("key"), F.struct("x.*", most.alias("most")).alias("x")).where(F.col("x.most") >= F.ceil(size * threshold - 1e-6)))
        least = own.groupBy("key").agg(F.min("x.n").alias("least"))
        return holding(own.join(least, "key").where("x.most >= least").drop("least"), every, own)

    fits = may_reach(threshold)
    return keys, lambda x, y: fits(x, y) & (x["n"] <= y["most"]) & (y["n"] <= x["most"])


def one_of_each(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-copies: the smallest id, and of rows that share it any one.

    Texts are linked if their sets of five-word shingles (A-Z as small letters) have a Jaccard similarity of threshold or
    more, and a group is what hangs together over links; texts without words make one group. A row without an id stays only where no row of its group has one.
    All columns stay. Documents aren't written once more: a row is known by its id and, where several rows have that id, by its set
    of shingles, worked out again. What the result reads is released() once it has been written.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold over 0, up to 1")
    with rows_a_batch(docs.sparkSession, ROWS_AT_ONCE):
        return _one_of_each(docs, threshold, id_col, text_col)


def _one_of_each(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType
    about = "fp long, sim long, n long, keys array<long>, lo long, hi long"

    def told(batches):
        from xxhash import xxh64_intdigest as h

        for batch in parts(batches):
            sets = [shingles(x) for x in batch.column(1).to_pylist()]
            fp = np.array([h(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            keys, bits = zip(*map(bands, sets))
            halves = np.frombuffer(b"".join(x.ljust(16, b"\0") for x in bits), "<i8").reshape(-1, 2)
            cols = [pa.array(fp), pa.array([simhash_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "fp", "sim", "n", "keys", "lo", "hi"])

    def read(batches):
        from xxhash import xxh64_intdigest as h

        for batch in parts(batches):
            own = [shingles(x).tobytes() for x in batch.column(1).to_pylist()]
            nodes = np.array([h(x, SEED) for x in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(own, pa.binary()), batch.column(2)], ["node", "own", "many"])

    source = docs.select(exact(id_col).alias("id"), exact(text_col).alias("text"))
    each = cut(source.mapInArrow(told, T.StructType([T.StructField("id", kind), *T._parse_datatype_string(about).fields])))
    # Ids that don't tell a row: those of several rows, and none.
    many = cut(each.groupBy("id").count().where("count > 1 or id is null").select("id"))
    # Equal sets stand for one node, so copies add no work to the search.
    nodes = each.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("id"), *(F.any_value(c).alias(c) for c in ("sim", "n", "lo", "hi", "keys")))
    close, least = close_fingerprints(nodes.select("node", "sim"))
    posted = nodes.select("node", "id", F.struct("n", "lo", "hi").alias("x"), F.explode("keys").alias("key"))
    posted = cut(posted.join(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"])
    wanted = cut(posted.select("node", "id").union(nodes.join(close.select(F.explode(F.array("u", "v")).alias("node")), "node").select("node", "id")).distinct())
    asked = wanted.select("id").distinct()
    asked = asked.join(many.withColumn("many", F.lit(True)), same(asked, many), "left").select(asked["id"], F.coalesce("many", F.lit(False)).alias("many"))
    sets = source.join(asked, same(source, asked)).select("text", F.lit(None).cast("boolean").alias("none"), "many").select("none", "text", "many").mapInArrow(read, "node long, own binary, many boolean")
    repeated = sets.where("many").groupBy("node").agg(F.any_value("own").alias("own"))
    sets = cut(sets.where("not many").select("node", "own").union(repeated.join(wanted, "node", "left_semi")))

    def alike(batches):
        for batch in parts(batches):
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok = np.array([similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= threshold for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], bool)
            yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], ["u", "v"])

    def verify(pairs):
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
        return both.select("u", "v", "a", "b").mapInArrow(alike, "u long, v long")

    alike_by_simhash = cut(verify(close))
    _, found, used = linked(posted.select("node", "key", "x"), verify, may_reach(threshold), (close, alike_by_simhash), rarest(sets, threshold))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("first")
    mine = each.groupBy("fp").agg(first)
    mine = mine.join(found, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("first").alias("first"))
    kept = cut(mine.select(F.col("first.id").alias("id"), F.col("first.fp").alias("fp")))
    # Ids of which no row is asked for by its id alone: those that go, and those that don't tell a row.
    gone = cut(each.select("id").where("id is not null").distinct().join(kept, "id", "left_anti").union(many.where("id is not null")))
    deleted(posted, sets, *used, each, wanted, least, close, alike_by_simhash)
    at = fresh(docs, "fp")

    def marked(batches):
        from xxhash import xxh64_intdigest as h

        for batch in parts(batches):
            fp = np.array([h(shingles(x).tobytes(), SEED) for x in batch.column(batch.schema.names.index(text_col)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], [*batch.schema.names, at])

    own = exact(id_col)
    told_by_id = docs.where(own.isNotNull()).join(gone.select(F.col("id").alias(at)), own == exact(at), "left_anti")
    unclear = docs.join(many.select(F.col("id").alias(at)), own.eqNullSafe(exact(at)), "left_semi")
    unclear = unclear.mapInArrow(marked, T.StructType([*docs.schema.fields, T.StructField(at, T.LongType())]))
    wanted = kept.select(F.col("id").alias(fresh(unclear, "id")), F.col("fp").alias(fresh(unclear, "of")))
    ids, prints = wanted.columns
    unclear = unclear.join(wanted, own.eqNullSafe(exact(ids)) & (exact(at) == exact(prints)), "left_semi").dropDuplicates([id_col, at])
    columns = list(map(exact, docs.columns))
    return holding(told_by_id.select(*columns).union(unclear.select(*columns)), many, kept, gone)
