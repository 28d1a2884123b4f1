"""Windowed LD scores within and between ancestries, as an equi-join of chunks of variants.

A variant's window reaches back to the first variant within a distance. Pairs are taken by whole chunks: which
pairs of chunks are needed follows from the windows alone, so the work is a join on a chunk's number, and each pair of
chunks is one product of matrices a tile of people.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_lefts(coords, reach: float) -> np.ndarray:
    """First index within reach of each sorted coordinate."""
    x = np.asarray(coords, float)
    if (np.diff(x) < 0).any():
        raise ValueError("coordinates have to be in order")
    left = np.searchsorted(x, x - reach, side="left")
    # x[i] - reach is rounded, the distance itself decides.
    for shift in (-1, 1):
        near = np.clip(left + (shift if shift < 0 else 0), 0, len(x) - 1)
        left = np.where((shift < 0) & (left > 0) & (np.abs(x - x[near]) <= reach), near, np.where((shift > 0) & (np.abs(x - x[left]) > reach), left + 1, left))
    return left


def block_sizes(coords, reach: float) -> np.ndarray:
    """Number of variants nearer than reach, strictly."""
    x = np.asarray(coords, float)
    return np.maximum(np.searchsorted(x, x + reach, side="left") - np.searchsorted(x, x - reach, side="right"), 0)


@dataclass(frozen=True)
class Windows:
    """Which pairs count: first_block, chunk and reach of each chunk back, all in numbers of variants."""

    m: int
    chunk: int
    first: int
    back: tuple[int, ...]

    @classmethod
    def of(cls, lefts: np.ndarray, chunk: int = 50) -> Windows:
        m = len(lefts)
        beyond = np.flatnonzero(lefts > 0)
        f = int(beyond[0]) if len(beyond) else m
        first, c = -(-f // chunk) * chunk, chunk
        if first > m:
            first, c = m, 1
        size = -(-(np.arange(m) - lefts) // c) * c
        return cls(m, c, first, tuple(int(size[k]) for k in range(0, m, c)))

    def chunk_pairs(self) -> list[tuple[int, int]]:
        """(left chunk, right chunk) with left <= right. Within the first block all pairs count."""
        out, blocks = [], -(-self.m // self.chunk)
        for k in range(blocks):
            at = k * self.chunk
            low = 0 if at < self.first else max(0, at - self.back[k]) // self.chunk
            out += [(i, k) for i in range(low, k + 1)]
        return out

    def included(self, i: int, k: int) -> bool:
        """Whether the pair i < k counts."""
        ck = k // self.chunk * self.chunk
        return k < self.first or i >= ck or ck - self.back[k // self.chunk] <= i


def _chunking(m: int, beyond: int | None, chunk: int) -> tuple[int, int]:
    """(chunk, first) of m variants, of which beyond is the first whose window doesn't reach back to the beginning."""
    first = -(-(m if beyond is None else beyond) // chunk) * chunk
    return (1, m) if first > m else (chunk, first)


_BEYOND = "min(if(left > 0, idx, null))"


def _met(size: Column, first: Column) -> tuple[Column, Column]:
    """(left chunks, right chunk) of the first variant of each chunk."""
    at = F.col("idx")
    back = F.ceil((at - F.col("left")) / size) * size
    low = F.when(at < first, F.lit(0)).otherwise(F.floor(F.greatest(F.lit(0), at - back) / size)).cast("int")
    k = (at / size).cast("int")
    return F.explode(F.sequence(low, k)).alias("i"), k.alias("k")


def chunk_pairs(lefts: DataFrame, chunk: int = 50) -> tuple[DataFrame, int, int]:
    """(idx, left) of all variants -> ((i int, k int) pairs of chunks, chunk, first): what Windows tells, as rows that are made on the executors.

    Two numbers come to the driver: how many variants there are, and the first whose window doesn't reach back to the beginning.
    """
    size, first = _chunking(*lefts.agg(F.count("*"), F.expr(_BEYOND)).first(), chunk)
    return lefts.where(F.col("idx") % size == 0).select(*_met(F.lit(size), F.lit(first))), size, first


def smaller_frequency(g: np.ndarray) -> np.ndarray:
    """Of dosages [variant, person] (NaN missing): of both alleles the smaller frequency among called people, NaN if there are none."""
    with np.errstate(invalid="ignore", divide="ignore"):
        f = np.nansum(g, 1) / (2 * (~np.isnan(g)).sum(1))
    return np.minimum(f, 1 - f)


def maf_ok(g: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Of dosages [variant, person] (NaN missing): the smaller frequency above least, and fewer than all het or missing."""
    miss = np.isnan(g)
    return (smaller_frequency(g) > least) & (((g == 1).sum(1) + miss.sum(1)) < g.shape[1])


#: People whose dosages one row holds, and dosages that are standardised at once.
TILE, AT_ONCE = 8192, 1 << 22
TILED = "pair int, idx long, tile int, g binary, fill double, m1 double, s1 double, m2 double, s2 double"


def _tiles(geno: DataFrame, masks: dict[int, tuple[np.ndarray, np.ndarray]], tile: int) -> DataFrame:
    """Each variant's dosages as bytes (-1 missing) by pair of ancestries and tile of people, with what they are standardised by: the mean of all
    people of the pair for missing ones, and by ancestry mean and standard deviation once those are filled in."""

    def run(batches):
        people = {p: np.flatnonzero(a | b) for p, (a, b) in masks.items()}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = pc.fill_null(batch.column(1).flatten(), -1).to_numpy(zero_copy_only=False).reshape(n, -1)
            at = batch.column(0).flatten()
            row = np.repeat(np.arange(n), pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False))
            pair, idx = (at.field(c).to_numpy(zero_copy_only=False) for c in ("pair", "idx"))
            for p, who in people.items():
                own, mine = [m[who] for m in masks[p]], np.flatnonzero(pair == p)
                step = max(1, AT_ONCE // max(1, len(who)))
                for k in range(0, len(mine), step):
                    some = mine[k : k + step]
                    g = flat[row[some]][:, who].astype(np.int8)
                    called = g >= 0
                    with np.errstate(invalid="ignore", divide="ignore"):
                        fill = np.where(called, g, 0).sum(1) / called.sum(1)
                    full = np.where(called, g, fill[:, None])
                    stats = [x for m in own for x in (full[:, m].mean(1), full[:, m].std(1))]
                    for t in range(0, len(who), tile):
                        part = np.ascontiguousarray(g[:, t : t + tile])
                        same = [pa.array(np.full(len(some), x, np.int32)) for x in (p, t // tile)]
                        yield pa.RecordBatch.from_arrays([same[0], pa.array(idx[some]), same[1], pa.array([r.tobytes() for r in part], pa.binary()), *(pa.array(x) for x in (fill, *stats))], ["pair", "idx", "tile", "g", "fill", "m1", "s1", "m2", "s2"])

    return geno.select("at", F.col("dosage").cast("array<int>").alias("dosage")).mapInArrow(run, TILED)


class _Chunk:
    """The variants of one row's list of structs: numbers, statistics by ancestry, and standardised dosages of a tile by ancestry."""

    def __init__(self, v: pa.StructArray, own: list[np.ndarray]):
        of = lambda c: v.field(c).to_numpy(zero_copy_only=False)
        self.idx = of("idx")
        self.mean, self.sd = [of("m1"), of("m2")], [of("s1"), of("s2")]
        g = np.frombuffer(b"".join(v.field("g").to_pylist()), np.int8).reshape(len(self.idx), -1)
        full = np.where(g >= 0, g, of("fill")[:, None])
        with np.errstate(invalid="ignore", divide="ignore"):
            self.z = [(full[:, o] - m[:, None]) / s[:, None] for o, m, s in zip(own, self.mean, self.sd)]

    def variance(self, a: int) -> np.ndarray:
        f = self.mean[a] / 2
        return 2 * f * (1 - f)


class _Told(_Chunk):
    """A chunk's numbers and statistics without its dosages."""

    def __init__(self, idx, mean, sd):
        self.idx, self.mean, self.sd = idx, mean, sd


def pair_scores(geno: DataFrame, anc1: np.ndarray, anc2: np.ndarray, lefts: DataFrame | np.ndarray, chunk: int = 50, per_allele: bool = True, correct: bool = True, symmetric: bool = False, exponent: float = 0.0, tile: int = TILE) -> DataFrame:
    """(idx, l2) of one pair of ancestries (or one with itself).

    geno: idx (0 to m - 1 in order) and dosage of all people; anc1, anc2: masks of people; lefts: (idx, left), or an array of small inputs. Products of correlations are
    summed over the windows; within an ancestry the square is freed of its bias unless correct is off. per_allele scales by
    the ratio of the variants' variances; as a known property of this score, a variant right of a chunk takes the ratio of its left
    neighbour's, unless symmetric. With an exponent each correlation counts times the other variant's variance to half that power; again
    unless symmetric, a variant right of a chunk takes its own variance for that of its left neighbour, and pairs within a chunk beyond the first
    block aren't scaled. Undefined products count as nothing.
    """
    if isinstance(lefts, np.ndarray):
        lefts = geno.sparkSession.createDataFrame(list(enumerate(lefts.tolist())), "idx long, left long")
    one = F.lit(0).alias("pair")
    of = geno.select(F.array(F.struct(one, F.col("idx").cast("long").alias("idx"))).alias("at"), "dosage")
    return scores(of, {0: (anc1, anc2)}, lefts.select(one, "idx", "left"), chunk, per_allele, correct, symmetric, exponent, tile).select("idx", "l2")


def scores(geno: DataFrame, people: dict[int, tuple[np.ndarray, np.ndarray]], lefts: DataFrame, chunk: int = 50, per_allele: bool = True, correct: bool = True, symmetric: bool = False, exponent: float = 0.0, tile: int = TILE) -> DataFrame:
    """(pair, idx, l2): pair_scores() of many pairs of ancestries at once, each with its variants' numbers.

    geno: at (array of structs of pair int and idx long) and dosage of all people; people: by pair both masks; lefts: (pair, idx, left).

    A row holds a chunk's dosages of one tile of people, a byte each. Correlations are sums over people, so tiles are multiplied
    apart and their products added.
    """
    chunking = {p: _chunking(m, beyond, chunk) for p, m, beyond in lefts.groupBy("pair").agg(F.count("*"), F.expr(_BEYOND)).collect()}
    people = {p: m for p, m in people.items() if p in chunking}
    # Without variants nothing is met; the map is there for its type.
    by_pair = lambda k: F.element_at(F.create_map(*(F.lit(x) for p, c in (chunking or {0: (chunk, 0)}).items() for x in (p, c[k]))), F.col("pair"))
    size_of, first_of = by_pair(0), by_pair(1)
    pairs = lefts.where(F.col("idx") % size_of == 0).select("pair", *_met(size_of, first_of))
    same = {p: bool((a == b).all()) for p, (a, b) in people.items()}
    n_of = {p: [int(a.sum()), int(b.sum())] for p, (a, b) in people.items()}
    inside = {p: [m[a | b] for m in (a, b)] for p, (a, b) in people.items()}
    tiles = max((-(-len(x[0]) // tile) for x in inside.values()), default=0)
    v = F.array_sort(F.collect_list(F.struct("idx", "g", "fill", "m1", "s1", "m2", "s2")))
    blocks = _tiles(geno, people, tile).groupBy("pair", F.floor(F.col("idx") / size_of).cast("int").alias("chunk"), "tile").agg(v.alias("v"))
    left = blocks.select("pair", F.col("chunk").alias("i"), "tile", F.col("v").alias("vi"))
    right = blocks.select("pair", F.col("chunk").alias("k"), "tile", F.col("v").alias("vk"))
    met = pairs.join(left, ["pair", "i"]).join(right, ["pair", "k", "tile"])

    def scored(p, i, k, a, b, r):
        """(pair, numbers, contributions) of both chunks, from the correlations of their variants by ancestry."""
        size, first = chunking[p]
        both_ways = symmetric or k * size < first
        scale_by = lambda sd, axis: np.expand_dims(sd**exponent, axis) if exponent else 1

        def products(factor):
            if same[p]:
                r2 = (r[0] * factor(0)) ** 2
                return r2 - (1 - r2) / (n_of[p][0] - 2) if correct else r2
            return r[0] * factor(0) * r[1] * factor(1)

        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            x = products(lambda c: scale_by(b.sd[c], 0) if i != k or both_ways else 1)
            scale = np.sqrt((a.variance(0) * a.variance(1))[:, None] / (b.variance(0) * b.variance(1))[None, :]) if per_allele else np.ones_like(x)
            yield p, a.idx, np.nansum(x * scale, 1)
            if i == k:
                return
            back = 1 / scale if both_ways or not per_allele else scale
            mirrored = products(lambda c: scale_by(a.sd[c], 1)) if exponent and both_ways else x
            yield p, b.idx, np.nansum(mirrored * back, 0)

    def rows(found):
        return [pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), p, np.int32)), pa.array(idx, pa.int64()), pa.array(l2, pa.float64())], ["pair", "idx", "l2"]) for p, idx, l2 in found]

    def correlated(batch, row):
        """(pair, i, k, both chunks, this tile's part of the correlations by ancestry)"""
        name = {n: c for c, n in enumerate(batch.schema.names)}
        p, i, k, t = (batch.column(name[c])[row].as_py() for c in ("pair", "i", "k", "tile"))
        own = [m[t * tile : (t + 1) * tile] for m in inside[p]]
        a, b = (_Chunk(batch.column(name[c])[row].values, own) for c in ("vi", "vk"))
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            return p, i, k, a, b, [a.z[c] @ b.z[c].T / n_of[p][c] for c in range(1 if same[p] else 2)]

    if tiles <= 1:
        def whole(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    yield from rows(scored(*correlated(batch, row)))

        out = met.mapInArrow(whole, "pair int, idx long, l2 double")
    else:
        # Tiles' parts are sums over people: a pair's are added up, a tile of them at a time, and the first one tells the variants.
        def parts(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    p, i, k, a, b, r = correlated(batch, row)
                    t = batch.column(batch.schema.names.index("tile"))[row].as_py()
                    about = pickle.dumps([(x.idx, x.mean, x.sd) for x in (a, b)]) if t == 0 else None
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (p, i, k)), pa.array([about], pa.binary()), pa.array([np.stack(r).tobytes()], pa.binary())], ["pair", "i", "k", "about", "r"])

        def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, i, k = (x.as_py() for x in key)
            about, total = None, None
            for batch in batches:
                for row in range(batch.num_rows):
                    told = batch.column(3)[row].as_py()
                    about = about or (told and pickle.loads(told))
                    r = np.frombuffer(batch.column(4)[row].as_py())
                    total = r if total is None else total + r
            a, b = (_Told(*x) for x in about)
            yield from rows(scored(p, i, k, a, b, list(total.reshape(-1, len(a.idx), len(b.idx)))))

        out = met.mapInArrow(parts, "pair int, i int, k int, about binary, r binary").groupBy("pair", "i", "k").applyInArrow(added, "pair int, idx long, l2 double")
    # Sums in decimals don't hang on the order in which tasks end.
    return out.groupBy("pair", "idx").agg(F.sum(F.col("l2").cast("decimal(38,12)")).cast("double").alias("l2"))
