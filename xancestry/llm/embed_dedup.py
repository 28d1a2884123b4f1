"""Near-duplicate vectors by cross-polytope hashing.

Vectors are turned by random signs and fast Hadamard transforms, three times over; the hash is the axis nearest to
the result, and its sign. Several such hashes side by side, the last perhaps over fewer axes, make a bucket of a table. Every
vector lives in one bucket of each table, and is asked in the next best ones too (multiprobe). What travels to the buckets is a vector in
bytes, with a bound of what rounding may change: that settles nearly all pairs that meet. The rows of those that it can't settle are fetched
in full and compared in double precision, so exactly the pairs that meet and reach the threshold are linked.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, deleted, exact

#: Fewest tables, buckets of each that a vector is asked in (its own first), vectors that a bucket is to hold, most bits of a bucket's number,
#: rows of a block; a bucket of more rows is split in blocks of two chunks each.
TABLES, PROBES, BUCKET, MOST_BITS, CHUNK = 2, 2, 512, 56, 2048
#: Share of the pairs at the threshold that the tables are to find, and simulated pairs that tell how many tables it takes.
RECALL, TRIALS = 0.95, 4000
#: More than single precision errs in a cosine. Pairs compared in full at once.
MARGIN, PAIRS = 1e-5, 1 << 14


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows (a power of two long)."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


def turned(x: np.ndarray, seed: int) -> np.ndarray:
    n = 1 << max(0, int(x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], n))
    return y


def buckets(x: np.ndarray, table: int, axes: list[int], probes: int) -> np.ndarray:
    """[row, probe] numbers of a table's buckets, the vector's own first, then those of least loss. axes: coordinates of each hash."""
    best = []
    for k, m in enumerate(axes):
        y = turned(x, 1000 * table + k)[:, :m]
        size = np.abs(y)
        top = np.argsort(-size, axis=1, kind="stable")[:, : max(2, probes)]
        value = np.take_along_axis(size, top, 1)
        code = 2 * top + (np.take_along_axis(y, top, 1) < 0)
        best.append((code, value[:, :1] - value, 2 * y.shape[1]))
    # All ways to leave the nearest axes, by the height given up.
    ways = np.array(sorted(itertools.product(*(range(b[0].shape[1]) for b in best)), key=sum)[: max(probes * 4, probes)])
    code, loss = np.zeros((len(x), len(ways)), np.int64), np.zeros((len(x), len(ways)))
    for k, (c, v, n) in enumerate(best):
        code = code * n + c[:, ways[:, k]]
        loss += v[:, ways[:, k]]
    order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(code, order, 1)


def unit(vectors) -> np.ndarray:
    """Unit vectors of double precision of equally long rows."""
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes_for(n: int, dim: int) -> list[int]:
    """Coordinates of each hash of a bucket, so that n vectors fill about BUCKET each: whole turns, and a part of one for the rest."""
    whole = 1 << max(0, (dim - 1).bit_length())
    bits, each = max(0.0, np.log2(max(2, n) / BUCKET)), 1 + (whole - 1).bit_length()
    bits = min(bits, MOST_BITS)
    k, rest = divmod(bits, each)
    out = [whole] * max(1, int(k))
    if k and rest >= 1.5:
        out.append(1 << min(each - 1, round(rest) - 1))
    return out


def tables_for(axes: list[int], dim: int, threshold: float, probes: int = PROBES) -> int:
    """Tables that find RECALL of the pairs whose cosine is threshold, by simulated pairs: more hashes find fewer in each table."""
    if dim < 2 or threshold >= 1:
        return TABLES
    rng = np.random.default_rng(17)
    size = max(1, min(500, (1 << 18) // dim))
    met = rounds = 0
    for t in range(-(-TRIALS // size)):
        x, z = unit(rng.normal(size=(size, dim))), rng.normal(size=(size, dim))
        z = unit(z - (z * x).sum(1, keepdims=True) * x)
        y = threshold * x + np.sqrt(1 - threshold * threshold) * z
        a, b = buckets(x, 900 + t, axes, probes), buckets(y, 900 + t, axes, probes)
        met += int(((a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)).sum())
        rounds += size
    share = min(max(met, 1) / rounds, 1 - 1e-9)
    return max(TABLES, int(np.ceil(np.log(1 - RECALL) / np.log(1 - share))))


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as (bytes, scale, length of what rounding took away)."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    lost = x - q * scale[:, None]
    return q, scale, np.sqrt((lost * lost).sum(1)) * (1 + 1e-9)


def code_type(axes: list[int]) -> str:
    """The smallest integers that hold a bucket's number."""
    bits = sum(1 + (m - 1).bit_length() for m in axes)
    return next(f"<u{k}" for k in (1, 2, 4, 8) if bits <= 8 * k)


def pairs_of_block(mult, q, scale, lost, asked, table, bucket, first, threshold, full=None):
    """Links of one block. first: rows of the first chunk, to be compared with the rest, or None: all with all.

    full None: counts the pairs whose bytes tell that they are linked; else the unit vectors, which tell the pairs that their bytes don't.
    Returns (links of each row, smallest row linked over links, rows of pairs left open). A pair counts in the
    first table, and in that the first of the two's own buckets, in which it meets, so nowhere twice.
    """
    from .simhash import unite

    n, own = len(mult), asked[:, :, 0]
    kind = np.float32 if 127 * 127 * q.shape[1] < 1 << 24 else np.float64  # sums of products are exact
    x_all = q.astype(kind)
    count, parent, open_ = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)
    here = own[:, table] == bucket
    home, guest = np.flatnonzero(here), np.flatnonzero(~here)
    if first is None:
        sides = [(home, home, True), (home, guest, False)]
    else:
        sides = [(home[first[home]], np.flatnonzero(~first), False), (guest[first[guest]], home[~first[home]], False)]
    for a_all, b_all, same in sides:
        if not len(a_all) or not len(b_all):
            continue
        worst = lost[a_all].max() + lost[b_all].max()
        least = threshold - MARGIN - worst * (1 + worst)
        for i in range(0, len(a_all), 512):
            a = a_all[i : i + 512]
            dots = x_all[a] @ x_all[b_all].T
            dots *= scale[a, None].astype(kind)
            dots *= scale[b_all].astype(kind)
            x, y = np.nonzero(dots >= least)
            cos = dots[x, y].astype(np.float64)
            x, y = a[x], b_all[y]
            ok = x < y if same else slice(None)
            x, y, cos = x[ok], y[ok], cos[ok]
            slack = lost[x] + lost[y] + lost[x] * lost[y] + MARGIN
            sure = cos - slack >= threshold
            unsure = ~sure & (cos + slack >= threshold)
            use = sure if full is None else unsure
            rest = (x[unsure], y[unsure]) if full is None else None
            x, y = x[use], y[use]
            if full is not None and len(x):
                near = np.concatenate([(full[x[k : k + PAIRS]] * full[y[k : k + PAIRS]]).sum(1) >= threshold for k in range(0, len(x), PAIRS)])
                x, y = x[near], y[near]
            for lo, hi, final in ((x, y, True), (*rest, False)) if rest else ((x, y, True),):
                lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)  # rows are in the order of ids
                if not len(lo):
                    continue
                if final:
                    parent = unite(parent, lo, hi)
                met = np.zeros(len(lo), bool)
                for t in range(table):
                    met |= (asked[hi, t] == own[lo, t, None]).any(1) | (asked[lo, t] == own[hi, t, None]).any(1)
                met |= ~here[lo] & (asked[hi, table] == own[lo, table, None]).any(1)
                lo, hi = lo[~met], hi[~met]
                if final:
                    np.add.at(count, lo, mult[hi])
                    np.add.at(count, hi, mult[lo])
                else:
                    open_[lo] = open_[hi] = True
    return count, parent, open_


KEY = ["table", "bucket", "dim", "i", "j"]


def link(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", tables: int | None = None, probes: int = PROBES) -> DataFrame:
    """Links vectors whose cosine is at least threshold.

    Returns id_col (as long), n_links (other rows linked directly), component_id (smallest id reachable, itself
    included) and kept (id = component_id). Vectors that are null, empty or zero or hold a null or non-finite component,
    and rows without an id, link with nothing (without an id the component is null, and the row isn't kept). Vectors of
    different length aren't compared. Equal vectors, repeated rows among them, are linked with each other and stand for
    one class in the search. Without tables given, as many are made as find RECALL of the pairs at the threshold, however many
    hashes the number of vectors asks for. Other columns are left out; an empty table gives an empty one.
    """
    kind, spark_kind = ("<f4", "float") if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else ("<f8", "double")
    v = vectors.select(exact(id_col).cast("long").alias("id"), exact(vec_col).cast(f"array<{spark_kind}>").alias("v"))

    def read(batches):
        """(id, digest and bytes of the vector; both null if it links with nothing)"""
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            digests, found = [None] * len(ids), [None] * len(ids)
            sizes = np.asarray(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            sizes[np.asarray(ids.is_null())] = 0
            starts = col.offsets.to_numpy().astype(np.int64)[:-1]
            values = np.asarray(col.values.to_numpy(zero_copy_only=False), kind)  # a null component is NaN
            for dim in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == dim)
                x = values[starts[rows, None] + np.arange(dim)] + np.zeros(1, kind)  # no -0.0
                fine = np.isfinite(x).all(1) & (x != 0).any(1)
                for k, one in zip(rows[fine], x[fine]):
                    found[k] = one.tobytes()
                    digests[k] = hashlib.blake2b(found[k], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary()), pa.array(found, pa.binary())], ["id", "digest", "vec"])

    each = v.mapInArrow(read, "id long, digest binary, vec binary")
    classes = cut(each.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.any_value("vec").alias("vec")))
    width = np.dtype(kind).itemsize
    found = classes.groupBy((F.length("vec") / width).cast("int").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()  # a row a length of vectors
    axes = {r["dim"]: axes_for(r["n"], r["dim"]) for r in found}
    tables_of = {dim: tables or tables_for(a, dim, threshold, probes) for dim, a in axes.items()}

    def spread(batches):
        """Each class's cells, and what travels there: bytes, scale, loss, and the numbers of all cells."""
        for batch in batches:
            rep, mult, vec = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            dims = np.array([len(x) // width for x in vec])
            for dim in map(int, np.unique(dims)):
                rows = np.flatnonzero(dims == dim)
                x, codes = unit(np.frombuffer(b"".join(vec[i] for i in rows), kind).reshape(-1, dim)), code_type(axes[dim])
                all_ = np.stack([buckets(x, t, axes[dim], probes) for t in range(tables_of[dim])], 1)
                q, scale, lost = rounded(x)
                asked = all_.reshape(len(rows), -1)
                n, cells = asked.shape
                table = np.tile(np.repeat(np.arange(tables_of[dim], dtype=np.int32), all_.shape[2]), n)
                cell = pa.StructArray.from_arrays([pa.array(table), pa.array(asked.ravel())], ["table", "bucket"])
                some = np.concatenate((q.view(np.uint8), scale[:, None].view(np.uint8), lost[:, None].view(np.uint8), asked.astype(codes).view(np.uint8).reshape(n, -1)), 1)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [rep.take(at), mult.take(at), pa.array(np.full(n, dim, np.int32)), pa.ListArray.from_arrays(np.arange(0, n * cells + 1, cells, dtype=np.int32), cell), pa.array([r.tobytes() for r in some], pa.binary())],
                    ["rep", "mult", "dim", "cells", "some"],
                )

    hashed = cut(classes.select("rep", "mult", "vec").mapInArrow(spread, "rep long, mult long, dim int, cells array<struct<table:int,bucket:long>>, some binary"))
    # How many rows each bucket has; only those of more than a chunk are split, and only their numbers are joined.
    cell = ["table", "bucket", "dim"]
    placed = hashed.select("rep", "mult", "dim", "some", F.explode("cells").alias("c")).select("c.table", "c.bucket", "dim", "rep", "mult", "some")
    full = placed.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select(*cell, F.ceil(F.col("n") / CHUNK).alias("chunks"))
    rows = placed.join(full, cell, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select(*cell, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "mult", "some")

    def within(group):
        col = lambda c: group.column(c).combine_chunks()
        key = {c: col(c)[0].as_py() for c in KEY}
        rep, dim = col("rep").to_numpy(), key["dim"]
        order = np.argsort(rep, kind="stable")
        rep, mult, chunk = rep[order], col("mult").to_numpy()[order], col("chunk").to_numpy()[order]
        some = np.frombuffer(b"".join(col("some").to_pylist()), np.uint8).reshape(len(rep), -1)[order]
        number = lambda k: np.ascontiguousarray(some[:, k : k + 8]).view("<f8")[:, 0]
        asked = np.ascontiguousarray(some[:, dim + 16 :]).view(code_type(axes[dim])).reshape(len(rep), tables_of[dim], -1)
        vec = unit(np.frombuffer(b"".join(col("vec").to_pylist()), kind).reshape(len(rep), dim)[order]) if "vec" in group.column_names else None
        first = None if key["i"] == key["j"] else chunk == key["i"]
        count, parent, open_ = pairs_of_block(mult, some[:, :dim].view(np.int8), number(dim), number(dim + 8), asked, key["table"], key["bucket"], first, threshold, vec)
        use = np.flatnonzero((count > 0) | (parent != np.arange(len(rep))) | open_)
        same = lambda c, t: pa.array(np.full(len(use), key[c]), t)
        types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([*map(same, KEY, types), *map(pa.array, (chunk[use], rep[use], rep[parent[use]], count[use], open_[use]))], [*KEY, "chunk", "u", "v", "n", "open"])

    schema = "table int, bucket long, dim int, i long, j long, chunk long, u long, v long, n long, open boolean"
    met = cut(rows.groupBy(*KEY).applyInArrow(within, schema))
    left = met.where("open").select(*KEY, "chunk", F.col("u").alias("rep"))
    both = met.select("u", "v", "n")
    if not left.isEmpty():
        again = left.join(hashed.select("rep", "mult", "some"), "rep").join(classes.select("rep", "vec"), "rep")
        both = both.union(cut(again.groupBy(*KEY).applyInArrow(within, schema)).select("u", "v", "n"))
    per = both.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(both.select("u", "v"))
    got = classes.select("digest", "rep", "mult").join(per, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    got = cut(got.select("digest", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")))
    deleted(classes, hashed, met)
    out = each.select("id", "digest").join(got, "digest", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
