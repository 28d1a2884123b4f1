"""Near-duplicates by SimHash, with vantage-point trees over Hamming distance.

Fingerprints of 64 bits that differ in at most `radius` bits differ in at most radius // 4 bits in one of four quarters. Each
quarter is a metric space of 2 ** 16 values, which one vantage-point tree halves again and again by distance to
a vantage point. Its upper levels make shards: a fingerprint lives in the one leaf that holds its quarter, and is asked
in every leaf that the triangle bounds don't exclude for its ball. Within a shard the lower levels prune in the same way, and
what remains is compared in full. So every pair within the radius meets, and no other is linked.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, components, cut, exact, fresh

SHINGLE_WORDS, SEED, BITS = 4, 42, 64
QUARTERS, QUARTER_BITS = 4, 16
#: Fingerprints that a shard is to hold; levels of the tree at most; cells compared at once; shingles summed at once.
SHARD, DEPTH, CELLS, BLOCK = 8192, 14, 1 << 21, 1 << 16
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text: a bit is 1 if it is in over half of the shingles' hashes; 0 without words."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE_WORDS, len(words))
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
    return majority(np.array([h(joined[a:b], SEED) for a, b in spans[i : i + BLOCK]], "<u8") for i in range(0, len(spans), BLOCK))


def majority(blocks: Iterable[np.ndarray]) -> int:
    """Of hashes in blocks, the bits that over half of them have."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in blocks:
        ones += np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fp (the 64 bits as a signed long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fp = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], [id_col, "fp"])

    quoted = "`" + id_col.replace("`", "``") + "`"
    return docs.select(exact(id_col), exact(text_col)).mapInArrow(run, f"{quoted} {kind}, fp long")


@lru_cache(maxsize=8)
def tree(depth: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of the nodes of a tree over all 16-bit values, node n's children being 2n and 2n + 1.

    A node's values within the radius go to 2n, the rest to 2n + 1; the radius halves them as evenly as it can.
    """
    rng = np.random.default_rng(seed)
    points, radii = np.zeros(1 << depth, np.uint16), np.zeros(1 << depth, np.int16)
    node_of = np.ones(1 << QUARTER_BITS, np.int64)
    values = np.arange(1 << QUARTER_BITS, dtype=np.uint16)
    for level in range(depth):
        order = np.argsort(node_of, kind="stable")
        edges = np.searchsorted(node_of[order], np.arange(1 << level, (2 << level) + 1))
        for n in range(1 << level):
            own = values[order[edges[n] : edges[n + 1]]]
            at = n + (1 << level)
            if not len(own):
                continue
            points[at] = own[rng.integers(len(own))]
            d = np.bitwise_count(own ^ points[at])
            within = np.cumsum(np.bincount(d, minlength=QUARTER_BITS + 1))
            radii[at] = np.argmin(np.abs(2 * within - len(own)))
        d = np.bitwise_count(values ^ points[node_of]).astype(np.int16)
        node_of = 2 * node_of + (d > radii[node_of])
    return points, radii


def route(values: np.ndarray, start: np.ndarray, levels: int, reach: int, points: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, node) of all nodes `levels` below start that hold something within reach of each value; reach 0: its own."""
    index, node = np.arange(len(values)), start.astype(np.int64)
    for _ in range(levels):
        d = np.bitwise_count(values[index] ^ points[node]).astype(np.int16)
        near, far = d - reach <= radii[node], d + reach > radii[node]  # the triangle bounds
        index, node = np.concatenate((index[near], index[far])), np.concatenate((2 * node[near], 2 * node[far] + 1))
    return index, node


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent, flat, with the sets of a[i] and b[i] made one under the smallest index."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (nxt := parent[parent]).tobytes() != parent.tobytes():
            parent = nxt


def shard_links(fps: np.ndarray, home: np.ndarray, quarter: int, leaf: int, level: int, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest one linked to it) within a shard; those at home are compared with all. A spanning forest: of a set of m m - 1 links."""
    points, radii = tree(depth)
    order = np.argsort(fps, kind="stable")
    fps, home = fps[order], home[order]
    bits = fps.view(np.uint64)
    values = ((bits >> np.uint64(QUARTER_BITS * quarter)) & np.uint64(0xFFFF)).astype(np.uint16)
    start = np.full(len(fps), leaf)
    at_home = np.flatnonzero(home)
    k, own = route(values[at_home], start[at_home], depth - level, 0, points, radii)
    who, asked = route(values, start, depth - level, radius // QUARTERS, points, radii)
    # Leaf by leaf; in each those at home against those asked.
    h = np.argsort(own, kind="stable")
    own, at_home = own[h], at_home[k[h]]
    q = np.argsort(asked, kind="stable")
    asked, who = asked[q], who[q]
    parent = np.arange(len(fps))
    leaves, first = np.unique(own, return_index=True)
    ends = np.append(first[1:], len(own))
    lo, hi = np.searchsorted(asked, leaves), np.searchsorted(asked, leaves, side="right")
    for f, e, l, r in zip(first, ends, lo, hi):
        a, b = at_home[f:e], who[l:r]
        step = max(1, CELLS // max(1, len(a)))
        for i in range(0, len(b), step):
            part = b[i : i + step]
            x, y = np.nonzero(np.bitwise_count(bits[a][:, None] ^ bits[part][None, :]) <= radius)
            x, y = a[x], part[y]
            new = x < y
            if new.any():
                parent = unite(parent, x[new], y[new])
    linked = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[linked], fps[parent[linked]]


def links(distinct: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """(u, v) of fingerprints (column fp, each once) that are linked: enough links to connect all that are."""
    depth = DEPTH
    level = int(min(depth, max(0, np.ceil(np.log2(max(1, n) / SHARD)))))
    reach = radius // QUARTERS

    def spread(batches):
        points, radii = tree(depth)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            start = np.ones(len(fp), np.int64)
            for quarter in range(QUARTERS):
                values = ((fp.view(np.uint64) >> np.uint64(QUARTER_BITS * quarter)) & np.uint64(0xFFFF)).astype(np.uint16)
                index, node = route(values, start, level, reach, points, radii)
                own = np.zeros(len(fp), np.int64)
                k, leaf = route(values, start, level, 0, points, radii)
                own[k] = leaf
                shard = (quarter << depth) + node - (1 << level)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(fp[index]), pa.array(own[index] == node)], ["shard", "fp", "home"])

    def within(group):
        shard = group.column("shard")[0].as_py()
        fp, home = (pc.fill_null(group.column(c), 0 if c == "fp" else False).to_numpy() for c in ("fp", "home"))
        a, b = shard_links(fp, home, shard >> depth, (shard & ((1 << depth) - 1)) + (1 << level), level, depth, radius)
        return pa.table({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64())})

    return distinct.select("fp").mapInArrow(spread, "shard int, fp long, home boolean").groupBy("shard").applyInArrow(within, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which documents are linked by fingerprints that differ in at most radius bits, directly or over others.

    Returns id_col, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable (null only if no
    row of the component has an id). Equal fingerprints stand for one node, so copies add no work to the search; a null
    or empty text has fingerprint zero and is linked like any other; repeated rows share a component; other columns are
    left out; an empty table gives an empty one. Radii from 0 to 63 are exact; the trees prune well for small ones.
    """
    if not 0 <= radius < BITS:
        raise ValueError("a radius from 0 to 63")
    each = cut(fingerprints(docs.select(exact(id_col).alias("id"), exact(text_col).alias("text")), "id", "text"))
    return with_components(each, radius).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_components(each: DataFrame, radius: int) -> DataFrame:
    """(id, fp) -> also component_id."""
    nodes = grouped(each, radius)
    least = nodes.groupBy("c").agg(F.min("least").alias("component_id"))
    return each.join(nodes.join(least, "c").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def grouped(each: DataFrame, radius: int) -> DataFrame:
    """(id, fp) -> (fp, least id, c) with c the component's smallest fingerprint."""
    distinct = cut(each.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(distinct, distinct.count(), radius))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))


def one_of_each(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: the smallest id, and of rows that share it any one.

    A row without an id stays only where no row of its group has one. All columns stay.
    """
    at, row = fresh(docs, "fp"), fresh(docs, "row")
    k = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(at, T.LongType())])

    def run(batches):
        for batch in batches:
            fp = np.fromiter(map(fingerprint, batch.column(k).to_pylist()), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], [*batch.schema.names, at])

    # Written, so that the numbers of the rows are the same whenever they are read.
    whole = cut(docs.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()))
    each = whole.select(exact(id_col).alias("id"), exact(at).alias("fp"), exact(row).alias("row"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    nodes = grouped(each, radius)
    mine = each.groupBy("fp").agg(first).join(nodes.select("fp", "c"), "fp").groupBy("c").agg(F.min("first").alias("first"))
    kept = mine.select(F.col("first.row").alias(row))
    return whole.join(kept, row, "left_semi").select(*map(exact, docs.columns))
