"""What the operators of this subpackage share: tables, bounded shipping, and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest file that an operator ships to every executor (a vocabulary); beyond it the caller must shard.
MAX_SHIPPED_BYTES = 64 << 20

#: The pattern of a word, and what A-Z become; both are part of the operators' contracts.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate in Python workers.
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession, path: str):
    """Broadcast of the bytes of a vocabulary file on the driver, refused above MAX_SHIPPED_BYTES."""
    with open(path, "rb") as f:
        data = f.read(MAX_SHIPPED_BYTES + 1)
    if len(data) > MAX_SHIPPED_BYTES:
        raise ValueError(f"{path} has more than {MAX_SHIPPED_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have in any case."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name += "_"
    return name


def exact(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of its own only where none is named, as in tests, on a single machine."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        at = "/tmp/checkpoints/xancestry"
    if at is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again: no lineage, and no executor's disk, stands behind it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/xancestry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def deleted(*tables: DataFrame | None) -> None:
    """Removes the files of tables that cut() returned. They may not be read again: what hangs on them has to be written before."""
    for df in tables:
        if df is not None:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
            path.getFileSystem(conf).delete(path, True)


def holding(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, which still reads these tables of cut(): to be released() once it has been written."""
    df.cut_tables = [*getattr(df, "cut_tables", []), *tables]
    return df


def released(df: DataFrame) -> None:
    """Deletes what df read, now that it has been written."""
    deleted(*getattr(df, "cut_tables", []))


@contextmanager
def rows_a_batch(spark: SparkSession, n: int):
    """Queries that run within get Arrow batches of at most n rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(u long, v long) links -> (node long, component long), component the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes; every step is a
    group-by with map-side minima and an equi-join that AQE can split, so a node with any number
    of links is never gathered in one task. Each round is written to the shared folder, which
    cuts the lineage and survives lost executors. Nodes without links don't appear.
    """
    spark = edges.sparkSession
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        # Large star: each neighbour above a node links to the smallest in the node's neighbourhood.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: each node and its smaller neighbours link to the smallest of these.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = cut(small)
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        deleted(now)
        now = after
        if sums == mark:
            break
        mark = sums
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


#: Rounds in which a key's nodes are compared with one of them, before all that are still apart are compared.
STARS = 3
#: Nodes of a key whose pairs are compared as they are; of a key with more only those that an operator's own exact way leaves.
CROWD = 64
#: Pairs of the last step from which on they are verified in turns, by shares of TURNS.
MANY, TURNS, FIRST = 1 << 15, 16, ((0, 1), (1, 4), (4, 16))


def linked(
    posted: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    fits: Callable[[Column, Column], Column] | None = None,
    known: tuple[DataFrame, DataFrame] | None = None,
    crowded: tuple[Callable[[DataFrame], DataFrame], Callable[[Column, Column], Column]] | None = None,
) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(node long, key long, perhaps x), each node and key once -> (links that verify found, their components as from components(), tables to delete at the end).

    verify takes pairs (u long, v long), u > v, and returns those that hold, with any further columns. Pairs that share a key, and for which
    fits says so of what each has in x for that key, are candidates; a candidate goes unverified only if its nodes hang together over links already, so the
    components are those of all candidates. A few rounds compare each node with one node of each key that it has, first the one whose keys are the most
    shared (of near-copies the one that the others were made from), then another one every round, which joins a large group of near-copies without its
    pairs; then every pair still apart is verified. known: pairs that another search has verified already, and the links among them.
    crowded: for that last step a function that takes the nodes (node, key, c, perhaps x) of keys with over CROWD of them and returns other keys for them, of which every
    pair of different c that verify would accept shares one for which the second function, fits of these keys, holds.
    """
    links = met = tried = None
    own, x = [c for c in ("x",) if c in posted.columns], [F.col(c) for c in ("x",) if c in posted.columns]
    used = []

    def kept(df):
        used.append(cut(df))
        return used[-1]

    def apart(now):
        return now.join(now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"), "key")

    def paired(now, near):
        # A key's largest component needs no row on the left: its pairs with others stand there with these on the left.
        size = now.groupBy("key", "c").agg(F.count("*").alias("n"))
        main = size.groupBy("key").agg(F.max(F.struct("n", "c"))["c"].alias("main"))
        left = now.join(main, "key").where("c <> main").select("key", "node", "c", *x)
        pairs = left.join(now.select("key", F.col("node").alias("o"), F.col("c").alias("oc"), *(F.col(k).alias("o" + k) for k in own)), "key").where("c <> oc")
        return told(pairs, near)

    def told(pairs, near):
        pairs = pairs.where(near(F.col("x"), F.col("ox"))) if near else pairs
        return pairs.select(F.greatest("node", "o").alias("u"), F.least("node", "o").alias("v"))

    shared = posted.join(posted.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("node").agg(F.sum("n").alias("shared"))
    if known is not None:
        tried, links = known
        met = kept(components(links.select("u", "v")))
    for turn in range(STARS + 1):
        now = posted
        if met is None:
            now = now.withColumn("c", F.col("node"))
        else:
            now = now.join(met.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
            now = kept(apart(now))
        if turn < STARS:
            rank = F.xxhash64("node", F.lit(turn)) if turn else -F.col("shared")
            other = (now if turn else now.join(shared, "node")).groupBy("key").agg(F.min(F.struct(rank.alias("r"), "node", "c", *x)).alias("o")).select("key", F.col("o.node").alias("o"), F.col("o.c").alias("oc"), *(F.col(f"o.{k}").alias("o" + k) for k in own))
            pairs = told(now.join(other, "key").where("c <> oc"), fits)
        elif crowded is None:
            pairs = paired(now, fits)
        else:
            crowds = now.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key")
            pairs = paired(now.join(crowds, "key", "left_anti"), fits)
            other = crowded[0](now.join(crowds, "key", "left_semi"))
            dense = kept(apart(other))
            released(other)
            pairs = pairs.union(paired(dense, crowded[1]))
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = kept(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        # Of many pairs a few first, by which most that hold hang together: of the rest those count that are apart still.
        turns = FIRST if turn == STARS and pairs.count() > MANY else ((0, TURNS),)
        for lo, hi in turns:
            some = pairs
            if hi - lo < TURNS:
                some = pairs.where(F.pmod(F.xxhash64("u", "v"), F.lit(TURNS)).between(lo, hi - 1))
            if lo:
                for k in ("u", "v"):
                    some = some.join(met.select(F.col("node").alias(k), F.col("component").alias(f"{k}c")), k, "left")
                some = some.where(~F.coalesce(F.col("uc") == F.col("vc"), F.lit(False))).select("u", "v")
            new = kept(verify(some))
            links = new if links is None else links.union(new)
            if met is None or not new.isEmpty():
                met = kept(components(links.select("u", "v")))
    return links, met, used


class Memo(dict):
    """A bounded memo: emptied when it holds `most` entries, so a worker's memory doesn't follow the data."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out
