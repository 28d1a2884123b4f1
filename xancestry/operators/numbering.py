"""Numbers by order over all rows, without one task that holds them: ranks from prefix sums over blocks and partitions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.planning import kept


def dense(df: DataFrame, block: list[Column], order: list[Column], name: str) -> DataFrame:
    """df with name, its rows' numbers from 0 in the order of block and, within a block, of order.

    Rows are numbered within blocks, which have to be small enough for a task; a block's first number is the sum of the counts of
    those before it, over one row a block.
    """
    keys = [f"block_{i}_" for i in range(len(block))]
    d = df.withColumns(dict(zip(keys, block)))
    before = Window.orderBy(*(f"of_{k}" for k in keys)).rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(*(F.col(k).alias(f"of_{k}") for k in keys)).agg(F.count("*").alias("n_")).withColumn("start_", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_")
    own = d.withColumn("own_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    met = own.join(starts, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys)))
    return met.withColumn(name, (F.col("start_") + F.col("own_")).cast("long")).drop(*keys, *(f"of_{k}" for k in keys), "start_", "own_")


#: What a row of bounds() asks for: itself, the points left of its reach, those not right of its lower end, those left of its upper end.
POINT, LEFT, LOW, HIGH = range(4)


def _least_within(x: np.ndarray, reach: float) -> np.ndarray:
    """The least number whose distance from x, as doubles round it, is within reach; by halving, as near 0 that may be many steps from x - reach."""
    slack = np.maximum(np.abs(x), reach) * 2.0**-50 + 1e-300
    beyond, within = x - reach - slack, x - reach + slack
    while True:
        mid = beyond + (within - beyond) / 2
        if ((mid <= beyond) | (mid >= within)).all():
            return within
        near = x - mid <= reach
        beyond, within = np.where(near, beyond, mid), np.where(near, mid, within)


def _probes(reach: float):
    """Each point and the three places whose ranks it asks for. side: before (-1) or after (1) the points that stand at a place."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            left = _least_within(x, reach)
            for kind, place, side in ((POINT, x, 0), (LEFT, left, -1), (LOW, x - reach, 1), (HIGH, x + reach, -1)):
                n = len(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), batch.column(2), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, side, np.int32))], ["idx", "place", "g", "kind", "side"])

    return run


def bounds(points: DataFrame, reach: float, by: str | None = None) -> DataFrame:
    """(idx long, x double, perhaps by) -> (idx, left, size): the first point within reach of each, and how many are nearer than reach.

    idx numbers the points from 0 in the order of x, within by if it is given, whose groups then stand one after the other; another order
    fails the query. Points and the places that they ask about are put in order together, in ranges; a place's rank is the number of
    points before it in its range and in the ranges before that. So no task holds more than a range, however far the reach.
    """
    if by is not None:
        # A group goes by the number of its first point, which keeps the groups in their order.
        g = points.groupBy(by).agg(F.min("idx").alias("g"))
        points = points.join(g, by)
    else:
        points = points.withColumn("g", F.lit(0).cast("long"))
    d = points.select(F.col("idx").cast("long").alias("idx"), F.col("x").cast("double").alias("x"), "g")
    probed = d.mapInArrow(_probes(float(reach)), "idx long, place double, g long, kind int, side int")
    order = ("g", "place", "side", "idx")
    # Kept, as ranges are drawn anew by every query; a partition that is lost falls into the same range again.
    ranged = kept(probed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    is_point = (F.col("kind") == POINT).cast("long")
    ahead = ranged.groupBy("part").agg(F.sum(is_point).alias("n"))
    ahead = ahead.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    here = F.coalesce(F.sum(is_point).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = ranged.withColumn("here", here).join(ahead, "part").select("idx", "kind", (F.col("here") + F.col("ahead")).alias("rank"))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("rank")))
    out = ranks.groupBy("idx").agg(of(POINT).alias("own"), of(LEFT).alias("left"), F.greatest(of(HIGH) - of(LOW), F.lit(0)).alias("size"))
    wrong = F.raise_error(F.lit("coordinates have to be in order")).cast("long")
    return out.select("idx", F.when(F.col("own") == F.col("idx"), F.col("left")).otherwise(wrong).alias("left"), F.when(F.col("own") == F.col("idx"), F.col("size")).otherwise(wrong).alias("size"))
