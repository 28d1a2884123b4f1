"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the mix in proportion to its weight, but no more than a number of epochs of
its own size; what a capped source can't take is shared out again by weight until no source is above its cap.
That is the level at which the sources, filled in proportion to their weights and each up to its cap, hold the
whole mix; it is found in one pass over the sources in the order in which they fill up. A source's target is then
met with whole repetitions of all its documents and one more of a seeded selection of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, deleted, exact, holding

#: Hexadecimal digits of a document's seeded rank, and of these the first ones by which ranks are summed in bins.
RANK_DIGITS, BIN_DIGITS = 13, 3
#: The plan, a row a source, and the kinds of rows of a split rank are broadcast only up to this number of rows; beyond it they are joined.
MOST_BROADCAST = 50_000
#: A column that is added to tables whose own columns have other names (see repeated).
ROW = "mix_row"


def words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def rank(seed: str, id_: Column, text: Column) -> Column:
    """A document's seeded place in its source, from 0 to 16 ** RANK_DIGITS - 1, by its id; by its text if it has none."""
    of = F.coalesce(F.concat(F.lit(seed + ":"), id_.cast("string")), F.concat(F.lit(seed + "::"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(of.cast("binary")), 1, RANK_DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, epochs: int) -> DataFrame:
    """(source, source_size) -> also target double. Sources by code point, null last, take the weights in turn.

    One row a source goes through one task; the rows are sums, not documents.
    """
    line = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.select("source", "source_size", (F.row_number().over(line) - 1).alias("k"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * epochs)
    # In the order in which sources fill up, those before a source are full when the level reaches it.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    whole = Window.partitionBy()
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(whole) * percent)
    # The level if this source and all after it stay below their caps; right for the first for which it does so.
    s = s.withColumn("level", (F.col("total") - 100 * F.col("full")) / (100.0 * F.col("open")))
    s = s.withColumn("turn", F.row_number().over(filling))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("turn", "level"))).over(whole)
    s = s.withColumn("level", level["level"])
    reach = F.col("level") * F.col("weight")
    target = F.when(F.col("level").isNull() | (reach >= F.col("cap")), F.col("cap").cast("double")).otherwise(reach)
    return s.select("source", "source_size", target.alias("target"))


def taken_of(slim: DataFrame, share: DataFrame) -> DataFrame:
    """row of `fit` rows of each kind in share (source, r, size, tie, fit): numbered within a partition of the written rows, behind those of the partitions before it."""
    kind = ["source", "r", "size", "tie"]
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.r") == F.col(f"{b}.r")) & (F.col(f"{a}.size") == F.col(f"{b}.size")) & (F.col(f"{a}.tie") == F.col(f"{b}.tie"))
    rows = slim.alias("a").join(share.alias("b"), same("a", "b")).select("a.source", "a.r", "a.size", "a.tie", "b.fit", "a.row", F.shiftright("a.row", 33).alias("part"))
    parts = rows.groupBy(*kind, "part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy(*kind).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = rows.withColumn("k", F.row_number().over(Window.partitionBy(*kind, "part").orderBy("row")))
    return own.alias("x").join(parts.alias("y"), same("x", "y") & (F.col("x.part") == F.col("y.part"))).where("x.k + y.ahead <= x.fit").select("x.row")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, epochs: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """How often the mix takes each document.

    Returns id_col, size, source_size, target, taken (repeats * size), repeats; with keep all of docs' columns come
    first instead of id_col alone, and the five others are prefixed by "mix_". Every document is taken
    floor(target / source_size) times, and once more if it is in the seeded selection: documents in the order of
    their seeded ranks while half of the next one still fits what the whole repetitions leave of the target.
    Documents of no words take no room; they follow the same order. A null text has no words, a null source is a source,
    a source of no words has target 0 and is taken 0 times, repeated rows count each, and an empty table gives an empty one.
    Rows of one rank (a repeated id, or none and the same text) are in the order of their sizes and texts; of rows that are equal in these, too,
    as many are taken as fit, whichever.

    Sums by bins of ranks are made on the executors, so that no source, however large, goes through one task: of a
    source only the bin in which the target is met is ordered, by sums of equal rows; and equal rows are numbered a partition at a time.
    """
    prefix = "mix_" if keep else ""
    size, rank_ = words(exact(text_col)), rank(seed, exact(id_col), exact(text_col))
    row, tie = F.monotonically_increasing_id(), F.xxhash64(exact(text_col))
    if keep:  # written, so that the numbers of the rows are the same whenever they are read
        whole = cut(docs.withColumn(ROW, row))
        slim = whole.select(F.col(ROW).alias("row"), exact(source_col).alias("source"), size.alias("size"), rank_.alias("r"), tie.alias("tie"))
    else:
        slim = docs.select(exact(id_col).alias("id"), row.alias("row"), exact(source_col).alias("source"), size.alias("size"), rank_.alias("r"), tie.alias("tie"))
    slim = cut(slim)
    width = 16 ** (RANK_DIGITS - BIN_DIGITS)
    bins = slim.groupBy("source", F.floor(F.col("r") / width).alias("bin")).agg(F.sum("size").alias("size"))
    sizes = bins.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(sizes, weights, percent, epochs)
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # The last bin of each source that begins within the rest, and what the bins before it hold.
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    run = bins.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    met = run.alias("b").join(t.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).where("b.before <= t.rest")
    met = met.groupBy("t.source").agg(F.max("bin").alias("bin"), F.max_by("before", "bin").alias("before"), F.first("rest").alias("rest"))
    # Within that bin: ranks in order, equal rows together.
    one = slim.withColumn("bin", F.floor(F.col("r") / width)).alias("d").join(met.alias("m"), F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col("d.bin") == F.col("m.bin")))
    ties = one.groupBy(F.col("m.source").alias("source"), "r", "size", "tie").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("r", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("room", F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(upto), F.lit(0)))
    # How many of the equal rows fit: half of the last one has to. Where some do and some don't, or rows of one rank differ, the rows are listed.
    fit = F.when(F.col("size") > 0, F.least(F.col("n"), F.floor(F.col("room") / F.col("size") + 0.5))).otherwise(F.when(F.col("room") >= 0, F.col("n")).otherwise(0))
    ties = cut(ties.withColumn("fit", F.greatest(F.lit(0), fit).cast("long")).select("source", "r", "size", "tie", "n", "fit"))
    edge = ties.groupBy("source", "r").agg(F.sum("fit").alias("fit"), F.sum("n").alias("n")).groupBy("source").agg(F.max(F.when(F.col("fit") == F.col("n"), F.col("r"))).alias("last"), F.max(F.when((F.col("fit") > 0) & (F.col("fit") < F.col("n")), F.col("r"))).alias("split"))
    plan = t.alias("t").join(met.select("source", "bin").alias("m"), F.col("t.source").eqNullSafe(F.col("m.source")), "left")
    plan = plan.join(edge.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
    plan = levels = cut(plan.select(F.col("t.source").alias("source"), "source_size", "target", "whole", F.coalesce("last", F.col("bin") * width - 1, F.lit(-1)).alias("last"), "split"))
    plan = F.broadcast(plan) if plan.count() <= MOST_BROADCAST else plan
    # Rows of a rank of which only some are taken.
    share = cut(plan.where("split is not null").alias("p").join(ties.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.split") == F.col("t.r"))).where("t.fit > 0").select("t.source", "t.r", "t.size", "t.tie", "t.fit"))
    # A row for each kind of text of the rank, whose number isn't that of the sources: one id may stand on many texts.
    chosen = cut(taken_of(slim, F.broadcast(share) if share.count() <= MOST_BROADCAST else share))
    deleted(ties, share)
    if keep:
        deleted(slim)
        d = whole.select(F.struct(*map(exact, docs.columns)).alias("doc"), F.col(ROW).alias("row"), exact(source_col).alias("source"), size.alias("size"), rank_.alias("r"))
    else:
        d = slim.select(F.struct(F.col("id").alias(id_col)).alias("doc"), "row", "source", "size", "r")
    out = d.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    more = F.col("r") <= F.col("last")
    if not chosen.isEmpty():
        out = out.join(chosen.withColumn("picked", F.lit(True)), "row", "left")
        more = more | F.coalesce("picked", F.lit(False))
    repeats = (F.col("whole") + F.when(more & (F.col("whole") < epochs) & (F.col("target") > 0), 1).otherwise(0)).cast("long")
    extra = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": repeats * F.col("size"), "repeats": repeats}
    return holding(out.select("doc.*", *(x.alias(prefix + n) for n, x in extra.items())), levels, chosen, whole if keep else slim)


def repeated(docs: DataFrame, **how) -> DataFrame:
    """docs with every row as often as the mix takes it, and docs' columns only. What it reads is released() once it has been written."""
    kept = [exact(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    plain = docs.select(*kept)
    names = {k: f"c{docs.columns.index(how.pop(k, v))}" for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    mixed = mix(plain, keep=True, **names, **how)
    out = mixed.where("mix_repeats > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_repeats"))))
    return holding(out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns))), *mixed.cut_tables)
