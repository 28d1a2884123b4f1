"""Term-wide association of an outcome with the words of free text, by cohort, kept up as documents arrive.

Biobanks hold notes beside genotypes. For every word and cohort this job fits the outcome (0 or 1 by document) on whether a
document has the word, and gives the engine's standard columns, so its output is filtered, converted and pooled like summary statistics
of variants. Documents are read as a file stream: a run takes the files that no earlier run took, and adds their counts to the state.
The counts are sums, so the result is that of all documents at once, in whatever order they come.

State: a batch adds to the counts of the one before it, in the other of two folders, and is marked with its number. A batch
that is repeated after a failure reads what it read before and replaces what it wrote.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, log_to_console, table_at, written
from xancestry.functions import expressions as X
from xancestry.operators import quality

DEFAULTS = {"id": "doc_id", "text": "text", "cohort": "source", "outcome": "quality", "unnamed": "unnamed", "frequencies": [0.01, 0.99], "least_carriers": 3, "files_per_batch": None}
#: A word: lower-case letters and digits of ASCII and all that isn't ASCII, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for all documents of a cohort; no word is empty.
EVERYONE = ""
STATE = "cohort string, term string, n long, cases long, batch long"
RESULT = "SNP string, CARRIERS long, N double, FREQ double, BETA double, SE double, Z double, P string, cohort string"
POOLED = "SNP string, COHORTS long, N double, BETA double, SE double, Z double, P string, Q double"


def outcomes(labels: DataFrame, c: dict) -> DataFrame:
    """(id, y): one outcome a document, the smallest if there are more; others than 0 and 1 count as none."""
    return labels.groupBy(F.col(c["id"]).alias("id")).agg(F.min(c["outcome"]).cast("long").alias("y")).where("y in (0, 1)")


def counts(docs: DataFrame, labels: DataFrame, c: dict) -> DataFrame:
    """(cohort, term, n, cases): documents with an outcome that have a word, and those among them with outcome 1. A null text has no words."""
    cohort = F.when(F.coalesce(F.col(c["cohort"]), F.lit("")) == "", F.lit(c["unnamed"])).otherwise(F.col(c["cohort"]))
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(c["text"]), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    d = docs.select(F.col(c["id"]).alias("id"), cohort.alias("cohort"), words.alias("words")).join(outcomes(labels, c), "id")
    each = d.select("cohort", "y", F.explode(F.concat(F.array(F.lit(EVERYONE)), F.array_distinct("words"))).alias("term"))
    return each.groupBy("cohort", "term").agg(F.count("*").alias("n"), F.sum("y").alias("cases"))


def associations(state: DataFrame, c: dict) -> quality.Checked:
    """A least-squares line of the outcome on a word's presence by cohort, in standard columns, with the quality filters' flags."""
    own = state.where(F.col("term") != EVERYONE).select("cohort", F.col("term").alias("SNP"), F.col("n").alias("n1"), F.col("cases").alias("s1"))
    whole = state.where(F.col("term") == EVERYONE).select("cohort", F.col("n").alias("N"), F.col("cases").alias("s"))
    d = own.join(whole, "cohort").withColumns({"n0": F.col("N") - F.col("n1"), "s0": F.col("s") - F.col("s1")})
    over = lambda a, b: a / F.nullif(b, F.lit(0))
    n1, n0, s1, s0 = map(F.col, ("n1", "n0", "s1", "s0"))
    # Around each group's mean an outcome of 0 or 1 leaves s (n - s) / n, which is never negative.
    left = over(s1 * (n1 - s1), n1) + over(s0 * (n0 - s0), n0)
    free = F.when(F.col("N") > 2, F.col("N") - 2)
    d = d.select(
        "cohort", "SNP", n1.alias("CARRIERS"), F.col("N").cast("double").alias("N"), (n1 / F.col("N")).alias("FREQ"),
        (over(s1, n1) - over(s0, n0)).alias("BETA"), F.sqrt(over(left / free * F.col("N"), n1 * n0)).alias("SE"),
    )
    filters = {
        "NO NAN": (lambda df: F.col("BETA").isNull() | F.col("SE").isNull(), "words that all documents have, cohorts of one or two"),
        "FREQ BOUNDS": (quality.freq_bounds(*c["frequencies"]), "frequencies outside the bounds"),
        "SE BOUNDS": quality.filters()["SE BOUNDS"],
        "FEW CARRIERS": (lambda df: F.col("CARRIERS") < c["least_carriers"], "words of too few documents"),
    }
    return quality.run_filters(d, filters)


def tested(d: DataFrame) -> DataFrame:
    """d with Z and P from BETA and SE."""
    d = d.withColumn("Z", X.z_score(F.col("BETA"), F.col("SE")))
    return d.withColumn("lp", X.log10_p("Z")).withColumn("P", X.p_text(F.col("lp"))).drop("lp")


def pooled(d: DataFrame) -> DataFrame:
    """Each word over all cohorts, weighted by inverse variance, with Cochran's Q; sums in decimals don't hang on their order."""
    w = 1 / (F.col("SE") * F.col("SE"))
    total = lambda x: F.sum(x.cast("decimal(38,12)")).cast("double")
    g = d.groupBy("SNP").agg(F.count("*").alias("COHORTS"), total(F.col("N")).alias("N"), total(w).alias("w"), total(w * F.col("BETA")).alias("wb"), total(w * F.col("BETA") * F.col("BETA")).alias("wbb"))
    g = g.select("SNP", "COHORTS", "N", (F.col("wb") / F.col("w")).alias("BETA"), F.sqrt(1 / F.col("w")).alias("SE"), (F.col("wbb") - F.col("wb") * F.col("wb") / F.col("w")).alias("Q"))
    return tested(g).select("SNP", "COHORTS", "N", "BETA", "SE", "Z", "P", "Q")


def state_at(spark: SparkSession, out: str, batch: int) -> DataFrame | None:
    """The counts after a batch; none before the first."""
    d = table_at(spark, f"{out}/state/slot={batch % 2}", STATE) if batch >= 0 else None
    return None if d is None else d.where(F.col("batch") == batch)


def watched(path: str) -> str:
    """The path as a pattern that only it matches: a file stream takes a folder as it is, but a single file only by a pattern."""
    path = path.rstrip("/")
    return path if any(x in path for x in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, labels: str, out: str, checkpoint: str, given: dict | None = None) -> DataFrame:
    """Takes the documents' files that are new to the checkpoint, writes state, associations (by cohort), drops and pooled
    under out, and returns the associations as they stand there.

    Labels have to be there when their documents are taken: documents without one, or without an id, have no outcome, and are
    not looked at again. A document's repeated rows count as often as they stand. Null and empty cohorts make up one of the name `unnamed`.
    """
    c = DEFAULTS | (given or {})
    read = spark.readStream.schema(spark.read.parquet(documents).schema)
    if c["files_per_batch"]:
        read = read.option("maxFilesPerTrigger", c["files_per_batch"])

    def take(batch: DataFrame, number: int) -> None:
        new = counts(batch, batch.sparkSession.read.parquet(labels), c)
        before = state_at(batch.sparkSession, out, number - 1)
        both = new if before is None else before.select("cohort", "term", "n", "cases").union(new)
        after = both.groupBy("cohort", "term").agg(F.sum("n").alias("n"), F.sum("cases").alias("cases")).withColumn("batch", F.lit(number).cast("long"))
        after.write.mode("overwrite").parquet(f"{out}/state/slot={number % 2}")
        log.info("batch %d: wrote the state to %s/state/slot=%d", number, out, number % 2)

    query = read.parquet(watched(documents)).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows of %s in %d batches", sum(p.numInputRows for p in query.recentProgress), documents, sum(p.numInputRows > 0 for p in query.recentProgress))
    every = table_at(spark, f"{out}/state", f"{STATE}, slot int")
    if every is None:
        every = spark.createDataFrame([], f"{STATE}, slot int")
    last = every.agg(F.max("batch")).first()[0]
    checked = associations(every.where(F.col("batch") == F.lit(last)).drop("batch", "slot"), c)
    drops = written(checked.metrics().coalesce(1), f"{out}/drops", "filter string, dropped long")
    log.info("words by cohort that filters drop: %s", {r["filter"]: r["dropped"] for r in drops.collect()})
    names = [x.split()[0] for x in RESULT.split(", ")]
    # One writer a cohort and slice of words, so a large cohort isn't one task's.
    result = written(tested(checked.passed).select(*names).repartition("cohort", F.pmod(F.xxhash64("SNP"), F.lit(16))), f"{out}/associations", RESULT, ("cohort",))
    written(pooled(result), f"{out}/pooled", POOLED)
    return result


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.term_association", description="term-wide association by cohort, over documents that are new")
    for x in ("config", "documents", "labels", "out", "checkpoint"):
        p.add_argument(f"--{x}", required=True)
    a = p.parse_args(argv)
    log_to_console()
    c = config(a.config, DEFAULTS)
    spark = SparkSession.builder.appName("term association").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a.documents, a.labels, a.out, a.checkpoint, c)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
