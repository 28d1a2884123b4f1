"""Both ends of the engine by paths that only Spark opens, and the quality filters on a stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from xancestry.operators import quality
from xancestry.plans import ld, sinks
from xancestry.sources import text
from xancestry.streaming import quality as on_stream

SS = "SNP string, CHR string, BP long, A1 string, A2 string, FREQ double, BETA double, SE double, P double"


@pytest.fixture
def store(spark, tmp_path):
    """tmp_path by a path that open() doesn't reach."""
    top = f"/{tmp_path.parts[1]}"
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.cluster.link.{top}", f"file://{top}")
    return f"viewfs://cluster{tmp_path}"


def test_matrices_and_counts(spark, tmp_path, store):
    m = np.array([[0.1, 1 / 3], [-2.5e-7, 4.0]])
    sinks.write_coefficients(m, f"{store}/m.cf")
    assert (tmp_path / "m.cf").read_text() == "\t".join(map(repr, m.ravel().tolist())) and (text.matrix(f"{store}/m.cf", 2) == m).all()
    with pytest.raises(text.SourceError, match="4 numbers instead of 9"):
        text.matrix(f"{store}/m.cf", 3)
    counts = spark.createDataFrame([("EUR", "EUR", 7, 5), ("EAS", "EUR", 4, 3)], "anc1 string, anc2 string, m long, m_5_50 long")
    sinks.write_counts(counts, f"{store}/x")
    assert json.loads((tmp_path / "x.l2.M.json").read_text()) == {"EAS_EUR": 4, "EUR_EUR": 7}
    assert json.loads((tmp_path / "x.l2.M_5_50.json").read_text()) == {"EAS_EUR": 3, "EUR_EUR": 5}


def test_tables_in_and_out(spark, tmp_path, store):
    """A table is written as one sorted file, and read back by pattern."""
    d = spark.createDataFrame([("2", "rs2", 5, 0.25, None), ("10", "rs9", 1, 1.0, 3.0), ("10", "rs1", 1, float("1e-300"), 2.0)], "CHR string, SNP string, BP long, BETA double, N double")
    sinks.write_results(d, f"{store}/r.res")
    assert (tmp_path / "r.res").read_text() == "CHR\tSNP\tBP\tBETA\tN\n10\trs1\t1\t1.0E-300\t2.0\n10\trs9\t1\t1.0\t3.0\n2\trs2\t5\t0.25\tNaN\n"
    (found,) = text.expand(spark, f"{store}/*.res")
    back = text.scan(spark, found)
    assert back.columns == ["CHR", "SNP", "BP", "BETA", "N", "place"] and [r["SNP"] for r in back.orderBy("place").collect()] == ["rs1", "rs9", "rs2"]
    assert back.where("SNP = 'rs2'").first()["N"] is None
    with pytest.raises(text.SourceError, match="more than one column"):
        text.one_column(spark, f"{store}/r.res")


def test_every_person_has_an_ancestry(spark):
    people = spark.createDataFrame([(0, "a"), (1, "b")], "ind_idx long, IID string")
    of = lambda *rows: spark.createDataFrame(list(rows), "IID string, ancestry string")
    assert ld.checked(people, of(("a", "X"), ("b", "Y"), ("c", "Z"))).count() == 2
    with pytest.raises(ValueError, match="no ancestry for"):
        ld.checked(people, of(("a", "X")))


def test_filters_on_a_stream(spark, tmp_path):
    """Row by row the same as on a batch, over files that arrive in two runs."""
    rows = [("RS%d" % i, str(1 + i % 25), i, "acgt"[i % 4], "CTGA"[i % 3], None if i % 7 == 0 else (i % 10) / 10, 0.1 * i, 1.0 - i % 5, 0.5) for i in range(60)]
    names = {c: c for c in ("SNP", "CHR", "BP", "A1", "A2", "FREQ", "BETA", "SE", "P")}

    def go():
        q = on_stream.filtered(spark.readStream.schema(SS).parquet(f"{tmp_path}/in"), names=names).writeStream
        q.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
        return sorted(r["SNP"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, SS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = go()
    whole = on_stream.filtered(spark.createDataFrame(rows, SS), names=names)
    assert got == sorted(r["SNP"] for r in whole.collect()) and 0 < len(got) < 60
    only = on_stream.filtered(spark.createDataFrame(rows, SS), names=names, filters={"SE BOUNDS": quality.filters()["SE BOUNDS"]})
    assert only.count() == sum(r[7] > 0 for r in rows) and only.where(F.col("SE") <= 0).count() == 0
