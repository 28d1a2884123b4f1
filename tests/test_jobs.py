"""The jobs over growing input, over repeated batches and runs, and against plain Python."""

import json
import math
import os
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import release, term_association
from jobs.common import config

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string"
JOBS = os.path.dirname(os.path.abspath(release.__file__))
LENIENT = {"least_carriers": 2, "frequencies": [0.05, 0.95]}


def fitted(docs, labels, c):
    """{(cohort, word): (carriers, n, freq, beta, se)} by sums of squares over the documents themselves."""
    y_of = {}
    for d, y in labels:
        y_of[d] = min(y, y_of.get(d, y))
    people = defaultdict(list)
    for d, text, source in docs:
        if d is not None and y_of.get(d) in (0, 1):
            people[source or "unnamed"].append((set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))), y_of[d]))
    out = {}
    for cohort, rows in people.items():
        n = len(rows)
        for word in set().union(*(w for w, _ in rows)):
            x, y = [float(word in w) for w, _ in rows], [float(v) for _, v in rows]
            mx, my = sum(x) / n, sum(y) / n
            sxx = sum((a - mx) ** 2 for a in x)
            if sxx == 0 or n <= 2 or not c["frequencies"][0] <= mx <= c["frequencies"][1] or sum(x) < c["least_carriers"]:
                continue
            beta = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sxx
            rss = sum((b - my - beta * (a - mx)) ** 2 for a, b in zip(x, y))
            if rss > 1e-9:
                out[cohort, word] = (int(sum(x)), float(n), mx, beta, math.sqrt(rss / (n - 2) / sxx))
    return out


def same(result, want):
    got = {(r["cohort"], r["SNP"]): (r["CARRIERS"], r["N"], r["FREQ"], r["BETA"], r["SE"]) for r in result.collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, rel=1e-9, abs=1e-12), k


@pytest.fixture(scope="module")
def notes(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string"))).orderBy("doc_id").limit(90).collect()]
    docs += [(1001, None, "c0"), (1002, "", "c0"), (1003, "Only Here É", None), (1004, "only there", ""), (1005, "only X", None), (1006, "both only", ""), (None, "no id", "c1"), docs[0], (1007, "unlabelled words", "c2")]
    labels = [(r[0], (r[0] * 7 + 3) % 2 if r[0] % 11 else 5) for r in docs if r[0] is not None and r[0] != 1007] + [(docs[1][0], 9), (None, 1)]
    return docs, labels


def test_growing_documents(spark, notes, tmp_path):
    docs, labels = notes
    c = term_association.DEFAULTS | LENIENT
    put = lambda rows, kind, to, **how: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{to}")
    put(labels, "doc_id long, quality int", "labels")
    go = lambda: term_association.run(spark, f"{tmp_path}/documents", f"{tmp_path}/labels", f"{tmp_path}/out", f"{tmp_path}/checkpoint", c)
    state = lambda: spark.read.parquet(f"{tmp_path}/out/state")
    put(docs[:40], DOC, "documents")
    same(go(), fitted(docs[:40], labels, c))
    put(docs[40:70], DOC, "documents")
    put(docs[70:], DOC, "documents")
    first = go()
    want = fitted(docs, labels, c)
    same(first, want)
    assert len(want) > 50 and any(k[0] == "unnamed" for k in fitted(docs, labels, c | {"frequencies": [0, 1], "least_carriers": 1}))
    # The second run took the new files alone: its batch is the second, and the first one's counts stand where it read them.
    assert state().agg(F.max("batch")).first()[0] == 1
    n = lambda b: state().where(f"batch = {b} and term = ''").agg(F.sum("n")).first()[0]
    labelled = {d for d, y in labels if d is not None and y in (0, 1)}
    assert (n(0), n(1)) == (sum(d[0] in labelled for d in docs[:40]), sum(d[0] in labelled for d in docs))
    # Nothing new: the same result. A batch whose commit was lost is done again: the same result.
    before = sorted(map(tuple, first.collect()))
    assert sorted(map(tuple, go().collect())) == before
    for name in ("1", ".1.crc"):
        if os.path.exists(f"{tmp_path}/checkpoint/commits/{name}"):
            os.remove(f"{tmp_path}/checkpoint/commits/{name}")
    assert sorted(map(tuple, go().collect())) == before and state().agg(F.max("batch")).first()[0] == 1
    assert sorted(x for x in os.listdir(tmp_path / "out/associations") if "=" in x) == sorted({f"cohort={k[0]}" for k in want})
    # Pooled by hand.
    by = defaultdict(list)
    for (_, word), (_, size, _, b, se) in want.items():
        by[word].append((size, b, 1 / se**2))
    for r in spark.read.parquet(f"{tmp_path}/out/pooled").collect():
        rows = by.pop(r["SNP"])
        w = sum(x[2] for x in rows)
        b = sum(x[1] * x[2] for x in rows) / w
        assert (r["COHORTS"], r["N"]) == (len(rows), sum(x[0] for x in rows)) and (r["BETA"], r["SE"]) == pytest.approx((b, w**-0.5), abs=1e-8)
        assert r["Q"] == pytest.approx(sum(x[2] * (x[1] - b) ** 2 for x in rows), abs=1e-6)
    assert not by
    drops = {r["filter"]: r["dropped"] for r in spark.read.parquet(f"{tmp_path}/out/drops").collect()}
    assert drops["TOTAL"] - drops["ANY"] == len(want)


def test_files_per_batch_and_one_file(spark, notes, tmp_path):
    docs, labels = notes
    spark.createDataFrame(labels, "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels")
    c = term_association.DEFAULTS | LENIENT
    for part in (docs[:30], docs[30:60], docs[60:]):
        spark.createDataFrame(part, DOC).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents")
    out = term_association.run(spark, f"{tmp_path}/documents", f"{tmp_path}/labels", f"{tmp_path}/a", f"{tmp_path}/ca", c | {"files_per_batch": 1})
    same(out, fitted(docs, labels, c))
    assert spark.read.parquet(f"{tmp_path}/a/state").agg(F.max("batch")).first()[0] == 2
    one = next(x for x in os.listdir(tmp_path / "documents") if x.endswith(".parquet"))
    alone = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/documents/{one}").collect()]
    same(term_association.run(spark, f"{tmp_path}/documents/{one}", f"{tmp_path}/labels", f"{tmp_path}/b", f"{tmp_path}/cb", c), fitted(alone, labels, c))


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels")
    for _ in range(2):
        assert term_association.run(spark, f"{tmp_path}/documents", f"{tmp_path}/labels", f"{tmp_path}/out", f"{tmp_path}/checkpoint").count() == 0


def test_releases(spark, tmp_path):
    c = config(f"{JOBS}/release.json", release.DEFAULTS)
    out = release.run_tables(spark, SF, f"{tmp_path}/out", c)
    rows = sorted(map(tuple, out.collect()))
    assert rows and {r["population"] for r in out.select("population").distinct().collect()} == {"R0_T", "R1_T"}
    assert {x for x in os.listdir(tmp_path / "out/results/release=current") if "=" in x} == {"population=R0_T", "population=R1_T"}
    assert sorted(map(tuple, release.run_tables(spark, SF, f"{tmp_path}/out", c).collect())) == rows
    # Another release beside it, of some chromosomes; made again with fewer, what isn't in it any more goes.
    for chromosomes in (["1", "2", "3"], ["2"]):
        both = release.run_tables(spark, SF, f"{tmp_path}/out", c | {"release": "some", "chromosomes": chromosomes})
    assert {r["CHR"] for r in both.where("release = 'some'").select("CHR").distinct().collect()} == {"2"}
    assert sorted(map(tuple, both.where("release = 'current'").collect())) == rows
    figures = {r["population"]: r for r in spark.read.parquet(f"{tmp_path}/out/figures/release=current").collect()}
    z = [r["Z"] ** 2 for r in both.where("release = 'current' and population = 'R1_T'").select("Z").collect()]
    assert figures["R1_T"]["variants_out"] == len(z) and figures["R1_T"]["mean_chi_sq_out"] == pytest.approx(sum(z) / len(z))
    drops = {(r["population"], r["filter"]): r["dropped"] for r in spark.read.parquet(f"{tmp_path}/out/drops/release=some").collect()}
    assert drops["R0_T", "CHR VALUES"] > 0 and drops["R0_T", "TOTAL"] >= drops["R0_T", "ANY"] >= drops["R0_T", "CHR VALUES"]
    coefs = spark.read.parquet(f"{tmp_path}/out/coefficients/release=current").where("kind = 'ld' and i = 0 and j = 0").collect()
    assert [r["value"] for r in coefs] == [c["ld"][0][0]]


def test_fitted_coefficients(spark, tmp_path):
    """Without given matrices the regressions fit them; one population needs no others."""
    out = release.run_tables(spark, SF, f"{tmp_path}/out", {"populations": 1})
    assert out.schema["CHR"].dataType.simpleString() == "string" and out.where("population <> 'R0_T'").count() == 0
    assert spark.read.parquet(f"{tmp_path}/out/coefficients/release=current").count() == 3


def test_configurations(tmp_path):
    for name, job in (("term_association", term_association), ("release", release)):
        assert config(f"{JOBS}/{name}.json", job.DEFAULTS).keys() == job.DEFAULTS.keys()
    (tmp_path / "x.json").write_text(json.dumps({"nonsense": 1}))
    with pytest.raises(ValueError, match="nonsense"):
        config(str(tmp_path / "x.json"), release.DEFAULTS)


def test_a_release_runs_the_estimator_once(spark):
    """The estimator's rows are kept, so tables and figures read them; figures are those of the tables, and nothing stays kept."""
    from xancestry.plans import meta

    pops, ld = release.sources(spark, "/root/testdata/sf0.001", 2)
    names = {x: x for x in ("SNP", "CHR", "BP", "A1", "A2", "FREQ", "BETA", "SE", "P", "N")}
    c = config(f"{os.path.dirname(release.__file__)}/release.json", release.DEFAULTS)
    r = meta.run(spark, pops, [ld], column_maps=dict.fromkeys(pops, names), ld_option=np.array(c["ld"]), const_option=np.array(c["intercept"]), se2_option=np.array(c["se2"]))
    assert all(d.storageLevel.useMemory for d in r.held)
    for t in r.tables.values():
        # What stands behind kept rows is printed after them.
        above, *behind = t._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")
        assert behind and "MapInArrow" not in above and "Join" not in above
    got = {x["population"]: x for x in release.figures(r).collect()}
    for i, (pop, t) in enumerate(r.tables.items()):
        z = [x["Z"] for x in t.collect()]
        own = [(x["b"] / x["s"]) ** 2 for x in r.harmonised.select(F.col(f"p{i}.BETA").alias("b"), F.col(f"p{i}.SE").alias("s")).collect()]
        f = got["_".join(pop)]
        assert (f["variants_in"], f["variants_out"]) == (len(own), len(z)) and len(z) > 10
        assert f["mean_chi_sq_out"] == pytest.approx(sum(x * x for x in z) / len(z)) and f["mean_chi_sq_in"] == pytest.approx(sum(own) / len(own))
    r.release()
    assert not any(d.storageLevel.useMemory for d in r.held)
