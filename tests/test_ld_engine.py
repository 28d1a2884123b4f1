"""Numbers, windows and pairs of chunks on executors against loops; genotype files and the command line of LD scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from xancestry.operators import ldscore, numbering
from xancestry.sources import plink


def by_loops(x, reach, group=None):
    """(left, size) of each sorted coordinate by comparing distances one by one."""
    group = group or [0] * len(x)
    same = lambda i: [k for k in range(len(x)) if group[k] == group[i]]
    left = [next(k for k in same(i) if abs(x[k] - x[i]) <= reach) for i in range(len(x))]
    size = [sum(x[i] - reach < x[k] < x[i] + reach for k in same(i)) for i in range(len(x))]
    return list(zip(range(len(x)), left, size))


def frame(spark, x, group=None):
    rows = [(i, float(v), (group or ["1"] * len(x))[i]) for i, v in enumerate(x)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "idx long, x double, chr string").repartition(3)


@pytest.mark.parametrize(
    "x,reach",
    [
        ([1, 2, 4, 7, 7.5], 3), ([5, 5, 5, 5], 0), ([0, 1, 1, 2, 2, 2, 9], 1), ([3], 2), ([0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7], 0.1), ([1e9 + k / 3 for k in range(40)], 1 / 3),
        (sorted(random.Random(2).choice([0.1, 0.3, 1.7]) * k for k in range(150)), 2.1), ([float(k) for k in range(60)], 1e9), ([-3.5, -1, 0, 2], 2.5),
    ],
)
def test_bounds(spark, x, reach):
    assert sorted(map(tuple, numbering.bounds(frame(spark, x).select("idx", "x"), reach).collect())) == by_loops(x, reach)
    assert ldscore.block_lefts(x, reach).tolist() == [left for _, left, _ in by_loops(x, reach)]


def test_bounds_by_chromosome(spark):
    """Chromosomes stand in the order of the file, 2 before 10, and each begins anew."""
    x, group = [1, 2, 3, 1, 1, 5, 0, 2, 3], ["2"] * 3 + ["10"] * 3 + ["X"] * 3
    assert sorted(map(tuple, numbering.bounds(frame(spark, x, group), 1, "chr").collect())) == by_loops(x, 1, group)
    with pytest.raises(Exception, match="in order"):
        numbering.bounds(frame(spark, x).select("idx", "x"), 1).collect()
    with pytest.raises(Exception, match="in order"):
        numbering.bounds(frame(spark, [1, 2, 3, 4], ["1", "2", "1", "2"]), 1, "chr").collect()
    assert numbering.bounds(spark.createDataFrame([], "idx long, x double"), 1).count() == 0


def test_bounds_over_many_ranges(spark):
    """More partitions than coordinates of their own: ties cross no range, and empty ranges count for nothing."""
    x = sorted(random.Random(3).randrange(40) for _ in range(300))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = numbering.bounds(frame(spark, x).select("idx", "x"), 3)
        assert sorted(map(tuple, got.collect())) == by_loops(x, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("m,chunk,reach", [(30, 4, 6), (30, 8, 3), (64, 8, 10), (30, 50, 5), (30, 3, 100), (1, 8, 1), (17, 5, 0)])
def test_pairs_of_chunks(spark, m, chunk, reach):
    lefts = ldscore.block_lefts(np.arange(m), reach)
    want = ldscore.Windows.of(lefts, chunk)
    pairs, size, first = ldscore.chunk_pairs(spark.createDataFrame(list(enumerate(lefts.tolist())), "idx long, left long"), chunk)
    assert (size, first) == (want.chunk, want.first) and pairs.dtypes == [("i", "int"), ("k", "int")]
    assert sorted(map(tuple, pairs.collect())) == sorted(want.chunk_pairs())


def test_dense_numbers(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(1000)] + [(1000, None)]
    d = spark.createDataFrame(rows, "id int, x int").repartition(5)
    got = numbering.dense(d, [F.floor(F.col("x") / 64)], [F.col("x"), F.col("id")], "n")
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)))}
    assert {r["id"]: r["n"] for r in got.collect()} == want and got.columns == ["id", "x", "n"]


def test_variants_of_a_split_file(spark, tmp_path):
    """Many blocks of one file, with comments and blank lines between."""
    lines = [f"1\trs{i}\t0\t{i}\tA\tG" + ("\n\n# note" if i % 97 == 0 else "") for i in range(2000)]
    (tmp_path / "x.bim").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        d = plink.bim(spark, str(tmp_path / "x.bim"))
        assert {r["SNP"]: r["snp_idx"] for r in d.collect()} == {f"rs{i}": i for i in range(2000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("exponent,symmetric", [(0.0, False), (0.5, False), (0.5, True)])
def test_tiles_of_people_add_up(spark, exponent, symmetric):
    """Whatever the tiles, the scores are those of all people at once; a variant that nobody was called for counts as nothing."""
    rng = np.random.default_rng(5)
    g = rng.integers(0, 3, (26, 33)).astype(float)
    g[rng.random(g.shape) < 0.05] = np.nan
    g[4], g[9], g[11] = np.nan, 1, 0
    a, b = np.arange(33) % 3 == 0, (np.arange(33) % 3 == 1) & (np.arange(33) > 4)
    geno = spark.createDataFrame([(i, [None if np.isnan(x) else int(x) for x in r]) for i, r in enumerate(g)], "idx long, dosage array<int>")
    lefts = ldscore.block_lefts(np.arange(26), 5)
    for x, y in ((a, b), (a, a)):
        how = [{r["idx"]: r["l2"] for r in ldscore.pair_scores(geno, x, y, lefts, 4, exponent=exponent, symmetric=symmetric, tile=t).collect()} for t in (8192, 10, 7)]
        assert how[0].keys() == set(range(26)) and all(np.isclose(how[0][i], h[i], atol=1e-9) for h in how[1:] for i in range(26))
        assert how[0][4] == 0


CODE = {0: 0, -1: 1, 1: 2, 2: 3}


def fileset(folder, g, name="x"):
    """A genotype fileset of dosages [variant, person], -1 missing; a chromosome, 100 bases apart."""
    packed = b"".join(bytes(sum(CODE[int(x)] << (2 * k) for k, x in enumerate(r[i : i + 4])) for i in range(0, len(r), 4)) for r in g)
    (folder / f"{name}.bed").write_bytes(plink.MAGIC + plink.BY_VARIANT + packed)
    (folder / f"{name}.bim").write_text("".join(f"22\trs{i}\t{i / 10}\t{100 * i}\tA\tG\n" for i in range(len(g))))
    (folder / f"{name}.fam").write_text("".join(f"f p{i} 0 0 0 -9\n" for i in range(len(g[0]))))
    return folder / name


@pytest.mark.parametrize("way", ["{}", "file://{}", "viewfs://cluster{}"])
def test_packed_genotypes(spark, tmp_path, way, monkeypatch):
    """In ranges, of some people and variants, by paths that Arrow opens and one that only Spark does."""
    g = np.random.default_rng(1).integers(-1, 3, (57, 23))
    at = f"{fileset(tmp_path, g)}.bed"
    top = f"/{tmp_path.parts[1]}"
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.cluster.link.{top}", f"file://{top}")
    monkeypatch.setattr(plink, "BATCH", 100)
    path = way.format(at)
    assert plink.arrow_opens(path) == (not path.startswith("viewfs"))
    seen = lambda d: {r["snp_idx"]: [-1 if x is None else x for x in r["dosage"]] for r in d.collect()}
    assert seen(plink.bed(spark, path, 23, 57)) == dict(enumerate(g.tolist()))
    some = plink.bed(spark, path, 23, 57, kept=[2, 3, 19], first=10, last=30)
    assert seen(some) == {i: g[i, [2, 3, 19]].tolist() for i in range(10, 30)}
    for people, variants in ((27, 57), (23, 58)):
        with pytest.raises(Exception, match="length"):
            plink.bed(spark, path, people, variants).collect()


def test_many_ranges(spark, tmp_path):
    g = np.random.default_rng(2).integers(-1, 3, (500, 5))
    spark.dataSource.register(plink.PackedGenotypes)
    at = f"{fileset(tmp_path, g)}.bed"
    read = lambda: spark.read.format("packed_genotypes").option("path", at).option("people", 5).option("variants", 500).option("step", 7).load()
    d = read()
    assert d.rdd.getNumPartitions() == 72 and d.count() == 500
    (tmp_path / "x.bed").write_bytes(b"no genotypes")
    with pytest.raises(Exception, match="packed genotype"):
        read().collect()


def test_command_line_of_ld_scores(spark, tmp_path):
    """Files in, files out: kept people, extracted and printed variants, a warning for what doesn't vary, and lists that match nothing."""
    import gzip
    import json

    from xancestry import cli

    rng = np.random.default_rng(4)
    g = rng.integers(0, 3, (40, 30))
    g[rng.random(g.shape) < 0.02] = -1
    g[7, ::2] = 1  # kept, though one ancestry doesn't vary
    merged = fileset(tmp_path, g)
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    ances = put("iid", "".join(f"p{i} {'EUR' if i % 2 else 'EAS'}\n" for i in range(30)))
    snps = put("snps", "SNP EAS EUR\n" + "".join(f"rs{i} 1 {int(i != 3)}\n" for i in range(40)))
    keep, extract = put("keep", "".join(f"p{i}\n" for i in range(24))), put("extract", "".join(f"rs{i}\n" for i in range(35)))
    shown = put("print", "".join(f"rs{i}\n" for i in range(0, 40, 2)))
    base = ["ldscores", "--bfile-merged-path", str(merged), "--ances-path", ances, "--snp-ances", snps, "--ld-wind-kb", "0.5", "--chunk-size", "8", "--std-geno-ldsc"]
    assert cli.main([*base, "--out", str(tmp_path / "all")]) == 0
    assert cli.main([*base, "--out", str(tmp_path / "some"), "--ld-keep", keep, "--ld-extract", extract, "--print-snps", shown]) == 0

    def table(name):
        lines = gzip.open(tmp_path / f"{name}.l2.ldscore.gz", "rt").read().splitlines()
        head = lines[0].split("\t")
        return head, {x.split("\t")[1]: dict(zip(head, x.split("\t"))) for x in lines[1:]}

    head, rows = table("some")
    assert head == ["CHR", "SNP", "BP", "EAS_EUR", "EAS_EAS", "EUR_EUR"] and list(rows) == [f"rs{i}" for i in range(0, 35, 2)]
    # By hand: the kept people, and the variants that both ancestries have, numbered anew.
    own = g[:, :24].astype(float)
    own[own < 0] = np.nan
    eur = np.arange(24) % 2 == 1
    have = [i for i in range(35) if i != 3]
    full = np.where(np.isnan(own), np.nanmean(own, 1, keepdims=True), own)
    r = [np.corrcoef(full[have][:, m]) for m in (~eur, eur)] if (full[have][:, eur].std(1) > 0).all() else None
    lefts = ldscore.block_lefts([100 * i for i in have], 500)
    win = ldscore.Windows.of(lefts, 8)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = r or [np.corrcoef(full[have][:, m]) for m in (~eur, eur)]
    for at, i in enumerate(have):
        if i % 2 == 0:
            want = np.nansum([r[0][at, k] * r[1][at, k] for k in range(len(have)) if k == at or win.included(min(at, k), max(at, k))])
            got = rows[f"rs{i}"]["EAS_EUR"]
            assert (got == "NA" and want == 0) or float(got) == pytest.approx(want, abs=2e-9)
    m = json.loads((tmp_path / "some.l2.M.json").read_text())
    assert m["EAS_EUR"] == 34 and m["EAS_EAS"] == 34  # rs3 has one source; of rs7 all of one ancestry are heterozygous
    assert len(table("all")[1]) == 40 and "ldscores" in (tmp_path / "all.log").read_text()
    assert "LD score of zero" in (tmp_path / "all.log").read_text()  # EUR has no rs3
    for flag, name, text, said in (("--ld-keep", "nobody", "nobody\n", "nothing matches"), ("--ld-extract", "none", "none\n", "nothing matches"), ("--print-snps", "two", "rs1 rs2\n", "more than one column")):
        assert cli.main([*base, "--out", str(tmp_path / name), flag, put(f"{name}.txt", text)]) == 1
        assert said in (tmp_path / f"{name}.log").read_text()


def test_people_go_before_their_calls_are_put_together(spark, tmp_path):
    """Calls of some ancestries are those of their people among all, and no plan lists people one by one."""
    from xancestry.plans import synth

    rng = np.random.default_rng(3)
    sizes = {}
    for n in (40, 400):
        rows = [(3 * i, i % 5, [float(x) for x in rng.normal(0, 0.1, 6)]) for i in range(n)]
        spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        _, people, every = synth.genotypes(spark, f"{tmp_path}/{n}")
        _, some, geno = synth.genotypes(spark, f"{tmp_path}/{n}", ["A1", "A3"])
        places = [k for k, r in enumerate(people.orderBy("ind_idx").collect()) if r["ancestry"] in ("A1", "A3")]
        whole = {r["snp_idx"]: r["dosage"] for r in every.collect()}
        assert {r["snp_idx"]: r["dosage"] for r in geno.collect()} == {i: [d[k] for k in places] for i, d in whole.items()} and some.count() == len(places)
        sizes[n] = len(geno._jdf.queryExecution().analyzed().toString())
    assert abs(sizes[400] - sizes[40]) < 50


def test_scores_of_many_pairs_at_once(spark):
    """Each pair of ancestries as by itself, though their variants, numbers and chunks differ; the plan doesn't grow with the pairs."""
    rng = np.random.default_rng(6)
    g = rng.integers(0, 3, (23, 45)).astype(float)
    g[rng.random(g.shape) < 0.04] = np.nan
    of = np.arange(45) % 3
    dosages = [[None if np.isnan(x) else int(x) for x in r] for r in g]
    have = {p: [i for i in range(23) if i % (p + 2) or p > 3] for p in range(6)}
    people = {p: (of == a, of == b) for p, (a, b) in enumerate([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)])}
    lefts = {p: ldscore.block_lefts(np.arange(len(x)), 3 + 9 * p) for p, x in have.items()}
    assert len({ldscore._chunking(len(x), next((i for i, k in enumerate(x) if k), None), 4) for x in lefts.values()}) > 2
    geno = spark.createDataFrame([([(p, x.index(i)) for p, x in have.items() if i in x], d) for i, d in enumerate(dosages)], "at array<struct<pair:int,idx:long>>, dosage array<int>")
    near = spark.createDataFrame([(p, i, int(k)) for p, x in lefts.items() for i, k in enumerate(x)], "pair int, idx long, left long")
    nodes = lambda d: d._jdf.queryExecution().analyzed().toString().count("MapInArrow")
    for tile in (8192, 7):
        got = ldscore.scores(geno, people, near, 4, tile=tile)
        assert nodes(got) == nodes(ldscore.scores(geno, people, near.where("pair = 1"), 4, tile=tile))
        got = {(r["pair"], r["idx"]): r["l2"] for r in got.collect()}
        for p, x in have.items():
            one = spark.createDataFrame([(k, dosages[i]) for k, i in enumerate(x)], "idx long, dosage array<int>")
            want = {(p, r["idx"]): r["l2"] for r in ldscore.pair_scores(one, *people[p], lefts[p], 4, tile=tile).collect()}
            assert want == {k: v for k, v in got.items() if k[0] == p} and len(want) == len(x)
