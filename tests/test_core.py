"""The engine's operators on small inputs with known results."""

import itertools

import numpy as np
import pandas as pd
import pytest

from xancestry.functions import expressions as X
from xancestry.operators import columns, gls, harmonise, ldscore, quality, regression
from xancestry.plans import ld, meta, sinks
from xancestry.schema import PATTERNS, REQUIRED
from xancestry.sources import plink, text


def test_column_mapping():
    names = ["_a2_", "_a1_", "_se_", "_freq_", "_beta_", "_chr_", "_snp_", "_bp_", "p", "other"]
    got = columns.map_columns(names, PATTERNS, REQUIRED)
    assert got == {"_a2_": "A2", "_a1_": "A1", "_se_": "SE", "_freq_": "FREQ", "_beta_": "BETA", "_chr_": "CHR", "_snp_": "SNP", "_bp_": "BP", "p": "P"}
    for bad in (names[:-2], [*names, "_bp2_bp_"], ["snp_pos", *names]):
        with pytest.raises(columns.MappingError):
            columns.map_columns(bad, PATTERNS, REQUIRED)
    assert columns.patterns(add={"SE": "err"})["SE"].endswith("|err")
    with pytest.raises(columns.MappingError):
        columns.patterns(replace={"SE": "("})


def test_scan_comments_nulls_and_order(spark, tmp_path):
    p = tmp_path / "s.txt"
    p.write_text("# first\nSNP\tCHR\tBP\tA1\tA2\tFREQ\tBETA\tSE\tP\n\nRS1\t1\t10\ta\tg\t0.2\t1.5\t0.1\t0.5 # note\nrs1\t1\t11\tA\tG\tn/a\t1\t0.1\t0.5\nrs2\t2\t12\tA\tC\t0.3\t1e-3\t0.1\t.5\n")
    d = columns.standardise(text.obtain(spark, str(p)))
    rows = d.orderBy("place").collect()
    assert [(r["SNP"], r["A1"], r["FREQ"], r["BP"]) for r in rows] == [("rs1", "A", 0.2, 10), ("rs1", "A", None, 11), ("rs2", "A", 0.3, 12)]
    with pytest.raises(text.SourceError):
        text.obtain(spark, 5)
    with pytest.raises(text.SourceError):
        text.expand(spark, str(tmp_path / "none*"))
    p.write_text("SNP,CHR,BP,A1,A2,FREQ,BETA,SE,P\nrs1,1,10,A,G,0.2,bad,0.1,0.5\n")
    with pytest.raises(Exception, match="no number"):
        columns.standardise(text.obtain(spark, str(p))).collect()


def rows(spark, **cols):
    base = {"SNP": "rs1", "CHR": "1", "BP": 1, "A1": "A", "A2": "G", "FREQ": 0.5, "BETA": 1.0, "SE": 1.0, "P": 0.5}
    n = max(map(len, cols.values()))
    kind = "SNP string, CHR string, BP long, A1 string, A2 string, FREQ double, BETA double, SE double, P double, place int"
    return spark.createDataFrame([tuple(cols.get(c, [base[c]] * n)[i] for c in base) + (i,) for i in range(n)], kind)


@pytest.mark.parametrize(
    "name,col,values,dropped",
    [
        ("NO NAN", "BETA", [None, 1.0], 1),
        ("FREQ BOUNDS", "FREQ", [0.0099, 0.01, 0.99, 0.9901, None], 3),
        ("SE BOUNDS", "SE", [-1.0, 0.0, 0.1, None], 2),
        ("CHR VALUES", "CHR", ["1", "22", "X", "Y", "0", "23", "Z", None], 4),
        ("DUPLICATE ALLELE SNPS", "A2", ["A", "G", None], 1),
        ("PALINDROMIC SNPS", "A2", ["T", "G", "TT", None], 1),
        ("INVALID ALLELES", "A1", ["A", "AC", "N", None], 3),
        ("NEGATIVE GWAS P", "P", [-0.1, 0.0, 1.5, None], 1),
    ],
)
def test_filters(spark, name, col, values, dropped):
    got = quality.run_filters(rows(spark, **{col: values}), {name: quality.filters()[name]})
    assert {r["filter"]: r["dropped"] for r in got.metrics().collect()} == {name: dropped, "ANY": dropped, "TOTAL": len(values)}
    assert got.passed.count() == len(values) - dropped


def test_registry_and_optional_filters(spark):
    from pyspark.sql import functions as F

    d = rows(spark, SNP=["a", "a", "b", "a"], BP=[5, 6, 7, 8], SE=[0.0, 1.0, 1.0, 1.0])
    out = quality.qc_sumstats(d, optional={"INFO": (lambda df: F.col("INFO") < 0.5, "low")})
    assert sorted((r["SNP"], r["BP"]) for r in out.passed.collect()) == [("a", 6), ("b", 7)]
    assert out.flags["INFO"] is None and out.duplicates.count() == 1
    with pytest.raises(Exception):
        quality.run_filters(d, {"INFO": (lambda df: F.col("INFO") < 0.5, "low")})
    with pytest.raises(ValueError):
        quality.filters(freq=(0.9, 0.1))
    assert "PALINDROMIC SNPS" not in quality.filters(palindromic=True)
    assert quality.run_filters(d, {"CHR VALUES": (quality.chr_values([]), "")}).passed.count() == 0


def test_alleles(spark):
    cases = {"rs1": ("A", "G", True), "rs2": ("T", "C", True), "rs3": ("G", "A", True), "rs4": ("C", "T", True), "rs5": ("A", "C", False)}
    one = rows(spark, SNP=list(cases))
    two = rows(spark, SNP=list(cases), A1=[c[0] for c in cases.values()], A2=[c[1] for c in cases.values()], FREQ=[0.2] * 5)
    h, _ = harmonise.harmonise([one, two])
    got = {r["SNP"]: (r["p1"]["FREQ"], r["p1"]["BETA"], r["p1"]["A1"]) for r in h.collect()}
    assert got == {"rs1": (0.2, 1.0, "A"), "rs2": (0.2, 1.0, "T"), "rs3": (0.8, -1.0, "A"), "rs4": (0.8, -1.0, "T")}


def test_regression():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1000, 3))
    assert np.allclose(regression.run_regression(x @ [1, 2, 3], x), [1, 2, 3])
    assert np.allclose(regression.run_regression(x @ [1, 2, 3], x, [np.nan, 2, np.nan], np.abs(x[:, 0])), [1, 2, 3])
    assert np.allclose(regression.run_regression([2.0, 2.0], [[1.0, 1.0], [1.0, 1.0]]), [1, 1]), "least norm"
    with pytest.raises(ValueError):
        regression.run_regression([1.0], [[1.0]], weights=[-1.0])
    for bad in ("other", 5, np.eye(3)):
        with pytest.raises(ValueError):
            regression.constraint(2, bad)


def tweaked_by_hand(m):
    d = np.diag(m).copy()
    out = np.minimum(m, np.outer(np.sqrt(d), np.sqrt(d)))
    np.fill_diagonal(out, d)
    while (np.linalg.eigvalsh(out) < 0).any():
        out = out * 0.99
        np.fill_diagonal(out, d)
    return out


@pytest.mark.parametrize("n_", [1, 2, 3, 5])
def test_matrices_in_batches(n_):
    """One by one and all together come to the same, clamped from above, shrunk from below, or neither; factors are told as the library tells them."""
    rng = np.random.default_rng(n_)
    m = rng.normal(size=(400, n_, n_)) * 2
    m = m + m.transpose(0, 2, 1)
    m[:, np.arange(n_), np.arange(n_)] = np.abs(m[:, np.arange(n_), np.arange(n_)])
    m[::50, 0, 0], m[3::50] = -1.0, 3 * np.eye(n_)
    before = m.copy()
    got, ok, tweaked = gls.check_omega(m)
    assert (m == before).all()
    for i, x in enumerate(m):
        fine, positive = (np.linalg.eigvalsh(x) >= 0).all(), (np.diag(x) > 0).all()
        assert (ok[i], tweaked[i]) == (fine or positive, positive and not fine)
        assert (got[i] == (tweaked_by_hand(x) if tweaked[i] else x)).all()
    if n_ > 1:
        assert tweaked.any() and (~ok).any() and any((x != y).any() and (np.abs(x) <= np.abs(y)).all() for x, y in zip(got, m))
    low = rng.normal(size=(300, n_, n_))
    si = low @ low.transpose(0, 2, 1)
    si[::3] -= np.eye(n_) * 0.3
    si[1::7, 0, :] = si[1::7, :, 0] = 0  # on the edge
    si[2::11] = np.nan
    edge = np.ones((1, n_, n_))
    si = np.concatenate([si, edge, edge * 1e-200, np.zeros_like(edge), np.full_like(edge, np.inf)])
    assert gls.check_sigma(si).tolist() == [gls._has_factor(x) for x in si]
    assert gls.check_sigma(si[:0]).tolist() == [] and gls.check_omega(m[:0])[0].shape == (0, n_, n_)


def test_tweaked_estimates_by_hand(spark):
    """The query of five populations whose matrices have to be tweaked, row by row."""
    from xancestry import queries as Q

    sf, n = "/root/testdata/sf0.001", 5
    coef, se2, const = 0.01 + 0.01 * np.eye(n), Q.SE2_5, Q.CONST5
    want, changed = {}, 0
    for r in Q._collated(spark, sf, n).select("SNP", "beta", "se", "ld").collect():
        om, se, b = np.array(r["ld"]).reshape(n, n) * coef, np.array(r["se"]), np.array(r["beta"])
        si = np.outer(se, se) * se2 + const
        if (np.linalg.eigvalsh(om) < 0).any():
            om, changed = tweaked_by_hand(om), changed + 1
        for p in range(n):
            w = om[:, p] / om[p, p]
            c = np.linalg.inv(om - np.outer(om[:, p], om[p]) / om[p, p] + si)
            want[r["SNP"], p] = (w @ c @ b / (w @ c @ w), (w @ c @ w) ** -0.5)
    got = Q.gls_p5_tweaked(spark, sf).collect()
    assert changed >= 3 and len(got) * n == len(want)
    for r in got:
        for p in range(n):
            assert (r[f"beta{p}"], r[f"se{p}"]) == pytest.approx(want[r["SNP"], p], abs=2e-6)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_distributed_regression_equals_direct(spark, n):
    rng = np.random.default_rng(n)
    m = 400
    beta, se, scores = rng.normal(size=(m, n)), rng.uniform(0.5, 2, (m, n)), rng.uniform(-1, 5, (m, n, n))
    scores = scores + scores.transpose(0, 2, 1)
    d = spark.createDataFrame([(b.tolist(), s.tolist(), x.ravel().tolist()) for b, s, x in zip(beta, se, scores)], "beta array<double>, se array<double>, ld array<double>").repartition(5)
    for options in ({}, {"se2": regression.OFF_ZERO}, {"const": regression.ZERO, "se2": regression.IDENTITY}, {"ld": regression.SET_CORR, "correlation": 0.3}):
        got = regression.ldscore_regressions(d, n, **options)
        fixed = [regression.constraint(n, options.get(k, regression.FREE)) for k in ("ld", "const", "se2")]
        for p, q in [*((i, i) for i in range(n)), *itertools.combinations(range(n), 2)]:
            x = scores[:, p, q]
            w = np.where(x > 0, 1 / x, 0) if p == q else np.abs(1 / x)
            f = np.array([k[p, q] for k in fixed])
            if options.get("ld") == regression.SET_CORR and p != q:
                with np.errstate(invalid="ignore"):
                    f[0] = 0.3 * np.sqrt(got[0][p, p] * got[0][q, q])
            want = regression.run_regression(beta[:, p] * beta[:, q], np.column_stack((x, np.ones(m), se[:, p] * se[:, q])), f, w)
            assert np.allclose([k[p, q] for k in got], want) and np.allclose([k[q, p] for k in got], want)


def test_matrices():
    m, ok, tweaked = gls.check_omega(np.array([[[2.0, 1], [1, 2]], [[1.0, 3], [3, 1]], [[1.0, -3], [-3, 1]], [[-1.0, 0], [0, 1]]]))
    assert ok.tolist() == [True, True, True, False] and tweaked.tolist() == [False, True, True, False]
    assert all((np.linalg.eigvalsh(x) >= 0).all() for x in m[:3]) and m[2][0, 1] < 0
    assert gls.check_sigma(np.array([[[1.0, 0], [0, 1]], [[1.0, 2], [2, 1]]])).tolist() == [True, False]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_estimator_by_definition(n):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(2, 50, n, n))
    om, si = a @ a.transpose(0, 2, 1), b @ b.transpose(0, 2, 1) + np.eye(n)
    beta = rng.normal(size=(50, n))
    got, se = gls.estimate(beta, om, si)
    for j in range(50):
        for p in range(n):
            w = om[j][:, p] / om[j][p, p]
            c = np.linalg.inv(om[j] - np.outer(om[j][:, p], om[j][:, p]) / om[j][p, p] + si[j])
            assert np.isclose(got[j, p], w @ c @ beta[j] / (w @ c @ w)) and np.isclose(se[j, p], (w @ c @ w) ** -0.5)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_estimator_rounds_as_its_sql(n):
    """To the last bit: an effect that ends in a half of the last digit shown is rounded to the same side."""
    import duckdb

    from xancestry.queries import _eliminated

    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(2, 300, n, n))
    om, si, beta = a @ a.transpose(0, 2, 1), b @ b.transpose(0, 2, 1) + np.eye(n), rng.normal(size=(300, n))
    x = pd.DataFrame({"SNP": range(300)} | {f"{k}{i}{j}": v[:, i, j] for k, v in (("o", om), ("g", si)) for i in range(n) for j in range(n)} | {f"b{i}": beta[:, i] for i in range(n)})  # noqa: F841
    want = duckdb.connect().execute(f"WITH {_eliminated(n)} SELECT t / u, 1 / sqrt(u) FROM est ORDER BY SNP, p").fetchall()
    assert list(zip(*(v.ravel().tolist() for v in gls.estimate(beta, om, si)))) == want


def test_estimator_of_two_rounds_as_its_sql():
    import duckdb

    from xancestry.queries import _gls_sql

    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 300, 2, 2))
    om, si, beta = a @ a.transpose(0, 2, 1), b @ b.transpose(0, 2, 1) + np.eye(2), rng.normal(size=(300, 2))
    x = pd.DataFrame({"SNP": range(300)} | {f"{k}{i}{j}": v[:, i, j] for k, v in (("o", om), ("g", si)) for i in (0, 1) for j in (0, 1)} | {f"b{i}": beta[:, i] for i in (0, 1)})  # noqa: F841
    sql = ", ".join(_gls_sql(p) for p in (0, 1)).replace("round(", "(").replace(", 6)", ")")
    want = np.array(duckdb.connect().execute(f"SELECT {sql} FROM x ORDER BY SNP").fetchall())
    got, se = gls.estimate_two(beta, om, si)
    assert (np.stack([got[:, 0], se[:, 0], got[:, 1], se[:, 1]], 1) == want).all()
    assert all(np.allclose(u, v) for u, v in zip((got, se), gls.estimate(beta, om, si)))


def test_effects_are_rounded_as_by_sql(spark):
    import math

    import duckdb

    from xancestry.queries import _r_scaled

    near = [y for x in (0.2509375, 0.5040625, -0.0021875, -0.0634375, -0.1246875, 5e-7) for y in (np.nextafter(x, -9), x, np.nextafter(x, 9))]
    x = [float(y) for y in [*near, 0.0, -0.0, -1e-9, 1.0, 123456789.1234565, 1e17, math.inf]] + [None]
    got = [r[0] for r in spark.createDataFrame([(y,) for y in x], "x double").select(*_r_scaled("x")).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6) + 0", [y]).fetchone()[0] for y in x]
    assert list(map(repr, got)) == list(map(repr, want))


def test_worked_variant():
    """LD scores 2, 1, 1 and effects 3, 2 with half on both intercepts and SE^2: 22/7 and the root of 6/7."""
    om, si = np.array([[[2.0, 1], [1, 1]]]), np.array([[[1.0, 0], [0, 1]]])
    b, s = gls.estimate(np.array([[3.0, 2.0]]), om, si)
    assert np.isclose(b[0, 0], 22 / 7) and np.isclose(s[0, 0], np.sqrt(6 / 7))


def test_p_values(spark):
    z = [1.0, -1.0, 1.96, 0.0, 34.999999, 35.000001, 60.0, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(X.p_text(X.log10_p("z"))).collect()]
    assert got[3] == "1.0e0" and got[7] is None and got[0] == got[1]
    assert np.isclose(float(got[0]), 0.317310507863) and np.isclose(float(got[2]), 0.0499957902964)
    assert got[6].endswith("e-784") and abs(float(got[4].split("e")[0]) / float(got[5].split("e")[0]) - 1) < 1e-3


def test_tail_against_erfc(spark):
    """Both sides of every seam, as far as a double holds the tail; the plan has no Python in it."""
    import math

    z = [0.0, 1e-300, 1e-9, *np.linspace(-37, 37, 2001).tolist(), *(s * math.sqrt(2) + d for s in (X.NEAR, X.MIDDLE) for d in (-1e-12, 0, 1e-12))]
    d = spark.createDataFrame([(x,) for x in [*z, None, float("nan"), math.inf, -math.inf, 1e200]], "z double").select("z", X.log10_p("z").alias("p"))
    assert "Python" not in d._jdf.queryExecution().toString()
    got = {r["z"]: r["p"] for r in d.collect() if r["z"] == r["z"]}
    for x in z:
        want = math.log10(math.erfc(abs(x) / math.sqrt(2)))
        assert abs(got[x] - want) <= 2e-13 * max(1, abs(want)), x
    assert got[None] is None and got[math.inf] == got[-math.inf] == -math.inf and got[1e200] == -math.inf
    assert d.where("isnan(z)").first()["p"] is None


def test_a_dropped_table_is_kept_again(spark):
    from xancestry.plans import synth

    first = synth.sumstats(spark, "/root/testdata/sf0.001")
    assert synth.sumstats(spark, "/root/testdata/sf0.001") is first
    spark.catalog.clearCache()
    again = synth.sumstats(spark, "/root/testdata/sf0.001")
    assert again is not first and again.storageLevel.useMemory


def brute_scores(g, a, b, pairs, per_allele, n_of, exponent=0.0, within=None):
    m = len(g)
    people = a | b
    mean = np.nanmean(g[:, people], 1, keepdims=True)
    g = np.where(np.isnan(g), mean, g)
    same = (a == b).all()
    out = np.zeros(m)
    stat = [[(g[i][x] - g[i][x].mean()) / g[i][x].std() for i in range(m)] for x in (a, b)]
    v = [[2 * f * (1 - f) for f in (g[i][x].mean() / 2 for i in range(m))] for x in (a, b)]
    for i, k in [*pairs, *((i, i) for i in range(m))]:
        def product(other):
            r = [np.mean(s[i] * s[k]) * (1 if within and within(i, k) else g[other][x].std() ** exponent) for s, x in zip(stat, (a, b))]  # noqa: B023
            return r[0] ** 2 - (1 - r[0] ** 2) / (a.sum() - 2) if same else r[0] * r[1]

        ratio = lambda t, o: np.sqrt(v[0][t] * v[1][t] / (v[0][o] * v[1][o])) if per_allele else 1  # noqa: B023, E731
        out[i] += product(k) * ratio(i, k)
        if i != k:
            out[k] += product(k if n_of(i, k) else i) * (ratio(i, k) if n_of(i, k) else ratio(k, i))
    return out


@pytest.mark.parametrize("chunk,reach", [(4, 6), (8, 3), (50, 5), (3, 100)])
@pytest.mark.parametrize("per_allele", [True, False])
def test_ld_scores(spark, chunk, reach, per_allele):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, (30, 40)).astype(float)
    g[rng.random(g.shape) < 0.03] = np.nan
    a, b = np.arange(40) < 25, np.arange(40) >= 25
    lefts = ldscore.block_lefts(np.arange(30), reach)
    w = ldscore.Windows.of(lefts, chunk)
    pairs = [(i, k) for i, k in itertools.combinations(range(30), 2) if w.included(i, k)]
    chunks = set(w.chunk_pairs())
    assert {(i, k) for i, k in itertools.combinations(range(30), 2) if (i // w.chunk, k // w.chunk) in chunks} == set(pairs)
    assert all(k in range(30) for i in range(30) for k in range(lefts[i], i) if (k, i) in pairs or pytest.fail("a pair in reach is missing"))
    geno = spark.createDataFrame([(i, [None if np.isnan(x) else int(x) for x in r]) for i, r in enumerate(g)], "idx long, dosage array<int>")
    left_of_chunk = lambda i, k: k >= w.first and i < k // w.chunk * w.chunk
    for x, y in ((a, b), (a, a)):
        got = {r["idx"]: r["l2"] for r in ldscore.pair_scores(geno, x, y, lefts, chunk, per_allele).collect()}
        assert np.allclose([got[i] for i in range(30)], brute_scores(g, x, y, pairs, per_allele, left_of_chunk), atol=1e-8)
        got = {r["idx"]: r["l2"] for r in ldscore.pair_scores(geno, x, y, lefts, chunk, per_allele, exponent=0.5).collect()}
        within = lambda i, k: k >= w.first and i >= k // w.chunk * w.chunk
        assert np.allclose([got[i] for i in range(30)], brute_scores(g, x, y, pairs, per_allele, left_of_chunk, 0.5, within), atol=1e-8)


def test_windows_by_hand():
    assert ldscore.block_lefts([1, 2, 4, 7, 7.5], 3).tolist() == [0, 0, 0, 2, 3]
    assert ldscore.block_sizes([1, 2, 4, 7], 3).tolist() == [2, 3, 2, 1]
    with pytest.raises(ValueError):
        ldscore.block_lefts([2, 1], 1)
    with pytest.raises(ValueError):
        ld.window(snps=1, kb=1)
    assert ld.window(kb=2) == (2000.0, "BP")


def test_block_sizes_are_columns(spark):
    g = [[0, 1, 2, 1, 0, 1], [2, 1, 0, 1, 1, 2], [1, 0, 1, 2, 2, 0]]
    variants = spark.createDataFrame([(i, "22", f"rs{i}", 0.0, 100 * i) for i in range(3)], "snp_idx long, CHR string, SNP string, CM double, BP long")
    people = spark.createDataFrame([(i, "AB"[i // 3]) for i in range(6)], "ind_idx long, ancestry string")
    geno = spark.createDataFrame(list(enumerate(g)), "snp_idx long, dosage array<int>")
    sources = spark.createDataFrame([(f"rs{i}", 1, int(i < 2)) for i in range(3)], "SNP string, A int, B int")
    got, _ = ld.estimate(spark, variants, people, geno, sources, (150.0, "BP"), sizes=True)
    assert got.columns == ["snp_idx", "CHR", "SNP", "BP", "A_B", "A_A", "B_B", "A_B_ldBlockSize", "A_A_ldBlockSize", "B_B_ldBlockSize"]
    rows = got.orderBy("snp_idx").collect()
    assert [r["A_A_ldBlockSize"] for r in rows] == [2, 3, 2] and [r["A_B_ldBlockSize"] for r in rows] == [2, 2, None]
    assert ld.restrict(got, cross_only=True).count() == sum(r["A_B"] is not None for r in rows)


def test_genotype_files(spark, tmp_path):
    g = np.array([[0, 1, 2, -1, 2], [2, 2, 1, 0, 0], [1, 1, 1, 1, 1]])
    code = {0: 0, -1: 1, 1: 2, 2: 3}
    packed = b"".join(bytes(sum(code[x] << (2 * k) for k, x in enumerate(r[i : i + 4])) for i in range(0, 5, 4)) for r in g)
    (tmp_path / "x.bed").write_bytes(plink.MAGIC + plink.BY_VARIANT + packed)
    (tmp_path / "x.bim").write_text("22\trs1\t0.1\t100\tA\tG\n22\trs2\t0.2\t200\tC\tT\n22\trs3\t0.3\t300\tC\tT\n")
    (tmp_path / "x.fam").write_text("".join(f"f p{i} 0 0 0 -9\n" for i in range(5)))
    got = plink.bed(spark, str(tmp_path / "x.bed"), 5, 3).orderBy("snp_idx").collect()
    assert [[-1 if x is None else x for x in r["dosage"]] for r in got] == g.tolist()
    assert [r["SNP"] for r in plink.bim(spark, str(tmp_path / "x.bim")).orderBy("snp_idx").collect()] == ["rs1", "rs2", "rs3"]
    assert [r["IID"] for r in plink.fam(spark, str(tmp_path / "x.fam")).orderBy("ind_idx").collect()] == [f"p{i}" for i in range(5)]
    with pytest.raises(Exception):
        plink.bed(spark, str(tmp_path / "x.bed"), 9, 3).collect()


def test_command_line(spark, tmp_path):
    from xancestry import cli

    rng = np.random.default_rng(2)
    m = 60
    base = pd.DataFrame({"SNP": [f"rs{i}" for i in range(m)], "CHR": 1 + np.arange(m) % 3, "BP": np.arange(m) + 1, "A1": "A", "A2": "G", "N": 1000, "FRQ": 0.4, "BETA": rng.normal(size=m), "SE": 1.0, "P": 0.5})
    base.to_csv(tmp_path / "one.txt", sep="\t", index=False)
    pd.DataFrame({"SNP": base["SNP"], "E_E": 1 + rng.integers(0, 3, m)}).to_csv(tmp_path / "x.l2.ldscore", sep="\t", index=False)
    out = tmp_path / "out"
    assert cli.main(["meta", "--sumstats", f"{tmp_path}/one.txt,E,T", "--ld-scores", f"{tmp_path}/*.ldscore", "--out", str(out), "--out-reg-coef", "--out-harmonized", "--reg-ld-unc", "--verbose"]) == 0
    res = pd.read_csv(f"{out}_E_T.res", sep="\t")
    both = base.merge(res, on="SNP", suffixes=("_in", ""))
    assert list(res.columns) == ["SNP", "CHR", "BP", "A1", "A2", "FREQ", "BETA", "SE", "Z", "P", "N_EFF", "N_ORIG"] and len(res) == m
    assert np.allclose(both["BETA"], both["BETA_in"]), "one population keeps its effects"
    assert res["CHR"].is_monotonic_increasing
    coef = [float((tmp_path / f"out_{k}_reg.cf").read_text()) for k in ("int", "se2")]
    assert np.isclose(*coef), "a constant SE shares its weight with the intercept"
    told = (tmp_path / "out.log").read_text()
    z = both["BETA_in"].to_numpy()
    assert f"mean chi-squared {(z**2).mean():.6f}"[:30] in told and "set: reg_ld_unc = True" in told and "default: freq_bounds = (0.01, 0.99)" in told and "took " in told
    assert "NO NAN drops []" in told and "duplicates []" in told
    hrm = pd.read_csv(f"{out}_E_T.hrm", sep="\t")
    assert list(hrm.columns) == ["SNP", "CHR", "BP", "A1", "A2", "N", "FREQ", "BETA", "SE", "P"] and len(hrm) == m and (hrm["P"] == 0.5).all()
    assert cli.main(["meta", "--sumstats", f"{tmp_path}/none.txt,E,T", "--ld-scores", f"{tmp_path}/*.ldscore", "--out", str(out)]) == 1


def test_reports(spark):
    assert [sinks.elapsed(x) for x in (3.21, 60, 3661.5, 90061)] == ["3.2s", "1m:0.0s", "1h:1m:1.5s", "1d:1h:1m:1.0s"]
    d = rows(spark, SNP=[f"rs{i}" for i in range(60)] + ["rs59"], SE=[-1.0] * 52 + [1.0] * 9)
    ck = quality.qc_sumstats(d)
    assert len(ck.dropped("SE BOUNDS")) == 51 and ck.dropped("SE BOUNDS")[-1] == "..." and ck.dropped("NO NAN") == [] and ck.repeated() == ["rs59"]
    from xancestry import cli

    argv = ["ldscores", "--out", "x", "--bfile-merged-path=y", "--ances-path", "z", "--snp-ances", "s", "--ld-wind-cm", "1", "--maf", "0"]
    assert cli.chosen(argv, cli.parser().parse_args(argv)) == {"out": "x", "bfile_merged_path": "y", "ances_path": "z", "snp_ances": "s", "ld_wind_cm": 1.0, "maf": 0.0}


def test_output_prefix(tmp_path):
    from xancestry.plans import sinks

    (tmp_path / "taken").write_text("")
    for path in (tmp_path / "taken", tmp_path, tmp_path / "none" / "x"):
        with pytest.raises(ValueError):
            sinks.output_prefix(str(path))
    assert sinks.output_prefix(f" {tmp_path}/free ") == f"{tmp_path}/free"


def test_entry_registers_sql_for_known_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_shared_source_is_dealt_by_its_rows(spark, monkeypatch):
    """Partitions of the joined lines follow their number, whatever the session shuffles into, and the setting is as before."""
    from xancestry.plans import synth

    sf = "/root/testdata/sf0.001"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(map(tuple, synth.sumstats(spark, sf).collect()))
    synth._KEPT.popitem()[1].unpersist()
    monkeypatch.setattr(synth, "ROWS_A_TASK", 500)
    try:
        got = synth.sumstats(spark, sf)
        rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
        assert "l_orderkey#" in got._jdf.queryExecution().toString() and f", {-(-rows // 500)}" in got._jdf.queryExecution().toString()
        assert sorted(map(tuple, got.collect())) == want and spark.conf.get("spark.sql.shuffle.partitions") == before
    finally:
        synth._KEPT.popitem()[1].unpersist()


@pytest.fixture
def bare(spark):
    """A session that leaves the number of shuffle partitions to Spark's default, and whose shared source isn't made yet."""
    from xancestry.plans import synth

    drop = lambda: [synth._KEPT.pop(k).unpersist() for k in list(synth._KEPT)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    drop()
    spark.conf.unset("spark.sql.shuffle.partitions")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    drop()


def test_settings_left_to_their_defaults_stay_so(bare):
    from xancestry.plans import planning

    for key, within in ((planning.PARTITIONS, planning.shuffled_in(bare, 7)), (planning.CONSTRAINTS, planning.without_constraints(bare))):
        assert bare.conf.get(key, None) is None
        with pytest.raises(ZeroDivisionError), within:
            assert bare.conf.get(key) in ("7", "false")
            1 / 0
        assert bare.conf.get(key, None) is None
    bare.conf.set(planning.PARTITIONS, "5")
    with planning.shuffled_in(bare, 7):
        pass
    assert bare.conf.get(planning.PARTITIONS) == "5"


@pytest.mark.parametrize("name", ["allele_flip", "ldreg_int_zero", "ldreg_se2_zero", "meta_two_populations", "std_units"])
def test_first_query_of_a_bare_session(bare, name):
    """It gives what its SQL gives, to the last row, and leaves the setting alone."""
    import duckdb

    import __spark_entry__ as e

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "nation"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = e.queries()[name](bare, sf)
    assert bare.conf.get("spark.sql.shuffle.partitions", None) is None
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_sources_of_a_release_in_a_bare_session(bare):
    from jobs import release

    pops, ld = release.sources(bare, "/root/testdata/sf0.001", 2)
    assert bare.conf.get("spark.sql.shuffle.partitions", None) is None
    assert all(d.count() for d in (*pops.values(), ld))
