"""Per-variant matrices and the generalised least squares estimator.

Omega and Sigma are column expressions; their checks and the estimator are batched linear algebra over Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What off-diagonals are multiplied by until a matrix is positive semi-definite.
SHRINK = 0.99


def _lit(m: np.ndarray) -> Column:
    return F.array(*(F.lit(float(x)) for x in np.asarray(m).ravel()))


def omega(ld: Column, coef: np.ndarray) -> Column:
    """Row by row: LD scores times coefficients."""
    return F.zip_with(ld, _lit(coef), lambda a, b: a * b)


def sigma(se: Column, se2: np.ndarray, const: np.ndarray) -> Column:
    n = len(const)
    return F.array(*(se[p] * se[q] * F.lit(float(se2[p, q])) + F.lit(float(const[p, q])) for p in range(n) for q in range(n)))


def _with_diagonal(m: np.ndarray, d: np.ndarray) -> np.ndarray:
    at = np.arange(m.shape[-1])
    m[..., at, at] = d
    return m


def tweak(m: np.ndarray) -> np.ndarray:
    """Of a matrix, or of each of a stack: off-diagonals at most the roots' product, then shrunk until no eigenvalue is negative.

    A stack is shrunk together; at each step only the matrices that still have a negative eigenvalue go on.
    """
    stack = m[None] if m.ndim == 2 else m
    d = np.diagonal(stack, axis1=-2, axis2=-1).copy()
    root = np.sqrt(d)
    out = _with_diagonal(np.minimum(stack, root[:, :, None] * root[:, None, :]), d)
    active = np.arange(len(out))
    while len(active := active[(np.linalg.eigvalsh(out[active]) < 0).any(-1)]):
        out[active] = _with_diagonal(out[active] * SHRINK, d[active])
    return out[0] if m.ndim == 2 else out


def check_omega(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrices, ok, tweaked) of a block; those with a diagonal that isn't positive can't be mended."""
    m = m.copy()
    good = (np.linalg.eigvalsh(m) >= 0).all(1) if len(m) else np.zeros(0, bool)
    positive = (np.diagonal(m, axis1=1, axis2=2) > 0).all(1)
    tweaked = ~good & positive
    if tweaked.any():
        m[tweaked] = tweak(m[tweaked])
    return m, good | tweaked, tweaked


#: Pivots within this share of their diagonal are too near 0 for elimination by column to tell what the library's factorisation says.
DOUBT = 1e-9


def _has_factor(m: np.ndarray) -> bool:
    try:
        np.linalg.cholesky(m)
        return True
    except np.linalg.LinAlgError:
        return False


def check_sigma(m: np.ndarray) -> np.ndarray:
    """Which have a Cholesky factor: all columns of all matrices at once; single matrices are factored only where a pivot is in doubt."""
    n = m.shape[-1]
    factor, ok, doubt = np.zeros_like(m), np.ones(len(m), bool), np.zeros(len(m), bool)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for j in range(n):
            rest = m[:, j:, j] - (factor[:, j:, :j] @ factor[:, j, :j, None])[:, :, 0]
            near = ~(np.abs(rest[:, 0]) > DOUBT * np.abs(m[:, j, j])) | ~np.isfinite(rest[:, 0])
            doubt |= ok & near
            ok &= rest[:, 0] > 0
            factor[:, j:, j] = rest / np.sqrt(rest[:, :1])
    for i in np.flatnonzero(doubt):
        ok[i] = _has_factor(m[i])
    return ok


def estimate(beta: np.ndarray, om: np.ndarray, si: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Effects and standard errors [variant, population]: one population's weights at a time, over all variants.

    [C w b; w' 0 0] is eliminated column by column, without pivoting as C is positive definite: what is left is -w' C^-1 w and
    -w' C^-1 b. The operations are those of the SQL, in its order, so that both round alike where a result ends in a half.
    """
    n = beta.shape[1]
    b, s = np.empty_like(beta), np.empty_like(beta)
    # Variants last, where they lie together.
    om, si = (np.ascontiguousarray(x.transpose(1, 2, 0)) for x in (om, si))
    m = np.empty((n + 1, n + 2, len(beta)))
    for p in range(n):
        m[:n, :n] = om - om[:, p, None] * om[None, p] / om[p, p] + si
        m[:n, n] = m[n, :n] = om[:, p] / om[p, p]
        m[:n, n + 1] = beta.T
        m[n, n:] = 0
        for k in range(n):
            m[k + 1 :, k + 1 :] -= m[k + 1 :, k, None] * m[None, k, k + 1 :] / m[k, k]
        b[:, p], s[:, p] = m[n, n + 1] / m[n, n], 1 / np.sqrt(-m[n, n])
    return b, s


def estimate_two(beta: np.ndarray, om: np.ndarray, si: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As estimate, of two populations with C's inverse written out: the last bits can differ, so each suits SQL of its own form."""
    b, s = np.empty_like(beta), np.empty_like(beta)
    for p in range(2):
        w = om[:, :, p] / om[:, p, p, None]
        c = om - om[:, :, p, None] * om[:, p, None, :] / om[:, p, p, None, None] + si
        det = c[:, 0, 0] * c[:, 1, 1] - c[:, 0, 1] * c[:, 1, 0]
        inv = [[c[:, 1, 1] / det, -c[:, 0, 1] / det], [-c[:, 1, 0] / det, c[:, 0, 0] / det]]
        form = lambda v: sum((w[:, i] * inv[i][j] * v[:, j] for i, j in ((0, 1), (1, 0), (1, 1))), w[:, 0] * inv[0][0] * v[:, 0])  # noqa: B023, E731
        b[:, p], s[:, p] = form(beta) / form(w), 1 / np.sqrt(form(w))
    return b, s


OUT = "new_beta array<double>, new_se array<double>, om array<double>, om_ok boolean, om_tweaked boolean, si_ok boolean"


def gls(df: DataFrame, n: int, by=estimate) -> DataFrame:
    """df (with beta, omega, sigma) and: new_beta, new_se (null where a check fails), om (after tweaks), om_ok, om_tweaked, si_ok.

    One population needs no linear algebra and stays in the JVM.
    """
    if n == 1:
        ok = F.col("sigma")[0] > 0
        return df.withColumns({
            "new_beta": F.when(ok, F.col("beta")), "new_se": F.when(ok, F.array(F.sqrt(F.col("sigma")[0]))), "om": F.col("omega"),
            "om_ok": F.lit(True), "om_tweaked": F.lit(False), "si_ok": F.coalesce(ok, F.lit(False)),
        })
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*df.schema.fields, *_parse_datatype_string(OUT).fields])

    def run(batches):
        for pdf in batches:
            square = lambda c: np.array(pdf[c].tolist(), float).reshape(-1, n, n)  # noqa: B023, E731
            beta = np.array(pdf["beta"].tolist(), float).reshape(-1, n)
            om, om_ok, tweaked = check_omega(square("omega"))
            si = square("sigma")
            si_ok = check_sigma(si)
            ok = om_ok & si_ok
            b, s = np.full_like(beta, np.nan), np.full_like(beta, np.nan)
            if ok.any():
                b[ok], s[ok] = by(beta[ok], om[ok], si[ok])
            lists = lambda x: [y.tolist() if o else None for y, o in zip(x, ok)]  # noqa: B023, E731
            yield pdf.assign(new_beta=lists(b), new_se=lists(s), om=om.reshape(len(om), -1).tolist(), om_ok=om_ok, om_tweaked=tweaked, si_ok=si_ok)

    return df.mapInPandas(run, schema)
