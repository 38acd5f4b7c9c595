"""Embedding whitening by the exact characteristic polynomial.

Vectors become integers, and n * scatter - sums * sums^T over the distinct vectors is an integer matrix M whose eigenvalues are
those of the covariance times n^2. Its characteristic polynomial is found modulo many primes (Hessenberg reduction, a group of primes
per task) and put together by Chinese remaindering. All its roots are real, so the sign variations of the shifted polynomial
count the roots above a point exactly; bisection isolates the largest ones, sign changes narrow them to ``BITS`` bits.
Inverse iteration with many-digit decimals (a component per task) gives the null space of M - root, also where roots are so close that double
precision would mix their vectors; of a repeated root an orthonormal basis is taken.

Scale: the distinct vectors are one shuffle, cut by partial aggregation, so copies of one vector load no task; scatter sums are exact and
leave a task as dim * (dim + 1) / 2 rows. The driver sees M, the polynomial and the components, whose size depends on the dimension
alone. Work for the polynomial grows with dim^4 and for a component with dim^3, not with the rows.

Edge cases: rows whose vector is null, empty or holds null or non-finite entries are dropped. The dimension is that of most of the
remaining rows (the larger of ties); rows of another one cannot be projected and are dropped, too. Entries
beyond +-2^46 count as that bound. Components of eigenvalue zero cannot be whitened and are left out: fewer than ``components`` come back when the vectors
span less, none (and no rows) when all are equal or there are none. Null and repeated ids and repeated rows pass through row by row; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import map_rows, step

BITS = 200  # of the largest root, to which roots are narrowed
DIGITS = 120  # of the decimals in inverse iteration
LIMB = 18  # bits of the parts in which integers are multiplied: sums of 2^16 products stay exact in doubles
ROWS = 1 << 16
LARGEST = 1 << 46  # of an entry's absolute value, in steps
_DECIMAL = pa.decimal128(38, 0)


@dataclass
class Whitening:
    n: int  # vectors in the fit list
    sums: list[int]  # per dimension, of the integer vectors less ``origin``
    origin: int
    scale: int
    vectors: np.ndarray  # dim x components, unit columns
    roots: list[Fraction]  # eigenvalues of the covariance
    trace: Fraction

    @property
    def dim(self) -> int:
        return len(self.sums)


def integers(vec: Column, scale: int) -> Column:
    """floor(scale * entry) of every entry."""
    return F.transform(vec, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long"))


def usable(rows: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector holds numbers only and has the dimension of most such rows."""
    good = rows.where(F.coalesce(F.forall(vec_col, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(math.inf), F.lit(False))), F.lit(False))
                      & (F.size(vec_col) > 0))
    top = good.groupBy(F.size(vec_col).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return good.where(F.size(vec_col) == (top["dim"] if top else 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _gram(z: np.ndarray) -> np.ndarray:
    """z^T z in Python integers: products of LIMB-bit parts in doubles, each sum below 2^53."""
    size, sign, parts = np.abs(z), np.sign(z), []
    while not parts or size.any():
        parts.append(((size & ((1 << LIMB) - 1)) * sign).astype(np.float64))
        size = size >> LIMB
    out = np.zeros((z.shape[1],) * 2, object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            out += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return out


def scatter(fit_list: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(rows, sums, z^T z) of the column ``z``, exact."""
    upper = [(i, j) for i in range(dim) for j in range(i, dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, gram = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            z = _matrix(batch.column(0), dim)
            n += len(z)
            for at in range(0, len(z), ROWS):
                part = z[at:at + ROWS]
                sums += part.sum(axis=0).astype(object)  # 2^16 entries below 2^46
                gram += _gram(part)
        if n:
            i, j, v = zip((-1, -1, n), *((-1, k, s) for k, s in enumerate(sums)), *((i, j, gram[i, j]) for i, j in upper))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(x)) for x in v], _DECIMAL)],
                                             names=["i", "j", "v"])

    total = map_rows(fit_list.select("z"), run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    n, sums, gram = 0, [0] * dim, np.zeros((dim, dim), object)
    for i, j, v in total.collect():  # (dim + 1) (dim + 2) / 2 rows
        if i >= 0:
            gram[i, j] = gram[j, i] = int(v)
        elif j >= 0:
            sums[j] = int(v)
        else:
            n = int(v)
    return n, sums, gram


# ---- characteristic polynomial -------------------------------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all 32-bit numbers."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(count: int) -> list[int]:
    """The largest ``count`` primes below 2^31."""
    out, p = [], (1 << 31) - 1
    while len(out) < count:
        if _is_prime(p):
            out.append(p)
        p -= 2
    return out


def polynomials_modulo(matrix: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Characteristic polynomial modulo each of ``moduli``; row per modulus, constant coefficient first."""
    d, p = len(matrix), np.array(moduli, np.int64)
    k = np.arange(len(p))
    a = np.stack([(matrix % m).astype(np.int64) for m in moduli])
    p1, p2 = p[:, None], p[:, None, None]

    def inverse(x: np.ndarray) -> np.ndarray:
        out, power, e = np.ones_like(x), x, p - 2
        while e.any():
            out = np.where(e & 1, out * power % p, out)
            power, e = power * power % p, e >> 1
        return out

    for c in range(d - 2):
        pivot = c + 1 + (a[:, c + 1:, c] != 0).argmax(axis=1)  # the first row that is not zero there
        rows = a[k, pivot].copy()
        a[k, pivot], a[:, c + 1] = a[:, c + 1].copy(), rows
        columns = a[k, :, pivot].copy()
        a[k, :, pivot], a[:, :, c + 1] = a[:, :, c + 1].copy(), columns
        u = a[:, c + 2:, c] * inverse(a[:, c + 1, c])[:, None] % p1  # a zero pivot has zeros below it and gives u = 0
        a[:, c + 2:] = (a[:, c + 2:] - u[:, :, None] * a[:, None, c + 1] % p2) % p2
        a[:, :, c + 1] = (a[:, :, c + 1] + (a[:, :, c + 2:] * u[:, None, :] % p2).sum(axis=2)) % p1
    # leading blocks of the Hessenberg form, one row and column more at a time
    polys = [np.zeros((len(p), d + 1), np.int64)]
    polys[0][:, 0] = 1
    for m in range(d):
        q = np.roll(polys[m], 1, axis=1)
        q = (q - a[:, m, m, None] * polys[m] % p1) % p1
        below = np.ones(len(p), np.int64)
        for i in range(m - 1, -1, -1):
            below = below * a[:, i + 1, i] % p
            q = (q - (a[:, i, m] * below % p)[:, None] * polys[i] % p1) % p1
        polys.append(q)
    return polys[d]


def polynomial(spark: SparkSession, matrix: np.ndarray, group: int = 16) -> list[int]:
    """Integer coefficients of the characteristic polynomial of a positive semidefinite integer matrix, constant first."""
    d = len(matrix)
    trace = int(sum(matrix[i, i] for i in range(d)))
    # no root is negative, so the k-th symmetric function is at most C(d, k) (trace / d)^k
    bound = max(math.comb(d, k) * (trace + d) ** k // d ** k + 1 for k in range(d + 1))
    moduli = primes(bound.bit_length() // 30 + 2)
    groups = [moduli[i:i + group] for i in range(0, len(moduli), group)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ms in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(ms, pa.int64()), pa.array(polynomials_modulo(matrix, ms).tolist(), pa.list_(pa.int64()))],
                                                 names=["p", "c"])

    src = spark.createDataFrame([(g,) for g in groups], "g array<long>").repartition(len(groups))
    total, mod = [0] * (d + 1), 1
    for p, c in map_rows(src, run, "p long, c array<long>").collect():
        inverse = pow(mod, -1, p)
        total = [t + mod * ((x - t) * inverse % p) for t, x in zip(total, c)]
        mod *= p
    # the coefficient of x^(d-k) has the sign (-1)^k
    return [t if (d - i) % 2 == 0 or t == 0 else t - mod for i, t in enumerate(total)]


# ---- roots -------------------------------------------------------------------------------------------------


def roots_above(poly: list[int], a: int) -> int:
    """Roots above ``a`` (with their multiplicity) of a polynomial with real roots only: sign variations of poly(x + a)."""
    c = poly[:]
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(poly: list[int], a: int) -> int:
    v = 0
    for c in reversed(poly):
        v = v * a + c
    return (v > 0) - (v < 0)


def largest_roots(poly: list[int], wanted: int, bits: int = BITS) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) by falling root, down to the ``wanted``-th one or to the last positive one. A root is the middle of an interval of 2^-bits times
    a bound of the largest one (or exact); roots within one interval count as one root of their joint multiplicity."""
    d = len(poly) - 1
    top = max(1, -poly[d - 1])  # the sum of all roots, none of them negative
    shift = max(0, bits - top.bit_length())
    scaled = [c << (shift * (d - i)) for i, c in enumerate(poly)]  # roots times 2^shift
    positive = roots_above(poly, 0)
    out, done, high = [], 0, top << shift  # no root above
    while done < min(wanted, positive):
        low, up, below = 0, high, positive  # above(low) > done >= above(up)
        while up - low > 1:
            if below == done + 1 and _sign(scaled, up):
                break
            mid = (low + up) // 2
            k = roots_above(scaled, mid)
            if k > done:
                low, below = mid, k
            else:
                up = mid
        if up - low > 1:  # one simple root inside (low, up)
            right = _sign(scaled, up)
            while up - low > 1:
                mid = (low + up) // 2
                s = _sign(scaled, mid)
                if s == right:
                    up = mid
                else:
                    low = mid
                    if s == 0:
                        up = mid
        exact = up if _sign(scaled, up) == 0 else None
        count = roots_above(scaled, low - (low == up)) - done
        out.append((Fraction(exact, 1 << shift) if exact is not None else Fraction(2 * low + 1, 2 << shift), count))
        done, high = done + count, low - (low == up)
    return out


# ---- components ----------------------------------------------------------------------------------------------


def null_space(matrix: np.ndarray, root: Fraction, count: int) -> np.ndarray:
    """``count`` orthonormal vectors of the eigenvalue ``root``, as doubles (dim x count): inverse iteration in decimals."""
    d = len(matrix)
    with localcontext() as ctx:
        ctx.prec = DIGITS
        a = np.array([[Decimal(int(x)) for x in row] for row in matrix], object)
        mu = Decimal(root.numerator) / Decimal(root.denominator)
        size = max((abs(x) for x in a.ravel()), default=Decimal(1)) or Decimal(1)
        tiny = size * Decimal(10) ** (-DIGITS)
        for i in range(d):
            a[i, i] -= mu
        swaps = []
        for c in range(d):
            r = c + max(range(d - c), key=lambda k: abs(a[c + k, c]))
            swaps.append(r)
            if r != c:
                a[[c, r]] = a[[r, c]]
            if abs(a[c, c]) < tiny:
                a[c, c] = tiny
            if c + 1 < d:
                a[c + 1:, c] /= a[c, c]
                a[c + 1:, c + 1:] -= np.outer(a[c + 1:, c], a[c, c + 1:])
        # starts without a pattern that an eigenvector could be orthogonal to
        v = np.array([[Decimal(pow(3, 5 * i + 7 * j + i * j + 11, 1_000_003) - 500_001) for j in range(count)] for i in range(d)], object)
        for _ in range(3):
            for c, r in enumerate(swaps):
                if r != c:
                    v[[c, r]] = v[[r, c]]
                if c + 1 < d:
                    v[c + 1:] -= np.outer(a[c + 1:, c], v[c])
            for c in range(d - 1, -1, -1):
                v[c] /= a[c, c]
                if c:
                    v[:c] -= np.outer(a[:c, c], v[c])
            for _ in range(2):
                for j in range(count):
                    for i in range(j):
                        v[:, j] -= v[:, i] * (v[:, i] @ v[:, j])
                    v[:, j] /= (v[:, j] @ v[:, j]).sqrt()
        out = v.astype(np.float64)
    return out * np.where(out[np.abs(out).argmax(axis=0), np.arange(count)] < 0, -1.0, 1.0)


def components(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[list[Fraction], np.ndarray]:
    """The largest eigenvalues above zero, at most ``wanted``, and their unit eigenvectors (dim x number)."""
    found = largest_roots(polynomial(spark, matrix), wanted)
    if not found:
        return [], np.zeros((len(matrix), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                v = null_space(matrix, *found[k])
                yield pa.RecordBatch.from_arrays([pa.array([k] * v.shape[1], pa.int32()), pa.array(range(v.shape[1]), pa.int32()),
                                                  pa.array(v.T.tolist(), pa.list_(pa.float64()))], names=["k", "j", "v"])

    src = spark.createDataFrame([(k,) for k in range(len(found))], "k int").repartition(len(found))
    rows = sorted(map_rows(src, run, "k int, j int, v array<double>").collect())[:wanted]
    return [found[k][0] for k, _, _ in rows], np.array([v for _, _, v in rows]).T


def fit(rows: DataFrame, vec_col: str = "embedding", *, components_wanted: int = 16, scale: int = 64, origin: int = 1_000_000) -> tuple[Whitening, DataFrame] | None:
    """The whitening of ``usable`` rows over their distinct integer vectors, and these vectors (column ``z``). None without rows.

    The integer vector is floor(scale * entry) + origin; ``origin`` moves all vectors alike and leaves everything centred unchanged."""
    fit_list = step(rows.select(integers(F.col(vec_col), scale).alias("z")).distinct())
    first = fit_list.select(F.size("z").alias("d")).first()
    if first is None:
        return None
    n, sums, gram = scatter(fit_list, first["d"])
    s = np.array(sums, object)
    matrix = n * gram - np.outer(s, s)
    roots, vectors = components(rows.sparkSession, matrix, components_wanted)
    square = Fraction(1, n * n)
    trace = sum(int(matrix[i, i]) for i in range(len(s))) * square
    return Whitening(n, sums, origin, scale, vectors, [r * square for r in roots], trace), fit_list


def _deviations(w: Whitening, z: np.ndarray) -> np.ndarray:
    """n * x - S, exact: the origin cancels."""
    if int(np.abs(z).max(initial=0)) * w.n < 1 << 62:
        return w.n * z - np.array(w.sums, np.int64)
    return w.n * z.astype(object) - np.array(w.sums, object)


def whitened(w: Whitening, deviations: np.ndarray) -> np.ndarray:
    """Coordinates of the components, in units of their standard deviations."""
    return (deviations / w.n).astype(np.float64) @ w.vectors / np.sqrt([float(r) for r in w.roots])


def identity_error(w: Whitening, fit_list: DataFrame) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity; centred before multiplying."""
    k = len(w.roots)

    def total(products: bool, mean: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k, k) if products else k)
            for batch in batches:
                x = whitened(w, _deviations(w, _matrix(batch.column(0), w.dim))) - mean
                out += x.T @ x if products else x.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(out.size), pa.int32()), pa.array(out.ravel())], names=["i", "v"])

        rows = map_rows(fit_list.select("z"), run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([v for _, v in sorted(rows)]) / w.n

    mean = total(False, np.zeros(k))
    return float(np.abs(total(True, mean).reshape(k, k) - np.eye(k)).max())


def transform(rows: DataFrame, w: Whitening, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``id_col``, deviation (decimal: sum over dimensions of (n x - S)^2, exact), whitened (array of double), one row per row of ``usable`` rows."""
    src = rows.select(F.col(id_col).alias("id"), integers(F.col(vec_col), w.scale).alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _deviations(w, _matrix(batch.column(1), w.dim))
            small = t.dtype != object and int(np.abs(t).max(initial=0)) ** 2 * w.dim < 1 << 63
            square = (t * t).sum(axis=1) if small else (t.astype(object) ** 2).sum(axis=1)
            out = whitened(w, t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Decimal(int(x)) for x in square], _DECIMAL), pa.array(list(out), pa.list_(pa.float64()))],
                                             names=["id", "deviation", "whitened"])

    return map_rows(src, run, f"id {src.schema['id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("id", id_col)


def whiten(table: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", *, components_wanted: int = 16, scale: int = 64,
           origin: int = 1_000_000) -> DataFrame:
    """One row per usable row and component: ``id_col``, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(table.select(F.col(id_col), F.col(vec_col)), vec_col)
    model = fit(rows, vec_col, components_wanted=components_wanted, scale=scale, origin=origin)
    schema = f"`{id_col}` {table.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not model[0].roots:
        return table.sparkSession.createDataFrame([], schema)
    w, fit_list = model
    error = identity_error(w, fit_list)
    explained = F.array(*[F.lit(float(r / w.trace)) for r in w.roots])
    return (transform(rows, w, vec_col, id_col).select(id_col, "deviation", F.posexplode("whitened").alias("p", "whitened"))
            .select(id_col, (F.col("p") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(explained, F.col("p") + 1).alias("explained"), F.lit(error).alias("identity_error")))
