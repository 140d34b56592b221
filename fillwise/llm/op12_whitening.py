"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Vectors become integers; with n distinct ones, sums S and products P the scatter n P - S S' is an integer matrix, n * n
times the covariance. Tasks add up its parts exactly. Its characteristic polynomial is found modulo primes, a Spark task
taking some of them: reduction to Hessenberg form, then the recurrence over the leading blocks. Chinese remaindering
gives the integer coefficients. All roots are real, so the sign changes of the polynomial moved by a count the roots
above a exactly (Descartes); bisection on that count isolates the largest roots with their multiplicity. Components span
the null space of the scatter less a root: inverse iteration in decimal arithmetic with digits enough for the gaps.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import accumulate
from math import comb, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.llm.common import written

#: Sums travel in parts of so many bits, the last one signed.
LIMB, LIMBS = 30, 6
#: Bits to which neighbouring roots are told apart before they count as one, and bits that components get beyond the gap.
FIRST_BITS, LAST_BITS, SPARE_BITS = 64, 512, 64
ROWS = 4096


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def gram(x: np.ndarray) -> np.ndarray:
    """x' x of integers, exactly, as Python integers: in parts of 20 bits, whose products doubles hold."""
    if not len(x):
        return np.zeros((x.shape[1], x.shape[1]), dtype=object)
    high = max(abs(int(x.max())), abs(int(x.min())))
    if high * high * len(x) < 2**53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    parts, rest = [], x
    while True:
        last = -(2**20) <= int(rest.min()) and int(rest.max()) < 2**20
        parts.append((rest if last else rest & (2**20 - 1)).astype(np.float64))
        if last:
            break
        rest = rest >> 20
    out = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for i, a in enumerate(parts):
        for k, b in enumerate(parts):
            out += (a.T @ b).astype(np.int64).astype(object) * (1 << 20 * (i + k))
    return out


def _sums(d: int):
    """Task: (i, k, limbs of the sum of x_i x_k) for i <= k; k = d has the sums of x_i, and i = k = d the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for lo in range(0, len(x), ROWS):
                some = x[lo : lo + ROWS]
                total += gram(np.column_stack([some, np.ones(len(some), np.int64)]))
        i, k = np.triu_indices(d + 1)
        values = total[i, k].tolist()
        limbs = [[(v >> LIMB * at) & ((1 << LIMB) - 1) if at < LIMBS - 1 else v >> LIMB * at for v in values] for at in range(LIMBS)]
        columns = [pa.array(i, pa.int32()), pa.array(k, pa.int32()), *(pa.array(v, pa.int64()) for v in limbs)]
        yield pa.RecordBatch.from_arrays(columns, ["i", "k", *(f"v{at}" for at in range(LIMBS))])

    return run


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, n P - S S') of the column ``x``. Only sums reach the driver, as many as the matrix has entries."""
    schema = "i int, k int, " + ", ".join(f"v{at} long" for at in range(LIMBS))
    rows = fit.select("x").mapInArrow(_sums(d), schema).groupBy("i", "k").agg(*[F.sum(f"v{at}").alias(f"v{at}") for at in range(LIMBS)])
    total = np.zeros((d + 1, d + 1), dtype=object)
    for r in rows.collect():
        total[r["i"], r["k"]] = total[r["k"], r["i"]] = sum(r[f"v{at}"] << LIMB * at for at in range(LIMBS))
    n, s = total[d, d], total[:d, d]
    return n, s.tolist(), n * total[:d, :d] - np.outer(s, s)


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 3 * 10^9."""
    if n < 2 or any(n % q == 0 for q in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7):
        y = pow(a, odd, n)
        if y not in (1, n - 1) and all((y := y * y % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds ``bound``."""
    out, product, at = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(at):
            out.append(at)
            product *= at
        at -= 2
    return out


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo p that is 0 below the first subdiagonal."""
    a, d = a.copy(), len(a)
    for j in range(d - 2):
        below = np.flatnonzero(a[j + 1 :, j])
        if not len(below):
            continue
        if (at := j + 1 + int(below[0])) != j + 1:
            a[[at, j + 1]] = a[[j + 1, at]]
            a[:, [at, j + 1]] = a[:, [j + 1, at]]
        factor = a[j + 2 :, j] * pow(int(a[j + 1, j]), -1, p) % p
        a[j + 2 :, j:] = (a[j + 2 :, j:] - factor[:, None] * a[j + 1, j:] % p) % p
        a[:, j + 1] = (a[:, j + 1] + (a[:, j + 2 :] * factor % p).sum(axis=1)) % p
    return a


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - a) modulo p, lowest first, from the leading blocks of the Hessenberg form."""
    d, h = len(a), hessenberg(a, p)
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        weight, chain = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weight[i] = int(h[i, k - 1]) * chain % p
            chain = chain * int(h[i, i - 1]) % p if i else chain
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (polys[:k] * weight[:, None] % p).sum(axis=0)) % p
    return polys[d]


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Integer coefficients of det(x - m), lowest first, for a symmetric matrix; primes are dealt over tasks."""
    d = len(m)
    radius = max(int(sum(abs(v) for v in row)) for row in m)
    bound = 2 * max(comb(d, k) * radius**k for k in range(d + 1))
    primes = primes_beyond(bound)
    rows = m.tolist()

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(rows, dtype=object)
        for batch in batches:
            ps = batch.column(0).to_pylist()
            found = [polynomial_mod((whole % p).astype(np.int64), p).tolist() for p in ps]
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["p", "c"])

    parts = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    got = spark.createDataFrame([(p,) for p in primes], "p long").repartition(parts, "p").mapInArrow(residues, "p long, c array<long>").collect()
    product = prod(primes)
    out = [0] * (d + 1)
    for r in got:
        p, others = r["p"], product // r["p"]
        unit = others * pow(others, -1, p)
        for i, c in enumerate(r["c"]):
            out[i] += c * unit
    out = [c % product for c in out]
    return [c - product if 2 * c > product else c for c in out]


def roots_above(coefs: list[int], a: int, shift: int) -> int:
    """Roots greater than a / 2^shift (a > 0), with multiplicity, of a polynomial whose roots are all real."""
    d, row, power = len(coefs) - 1, [], 1
    for i, c in enumerate(coefs):
        row.append((c * power) << shift * (d - i))
        power *= a
    signs, row = [], row[::-1]
    while row:  # the polynomial moved by 1, lowest coefficient first
        row = list(accumulate(row))
        if last := row.pop():
            signs.append(last > 0)
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def largest_roots(coefs: list[int], most: int) -> tuple[list[tuple[int, int]], int]:
    """Brackets (a, bits): the k-th largest root lies in (a, a + 1] / 2^bits, one for each of the ``most`` and the next one.

    Only roots above 0 are returned. Roots of one bracket at LAST_BITS count as equal. The second result is the number of
    bits to which the returned ones are told apart.
    """
    positive = len(coefs) - 1 - next(i for i, c in enumerate(coefs) if c)
    size = (sum(abs(c) for c in coefs[-2:-1]) or 1).bit_length()  # the trace is above every root
    out: list[tuple[int, int]] = []
    bits = FIRST_BITS
    for k in range(1, min(most + 1, positive) + 1):
        # binary places: first until the root's own size is known, then so many bits below it
        low, shift, high = 0, 0, 1 << size
        while roots_above(coefs, 1, shift) < k:
            shift += FIRST_BITS
        high <<= shift
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if roots_above(coefs, mid, shift) >= k else (low, mid)
        low, shift = _sharper(coefs, k, low, shift, bits)
        while out and bits < LAST_BITS and _meet(out[-1], (low, shift)):
            bits *= 2
            out = [_sharper(coefs, j, *b, bits) for j, b in enumerate(out, 1)]
            low, shift = _sharper(coefs, k, low, shift, bits)
        out.append((low, shift))
    bits += SPARE_BITS
    return [_sharper(coefs, j, *b, bits) for j, b in enumerate(out, 1)], bits


def _sharper(coefs: list[int], k: int, low: int, shift: int, bits: int) -> tuple[int, int]:
    while low.bit_length() < bits:
        low, shift = 2 * low, shift + 1
        if roots_above(coefs, low + 1, shift) >= k:
            low += 1
    return low, shift


def _meet(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether two brackets overlap or touch."""
    top = max(a[1], b[1])
    (x, xw), (y, yw) = ((v << top - s, 1 << top - s) for v, s in (a, b))
    return x <= y + yw and y <= x + xw


def _solver(m: np.ndarray, digits: int):
    """Solves m x = b by elimination with pivots, in decimals; a pivot that is 0 becomes tiny."""
    a, d = m.copy(), len(m)
    order, tiny = np.arange(d), max(abs(v) for row in m for v in row) * Decimal(10) ** -digits or Decimal(1)
    for j in range(d):
        at = j + max(range(d - j), key=lambda i: abs(a[j + i, j]))
        if at != j:
            a[[at, j]], order[[at, j]] = a[[j, at]], order[[j, at]]
        a[j, j] = a[j, j] or tiny
        a[j + 1 :, j] = a[j + 1 :, j] / a[j, j]
        a[j + 1 :, j + 1 :] -= np.outer(a[j + 1 :, j], a[j, j + 1 :])

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for j in range(d):
            x[j + 1 :] -= a[j + 1 :, j] * x[j]
        for j in range(d - 1, -1, -1):
            x[j] /= a[j, j]
            x[:j] -= a[:j, j] * x[j]
        return x

    return solve


def _orthonormal(vectors: list[np.ndarray]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for v in vectors:
        for _ in range(2):
            for u in out:
                v = v - u * (u @ v)
        out.append(v / (v @ v).sqrt())
    return out


@dataclass
class Whitening:
    """Components (rows of ``vectors``) with the eigenvalues of the scatter, and what the vectors are centred by."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    roots: list[float]
    explained: list[float]

    def project(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """(sum of squares of n x - S, whitened values) of integer vectors."""
        high = max(abs(int(x.max())), abs(int(x.min())), 1) if x.size else 1
        reach = high * self.n + max(abs(s) for s in self.sums)
        y = x * self.n - np.array(self.sums, np.int64) if reach < 2**62 else x.astype(object) * self.n - np.array(self.sums, object)
        squares = y if reach * reach * len(self.sums) < 2**63 else y.astype(object)
        return (squares * squares).sum(axis=1).tolist(), y.astype(np.float64) @ self.vectors.T / np.sqrt(self.roots)


def components(spark: SparkSession, n: int, sums: list[int], m: np.ndarray, most: int) -> Whitening:
    """At most ``most`` components of the scatter, by falling eigenvalue; those of eigenvalue 0 are none."""
    d, trace = len(m), int(sum(m[i, i] for i in range(len(m))))
    if trace == 0:
        return Whitening(n, sums, np.zeros((0, d)), [], [])
    brackets, bits = largest_roots(characteristic_polynomial(spark, m), most)
    vectors: list = []
    roots, at = [], 0
    digits = 20 + int(2 * bits * 0.302)
    with decimal.localcontext(decimal.Context(prec=digits + 20)):
        exact = np.array([[Decimal(int(v)) for v in row] for row in m], dtype=object)
        while at < min(most, len(brackets)):
            alike = 1
            while at + alike < len(brackets) and _meet(brackets[at + alike - 1], brackets[at + alike]):
                alike += 1
            alike = min(alike, most - at)
            low, shift = brackets[at]
            root = Decimal(2 * low + 1) / Decimal(2 << shift)
            less = exact.copy()
            less[np.arange(d), np.arange(d)] -= root
            solve, found = _solver(less, digits), []
            for k in range(alike):
                state = k + 1
                start = []
                for _ in range(d):
                    state = (1103515245 * state + 12345) % 2**31
                    start.append(Decimal(state) / 2**31 + 1)
                found.append(np.array(start, dtype=object))
            for _ in range(3):
                found = _orthonormal([solve(v) for v in found])
            vectors += found
            roots += [root] * alike
            at += alike
        flat = np.array([[float(v) for v in u] for u in vectors])
        shares = [float(r / trace) for r in roots]
        roots = [float(r) for r in roots]
    flat *= np.sign(flat[np.arange(len(flat)), np.abs(flat).argmax(axis=1)])[:, None]
    return Whitening(n, sums, flat, roots, shares)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, unit: int) -> tuple[DataFrame, int]:
    """(vec_id, x) of the usable rows as a table, and their dimension: the most frequent length, the larger of ties."""
    v = F.col(vector_col)
    usable = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & (F.size(v) > 0)
    x = F.transform(v, lambda c: F.floor(F.lit(float(unit)) * c.cast("double")).cast("long"))
    rows = written(df.where(usable).select(F.col(id_col).alias("vec_id"), x.alias("x")), "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return rows.where(F.size("x") == d), d


RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 4, unit: int = 256) -> DataFrame:
    """RESULT: one row for each usable vector and component, at most ``most`` components.

    Null vectors, empty ones and those with null or non-finite entries are dropped, and so are those of another length
    than the most frequent one. Entries become floor(unit * entry), held within 64 bits. Repeated rows count once in the
    fit and each come out; null ids come out as null. Components of eigenvalue 0 are not returned: without two distinct
    vectors the result is empty. ``deviation`` is null beyond 38 digits. Of equal eigenvalues any orthonormal basis is
    given, the same for all rows. Other columns are ignored; their names don't matter. The driver holds the scatter, its
    polynomial and one elimination of it, whatever the number of rows: work there grows with the cube of the dimension.
    """
    spark = df.sparkSession
    rows, d = integer_vectors(df, id_col, vector_col, unit)
    if not d:
        return spark.createDataFrame([], RESULT)
    fit = written(rows.select("x").distinct(), "fit")
    model = components(spark, *scatter(fit, d), most)
    names = range(len(model.roots))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = model.project(_matrix(batch.column(0), d))[1]
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in names], [f"w{k}" for k in names])

    error = 0.0
    if model.roots:
        of_fit = fit.select("x").mapInArrow(measured, ", ".join(f"w{k} double" for k in names))
        entries = [F.abs(F.covar_pop(f"w{a}", f"w{b}") - float(a == b)) for a in names for b in names if a <= b]
        error = of_fit.agg(F.greatest(*entries, F.lit(0.0)).alias("e")).first()["e"]

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.roots)
        for batch in batches:
            deviation, w = model.project(_matrix(batch.column(1), d))
            deviation = [v if v < 10**38 else None for v in deviation]
            count = len(deviation)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(count), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * k, model.n, np.int64)), pa.array([v for v in deviation for _ in range(k)], pa.decimal128(38, 0)),
                    pa.array(w.reshape(-1)), pa.array(np.tile(model.explained, count)), pa.array(np.full(count * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(result, RESULT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations beyond 64 bits are null."""
    out = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
