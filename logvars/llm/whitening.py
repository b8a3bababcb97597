"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become whole numbers, so the scatter matrix is exact.  Its characteristic polynomial is computed
modulo many primes (Hessenberg reduction, primes dealt over tasks) and put together by the Chinese
remainder theorem.  All its roots are real, so Descartes' rule of signs counts those above any bound
exactly; bisection isolates the largest ones and narrows them far below double precision.  Components are
null vectors of the matrix less a root, by inverse iteration in long fixed-point numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed rule of the whole numbers: floor(1024 c) + 100000.
SCALE, SHIFT = 1024, 100_000
#: Digits of a limb: products of two limbs, summed over ``ROWS`` rows, are whole numbers that doubles hold exactly.
LIMB, ROWS = 15, 1 << 20
#: Bits that roots are narrowed to (relative), and bits of the fixed-point numbers of the inverse iteration.
ROOT_BITS, FIXED_BITS = 120, 320
#: Primes of one task of the modular reduction.
PRIMES_AT_ONCE = 16


def whole_numbers(vector: Column) -> Column:
    """floor(1024 c) + 100000 of each entry; null for a vector that is null or holds null or non-finite entries.

    Entries too large for it give the greatest or smallest long.
    """
    good = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    top = float(1 << 61)

    def number(c: Column) -> Column:
        scaled = F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(top)), F.lit(-top)))
        return scaled.cast("long") + F.lit(SHIFT).cast("long")

    return F.when(good, F.transform(vector, number))


def fit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): the rows that remain."""
    x = whole_numbers(F.col(vector_col).cast("array<double>"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0))


def _matrices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            if batch.num_rows:
                yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Signed digits to the base 2^15, as doubles; as many as the values need."""
    out, rest = [], values
    while True:
        digit = ((rest + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
        out.append(digit.astype(np.float64))
        rest = (rest - digit) >> LIMB
        if not rest.any():
            return out


class ExactSums:
    """Sums of rows and of products of entries, exact: partial sums in doubles, totals in whole numbers by limb."""

    def __init__(self, products: bool):
        self.products, self.held = products, {}

    def add(self, values: np.ndarray) -> None:
        limbs = _limbs(values)
        for i, a in enumerate(limbs):
            self._put(("s", i), a.sum(axis=0)[None, :])
            if self.products:
                for j, b in enumerate(limbs):
                    self._put(("p", i + j), a.T @ b)

    def _put(self, key: tuple[str, int], part: np.ndarray) -> None:
        part = part.astype(np.int64)
        self.held[key] = self.held[key] + part if key in self.held else part

    def rows(self) -> pa.RecordBatch:
        kinds, levels, at_i, at_j, sums = [], [], [], [], []
        for (kind, level), part in self.held.items():
            i, j = np.indices(part.shape)
            kinds += [kind] * part.size
            levels += [level] * part.size
            for into, values in ((at_i, i), (at_j, j), (sums, part)):
                into.append(values.ravel())
        columns = [pa.array(kinds, pa.string()), pa.array(levels, pa.int32())]
        columns += [pa.array(np.concatenate(c) if c else [], t) for c, t in ((at_i, pa.int32()), (at_j, pa.int32()), (sums, pa.int64()))]
        return pa.record_batch(columns, names=["kind", "level", "i", "j", "part"])


def exact_sums(rows: DataFrame, centre: list[int], products: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x - ``centre`` and of its products, as Python integers; ``rows`` has x.

    Tasks hand on one number for each pair of dimensions, which Spark adds up; the driver sees d x d sums.
    """
    less = np.array(centre, dtype=np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = ExactSums(products), 0
        for batch, x in _matrices(batches):
            sums.add(x - less)
            n += len(batch)
            if n >= ROWS:  # long before a 64-bit sum could overflow
                yield sums.rows()
                sums, n = ExactSums(products), 0
        yield sums.rows()

    parts = rows.select("x").mapInArrow(add, "kind string, level int, i int, j int, part long")
    totals = parts.groupBy("kind", "level", "i", "j").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    d = len(centre)
    found = {"s": np.zeros((1, d), dtype=object), "p": np.zeros((d, d), dtype=object)}
    for r in totals.collect():
        found[r["kind"]][r["i"], r["j"]] += int(r["total"]) << (LIMB * r["level"])
    return found["s"][0], found["p"]


# --- characteristic polynomial


def is_prime(n: int) -> bool:
    """Exact for n below 3,215,031,751 (Miller-Rabin with the bases 2, 3, 5 and 7)."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds ``bound``."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def coefficient_bound(matrix: np.ndarray) -> int:
    """No coefficient of det(x - M) of a positive semidefinite M is larger (Maclaurin's inequality)."""
    d, trace = len(matrix), max(1, sum(int(matrix[i, i]) for i in range(len(matrix))))
    share = -(-trace // d)
    return max(math.comb(d, k) * share**k for k in range(d + 1))


def hessenberg_polynomials(matrices: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients of det(x - M) modulo each prime, lowest power first; all primes step together.

    Similarity steps bring M to Hessenberg form; the polynomials of its leading blocks follow by a recursion.
    """
    h, p = matrices.copy(), primes[:, None]
    count, d, _ = h.shape
    every = np.arange(count)
    for k in range(d - 2):
        # A row with an entry in this column moves to the place below the diagonal, its column likewise.
        pivot = k + 1 + np.argmax(h[:, k + 1 :, k] != 0, axis=1)
        lower = h[every, pivot].copy()
        h[every, pivot], h[:, k + 1] = h[:, k + 1].copy(), lower
        lower = h[every, :, pivot].copy()
        h[every, :, pivot], h[:, :, k + 1] = h[:, :, k + 1].copy(), lower
        inverse = np.array([pow(int(a), -1, int(q)) if a else 0 for a, q in zip(h[:, k + 1, k], primes, strict=True)])
        factors = h[:, k + 2 :, k] * inverse[:, None] % p
        h[:, k + 2 :] = (h[:, k + 2 :] - factors[:, :, None] * h[:, None, k + 1] % p[:, :, None]) % p[:, :, None]
        # Column k + 1 gains each eliminated column times its factor.
        gained = (factors[:, None, :] * h[:, :, k + 2 :] % p[:, :, None]).sum(axis=2)
        h[:, :, k + 1] = (h[:, :, k + 1] + gained) % p
    blocks = np.zeros((d + 1, count, d + 1), dtype=np.int64)
    blocks[0, :, 0] = 1
    for m in range(1, d + 1):
        made = np.zeros((count, d + 1), dtype=np.int64)
        made[:, 1:] = blocks[m - 1, :, :-1]
        made = (made - h[:, m - 1, m - 1, None] * blocks[m - 1]) % p
        below = np.ones(count, dtype=np.int64)
        for i in range(m - 2, -1, -1):
            below = below * h[:, i + 1, i] % primes
            made = (made - (h[:, i, m - 1] * below % primes)[:, None] * blocks[i]) % p
        blocks[m] = made
    return blocks[d]


def from_residues(residues: list[int], primes: list[int]) -> int:
    """The whole number of smallest size with these residues (products of primes are joined in a tree)."""
    level = [(r % p, p) for r, p in zip(residues, primes, strict=True)]
    while len(level) > 1:
        joined = []
        for (a, m), (b, n) in zip(level[::2], level[1::2], strict=False):
            joined.append((a + m * ((b - a) * pow(m, -1, n) % n), m * n))
        level = joined + level[len(level) // 2 * 2 :]
    value, modulus = level[0]
    return value - modulus if 2 * value > modulus else value


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients of det(x - M), lowest power first, of a positive semidefinite integer matrix.

    The primes are dealt over tasks; the driver joins d + 1 residues for each prime.
    """
    primes = primes_beyond(2 * coefficient_bound(matrix))
    d = len(matrix)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held = whole.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(held), PRIMES_AT_ONCE):
                some = held[at : at + PRIMES_AT_ONCE]
                found = hessenberg_polynomials(np.array([(matrix % int(q)).astype(np.int64) for q in some]), some)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * (d + 1), pa.int32()), pa.array(found.ravel()))
                yield pa.record_batch([pa.array(some), lists], names=["prime", "residues"])

    table = spark.createDataFrame([(q,) for q in primes], "prime long")
    parts = max(1, min(len(primes) // PRIMES_AT_ONCE, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = table.repartition(parts).mapInArrow(reduce, "prime long, residues array<long>").collect()
    by_prime = {r["prime"]: r["residues"] for r in found}
    return [from_residues([by_prime[q][k] for q in primes], primes) for k in range(d + 1)]


# --- roots


def roots_above(coefficients: list[int], bound: int) -> int:
    """How many roots of a polynomial with real roots only lie above ``bound``, repeated ones counted each.

    For such polynomials Descartes' rule is exact: it is the number of changes of sign in p(x + bound).
    """
    shifted = list(coefficients)
    for i in range(len(shifted) - 1):
        for j in range(len(shifted) - 2, i - 1, -1):
            shifted[j] += bound * shifted[j + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def value_at(coefficients: list[int], x: int) -> int:
    total = 0
    for c in reversed(coefficients):
        total = total * x + c
    return total


def largest_roots(coefficients: list[int], count: int, bits: int = ROOT_BITS) -> tuple[list[int], int]:
    """The ``count`` largest roots above 0, falling, repeated ones each, times 2^s; and s.

    Every root lies in (r - w, r] with w below r / 2^bits (or 2^-bits, for roots below 1); roots that no bisection
    parts within that are equal.
    """
    d = len(coefficients) - 1
    s = bits
    scaled = [c << (s * (d - k)) for k, c in enumerate(coefficients)]
    top = 1 << (max(1, -coefficients[d - 1]) << s).bit_length()  # above the trace, so above every root
    above = {0: roots_above(scaled, 0), top: 0}
    found = []

    def wide(low: int, high: int) -> bool:
        return high - low > 1 and (high - low) << bits > high

    for k in range(min(count, above[0])):
        # Bounds known so far around the root of rank k.
        low = max(b for b, n in above.items() if n > k)
        high = min(b for b, n in above.items() if n <= k)
        while above[low] - above[high] > 1 and wide(low, high):
            middle = (low + high) // 2
            above[middle] = roots_above(scaled, middle)
            low, high = (middle, high) if above[middle] > k else (low, middle)
        if above[low] - above[high] == 1:  # isolated: from here the sign decides
            sign = value_at(scaled, high)
            while sign and wide(low, high):
                middle = (low + high) // 2
                here = value_at(scaled, middle)
                if here == 0:
                    high, sign = middle, 0
                elif (here > 0) == (sign > 0):
                    high = middle
                else:
                    low = middle
        found.append(high)
    return found, s


# --- components


def _fixed(values: np.ndarray) -> np.ndarray:
    """Whole numbers nearest to fixed-point products."""
    return (values + (1 << (FIXED_BITS - 1))) >> FIXED_BITS


def _unit(vector: np.ndarray) -> np.ndarray:
    size = math.isqrt(int((vector * vector).sum()))
    return (vector << FIXED_BITS) // max(size, 1)


class ShiftedSystem:
    """LU decomposition of M - r in fixed point, with partial pivoting; an exact 0 as pivot becomes the smallest number."""

    def __init__(self, matrix: np.ndarray, root: int, s: int):
        d, unit = len(matrix), max(root, 1)
        lower = ((matrix << (s + FIXED_BITS)) // unit).astype(object)  # in units of the root
        for i in range(d):
            lower[i, i] -= (root << FIXED_BITS) // unit
        self.order, self.a = list(range(d)), lower
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(self.a[i, k]))
            if best != k:
                self.a[[k, best]] = self.a[[best, k]]
                self.order[k], self.order[best] = self.order[best], self.order[k]
            if self.a[k, k] == 0:
                self.a[k, k] = 1
            if k + 1 < d:
                factors = (self.a[k + 1 :, k] << FIXED_BITS) // self.a[k, k]
                self.a[k + 1 :, k + 1 :] -= _fixed(factors[:, None] * self.a[None, k, k + 1 :])
                self.a[k + 1 :, k] = factors

    def solve(self, right: np.ndarray) -> np.ndarray:
        d, x = len(right), right[self.order].copy()
        for k in range(1, d):
            x[k] -= _fixed((self.a[k, :k] * x[:k]).sum())
        for k in range(d - 1, -1, -1):
            rest = x[k] - (_fixed((self.a[k, k + 1 :] * x[k + 1 :]).sum()) if k + 1 < d else 0)
            x[k] = (rest << FIXED_BITS) // self.a[k, k]
        return x


def null_vectors(matrix: np.ndarray, roots: list[int], s: int) -> list[np.ndarray]:
    """Orthonormal vectors, one for each root, in fixed point.

    Two rounds of inverse iteration shrink everything else by the gap over the root's width, twice.
    Vectors of the same root start from different places and are made orthogonal to each other.
    """
    d, found, system = len(matrix), [], None
    rng = np.random.default_rng(d)
    for i, root in enumerate(roots):
        if system is None or root != roots[i - 1]:
            system, same = ShiftedSystem(matrix, root, s), []
        vector = np.array([int(v) << (FIXED_BITS - 30) for v in rng.integers(-(1 << 30), 1 << 30, d)], dtype=object)
        for _ in range(3):
            vector = _unit(system.solve(vector))
            for _ in range(2):
                for other in same:
                    vector = vector - _fixed(other * _fixed((other * vector).sum()))
            vector = _unit(vector)
        # Either sign would do; the largest entry is positive.
        if vector[max(range(d), key=lambda j: abs(vector[j]))] < 0:
            vector = -vector
        same.append(vector)
        found.append(vector)
    return found


# --- the whole


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def _projection(n: int, centre: list[int], left: list[int], whitened, explained: list[float]):
    """Rows (vec_id, x) to one row for each component; ``left`` is the sum of x - centre."""
    less, names, count = np.array(centre, dtype=np.int64), [c.split()[0] for c in OUT.split(", ")], len(explained)

    def deviations(x: np.ndarray) -> list[int | None]:
        """Exact; in 64 bits where that is sure to be enough, null where the result exceeds them."""
        bound = (int(np.abs(x - less).max()) + 1) * n
        if x.shape[1] * bound * bound < 1 << 63:
            moved = (x - less) * n - np.array(left, dtype=np.int64)
            return (moved * moved).sum(axis=1).tolist()
        rest = np.array(left, dtype=object)
        exact = [int((((row - less).astype(object) * n - rest) ** 2).sum()) for row in x]
        return [v if v < 1 << 63 else None for v in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, 1):
            rows = len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), count))),
                pa.array(np.tile(np.arange(1, count + 1), rows), pa.int32()),
                pa.array(np.full(rows * count, n), pa.int64()),
                pa.array([v for v in deviations(x) for _ in range(count)], pa.int64()),
                pa.array(whitened(x).ravel(), pa.float64()),
                pa.array(np.tile(explained, rows), pa.float64()),
            ]
            yield pa.record_batch(columns, names=names)

    return project


def _identity_error(rows: DataFrame, count: int, whitened) -> float:
    """Largest absolute entry of the covariance of the whitened rows, less the identity."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, np.zeros(count), np.zeros((count, count))
        for _, x in _matrices(batches):
            w = whitened(x)
            here, centred = w.mean(axis=0), w - w.mean(axis=0)
            scatter += centred.T @ centred + np.outer(here - mean, here - mean) * n * len(w) / (n + len(w))
            mean, n = mean + (here - mean) * len(w) / (n + len(w)), n + len(w)
        if n:
            flat = [pa.array([v], pa.list_(pa.float64())) for v in (mean.tolist(), scatter.ravel().tolist())]
            yield pa.record_batch([pa.array([n], pa.int64()), *flat], names=["n", "mean", "scatter"])

    parts = rows.select("x").mapInArrow(moments, "n long, mean array<double>, scatter array<double>")
    # Scatter within tasks plus scatter between their means, summed by Spark entry by entry.
    entries = parts.select("n", "mean", F.posexplode("scatter").alias("at", "within"))
    i, j = F.col("at").cast("int") / count, F.col("at") % count
    a, b = F.get("mean", F.floor(i).cast("int")), F.get("mean", j)
    sums = entries.groupBy("at").agg(
        F.sum("n").alias("n"), F.sum("within").alias("within"), F.sum(F.col("n") * a * b).alias("ab"),
        F.sum(F.col("n") * a).alias("a"), F.sum(F.col("n") * b).alias("b"),
    )
    covariance = (F.col("within") + F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.col("n")
    target = F.when(F.col("at") % (count + 1) == 0, 1.0).otherwise(0.0)
    return sums.agg(F.max(F.abs(covariance - target))).first()[0]


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every remaining row.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and rows whose
    length is not the most frequent one (of equally frequent ones the largest).  Repeated rows and null
    ids stay.  Components of eigenvalue 0, which the polynomial tells exactly, have no scale and are left
    out, so fewer than ``components`` may be returned; rows that are all equal give none.  A deviation
    that exceeds a long is null.  Other columns are not returned.
    """
    spark = vectors.sparkSession
    schema = OUT + ", identity_error double"
    rows = fit_rows(vectors, id_col, vector_col)
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    d, n = length["d"], length["n"]
    rows = rows.where(F.size("x") == d)
    sums, _ = exact_sums(rows, [0] * d, products=False)
    # Centred at the whole number nearest to the mean; what is left of the sum corrects the products exactly.
    centre = [(2 * total + n) // (2 * n) for total in sums]
    left, products = exact_sums(rows, centre, products=True)
    matrix = products * n - np.outer(left, left)  # n^2 times the covariance
    polynomial = characteristic_polynomial(spark, matrix)
    roots, s = largest_roots(polynomial, components)
    if not roots:
        return spark.createDataFrame([], schema)
    units = null_vectors(matrix, roots, s)
    trace = sum(int(matrix[i, i]) for i in range(d))
    # Quotients of whole numbers of any size are rounded once.  Eigenvalues of the covariance are root / (2^s n^2).
    explained = [r / (trace << s) for r in roots]
    scales = [math.sqrt(r / ((n * n) << s)) for r in roots]
    columns = np.array([[int(v) / (1 << FIXED_BITS) for v in vector] for vector in units]).T / np.array(scales)
    less, rest = np.array(centre, dtype=np.int64), np.array([int(r) / n for r in left])

    def whitened(x: np.ndarray) -> np.ndarray:
        return ((x - less).astype(np.float64) - rest) @ columns

    error = _identity_error(rows, len(roots), whitened)
    projection = _projection(n, centre, [int(r) for r in left], whitened, explained)
    return rows.mapInArrow(projection, OUT).withColumn("identity_error", F.lit(float(error)))
