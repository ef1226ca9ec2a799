"""Whitening of embeddings from the exact spectrum of their integer scatter.

Vectors become integers, so that counts, sums and the scatter are exact whatever the order in which
tasks add them up. The scatter's characteristic polynomial is computed modulo primes, one prime to a row of
a Spark job, and joined by Chinese remaindering, one coefficient to a group; its greatest roots are
isolated in integers, and each root's component comes from inverse iteration in long fixed point."""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm import charpoly as cp
from tunedata.llm.common import materialize

#: Steps of a unit: entries are rounded down to 1 / STEPS.
STEPS = 256
COMPONENTS = 4
#: Sums travel as limbs of so many bits, so that Spark's long sums hold them at any size.
LIMB_BITS = 30


@dataclass(frozen=True)
class Spectrum:
    """``n`` distinct vectors of ``dim`` entries, their exact ``sums``; for each component its unit vector,
    its eigenvalue of the covariance and that eigenvalue's share of the trace."""

    n: int
    dim: int
    sums: list[int]
    vectors: list[list[float]]
    values: list[float]
    shares: list[float]


def usable(vector: Column) -> Column:
    """Neither null nor holding a null, a NaN or an infinity."""
    c = lambda x: x.cast("double")
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(c(x)) & (F.abs(c(x)) < float("inf"))), F.lit(False))


def integral(vector: Column, steps: int = STEPS) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(steps))).cast("bigint"))


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of longs as rows of a matrix; entries beyond a short list's end are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` in integers: in doubles or longs where every partial sum fits, else in Python's integers."""
    top = _largest(a) * _largest(b) * max(a.shape[-1], 1)
    if a.dtype != object and b.dtype != object:
        if top < 1 << 53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        if top < 1 << 62:
            return a @ b
    return a.astype(object) @ b.astype(object)


def exact_sums(fit: DataFrame, dim: int) -> tuple[list[int], list[list[int]]]:
    """Sums per dimension and the matrix of sums of products over ``fit``, exact. Each task adds up its
    rows; limbs of the partial sums, ``dim ** 2 / 2`` times a few per task, are summed by Spark."""
    mask = (1 << LIMB_BITS) - 1

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = matrix_of(batch.column(0).slice(at, 4096), dim)
                total[:dim] += exact_dot(x.T, x).astype(object)
                total[dim] += exact_dot(np.ones((1, len(x)), np.int64), x)[0].astype(object)
        rows = []
        for i in range(dim + 1):
            for j in range(0 if i == dim else i, dim):
                rest, sign, limb = abs(int(total[i, j])), -1 if total[i, j] < 0 else 1, 0
                while rest:
                    rows.append((i, j, limb, sign * (rest & mask)))
                    rest, limb = rest >> LIMB_BITS, limb + 1
        cols = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 3 + [pa.int64()])],
                                         names=["i", "j", "limb", "part"])

    sums = fit.select("x").mapInArrow(partials, "i int, j int, limb int, part bigint")
    full = [[0] * dim for _ in range(dim + 1)]
    # dim ** 2 / 2 numbers of a few limbs: bounded by the dimension, whatever the rows.
    for r in sums.groupBy("i", "j", "limb").agg(F.sum("part").alias("part")).collect():
        full[r["i"]][r["j"]] += r["part"] << (LIMB_BITS * r["limb"])
    for i in range(dim):
        for j in range(i):
            full[i][j] = full[j][i]
    return full[dim], full[:dim]


def exact_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The characteristic polynomial of a positive semidefinite integer matrix, constant first: one
    prime to a row, Hessenberg reduction modulo the prime in the tasks, then one coefficient to a group."""
    dim = len(matrix)
    primes = cp.primes_below(1 << cp.PRIME_BITS, cp.coefficient_bits([matrix[i][i] for i in range(dim)]) // (cp.PRIME_BITS - 1) + 2)

    def residues(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["p"].tolist():
                found = cp.charpoly_mod(np.array([[v % p for v in row] for row in matrix], np.int64), p)
                yield pd.DataFrame({"k": np.arange(dim + 1, dtype=np.int32), "p": p, "r": found})

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": frame["k"][:1], "value": [hex(cp.combine(frame["r"].tolist(), frame["p"].tolist()))]})

    rows = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    found = rows.mapInPandas(residues, "k int, p bigint, r bigint").groupBy("k").applyInPandas(joined, "k int, value string")
    return [int(r["value"], 16) for r in sorted(found.collect(), key=lambda r: r["k"])]


def spectrum(fit: DataFrame, components: int = COMPONENTS) -> Spectrum:
    """Greatest ``components`` eigenvalues and components of the covariance of ``fit (x array<bigint>)``,
    whose rows are distinct. The matrix is ``n * scatter - sums * sums``: the covariance times n ** 2."""
    spark = fit.sparkSession
    size = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 0
    if not dim:
        return Spectrum(n, 0, [], [], [], [])
    sums, products = exact_sums(fit, dim)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    trace = sum(matrix[i][i] for i in range(dim))
    poly = exact_polynomial(spark, matrix)
    roots = cp.top_roots(poly, min(components, dim), trace.bit_length() + cp.GUARD_BITS)
    groups: dict[tuple[int, int], int] = {}
    for at, shift, _ in roots:
        groups[at, shift] = groups.get((at, shift), 0) + 1

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, shift, dim_ in zip(frame["at"], frame["shift"], frame["dim"]):
                for b, v in enumerate(cp.null_basis(matrix, int(at, 16), int(shift), int(dim_))):
                    yield pd.DataFrame({"at": [at], "b": [b], "vector": [v]})

    asked = [(hex(at), shift, count) for (at, shift), count in groups.items() if at > 0]
    vectors = {}
    if asked:
        tasks = spark.createDataFrame(asked, "at string, shift int, dim int").repartition(len(asked))
        for r in tasks.mapInPandas(solve, "at string, b int, vector array<double>").collect():
            vectors[int(r["at"], 16), r["b"]] = r["vector"]
    out = Spectrum(n, dim, sums, [], [], [])
    used: dict[int, int] = {}
    for at, shift, _ in roots:
        b = used[at] = used.get(at, -1) + 1
        out.vectors.append(list(vectors.get((at, b), [0.0] * dim)))
        out.values.append(max(at, 0) / ((n * n) << shift))
        out.shares.append(max(at, 0) / (trace << shift) if trace else 0.0)
    return out


def _project(x: np.ndarray, s: Spectrum) -> np.ndarray:
    """Whitened values, a column per component; NaN where its eigenvalue is 0."""
    centred = x - np.array([v / s.n for v in s.sums])
    out = centred @ np.array(s.vectors).T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.array(s.values) > 0, out / np.sqrt(s.values), np.nan)


def identity_error(fit: DataFrame, s: Spectrum) -> float | None:
    """Largest absolute entry of the whitened fit vectors' covariance less the identity, over the
    components of positive eigenvalue (None without one), as Spark's one-pass centred covariance."""
    live = [k for k, v in enumerate(s.values) if v > 0]
    if not live:
        return None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _project(matrix_of(batch.column(0), s.dim), s)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in live], names=[f"w{k}" for k in live])

    w = fit.select("x").mapInArrow(project, ", ".join(f"w{k} double" for k in live))
    row = w.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a in live for b in live if a <= b]).first()
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a in live for b in live if a <= b)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS, steps: int = STEPS) -> DataFrame:
    """One row per usable vector and component: ``id, component, n, deviation decimal(38,0), whitened,
    explained, identity_error``.

    The fit list holds each distinct integer vector once; a vector that a third of all rows share is one
    row of it, combined before the shuffle. What reaches the driver (products, coefficients, components)
    is bounded by the dimension.

    Defined cases: a vector that is null or holds a null, NaN or infinity has no rows; shorter vectors,
    the empty one too, count 0 beyond their end; ids may be null or repeat, each row gets its own
    results; equal eigenvalues get orthonormal components of their common space; a component of
    eigenvalue 0 (few or equal vectors) has ``whitened`` null and explains 0; a deviation of over 38 digits
    is null; without a usable vector, or with empty ones only, there are no rows; other columns are ignored."""
    rows = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), integral(F.col(vector_col), steps).alias("x"))
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    s = spectrum(fit, components)
    error = identity_error(fit, s) if s.n else None
    count = len(s.values)

    def deviation(x: np.ndarray) -> pa.Array:
        sums = np.array(s.sums, dtype=np.int64 if max(map(abs, s.sums)) < 1 << 62 else object)
        square = ((x if _largest(x) ** 2 * s.dim < 1 << 62 else x.astype(object)) ** 2).sum(axis=1)
        found = s.n * s.n * square.astype(object) - 2 * s.n * exact_dot(x, sums).astype(object) + sum(v * v for v in s.sums)
        return pa.array([decimal.Decimal(v) if v < 10 ** 38 else None for v in found.tolist()], pa.decimal128(38, 0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if count else 0, 4096):
                part = batch.slice(at, 4096)
                x, m = matrix_of(part.column(1), s.dim), part.num_rows
                each = pa.array(np.repeat(np.arange(m), count))
                w = _project(x, s).ravel()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * count, s.n)), deviation(x).take(each), pa.array(w, mask=np.isnan(w)),
                     pa.array(np.tile(s.shares, m)), pa.array([error] * (m * count), pa.float64())],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    id_type = dict(rows.dtypes)["id"]
    return rows.mapInArrow(project, f"id {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, "
                                    "explained double, identity_error double")
