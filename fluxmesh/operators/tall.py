"""Tall, skinny matrices: QR by a tree of small factors, dominant column spaces.

A matrix is rows with one number column for each of its few columns; ``by`` makes many matrices of one table. Each task
factors its rows a batch at a time and keeps only the square factor R; factors are stacked and factored again, ``FAN`` at
a time, until one is left. R carries the singular values without squaring the matrix's condition, as a Gram matrix would.
Q is never formed by Householder steps: it is the rows times a small matrix, in one more pass of built-in expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Factors that meet in one task; four levels serve a million tasks.
FAN, LEVELS = 32, 4
#: Columns of a matrix whose factors are worth stacking: a factor has their square.
MOST_COLUMNS = 512


def upper_factor(a: np.ndarray) -> np.ndarray:
    """R of ``a = QR`` with a diagonal that is not negative, ``k`` by ``k`` (zero rows below if ``a`` has fewer rows)."""
    k = a.shape[1]
    r = np.linalg.qr(a, mode="r") if len(a) else np.zeros((0, k))
    r = r * np.where(np.diagonal(r) < 0, -1.0, 1.0)[:, None] if len(r) else r
    return np.vstack([r, np.zeros((k - len(r), k))]) if len(r) < k else r


def tall_factors(rows: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``by, i, r``: the rows of each matrix's factor R. A matrix without rows has none."""
    k = len(columns)
    if not 0 < k <= MOST_COLUMNS:
        raise ValueError(f"a tall matrix has 1 to {MOST_COLUMNS} columns")
    types = dict(rows.dtypes)
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    schema = "".join(f"_k{i} {types[c]}, " for i, c in enumerate(by)) + "part int, i int, r array<double>"
    n = len(by)

    def fold(batches):
        held: dict[tuple, np.ndarray] = {}
        kinds = None
        for batch in batches:
            kinds = [f.type for f in batch.schema][:n]
            a = np.asarray(batch.column(n + 1).flatten(), float).reshape(-1, k)
            tags = list(zip(*(batch.column(j).to_pylist() for j in range(n + 1)), strict=True))
            groups: dict[tuple, list[int]] = {}
            for at, tag in enumerate(tags):
                groups.setdefault(tag, []).append(at)
            for tag, at in groups.items():
                held[tag] = upper_factor(np.vstack([held[tag], a[at]]) if tag in held else a[at])
        for tag, r in held.items():
            made = [pa.array([v] * k, kind) for v, kind in zip(tag[:n], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, pa.array([tag[n]] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(r.tolist(), pa.list_(pa.float64()))], names=[*(f"_k{j}" for j in range(n)), "part", "i", "r"])

    vector = F.array(*[F.col(c).cast("double") for c in columns])
    cur = rows.select(*keys, F.spark_partition_id().alias("part"), vector.alias("r")).mapInArrow(fold, schema)
    where = [f"_k{i}" for i in range(n)]
    for _ in range(LEVELS):
        up = cur.select(*where, F.floor(F.col("part") / FAN).cast("int").alias("part"), "r")
        cur = up.repartition(*where, "part").mapInArrow(fold, schema)
    return cur.select(*[F.col(w).alias(c) for w, c in zip(where, by, strict=True)], "i", "r")


def factor(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """R of one matrix, on the driver: as many numbers as the square of its columns."""
    found = {row.i: row.r for row in tall_factors(rows, columns).collect()}
    return np.array([found[i] for i in range(len(columns))]) if found else np.zeros((len(columns), len(columns)))


def times(rows: DataFrame, columns: list[str], keep: list[str], m: np.ndarray, prefix: str = "q") -> DataFrame:
    """``keep`` and the columns of (rows times ``m``) as ``prefix0`` and so on: products of columns with constants."""
    def product(j: int):
        out = F.lit(0.0)
        for c, v in zip(columns, m[:, j].tolist(), strict=True):
            out = out + F.col(c).cast("double") * F.lit(v)
        return out.alias(f"{prefix}{j}")

    return rows.select(*keep, *[product(j) for j in range(m.shape[1])])


def dominant_basis(rows: DataFrame, columns: list[str], keep: list[str], rtol: float = 1e-8) -> tuple[DataFrame, np.ndarray]:
    """(``keep`` with the orthonormal columns ``q0``, ``q1``, ..., all singular values).

    The basis spans the columns but for directions whose singular value is at most ``rtol`` of the largest. Divided by
    small singular values, columns lose digits of orthogonality; a second factorisation restores them.
    """
    _, s, vt = np.linalg.svd(factor(rows, columns))
    kept = int((s > rtol * s[0]).sum()) if len(s) and s[0] > 0 else 0
    m = vt[:kept].T / s[:kept]
    if kept:
        first = times(rows, columns, keep, m, "_q")
        r = factor(first, [f"_q{j}" for j in range(kept)])
        m = m @ np.linalg.inv(r)
    return times(rows, columns, keep, m), s
