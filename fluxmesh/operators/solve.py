"""Linear solves: one grounded system for many right-hand sides.

The matrix is assembled by Spark, read once as sorted rows and broadcast; its size is checked first. Each right-hand
side is a group of its own (a placement, a draw, a direction) and is solved in one task, so results do not depend on
what else is solved. The preconditioner is the l1 diagonal, or two levels with pairwise aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a matrix that may be broadcast (20 bytes each).
MAX_ENTRIES = 60_000_000
TOLERANCE, MAX_ITERATIONS = 1e-6, 2000
ADJOINT_TOLERANCE, ADJOINT_ITERATIONS = 1e-9, 3000


class SolverConvergenceError(RuntimeError):
    """A system did not reach its tolerance, restart included."""


@dataclass
class Csr:
    """A square matrix in compressed rows, with the node of each row; values may come in several parts (by tag)."""

    nodes: np.ndarray
    ptr: np.ndarray
    idx: np.ndarray
    values: np.ndarray  # (parts, entries)
    tags: tuple[int, ...] = ()

    def combined(self, sigma: dict[int, float] | None = None) -> np.ndarray:
        if sigma is None:
            return self.values.sum(0)
        return sum(sigma[t] * v for t, v in zip(self.tags, self.values, strict=True))


def collect_csr(k: DataFrame, by_tag: bool = False) -> Csr:
    """The matrix ``k(r, c, v)`` (or ``k(tag, r, c, v)``) as compressed rows; raises beyond ``MAX_ENTRIES``."""
    n = k.count()
    if n > MAX_ENTRIES:
        raise ValueError(f"the matrix has {n} entries; at most {MAX_ENTRIES} are broadcast")
    t = k.select(*(["tag"] if by_tag else []), "r", "c", "v").toArrow()
    r, c, v = (t.column(x).to_numpy() for x in ("r", "c", "v"))
    tag = t.column("tag").to_numpy() if by_tag else np.zeros(len(r), np.int64)
    nodes = np.unique(r)
    ri, ci = np.searchsorted(nodes, r), np.searchsorted(nodes, c)
    key = ri.astype(np.int64) * len(nodes) + ci
    pattern, where = np.unique(key, return_inverse=True)
    tags = np.unique(tag)
    values = np.zeros((len(tags), len(pattern)))
    values[np.searchsorted(tags, tag), where] = v
    ptr = np.searchsorted(pattern, np.arange(len(nodes) + 1, dtype=np.int64) * len(nodes))
    if (np.diff(ptr) == 0).any():
        raise ValueError("the matrix has an empty row")
    return Csr(nodes, ptr, (pattern % len(nodes)).astype(np.int64), values, tuple(int(x) for x in tags) if by_tag else ())


def spmv(ptr: np.ndarray, idx: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values * x[idx], ptr[:-1])


def l1_diagonal(ptr: np.ndarray, idx: np.ndarray, values: np.ndarray) -> np.ndarray:
    s = np.add.reduceat(np.abs(values), ptr[:-1])
    return 1.0 / np.where(s == 0, 1.0, s)


def row_ids(ptr: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def compress(n: int, m: int, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of ``n`` by ``m`` entries as ``ptr, idx, values``; equal places are added."""
    key, where = np.unique(r.astype(np.int64) * m + c, return_inverse=True)
    return np.searchsorted(key, np.arange(n + 1, dtype=np.int64) * m), key % m, np.bincount(where, v, len(key))


def product(a: tuple, b: tuple, m: int) -> tuple:
    """``a`` times ``b`` (of ``m`` columns), both compressed: each entry of ``a`` meets the row of ``b`` it points to."""
    ptr, idx, values = b
    width = np.diff(ptr)[a[1]]
    first = np.repeat(ptr[:-1][a[1]] - (np.cumsum(width) - width), width)
    at = np.arange(width.sum()) + first
    return compress(len(a[0]) - 1, m, np.repeat(row_ids(a[0]), width), idx[at], np.repeat(a[2], width) * values[at])


def match(n: int, rows: np.ndarray, cols: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """The partner of each row, itself if alone: rows choose their strongest free neighbour and pair when both do.

    Ties go by the lower pair of ids, so the strongest open pair always chooses each other and every round pairs some.
    """
    partner = np.arange(n)
    live = rows != cols
    rows, cols, strength = rows[live], cols[live], strength[live]
    while len(rows):
        order = np.lexsort((np.maximum(rows, cols), np.minimum(rows, cols), -strength, rows))
        first = order[np.unique(rows[order], return_index=True)[1]]
        choice = np.full(n, -1)
        choice[rows[first]] = cols[first]
        both = first[choice[cols[first]] == rows[first]]
        partner[rows[both]] = cols[both]
        open_ = (partner[rows] == rows) & (partner[cols] == cols)
        rows, cols, strength = rows[open_], cols[open_], strength[open_]
    return partner


def aggregate_pairs(ptr: np.ndarray, idx: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Aggregates of at most four rows: two rounds of pairing, the second between the pairs of the first."""
    agg = np.arange(len(ptr) - 1)
    rows = row_ids(ptr)
    for _ in range(2):
        n = int(agg.max()) + 1
        p, c, v = compress(n, n, agg[rows], agg[idx], np.abs(values))
        partner = match(n, row_ids(p), c, v)
        agg = np.unique(np.minimum(partner, np.arange(n)), return_inverse=True)[1][agg]
    return agg


class Hierarchy:
    """A V-cycle of smoothed aggregates: a symmetric preconditioner of a symmetric positive matrix.

    Levels are added while they shrink and have more than ``coarsest`` rows; the last is solved exactly, or smoothed if
    it stayed larger than that. ``degree`` is the Chebyshev smoother's, over the upper part (from ``low``) of the
    l1-scaled spectrum, which ends at 1; ``omega`` damps the smoothing of the prolongators.
    """

    def __init__(self, ptr, idx, values, coarsest: int = 400, degree: int = 2, low: float = 0.1, omega: float = 4.0 / 3.0):
        self.degree, self.low = degree, low
        self.matrices, self.diagonals, self.down = [(ptr, idx, values)], [l1_diagonal(ptr, idx, values)], []
        while (n := len(self.matrices[-1][0]) - 1) > coarsest:
            a, d = self.matrices[-1], self.diagonals[-1]
            agg = aggregate_pairs(*a)
            m = int(agg.max()) + 1
            if m > 0.8 * n:
                break
            one = 1.0 / np.sqrt(np.bincount(agg, minlength=m))[agg]
            p0 = (np.arange(n + 1), agg, one)
            step = product((a[0], a[1], -omega * d[row_ids(a[0])] * a[2]), p0, m)
            p = compress(n, m, np.concatenate([np.arange(n), row_ids(step[0])]), np.concatenate([agg, step[1]]), np.concatenate([one, step[2]]))
            back = compress(m, n, p[1], row_ids(p[0]), p[2])
            self.down.append((p, back))
            self.matrices.append(product(back, product(a, p, m), m))
            self.diagonals.append(l1_diagonal(*self.matrices[-1]))
        self.inverse = None
        if n <= coarsest:
            dense = np.zeros((n, n))
            p, c, v = self.matrices[-1]
            dense[row_ids(p), c] = v
            self.inverse = np.linalg.inv(dense)

    def levels(self) -> list[tuple[int, int]]:
        """(rows, entries) of each level, the finest first."""
        return [(len(a[0]) - 1, len(a[1])) for a in self.matrices]

    def smooth(self, level: int, r: np.ndarray) -> np.ndarray:
        """A polynomial in the scaled matrix times ``r``, so the cycle stays symmetric."""
        a, d = self.matrices[level], self.diagonals[level]
        mid, half = (1 + self.low) / 2, (1 - self.low) / 2
        rho = half / mid
        p = d * r / mid
        x = p.copy()
        for _ in range(self.degree - 1):
            new = 1 / (2 * mid / half - rho)
            p = new * rho * p + 2 * new / half * d * (r - spmv(*a, x))
            x, rho = x + p, new
        return x

    def __call__(self, r: np.ndarray, level: int = 0) -> np.ndarray:
        if level == len(self.down):
            return self.inverse @ r if self.inverse is not None else self.smooth(level, r)
        a, (p, back) = self.matrices[level], self.down[level]
        x = self.smooth(level, r)
        x = x + spmv(*p, self(spmv(*back, r - spmv(*a, x)), level + 1))
        return x + self.smooth(level, r - spmv(*a, x))


def pcg(ptr, idx, values, b: np.ndarray, tolerance: float = TOLERANCE, most: int = MAX_ITERATIONS, start: np.ndarray | None = None, precondition=None) -> tuple[np.ndarray, int, float]:
    """(solution, iterations, true residual relative to ``b``: the running one drifts below it). A zero right-hand side gives zeros in no iteration; a start
    is measured against ``b`` too."""
    size = float(np.linalg.norm(b))
    if size == 0:
        return np.zeros_like(b), 0, 0.0
    if precondition is None:
        d = l1_diagonal(ptr, idx, values)
        precondition = lambda r: d * r
    x = np.zeros_like(b) if start is None else start.copy()
    r = b - spmv(ptr, idx, values, x) if start is not None else b.copy()
    p, rz, done = np.zeros_like(b), 1.0, 0
    while (rel := float(np.linalg.norm(r)) / size) > tolerance and done < most:
        z = precondition(r)
        new = float(r @ z)
        p = z + (new / rz) * p if done else z
        rz = new
        q = spmv(ptr, idx, values, p)
        alpha = rz / float(p @ q)
        x += alpha * p
        r -= alpha * q
        done += 1
    return x, done, float(np.linalg.norm(b - spmv(ptr, idx, values, x))) / size if done else rel


def solve_or_raise(ptr, idx, values, b, tolerance, most, precondition=None, label="", start: np.ndarray | None = None) -> tuple[np.ndarray, int, float]:
    """Solve; after a failure restart once from the iterate with a preconditioner of its own matrix, then raise."""
    x, n, rel = pcg(ptr, idx, values, b, tolerance, most, start, precondition)
    if rel > tolerance:
        x, more, rel = pcg(ptr, idx, values, b, tolerance, most, x, Hierarchy(ptr, idx, values))
        n += more
        if rel > tolerance:
            raise SolverConvergenceError(f"system {label}: residual {rel:.3g} after {n} iterations, tolerance {tolerance:g}")
    return x, n, rel


def solve(csr: Csr, rhs: DataFrame, by: list[str], tolerance: float = TOLERANCE, most: int = MAX_ITERATIONS, levels: int = 1, sigmas: str | None = None, start: str | None = None) -> DataFrame:
    """``by, node, v, iterations, residual`` of every group of ``rhs(by, node, b)``. ``start`` names a column that each solve
    begins from; it moves a solution within the tolerance only.

    ``levels`` beyond 1 takes the multilevel cycle; with ``sigmas`` each group builds its own. ``sigmas`` names a map column (tag to conductivity, the same in a group's rows) that scales the matrix's parts.
    """
    spark = rhs.sparkSession
    cycle = Hierarchy(csr.ptr, csr.idx, csr.combined()) if levels > 1 and not sigmas else None
    shared = spark.sparkContext.broadcast((csr, cycle))
    types = dict(rhs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", node int, v double, iterations int, residual double"

    def run(t: pa.Table) -> pa.Table:
        m, two = shared.value
        t = t.sort_by("node")
        node, b = t.column("node").to_numpy(), t.column("b").to_numpy()
        values = m.combined(dict(t.column(sigmas)[0].as_py()) if sigmas else None)
        known = np.isin(node, m.nodes)

        def on_rows(values: np.ndarray) -> np.ndarray:
            full = np.zeros(len(m.nodes))
            full[np.searchsorted(m.nodes, node[known])] = values[known]
            return full

        full = on_rows(b)
        first = on_rows(np.nan_to_num(t.column(start).to_numpy())) if start else None
        key = [t.column(c)[0].as_py() for c in by]
        if sigmas and levels > 1:
            two = Hierarchy(m.ptr, m.idx, values)
        x, n, rel = solve_or_raise(m.ptr, m.idx, values, full, tolerance, most, two, str(key), first)
        k = len(m.nodes)
        cols = [pa.array([v] * k, t.schema.field(c).type) for c, v in zip(by, key, strict=True)]
        return pa.Table.from_arrays([*cols, pa.array(m.nodes.astype(np.int32)), pa.array(x), pa.array([n] * k, pa.int32()), pa.array([rel] * k)], names=[*by, "node", "v", "iterations", "residual"])

    return rhs.select(*by, F.col("node").cast("int").alias("node"), "b", *([sigmas] if sigmas else []), *([start] if start else [])).groupBy(*by).applyInArrow(run, schema)


def with_ground(potential: DataFrame, ground: DataFrame, by: list[str]) -> DataFrame:
    """``by, node, v`` with the ground node at zero in every group."""
    groups = potential.select(*by).distinct() if by else None
    zero = ground.select(F.col("ground").cast("int").alias("node"), F.lit(0.0).alias("v"))
    extra = groups.crossJoin(F.broadcast(zero)) if by else zero
    return potential.select(*by, "node", "v").unionByName(extra)
