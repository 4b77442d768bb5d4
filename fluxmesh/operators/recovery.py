"""Nodal fields from element fields: patches, local fits, and their application.

A slot is a (node, tag): fields jump between tissues, so a node of two tissues has two values. Applying a recovery is a
join and a grouped sum. The weights come from one small dense system a slot, solved for many slots at once in NumPy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxmesh.sources.scratch import written

SMALL_PATCH = 16
MODES = ("raw", "spr_global", "spr_tissue", "harmonic")
# When a fit is rejected.
PIVOT, MOST_WEIGHT, MOST_GAIN = 1e-12, 8.0, 50.0
RUNGS = ((16, 20, 3), (9, 9, 2), (4, 4, 1))


def validate_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown recovery {mode!r}; known: {', '.join(MODES)}")
    return mode


def slot_corners(corners: DataFrame, slots: DataFrame) -> DataFrame:
    """``slot, c, e, i, node, vol``: the corners of each slot."""
    return corners.join(slots, ["node", "tag"]).select("slot", "c", "e", "i", "node", "tag", "vol")


def first_ring(corners: DataFrame, slots: DataFrame) -> DataFrame:
    """``slot, node``: the distinct nodes of the elements at each slot."""
    own = slot_corners(corners, slots).select("slot", "e")
    return own.join(corners.select("e", "node"), "e").select("slot", "node").distinct()


def node_patches(corners: DataFrame, slots: DataFrame, small: int = SMALL_PATCH) -> DataFrame:
    """``slot, node``: the first ring, or where it has fewer than ``small`` nodes the rings of all its slots of the tissue."""
    # Written once: it is read four times, and its plan, repeated, would fill the driver.
    ring = written(first_ring(corners, slots), "ring")
    few = ring.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") < small).select("slot")
    tag = slots.select("slot", "tag")
    beside = ring.join(few, "slot").join(tag, "slot").join(slots.select(F.col("slot").alias("other"), "node", "tag"), ["node", "tag"]).select("slot", "other")
    grown = beside.join(ring.select(F.col("slot").alias("other"), "node"), "other").select("slot", "node")
    return ring.unionByName(grown).distinct()


def volume_means(corners: DataFrame, slots: DataFrame) -> DataFrame:
    """``slot, e, w``: each slot's elements by their volume, or equally if they have none."""
    own = slot_corners(corners, slots).select("slot", "e", "vol")
    total = own.groupBy("slot").agg(F.sum("vol").alias("t"), F.count("*").alias("n"))
    return own.join(total, "slot").select("slot", "e", F.when(F.col("t") > 0, F.col("vol") / F.col("t")).otherwise(1.0 / F.col("n")).alias("w"))


def recover_nodes(weights: DataFrame, field: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``slot, ex, ey, ez``: weighted sums of element vectors."""
    return weights.join(field, "e").groupBy(*by, "slot").agg(*[F.sum(F.col("w") * F.col(f"e{a}")).alias(f"e{a}") for a in "xyz"])


def recover_elements(corners: DataFrame, slots: DataFrame, slot_field: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``e, ex, ey, ez, magn``: means of the four corner slots."""
    own = slot_corners(corners, slots).select("slot", "e")
    m = own.join(slot_field, "slot").groupBy(*by, "e").agg(*[(F.sum(f"e{a}") / 4).alias(f"e{a}") for a in "xyz"])
    return m.withColumn("magn", F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez")))


def nodal_field(nodes: DataFrame, slots: DataFrame, slot_field: DataFrame, tag: int) -> DataFrame:
    """``node, ex, ey, ez`` of one tissue at every node, NaN elsewhere."""
    own = slots.where(F.col("tag") == tag).join(slot_field, "slot").select("node", "ex", "ey", "ez")
    return nodes.select("node").join(own, "node", "left").select("node", *[F.coalesce(f"e{a}", F.lit(float("nan"))).alias(f"e{a}") for a in "xyz"])


# ---- weights ----------------------------------------------------------------------------------------------------


def spr_fit(offsets: np.ndarray) -> np.ndarray | None:
    """Weights of points at ``offsets`` from a node that reproduce linear fields there, or None if no fit is sound."""
    if len(offsets) < 4:
        return None
    h = np.abs(offsets).max()
    if not h > 0:
        return None
    p = np.column_stack([np.ones(len(offsets)), offsets / h])
    a = p.T @ p
    try:
        lower = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return None
    if (np.diag(lower) ** 2).min() <= PIVOT * a[0, 0]:
        return None
    w = p @ np.linalg.solve(a, np.eye(4)[0])
    return w if np.abs(w).sum() <= MOST_WEIGHT else None


def harmonic_basis(u: np.ndarray, v: np.ndarray, t: np.ndarray, degree: int = 3) -> np.ndarray:
    """Real solid harmonics up to a degree, by the recurrence of the Legendre functions in ``t`` and powers of u + iv.

    Columns go by degree, and in a degree from order 1 up with order 0 last, so the linear ones are u, v, t.
    """
    square = u * u + v * v + t * t
    of: dict[tuple[int, int], np.ndarray] = {}
    for m in range(degree + 1):
        of[m, m] = (u + 1j * v) ** m
        for n in range(m, degree):
            of[n + 1, m] = ((2 * n + 1) * t * of[n, m] - (n + m) * square * of.get((n - 1, m), 0)) / (n - m + 1)
    columns = []
    for n in range(degree + 1):
        columns += [part for m in range(1, n + 1) for part in (of[n, m].real, of[n, m].imag)]
        columns.append(of[n, 0].real)
    return np.column_stack(columns)


def harmonic_fit(offsets: np.ndarray) -> tuple[np.ndarray, int]:
    """(gradient weights, degree): the highest rung with enough points and a bounded gain; degree 0 if none fits.

    ``offsets`` are in metres from the slot's node, so the weights turn potentials into gradients per metre.
    """
    h = np.abs(offsets).max() if len(offsets) else 0.0
    if h > 0:
        full = harmonic_basis(*(offsets / h).T)
        for terms, least, degree in RUNGS:
            if len(offsets) < least:
                continue
            p = full[:, :terms]
            a = p.T @ p
            try:
                lower = np.linalg.cholesky(a)
            except np.linalg.LinAlgError:
                continue
            if (np.diag(lower) ** 2).min() <= PIVOT * a[0, 0]:
                continue
            w = p @ np.linalg.solve(a, np.eye(terms)[:, 1:4])
            if np.abs(w).sum(0).max() <= MOST_GAIN:
                return w / h, degree
    return np.zeros((len(offsets), 3)), 0


def spr_weights(corners: DataFrame, slots: DataFrame, nodes: DataFrame, centres: DataFrame, boundary: DataFrame) -> DataFrame:
    """``slot, e, w``: fits to the barycentres of a slot's elements; boundary slots and unsound fits take volume means."""
    own = slot_corners(corners, slots).select("slot", "node", "e", "vol").join(centres, "e").join(nodes, "node")
    own = own.join(boundary.select("node", F.lit(True).alias("edge")), "node", "left").select("slot", "e", "vol", *[((F.col(f"b{a}") - F.col(a))).alias(f"d{a}") for a in "xyz"], F.coalesce("edge", F.lit(False)).alias("edge"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["slot", "e"], kind="stable").reset_index(drop=True)
        out = np.zeros(len(pdf))
        for _, at in pdf.groupby("slot", sort=False).indices.items():
            w = None if pdf["edge"].iat[at[0]] else spr_fit(pdf[["dx", "dy", "dz"]].to_numpy()[at])
            if w is None:
                vol = pdf["vol"].to_numpy()[at]
                w = vol / vol.sum() if vol.sum() > 0 else np.full(len(at), 1 / len(at))
            out[at] = w
        return pdf[["slot", "e"]].assign(w=out)

    return own.withColumn("_g", F.floor(F.col("slot") / 4096)).groupBy("_g").applyInPandas(lambda p: fit(p.drop(columns="_g")), "slot int, e int, w double")


def harmonic_weights(patches: DataFrame, slots: DataFrame, nodes: DataFrame) -> DataFrame:
    """``slot, node, wx, wy, wz, status``: gradient weights of the patch nodes' potentials."""
    at = slots.select("slot", F.col("node").alias("own")).join(nodes.select(F.col("node").alias("own"), *[F.col(a).alias(f"o{a}") for a in "xyz"]), "own")
    rows = patches.join(nodes, "node").join(at, "slot").select("slot", "node", *[((F.col(a) - F.col(f"o{a}")) * 1e-3).alias(f"d{a}") for a in "xyz"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["slot", "node"], kind="stable").reset_index(drop=True)
        out, status = np.zeros((len(pdf), 3)), np.zeros(len(pdf), np.int32)
        points = pdf[["dx", "dy", "dz"]].to_numpy()
        for _, at in pdf.groupby("slot", sort=False).indices.items():
            out[at], status[at] = harmonic_fit(points[at])
        return pdf[["slot", "node"]].assign(wx=out[:, 0], wy=out[:, 1], wz=out[:, 2], status=status)

    return rows.withColumn("_g", F.floor(F.col("slot") / 4096)).groupBy("_g").applyInPandas(lambda p: fit(p.drop(columns="_g")), "slot int, node int, wx double, wy double, wz double, status int")


def harmonic_field(weights: DataFrame, slots: DataFrame, potential: DataFrame, dadt: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``slot, ex, ey, ez``: minus the fitted gradient, minus dA/dt at the node."""
    g = weights.join(potential, "node").groupBy(*by, "slot").agg(*[F.sum(-F.col(f"w{a}") * F.col("v")).alias(f"g{a}") for a in "xyz"])
    at = g.join(slots.select("slot", "node"), "slot").join(dadt, [*by, "node"])
    return at.select(*by, "slot", *[(F.col(f"g{a}") - F.col(f"a{a}")).alias(f"e{a}") for a in "xyz"])
