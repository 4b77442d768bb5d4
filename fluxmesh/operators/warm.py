"""Starts of an ensemble's solves: the nominal solution, corrected by a Galerkin projection onto its sensitivities.

Matrix and right-hand side are linear in the conductivities: ``A(s) = sum s_t A_t``, ``b(s) = sum s_t b_t``. The residual of
the nominal solution x in a draw is then ``sum s_t r_t`` with ``r_t = b_t - A_t x``, and ``dx/ds_t`` solves the nominal system
for ``r_t``. With W a basis of those sensitivities, a draw starts from ``x + W E^-1 W' r(s)``, ``E = W' A W``.

Everything as long as the mesh is done once for each placement: W, ``G = W' r_t`` and E are sums over nodes that combine in
the tasks that hold them. A draw costs a product of matrices as small as the number of tissues. It reads its own
conductivities only, so a start does not depend on what else is drawn.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxmesh.operators import tall

#: Sensitivities are solved to this: they steer a start only.
TOLERANCE = 1e-4
RTOL = 1e-8


def residual_parts(by_tissue: DataFrame, unit_rhs: DataFrame, nominal: DataFrame) -> DataFrame:
    """``p, tag, node, b``: ``b_t - A_t x`` from ``by_tissue(tag, r, c, v)``, ``unit_rhs(p, tag, node, b)`` and ``nominal(p, node, v)``."""
    x = nominal.select("p", F.col("node").alias("c"), F.col("v").alias("x"))
    ax = by_tissue.join(x, "c").groupBy("p", "tag", F.col("r").alias("node")).agg((-F.sum(F.col("v") * F.col("x"))).alias("b"))
    return unit_rhs.select("p", "tag", "node", "b").unionByName(ax.select("p", "tag", "node", "b")).groupBy("p", "tag", "node").agg(F.sum("b").alias("b"))


def orthonormal(sensitivities: DataFrame, tags: list[int], rtol: float = RTOL) -> DataFrame:
    """``p, node, i, w``: for each placement an orthonormal basis of its columns ``sensitivities(p, tag, node, v)``.

    R of each placement comes from a tree of factors; a placement that nothing couples to has an empty basis.
    """
    names = [f"t{t}" for t in tags]
    wide = sensitivities.groupBy("p", "node").agg(*[F.sum(F.when(F.col("tag") == t, F.col("v")).otherwise(0.0)).alias(c) for t, c in zip(tags, names, strict=True)])
    k = len(tags)

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.array(pdf.sort_values("i")["r"].tolist(), float).reshape(-1, k)
        _, s, vt = np.linalg.svd(r)
        kept = int((s > rtol * s[0]).sum()) if len(s) and s[0] > 0 else 0
        m = (vt[:kept].T / s[:kept]) if kept else np.zeros((k, 0))
        return pd.DataFrame({"p": [pdf["p"].iloc[0]] * kept, "i": range(kept), "m": pd.Series([m[:, j].tolist() for j in range(kept)], dtype=object)})

    kind = dict(sensitivities.dtypes)["p"]
    m = tall.tall_factors(wide, names, ("p",)).groupBy("p").applyInPandas(small, f"p {kind}, i int, m array<double>")
    w = F.aggregate(F.zip_with(F.array(*names), F.col("m"), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return wide.join(m, "p").select("p", "node", "i", w.alias("w"))


def projections(basis: DataFrame, by_tissue: DataFrame, tissues: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``p, i, j, e`` of ``W' A W`` at ``tissues(tag, sigma)``, ``p, i, tag, g`` of ``W' r_t``)."""
    nominal = by_tissue.join(F.broadcast(tissues.select("tag", "sigma")), "tag").groupBy("r", "c").agg(F.sum(F.col("sigma") * F.col("v")).alias("v"))
    right = basis.select("p", F.col("node").alias("c"), F.col("i").alias("j"), F.col("w").alias("wj"))
    aw = nominal.join(right, "c").groupBy("p", "j", F.col("r").alias("node")).agg(F.sum(F.col("v") * F.col("wj")).alias("y"))
    e = basis.join(aw, ["p", "node"]).groupBy("p", "i", "j").agg(F.sum(F.col("w") * F.col("y")).alias("e"))
    g = basis.join(parts, ["p", "node"]).groupBy("p", "i", "tag").agg(F.sum(F.col("w") * F.col("b")).alias("g"))
    return e, g


def corrections(e: DataFrame, g: DataFrame, sigmas: DataFrame) -> DataFrame:
    """``p, k, i, c``: ``E^-1 W' r(s)`` of each draw of ``sigmas(k, tag, sigma)``."""

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["i"].max()) + 1
        m = np.zeros((n, n))
        m[pdf["i"], pdf["j"]] = pdf["e"]
        i, j = np.indices((n, n))
        return pd.DataFrame({"p": pdf["p"].iloc[0], "i": i.ravel(), "j": j.ravel(), "inv": np.linalg.inv(m).ravel()})

    kind = dict(e.dtypes)["p"]
    inverse = e.groupBy("p").applyInPandas(invert, f"p {kind}, i int, j int, inv double")
    # E^-1 G is a draw's correction for one unit of each tissue; a draw then only weighs tissues.
    unit = inverse.join(g.select("p", F.col("i").alias("j"), "tag", "g"), ["p", "j"]).groupBy("p", "i", "tag").agg(F.sum(F.col("inv") * F.col("g")).alias("u"))
    return unit.join(sigmas.select("k", "tag", "sigma"), "tag").groupBy("p", "k", "i").agg(F.sum(F.col("sigma") * F.col("u")).alias("c"))


def starts(nominal: DataFrame, basis: DataFrame, correction: DataFrame, sigmas: DataFrame) -> DataFrame:
    """``p, k, node, x0`` of every draw."""
    moved = basis.join(correction, ["p", "i"]).groupBy("p", "k", "node").agg(F.sum(F.col("w") * F.col("c")).alias("d"))
    all_ = nominal.select("p", "node", "v").crossJoin(F.broadcast(sigmas.select("k").distinct()))
    return all_.join(moved, ["p", "k", "node"], "left").select("p", "k", "node", (F.col("v") + F.coalesce("d", F.lit(0.0))).alias("x0"))
