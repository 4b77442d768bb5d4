"""Metrics of weighted fields: order statistics, stimulated volume, focality, centres.

Weighted quantiles follow the midpoint rule: sort by value, cumulate weights, place each value at
``(cumulated - weight / 2) / total`` and interpolate, clamped at both ends. The cumulated weights of a group can be cut
into value buckets: bucket totals are summed first, each bucket is then cumulated on its own, so one large group is
spread over tasks instead of sorted in one. Quantiles themselves are conditional maxima and minima, which combine
before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxmesh.model import ANCHOR, FRACTIONS, FieldSpec
from fluxmesh.operators import spatial
from fluxmesh.sources.scratch import written


def cumulated(df: DataFrame, spec: FieldSpec, buckets: int = 1) -> DataFrame:
    """``df`` with ``cw`` (weights up to and with the row), ``total`` (the group's) and ``pos``."""
    spec.check(df)
    groups = list(spec.group)
    value, weight = F.col(spec.value).cast("double"), F.col(spec.weight).cast("double")
    if buckets > 1:
        cuts = sorted(set(df.select(value.alias("v")).approxQuantile("v", [k / buckets for k in range(1, buckets)], 0.01)))
        bucket = reduce(lambda a, c: a + (value > c).cast("int"), cuts, F.lit(0))
    else:
        bucket = F.lit(0)
    rows = df.withColumn("_bucket", bucket)
    sums = rows.groupBy(*groups, "_bucket").agg(F.sum(weight).alias("_sum"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    sums = sums.withColumn("total", F.sum("_sum").over(whole)).withColumn("_before", F.sum("_sum").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    order = Window.partitionBy(*groups, "_bucket").orderBy(spec.value, *spec.key).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, [*groups, "_bucket"])
    cw = F.coalesce("_before", F.lit(0.0)) + F.sum(weight).over(order)
    return rows.withColumn("cw", cw).withColumn("pos", F.try_divide(F.col("cw") - weight / 2, F.col("total"))).drop("_bucket", "_before")


def quantile_columns(spec: FieldSpec, quantiles: dict[str, float]) -> list[Column]:
    """Aggregates over ``cumulated`` rows, one for each named quantile."""
    at = F.struct(F.col("pos"), F.col("cw"), F.col(spec.value).cast("double").alias("v"))
    out = []
    for name, q in quantiles.items():
        lo, hi = F.max(F.when(F.col("pos") <= q, at)), F.min(F.when(F.col("pos") > q, at))
        between = lo["v"] + (hi["v"] - lo["v"]) * F.try_divide(F.lit(q) - lo["pos"], hi["pos"] - lo["pos"])
        out.append(F.coalesce(F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(between), lo["v"]).alias(name))
    return out


def weighted_quantiles(df: DataFrame, spec: FieldSpec, percents: list[float], buckets: int = 1) -> DataFrame:
    """One column ``p{percent}`` for each of ``percents`` by group."""
    names = {f"p{p:g}".replace(".", "_"): p / 100 for p in percents}
    return cumulated(df, spec, buckets).groupBy(*spec.group).agg(*quantile_columns(spec, names))


def stimulated_volume(spec: FieldSpec, threshold: Column) -> Column:
    """Weight at or above a threshold."""
    return F.coalesce(F.sum(F.when(F.col(spec.value) >= threshold, F.col(spec.weight).cast("double"))), F.lit(0.0))


def focality(df: DataFrame, spec: FieldSpec, fractions=FRACTIONS, anchor: float = ANCHOR, buckets: int = 1) -> DataFrame:
    """Weight at or above each fraction of the anchor percentile (100: the maximum)."""
    if anchor >= 100:
        anchors = df.groupBy(*spec.group).agg(F.max(F.col(spec.value).cast("double")).alias("anchor"))
    else:
        anchors = cumulated(df, spec, buckets).groupBy(*spec.group).agg(*quantile_columns(spec, {"anchor": anchor / 100}))
    joined = df.join(anchors, list(spec.group)) if spec.group else df.crossJoin(F.broadcast(anchors))
    return joined.groupBy(*spec.group).agg(F.max("anchor").alias("anchor"), *[stimulated_volume(spec, F.lit(f) * F.col("anchor")).alias(f"focality_{f:g}".replace(".", "_")) for f in fractions])


def peak(spec: FieldSpec) -> Column:
    return F.max(F.col(spec.value).cast("double"))


def first_argmax(spec: FieldSpec, what: list[str]) -> Column:
    """Struct of ``what`` in the row with the largest value; of equal values the one with the smallest key."""
    best = F.min(F.struct((-F.col(spec.value).cast("double")).alias("v"), *[F.col(k).alias(f"k_{k}") for k in spec.key], *[F.col(w).alias(w) for w in what]))
    return F.struct(*[best[w].alias(w) for w in what])


def centre_of_gravity(spec: FieldSpec) -> list[Column]:
    mass = F.col(spec.weight).cast("double") * F.col(spec.value)
    return [F.try_divide(F.sum(mass * F.col(p)), F.sum(mass)).alias(f"cog_{p}") for p in spec.position]


def distribution(df: DataFrame, spec: FieldSpec) -> DataFrame:
    """Weighted mean and population deviation by group, the deviation from the mean (not from squares)."""
    w = F.col(spec.weight).cast("double")
    means = df.groupBy(*spec.group).agg(F.try_divide(F.sum(w * F.col(spec.value)), F.sum(w)).alias("mean"))
    joined = df.join(means, list(spec.group)) if spec.group else df.crossJoin(F.broadcast(means))
    off = F.col(spec.value) - F.col("mean")
    return joined.groupBy(*spec.group).agg(F.max("mean").alias("mean"), F.sqrt(F.try_divide(F.sum(w * off * off), F.sum(w))).alias("std"))


def region_summary(df: DataFrame, spec: FieldSpec, percents=(50, 95, 99, 99.9), fractions=FRACTIONS, anchor: float = ANCHOR, buckets: int = 1) -> DataFrame:
    """All metrics of every group: one ordering is shared by the quantiles and the focality anchor.

    Groups of no rows are absent; a group without weight has null ratios.
    """
    return summarized(cumulated(df, spec, buckets), df, spec, percents, fractions, anchor)


def summarized(ordered: DataFrame, rows: DataFrame, spec: FieldSpec, percents=(50, 95, 99, 99.9), fractions=FRACTIONS, anchor: float = ANCHOR) -> DataFrame:
    """The metrics of ``region_summary`` from ``ordered`` rows (with ``cw`` and ``pos``) and the same ``rows`` in any order."""
    names = {f"p{p:g}".replace(".", "_"): p / 100 for p in percents}
    w = F.col(spec.weight).cast("double")
    where = [F.col("at")[p].alias(f"peak_{p}") for p in spec.position]
    head = ordered.groupBy(*spec.group).agg(
        peak(spec).alias("peak"), first_argmax(spec, list(spec.position)).alias("at"), *centre_of_gravity(spec), F.sum(w).alias("volume"),
        F.try_divide(F.sum(w * F.col(spec.value)), F.sum(w)).alias("mean"), *quantile_columns(spec, names | {"anchor": anchor / 100}),
    )
    off = F.col(spec.value) - F.col("mean")
    few = head.select(*spec.group, "mean", "anchor")
    joined = rows.join(few, list(spec.group)) if spec.group else rows.crossJoin(F.broadcast(few))
    foc = [f"focality_{f:g}".replace(".", "_") for f in fractions]
    tail = joined.groupBy(*spec.group).agg(F.sqrt(F.try_divide(F.sum(w * off * off), F.sum(w))).alias("std"), *[stimulated_volume(spec, F.lit(f) * F.col("anchor")).alias(n) for f, n in zip(fractions, foc, strict=True)])
    cogs = [f"cog_{p}" for p in spec.position]
    both = head.join(tail, list(spec.group)) if spec.group else head.crossJoin(F.broadcast(tail))
    return both.select(*spec.group, "peak", *where, *cogs, "volume", "mean", "std", *names, *foc)


# ---- regions of interest ----------------------------------------------------------------------------------------


def squared_distance(position: list[str], target: list[str]) -> Column:
    return sum(((F.col(p) - F.col(t)) * (F.col(p) - F.col(t)) for p, t in zip(position, target, strict=True)), F.lit(0.0))


def resolve_targets(elements: DataFrame, targets: DataFrame, key: str = "e", volume: str = "vol", position=("bx", "by", "bz")) -> DataFrame:
    """``name, e, w``: the elements of each target ``(name, tx, ty, tz, radius)`` with weights that sum to one.

    Radius 0 or less takes the one nearest element (smallest key); else the ball; an empty ball takes all elements at
    the least distance. An element near each target bounds the search, so no target meets elements farther than its
    radius or that bound.
    """
    # Written once: each is read several times, and its plan, repeated, would fill the driver.
    places = written(elements.select(key, volume, *[F.col(c).alias(a) for c, a in zip(position, "xyz", strict=True)]), "places")
    # Cells of about one element, were elements spread evenly over their box.
    spans = [F.max(a) - F.min(a) for a in "xyz"]
    pyramid = spatial.Pyramid.over(places, F.cbrt(spans[0] * spans[1] * spans[2] / F.count("*")))
    if pyramid is None:
        return targets.limit(0).select("name", F.lit(0).cast("int").alias(key), F.lit(0.0).alias("w"))
    aims = targets.select("name", "tx", "ty", "tz", "radius")
    reach = spatial.upper_reach(aims, places, pyramid, "name", ("tx", "ty", "tz"))
    aims = written(aims.join(reach, "name").withColumn("reach", F.greatest("reach", "radius")), "aims")
    boxes = places.select(key, volume, *"xyz", *[F.col(a).alias(f"{n}{a}") for a in "xyz" for n in ("lo", "hi")])
    near = spatial.ball_pairs(aims, boxes, pyramid, ("tx", "ty", "tz")).withColumn("d2", squared_distance(list("xyz"), ["tx", "ty", "tz"]))
    near = written(near.select("name", key, volume, "radius", "d2"), "near")
    least = near.groupBy("name").agg(F.min(F.struct("d2", key)).alias("nearest"), F.sum((F.col("d2") <= F.col("radius") * F.col("radius")).cast("int")).alias("inside"))
    picked = near.join(least, "name").where(
        F.when(F.col("radius") <= 0, F.col(key) == F.col("nearest")[key]).when(F.col("inside") > 0, F.col("d2") <= F.col("radius") * F.col("radius")).otherwise(F.col("d2") == F.col("nearest.d2"))
    )
    total = picked.groupBy("name").agg(F.sum(volume).alias("_total"))
    return picked.join(total, "name").select("name", key, (F.col(volume) / F.col("_total")).alias("w"))


def depth_probes(targets: DataFrame, depths: list[float]) -> DataFrame:
    """Each target moved along its direction by each depth: ``name, depth, tx, ty, tz``."""
    deep = F.explode(F.array(*[F.lit(float(d)) for d in depths])).alias("depth")
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return targets.select("*", deep).select("name", "depth", *[(F.col(f"t{a}") + F.col("depth") * F.col(f"d{a}") / size).alias(f"t{a}") for a in "xyz"])


def roi_means(samples: DataFrame, roi: DataFrame, by: list[str], value: str = "magn", key: str = "e") -> DataFrame:
    """Weighted mean of a field in each region of interest, by ``by``."""
    return samples.join(roi, key).groupBy(*by, "name").agg(F.sum(F.col("w") * F.col(value)).alias("mean"))
