"""Order statistics of several regions from one sort, and an index of cumulated weights that answers any of them later.

A row names the regions it lies in, in an array. Rows are cut into value buckets by group and each bucket is sorted
once; running sums of every region ride on that sort. A large group is spread over its buckets. Equal values share a
bucket, so a value that very many rows hold makes one large bucket, sorted with spilling.

The index stores the sorted rows by bucket beside one head for each group, region and bucket. A quantile or a threshold
is located by the heads, and only the bucket it falls into is read.

Rows without a value, weight or group take no part.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fluxmesh.model import ANCHOR, FRACTIONS, FieldSpec
from fluxmesh.operators import metrics
from fluxmesh.sources.scratch import written

#: Value buckets of a group.
BUCKETS = 64


def _whole(df: DataFrame, spec: FieldSpec) -> DataFrame:
    spec.check(df)
    return df.where(F.col(spec.value).isNotNull() & F.col(spec.weight).isNotNull())


def bucketed(df: DataFrame, spec: FieldSpec, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``bucket``, which rises with the value in each group; the cuts are approximate quantiles of the group."""
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    groups, value = list(spec.group), F.col(spec.value).cast("double")
    df = _whole(df, spec)
    if buckets == 1:
        return df.withColumn("bucket", F.lit(0))
    # Written once: it is small, and readers of the buckets would each make it again.
    cuts = written(df.groupBy(*groups).agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 16 * buckets).alias("_cuts")), "cuts")
    rows = df.join(cuts, groups) if groups else df.crossJoin(F.broadcast(cuts))
    # The number of cuts below the value, by halving steps.
    rows = rows.withColumn("bucket", F.lit(0))
    for step in (1 << k for k in reversed(range((buckets - 1).bit_length()))):
        below = F.get("_cuts", F.col("bucket") + (step - 1)) < value
        rows = rows.withColumn("bucket", F.col("bucket") + F.when(below, step).otherwise(0))
    return rows.drop("_cuts")


def _holds(member: str, region: str) -> Column:
    return F.array_contains(member, region)


def members(df: DataFrame, regions: list[str], member: str = "regions") -> DataFrame:
    """``df`` once for each of ``regions`` that holds a row, with ``region``; a name that a row repeats counts once."""
    held = F.array_intersect(F.array_distinct(member), F.array(*[F.lit(r) for r in regions]))
    return df.withColumn("region", F.explode(held)).drop(member)


def ranked(df: DataFrame, spec: FieldSpec, regions: list[str], member: str = "regions", buckets: int = BUCKETS, by_range: bool = False) -> DataFrame:
    """``members`` of ``df`` with ``bucket`` and, among the rows of group and region, ``cw``, ``total`` and ``pos`` as of
    ``metrics.cumulated``. One sort serves all regions; ``by_range`` deals it by ranges of (bucket, group)."""
    if not regions or len(set(regions)) < len(regions):
        raise ValueError("regions must be named, each once")
    groups = list(spec.group)
    parts = [F.when(_holds(member, r), F.col(spec.weight).cast("double")) for r in regions]
    rows = bucketed(df, spec, buckets)
    sums = rows.groupBy(*groups, "bucket").agg(*[F.coalesce(F.sum(w), F.lit(0.0)).alias(f"_s{i}") for i, w in enumerate(parts)])
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Written once and small, so that rows meet it where they are.
    sums = written(sums.select(*groups, "bucket", F.array(*[F.struct(F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0.0)).alias("before"), F.sum(f"_s{i}").over(whole).alias("total")) for i in range(len(regions))]).alias("_sums")), "sums")
    order = Window.partitionBy(*groups, "bucket").orderBy(F.col(spec.value).cast("double"), *spec.key).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.repartitionByRange("bucket", *groups) if by_range else rows
    rows = rows.withColumn("_cw", F.array(*[F.sum(w).over(order) for w in parts])).join(sums, [*groups, "bucket"])
    each = F.filter(F.array(*[F.when(_holds(member, r), F.struct(F.lit(r).alias("region"), (F.col("_sums")[i]["before"] + F.col("_cw")[i]).alias("cw"), F.col("_sums")[i]["total"].alias("total"))) for i, r in enumerate(regions)]), lambda x: x.isNotNull())
    rows = rows.withColumn("_at", F.explode(each))
    pos = F.try_divide(F.col("_at.cw") - F.col(spec.weight).cast("double") / 2, F.col("_at.total"))
    return rows.select("*", "_at.region", "_at.cw", "_at.total", pos.alias("pos")).drop("_at", "_cw", "_sums", member)


def regional_summaries(df: DataFrame, spec: FieldSpec, regions: list[str], member: str = "regions", percents=(50, 95, 99, 99.9), fractions=FRACTIONS, anchor: float = ANCHOR, buckets: int = BUCKETS) -> DataFrame:
    """``metrics.region_summary`` of every group and region, from one sort. A region without rows is absent."""
    by = replace(spec, group=(*spec.group, "region"))
    df = _whole(df, spec)
    return metrics.summarized(ranked(df, spec, regions, member, buckets), members(df, regions, member), by, percents, fractions, anchor)


# ---- stored index -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class WeightIndex:
    """Rows in folders by bucket, and their heads: ``n, weight, before, total, lo, hi, first, last``."""

    rows: DataFrame
    heads: DataFrame
    groups: tuple[str, ...]

    @property
    def keys(self) -> list[str]:
        return [*self.groups, "region"]

    def _bucket_rows(self, wanted: DataFrame) -> DataFrame:
        """The rows of the buckets that ``wanted`` names; the names (at most the buckets of a group) choose folders."""
        names = sorted(r.bucket for r in wanted.select("bucket").distinct().collect())
        return self.rows.where(F.col("bucket").isin(names)) if names else self.rows.where("false")

    def quantiles(self, targets: DataFrame) -> DataFrame:
        """``targets(groups, region, q)``, each row once, with ``value``: the midpoint rule; null where no row is."""
        asked = targets.select(*self.keys, "q").distinct()
        if asked.where("q is null or isnan(q) or q < 0 or q > 1").limit(1).count():
            raise ValueError("a quantile lies between 0 and 1")
        following = Window.partitionBy(*self.keys).orderBy("bucket")
        heads = self.heads.select(*self.keys, "bucket", "first", "last", F.lead("first").over(following).alias("next"))
        at = F.struct("bucket", "first", "last", "next")
        below = F.max(F.when(F.col("first.pos") <= F.col("q"), at))
        found = asked.join(heads, self.keys).groupBy(*self.keys, "q").agg(below.alias("b"), F.min(F.struct("bucket", "first")).alias("least"))
        found = found.withColumn("inside", F.coalesce(F.col("q") < F.col("b.last.pos"), F.lit(False)))
        inner = found.where("inside").select(*self.keys, "q", F.col("b.bucket").alias("bucket"))
        near = inner.join(self._bucket_rows(inner), [*self.keys, "bucket"])
        row = F.struct("pos", "cw", "value")
        near = near.groupBy(*self.keys, "q").agg(F.max(F.when(F.col("pos") <= F.col("q"), row)).alias("lo"), F.min(F.when(F.col("pos") > F.col("q"), row)).alias("hi"))
        outer = found.where("not inside").select(*self.keys, "q", F.col("b.last").alias("lo"), F.when(F.col("b").isNull(), F.col("least.first")).otherwise(F.col("b.next")).alias("hi"))
        lo, hi, q = F.col("lo"), F.col("hi"), F.col("q")
        between = lo["value"] + (hi["value"] - lo["value"]) * F.try_divide(q - lo["pos"], hi["pos"] - lo["pos"])
        value = F.coalesce(F.when(lo.isNull(), F.when(hi["pos"].isNotNull(), hi["value"])).when(hi.isNull(), lo["value"]).otherwise(between), lo["value"])
        return targets.join(near.unionByName(outer).select(*self.keys, "q", value.alias("value")), [*self.keys, "q"], "left")

    def above(self, targets: DataFrame) -> DataFrame:
        """``targets(groups, region, threshold)``, each row once, with ``volume``: the weight at or above the threshold."""
        asked = targets.select(*self.keys, "threshold").distinct()
        met = asked.join(self.heads, self.keys)
        whole = met.where("lo >= threshold").select(*self.keys, "threshold", F.col("weight").alias("part"))
        cut = met.where("lo < threshold and hi >= threshold").select(*self.keys, "threshold", "bucket")
        partly = cut.join(self._bucket_rows(cut), [*self.keys, "bucket"]).where("value >= threshold").select(*self.keys, "threshold", F.col("weight").alias("part"))
        sums = whole.unionByName(partly).groupBy(*self.keys, "threshold").agg(F.sum("part").alias("volume"))
        return targets.join(sums, [*self.keys, "threshold"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))

    def focality(self, targets: DataFrame, anchor: float = ANCHOR) -> DataFrame:
        """``targets(groups, region, fraction)`` with ``anchor`` and ``volume``: weight at or above the fraction of the
        anchor percentile (100: the maximum). Two buckets of a region are read at most."""
        if anchor >= 100:
            tops = self.heads.groupBy(*self.keys).agg(F.max("hi").alias("anchor"))
        else:
            tops = self.quantiles(targets.select(*self.keys).distinct().withColumn("q", F.lit(anchor / 100))).select(*self.keys, F.col("value").alias("anchor"))
        asked = targets.join(tops, self.keys, "left").withColumn("threshold", F.col("fraction") * F.col("anchor"))
        return self.above(asked).drop("threshold")


def write_index(df: DataFrame, spec: FieldSpec, regions: list[str], path: str, member: str = "regions", buckets: int = BUCKETS) -> WeightIndex:
    """Store the index of a field below ``path``. Sorted and written by ranges of (bucket, group), so rows are shuffled once
    and files are about as many as tasks."""
    keys = [*spec.group, "region"]
    rows = ranked(df, spec, regions, member, buckets, by_range=True)
    rows = rows.select(*keys, "bucket", F.col(spec.value).cast("double").alias("value"), F.col(spec.weight).cast("double").alias("weight"), "cw", "total", "pos")
    rows.sortWithinPartitions("bucket", *keys, "cw").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    at = F.struct("pos", "cw", "value")
    heads = stored.groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.max("total").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(at).alias("first"), F.max(at).alias("last"))
    heads.write.mode("overwrite").parquet(f"{path}/heads")
    return open_index(df.sparkSession, path, spec.group)


def open_index(spark: SparkSession, path: str, groups: tuple[str, ...]) -> WeightIndex:
    """An index that ``write_index`` stored."""
    heads = spark.read.parquet(f"{path}/heads")
    schema = StructType([heads.schema[k] for k in (*groups, "region")])
    for name in ("value", "weight", "cw", "total", "pos"):
        schema = schema.add(name, "double")
    return WeightIndex(spark.read.schema(schema.add("bucket", "integer")).parquet(f"{path}/rows"), heads, tuple(groups))
