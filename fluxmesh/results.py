"""Results of requests and what is asked of them: fields are written once, every region's metrics come from one sort."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxmesh.model import ANCHOR, TISSUES, FieldSpec, region_tag
from fluxmesh.operators import ensemble, metrics, ordering, recovery
from fluxmesh.sources.scratch import scratch, written

#: Metrics of an element field of a subject.
ELEMENT_FIELD = FieldSpec("magn", "vol", ("p",), ("e",), ("bx", "by", "bz"))
LABELS = [label for _, label, _, _ in TISSUES]


def labelled(elements: DataFrame) -> DataFrame:
    """``elements`` with ``regions``: the label of the tag, and ``all``."""
    label = F.coalesce(*[F.when(F.col("tag") == tag, label) for tag, label, _, _ in TISSUES])
    return elements.withColumn("regions", F.array_compact(F.array(label, F.lit("all"))))


class Regions:
    """Summaries, percentiles and volumes of a field by region; everything but the field itself is made when asked for."""

    def __init__(self, field: DataFrame, elements: DataFrame, spec: FieldSpec, regions: list[str]):
        self.spec, self.regions = spec, regions
        self._field, self._elements = field, elements

    @cached_property
    def rows(self) -> DataFrame:
        """The field with its elements' weights, places and regions, written once."""
        return written(self._field.join(self._elements, list(self.spec.key)), "field")

    @cached_property
    def all_summaries(self) -> DataFrame:
        return written(ordering.regional_summaries(self.rows, self.spec, self.regions), "summaries")

    @cached_property
    def index(self) -> ordering.WeightIndex:
        """The stored index of cumulated weights: one sort, any fraction or percentile later."""
        return ordering.write_index(self.rows, self.spec, self.regions, scratch(self.rows.sparkSession, "index"))

    def check(self, region: str) -> str:
        if region not in self.regions:
            raise ValueError(f"unknown region {region!r}; known: {', '.join(self.regions)}")
        return region

    def summary(self, region: str) -> DataFrame:
        return self.all_summaries.where(F.col("region") == self.check(region))

    def focality(self, fraction: float, region: str, anchor: float = ANCHOR) -> DataFrame:
        keys = self.index.heads.where(F.col("region") == self.check(region)).select(*self.index.keys).distinct()
        return self.index.focality(keys.withColumn("fraction", F.lit(float(fraction))), anchor)

    def percentile(self, percent: float, region: str) -> DataFrame:
        keys = self.index.heads.where(F.col("region") == self.check(region)).select(*self.index.keys).distinct()
        return self.index.quantiles(keys.withColumn("q", F.lit(percent / 100)))


class FieldResult:
    """Fields of placements, ``p, e, magn`` and more, over ``elements(e, vol, bx, by, bz, regions)``.

    Every accessor returns a row for each placement. ``slots(slot, node, tag)`` and ``slot_field(p, slot, ...)`` are there if
    the request kept the nodal field; ``tag`` is absent where slots are nodes.
    """

    def __init__(self, field: DataFrame, elements: DataFrame, mode: str = "raw", spec: FieldSpec = ELEMENT_FIELD, regions: list[str] | None = None, slots: DataFrame | None = None, slot_field: DataFrame | None = None):
        recovery.validate_mode(mode)
        self.mode = mode
        self.magnitude = Regions(field, elements, spec, regions or [*LABELS, "all"])
        self._slots, self._slot_field = slots, slot_field

    def summaries(self) -> DataFrame:
        """All metrics of every placement and region."""
        return self.magnitude.all_summaries

    def summary_for(self, region: str = "gray_matter") -> DataFrame:
        return self.magnitude.summary(region)

    def peak_magn(self, region: str = "gray_matter") -> DataFrame:
        return self.summary_for(region).select("p", "peak")

    def peak_location(self, region: str = "gray_matter") -> DataFrame:
        return self.summary_for(region).select("p", *[f"peak_{c}" for c in self.magnitude.spec.position])

    def center_of_gravity(self, region: str = "gray_matter") -> DataFrame:
        return self.summary_for(region).select("p", *[f"cog_{c}" for c in self.magnitude.spec.position])

    def focality(self, fraction: float = 0.5, region: str = "gray_matter") -> DataFrame:
        """``p, volume``: summaries hold the usual fractions, the index answers any other."""
        name = f"focality_{fraction:g}".replace(".", "_")
        self.magnitude.check(region)
        if name in self.summaries().columns:
            return self.summary_for(region).select("p", F.col(name).alias("volume"))
        return self.magnitude.focality(fraction, region).select("p", "volume")

    def percentile(self, percent: float, region: str = "gray_matter") -> DataFrame:
        return self.magnitude.percentile(percent, region).select("p", "value")

    def nodal_field(self, region: str = "gray_matter") -> DataFrame:
        """The kept slots of one tissue. A field that has two values at a tissue boundary has none for ``all``."""
        if self._slots is None or self._slot_field is None:
            raise ValueError("the request did not keep the nodal field")
        if "tag" not in self._slots.columns:
            if region != "all":
                raise ValueError("slots are nodes: only 'all' names them")
            return self._slot_field.join(self._slots, "slot")
        if region == "all":
            raise ValueError("a node at a tissue boundary has a value for each tissue: name one")
        return self._slot_field.join(self._slots.where(F.col("tag") == region_tag(region)), "slot")


class EnsembleResult:
    """Draws ``p, k, e, magn`` of an ensemble over ``elements``, with the conductivities ``k, tag, sigma``.

    Summaries describe the mean field; values by draw have a row for each placement and draw. ``rois(name, e, w)`` are
    recorded regions of interest.
    """

    def __init__(self, samples: DataFrame, elements: DataFrame, sigmas: DataFrame, spec: FieldSpec = ELEMENT_FIELD, regions: list[str] | None = None, rois: DataFrame | None = None):
        self.spec, self.sigmas, self.rois = spec, sigmas, rois
        self.regions = regions or [*LABELS, "all"]
        self._elements, self._samples = elements, samples

    @cached_property
    def samples(self) -> DataFrame:
        return written(self._samples, "samples")

    @cached_property
    def moments(self) -> DataFrame:
        """``p, e, n, mean, std, cov``."""
        return written(ensemble.moments(self.samples, ["p", *self.spec.key], self.spec.value, ("p",)), "moments")

    @cached_property
    def mean_field(self) -> Regions:
        field = self.moments.select("p", *self.spec.key, F.col("mean").alias(self.spec.value), "cov")
        return Regions(field, self._elements, self.spec, self.regions)

    def summaries(self) -> DataFrame:
        """Metrics of the mean field and ``max_local_cov`` of every placement and region."""
        worst = ordering.members(self.mean_field.rows, self.regions).groupBy("p", "region").agg(F.max("cov").alias("max_local_cov"))
        return self.mean_field.all_summaries.join(worst, ["p", "region"])

    def summary_for(self, region: str = "gray_matter") -> DataFrame:
        return self.summaries().where(F.col("region") == self.mean_field.check(region))

    def peak_mean_magn(self, region: str = "gray_matter") -> DataFrame:
        return self.summary_for(region).select("p", "peak")

    def max_local_cov(self, region: str = "gray_matter") -> DataFrame:
        return self.summary_for(region).select("p", "max_local_cov")

    def _drawn(self, region: str) -> tuple[DataFrame, FieldSpec]:
        if region not in self.regions:
            raise ValueError(f"unknown region {region!r}; known: {', '.join(self.regions)}")
        by = FieldSpec(self.spec.value, self.spec.weight, ("p", "k"), self.spec.key, self.spec.position)
        return self.samples.join(self._elements.where(F.array_contains("regions", region)), list(self.spec.key)), by

    def peak_samples(self, region: str = "gray_matter") -> DataFrame:
        """``p, k, peak`` and its place."""
        rows, by = self._drawn(region)
        best = rows.groupBy("p", "k").agg(metrics.peak(by).alias("peak"), metrics.first_argmax(by, list(by.position)).alias("at"))
        return best.select("p", "k", "peak", *[F.col("at")[c].alias(f"peak_{c}") for c in by.position])

    def focality_samples(self, region: str = "gray_matter", fraction: float = 0.5) -> DataFrame:
        """``p, k, focality``; the elements of a draw are sorted in buckets."""
        rows, by = self._drawn(region)
        name = f"focality_{fraction:g}".replace(".", "_")
        return metrics.focality(rows, by, (fraction,)).select("p", "k", F.col(name).alias("focality"))

    def roi_samples(self, name: str) -> DataFrame:
        """``p, k, mean`` in a recorded region of interest; an unknown name raises."""
        if self.rois is None or not self.rois.where(F.col("name") == name).limit(1).count():
            raise ValueError(f"no region of interest {name!r} was recorded")
        roi = self.rois.where(F.col("name") == name)
        return metrics.roi_means(self.samples, roi, ["p", "k"], self.spec.value).select("p", "k", "mean")

    def tissue_sensitivity(self, output: str = "peak", region: str = "gray_matter") -> DataFrame:
        """``p, tag, share`` of each drawn tissue in the variance of ``peak``, ``focality`` or a recorded region of interest."""
        if output == "peak":
            y = self.peak_samples(region).select("p", "k", F.col("peak").alias("y"))
        elif output == "focality":
            y = self.focality_samples(region).select("p", "k", F.col("focality").alias("y"))
        else:
            y = self.roi_samples(output).select("p", "k", F.col("mean").alias("y"))
        tags = sorted(r.tag for r in self.sigmas.select("tag").distinct().collect())
        wide = self.sigmas.groupBy("k").pivot("tag", tags).agg(F.first("sigma"))
        shares = ensemble.sensitivities(y.join(wide, "k"), ["p"], "y", [str(t) for t in tags])
        return shares.select("p", F.col("name").cast("int").alias("tag"), "share")
