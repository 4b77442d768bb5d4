"""Names and constants of the data model, and the description of a field table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Volume tags, their tissue, conductivity in S/m and its coefficient of variation.
TISSUES = [
    (1, "white_matter", 0.126, 0.15),
    (2, "gray_matter", 0.275, 0.15),
    (3, "csf", 1.654, 0.05),
    (4, "bone", 0.010, 0.35),
    (5, "scalp", 0.465, 0.20),
    (6, "eyes", 0.5, 0.20),
    (7, "compact_bone", 0.008, 0.35),
    (8, "spongy_bone", 0.025, 0.35),
    (9, "blood", 0.6, 0.15),
    (10, "muscle", 0.16, 0.20),
]
SKIN_TAG = 1005
SURFACE_TAGS = [*range(1001, 1011), 1099]
MU0_4PI = 1e-7
FRACTIONS = (0.5, 0.75)
ANCHOR = 99.9


def tissue_table(spark: SparkSession) -> DataFrame:
    """``tag, label, sigma, cov``: ten rows."""
    return spark.createDataFrame(TISSUES, "tag int, label string, sigma double, cov double")


@dataclass(frozen=True)
class FieldSpec:
    """Which columns of a table are the field: value, weight, groups, a unique order key, and the position."""

    value: str
    weight: str
    group: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    position: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)

    def check(self, df: DataFrame) -> None:
        """Raise at once if a column is missing or no order key is given."""
        missing = [c for c in (self.value, self.weight, *self.group, *self.key, *self.position) if c not in df.columns]
        if missing:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        if not self.key:
            raise ValueError("an order key is needed: equal values must have one order")


def region_tag(label: str) -> int:
    """The tag of a tissue label; unknown labels raise."""
    for tag, name, _, _ in TISSUES:
        if name == label:
            return tag
    raise ValueError(f"unknown region {label!r}; known: {', '.join(t[1] for t in TISSUES)}, all")


def region_filter(region: str, tag: str = "tag") -> Column:
    return F.lit(True) if region == "all" else F.col(tag) == region_tag(region)


def clean(c: Column, digits: int) -> Column:
    """Rounded for output, with one zero."""
    return F.round(c, digits) + F.lit(0.0)


def clean_scaled(c: Column, digits: int) -> Column:
    """``clean`` of a double column by scaling, as DuckDB rounds: halves of the scaled value go away from zero. Built-in
    ``round`` goes through decimals, some microseconds a value; it takes values that are too large to scale."""
    scaled = F.abs(c) * float(10**digits)
    low = F.floor(scaled)
    near = (low + F.when(scaled - low >= 0.5, 1).otherwise(0)) / float(10**digits)
    return F.when(scaled < float(2**52), F.when(c < 0, -near).otherwise(near)).otherwise(F.round(c, digits)) + F.lit(0.0)
