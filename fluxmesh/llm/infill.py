"""Fill-in-the-middle transformation over run-length character classes.

A text is cut at unit boundaries into prefix, middle and suffix, which are written in another order behind sentinels.
The text itself is never split into units: it is stored as its maximal runs of one character class (white space or not)
with the number of units that are complete at each run's end. A cut after ``k`` units is found by a binary search for
the run in which unit ``k`` ends; its place inside that run follows by arithmetic from the run's start and unit width.

Units: ``word`` (white space and the word after it; white space at the end is a unit of its own) or ``char``. Places are
code points.

Rows: a null text is an empty one, which stays plain; so do texts that hold a sentinel. Only the id's decimal digits
(nothing for a null id) and the seed decide cuts and form, so rows that share an id and text come out alike. Texts of
any length are cut whole, in memory of a few bytes a code point; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those that are transformed, and of 100 transformed ones, those with the suffix first.
RATE, SPM_RATE = 50, 80


def class_runs(text: str, unit: str = "word") -> tuple[np.ndarray, np.ndarray]:
    """(end of each maximal run of one class, units complete at that end)."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    ends = np.append(np.flatnonzero(blank[1:] != blank[:-1]) + 1, len(points))
    if unit == "char":
        return ends, ends
    full = ~blank[ends - 1]
    full[-1] = True  # white space at the end of the text is a unit
    return ends, np.cumsum(full)


def cut_place(ends: np.ndarray, units: np.ndarray, k: int, unit: str = "word") -> int:
    """The code points in the first ``k`` units."""
    if k <= 0:
        return 0
    run = int(np.searchsorted(units, k))  # the first run by whose end k units are complete
    before = (int(ends[run - 1]), int(units[run - 1])) if run else (0, 0)
    # A word unit is as wide as the rest of its run, a character unit one code point.
    width = 1 if unit == "char" else int(ends[run]) - before[0]
    return before[0] + (k - before[1]) * width


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers that the seed and id fix."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[at : at + 8], 16) for at in (0, 8, 16, 24))


def transform(text: str, doc_id: int | None, seed: int, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = "word") -> tuple[int, str, str, int | None, int | None]:
    """(units, form, output, code points of the prefix, of the middle)."""
    ends, units = class_runs(text, unit)
    n = int(units[-1]) if len(units) else 0
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", text, None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cut_place(ends, units, low, unit), cut_place(ends, units, high, unit)
    head, middle, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{middle}", a, b - a
    return n, "psm", f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{middle}", a, b - a


def infill(docs: DataFrame, keep_columns: list[str], seed: int = 42, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = "word") -> DataFrame:
    """``keep_columns`` of ``docs(doc_id, text)``, ``n`` units, ``form``, ``output``, ``prefix_chars``, ``middle_chars``."""
    if unit not in ("word", "char"):
        raise ValueError(f"unknown unit {unit!r}")
    types, k = dict(docs.dtypes), len(keep_columns)
    own = docs.select(*[F.col(c).alias(f"own_{c}") for c in keep_columns], F.col("doc_id").cast("long").alias("k_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("k_text"))
    names = [*keep_columns, "n", "form", "output", "prefix_chars", "middle_chars"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        for part in (p for batch in batches for p in slices(batch)):
            rows = [transform(t, i, seed, rate, spm_rate, unit) for i, t in zip(part.column(k).to_pylist(), part.column(k + 1).to_pylist(), strict=True)]
            made = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns[:k], *made], names=names)

    schema = ", ".join([f"`{c}` {types[c]}" for c in keep_columns] + ["n long", "form string", "output string", "prefix_chars long", "middle_chars long"])
    return own.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of: each part stands behind its sentinel."""
    parts = F.split(output, "<[PSM]>")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
