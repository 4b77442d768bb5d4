"""Moments of an ensemble whose draws arrive as a stream.

Elements are taken in blocks. A block of a placement keeps count, sum and sum of squares of each element as state; it is
emitted once, with its state removed, when all its draws have come. Sources and state are checkpointed and the table is
a file sink, so a restart neither loses a block nor writes it twice. Each draw must come once: an element with more
draws than it should have stops the stream. Draws without a value, and draws of elements that are not listed, take no
part; list their number without them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Element numbers of a block. State of a placement is spread over its blocks.
BLOCK = 1024
_STATE = "e binary, n binary, due binary, s binary, q binary"
_KINDS = ("i8", "i8", "i8", "f8", "f8")


def _add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    e, n, due, s, q = (np.frombuffer(b, t) for b, t in zip(state.get if state.exists else (b"",) * 5, _KINDS, strict=True))
    whole = 0
    for rows in batches:
        if not len(rows):
            continue
        whole = int(rows["due_block"].iloc[0])
        v = rows["magn"].to_numpy("f8")
        e, at = np.unique(np.concatenate([e, rows["e"].to_numpy("i8")]), return_inverse=True)
        add = lambda old, new: np.bincount(at, np.concatenate([old, new]), len(e))  # noqa: E731, B023
        n, s, q = add(n, np.ones(len(v))).astype("i8"), add(s, v), add(q, v * v)
        most = np.zeros(len(e), "i8")
        np.maximum.at(most, at, np.concatenate([due, rows["due"].to_numpy("i8")]))
        due = most
    if (n > due).any():
        raise ValueError(f"element {e[n > due][0]} of placement {key[0]} has more draws than it should")
    if int(n.sum()) < whole:
        state.update(tuple(x.tobytes() for x in (e, n, due, s, q)))
        return
    if state.exists:
        state.remove()
    mean = s / n
    std = np.sqrt(np.maximum(q - n * mean * mean, 0) / np.maximum(n - 1, 1))
    yield pd.DataFrame({"p": key[0], "e": e, "n": n, "mean": mean, "std": std})


def stream_moments(samples: DataFrame, elements: DataFrame, path: str, checkpoint: str, block: int = BLOCK) -> StreamingQuery:
    """Append ``p, e, n, mean, std`` of finished blocks of ``samples(p, e, magn)`` to the table at ``path``.

    ``elements(p, e, due)`` lists the draws to come of each element, or ``elements(e, due)`` those of every placement.
    """
    keys = [c for c in ("p", "e") if c in elements.columns]
    listed = elements.where("due > 0").select(*keys, "due", F.floor(F.col("e") / block).alias("block"))
    blocks = [*keys[:-1], "block"]
    listed = listed.join(listed.groupBy(*blocks).agg(F.sum("due").alias("due_block")), blocks)
    p = samples.schema["p"].dataType.simpleString()
    rows = samples.where("magn is not null").select("p", F.col("e").cast("long").alias("e"), F.col("magn").cast("double").alias("magn"))
    rows = rows.join(listed.withColumn("e", F.col("e").cast("long")), keys)
    done = rows.groupBy("p", "block").applyInPandasWithState(_add, f"p {p}, e long, n long, mean double, std double", _STATE, "append", GroupStateTimeout.NoTimeout)
    return done.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def finished(table: DataFrame, elements: DataFrame) -> DataFrame:
    """``p, e, n, mean, std, cov`` of the placements all of whose elements were emitted, in their order.

    ``cov`` is 0 where the mean is at most 1e-12 of the placement's largest, as of ``ensemble.moments``.
    """
    come = table.groupBy("p").agg(F.count("*").alias("_come"), F.max("mean").alias("_top"))
    listed = elements.where("due > 0")
    if "p" in elements.columns:
        come = come.join(listed.groupBy("p").agg(F.count("*").alias("_all")), "p")
    else:
        come = come.crossJoin(F.broadcast(listed.agg(F.count("*").alias("_all"))))
    whole = table.join(come.where("_come = _all"), "p")
    cov = F.when(F.col("mean") <= 1e-12 * F.col("_top"), F.lit(0.0)).otherwise(F.try_divide("std", "mean"))
    return whole.select("p", "e", "n", "mean", "std", cov.alias("cov")).orderBy("p", "e")
