"""The barcode gate on a stream: one hit a frame, whatever the micro-batches its codes come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import identifiers
from ..functions.strings import trimmed
from ..operators.codes import LEAST

HIT = "frame long, id long, raw string"


def _latched(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the least code of a frame; tell it once, when the watermark has passed the frame, and forget it."""
    if state.hasTimedOut:
        best = state.get
        state.remove()
        yield pd.DataFrame([[key[0], *best[:2]]], columns=["frame", "id", "raw"])
        return
    best = state.get if state.exists else None
    for rows in batches:
        rows = rows[rows["hit"]]
        if rows.empty:
            continue
        first = rows.loc[rows["id"].idxmin()]
        if best is None or first["id"] < best[0]:
            best = (int(first["id"]), str(first["raw"]), best[2] if best else 0)
        best = (*best[:2], max(best[2], int(rows["at"].max())))
    if best is not None:
        state.update(best)
        state.setTimeoutTimestamp(max(best[2], state.getCurrentWatermarkMs()) + 1)
    return
    yield  # a generator without rows


def hits(seen: DataFrame, zone: Column, image: tuple[float, float], view: tuple[float, float], late: str = "10 seconds") -> DataFrame:
    """A stream of frame, id and raw: of each frame the code that operators.codes.first_hits finds in a table.

    seen: a stream of frame, id, raw, cx, cy, rotation and ts. A frame's hit is told when the watermark, late behind the newest ts, has
    passed its newest code; codes that come later than that are dropped. One small row of state a frame is kept until then.
    """
    rows = seen.withColumns({"raw": trimmed(F.col("raw")), "ts": F.col("ts").cast("timestamp")}).withWatermark("ts", late)
    hit = identifiers.in_zone(F.col("cx"), F.col("cy"), F.col("rotation"), *map(F.lit, (*image, *view)), zone)
    hit = F.coalesce((F.length("raw") >= LEAST) & hit, F.lit(False))
    # not filtered here: Spark would do that before the watermark, which codes out of the zone move on as well
    marked = rows.select(F.col("frame").cast("long").alias("frame"), F.col("id").cast("long").alias("id"), "raw", "ts", F.unix_millis("ts").alias("at"), hit.alias("hit"))
    return marked.groupBy("frame").applyInPandasWithState(_latched, HIT, "id long, raw string, at long", "append", GroupStateTimeout.EventTimeTimeout)
