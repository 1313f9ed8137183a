"""Nearest rows in time, by buckets of the tolerance's width, and frames of clips found by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: seconds that an approximately sought frame may be away.
BUFFER_S = 0.102


def nearest_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, tolerance: float, left_id: str, right_id: str, output: str = "nearest") -> DataFrame:
    """Adds to every row of `left` the id of the row of `right` with the same keys whose time is nearest, at most `tolerance` away; the smaller id of equally near ones, null where there is none.

    Times fall into cells as wide as the tolerance; a left row looks into its own and both
    neighbouring ones, so it meets only rows within twice the tolerance. `left_id` must be unique.
    """
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    width = F.lit(tolerance)
    near = [F.floor(F.col(left_time) / width) + i for i in (-1, 0, 1)]
    asked = left.select(left_id, *keys, F.col(left_time).alias("_t"), F.explode(F.array(*near)).alias("_cell"))
    there = right.select(*keys, F.floor(F.col(right_time) / width).alias("_cell"), F.col(right_id).alias("_other"), F.col(right_time).alias("_u"))
    away = F.abs(F.col("_t") - F.col("_u"))
    best = asked.join(there, [*keys, "_cell"]).where(away <= width).groupBy(left_id).agg(F.min_by("_other", F.struct(away, "_other")).alias(output))
    return left.join(best, left_id, "left")


def seek_frames(requests: DataFrame, frames: DataFrame, clip: str, request_id: str, time: str, frame: str, pts: str, tolerance: float, strict: bool = True, output: str = "frame") -> DataFrame:
    """The frame nearest to every requested time of a clip. Strict: a request without a frame in reach is an error; else its frame is null."""
    found = nearest_join(requests, frames, [clip], time, pts, tolerance, request_id, frame, output)
    if not strict:
        return found
    missing = F.raise_error(F.concat(F.lit("no frame near request "), F.col(request_id).cast("string")))
    return found.withColumn(output, F.coalesce(F.col(output), missing.cast(found.schema[output].dataType)))


def merge_frames(requests: DataFrame, frames: DataFrame, clip: str, request_id: str, time: str, frame: str, pts: str, buffer: float = BUFFER_S, strict: bool = True, output: str = "frame", cell: float = 60.0) -> DataFrame:
    """Approximate seeking, for clips with missing frames: the frame nearest to every requested time, at most `buffer` seconds away; the earlier of equally near ones.

    Requests and frames of a clip are sorted together once, and each request takes the last frame
    before it or the first after it, so no request is paired with all frames in reach. A clip is
    cut into cells of `cell` seconds that one task merges; frames within the buffer of a border go
    into both cells, which makes cells independent. Of frames with one time the smallest counts.
    Strict: a request without a frame is an error; else its frame is null. Requests without a time
    or a clip have none.
    """
    if not 0 < buffer < cell:
        raise ValueError("buffer must be positive and less than cell")
    kind = frames.schema[frame].dataType
    cell_of = lambda t: F.floor(t / cell)
    here = frames.where(F.col(pts).isNotNull() & F.col(clip).isNotNull()).groupBy(F.col(clip).alias("_clip"), F.col(pts).cast("double").alias("_t")).agg(F.min(frame).alias("_frame"))
    cells = F.array_distinct(F.array(*(cell_of(F.col("_t") + d) for d in (-buffer, 0.0, buffer))))
    here = here.select("_clip", F.explode(cells).alias("_cell"), "_t", F.struct("_t", "_frame").alias("_at"), F.lit(None).cast(requests.schema[request_id].dataType).alias("_id"))
    t = F.col(time).cast("double")
    asked = requests.where(t.isNotNull() & F.col(clip).isNotNull()).select(F.col(clip).alias("_clip"), cell_of(t).alias("_cell"), t.alias("_t"), F.lit(None).cast(here.schema["_at"].dataType).alias("_at"), F.col(request_id).alias("_id"))
    merged = Window.partitionBy("_clip", "_cell").orderBy("_t", F.col("_id").isNotNull())
    before, after = merged.rowsBetween(Window.unboundedPreceding, Window.currentRow), merged.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = here.unionByName(asked).withColumns({"_a": F.last("_at", ignorenulls=True).over(before), "_b": F.first("_at", ignorenulls=True).over(after)}).where("_id is not null")
    away = {c: F.abs(F.col(f"{c}._t") - F.col("_t")) for c in ("_a", "_b")}
    near = {c: F.when(away[c] <= buffer, away[c]) for c in away}
    pick = F.when(near["_a"].isNotNull() & (near["_b"].isNull() | (near["_a"] <= near["_b"])), F.col("_a._frame")).when(near["_b"].isNotNull(), F.col("_b._frame"))
    found = requests.join(both.select(F.col("_id").alias(request_id), pick.cast(kind).alias(output)), request_id, "left")
    if not strict:
        return found
    missing = F.raise_error(F.concat(F.lit("no frame near request "), F.col(request_id).cast("string")))
    return found.withColumn(output, F.coalesce(F.col(output), missing.cast(kind)))


def exact_tolerance(fps: float) -> float:
    """Half a frame and a millisecond."""
    return 0.5 / fps + 0.001


def index_time(index: Column, fps: Column | float) -> Column:
    """Time of the frame with this index."""
    return index / fps
