"""Motion scores and motion-adaptive sampling of video frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.folds import fold

#: Pixels whose gray values differ by more than this count as changed.
CHANGED = 18
HIGH, LOW = 0.18, 0.055
#: Frames between samples at high, middle and low motion.
INTERVALS = (4, 12, 24)


def motion_score(previous: Column, current: Column) -> Column:
    """How much two gray images (arrays of 0 to 255) differ, from 0 to 1; without a previous one 1."""
    size = F.size(current).cast("double")
    differences = F.zip_with(previous, current, lambda a, b: F.abs(a - b).cast("double"))
    total = F.aggregate(differences, F.lit(0.0), lambda acc, x: acc + x)
    changed = F.aggregate(differences, F.lit(0), lambda acc, x: acc + (x > CHANGED).cast("int"))
    score = F.least(F.lit(1.0), total / size / 255.0 * 1.8 + changed / size * 0.8)
    return F.when(previous.isNull(), 1.0).otherwise(F.round(score, 4))


def with_motion(frames: DataFrame) -> DataFrame:
    """``frames`` (video_id, index, gray, …) with ``motion_score`` against the frame before, whether that is sampled or not."""
    before = F.lag("gray").over(Window.partitionBy("video_id").orderBy("index"))
    return frames.withColumn("motion_score", motion_score(before, F.col("gray")))


def interval(motion: Column) -> Column:
    """Frames to the next sample at this motion."""
    return F.when(motion >= HIGH, INTERVALS[0]).when(motion >= LOW, INTERVALS[1]).otherwise(INTERVALS[2])


def min_gap(fps: Column) -> Column:
    """The least number of frames between samples; halves go to the even side."""
    return F.greatest(F.lit(1), F.rint(F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(30.0)) * 0.08).cast("int"))


def _sampled(state: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
    video, at, step = row
    last, n = state or (None, 0)
    if last is not None and at - last < step:
        return (last, n), None
    return (at, n + 1), (video, at, n)


def adaptive_sample(frames: DataFrame) -> DataFrame:
    """The frames that sampling keeps, with ``sample_index`` 0 to n - 1: ``frames`` (video_id, index, motion_score, fps, …).

    The first frame stays; a later one stays if its distance from the last kept one is the interval of its own motion
    and the least gap at least. The decision depends on earlier decisions: a video's frames stream through in order, the
    state is the last kept one, and the rows themselves are joined again afterwards.
    """
    step = F.greatest(min_gap(F.col("fps")), interval(F.coalesce("motion_score", F.lit(0.0))))
    narrow = frames.select("video_id", F.col("index").cast("long").alias("index"), step.cast("long").alias("step"))
    kept = fold(narrow, ["video_id"], ["index"], _sampled, f"video_id {frames.schema['video_id'].dataType.simpleString()}, index long, sample_index int")
    return frames.join(kept, ["video_id", "index"])


#: The name that it has for videos of any length, which are no other case any more.
adaptive_sample_long = adaptive_sample
