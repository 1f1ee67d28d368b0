"""Alignment of several cameras: clock offsets from motion, nearest frames within a tolerance, conflicts removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.folds import fold
from orrery.sources.scratch import written

MOTION_TOLERANCE = 0.03
BUCKET_MS = 100.0
MIN_VARIANCE = 0.0005
TOLERANCE_MS = 120.0


def usable_frames(frames: DataFrame) -> DataFrame:
    """Frames with a time, of uploads with at least two such sources; ``ts_pos`` orders a source by time, then position."""
    source = Window.partitionBy("upload_id", "source_id")
    columns = ["upload_id", "source_id", "source_order", "pos", "index", "timestamp_ms", "motion_score"]
    timed = frames.filter(F.col("timestamp_ms").isNotNull()).select(*columns).withColumn("ts_pos", F.row_number().over(source.orderBy("timestamp_ms", "pos")))
    return timed.join(timed.groupBy("upload_id").agg(F.countDistinct("source_id").alias("n_sources")).filter("n_sources > 1"), "upload_id")


def anchors(usable: DataFrame) -> DataFrame:
    """(upload_id, anchor): the source with the most frames, the first in source order of equals."""
    each = usable.groupBy("upload_id", "source_id").agg(F.count(F.lit(1)).alias("n"), F.min("source_order").alias("source_order"))
    best = Window.partitionBy("upload_id").orderBy(F.col("n").desc(), "source_order")
    return each.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select("upload_id", F.col("source_id").alias("anchor"))


def offsets(usable: DataFrame, chosen: DataFrame) -> DataFrame:
    """(upload_id, source_id, offset_ms) of every source but the anchor: how far its clock is behind the anchor's.

    Pairs of frames of like motion vote with their time difference. The fullest bucket wins (then the one whose mean is
    nearest to zero, then the first in order of the pairs), and its median is the offset. Sources with fewer than two
    frames, with hardly any variance of motion, or without pairs have none: 0.

    Frames meet through bands of motion as wide as the tolerance, so those of other motion are never paired, and votes are
    summed by bucket before they move. The pairs of a winning bucket are found again through their times alone.
    """
    motion = F.coalesce("motion_score", F.lit(0.0))
    rows = usable.join(chosen, "upload_id").select("upload_id", "source_id", "anchor", "ts_pos", "timestamp_ms", motion.alias("motion"))
    lively = rows.groupBy("upload_id", "source_id", "anchor").agg(F.count(F.lit(1)).alias("n"), F.var_pop("motion").alias("v")).filter((F.col("n") > 1) & (F.col("v") >= MIN_VARIANCE))
    signal = rows.join(lively.select("upload_id", "source_id"), ["upload_id", "source_id"], "left_semi")
    c = signal.filter("source_id <> anchor").select("upload_id", "source_id", F.col("ts_pos").alias("c_pos"), F.col("timestamp_ms").alias("c_ts"), F.col("motion").alias("c_motion"))
    a = signal.filter("source_id = anchor").select("upload_id", F.col("ts_pos").alias("a_pos"), F.col("timestamp_ms").alias("a_ts"), F.col("motion").alias("a_motion"))
    c, a = written(c, "sync-others"), written(a.join(c.select("upload_id", "source_id").distinct(), "upload_id"), "sync-anchor-frames")
    alike = F.abs(F.col("a_motion") - F.col("c_motion")) <= MOTION_TOLERANCE
    beside = lambda at: F.explode(F.sequence(F.floor(at) - 1, F.floor(at) + 1))
    band = 1.000001 * MOTION_TOLERANCE  # rounding must not put frames as far apart as the tolerance two bands apart
    # Few rows make many pairs: fixed partitions by band, which Spark doesn't merge for their few bytes.
    n, by = int(usable.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["upload_id", "source_id", "band"]
    banded = a.withColumn("band", F.floor(F.col("a_motion") / band)).repartition(n, *by).join(c.withColumn("band", beside(F.col("c_motion") / band)).repartition(n, *by), by)
    place = F.col("a_pos").cast("long") * (1 << 31) + F.col("c_pos")
    apart = F.col("a_ts") - F.col("c_ts")
    votes = banded.filter(alike).select("upload_id", "source_id", apart.alias("offset"), place.alias("at")).withColumn("bucket", F.rint(F.col("offset") / BUCKET_MS))
    buckets = votes.groupBy("upload_id", "source_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("offset")).alias("far"), F.min("at").alias("first"))
    winners = written(buckets.groupBy("upload_id", "source_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "far", "first", "bucket")).alias("best")).select("upload_id", "source_id", "best.bucket"), "sync-winners")
    # The exact median holds all values of its group: only the winners' values get there.
    goal = c.join(winners, ["upload_id", "source_id"]).withColumn("slot", beside((F.col("c_ts") + F.col("bucket") * BUCKET_MS) / BUCKET_MS))
    met = a.withColumn("slot", F.floor(F.col("a_ts") / BUCKET_MS)).join(goal, ["upload_id", "source_id", "slot"]).filter(alike & (F.rint(apart / BUCKET_MS) == F.col("bucket")))
    found = met.groupBy("upload_id", "source_id").agg(F.round(F.percentile(apart, F.lit(0.5)), 3).alias("offset_ms"))
    others = rows.filter("source_id <> anchor").select("upload_id", "source_id").distinct()
    return others.join(found, ["upload_id", "source_id"], "left").withColumn("offset_ms", F.coalesce("offset_ms", F.lit(0.0)))


def nearest(usable: DataFrame, chosen: DataFrame, shifts: DataFrame, tolerance_ms: float = TOLERANCE_MS) -> DataFrame:
    """For each anchor frame and other source the frame nearest in time, if it is within the tolerance (included).

    (upload_id, entry_pos, anchor, anchor_index, anchor_ts, source_id, index, offset_ms, n_sources). Of frames as near, the
    earlier one, then the one that comes first. Both sides are dealt into time buckets wider than the tolerance, each
    anchor frame into its own and the two beside it, so the join is on keys and never compares whole sources.
    """
    width = tolerance_ms + 1
    rows = usable.join(chosen, "upload_id")
    a = rows.filter("source_id = anchor").select("upload_id", "anchor", "n_sources", F.col("ts_pos").alias("entry_pos"), F.col("index").alias("anchor_index"), F.col("timestamp_ms").alias("anchor_ts"))
    a = a.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("anchor_ts") / width) - 1, F.floor(F.col("anchor_ts") / width) + 1)))
    c = rows.filter("source_id <> anchor").join(shifts, ["upload_id", "source_id"]).withColumn("adjusted", F.col("timestamp_ms") + F.col("offset_ms"))
    c = c.select("upload_id", "source_id", "index", "offset_ms", "adjusted", "ts_pos", F.floor(F.col("adjusted") / width).alias("bucket"))
    near = a.join(c, ["upload_id", "bucket"]).withColumn("apart", F.abs(F.col("adjusted") - F.col("anchor_ts"))).filter(F.col("apart") <= tolerance_ms)
    best = F.min_by(F.struct("index", "offset_ms"), F.struct("apart", "ts_pos")).alias("best")
    return near.groupBy("upload_id", "entry_pos", "anchor", "anchor_index", "anchor_ts", "n_sources", "source_id").agg(best).select("*", "best.index", "best.offset_ms").drop("best")


def complete_entries(aligned: DataFrame) -> DataFrame:
    """One row for each anchor frame aligned in every source: ``others``, a sorted array of (source_id, index, offset_ms)."""
    gathered = F.array_sort(F.collect_list(F.struct("source_id", "index", "offset_ms"))).alias("others")
    return aligned.groupBy("upload_id", "entry_pos", "anchor", "anchor_index", "anchor_ts", "n_sources").agg(gathered).filter(F.size("others") == F.col("n_sources") - 1)


def _unlike(last: list | None, row: tuple) -> tuple[list, tuple | None]:
    upload, entry, used = row
    if last is not None and any(p == q for p, q in zip(last, used, strict=True)):
        return last, None
    return used, (upload, entry)


def drop_conflicts(entries: DataFrame) -> DataFrame:
    """Entries without those that use a frame of an entry kept before, in anchor order.

    Alignment is monotone in time, so an entry can only share frames with the last one kept, whose frames are the state.
    """
    entries = written(entries, "sync-complete")  # the pass and the join after it both read them
    used = entries.select("upload_id", F.col("entry_pos").cast("long").alias("entry_pos"), F.concat(F.array(F.col("anchor_index")), F.transform("others", lambda o: o["index"])).alias("used"))
    kept = fold(used, ["upload_id"], ["entry_pos"], _unlike, f"upload_id {entries.schema['upload_id'].dataType.simpleString()}, entry_pos long")
    return entries.join(kept, ["upload_id", "entry_pos"])


def sync_map(frames: DataFrame, tolerance_ms: float = TOLERANCE_MS) -> DataFrame:
    """(upload_id, entry_pos, anchor_timestamp_ms, aligned_frames, offsets_ms) of uploads with several sources.

    ``aligned_frames`` maps every source, the anchor too, to a frame index; ``offsets_ms`` maps the other sources.
    """
    usable = written(usable_frames(frames), "sync-frames")  # several steps read it, and its order is worked out once
    chosen = written(anchors(usable), "sync-anchors")
    entries = drop_conflicts(complete_entries(nearest(usable, chosen, offsets(usable, chosen), tolerance_ms)))
    own = F.array(F.struct(F.col("anchor").alias("key"), F.col("anchor_index").alias("value")))
    indexes = F.transform("others", lambda o: F.struct(o["source_id"].alias("key"), o["index"].alias("value")))
    shifts = F.transform("others", lambda o: F.struct(o["source_id"].alias("key"), F.round(o["offset_ms"], 3).alias("value")))
    return entries.select("upload_id", "entry_pos", F.round("anchor_ts", 3).alias("anchor_timestamp_ms"), F.map_from_entries(F.concat(own, indexes)).alias("aligned_frames"), F.map_from_entries(shifts).alias("offsets_ms"))


def long_entries(entries: DataFrame) -> DataFrame:
    """(upload_id, entry_pos, source_id, index) rows of a sync map."""
    return entries.select("upload_id", "entry_pos", F.explode("aligned_frames").alias("source_id", "index"))
