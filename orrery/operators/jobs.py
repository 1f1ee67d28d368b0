"""Reconstruction jobs: modes, frame order and caps, synchronised view groups, parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.scratch import written

MAX_FRAMES = 40
SWIN_THRESHOLD = 20

# Modes by source type, the error of the source types that make no job, and parameter defaults with their types.
MODES = {"image_folder": "multi_view", "single_video": "video_sequence", "video_folder": "synchronized_views"}
MODE_ERRORS = {
    "single_image": "single_view reconstruction is not implemented yet",
    "live_stream": "live streams cannot be converted into reconstruction jobs",
    "unknown": "Unsupported source type: unknown",
}
PARAMS = {
    "model_name": ("string", "naver/MASt3R_ViTLarge_BaseDecoder_512_catmlpdpt_metric"),
    "device": ("string", "auto"),
    "image_size": ("int", 512),
    "pairing_strategy": ("string", "complete"),
    "tsdf_thresh": ("double", 0.0),
    "min_conf_thr": ("double", 1.5),
    "seed": ("bigint", None),
    "dry_run": ("boolean", False),
}


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def with_mode(jobs: DataFrame) -> DataFrame:
    """``jobs`` (source_type, …) with ``mode`` and, where there is none, ``error``."""
    kind = F.col("source_type")
    error = F.coalesce(_lookup(kind, MODE_ERRORS), F.concat(F.lit("Unsupported source type: "), F.coalesce(kind, F.lit("null"))))
    return jobs.withColumn("mode", _lookup(kind, MODES)).withColumn("error", F.when(F.col("mode").isNull(), error))


def frame_order() -> list[Column]:
    """The order of a job's frames: source (none is empty), index, id."""
    return [F.coalesce("source_id", F.lit("")), F.col("index"), F.col("frame_id")]


def job_frames(frames: DataFrame, cap: int = MAX_FRAMES) -> DataFrame:
    """The frames that a job of ordered frames uses: ``frames`` with ``frame_pos`` (order), ``n_frames``, ``output_pos``.

    With more than ``cap`` frames only those with the most motion stay (null is least, then the higher index, then the
    earlier position), in order of that rank; with fewer, the order of the frames is kept.
    """
    job = Window.partitionBy("upload_id")
    by_order, by_motion = job.orderBy(*frame_order()), job.orderBy(F.coalesce("motion_score", F.lit(float("-inf"))).desc(), F.col("index").desc(), "frame_pos")
    placed = frames.withColumn("frame_pos", F.row_number().over(by_order) - 1).withColumn("n_frames", F.count(F.lit(1)).over(job))
    ranked = placed.withColumn("rank", F.row_number().over(by_motion)).filter(F.col("rank") <= cap)
    return ranked.withColumn("output_pos", F.when(F.col("n_frames") > cap, F.col("rank") - 1).otherwise(F.col("frame_pos"))).drop("rank")


def missing_uris(frames: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """(upload_id, error) of jobs with a frame that has no URI, even one that the cap would drop; the first in order is named."""
    lost = F.coalesce("uri", F.lit("")) == ""
    first = F.min_by("frame_id", F.struct(*(order or frame_order())))
    return frames.filter(lost).groupBy("upload_id").agg(first.alias("frame_id")).select("upload_id", F.concat(F.lit("Frame "), "frame_id", F.lit(" is missing a normalized asset URI")).alias("error"))


def pairing(mode: Column, n_frames: Column) -> Column:
    """The recommended pairing: a window for videos and for many views (counted before the cap), else none."""
    return F.when((mode == "video_sequence") | ((mode == "multi_view") & (n_frames > SWIN_THRESHOLD)), "swin")


def resolve_groups(sync_entries: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of each sync entry: (resolved rows, errors) from long entries (upload_id, entry_pos, source_id, index).

    A frame is found by source and index; of several the last position counts; frames without a source match nothing.
    """
    known = frames.filter(F.col("source_id").isNotNull()).groupBy("upload_id", "source_id", "index").agg(F.max_by(F.struct("frame_id", "uri", "motion_score"), "pos").alias("frame"))
    met = written(sync_entries.join(known, ["upload_id", "source_id", "index"], "left"), "job-entries")
    resolved = met.filter("frame is not null").select("upload_id", "entry_pos", "source_id", "index", "frame.frame_id", "frame.uri", "frame.motion_score")
    text = F.concat(F.lit("sync_map references a frame that is not present in the payload: "), "source_id", F.lit("["), F.col("index").cast("string"), F.lit("]"))
    return resolved, met.filter("frame is null").select("upload_id", "entry_pos", text.alias("error"))


def cap_groups(groups: DataFrame, cap: int = MAX_FRAMES) -> DataFrame:
    """``groups`` (upload_id, entry_pos, source_id, index, motion_score, …) without those beyond the cap, with ``group_pos``.

    A job keeps ``cap`` over its mean number of cameras groups, at least one; if there are more, those with the highest
    motion (then the highest index at that motion, not below 0, then the earlier entry) stay, in that order.
    """
    top = F.max(F.struct(F.coalesce("motion_score", F.lit(float("-inf"))).alias("motion"), F.col("index").alias("at"))).alias("top")
    each = groups.groupBy("upload_id", "entry_pos").agg(F.count(F.lit(1)).alias("cameras"), top)
    best_index = F.greatest(F.lit(0), F.col("top.at"))
    job = Window.partitionBy("upload_id")
    ranked = (
        each.withColumn("most", F.greatest(F.lit(1), F.floor(cap / F.avg("cameras").over(job)))).withColumn("n", F.count(F.lit(1)).over(job))
        .withColumn("rank", F.row_number().over(job.orderBy(F.col("top.motion").desc(), best_index.desc(), "entry_pos")) - 1)
        .withColumn("order", F.row_number().over(job.orderBy("entry_pos")) - 1)
    )
    kept = ranked.filter(F.col("rank") < F.col("most")).withColumn("group_pos", F.when(F.col("n") <= F.col("most"), F.col("order")).otherwise(F.col("rank")))
    return groups.join(kept.select("upload_id", "entry_pos", "group_pos"), ["upload_id", "entry_pos"])


def flatten_groups(groups: DataFrame) -> DataFrame:
    """The frames of groups in order of group and source, each (source, frame) once, with ``output_pos``."""
    once = Window.partitionBy("upload_id", "source_id", "frame_id").orderBy("group_pos")
    firsts = groups.withColumn("nth", F.row_number().over(once)).filter("nth = 1").drop("nth")
    return firsts.withColumn("output_pos", F.row_number().over(Window.partitionBy("upload_id").orderBy("group_pos", "source_id")) - 1)


def used_frames(uploads: DataFrame, frames: DataFrame, sync_entries: DataFrame, cap: int = MAX_FRAMES) -> tuple[DataFrame, DataFrame]:
    """(the placed frames that jobs use, error rows (upload_id, step, error)) of ``uploads`` (upload_id, source_type, …).

    Ordered jobs take their frames by ``job_frames``. Jobs of synchronised views take those of their sync entries
    (upload_id, entry_pos, source_id, index): groups are resolved, capped and flattened. A frame without a URI is an
    error (of synchronised views only one that has a source), and so is an entry whose frame isn't there; the first of a
    job is reported. Rows are (upload_id, uri, output_pos, n_frames before the cap, n_groups).
    """
    moded = with_mode(uploads.select("upload_id", "source_type")).filter("mode is not null").select("upload_id", "mode")
    # Errors, groups and jobs all read the frames: they are worked out once.
    known = written(frames.join(moded, "upload_id").select("upload_id", "mode", "source_id", "index", "frame_id", "pos", "uri", "motion_score"), "job-frames")
    ordered, synced = known.filter("mode <> 'synchronized_views'").drop("mode"), known.filter("mode = 'synchronized_views'").drop("mode")
    lost = written(missing_uris(ordered).unionByName(missing_uris(synced.filter(F.col("source_id").isNotNull()), [F.col("pos"), F.col("frame_id")])), "job-lost")
    entries = sync_entries.join(moded.filter("mode = 'synchronized_views'").select("upload_id"), "upload_id", "left_semi").join(lost.select("upload_id"), "upload_id", "left_anti")
    groups, absent = resolve_groups(entries, synced)
    broken = absent.groupBy("upload_id").agg(F.min_by("error", F.struct("entry_pos", "error")).alias("error"))
    errors = lost.select("upload_id", F.lit("frames").alias("step"), "error").unionByName(broken.select("upload_id", F.lit("groups").alias("step"), "error"))
    capped = cap_groups(groups.join(broken.select("upload_id"), "upload_id", "left_anti"), cap)
    counts = synced.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n_frames")).join(capped.groupBy("upload_id").agg(F.count_distinct("entry_pos").alias("n_groups")), "upload_id")
    columns = ["upload_id", "uri", "output_pos", "n_frames", "n_groups"]
    flat = flatten_groups(capped).join(counts, "upload_id").select(*columns)
    plain = job_frames(ordered.join(lost.select("upload_id"), "upload_id", "left_anti"), cap).withColumn("n_groups", F.lit(None).cast("bigint"))
    return plain.select(*columns).unionByName(flat), errors


def assemble(uploads: DataFrame, frames: DataFrame) -> DataFrame:
    """One row for each upload: mode, error, image_uris in order, pairing_strategy, n_frames, sync_group_count.

    ``frames`` are placed ones (``output_pos``, ``n_frames``, and ``n_groups`` where there are synchronised views).
    Uploads without a mode keep their error, others get one if fewer than two images are left.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("output_pos", "uri"))), lambda x: x["uri"])
    groups = F.max("n_groups") if "n_groups" in frames.columns else F.lit(None).cast("bigint")
    each = frames.groupBy("upload_id").agg(listed.alias("image_uris"), F.max("n_frames").alias("n_frames"), groups.alias("sync_group_count"))
    jobs = with_mode(uploads).join(each, "upload_id", "left")
    few = F.coalesce(F.size("image_uris"), F.lit(0)) < 2
    return jobs.select(
        "upload_id", "source_type", "mode", F.coalesce("error", F.when(few, "reconstruction needs at least two images")).alias("error"),
        F.when(F.col("mode").isNotNull(), F.col("image_uris")).alias("image_uris"), F.when(F.col("mode").isNotNull(), F.col("n_frames")).alias("n_frames"), pairing(F.col("mode"), F.col("n_frames")).alias("pairing_strategy"),
        F.when(F.col("mode").isNotNull(), F.col("sync_group_count")).alias("sync_group_count"),
    )


def overlay_params(jobs: DataFrame) -> DataFrame:
    """``jobs`` (recommended, explicit: maps of text) with ``params``: explicit before recommended before the defaults.

    Values that don't have their parameter's type count as not given; keys that aren't parameters are ignored.
    """
    value = lambda k: F.coalesce(F.try_element_at("explicit", F.lit(k)), F.try_element_at("recommended", F.lit(k)))
    return jobs.withColumn("params", F.struct(*[F.coalesce(value(k).try_cast(t), F.lit(d).cast(t)).alias(k) for k, (t, d) in PARAMS.items()]))


def job_label(label: Column, sync_group_id: Column, source_type: Column) -> Column:
    """A job's label: the one given, else its sync group, else its source type; empty ones count as not given."""
    return F.coalesce(F.nullif(label, F.lit("")), F.nullif(sync_group_id, F.lit("")), source_type)
