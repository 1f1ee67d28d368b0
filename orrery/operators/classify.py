"""Classification of uploads and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import item_kind, priority_score

BATCH, LIVE = "track_a_batch", "track_b_live"
MAX_UPLOAD_FILE_BYTES = 512 * 1024 * 1024


def classify_uploads(uploads: DataFrame, items: DataFrame) -> DataFrame:
    """(upload_id, input_type, track, priority_score, reason) of each upload from its items.

    Items repeat a file name at most once for the kinds (the last position wins) but count each time. An upload without
    items is unknown, and so is one with an unknown file, whose names the reason lists in order of their first position.
    """
    named = items.groupBy("upload_id", "filename").agg(F.min("pos").alias("first"), F.max_by(item_kind(F.col("filename"), F.col("mime_type")), "pos").alias("kind"), F.count(F.lit(1)).alias("n"))
    unknown = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "unknown", F.struct("first", "filename")))), lambda x: x["filename"])
    each = named.groupBy("upload_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"), unknown.alias("unknown"))
    met = uploads.select("upload_id").join(each, "upload_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = lambda kind, single, many: F.when(F.col("kinds") == F.array(F.lit(kind)), F.when(F.col("n") == 1, single).otherwise(many))
    kind = F.coalesce(one("single_image", "single_image", "image_folder"), one("single_video", "single_video", "video_folder"), F.lit("unknown"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("kinds", lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "), F.lit("]"))
    reason = (
        F.when(F.col("n") == 0, "empty payload")
        .when(F.size("unknown") > 0, F.concat(F.lit("unsupported file(s): "), F.array_join("unknown", ", ")))
        .otherwise(F.concat(F.col("n").cast("string"), F.lit(" static item(s), kinds="), listed))
    )
    track = F.lit(BATCH)
    return met.select("upload_id", kind.alias("input_type"), track.alias("track"), priority_score(kind, track, F.col("n")).alias("priority_score"), reason.alias("reason"))


def classify_streams(streams: DataFrame) -> DataFrame:
    """``streams`` (stream_id, transport) with input_type, track, priority_score, reason: WebSocket alone is supported."""
    ok = F.lower("transport") == "websocket"
    reason = F.when(ok, F.trim(F.concat(F.lower("transport"), F.lit(" live stream "), F.coalesce(F.col("stream_id").cast("string"), F.lit("")))))
    other = F.concat(F.lit("unsupported live transport="), F.col("transport"), F.lit("; implemented transport=websocket"))
    kind = F.when(ok, "live_stream").otherwise("unknown")
    return streams.select("*", kind.alias("input_type"), F.lit(LIVE).alias("track"), F.lit(1.0).alias("priority_score"), F.coalesce(reason, other).alias("reason"))


def size_guard(items: DataFrame, limit: int = MAX_UPLOAD_FILE_BYTES) -> DataFrame:
    """(upload_id, largest, accepted): an upload is rejected whole if any of its files is larger than ``limit``."""
    return items.groupBy("upload_id").agg(F.max("size_bytes").alias("largest")).withColumn("accepted", F.coalesce(F.col("largest") <= limit, F.lit(True)))
