"""Live rules (their batch forms) and composed plans."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import views
from orrery.operators import jobs, sync
from orrery.plans import pipelines
from orrery.registry.capture import C3, ENTRIES, PLANNED, _video_frames
from orrery.registry.uploads import KIND_SQL, REQUESTS_SQL, _requests
from orrery.sources import media
from orrery.sources.scratch import shared_dir
from orrery.streaming import live

#: A user of the table has at most about a hundred events: smaller limits than those of live use make the rules act.
RING, LIMIT, DAY = 32, 5, 86_400


def i1_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.decide(views.live_frames(spark, sf_dir), RING)


DECIDED = f"""{views.sql(views.LIVE_FRAMES)},
j AS (SELECT *, CASE WHEN payload_bytes > 10485760 THEN 'payload_too_large' WHEN NOT decodable THEN 'invalid_frame' END AS refused FROM live_frames),
n AS (SELECT *, count(*) FILTER (refused IS NULL) OVER (PARTITION BY stream_id ORDER BY arrival_seq) AS upto FROM j),
decided AS (
    SELECT stream_id, arrival_seq, frame_id, payload_bytes, decodable, refused IS NULL AS accepted, coalesce(refused, CASE WHEN upto > {RING} THEN 'drop_oldest' ELSE 'accepted' END) AS action,
           CASE WHEN refused IS NULL THEN upto - 1 END AS sequence, CASE WHEN refused IS NULL AND upto > {RING} THEN 1 ELSE 0 END AS dropped_frames FROM n)"""
I1 = f"{DECIDED} SELECT * FROM decided"


def i2_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.snapshot(i1_decisions(spark, sf_dir), RING)


I2 = f"""{DECIDED}, b AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY sequence DESC) AS back FROM decided WHERE accepted)
SELECT stream_id, frame_id, sequence, count(*) OVER (PARTITION BY stream_id) - back AS slot FROM b WHERE back <= {RING}"""


def i3_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.dropped(i1_decisions(spark, sf_dir), RING)


I3 = f"{DECIDED} SELECT stream_id, count(*) FILTER (accepted) AS accepted, greatest(0, count(*) FILTER (accepted) - {RING}) AS dropped FROM decided GROUP BY 1"


def i4_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.rate_limit(views.requests(spark, sf_dir), LIMIT, DAY)


I4 = f"""{views.sql(views.REQUESTS, recursive=True)},
n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY "at", request_id) AS k FROM requests),
fold AS (
    SELECT subject, request_id, "at", k, true AS allowed, {LIMIT - 1} AS remaining, ["at"] AS held FROM n WHERE k = 1
    UNION ALL
    SELECT n.subject, n.request_id, n."at", n.k, len(list_filter(f.held, lambda t: n."at" - t <= {DAY})) < {LIMIT},
           greatest(0, {LIMIT - 1} - len(list_filter(f.held, lambda t: n."at" - t <= {DAY})))::INTEGER,
           CASE WHEN len(list_filter(f.held, lambda t: n."at" - t <= {DAY})) < {LIMIT} THEN list_append(list_filter(f.held, lambda t: n."at" - t <= {DAY}), n."at") ELSE list_filter(f.held, lambda t: n."at" - t <= {DAY}) END
    FROM fold f JOIN n ON n.subject = f.subject AND n.k = f.k + 1)
SELECT subject, request_id, "at", allowed, remaining FROM fold"""


def _streamed(rows: DataFrame, place: Column, build: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """What ``build`` makes of ``rows`` as a stream of three files, by their ``place`` in it (0, 1 or 2)."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for k in range(3):
        rows.filter(place == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    made = build(source)
    made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")


def i4_rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir)
    third = F.least(F.lit(2), F.floor(F.col("at") / (10 * DAY)))
    return _streamed(r, third, lambda s: live.rate_limit_stream(s, LIMIT, DAY), "live-limit")


def i5_live_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _video_frames(spark, sf_dir)
    third = F.least(F.lit(2), F.floor(F.col("index") / 20))
    return _streamed(f, third, live.adaptive_sample_stream, "live-sample")


def i6_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = views.live_frames(spark, sf_dir).select("stream_id").distinct().withColumn("transport", F.lit("websocket"))
    return live.stream_headers(streams)


I6 = "SELECT DISTINCT user_id AS stream_id, 'live_stream' AS source_type, 'track_b_live' AS track, 1.0::DOUBLE AS compute_priority_score, 64 AS buffer_size, 'websocket' AS transport FROM events"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = views.uploads(spark, sf_dir).select("upload_id", F.col("source_type").alias("input_type"), F.lit("track_a_batch").alias("track"), F.lit(0.25).alias("priority_score"))
    return pipelines.assemble_payloads(classes, views.frames(spark, sf_dir))


def k1_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _payloads(spark, sf_dir)
    camera = lambda c: F.col(f"{c}.camera_intrinsics.focal_length_35mm")
    ends = p.withColumn("a", F.col("frames")[0]).withColumn("z", F.element_at("frames", -1))
    return ends.select("upload_id", "source_type", "frame_count", F.col("resolution.w").alias("w"), F.col("resolution.h").alias("h"), F.col("a.frame_id").alias("first_frame"), F.col("z.frame_id").alias("last_frame"), camera("z").alias("last_f"), F.col("camera_intrinsics.focal_length_35mm").alias("f"))


K1 = f"""{views.sql(views.FRAMES, views.UPLOADS)}
SELECT upload_id, source_type, frame_count, w, h, first_frame, last_frame, fs[len(fs)] AS last_f, CASE WHEN source_type IN ('single_image', 'image_folder') THEN fs[1] END AS f
FROM (SELECT upload_id, source_type, count(*)::INTEGER AS frame_count, min_by(width, pos) AS w, min_by(height, pos) AS h, min_by(frame_id, pos) AS first_frame, max_by(frame_id, pos) AS last_frame, list(focal_length_35mm ORDER BY pos) AS fs
      FROM uploads JOIN frames USING (upload_id) GROUP BY ALL)"""


def a3_payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _payloads(spark, sf_dir)
    payload = p.select(F.col("upload_id").cast("string").alias("upload_id"), *[c for c in p.columns if c != "upload_id"])
    back = media.parse_payload_json(media.to_payload_json(payload))
    frames = back.select("upload_id", F.explode("frames").alias("f"))
    return frames.select("upload_id", "f.frame_id", "f.uri", "f.index", "f.source_id", "f.timestamp_ms", "f.motion_score", F.col("f.resolution.w").alias("w"), F.col("f.camera_intrinsics.focal_length_35mm").alias("f35"))


A3 = f"""{views.sql(views.FRAMES)} SELECT upload_id::VARCHAR AS upload_id, frame_id, uri, "index", source_id, timestamp_ms, motion_score, width AS w, focal_length_35mm AS f35 FROM frames"""


def a7_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = views.table(spark, sf_dir, "orders").select(
        k.cast("string").alias("job_id"), F.lit("multi_view").alias("mode"), F.array(F.concat(F.lit("a"), k), F.lit("b")).alias("image_paths"), F.lit("out").alias("output_dir"), F.concat(F.lit("out/"), k, F.lit(".glb")).alias("output_path"),
        F.when(k % 2 == 0, F.create_map(F.lit("image_size"), F.lit("224"))).alias("explicit"), F.lit(None).cast("map<string,string>").alias("recommended"), (k % 3).cast("int").alias("sync_group_count"),
    )
    return media.run_manifests(jobs.overlay_params(o))


A7 = """
SELECT o_orderkey::VARCHAR AS job_id, '{"backend":"mast3r","device":"auto","dry_run":false,"image_paths":["a' || o_orderkey || '","b"],"image_size":' || CASE WHEN o_orderkey % 2 = 0 THEN 224 ELSE 512 END
       || ',"job_id":"' || o_orderkey || '","min_conf_thr":1.5,"mode":"multi_view","model_name":"naver/MASt3R_ViTLarge_BaseDecoder_512_catmlpdpt_metric","output_dir":"out","output_path":"out/' || o_orderkey
       || '.glb","pairing_strategy":"complete",' || CASE WHEN o_orderkey % 3 > 0 THEN '"sync_group_count":' || o_orderkey % 3 || ',"sync_pairing_enabled":true,' ELSE '' END || '"tsdf_thresh":0.0}' AS manifest
FROM orders"""


def a2_payload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/payloads-{uuid.uuid4().hex}"
    p = _payloads(spark, sf_dir)
    media.write_payloads(p.select(F.col("upload_id").cast("string").alias("upload_id"), *[c for c in p.columns if c != "upload_id"]), f"{folder}/good")
    # Files with a payload that breaks the contract, and with one that is no JSON.
    spark.range(2).select(F.when(F.col("id") == 0, F.lit('{"upload_id": "x1", "source_type": "single_image", "track": "track_z", "compute_priority_score": 0.5}')).otherwise(F.lit("{no json")).alias("value")).write.text(f"{folder}/bad")
    good, bad = media.checked_payloads(media.read_payloads(spark, f"{folder}/*/*"))
    kept = good.select("upload_id", "source_type", F.size("frames").cast("long").alias("frames"), F.lit(0).alias("refused"))
    return kept.unionByName(bad.agg(F.lit(None).cast("string").alias("upload_id"), F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("long").alias("frames"), F.count(F.lit(1)).cast("int").alias("refused")))


A2 = f"""{views.sql(views.FRAMES, views.UPLOADS)}
SELECT upload_id::VARCHAR AS upload_id, source_type, count(*) AS frames, 0 AS refused FROM uploads JOIN frames USING (upload_id) GROUP BY ALL
UNION ALL SELECT NULL, NULL, NULL, 2"""


def p1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.media_items(spark, sf_dir)
    p = pipelines.ingest(items.select("upload_id").distinct(), items, views.frames(spark, sf_dir).withColumn("fps", F.lit(12.0)))
    return p.select("upload_id", "source_type", "frame_count", F.coalesce(F.size("sync_map"), F.lit(0)).alias("sync_entries"), F.col("sync_group_id").isNotNull().alias("grouped"))


_ALL = views.FRAMES.replace("frames AS (", "decoded AS (", 1)
_SAMPLED = f"""{views.MEDIA_ITEMS},
named AS (SELECT upload_id, filename, max_by({KIND_SQL}, pos) AS kind, count(*) AS n, max(size_bytes) AS largest FROM media_items GROUP BY ALL),
grouped AS (SELECT upload_id, sum(n) AS n, list_sort(list(DISTINCT kind)) AS kinds FROM named GROUP BY 1 HAVING max(largest) <= 536870912),
classes AS (
    SELECT upload_id, CASE WHEN kinds = ['single_image'] THEN CASE WHEN n = 1 THEN 'single_image' ELSE 'image_folder' END
                           WHEN kinds = ['single_video'] THEN CASE WHEN n = 1 THEN 'single_video' ELSE 'video_folder' END END AS source_type FROM grouped),
steps AS (
    SELECT d.*, row_number() OVER (PARTITION BY upload_id, source_id ORDER BY "index") AS nth,
           CASE WHEN coalesce(motion_score, 0) >= 0.18 THEN 4 WHEN coalesce(motion_score, 0) >= 0.055 THEN 12 ELSE 24 END AS step FROM decoded d JOIN classes USING (upload_id)),
walk AS (
    SELECT upload_id, source_id, nth, true AS kept, "index" AS last FROM steps WHERE nth = 1
    UNION ALL
    SELECT s.upload_id, s.source_id, s.nth, s."index" - w.last >= s.step, CASE WHEN s."index" - w.last >= s.step THEN s."index" ELSE w.last END
    FROM walk w JOIN steps s ON s.upload_id = w.upload_id AND s.source_id = w.source_id AND s.nth = w.nth + 1),
frames AS (
    SELECT s.* EXCLUDE (nth, step) FROM steps s JOIN classes USING (upload_id) LEFT JOIN walk w USING (upload_id, source_id, nth)
    WHERE source_type IS NOT NULL AND (w.kept OR source_type NOT IN ('single_video', 'video_folder')))"""
P1 = f"""{ENTRIES.replace(views.FRAMES, _ALL + "," + _SAMPLED)}
SELECT upload_id, source_type, coalesce(n, 0)::INTEGER AS frame_count, CASE WHEN source_type = 'video_folder' THEN coalesce(m, 0) ELSE 0 END::INTEGER AS sync_entries, source_type = 'video_folder' AS grouped
FROM classes LEFT JOIN (SELECT upload_id, count(*) AS n FROM frames GROUP BY 1) USING (upload_id) LEFT JOIN (SELECT upload_id, count(*) AS m FROM kept GROUP BY 1) USING (upload_id)
WHERE source_type IS NOT NULL"""


def p2_plan_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, f = views.uploads(spark, sf_dir), views.frames(spark, sf_dir)
    counts = f.groupBy("upload_id").agg(F.count(F.lit(1)).alias("frame_count"))
    headers = u.join(counts, "upload_id").select("upload_id", "source_type", F.lit("track_a_batch").alias("track"), F.when(F.col("upload_id") % 9 == 8, 1.5).otherwise(0.3).alias("compute_priority_score"), "frame_count")
    headers = headers.withColumn("sync_group_id", F.when(F.col("upload_id") % 2 == 0, F.concat(F.lit("sync_"), "upload_id")))
    # An upload in five has an entry whose frame isn't there.
    entries = sync.sync_map(f.join(u.filter("source_type = 'video_folder'").select("upload_id"), "upload_id", "left_semi"))
    broken = u.filter("upload_id % 5 = 3").select("upload_id", F.lit(0).cast("int").alias("entry_pos"), F.lit(0.0).alias("anchor_timestamp_ms"), F.create_map(F.lit("cam_9"), F.lit(7)).alias("aligned_frames"), F.create_map(F.lit("cam_9"), F.lit(0.0)).alias("offsets_ms"))
    ready, errors = pipelines.plan_jobs(headers, f, sync_map=entries.unionByName(broken))
    none = lambda t: F.lit(None).cast(t)
    planned = ready.select("upload_id", "mode", F.col("params.pairing_strategy").alias("pairing"), F.size("image_uris").alias("images"), "sync_group_count", "sync_group_id", "output_path", none("string").alias("step"), none("string").alias("error"))
    failed = errors.select("upload_id", *[none(t).alias(c) for c, t in (("mode", "string"), ("pairing", "string"), ("images", "int"), ("sync_group_count", "bigint"), ("sync_group_id", "string"), ("output_path", "string"))], "step", "error")
    return planned.unionByName(failed)


P2 = f"""{PLANNED},
h AS (
    SELECT *, CASE WHEN upload_id % 9 = 8 THEN 'contract' WHEN source_type = 'video_folder' AND upload_id % 5 = 3 THEN 'groups' WHEN error IS NOT NULL THEN 'build' END AS step,
           CASE WHEN upload_id % 2 = 0 AND source_type = 'video_folder' THEN 'sync_' || upload_id END AS group_id FROM built)
SELECT upload_id, CASE WHEN step IS NULL THEN mode END AS mode, CASE WHEN step IS NULL THEN coalesce(pairing_strategy, 'complete') END AS pairing, CASE WHEN step IS NULL THEN n END::INTEGER AS images,
       CASE WHEN step IS NULL THEN sync_group_count END AS sync_group_count, CASE WHEN step IS NULL THEN group_id END AS sync_group_id,
       CASE WHEN step IS NULL THEN 'data/reconstruction/' || coalesce(group_id, source_type) || '_' || upload_id || '/' || coalesce(group_id, source_type) || '.glb' END AS output_path, step,
       CASE step WHEN 'contract' THEN 'score' WHEN 'groups' THEN 'sync_map references a frame that is not present in the payload: cam_9[7]' WHEN 'build' THEN error END AS error
FROM h"""


def p4_deliver(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = _requests(spark, sf_dir).select(k.alias("job_key"), "input_type", "use_case", F.concat(F.lit("out/"), k, F.lit(".glb")).alias("path"))
    listed = views.table(spark, sf_dir, "orders").filter(k % 10 != 0).select(F.concat(F.lit("out/"), k, F.lit(".glb")).alias("path"), F.lit(9).cast("long").alias("length"))
    return pipelines.deliver_jobs(r, listed).select("job_key", "track", "error", "job_id", "status")


P4 = f"""WITH {REQUESTS_SQL}
SELECT o_orderkey AS job_key, track, coalesce(error, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' END) AS error,
       CASE WHEN error IS NULL AND o_orderkey % 10 <> 0 THEN 'JOB_' || upper(substr(sha256(o_orderkey::VARCHAR), 1, 6)) END AS job_id,
       CASE WHEN error IS NOT NULL OR o_orderkey % 10 = 0 THEN 'rejected' WHEN track = 'C' THEN 'not_implemented' ELSE 'delivered' END AS status
FROM t"""

QUERIES = {f.__name__: f for f in (a2_payload_files, a3_payload_round_trip, a7_manifests, i1_decisions, i2_snapshot, i3_dropped, i4_rate_limit, i4_rate_limit_stream, i5_live_sample, i6_headers, k1_payloads, p1_ingest, p2_plan_jobs, p4_deliver)}
ORACLES = dict(zip(QUERIES, (A2, A3, A7, I1, I2, I3, I4, I4, C3, I6, K1, P1, P2, P4), strict=True))
