"""Uploads: classification, guards, scalar functions, routing and delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import views
from orrery.functions import scalars as S
from orrery.operators import classify, contracts, deliver
from orrery.operators.jobs import overlay_params
from orrery.views import table


def b1_item_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.media_items(spark, sf_dir).select("upload_id", "pos", "filename", S.item_kind(F.col("filename"), F.col("mime_type")).alias("kind"))


KIND_SQL = """
    CASE WHEN lower(coalesce(mime_type, '')) LIKE 'image/%' OR lower(regexp_extract(filename, '.(\\.[^.]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff', '.webp') THEN 'single_image'
         WHEN lower(coalesce(mime_type, '')) LIKE 'video/%' OR lower(regexp_extract(filename, '.(\\.[^.]+)$', 1)) IN ('.mp4', '.mov', '.avi', '.mkv', '.webm', '.m4v') THEN 'single_video'
         ELSE 'unknown' END"""

B1 = f"{views.sql(views.MEDIA_ITEMS)} SELECT upload_id, pos, filename, {KIND_SQL} AS kind FROM media_items"


def b2_upload_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.media_items(spark, sf_dir)
    empty = items.select((-1 - F.col("upload_id")).alias("upload_id")).filter("upload_id % 50 = 0").distinct()  # uploads without items
    return classify.classify_uploads(items.select("upload_id").distinct().unionByName(empty), items)


B2 = f"""{views.sql(views.MEDIA_ITEMS)},
named AS (SELECT upload_id, filename, min(pos) AS first, max_by({KIND_SQL}, pos) AS kind, count(*) AS n FROM media_items GROUP BY ALL),
g AS (
    SELECT upload_id, sum(n)::BIGINT AS n, list_sort(list(DISTINCT kind)) AS kinds, list(filename ORDER BY first, filename) FILTER (kind = 'unknown') AS unknown
    FROM named GROUP BY upload_id),
u AS (
    SELECT upload_id, coalesce(n, 0) AS n, kinds, unknown,
           CASE WHEN kinds = ['single_image'] THEN CASE WHEN n = 1 THEN 'single_image' ELSE 'image_folder' END
                WHEN kinds = ['single_video'] THEN CASE WHEN n = 1 THEN 'single_video' ELSE 'video_folder' END ELSE 'unknown' END AS input_type
    FROM (SELECT DISTINCT upload_id FROM media_items UNION SELECT DISTINCT -1 - upload_id FROM media_items WHERE (-1 - upload_id) % 50 = 0) LEFT JOIN g USING (upload_id))
SELECT upload_id, input_type, 'track_a_batch' AS track,
       round(greatest(0.05, least(0.95, CASE input_type WHEN 'single_image' THEN 0.55::DOUBLE WHEN 'image_folder' THEN 0.35::DOUBLE WHEN 'single_video' THEN 0.45::DOUBLE
           WHEN 'video_folder' THEN 0.25::DOUBLE ELSE 0.2::DOUBLE END - CASE WHEN n > 1 THEN least(0.15::DOUBLE, (n - 1) * 0.02::DOUBLE) ELSE 0 END)), 3) AS priority_score,
       CASE WHEN n = 0 THEN 'empty payload' WHEN len(unknown) > 0 THEN 'unsupported file(s): ' || list_aggregate(unknown, 'string_agg', ', ')
            ELSE n || ' static item(s), kinds=[' || list_aggregate(list_transform(kinds, lambda k: '''' || k || ''''), 'string_agg', ', ') || ']' END AS reason
FROM u"""


def b3_stream_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    transport = F.when(F.col("event_type") == "error", "rtsp").when(F.col("user_id") % 2 == 0, "WebSocket").otherwise("websocket")
    return classify.classify_streams(e.select(F.col("event_id"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("s"), "user_id")).alias("stream_id"), transport.alias("transport")))


B3 = """
SELECT *, CASE WHEN lower(transport) = 'websocket' THEN 'live_stream' ELSE 'unknown' END AS input_type, 'track_b_live' AS track, 1.0::DOUBLE AS priority_score,
       CASE WHEN lower(transport) = 'websocket' THEN trim(lower(transport) || ' live stream ' || coalesce(stream_id, ''))
            ELSE 'unsupported live transport=' || transport || '; implemented transport=websocket' END AS reason
FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN 's' || user_id END AS stream_id,
             CASE WHEN event_type = 'error' THEN 'rtsp' WHEN user_id % 2 = 0 THEN 'WebSocket' ELSE 'websocket' END AS transport FROM events)"""


def b5_size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.size_guard(views.media_items(spark, sf_dir))


B5 = f"{views.sql(views.MEDIA_ITEMS)} SELECT upload_id, max(size_bytes) AS largest, max(size_bytes) <= 536870912 AS accepted FROM media_items GROUP BY upload_id"


def b6_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    length = F.when(key % 7 == 0, F.concat("p_size", F.lit("/0"))).when(key % 7 == 1, F.lit("wide")).when(key % 7 == 2, F.col("p_size").cast("string")).otherwise(F.concat("p_size", F.lit("/"), (key % 5 + 1).cast("string")))
    tags = F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("FocalLength", "FocalLengthIn35mmFilm", "Make", "Model")]), F.array(length, (key % 50 + 10).cast("string"), F.concat(F.lit(" "), "p_brand", F.lit("  ")), F.col("p_type"))
    )
    i = p.select("p_partkey", S.intrinsics(tags).alias("i"))
    return i.select("p_partkey", "i.focal_length_mm", "i.focal_length_35mm", "i.make", "i.model", "i.lens_model")


B6 = """
SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 1) THEN NULL WHEN p_partkey % 7 = 2 THEN p_size::DOUBLE ELSE p_size::DOUBLE / (p_partkey % 5 + 1) END AS focal_length_mm,
       (p_partkey % 50 + 10)::DOUBLE AS focal_length_35mm, p_brand AS make, trim(p_type) AS model, NULL::VARCHAR AS lens_model
FROM part"""


def b7_fit_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 4000 + 1).alias("width"), (F.col("p_size") * 61 + 1).alias("height"))
    return p.select("p_partkey", S.fit_within(F.col("width"), F.col("height")).alias("s")).select("p_partkey", "s.w", "s.h")


B7 = """
SELECT p_partkey, greatest(1, round_even(w * s, 0))::INTEGER AS w, greatest(1, round_even(h * s, 0))::INTEGER AS h
FROM (SELECT *, least(1024::DOUBLE / w, 1024::DOUBLE / h, 1::DOUBLE) AS s FROM (SELECT p_partkey, p_partkey * 37 % 4000 + 1 AS w, p_size * 61 + 1 AS h FROM part))"""


def b8_k_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = S.k_matrix(F.col("focal_length_35mm"), F.col("width"), F.col("height"))
    return views.frames(spark, sf_dir).select("frame_id", k.alias("k")).select("frame_id", F.col("k")[0][0].alias("f"), F.col("k")[0][2].alias("cx"), F.col("k")[1][2].alias("cy"), F.col("k")[2][2].alias("one"))


B8 = f"""{views.sql(views.FRAMES)}
SELECT frame_id, focal_length_35mm / 36.0::DOUBLE * greatest(width, height) AS f, CASE WHEN focal_length_35mm IS NOT NULL THEN width / 2 END AS cx,
       CASE WHEN focal_length_35mm IS NOT NULL THEN height / 2 END AS cy, CASE WHEN focal_length_35mm IS NOT NULL THEN 1::DOUBLE END AS one
FROM frames"""


def b9_uri_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("file:///data/a%20b+"), "page_id", F.lit(".png")))
    u = u.when(F.col("page_id") % 4 == 2, F.concat(F.lit("file:///C:/x/"), "page_id")).otherwise(F.concat(F.lit("/plain/100%25/"), "page_id"))
    return table(spark, sf_dir, "pages").select("page_id", S.uri_path(u).alias("path"))


B9 = """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/data/a b+' || page_id || '.png' WHEN 2 THEN 'C:/x/' || page_id ELSE '/plain/100%/' || page_id END AS path FROM pages"""


def b10_frame_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.when(F.col("pos") % 3 == 0, F.lit(0.0)).otherwise(F.col("timestamp_ms"))
    return views.frames(spark, sf_dir).select("frame_id", S.frame_time(ts, F.col("index"), F.col("pos") % 4 * 15).alias("timestamp_ms"))


B10 = f"""{views.sql(views.FRAMES)}
SELECT frame_id, CASE WHEN ts <= 0 AND "index" > 0 THEN "index" / coalesce(nullif(fps, 0), 30)::DOUBLE * 1000 ELSE ts END AS timestamp_ms
FROM (SELECT *, CASE WHEN pos % 3 = 0 THEN 0 ELSE timestamp_ms END AS ts, pos % 4 * 15 AS fps FROM frames)"""


def b12_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    header = o.select(
        F.when(k % 101 != 0, k).alias("upload_id"), F.when(k % 13 == 0, "hologram").otherwise("image_folder").alias("source_type"), F.when(k % 17 == 0, "track_z").otherwise("track_a_batch").alias("track"),
        ((k % 120) / 100).alias("compute_priority_score"), (k % 19 - 1).alias("frame_count"), k.alias("row"),
    )
    good, bad = contracts.check(header, contracts.payload_rules())
    return good.select("row", F.lit("").alias("violations")).unionByName(bad.select("row", F.array_join("violations", ",").alias("violations")))


B12 = """
SELECT o_orderkey AS row, concat_ws(',', CASE WHEN o_orderkey % 101 = 0 THEN 'upload_id' END, CASE WHEN o_orderkey % 13 = 0 THEN 'source_type' END,
       CASE WHEN o_orderkey % 17 = 0 THEN 'track' END, CASE WHEN o_orderkey % 120 > 100 THEN 'score' END, CASE WHEN o_orderkey % 19 = 0 THEN 'frame_count' END) AS violations
FROM orders"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    types, uses = F.array(*[F.lit(t) for t in (*contracts.SOURCE_TYPES, "cube")]), F.array(*[F.lit(u) for u in ("editing", "viewing", "live", "print")])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(types, (k % 7 + 1).cast("int")).alias("input_type"), F.element_at(uses, (F.floor(k / 7) % 4 + 1).cast("int")).alias("use_case"))


REQUESTS_SQL = """
r AS (SELECT o_orderkey, ['single_image', 'image_folder', 'single_video', 'video_folder', 'live_stream', 'unknown', 'cube'][o_orderkey % 7 + 1] AS input_type,
             ['editing', 'viewing', 'live', 'print'][o_orderkey // 7 % 4 + 1] AS use_case FROM orders),
e AS (SELECT *, CASE WHEN input_type = 'cube' THEN 'unknown_input_type' WHEN use_case = 'print' THEN 'unknown_use_case'
                     WHEN (use_case = 'editing' AND input_type IN ('single_image', 'image_folder', 'single_video', 'video_folder'))
                       OR (use_case = 'viewing' AND input_type IN ('single_video', 'video_folder', 'image_folder')) OR (use_case = 'live' AND input_type = 'live_stream') THEN NULL
                     ELSE 'invalid_pair' END AS error FROM r),
t AS (SELECT *, CASE WHEN error IS NULL THEN CASE use_case WHEN 'editing' THEN 'A' WHEN 'viewing' THEN 'B' ELSE 'C' END END AS track FROM e)"""


def b14_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.route(_requests(spark, sf_dir))


B14 = f"WITH {REQUESTS_SQL} SELECT * FROM t"


def b15_deliverables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.deliverables(deliver.route(_requests(spark, sf_dir)), F.col("o_orderkey"))


B15 = f"""WITH {REQUESTS_SQL},
j AS (SELECT *, 'JOB_' || upper(substr(sha256(o_orderkey::VARCHAR), 1, 6)) AS job FROM t)
SELECT o_orderkey, input_type, use_case, error, track, CASE WHEN error IS NULL THEN job END AS job_id,
       CASE track WHEN 'A' THEN 'blender_ready/' || job || '_model.glb' WHEN 'B' THEN 'point_clouds/' || job || '_points.ply' END AS output_path,
       CASE track WHEN 'A' THEN 'Blender-ready export packaged successfully.' WHEN 'B' THEN 'Point-cloud deliverable packaged successfully.'
            WHEN 'C' THEN '[' || job || '] Track C (real-time WebRTC/WebSocket delivery) is not implemented yet.' END AS message,
       CASE WHEN error IS NOT NULL THEN 'rejected' WHEN track = 'C' THEN 'not_implemented' ELSE 'delivered' END AS status
FROM j"""


def b16_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.concat(F.lit("out/run."), k, F.lit("/mesh_"), k, F.when(k % 3 == 0, ".ply").when(k % 3 == 1, "").otherwise(".GLB"))
    explicit = F.when(k % 4 == 0, raw).when(k % 4 == 1, F.lit("out/folder"))
    label = F.when(k % 2 == 0, F.concat(F.lit("lab"), k))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", deliver.refined_path(raw).alias("refined"), deliver.cleaned_path(raw).alias("cleaned"), deliver.job_output_path(explicit, label, k.cast("string")).alias("job_output"),
        deliver.input_output_path(raw, explicit, label, k.cast("string")).alias("run_output"),
    )


B16 = """
SELECT o_orderkey, base || '_refined' || coalesce(nullif(ext, ''), '.glb') AS refined, base || '.cleaned' || coalesce(nullif(ext, ''), '.vtk') AS cleaned,
       CASE o_orderkey % 4 WHEN 0 THEN base || ext WHEN 1 THEN 'out/folder' ELSE 'data/reconstruction/' || coalesce(label, 'reconstruction') || '_' || o_orderkey || '/' || coalesce(label, 'reconstruction') || '.glb' END AS job_output,
       CASE WHEN o_orderkey % 4 = 0 AND ext <> '' THEN base || '_' || o_orderkey || '/mesh_' || o_orderkey || ext WHEN o_orderkey % 4 = 0 THEN base || ext || '/mesh_' || o_orderkey || '.glb'
            WHEN o_orderkey % 4 = 1 THEN 'out/folder/mesh_' || o_orderkey || '.glb'
            ELSE 'data/reconstruction/' || coalesce(label, 'mesh_' || o_orderkey) || '_' || o_orderkey || '/' || coalesce(label, 'mesh_' || o_orderkey) || '.glb' END AS run_output
FROM (SELECT o_orderkey, 'out/run.' || o_orderkey || '/mesh_' || o_orderkey AS base, ['.ply', '', '.GLB'][o_orderkey % 3 + 1] AS ext, CASE WHEN o_orderkey % 2 = 0 THEN 'lab' || o_orderkey END AS label FROM orders)"""


def b17_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    recommended = F.when(k % 2 == 0, F.create_map(F.lit("pairing_strategy"), F.lit("swin"), F.lit("frame_count"), k.cast("string"))).otherwise(F.create_map(F.lit("frame_count"), k.cast("string")))
    explicit = F.when(k % 3 == 0, F.create_map(F.lit("pairing_strategy"), F.lit("complete"), F.lit("image_size"), (k % 9 * 64).cast("string"))).when(k % 3 == 1, F.create_map(F.lit("min_conf_thr"), F.lit("bad")))
    return overlay_params(table(spark, sf_dir, "orders").select("o_orderkey", recommended.alias("recommended"), explicit.alias("explicit"))).select("o_orderkey", "params.*").drop("model_name")


B17 = """
SELECT o_orderkey, 'auto' AS device, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 9 * 64 ELSE 512 END::INTEGER AS image_size,
       CASE WHEN o_orderkey % 3 = 0 THEN 'complete' WHEN o_orderkey % 2 = 0 THEN 'swin' ELSE 'complete' END AS pairing_strategy,
       0::DOUBLE AS tsdf_thresh, 1.5::DOUBLE AS min_conf_thr, NULL::BIGINT AS seed, false AS dry_run
FROM orders"""


def b18_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    token = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.lit(""))
    host = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("10.0.0."), "c_nationkey"))
    return c.select("c_custkey", S.subject(token, host).alias("subject"))


B18 = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'auth:' || substr(sha256(c_name), 1, 16) WHEN c_custkey % 2 = 0 THEN 'anonymous:10.0.0.' || c_nationkey ELSE 'anonymous:unknown' END AS subject
FROM customer"""


def b19_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.concat(F.lit("out/"), k, F.when(k % 5 == 0, ".txt").otherwise(".GLB"))
    o = table(spark, sf_dir, "orders")
    return deliver.check_artifacts(o.select(k.alias("job_id"), path.alias("path")), o.filter(k % 4 != 0).select(path.alias("path"), F.when(k % 7 == 0, 0).otherwise(k).cast("long").alias("length")))


B19 = """
SELECT o_orderkey AS job_id, 'out/' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '.txt' ELSE '.GLB' END AS path,
       CASE WHEN o_orderkey % 4 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'empty' WHEN o_orderkey % 5 = 0 THEN 'unsupported_format' END AS error
FROM orders"""


def a4_asset_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.media_items(spark, sf_dir)
    return items.select("upload_id", "pos", S.asset_key(F.col("upload_id"), F.concat(F.lit("in/"), "filename")).alias("key"))


A4 = f"{views.sql(views.MEDIA_ITEMS)} SELECT upload_id, pos, sha256(upload_id || chr(10) || 'in/' || filename) || '_' || filename AS key FROM media_items"

QUERIES = {f.__name__: f for f in (a4_asset_key, b1_item_kind, b2_upload_class, b3_stream_class, b5_size_guard, b6_intrinsics, b7_fit_within, b8_k_matrix, b9_uri_path, b10_frame_time, b12_contract, b14_routing, b15_deliverables, b16_paths, b17_params, b18_subject, b19_artifacts)}
ORACLES = dict(zip(QUERIES, (A4, B1, B2, B3, B5, B6, B7, B8, B9, B10, B12, B14, B15, B16, B17, B18, B19), strict=True))
