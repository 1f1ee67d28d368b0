"""Capture: sampling, camera alignment, jobs and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import views
from orrery.operators import jobs, pairing, sampling, sync
from orrery.sources.scratch import written
from orrery.views import table


def _gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images of eight by eight from ``embeddings``: videos of 50 frames."""
    gray = F.transform("embedding", lambda x: F.pmod(F.floor(F.abs(x.cast("double")) * 400), F.lit(256)))
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("video_id"), (F.col("vec_id") % 50).alias("index"), gray.alias("gray"))


def c1_motion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sampling.with_motion(_gray(spark, sf_dir))
    return m.select("video_id", "index", "motion_score", sampling.interval(F.col("motion_score")).alias("interval"))


C1 = """
WITH g AS (SELECT vec_id // 50 AS video_id, vec_id % 50 AS "index", list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 400)::BIGINT % 256) AS gray FROM embeddings),
p AS (SELECT *, lag(gray) OVER (PARTITION BY video_id ORDER BY "index") AS before FROM g),
d AS (SELECT *, list_transform(list_zip(before, gray), lambda z: abs(z[1] - z[2])::DOUBLE) AS diff FROM p),
m AS (
    SELECT video_id, "index", CASE WHEN before IS NULL THEN 1.0::DOUBLE
           ELSE round(least(1.0::DOUBLE, list_sum(diff) / 64 / 255 * 1.8::DOUBLE + len(list_filter(diff, lambda x: x > 18)) / 64::DOUBLE * 0.8::DOUBLE), 4) END AS motion_score FROM d)
SELECT *, CASE WHEN motion_score >= 0.18 THEN 4 WHEN motion_score >= 0.055 THEN 12 ELSE 24 END AS interval FROM m"""


def _video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir)
    calm = F.when(F.floor(F.col("index") / 60) % 3 == 0, F.col("motion_score")).when(F.floor(F.col("index") / 60) % 3 == 1, F.col("motion_score") / 5).otherwise(F.col("motion_score") / 40)
    return f.select(F.concat_ws("/", F.col("upload_id").cast("string"), "source_id").alias("video_id"), "index", calm.alias("motion_score"), F.lit(12.0).alias("fps"))


def c3_adaptive_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.adaptive_sample(_video_frames(spark, sf_dir)).select("video_id", "index", "sample_index")


def c3_adaptive_sample_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.adaptive_sample_long(_video_frames(spark, sf_dir)).select("video_id", "index", "sample_index")


C3 = f"""{views.sql(views.FRAMES, recursive=True)},
v AS (
    SELECT upload_id || '/' || source_id AS video_id, "index",
           greatest(1, CASE WHEN m >= 0.18 THEN 4 WHEN m >= 0.055 THEN 12 ELSE 24 END) AS step
    FROM (SELECT *, coalesce(CASE "index" // 60 % 3 WHEN 0 THEN motion_score WHEN 1 THEN motion_score / 5 ELSE motion_score / 40 END, 0) AS m FROM frames)),
w AS (
    SELECT video_id, "index", true AS kept, "index" AS last FROM v WHERE "index" = 0
    UNION ALL
    SELECT v.video_id, v."index", v."index" - w.last >= v.step, CASE WHEN v."index" - w.last >= v.step THEN v."index" ELSE w.last END
    FROM w JOIN v ON v.video_id = w.video_id AND v."index" = w."index" + 1)
SELECT video_id, "index", (row_number() OVER (PARTITION BY video_id ORDER BY "index") - 1)::INTEGER AS sample_index FROM w WHERE kept"""

SYNC = f"""{views.sql(views.FRAMES, recursive=True)},
timed AS (SELECT *, row_number() OVER (PARTITION BY upload_id, source_id ORDER BY timestamp_ms, pos) AS ts_pos FROM frames WHERE timestamp_ms IS NOT NULL),
usable AS (SELECT * FROM timed JOIN (SELECT upload_id, count(DISTINCT source_id) AS n_sources FROM timed GROUP BY 1 HAVING count(DISTINCT source_id) > 1) USING (upload_id)),
sized AS (SELECT upload_id, source_id, count(*) AS n, min(source_order) AS o, var_pop(coalesce(motion_score, 0)) AS v FROM usable GROUP BY ALL),
anchors AS (SELECT upload_id, source_id AS anchor FROM sized QUALIFY row_number() OVER (PARTITION BY upload_id ORDER BY n DESC, o) = 1),
signal AS (SELECT u.*, anchor, coalesce(motion_score, 0) AS motion FROM usable u JOIN anchors USING (upload_id) JOIN sized s USING (upload_id, source_id) WHERE s.n > 1 AND s.v >= 0.0005),
votes AS (
    SELECT a.upload_id, c.source_id, a.timestamp_ms - c.timestamp_ms AS off, a.ts_pos AS ap, c.ts_pos AS cp
    FROM signal a JOIN signal c ON a.upload_id = c.upload_id AND a.source_id = a.anchor AND c.source_id <> c.anchor AND abs(a.motion - c.motion) <= 0.03),
buckets AS (
    SELECT upload_id, source_id, round_even(off / 100.0::DOUBLE, 0) AS bucket, count(*) AS n, abs(avg(off)) AS far, min(ap * 1000000 + cp) AS first, quantile_cont(off, 0.5) AS median FROM votes GROUP BY ALL),
best AS (SELECT upload_id, source_id, round(median, 3) AS offset_ms FROM buckets QUALIFY row_number() OVER (PARTITION BY upload_id, source_id ORDER BY n DESC, round(far, 6), first) = 1),
offsets AS (SELECT s.upload_id, s.source_id, coalesce(offset_ms, 0) AS offset_ms FROM sized s JOIN anchors a ON s.upload_id = a.upload_id AND s.source_id <> a.anchor LEFT JOIN best b ON s.upload_id = b.upload_id AND s.source_id = b.source_id)"""


def d5_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = written(sync.usable_frames(views.frames(spark, sf_dir)), "sync-frames")
    return sync.offsets(usable, sync.anchors(usable))


D5 = f"{SYNC} SELECT * FROM offsets"


def d6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = written(sync.usable_frames(views.frames(spark, sf_dir)), "sync-frames")
    chosen = sync.anchors(usable)
    return sync.nearest(usable, chosen, sync.offsets(usable, chosen)).select("upload_id", "entry_pos", "anchor", "anchor_index", "source_id", "index")


NEAREST = f"""{SYNC},
near AS (
    SELECT a.upload_id, a.ts_pos AS entry_pos, x.anchor, a."index" AS anchor_index, a.timestamp_ms AS anchor_ts, a.n_sources, c.source_id, c."index", o.offset_ms
    FROM usable a JOIN anchors x ON a.upload_id = x.upload_id AND a.source_id = x.anchor
    JOIN usable c ON c.upload_id = a.upload_id AND c.source_id <> a.source_id JOIN offsets o ON o.upload_id = c.upload_id AND o.source_id = c.source_id
    WHERE abs(c.timestamp_ms + o.offset_ms - a.timestamp_ms) <= 120
    QUALIFY row_number() OVER (PARTITION BY a.upload_id, a.ts_pos, c.source_id ORDER BY abs(c.timestamp_ms + o.offset_ms - a.timestamp_ms), c.ts_pos) = 1)"""
D6 = f'{NEAREST} SELECT upload_id, entry_pos, anchor, anchor_index, source_id, "index" FROM near'


def d9_sync_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sync.sync_map(views.frames(spark, sf_dir))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat(k, F.lit("="), F.element_at(c, k).cast("string"))), ",")
    return m.select("upload_id", "entry_pos", "anchor_timestamp_ms", listed("aligned_frames").alias("aligned_frames"), F.size("offsets_ms").alias("n_offsets"), F.aggregate(F.map_values("offsets_ms"), F.lit(0.0), lambda a, x: a + x).alias("offset_sum"))


ENTRIES = f"""{NEAREST},
entries AS (
    SELECT upload_id, entry_pos, anchor, anchor_index, anchor_ts, list(source_id ORDER BY source_id) AS sources, list("index" ORDER BY source_id) AS idx, list(offset_ms ORDER BY source_id) AS offs,
           row_number() OVER (PARTITION BY upload_id ORDER BY entry_pos) AS n
    FROM near GROUP BY upload_id, entry_pos, anchor, anchor_index, anchor_ts, n_sources HAVING count(*) = n_sources - 1),
fold AS (
    SELECT upload_id, n, true AS kept, idx AS used FROM entries WHERE n = 1
    UNION ALL
    SELECT e.upload_id, e.n, NOT list_bool_or(list_transform(list_zip(e.idx, f.used), lambda z: z[1] = z[2])),
           CASE WHEN list_bool_or(list_transform(list_zip(e.idx, f.used), lambda z: z[1] = z[2])) THEN f.used ELSE e.idx END
    FROM fold f JOIN entries e ON e.upload_id = f.upload_id AND e.n = f.n + 1),
kept AS (SELECT e.* FROM entries e JOIN fold f USING (upload_id, n) WHERE f.kept)"""
D9 = f"""{ENTRIES},
pairs AS (
    SELECT upload_id, entry_pos, anchor AS source_id, anchor_index AS "index" FROM kept
    UNION ALL SELECT upload_id, entry_pos, unnest(sources), unnest(idx) FROM kept)
SELECT upload_id, entry_pos, round(anchor_ts, 3) AS anchor_timestamp_ms, aligned_frames, len(offs)::INTEGER AS n_offsets, list_sum(offs) AS offset_sum
FROM kept JOIN (SELECT upload_id, entry_pos, string_agg(source_id || '=' || "index", ',' ORDER BY source_id) AS aligned_frames FROM pairs GROUP BY ALL) USING (upload_id, entry_pos)"""


def e_job_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = jobs.job_frames(views.frames(spark, sf_dir)).join(jobs.with_mode(views.uploads(spark, sf_dir)), "upload_id")
    return placed.select("upload_id", "mode", "error", "source_id", "index", "frame_id", "output_pos", jobs.pairing(F.col("mode"), F.col("n_frames")).alias("pairing_strategy"))


MODE_SQL = """CASE source_type WHEN 'image_folder' THEN 'multi_view' WHEN 'single_video' THEN 'video_sequence' WHEN 'video_folder' THEN 'synchronized_views' END"""
ERROR_SQL = """CASE source_type WHEN 'single_image' THEN 'single_view reconstruction is not implemented yet' WHEN 'live_stream' THEN 'live streams cannot be converted into reconstruction jobs'
    WHEN 'unknown' THEN 'Unsupported source type: unknown' END"""
JOB_FRAMES = f"""{views.sql(views.FRAMES, views.UPLOADS)},
placed AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY source_id, "index", frame_id) - 1 AS frame_pos, count(*) OVER (PARTITION BY upload_id) AS n_frames FROM frames),
ranked AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY coalesce(motion_score, '-inf'::DOUBLE) DESC, "index" DESC, frame_pos) AS rank FROM placed),
used AS (SELECT *, CASE WHEN n_frames > 40 THEN rank - 1 ELSE frame_pos END AS output_pos FROM ranked WHERE rank <= 40)"""
E_FRAMES = f"""{JOB_FRAMES}
SELECT upload_id, {MODE_SQL} AS mode, {ERROR_SQL} AS error, source_id, "index", frame_id, output_pos,
       CASE WHEN source_type = 'single_video' OR (source_type = 'image_folder' AND n_frames > 20) THEN 'swin' END AS pairing_strategy
FROM used JOIN uploads USING (upload_id)"""


def e13_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.with_mode(views.uploads(spark, sf_dir))


E13 = f"{views.sql(views.UPLOADS)} SELECT *, {MODE_SQL} AS mode, {ERROR_SQL} AS error FROM uploads"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved groups as a table of their own: several operators read them, and the alignment runs once."""
    frames = written(views.frames(spark, sf_dir), "frames")
    return written(jobs.resolve_groups(sync.long_entries(sync.sync_map(frames)), frames)[0], "groups")


def e5_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cap_groups(_groups(spark, sf_dir)).select("upload_id", "entry_pos", "source_id", "frame_id", "group_pos")


CAPPED = f"""{ENTRIES},
long AS (
    SELECT upload_id, entry_pos, anchor AS source_id, anchor_index AS "index" FROM kept
    UNION ALL SELECT upload_id, entry_pos, unnest(sources), unnest(idx) FROM kept),
resolved AS (SELECT l.*, frame_id, uri, motion_score FROM long l JOIN frames f USING (upload_id, source_id, "index")),
scored AS (
    SELECT upload_id, entry_pos, count(*) AS cameras, max(coalesce(motion_score, '-inf'::DOUBLE)) AS motion FROM resolved GROUP BY ALL),
indexed AS (
    SELECT s.*, greatest(0, max(r."index") FILTER (coalesce(r.motion_score, '-inf'::DOUBLE) = s.motion)) AS best_at FROM scored s JOIN resolved r USING (upload_id, entry_pos) GROUP BY ALL),
ranked AS (
    SELECT *, greatest(1, floor(40 / avg(cameras) OVER j)) AS most, count(*) OVER j AS n, row_number() OVER (PARTITION BY upload_id ORDER BY motion DESC, best_at DESC, entry_pos) - 1 AS rank,
           row_number() OVER (PARTITION BY upload_id ORDER BY entry_pos) - 1 AS ord FROM indexed WINDOW j AS (PARTITION BY upload_id)),
capped AS (SELECT r.*, CASE WHEN n <= most THEN ord ELSE rank END AS group_pos FROM resolved r JOIN ranked USING (upload_id, entry_pos) WHERE rank < most)"""
E5 = f"{CAPPED} SELECT upload_id, entry_pos, source_id, frame_id, group_pos FROM capped"


def e6_flat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.flatten_groups(jobs.cap_groups(_groups(spark, sf_dir))).select("upload_id", "source_id", "frame_id", "output_pos")


FLAT = f"""{CAPPED},
firsts AS (SELECT * FROM capped QUALIFY row_number() OVER (PARTITION BY upload_id, source_id, frame_id ORDER BY group_pos) = 1),
flat AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY group_pos, source_id) - 1 AS output_pos FROM firsts)"""
E6 = f"{FLAT} SELECT upload_id, source_id, frame_id, output_pos FROM flat"


def e7_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, uploads = written(views.frames(spark, sf_dir), "frames"), views.uploads(spark, sf_dir)
    entries = written(sync.long_entries(sync.sync_map(frames)), "sync-entries")
    used, _ = jobs.used_frames(uploads, frames, entries)
    return jobs.assemble(uploads, used).withColumn("image_uris", F.array_join("image_uris", " "))


# The frames of jobs: ordered ones up to the cap, and those of capped and flattened groups for synchronised views.
PLANNED = f"""{FLAT},{views.UPLOADS},
placed AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY source_id, "index", frame_id) - 1 AS frame_pos, count(*) OVER (PARTITION BY upload_id) AS n_frames FROM frames),
motioned AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY coalesce(motion_score, '-inf'::DOUBLE) DESC, "index" DESC, frame_pos) AS nth FROM placed),
totals AS (SELECT upload_id, count(*) AS n_frames FROM frames GROUP BY 1),
taken AS (
    SELECT upload_id, uri, CASE WHEN n_frames > 40 THEN nth - 1 ELSE frame_pos END AS output_pos, n_frames, NULL::BIGINT AS n_groups
    FROM motioned JOIN uploads USING (upload_id) WHERE nth <= 40 AND source_type <> 'video_folder'
    UNION ALL
    SELECT upload_id, uri, output_pos, n_frames, n_groups FROM flat JOIN uploads USING (upload_id) JOIN totals USING (upload_id)
    JOIN (SELECT upload_id, count(DISTINCT entry_pos) AS n_groups FROM capped GROUP BY 1) USING (upload_id) WHERE source_type = 'video_folder'),
listed AS (SELECT upload_id, count(*) AS n, max(n_frames) AS n_frames, max(n_groups) AS n_groups, string_agg(uri, ' ' ORDER BY output_pos) AS uris FROM taken GROUP BY 1),
built AS (
    SELECT upload_id, source_type, {MODE_SQL} AS mode, coalesce({ERROR_SQL}, CASE WHEN coalesce(n, 0) < 2 THEN 'reconstruction needs at least two images' END) AS error, n,
           CASE WHEN {MODE_SQL} IS NOT NULL THEN uris END AS image_uris, CASE WHEN {MODE_SQL} IS NOT NULL THEN n_frames END AS n_frames,
           CASE WHEN source_type = 'single_video' OR (source_type = 'image_folder' AND n_frames > 20) THEN 'swin' END AS pairing_strategy,
           CASE WHEN {MODE_SQL} IS NOT NULL THEN n_groups END AS sync_group_count
    FROM uploads LEFT JOIN listed USING (upload_id))"""
E7 = f"{PLANNED} SELECT * EXCLUDE (n) FROM built"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_frames(views.frames(spark, sf_dir)).select(F.col("upload_id").alias("job_id"), F.col("output_pos").alias("pos"), F.col("uri").alias("path"), "width", "height", "focal_length_35mm")


def e8_complete_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.complete_pairs(_images(spark, sf_dir))


E8 = f"{JOB_FRAMES} SELECT a.upload_id AS job_id, a.output_pos AS a, b.output_pos AS b FROM used a JOIN used b ON a.upload_id = b.upload_id AND a.output_pos <> b.output_pos"


def e9_window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.window_pairs(_images(spark, sf_dir))


E9 = f"""{JOB_FRAMES},
m AS (SELECT upload_id, count(*) AS n FROM used GROUP BY 1)
SELECT DISTINCT a.upload_id AS job_id, a.output_pos AS a, b.output_pos AS b FROM used a JOIN used b ON a.upload_id = b.upload_id AND a.output_pos <> b.output_pos JOIN m ON m.upload_id = a.upload_id
WHERE (b.output_pos - a.output_pos + n) % n <= 3 OR (a.output_pos - b.output_pos + n) % n <= 3"""


def _sync_images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    groups = written(jobs.cap_groups(_groups(spark, sf_dir)), "capped-groups")
    images = jobs.flatten_groups(groups).select(F.col("upload_id").alias("job_id"), F.col("output_pos").alias("pos"), F.concat(F.lit("/data/"), F.regexp_extract("uri", r"([^/]*)$", 1)).alias("path"))
    return images, groups.select(F.col("upload_id").alias("job_id"), "group_pos", "source_id", "uri")


def e10_sync_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.sync_pairs(*_sync_images(spark, sf_dir))


E10 = f"""{FLAT},
idx AS (SELECT c.upload_id, c.group_pos, c.source_id, f.output_pos AS i FROM capped c JOIN flat f USING (upload_id, source_id, frame_id)),
met AS (SELECT l.upload_id, l.i AS a, r.i AS b, row(l.group_pos, l.source_id, r.source_id) AS emit FROM idx l JOIN idx r ON l.upload_id = r.upload_id AND l.group_pos = r.group_pos AND l.source_id < r.source_id),
first AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY upload_id, least(a, b), greatest(a, b) ORDER BY emit) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY emit) - 1 AS k FROM first)
SELECT upload_id AS job_id, a, b, 2 * k AS emitted FROM k UNION ALL SELECT upload_id, b, a, 2 * k + 1 FROM k"""


def e11_job_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, groups = _sync_images(spark, sf_dir)
    images = _images(spark, sf_dir)
    strategies = images.select("job_id").distinct().withColumn("strategy", F.when(F.col("job_id") % 2 == 0, "swin").otherwise("complete"))
    return pairing.job_pairs(images, groups.filter("job_id % 3 = 0"), strategies)


# Pairs of a job's groups where there are any, else those of its strategy.
E11 = f"""{PLANNED},
used AS (SELECT upload_id, uri, CASE WHEN n_frames > 40 THEN nth - 1 ELSE frame_pos END AS i FROM motioned WHERE nth <= 40),
idx AS (SELECT upload_id, group_pos, source_id, i FROM capped JOIN used USING (upload_id, uri) WHERE upload_id % 3 = 0),
sp AS (SELECT DISTINCT l.upload_id, l.i AS a, r.i AS b FROM idx l JOIN idx r ON l.upload_id = r.upload_id AND l.group_pos = r.group_pos AND l.source_id <> r.source_id),
rest AS (SELECT *, count(*) OVER (PARTITION BY upload_id) AS n FROM used WHERE upload_id NOT IN (SELECT upload_id FROM sp)),
other AS (SELECT x.upload_id, x.i AS a, y.i AS b, x.n FROM rest x JOIN rest y ON x.upload_id = y.upload_id AND x.i <> y.i)
SELECT upload_id AS job_id, a, b, 'sync' AS how FROM sp
UNION ALL SELECT upload_id, a, b, 'swin' FROM other WHERE upload_id % 2 = 0 AND ((b - a + n) % n <= 3 OR (a - b + n) % n <= 3)
UNION ALL SELECT upload_id, a, b, 'complete' FROM other WHERE upload_id % 2 = 1"""


def e12_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    return pairing.intrinsic_priors(images.drop("focal_length_35mm"), images).select("job_id", "path", F.col("k")[0][0].alias("f"), F.col("k")[0][2].alias("cx"))


E12 = f"""{JOB_FRAMES}
SELECT upload_id AS job_id, uri AS path, focal_length_35mm / 36.0::DOUBLE * greatest(width, height) AS f, width / 2 AS cx FROM used WHERE focal_length_35mm IS NOT NULL"""

QUERIES = {f.__name__: f for f in (c1_motion_score, c3_adaptive_sample, c3_adaptive_sample_long, d5_offsets, d6_nearest, d9_sync_map, e_job_frames, e5_group_cap, e6_flat_groups, e7_jobs, e8_complete_pairs, e9_window_pairs, e10_sync_pairs, e11_job_pairs, e12_priors, e13_modes)}
ORACLES = dict(zip(QUERIES, (C1, C3, C3, D5, D6, D9, E_FRAMES, E5, E6, E7, E8, E9, E10, E11, E12, E13), strict=True))
