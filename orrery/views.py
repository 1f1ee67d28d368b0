"""The stored tables seen as media tables, so that every operator can run on them and be checked with SQL.

Each view is given twice: as a DataFrame, and as a SQL text that DuckDB runs over the same tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of uploads with three cameras each, from ``events``: 15 users are an upload, time runs 60,000 times as fast."""
    e = table(spark, sf_dir, "events")
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    cam = (F.col("user_id") % 15 % 3).cast("int")
    upload = F.floor(F.col("user_id") / 15)
    order = Window.partitionBy("upload_id", "source_id").orderBy("ts", "event_id")
    return e.select(
        upload.alias("upload_id"),
        F.concat(F.lit("cam_"), cam).alias("source_id"),
        cam.alias("source_order"),
        F.col("event_id").alias("pos"),
        F.concat(F.lit("f"), "event_id").alias("frame_id"),
        F.concat(F.lit("file:///frames/"), "event_id", F.lit(".png")).alias("uri"),
        F.when(F.col("event_id") % 97 != 0, seconds / 60.0).alias("timestamp_ms"),
        F.when(F.col("event_id") % 89 != 0, F.col("value") / 500).alias("motion_score"),
        (640 + 16 * (F.col("event_id") % 5)).cast("int").alias("width"),
        F.lit(480).alias("height"),
        F.when(F.col("event_id") % 4 != 0, (24 + F.col("event_id") % 30).cast("double")).alias("focal_length_35mm"),
        "ts",
        "event_id",
    ).select(
        "upload_id", "source_id", "source_order", "pos", "frame_id", "uri", (F.row_number().over(order) - 1).alias("index"),
        "timestamp_ms", "motion_score", "width", "height", "focal_length_35mm",
    )


FRAMES = """
frames AS (
    SELECT user_id // 15 AS upload_id, 'cam_' || (user_id % 15 % 3) AS source_id, (user_id % 15 % 3)::INTEGER AS source_order, event_id AS pos,
           'f' || event_id AS frame_id, 'file:///frames/' || event_id || '.png' AS uri,
           (row_number() OVER (PARTITION BY user_id // 15, user_id % 15 % 3 ORDER BY ts, event_id) - 1)::INTEGER AS "index",
           CASE WHEN event_id % 97 <> 0 THEN date_diff('second', TIMESTAMP '2024-01-01', ts) / 60.0::DOUBLE END AS timestamp_ms,
           CASE WHEN event_id % 89 <> 0 THEN value / 500 END AS motion_score, (640 + 16 * (event_id % 5))::INTEGER AS width, 480 AS height,
           CASE WHEN event_id % 4 <> 0 THEN (24 + event_id % 30)::DOUBLE END AS focal_length_35mm
    FROM events)"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each upload of ``frames``, with a source type by its number."""
    types = F.array(*[F.lit(t) for t in UPLOAD_TYPES])
    ids = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 15).alias("upload_id")).distinct()
    return ids.withColumn("source_type", F.element_at(types, (F.col("upload_id") % len(UPLOAD_TYPES) + 1).cast("int")))


UPLOAD_TYPES = ("video_folder", "single_video", "image_folder", "video_folder", "single_image", "live_stream", "unknown")
UPLOADS = f"""
uploads AS (
    SELECT DISTINCT user_id // 15 AS upload_id, {list(UPLOAD_TYPES)!r}[user_id // 15 % {len(UPLOAD_TYPES)} + 1] AS source_type FROM events)"""


def media_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of uploads of up to five, from ``documents``: all images, all videos, both, or with unknown ones."""
    d = table(spark, sf_dir, "documents")
    upload, place = F.floor(F.col("doc_id") / 5), F.col("doc_id") % 5
    images, videos = F.array(*map(F.lit, (".jpg", ".PNG", ".webp", ".Tiff", ".bmp"))), F.array(*map(F.lit, (".mp4", ".MOV", ".webm", ".m4v", ".avi")))
    at = (place + 1).cast("int")
    ext = (
        F.when(upload % 4 == 0, F.element_at(images, at)).when(upload % 4 == 1, F.element_at(videos, at))
        .when(upload % 4 == 2, F.when(place < 2, F.element_at(images, at)).otherwise(F.element_at(videos, at)))
        .otherwise(F.when(place == 3, F.lit(".txt")).when(place == 4, F.lit("")).otherwise(F.element_at(images, at)))
    )
    # Every file of an upload in six is an upload of its own; some items repeat a name.
    return d.select(
        F.when(upload % 6 == 5, 1_000_000_000 + F.col("doc_id")).otherwise(upload).alias("upload_id"),
        place.cast("int").alias("pos"),
        F.concat(F.lit("item_"), F.when(F.col("doc_id") % 11 == 4, F.col("doc_id") - 1).otherwise(F.col("doc_id")), ext).alias("filename"),
        F.when(F.col("doc_id") % 13 == 0, F.lit("IMAGE/x-raw")).when(F.col("doc_id") % 17 == 0, F.lit("video/x-raw")).alias("mime_type"),
        (F.col("n_chars") * 50_000).alias("size_bytes"),
    )


MEDIA_ITEMS = """
media_items AS (
    SELECT CASE WHEN doc_id // 5 % 6 = 5 THEN 1000000000 + doc_id ELSE doc_id // 5 END AS upload_id, (doc_id % 5)::INTEGER AS pos,
           'item_' || CASE WHEN doc_id % 11 = 4 THEN doc_id - 1 ELSE doc_id END ||
           CASE WHEN doc_id // 5 % 4 = 0 OR (doc_id // 5 % 4 = 2 AND doc_id % 5 < 2) OR (doc_id // 5 % 4 = 3 AND doc_id % 5 < 3)
                THEN ['.jpg', '.PNG', '.webp', '.Tiff', '.bmp'][doc_id % 5 + 1]
                WHEN doc_id // 5 % 4 < 3 THEN ['.mp4', '.MOV', '.webm', '.m4v', '.avi'][doc_id % 5 + 1]
                WHEN doc_id % 5 = 3 THEN '.txt' ELSE '' END AS filename,
           CASE WHEN doc_id % 13 = 0 THEN 'IMAGE/x-raw' WHEN doc_id % 17 = 0 THEN 'video/x-raw' END AS mime_type, n_chars * 50000 AS size_bytes
    FROM documents)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with colours and confidence, from ``embeddings``: 25 to a view, some with a coordinate that isn't finite."""
    e = table(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    x = F.when(F.col("vec_id") % 53 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 59 == 0, F.lit(float("inf"))).otherwise(F.col("e")[0])
    return e.select(
        F.floor(F.col("vec_id") / 100).alias("job_id"), (F.floor(F.col("vec_id") / 25) % 4).cast("int").alias("view"), (F.col("vec_id") % 25).cast("int").alias("pix"),
        x.alias("x"), F.col("e")[1].alias("y"), F.col("e")[2].alias("z"),
        F.abs(F.col("e")[3]).alias("r"), F.abs(F.col("e")[4]).alias("g"), F.abs(F.col("e")[5]).alias("b"),
        F.when(F.col("vec_id") % 61 == 0, F.lit(float("nan"))).otherwise(F.abs(F.col("e")[6]) * 10).alias("conf"),
    )


POINTS = """
points AS (
    SELECT vec_id // 100 AS job_id, (vec_id // 25 % 4)::INTEGER AS view, (vec_id % 25)::INTEGER AS pix,
           CASE WHEN vec_id % 53 = 0 THEN 'nan'::DOUBLE WHEN vec_id % 59 = 0 THEN 'inf'::DOUBLE ELSE embedding[1]::DOUBLE END AS x,
           embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, abs(embedding[4]::DOUBLE) AS r, abs(embedding[5]::DOUBLE) AS g, abs(embedding[6]::DOUBLE) AS b,
           CASE WHEN vec_id % 61 = 0 THEN 'nan'::DOUBLE ELSE abs(embedding[7]::DOUBLE) * 10 END AS conf
    FROM embeddings)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of subjects in order of time (seconds), from ``events``."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("request_id"), seconds.alias("at"))


REQUESTS = """
requests AS (SELECT user_id AS subject, event_id AS request_id, date_diff('second', TIMESTAMP '2024-01-01', ts) AS "at" FROM events)"""


def live_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded frames of live streams in order of arrival, from ``events``; errors can't be decoded."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), F.row_number().over(order).cast("long").alias("arrival_seq"), F.concat(F.lit("live_"), "event_id").alias("frame_id"),
        F.floor(F.col("value") * 25_000).alias("payload_bytes"), (F.col("event_type") != "error").alias("decodable"),
    )


LIVE_FRAMES = """
live_frames AS (
    SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS arrival_seq, 'live_' || event_id AS frame_id,
           floor(value * 25000)::BIGINT AS payload_bytes, event_type <> 'error' AS decodable
    FROM events)"""

#: Cells in a row of the lattice meshes, and parts to a mesh.
LATTICE_WIDTH, PARTS_PER_MESH = 20, 400


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice cells of meshes, from ``part``: some are left out, which makes holes and separate components."""
    p, w = F.col("p_partkey"), LATTICE_WIDTH
    cell = p % PARTS_PER_MESH
    i, j = cell % w, F.floor(cell / w)
    rows = table(spark, sf_dir, "part").select(F.floor(p / PARTS_PER_MESH).alias("mesh_id"), cell.alias("cell"), i.alias("i"), j.alias("j"), F.col("p_size").alias("size"))
    return rows.filter((F.col("i") != 12) & (F.col("cell") % 37 != 5))


CELLS = f"""
cells AS (
    SELECT * FROM (
        SELECT p_partkey // {PARTS_PER_MESH} AS mesh_id, p_partkey % {PARTS_PER_MESH} AS cell, p_partkey % {PARTS_PER_MESH} % {LATTICE_WIDTH} AS i,
               p_partkey % {PARTS_PER_MESH} // {LATTICE_WIDTH} AS j, p_size AS size FROM part)
    WHERE i <> 12 AND cell % 37 <> 5)"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triangles for each cell; a cell in 41 has one polygon of four vertices instead."""
    c, w = cells(spark, sf_dir), LATTICE_WIDTH + 1
    a = F.col("j") * w + F.col("i")
    quad = F.array(F.array(a, a + 1, a + w + 1, a + w))
    pair = F.array(F.array(a, a + 1, a + w + 1), F.array(a, a + w + 1, a + w))
    each = c.select("mesh_id", "cell", F.posexplode(F.when(F.col("cell") % 41 == 7, quad).otherwise(pair)).alias("k", "vids"))
    return each.select("mesh_id", (F.col("cell") * 2 + F.col("k")).alias("fid"), "vids")


FACES = f"""
faces AS (
    SELECT mesh_id, cell * 2 + k AS fid, CASE WHEN cell % 41 = 7 THEN [a, a + 1, a + w + 1, a + w] WHEN k = 0 THEN [a, a + 1, a + w + 1] ELSE [a, a + w + 1, a + w] END AS vids
    FROM (SELECT *, j * {LATTICE_WIDTH + 1} + i AS a, {LATTICE_WIDTH + 1} AS w FROM cells), (SELECT unnest([0, 1]) AS k)
    WHERE cell % 41 <> 7 OR k = 0)"""


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lattice corners of each mesh, bent into a bowl; some belong to no face."""
    w = LATTICE_WIDTH + 1
    ids = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / PARTS_PER_MESH).alias("mesh_id")).distinct()
    # A few bytes of numbers become all the corners: fixed partitions, which Spark doesn't merge for them.
    dealt = ids.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "mesh_id")
    v = dealt.withColumn("vid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(w * w - 1).cast("long"))))
    x, y = (F.col("vid") % w).cast("double"), F.floor(F.col("vid") / w).cast("double")
    z = ((x - 10) * (x - 10) + (y - 10) * (y - 10)) / 20
    return v.select("mesh_id", "vid", x.alias("x"), y.alias("y"), z.alias("z"), F.array(x / 20, y / 20, F.lit(0.5)).alias("color"))


VERTICES = f"""
vertices AS (
    SELECT mesh_id, vid, x, y, ((x - 10) * (x - 10) + (y - 10) * (y - 10)) / 20 AS z, [x / 20, y / 20, 0.5::DOUBLE] AS color
    FROM (SELECT mesh_id, vid, (vid % {LATTICE_WIDTH + 1})::DOUBLE AS x, (vid // {LATTICE_WIDTH + 1})::DOUBLE AS y
          FROM (SELECT DISTINCT p_partkey // {PARTS_PER_MESH} AS mesh_id FROM part), range({(LATTICE_WIDTH + 1) ** 2}) t(vid)))"""


#: Cells around a ring's tube, cells that an event stands for, and rows of cells to a ring.
TUBE, STRIP, RING_ROWS = 160, 8, 500


def ring_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of rings, from ``events``: each is a strip of cells of a ring's surface; errors and a few more are left out."""
    per_row = TUBE // STRIP
    e = table(spark, sf_dir, "events").filter((F.col("event_type") != "error") & (F.col("event_id") % 41 != 7))
    row = F.floor(F.col("event_id") / per_row)
    # Few bytes of numbers become all the triangles here too.
    e = e.select("event_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    cells = e.select(F.floor(row / RING_ROWS).alias("mesh_id"), (row % RING_ROWS).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(STRIP - 1))).alias("s"), (F.col("event_id") % per_row * STRIP).alias("j0"))
    j = F.col("j0") + F.col("s")
    at = lambda di, dj: (F.col("i") + di) % RING_ROWS * TUBE + (j + dj) % TUBE
    pair = F.array(F.array(at(0, 0), at(1, 0), at(1, 1)), F.array(at(0, 0), at(1, 1), at(0, 1)))
    return cells.select("mesh_id", (2 * at(0, 0)).alias("cell"), F.posexplode(pair).alias("k", "vids")).select("mesh_id", (F.col("cell") + F.col("k")).alias("fid"), "vids")


RING_FACES = f"""
ring_cells AS (
    SELECT event_id // {TUBE // STRIP} // {RING_ROWS} AS mesh_id, event_id // {TUBE // STRIP} % {RING_ROWS} AS i, event_id % {TUBE // STRIP} * {STRIP} + s AS j
    FROM events, range({STRIP}) t(s) WHERE event_type <> 'error' AND event_id % 41 <> 7),
ring_faces AS (
    SELECT mesh_id, 2 * (i * {TUBE} + j) + k AS fid,
           CASE WHEN k = 0 THEN [i * {TUBE} + j, (i + 1) % {RING_ROWS} * {TUBE} + j, (i + 1) % {RING_ROWS} * {TUBE} + (j + 1) % {TUBE}]
                ELSE [i * {TUBE} + j, (i + 1) % {RING_ROWS} * {TUBE} + (j + 1) % {TUBE}, i * {TUBE} + (j + 1) % {TUBE}] END AS vids
    FROM ring_cells, (SELECT unnest([0, 1]) AS k))"""


def ring_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the rings' faces, on a ring of radius 10 with a tube of radius 3."""
    used = ring_faces(spark, sf_dir).select("mesh_id", F.explode("vids").alias("vid")).distinct()
    around, tube = F.floor(F.col("vid") / TUBE) * (2 * math.pi / RING_ROWS), F.col("vid") % TUBE * (2 * math.pi / TUBE)
    far = 10 + 3 * F.cos(tube)
    return used.select("mesh_id", "vid", (far * F.cos(around)).alias("x"), (far * F.sin(around)).alias("y"), (3 * F.sin(tube)).alias("z"), F.lit(None).cast("array<double>").alias("color"))


def sql(*views: str, recursive: bool = False) -> str:
    """The WITH clause that defines ``views``, to go before a SELECT."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(views)
