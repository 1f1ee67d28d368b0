"""Point clouds, meshes and rigs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import views
from orrery.functions import scalars as S
from orrery.operators import mesh, points, rig
from orrery.operators.contracts import MeshCleaningConfig
from orrery.plans import pipelines
from orrery.sources import media
from orrery.sources.ply import read_clouds, write_clouds
from orrery.sources.scratch import shared_dir


def b11_rgb_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.points(spark, sf_dir)
    whole = points.colors_to_bytes(p.select("job_id", "view", "pix", *[(F.col(c) * F.when(F.col("job_id") % 2 == 0, 0.5).otherwise(200.0)).alias(c) for c in "rgb"]))
    single = p.select("job_id", "view", "pix", *[S.rgb_to_byte(F.col(c)).alias(f"{c}1") for c in "rgb"])
    return whole.join(single, ["job_id", "view", "pix"])


B11 = f"""{views.sql(views.POINTS)},
s AS (SELECT *, CASE WHEN job_id % 2 = 0 THEN 0.5::DOUBLE ELSE 200::DOUBLE END AS f FROM points),
t AS (SELECT *, max(greatest(r * f, g * f, b * f)) OVER (PARTITION BY job_id) AS top FROM s)
SELECT job_id, view, pix, least(255, greatest(0, CASE WHEN top <= 1 THEN round_even(r * f * 255, 0) ELSE floor(r * f) END))::INTEGER AS r,
       least(255, greatest(0, CASE WHEN top <= 1 THEN round_even(g * f * 255, 0) ELSE floor(g * f) END))::INTEGER AS g,
       least(255, greatest(0, CASE WHEN top <= 1 THEN round_even(b * f * 255, 0) ELSE floor(b * f) END))::INTEGER AS b,
       round_even(least(1, greatest(0, r)) * 255, 0)::INTEGER AS r1, round_even(least(1, greatest(0, g)) * 255, 0)::INTEGER AS g1, round_even(least(1, greatest(0, b)) * 255, 0)::INTEGER AS b1
FROM t"""


def f1_flatten_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    cube = F.array(*[F.array(*[F.slice("e", 1 + 16 * i + 4 * j, 4) for j in range(4)]) for i in range(4)])
    rows = e.select("vec_id", F.posexplode(points.flatten_rows(cube, 3)).alias("row", "p"))
    return rows.select("vec_id", "row", *[F.col("p")[i].alias(c) for i, c in enumerate("xyzw")])


F1 = "SELECT vec_id, k::INTEGER AS row, embedding[4 * k + 1]::DOUBLE AS x, embedding[4 * k + 2]::DOUBLE AS y, embedding[4 * k + 3]::DOUBLE AS z, embedding[4 * k + 4]::DOUBLE AS w FROM embeddings, range(16) t(k)"


def f2_confident_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.confident(views.points(spark, sf_dir))


F2 = f"{views.sql(views.POINTS)} SELECT * FROM points WHERE conf > 1.5 AND NOT isnan(conf) AND isfinite(x + y + z)"


def a5_ply_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/ply-{uuid.uuid4().hex}"
    p = points.confident(views.points(spark, sf_dir))
    byte = lambda c: F.floor(F.least(F.col(c), F.lit(1.0)) * 255).cast("int")
    cloud = p.select(*[F.col(c).cast("float").alias(c) for c in "xyz"], byte("r").alias("red"), byte("g").alias("green"), byte("b").alias("blue"))
    write_clouds(cloud, folder, 300)
    return read_clouds(spark, folder)


A5 = f"""{views.sql(views.POINTS)} SELECT x::FLOAT AS x, y::FLOAT AS y, z::FLOAT AS z, floor(least(r, 1) * 255)::INTEGER AS red, floor(least(g, 1) * 255)::INTEGER AS green, floor(least(b, 1) * 255)::INTEGER AS blue
FROM points WHERE conf > 1.5 AND NOT isnan(conf) AND isfinite(x + y + z)"""


def f3_paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.points(spark, sf_dir).select(F.concat_ws("/", F.col("job_id").cast("string"), F.col("view").cast("string")).alias("cloud_id"), F.col("pix").alias("pos"), "y", "z", "r", "g")
    return points.pair_rows(p.select("cloud_id", "pos", "y", "z"), p.filter("pos < 20").select("cloud_id", "pos", "r", "g"))


F3 = f"{views.sql(views.POINTS)} SELECT job_id || '/' || view AS cloud_id, pix AS pos, y, z, r, g FROM points WHERE pix < 20"


def g1_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.vertices(spark, sf_dir).withColumn("z", F.when((F.col("mesh_id") % 3 == 1) & (F.col("vid") == 7), F.lit(float("nan"))).otherwise(F.col("z")))
    return mesh.validate(v, views.faces(spark, sf_dir).filter("mesh_id % 4 <> 3"))


G1 = f"""{views.sql(views.CELLS, views.FACES, views.VERTICES)}
SELECT mesh_id, CASE WHEN mesh_id % 4 = 3 OR mesh_id NOT IN (SELECT mesh_id FROM faces) THEN 'Mesh must contain at least one point and one cell' WHEN mesh_id % 3 = 1 THEN 'Mesh contains NaN/Inf point coordinates' END AS error
FROM (SELECT DISTINCT mesh_id FROM vertices)"""


def g3_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.vertices(spark, sf_dir).withColumn("z", F.when(F.col("mesh_id") % 2 == 0, F.col("z") / 10).otherwise(F.col("z")))
    return mesh.bounds(v).select("mesh_id", "span_x", "span_y", "span_z", "diagonal", "sheet_like", "default_hole_size")


G3 = f"""{views.sql(views.VERTICES)},
s AS (SELECT mesh_id, max(x) - min(x) AS span_x, max(y) - min(y) AS span_y, max(zz) - min(zz) AS span_z FROM (SELECT *, CASE WHEN mesh_id % 2 = 0 THEN z / 10 ELSE z END AS zz FROM vertices) GROUP BY 1)
SELECT *, sqrt(span_x * span_x + span_y * span_y + span_z * span_z) AS diagonal, least(span_x, span_y, span_z) / greatest(span_x, span_y, span_z) < 0.15 AS sheet_like,
       sqrt(span_x * span_x + span_y * span_y + span_z * span_z) * 0.5 AS default_hole_size FROM s"""


def g4_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.components(views.faces(spark, sf_dir)).groupBy("mesh_id", "component").agg(F.count(F.lit(1)).alias("cells"))


LABELS = f"""{views.sql(views.CELLS, views.FACES, recursive=True)},
ends AS (SELECT DISTINCT mesh_id, vids[1] AS a, unnest(vids) AS b FROM faces),
links AS (SELECT mesh_id, a, b FROM ends UNION SELECT mesh_id, b, a FROM ends),
reach AS (SELECT DISTINCT mesh_id, a AS vid, a AS seen FROM links UNION SELECT r.mesh_id, l.b, r.seen FROM reach r JOIN links l ON r.mesh_id = l.mesh_id AND r.vid = l.a),
label AS (SELECT mesh_id, vid, min(seen) AS component FROM reach GROUP BY ALL),
sizes AS (SELECT f.mesh_id, component, count(*) AS n, sum(fid) AS s FROM faces f JOIN label l ON f.mesh_id = l.mesh_id AND f.vids[1] = l.vid GROUP BY ALL)"""
G4 = f"{LABELS} SELECT mesh_id, component, n AS cells FROM sizes"


def g5_object_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.keep_objects(views.vertices(spark, sf_dir), views.faces(spark, sf_dir))[0].select("mesh_id", "vid", "x", "y", "z")


G5 = f"{views.sql(views.CELLS, views.FACES, views.VERTICES)} SELECT mesh_id, vid, x, y, z FROM vertices JOIN (SELECT DISTINCT mesh_id, unnest(vids) AS vid FROM faces) USING (mesh_id, vid)"


def g6_room_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, few = mesh.keep_large_components(views.faces(spark, sf_dir), 300)
    return kept.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("fid").alias("fid_sum")).withColumn("error", F.lit(None).cast("string")).unionByName(few.select("mesh_id", F.lit(0).cast("long").alias("cells"), F.lit(0).cast("long").alias("fid_sum"), "error"))


G6 = f"""{LABELS}
SELECT mesh_id, coalesce(sum(n) FILTER (n > 300), 0)::BIGINT AS cells, coalesce(sum(s) FILTER (n > 300), 0)::BIGINT AS fid_sum,
       CASE WHEN max(n) <= 300 THEN 'No component exceeded min_cell_count=300 (largest component had ' || max(n) || ' cells); lower the threshold or check the input mesh' END AS error
FROM sizes GROUP BY mesh_id"""


def g9_weld(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every vertex has a second one beside it, nearer or farther than the tolerance, that every other face takes.
    v, f = views.vertices(spark, sf_dir), views.faces(spark, sf_dir)
    step = 0.05 + 0.13 * (F.col("vid") % 5)
    even = F.col("vid") % 2 == 0
    beside = v.select("mesh_id", (F.col("vid") + 1000).alias("vid"), (F.col("x") + F.when(even, step).otherwise(0.0)).alias("x"), "y", (F.col("z") + F.when(even, 0.0).otherwise(step)).alias("z"), "color")
    taken = f.withColumn("vids", F.when(F.col("fid") % 2 == 1, F.transform("vids", lambda x: x + 1000)).otherwise(F.col("vids")))
    v, f = mesh.weld(v.unionByName(beside), taken, 0.01)
    points_ = v.select("mesh_id", F.lit("point").alias("part"), F.col("vid").alias("id"), F.lit("").alias("corners"))
    return points_.unionByName(f.select("mesh_id", F.lit("face").alias("part"), F.col("fid").alias("id"), F.array_join("vids", " ").alias("corners")))


G9 = f"""{views.sql(views.CELLS, views.FACES, views.VERTICES, recursive=True)},
s AS (SELECT *, 0.05::DOUBLE + 0.13::DOUBLE * (vid % 5) AS step FROM vertices),
v AS (
    SELECT mesh_id, vid, x, y, z FROM s
    UNION ALL SELECT mesh_id, vid + 1000, x + CASE WHEN vid % 2 = 0 THEN step ELSE 0 END, y, z + CASE WHEN vid % 2 = 0 THEN 0 ELSE step END FROM s),
d AS (SELECT mesh_id, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2) + power(max(z) - min(z), 2)) * 0.01::DOUBLE AS size FROM v GROUP BY 1),
near AS (
    SELECT a.mesh_id, a.vid AS p, b.vid AS q FROM v a JOIN v b ON a.mesh_id = b.mesh_id AND a.vid <> b.vid JOIN d ON d.mesh_id = a.mesh_id
    WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= size * size),
reach AS (SELECT mesh_id, vid, vid AS seen FROM v UNION SELECT r.mesh_id, n.q, r.seen FROM reach r JOIN near n ON n.mesh_id = r.mesh_id AND n.p = r.vid AND r.seen < n.q),
k AS (SELECT mesh_id, vid, min(seen) AS t FROM reach GROUP BY ALL),
e AS (SELECT mesh_id, fid, unnest(vids) + CASE WHEN fid % 2 = 1 THEN 1000 ELSE 0 END AS vid, generate_subscripts(vids, 1) AS i FROM faces),
n AS (SELECT mesh_id, fid, string_agg(t, ' ' ORDER BY i) AS corners FROM e JOIN k USING (mesh_id, vid) GROUP BY ALL HAVING count(DISTINCT t) = count(*))
SELECT mesh_id, 'point' AS part, vid AS id, '' AS corners FROM k WHERE t = vid UNION ALL SELECT mesh_id, 'face', fid, corners FROM n"""


def g10_triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = mesh.triangulate(views.faces(spark, sf_dir))
    return t.select("mesh_id", F.col("vids")[0].alias("a"), F.col("vids")[1].alias("b"), F.col("vids")[2].alias("c"))


G10 = f"""{views.sql(views.CELLS, views.FACES)}
SELECT mesh_id, vids[1] AS a, vids[2] AS b, vids[3] AS c FROM faces UNION ALL SELECT mesh_id, vids[1], vids[3], vids[4] FROM faces WHERE len(vids) = 4"""


def g12_transfer_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.vertices(spark, sf_dir)
    moved = v.select("mesh_id", "vid", (F.col("x") * 1.07 + 0.21).alias("x"), (F.col("y") * 0.93 + 0.13).alias("y"), (F.col("z") + 1.7).alias("z"), F.lit(None).cast("array<double>").alias("color"))
    out = mesh.transfer_colors(v, moved)
    return out.select("mesh_id", "vid", F.col("color")[0].alias("c0"), F.col("color")[1].alias("c1"))


G12 = f"""{views.sql(views.VERTICES)},
t AS (SELECT mesh_id, vid, x * 1.07::DOUBLE + 0.21::DOUBLE AS x, y * 0.93::DOUBLE + 0.13::DOUBLE AS y, z + 1.7::DOUBLE AS z FROM vertices)
SELECT t.mesh_id, t.vid, s.color[1] AS c0, s.color[2] AS c1 FROM t JOIN vertices s ON s.mesh_id = t.mesh_id
QUALIFY row_number() OVER (PARTITION BY t.mesh_id, t.vid ORDER BY (t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) + (t.z - s.z) * (t.z - s.z), s.vid) = 1"""


def g13_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.topology(views.faces(spark, sf_dir))


G13 = f"""{views.sql(views.CELLS, views.FACES)},
d AS (SELECT mesh_id, vids[k] AS a, vids[k % len(vids) + 1] AS b FROM faces, range(1, 5) t(k) WHERE k <= len(vids)),
u AS (SELECT mesh_id, least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS uses FROM d GROUP BY ALL),
c AS (SELECT mesh_id, count(*) FILTER (uses = 1) AS boundary_edge_count, count(*) FILTER (uses > 2) AS non_manifold_edge_count FROM u GROUP BY 1)
SELECT *, boundary_edge_count + non_manifold_edge_count = 0 AS is_watertight, boundary_edge_count + non_manifold_edge_count AS open_edge_count FROM c"""


def g14_clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipelines.clean_meshes(views.vertices(spark, sf_dir), views.faces(spark, sf_dir), MeshCleaningConfig(mode="room", min_cell_count=100))
    return out.reports


def p3_clean_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipelines.clean_meshes(views.ring_vertices(spark, sf_dir), views.ring_faces(spark, sf_dir), MeshCleaningConfig(smoothing_iters=0))
    done = out.reports.select("mesh_id", "input_cell_count", "output_cell_count", "boundary_edge_count", "non_manifold_edge_count", F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("bigint")
    return done.unionByName(out.errors.select("mesh_id", *[none.alias(c) for c in done.columns[1:-1]], "error"))


# Every open edge takes one more triangle, and none is left.
P3 = f"""{views.sql(views.RING_FACES)},
side AS (SELECT mesh_id, least(p, q) AS lo, greatest(p, q) AS hi FROM (SELECT mesh_id, vids[k] AS p, vids[k % 3 + 1] AS q FROM ring_faces, range(1, 4) t(k))),
edge AS (SELECT mesh_id, count(*) AS uses FROM side GROUP BY mesh_id, lo, hi),
rim AS (SELECT mesh_id, count(*) FILTER (uses = 1) AS n FROM edge GROUP BY 1),
f AS (SELECT mesh_id, count(*) AS cells FROM ring_faces GROUP BY 1)
SELECT mesh_id, cells AS input_cell_count, cells + n AS output_cell_count, 0 AS boundary_edge_count, 0 AS non_manifold_edge_count, NULL::VARCHAR AS error FROM f JOIN rim USING (mesh_id)"""


def g7_fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # More cells are left out, so that some holes share a corner.
    f = views.faces(spark, sf_dir).filter(F.floor(F.col("fid") / 2) % 37 != 26)
    _, f = mesh.fill_holes(views.vertices(spark, sf_dir), f, 2.0)
    return mesh.topology(f)


# Left-out cells that touch no other one along an edge, and no side of the lattice: their four edges are loops that are closed.
G7 = f"""{views.sql(views.CELLS, views.FACES)},
allc AS (SELECT DISTINCT p_partkey // {views.PARTS_PER_MESH} AS mesh_id, c AS cell, c % {views.LATTICE_WIDTH} AS i, c // {views.LATTICE_WIDTH} AS j FROM part, range({views.PARTS_PER_MESH}) t(c)),
here AS (SELECT * FROM cells WHERE cell % 37 <> 26),
gone AS (SELECT a.mesh_id, a.cell, a.i, a.j FROM allc a ANTI JOIN here c USING (mesh_id, cell)),
alone AS (
    SELECT g.mesh_id, g.cell FROM gone g WHERE i BETWEEN 1 AND {views.LATTICE_WIDTH - 2} AND j BETWEEN 1 AND {views.LATTICE_WIDTH - 2}
    AND NOT EXISTS (SELECT 1 FROM gone o WHERE o.mesh_id = g.mesh_id AND abs(o.i - g.i) + abs(o.j - g.j) = 1)),
d AS (SELECT mesh_id, vids[k] AS a, vids[k % len(vids) + 1] AS b FROM faces, range(1, 5) t(k) WHERE k <= len(vids) AND fid // 2 % 37 <> 26),
u AS (SELECT mesh_id, least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS uses FROM d GROUP BY ALL),
c AS (SELECT mesh_id, count(*) FILTER (uses = 1) AS boundary, count(*) FILTER (uses > 2) AS non_manifold_edge_count FROM u GROUP BY 1),
n AS (SELECT c.mesh_id, boundary - 4 * (SELECT count(*) FROM alone a WHERE a.mesh_id = c.mesh_id) AS boundary_edge_count, non_manifold_edge_count FROM c)
SELECT mesh_id, boundary_edge_count, non_manifold_edge_count, boundary_edge_count + non_manifold_edge_count = 0 AS is_watertight, boundary_edge_count + non_manifold_edge_count AS open_edge_count FROM n"""


def _smoothed(spark: SparkSession, sf_dir: str, mode: str, whole: int) -> DataFrame:
    out = mesh.smooth(views.vertices(spark, sf_dir), mesh.triangulate(views.faces(spark, sf_dir)), mode, 2, 0.1, 20.0, whole)
    return out.select("mesh_id", "vid", *[F.round(c, 9).alias(c) for c in ("x", "y", "z")])


def g8_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smoothed(spark, sf_dir, "object", mesh.WHOLE_VERTICES)


def g8_smooth_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature edges stay lines; as if every mesh were too large for one task."""
    return _smoothed(spark, sf_dir, "room", 0)


def _term(name: str, now: str, before: str | None) -> str:
    """The next polynomial from the one before it and the one before that."""
    move = lambda c: f"coalesce((n.{c} + m.{c}) / 2, n.{c})" if before is None else f"coalesce(n.{c} + m.{c} - b.{c}, n.{c})"
    join = "" if before is None else f" JOIN {before} b USING (mesh_id, vid)"
    return f"""
m_{name} AS (SELECT n.mesh_id, n.vid, avg(o.x) AS x, avg(o.y) AS y, avg(o.z) AS z FROM near n JOIN {now} o ON o.mesh_id = n.mesh_id AND o.vid = n.other GROUP BY ALL),
{name} AS (SELECT mesh_id, vid, {", ".join(f"{move(c)} AS {c}" for c in "xyz")} FROM {now} n LEFT JOIN m_{name} m USING (mesh_id, vid){join})"""


def _smooth_sql(lines: str) -> str:
    w = [f"({x!r})::DOUBLE" for x in mesh.sinc_weights(2, 0.1)]
    mix = ", ".join(f"round(CASE WHEN s.vid IS NULL THEN v.{c} ELSE {w[0]} * v.{c} + {w[1]} * one.{c} + {w[2]} * two.{c} END, 9) AS {c}" for c in "xyz")
    return f"""{views.sql(views.CELLS, views.FACES, views.VERTICES)},
tri AS (SELECT mesh_id, 2 * fid AS id, vids[1] AS a, vids[2] AS b, vids[3] AS c FROM faces UNION ALL SELECT mesh_id, 2 * fid + 1, vids[1], vids[3], vids[4] FROM faces WHERE len(vids) = 4),
side AS (SELECT mesh_id, id, least(p, q) AS lo, greatest(p, q) AS hi FROM (SELECT mesh_id, id, a AS p, b AS q FROM tri UNION ALL SELECT mesh_id, id, b, c FROM tri UNION ALL SELECT mesh_id, id, c, a FROM tri)),
d AS (SELECT mesh_id, lo, hi, count(*) AS uses, min(id) AS f, max(id) AS g FROM side GROUP BY ALL),
{lines},
both_ AS (SELECT mesh_id, lo AS vid, hi AS other FROM d UNION ALL SELECT mesh_id, hi, lo FROM d),
along AS (SELECT mesh_id, lo AS vid, hi AS other FROM line UNION ALL SELECT mesh_id, hi, lo FROM line),
ends AS (SELECT mesh_id, vid, count(*) AS n FROM along GROUP BY ALL),
near AS (SELECT a.* FROM along a JOIN ends e USING (mesh_id, vid) WHERE n = 2 UNION ALL SELECT b.* FROM both_ b ANTI JOIN ends e USING (mesh_id, vid)),
seen AS (SELECT DISTINCT mesh_id, vid FROM near),{_term("one", "vertices", None)},{_term("two", "one", "vertices")}
SELECT v.mesh_id, v.vid, {mix} FROM vertices v JOIN one USING (mesh_id, vid) JOIN two USING (mesh_id, vid) LEFT JOIN seen s ON s.mesh_id = v.mesh_id AND s.vid = v.vid"""


G8 = _smooth_sql("line AS (SELECT mesh_id, lo, hi FROM d WHERE uses <> 2)")
G8_ROOM = _smooth_sql("""
p AS (
    SELECT mesh_id, id, (y.y - x.y) * (z.z - x.z) - (y.z - x.z) * (z.y - x.y) AS nx, (y.z - x.z) * (z.x - x.x) - (y.x - x.x) * (z.z - x.z) AS ny, (y.x - x.x) * (z.y - x.y) - (y.y - x.y) * (z.x - x.x) AS nz
    FROM tri t JOIN vertices x USING (mesh_id) JOIN vertices y USING (mesh_id) JOIN vertices z USING (mesh_id) WHERE x.vid = a AND y.vid = b AND z.vid = c),
line AS (
    SELECT mesh_id, lo, hi FROM d LEFT JOIN p ON d.mesh_id = p.mesh_id AND d.f = p.id LEFT JOIN p q ON d.mesh_id = q.mesh_id AND d.g = q.id
    WHERE uses <> 2 OR (p.nx * q.nx + p.ny * q.ny + p.nz * q.nz) / sqrt((p.nx * p.nx + p.ny * p.ny + p.nz * p.nz) * (q.nx * q.nx + q.ny * q.ny + q.nz * q.nz)) < cos(radians(20)))""".replace("SELECT mesh_id, lo, hi FROM d LEFT", "SELECT d.mesh_id, lo, hi FROM d LEFT"))


def g11_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tri = mesh.triangulate(views.faces(spark, sf_dir))
    _, f = mesh.decimate(views.vertices(spark, sf_dir), tri, 0.5)
    n = lambda df, name: df.groupBy("mesh_id").agg(F.count(F.lit(1)).alias(name))
    points_ = f.select("mesh_id", F.explode("vids").alias("vid")).distinct()
    bodies = mesh.components(f).select("mesh_id", "component").distinct()
    edges = mesh.edge_uses(f)
    each = n(f, "cells").join(n(points_, "points"), "mesh_id").join(n(edges, "edges"), "mesh_id").join(n(bodies, "bodies"), "mesh_id").join(n(tri, "before"), "mesh_id")
    each = each.join(edges.groupBy("mesh_id").agg(F.count_if(F.col("uses") > 2).alias("non_manifold_edge_count")), "mesh_id")
    return each.select("mesh_id", "bodies", (F.col("points") - F.col("edges") + F.col("cells")).alias("euler"), "non_manifold_edge_count", (F.col("cells") <= F.floor(F.col("before") * 0.5)).alias("within_budget"))


# What a decimation must leave as it is: bodies, Euler number and overused edges of the triangles before it.
G11 = f"""{views.sql(views.CELLS, views.FACES, recursive=True)},
tri AS (SELECT mesh_id, vids[1] AS a, vids[2] AS b, vids[3] AS c FROM faces UNION ALL SELECT mesh_id, vids[1], vids[3], vids[4] FROM faces WHERE len(vids) = 4),
side AS (SELECT mesh_id, least(p, q) AS lo, greatest(p, q) AS hi FROM (SELECT mesh_id, a AS p, b AS q FROM tri UNION ALL SELECT mesh_id, b, c FROM tri UNION ALL SELECT mesh_id, c, a FROM tri)),
edge AS (SELECT mesh_id, lo, hi, count(*) AS uses FROM side GROUP BY ALL),
both_ AS (SELECT mesh_id, lo AS p, hi AS q FROM edge UNION ALL SELECT mesh_id, hi, lo FROM edge),
reach AS (SELECT DISTINCT mesh_id, p AS vid, p AS seen FROM both_ UNION SELECT r.mesh_id, l.q, r.seen FROM reach r JOIN both_ l ON r.mesh_id = l.mesh_id AND r.vid = l.p AND r.seen < l.q),
label AS (SELECT mesh_id, vid, min(seen) AS part FROM reach GROUP BY ALL),
v AS (SELECT mesh_id, count(*) AS points, count(DISTINCT part) AS bodies FROM label GROUP BY 1),
e AS (SELECT mesh_id, count(*) AS edges, count(*) FILTER (uses > 2) AS non_manifold_edge_count FROM edge GROUP BY 1),
f AS (SELECT mesh_id, count(*) AS cells FROM tri GROUP BY 1)
SELECT mesh_id, bodies, points - edges + cells AS euler, non_manifold_edge_count, true AS within_budget FROM v JOIN e USING (mesh_id) JOIN f USING (mesh_id)"""


def _turned(vids: Column) -> Column:
    """A triangle's corners, turned so that the smallest comes first; the winding stays."""
    low = F.array_position(vids, F.array_min(vids)).cast("int") - 1
    at = lambda k: F.get(vids, (low + k) % 3)
    return F.array(at(0), at(1), at(2))


def g15_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = views.vertices(spark, sf_dir), mesh.triangulate(views.faces(spark, sf_dir))
    mixed = f.withColumn("vids", F.when(F.col("fid") % 3 == 0, F.reverse("vids")).otherwise(F.col("vids")))
    oriented = mesh.orient(v, mixed).select("mesh_id", "orientable", _turned(F.col("vids")).alias("t"))
    return oriented.select("mesh_id", "orientable", *[F.col("t")[i].alias(c) for i, c in enumerate("abc")])


# The lattice winds its triangles alike: those of a component (over shared edges) stay so, or turn if their volume is negative.
G15 = f"""{views.sql(views.CELLS, views.FACES, views.VERTICES, recursive=True)},
tri AS (SELECT mesh_id, 2 * fid AS id, vids[1] AS a, vids[2] AS b, vids[3] AS c FROM faces UNION ALL SELECT mesh_id, 2 * fid + 1, vids[1], vids[3], vids[4] FROM faces WHERE len(vids) = 4),
side AS (SELECT mesh_id, id, least(p, q) AS lo, greatest(p, q) AS hi FROM (SELECT mesh_id, id, a AS p, b AS q FROM tri UNION ALL SELECT mesh_id, id, b, c FROM tri UNION ALL SELECT mesh_id, id, c, a FROM tri)),
link AS (SELECT x.mesh_id, x.id, y.id AS other FROM side x JOIN side y ON x.mesh_id = y.mesh_id AND x.lo = y.lo AND x.hi = y.hi AND x.id <> y.id),
reach AS (SELECT mesh_id, id, id AS seen FROM tri UNION SELECT r.mesh_id, l.other, r.seen FROM reach r JOIN link l ON r.mesh_id = l.mesh_id AND r.id = l.id AND r.seen < l.other),
label AS (SELECT mesh_id, id, min(seen) AS part FROM reach GROUP BY ALL),
det AS (
    SELECT t.*, part, x.x * (y.y * z.z - y.z * z.y) - x.y * (y.x * z.z - y.z * z.x) + x.z * (y.x * z.y - y.y * z.x) AS d FROM tri t JOIN label USING (mesh_id, id)
    JOIN vertices x ON x.mesh_id = t.mesh_id AND x.vid = a JOIN vertices y ON y.mesh_id = t.mesh_id AND y.vid = b JOIN vertices z ON z.mesh_id = t.mesh_id AND z.vid = c),
way AS (SELECT mesh_id, a, CASE WHEN s < 0 THEN c ELSE b END AS b, CASE WHEN s < 0 THEN b ELSE c END AS c FROM (SELECT *, sum(d) OVER (PARTITION BY mesh_id, part) AS s FROM det))
SELECT mesh_id, true AS orientable, least(a, b, c) AS a, CASE least(a, b, c) WHEN a THEN b WHEN b THEN c ELSE a END AS b, CASE least(a, b, c) WHEN a THEN c WHEN b THEN a ELSE b END AS c FROM way"""


def j1_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = views.vertices(spark, sf_dir), views.faces(spark, sf_dir)
    mv, mf = mesh.merge_pieces(v, f, v.filter("vid % 2 = 0"), f.filter("fid % 5 = 0"))
    corner = mf.select("mesh_id", F.explode("vids").alias("vid")).groupBy("mesh_id").agg(F.sum("vid").alias("corner_sum"))
    return mv.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("points"), F.sum("vid").alias("vid_sum")).join(mf.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("fid").alias("fid_sum")), "mesh_id").join(corner, "mesh_id")


J1 = f"""{views.sql(views.CELLS, views.FACES, views.VERTICES)},
s AS (SELECT mesh_id, max(vid) + 1 AS dv FROM vertices GROUP BY 1), t AS (SELECT mesh_id, max(fid) + 1 AS df FROM faces GROUP BY 1),
v AS (SELECT mesh_id, vid FROM vertices UNION ALL SELECT mesh_id, vid + dv FROM vertices JOIN s USING (mesh_id) WHERE vid % 2 = 0),
f AS (SELECT mesh_id, fid, list_sum(vids) AS corners FROM faces UNION ALL SELECT mesh_id, fid + df, list_sum(vids) + len(vids) * dv FROM faces JOIN s USING (mesh_id) JOIN t USING (mesh_id) WHERE fid % 5 = 0)
SELECT mesh_id, points, vid_sum, cells, fid_sum, corner_sum FROM (SELECT mesh_id, count(*) AS points, sum(vid)::BIGINT AS vid_sum FROM v GROUP BY 1)
JOIN (SELECT mesh_id, count(*) AS cells, sum(fid)::BIGINT AS fid_sum, sum(corners)::BIGINT AS corner_sum FROM f GROUP BY 1) USING (mesh_id)"""


def j2_first_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    return mesh.first_usable_blocks(
        p.select(F.floor(F.col("p_partkey") / 5).alias("mesh_id"), (F.col("p_partkey") % 5).alias("block_pos"), F.col("p_name").alias("block"), (F.col("p_size") % 3).cast("long").alias("n_points"), (F.col("p_size") % 4).cast("long").alias("n_cells"))
    )


J2 = """
WITH b AS (SELECT p_partkey // 5 AS mesh_id, p_partkey % 5 AS pos, p_name, p_size % 3 > 0 AND p_size % 4 > 0 AS ok FROM part)
SELECT mesh_id, min_by(p_name, pos) FILTER (ok) AS block, CASE WHEN count(*) FILTER (ok) > 1 THEN 'mesh has ' || count(*) FILTER (ok) || ' usable blocks; the first is taken' END AS warning,
       CASE WHEN count(*) FILTER (ok) = 0 THEN 'no usable block' END AS error
FROM b GROUP BY mesh_id"""


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in rig.TEMPLATES])
    ids = views.faces(spark, sf_dir).select("mesh_id").distinct()
    return ids.withColumn("articulation", F.element_at(names, (F.col("mesh_id") % len(rig.TEMPLATES) + 1).cast("int")))


def h1_unit_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rig.unit_normalise(views.vertices(spark, sf_dir), views.faces(spark, sf_dir)).select("mesh_id", "vid", "x", "y", "z")


UNIT = f"""{views.sql(views.CELLS, views.FACES, views.VERTICES)},
used AS (SELECT * FROM vertices JOIN (SELECT DISTINCT mesh_id, unnest(vids) AS vid FROM faces) USING (mesh_id, vid)),
box AS (
    SELECT mesh_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent FROM used GROUP BY 1),
unit AS (SELECT mesh_id, vid, (x - mx) / extent AS x, (y - my) / extent AS y, (z - mz) / extent AS z FROM vertices JOIN box USING (mesh_id))"""
H1 = f"{UNIT} SELECT * FROM unit"


def _joints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v, f = views.vertices(spark, sf_dir), views.faces(spark, sf_dir)
    unit = rig.unit_normalise(v, f)
    return unit, rig.fit_skeletons(unit, f, _kinds(spark, sf_dir))


def h2_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joints(spark, sf_dir)[1].select("mesh_id", "joint_idx", "joint", *[F.round(c, 9).alias(c) for c in ("x", "y", "z")])


def _template_values() -> str:
    return ", ".join(f"({', '.join('NULL' if v is None else repr(v) for v in (t, i, name, *[x for axis in axes for x in axis]))})" for t, joints in rig.TEMPLATES.items() for i, (name, _, *axes) in enumerate(joints))


JOINTS = f"""{UNIT},
templates AS (SELECT * FROM (VALUES {_template_values()}) t(articulation, joint_idx, joint, bx, sx, by_, sy, bz, sz)),
ubox AS (
    SELECT mesh_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM unit JOIN (SELECT DISTINCT mesh_id, unnest(vids) AS vid FROM faces) USING (mesh_id, vid) GROUP BY 1),
kinds AS (SELECT *, {list(rig.TEMPLATES)!r}[mesh_id % {len(rig.TEMPLATES)} + 1] AS articulation FROM ubox),
joints AS (
    SELECT mesh_id, joint_idx, joint, CASE bx WHEN 'min' THEN lx WHEN 'max' THEN hx ELSE (lx + hx) / 2 END + sx * greatest(hx - lx, 1e-6) AS x,
           CASE by_ WHEN 'min' THEN ly WHEN 'max' THEN hy ELSE (ly + hy) / 2 END + sy * greatest(hy - ly, 1e-6) AS y,
           CASE bz WHEN 'min' THEN lz WHEN 'max' THEN hz ELSE (lz + hz) / 2 END + sz * greatest(hz - lz, 1e-6) AS z
    FROM kinds JOIN templates USING (articulation))"""
H2 = f"{JOINTS} SELECT mesh_id, joint_idx, joint, round(x::DOUBLE, 9) AS x, round(y::DOUBLE, 9) AS y, round(z::DOUBLE, 9) AS z FROM joints"


def h4_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rig.skin(*_joints(spark, sf_dir)).select("mesh_id", "vid", "joint_idx", F.round("w", 9).alias("w"))


WEIGHTS = f"""{JOINTS},
raw AS (SELECT u.mesh_id, u.vid, joint_idx, 1 / greatest(sqrt((u.x - j.x) * (u.x - j.x) + (u.y - j.y) * (u.y - j.y) + (u.z - j.z) * (u.z - j.z)), 1e-6) AS w FROM unit u JOIN joints j USING (mesh_id)),
top AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY mesh_id, vid ORDER BY w DESC, joint_idx) <= 4),
weights AS (SELECT mesh_id, vid, joint_idx, w / sum(w) OVER (PARTITION BY mesh_id, vid) AS w FROM top)"""
H4 = f"{WEIGHTS} SELECT mesh_id, vid, joint_idx, round(w::DOUBLE, 9) AS w FROM weights"


def h5_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = rig.pack_influences(rig.skin(*_joints(spark, sf_dir)))
    return packed.select("mesh_id", "vid", F.array_join("joints", " ").alias("joints"), *[F.round(F.col("weights")[i], 6).alias(f"w{i}") for i in range(4)], "error")


PACKED = f"""{WEIGHTS},
p AS (SELECT mesh_id, vid, list(w ORDER BY w DESC, joint_idx) AS ws, list_resize(list(joint_idx ORDER BY w DESC, joint_idx), 4, 0) AS js FROM weights GROUP BY ALL),
packed AS (
    SELECT mesh_id, vid, array_to_string(js, ' ') AS joints, {", ".join(f"round(coalesce(ws[{i + 1}], 0)::DOUBLE, 6) AS w{i}" for i in range(4))}, NULL::VARCHAR AS error FROM p)"""
H5 = f"{PACKED} SELECT * FROM packed"


def h6_bones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rig.bones(_joints(spark, sf_dir)[1])


def _bone_values() -> str:
    return ", ".join(f"({t!r}, {f'{parent}_to_{name}'!r}, {parent!r}, {name!r})" for t, joints in rig.TEMPLATES.items() for name, parent, *_ in joints if parent)


H6 = f"""{JOINTS}, b AS (SELECT * FROM (VALUES {_bone_values()}) t(articulation, bone, parent, child))
SELECT mesh_id, bone, parent, child FROM kinds JOIN b USING (articulation)"""


def h7_rig_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = views.vertices(spark, sf_dir), views.faces(spark, sf_dir)
    r = pipelines.rig_meshes(v, f, _kinds(spark, sf_dir))[2]
    return r.select("mesh_id", "articulation", "vertex_count", "face_count", "joint_count", "bone_count")


H7 = f"""{JOINTS}
SELECT mesh_id, articulation, vertex_count, face_count, joint_count, joint_count - 1 AS bone_count
FROM kinds JOIN (SELECT mesh_id, count(*) AS vertex_count FROM vertices GROUP BY 1) USING (mesh_id) JOIN (SELECT mesh_id, count(*) AS face_count FROM faces GROUP BY 1) USING (mesh_id)
JOIN (SELECT mesh_id, count(*) AS joint_count FROM joints GROUP BY 1) USING (mesh_id)"""

def a8_rig_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = views.vertices(spark, sf_dir), views.faces(spark, sf_dir)
    joints, packed, _ = pipelines.rig_meshes(v, f, _kinds(spark, sf_dir))
    rig_rows = media.rig_metadata(joints, rig.bones(joints), packed)
    read = F.from_json("rig", "bones ARRAY<STRUCT<bone: STRING>>, joints ARRAY<STRUCT<joint: STRING>>, skin ARRAY<STRUCT<vid: BIGINT, joints: ARRAY<INT>, weights: ARRAY<DOUBLE>>>")
    names = lambda c: F.coalesce(F.array_join(F.transform(f"r.{c}s", lambda x: x[c]), " "), F.lit(""))
    each = rig_rows.select("mesh_id", read.alias("r")).select("mesh_id", names("bone").alias("bones"), names("joint").alias("joint_names"), F.explode("r.skin").alias("s"))
    return each.select("mesh_id", "bones", "joint_names", F.col("s.vid").alias("vid"), F.array_join("s.joints", " ").alias("joints"), *[F.round(F.col("s.weights")[i], 6).alias(f"w{i}") for i in range(4)])


A8 = f"""{PACKED}, b AS (SELECT * FROM (VALUES {_bone_values()}) t(articulation, bone, parent, child)),
named AS (SELECT mesh_id, string_agg(joint, ' ' ORDER BY joint_idx) AS joint_names FROM joints GROUP BY 1),
boned AS (SELECT mesh_id, string_agg(bone, ' ' ORDER BY bone) AS bones FROM kinds JOIN b USING (articulation) GROUP BY 1)
SELECT mesh_id, coalesce(bones, '') AS bones, joint_names, vid, joints, w0, w1, w2, w3 FROM packed JOIN named USING (mesh_id) LEFT JOIN boned USING (mesh_id)"""

QUERIES = {f.__name__: f for f in (a5_ply_files, b11_rgb_bytes, f1_flatten_rows, f2_confident_points, f3_paired_rows, g1_validate, g3_bounds, g4_components, g5_object_filter, g6_room_filter, g9_weld, g10_triangulate, g12_transfer_colors, g7_fill_holes, g8_smooth, g8_smooth_room, g11_decimate, g13_topology, g14_clean_report, g15_normals, p3_clean_meshes, j1_merge, j2_first_blocks, a8_rig_metadata, h1_unit_normalise, h2_skeletons, h4_weights, h5_packed, h6_bones, h7_rig_results)}
ORACLES = dict(zip(QUERIES, (A5, B11, F1, F2, F3, G1, G3, G4, G5, G6, G9, G10, G12, G7, G8, G8_ROOM, G11, G13, None, G15, P3, J1, J2, A8, H1, H2, H4, H5, H6, H7), strict=True))
