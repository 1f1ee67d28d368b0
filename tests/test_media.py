"""Expected values of small tables: classification, alignment, jobs, pairs, points, meshes, rigs, live rules."""

from __future__ import annotations

import math
import random
import os
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from orrery import views
from orrery.functions import scalars as S
from orrery.operators import classify, components, contraction, contracts, deliver, jobs, mesh, pairing, points, rig, sampling, sync
from orrery.plans import pipelines
from orrery.registry import shapes
from orrery.sources import media, ply
from orrery.streaming import live

FRAMES = "upload_id long, source_id string, source_order int, pos long, frame_id string, uri string, index int, timestamp_ms double, motion_score double, width int, height int"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def frames(spark, rows):
    """Rows (source, index, time, motion) of upload 1."""
    names = list(dict.fromkeys(r[0] for r in rows))
    return spark.createDataFrame([(1, s, names.index(s), k, f"{s}-{i}", f"file:///in/{s}{i}.png", i, t, m, 640, 480) for k, (s, i, t, m) in enumerate(rows)], FRAMES)


def test_classification(spark):
    items = spark.createDataFrame(
        [(1, 0, "sample.jpg", "image/jpeg"), (2, 0, "sample.mp4", "video/mp4"), (3, 0, "cam_a.mp4", "video/mp4"), (3, 1, "cam_b.mp4", "video/mp4"), (4, 0, "photo.jpg", "image/jpeg"), (4, 1, "notes.txt", "text/plain"), (6, 0, "a.jpg", "video/mp4"), (6, 1, "b.mp4", None)],
        "upload_id long, pos int, filename string, mime_type string",
    )
    uploads = spark.createDataFrame([(i,) for i in range(1, 7)], "upload_id long")
    got = {r["upload_id"]: r for r in classify.classify_uploads(uploads, items).collect()}
    assert [got[i]["input_type"] for i in range(1, 7)] == ["single_image", "single_video", "video_folder", "unknown", "unknown", "unknown"]
    assert got[1]["priority_score"] == 0.55 and got[5]["priority_score"] == 0.2 and got[5]["reason"] == "empty payload"
    assert "notes.txt" in got[4]["reason"] and "'single_image', 'single_video'" in got[6]["reason"]
    streams = spark.createDataFrame([("s1", "rtsp"), (None, "WebSocket")], "stream_id string, transport string")
    assert [r["input_type"] for r in classify.classify_streams(streams).collect()] == ["unknown", "live_stream"]


@pytest.mark.parametrize(
    ("uri", "path"),
    [("file:///a%20b/c+d.png", "/a b/c+d.png"), ("file:///C:/x.png", "C:/x.png"), ("file://C:/x.png", "C:/x.png"), ("/plain%41", "/plainA"), ("s3://b/k%20", "s3://b/k%20"), ("/bad%zz", "/bad%zz"), ("rel/x", "rel/x")],
)
def test_uri_path(spark, uri, path):
    assert one(spark, S.uri_path(F.lit(uri))) == path


def test_scalars(spark):
    assert [one(spark, S.suffix(F.lit(x))) for x in ("a.JPG", ".jpg", "a.", "a/b.c/d", "x.tar.gz")] == [".jpg", "", "", "", ".gz"]
    assert [one(spark, S.rgb_to_byte(F.lit(x))) for x in (0.0, 0.5, 1.0, -0.5, 1.5, 0.2, 0.4, 0.6)] == [0, 128, 255, 0, 255, 51, 102, 153]
    assert [one(spark, S.rational(F.lit(x))) for x in ("50/2", "3/0", "x", "7", "1/2/3")] == [25.0, None, None, 7.0, None]
    k = one(spark, S.k_matrix(F.lit(50.0), F.lit(64), F.lit(64)))
    assert k[0][0] == 50.0 / 36 * 64 and k[0][2] == k[1][2] == 32
    assert one(spark, S.fit_within(F.lit(4000), F.lit(1))) == Row(w=1024, h=1)
    assert one(spark, S.subject(F.lit(""), F.lit(None).cast("string"))) == "anonymous:unknown"


def test_sampling(spark):
    rows = [(1, i, 0.2 if 20 <= i < 40 else 0.0, 12.0) for i in range(60)] + [(2, 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "video_id long, index int, motion_score double, fps double")
    kept = sorted((r["video_id"], r["index"], r["sample_index"]) for r in sampling.adaptive_sample(df).collect())
    assert [i for v, i, _ in kept if v == 1] == [0, 20, 24, 28, 32, 36] and (2, 0, 0) in kept
    assert sorted((r["video_id"], r["index"], r["sample_index"]) for r in sampling.adaptive_sample_long(df).collect()) == kept


def test_offset_and_map(spark):
    motion = [0.01, 0.2, 0.04, 0.3]
    f = frames(spark, [("cam_a", i, 500.0 * i, m) for i, m in enumerate(motion)] + [("cam_b", i, 500.0 * (i + 1), m) for i, m in enumerate(motion)])
    usable = sync.usable_frames(f)
    assert [r["offset_ms"] for r in sync.offsets(usable, sync.anchors(usable)).collect()] == [-500.0]
    entries = sync.sync_map(f).orderBy("entry_pos").collect()
    assert [e["aligned_frames"] for e in entries] == [{"cam_a": i, "cam_b": i} for i in range(4)] and entries[0]["offsets_ms"] == {"cam_b": -500.0}


def test_alignment_edges(spark):
    still = frames(spark, [("a", 0, 0.0, 0.0), ("a", 1, 1000.0, None), ("b", 0, 120.0, 0.0), ("b", 1, 1120.5, 0.0), ("c", 0, None, 0.1)])
    entries = sync.sync_map(still).collect()
    assert [e["aligned_frames"] for e in entries] == [{"a": 0, "b": 0}]  # 120 ms apart is in, 120.5 out
    shared = frames(spark, [("a", 0, 0.0, 0.0), ("a", 1, 10.0, 0.0), ("a", 2, 500.0, 0.0), ("b", 0, 5.0, 0.0), ("b", 1, 500.0, 0.0)])
    assert sorted(e["aligned_frames"]["a"] for e in sync.sync_map(shared).collect()) == [0, 2]
    assert sync.sync_map(frames(spark, [("a", 0, 0.0, 0.0)])).count() == 0


def test_sync_map_finds_nearest_frames_once(spark):
    # The pass over the entries and the join after it read a table of them; neither goes through the alignment again.
    two = frames(spark, [(s, i, 100.0 * i, 0.1 * (i % 3)) for s in "ab" for i in range(4)])
    plan = sync.sync_map(two)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and "collect_list" not in plan
    # What alignment doesn't read isn't kept for it.
    assert not {"uri", "frame_id", "width"} & set(sync.usable_frames(two).columns)


def test_job_frames(spark):
    for n in (40, 41):
        f = frames(spark, [("v", i, float(i), None if i == 7 else (i % 5) / 10) for i in range(n)])
        got = jobs.job_frames(f).orderBy("output_pos").collect()
        assert len(got) == 40 and [r["output_pos"] for r in got] == list(range(40))
        want = sorted(range(n), key=lambda i: (-math.inf if i == 7 else (i % 5) / 10, i), reverse=True)[:40] if n > 40 else list(range(n))
        assert [r["index"] for r in got] == want
    uploads = spark.createDataFrame([(1, "image_folder"), (2, "single_image"), (3, "live_stream"), (4, "video_folder")], "upload_id long, source_type string")
    built = {r["upload_id"]: r for r in jobs.assemble(uploads, jobs.job_frames(f)).collect()}
    assert built[1]["pairing_strategy"] == "swin" and len(built[1]["image_uris"]) == 40
    assert "single_view" in built[2]["error"] and "live streams" in built[3]["error"] and "at least two images" in built[4]["error"]
    lost = f.withColumn("uri", F.when(F.col("index") != 3, F.col("uri")))
    assert jobs.missing_uris(lost).first()["error"] == "Frame v-3 is missing a normalized asset URI"


def test_groups_and_pairs(spark):
    entries = spark.createDataFrame([(1, k, s, k) for k in range(2) for s in ("cam_a", "cam_b")] + [(1, 2, "cam_a", 9)], "upload_id long, entry_pos int, source_id string, index int")
    f = frames(spark, [("cam_b", 0, 5.0, 0.1), ("cam_a", 0, 0.0, 0.1), ("cam_a", 1, 100.0, 0.2), ("cam_b", 1, 103.0, 0.2)])
    resolved, errors = jobs.resolve_groups(entries, f)
    assert errors.first()["error"].endswith("cam_a[9]")
    groups = jobs.cap_groups(resolved)
    flat = jobs.flatten_groups(groups).orderBy("output_pos").collect()
    assert [r["frame_id"] for r in flat] == ["cam_a-0", "cam_b-0", "cam_a-1", "cam_b-1"]
    images = spark.createDataFrame([(1, r["output_pos"], f"/x/{r['uri'].rsplit('/', 1)[1]}") for r in flat], "job_id long, pos int, path string")
    pairs = pairing.sync_pairs(images, groups.withColumnRenamed("upload_id", "job_id")).orderBy("emitted").collect()
    assert [(r["a"], r["b"]) for r in pairs] == [(0, 1), (1, 0), (2, 3), (3, 2)]
    assert pairing.complete_pairs(images).count() == 12 and pairing.window_pairs(images).count() == 12
    strategies = spark.createDataFrame([(1, "complete")], "job_id long, strategy string")
    fallback = pairing.job_pairs(images, groups.withColumnRenamed("upload_id", "job_id").filter("false"), strategies)
    assert fallback.count() == 12 and fallback.filter("how = 'complete'").count() == 12


def test_params(spark):
    df = spark.createDataFrame([({"pairing_strategy": "swin", "other": "1"}, {"pairing_strategy": "complete"}), ({"pairing_strategy": "swin"}, None)], "recommended map<string,string>, explicit map<string,string>")
    assert [r["params"]["pairing_strategy"] for r in jobs.overlay_params(df).collect()] == ["complete", "swin"]


def test_contracts(spark):
    header = spark.createDataFrame([(1, "image_folder", "track_a_batch", 0.5, 2), (None, "x", "track_a_batch", 1.5, -1)], "upload_id long, source_type string, track string, compute_priority_score double, frame_count int")
    good, bad = contracts.check(header, contracts.payload_rules())
    assert good.count() == 1 and bad.first()["violations"] == ["upload_id", "source_type", "score", "frame_count"]
    with pytest.raises(ValueError, match="decimate"):
        contracts.MeshCleaningConfig(decimate_target_reduction=1.0)
    joints = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "mesh_id long, joint string")
    found = contracts.skeleton_violations(joints, joints.withColumnRenamed("joint", "bone").filter("mesh_id = 2"), spark.createDataFrame([(1, 0)], "mesh_id long, vid long"))
    assert sorted((r["mesh_id"], r["code"]) for r in found.collect()) == [(1, "joint_names"), (2, "no_weights")]


def test_delivery(spark):
    r = spark.createDataFrame([("cube", "print"), ("unknown", "editing"), ("live_stream", "live"), ("image_folder", "viewing")], "input_type string, use_case string")
    got = deliver.deliverables(deliver.route(r), F.col("input_type")).collect()
    assert [x["error"] for x in got] == ["unknown_input_type", "invalid_pair", None, None]
    assert [x["status"] for x in got] == ["rejected", "rejected", "not_implemented", "delivered"] and re.fullmatch(r"point_clouds/JOB_[0-9A-F]{6}_points\.ply", got[3]["output_path"])
    assert one(spark, deliver.refined_path(F.lit("o.p/mesh"))) == "o.p/mesh_refined.glb" and one(spark, deliver.cleaned_path(F.lit("m.tar.ply"))) == "m.tar.cleaned.ply"


def test_points_and_ply(spark, tmp_path):
    rows = [(0, i, 0.1 * i, 0.0, 0.0, 0.2, 0.4, 0.6, 0.5 if i == 3 else 2.0) for i in range(16)] + [(0, 16, float("nan"), 0.0, 0.0, 0.0, 0.0, 0.0, 2.0), (0, 17, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, float("nan"))]
    p = spark.createDataFrame(rows, "job_id long, pix int, x double, y double, z double, r double, g double, b double, conf double")
    kept = points.confident(p)
    assert kept.count() == 15
    cloud = points.colors_to_bytes(kept).selectExpr("cast(x as float) x", "cast(y as float) y", "cast(z as float) z", "r red", "g green", "b blue")
    spark.dataSource.register(ply.PlySource)
    out = str(tmp_path / "cloud")
    cloud.repartition(3).write.format("ply").mode("append").save(out)
    back = spark.read.format("ply").load(out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cloud.collect())) and back.first()["red"] == 51
    names = os.listdir(out)
    assert len(names) == 3 and all(x.endswith(".ply") for x in names)
    assert one(spark, points.flatten_rows(F.array(F.array(F.array(F.lit(1), F.lit(2)))), 3)) == [[1, 2]]


def test_catalog_and_payloads(spark, tmp_path):
    for name in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.png").write_bytes(b"x")
    files = media.catalog(spark, f"file://{tmp_path}")
    assert [r["path"].rsplit("/", 1)[1] for r in files.collect()] == ["a.png", "b.JPG"] and media.catalog_error(files).first()["error"] is None
    payload = spark.createDataFrame([("u", "image_folder", 0.3, 1)], "upload_id string, source_type string, compute_priority_score double, frame_count int")
    media.write_payloads(payload, str(tmp_path / "p"))
    (tmp_path / "p" / "bad.json").write_text("{oops")
    got = media.read_payloads(spark, str(tmp_path / "p" / "*.json")).collect()
    assert {r["upload_id"] for r in got} == {"u", None} and any(r[media.CORRUPT] for r in got)


VERTEX, FACE = "mesh_id long, vid long, x double, y double, z double, color array<double>", "mesh_id long, fid long, vids array<bigint>"


def sphere(n=8, rings=7, cap=False, mesh_id=1, radius=0.5):
    """A ball of latitude rings; without its top ring if ``cap``."""
    v = [(0.0, 0.0, -radius)]
    for i in range(1, rings):
        t = math.pi * i / rings - math.pi / 2
        v += [(radius * math.cos(t) * math.cos(2 * math.pi * k / n), radius * math.cos(t) * math.sin(2 * math.pi * k / n), radius * math.sin(t)) for k in range(n)]
    f = [[0, 1 + (k + 1) % n, 1 + k] for k in range(n)]
    for i in range(rings - 2):
        for k in range(n):
            a, b = 1 + i * n + k, 1 + i * n + (k + 1) % n
            f += [[a, b, b + n], [a, b + n, a + n]]
    if not cap:
        v.append((0.0, 0.0, radius))
        f += [[len(v) - 1, 1 + (rings - 2) * n + k, 1 + (rings - 2) * n + (k + 1) % n] for k in range(n)]
    return [(mesh_id, i, *p, [p[0] + 0.5, p[1] + 0.5, p[2] + 0.5]) for i, p in enumerate(v)], [(mesh_id, i, x) for i, x in enumerate(f)]


def plane(n, mesh_id=2, shift=0.0, first=0, first_face=0):
    v = [(mesh_id, first + i * (n + 1) + k, i + shift, float(k), 0.0, [0.1, 0.2, 0.3]) for i in range(n + 1) for k in range(n + 1)]
    f = []
    for i in range(n):
        for k in range(n):
            a = first + i * (n + 1) + k
            f += [[a, a + n + 1, a + n + 2], [a, a + n + 2, a + 1]]
    return v, [(mesh_id, first_face + i, x) for i, x in enumerate(f)]


def tables(spark, *parts):
    return spark.createDataFrame([r for v, _ in parts for r in v], VERTEX), spark.createDataFrame([r for _, f in parts for r in f], FACE)


def test_components_of_chains(spark):
    n = 300
    order = [(i * 7919) % n for i in range(n)]
    edges = [(order[i], order[i + 1]) for i in range(n - 1) if i % 100 != 99]
    got = components.connected_components(spark.createDataFrame([*edges, (5, 5), (None, 3)], "src long, dst long"))
    label = {}
    for part in range(0, n, 100):
        label |= dict.fromkeys(order[part : part + 100], min(order[part : part + 100]))
    assert {r["vertex"]: r["component"] for r in got.collect()} == label
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_holed_sphere_is_closed(spark):
    v, f = tables(spark, sphere(cap=True), plane(4), plane(4, shift=9.0, first=100, first_face=100))
    before = {r["mesh_id"]: r for r in mesh.topology(f).collect()}
    assert before[1]["boundary_edge_count"] == 8 and not before[1]["is_watertight"]
    v2, f2 = mesh.fill_holes(v, f)
    after = {r["mesh_id"]: r for r in mesh.topology(f2).collect()}
    assert after[1]["is_watertight"] and after[2]["boundary_edge_count"] == before[2]["boundary_edge_count"]
    assert v2.filter("mesh_id = 1 and size(color) = 3").count() == v.filter("mesh_id = 1").count() + 1
    labelled = mesh.components(f).select("mesh_id", "component").distinct().groupBy("mesh_id").count().collect()
    assert dict(map(tuple, labelled)) == {1: 1, 2: 2}
    kept, few = mesh.keep_large_components(f, 40)
    assert kept.select("mesh_id").distinct().count() == 1 and few.first()["error"].startswith("No component exceeded min_cell_count=40 (largest component had 32 cells)")


def test_orientation_and_normals(spark):
    v, f = tables(spark, sphere())
    mixed = f.withColumn("vids", F.when(F.col("fid") % 3 == 0, F.reverse("vids")).otherwise(F.col("vids")))
    out = mesh.orient(v, mixed)
    assert out.filter("not orientable").count() == 0
    normals = mesh.vertex_normals(v, out.select("mesh_id", "fid", "vids")).join(v, ["mesh_id", "vid"])
    assert normals.filter("nx * x + ny * y + nz * z <= 0").count() == 0
    strip = [(1, i, float(i // 2), float(i % 2), 0.0, None) for i in range(10)]
    band = [[0, 1, 2], [1, 3, 2], [2, 3, 4], [3, 5, 4], [4, 5, 6], [5, 7, 6], [6, 7, 8], [7, 9, 8], [8, 9, 1], [9, 0, 1]]
    mv, mf = spark.createDataFrame(strip, VERTEX), spark.createDataFrame([(1, i, x) for i, x in enumerate(band)], FACE)
    assert mesh.orient(mv, mf).filter("orientable").count() == 0  # a Möbius strip


def test_smoothing_spreads_large_meshes(spark, monkeypatch):
    # A lattice takes few bytes: adaptive execution would merge its partitions into few tasks, but not those of a given number.
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(mesh, "written", lambda df, label, inner=mesh.written: (plans.append(plan(df)), inner(df, label))[1])
    v = spark.createDataFrame([(1, k, float(k % 2), float(k // 2), 0.0) for k in range(4)], "mesh_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(1, 0, [0, 1, 3]), (1, 1, [0, 3, 2])], "mesh_id long, fid long, vids array<long>")
    out = mesh.smooth(v, f, "room", 2, 0.1, 20.0, 0)
    assert out.count() == 4 and "REPARTITION_BY_NUM" in plans[0] and plan(out).count("REPARTITION_BY_NUM") >= 5


def test_smoothing_keeps_volume(spark):
    v, f = tables(spark, sphere(10, 9))
    rough = v.withColumn("z", F.col("z") + F.when(F.col("vid") % 2 == 0, 0.02).otherwise(-0.02))
    smooth = mesh.smooth(rough, f, "object", 3, 0.1)
    spread = lambda df: df.select(F.stddev(F.expr("sqrt(x * x + y * y + z * z)"))).first()[0]
    size = lambda df: df.select(F.avg(F.expr("sqrt(x * x + y * y + z * z)"))).first()[0]
    assert spread(smooth) < spread(rough) and abs(size(smooth) - size(rough)) < 0.05 * size(rough)
    assert mesh.smooth(rough, f, "object", 0, 0.1) is rough


def test_weld_triangulate_decimate(spark):
    v, f = tables(spark, sphere(16, 13))
    twice = v.unionByName(v.withColumn("vid", F.col("vid") + 1000))
    wv, wf = mesh.weld(twice, f, 1e-6)
    assert wv.count() == v.count() and wf.count() == f.count()
    quads = spark.createDataFrame([(1, 0, [0, 1, 2, 3]), (1, 1, [3, 2, 4])], FACE)
    assert mesh.triangulate(quads).select("fid").distinct().count() == 3
    n = f.count()
    _, df = mesh.decimate(v, f, 0.5)
    assert 0 < df.count() <= n * 0.5


def test_colors_and_validation(spark):
    v, f = tables(spark, sphere())
    moved = v.select("mesh_id", "vid", (F.col("x") * 1.01).alias("x"), "y", (F.col("z") + 0.001).alias("z"), F.lit(None).cast("array<double>").alias("color"))
    got = mesh.transfer_colors(v, moved).join(v.select("mesh_id", "vid", F.col("color").alias("want")), ["mesh_id", "vid"])
    assert got.filter("color = want").count() == v.count()
    far = moved.limit(1).withColumn("x", F.lit(500.0))
    assert mesh.transfer_colors(v, far).filter("color is not null").count() == 1
    bad = v.withColumn("x", F.when(F.col("vid") == 3, F.lit(float("nan"))).otherwise(F.col("x")))
    assert "NaN" in mesh.validate(bad, f).first()["error"] and mesh.validate(v, f).first()["error"] is None
    with pytest.raises(mesh.MeshStepError, match="step 'smooth' failed"):
        mesh.run_step("smooth", lambda: 1 / 0)


def test_nearest_points(spark):
    import numpy as np

    from orrery.operators import nearest

    rng = np.random.default_rng(5)
    sides = {}
    for mesh_id, n in ((1, 12_000), (2, 300), (3, 1), (4, 500)):
        p = rng.normal(size=(n, 3))
        p /= np.linalg.norm(p, axis=1)[:, None]
        sides[mesh_id] = np.round(p, 1 if mesh_id == 4 else 6)  # mesh 4: many points stand twice, many are as near
    frame = lambda of: spark.createDataFrame([(m, i, *map(float, x)) for m, p in of.items() for i, x in enumerate(p)], "mesh_id long, vid long, x double, y double, z double")
    source = frame(sides)
    far = {m: p[:3000] * 1.1 + shift for m, p, shift in ((1, sides[1], (500.0, -20.0, 3.0)), (2, sides[2], 0.01), (3, sides[2], 1e6), (4, sides[4], 0.05), (9, sides[3], 0.0))}
    got = {(r[0], r[1]): r[2] for r in nearest.nearest(source, frame(far)).collect()}
    for m, p in far.items():
        if m not in sides:
            assert not any(k[0] == m for k in got)
            continue
        for i, t in enumerate(p):
            d = t - sides[m]
            assert got[m, i] == int((d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]).argmin())
    assert len(got) == sum(len(far[m]) for m in (1, 2, 3, 4))
    # However far the sides lie apart, few leaves meet.
    there, asking = nearest.leaves(source.filter("mesh_id = 1")), nearest.leaves(frame({1: far[1]}))
    tree = nearest.levels(there)
    assert len(tree) > 1 and nearest.candidates(asking, tree).count() < 0.25 * there.count() * asking.count()
    assert nearest.nearest(source.limit(0), frame(far)).count() == 0 == nearest.nearest(source, source.limit(0)).count()


def test_clean_meshes(spark):
    v, f = tables(spark, sphere(cap=True))
    out = pipelines.clean_meshes(v.unionByName(v.withColumn("mesh_id", F.lit(7).cast("long"))), f, contracts.MeshCleaningConfig(smoothing_iters=1))
    r = out.reports.collect()
    assert len(r) == 1 and r[0]["is_watertight"] and r[0]["open_edge_count"] == 0 and r[0]["output_cell_count"] == f.count() + 8
    assert out.errors.collect()[0]["mesh_id"] == 7 and out.vertices.filter("color is null").count() == 0


def test_rigs(spark):
    v, f = tables(spark, sphere(), sphere(mesh_id=2), sphere(mesh_id=3))
    kinds = spark.createDataFrame([(1, "static"), (2, "quadruped"), (3, "biped")], "mesh_id long, articulation string")
    joints, packed, results = pipelines.rig_meshes(v, f, kinds)
    assert {r["mesh_id"]: (r["joint_count"], r["bone_count"]) for r in results.collect()} == {1: (1, 0), 2: (7, 6), 3: (7, 6)}
    for r in packed.collect():
        assert len(r["joints"]) == len(r["weights"]) == 4 and abs(sum(r["weights"]) - 1) < 1e-9
    none = spark.createDataFrame([(1, 0, 0, 0.0)], "mesh_id long, vid long, joint_idx int, w double")
    assert "positive influence" in rig.pack_influences(none).first()["error"]
    assert media.rig_metadata(joints, rig.bones(joints), packed).count() == 3


def test_whole_run(spark):
    f = frames(spark, [("v", i, float(i), 0.1) for i in range(3)])
    f = f.unionByName(f.withColumn("upload_id", F.lit(2).cast("long"))).unionByName(f.withColumn("upload_id", F.lit(3).cast("long")))
    headers = spark.createDataFrame([(1, "image_folder"), (2, "single_image"), (3, "single_video")], "upload_id long, source_type string")
    headers = headers.select("*", F.lit("track_a_batch").alias("track"), F.lit(0.3).alias("compute_priority_score"), F.lit(3).alias("frame_count"))
    v, fa = tables(spark, sphere(cap=True), sphere(mesh_id=3))
    uses = spark.createDataFrame([(1, "editing"), (3, "live")], "upload_id long, use_case string")
    listed = spark.createDataFrame([("data/reconstruction/image_folder_1/image_folder.glb", 10)], "path string, length long")
    out = pipelines.run_jobs(headers, f, v, fa, uses, listed, contracts.MeshCleaningConfig(smoothing_iters=0))
    assert sorted((r["upload_id"], r["step"]) for r in out.errors.collect()) == [(2, "build"), (3, "routing")]
    assert [(r["upload_id"], r["status"]) for r in out.deliverables.collect()] == [(1, "delivered")]
    assert [r["mesh_id"] for r in out.meshes.reports.collect()] == [1]
    assert one(spark, jobs.job_label(F.lit(""), F.lit(None).cast("string"), F.lit("x"))) == "x"


def live_rows(spark, n=70):
    return spark.createDataFrame([("s", i, f"f{i}", 20_000_000 if i == 9 else 100, i != 11) for i in range(n + 2)], "stream_id string, arrival_seq long, frame_id string, payload_bytes long, decodable boolean")


def test_ring(spark):
    d = live.decide(live_rows(spark))
    assert {r["action"] for r in d.filter("arrival_seq in (9, 11)").collect()} == {"payload_too_large", "invalid_frame"}
    assert live.dropped(d).first()["dropped"] == 6 and live.snapshot(d).count() == 64
    assert live.snapshot(d).orderBy(F.col("slot").desc()).first()["frame_id"] == "f71"


def test_rate_limit(spark):
    rows = [(1, i, float(t)) for i, t in enumerate([0, 1, 2, 60, 60.5, 61])]
    df = spark.createDataFrame([(s, i, int(t * 2)) for s, i, t in rows], "subject long, request_id long, at long")
    got = [(r["allowed"], r["remaining"]) for r in live.rate_limit(df, 3, 120).orderBy("request_id").collect()]
    assert got == [(True, 2), (True, 1), (True, 0), (False, 0), (True, 0), (False, 0)]


def run_stream(spark, df, build, tmp_path, name):
    """The rows that a streaming operator gives for ``df`` in three micro-batches."""
    folder = str(tmp_path / name)
    for k in range(3):
        df.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = build(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    f = live_rows(spark)
    got = run_stream(spark, f.withColumn("part", F.floor(F.col("arrival_seq") / 25)), lambda s: live.decide_stream(s, 16), tmp_path, "ring")
    want = live.decide(f, 16).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    reqs = spark.range(90).select((F.col("id") % 2).alias("subject"), F.col("id").alias("request_id"), F.floor(F.col("id") * F.col("id") / 60).alias("at"))
    got = run_stream(spark, reqs.withColumn("part", F.floor(F.col("request_id") / 30)), lambda s: live.rate_limit_stream(s, 5, 40), tmp_path, "limit")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.rate_limit(reqs, 5, 40).select(*got.columns).collect()))
    video = spark.range(120).select((F.col("id") % 2).alias("video_id"), F.floor(F.col("id") / 2).alias("index"), F.when(F.col("id") % 40 < 20, 0.2).otherwise(0.06).alias("motion_score"), F.lit(12.0).alias("fps"))
    got = run_stream(spark, video.withColumn("part", F.floor(F.col("index") / 20)), live.adaptive_sample_stream, tmp_path, "sample")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sampling.adaptive_sample(video).select("video_id", "index", "sample_index").collect()))


def test_plans_stay_on_keys(spark):
    f = frames(spark, [(s, i, 33.0 * i, (i * 7 % 10) / 10) for s in ("a", "b") for i in range(5)])
    usable = sync.usable_frames(f)
    chosen = sync.anchors(usable)
    for df in (sync.sync_map(f), sync.offsets(usable, chosen), jobs.job_frames(f)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert "WindowGroupLimit" in jobs.job_frames(f)._jdf.queryExecution().executedPlan().toString()


def test_only_the_entry_knows_the_training_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "orrery")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as lines:
                        assert "orrery.llm" not in lines.read(), name


def test_holes_of_mixed_winding(spark):
    v, f = tables(spark, sphere(cap=True))
    mixed = f.withColumn("vids", F.when(F.col("fid") % 3 == 0, F.reverse("vids")).otherwise(F.col("vids")))
    fv, ff = mesh.fill_holes(v, mixed, 2.0)
    assert ff.count() == ff.select("fid").distinct().count() and mesh.topology(ff).first()["is_watertight"]
    out = pipelines.clean_meshes(v, mixed, contracts.MeshCleaningConfig(smoothing_iters=0, hole_size=2.0))
    assert out.reports.first()["is_watertight"] and out.faces.count() == ff.count()


def test_empty_and_uncoloured_meshes(spark):
    v, f = tables(spark, sphere(), sphere(mesh_id=2), sphere(mesh_id=3))
    # All points of mesh 2 are one; of mesh 3 only a vertex without faces has a colour.
    v = v.withColumn("x", F.when(F.col("mesh_id") == 2, F.lit(1.0)).otherwise(F.col("x"))).withColumn("y", F.when(F.col("mesh_id") == 2, F.lit(1.0)).otherwise(F.col("y"))).withColumn("z", F.when(F.col("mesh_id") == 2, F.lit(1.0)).otherwise(F.col("z")))
    v = v.withColumn("color", F.when(F.col("mesh_id") != 3, F.col("color")))
    lone = spark.createDataFrame([(3, 10_000, 900.0, 0.0, 0.0, [0.25, 0.5, 0.75])], v.schema)
    # A point cloud's faces degenerate: their corners are welded into one.
    out = pipelines.clean_meshes(v.unionByName(lone), f, contracts.MeshCleaningConfig(smoothing_iters=0, merge_tolerance=0.0))
    assert {r["mesh_id"] for r in out.reports.collect()} >= {1, 3}
    assert out.vertices.filter("mesh_id = 3 and color[0] = 0.25").count() == out.vertices.filter("mesh_id = 3").count() > 0
    welded = pipelines.clean_meshes(v, f, contracts.MeshCleaningConfig(smoothing_iters=0, merge_tolerance=10.0))
    assert {(r["mesh_id"], r["error"]) for r in welded.errors.collect()} >= {(1, "Final mesh is empty after cleaning")}
    assert welded.reports.filter("mesh_id = 1").count() == 0


def test_failures_of_a_run_name_their_step(spark):
    v, f = tables(spark, sphere())
    with pytest.raises(mesh.MeshStepError, match="step 'weld' failed"):
        mesh.run_step("weld", lambda: v.withColumn("x", F.raise_error(F.lit("late")).cast("double")))


def test_defaults_of_the_configuration():
    c = contracts.MeshCleaningConfig()
    assert (c.min_cell_count, c.pass_band, c.merge_tolerance) == (500, 0.1, 1e-5)


def test_synchronised_jobs(spark):
    frames = spark.createDataFrame(
        [("u", s, o, 10 * o + i, f"{s}{i}", f"{s}{i}.png", i, 0.1 * i) for o, s in enumerate("ab") for i in range(3)], "upload_id string, source_id string, source_order int, pos long, frame_id string, uri string, index int, motion_score double"
    )
    frames = frames.unionByName(frames.withColumn("upload_id", F.lit("w"))).unionByName(frames.withColumn("upload_id", F.lit("x")).withColumn("uri", F.when(F.col("frame_id") != "b1", F.col("uri"))))
    entries = spark.createDataFrame([("u", 0, "a", 0), ("u", 0, "b", 0), ("u", 1, "a", 1), ("u", 1, "b", 1), ("w", 0, "a", 0), ("w", 0, "b", 9), ("x", 0, "a", 0)], "upload_id string, entry_pos int, source_id string, index int")
    uploads = spark.createDataFrame([(u, "video_folder") for u in "uwx"], "upload_id string, source_type string")
    used, errors = jobs.used_frames(uploads, frames, entries)
    job = jobs.assemble(uploads.filter("upload_id = 'u'"), used).first()
    assert job["image_uris"] == ["a0.png", "b0.png", "a1.png", "b1.png"] and (job["n_frames"], job["sync_group_count"]) == (6, 2)
    assert {r["upload_id"]: r["error"] for r in errors.collect()} == {"w": "sync_map references a frame that is not present in the payload: b[9]", "x": "Frame b1 is missing a normalized asset URI"}


CUBE = [(0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5)]


def cube(mesh_id, size=(1.0, 1.0, 1.0), first=0, first_face=0, shift=0.0):
    v = [(mesh_id, first + k, shift + size[0] * (k >> 2), size[1] * (k >> 1 & 1), size[2] * (k & 1), [0.1, 0.2, 0.3]) for k in range(8)]
    return v, [(mesh_id, first_face + i, [first + c for c in f]) for i, f in enumerate(CUBE)]


def shape_of(faces):
    """(cells, bodies, Euler number, open edges, overused edges) of triangles."""
    uses, up = {}, {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for f in faces:
        for a, b in zip(f, (*f[1:], f[0]), strict=True):
            uses[min(a, b), max(a, b)] = uses.get((min(a, b), max(a, b)), 0) + 1
            up[top(a)] = top(b)
    return len(faces), len({top(x) for x in up}), len(up) - len(uses) + len(faces), sum(n == 1 for n in uses.values()), sum(n > 2 for n in uses.values())


def test_decimation_keeps_topology(spark):
    holed, pinched = plane(12, mesh_id=6), plane(12, mesh_id=7)
    gone = {6: {40, 41, 90, 91}, 7: {40, 41, 66, 67}}  # two holes apart, and two that share a corner
    holed, pinched = ((v, [f for f in faces if f[1] not in gone[m]]) for m, (v, faces) in ((6, holed), (7, pinched)))
    two = [x + y for x, y in zip(cube(4), cube(4, first=8, first_face=12, shift=5.0), strict=True)]
    shapes = [sphere(64, 63, cap=True), cube(2), cube(3, (10.0, 1.0, 0.01)), two, ([(5, k, float(k), float(k * k), 0.0, None) for k in range(3)], [(5, 0, [0, 1, 2])]), holed, pinched, sphere(24, 23, cap=True, mesh_id=8)]
    v, f = tables(spark, *shapes)
    f = mesh.triangulate(f)
    listed = lambda df: {m: [r["vids"] for r in rows] for m in range(1, 9) for rows in [[r for r in df.collect() if r["mesh_id"] == m]]}
    before = listed(f)
    for reduction, patch in ((0.5, 40_000), (0.9, 40_000), (0.5, 600)):
        dv, df = mesh.decimate(v, f, reduction, patch_faces=patch)
        after = listed(df)
        for m in before:
            (n, *was), (left, *now) = shape_of(before[m]), shape_of(after[m])
            assert now[:2] == was[:2] and now[2] <= was[2] and now[3] == was[3] == 0, m
            assert left <= n and (left <= int(n * (1 - reduction)) or m in (2, 3, 4, 5, 6, 7)), (m, n, left)
            if reduction == 0.5:
                assert left <= n // 2 or m == 5
        assert len(after[5]) == 1
        ids = {(r["mesh_id"], r["vid"]) for r in dv.collect()}
        assert ids == {(m, x) for m, faces in after.items() for face in faces for x in face}
        radius = dv.filter("mesh_id = 1").select(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("r")).agg(F.min("r"), F.max("r")).first()
        assert 0.45 < radius[0] <= radius[1] < 0.51
        assert df.join(f.select("mesh_id", "fid"), ["mesh_id", "fid"]).count() == df.count() == df.select("mesh_id", "fid").distinct().count()
    assert mesh.decimate(v.limit(0), f.limit(0), 0.5)[1].count() == 0


def test_decimated_mesh_stays_in_cleaning(spark):
    v, f = tables(spark, cube(1), sphere(mesh_id=2, cap=True))
    out = pipelines.clean_meshes(v, f, contracts.MeshCleaningConfig(smoothing_iters=0, decimate_target_reduction=0.5))
    assert out.errors.count() == 0 and {r["mesh_id"]: (r["output_cell_count"], r["is_watertight"]) for r in out.reports.collect()}[1] == (6, True)


def test_holes_that_share_corners(spark):
    # Two holes that share a corner, three in a ring around one face, and a hole whose corner the border shares.
    n = 12
    v, f = plane(n, mesh_id=1)
    cell = lambda i, k: 2 * (i * n + k)
    gone = {cell(3, 3), cell(4, 4), cell(8, 3), cell(9, 4), cell(8, 5), cell(7, 4), cell(0, 8), cell(1, 9)}
    left = [x for x in f if x[1] - x[1] % 2 not in gone]
    mixed = [(m, i, x[::-1] if i % 3 == 0 else x) for m, i, x in left]
    for rows in (left, mixed):
        tv, tf = tables(spark, (v, rows))
        fv, ff = mesh.fill_holes(tv, tf, 1.2)
        got = mesh.topology(ff).first()
        assert ff.count() == ff.select("fid").distinct().count() and got["non_manifold_edge_count"] == 0
        # Open stay the border, longer by the two more edges of the cell cut out of it.
        if rows is left:
            assert got["boundary_edge_count"] == 4 * n + 2 and fv.count() == len(v) + 7
    # At a vertex of three fans each hole is closed by itself.
    ring = [(2, 0, 0.0, 0.0, 0.0, None)] + [(2, 1 + k, math.cos(k * math.pi / 6), math.sin(k * math.pi / 6), 0.0, None) for k in range(12)] + [(2, 13 + k, 2 * math.cos(k * math.pi / 6), 2 * math.sin(k * math.pi / 6), 0.0, None) for k in range(12)]
    inner = [[0, 1 + k, 1 + (k + 1) % 12] for k in range(12) if k not in (1, 4, 5, 9)]
    outer = [x for k in range(12) for x in ([1 + k, 13 + k, 13 + (k + 1) % 12], [1 + k, 13 + (k + 1) % 12, 1 + (k + 1) % 12])]
    tv, tf = tables(spark, (ring, [(2, i, x) for i, x in enumerate(inner + outer)]))
    fv, ff = mesh.fill_holes(tv, tf, 1.0)
    assert mesh.topology(ff).first()["boundary_edge_count"] == 12 and fv.count() == 25 + 3 and ff.count() == 32 + 3 + 3 + 4


def test_weld_by_distance(spark):
    r = random.Random(4)
    rows = [(1, k, r.uniform(0, 10), r.uniform(0, 10), r.uniform(0, 1), None) for k in range(400)]
    rows += [(1, 400 + k, rows[k][2] + r.uniform(-0.3, 0.3), rows[k][3], rows[k][4], None) for k in range(100)] + [(1, 500 + k, 5.0, 5.0, 0.5, None) for k in range(50)]
    rows += [(2, 0, -1e-9, 0.0, 0.0, None), (2, 1, 1e-9, 0.0, 0.0, None), (2, 2, 1.0, 0.0, 0.0, None), (2, 3, float("nan"), 0.0, 0.0, None), (2, 4, 1.0, 1.0, 0.0, None)]
    rows += [(3, k, 0.0, 0.0, 0.0, None) for k in range(4)] + [(4, k, 0.09 * k, 0.0, 0.0, None) for k in range(60)]
    v = spark.createDataFrame(rows, VERTEX)
    size = {1: 0.35, 2: 1e-6, 3: 0.0, 4: 0.1}
    got = {(r["mesh_id"], r["vid"]): r["to"] for r in mesh.close_points(v, spark.createDataFrame(list(size.items()), "mesh_id long, size double")).collect()}
    up = {(m, i): i for m, i, *_ in rows}

    def top(m, i):
        while up[m, i] != i:
            i = up[m, i]
        return i

    for m, i, *p, _ in rows:
        for m2, k, *q, _ in rows:
            if m == m2 and i < k and sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) <= size[m] ** 2:
                a, b = sorted((top(m, i), top(m, k)))
                up[m, b] = a
    assert got == {(m, i): top(m, i) for m, i in up}
    # Twins across a cell's border are one, and the faces know it.
    wv, wf = mesh.weld(v.filter("mesh_id = 2 and vid <> 3"), spark.createDataFrame([(2, 0, [0, 2, 4]), (2, 1, [4, 1, 0]), (2, 2, [1, 4, 2])], FACE), 1e-6)
    assert wv.count() == 3 and sorted(r["vids"] for r in wf.collect()) == [[0, 2, 4], [0, 4, 2]]


def test_hot_keys_stream_through(spark):
    # A subject with a third of all requests, an upload with most of the entries: as by hand, and in a few seconds.
    r = random.Random(6)
    rows = [(0 if i % 3 == 0 else r.randrange(1, 400), i, r.randrange(40_000)) for i in range(60_000)]
    got = {(x["subject"], x["request_id"]): (x["allowed"], x["remaining"]) for x in live.rate_limit(spark.createDataFrame(rows, "subject long, request_id long, at long"), 5, 20).collect()}
    held, want = {}, {}
    for subject, i, at in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        own = held[subject] = [t for t in held.get(subject, []) if at - t <= 20]
        want[subject, i] = (len(own) < 5, max(0, 4 - len(own)))
        if len(own) < 5:
            own.append(at)
    assert got == want
    entries = [(u, i, i // 2, [("cam_1", i // 3, 0.0), ("cam_2", i, 0.0)]) for u, n in ((1, 20_000), (2, 7)) for i in range(n)]
    table = spark.createDataFrame(entries, "upload_id long, entry_pos int, anchor_index int, others array<struct<source_id: string, index: int, offset_ms: double>>")
    kept = {(x["upload_id"], x["entry_pos"]) for x in sync.drop_conflicts(table).collect()}
    last, want = {}, set()
    for u, i, a, others in entries:
        used = [a, *[x for _, x, _ in others]]
        if u not in last or all(p != q for p, q in zip(last[u], used, strict=True)):
            last[u] = used
            want.add((u, i))
    assert kept == want


def test_offsets_by_hand(spark):
    r = random.Random(12)
    rows = []
    for u, shift, n in ((1, 350.0, 300), (2, -1234.5, 120), (3, 0.0, 2)):
        scores = [round(r.random() ** 2, 3) for _ in range(n)]
        for cam, (late, order) in {"a": (0.0, 0), "b": (shift, 1)}.items():
            rows += [(u, cam, order, k, 40.0 * k - late + r.randrange(-3, 4), scores[k] + (0.03 if k % 17 == 0 and cam == "b" else 0.0)) for k in range(n - (cam == "b"))]
    frames = spark.createDataFrame(rows, "upload_id long, source_id string, source_order int, pos long, timestamp_ms double, motion_score double").withColumn("index", F.col("pos").cast("int"))
    usable = sync.usable_frames(frames)
    got = {x["upload_id"]: x["offset_ms"] for x in sync.offsets(usable, sync.anchors(usable)).collect()}
    for u in (1, 2):
        by = {c: sorted((t, p, m) for x, c, _, p, t, m in rows if x == u and c == cam) for cam in "ab" for c in [cam]}
        votes = {}
        for i, (ta, _, ma) in enumerate(by["a"]):
            for k, (tc, _, mc) in enumerate(by["b"]):
                if abs(ma - mc) <= 0.03:
                    votes.setdefault(round((ta - tc) / 100.0), []).append(((i, k), ta - tc))
        best = min(votes.values(), key=lambda v: (-len(v), abs(sum(x for _, x in v) / len(v)), min(v)[0]))
        values = sorted(x for _, x in best)
        middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
        assert got[u] == pytest.approx(middle, abs=1e-3)
    assert got[3] == 0.0


def test_contracted_components(spark, monkeypatch):
    r = random.Random(2)
    rows = [(1, k, k + 1) for k in range(3000) if k % 97] + [(2, r.randrange(4000), r.randrange(4000)) for _ in range(3500)] + [(3, 5, 5), (1, None, 4)]
    edges = spark.createDataFrame(rows, "m long, a long, b long").repartition(7).select(*[F.when(F.col(c).isNotNull(), F.struct("m", F.col(c).alias("v"))).alias(n) for c, n in (("a", "src"), ("b", "dst"))])
    want = {tuple(x["vertex"]): tuple(x["component"]) for x in components.connected_components(edges).collect()}
    for spread in (False, True):
        got = contraction.contracted_components(edges, spread).collect()
        assert len(got) == len(want) and {tuple(x["vertex"]): tuple(x["component"]) for x in got} == want
    assert contraction.contracted_components(edges.limit(0)).count() == 0


def test_windowed_sinc(spark):
    w = mesh.sinc_weights(20, 0.1)
    response = lambda k: sum(x * math.cos(j * math.acos(1 - k / 2)) for j, x in enumerate(w))
    assert sum(w) == pytest.approx(1) and response(0.1) == pytest.approx(1, abs=3e-3) and all(abs(response(k / 10)) < 0.05 for k in range(8, 20))
    # By hand, whole and by joins, with an open rim and a vertex that nothing touches.
    v, f = tables(spark, sphere(cap=True), plane(5))
    v = v.unionByName(spark.createDataFrame([(2, 900, 3.0, 3.0, 3.0, None)], VERTEX))
    rows, faces = v.collect(), [(r["mesh_id"], r["vids"]) for r in mesh.triangulate(f).collect()]
    uses = {}
    for m, t in faces:
        for a, b in zip(t, (*t[1:], t[0]), strict=True):
            uses[m, min(a, b), max(a, b)] = uses.get((m, min(a, b), max(a, b)), 0) + 1
    near, rim = {}, {}
    for (m, a, b), n in uses.items():
        for x, y in ((a, b), (b, a)):
            near.setdefault((m, x), []).append(y)
            if n != 2:
                rim.setdefault((m, x), []).append(y)
    near = {k: rim.get(k, ys) if len(rim.get(k, [0, 0])) == 2 else [] for k, ys in near.items()}
    xyz = {(r["mesh_id"], r["vid"]): [r["x"], r["y"], r["z"]] for r in rows}
    step = lambda p: {k: [sum(p[k[0], o][i] for o in near[k]) / len(near[k]) for i in range(3)] if near.get(k) else x for k, x in p.items()}
    w = mesh.sinc_weights(4, 0.3)
    before, now = xyz, {k: [(a + b) / 2 for a, b in zip(xyz[k], m, strict=True)] for k, m in step(xyz).items()}
    want = {k: [w[0] * a + w[1] * b for a, b in zip(xyz[k], now[k], strict=True)] for k in xyz}
    for x in w[2:]:
        mean = step(now)
        before, now = now, {k: [a + b - c for a, b, c in zip(now[k], mean[k], before[k], strict=True)] for k in now}
        want = {k: [a + x * b for a, b in zip(want[k], now[k], strict=True)] for k in want}
    want = {k: p if near.get(k) else xyz[k] for k, p in want.items()}
    for whole in (mesh.WHOLE_VERTICES, 0):
        got = {(r["mesh_id"], r["vid"]): [r["x"], r["y"], r["z"]] for r in mesh.smooth(v, mesh.triangulate(f), "object", 4, 0.3, whole=whole).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-9), k


def test_one_mesh_fails_and_the_others_go_on(spark, monkeypatch):
    v, f = tables(spark, *[sphere(cap=True, mesh_id=m) for m in range(1, 11)])
    # Mesh 3 names a vertex that isn't there, mesh 5 has a vertex twice, mesh 9 makes smoothing itself fail.
    f = f.withColumn("vids", F.when((F.col("mesh_id") == 3) & (F.col("fid") == 4), F.array(F.lit(0), F.lit(1), F.lit(77))).otherwise(F.col("vids")))
    v = v.unionByName(v.filter("mesh_id = 5 and vid = 2"))
    inner = mesh.smooth
    breaks = lambda points, *rest: inner(points, *rest).withColumn("x", F.when(F.col("mesh_id") == 9, F.raise_error(F.lit("no such filter")).cast("double")).otherwise(F.col("x")))
    monkeypatch.setattr(mesh, "smooth", breaks)
    out = pipelines.clean_meshes(v, f, contracts.MeshCleaningConfig(smoothing_iters=1))
    assert {r["mesh_id"] for r in out.reports.collect()} == {1, 2, 4, 6, 7, 8, 10}
    errors = {r["mesh_id"]: (r["step"], r["error"]) for r in out.errors.collect()}
    assert errors[3] == ("component_filter", "Mesh cleaning step 'component_filter' failed: face 4 names vertex 77, which isn't there")
    assert errors[5][1].endswith("vertex 2 stands there 2 times") and errors.keys() == {3, 5, 9}
    assert errors[9][0] == "smooth" and "no such filter" in errors[9][1]
    assert out.faces.filter("mesh_id in (3, 5, 9)").count() == 0


def test_idle_subjects_leave_no_state(spark, tmp_path):
    # Subjects 1 to 20 ask in the first file only; when the clock has moved on, their state is gone, and one that comes back starts anew.
    rows = [(s, 100 * k + s, k * 5, 0) for s in range(1, 21) for k in range(6)] + [(99, 10_000 + i, 5_000 + i, 1) for i in range(3)] + [(99, 20_000, 9_000, 2), (3, 20_001, 9_001, 2)] + [(99, 30_000, 9_500, 3)]
    reqs = spark.createDataFrame(rows, "subject long, request_id long, at long, part int")
    folder = str(tmp_path)
    for k in range(4):
        reqs.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema("subject long, request_id long, at long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = live.rate_limit_stream(source, 3, 60, "0 seconds").writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["subject"], r["request_id"]): (r["allowed"], r["remaining"]) for r in spark.table("idle").collect()}
    want = {(r["subject"], r["request_id"]): (r["allowed"], r["remaining"]) for r in live.rate_limit(reqs.drop("part"), 3, 60).collect()}
    assert got == want
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) >= 20 and held[-1] <= 2


def test_subjects_share_few_states(spark, tmp_path):
    # Many subjects, null too, are few groups; each is judged by itself, and one state's subjects go one by one.
    rows = [(s, 1000 * k + s, 3 * k + s % 5, k // 4) for s in range(1, 301) for k in range(12)] + [(None, 60_000 + i, i, 0) for i in range(5)]
    reqs = spark.createDataFrame(rows, "subject long, request_id long, at long, part int")
    got = run_stream(spark, reqs, lambda s: live.rate_limit_stream(s, 3, 10, "0 seconds", 8), tmp_path, "few")
    got = {(r["subject"], r["request_id"]): (r["allowed"], r["remaining"]) for r in got.collect()}
    want = {(r["subject"], r["request_id"]): (r["allowed"], r["remaining"]) for r in live.rate_limit(reqs.filter("subject is not null").drop("part"), 3, 10).collect()}
    of_none = [v for (s, _), v in sorted((k, v) for k, v in got.items() if k[0] is None)]
    assert {k: v for k, v in got.items() if k[0] is not None} == want and of_none == [(True, 2), (True, 1), (True, 0), (False, 0), (False, 0)]
    assert len(want) == 3600 and 0 < spark.read.format("statestore").load(str(tmp_path / "few" / "check")).count() <= 9


def test_joining_up_holds_few_edges():
    # What a task holds of its edges is bounded far below what an executor has for each.
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    def batches():
        for k in range(120):
            i = np.arange(k * 10_000, (k + 1) * 10_000)
            node = lambda d: pa.StructArray.from_arrays([pa.array(i // 1000), pa.array(i % 1000 * 2 + d)], ["mesh_id", "fid"])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([node(0), node(1)], names=["src", "dst"])

    tracemalloc.start()
    assert sum(b.num_rows for b in contraction._labelled(batches())) == 2_400_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_components_of_some_links_are_dealt(spark, monkeypatch):
    # From some thousand links on, labels are dealt by key: a broadcast table of structs takes 64 MB each, however small.
    dealt = []
    monkeypatch.setattr(components, "shuffled", lambda table, inner=components.shuffled: (dealt.append(table), inner(table))[1])
    node = lambda c: F.struct((F.col("id") % 7).alias("mesh_id"), c.alias("vid"))
    edges = spark.range(6000).select(node(F.col("id") - F.col("id") % 2).alias("src"), node(F.col("id") + 10_000).alias("dst"))
    got = components.connected_components(edges)
    assert dealt and got.count() == got.select("vertex").distinct().count() and got.filter("vertex.vid < 10000 and component <> vertex").count() == 0


def test_clouds_on_any_file_system(spark, tmp_path):
    from orrery.sources import ply

    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.cloud.link./in", f"file://{tmp_path}")
    folder = "viewfs://cloud/in/points"  # no mounted path: only the session's file systems know it
    cloud = spark.range(1000).repartition(3).select(*[(F.col("id") * k).cast("float").alias(c) for k, c in enumerate("xyz", 1)], *[(F.col("id") % 256).cast("int").alias(c) for c in ("red", "green", "blue")])
    assert ply.write_clouds(cloud, folder, 150) >= 7
    want = sorted(map(tuple, cloud.collect()))
    assert sorted(map(tuple, ply.read_clouds(spark, folder).collect())) == want
    names = os.listdir(tmp_path / "points")
    assert all(n.endswith(".ply") for n in names if not n.startswith(".")) and ply.read_header(str(tmp_path / "points" / next(n for n in names if n.endswith(".ply"))))[0] <= 150
    # A job that fails leaves nothing that a reader sees, and a second one adds to what is there.
    with pytest.raises(Exception, match="no such point"):
        ply.write_clouds(cloud.withColumn("x", F.when(F.col("x") == 900, F.raise_error(F.lit("no such point")).cast("float")).otherwise(F.col("x"))), folder, 10)
    assert ply.read_clouds(spark, folder).count() == 1000 and not any(n.startswith("_making") for n in os.listdir(tmp_path / "points"))
    assert ply.write_clouds(cloud.limit(0), folder) == 0 and ply.write_clouds(cloud, folder) == 3
    assert ply.read_clouds(spark, folder).count() == 2000
    (tmp_path / "points" / "broken.ply").write_bytes(b"ply\nformat ascii 1.0\n")
    with pytest.raises(Exception, match="has no header of a point cloud"):
        ply.read_clouds(spark, folder).count()


def test_live_frames_lose_and_repeat_nothing(spark, tmp_path):
    from orrery.streaming import frames as source

    spark.dataSource.register(source.LiveFrameSource)
    spool, out, state = (str(tmp_path / n) for n in ("spool", "out", "state"))
    sent = []

    def send(stream, k, payload):
        source.append_frame(spool, stream, f"f{k}", payload)
        sent.append((stream, sum(s == stream for s, *_ in sent), f"f{k}", len(payload), payload[:3] == b"\xff\xd8\xff"))

    def drain():
        rows = spark.readStream.format("live_frames").option("path", spool).load()
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        q.processAllAvailable()
        q.stop()
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    for k in range(20):
        send(f"cam/{k % 3}", k, (b"\xff\xd8\xff" if k % 4 else b"junk") + bytes(k * 50))
    assert drain() == sorted(sent)
    # A query that starts again from its checkpoint goes on where it was, with new streams and half-written records beside.
    for k in range(20, 33):
        send(f"cam/{k % 4}", k, b"\xff\xd8\xff" + bytes(k))
    half = source.spool_file(spool, "cam/1")
    with open(half, "ab") as f:
        f.write(source.HEAD.pack(2, 500) + b"xx123")
    assert drain() == sorted(sent)
    with open(half, "ab") as f:
        f.write(bytes(497))
    sent.append(("cam/1", sum(s == "cam/1" for s, *_ in sent), "xx", 500, False))
    assert drain() == sorted(sent) and drain() == sorted(sent)
    decided = live.decide(spark.read.parquet(out), 8, 900)
    assert decided.filter("action = 'payload_too_large'").count() == sum(n > 900 for *_, n, _ in sent) and decided.filter("action = 'invalid_frame'").count() == sum(n <= 900 and not ok for *_, n, ok in sent)


def test_every_payload_is_read_back(spark, tmp_path):
    rows = spark.range(25).coalesce(2).select(F.col("id").cast("string").alias("upload_id"), F.lit("image_folder").alias("source_type"), F.lit("track_a_batch").alias("track"), F.lit(0.5).alias("compute_priority_score"))
    media.write_payloads(rows, str(tmp_path / "payloads"))
    back = media.read_payloads(spark, str(tmp_path / "payloads")).collect()
    assert sorted(int(r["upload_id"]) for r in back) == list(range(25)) and all(r[media.CORRUPT] is None for r in back)


def broadcast_keys(df):
    """The keys of each join that sends a side to all tasks."""
    return re.findall(r"BroadcastHashJoin \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())


def test_tables_of_points_are_never_broadcast(spark, monkeypatch):
    # Their files are small, their rows are not: only tables with a row for each mesh may be sent to all tasks.
    found, labelled = [], []
    for module, keys in ((mesh, found), (components, labelled)):
        monkeypatch.setattr(module, "written", lambda df, label, inner=module.written, keys=keys: (keys.extend(broadcast_keys(df)), inner(df, label))[1])
    monkeypatch.setattr(components, "SMALL", 0, raising=False)
    v, f = tables(spark, plane(6))
    v = v.unionByName(v.withColumn("vid", F.col("vid") + 1000).withColumn("x", F.col("x") + 0.1))
    f = f.withColumn("vids", F.when(F.col("fid") % 2 == 1, F.transform("vids", lambda x: x + 1000)).otherwise(F.col("vids")))
    wv, wf = mesh.weld(v, f, 0.02)
    assert wv.count() == 49 and wf.count() == 72
    for df in (wv, wf):
        found += broadcast_keys(df)
    assert all(re.fullmatch(r"mesh_id#\d+L", keys) for keys in found) and not labelled


def test_hole_that_meets_itself_is_closed(spark):
    # A cell hangs on by one corner inside a hole; another hole goes around two such cells, one of them on the other.
    n = 12
    v, f = plane(n, mesh_id=1)
    cell = lambda i, k: 2 * (i * n + k)
    around = {cell(i, k) for i in (2, 3, 4) for k in (2, 3, 4)} - {cell(3, 3), cell(2, 2)}
    around |= {cell(i, k) for i in range(6, 11) for k in range(6, 11)} - {cell(6, 6), cell(7, 7), cell(8, 8)}
    left = [x for x in f if x[1] - x[1] % 2 not in around]
    tv, tf = tables(spark, (v, left))
    fv, ff = mesh.fill_holes(tv, tf, 4.0)
    got = mesh.topology(ff).first()
    assert got["non_manifold_edge_count"] == 0 and got["boundary_edge_count"] == 4 * n
    # Each open edge has taken one triangle: both holes and the three cells are loops.
    assert fv.count() == len(v) + 5 and ff.count() == len(left) + mesh.edge_uses(tf).filter("uses = 1").count() - 4 * n


def test_rigs_of_many_meshes_are_dealt(spark):
    # A few bytes of compressed numbers must not bring all meshes into one task, nor be sent to all of them.
    v, f = tables(spark, *[sphere(mesh_id=k) for k in range(1, 25)])
    kinds = spark.createDataFrame([(k, "biped") for k in range(1, 25)], "mesh_id long, articulation string")
    joints, packed, _ = pipelines.rig_meshes(v, f, kinds)
    records = media.rig_metadata(joints, rig.bones(joints), packed)
    for df in (packed, records):
        assert df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(bool).count() > 1
    assert packed.count() == v.count() and records.count() == 24


def test_meshes_are_oriented_whole_as_by_joins(spark):
    # Turned faces, a second surface, a surface that can't be oriented, polygons, a lone face, three faces on an edge.
    r = random.Random(4)
    strip = [(5, i, float(i // 2), float(i % 2), 0.1 * i, None) for i in range(10)]
    band = [[0, 1, 2], [1, 3, 2], [2, 3, 4], [3, 5, 4], [4, 5, 6], [5, 7, 6], [6, 7, 8], [7, 9, 8], [8, 9, 1], [9, 0, 1]]
    wing = ([(4, i, 1.0 + i % 3, 0.5 * i, float(i * i % 5), None) for i in range(7)], [(4, 0, [0, 1, 2, 3]), (4, 9, [1, 0, 4]), (4, 5, [0, 1, 5]), (4, 7, [2, 6, 3])])
    v, f = tables(spark, sphere(mesh_id=1), sphere(12, 8, cap=True, mesh_id=2), sphere(mesh_id=3), plane(3, mesh_id=3, shift=4.0, first=500, first_face=500), (strip, [(5, i, x) for i, x in enumerate(band)]), wing)
    f = spark.createDataFrame([(m, i, x[::-1] if m in (3, 5) and r.random() < 0.4 else x) for m, i, x in sorted(map(tuple, f.collect()))], FACE)
    f = f.withColumn("vids", F.when(F.col("mesh_id") == 2, F.reverse("vids")).otherwise(F.col("vids")))
    both = [sorted(map(tuple, mesh.orient(v, f, whole).collect())) for whole in (mesh.WHOLE_VERTICES, 60, 0)]
    assert both[0] == both[1] == both[2] == sorted(map(tuple, mesh.orient_dealt(v, f).collect())) and len(both[0]) == f.count()
    assert {x[0] for x in both[0] if not x[3]} == {5}


def test_cleaning_reads_dealt_rows_and_joins_rims_up_at_once(spark, monkeypatch):
    # A file of a few megabytes is one task's; its triangles, and all that cleaning makes of them, are dealt.
    sf, parts = "/root/testdata/sf0.001", 4
    assert views.ring_faces(spark, sf).rdd.getNumPartitions() == parts and views.ring_vertices(spark, sf).count() > 0
    seen, rounds = [], []
    for module in (pipelines, components):
        monkeypatch.setattr(module, "written", lambda df, label, inner=module.written: (seen.append((label, df._jdf.queryExecution().executedPlan().toString())), inner(df, label))[1])
    monkeypatch.setattr(contraction, "connected_components", lambda links, inner=contraction.connected_components: (rounds.append(links.count()), inner(links))[1])
    n = 12
    v, f = plane(n, mesh_id=1)
    gone = {2 * (i * n + k) for i, k in ((2, 2), (3, 3), (4, 2), (6, 8), (8, 8), (9, 9), (7, 4))}
    tv, tf = tables(spark, (v, [x for x in f if x[1] - x[1] % 2 not in gone]))
    out = pipelines.clean_meshes(tv, tf, contracts.MeshCleaningConfig(smoothing_iters=0, hole_size=2.0))
    assert out.reports.first()["boundary_edge_count"] == 4 * n and out.errors.count() == 0
    plans = [plan for label, plan in seen if label == "mesh-input"]
    assert len(plans) == 2 and all("REPARTITION_BY_NUM" in plan and "rangepartitioning" in plan for plan in plans)
    # No rounds over labels: parts of the rim are joined up where they lie, and few links that are left by one task.
    assert not rounds and not any(label == "cc-labels" for label, _ in seen)


def test_faults_name_the_first_lost_corner(spark):
    v, f = tables(spark, sphere(mesh_id=1), sphere(mesh_id=2), sphere(mesh_id=3), sphere(mesh_id=4))
    broken = [(1, 20, [0, 1, 99]), (1, 100, [0, 98, 1]), (2, 200, [0, None, 1]), (3, 300, [0, 1])]
    got = {r["mesh_id"]: r["error"] for r in mesh.faults(v, f.unionByName(spark.createDataFrame(broken, FACE))).collect()}
    assert got == {1: "face 100 names vertex 98, which isn't there", 2: "face 200 has a null corner", 3: "face 300 has fewer than three corners"}
    assert mesh.faults(v, f).count() == 0


def test_clean_report_smooths_in_earnest(spark, monkeypatch):
    # The filter of the registered query takes out what the pass band doesn't hold: with few terms, nearly all of it stays.
    terms = []
    monkeypatch.setattr(mesh, "smooth", lambda *args, inner=mesh.smooth: (terms.append(args[3:5]), inner(*args))[1])
    assert shapes.g14_clean_report(spark, "/root/testdata/sf0.001").count() == 1
    w = mesh.sinc_weights(*terms[0])
    left = lambda k: abs(sum(x * math.cos(j * math.acos(1 - k / 2)) for j, x in enumerate(w)))
    assert len(terms) == 1 and all(left(k / 10) < 0.05 for k in range(8, 41)) and left(0.1) > 0.99
