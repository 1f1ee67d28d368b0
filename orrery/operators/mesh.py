"""Mesh operators on tables of vertices (mesh_id, vid, x, y, z, color) and faces (mesh_id, fid, vids).

All meshes of a table go through an operator together; only smoothing and winding gather a mesh in one place, up to
``WHOLE_VERTICES``. New vertex and face numbers follow those that are there.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.components import connected_components
from orrery.operators.contraction import contracted_components, smallest_reached
from orrery.operators.decimation import decimate as decimate
from orrery.operators.joins import shuffled, spread
from orrery.operators.nearest import nearest
from orrery.sources.scratch import dropped, written

# Names of arrays that hold vertex colours.
COLOR_NAMES = ("RGBA", "RGB", "rgba", "rgb", "COLOR_0", "color_0")
XYZ = ("x", "y", "z")
SHEET_RATIO = 0.15


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def validate(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, error): null for meshes with a vertex and a face and only finite coordinates."""
    v = vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_points"), F.bool_and(_finite("x") & _finite("y") & _finite("z")).alias("finite"))
    f = faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_cells"))
    both = v.join(f, "mesh_id", "full_outer")
    empty = F.col("n_points").isNull() | F.col("n_cells").isNull()
    return both.select("mesh_id", F.when(empty, "Mesh must contain at least one point and one cell").when(~F.col("finite"), "Mesh contains NaN/Inf point coordinates").alias("error"))


def first_usable_blocks(blocks: DataFrame) -> DataFrame:
    """(mesh_id, block, warning, error): the first block in order with points and cells; ``blocks`` has (mesh_id, block_pos, block, n_points, n_cells)."""
    usable = (F.col("n_points") > 0) & (F.col("n_cells") > 0)
    first = F.min_by(F.when(usable, F.col("block")), F.when(usable, F.col("block_pos")))
    each = blocks.groupBy("mesh_id").agg(first.alias("block"), F.count_if(usable).alias("n"))
    warning = F.when(F.col("n") > 1, F.concat(F.lit("mesh has "), F.col("n").cast("string"), F.lit(" usable blocks; the first is taken")))
    return each.select("mesh_id", "block", warning.alias("warning"), F.when(F.col("n") == 0, "no usable block").alias("error"))


def bounds(vertices: DataFrame) -> DataFrame:
    """Per mesh: low and high of each axis, spans, diagonal, ``sheet_like``, and the default hole size."""
    b = vertices.groupBy("mesh_id").agg(*[f(c).alias(f"{n}_{c}") for c in XYZ for f, n in ((F.min, "low"), (F.max, "high"))])
    for c in XYZ:
        b = b.withColumn(f"span_{c}", F.col(f"high_{c}") - F.col(f"low_{c}"))
    spans = F.filter(F.array(*[f"span_{c}" for c in XYZ]), lambda s: s > 1e-12)
    sheet = (F.size(spans) < 3) | (F.array_min(spans) / F.array_max(spans) < SHEET_RATIO)
    diagonal = F.sqrt(sum(F.col(f"span_{c}") * F.col(f"span_{c}") for c in XYZ))
    return b.withColumn("diagonal", diagonal).withColumn("sheet_like", sheet).withColumn("default_hole_size", F.col("diagonal") * 0.5)


def triangulate(faces: DataFrame) -> DataFrame:
    """Polygons cut into fans of triangles: faces (mesh_id, fid, vids) numbered anew in order of face and fan."""
    fans = faces.filter(F.size("vids") > 2).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("vids") - 2)))
    corner = lambda i: F.element_at("vids", i)
    tri = fans.select("mesh_id", F.col("fid").alias("was"), "k", F.array(corner(F.lit(1)), corner(F.col("k") + 1), corner(F.col("k") + 2)).alias("vids"))
    # Numbers leave room for a polygon's triangles: no sort of a whole mesh is needed.
    widest = tri.groupBy("mesh_id").agg(F.max("k").alias("widest"))
    return tri.join(widest, "mesh_id").select("mesh_id", (F.col("was") * F.col("widest") + F.col("k") - 1).alias("fid"), "vids")


def edges(faces: DataFrame) -> DataFrame:
    """Directed edges (mesh_id, fid, a, b) of all faces."""
    return faces.select("mesh_id", "fid", "vids", F.posexplode("vids").alias("k", "a")).select("mesh_id", "fid", "a", F.element_at("vids", F.pmod(F.col("k") + 1, F.size("vids")) + 1).alias("b"))


def edge_uses(faces: DataFrame) -> DataFrame:
    """(mesh_id, lo, hi, uses) of undirected edges."""
    return edges(faces).groupBy("mesh_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count(F.lit(1)).alias("uses"))


def topology(faces: DataFrame) -> DataFrame:
    """(mesh_id, boundary_edge_count, non_manifold_edge_count, is_watertight, open_edge_count)."""
    t = edge_uses(faces).groupBy("mesh_id").agg(F.count_if(F.col("uses") == 1).alias("boundary_edge_count"), F.count_if(F.col("uses") > 2).alias("non_manifold_edge_count"))
    total = F.col("boundary_edge_count") + F.col("non_manifold_edge_count")
    return t.withColumn("is_watertight", total == 0).withColumn("open_edge_count", total)


def components(faces: DataFrame) -> DataFrame:
    """``faces`` with ``component``: the smallest vertex that a face reaches through shared vertices."""
    first = F.element_at("vids", 1)
    links = faces.select("mesh_id", first.alias("a"), F.explode("vids").alias("b"))
    node = lambda c: F.struct("mesh_id", F.col(c).alias("vid"))
    found = contracted_components(links.select(node("a").alias("src"), node("b").alias("dst")))
    labels = found.select(F.col("vertex.mesh_id").alias("mesh_id"), F.col("vertex.vid").alias("first_vid"), F.col("component.vid").alias("component"))
    return faces.withColumn("first_vid", first).join(shuffled(labels), ["mesh_id", "first_vid"]).drop("first_vid")


def keep_objects(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All components stay; vertices of no face go."""
    used = faces.select("mesh_id", F.explode("vids").alias("vid")).distinct()
    return vertices.join(shuffled(used), ["mesh_id", "vid"], "left_semi"), faces


def keep_large_components(faces: DataFrame, min_cell_count: int) -> tuple[DataFrame, DataFrame]:
    """(faces of components with more than ``min_cell_count`` faces, (mesh_id, error) of meshes without one)."""
    labelled = components(faces)
    sizes = labelled.groupBy("mesh_id", "component").agg(F.count(F.lit(1)).alias("n"))
    kept = labelled.join(shuffled(sizes.filter(F.col("n") > min_cell_count).select("mesh_id", "component")), ["mesh_id", "component"], "left_semi").select(*faces.columns)
    most = sizes.groupBy("mesh_id").agg(F.max("n").alias("n")).filter(F.col("n") <= min_cell_count)
    text = F.concat(F.lit(f"No component exceeded min_cell_count={min_cell_count} (largest component had "), F.col("n").cast("string"), F.lit(" cells); lower the threshold or check the input mesh"))
    return kept, most.select("mesh_id", text.alias("error"))


def merge_pieces(vertices: DataFrame, faces: DataFrame, more_vertices: DataFrame, more_faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of two parts of each mesh, without merging points: the second part's numbers follow the first's."""
    shift = vertices.groupBy("mesh_id").agg((F.max("vid") + 1).alias("dv")).join(faces.groupBy("mesh_id").agg((F.max("fid") + 1).alias("df")), "mesh_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    v = more_vertices.join(shift, "mesh_id", "left").withColumn("vid", F.col("vid") + zero("dv")).select(*vertices.columns)
    f = more_faces.join(shift, "mesh_id", "left").withColumn("dv", zero("dv")).withColumn("vids", F.transform("vids", lambda x: x + F.col("dv"))).withColumn("fid", F.col("fid") + zero("df")).select(*faces.columns)
    return vertices.unionByName(v), faces.unionByName(f)


def rim_links(vertices: DataFrame, faces: DataFrame, rim: DataFrame) -> DataFrame:
    """(mesh_id, vid, e, next, shared) of open edges that follow each other around a hole; ``rim`` has (mesh_id, e, fid, a, b).

    At most vertices two open edges meet, whatever their windings. Where rims share a vertex, its faces form fans, each
    with one open edge that comes in and one that goes out: the one that comes into a fan is followed by the one that
    goes out of the next fan around the vertex, so each hole keeps its own loop. Vertices at which fans have no such two
    edges link nothing.
    """
    ends = rim.select("mesh_id", "e", "fid", F.explode(F.array(F.struct(F.col("a").alias("vid"), F.lit(True).alias("out"), F.col("b").alias("other")), F.struct(F.col("b").alias("vid"), F.lit(False).alias("out"), F.col("a").alias("other")))).alias("p")).select("mesh_id", "e", "fid", "p.*")
    at = ends.groupBy("mesh_id", "vid").agg(F.count(F.lit(1)).alias("degree"), F.min("e").alias("e"), F.max("e").alias("next"))
    plain = at.filter("degree = 2").select("mesh_id", "vid", "e", "next", F.lit(False).alias("shared"))
    shared = written(at.filter("degree > 2").select("mesh_id", "vid"), "mesh-pinches")
    if shared.isEmpty():
        return plain
    # Fans: faces around the vertex that share an inner edge there. Corners meet the few vertices before their two sides are rows.
    beside = lambda step: F.element_at("vids", F.pmod(F.col("k") + step, F.size("vids")) + 1)
    corners = faces.select("mesh_id", "fid", "vids", F.posexplode("vids").alias("k", "vid")).select("mesh_id", "fid", "vid", F.array(beside(-1), beside(1)).alias("others"))
    sides = corners.join(shuffled(shared), ["mesh_id", "vid"], "left_semi").select("mesh_id", "fid", "vid", F.explode("others").alias("other"))
    node = lambda c: F.struct("mesh_id", "vid", F.col(c).alias("fid"))
    alike = sides.groupBy("mesh_id", "vid", "other").agg(F.min("fid").alias("f"), F.max("fid").alias("g"))
    found = contracted_components(alike.select(node("f").alias("src"), node("g").alias("dst")), spread=True)
    fans = written(found.select("vertex.*", F.col("component.fid").alias("fan")), "mesh-fans")
    # The order of fans around a vertex: the direction of the edge that goes out, in the plane across the mean normal.
    near = written(triangulate(faces.join(shuffled(fans.select("mesh_id", "fid").distinct()), ["mesh_id", "fid"], "left_semi")), "mesh-near")
    vertices = written(vertices.join(shuffled(near.select("mesh_id", F.explode("vids").alias("vid")).distinct()), ["mesh_id", "vid"], "left_semi").select("mesh_id", "vid", *XYZ), "mesh-near-points")
    around = near.join(shuffled(face_normals(vertices, near)), ["mesh_id", "fid"])
    normal = around.select("mesh_id", F.explode("vids").alias("vid"), "nx", "ny", "nz").join(shuffled(shared), ["mesh_id", "vid"], "left_semi").groupBy("mesh_id", "vid").agg(*[F.sum(c).alias(c) for c in ("nx", "ny", "nz")])
    of = ends.join(shuffled(fans), ["mesh_id", "vid", "fid"])
    pair = of.groupBy("mesh_id", "vid", "fan").agg(F.count_if("out").alias("outs"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("out"), F.col("e"))).alias("gone"), F.max(F.when(~F.col("out"), F.col("e"))).alias("come"), F.max(F.when(F.col("out"), F.col("other"))).alias("towards"))
    p = lambda name, prefix: vertices.select("mesh_id", F.col("vid").alias(name), *[F.col(c).alias(f"{prefix}{c}") for c in XYZ])
    placed = pair.join(shuffled(normal), ["mesh_id", "vid"]).join(shuffled(p("vid", "p")), ["mesh_id", "vid"]).join(shuffled(p("towards", "t")), ["mesh_id", "towards"])
    d = [F.col(f"t{c}") - F.col(f"p{c}") for c in XYZ]
    n = [F.col(f"n{c}") for c in XYZ]
    # Two directions across the normal: u is the axis least along it, made upright, and v = n x u.
    axis = F.array_position(F.array(*[F.abs(x) for x in n]), F.array_min(F.array(*[F.abs(x) for x in n])))
    e = [F.when(axis == k + 1, F.lit(1.0)).otherwise(F.lit(0.0)) for k in range(3)]
    length = sum(x * x for x in n)
    along = sum(a * b for a, b in zip(e, n, strict=True))
    u = [e[k] * length - along * n[k] for k in range(3)]
    v = [n[1] * u[2] - n[2] * u[1], n[2] * u[0] - n[0] * u[2], n[0] * u[1] - n[1] * u[0]]
    angle = F.atan2(sum(a * b for a, b in zip(d, v, strict=True)) / F.greatest(F.sqrt(length), F.lit(1e-300)), sum(a * b for a, b in zip(d, u, strict=True)))
    order = Window.partitionBy("mesh_id", "vid")
    turned = placed.withColumn("angle", angle).withColumn("sound", F.min((F.col("outs") == 1) & (F.col("n") == 2)).over(order))
    turn = order.orderBy("angle", "fan")
    followed = turned.filter("sound").withColumn("next", F.coalesce(F.lead("gone").over(turn), F.first("gone").over(turn)))
    return plain.unionByName(followed.select("mesh_id", "vid", F.col("come").alias("e"), "next", F.lit(True).alias("shared")))


def rim_loops(links: DataFrame) -> DataFrame:
    """``links`` (mesh_id, e, next, …) with ``loop``: the smallest open edge that each link's edges reach."""
    node = lambda c: F.struct("mesh_id", F.col(c).alias("e"))
    found = contracted_components(links.select(node("e").alias("src"), node("next").alias("dst")), spread=True)
    loops = found.select(F.col("vertex.mesh_id").alias("mesh_id"), F.col("vertex.e").alias("e"), F.col("component.e").alias("loop"))
    return links.join(shuffled(loops), ["mesh_id", "e"])


def simple_loops(links: DataFrame) -> DataFrame:
    """The rim's links with ``loop``, where no loop passes a vertex twice; ``links`` are those of ``rim_links``.

    A hole that meets itself at a vertex (around a part of the surface that hangs on by it) has a loop that passes there
    twice; a fan over it would have an edge of four faces. Such a loop is cut in two: of two passes each takes up the
    other's end. All vertices of all loops go at once as long as that leaves fewer such passes; where loops cross, one
    vertex of each loop goes alone, and with its ends joined the other way where windings are mixed.
    """
    whole = written(rim_loops(links), "mesh-rim-loops")
    key = ["mesh_id", "loop", "vid"]

    def repeated(loops: DataFrame) -> DataFrame:
        passes = F.array_sort(F.collect_list(F.struct("e", "next"))).alias("passes")
        return loops.filter("shared").groupBy(*key).agg(passes).filter(F.size("passes") > 1)

    count = lambda twice: twice.agg(F.coalesce(F.sum(F.size("passes") - 1), F.lit(0))).first()[0]
    twice = written(repeated(whole), "mesh-rim-twice")
    n = count(twice)
    if not n:
        return whole
    torn = twice.select("mesh_id", "loop").distinct()
    done = whole.join(shuffled(torn), ["mesh_id", "loop"], "left_anti")
    part = written(whole.join(shuffled(torn), ["mesh_id", "loop"], "left_semi"), "mesh-rim-torn")
    one, two = F.col("passes")[0], F.col("passes")[1]
    crossed = [(one["e"], two["next"]), (two["e"], one["next"])]
    turned = [(one["e"], two["e"]), (one["next"], two["next"])]
    while n:
        # The first two passes of a vertex: beyond those, the next round takes what is left.
        alone = twice.withColumn("nth", F.row_number().over(Window.partitionBy("mesh_id", "loop").orderBy("vid"))).filter("nth = 1")
        for chosen, ways in ((twice, crossed), (alone, crossed), (alone, turned)):
            old = chosen.select("mesh_id", "vid", F.explode(F.slice("passes", 1, 2)["e"]).alias("e"))
            new = chosen.select("mesh_id", "vid", F.explode(F.array(*[F.struct(e.alias("e"), x.alias("next")) for e, x in ways])).alias("p"))
            kept = part.drop("loop").join(shuffled(old), ["mesh_id", "vid", "e"], "left_anti")
            trial = written(rim_loops(kept.unionByName(new.select("mesh_id", "vid", "p.e", "p.next", F.lit(True).alias("shared")))), "mesh-rim-torn")
            left = written(repeated(trial), "mesh-rim-twice")
            if (fewer := count(left)) < n:
                break
            dropped(trial, left)
        else:
            break  # no way to join them leaves fewer: the loops stay as they are
        dropped(part)
        part, twice, n = trial, left, fewer
    return done.unionByName(part.select(*done.columns))


def fill_holes(vertices: DataFrame, faces: DataFrame, hole_size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Closes boundary loops of a radius up to ``hole_size`` with a fan around a new vertex in their middle.

    Without a size, flat meshes stay as they are and others take half their diagonal. Holes that share a vertex are loops
    of their own, and a hole that meets itself at a vertex is closed as two. A loop's radius is its farthest vertex from its middle.
    """
    limit = bounds(vertices).select("mesh_id", F.lit(hole_size).cast("double").alias("limit") if hole_size is not None else F.when(~F.col("sheet_like"), F.col("default_hole_size")).alias("limit")).filter("limit is not null")
    limit = written(limit.join(vertices.groupBy("mesh_id").agg(F.max("vid").alias("top")), "mesh_id"), "mesh-limits")
    widest = faces.groupBy("mesh_id").agg(F.max(F.size("vids")).cast("long").alias("widest"), F.max("fid").alias("last"))
    sided = faces.select("mesh_id", "fid", "vids", F.posexplode("vids").alias("k", "a")).select("mesh_id", "fid", "k", "a", F.element_at("vids", F.pmod(F.col("k") + 1, F.size("vids")) + 1).alias("b"))
    # An open edge is a side of one face only: its sums are that side, which numbers it, and what is made from it.
    sums = sided.groupBy("mesh_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count(F.lit(1)).alias("uses"), F.min("fid").alias("fid"), F.min("k").alias("k"), F.min(F.col("a") < F.col("b")).alias("up"))
    rim = sums.filter("uses = 1").join(limit.select("mesh_id"), "mesh_id", "left_semi").join(widest, "mesh_id")
    ends = (F.when(F.col("up"), F.col(x)).otherwise(F.col(y)).alias(name) for name, x, y in (("a", "lo", "hi"), ("b", "hi", "lo")))
    rim = written(rim.select("mesh_id", "fid", *ends, "last", (F.col("fid") * F.col("widest") + F.col("k")).alias("e")), "mesh-rim")
    if rim.isEmpty():
        return vertices, faces
    links = simple_loops(written(rim_links(vertices, faces, rim), "mesh-rim-links"))
    loops = written(links.select("mesh_id", "loop", F.explode(F.array("e", "next")).alias("e")).distinct(), "mesh-loops")
    sizes = loops.groupBy("mesh_id", "loop").agg(F.count(F.lit(1)).alias("n"))
    steps = links.groupBy("mesh_id", "loop").agg(F.count(F.lit(1)).alias("steps"))
    whole = sizes.join(shuffled(steps), ["mesh_id", "loop"]).filter("n = steps").select("mesh_id", "loop")
    looped = written(rim.join(shuffled(loops), ["mesh_id", "e"]).join(shuffled(whole), ["mesh_id", "loop"], "left_semi"), "mesh-looped")
    corners = written(looped.select("mesh_id", "loop", F.explode(F.array("a", "b")).alias("vid")).distinct().join(shuffled(vertices), ["mesh_id", "vid"]).select("mesh_id", "loop", "vid", *XYZ, "color"), "mesh-corners")
    middles = corners.groupBy("mesh_id", "loop").agg(F.min_by("color", "vid").alias("color"), *[F.avg(c).alias(f"m{c}") for c in XYZ])
    far = F.sqrt(sum((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in XYZ))
    radius = corners.drop("color").join(shuffled(middles), ["mesh_id", "loop"]).groupBy("mesh_id", "loop").agg(F.max(far).alias("radius"))
    closed = middles.join(shuffled(radius), ["mesh_id", "loop"]).join(limit, "mesh_id").filter(F.col("radius") <= F.col("limit"))
    closed = written(closed.withColumn("middle", F.col("top") + 1 + F.col("loop")), "mesh-closed")
    new_vertices = closed.select("mesh_id", F.col("middle").alias("vid"), *[F.col(f"m{c}").alias(c) for c in XYZ], "color")
    fan = looped.join(shuffled(closed.select("mesh_id", "loop", "middle")), ["mesh_id", "loop"])
    new_faces = fan.select("mesh_id", (F.col("last") + 1 + F.col("e")).alias("fid"), F.array("b", "a", "middle").alias("vids"))
    return vertices.unionByName(new_vertices.select(*vertices.columns)), faces.unionByName(new_faces)


def feature_edges(vertices: DataFrame, faces: DataFrame, angle: float) -> DataFrame:
    """(mesh_id, lo, hi) of edges on the boundary, or whose two faces meet at more than ``angle`` degrees."""
    normals = face_normals(vertices, faces)
    sided = edges(faces).select("mesh_id", "fid", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).join(shuffled(normals), ["mesh_id", "fid"])
    n = F.array("nx", "ny", "nz")
    pair = spread(sided, "mesh_id", "lo", "hi").groupBy("mesh_id", "lo", "hi").agg(F.count(F.lit(1)).alias("uses"), F.min_by(n, "fid").alias("p"), F.max_by(n, "fid").alias("q"))
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    cosine = dot(F.col("p"), F.col("q")) / F.sqrt(dot(F.col("p"), F.col("p")) * dot(F.col("q"), F.col("q")))
    return pair.filter((F.col("uses") != 2) | (cosine < math.cos(math.radians(angle)))).select("mesh_id", "lo", "hi")


def sinc_weights(terms: int, pass_band: float) -> list[float]:
    """Weights of the polynomials T_0 to T_terms of a low-pass filter that keeps frequencies below ``pass_band`` (0 to 2).

    They are those of an ideal filter's series under a Hamming window; its edge is moved up until the filter keeps the
    pass band itself (to two in a thousand), and the weights add up to 1, so that what doesn't vary stays as it is.
    """
    edge = math.acos(1 - pass_band / 2)
    window = [0.54 + 0.46 * math.cos(math.pi * j / (terms + 1)) for j in range(terms + 1)]

    def weights(at: float) -> list[float]:
        raw = [window[j] * (at / math.pi if j == 0 else 2 * math.sin(j * at) / (j * math.pi)) for j in range(terms + 1)]
        return [x / sum(raw) for x in raw]

    lost = lambda at: 1 - sum(w * math.cos(j * edge) for j, w in enumerate(weights(at)))
    # The least shift that is enough; few terms can't be as sharp, and take the one that comes nearest.
    shifts = [edge + k / 1000 * (math.pi - edge) for k in range(900)]
    return weights(next((at for at in shifts if abs(lost(at)) <= 0.002), min(shifts, key=lambda at: abs(lost(at)))))


def smoothing_neighbours(vertices: DataFrame, faces: DataFrame, mode: str, feature_angle: float) -> DataFrame:
    """(mesh_id, vid, other): whose mean a vertex is compared with.

    For most these are all vertices that they share an edge with. Vertices on lines (open edges; in room mode feature edges
    too) look along their line only, and stay where they are unless two edges of it meet there.
    """
    both = lambda df: df.select("mesh_id", F.explode(F.array(F.struct(F.col("lo").alias("vid"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("vid"), F.col("lo").alias("other")))).alias("p")).select("mesh_id", "p.*")
    # What the file's few bytes of faces make, and the rows of their edges, go to all tasks alike.
    faces = spread(faces, "mesh_id", "fid")
    uses = edge_uses(faces)
    lines = feature_edges(vertices, faces, feature_angle) if mode == "room" else uses.filter("uses <> 2").select("mesh_id", "lo", "hi")
    along = both(lines)
    ends = along.groupBy("mesh_id", "vid").agg(F.count(F.lit(1)).alias("n"), F.collect_list("other").alias("others"))
    led = ends.filter("n = 2").select("mesh_id", "vid", F.explode("others").alias("other"))
    return led.unionByName(spread(both(uses), "mesh_id", "vid").join(shuffled(ends.select("mesh_id", "vid")), ["mesh_id", "vid"], "left_anti"))


#: Meshes of up to so many vertices are smoothed whole, each in one task.
WHOLE_VERTICES = 200_000


def _smooth_whole(weights: list[float]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(points: pa.Table, near: pa.Table) -> pa.Table:
        vid = points.column("vid").to_numpy()
        order = np.argsort(vid, kind="stable")
        start = np.stack([points.column(c).to_numpy(zero_copy_only=False)[order] for c in XYZ], axis=1)
        of, to = (np.searchsorted(vid[order], near.column(c).to_numpy()) for c in ("n_vid", "n_other"))
        degree = np.bincount(of, minlength=len(vid))[:, None]
        mean = lambda x: np.where(degree > 0, np.stack([np.bincount(of, weights=x[to, i], minlength=len(vid)) for i in range(3)], axis=1) / np.maximum(degree, 1), x)
        before, now = start, (start + mean(start)) / 2
        out = weights[0] * before + weights[1] * now
        for w in weights[2:]:
            before, now = now, now + mean(now) - before
            out += w * now
        out = np.where(degree > 0, out, start)
        return pa.Table.from_arrays([points.column("mesh_id"), pa.array(vid[order]), *[pa.array(out[:, i]) for i in range(3)]], names=["mesh_id", "vid", *XYZ])

    return run


def smooth(vertices: DataFrame, faces: DataFrame, mode: str, iterations: int, pass_band: float, feature_angle: float = 45.0, whole: int = WHOLE_VERTICES) -> DataFrame:
    """A windowed-sinc filter of ``iterations`` terms: details beyond ``pass_band`` go, and the volume stays.

    The terms are Chebyshev polynomials of the step half-way to the neighbours' mean; each comes from the two before it.
    Meshes of up to ``whole`` vertices are filtered whole in one task each. For larger ones each term is a join with the
    neighbours and a mean.
    """
    if not iterations:
        return vertices
    weights = sinc_weights(iterations, pass_band)
    near = written(smoothing_neighbours(vertices, faces, mode, feature_angle), "mesh-neighbours")
    large = written(vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > whole).select("mesh_id"), "mesh-large")
    small = vertices.select("mesh_id", "vid", *XYZ).join(large, "mesh_id", "left_anti")
    own = near.join(large, "mesh_id", "left_anti").select(F.col("mesh_id").alias("n_mesh"), F.col("vid").alias("n_vid"), F.col("other").alias("n_other"))
    done = small.groupBy("mesh_id").cogroup(own.groupBy("n_mesh")).applyInArrow(_smooth_whole(weights), "mesh_id long, vid long, x double, y double, z double")
    if not large.isEmpty():
        near = near.join(large, "mesh_id", "left_semi")
        now = vertices.join(large, "mesh_id", "left_semi").select("mesh_id", "vid", *XYZ, *[F.col(c).alias(f"b{c}") for c in XYZ], *[(weights[0] * F.col(c)).alias(f"s{c}") for c in XYZ])
        for k, w in enumerate(weights[1:]):
            around = spread(near, "mesh_id", "other").join(shuffled(now.select("mesh_id", F.col("vid").alias("other"), *XYZ)), ["mesh_id", "other"]).groupBy("mesh_id", "vid").agg(*[F.avg(c).alias(f"m{c}") for c in XYZ])
            met = spread(now, "mesh_id", "vid").join(shuffled(around), ["mesh_id", "vid"], "left")
            after = lambda c: F.coalesce((F.col(c) + F.col(f"m{c}")) / 2 if k == 0 else F.col(c) + F.col(f"m{c}") - F.col(f"b{c}"), F.col(c))  # noqa: E731, B023
            now = met.select("mesh_id", "vid", *[after(c).alias(c) for c in XYZ], *[F.col(c).alias(f"b{c}") for c in XYZ], *[(F.col(f"s{c}") + w * after(c)).alias(f"s{c}") for c in XYZ])
            if k % 3 == 2:
                held, now = now, written(now, "mesh-smooth")
                dropped(held)
        done = done.unionByName(now.select("mesh_id", "vid", *[F.col(f"s{c}").alias(c) for c in XYZ]))
    moved = done.select("mesh_id", "vid", *[F.col(c).alias(f"n{c}") for c in XYZ])
    return spread(vertices, "mesh_id", "vid").join(shuffled(moved), ["mesh_id", "vid"], "left").select(*[F.coalesce(f"n{c}", c).alias(c) if c in XYZ else F.col(f"`{c}`") for c in vertices.columns])


def close_points(vertices: DataFrame, size: DataFrame) -> DataFrame:
    """(mesh_id, vid, to): each vertex with the smallest one that it reaches over steps of at most its mesh's ``size``.

    ``size`` has (mesh_id, size). Points of a cube whose diagonal is ``size`` are one step apart without being paired, so
    crowds of points in one place stay cheap. Points of different cubes meet through cells four steps wide: each stands in
    its own, and looks into those that a step reaches, which for most is no other. Without a positive size, and without
    finite coordinates, only equal points are one.
    """
    sized = vertices.join(size, "mesh_id").withColumn("ok", F.coalesce(F.col("size") > 0, F.lit(False)) & _finite("x") & _finite("y") & _finite("z"))
    at = lambda width: F.array(*[F.floor(F.col(c) / width).cast("long") for c in XYZ])
    # Cubes a little smaller than that: rounding must not join points beyond a step.
    small = sized.withColumn("cube", F.when(F.col("ok"), at(F.col("size") * (0.999999 / math.sqrt(3)))))
    exact = F.when(~F.col("ok"), F.concat_ws(",", *[F.col(c).cast("string") for c in XYZ]))
    held = written(small.withColumn("rep", F.min("vid").over(Window.partitionBy("mesh_id", "cube", exact))).select("mesh_id", "vid", *XYZ, "size", "ok", "rep"), "mesh-cubes")
    spots = held.filter("ok").groupBy("mesh_id", *XYZ, "size").agg(F.min("rep").alias("rep"))
    wide = 4 * F.col("size")
    home = spots.select("mesh_id", F.col("rep").alias("other"), *[F.col(c).alias(f"o{c}") for c in XYZ], *[F.floor(F.col(c) / wide).alias(f"c{c}") for c in XYZ])
    reach = spots
    for c in XYZ:
        reach = reach.withColumn(f"c{c}", F.explode(F.sequence(F.floor((F.col(c) - F.col("size")) / wide), F.floor((F.col(c) + F.col("size")) / wide))))
    apart = sum((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in XYZ)
    met = reach.join(shuffled(home), ["mesh_id", *[f"c{c}" for c in XYZ]]).filter((F.col("rep") < F.col("other")) & (apart <= F.col("size") * F.col("size")))
    node = lambda c: F.struct("mesh_id", F.col(c).alias("vid"))
    links = written(met.select(node("rep").alias("src"), node("other").alias("dst")).distinct(), "mesh-close")
    if links.isEmpty():
        return held.select("mesh_id", "vid", F.col("rep").alias("to"))
    found = connected_components(links)
    to = found.select(F.col("vertex.mesh_id").alias("mesh_id"), F.col("vertex.vid").alias("rep"), F.col("component.vid").alias("to"))
    return held.join(shuffled(to), ["mesh_id", "rep"], "left").select("mesh_id", "vid", F.coalesce("to", "rep").alias("to"))


def weld(vertices: DataFrame, faces: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Welds points that are at most ``tolerance`` times the mesh's diagonal apart, step by step, into the smallest one.

    Faces that lose a corner go.
    """
    remap = written(close_points(vertices, bounds(vertices).select("mesh_id", (F.col("diagonal") * tolerance).alias("size"))), "mesh-remap")
    moved = remap.filter("vid <> to")
    if moved.isEmpty():
        return vertices, faces.filter(F.size(F.array_distinct("vids")) == F.size("vids"))
    each = faces.select("mesh_id", "fid", F.posexplode("vids").alias("k", "vid")).join(shuffled(remap), ["mesh_id", "vid"])
    new = each.groupBy("mesh_id", "fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "to"))), lambda x: x["to"]).alias("vids"))
    new = new.filter(F.size(F.array_distinct("vids")) == F.size("vids"))
    return vertices.join(shuffled(moved), ["mesh_id", "vid"], "left_anti"), new


def corner_points(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, fid, p0, p1, p2) of triangles: all corners meet their points in one join."""
    each = faces.select("mesh_id", "fid", F.posexplode("vids").alias("k", "vid")).join(shuffled(vertices.select("mesh_id", "vid", F.struct(*XYZ).alias("p"))), ["mesh_id", "vid"])
    return each.groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("k") == k, F.col("p"))).alias(f"p{k}") for k in range(3)])


def face_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, fid, nx, ny, nz) of triangles; a normal is as long as twice the triangle's area."""
    f = corner_points(vertices, faces)
    u, w = ([F.col(f"p{i}.{c}") - F.col(f"p0.{c}") for c in XYZ] for i in (1, 2))
    cross = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    return f.select("mesh_id", "fid", *[c.alias(n) for c, n in zip(cross, ("nx", "ny", "nz"), strict=True)])


def _orient_whole(points: pa.Table, faces: pa.Table) -> pa.Table:
    fid, lists = faces.column("fid").to_numpy(), faces.column("vids").combine_chunks()
    vids, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    start, of, at = np.cumsum(size) - size, np.repeat(np.arange(len(fid)), size), np.arange(len(vids))
    (corner, a), (number, own) = np.unique(vids, return_inverse=True), np.unique(fid, return_inverse=True)
    b = a[np.where(at == (start + size - 1)[of], start[of], at + 1)]
    # Sides in order of their edge; a side is twice its face's place, and one more where it goes up.
    edge, side = np.minimum(a, b) * len(corner) + np.maximum(a, b), 2 * own[of] + (a < b)
    order = np.lexsort((side, edge))
    edge, side = edge[order], side[order]
    first = np.flatnonzero(np.diff(edge, prepend=-1))
    pair = first[np.diff(first, append=len(edge)) == 2]
    f, g = side[pair], side[pair + 1]
    f, g = f[f // 2 < g // 2], g[f // 2 < g // 2]
    agree = (f + g) % 2
    f, g, n = f // 2, g // 2, len(number)
    if agree.all():
        surface, orientable, turn = smallest_reached(f, g, n), np.ones(n, bool), np.zeros(n, bool)
    else:
        copies = smallest_reached(np.concatenate([2 * f, 2 * f + 1]), np.concatenate([2 * g + 1 - agree, 2 * g + agree]), 2 * n).reshape(n, 2)
        surface, orientable, turn = copies.min(axis=1) // 2, copies[:, 0] != copies[:, 1], copies[:, 1] < copies[:, 0]
    reverse = (2 * start + size - 1)[of] - at
    # Faces all of whose corners have points make up the volume.
    seen, place = np.unique(points.column("vid").to_numpy(), return_index=True)
    there = np.isin(corner, seen)
    known = (size > 2) & (np.bincount(of[~there[a]], minlength=len(fid)) == 0)
    turned = np.where(turn[own][of], reverse, at)
    met = [place[np.searchsorted(seen, vids[turned[start[known] + k]])] for k in range(3)]
    x, y, z = ([points.column(c).to_numpy()[p] for p in met] for c in XYZ)
    det = x[0] * (y[1] * z[2] - z[1] * y[2]) - y[0] * (x[1] * z[2] - z[1] * x[2]) + z[0] * (x[1] * y[2] - y[1] * x[2])
    inward = np.bincount(surface[own][known], weights=det, minlength=n) < 0
    back = (turn ^ (inward[surface] & orientable))[own]
    made = pa.ListArray.from_arrays(pa.array(np.append(start, len(vids)), pa.int32()), pa.array(vids[np.where(back[of], reverse, at)]))
    return pa.Table.from_arrays([faces.column("mesh_id"), pa.array(fid), made, pa.array(orientable[own])], names=["mesh_id", "fid", "vids", "orientable"])


def orient(vertices: DataFrame, faces: DataFrame, whole: int = WHOLE_VERTICES) -> DataFrame:
    """Triangles with consistent winding, outwards, and ``orientable``, by the rules of ``orient_dealt``.

    Meshes of up to ``whole`` vertices and twice as many faces are oriented whole in one task each.
    """
    many = lambda table, most: table.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("mesh_id")
    large = written(many(vertices, whole).unionByName(many(faces, 2 * whole)).distinct(), "mesh-large")
    points = vertices.select(F.col("mesh_id").alias("p_mesh"), "vid", *XYZ).join(large, F.col("p_mesh") == F.col("mesh_id"), "left_anti")
    small = faces.select("mesh_id", "fid", "vids").join(large, "mesh_id", "left_anti")
    kinds = ", ".join(f"{c} {small.schema[c].dataType.simpleString()}" for c in small.columns)
    done = spread(points, "p_mesh").groupBy("p_mesh").cogroup(spread(small, "mesh_id").groupBy("mesh_id")).applyInArrow(_orient_whole, f"{kinds}, orientable boolean")
    if large.isEmpty():
        return done
    return done.unionByName(orient_dealt(vertices.join(large, "mesh_id", "left_semi"), faces.join(large, "mesh_id", "left_semi")))


def orient_dealt(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``orient`` for meshes of any size, by joins.

    Neighbours over an edge of two faces agree if they run along it in opposite directions. Where all of a mesh agree, its
    surfaces are those that neighbours link. Elsewhere each face stands twice in the graph, as it is and flipped, and
    neighbours link the copies that agree: a surface that holds both copies of a face can't be oriented and stays as it
    is, the others choose the copy with the smaller label. Surfaces turn round where their signed volume is negative.
    """
    sided = edges(faces).select("mesh_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.struct("fid", (F.col("a") < F.col("b")).alias("up")).alias("s"))
    pair = sided.groupBy("mesh_id", "lo", "hi").agg(F.count(F.lit(1)).alias("uses"), F.min("s").alias("f"), F.max("s").alias("g"))
    met = written(pair.filter("uses = 2 and f.fid < g.fid").select("mesh_id", F.col("f.fid").alias("fid"), F.col("g.fid").alias("g"), (F.col("f.up") != F.col("g.up")).alias("agree")), "mesh-met")
    torn = written(met.filter(~F.col("agree")).select("mesh_id").distinct(), "mesh-torn")
    node = lambda fid, flip: F.struct("mesh_id", F.col(fid).alias("fid"), flip.cast("int").alias("flip"))
    flat = F.lit(0)
    calm = met.join(torn, "mesh_id", "left_anti").select(node("fid", flat).alias("src"), node("g", flat).alias("dst"))
    wild = met.join(torn, "mesh_id", "left_semi")
    doubled = wild.select(F.explode(F.array(*[F.struct(node("fid", F.lit(s == 1)).alias("src"), node("g", F.when(F.col("agree"), F.lit(s == 1)).otherwise(F.lit(s == 0))).alias("dst")) for s in (0, 1)])).alias("l")).select("l.*")
    found = contracted_components(calm.unionByName(doubled), spread=True)
    labels = found.select("vertex.*", F.struct("component.fid", "component.flip").alias("label"))
    both = labels.groupBy("mesh_id", "fid").agg(F.min("label").alias("label"), F.min_by("flip", "label").alias("flip"), ((F.count(F.lit(1)) == 1) | (F.min("label") != F.max("label"))).alias("orientable"))
    # A face without neighbours is a surface of its own.
    alone = F.struct(F.col("fid"), F.lit(0).alias("flip"))
    turned = faces.join(shuffled(both), ["mesh_id", "fid"], "left").withColumn("orientable", F.coalesce("orientable", F.lit(True))).withColumn("label", F.coalesce("label", alone))
    turned = turned.withColumn("flip", F.when(F.col("orientable"), F.coalesce("flip", F.lit(0))).otherwise(0))
    turned = written(turned.withColumn("vids", F.when(F.col("flip") == 1, F.reverse("vids")).otherwise(F.col("vids"))), "mesh-turned")
    x, y, z = ([F.col(f"p{k}.{c}") for k in range(3)] for c in XYZ)
    det = x[0] * (y[1] * z[2] - z[1] * y[2]) - y[0] * (x[1] * z[2] - z[1] * x[2]) + z[0] * (x[1] * y[2] - y[1] * x[2])
    volume = corner_points(vertices, turned).join(shuffled(turned.select("mesh_id", "fid", "label")), ["mesh_id", "fid"])
    inward = volume.groupBy("mesh_id", "label").agg((F.sum(det) < 0).alias("inward"))
    out = turned.join(shuffled(inward), ["mesh_id", "label"], "left")
    return out.select("mesh_id", "fid", F.when(F.col("inward") & F.col("orientable"), F.reverse("vids")).otherwise(F.col("vids")).alias("vids"), "orientable")


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, vid, nx, ny, nz): unit sums of the normals of a vertex's triangles, weighted by area."""
    names = ("nx", "ny", "nz")
    each = face_normals(vertices, faces).join(shuffled(faces), ["mesh_id", "fid"]).select("mesh_id", F.explode("vids").alias("vid"), *names)
    total = each.groupBy("mesh_id", "vid").agg(*[F.sum(n).alias(n) for n in names])
    length = F.sqrt(sum(F.col(n) * F.col(n) for n in names))
    return total.select("mesh_id", "vid", *[F.try_divide(F.col(n), length).alias(n) for n in names])


def transfer_colors(source: DataFrame, target: DataFrame) -> DataFrame:
    """``target`` with the colour of the nearest source vertex of its mesh (the lowest number of those as near).

    A source without colours leaves ``target`` as it is, and so do vertices without finite coordinates and a nearest
    vertex without a colour. Source vertices without finite coordinates are nobody's nearest.
    """
    if source.filter("color is not null").isEmpty():
        return target
    finite = F.col("vid").isNotNull() & _finite("x") & _finite("y") & _finite("z")
    points = lambda t: t.filter(finite).select("mesh_id", "vid", *XYZ)
    met = nearest(points(source), points(target.join(source.select("mesh_id").distinct(), "mesh_id", "left_semi")))
    painted = source.groupBy("mesh_id", F.col("vid").alias("near_vid")).agg(F.min("color").alias("new_color"))
    colors = met.join(shuffled(painted), ["mesh_id", "near_vid"]).select("mesh_id", "vid", "new_color")
    return target.join(shuffled(colors), ["mesh_id", "vid"], "left").withColumn("color", F.coalesce("new_color", "color")).select(*target.columns)


def report(in_vertices: DataFrame, in_faces: DataFrame, out_vertices: DataFrame, out_faces: DataFrame, mode: str, verify: bool = True) -> DataFrame:
    """One row for each mesh: counts in and out, mode, topology, and a warning where the surface isn't closed."""
    count = lambda df, name: df.groupBy("mesh_id").agg(F.count(F.lit(1)).alias(name))
    r = count(in_vertices, "input_point_count")
    for df, name in ((in_faces, "input_cell_count"), (out_vertices, "output_point_count"), (out_faces, "output_cell_count")):
        r = r.join(count(df, name), "mesh_id", "left")
    r = r.withColumn("mode", F.lit(mode))
    if not verify:
        none = {"boundary_edge_count": "bigint", "non_manifold_edge_count": "bigint", "is_watertight": "boolean", "open_edge_count": "bigint", "warning": "string"}
        return r.select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    text = F.concat(
        F.lit("Output mesh has topology issues ("), F.col("boundary_edge_count").cast("string"), F.lit(" boundary edges, "), F.col("non_manifold_edge_count").cast("string"), F.lit(" non-manifold edges; "),
        F.col("open_edge_count").cast("string"), F.lit(" total)"),
    )
    return r.join(topology(out_faces), "mesh_id", "left").withColumn("warning", F.when(~F.col("is_watertight"), text))


class MeshStepError(RuntimeError):
    """A cleaning step failed; ``step`` names it."""

    def __init__(self, step: str, cause: Exception) -> None:
        super().__init__(f"Mesh cleaning step '{step}' failed: {cause}")
        self.step = step


def run_step(step: str, operator, *args, **kwargs):
    """Runs an operator and writes the tables that it declares, so that a failure in the run names the step too.

    Errors of validation pass through as they are.
    """
    try:
        made = operator(*args, **kwargs)
        if isinstance(made, DataFrame):
            return written(made, f"mesh-{step}")
        return tuple(written(table, f"mesh-{step}") for table in made)
    except ValueError:
        raise
    except Exception as cause:
        raise MeshStepError(step, cause) from cause


def faults(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, error) of meshes that no step can work on: corners without a vertex or null, vertices that stand twice.

    The first of a mesh is named. Null corners and faces of fewer than three corners count as faults of the face.
    """
    corner = faces.select("mesh_id", "fid", F.explode_outer("vids").alias("vid"))
    there = vertices.groupBy("mesh_id", "vid").agg(F.count(F.lit(1)).alias("n"))
    # Sound meshes end here: each vertex that faces name is looked up once, and only lost ones meet their faces.
    missing = written(corner.select("mesh_id", "vid").distinct().join(shuffled(there), ["mesh_id", "vid"], "left_anti"), "mesh-missing")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in ("mesh_id", "vid")]
    met = corner.alias("c").join(shuffled(missing.alias("m")), same, "left_semi") if not missing.isEmpty() else corner.limit(0)
    lost = F.concat(F.lit("face "), F.col("fid").cast("string"), F.coalesce(F.concat(F.lit(" names vertex "), F.col("vid").cast("string"), F.lit(", which isn't there")), F.lit(" has a null corner")))
    few = faces.filter(F.coalesce(F.size("vids"), F.lit(0)) < 3).select("mesh_id", F.concat(F.lit("face "), F.col("fid").cast("string"), F.lit(" has fewer than three corners")).alias("error"))
    twice = there.filter("n > 1").select("mesh_id", F.concat(F.lit("vertex "), F.coalesce(F.col("vid").cast("string"), F.lit("null")), F.lit(" stands there "), F.col("n").cast("string"), F.lit(" times")).alias("error"))
    return met.select("mesh_id", lost.alias("error")).unionByName(few).unionByName(twice).groupBy("mesh_id").agg(F.min("error").alias("error"))


ERRORS = "mesh_id long, error string, step string"


def run_step_each(step: str, operator: Callable[..., DataFrame | tuple[DataFrame, ...]], tables: tuple[DataFrame, ...], *args, level: int = 0) -> tuple[tuple[DataFrame, ...], DataFrame | None]:
    """(the tables that ``operator`` makes of ``tables``, error rows): meshes that make the step fail don't stop the others.

    The step runs once for all. Only if it fails, its meshes are halved by a hash of their number, again and again, until
    the failing ones stand alone: each gives an error row with the step, all others their results.
    """
    try:
        made = run_step(step, operator, *tables, *args)
        return (made if isinstance(made, tuple) else (made,)), None
    except MeshStepError as failed:
        ids = [r[0] for r in tables[0].select("mesh_id").unionByName(tables[-1].select("mesh_id")).distinct().limit(2).collect()]
        if len(ids) < 2 or level > 62:
            cause = str(failed.__cause__).strip().splitlines()
            spark = tables[0].sparkSession
            return (), spark.createDataFrame([(i, f"Mesh cleaning step '{step}' failed: {cause[0] if cause else type(failed.__cause__).__name__}", step) for i in ids], ERRORS)
    made, errors = (), None
    for half in (0, 1):
        own = tuple(t.filter(F.shiftright(F.xxhash64("mesh_id"), level).bitwiseAND(1) == half) for t in tables)
        part, wrong = run_step_each(step, operator, own, *args, level=level + 1)
        made = tuple(a.unionByName(b) for a, b in zip(made, part, strict=True)) if made and part else made or part
        errors = wrong if errors is None else errors.unionByName(wrong) if wrong is not None else errors
    return made, errors


def tagged(errors: DataFrame, step: str) -> DataFrame:
    """Error rows (mesh_id, error) with the step that made them."""
    return errors.withColumn("step", F.lit(step))
