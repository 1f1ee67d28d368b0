"""Rigging: template skeletons in a mesh's box, skinning weights from distances, packed influences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators.joins import shuffled, spread
from orrery.operators.mesh import XYZ, bounds, keep_objects

MAX_INFLUENCES = 4
PACKED = 4

# For each template its joints (name, parent, and for x, y, z the box's side to start from and the share
# of the box's size to add).
TEMPLATES = {
    "static": [("root", None, ("ctr", 0.0), ("ctr", 0.0), ("ctr", 0.0))],
    "biped": [
        ("hips", None, ("ctr", 0.0), ("min", 0.45), ("ctr", 0.0)),
        ("spine", "hips", ("ctr", 0.0), ("min", 0.65), ("ctr", 0.0)),
        ("head", "spine", ("ctr", 0.0), ("min", 0.92), ("ctr", 0.0)),
        ("left_hand", "spine", ("ctr", -0.28), ("min", 0.62), ("ctr", 0.0)),
        ("right_hand", "spine", ("ctr", 0.28), ("min", 0.62), ("ctr", 0.0)),
        ("left_foot", "hips", ("ctr", -0.28), ("min", 0.0), ("ctr", 0.0)),
        ("right_foot", "hips", ("ctr", 0.28), ("min", 0.0), ("ctr", 0.0)),
    ],
    "quadruped": [
        ("body", None, ("ctr", 0.0), ("ctr", 0.10), ("ctr", 0.0)),
        ("neck", "body", ("max", -0.20), ("ctr", 0.25), ("ctr", 0.0)),
        ("head", "neck", ("max", 0.0), ("ctr", 0.30), ("ctr", 0.0)),
        ("front_left_foot", "body", ("max", -0.15), ("min", 0.0), ("ctr", -0.30)),
        ("front_right_foot", "body", ("max", -0.15), ("min", 0.0), ("ctr", 0.30)),
        ("back_left_foot", "body", ("min", 0.15), ("min", 0.0), ("ctr", -0.30)),
        ("back_right_foot", "body", ("min", 0.15), ("min", 0.0), ("ctr", 0.30)),
    ],
    "winged": [
        ("body", None, ("ctr", 0.0), ("ctr", 0.0), ("ctr", 0.0)),
        ("head", "body", ("ctr", 0.0), ("max", 0.0), ("ctr", 0.0)),
        ("left_wing_tip", "body", ("min", 0.0), ("ctr", 0.0), ("ctr", 0.0)),
        ("right_wing_tip", "body", ("max", 0.0), ("ctr", 0.0), ("ctr", 0.0)),
        ("tail", "body", ("ctr", 0.0), ("ctr", -0.25), ("min", 0.0)),
    ],
}


def templates(spark: SparkSession) -> DataFrame:
    """The templates as rows: articulation, joint_idx, joint, parent, and base and share for each axis."""
    rows = [(t, i, name, parent, *[v for axis in axes for v in axis]) for t, joints in TEMPLATES.items() for i, (name, parent, *axes) in enumerate(joints)]
    return spark.createDataFrame(rows, "articulation string, joint_idx int, joint string, parent string, " + ", ".join(f"base_{c} string, share_{c} double" for c in XYZ))


def unit_normalise(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices moved to their box's middle and scaled to an extent of 1; the box is that of the vertices in use."""
    b = bounds(keep_objects(vertices, faces)[0]).withColumn("extent", F.greatest(*[f"span_{c}" for c in XYZ]))
    met = vertices.join(shuffled(b.select("mesh_id", "extent", *[((F.col(f"low_{c}") + F.col(f"high_{c}")) / 2).alias(f"mid_{c}") for c in XYZ])), "mesh_id")
    moved = [F.when(F.col("extent") > 0, (F.col(c) - F.col(f"mid_{c}")) / F.col("extent")).otherwise(F.col(c)).alias(c) for c in XYZ]
    return met.select(*[c for c in vertices.columns if c not in XYZ], *moved).select(*vertices.columns)


def fit_skeletons(vertices: DataFrame, faces: DataFrame, kinds: DataFrame) -> DataFrame:
    """Joints (mesh_id, joint_idx, joint, parent, x, y, z) of each mesh for its articulation (mesh_id, articulation)."""
    b = bounds(keep_objects(vertices, faces)[0]).join(kinds, "mesh_id")
    t = F.broadcast(templates(vertices.sparkSession))  # a fixed table of a few rows
    met = b.join(t, "articulation")
    place = []
    for c in XYZ:
        middle, extent = (F.col(f"low_{c}") + F.col(f"high_{c}")) / 2, F.greatest(F.col(f"span_{c}"), F.lit(1e-6))
        base = F.when(F.col(f"base_{c}") == "min", F.col(f"low_{c}")).when(F.col(f"base_{c}") == "max", F.col(f"high_{c}")).otherwise(middle)
        place.append((base + F.col(f"share_{c}") * extent).alias(c))
    return met.select("mesh_id", "joint_idx", "joint", "parent", *place)


def bones(joints: DataFrame) -> DataFrame:
    """(mesh_id, bone, parent, child) of joints with a parent."""
    return joints.filter("parent is not null").select("mesh_id", F.concat("parent", F.lit("_to_"), "joint").alias("bone"), "parent", F.col("joint").alias("child"))


def skin(vertices: DataFrame, joints: DataFrame, max_influences: int = MAX_INFLUENCES) -> DataFrame:
    """(mesh_id, vid, joint_idx, w): inverse distances to the nearest joints, normalised to a sum of 1 for each vertex."""
    j = joints.select("mesh_id", "joint_idx", *[F.col(c).alias(f"j{c}") for c in XYZ])
    far = F.sqrt(sum((F.col(c) - F.col(f"j{c}")) * (F.col(c) - F.col(f"j{c}")) for c in XYZ))
    raw = vertices.select("mesh_id", "vid", *XYZ).join(shuffled(j), "mesh_id").select("mesh_id", "vid", "joint_idx", (1.0 / F.greatest(far, F.lit(1e-6))).alias("w"))
    vertex = Window.partitionBy("mesh_id", "vid")
    top = spread(raw, "mesh_id", "vid").withColumn("nth", F.row_number().over(vertex.orderBy(F.col("w").desc(), "joint_idx"))).filter(F.col("nth") <= max_influences)
    return top.select("mesh_id", "vid", "joint_idx", (F.col("w") / F.greatest(F.sum("w").over(vertex), F.lit(1e-12))).alias("w"))


def pack_influences(weights: DataFrame) -> DataFrame:
    """(mesh_id, vid, joints, weights, error): the four largest positive weights, normalised, padded with zeros."""
    vertex = Window.partitionBy("mesh_id", "vid")
    top = weights.withColumn("w", F.greatest("w", F.lit(0.0))).withColumn("nth", F.row_number().over(vertex.orderBy(F.col("w").desc(), "joint_idx"))).filter(F.col("nth") <= PACKED)
    kept = F.filter(F.array_sort(F.collect_list(F.struct("nth", "joint_idx", "w"))), lambda x: x["w"] > 0)
    packed = top.groupBy("mesh_id", "vid").agg(kept.alias("p"), F.sum("w").alias("total"))
    pad = lambda arr, zero: F.slice(F.concat(arr, F.array_repeat(zero, PACKED)), 1, PACKED)
    none = F.size("p") == 0
    return packed.select(
        "mesh_id", "vid",
        F.when(~none, pad(F.transform("p", lambda x: x["joint_idx"]), F.lit(0))).alias("joints"),
        F.when(~none, pad(F.transform("p", lambda x: x["w"] / F.col("total")), F.lit(0.0))).alias("weights"),
        F.when(none, "skinning weight rows must contain at least one positive influence").alias("error"),
    )


def rig_results(vertices: DataFrame, faces: DataFrame, joints: DataFrame, kinds: DataFrame) -> DataFrame:
    """One record for each rigged mesh: counts, methods and the warning about axes."""
    count = lambda df, name: df.groupBy("mesh_id").agg(F.count(F.lit(1)).alias(name))
    r = kinds.join(count(vertices, "vertex_count"), "mesh_id").join(count(faces, "face_count"), "mesh_id").join(count(joints, "joint_count"), "mesh_id").join(count(bones(joints), "bone_count"), "mesh_id", "left")
    return r.select(
        "mesh_id", "articulation", "vertex_count", "face_count", "joint_count", F.coalesce("bone_count", F.lit(0)).alias("bone_count"), F.lit("inverse_distance_to_joints").alias("skinning_method"),
        F.lit("template_bbox_fit").alias("skeleton_method"), F.lit("Y-up height, X forward/width, Z lateral/depth").alias("axis_convention"),
        F.lit("Template skeleton fitting assumes a world-axis-aligned, Y-up mesh; joints may be misplaced for arbitrary orientations.").alias("warning"),
    )
