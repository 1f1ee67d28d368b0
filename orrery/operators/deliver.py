"""Delivery: which use cases a source type allows, what is delivered, where it goes, and whether its mesh is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import MESH_EXTENSIONS, short_id, stem, suffix
from orrery.operators.contracts import SOURCE_TYPES

# Use cases with their track and the source types that they take.
USE_CASES = {
    "editing": ("A", ("single_image", "image_folder", "single_video", "video_folder")),
    "viewing": ("B", ("single_video", "video_folder", "image_folder")),
    "live": ("C", ("live_stream",)),
}


def route(requests: DataFrame) -> DataFrame:
    """``requests`` (input_type, use_case, …) with ``track`` and ``error``: a bad type comes before a bad use case."""
    allowed, track = F.lit(False), F.lit(None).cast("string")
    for name, (letter, types) in USE_CASES.items():
        own = F.coalesce(F.col("use_case") == name, F.lit(False))
        allowed = allowed | (own & F.coalesce(F.col("input_type").isin(*types), F.lit(False)))
        track = F.when(own, letter).otherwise(track)
    error = (
        F.when(~F.coalesce(F.col("input_type").isin(*SOURCE_TYPES), F.lit(False)), "unknown_input_type")
        .when(~F.coalesce(F.col("use_case").isin(*USE_CASES), F.lit(False)), "unknown_use_case")
        .when(~allowed, "invalid_pair")
    )
    return requests.withColumn("error", error).withColumn("track", F.when(F.col("error").isNull(), track))


def deliverables(routed: DataFrame, key: Column) -> DataFrame:
    """``routed`` with job_id, output_path, message and status; ``key`` decides the job id, the same in every run."""
    job = short_id("JOB_", key)
    path = F.when(F.col("track") == "A", F.concat(F.lit("blender_ready/"), job, F.lit("_model.glb"))).when(F.col("track") == "B", F.concat(F.lit("point_clouds/"), job, F.lit("_points.ply")))
    message = (
        F.when(F.col("track") == "A", "Blender-ready export packaged successfully.")
        .when(F.col("track") == "B", "Point-cloud deliverable packaged successfully.")
        .when(F.col("track") == "C", F.concat(F.lit("["), job, F.lit("] Track C (real-time WebRTC/WebSocket delivery) is not implemented yet.")))
    )
    status = F.when(F.col("error").isNotNull(), "rejected").when(F.col("track") == "C", "not_implemented").otherwise("delivered")
    return routed.select("*", F.when(F.col("error").isNull(), job).alias("job_id"), path.alias("output_path"), message.alias("message"), status.alias("status"))


def refined_path(raw: Column) -> Column:
    """The refined mesh beside the raw one: ``_refined`` before the extension, which defaults to ``.glb``."""
    return F.concat(_folder(raw), stem(raw), F.lit("_refined"), F.coalesce(F.nullif(_suffix(raw), F.lit("")), F.lit(".glb")))


def cleaned_path(path: Column) -> Column:
    """``.cleaned`` before the extension; without one, ``.cleaned.vtk`` behind the name."""
    return F.concat(_folder(path), stem(path), F.lit(".cleaned"), F.coalesce(F.nullif(_suffix(path), F.lit("")), F.lit(".vtk")))


def job_output_path(explicit: Column, label: Column, job_id: Column, root: str = "data/reconstruction") -> Column:
    """A job's output: the explicit path, else ``<root>/<label>_<job>/<label>.glb`` with the label ``reconstruction`` as default."""
    name = F.coalesce(F.nullif(label, F.lit("")), F.lit("reconstruction"))
    return F.coalesce(F.nullif(explicit, F.lit("")), F.concat(F.lit(f"{root}/"), name, F.lit("_"), job_id, F.lit("/"), name, F.lit(".glb")))


def input_output_path(input_path: Column, explicit: Column, label: Column, run_id: Column, root: str = "data/reconstruction") -> Column:
    """Where a run writes: an explicit mesh file goes into a folder of its own, an explicit folder holds ``mesh_<run>.glb``."""
    given = F.nullif(explicit, F.lit(""))
    is_file = suffix(given).isin(".obj", ".glb", ".ply")
    file = F.concat(_folder(given), stem(given), F.lit("_"), run_id, F.lit("/"), stem(given), _suffix(given))
    name = F.coalesce(F.nullif(label, F.lit("")), stem(input_path), F.lit("reconstruction"))
    default = F.concat(F.lit(f"{root}/"), name, F.lit("_"), run_id, F.lit("/"), name, F.lit(".glb"))
    return F.when(is_file, file).when(given.isNotNull(), F.concat(given, F.lit("/mesh_"), run_id, F.lit(".glb"))).otherwise(default)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def _suffix(path: Column) -> Column:
    """The extension as it is written."""
    return F.regexp_extract(path, r"^.*[^/](\.[^./]+)$", 1)


def check_artifacts(expected: DataFrame, listed: DataFrame) -> DataFrame:
    """``expected`` (job_id, path) with ``error``: missing, then empty, then of an unsupported format; ``listed`` has (path, length)."""
    met = expected.join(listed.select(F.col("path").alias("__path"), F.col("length").alias("__length")), F.col("path") == F.col("__path"), "left")
    error = F.when(F.col("__path").isNull(), "missing").when(F.col("__length") == 0, "empty").when(~suffix(F.col("path")).isin(*MESH_EXTENSIONS), "unsupported_format")
    return met.select(*[f"`{c}`" for c in expected.columns], error.alias("error"))
