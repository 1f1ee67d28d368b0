"""Sources and sinks: media catalogs, payload JSON, manifests, rigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.scalars import IMAGE_EXTENSIONS, suffix
from orrery.operators.contracts import check, payload_rules
from orrery.operators.joins import shuffled, spread

INTRINSICS = "focal_length_mm double, focal_length_35mm double, make string, model string, lens_model string"
_CAMERA = "STRUCT<" + ", ".join(": ".join(f.split()) for f in INTRINSICS.split(", ")) + ">"
PAYLOAD_SCHEMA = f"""
    upload_id STRING, source_type STRING, track STRING, sync_group_id STRING, compute_priority_score DOUBLE, frame_count INT, resolution STRUCT<w: INT, h: INT>, camera_intrinsics {_CAMERA},
    frames ARRAY<STRUCT<pos: BIGINT, frame_id: STRING, uri: STRING, index: INT, source_id: STRING, timestamp_ms: DOUBLE, motion_score: DOUBLE, resolution: STRUCT<w: INT, h: INT>, camera_intrinsics: {_CAMERA}>>,
    sync_map ARRAY<STRUCT<anchor_timestamp_ms: DOUBLE, aligned_frames: MAP<STRING, INT>, offsets_ms: MAP<STRING, DOUBLE>>>, metadata MAP<STRING, STRING>
"""
CORRUPT = "_corrupt"


def catalog(spark: SparkSession, path: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """(path, length) of the files right in a folder that have one of the extensions, by path; contents are never read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", "length")
    return listed.filter(suffix(F.col("path")).isin(*extensions)).orderBy("path")


def catalog_error(files: DataFrame, least: int = 2) -> DataFrame:
    """One row (n, error): a catalog without files, or with fewer than ``least``, is an error."""
    n = F.count(F.lit(1)).alias("n")
    return files.agg(n).withColumn("error", F.when(F.col("n") == 0, "no supported images found").when(F.col("n") < least, f"at least {least} images are needed"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads from JSON files, one each; what doesn't parse has its text in the column ``CORRUPT``."""
    return spark.read.schema(f"{PAYLOAD_SCHEMA}, {CORRUPT} STRING").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def checked_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads that keep the contract, the others with their ``violations``); one that didn't parse breaks ``corrupt``."""
    rules = payload_rules()
    if CORRUPT in payloads.columns:
        rules = {"corrupt": F.col(CORRUPT).isNull()} | rules
    return check(payloads, rules)


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Payloads as JSON files, one each, that ``read_payloads`` reads back."""
    payloads.drop(CORRUPT).write.option("maxRecordsPerFile", 1).json(path)


def to_payload_json(payloads: DataFrame) -> DataFrame:
    """(upload_id, json) of payload rows."""
    return payloads.select("upload_id", F.to_json(F.struct(*payloads.columns)).alias("json"))


def parse_payload_json(rows: DataFrame) -> DataFrame:
    """The payloads of (upload_id, json) rows."""
    return rows.select(F.from_json("json", PAYLOAD_SCHEMA).alias("p")).select("p.*")


def run_manifests(jobs: DataFrame) -> DataFrame:
    """(job_id, manifest): one JSON record for each job with its keys in order; sync fields only where there are groups.

    ``jobs`` has job_id, mode, image_paths, output_dir, output_path, params (struct) and sync_group_count.
    """
    grouped = F.col("sync_group_count") > 0
    fields = {
        "backend": F.lit("mast3r"), "device": F.col("params.device"), "dry_run": F.col("params.dry_run"), "image_paths": F.col("image_paths"), "image_size": F.col("params.image_size"), "job_id": F.col("job_id"),
        "min_conf_thr": F.col("params.min_conf_thr"), "mode": F.col("mode"), "model_name": F.col("params.model_name"), "output_dir": F.col("output_dir"), "output_path": F.col("output_path"),
        "pairing_strategy": F.col("params.pairing_strategy"), "seed": F.col("params.seed"), "sync_group_count": F.when(grouped, F.col("sync_group_count")), "sync_pairing_enabled": F.when(grouped, True),
        "tsdf_thresh": F.col("params.tsdf_thresh"),
    }
    return jobs.select("job_id", F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())])).alias("manifest"))


def refinement_manifests(reports: DataFrame) -> DataFrame:
    """(mesh_id, manifest) of mesh cleaning reports, keys in order."""
    return reports.select("mesh_id", F.to_json(F.struct(*sorted(c for c in reports.columns if c != "mesh_id"))).alias("manifest"))


def write_manifests(manifests: DataFrame, path: str, key: str = "job_id") -> None:
    """Manifests as text files, a folder for each job."""
    manifests.write.partitionBy(key).text(path)


def rig_metadata(joints: DataFrame, bones: DataFrame, packed: DataFrame) -> DataFrame:
    """(mesh_id, rig): the skeleton and packed weights of each mesh, ordered, as one JSON record.

    A record holds a whole mesh, as its file does; ``packed`` rows are narrow.
    """
    listed = lambda df, name, *cols: spread(df, "mesh_id").groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    rig = listed(joints, "joints", "joint_idx", "joint", "parent", "x", "y", "z").join(shuffled(listed(bones, "bones", "bone", "parent", "child")), "mesh_id", "left")
    rig = rig.join(shuffled(listed(packed, "skin", "vid", "joints", "weights")), "mesh_id")
    return rig.select("mesh_id", F.to_json(F.struct("bones", "joints", "skin")).alias("rig"))


def write_rigs(rigs: DataFrame, path: str) -> None:
    """Rig records as text files, a folder for each mesh."""
    rigs.write.partitionBy("mesh_id").text(path)
