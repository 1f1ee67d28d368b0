"""Column functions over media metadata: all of them are built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by kind of file.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v")
MESH_EXTENSIONS = (".obj", ".glb", ".ply", ".stl", ".vtk", ".vtp")

# The box that images are fitted into.
MAX_WIDTH, MAX_HEIGHT = 1024, 1024


def suffix(name: Column) -> Column:
    """The last extension of a file name with its dot, in lower case; a leading dot starts no extension, a last one ends none."""
    return F.lower(F.regexp_extract(name, r"^.*[^/](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def item_kind(filename: Column, mime_type: Column) -> Column:
    """``single_image``, ``single_video`` or ``unknown``; an image extension wins over the type of a video."""
    mime, ext = F.lower(F.coalesce(mime_type, F.lit(""))), suffix(filename)
    return (
        F.when(mime.startswith("image/") | ext.isin(*IMAGE_EXTENSIONS), "single_image")
        .when(mime.startswith("video/") | ext.isin(*VIDEO_EXTENSIONS), "single_video")
        .otherwise("unknown")
    )


def priority_score(source_type: Column, track: Column, file_count: Column) -> Column:
    """Compute priority: live streams first, single files before folders, less for each further file."""
    base = (
        F.when(source_type == "single_image", 0.55).when(source_type == "image_folder", 0.35).when(source_type == "single_video", 0.45)
        .when(source_type == "video_folder", 0.25).otherwise(0.2)
    )
    less = F.when(file_count > 1, F.least(F.lit(0.15), (file_count - 1) * 0.02)).otherwise(0.0)
    return F.when(track == "track_b_live", 1.0).otherwise(F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), base - less)), 3))


def rational(value: Column) -> Column:
    """A number, or a quotient written ``a/b``; null where either isn't a number or b is zero."""
    parts = F.split(value, "/")
    top = parts[0].try_cast("double")
    bottom = F.when(F.size(parts) == 2, F.try_element_at(parts, F.lit(2)).try_cast("double")).when(F.size(parts) == 1, 1.0)
    return F.try_divide(top, bottom)


def intrinsics(tags: Column) -> Column:
    """Camera intrinsics from a map of EXIF tags: two focal lengths, maker, model, lens, and the map itself."""
    tag = lambda name: F.try_element_at(tags, F.lit(name))
    return F.struct(
        rational(tag("FocalLength")).alias("focal_length_mm"), rational(tag("FocalLengthIn35mmFilm")).alias("focal_length_35mm"),
        F.trim(tag("Make")).alias("make"), F.trim(tag("Model")).alias("model"), F.trim(tag("LensModel")).alias("lens_model"), tags.alias("raw_exif"),
    )


def fit_within(width: Column, height: Column, max_width: int = MAX_WIDTH, max_height: int = MAX_HEIGHT) -> Column:
    """The size scaled down, if need be, to fit the box: halves go to the even side, no side falls below 1."""
    scale = F.least(F.lit(max_width) / width, F.lit(max_height) / height, F.lit(1.0))
    side = lambda x: F.greatest(F.lit(1), F.rint(x * scale).cast("int"))
    return F.struct(side(width).alias("w"), side(height).alias("h"))


def k_matrix(focal_length_35mm: Column, width: Column, height: Column) -> Column:
    """The pinhole camera matrix of an image, null without a focal length."""
    f, zero = focal_length_35mm / 36.0 * F.greatest(width, height), F.lit(0.0)
    return F.when(focal_length_35mm.isNotNull(), F.array(F.array(f, zero, width / 2), F.array(zero, f, height / 2), F.array(zero, zero, F.lit(1.0))))


def uri_path(uri: Column) -> Column:
    """The path of a ``file`` URI or plain path, percent-decoded, with drive letters in front; other URIs unchanged.

    What can't be decoded stays as it is written.
    """
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.regexp_extract(uri, r"^[A-Za-z]+://([^/?#]*)", 1)
    body = F.regexp_extract(uri, r"^[A-Za-z]+:(?://[^/?#]*)?([^?#]*)", 1)
    decoded = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    path = F.concat(F.when(host.rlike("^[A-Za-z]:$"), host).otherwise(""), decoded(body))
    path = F.when(path.rlike("^/[A-Za-z]:"), path.substr(F.lit(2), F.length(path))).otherwise(path)
    return F.when(scheme == "file", path).when(scheme == "", decoded(uri)).otherwise(uri)


def frame_time(timestamp_ms: Column, index: Column, fps: Column) -> Column:
    """The frame's time, or from its index where a later frame has no time; frame rates of zero count as 30."""
    rate = F.coalesce(F.nullif(fps.cast("double"), F.lit(0.0)), F.lit(30.0))
    return F.when((timestamp_ms <= 0) & (index > 0), index / rate * 1000.0).otherwise(timestamp_ms)


def rgb_to_byte(channel: Column) -> Column:
    """A channel of 0 to 1 as a byte; halves go to the even side."""
    return F.rint(F.least(F.lit(1.0), F.greatest(F.lit(0.0), channel)) * 255.0).cast("int")


def subject(authorization: Column, host: Column) -> Column:
    """The pseudonym of a caller: a hash of its credentials, or its host; empty credentials are none."""
    credentials = F.nullif(authorization, F.lit(""))
    return F.coalesce(F.concat(F.lit("auth:"), F.substring(F.sha2(credentials, 256), 1, 16)), F.concat(F.lit("anonymous:"), F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown"))))


def asset_key(upload_id: Column, path: Column) -> Column:
    """A storage key that is the same in every run: a hash of upload and path, and the file's name."""
    return F.concat(F.sha2(F.concat_ws("\n", upload_id.cast("string"), path), 256), F.lit("_"), F.regexp_extract(path, r"([^/]*)$", 1))


def short_id(prefix: str, key: Column) -> Column:
    """A short id from a key: the prefix and six hexadecimal digits in capitals."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 6)))
