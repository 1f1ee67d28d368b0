"""Pairs of views to be matched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.scalars import k_matrix, stem, uri_path

WINDOW = 3


def _both_ways(pairs: DataFrame) -> DataFrame:
    two = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select("job_id", F.explode(two).alias("p")).select("job_id", "p.a", "p.b")


def complete_pairs(images: DataFrame) -> DataFrame:
    """(job_id, a, b) of all pairs of a job's images (job_id, pos), both ways. Jobs are capped, so the pairs are few."""
    return _both_ways(images.select("job_id", F.col("pos").alias("a")).join(images.select("job_id", F.col("pos").alias("b")), "job_id").filter("a < b"))


def window_pairs(images: DataFrame, window: int = WINDOW) -> DataFrame:
    """(job_id, a, b): each image with the next ones in a ring of the job's images, both ways, each pair once."""
    counted = images.select("job_id", "pos", F.count(F.lit(1)).over(Window.partitionBy("job_id")).alias("n"))
    ahead = counted.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(window)))).select("job_id", F.col("pos").alias("x"), F.pmod(F.col("pos") + F.col("k"), F.col("n")).alias("y"))
    once = ahead.filter("x <> y").select("job_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return _both_ways(once)


def sync_pairs(images: DataFrame, groups: DataFrame) -> DataFrame:
    """(job_id, a, b, emitted): pairs within groups of synchronised views, both ways, each once, in order of emission.

    ``images`` (job_id, pos, path), ``groups`` (job_id, group_pos, source_id, uri). A view is the first image whose path
    has the stem of its URI; views without one are left out. Sources of a group go in order of their names.
    """
    by_stem = images.groupBy("job_id", stem(F.col("path")).alias("stem")).agg(F.min("pos").alias("idx"))
    views = groups.withColumn("stem", stem(uri_path(F.col("uri")))).join(by_stem, ["job_id", "stem"]).select("job_id", "group_pos", "source_id", "idx")
    left, right = views.select("job_id", "group_pos", F.col("source_id").alias("s"), F.col("idx").alias("a")), views.select("job_id", "group_pos", F.col("source_id").alias("t"), F.col("idx").alias("b"))
    met = left.join(right, ["job_id", "group_pos"]).filter("s < t").select("job_id", "a", "b", F.struct("group_pos", "s", "t").alias("at"))
    # A pair that comes up again, either way round, is left out.
    first = met.groupBy("job_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min(F.struct("at", "a", "b")).alias("f"))
    first = first.select("job_id", "f.a", "f.b", (F.row_number().over(Window.partitionBy("job_id").orderBy("f.at")) - 1).alias("k"))
    one, two = F.struct("a", "b", (2 * F.col("k")).alias("emitted")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), (2 * F.col("k") + 1).alias("emitted"))
    own = F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, two))
    return first.select("job_id", F.explode(own).alias("p")).select("job_id", "p.a", "p.b", "p.emitted")


def job_pairs(images: DataFrame, groups: DataFrame, strategies: DataFrame) -> DataFrame:
    """(job_id, a, b, how): synchronised pairs where a job has any, else those of its strategy (job_id, strategy)."""
    synced = sync_pairs(images, groups).select("job_id", "a", "b", F.lit("sync").alias("how"))
    rest = images.join(synced.select("job_id").distinct(), "job_id", "left_anti").join(strategies, "job_id")
    swin = window_pairs(rest.filter("strategy = 'swin'")).withColumn("how", F.lit("swin"))
    return synced.unionByName(swin).unionByName(complete_pairs(rest.filter("strategy <> 'swin'")).withColumn("how", F.lit("complete")))


def intrinsic_priors(images: DataFrame, frames: DataFrame) -> DataFrame:
    """(job_id, path, k) for images and frames at the same position, where the frame has a focal length.

    ``images`` (job_id, pos, path, width, height), ``frames`` (job_id, pos, focal_length_35mm).
    """
    k = k_matrix(F.col("focal_length_35mm"), F.col("width"), F.col("height"))
    return images.join(frames.select("job_id", "pos", "focal_length_35mm"), ["job_id", "pos"]).select("job_id", "path", k.alias("k")).filter("k is not null")
