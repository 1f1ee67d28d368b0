"""Proportional stratified interleaving: shards of equal row counts, each with the mixture of the whole table.

Within each source the rows are ranked in a seeded random order. A row's fractional rank (its rank over the size of its
source) spreads every source evenly over the interval 0 to 1; all rows in the order of their fractional ranks are cut
into shards of equal counts.

Both rankings are global, and neither sorts a source or the table in one task: rows are dealt into ranges of the whole
sort key, whose last part tells even equal rows apart, the ranges' counts are summed up in a small table, and only rows
of one range are sorted together. The ranks don't depend on where Spark puts the bounds of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.scratch import written

SEED = "mixture-1"


def _ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0) of each row within ``by``; ``order`` has no ties."""
    ranges = written(rows.repartitionByRange(*by, *order).withColumn("range", F.spark_partition_id()), "shard-ranges")
    counts = ranges.groupBy(*by, "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*by, "range", F.coalesce(before, F.lit(0)).alias("start"))
    within = ranges.withColumn("in_range", F.row_number().over(Window.partitionBy(*by, "range").orderBy(*order)) - 1)
    return within.join(starts, [*by, "range"]).withColumn("rank", F.col("start") + F.col("in_range")).drop("start", "in_range", "range")


def _placed(rows: DataFrame, n_shards: int, seed: str) -> DataFrame:
    """Ranks, shard and slot of (doc_id, source, text, row) rows; ``row`` is another number for each row."""
    body = F.coalesce(F.col("text"), F.lit(""))
    narrow = written(
        rows.select(
            "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"),
            F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("key"), "row",
        ), "shard-rows",
    )
    n_rows = narrow.count()
    ranked = _ranked(narrow, ["source"], ["key", "doc_id", "text_crc32", "row"]).withColumnRenamed("rank", "in_source")
    totals = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    spread = ranked.join(totals, "source").withColumn("fraction", (2 * F.col("in_source") + 1).cast("double") / (2 * F.col("of")).cast("double"))
    rows = _ranked(spread.withColumn("all", F.lit(0)), ["all"], ["fraction", "source", "in_source"])
    first = F.floor((F.col("shard") * n_rows + n_shards - 1) / n_shards)
    return rows.withColumn("shard", F.floor(F.col("rank") * n_shards / F.lit(n_rows)).cast("int")).withColumn("slot", F.col("rank") - first)


def _numbered(docs: DataFrame, source: str, text: str, doc_id: str, *more: Column) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"), *more)


def interleaved_shards(docs: DataFrame, n_shards: int, source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """Shard and slot for each row: (doc_id, source, size, text_crc32, rank, fraction, position, shard, slot).

    Counts of any two shards, and a source's counts in them, are as equal as whole rows allow (one apart for the
    shards, one or two for a source). A null text counts as no bytes, a null source is a source of its own.
    Rows with the same id, source and text are interchangeable and take neighbouring ranks. An empty table gives no
    rows, and other columns of ``docs`` don't matter. Texts are read once; only ids, sources, sizes and checksums are
    shuffled.
    """
    placed = _placed(_numbered(docs, source, text, doc_id), n_shards, seed)
    return placed.select("doc_id", F.expr("substr(nullif(source, ''), 2)").alias("source"), "size", "text_crc32", F.col("in_source").alias("rank"), "fraction", F.col("rank").alias("position"), "shard", "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int, source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: str = SEED) -> tuple[str, str]:
    """Write every row of ``docs`` with its shard and slot to ``path``, one folder for each shard; returns their names.

    The two columns are called shard and slot, with underscores after them while ``docs`` has such a column. All columns
    and rows stay as they are, those with null or repeated ids too: the rows are numbered in a table of their own, and
    the number brings shard and slot back to them. An empty table writes no shard.
    """
    names = []
    for name in ("shard", "slot"):
        while name.lower() in {c.lower() for c in docs.columns}:
            name += "_"
        names.append(name)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = written(_numbered(docs, source, text, doc_id, whole).select("doc_id", "source", "whole", "row"), "shard-whole")
    placed = _placed(rows.select("doc_id", "source", F.col("whole")[text].alias("text"), "row"), n_shards, seed).select("row", "shard", "slot")
    out = rows.join(placed, "row").repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
    out.select("whole.*", *[F.col(a).alias(b) for a, b in zip(("shard", "slot"), names, strict=True)]).write.partitionBy(names[0]).parquet(path)
    return names[0], names[1]
