"""Joins and partitions of tables that Spark takes for smaller than they are."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(table: DataFrame) -> DataFrame:
    """``table`` for a join whose sides are both dealt by key, and neither of them sent whole to the driver and all tasks.

    Spark measures a table by its files. Numbers of a lattice, and what is exploded from a row, take a hundred times as
    much once they are rows, so tables of gigabytes are broadcast as small ones.
    """
    return table.hint("merge")


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """``table`` dealt by ``keys`` over all shuffle partitions of the session, however few bytes its files take.

    Adaptive execution merges partitions by their compressed bytes, and puts what makes gigabytes of rows into one task.
    """
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ranged(table: DataFrame, *keys: str) -> DataFrame:
    """``table`` in ranges of ``keys``, as many as the session's shuffle partitions: as even as ``spread``, and what is near lies together."""
    return table.repartitionByRange(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
