"""Rows without a partner left out where they lie, by a Bloom filter of the partners' keys.

A join of a large table with few keys shuffles the whole table; behind a sieve only the rows that meet move, and few others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for a key, places of a key, bits of a filter at least and at most (8 MB; with more keys more rows pass in vain), bits of one part.
PER_KEY, PLACES, LEAST, MOST, PART = 16, 2, 1 << 15, 1 << 26, 1 << 15


def _places(key: Column, bits: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(k)).bitwiseAND(F.lit(bits - 1)) for k in range(PLACES)]


def sieve(keys: DataFrame, most: int = MOST) -> Callable[[str], Column]:
    """A condition on a column of the type of ``keys``' only one: true for all values that ``keys`` holds, and for few others.

    The filter has at most ``most`` bits, whatever the number of keys: that bounds what the driver gathers and the tasks get.
    """
    (name,) = keys.columns
    n = keys.agg(F.approx_count_distinct(name)).first()[0]
    bits = min(most, max(LEAST, 1 << (PER_KEY * n).bit_length()))
    places = keys.distinct().select(F.explode(F.array(*_places(F.col(name), bits))).alias("at"))
    part = places.select(F.shiftright("at", 15).alias("part"), F.col("at").bitwiseAND(F.lit(PART - 1)).alias("bit")).repartition("part")
    whole = np.zeros((bits // PART, PART // 8), np.uint8)
    for row in part.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("set")).collect():
        whole[row["part"]] = np.frombuffer(row["set"], np.uint8)
    held = keys.sparkSession.sparkContext.broadcast(whole.reshape(-1))

    @F.pandas_udf("boolean")
    def holds(one: pd.Series, two: pd.Series) -> pd.Series:
        at = [one.to_numpy(), two.to_numpy()]
        return pd.Series(np.logical_and(*[(held.value[x >> 3] >> (x & 7) & 1).astype(bool) for x in at]))

    return lambda column: holds(*_places(F.col(column), bits))
