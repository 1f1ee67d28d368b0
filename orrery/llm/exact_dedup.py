"""Exact deduplication against a minimal perfect hash over historical digests.

The history is reduced to its distinct digests. They are dealt by digest into buckets of a bounded size, and each
bucket becomes one index row: the levels of a minimal perfect hash, and for every slot the whole digest and the locator
of the winning row. A new batch is reduced to its distinct digests too (so a text that makes up a third of all rows
is one row before anything is shuffled by bucket), meets its bucket's index, and a hit counts only if the slot's
32 digest bytes are the same. Digests that are no members form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import fresh, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of a level for each key that is still without a slot.
GAMMA = 2.0
#: Rows of input for each bucket of the index; a bucket is handled in one task's memory.
ROWS_PER_BUCKET = 20_000

INDEX_SCHEMA = "bucket long, n_keys long, level_bits array<long>, levels array<binary>, digests binary, winners array<long>, copies array<long>"
GROUP_SCHEMA = "digest binary, keep_id long, group_size long, in_history boolean"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each digest, apart from the bytes that choose its bucket."""
    w = digests.view("<u8")
    return w[:, 1].copy(), w[:, 2].copy()


def _position(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(2 * level + 1))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


def perfect_hash(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels (boolean arrays) of a minimal perfect hash over distinct rows of 32 bytes, and each row's slot.

    On every level a key takes the bit that no other remaining key hits; the others try the next level. A key's slot
    is the number of bits set before its own, over all levels: 0 to n - 1 without a gap.
    """
    a, b = _words(digests)
    left, slots, levels, before = np.arange(len(digests)), np.empty(len(digests), np.int64), [], 0
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        at = _position(a[left], b[left], len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        own = bits[at]
        slots[left[own]] = before + (np.cumsum(bits) - 1)[at[own]]
        before += int(bits.sum())
        levels.append(bits)
        left = left[~own]
    return levels, slots


def find_slots(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot of each digest, or -1 if no level has its bit. A slot may belong to another digest: compare bytes."""
    a, b = _words(digests)
    left, slots, before = np.arange(len(digests)), np.full(len(digests), -1, np.int64), 0
    for k, bits in enumerate(levels):
        at = _position(a[left], b[left], k, len(bits))
        own = bits[at]
        slots[left[own]] = before + (np.cumsum(bits) - 1)[at[own]]
        before += int(bits.sum())
        left = left[~own]
    return slots


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _locators(column: pd.Series) -> list[int | None]:
    return [None if pd.isna(x) else int(x) for x in column]


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(rows["digest"])
    levels, slots = perfect_hash(digests)
    order = np.argsort(slots)
    winners, copies = _locators(rows["winner"]), rows["copies"].to_numpy()
    return pd.DataFrame(
        {
            "bucket": [rows["bucket"].iloc[0]],
            "n_keys": [len(rows)],
            "level_bits": [[len(x) for x in levels]],
            "levels": [[np.packbits(x).tobytes() for x in levels]],
            "digests": [digests[order].tobytes()],
            "winners": [[winners[i] for i in order]],
            "copies": [copies[order].tolist()],
        }
    )


def _larger(a: int | None, b: int | None) -> int | None:
    return max((x for x in (a, b) if x is not None), default=None)


def _look_up(batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Groups of one bucket: every slot, with what the batch adds to it, then the batch's own digests."""
    keys, winners, sizes, known = [], [], [], []
    fresh = np.ones(len(batch), bool)
    own, counts = _locators(batch["winner"]), batch["copies"].to_numpy()
    if len(index):
        row = index.iloc[0]
        table = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        top, held = [None if pd.isna(x) else int(x) for x in row["winners"]], np.array(row["copies"], np.int64)
        if len(batch):
            digests = _matrix(batch["digest"])
            levels = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(row["levels"], row["level_bits"], strict=True)]
            slots = find_slots(levels, digests)
            hit = (slots >= 0) & (table[slots] == digests).all(axis=1)
            for i in np.flatnonzero(hit):
                top[slots[i]] = _larger(top[slots[i]], own[i])
                held[slots[i]] += counts[i]
            fresh = ~hit
        keys, winners, sizes, known = [x.tobytes() for x in table], top, held.tolist(), [True] * len(table)
    for i in np.flatnonzero(fresh):
        keys.append(batch["digest"].iloc[i])
        winners.append(own[i])
        sizes.append(int(counts[i]))
        known.append(False)
    return pd.DataFrame({"digest": keys, "keep_id": pd.array(winners, "Int64"), "group_size": sizes, "in_history": known})


def _distinct(rows: DataFrame, n_buckets: int) -> DataFrame:
    """One row for each digest: its bucket, its largest id and its number of rows. Spark combines before the shuffle."""
    grouped = rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies"))
    return grouped.withColumn("bucket", F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(n_buckets)))


def build_index(history: DataFrame, n_buckets: int) -> DataFrame:
    """The index over (digest, doc_id) rows: one row for each bucket that has keys."""
    return _distinct(history, n_buckets).groupBy("bucket").applyInPandas(_build, INDEX_SCHEMA)


def look_up(batch: DataFrame, index: DataFrame, n_buckets: int) -> DataFrame:
    """Groups (digest, keep_id, group_size, in_history) over the indexed history and a batch of (digest, doc_id) rows."""
    left = _distinct(batch, n_buckets).groupBy("bucket")
    return left.cogroup(index.groupBy("bucket")).applyInPandas(_look_up, GROUP_SCHEMA)


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Mark exact copies: one row (doc_id, keep_id, group_size, kept, text_sha256, in_history) for each row of ``docs``.

    The lower half of the id range is taken as the history that is indexed, the upper half as the batch that is looked
    up; all rows take part and the result doesn't depend on where the range is cut. Of equal texts the row with the
    largest id stays.

    Null text is the empty text. Rows with a null id belong to the batch, count towards the group, and win only if no
    row of the group has an id. Rows that repeat the winning id are all marked kept. An empty table gives no rows.
    The texts are read once: their digests are a table of their own from then on.
    """
    ids = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(F.col(text)).alias("digest")), "digests")
    n_rows, low, high = ids.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    n_buckets = max(1, -(-n_rows // ROWS_PER_BUCKET))
    middle = None if low is None else low + (high - low) // 2
    old = F.coalesce(F.col("doc_id") <= F.lit(middle).cast("long"), F.lit(False))
    index = build_index(ids.filter(old), n_buckets)
    groups = look_up(ids.filter(~old), index, n_buckets)
    return ids.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "in_history",
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each text, that of the largest id; columns unchanged, other columns don't matter.

    Null text is the empty text. Rows with a null id stay only if no row with their text has an id. Of rows that repeat
    id and text of a winner one stays. An empty table gives no rows. The join's keys are (id, digest), so no group of
    copies meets in one task; repeated winners are reduced to one in each task before they meet.
    """
    own_id, own, kept, key = fresh(docs.columns, "__own_id", "__own", "__kept", "__digest")
    marks = written(exact_groups(docs, text, doc_id).select(F.col("doc_id").alias(own_id), F.unhex("text_sha256").alias(own), F.col("kept").alias(kept)), "exact-marks")
    keyed = docs.withColumn(key, digest(F.col(text)))
    same = (F.col(doc_id).cast("long").eqNullSafe(F.col(own_id))) & (F.col(key) == F.col(own))
    left = keyed.join(marks.filter(~F.col(kept)), same, "left_anti")
    repeated = marks.filter(F.col(kept)).groupBy(own).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(own)
    if not repeated.isEmpty():
        several = F.col(key) == F.col(own)
        left = left.join(repeated, several, "left_anti").unionByName(left.join(repeated, several, "left_semi").dropDuplicates([key]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
