"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text is measured once. The measures of all texts of a language and source go into a quantile sketch: counts in
buckets whose width is at most a sixteenth of their value. Sketches of the same measure merge by adding counts, in any
order and with the same result, so Spark builds them with partial sums, and the sketches of sources merge into those
of languages and of the whole corpus. The thresholds come from the sketches alone: a limit lies beyond the outer decile
by a multiple of that decile's distance from the median. So a source where symbols are usual allows many, and one where
nine texts in ten have none allows none. The limits of a source are mixed with those of its language, and a language's
with those of all texts, in proportion to their numbers of texts, so small groups lean on larger ones without a switch.
A join brings the limits to the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.scratch import slices, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
#: Texts whose repeated words are more than this share (in percent) of all words fail.
MAX_REPEAT_PERCENT = 50
#: The outer deciles are those of this percentage; limits lie beyond them by this many times their distance from the median.
TAIL, REACH = 10, 3
#: A group's limits are mixed with those of the next larger one as if that added this many texts.
PRIOR = 20
#: Measures (integers) and whether low values fail too. Rates count what goes beyond a single occurrence.
MEASURES = {"symbol_rate": False, "dup_line_rate": False, "repeat_rate": False, "word_length": True}
#: Words that one repeated window of three words covers.
ONE_REPEAT = 6

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more in the text, their first occurrence included."""
    if len(words) < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    n = len(seen)
    if n == len(words):
        return 0
    pairs = ids[:-2] * n + ids[1:-1]
    if n >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs * n + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one whole text."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [measure(t.as_py() or "") for t in batch.column(batch.schema.get_field_index("__text"))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
        arrays = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "__text"]
        names = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(c, pa.int64()) for c in columns]], names=[*names, *COUNTS])


def bucket(value: Column) -> Column:
    """Sketch bucket of an integer of 0 or more: itself below 32, then 16 buckets for each power of two."""
    shift = F.length(F.bin(value)) - 5
    return F.when(value < 32, value).otherwise(16 * shift + F.floor(value / F.pow(F.lit(2), shift)))


def bucket_top(b: Column) -> Column:
    """The largest integer that falls into bucket ``b``."""
    shift = F.floor((b - 16) / 16)
    return F.when(b < 32, b).otherwise((F.pow(F.lit(2), shift) * (b - 16 * shift + 1) - 1).cast("long"))


def sketches(measured: DataFrame) -> DataFrame:
    """Counts by (lang, source, measure, bucket), and merged by (lang, measure, bucket) and (measure, bucket).

    ``depth`` is 2, 1 or 0: how many of the two keys hold.
    """
    each = measured.select("lang", "source", F.explode(F.create_map(*[x for m in MEASURES for x in (F.lit(m), bucket(F.col(m)))])).alias("measure", "bucket"))
    own = each.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    by_lang = own.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")).withColumn("source", none).withColumn("depth", F.lit(1))
    all_ = own.groupBy("measure", "bucket").agg(F.sum("n").alias("n")).withColumn("source", none).withColumn("lang", none).withColumn("depth", F.lit(0))
    return own.withColumn("depth", F.lit(2)).unionByName(by_lang).unionByName(all_)


def fences(counted: DataFrame) -> DataFrame:
    """(depth, lang, source, total, and low_ and high_ of each measure) from sketches: one row for each sketch group."""
    by = ["depth", "lang", "source", "measure"]
    up = Window.partitionBy(*by).orderBy("bucket")
    ranked = counted.withColumn("upto", F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    quantile = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), bucket_top(F.col("bucket"))))
    cut = ranked.groupBy(*by).agg(quantile(TAIL).alias("lower"), quantile(50).alias("median"), quantile(100 - TAIL).alias("upper"), F.max("total").alias("total"))
    cut = cut.withColumn("low", F.greatest(F.lit(0), F.col("lower") - REACH * (F.col("median") - F.col("lower")))).withColumn("high", F.col("upper") + REACH * (F.col("upper") - F.col("median")))
    pick = lambda c, m: F.max(F.when(F.col("measure") == m, F.col(c)))
    sides = [pick("high", m).alias(f"high_{m}") for m in MEASURES] + [pick("low", m).alias(f"low_{m}") for m, both in MEASURES.items() if both]
    return cut.groupBy("depth", "lang", "source").agg(F.max("total").alias("total"), *sides)


def thresholds(counted: DataFrame) -> DataFrame:
    """The limits that hold for each (lang, source): its own, mixed with its language's, mixed with those of all texts."""
    found = fences(counted)
    bounds = [c for c in found.columns if c.startswith(("low_", "high_"))]
    level = lambda d, tag: found.filter(F.col("depth") == d).select(*[F.col(c).alias(f"{tag}{c}") for c in ("lang", "source", "total", *bounds)])
    mixed = lambda n, own, wider: F.expr(f"({n} * {own} + {PRIOR} * {wider}) div ({n} + {PRIOR})")
    lang = level(1, "l_").join(F.broadcast(level(0, "a_")), F.lit(True), "left")  # of all texts there is one row
    lang = lang.select("l_lang", *[mixed("l_total", f"l_{c}", f"a_{c}").alias(f"l_{c}") for c in bounds])
    joined = level(2, "").join(lang, F.col("lang") == F.col("l_lang"), "left")
    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[mixed("total", c, f"l_{c}").alias(c) for c in bounds])


def quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Measures and verdict of each row: doc_id, the base counts, base_failed, failed (names of measures), kept.

    A null text has no words (and so fails); null languages and null sources are groups of their own. Rows that
    repeat an id are judged each for itself, and so are repeated rows, which count in the sketches as often as they stand
    there. An empty table gives no rows; other columns of ``docs`` don't matter. All texts, whole, shape the limits.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  null apart from any value
    rows = docs.select(F.col(doc_id).alias("doc_id"), key(lang).alias("lang"), key(source).alias("source"), F.col(text).alias("__text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    counts = rows.mapInArrow(_measure, f"{fields}, {', '.join(f'{c} long' for c in COUNTS)}")
    rate = lambda times, n, once, of: F.expr(f"CASE WHEN {of} > 0 THEN {times} * greatest(0, {n} - {once}) div {of} ELSE 0 END")
    measured = written(
        counts.withColumn("symbol_rate", rate(1000, "n_symbols", 1, "n_words"))
        .withColumn("dup_line_rate", rate(1000, "n_dup_lines", 1, "n_lines"))
        .withColumn("repeat_rate", rate(1000, "n_repeat_words", ONE_REPEAT, "n_words"))
        .withColumn("word_length", rate(10, "word_chars", 0, "n_words")),
        "quality",
    )
    limits = thresholds(sketches(measured))
    joined = measured.join(limits, (F.col("lang") == F.col("t_lang")) & (F.col("source") == F.col("t_source")), "left")
    outside = [F.when((F.col(m) > F.col(f"high_{m}")) | ((F.col(m) < F.col(f"low_{m}")) if both else F.lit(False)), F.lit(m)) for m, both in MEASURES.items()]
    judged = joined.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    judged = judged.withColumn("failed", F.array_join(F.array_compact(F.array(*outside)), ","))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"))
