"""Secret scanning with corpus-wide ownership frequency.

Every whole text is searched for the base kinds (assignments, access keys, hexadecimal strings) and for bare
credentials: long tokens of mixed characters and high entropy that no base span touches. What a candidate is worth is
decided over the corpus: its hash is counted by the distinct repositories and owners that hold it. A repository has one
owner, however often it is copied, so copies of one text make no value common. A value that several owners hold is a
copied example; a value of one or two owners looks live. Bare candidates become spans only if they look live; base spans
always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import slices, written

# The base patterns and the lengths below which a match is dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "bare")

BARE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])")
MIN_BITS = 4.0
#: A value with at most this many owners looks live.
LIVE_OWNERS = 2

Span = tuple[int, int, int, str]

SCAN_SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:int,kind:int,end:int,value:string>>"


def bits_per_character(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[Span]:
    """(start, kind, end, secret value) of the base kinds, by start, then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def bare_spans(text: str, taken: list[Span]) -> list[Span]:
    """Tokens with lower case, upper case and digits and at least ``MIN_BITS`` bits a character, outside ``taken``."""
    found = []
    for m in BARE.finditer(text):
        v = m[0]
        mixed = sum(c.isdigit() for c in v) >= 3 and sum(c.isupper() for c in v) >= 3 and sum(c.islower() for c in v) >= 3
        if mixed and bits_per_character(v) >= MIN_BITS and not any(s[0] < m.end() and m.start() < s[2] for s in taken):
            found.append((m.start(), 3, m.end(), v))
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end, _ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column(batch.schema.get_field_index("__text"))
        counts, digests, found = ([], [], []), [], []
        for text in texts:
            text = text.as_py() or ""
            base = base_spans(text)
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in base))
            digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
            spans = base + bare_spans(text, base)
            found.append([{"start": s, "kind": k, "end": e, "value": hashlib.sha256(v.encode()).hexdigest()} for s, k, e, v in spans])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        arrays = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "__text"]
        names = [n for n in batch.schema.names if n != "__text"]
        arrays += [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(found, kind)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def scan(docs: DataFrame, repository: Column, owner: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Candidates of each row of ``docs``: its id, owner and repository, the base figures, and all spans with hashes."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), F.col(text).alias("__text")
    )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(_scan, f"{fields}, {SCAN_SCHEMA}")


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, n_repositories, n_owners) over (value, owner, repository) rows; null owners and repositories count as one.

    The owner of a repository is the first of those that its copies name. Every step combines before its shuffle, so a
    value that a third of all texts hold is few rows by then.
    """
    each = candidates.groupBy("value", "repository").agg(F.min("owner").alias("owner"))
    by_owner = each.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def find_secrets(docs: DataFrame, repository: Column, owner: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Secrets in each row of ``docs``: doc_id, text_hash, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared
    and live_spans.

    ``spans`` lists kind:start:end of base spans and of the bare ones that look live, by start, then kind; positions
    are code points, ends exclusive. ``live_spans`` are those of them whose value looks live (``n_live``); the other
    ones (``n_shared``) hold widely copied values. A null text is empty. Rows that repeat an id are reported each for
    itself; a null id stays null; a null owner or repository counts as one owner or repository. An empty table gives
    no rows, and other columns of ``docs`` don't matter. Texts of any length are searched whole.
    """
    scanned = written(scan(docs, repository, owner, text, doc_id).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = scanned.filter(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("s")).select("row", "owner", "repository", "s.*")
    judged = each.join(ownership(each), "value")
    live = F.col("n_owners") <= LIVE_OWNERS
    judged = judged.withColumn("live", live).filter((F.col("kind") < 3) | F.col("live"))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    spans = judged.withColumn("name", name).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "name"))).alias("all"))

    def text_of(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    alive = F.filter("all", lambda s: s["live"])
    spans = spans.select("row", text_of(F.col("all")).alias("spans"), F.size(alive).cast("long").alias("n_live"), (F.size("all") - F.size(alive)).cast("long").alias("n_shared"), text_of(alive).alias("live_spans"))
    joined = scanned.drop("found", "owner", "repository").join(spans, "row", "left")
    return joined.select(
        "doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.coalesce("live_spans", F.lit("")).alias("live_spans"),
    )


REDACTED = "[REDACTED]"


def redact_spans(text: str, spans: str) -> str:
    """The text with every listed span replaced; spans that overlap are replaced as one."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for start, end in (map(int, s.split(":")[1:]) for s in spans.split(",")):
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, repository: Column, owner: Column, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with the values that look live replaced in their texts, and ``n_chars`` counted anew where it changes.

    Widely copied values stay, and so do all rows, repeated ones and those with a null id too; a null text stays null.
    An empty table gives no rows; names that begin with two underscores are the operator's own. Only texts with live
    spans meet Python a second time.
    """
    found = find_secrets(docs, repository, owner, text, doc_id).filter(F.col("live_spans") != "")
    live = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("live_spans").alias("__spans")).distinct()
    keyed = docs.withColumn("__text_hash", F.xxhash64(F.col(text)))
    joined = keyed.join(live, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([redact_spans(t, s) for t, s in zip(texts, spans, strict=True)])

    # Texts without spans go to Python as nulls.
    fresh = joined.withColumn("__fresh", F.when(F.col("__spans").isNotNull(), cut(F.when(F.col("__spans").isNotNull(), F.col(text)), F.col("__spans"))))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.coalesce("__fresh", F.col(text)).alias(c))
        elif c == n_chars:
            columns.append(F.coalesce(F.length("__fresh").cast(docs.schema[c].dataType), F.col(c)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return fresh.select(*columns)
