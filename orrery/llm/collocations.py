"""Phrases whose words stand together more often than apart: multikey three-way quicksort of suffix pointers.

Every word of a text is a suffix: it and the words that follow it in its piece, four at most. A first pass counts words
and pairs of words by hash slots; the slots that hold enough for a candidate become two bitmaps of fixed size. They may
let others pass (the sort abandons those), but lose none. A second pass ends suffixes at words and pairs that can't be
frequent, codes those of each chunk of texts against the chunk's own words, sums equal ones, and deals them out by their
leading two words, so that all suffixes of a phrase meet in one bucket. There, pointers to them are sorted by multikey
three-way quicksort, word by word down to the fourth: the size of an equal partition is a phrase's count, and partitions
that hold fewer suffixes than a candidate needs are abandoned at once. Buckets that a few leading words overfill are
dealt out by one word more, their leading phrases being summed beforehand.

The cuts of candidates meet the counts of their parts in joins, and so do candidates and the longer ones around them.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.scratch import dropped, slices, written

LONGEST, LEAST = 4, 30
TOP = 2000
#: A candidate goes if one around it has at least this part (4 / 5) of its occurrences.
WITHIN = (4, 5)
SCALE = 2_000_000
NO_LANG = "und"



@dataclass(frozen=True)
class Limits:
    """Sizes that bound memory; results don't depend on them.

    Words of a chunk; bytes of a text that are split at once; bits of a slot's number (bitmaps of 16 MB each) and of its
    place in a page; suffixes that a bucket has on average at most, and how many times that make it dealt out again.
    """

    chunk: int = 2_000_000
    window: int = 4 << 20
    slot_bits: int = 27
    page_bits: int = 20
    bucket: int = 2_000_000
    overfull: int = 4


# What ends a piece, what parts words.
_TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_BREAK = b"\n"


def _windows(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut at spaces."""
    at = 0
    while len(text) - at > size:
        cut = text.find(b" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class Chunk:
    """Words of many texts as numbers: ``ids`` in order, with -1 between pieces, and the language number of each."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.words: dict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.words[b""], self.words[_BREAK]  # numbers 0 and 1: nothing, and the end of a piece
        self.langs: dict[str, int] = {}
        self._ids: list[np.ndarray] = []
        self._langs: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes, lang: str) -> None:
        number = self.langs.setdefault(lang, len(self.langs))
        for part in _windows(text.lower().translate(_TABLE), self.window):
            tokens = part.replace(_BREAK, b" \n ").split(b" ")
            ids = np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens))
            ids = ids[ids > 0] - 2
            self._ids.append(ids)
            self._langs.append(np.full(len(ids), number, np.int32))
            self.size += len(ids)
        self._ids.append(np.array([-1], np.int32))
        self._langs.append(np.array([number], np.int32))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, languages); between pieces and texts the id is -1."""
        return np.concatenate(self._ids), np.concatenate(self._langs)

    def vocabulary(self) -> list[bytes]:
        return list(self.words)[2:]


def _chunks(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[Chunk]:
    chunk = Chunk(limits.window)
    for batch in slices(batches):
        for text, lang in zip(batch.column("__text").cast(pa.binary()), batch.column("lang").to_pylist(), strict=True):
            chunk.add(text.as_py() or b"", lang)
            if chunk.size >= limits.chunk:
                yield chunk
                chunk = Chunk(limits.window)
    if chunk.size:
        yield chunk


def _mixed(key: np.ndarray) -> np.ndarray:
    key = (key ^ key >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ key >> np.uint64(32)


def slots(chunk: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, languages, slot of each word, slot of each word with the next one); -1 where there is none."""
    ids, langs = chunk.arrays()
    marks = np.array([*map(zlib.crc32, chunk.vocabulary()), 0], np.uint64)[ids]
    tags = np.array([zlib.crc32(x.encode()) for x in chunk.langs], np.uint64)[langs] << np.uint64(32)
    low = np.uint64((1 << bits) - 1)
    word = _mixed(marks ^ tags)
    pair = (_mixed(word[:-1] + (marks[1:] << np.uint64(1))) & low).astype(np.int64)
    pair[(ids[:-1] < 0) | (ids[1:] < 0)] = -1
    return ids, langs, np.where(ids < 0, -1, (word & low).astype(np.int64)), np.append(pair, -1)


def _count_slots(least: int, limits: Limits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per chunk, kind (words, pairs) and page of slots: how many words, the slots in use and their counts, up to ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for chunk in _chunks(batches, limits):
            for kind, found in enumerate(slots(chunk, limits.slot_bits)[2:]):
                used, counts = np.unique(found[found >= 0], return_counts=True)
                few = np.minimum(counts, least).astype("<u4")
                cuts = np.flatnonzero(np.diff(used >> limits.page_bits, prepend=-1))
                for a, b in zip(cuts, np.append(cuts[1:], len(used)), strict=len(used) > 0):
                    own = np.diff(used[a:b], prepend=used[a] >> limits.page_bits << limits.page_bits).astype("<u4")
                    planes = np.concatenate([own, few[a:b]]).view(np.uint8).reshape(-1, 4).T  # bytes of like weight together
                    row = (kind, int(used[a] >> limits.page_bits), int(counts[a:b].sum()), squeeze(planes.tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["kind", "page", "n", "data"])

    return run


def _enough(least: int, limits: Limits) -> Callable[[pa.Table], pa.Table]:
    """The bits of a page's slots whose counts reach ``least``."""

    def run(page: pa.Table) -> pa.Table:
        total = np.zeros(1 << limits.page_bits, np.int64)
        for data in page.column("data"):
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_py()), np.uint8).reshape(4, -1)
            gaps, counts = np.ascontiguousarray(planes.T).view("<u4").reshape(2, -1).astype(np.int64)
            total[np.cumsum(gaps)] += counts
        bits = zlib.compress(np.packbits(total >= least).tobytes(), 1)
        return pa.table({"kind": page.column("kind")[:1], "page": page.column("page")[:1], "n": pa.array([sum(page.column("n").to_pylist())]), "bits": pa.array([bits])})

    return run


def bitmaps(rows: DataFrame, least: int, limits: Limits) -> tuple[list[bytes], int]:
    """(the compressed bitmaps of slots of words and of pairs that may be frequent, the number of words).

    Each has ``2 ** slot_bits`` bits whatever the corpus: that bounds what the driver gathers and the tasks get.
    """
    counted = rows.mapInArrow(_count_slots(least, limits), "kind long, page long, n long, data binary")
    pages = counted.groupBy("kind", "page").applyInArrow(_enough(least, limits), "kind long, page long, n long, bits binary")
    size = 1 << (limits.page_bits - 3)
    found, n = [np.zeros(1 << (limits.slot_bits - 3), np.uint8) for _ in range(2)], 0
    for kind, page, count, bits in pages.toLocalIterator():
        found[kind][page * size : (page + 1) * size] = np.frombuffer(zlib.decompress(bits), np.uint8)
        n += count if kind == 0 else 0
    return [zlib.compress(x.tobytes(), 1) for x in found], n


def suffixes(chunk: Chunk, known: list[np.ndarray], limits: Limits) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]:
    """(columns, counts) of the distinct suffixes of a chunk, and of its distinct words.

    Columns are the language and up to ``LONGEST`` words, -1 where a suffix has ended. A word or pair that the bitmaps
    don't know ends it like the end of a piece; of single words there are no suffixes.
    """
    ids, langs, *found = slots(chunk, limits.slot_bits)
    word, pair = (np.where(at < 0, False, bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool) for at, bits in zip(found, known, strict=True))
    pair[:-1] &= word[:-1] & word[1:]
    numbers, n = np.unique(langs[word].astype(np.int64) * len(chunk.words) + ids[word], return_counts=True)
    words = [numbers // len(chunk.words), numbers % len(chunk.words)]
    at = np.flatnonzero(pair)
    ids, pair = np.concatenate([ids, np.full(LONGEST, -1, ids.dtype)]), np.concatenate([pair, np.zeros(LONGEST, bool)])
    columns = [langs[at], ids[at]]
    goes_on = np.ones(len(at), bool)
    for k in range(1, LONGEST):
        goes_on = goes_on & pair[at + k - 1]
        columns.append(np.where(goes_on, ids[at + k], -1))
    return *_summed(columns, np.ones(len(at), np.int64)), words, n


def _summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows in order of their columns, equal ones once, with the sums of their counts."""
    if not len(counts):
        return columns, counts
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = np.zeros(len(order), bool)
    first[0] = True
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(first)
    return [c[at] for c in columns], np.add.reduceat(counts[order], at)


def pack_block(words: list[bytes], langs: list[str], columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Suffixes coded against the words and languages that they use, compressed."""
    used, at = np.unique(np.concatenate(columns[1:]), return_inverse=True)
    own_langs, lang_at = np.unique(columns[0], return_inverse=True)
    shift = 0 if used[0] < 0 else 1  # number 0 is the end
    numbers = (at + shift).astype("<u4").reshape(len(columns) - 1, -1)
    table = b" ".join(words[i] for i in used[1 - shift :]), json.dumps([langs[i] for i in own_langs]).encode()
    planes = np.concatenate([lang_at.astype("<u4"), *numbers]).view(np.uint8).reshape(-1, 4).T  # bytes of like weight together
    head = np.array([len(counts), *map(len, table)], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *table, planes.tobytes(), counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()]))


def unpack_block(data: bytes) -> tuple[list[bytes], list[str], list[np.ndarray], np.ndarray]:
    """(words, languages, columns, counts) of a block: language numbers, word numbers from 0, -1 where a suffix has ended."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, *sizes = np.frombuffer(raw, "<i8", 3).tolist()
    a, b = 24 + sizes[0], 24 + sizes[0] + sizes[1]
    whole = lambda at, rows, size: np.ascontiguousarray(np.frombuffer(raw, np.uint8, rows * size, at).reshape(size, rows).T)
    numbers = whole(b, n * (LONGEST + 1), 4).view("<u4").reshape(LONGEST + 1, n).astype(np.int32)
    counts = whole(b + 4 * n * (LONGEST + 1), n, 8).view("<i8").reshape(-1)
    return raw[24:a].split(b" "), json.loads(raw[a:b]), [numbers[0], *(numbers[1:] - 1)], counts


BLOCK = "bucket long, n long, data binary"


def _deal(words: list[bytes], langs: list[str], columns: list[np.ndarray], counts: np.ndarray, depth: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Suffixes as one block for each bucket; the bucket follows from the language and the first ``depth`` words."""
    mark = np.array([zlib.crc32(w) for w in words] + [0], np.uint64)
    key = np.array([zlib.crc32(x.encode()) for x in langs], np.uint64)[columns[0]]
    for c in columns[1 : depth + 1]:
        key = (key ^ mark[c]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    columns, counts, bucket = [c[order] for c in columns], counts[order], bucket[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=len(bucket) > 0):
        row = int(bucket[a]), int(b - a), pack_block(words, langs, [c[a:b] for c in columns], counts[a:b])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["bucket", "n", "data"])


def _route(known: list[bytes], buckets: int, limits: Limits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per chunk its blocks (bucket, n, data), its words (lang, word, n), and all its words (lang, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(zlib.decompress(x), np.uint8) for x in known]
        names = ["bucket", "n", "data", "lang", "word"]
        for chunk in _chunks(batches, limits):
            columns, counts, (lang, word), n = suffixes(chunk, bits, limits)
            for block in _deal(chunk.vocabulary(), list(chunk.langs), columns, counts, 2, buckets):
                yield pa.RecordBatch.from_arrays([*block.columns, *[pa.nulls(block.num_rows, pa.string())] * 2], names=names)
            langs, words = pa.array(list(chunk.langs), pa.string()), pa.array(chunk.vocabulary(), pa.binary()).cast(pa.string())
            ids, of = chunk.arrays()
            total = np.bincount(of[ids >= 0], minlength=len(langs))
            for own, own_words, own_n in ((langs.take(pa.array(lang)), words.take(pa.array(word)), n), (langs, pa.nulls(len(langs), pa.string()), total)):
                none = [pa.nulls(len(own), t) for t in (pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([none[0], pa.array(own_n, pa.int64()), none[1], own, own_words], names=names)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str], list[np.ndarray], np.ndarray]]:
    for batch in batches:
        for data in batch.column(batch.schema.get_field_index("data")):
            yield unpack_block(data.as_py())


def _again(depth: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, columns, counts in _blocks(batches):
            yield from _deal(words, langs, columns, counts, depth, buckets)

    return run


def _found(langs: list[str], words: list[bytes], rows: list[tuple[tuple[int, ...], int]]) -> pa.RecordBatch:
    phrases = pa.array([b" ".join([words[i] for i in key[1:]]) for key, _ in rows], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([langs[key[0]] for key, _ in rows], pa.string()), phrases, pa.array([len(key) - 1 for key, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], names=["lang", "phrase", "size", "n"])


def _leading(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the first ``depth`` words of a block's suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, columns, counts in _blocks(batches):
            whole = columns[depth] >= 0
            keys, sums = _summed([c[whole] for c in columns[: depth + 1]], counts[whole])
            if len(sums):
                yield _found(langs, words, list(zip(zip(*[k.tolist() for k in keys], strict=True), sums.tolist(), strict=True)))

    return run


def equal_partitions(columns: list[np.ndarray], counts: np.ndarray, least: int, shortest: int) -> list[tuple[tuple[int, ...], int]]:
    """((language, words…), count) of phrases of ``shortest`` words or more that at least ``least`` suffixes begin with.

    Multikey three-way quicksort of pointers to the rows: a partition is split by a pivot in the column of its depth into
    smaller, equal and larger; the equal part goes on with the next column. Partitions of fewer suffixes are abandoned.
    """
    out: list[tuple[tuple[int, ...], int]] = []
    stack: list[tuple[np.ndarray, int, tuple[int, ...]]] = [(np.arange(len(counts)), 0, ())]
    while stack:
        pointers, depth, before = stack.pop()
        keys = columns[depth][pointers]
        n = len(keys)
        a, b, c = int(keys[n // 4]), int(keys[n // 2]), int(keys[3 * n // 4])
        pivot = max(min(a, b), min(max(a, b), c))
        equal = keys == pivot
        own = pointers[equal]
        size = int(counts[own].sum())
        if len(own) < n:
            for part in (pointers[keys < pivot], pointers[keys > pivot]):
                if len(part) and int(counts[part].sum()) >= least:
                    stack.append((part, depth, before))
        if pivot >= 0 and size >= least:
            key = (*before, pivot)
            if depth >= shortest:
                out.append((key, size))
            if depth + 1 < len(columns):
                stack.append((own, depth + 1, key))
    return out


def _sort(least: int, shortest: int) -> Callable[[pa.Table], pa.Table]:
    def run(bucket: pa.Table) -> pa.Table:
        words: dict[bytes, int] = {}
        langs: dict[str, int] = {}
        parts, counts = [], []
        for own_words, own_langs, columns, n in _blocks(bucket.to_batches()):
            to_word = np.array([words.setdefault(w, len(words)) for w in own_words] + [-1], np.int32)
            to_lang = np.array([langs.setdefault(x, len(langs)) for x in own_langs], np.int32)
            parts.append([to_lang[columns[0]], *[to_word[c] for c in columns[1:]]])
            counts.append(n)
        rows = equal_partitions([np.concatenate(c) for c in zip(*parts, strict=True)], np.concatenate(counts), least, shortest)
        return pa.Table.from_batches([_found(list(langs), list(words), rows)])

    return run


PHRASE = "lang string, phrase string, size int, n long"


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, n) of phrases of one to ``LONGEST`` words with n of ``least`` or more, (lang, n) of all words).

    A-Z are lower-cased; the characters ``.,;:!?`` and line ends part pieces, spaces and tabs part words. Of single words
    only those are counted that the bitmap lets pass.
    """
    limits = limits or Limits()
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    known, n = bitmaps(rows, least, limits)
    held = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(held, -(-n // limits.bucket))
    routed = written(rows.mapInArrow(_route(known, buckets, limits), f"{BLOCK}, lang string, word string"), "phrase-blocks")
    totals = written(routed.filter("bucket is null and word is null").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    words = routed.filter("bucket is null and word is not null").groupBy("lang", F.col("word").alias("phrase")).agg(F.lit(1).alias("size"), F.sum("n").alias("n"))
    found = words.filter(F.col("n") >= least)
    blocks, made = routed.filter("bucket is not null").select("bucket", "n", "data"), [routed]
    for depth in range(2, LONGEST + 1):
        full, over = blocks, 0
        if depth < LONGEST:
            sizes = written(blocks.groupBy("bucket").agg(F.sum("n").alias("total")).filter(F.col("total") > limits.overfull * limits.bucket), "phrase-sizes")
            made.append(sizes)
            over = sizes.agg(F.sum("total")).first()[0] or 0
            full = blocks.join(sizes, "bucket", "left_anti") if over else blocks
        found = found.unionByName(full.groupBy("bucket").applyInArrow(_sort(least, depth), PHRASE))
        if not over:
            break
        crowded = blocks.join(sizes, "bucket", "left_semi")
        leading = crowded.mapInArrow(_leading(depth), PHRASE).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
        found = found.unionByName(leading.filter(F.col("n") >= least))
        blocks = written(crowded.mapInArrow(_again(depth + 1, max(held, -(-over // limits.bucket))), BLOCK), "phrase-blocks")
        made.append(blocks)
    found = written(found, "phrases")
    dropped(*made)
    return found, totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, limits: Limits | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language.

    ``a`` counts a phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` all words of the language; the score is
    ``SCALE * a // (l + r)``. Candidates inside a longer one with nearly as many occurrences go. Null texts have no
    words, a null language is ``und``; repeated rows count as often as they stand there, ids and other columns don't
    matter, and an empty table gives no rows. Texts are counted whole, of any length.
    """
    counted, totals = phrase_counts(docs, text, lang, least, limits)
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    phrases = counted.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("words"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    of = lambda name, n: counted.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    met = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    # Products may pass 64 bits: the division is that of decimals, exact to the whole number.
    score = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    inner = phrases.filter("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    around = inner.groupBy("lang", part(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    kept = scored.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (WITHIN[1] * exact("longer") < WITHIN[0] * exact("a")))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
