"""Packing tokenized documents into sequences of a fixed length: best fit, then swap-based local search.

Documents are tokenized where they lie, and only the pieces' lengths and checksums travel. They are dealt at random into
groups of a bounded number of tokens and pieces, and each group is packed in one task: best fit, by size class, opens the
sequences, and local search closes them. The search takes one underfull sequence after another, the emptiest first, and
gives its pieces to fuller ones, by moves and by exchanges of one or two of its pieces for one, and moves the pieces of
whole sequences into the room of others, as long as that raises the sum of squared fills. It ends with the fewest
sequences that the tokens can fill, or when no step is left. What is underfull then, in all groups, is dealt into new
groups and searched again, until it is a single group, or until a round leaves nearly as many sequences underfull as it
was given: pieces that can't be combined (all of more than half a sequence, say) end there.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import dropped, slices, written

CAPACITY = 2048
END_ID = 0
#: Sequences' worth of tokens, and pieces, that a group has on average at most.
SEQUENCES_PER_GROUP, PIECES_PER_GROUP = 2000, 20_000
#: Sequences that a group of a later round has on average at least; they hold no more pieces than a group may have.
LEAST_SEQUENCES = 8
#: Sequences with at least this part of their room free after a round are searched again with those of other groups.
UNDERFULL = 1 / 16
#: Another round follows one that left at most this part of its sequences underfull: rounds shrink by a constant factor.
STILL_OPEN = 7 / 8
#: Texts with more characters than this are encoded by the library whose splitting needs no stack.
LONG_TEXT = 100_000

SPECIAL = "<|endoftext|>"


def byte_bpe(ranks_path: str | None = None, json_path: str | None = None) -> Callable[[str], list[int]]:
    """The encoder of the public byte-level BPE vocabulary: the ids that ``byte_bpe_50k.json`` gives.

    It runs on the same vocabulary in its form as ranks, which is several times as fast, but overflows its stack on a
    run of some 700,000 spaces; texts beyond ``LONG_TEXT`` go to the JSON form. The special token's string gets the
    special id in both.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if len(text) > LONG_TEXT:
            if not whole:
                whole.append(Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json")))
            return whole[0].encode(text, add_special_tokens=False).ids
        if SPECIAL not in text:
            return plain(text)
        ids: list[int] = []
        for k, part in enumerate(re.split(re.escape(SPECIAL), text)):
            ids += ([len(ranks)] if k else []) + plain(part)
        return ids

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, and before them what is left over."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, first if s == 0 and first else capacity) for s in starts]


def _pieces(ranks_path: str | None, capacity: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(ranks_path)
        for batch in slices(batches):
            rows, piece, start, length, crc, ids_of = [], [], [], [], [], []
            for i, text in enumerate(batch.column("__text")):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                    if with_ids:
                        ids_of.append(ids[s : s + n].astype(np.int32))
            arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids_of, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Token pieces of each row: doc_id, piece, start, length, ids_crc32 (and ids). Each document ends with ``END_ID``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(_pieces(ranks_path, capacity, with_ids), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, taken in the given order: the fullest one it fits into, else a new one."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r: some bin has room r
    bins, n = np.empty(len(lengths), np.int64), 0
    for i, x in enumerate(lengths.tolist()):
        fitting = filled >> x
        if fitting:
            room = x + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                filled ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i] = b
        if room > x:
            rooms[room - x].append(b)
            filled |= 1 << (room - x)
    return bins


class Search:
    """Local search over the bins of items; every step raises the sum of squared fills.

    A step takes from one bin, the donor, and gives to one that is at least as full: it moves an item, or exchanges one
    or two of the donor's items for a smaller one. Of the steps that fill the other bin to the last token the one that
    carries most over is taken, and without such steps the one that carries most over.
    """

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int) -> None:
        self.lengths, self.bins, self.capacity = lengths.astype(np.int64), bins.copy(), capacity
        self.fill = np.bincount(bins, weights=lengths).astype(np.int64)
        self.steps = 0

    def least(self) -> bool:
        """Whether fewer bins can't hold the tokens."""
        used = self.fill > 0
        return int((self.capacity - self.fill[used]).sum()) < self.capacity

    def step(self, donor: int) -> bool:
        """The best step of one donor; False if there is none."""
        lengths, bins, fill, capacity = self.lengths, self.bins, self.fill, self.capacity
        room = capacity - fill
        room[(fill == 0) | (fill < fill[donor])] = 0
        room[donor] = 0
        own = np.flatnonzero(bins == donor)
        sizes, counts = np.unique(lengths[own], return_counts=True)
        # By length of an item taken in exchange (0: none): the most room that a bin with such an item has.
        most, closing = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
        most[0] = room.max()
        if not most[0]:
            return False
        others = np.flatnonzero(room[bins])
        free = room[bins[others]]
        np.maximum.at(most, lengths[others], free)
        # By length given: the most room that it fills to the last token, alone or for an item taken back.
        np.maximum.at(closing, room, room)
        np.maximum.at(closing, lengths[others] + free, free)
        # Few distinct lengths fit in a bin, so all sums of two are few.
        first, second = np.triu_indices(len(sizes))
        two = (first != second) | (counts[first] > 1)
        first, second = first[two], second[two]
        given = np.concatenate([sizes, sizes[first] + sizes[second]])
        gain = closing[given]
        if not gain.any():
            reach = np.maximum.accumulate(np.where(most > 0, np.arange(capacity + 1) + most, 0))
            gain = np.maximum(given - np.searchsorted(reach, given), 0)  # the shortest item that makes room is taken back
        k = int(gain.argmax())
        moved = int(gain[k])
        if moved <= 0:
            return False
        back = int(given[k]) - moved
        chosen = [int(own[lengths[own] == x][0]) for x in ([sizes[k]] if k < len(sizes) else {sizes[first[k - len(sizes)]], sizes[second[k - len(sizes)]]})]
        if k >= len(sizes) and len(chosen) == 1:
            chosen = own[lengths[own] == lengths[chosen[0]]][:2].tolist()
        if back:
            takers = others[lengths[others] == back]
            item = int(takers[np.where(room[bins[takers]] >= moved, room[bins[takers]], capacity + 1).argmin()])
            to = int(bins[item])
            bins[item] = donor
        else:
            to = int(np.where(room >= moved, room, capacity + 1).argmin())
        bins[chosen] = to
        fill[to] += moved
        fill[donor] -= moved
        self.steps += 1
        return True

    def dissolve(self) -> bool:
        """Empties a bin, a full one too, whose items can all move into the room of others, where that raises the sum."""
        lengths, bins, fill, capacity = self.lengths, self.bins, self.fill, self.capacity
        order = np.lexsort((-lengths, bins))
        starts = np.flatnonzero(np.r_[True, bins[order][1:] != bins[order][:-1]])
        held = {int(bins[own[0]]): own for own in np.split(order, starts[1:])}
        rooms = sorted((int(capacity - fill[b]), b) for b in held if fill[b] < capacity)
        for donor in sorted(held, key=lambda b: int(lengths[held[b][0]])):
            if not rooms or lengths[held[donor][0]] > rooms[-1][0]:
                break  # its largest item fits nowhere, and so it is with all donors to come
            left, moves, rise = list(rooms), [], -int(fill[donor]) ** 2
            if fill[donor] < capacity:
                left.remove((int(capacity - fill[donor]), donor))
            for item in held[donor].tolist():
                x = int(lengths[item])
                at = bisect_left(left, (x, -1))
                if at == len(left):
                    break
                room, to = left.pop(at)
                rise += x * (2 * (capacity - room) + x)
                moves.append((item, to))
                if room > x:
                    insort(left, (room - x, to))
            if len(moves) < len(held[donor]) or rise <= 0:
                continue
            for item, to in moves:
                bins[item] = to
                fill[to] += lengths[item]
            fill[donor] = 0
            self.steps += len(moves)
            return True
        return False

    def run(self) -> np.ndarray:
        """The bins after the search; it sweeps over underfull bins, the emptiest first, until a sweep changes nothing."""
        changed = True
        while changed and not self.least():
            changed = False
            for donor in np.argsort(self.fill, kind="stable").tolist():
                while 0 < self.fill[donor] < self.capacity and self.step(donor):
                    changed = True
                if self.least():
                    return self.bins
            changed = self.dissolve() or changed
        return self.bins


def fewest(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bins of items by local search from best fit: by size class, then, if bins are left over, by falling length.

    Within a class (a power of two) the order is that of arrival, and the search has bins to close.
    """
    found: Search | None = None
    for order in (np.argsort(-np.floor(np.log2(lengths)), kind="stable"), np.argsort(-lengths, kind="stable")):
        bins = np.empty(len(lengths), np.int64)
        bins[order] = best_fit(lengths[order], capacity)
        search = Search(lengths, bins, capacity)
        search.run()
        if found is None or (search.fill > 0).sum() < (found.fill > 0).sum():
            found = search
        if found.least():
            break
    return found.bins


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """The bins of items after local search from the given ones."""
    return Search(lengths, bins, capacity).run()


# Numbers of sequences: round, group, and place in the group. 1,023 rounds fit, more than any 64-bit count of rows takes.
_ROUND, _GROUP = 1 << 53, 1 << 24


def _pack(capacity: int, nth: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = list(rows.columns)
        rows = rows.sort_values(["sequence_id", "doc_id", "piece", "ids_crc32", "length"], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins = fewest(lengths, capacity) if nth == 0 else improve(lengths, np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)[1], capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = np.empty(len(rows), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        fill = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
        out = rows.assign(sequence_id=nth * _ROUND + int(key[0]) * _GROUP + bins, offset=offset, fill=fill, piece=rows["piece"].astype("int32"), doc_id=rows["doc_id"].astype("Int64"))
        return out[names]

    return run


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Place all token pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A null or empty text is its end id alone. Only documents longer than ``capacity`` are cut. Rows with a null id and
    repeated rows are documents like others, dealt into groups each for itself. An empty table gives no rows, and other
    columns of ``docs`` don't matter. Texts of any length are encoded whole.
    """
    zero = F.lit(0).cast("long")
    left = written(pieces(docs, text, doc_id, capacity, ranks_path, with_ids).select("*", *[zero.alias(c) for c in ("sequence_id", "offset", "fill")]), "pack-pieces")
    done, nth, key, n_open = None, 0, F.xxhash64(F.monotonically_increasing_id()), None
    again = F.col("fill") <= capacity * (1 - UNDERFULL)
    while True:
        tokens, n = left.agg(F.sum("length"), F.count(F.lit(1))).first()
        by_pieces = -(-n // PIECES_PER_GROUP)
        if n_open is not None:
            by_pieces = min(by_pieces, n_open // LEAST_SEQUENCES)
        n_groups = max(1, -(-(tokens or 0) // (SEQUENCES_PER_GROUP * capacity)), by_pieces)
        placed = left.groupBy(F.pmod(key, F.lit(n_groups)).alias("group")).applyInPandas(_pack(capacity, nth), left.schema)
        if n_groups == 1:
            break
        placed = written(placed, "pack-placed")
        dropped(left)
        given, n_open = n_open, placed.filter(again & (F.col("offset") == 0)).count()
        if not n_open or (given is not None and n_open > STILL_OPEN * given):
            break
        closed, left = written(placed.filter(~again), "pack-closed"), written(placed.filter(again), "pack-open")
        dropped(placed)
        done = closed if done is None else done.unionByName(closed)
        nth, key = nth + 1, F.xxhash64("sequence_id")
    out = placed if done is None else done.unionByName(placed)
    return out.drop("fill")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_starts) from pieces packed with their ids; a sequence has ``capacity`` ids at most.

    Pieces go by their offset. An empty table gives no rows.
    """
    placed = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return placed.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["offset"]).alias("doc_starts"))
