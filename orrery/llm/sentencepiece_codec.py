"""SentencePiece encoding and decoding by a Viterbi pass that words with a common prefix share.

A text is normalised as its model says (a space is marked, and one mark is put in front) and cut into marked words, which
no piece crosses. The distinct words of a batch are sorted, so that neighbours share prefixes as in a depth-first walk
through their trie, and the forward table of a word is kept as far as the next word agrees with it.

The forward table holds, for each position, the best last piece: the one that gives the highest score of all pieces that
end there and may follow the best piece before. In unigram models any piece may follow any other. In BPE models two
pieces may stand side by side only if merging them from characters leaves exactly these two; with that rule one path
alone survives, and it is the one that the merges produce. Characters without a piece fall back to their bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import slices

MARK = "▁"
#: Bytes of the words and ids that a task remembers between batches; when there are more it starts anew.
REMEMBERED = 256 << 20
#: Bytes of a remembered word beside its characters and ids.
ENTRY = 200
_WORDS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


class Vocabulary:
    """Pieces with ids and scores, the ids of single bytes, and whether pieces come from merges (BPE)."""

    def __init__(self, ids: dict[str, int], scores: dict[str, float], byte_ids: list[int], merges: bool) -> None:
        self.ids, self.scores, self.byte_ids, self.merges = ids, scores, byte_ids, merges
        self.halves: dict[str, tuple[str, str]] = {}
        self.matches = ahocorasick.Automaton()
        for piece, score in scores.items():
            if not merges or self.merged(piece) == [piece]:  # a piece that merges never produce isn't used
                self.matches.add_word(piece, (piece, len(piece), score, {}))
        self.matches.make_automaton()
        self.longest = max(map(len, scores), default=1)

    @classmethod
    def load(cls, path: str, merges: bool = True) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in plain}
        return cls(pieces, {p: model.get_score(i) for p, i in pieces.items()}, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], merges)

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """BPE from single characters: again and again the best-scored pair of neighbours, the leftmost of equals."""
        parts = list(text)
        while len(parts) > down_to:
            best = max(((self.scores[parts[k] + parts[k + 1]], -k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.scores), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _halves(self, piece: str) -> tuple[str, str]:
        """The two parts that the last merge of a piece joins."""
        if (known := self.halves.get(piece)) is None:
            known = self.halves[piece] = tuple(self.merged(piece, 2))
        return known

    def may_follow(self, before: str, piece: str) -> bool:
        """Whether merging leaves the two apart: undoing their merges, latest first, no pair across the border is due."""
        if not self.merges:
            return True
        when = lambda p: -self.scores[p] if len(p) > 1 else -1.0  # noqa: E731  a piece's turn; characters are there from the start
        limit = float("inf")
        while True:
            across = self.scores.get(before + piece)
            if across is not None and -across < limit:
                return False
            a, b = when(before), when(piece)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, before = a, self._halves(before)[1]
            else:  # of equal turns the left one is taken first, so a pair across comes before the right piece
                limit, piece = b + 0.5, self._halves(piece)[0]


#: A character without a piece costs more than any piece.
_UNKNOWN_SCORE = -1e9


def encode_words(words: list[str], vocabulary: Vocabulary) -> dict[str, list[str]]:
    """The pieces of each distinct word, from one walk through the words in sorted order."""
    matches, may_follow, merges = vocabulary.matches.iter, vocabulary.may_follow, vocabulary.merges
    out: dict[str, list[str]] = {}
    # At each position: the best last piece, the best path's score, and whether a piece of the vocabulary ends there.
    previous, lasts, upto, found = "", [""], [0.0], [True]
    for word in sorted(words):
        shared = min(len(previous), len(word))
        while previous[:shared] != word[:shared]:
            shared -= 1
        del lasts[shared + 1 :], upto[shared + 1 :], found[shared + 1 :]
        unset, settled = shared + 1, shared
        # What ends beyond the shared prefix begins less than the longest piece before: the rest isn't walked again.
        for at, (piece, size, score, follows) in matches(word, max(0, shared + 1 - vocabulary.longest)):
            if at < settled:
                continue
            while unset <= at + 1:  # a position that no piece reaches ends a character without a piece
                lasts.append(word[unset - 1])
                upto.append(upto[-1] + _UNKNOWN_SCORE)
                found.append(False)
                unset += 1
            start = at + 1 - size
            if start:
                before = lasts[start]
                fits = follows.get(before)
                if fits is None:
                    fits = follows[before] = may_follow(before, piece)
                if not fits:
                    continue
            total = upto[start] + score
            if not found[-1] or total > upto[-1]:
                lasts[-1], upto[-1], found[-1] = piece, total, True
                if merges:  # no other piece can end here
                    settled = at + 1
        while unset <= len(word):
            lasts.append(word[unset - 1])
            upto.append(upto[-1] + _UNKNOWN_SCORE)
            found.append(False)
            unset += 1
        end, pieces = len(word), []
        while end:
            pieces.append(lasts[end])
            end -= len(lasts[end])
        out[word] = pieces[::-1]
        previous = word
    return out


class Encoder:
    """Encodes texts to ids, as little-endian unsigned 32-bit numbers in bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.known, self.held = vocabulary, {}, 0
        self.packed = {p: i.to_bytes(4, "little") for p, i in vocabulary.ids.items()}

    def _ids(self, pieces: list[str]) -> bytes:
        v, packed = self.vocabulary, self.packed
        try:
            return b"".join([packed[p] for p in pieces])
        except KeyError:
            return b"".join([packed[p] if p in packed else b"".join(v.byte_ids[b].to_bytes(4, "little") for b in p.encode("utf-8", "surrogatepass")) for p in pieces])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        fresh = {w for words in split for w in words} - self.known.keys()
        coded = {w: self._ids(p) for w, p in encode_words(list(fresh), self.vocabulary).items()}
        self.held += sum(4 * len(w) + len(ids) + ENTRY for w, ids in coded.items())  # a character takes four bytes at most
        self.known |= coded
        known = self.known
        return [b"".join([known[w] for w in words]) for words in split]


class Decoder:
    """Decodes ids to texts: byte ids become their bytes, marks become spaces, and the mark put in front goes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.bytes_of = {i: p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p, i in vocabulary.ids.items()} | {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}

    def decode(self, ids: list[int]) -> str:
        of = self.bytes_of
        text = b"".join([of.get(i, b"") for i in ids]).decode("utf-8", "replace")
        return text.removeprefix(" ")


#: Encoder and decoder by model path: a Python worker serves many tasks.
_LOADED: dict[str, tuple[Encoder, Decoder]] = {}


def codec(model_path: str) -> tuple[Encoder, Decoder]:
    if model_path not in _LOADED:
        vocabulary = Vocabulary.load(model_path)
        _LOADED[model_path] = Encoder(vocabulary), Decoder(vocabulary)
    return _LOADED[model_path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _run(model_path: str | None, out: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(model_path or default_model())
        for batch in slices(batches):
            if out == "text":
                values = [decoder.decode(ids.as_py()) if ids.is_valid else None for ids in batch.column("ids")]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string())], schema=schema)
                continue
            texts = [t.as_py() or "" for t in batch.column("__text")]
            encoded = encoder.encode_all(texts)
            if out == "ids":
                offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in encoded])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])
                continue
            back = [decoder.decode(np.frombuffer(b, "<u4").tolist()) for b in encoded]
            columns = [
                pa.array([len(b) // 4 for b in encoded], pa.int64()),
                pa.array([zlib.crc32(b) for b in encoded], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    return run


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model_path: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row. A null or empty text has no ids.

    Repeated rows give repeated rows, a null id stays null, an empty table gives no rows, and other columns don't matter.
    Texts are encoded whole where they lie, without a shuffle.
    """
    return _rows(docs, text, doc_id).mapInArrow(_run(model_path, "ids", pa.schema([])), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) of each (doc_id, ids) row; null ids give a null text, ids outside the vocabulary nothing.

    Repeated rows, null doc_ids, empty tables and other columns are as with ``encode``.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    return encoded.select("doc_id", "ids").mapInArrow(_run(model_path, "text", schema), "doc_id long, text string")


def round_trip(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model_path: str | None = None) -> DataFrame:
    """Each row encoded and decoded again: doc_id, n_ids, ids_crc32 (ids as unsigned 32-bit), decoded_sha256, restored.

    ``restored`` says that the text came back; only texts that hold the mark itself don't (it comes back as a space). A null
    text counts as empty; repeated rows, null doc_ids, empty tables and other columns are as with ``encode``.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("restored", pa.bool_())])
    return _rows(docs, text, doc_id).mapInArrow(_run(model_path, "digest", schema), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, restored boolean")
