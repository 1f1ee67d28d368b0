"""Language identification with interpolated Kneser-Ney character models.

One model for each language is fitted on a bounded sample of labelled rows: Spark counts the character n-grams of the
sample, and the model is a few sorted arrays of n-gram hashes with their probabilities and back-off weights. A text gets
the language of the lowest cross-entropy per character over its whole length. A held-back part of the sample calibrates
the temperature of the score and, for each language, the cross-entropy beyond which a text is rejected.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import slices, written

ORDER = 4
#: Labelled rows of each language in the sample, on average; a fifth of them calibrates.
ROWS_PER_LANGUAGE = 1500
#: Labels that may be learned; beyond it a label column holds something else than languages.
MOST_LANGUAGES = 500
#: Characters that are scored at a time.
CHUNK = 1 << 20
#: A text is rejected if its cross-entropy exceeds its language's mean by this many deviations, or by this many nats if
#: that is more, and by a further number of nats over the square root of its length.
REJECT_DEVIATIONS, REJECT_NATS, REJECT_SHORT = 6.0, 0.8, 4.0
UNKNOWN = "und"

_SPACE, _OTHER = 0x20, 0xFFFF
_BITS = np.uint64(16)
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its own number if it is a letter or mark, else a space; beyond 16 bits letters are one."""
    if not _TABLE:
        table = np.full(sys.maxunicode + 1, _SPACE, np.uint16)
        for c in range(0x10000):
            if unicodedata.category(chr(c))[0] in "LM":
                table[c] = c
        for c in range(0x10000, 0x33000):
            if unicodedata.category(chr(c))[0] in "LM":
                table[c] = _OTHER
        _TABLE.append(table)
    return _TABLE[0]


def symbols(text: str) -> np.ndarray:
    """The text's letters in lower case; every run of other characters, and either end, is one space."""
    s = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != _SPACE) | (s[:-1] != _SPACE)
    return s[keep]


def ngrams(s: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each symbol but the first, as one 64-bit hash (16 bits a symbol); spaces come before."""
    padded = np.concatenate([np.full(order - 1, _SPACE, np.uint16), s]).astype(np.uint64)
    out = np.zeros(len(s), np.uint64)
    for k in range(order):
        out = (out << _BITS) | padded[k : k + len(s)]
    return out[1:]


def _low(grams: np.ndarray, k: int) -> np.ndarray:
    """The last ``k`` symbols of each n-gram."""
    return grams & np.uint64((1 << (16 * k)) - 1) if k < 4 else grams


@dataclass
class LanguageModel:
    """Sorted n-gram hashes of each order 1 to N with log-probabilities, and sorted contexts with log back-off weights."""

    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float

    @classmethod
    def fit(cls, grams: np.ndarray, counts: np.ndarray, n_symbols: int) -> LanguageModel:
        """From the distinct n-grams of the highest order and their counts."""
        order = np.argsort(grams)
        level, number = grams[order], counts[order].astype(np.float64)
        levels = [(level, number)]
        for k in range(ORDER - 1, 0, -1):
            level, n = np.unique(_low(level, k), return_counts=True)  # continuation counts: distinct symbols before
            levels.append((level, n.astype(np.float64)))
        levels.reverse()
        out = cls([], [], [], [], -float(np.log(n_symbols + 1)))
        lower = np.array([])
        for k, (g, n) in enumerate(levels, 1):
            context, at = np.unique(g >> _BITS, return_inverse=True)
            total, kinds = np.bincount(at, weights=n), np.bincount(at)
            once, twice = (n == 1).sum(), (n == 2).sum()
            d = float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.9))
            weight = d * kinds / total
            below = np.full(len(g), np.exp(out.floor)) if k == 1 else lower[np.searchsorted(out.grams[-1], _low(g, k - 1))]
            lower = np.maximum(n - d, 0) / total[at] + weight[at] * below
            out.grams.append(g)
            out.logp.append(np.log(lower))
            out.contexts.append(context)
            out.backoff.append(np.log(weight))
        return out

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of the last symbol of each n-gram after the others."""
        lp = np.full(len(grams), self.floor)
        for k in range(ORDER):
            g = _low(grams, k + 1)
            at, here = _find(self.contexts[k], g >> _BITS)
            lp = lp + np.where(here, self.backoff[k][at], 0.0)
            at, here = _find(self.grams[k], g)
            lp = np.where(here, self.logp[k][at], lp)
        return lp


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Identifier:
    """All languages' models, one array of the n-grams that any of them knows, and the calibration."""

    languages: list[str]
    models: list[LanguageModel]
    known: np.ndarray
    known_logp: np.ndarray
    temperature: float = 1.0
    mean: np.ndarray | None = None
    reach: np.ndarray | None = None

    @classmethod
    def of(cls, languages: list[str], models: list[LanguageModel]) -> Identifier:
        known = np.unique(np.concatenate([m.grams[-1] for m in models]))
        return cls(languages, models, known, np.stack([m.score(known) for m in models], axis=1))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, cross-entropy per character under each language) of each text."""
        n, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            for start in range(0, max(1, len(text)), CHUNK):
                g = ngrams(symbols(text[start : start + CHUNK]))
                held.append((i, g))
                size += len(g)
                if size >= CHUNK:
                    self._add(held, n, total)
                    held, size = [], 0
        self._add(held, n, total)
        return n, -total / np.maximum(n, 1)[:, None]

    def _add(self, held: list[tuple[int, np.ndarray]], n: np.ndarray, total: np.ndarray) -> None:
        held = [(i, g) for i, g in held if len(g)]
        if not held:
            return
        lengths = np.array([len(g) for _, g in held])
        distinct, which = np.unique(np.concatenate([g for _, g in held]), return_inverse=True)
        at, here = _find(self.known, distinct)
        logp = self.known_logp[at]
        if not here.all():
            logp[~here] = np.stack([m.score(distinct[~here]) for m in self.models], axis=1)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        rows = np.array([i for i, _ in held])
        np.add.at(n, rows, lengths)
        for k in range(logp.shape[1]):
            np.add.at(total[:, k], rows, np.add.reduceat(logp[:, k][which], starts))

    def calibrate(self, n: np.ndarray, entropy: np.ndarray, truth: np.ndarray) -> None:
        """The temperature with the highest likelihood of the held-back labels, and each language's usual cross-entropy."""
        self.mean, self.reach = np.full(len(self.languages), -self.models[0].floor), np.full(len(self.languages), REJECT_NATS)
        if len(truth):
            grid = np.geomspace(0.5, 200, 60)
            self.temperature = float(max(grid, key=lambda t: np.log(np.maximum(self._posterior(entropy, t)[np.arange(len(truth)), truth], 1e-12)).sum()))
        for k in range(len(self.languages)):
            if len(own := entropy[(truth == k) & (n >= 50), k]):
                self.mean[k], self.reach[k] = own.mean(), max(REJECT_NATS, REJECT_DEVIATIONS * own.std())

    @staticmethod
    def _posterior(entropy: np.ndarray, temperature: float) -> np.ndarray:
        e = np.exp(-(entropy - entropy.min(axis=1, keepdims=True)) * temperature)
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text; a text without a letter is ``UNKNOWN``."""
        n, entropy = self.entropies(texts)
        lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        best = entropy.argmin(axis=1)
        rows = np.arange(len(texts))
        limit = self.mean[best] + self.reach[best] + REJECT_SHORT / np.sqrt(np.maximum(n, 1))
        score = np.where(lettered, self._posterior(entropy, self.temperature)[rows, best], 0.0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return names, score, entropy[rows, best], ~lettered | (entropy[rows, best] > limit)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        held: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            held.setdefault(lang.as_py(), []).append(ngrams(symbols(text.as_py())))
        for lang, parts in held.items():
            grams, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows that models may learn from: CRC-32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 != 1


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Identifier | None:
    """Fit on a sample of the rows that ``learn`` allows: ``ROWS_PER_LANGUAGE`` of each language on average, all if fewer.

    Which rows are taken depends on their ids alone. Only the sample's n-gram counts reach the driver; their number is
    bounded by the sample, and the number of labels by ``MOST_LANGUAGES``: more are an error. Without labelled rows there is
    no model (None).
    """
    labelled = docs.filter(learn & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(doc_id).cast("string").alias("id"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}  # reads no texts
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels: each would be a model of its own, which every task gets")
    if not sizes:
        return None
    draw = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce("id", F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, ROWS_PER_LANGUAGE / n)))])
    chosen = labelled.filter((draw("sample:") < share[F.col("lang")]) & F.col("text").isNotNull())
    sample = written(chosen.select("lang", "text", (draw("part:") < 0.8).alias("fits")), "language-sample")
    counted = sample.filter("fits").select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names, models = [], []
    for name in sorted(counted["lang"].unique()):
        own = counted[counted["lang"] == name]
        grams = own["gram"].to_numpy().astype(np.int64).view(np.uint64)
        names.append(name)
        models.append(LanguageModel.fit(grams, own["n"].to_numpy(), len(np.unique(_low(grams, 1)))))
    if not names:
        return None
    out = Identifier.of(names, models)
    held = docs.sparkSession.sparkContext.broadcast(out)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, entropy = held.value.entropies([t.as_py() for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n, pa.int64()), pa.array(list(entropy), pa.list_(pa.float64()))], names=["lang", "n", "entropy"])

    back = sample.filter(~F.col("fits") & F.col("lang").isin(names)).select("lang", "text").mapInArrow(measure, "lang string, n long, entropy array<double>").toPandas()
    truth = np.array([names.index(x) for x in back["lang"]], np.int64)
    entropy = np.array(back["entropy"].tolist(), np.float64).reshape(-1, len(names))
    out.calibrate(back["n"].to_numpy(np.int64), entropy, truth)
    return out


def identify(docs: DataFrame, model: Identifier | None, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with four columns more: lang_pred, score (0 to 1), entropy (nats per character) and rejected.

    Texts that are null or without a letter are ``UNKNOWN`` with score 0 and rejected, and so are all texts if there is
    no model. Only the text decides. ``prefix`` goes before the new names, which must not be among those of ``docs``.
    There is no shuffle.
    """
    added = [prefix + c for c in ("lang_pred", "score", "entropy", "rejected")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    schema = ", ".join([*fields, *[f"`{c}` {k}" for c, k in zip(added, ("string", "double", "double", "boolean"), strict=True)]])
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.as_py() or "" for t in batch.column(at)]
            n = len(texts)
            names, score, entropy, out = held.value.predict(texts) if held.value and n else ([UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool))
            found = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(out, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Identifier | None, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text the model rejects; columns unchanged.

    Null and empty texts and those without a letter go, and all rows do without a model. Null ids don't matter, and
    repeated rows are judged each for itself. An empty table gives no rows.
    """
    prefix = "__language_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return identify(docs, model, text, prefix).filter(~F.col(f"{prefix}rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])
