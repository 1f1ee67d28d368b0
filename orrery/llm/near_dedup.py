"""Near-duplicate detection by a chosen-path set similarity join.

Each text is its set of word shingles and a row of minwise tokens of that set. A tree of nodes grows over the texts: a
node chooses positions among the minwise tokens, and every text in it goes to the child that its token at the chosen
position names, so similar texts stay together with the probability of their similarity at each step. Only nodes with
many texts branch further. Small nodes are compared exhaustively on the tokens, and what may be similar is confirmed on
the full sets. Independent trees repeat this until the chance of missing a pair is negligible.

Texts with the same set are one representative from the start. Links are gathered in three rounds. The first confirms,
for each small node, a spanning forest of its most similar pairs, which joins nearly all texts that belong together. Texts
of crowded nodes that it has left in several components are the crowd. The second confirms the remaining pairs of small
nodes whose ends are in different components and not both of the crowd, of pairs of the crowd a spanning forest of each
node's components, and compares the texts of each crowded node with its hub, the text that most of them resemble. The
third joins the whole crowd on the rarest shingles of the full sets: of sets that are similar enough, the prefixes in one
order of all shingles share one. A dense group of copies thus costs few confirmations for each text, and no pair that
could change a component depends on where a tree has dealt it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.scratch import dropped, fresh, slices, written
from orrery.llm.sieve import sieve
from orrery.operators.components import connected_components

WORDS, PERCENT = 5, 80
TOKENS = 128
TREES = 16
#: Tokens on the path of a root's children, and tokens that each further level adds.
FIRST, DEEPER = 2, (6, 6, 6)
#: Nodes of up to this many texts are compared; larger ones branch. After the last level they are dealt into blocks.
SMALL, BLOCK = 48, 32
#: Texts of a crowded node, about, from which the most frequent token of each position is taken.
SAMPLE = 64
#: Texts in a chunk of those that share a rare shingle; chunks are compared in twos, each as one row. Pairs compared at a time.
CHUNK, TOGETHER = 256, 8192
#: One node in this many gives its texts a second child.
BRANCH = 4
#: Pairs whose tokens agree less than this far below the threshold, in standard deviations, are not confirmed.
MARGIN = 6

_U = np.uint64
_rng = np.random.default_rng(20_240_229)
_XOR = _rng.integers(0, 1 << 32, TOKENS, np.uint32)[:, None]
_MULTIPLY = (_rng.integers(0, 1 << 31, TOKENS, np.uint32) * 2 + 1)[:, None]
_BASE = 0x9E3779B97F4A7C55
_POWERS: list[np.ndarray] = []
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 to the 64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 14, 2 * n)
        _POWERS[:] = [np.cumprod(np.array([1, *[b] * (size - 1)], np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the text, with A-Z in lower case; words are runs of other than ASCII white space."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    word = ~_IS_SPACE[b]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(b) + 1)
    sums = np.concatenate([[_U(0)], np.cumsum((b.astype(np.uint64) + _U(1)) * up[: len(b)])])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; with fewer words their whole sequence is one, without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = _mix(h * _U(0x2545F4914F6CDD1D) + w[j : len(w) - k + 1 + j])
    return np.unique(h)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The set's minwise tokens: under each of ``TOKENS`` permutations the smallest value."""
    x = (shingles >> _U(32)).astype(np.uint32)
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, ((x[at : at + 2048] ^ _XOR) * _MULTIPLY).min(axis=1), out=out)
    return out


def _features(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, keys, tokens = [], [], []
            for text in batch.column("__text"):
                s = shingle_set(text.as_py() or "", words)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                tokens.append(minwise(s).tobytes() if len(s) else None)
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_key", "tokens"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def descend(path: np.ndarray, tokens: np.ndarray, steps: int) -> np.ndarray:
    """The node that each text reaches from ``path`` after ``steps`` more tokens, at positions the nodes choose."""
    rows = np.arange(len(path))
    for _ in range(steps):
        at = (_mix(path + _U(0x632BE59BD9B4E019)) % _U(TOKENS)).astype(np.int64)
        path = _mix(path * _U(0x2545F4914F6CDD1D) + tokens[rows, at].astype(np.uint64))
    return path


_NODE = "path long, id long, component long"


def _roots(trees: range, first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _matrix(batch.column("tokens"))
            for tree in trees if len(tokens) else ():
                start = np.full(len(tokens), _mix(np.array([tree + 1], np.uint64))[0], np.uint64)
                path = pa.array(descend(start, tokens, first).view(np.int64))
                yield pa.RecordBatch.from_arrays([path, batch.column("id"), batch.column("component")], names=["path", "id", "component"])

    return run


def _children(steps: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
            tokens, others = _matrix(batch.column("tokens")), [batch.column("id"), batch.column("component")]
            if not len(path):
                continue
            names = ["path", "id", "component"]
            yield pa.RecordBatch.from_arrays([pa.array(descend(path, tokens, steps).view(np.int64)), *others], names=names)
            twice = np.flatnonzero(_mix(path) % _U(BRANCH) == 0)
            second = descend(_mix(path[twice] + _U(1)), tokens[twice], steps)
            yield pa.RecordBatch.from_arrays([pa.array(second.view(np.int64)), *[c.take(pa.array(twice)) for c in others]], names=names)

    return run


def _pairs(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the texts of each node (rows sorted by path): pairs (a, b) of different components that agree in ``least`` tokens or more.

    Of the pairs whose ends both have ``sparse`` set only those of a spanning forest of the node's components, most similar ones first.
    """

    def compare(path: np.ndarray, ids: np.ndarray, tokens: np.ndarray, component: np.ndarray, sparse: np.ndarray) -> list[tuple[int, int]]:
        first, second, agreed = [], [], []
        for d in range(1, len(path)):
            i = np.flatnonzero(path[d:] == path[:-d])
            if not len(i):
                break
            i = i[component[i] != component[i + d]]
            n = (tokens[i] == tokens[i + d]).sum(axis=1)
            near = n >= least
            first.append(i[near])
            second.append(i[near] + d)
            agreed.append(n[near])
        if not first:
            return []
        i, j, n = np.concatenate(first), np.concatenate(second), np.concatenate(agreed)
        # A node's texts of one component are one from the start: all of them stand for the first.
        order = np.lexsort((component, path))
        new = np.r_[True, (path[order][1:] != path[order][:-1]) | (component[order][1:] != component[order][:-1])]
        up = np.empty(len(path), np.int64)
        up[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        thin = sparse[i] & sparse[j]
        chosen = np.flatnonzero(~thin).tolist()
        for k in np.argsort(-n, kind="stable"):
            if thin[k] and (a := top(i[k])) != (b := top(j[k])):
                up[max(a, b)] = min(a, b)
                chosen.append(k)
        i, j = i[chosen], j[chosen]
        return list(zip(np.minimum(ids[i], ids[j]).tolist(), np.maximum(ids[i], ids[j]).tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(final: bool) -> pa.RecordBatch | None:
            """Compares what is held, but for the last node, which may go on, unless this is the end."""
            if not held:
                return None
            rows = pa.Table.from_batches(held).combine_chunks()
            path = rows.column("path").to_numpy()
            upto = len(path) if final else int(np.searchsorted(path, path[-1]))
            held[:] = rows.slice(upto).to_batches()
            if not upto:
                return None
            done = rows.slice(0, upto)
            tokens = np.frombuffer(b"".join(done.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            found = compare(path[:upto], done.column("id").to_numpy(), tokens, *(done.column(c).to_numpy(zero_copy_only=False) for c in ("component", "sparse")))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if (out := flush(False)) is not None:
                    yield out
        if (out := flush(True)) is not None:
            yield out

    return run


def _chunk_pairs(least: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the texts of two chunks (or of one, beside itself) in a row: pairs (a, b) of different components that agree in ``least`` tokens or more.

    Texts say at which place of their sets' order (``at``, from 1) the shared shingle stands: two sets that share none
    before it have at most what follows in common, and a pair that this rules out is left to the first shingle that it shares.
    """

    def opened(rows: pa.ListScalar) -> tuple[np.ndarray, ...]:
        texts = rows.values
        tokens = np.frombuffer(b"".join(texts.field("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
        return *(texts.field(c).to_numpy() for c in ("id", "at", "size", "component")), tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for alone, one, two in zip(batch.column("alone").to_pylist(), batch.column("one"), batch.column("two"), strict=True):
                id_a, at_a, size_a, component_a, tokens_a = opened(one)
                id_b, at_b, size_b, component_b, tokens_b = opened(two)
                after = np.minimum((size_a - at_a)[:, None], (size_b - at_b)[None, :])
                near = (component_a[:, None] != component_b[None, :]) & ((1 + after) * (100 + percent) >= percent * (size_a[:, None] + size_b[None, :]))
                i, j = np.nonzero(np.triu(near, 1) if alone else near)
                parts = [slice(k, k + TOGETHER) for k in range(0, len(i), TOGETHER)]
                alike = [k.start + np.flatnonzero((tokens_a[i[k]] == tokens_b[j[k]]).sum(axis=1) >= least) for k in parts]
                if alike:
                    k = np.concatenate(alike)
                    a, b = id_a[i[k]], id_b[j[k]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _overlap(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple[int, np.ndarray]] = {}

        def shingles(side: str, key: int, text: str | None) -> np.ndarray:
            if side not in last or last[side][0] != key:
                last[side] = (key, shingle_set(text or "", words))
            return last[side][1]

        for batch in slices(batches):
            common, either = [], []
            for a, b, x, y in zip(batch.column("a"), batch.column("b"), batch.column("text_a"), batch.column("text_b"), strict=True):
                s, t = shingles("a", a.as_py(), x.as_py()), shingles("b", b.as_py(), y.as_py())
                n = len(np.intersect1d(s, t, assume_unique=True))
                common.append(n)
                either.append(len(s) + len(t) - n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "common", "either"])

    return run


def small_nodes(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with 2 to about ``SMALL`` texts, for (id, tokens, component) rows.

    Returns (path, id) rows of these nodes, over all trees, and (path, id, n, level, tokens) of the nodes that had to
    branch: their texts meet their tokens once, and children, hubs and consensus all come from there.
    """

    def counted(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        return written(rows.join(sizes.filter("low < high").drop("low", "high"), "path"), "near-nodes")

    large = lambda level, k: written(level.filter(F.col("n") > SMALL).select("path", "id", "n", F.lit(k).alias("level")).join(dense, "id"), "near-crowds")
    level = counted(reps.mapInArrow(_roots(range(TREES), FIRST), _NODE))
    # Texts of nodes further down are texts of crowded ones up here.
    dense = reps.filter(sieve(level.filter(F.col("n") > SMALL).select("id"))("id"))
    parents = large(level, 0)
    found, crowded = level.filter(F.col("n") <= SMALL).select("path", "id"), parents
    for k, steps in enumerate(DEEPER, 1):
        if parents.isEmpty():
            return found, crowded.drop("component")
        level = counted(parents.select("path", "id", "tokens", "component").mapInArrow(_children(steps), _NODE).distinct())
        found = found.unionByName(level.filter(F.col("n") <= SMALL).select("path", "id"))
        parents = large(level, k)
        crowded = crowded.unionByName(parents)
    # Blocks only give the first round links early; what they part is left to the hubs and the exact join.
    block = F.pmod(F.xxhash64("path", "id"), F.ceil(F.col("n") / BLOCK))
    return found.unionByName(level.filter(F.col("n") > SMALL).select(F.xxhash64("path", block).alias("path"), "id")), crowded.drop("component")


def _consensus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, center) of (path, all: list of tokens): the most frequent token of each position."""
    for batch in batches:
        centers = []
        for rows in batch.column("all"):
            m = np.sort(np.frombuffer(b"".join(rows.as_py()), np.uint32).reshape(-1, TOKENS), axis=0)
            run = np.ones(m.shape, np.int64)
            for i in range(1, len(m)):
                run[i] = np.where(m[i] == m[i - 1], run[i - 1] + 1, 1)
            centers.append(m[run.argmax(axis=0), np.arange(TOKENS)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(centers, pa.binary())], names=["path", "center"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of tokens and center in how many positions they agree."""
    for batch in batches:
        n = (_matrix(batch.column("tokens")) == _matrix(batch.column("center"))).sum(axis=1)
        kept = [k for k in batch.schema.names if k not in ("tokens", "center")]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(n, pa.int64())], names=[*kept, "agreed"])


def hub_pairs(crowded: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of a crowded node's hub and each of its texts in another component, for (path, id, n, tokens, component) rows.

    ``reps`` are (id, tokens, component) rows. The hub agrees best with the most frequent tokens of its node.
    """
    tokens = reps.select("id", "tokens", "component")
    mixed = crowded.groupBy("path").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("path")
    rows = written(crowded.join(mixed, "path", "left_semi").select("path", "id", "n", "tokens", "component"), "near-mixed")
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("n") / SAMPLE)) == 0).groupBy("path").agg(F.collect_list("tokens").alias("all"))
    center = sample.mapInArrow(_consensus, "path long, center binary")
    near = rows.join(center, "path").select("path", "id", "tokens", "center").mapInArrow(_agreement, "path long, id long, agreed long")
    hubs = near.groupBy("path").agg(F.max(F.struct("agreed", (-F.col("id")).alias("id"))).alias("top")).select("path", (-F.col("top.id")).alias("hub"))
    hubs = hubs.join(tokens.select(F.col("id").alias("hub"), F.col("tokens").alias("center"), F.col("component").alias("own")), "hub")
    both = rows.join(hubs, "path").filter(F.col("component") != F.col("own")).select("hub", "id", "tokens", "center")
    found = both.mapInArrow(_agreement, "hub long, id long, agreed long").filter(F.col("agreed") >= least)
    return found.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()


def _shingle_rows(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("__text"), strict=True):
                s = shingle_set(text.as_py() or "", words)
                if len(s):
                    key = int(_mix(s).sum(dtype=np.uint64).view(np.int64))
                    arrays = [np.full(len(s), i), np.full(len(s), key), np.full(len(s), len(s)), s.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["id", "key", "size", "shingle"])

    return run


def prefix_chunks(texts: DataFrame, labels: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """(shingle, chunk, low, high, rows) that hold, two by two, every pair of texts of different components that can be linked.

    A set of n shingles overlaps with any that it is linked with in at least ``percent`` of n, so in one order of all
    shingles, rarest first, the prefixes that leave out one shingle less than that share one. Texts that share a
    shingle are sorted by component and cut into chunks, from ``low`` to ``high`` component. A chunk's ``rows`` are
    (id, at, size, component, tokens): ``at`` is the shingle's place in the order of the text's set, which has ``size`` of them.
    Each text stands once for each shingle of its prefix, however many others share it.
    """
    rows = written(texts.mapInArrow(_shingle_rows(words), "id long, key long, size long, shingle long").distinct(), "near-shingles")
    # Shingles of one text alone come first in the order and are only counted.
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = Window.partitionBy("id", "key")
    ranked = rows.join(often, "shingle").withColumn("shared", F.count(F.lit(1)).over(own)).withColumn("at", F.row_number().over(own.orderBy("n", "shingle")))
    prefix = F.col("size") - F.floor((percent * F.col("size") + 99) / 100) + 1
    placed = ranked.withColumn("at", F.col("size") - F.col("shared") + F.col("at"))
    kept = placed.filter(F.col("at") <= prefix).select("shingle", "id", "at", "size").join(labels, "id")
    kept = written(kept, "near-prefixes")
    mixed = kept.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("shingle")
    order = Window.partitionBy("shingle").orderBy("component", "id")
    dealt = kept.join(mixed, "shingle", "left_semi").withColumn("chunk", F.floor((F.row_number().over(order) - 1) / CHUNK))
    row = F.struct("id", "at", "size", "component", "tokens")
    packed = dealt.join(reps.select("id", "tokens"), "id").groupBy("shingle", "chunk")
    return written(packed.agg(F.min("component").alias("low"), F.max("component").alias("high"), F.collect_list(row).alias("rows")), "near-chunks")


def chunk_twos(chunks: DataFrame) -> DataFrame:
    """(alone, one, two) for chunks of a shingle that hold several components: the rows of two of them, or of one beside itself (``alone``)."""
    ends = chunks.select("shingle", "chunk", "low", "high")
    other = ends.select(F.col("shingle").alias("s"), F.col("chunk").alias("other"), F.col("low").alias("l"), F.col("high").alias("h"))
    met = ends.join(other, (F.col("shingle") == F.col("s")) & (F.col("chunk") <= F.col("other"))).filter(F.least("low", "l") < F.greatest("high", "h"))
    rows = lambda chunk, name: chunks.select("shingle", F.col("chunk").alias(chunk), F.col("rows").alias(name))
    both = met.select("shingle", "chunk", "other").join(rows("chunk", "one"), ["shingle", "chunk"]).join(rows("other", "two"), ["shingle", "other"])
    return both.select((F.col("chunk") == F.col("other")).alias("alone"), "one", "two")


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Classes of near-duplicates: doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Two texts are linked if their shingle sets have 100 * intersection >= percent * union; ``component_id`` is the
    smallest id that links reach and ``kept`` says that it is the row's own.

    Texts that are null, empty or without words have no shingles and are linked with nothing. Rows with the same id are
    one document. Rows with a null id are linked with nothing, keep a null ``component_id`` and are kept. Repeated
    rows give repeated rows, an empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    features = written(rows.mapInArrow(_features(words), "doc_id long, n_shingles long, set_key binary, tokens binary"), "near-features")
    linkable = features.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    sets = written(linkable.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "near-sets")
    # A set that stands once is its own representative; only rows of the others look for theirs.
    again = sieve(sets.filter("n > 1").select("set_key"))
    shared, own_sets = sets.filter(again("set_key")).select(F.col("set_key").alias("k"), "id"), linkable.select(F.col("doc_id"), F.col("set_key"), "tokens")
    chosen = own_sets.filter(again("set_key")).join(shared, (F.col("doc_id") == F.col("id")) & (F.col("set_key") == F.col("k"))).select("id", "tokens")
    reps = written(own_sets.filter(~again("set_key")).select(F.col("doc_id").alias("id"), "tokens").unionByName(chosen), "near-reps")

    share = percent / 100
    least = int(np.floor(TOKENS * share - MARGIN * np.sqrt(TOKENS * share * (1 - share))))
    nodes, crowded = small_nodes(reps.withColumn("component", F.col("id")))
    dense = written(crowded.filter("level = 0").select("id", "tokens").distinct(), "near-dense")
    compared = written(nodes.join(reps.filter(sieve(nodes.select("id"))("id")), "id"), "near-compared")

    def pairs(labelled: DataFrame) -> DataFrame:
        together = labelled.select("path", "id", "tokens", "component", "sparse").repartition("path").sortWithinPartitions("path", "id")
        return written(together.mapInArrow(_pairs(least), "a long, b long").distinct(), "near-pairs")

    candidates = pairs(compared.withColumns({"component": F.col("id"), "sparse": F.lit(True)}))
    ends = lambda found: found.select(F.explode(F.array("a", "b")).alias("id"))
    texts = written(rows.filter(sieve(ends(candidates).unionByName(dense.select("id")))("doc_id")), "near-texts")

    def links(found: DataFrame, near: DataFrame) -> DataFrame:
        left, right = (near.select(F.col("doc_id").alias(k), F.col("__text").alias(f"text_{k}")) for k in ("a", "b"))
        both = found.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        measured = both.mapInArrow(_overlap(words), "a long, b long, common long, either long")
        return written(measured.filter(100 * F.col("common") >= percent * F.col("either")), "near-links")

    def joined_by(found: DataFrame, label: DataFrame) -> DataFrame:
        """(id, label) after the links ``found`` have joined components of ``label``, which are the vertices here."""
        of = lambda k: label.select(F.col("id").alias(k), F.col("label").alias(f"label_{k}"))
        bridges = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("label_a", "a").alias("src"), F.coalesce("label_b", "b").alias("dst"))
        after = connected_components(bridges).select(F.col("vertex").alias("label"), F.col("component").alias("final"))
        # Ends that had no label yet are labelled by themselves.
        known = label.unionByName(after.select(F.col("label").alias("id"), "label")).groupBy("id").agg(F.min("label").alias("label"))
        return written(known.join(after, "label", "left").select("id", F.coalesce("final", "label").alias("label")), "near-labels")

    first = connected_components(links(candidates, texts), "a", "b")
    label = first.select(F.col("vertex").alias("id"), F.col("component").alias("label"))
    with_label = lambda df: df.join(label, "id", "left").withColumn("component", F.coalesce("label", "id")).drop("label")
    several = lambda nodes: nodes.groupBy("path").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("path")
    roots = with_label(crowded.filter("level = 0").select("path", "id"))
    crowd = written(roots.join(several(roots), "path", "left_semi").select("id").distinct(), "near-crowd")
    some_crowded = not crowd.isEmpty()
    marked = compared.join(crowd.withColumn("sparse", F.lit(True)), "id", "left").withColumn("sparse", F.coalesce("sparse", F.lit(False)))
    mixed = written(several(with_label(compared.select("path", "id"))), "near-mixed")
    more = pairs(with_label(marked.filter(sieve(mixed)("path"))).join(mixed, "path", "left_semi"))
    if some_crowded:
        more = more.unionByName(hub_pairs(with_label(crowded), with_label(dense), least)).distinct()
    more = written(more.join(candidates, ["a", "b"], "left_anti"), "near-pairs")
    met = lambda found: texts.filter(sieve(ends(found))("doc_id"))
    label = joined_by(links(more, met(more)), label)
    if some_crowded:
        # A pair that no small node has held was together in a crowded one from the start, if in any. Its ends and those of
        # pairs of the crowd that the second round has left out are here, in different components or joined already.
        left = written(with_label(crowd), "near-left")
        own = texts.join(left, F.col("doc_id") == F.col("id"), "left_semi")
        twos = chunk_twos(prefix_chunks(own, left, dense, words, percent))
        exact = written(twos.mapInArrow(_chunk_pairs(least, percent), "a long, b long").distinct(), "near-pairs")
        label = joined_by(links(exact, met(exact)), label)
    dropped(reps, compared, candidates, texts)
    classes = sets.join(label, "id", "left").select(F.col("set_key").alias("k"), F.coalesce("label", "id").alias("class"))
    joined = features.select("doc_id", "n_shingles", "set_key").join(classes, F.col("set_key") == F.col("k"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each class of near-duplicates, the one with the smallest id; columns unchanged.

    Texts without words, null ones too, and rows with a null id stay. Rows that repeat a kept id stay with it: equal
    texts are the matter of exact deduplication. An empty table gives no rows; other columns don't matter.
    """
    (lost_id,) = fresh(docs.columns, "__lost_id")
    lost = components(docs, text, doc_id, words, percent).filter(~F.col("kept")).select(F.col("doc_id").alias(lost_id)).distinct()
    return docs.join(lost, F.col(doc_id).cast("long") == F.col(lost_id), "left_anti")
