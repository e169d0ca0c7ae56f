"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Words are a text's lower-cased, space-separated strings; a shingle is five neighbouring words (all of them, if fewer),
weighted by its count times the mean inverse document frequency of its words. Document frequencies are those of each
word, by its 64-bit hash, over all documents, each counted exactly; a word in fewer than P / COMMON documents, P being the
different words of documents in all, weighs as one in so many. So fewer than COMMON words can weigh otherwise, whatever
the corpus, and tasks receive these; in a corpus of fewer pairs than COMMON that is all words. Each of
``BANDS * ROWS`` hashes draws one shingle with probability in proportion to its weight, alike in every document;
documents that agree on all rows of a band share a bucket. Texts of equal words are one class before that.

A pair that shares a bucket is a candidate when at least half of its draws agree too: of a pair at the threshold of 0.8
28.8 of 36 do, and fewer than 18 in 2 of 100,000 cases. A bucket's members are first compared with its smallest member.
What remains unlinked in a bucket after that is held against all the bucket's members in blocks, each in a task of its
own, first by draws alone; texts are fetched for members with a candidate left. So no pair of a bucket is left out and
none is written down. Links are pairs of weighted Jaccard similarity of at least ``threshold``, computed from the whole
texts; groups are their connected components.

Texts without words (null, empty, blank) are copies of each other, a very long text is a document like others. Each row
is returned; rows with equal ids are judged by their texts, ties of id go by the text's hash; an empty table gives none;
other columns aren't read.
"""

from __future__ import annotations

import functools
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, carried, components, mix, partitions, restored, texts
from .simhash import Words

BANDS, ROWS, SIZE, THRESHOLD, BLOCK, AGREE = 12, 3, 5, 0.8, 256, 0.5
SLOTS, COMMON = 1 << 16, 1 << 17
_SLOT = np.uint64(SLOTS - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Frequencies:
    """Inverse document frequencies, ln(1 + total / (1 + df)), of word hashes; ``least`` is the smallest df that counts."""

    def __init__(self, total: int, words: np.ndarray, counts: np.ndarray, least: int):
        order = np.argsort(words)
        of = lambda df: np.log1p(total / (1 + df)).astype(np.float32)
        self.rare, self.words, self.common = of(np.float64(least)), words[order], of(counts[order].astype(np.float64))

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), self.rare)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.common[at], self.rare)


def shingles(words: np.ndarray, idf: Frequencies) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of the word hashes, sorted, and their weights."""
    if not len(words):
        return words, np.zeros(0, np.float32)
    size = min(SIZE, len(words))
    n = len(words) - size + 1
    weights = idf(words)
    name, weight = words[:n].copy(), weights[:n].copy()
    for k in range(1, size):
        name = name * _STEP + words[k : n + k]
        name ^= name >> np.uint64(31)
        weight += weights[k : n + k]
    names, at, counts = np.unique(name, return_index=True, return_counts=True)
    return names, (weight[at] * counts / size).astype(np.float32)


@functools.lru_cache(1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of r and ln c (Gamma(2, 1) each) and beta (uniform), looked up by 16 bits of a shingle's hash."""
    rng = np.random.default_rng(9)
    return rng.gamma(2, 1, SLOTS).astype(np.float32), np.log(rng.gamma(2, 1, SLOTS)).astype(np.float32), rng.random(SLOTS).astype(np.float32)


def bands(names: np.ndarray, weights: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key for each band, and 16 bits of each draw."""
    gamma, log_c, beta = _draws()
    odd = mix(np.arange(1, n_bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    x = names[None, :] * odd[:, None]
    x ^= x >> np.uint64(29)
    x *= _STEP
    r = gamma[(x >> np.uint64(48)).astype(np.uint16)]
    shift = beta[((x >> np.uint64(32)) & _SLOT).astype(np.uint16)]
    t = np.floor(np.log(weights)[None, :] / r + shift)
    drawn = np.argmin(log_c[((x >> np.uint64(16)) & _SLOT).astype(np.uint16)] - r * (t - shift + 1), axis=1)
    steps = t[np.arange(len(odd)), drawn].astype(np.int64).view(np.uint64)
    sign = mix(names[drawn] + steps * _STEP).reshape(n_bands, rows)
    out = np.zeros(n_bands, np.uint64)
    for k in range(rows):
        out = mix(out * _STEP + sign[:, k])
    return out, (sign.reshape(-1) >> np.uint64(48)).astype(np.uint16)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted shingle lists."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    shared = float(np.minimum(a[1][at[same]], b[1][same]).sum(dtype=np.float64))
    return shared / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - shared)


def word_counts(docs: DataFrame) -> DataFrame:
    """w (hash), n (how many documents hold it) of each word."""

    def run(batches):
        words = Words()
        for batch in batches:
            each = [np.unique(words.of(t.lower())) for t in texts(batch.column("text"))]
            found, n = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["w", "n"])

    return docs.select("text").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def document_frequencies(docs: DataFrame, scratch: Scratch | None = None) -> Frequencies:
    """Frequencies with the table of the most frequent words, of fewer than COMMON (all of them, in a small corpus)."""
    scratch = scratch or Scratch(docs.sparkSession)
    counts = scratch.keep(word_counts(docs), "frequencies")
    least = (counts.agg(F.sum("n")).first()[0] or 0) // COMMON + 1
    table = counts.where(F.col("n") >= least).toArrow()
    scratch.drop(counts)
    return Frequencies(docs.count(), table["w"].to_numpy().view(np.uint64), table["n"].to_numpy(), least)


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.hash("text").alias("th"), "text")


def _signatures(docs: DataFrame, idf: Frequencies, n_bands: int, rows: int) -> DataFrame:
    """k, th, class (a name of the words), bands, draws of each document; bands and draws are null without words."""

    def run(batches):
        words = Words()
        for batch in batches:
            names, keys, draws = [], [], []
            for text in texts(batch.column("text")):
                hashes = words.of(text.lower())
                names.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                key, draw = bands(*shingles(hashes, idf), n_bands, rows) if len(hashes) else (None, None)
                keys.append(None if key is None else key.view(np.int64))
                draws.append(None if key is None else draw.tobytes())
            cols = [pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(draws, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("th"), *cols], ["k", "th", "class", "bands", "draws"])

    return _keyed(docs).select("k", "th", "text").mapInArrow(run, "k long, th int, class binary, bands array<long>, draws binary")


class _Shingled:
    """Shingles by class, the latest ones kept."""

    def __init__(self, idf: Frequencies, most: int = 64):
        self.idf, self.words, self.most, self.kept = idf, Words(), most, OrderedDict()

    def __call__(self, name: bytes, text: str | None):
        if name in self.kept:
            self.kept.move_to_end(name)
        else:
            self.kept[name] = shingles(self.words.of((text or "").lower()), self.idf)
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return self.kept[name]


def _verify(edges: DataFrame, payload: DataFrame, idf: Frequencies, threshold: float) -> DataFrame:
    """The edges (a, b) whose texts are similar; b has many edges, a few."""

    def run(batches):
        of = _Shingled(idf)
        for batch in batches:
            sides = (batch.column(c).to_pylist() for c in ("a", "ta", "b", "tb"))
            hit = [jaccard(of(p, x), of(q, y)) >= threshold for p, x, q, y in zip(*sides)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    left, right = (payload.select(F.col("class").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return edges.join(left, "a").join(right, "b").select("a", "ta", "b", "tb").mapInArrow(run, "a binary, b binary")


def _fixed(column: pa.Array, kind) -> np.ndarray:
    """A binary column whose values are all of one length, a row each."""
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, kind).reshape(len(column), -1)


def _agreeing(near: DataFrame, least: float) -> DataFrame:
    """The edges (a, b) among rows with draws (x, y) of which at least ``least`` agree."""

    def run(batches):
        for batch in batches:
            if len(batch):
                x, y = _fixed(batch.column("x"), np.uint16), _fixed(batch.column("y"), np.uint16)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    return near.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary").distinct()


_CELL = ["band", "key", "i", "j"]


def _cells(batches):
    """Record batches that end where a cell ends, and the ends of their cells."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        at = np.stack([held.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _CELL])
        turns = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
        if len(turns):
            yield held.slice(0, turns[-1]), turns.tolist()
            held = held.slice(turns[-1])
    if held is not None:
        yield held, [len(held)]


def _candidates(draws: np.ndarray, parts: np.ndarray, n_all: int, least: float) -> np.ndarray:
    """Whether row n_all + p (of a cell's rest) and row q (of all) agree in ``least`` of their draws and are in different parts."""
    some, every = draws[n_all:], draws[:n_all]
    same = np.zeros((len(some), n_all), np.int16)
    for k in range(draws.shape[1]):
        same += some[:, k, None] == every[None, :, k]
    apart = (parts[n_all:, None, :] != parts[None, :n_all, :]).any(axis=2)
    return apart & (same >= least * draws.shape[1])


def _blocks(buckets: DataFrame, parts: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """band, key, i, j, side, class, part: what isn't in its bucket's main component (side 1) beside all of the bucket (side 0),
    a block of each in a cell."""
    cell = ["band", "key"]
    named = buckets.join(parts, F.col("class") == F.col("node"), "left").select(*cell, "class", "draws", F.coalesce("component", "class").alias("part"))
    named = scratch.keep(named, "members")
    split = named.groupBy(*cell).agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.min_by("part", "class").alias("main"), F.count("*").alias("n"))
    split = scratch.keep(split.where("p0 <> p1").select(*cell, "main", F.ceil(F.col("n") / block).cast("int").alias("n_all")), "split")
    rest = named.join(split, cell).where("part <> main")
    blocks = scratch.keep(rest.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("n_rest")), "blocks")
    # written first: the joins' both sides are plain shuffles, so that Spark can split a bucket of very many rows
    sizes = scratch.keep(split.join(blocks, cell), "sizes")
    named = named.join(sizes, cell)
    own = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    until = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = [*cell, "class", "draws", "part"]
    return named.select(*cols, F.lit(0).alias("side"), own("n_all").alias("i"), until("n_rest").alias("j")).unionByName(
        named.where("part <> main").select(*cols, F.lit(1).alias("side"), own("n_rest").alias("j"), until("n_all").alias("i"))
    )


def _rest(
    buckets: DataFrame, parts: DataFrame, payload: DataFrame, idf: Frequencies, threshold: float, block: int, least: float, scratch: Scratch
) -> DataFrame:
    """Links (a, b) between parts that have members in one bucket."""
    n = partitions(scratch.spark)
    in_order = lambda df: df.repartition(n, *_CELL).sortWithinPartitions(*_CELL, "side", "class")

    def survivors(batches):
        for rows, ends in _cells(batches):
            draws, part, side = _fixed(rows.column("draws"), np.uint16), _fixed(rows.column("part"), np.uint64), rows.column("side").to_numpy()
            kept = np.zeros(len(rows), bool)
            for lo, hi in zip([0, *ends], ends):
                n_all = int((side[lo:hi] == 0).sum())
                hit = _candidates(draws[lo:hi], part[lo:hi], n_all, least)
                kept[lo:hi] = np.concatenate([hit.any(axis=0), hit.any(axis=1)])
            yield rows.filter(pa.array(kept))

    cells = in_order(_blocks(buckets, parts, block, scratch)).select(*_CELL, "side", "class", "part", "draws")
    left = scratch.keep(cells.mapInArrow(survivors, "band int, key long, i int, j int, side int, class binary, part binary, draws binary"), "survivors")

    def compare(batches):
        of = _Shingled(idf, 4 * block)
        for rows, ends in _cells(batches):
            draws, part, side = _fixed(rows.column("draws"), np.uint16), _fixed(rows.column("part"), np.uint64), rows.column("side").to_numpy()
            names, own, text = (rows.column(c) for c in ("class", "part", "text"))
            get = lambda r: of(names[r].as_py(), text[r].as_py())
            out = []
            for lo, hi in zip([0, *ends], ends):
                n_all, root = int((side[lo:hi] == 0).sum()), {}

                def find(x):
                    while root.setdefault(x, x) != x:
                        x = root[x]
                    return x

                for p, q in np.argwhere(_candidates(draws[lo:hi], part[lo:hi], n_all, least)).tolist():
                    p, q = lo + n_all + p, lo + q
                    a, b = own[p].as_py(), own[q].as_py()
                    if find(a) != find(b) and jaccard(get(p), get(q)) >= threshold:
                        root[find(a)] = find(b)
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    joined = in_order(left.join(payload, "class")).select(*_CELL, "side", "class", "part", "draws", "text")
    return joined.mapInArrow(compare, "a binary, b binary").distinct()


def groups(
    docs: DataFrame, threshold: float = THRESHOLD, n_bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, least: float = AGREE, scratch: Scratch | None = None
) -> DataFrame:
    """k, th (a document's id and text hash), first (the smallest k and th of its group) for each row."""
    scratch = scratch or Scratch(docs.sparkSession)
    idf = document_frequencies(docs, scratch)
    signed = scratch.keep(_signatures(docs, idf, n_bands, rows), "signatures")
    classes = signed.groupBy("class").agg(F.min(F.struct("k", "th")).alias("rep"), F.first("bands").alias("bands"), F.first("draws").alias("draws"))
    entries = classes.where("bands is not null").select("class", "rep", "draws", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("band", "key").agg(F.count("*").alias("n"), F.min(F.struct("class", "draws")).alias("first")).where("n > 1").drop("n")
    shared = scratch.keep(shared, "shared")  # written first, so that Spark can split a hot bucket in the join
    buckets = scratch.keep(entries.join(shared, ["band", "key"]).select("band", "key", "class", "rep", "draws", "first"), "buckets")
    scratch.drop(shared)
    near = buckets.where("class <> first.class").select(F.col("class").alias("a"), F.col("first.class").alias("b"), F.col("draws").alias("x"), F.col("first.draws").alias("y"))
    edges = _agreeing(near, least)
    wanted = buckets.groupBy("class").agg(F.first("rep").alias("rep")).select("class", "rep.k", "rep.th")
    payload = _keyed(docs).drop("doc_id").join(wanted.hint("shuffle_hash"), ["k", "th"]).select("class", "text").dropDuplicates(["class"])
    payload = scratch.keep(payload, "texts")
    parts = scratch.keep(components(scratch, scratch.keep(_verify(edges, payload, idf, threshold), "links")), "parts")
    more = scratch.keep(_rest(buckets.drop("rep", "first"), parts, payload, idf, threshold, block, least, scratch), "more")
    scratch.drop(payload)
    joined = components(scratch, more).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    named = signed.join(parts.withColumnRenamed("node", "class"), "class", "left").select("k", "th", F.coalesce("component", "class").alias("part"))
    named = named.join(joined, "part", "left").select("k", "th", F.coalesce("whole", "part").alias("part"))
    named = scratch.keep(named, "named")
    lowest = scratch.keep(named.groupBy("part").agg(F.min(F.struct("k", "th")).alias("first")), "lowest")
    return named.join(lowest, "part").select("k", "th", "first")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, class_id (smallest id of its group; null counts as smallest), kept (is the group's first) of each row."""
    found = groups(docs, threshold, **options)
    own, low = (F.when(F.col(c) != -(1 << 63), F.col(c)) for c in ("k", "first.k"))
    return found.select(own.alias("doc_id"), low.alias("class_id"), (F.struct("k", "th") == F.col("first")).alias("kept"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that are first of their group, repeated rows once."""
    packed, rest = carried(docs)
    firsts = groups(packed, threshold, **options).where(F.struct("k", "th") == F.col("first")).select("k", "th").distinct()
    kept = _keyed(packed, rest).join(firsts.hint("shuffle_hash"), ["k", "th"]).dropDuplicates(["k", "th"])
    return restored(kept, docs)
