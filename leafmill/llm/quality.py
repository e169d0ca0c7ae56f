"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words that cover its whole text. Each passage becomes a vector of word
statistics (letter case, digits, signs, lengths, repetition within the document, hashed words). A layer encodes it, a
gated attention weighs the passages of a bag, and the weighted sum of encodings is scored. Only documents' labels are
used: the attention learns which passages decide.

The model is fitted on at most about ``sample`` labelled documents, chosen by a hash of their ids; every passage of these
is encoded, as every passage is in scoring. Inputs of a score are the text alone.

Very long texts are read a few passages at a time, repeated rows get equal scores, an empty table gives none. Null and
empty texts are a bag of one empty passage and get a score like any other. Rows are independent; a label that
is null is none; of several labels of an id the larger counts. Without any label each score is 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, carried, restored, texts

PASSAGE, HASHED, SAMPLE, THRESHOLD = 64, 32, 6000, 0.3
#: Bytes of passages that the driver holds at a time while it fits.
PART = 64 << 20
SIGNS = ".,!?;:|#$%&*<>{}[]()\"'-_/\\@+="
_BASIC = 9
WIDTH = _BASIC + len(SIGNS) + HASHED + 7


def _signs_table() -> np.ndarray:
    """Letter, capital, digit and each sign, by code point; what lies past the table counts as a letter."""
    table = np.zeros((0x3001, 3 + len(SIGNS)), np.float32)
    for code in range(0x3000):
        c = chr(code)
        table[code, :3] = c.isalpha(), c.isupper(), c.isdigit()
        if c in SIGNS:
            table[code, 3 + SIGNS.index(c)] = 1
    table[0x3000, 0] = 1
    return table


class Passages:
    """Vectors of a text's passages; words' own statistics are kept, up to a bound."""

    most = 100_000

    def __init__(self):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((4096, _BASIC + len(SIGNS) + HASHED), np.float32)
        self.table = _signs_table()

    def _learn(self, new: list[str]) -> None:
        """The statistics of words not met before, all at once."""
        first = len(self.at)
        while first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        codes = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.fromiter(map(len, new), np.int64, len(new))
        sums = np.add.reduceat(self.table[np.minimum(codes, 0x3000)], np.cumsum(n) - n, axis=0)
        letters, upper, digits = sums[:, 0], sums[:, 1], sums[:, 2]
        rows = self.rows[first : first + len(new)]
        rows[:] = 0
        few = np.minimum(n, 60)
        basic = (np.log(n), few / 10, few * few / 100, letters / n, upper / n, digits / n, letters == n, (upper == letters) & (letters > 1), n > 20)
        rows[:, :_BASIC] = np.stack(basic, axis=1)
        rows[:, _BASIC : _BASIC + len(SIGNS)] = sums[:, 3:]
        names = np.fromiter((xxhash.xxh64_intdigest(w.lower().strip(SIGNS)) for w in new), np.uint64, len(new))
        slot = _BASIC + len(SIGNS) + (names % np.uint64(HASHED)).astype(np.int64)
        rows[np.arange(len(new)), slot] = np.where(names >> np.uint64(40) & np.uint64(1), 1, -1)
        self.at.update(zip(new, range(first, first + len(new))))

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros((1, WIDTH), np.float32)
        if len(self.at) > self.most:
            self.at.clear()
        known = self.at
        if new := [w for w in set(words) if w not in known]:
            self._learn(new)
        ids = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        n = len(words)
        cuts = np.arange(0, n, PASSAGE)
        if len(cuts) > 1 and n - cuts[-1] < PASSAGE // 2:
            cuts = cuts[:-1]
        sizes = np.diff(np.append(cuts, n))[:, None].astype(np.float32)
        # a long text's words go a few passages at a time, so that their rows need little memory
        groups = [cuts[k : k + 256] for k in range(0, len(cuts), 256)]
        ends = [*(g[0] for g in groups[1:]), n]
        stats = np.concatenate([np.add.reduceat(self.rows[ids[g[0] : end]], g - g[0], axis=0) for g, end in zip(groups, ends)]) / sizes
        again = np.stack([self._seen(ids), self._seen(self._runs(ids, 3))], axis=1)
        again = np.add.reduceat(again, cuts, axis=0) / sizes
        lines = text.count("\n") + 1
        whole = np.array([math.log1p(n) / 5, math.log1p(n / lines) / 3, again[:, 0].mean(), again[:, 1].mean()], np.float32)
        return np.concatenate([stats, again, np.log(sizes) / 4, np.tile(whole, (len(cuts), 1))], axis=1)

    @staticmethod
    def _runs(ids: np.ndarray, k: int) -> np.ndarray:
        ids = ids + 1  # so that no run equals a shorter one at the text's start, whatever the numbers of words
        out = ids.copy()
        for j in range(1, min(k, len(ids))):
            out[j:] = out[j:] * 1_000_003 + ids[:-j]
        return out

    @staticmethod
    def _seen(names: np.ndarray) -> np.ndarray:
        out = np.ones(len(names), np.float32)
        out[np.unique(names, return_index=True)[1]] = 0
        return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder, gated attention and scorer; numbers only, so that tasks can carry it."""

    def __init__(self, width: int = WIDTH, hidden: int = 24, gate: int = 12, seed: int = 8):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.standard_normal((a, b)) / math.sqrt(a)
        self.p = {"W": draw(width, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1), "c": draw(hidden, 1), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Scores of the bags that begin at ``starts``, and what the gradient needs."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = ((tv * su) @ p["w"])[:, 0]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        score = _sigmoid((z @ p["c"])[:, 0] + p["d"])
        return score, (x, h, tv, su, a, bag, z)

    def gradient(self, kept, starts, score, y) -> dict:
        p, (x, h, tv, su, a, bag, z) = self.p, kept
        ds = ((score - y) / len(y))[:, None]
        g = {"c": z.T @ ds, "d": ds.sum(0)}
        dz = (ds @ p["c"].T)[bag]
        da = (dz * h).sum(1)
        de = (a * (da - np.add.reduceat(a * da, starts)[bag]))[:, None]
        g["w"] = (tv * su).T @ de
        dg = de @ p["w"].T
        dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
        g["V"], g["U"] = h.T @ dv, h.T @ du
        dh = (dz * a[:, None] + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        g["W"], g["b"] = x.T @ dh, dh.sum(0)
        return g

    def fit(self, parts: Callable[[], Iterable[tuple[list[np.ndarray], np.ndarray]]], epochs: int = 30, rate: float = 0.004, decay: float = 1e-4, batch: int = 64, seed: int = 8) -> Model:
        """Fit on the bags and labels that ``parts`` yields, each time it is asked, a part after the other."""
        rng = np.random.default_rng(seed)
        n, total = 0, 0.0
        for bags, _ in parts():
            n += sum(map(len, bags))
            total = total + sum(b.sum(0, dtype=np.float64) for b in bags)
        self.mean = total / n
        self.scale = np.sqrt(sum(sum(((b - self.mean) ** 2).sum(0) for b in bags) for bags, _ in parts()) / n) + 1e-3
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            for bags, y in parts():
                order = rng.permutation(len(bags))
                for at in range(0, len(order), batch):
                    chosen = order[at : at + batch]
                    starts = np.cumsum([0, *(len(bags[k]) for k in chosen)])[:-1]
                    score, kept = self.forward(np.concatenate([bags[k] for k in chosen]), starts)
                    step += 1
                    for k, g in self.gradient(kept, starts, score, y[chosen]).items():
                        g = g + decay * self.p[k]
                        first[k] = 0.9 * first[k] + 0.1 * g
                        second[k] = 0.999 * second[k] + 0.001 * g * g
                        self.p[k] -= rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, part: int = PART) -> Model | None:
    """The model fitted on labelled documents that aren't held out.

    Their passages are a table, of which the driver holds about ``part`` bytes at a time: where there are more, each round
    of fitting reads them again part by part.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    share = int(1_000_000 * min(1.0, sample / max(1, n)))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    def run(batches):
        of = Passages()
        for batch in batches:
            bags = [of(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array([b.astype(np.float32).tobytes() for b in bags], pa.binary())], ["doc_id", "quality", "bag"]
            )

    chosen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # ``sample`` bounds the labels sent out
    kinds = ", ".join(f"{c} {chosen.schema[c].dataType.simpleString()}" for c in ("doc_id", "quality"))
    scratch = Scratch(docs.sparkSession)
    bags = scratch.keep(chosen.select("doc_id", "text", "quality").mapInArrow(run, f"{kinds}, bag binary"), "bags")
    size = bags.agg(F.sum(F.length("bag").cast("long"))).first()[0]
    if size is None:
        return None
    n = -(-size // part)

    def read(k: int) -> tuple[list[np.ndarray], np.ndarray]:
        rows = sorted(bags.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k).collect(), key=lambda r: (r.doc_id, r.bag))
        return [np.frombuffer(r.bag, np.float32).reshape(-1, WIDTH) for r in rows], np.array([float(r.quality > 0) for r in rows])

    one = [read(0)] if n == 1 else None
    model = Model().fit(lambda: one or (x for x in map(read, range(n)) if x[0]))
    scratch.drop(bags)
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted."""
    names = docs.columns

    def run(batches):
        of = Passages()
        for batch in batches:
            scores = []
            for text in texts(batch.column("text")):
                scores.append(0.5 if model is None else float(model.forward(of(text), np.zeros(1, np.int64))[0][0]))
            out = np.array(scores, np.float64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(out), pa.array((out >= threshold).astype(np.int32))], [*names, "score", "predicted"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, sample), threshold)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_rejected(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    packed, _ = carried(docs)
    return restored(score(packed, train(docs, labels, sample), threshold).where("predicted = 1"), docs)
