"""Near-duplicate vectors by Euclidean p-stable hashing, with an exact cosine check.

Vectors are scaled to length one. A table's key is ``DEPTH`` random projections, shifted and cut to whole numbers of
``WIDTH``; vectors that share a key in any of ``TABLES`` tables are compared by cosine in double precision. Two vectors
of cosine 0.98 (0.2 apart) share one projection's cell with a chance of 0.867 and a table's key with 0.102, so that one
of 48 tables finds them with 0.994; a pair 0.77 apart (cosine 0.7) meets in 0.14 % of cases.

Equal vectors of a label are one class with a count before that. A class is known by its smallest vec_id and a hash of
label and vector, so that unlike vectors of one vec_id are classes of their own. A key's classes are cut into blocks of
at most ``BLOCK`` by a hash; each pair of blocks is compared by a matrix product in one task, which reads its blocks one
after another from rows sorted by key and returns link counts and spanning edges, never the pairs. A pair is counted in
the first table that both share.

Null, zero or non-finite vectors, vectors without components, and rows with a null label or vec_id, link with nothing:
each is its own component. Vectors of different lengths never link. Each row of a repeated vec_id is returned, with the
links of its own vector; equal vectors link to each other. An empty table gives an empty result; other columns aren't
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, partitions

WIDTH, DEPTH, TABLES, BLOCK, SEED = 1.2, 16, 48, 1024, 17


def projections(dim: int, depth: int = DEPTH, tables: int = TABLES, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + dim)
    return rng.standard_normal((dim, depth * tables)), rng.random(depth * tables) * width


def keys(unit: np.ndarray, depth: int = DEPTH, tables: int = TABLES, width: float = WIDTH) -> np.ndarray:
    """A 64-bit key for each row and table."""
    way, shift = projections(unit.shape[1], depth, tables, width)
    cells = np.floor((unit @ way + shift) / width).astype(np.int64).reshape(len(unit), tables, depth)
    out = np.zeros((len(unit), tables), np.uint64)
    for k in range(depth):
        out = (out ^ cells[:, :, k].view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list column whose values are all of one length."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _spanning(hit: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the least row that it is linked to over any way."""
    low = np.arange(len(hit))
    while True:
        new = np.minimum(low, np.where(hit, low[None, :], len(hit)).min(axis=1))
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def block_links(x: np.ndarray, norms: np.ndarray, own_keys: np.ndarray, counts: np.ndarray, cut: int, table: int, threshold: float):
    """Of vectors ``x`` (of one block, or of two, the second from ``cut`` on): to how many copies each links here first, and
    edges (row, row) that span these links."""
    n = len(x)
    a, b = (slice(0, n), slice(0, n)) if cut == n else (slice(0, cut), slice(cut, n))
    hit = (x[a] @ x[b].T) / np.outer(norms[a], norms[b]) >= threshold
    i, j = np.nonzero(np.triu(hit, 1) if cut == n else hit)
    j = j + b.start
    if len(i) and table:
        first = np.ones(len(i), bool)
        for t in range(table):
            first &= own_keys[i, t] != own_keys[j, t]
        i, j = i[first], j[first]
    if not len(i):
        return None, ()
    links = np.bincount(i, counts[j], n) + np.bincount(j, counts[i], n)
    if len(i) == 1:
        return links, [(i[0], j[0])]
    both = np.zeros((n, n), bool)
    both[i, j] = both[j, i] = True
    low = _spanning(both)
    return links, [(k, m) for k, m in enumerate(low.tolist()) if k != m]


_CELL = ["t", "key", "lab", "dim", "i", "j"]


def _compared(dealt: DataFrame, threshold: float) -> DataFrame:
    """id, h, links and edges (id, h, other_id, other_h) from rows sorted by cell."""

    def groups(batches):
        """Record batches that end where a cell ends."""
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            cells = np.stack([held.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _CELL])
            turns = np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1
            if len(turns):
                yield held.slice(0, turns[-1]), turns
                held = held.slice(turns[-1])
        if held is not None:
            yield held, np.array([len(held)])

    def run(batches):
        for rows, turns in groups(batches):
            col = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("t", "i", "j", "own", "id", "h", "n")}
            dims = rows.column("dim").to_numpy(zero_copy_only=False)
            table_keys = _matrix(rows.column("keys"))
            found, edges = np.zeros(len(rows), np.int64), []
            begins = np.concatenate([[0], turns[:-1]])
            for dim in np.unique(dims):
                some = np.flatnonzero(dims == dim)
                x = _matrix(rows.column("embedding").take(pa.array(some))).astype(np.float64)
                norms, at = np.linalg.norm(x, axis=1), dict(zip(some.tolist(), range(len(some))))
                for lo, hi in zip(begins.tolist(), turns.tolist()):
                    if dims[lo] != dim or hi - lo < 2:
                        continue
                    p = at[lo]
                    cut = hi - lo if col["i"][lo] == col["j"][lo] else int(np.searchsorted(col["own"][lo:hi], col["j"][lo]))
                    part = slice(p, p + hi - lo)
                    links, pairs = block_links(x[part], norms[part], table_keys[lo:hi], col["n"][lo:hi], cut, int(col["t"][lo]), threshold)
                    if links is not None:
                        found[lo:hi] += links.astype(np.int64)
                        edges += [(lo + k, lo + m) for k, m in pairs]
            own = np.flatnonzero(found)
            k, m = (np.array(side, np.int64) for side in (zip(*edges) if edges else ((), ())))
            left, right = np.concatenate([own, k]), pa.array(np.concatenate([np.full(len(own), -1), m]), mask=np.arange(len(own) + len(k)) < len(own))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(col["id"][left]), pa.array(col["h"][left]), pa.array(col["id"]).take(right), pa.array(col["h"]).take(right),
                    pa.array(np.concatenate([found[own], np.zeros(len(k), np.int64)])),
                ],
                ["id", "h", "other_id", "other_h", "links"],
            )

    return dealt.mapInArrow(run, "id long, h long, other_id long, other_h long, links long")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, depth: int = DEPTH, tables: int = TABLES, width: float = WIDTH, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    usable = F.coalesce(
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda v: v != 0.0), F.lit(False)
    )
    zero = F.lit(0.0).cast(kind)  # -0.0 + 0.0 is 0.0
    named = rows.where(usable).withColumn("embedding", F.transform("embedding", lambda v: v + zero))
    named = named.select("vec_id", F.xxhash64("label").alias("lab"), F.xxhash64("label", "embedding").alias("h"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("h2"), "embedding")
    reps = named.groupBy("lab", "h", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    reps = scratch.keep(reps.withColumn("dim", F.size("embedding")), "reps")

    def hashed(batches):
        for batch in batches:
            sizes, out = batch.column("dim").to_numpy(zero_copy_only=False), np.zeros((len(batch), tables), np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = _matrix(batch.column("embedding").take(pa.array(at))).astype(np.float64)
                out[at] = keys(x / np.linalg.norm(x, axis=1, keepdims=True), depth, tables, width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, np.int32)), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "h", "lab", "dim")), lists], ["id", "h", "lab", "dim", "keys"])

    signed = scratch.keep(reps.select("id", "h", "lab", "dim", "embedding").mapInArrow(hashed, "id long, h long, lab long, dim int, keys array<long>"), "keys")
    entries = signed.select("id", "h", "lab", "dim", F.posexplode("keys").alias("t", "key"))
    cell = ["lab", "dim", "t", "key"]
    shared = entries.groupBy(*cell).count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count")
    members = scratch.keep(entries.join(shared, cell).select("id", "h", *cell, "blocks"), "members")
    own = F.pmod(F.xxhash64("id", "h"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "h", *cell, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    payload = reps.select("id", "h", "n", "embedding").join(signed.select("id", "h", "keys"), ["id", "h"])
    dealt = dealt.join(payload, ["id", "h"]).repartition(partitions(spark), *_CELL).sortWithinPartitions(*_CELL, "own", "id", "h")
    found = scratch.keep(_compared(dealt, float(threshold)), "links")
    scratch.drop(members)
    links = found.groupBy("id", "h").agg(F.sum("links").alias("links"))
    node = lambda i, h: F.struct(F.col(i).alias("id"), F.col(h).alias("h"))
    parts = components(scratch, found.where("other_id is not null").select(node("id", "h").alias("a"), node("other_id", "other_h").alias("b")))
    parts = parts.select("node.id", "node.h", F.col("component.id").alias("component_id"))
    of_class = (
        reps.select("lab", "h", "h2", "id", "n").join(links, ["id", "h"], "left").join(parts, ["id", "h"], "left")
        .select("lab", "h", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    )
    good = named.select("vec_id", "lab", "h", "h2").join(of_class, ["lab", "h", "h2"]).select("vec_id", "n_links", "component_id")
    lone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
