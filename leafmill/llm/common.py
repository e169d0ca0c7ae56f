"""What the operators of this package share: scratch tables, global ranks, Arrow text access, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: monotonically_increasing_id() holds the partition above this many bits and the row's place below.
_ROW_BITS = 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(docs: DataFrame) -> tuple[DataFrame, str]:
    """doc_id, text and all other columns in one struct, whose name is returned: none can clash with an operator's."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest))).alias("_rest")), "_rest"


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with doc_id and text of ``df`` and the others as they were carried; n_chars follows text."""
    rest = iter(range(len(like.columns)))
    cols = []
    for c in like.columns:
        if c in ("doc_id", "text"):
            cols.append(F.col(c))
        else:
            old = F.col(f"_rest.c{next(rest)}")
            if c == "n_chars":
                old = F.when(F.col("text").isNull(), old).otherwise(F.length("text")).cast(like.schema[c].dataType)
            cols.append(old.alias(c))
    return df.select(*cols)


class Scratch:
    """Tables written under ``spark.checkpoint.dir``: they cut lineage and outlive the loss of an executor.

    Where that setting is absent and Spark runs in this process alone (tests) a temporary folder is taken instead.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="leafmill-")
        self.root = f"{root.rstrip('/')}/leafmill-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back.

        Collecting garbage then lets Spark's cleaner delete the shuffle files of plans that are done.
        """
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        path = self._paths.pop(id(df), None)
        if path:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(scratch: Scratch, df: DataFrame, order: list[Column], name: str = "rank") -> tuple[DataFrame, list[int]]:
    """Range-sort ``df`` and write it with its place as (``part``, ``idx``).

    Also returns each part's first global position, one integer a partition, so position = starts[part] + idx.
    """
    n = partitions(scratch.spark)
    spot = F.monotonically_increasing_id()
    out = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("*", F.shiftright(spot, _ROW_BITS).cast("int").alias("part"), spot.bitwiseAND((1 << _ROW_BITS) - 1).alias("idx"))
    )
    out = scratch.keep(out, name)
    counts = dict(out.groupBy("part").count().collect())
    starts, at = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(at)
        at += counts.get(part, 0)
    return out, starts


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and where each value starts in them (one entry more than values); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def slices(bounds: np.ndarray, size: int):
    """Ranges of values that hold about ``size`` bytes together."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: At most so many nodes can have more than 2 E / HUBS of E edges' ends: their minima are sent to all tasks.
HUBS = 4096


def _with_low(both: DataFrame, n_edges: int) -> DataFrame:
    """``both`` (u, v) with m, the least of u and its neighbours. A hub's many rows stay where they are."""
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("degree"))
    low, many = low.select("u", "m", "degree"), F.col("degree") > 2 * n_edges // HUBS
    hubs = F.broadcast(low.where(many).select("u", "m"))  # fewer than HUBS rows
    rest = both.join(hubs.select("u"), "u", "left_anti").join(low.where(~many).select("u", "m").hint("merge"), "u")
    return both.join(hubs, "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b) as rows (node, component), component being the smallest node.

    Alternates large-star and small-star steps until nothing changes, which takes of the order of log^2 n rounds; each is
    a map-side-combined minimum per node and a join back, so no node's neighbours are ever gathered. Isolated nodes
    don't occur in ``edges`` and so not in the result.
    """
    now = scratch.keep(
        edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "edges"
    )
    size = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state = size(now)
    while state[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_low(both, state[0]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, "edges")
        step = _with_low(large, large.count())
        out = step.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        out = scratch.keep(out.where("u <> v").distinct(), "edges")
        scratch.drop(now)
        scratch.drop(large)
        now, before = out, state
        state = size(now)
        if state == before:
            break
    tops = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        tops.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
