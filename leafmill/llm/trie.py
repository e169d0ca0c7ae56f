"""Prefix tries of conversations, as balanced parentheses in shards.

A conversation is its turns in order, a turn known by the MD5 of role and text. Conversations are range-sorted by their
turns (then conv_id), so that a sorted run of them is the trie in preorder. ``block`` neighbours make a shard, whose trie
is a row of parentheses: a node opens where the first conversation has it and closes behind the last. Over the excess of
open parentheses lies a tree of block minima; ``find_close`` walks it for all nodes at once, and what lies between a
parenthesis and its partner is the subtree. Leaves are pairs "()", counted by rank; members and savings are differences
of cumulative arrays.

Nodes that the next or the last shard has too, the spines, are told by how many turns both sides of a border share. A
shard counts what it has of them, each turn saved and each child in the first shard that has it, each leaf in the last, so
that a sum over shards by node is the whole: spines merge in a streaming pass over the sorted partial rows. Other nodes
are done in their shard. No shard knows another's nodes, and none grows with a group of copies: those are cut by conv_id.

Turns are ordered by turn (null first), role, text; null role or text is empty. Repeated rows are turns of their own. Rows
with null conv_id are left out; a conversation without turns ends at the root; an empty table has no nodes. Very long
texts are hashed whole; a conversation is a row of 16 bytes a turn. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ranked

#: Conversations a shard.
BLOCK = 1024

_NODES = (
    "block long, node int, parent int, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends string, ends_sha256 string"
)
_MERGED = "key binary, parent_key binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 1), name, words of each turn."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    name = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return rows.select("conv_id", F.row_number().over(order).alias("i"), name.alias("name"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))


def rebuilt(scratch: Scratch, own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """conv_id, path (names), words of each conversation, whose first h turns are those of the first conversation of its
    ``every``, h being the crc32 of its number modulo ``most``."""
    own = scratch.keep(own, "turns")
    head = F.crc32(F.col("conv_id").cast("string")) % most
    convs = own.where("i = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), head.alias("h"))
    first = own.where((F.col("i") < most) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "i", "name", "words")
    lent = convs.where("h > 0").join(first, "base").where("i <= h").select("conv_id", F.lit(0).alias("part"), "i", "name", "words")
    rest = own.where(F.col("i") > head).select("conv_id", F.lit(1).alias("part"), "i", "name", "words")
    none = convs.select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in (("part", "int"), ("i", "int"), ("name", "binary"), ("words", "int"))))
    row = F.when(F.col("part").isNotNull(), F.struct("part", "i", "name", "words"))
    found = lent.unionByName(rest).unionByName(none).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    return found.select("conv_id", F.col("t.name").alias("path"), F.col("t.words").alias("words"))


def find_close(bits: np.ndarray, opens: np.ndarray, block: int = 64) -> np.ndarray:
    """Where the parentheses that open at ``opens`` close: the next place whose excess is below their own."""
    far = np.iinfo(np.int32).max
    excess = np.full(-(-len(bits) // block) * block, far, np.int32)
    excess[: len(bits)] = np.cumsum(np.where(bits, 1, -1))
    rows = excess.reshape(-1, block)
    half = 1 << max(0, len(rows) - 1).bit_length()
    least = np.full(2 * half, far, np.int32)  # a tree of minima: node i has 2i and 2i + 1
    least[half : half + len(rows)] = rows.min(1)
    width = half
    while width > 1:
        width //= 2
        least[width : 2 * width] = np.minimum(least[2 * width : 4 * width : 2], least[2 * width + 1 : 4 * width : 2])
    out = np.empty(len(opens), np.int64)
    for at in range(0, len(opens), 1 << 16):
        i = opens[at : at + (1 << 16)]
        goal, b = excess[i] - 1, i // block
        inside = (rows[b] <= goal[:, None]) & (np.arange(block) > (i % block)[:, None])
        here, spot = inside.any(1), b * block + inside.argmax(1)
        away = np.flatnonzero(~here)
        if len(away):
            node, want = half + b[away], goal[away]
            up = np.arange(len(away))
            while len(up):  # up until a right neighbour holds the goal
                n = node[up]
                right = (n % 2 == 0) & (least[n | 1] <= want[up])
                node[up] = np.where(right, n + 1, n >> 1)
                up = up[~right]
            while (deeper := node < half).any():  # and down to the first block that does
                below = 2 * node[deeper]
                node[deeper] = below + (least[below] > want[deeper])
            spot[away] = (node - half) * block + (rows[node - half] <= want[:, None]).argmax(1)
        out[at : at + len(i)] = spot
    return out


def _keys(path: list[bytes], upto: int) -> list[bytes]:
    """Names of the first ``upto`` prefixes of a path, from the empty one on."""
    digest, out = hashlib.blake2b(digest_size=16), []
    for d in range(upto + 1):
        if d:
            digest.update(path[d - 1])
        out.append(digest.digest())
    return out


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shard(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one block's trie. ``before`` and ``after`` are how many turns it shares with its neighbours, or -1."""
    rows = rows.sort_values("pos")
    ids, paths = rows["conv_id"].to_numpy(np.int64), [list(p) for p in rows["path"]]
    before, after, n = int(rows["before"].iloc[0]), int(rows["after"].iloc[0]), len(rows)
    lens = np.array([len(p) for p in paths])
    off = np.concatenate([[0], np.cumsum(lens)])
    names = np.frombuffer(b"".join(x for p in paths for x in p), np.uint64).reshape(-1, 2)
    words = np.concatenate([*map(np.asarray, rows["words"]), np.zeros(0)]).astype(np.int64)
    row = np.repeat(np.arange(n), lens)
    d = np.arange(off[-1]) - off[row]
    old = np.flatnonzero((row > 0) & (d < lens[row - 1]))
    same = np.zeros(off[-1], bool)
    same[old] = (names[old] == names[off[row[old] - 1] + d[old]]).all(1)
    lcp = lens.copy()
    np.minimum.at(lcp, row[~same], d[~same])
    lcp[0] = -1
    new = lens - lcp  # the first conversation opens the root as well
    closed = np.append(lens[:-1] - lcp[1:], lens[-1] + 1)
    bits = np.repeat(np.tile([True, False], n), np.stack([new, closed], 1).ravel())
    starts = np.concatenate([[0], np.cumsum(new)])
    m = int(starts[-1])
    opener = np.repeat(np.arange(n), new)
    depth = lcp[opener] + 1 + np.arange(m) - starts[opener]
    opens = np.flatnonzero(bits)
    close = find_close(bits, opens)
    upto = np.arange(m) + (close - opens + 1) // 2  # a subtree is the nodes from its top to here

    path, parent, end = np.zeros(int(lens.max()) + 1, np.int64), np.arange(m) - 1, np.empty(n, np.int64)
    for r in range(n):
        if r and new[r]:
            parent[starts[r]] = path[lcp[r]]
        path[lcp[r] + 1 : lens[r] + 1] = np.arange(starts[r], starts[r + 1])
        end[r] = path[lens[r]]
    within = lambda of: (c := np.concatenate([[0], np.cumsum(of)]))[upto] - c[:m]
    n_convs = within(np.bincount(end, minlength=m))
    lowest = np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), np.stack([opener, opener + n_convs], 1).ravel())[::2]
    ours = (opener > 0) | (depth > before)
    word = np.where(depth > 0, words[np.minimum(off[opener] + np.maximum(depth, 1) - 1, max(0, len(words) - 1))] if len(words) else 0, 0)
    saved = within((n_convs - ours) * word)
    pair = bits & ~np.append(bits[1:], True)
    if after >= lens[-1]:
        pair[opens[end[-1]]] = False  # the next shard goes on here
    upwards = np.concatenate([[0], np.cumsum(pair)])
    leaves = upwards[close] - upwards[opens]
    children = np.bincount(parent[1:], ours[1:], minlength=m).astype(np.int64)

    shared, key = np.zeros(m, bool), np.full(m, None, object)
    for spine, known, conv in ((np.arange(starts[1])[: before + 1], before, paths[0]), (path[: after + 1], after, paths[-1])):
        shared[spine] = True
        key[spine] = _keys(conv, known) if known >= 0 else []
    text = np.full(m, "", object)
    for group in np.split(by := np.argsort(end, kind="stable"), np.flatnonzero(np.diff(end[by])) + 1):
        text[end[group[0]]] = ",".join(map(str, ids[group]))
    none = _hash("")
    local = (parent >= 0) & ~shared[parent]
    up = np.maximum(parent, 0)
    return pd.DataFrame({
        "block": np.full(m, rows["block"].iloc[0]), "node": np.arange(m), "parent": pd.array(np.where(parent < 0, 0, parent), "Int32"), "key": key,
        "parent_key": np.where(shared & (parent >= 0), key[up], None), "depth": depth, "conv_id": lowest,
        "parent_conv_id": pd.array(lowest[up], "Int64").copy(), "n_convs": n_convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
        "ends": np.where(shared, text, ""), "ends_sha256": [None if s else none if t == "" else _hash(t) for s, t in zip(shared, text)],
    }).assign(parent_conv_id=lambda f: f["parent_conv_id"].mask(~local), parent=lambda f: f["parent"].mask(parent < 0))


def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a node of partial rows that come sorted by key and block."""
    names = ["key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    now, digest, begun, out = None, None, False, []
    for batch in batches:
        for *row, ends in batch[[*names, "ends"]].itertuples(index=False, name=None):
            if now is None or row[0] != now[0]:
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest, begun = row, hashlib.sha256(), False
            else:
                now[3] = min(now[3], row[3])
                now[4:] = [a + b for a, b in zip(now[4:], row[4:])]
            if ends:
                digest.update((("," if begun else "") + ends).encode())
                begun = True
        yield pd.DataFrame(out, columns=[*names, "ends_sha256"])
        out = []
    if now:
        yield pd.DataFrame([(*now, digest.hexdigest())], columns=[*names, "ends_sha256"])


def prefix_trie(scratch: Scratch, paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, path, words)."""
    spark = paths.sparkSession
    found, starts = ranked(scratch, paths, [F.col("path"), F.col("conv_id")], "paths")
    if not starts:
        return spark.createDataFrame([], _NODES).select(*OUT)
    pos = F.get(F.array(*map(F.lit, starts)), F.col("part")).cast("long") + F.col("idx")
    found = found.select("conv_id", "path", "words", pos.alias("pos"), F.floor(pos / block).cast("long").alias("block"))
    last = found.where((F.col("pos") + 1) % block == 0).select((F.col("block") + 1).alias("block"), F.col("path").alias("old"))
    differ = F.array_position(F.zip_with("old", "path", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    both = found.where(F.col("pos") % block == 0).join(last, "block")
    borders = scratch.keep(both.select("block", F.when(differ == 0, F.size("path")).otherwise(differ - 1).cast("int").alias("n")), "borders")
    near = borders.withColumnRenamed("n", "before").join(borders.select(F.col("block") - 1, F.col("n").alias("after")).toDF("block", "after"), "block", "full")
    fed = found.join(near, "block", "left").withColumn("before", F.coalesce("before", F.lit(-1))).withColumn("after", F.coalesce("after", F.lit(-1)))
    nodes = scratch.keep(fed.groupBy("block").applyInPandas(lambda rows: shard(rows), _NODES), "nodes")

    shared = nodes.where("key is not null")
    pieces = shared.repartition("key").sortWithinPartitions("key", "block")
    whole = scratch.keep(pieces.mapInPandas(merge, _MERGED), "spines")
    top = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    spines = whole.join(top, "parent_key", "left").select(*OUT)
    done = "key is null and (parent is null or parent_conv_id is not null)"
    held = shared.select("block", F.col("node").alias("parent"), "key").join(whole.select("key", F.col("conv_id").alias("up")), "key").drop("key")
    hung = nodes.where(f"not ({done}) and key is null").drop("parent_conv_id").join(held, ["block", "parent"]).withColumnRenamed("up", "parent_conv_id")
    return nodes.where(done).select(*OUT).unionByName(hung.select(*OUT)).unionByName(spines)


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of all conversations after ``rebuilt``: conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 of each node."""
    scratch = Scratch(conversations.sparkSession)
    return prefix_trie(scratch, rebuilt(scratch, turns(conversations)), block)


ORACLE_SQL = r"""
with t as (
  select conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) i
  from conversations where conv_id is not null
), crc as (
  select conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda h, b: case when b >= 0 then xor(h, b) else xor(h >> 1, 3988292384 * (h & 1)) end)) % 4 h from (select distinct conv_id from t)
), every as (
  select c.conv_id, 0 part, i, r, x from crc c join t on t.conv_id = c.conv_id - c.conv_id % 20 and i <= h
  union all select conv_id, 1, i, r, x from t join crc using (conv_id) where i > h
), turns as (
  select conv_id, row_number() over (partition by conv_id order by part, i) d, r, x from every
), pre as (
  select conv_id, d, string_agg(length(r) || ':' || length(x) || ':' || r || x, '') over (partition by conv_id order by d) p, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) w from turns
  union all select conv_id, 0, '', 0 from crc
), ended as (
  select conv_id, p from (select *, d = max(d) over (partition by conv_id) last from pre) where last
), ends as (
  select p, string_agg(conv_id::varchar, ',' order by conv_id) ends from ended group by p
), node as (
  select p, d, min(conv_id) conv_id, count(*) n, max(w) w from pre group by p, d
), up as (
  select n.p, n.conv_id, q.p parent, n.n, n.w from node n left join pre q on q.conv_id = n.conv_id and q.d = n.d - 1
), kids as (
  select parent p, count(*) k from up where parent is not null group by 1
), below as (
  select q.p, sum(case when k.k is null then 1 else 0 end) leaves, sum((n.n - 1) * n.w) saved
  from node n join pre q on q.conv_id = n.conv_id and q.d <= n.d left join kids k on k.p = n.p group by q.p
)
select n.conv_id, n.d::bigint as depth, a.conv_id parent_conv_id, n.n n_convs, coalesce(k, 0)::bigint n_children, leaves::bigint n_leaves, saved::bigint saved_tokens, sha256(coalesce(ends, '')) ends_sha256
from node n join up using (p) left join node a on a.p = up.parent left join kids on kids.p = n.p join below on below.p = n.p left join ends on ends.p = n.p
"""
