"""Repair of conversations whose roles don't alternate, by Hirschberg's divide and conquer.

A repaired conversation has roles of the initials (s?(ua)+)?. Rows are kept, given another role (R, 1) or deleted (D, 2:
what is blank or a repetition must be), and rows without text are inserted (I, 5); a truncated row that stays costs 5.
Of the cheapest edits those whose initials, in order, are ASCII-least are made.

What has been put out so far is one of four states (nothing, s, u, a). Forward costs of all states from one end and
backward costs from the other meet in the middle, where the cheapest crossing is taken; both halves are then solved alike,
so that memory is linear. Forward costs carry the order of their states' least edits: different edits of the same rows
never begin one another, as each ends with a row's own, so among equally cheap crossings the one whose forward edits are
least is right.

Rows are range-sorted by conversation and turn, so that no conversation need fit in one task. ``SEGMENT`` rows are one
segment. Segments of a conversation that has several are summed up as tables of cost and order from each state to each,
tables of ``FAN`` neighbours as one, and so on; from the top down the same divide and conquer gives each table,
and at last each segment, the states where it begins and ends. Segments are then edited apart from each other.

Rows are ordered by turn (null first), role, text. A null role or text is one space; a null conv_id is a conversation like
others. Repeated rows are repetitions, thus deleted. A conversation all of whose rows go has no edits of its own but D's.
Very long texts are rows like others; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked

#: Rows a segment, and tables that are summed up as one.
SEGMENT, FAN = 1024, 64
FAR = 1 << 60
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)

#: What a role's initial puts out, and from which states.
_BEFORE = {SYSTEM: {NOTHING}, USER: {NOTHING, SYSTEM, ASSISTANT}, ASSISTANT: {USER}}
#: What is put out on the way to each state, and before that where a row is inserted first.
_PUT, _OTHER = "-sua", "--au"
#: What must still follow each state at the end.
_MISSING = {NOTHING: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}


@lru_cache(maxsize=None)
def row_table(code: str) -> tuple:
    """(costs, edits) from each state to each over one row: its initial (s, u, a or -) in a code that is a capital where the
    row is truncated, and x for a row that must go. Edits may begin with an I, none ends with one."""
    cost, edits = [[FAR] * 4 for _ in STATES], [[""] * 4 for _ in STATES]

    def may(s: int, t: int, c: int, e: str) -> None:
        if (c, e) < (cost[s][t], edits[s][t]) or cost[s][t] == FAR:
            cost[s][t], edits[s][t] = c, e

    for s in STATES:
        may(s, s, DELETE, "D")
    if code != "x":
        stays = TRUNCATED * code.isupper()
        own = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(code.lower())
        for t in (SYSTEM, USER, ASSISTANT):
            for c, e in ((0, "K"), (REROLE, "R")):
                if (e == "K" and t != own) or (e == "R" and t == SYSTEM):
                    continue
                for s in STATES:
                    if s in _BEFORE[t]:
                        may(s, t, stays + c, e)
                    elif t != SYSTEM:  # a row that it can follow is inserted: an a after u, else a u
                        may(s, t, stays + c + INSERT, "I" + e)
    return tuple(map(tuple, cost)), tuple(map(tuple, edits))


@lru_cache(maxsize=1 << 16)
def _step(costs: tuple, order: tuple, table: tuple) -> tuple:
    """Costs and order of the states after one more table; costs are told from the least, which comes third."""
    cost, keys = table
    found = [min((min(costs[s] + cost[s][t], FAR), order[s], keys[s][t]) for s in STATES) for t in STATES]
    least = min(c for c, _, _ in found)
    ranks = sorted({(o, k) for c, o, k in found if c < FAR})
    return tuple(FAR if c == FAR else c - least for c, _, _ in found), tuple(ranks.index((o, k)) if c < FAR else 4 for c, o, k in found), least


def forward(tables: list, start: int) -> tuple[tuple, tuple, int]:
    """Costs to each state from ``start``, above their least, the order of their edits, and that least."""
    costs, order, base = tuple(0 if s == start else FAR for s in STATES), (0, 0, 0, 0), 0
    for table in tables:
        costs, order, least = _step(costs, order, table)
        base += least
    return costs, order, base


@lru_cache(maxsize=1 << 16)
def _back(costs: tuple, cost: tuple) -> tuple:
    found = [min(min(cost[s][t] + costs[t], FAR) for t in STATES) for s in STATES]
    least = min(found)
    return tuple(FAR if c >= FAR else c - least for c in found)


def backward(tables: list, end: int) -> tuple:
    costs = tuple(0 if s == end else FAR for s in STATES)
    for cost, _ in reversed(tables):
        costs = _back(costs, cost)
    return costs


def crossings(tables: list, start: int, end: int) -> list[int]:
    """The state before each table on the cheapest way from ``start`` to ``end``, the first in order of edits."""
    if len(tables) < 2:
        return [start] * len(tables)
    half = len(tables) // 2
    (costs, order, _), rest = forward(tables[:half], start), backward(tables[half:], end)
    at = min(STATES, key=lambda s: (min(costs[s] + rest[s], FAR), order[s]))
    return crossings(tables[:half], start, at) + crossings(tables[half:], at, end)


def last_state(costs: tuple, order: tuple) -> int:
    """The state in which it is cheapest to end, with what is missing then inserted."""
    return min(STATES, key=lambda s: (min(costs[s] + INSERT * len(_MISSING[s]), FAR), order[s]))


def summed(tables: list) -> tuple:
    """One table of several in a row."""
    found = [forward(tables, s) for s in STATES]
    return tuple(tuple(min(c + base, FAR) for c in costs) for costs, _, base in found), tuple(order for _, order, _ in found)


def edits(codes: str, start: int, end: int, last: bool) -> list[tuple[str, str]]:
    """The edits of each row and the initials that they put out; the last row of a conversation has what is inserted behind it."""
    tables = [row_table(c) for c in codes]
    at = [*crossings(tables, start, end), end]
    out = []
    for k, (_, keys) in enumerate(tables):
        did = keys[at[k]][at[k + 1]]
        put = "-" if did == "D" else _PUT[at[k + 1]] if len(did) == 1 else _OTHER[at[k + 1]] + _PUT[at[k + 1]]
        out.append((did, put))
    if last:
        missing = _MISSING[end]
        out[-1] = out[-1][0] + "I" * len(missing), out[-1][1] + missing
    return out


def _key(df: DataFrame) -> Column:
    """conv_id as text; null is one space."""
    return F.coalesce(df["conv_id"].cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """key, turn, role, text after the damage that the crc32 of ``conv_id:turn`` deals out to a twentieth of rows each."""
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" "))
    turn = F.col("turn").cast("long")
    kind = F.crc32(F.concat(_key(conversations), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))) % 20
    rows = conversations.select(_key(conversations).alias("key"), turn.alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("key", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def placed(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """``rows`` (key, turn, role, text) with their place ``pos`` in the order of conversations and turns."""
    order = ["key", "turn", "role", "text", "same"]  # ``same`` lets equal rows, too, be cut between tasks
    rows, starts = ranked(scratch, rows.withColumn("same", F.monotonically_increasing_id()), [F.col(c).asc_nulls_first() for c in order], "rows")
    pos = F.get(F.array(*map(F.lit, starts or [0])), F.col("part")).cast("long") + F.col("idx")
    return rows.select("key", "turn", "role", "text", pos.alias("pos"))


def faults(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """key, pos, fault (blank, duplicate, truncated or null), code of each row. A repetition is a row that isn't the first
    of its role and text: firsts are found by a partial aggregate and joined by place, so no text is hot."""
    name = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), -1, 1)
    narrow = scratch.keep(rows.select("key", "pos", name.alias("name"), F.substring("role", 1, 1).alias("initial"), last.alias("last")), "narrow")
    firsts = narrow.groupBy("key", "name").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    return scratch.keep(narrow.join(firsts, "pos", "left").withColumn("fault", fault).select("key", "pos", "fault", code.alias("code")), "faults")


_TABLES = "key string, node long, costs array<long>, orders array<int>"
_STATES = "key string, node long, start int, end int"


def _packed(tables: list) -> pd.DataFrame:
    flat = lambda of: [x for row in of for x in row]
    return pd.DataFrame({"costs": [flat(c) for c, _ in tables], "orders": [flat(o) for _, o in tables]})


def _unpacked(costs, orders) -> tuple:
    quads = lambda of: tuple(tuple(int(x) for x in of[4 * k : 4 * k + 4]) for k in STATES)
    return quads(costs), quads(orders)


def _of_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["key", "node"]].join(_packed([summed([row_table(c) for c in codes]) for codes in batch["codes"]]))


def _of_tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["key", "node"]].join(_packed([summed([_unpacked(t["costs"], t["orders"]) for t in below]) for below in batch["below"]]))


def _tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        tables = [_unpacked(c, o) for c, o in zip(batch["costs"], batch["orders"])]
        yield batch[["key", "node"]].assign(start=NOTHING, end=[last_state(c[NOTHING], o[NOTHING]) for c, o in tables])


def _downwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples():
            at = [*crossings([_unpacked(t["costs"], t["orders"]) for t in r.below], r.start, r.end), r.end]
            out += [(r.key, t["node"], at[k], at[k + 1]) for k, t in enumerate(r.below)]
        yield pd.DataFrame(out, columns=["key", "node", "start", "end"])


def borders(scratch: Scratch, segments: DataFrame, fan: int) -> DataFrame:
    """key, node, start, end, last of the segments of conversations that have several: the states where each begins and ends."""
    several = scratch.keep(segments.groupBy("key").agg(F.count("*").alias("n"), F.max("node").alias("top")).where("n > 1"), "several")
    level = segments.select("key", "node", "codes").join(several.select("key"), "key", "left_semi")
    level, groups = scratch.keep(level.mapInPandas(_of_codes, _TABLES), "tables"), []
    while not level.groupBy("key").count().where("count > 1").isEmpty():
        below = F.array_sort(F.collect_list(F.struct("node", "costs", "orders"))).alias("below")
        groups.append(scratch.keep(level.groupBy("key", F.floor(F.col("node") / fan).cast("long").alias("node")).agg(below), "groups"))
        level = scratch.keep(groups[-1].mapInPandas(_of_tables, _TABLES), "tables")
    states = level.mapInPandas(_tops, _STATES)
    for group in reversed(groups):
        states = scratch.keep(group.join(states, ["key", "node"]).mapInPandas(_downwards, _STATES), "states")
    return states.join(several.select("key", "top"), "key").select("key", "node", "start", "end", (F.col("node") == F.col("top")).alias("last"))


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for codes, start, end, last in zip(batch["codes"], batch["start"], batch["end"], batch["last"]):
            if end < 0:
                costs, order, _ = forward([row_table(c) for c in codes], NOTHING)
                start, end = NOTHING, last_state(costs, order)
            out.append(edits(codes, int(start), int(end), bool(last)))
        yield pd.DataFrame({"first": batch["first"], "did": out})


def edits_of(scratch: Scratch, coded: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """key, pos, fault, edits (one letter each: I's before a row, its K, R or D, I's behind the last), roles (the initial that
    each letter puts out, - for a D)."""
    each = F.array_sort(F.collect_list(F.struct("pos", "code")))
    segments = coded.groupBy("key", F.floor(F.col("pos") / segment).cast("long").alias("node")).agg(F.min("pos").alias("first"), each.alias("l"))
    segments = scratch.keep(segments.select("key", "node", "first", F.array_join(F.col("l.code"), "").alias("codes")), "segments")
    fed = segments.join(borders(scratch, segments, fan), ["key", "node"], "left")
    alone = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    done = fed.select("first", "codes", alone("start", -1), alone("end", -1), alone("last", True)).mapInPandas(_edited, "first long, did array<struct<edits:string,roles:string>>")
    done = done.select("first", F.posexplode("did").alias("k", "d")).select((F.col("first") + F.col("k")).alias("pos"), "d.edits", "d.roles")
    return scratch.keep(coded.join(done, "pos").select("key", "pos", "fault", "edits", "roles"), "edits")


def repaired(rows: DataFrame, done: DataFrame) -> DataFrame:
    """key, pos, k, edit, role, text: what the edits of ``done`` make of ``rows``, in order of pos and k."""
    each = F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.length("edits")), lambda k: F.struct(k.alias("k"), F.substring("edits", k, F.lit(1)).alias("edit"), F.substring("roles", k, F.lit(1)).alias("initial"))), lambda x: x["edit"] != "D"))
    found = rows.select("pos", "role", "text").join(done.select("key", "pos", "edits", "roles"), "pos").select("key", "pos", "role", "text", each.alias("e"))
    role = F.when(F.col("e.edit") == "K", F.col("role")).when(F.col("e.initial") == "u", "user").otherwise("assistant")
    return found.select("key", "pos", "e.k", "e.edit", role.alias("role"), F.when(F.col("e.edit") == "I", "").otherwise(F.col("text")).alias("text"))


_REPORT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = {"u": "user", "a": "assistant"}


class _Report:
    """What is summed up of one conversation while its rows go by."""

    def __init__(self, key: str):
        self.key, self.low, self.high, self.turns, self.faults, self.illegal, self.cost = key, None, None, 0, Counter(), 0, 0
        self.initial, self.audit, self.hash, self.begun = None, [], hashlib.sha256(), False

    def add(self, turn, role: str, text: str, fault, did: str, roles: str) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.faults[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        for e, r in zip(did, roles):
            if e != "D":
                line = (role if e == "K" else _NAMES[r]) + ":" + ("" if e == "I" else text)
                self.hash.update((("\n" if self.begun else "") + line).encode())
                self.begun = True
            self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[e] + TRUNCATED * (fault == "truncated" and e in "KR")
        self.audit.append(did)

    def row(self) -> tuple:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, *(self.faults[f] for f in ("blank", "duplicate", "truncated")), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation of rows that come sorted by key and pos, each followed by its edits; only the audit grows."""
    now, row = None, None
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in _REPORT.split(", ")])
    made = lambda of: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*of), schema)], schema=schema)
    for batch in batches:
        out = []
        for key, turn, role, text, fault, did, roles in zip(*(batch.column(c).to_pylist() for c in ("key", "turn", "role", "text", "fault", "edits", "roles"))):
            if now is None or key != now.key:
                if now:
                    out.append(now.row())
                now = _Report(key)
            if did is None:
                row = turn, role, text
            else:
                now.add(*row, fault, did, roles)
        if out:
            yield made(out)
    if now:
        yield made([now.row()])


def repair_report(conversations: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation after damage.

    A hash of a whole conversation is one after the other of its rows, so here its rows pass through one task, a batch at a
    time; ``edits_of`` and ``repaired`` have no such step.
    """
    scratch = Scratch(conversations.sparkSession)
    rows = placed(scratch, damaged(conversations))
    done = edits_of(scratch, faults(scratch, rows), segment, fan)
    # Rows and their edits meet by the sort, so that texts are shuffled once more and not twice.
    both = rows.unionByName(done, allowMissingColumns=True)
    both = both.repartition("key").sortWithinPartitions("key", "pos", F.col("edits").isNotNull()).drop("pos")
    found = both.mapInArrow(_reports, _REPORT)
    every = conversations.select(F.col("conv_id").alias("conv_id")).distinct()
    every = every.select("conv_id", _key(every).alias("key"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "key", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


ORACLE_SQL = r"""
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') name from conversations
), hit as (
  select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(name, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda h, b: case when b >= 0 then xor(h, b) else xor(h >> 1, 3988292384 * (h & 1)) end)) % 20 kind from raw
), dealt as (
  select conv_id, turn, case when kind = 4 then 'user' else role end role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when kind = 3 then [0, 1] else [0] end) again from hit where kind <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, again) k, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) last from dealt
), flagged as (
  select *, case when last = '' then 'blank' when row_number() over (partition by conv_id, role, text order by k) > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' end fault,
    role[1] i, lag(role[1]) over (partition by conv_id order by k) before from placed
), walk as (
  select distinct conv_id, 0::bigint k, {'c': 0::bigint, 'e': '', 'o': ''} s0, null::struct(c bigint, e varchar, o varchar) s1, null::struct(c bigint, e varchar, o varchar) s2, null::struct(c bigint, e varchar, o varchar) s3 from flagged
  union all
  select conv_id, k,
    {'c': s0.c + 2, 'e': s0.e || 'D', 'o': s0.o},
    list_min([case when s1 is not null then {'c': s1.c + 2, 'e': s1.e || 'D', 'o': s1.o} end, case when stays and i = 's' then {'c': s0.c + cut, 'e': s0.e || 'K', 'o': s0.o || chr(10) || role || ':' || text} end]),
    list_min([case when s2 is not null then {'c': s2.c + 2, 'e': s2.e || 'D', 'o': s2.o} end, case when stays then {'c': s0.c + uc, 'e': s0.e || ue, 'o': s0.o || uo} end, case when stays and s1 is not null then {'c': s1.c + uc, 'e': s1.e || ue, 'o': s1.o || uo} end,
      case when stays and s3 is not null then {'c': s3.c + uc, 'e': s3.e || ue, 'o': s3.o || uo} end, case when stays and s2 is not null then {'c': s2.c + uc + 5, 'e': s2.e || 'I' || ue, 'o': s2.o || chr(10) || 'assistant:' || uo} end]),
    list_min([case when s3 is not null then {'c': s3.c + 2, 'e': s3.e || 'D', 'o': s3.o} end, case when stays and s2 is not null then {'c': s2.c + ac, 'e': s2.e || ae, 'o': s2.o || ao} end, case when stays then {'c': s0.c + ac + 5, 'e': s0.e || 'I' || ae, 'o': s0.o || chr(10) || 'user:' || ao} end,
      case when stays and s1 is not null then {'c': s1.c + ac + 5, 'e': s1.e || 'I' || ae, 'o': s1.o || chr(10) || 'user:' || ao} end, case when stays and s3 is not null then {'c': s3.c + ac + 5, 'e': s3.e || 'I' || ae, 'o': s3.o || chr(10) || 'user:' || ao} end])
  from (select w.conv_id, f.k, s0, s1, s2, s3, i, role, text, coalesce(fault, '') not in ('blank', 'duplicate') stays, case when fault = 'truncated' then 5 else 0 end cut, cut + (i <> 'u')::int uc, case when i = 'u' then 'K' else 'R' end ue,
    chr(10) || case when i = 'u' then role else 'user' end || ':' || text uo, cut + (i <> 'a')::int ac, case when i = 'a' then 'K' else 'R' end ae, chr(10) || case when i = 'a' then role else 'assistant' end || ':' || text ao
    from walk w join flagged f on f.conv_id is not distinct from w.conv_id and f.k = w.k + 1)
), ended as (
  select conv_id, list_min([s0, s3, case when s2 is not null then {'c': s2.c + 5, 'e': s2.e || 'I', 'o': s2.o || chr(10) || 'assistant:'} end, case when s1 is not null then {'c': s1.c + 10, 'e': s1.e || 'II', 'o': s1.o || chr(10) || 'user:' || chr(10) || 'assistant:'} end]) b
  from walk qualify k = max(k) over (partition by conv_id)
), counted as (
  select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) gaps, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate, count(*) filter (fault = 'truncated') truncated,
    count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) illegal from flagged group by conv_id
)
select d.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(b.c, 0) cost, coalesce(b.e, '') audit, sha256(coalesce(b.o[2:], '')) repaired_sha256
from (select distinct conv_id from conversations) d left join ended e on e.conv_id is not distinct from d.conv_id left join counted c on c.conv_id is not distinct from d.conv_id
"""
