"""op11 against a plain search over whole edit strings, with segments of few rows so that conversations span several."""

import hashlib
import random
import zlib

import pytest

from leafmill.llm import repair

TURNS = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, lines) by keeping, for each state, the best whole string of edits so far."""
    best = {"": (0, "", [])}
    def put(into, state, entry):
        if state not in into or entry[:2] < into[state][:2]:
            into[state] = entry
    after = {"": {"u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    def inserted(states):
        out, todo = dict(states), list(states.items())
        while todo:
            s, (c, e, lines) = todo.pop()
            for i, t in after[s].items():
                new = (c + 5, e + "I", lines + [names[i] + ":"])
                if len(new[1]) <= 3 * len(rows) + 2 and (t not in out or new[:2] < out[t][:2]):
                    out[t] = new
                    todo.append((t, new))
        return out
    for role, text, fault in rows:
        new = {}
        for s, (c, e, lines) in inserted(best).items():
            put(new, s, (c + 2, e + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if role[:1] in after[s] or (s == "" and role[:1] == "s"):
                put(new, role[:1], (c + more, e + "K", lines + [f"{role}:{text}"]))
            for i, t in after[s].items():
                put(new, t, (c + more + 1, e + "R", lines + [f"{names[i]}:{text}"]))
        best = new
    return min(v for s, v in inserted(best).items() if s in ("", "a"))


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        own = convs.setdefault(c, [])
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        own += [(turn is not None, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        seen, flagged = set(), []
        for _, _, role, text in own:
            end = text.rstrip(BLANK)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
            seen.add((role, text))
            flagged.append((role, text, fault))
        turns = [r[1] for r in own if r[0]]
        cost, audit, lines = cheapest(flagged) if flagged else (0, "", [])
        initials = [r[:1] for r, _, _ in flagged]
        yield (
            c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == k for _, _, f in flagged) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )


def same(spark, rows, **how):
    got = repair.repair_report(spark.createDataFrame(rows, TURNS), **how).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def some(seed, n, long=0):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "ant"]
    for c in range(n):
        turn = rng.randrange(5)
        for _ in range(long if c == 0 and long else rng.randrange(1, 12)):
            rows.append((c, turn, rng.choice(roles), rng.choice(["Yes.", "A cut", "ok!  ", "", "b?\n", " \t", f"t{rng.randrange(99)}.", f"t{rng.randrange(99)}"])))
            turn += rng.choice([1, 1, 1, 2, 5])
    return rows


@pytest.mark.parametrize("segment, fan", [(1, 2), (2, 3), (5, 2), (1024, 64)])
def test_equals_a_plain_search(spark, segment, fan):
    same(spark, some(segment, 60, 70), segment=segment, fan=fan)


def test_all_short_patterns():
    """Every conversation of up to five codes: the divide and conquer equals the search."""
    import itertools

    rows = {"s": ("s", "1.", None), "u": ("u", "1.", None), "a": ("a", "1.", None), "o": ("o", "1.", None), "U": ("u", "1", "truncated"), "A": ("a", "1", "truncated"), "S": ("s", "1", "truncated"), "x": ("u", "", "blank")}
    for n in range(1, 6):
        for codes in itertools.product(rows, repeat=n) if n < 5 else random.Random(0).sample(list(itertools.product(rows, repeat=5)), 4000):
            tables = [repair.row_table(c) for c in codes]
            costs, order, base = repair.forward(tables, repair.NOTHING)
            end = repair.last_state(costs, order)
            audit = "".join(e for e, _ in repair.edits("".join(codes), repair.NOTHING, end, True))
            cost, want, _ = cheapest([rows[c] for c in codes])
            assert (base + costs[end] + 5 * len(repair._MISSING[end]), audit) == (cost, want), codes


def test_cases(spark):
    long = "word " * 100000 + "."
    rows = [(1, None, None, None), (1, None, "user", "a."), (1, 5, "assistant", long), (1, 5, "assistant", long), (None, 1, "user", "Hi."), (None, None, None, "x"), (2, 1, "user", ""), (3, 2**60, "s", "x"), (3, 2**60 + 1, "ü", "é.")]
    rows += [(9, t, "user", "The same text.") for t in range(300)]
    same(spark, rows, segment=7, fan=3)
    same(spark, rows)
    assert repair.repair_report(spark.createDataFrame([], TURNS)).collect() == []
    extra = spark.createDataFrame(some(3, 30), TURNS).selectExpr("*", "1 key", "'x' pos", "2 node", "3 edits", "4 kind", "5 copy", "6 same", "7 part", "8 idx")
    assert sorted(map(tuple, repair.repair_report(extra).collect()), key=str) == sorted(brute(some(3, 30)), key=str)


def test_repaired_rows_hash_to_the_report(spark):
    from leafmill.llm.common import Scratch

    scratch, conversations = Scratch(spark), spark.createDataFrame(some(8, 40), TURNS)
    rows = repair.placed(scratch, repair.damaged(conversations))
    done = repair.edits_of(scratch, repair.faults(scratch, rows), 4, 2)
    lines = {}
    for r in repair.repaired(rows, done).orderBy("pos", "k").collect():
        lines.setdefault(r.key, []).append(f"{r.role}:{r.text}")
    for r in repair.repair_report(conversations).collect():
        assert hashlib.sha256("\n".join(lines.get(str(r.conv_id), [])).encode()).hexdigest() == r.repaired_sha256
