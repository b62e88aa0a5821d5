"""Conversation repair against a plain recursion over all edits."""

import hashlib
import re
import zlib
from functools import lru_cache

import pytest

from webcairn.llm import conversations as C
from webcairn.llm.common import table

SF = "/root/testdata/sf0.001"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
MADE = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired rows of one conversation."""
    md5 = lambda t: hashlib.md5(t.encode()).digest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], md5(r[3])))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, kinds = set(), []
    for _, _, role, text in rows:
        solid = re.findall("[^\x20\x09-\x0d]", text)
        kinds.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    @lru_cache(None)
    def best(i, state, inserts):
        picks = []
        if i == len(rows) and state in (0, 3):
            picks.append((0, "", ()))
        if inserts < 3:
            role = MADE[state]
            c, a, r = best(i, NEXT[state][role[0]], inserts + 1)
            picks.append((c + 3, "I" + a, ((role, ""), *r)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, a, r = best(i + 1, state, 0)
            picks.append((c + 4, "D" + a, r))
            if kinds[i] not in ("b", "d") or not kinds[i]:
                spare = 3 if kinds[i] == "t" else 0
                if role[:1] in NEXT[state]:
                    c, a, r = best(i + 1, NEXT[state][role[:1]], 0)
                    picks.append((c + spare, "K" + a, ((role, text), *r)))
                for made in ("user", "assistant"):
                    if made[0] in NEXT[state]:
                        c, a, r = best(i + 1, NEXT[state][made[0]], 0)
                        picks.append((c + spare + 3, "R" + a, ((made, text), *r)))
        return min(picks, key=lambda p: p[:2]) if picks else (1 << 50, "", ())

    cost, audit, made = best(0, 0, 0)
    return gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, list(made)


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def rows_of(seed=0, n=60):
    import random

    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randrange(0, 14)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ukn"])
            text = rnd.choice(["Yes.", "No!", "cut off", "  \n\t", "", None, "What? ", "end.\n", "x ", "A. ", "𝔘."])
            rows.append((None if c == 0 else c, rnd.choice([t, t, t, t + 2, None]), role, text))
    return rows + rows[:7]


@pytest.mark.parametrize("block, fan", [(C.BLOCK, C.FAN), (3, 2)])
def test_repair_equals_recursion(spark, block, fan):
    rows = rows_of()
    df = spark.createDataFrame(rows, "conv_id int, turn bigint, role string, text string").selectExpr(
        "conv_id", "turn", "role", "text", "1 as conv", "2 as at", "3 as block"
    )
    got = C.Repair(df, block=block, fan=fan)
    report = {r.conv: r for r in got.report().collect()}
    sha = {r.conv: r.sha for r in got.digests().collect()}
    made = by_conversation([(r.conv_id, r.place, r.role, r.text) for r in got.repaired().collect()])
    value = lambda x: " " if x is None else x
    want = by_conversation([(c, t, value(r), value(x)) for c, t, r, x in rows])
    assert len(report) == len(want)
    for conv, held in want.items():
        *numbers, audit, out = repair(held)
        key = "" if conv is None else f"c{conv}"
        r = report[key]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == [*numbers, audit]
        assert [x[2:] for x in sorted(made.get(conv, []))] == out
        if out:
            assert sha[key] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
        else:
            assert key not in sha


def test_long_conversation(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"turn {t % 50}." if t % 5 else "cut") for t in range(180)]
    df = spark.createDataFrame(rows, "conv_id int, turn bigint, role string, text string")
    one, two = (C.Repair(df, block=b, fan=f).report().first() for b, f in ((1024, 1024), (16, 4)))
    assert one == two and one.audit == repair(rows)[6] and one.cost == repair(rows)[5]


def test_query(spark):
    got = {r.conv_id: r for r in C.op13_conversation_repair(spark, SF).collect()}
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    held = by_conversation(damage(rows))
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        *numbers, audit, out = repair(held.get(conv, []))
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
        assert list(r)[1:] == [*numbers, audit, sha]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op13_conversation_repair(spark, str(tmp_path)).count() == 0
