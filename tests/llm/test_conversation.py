"""The agenda against a search over all audits, and the whole operator against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from riskspark.llm.conversation import damage, lightest, repair_report, repaired_turns, short_repair

SHAPE = re.compile(r"(s?(ua)+)?")


def brute_repair(turns):
    """Cheapest, then ASCII-least audit over every sequence of edits (a few rows only)."""
    faults, seen = [], set()
    for role, text in turns:
        core = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "cut" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    n = len(turns)
    for places in product(range(3), repeat=n + 1):              # insertions before each row and at the end
        if sum(places) > 2:
            continue
        for edits in product("DKR", repeat=n):
            if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits)):
                continue
            free, audit, cost = [], "", 0
            for k in range(n + 1):
                audit += "I" * places[k]
                free += [(None, "")] * places[k]
                cost += 5 * places[k]
                if k < n:
                    audit += edits[k]
                    cost += {"D": 2, "K": 0, "R": 1}[edits[k]] + (5 if edits[k] != "D" and faults[k] == "cut" else 0)
                    if edits[k] != "D":
                        free.append((turns[k][0] if edits[k] == "K" else None, turns[k][1]))
            for head in ("", "s"):
                m = len(free)
                shape = (head + "ua" * m)[:m]
                if not SHAPE.fullmatch(shape) or any(r is not None and r[:1] != c for (r, _), c in zip(free, shape)) or \
                        (shape[:1] == "s" and free[0][0] is None):
                    continue
                out = "\n".join(f"{r if r is not None else {'u': 'user', 'a': 'assistant'}[c]}:{t}" for (r, t), c in zip(free, shape))
                best = min(best or (1 << 60,), (cost, audit, out))
    return faults, best


def brute_damage(rows):
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        for _ in range(1 + (k == 3)):
            yield conv, turn, "user" if k == 4 else role, text


def brute_report(rows):
    out = {conv: (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    groups = {}
    for r in brute_damage(rows):
        groups.setdefault(r[0], []).append(r[1:])
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, (cost, audit, text) = brute_repair([r[1:] for r in group])
        known = {r[0] for r in group} - {None}
        initials = [r[1][:1] for r in group]
        out[conv] = (conv, max(known) - min(known) + 1 - len(known) if known else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("cut"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return sorted(out.values(), key=repr)


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(11)
    say = ["Yes.", "no", "", " \n", "Why?", "Good!  ", "half a", "x.y", None]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, rng.choice(say)))
    rows += [(70, 1, "user", "Hi."), (70, 1, "user", "Hi."), (70, 1, "assistant", "Ho.")]
    ddl = "conv_id long, turn long, role string, text string, block string, live string"
    return rows, spark.createDataFrame([(*r, "clash", "clash") for r in rows], ddl)


def test_against_all_edits(conversations):
    rows, table = conversations
    assert sorted(map(tuple, repair_report(damage(table)).collect()), key=repr) == brute_report(rows)


def test_long_conversations_give_the_same(conversations):
    """Every conversation by the way of the long ones, in blocks."""
    rows, table = conversations
    assert sorted(map(tuple, repair_report(damage(table), long_rows=0).collect()), key=repr) == brute_report(rows)


def test_blocks_and_one_run_agree_on_a_hot_conversation(spark):
    rng = random.Random(7)
    rows = [(5, k // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"t{k}.", f"t{k}", "again.", "", "t!"])) for k in range(5000)]
    table = spark.createDataFrame(rows + [(6, 0, "user", "Only?")], "conv_id long, turn long, role string, text string")
    one = repair_report(table, long_rows=10_000).collect()
    many = repair_report(table, long_rows=1000).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    text = {r.conv_id: r.repaired_sha256 for r in one}
    for long_rows in (10_000, 1000):
        turns = [r for r in repaired_turns(table, long_rows=long_rows).orderBy("block", "at").collect() if r.conv_id == 5]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == text[5]
        assert SHAPE.fullmatch("".join(r.role[0] for r in turns))


def test_agenda_on_a_hypergraph():
    """Two premises: the value of a pair is the sum of its parts and one."""
    done = {}

    def deduce(item, value):
        done[item] = value
        for other, worth in list(done.items()):
            if len(item) + len(other) <= 4:
                yield item + other, (value[0] + worth[0] + 1, "")
    assert lightest({"a": (1, ""), "b": (3, "")}, deduce, {"aaaa", "ba"}) == {"aaaa": (7, ""), "ba": (5, "")}


def test_ties_take_the_least_audit():
    assert short_repair("u0") == (2, "D") and short_repair("") == (0, "")
    assert short_repair("a0a0") == (1, "RK") and short_repair("s0u0a0") == (0, "KKK")


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_report(damage(none)).collect() == [] and repaired_turns(none).collect() == []
