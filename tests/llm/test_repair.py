"""Conversation repair against all ways to edit, and against a programme over strings."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from cadenza.llm import repair
from tests.conftest import rows

GOAL = re.compile(r"(s?(ua)+)?")
LINES = ["Yes.", "No!", "and then", "", " \t\x0b", "Why? ", "Yes."]


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(turns):
    """Least (cost, audit, lines) of all edits, with up to two insertions in each gap."""
    best = None
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    options = [["D"] if f in ("blank", "duplicate") else ["D", "K", "user", "assistant"] for f in faults(turns)]
    for edits in product(*options):
        for inserted in product(gaps, repeat=len(turns) + 1):
            cost, audit, lines = 0, "", []
            for k in range(len(turns) + 1):
                for role in inserted[k]:
                    cost, audit = cost + 2, audit + "I"
                    lines.append((role, ""))
                if k < len(turns):
                    edit, (role, text) = edits[k], turns[k]
                    if edit == "D":
                        cost, audit = cost + 3, audit + "D"
                    else:
                        cost += (0 if edit == "K" else 2) + (faults(turns)[k] == "truncated")
                        audit += "K" if edit == "K" else "R"
                        lines.append((role if edit == "K" else edit, text))
            if GOAL.fullmatch("".join(r[:1] or "?" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def by_strings(turns):
    """The same by states, with whole audits."""
    states = {"": (0, "", [])}

    def better(into, state, option):
        if state not in into or option[:2] < into[state][:2]:
            into[state] = option

    def closed(now):
        out = dict(now)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                role = "assistant" if state == "u" else "user"
                better(out, role[0], (cost + 2, audit + "I", [*lines, (role, "")]))
        return out

    for (role, text), fault in zip(turns, faults(turns), strict=True):
        new = {}
        for state, (cost, audit, lines) in closed(states).items():
            better(new, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            for edit, initial, line in [("K", role[:1], (role, text)), ("R", "u", ("user", text)), ("R", "a", ("assistant", text))]:
                if initial and (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    better(new, initial, (cost + 2 * (edit == "R") + (fault == "truncated"), audit + edit, [*lines, line]))
        states = new
    return min((x for state, x in closed(states).items() if state in ("", "a")), key=lambda x: x[:2])


def by_class(turns):
    lines = []
    one = repair.Repair(lambda edit, turn, role, text: lines.append((role, text)))
    for k, ((role, text), fault) in enumerate(zip(turns, faults(turns), strict=True)):
        one.add(k, role, text, ["", "blank", "duplicate", "truncated"].index(fault))
    return (*one.finish(), lines)


@pytest.mark.parametrize("every", [1, 1024])
def test_least_of_all_edits(monkeypatch, every):
    monkeypatch.setattr(repair, "WRITE_EVERY", every)
    r = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", " ", "ua"]
    for k in range(120):
        turns = [(r.choice(roles), r.choice(LINES)) for _ in range(k % 4)]
        assert by_class(turns) == by_strings(turns) == brute(turns), turns


@pytest.mark.parametrize("every", [1, 7, 1024])
def test_long_conversations(monkeypatch, every):
    monkeypatch.setattr(repair, "WRITE_EVERY", every)
    r = random.Random(every)
    for n in (20, 60, 300):
        for weights in ((5, 5, 1, 1), (1, 9, 1, 0), (1, 1, 9, 9)):
            turns = [(r.choices(["user", "assistant", "system", "tool"], weights)[0], r.choice(LINES) + str(r.randrange(9)) * (r.random() < 0.5) + r.choice([".", ""])) for _ in range(n)]
            assert by_class(turns) == by_strings(turns)


def test_long_conversations_are_not_held(monkeypatch):
    monkeypatch.setattr(repair, "WRITE_EVERY", 64)
    one, most = repair.Repair(lambda *x: None), 0
    for k in range(5000):
        one.add(k, ["user", "assistant", "user"][k % 3], f"text {k}.", 0)
        most = max(most, one.open)
    assert most <= 130
    assert len(one.finish()[1]) >= 5000


def test_whole_operator(spark):
    """Damage, faults, order and digest of a made table with nulls, ties, copies and clashing names."""
    r = random.Random(8)
    made = [(r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, *range(9)]), r.choice([None, "user", "assistant", "system", "", "tool"]), r.choice([None, "A b. c!", *LINES])) for _ in range(300)]
    made += [(7, 1, "user", "once"), (8, None, None, None)] + [(x, 0, "user", "gone?") for x in range(100, 140)]
    df = spark.createDataFrame([(*x, 0, 1) for x in made], "conv_id long, turn long, role string, text string, there int, fault int")
    got = {x.conv_id: x for x in repair.repairs(repair.damaged(df)).collect()}
    lines = {}
    for x in repair.repaired(repair.damaged(df)).orderBy("conv", "position").collect():
        lines.setdefault(x.conv, []).append(f"{x.role}:{x.text}")
    assert set(got) == {x[0] for x in made}
    for conv in got:
        after = []
        for c, turn, role, text in made:
            role, text = " " if role is None else role, " " if text is None else text
            if c == conv:
                kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                after += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        after.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        turns, numbers = [x[2:] for x in after], [x[1] for x in after if x[0]]
        cost, audit, fixed = by_strings(turns)
        want = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[faults(turns).count(f) for f in ("blank", "duplicate", "truncated")],
                sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])), cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in fixed).encode()).hexdigest())
        assert tuple(got[conv])[1:] == want, conv
        assert lines.get(conv, []) == [f"{a}:{b}" for a, b in fixed]
    assert any(not x.audit for x in got.values())
    assert repair.repairs(repair.damaged(df.limit(0))).collect() == []


def test_sql_agrees(spark, duck, sf_dir):
    assert rows(repair.op12_repair(spark, sf_dir)) == rows(duck.sql(repair.OP12_SQL))


def test_one_shuffle(spark, sf_dir):
    plan = repair.op12_repair(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
