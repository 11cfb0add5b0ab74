"""Conversation repair against a search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from seatwise.llm import turn_repair

TURNS = "conv_id long, turn long, role string, text string, at long, hash string, copies int"
WHITE = " \t\n\x0b\x0c\r"


def least_edits(kinds):
    """(cost, audit) by trying all strings of edits, cheapest first, with up to two inserts before each turn and at the end."""
    best = None
    inserts = ["", "I", "II"]
    choices = [[i + e for i in inserts for e in "DKR"] for _ in kinds] + [inserts]
    for picked in itertools.product(*choices):
        cost, state, good = 0, "", True
        shown = ""
        for (initial, fault), edits in zip([*kinds, ("", 0)], picked):
            for e in edits:
                if e == "D":
                    cost += 4
                    continue
                if e in "KR" and fault == 2:
                    good = False
                cost += 3 * (e in "IR") + 3 * (e in "KR" and fault == 1)
                shown += initial if e == "K" else ("a" if shown[-1:] == "u" else "u")
        if good and re.fullmatch("(s?(ua)+)?", shown) and (best is None or (cost, "".join(picked)) < best):
            best = cost, "".join(picked)
    return best


def test_edits_are_the_least_of_all():
    rng = random.Random(1)
    for _ in range(25):
        kinds = [(rng.choice("ssuuaax") if rng.random() < 0.97 else "", rng.choice([0, 0, 1, 2])) for _ in range(rng.randint(0, 3))]
        steps = list(turn_repair.walk(kinds, turn_repair.END, turn_repair.START))
        state = steps[-1][1] if steps else turn_repair.START
        audit = "".join(s[0] for s in steps) + "I" * turn_repair.LAST_INSERTS[state]
        assert (audit, audit) == (least_edits(kinds)[1], audit), kinds


def test_blocks_compose_to_the_whole():
    rng = random.Random(2)
    for _ in range(40):
        kinds = [(rng.choice("suax"), rng.choice([0, 1, 2])) for _ in range(rng.randint(2, 40))]
        cut = rng.randint(1, len(kinds) - 1)
        middle = turn_repair.times(turn_repair.block_matrix(kinds[cut:]), turn_repair.END)
        whole = list(turn_repair.walk(kinds, turn_repair.END, 0))
        first = list(turn_repair.walk(kinds[:cut], middle, 0))
        assert whole == first + list(turn_repair.walk(kinds[cut:], turn_repair.END, first[-1][1]))


def plain_repair(rows):
    """The result for rows (turn, role, text) in order, by a table over all turns and states."""
    seen, kinds, faults = set(), [], [0, 0, 0]
    for _, role, text in rows:
        kind = 0
        if not text.strip(WHITE):
            kind = 1
        elif (role, text) in seen:
            kind = 2
        elif text.rstrip(WHITE)[-1] not in ".!?":
            kind = 3
        seen.add((role, text))
        kinds.append(kind)
        if kind:
            faults[kind - 1] += 1
    # (cost, audit, lines) of the best way to each end, memo by turn and the roles shown so far
    known = {}

    def best(at, state):
        if (at, state) in known:
            return known[at, state]
        known[at, state] = (10**9, "~", ())  # a circle of inserts is never cheapest
        following = "a" if state == "u" else "u"
        options = []
        if at == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text = rows[at]
            cost, audit, lines = best(at + 1, state)
            options.append((cost + 4, "D" + audit, lines))
            if kinds[at] not in (1, 2):
                more = 3 * (kinds[at] == 3)
                initial = role[:1]
                if (initial == "s" and state == "") or (initial == following and initial):
                    cost, audit, lines = best(at + 1, initial)
                    options.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                cost, audit, lines = best(at + 1, following)
                name = {"u": "user", "a": "assistant"}[following]
                options.append((cost + more + 3, "R" + audit, (f"{name}:{text}", *lines)))
        for n in (1, 2):
            shown, now = [], state
            for _ in range(n):
                now = "a" if now == "u" else "u"
                shown.append({"u": "user:", "a": "assistant:"}[now])
            if at == len(rows):
                if now == "a":
                    options.append((3 * n, "I" * n, tuple(shown)))
            else:
                for cost, audit, lines in straight(at, now):
                    options.append((cost + 3 * n, "I" * n + audit, (*shown, *lines)))
        known[at, state] = min(options, key=lambda o: o[:2])
        return known[at, state]

    def straight(at, state):
        """Edits of the turn itself, without inserts before it."""
        _, role, text = rows[at]
        following = "a" if state == "u" else "u"
        cost, audit, lines = best(at + 1, state)
        yield cost + 4, "D" + audit, lines
        if kinds[at] not in (1, 2):
            more = 3 * (kinds[at] == 3)
            if (role[:1] == "s" and state == "") or (role[:1] == following):
                cost, audit, lines = best(at + 1, role[:1])
                yield cost + more, "K" + audit, (f"{role}:{text}", *lines)
            cost, audit, lines = best(at + 1, following)
            yield cost + more + 3, "R" + audit, ({"u": "user", "a": "assistant"}[following] + f":{text}", *lines)

    for at in range(len(rows), -1, -1):
        for state in ("", "s", "u", "a"):
            best(at, state)
    cost, audit, lines = best(0, "")
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def plain_order(turn, role, text):
    return (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest())


def damaged(rows):
    """The conversations of rows (conv_id, turn, role, text) after damage."""
    talks = {}
    for conv, turn, role, text in rows:
        own = talks.setdefault(conv, [])
        show = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return {c: sorted(own, key=lambda r: plain_order(*r)) for c, own in talks.items()}


def check(spark_rows, rows):
    want = sorted(((c, *plain_repair(own)[0]) for c, own in damaged(rows).items()), key=repr)
    assert sorted(map(tuple, spark_rows), key=repr) == want


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "Well", " \t", "", "end. \n", "a ", "　", "line\nline.", "x" * 20_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "umpire", "user", "assistant"]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), rng.choice(roles), rng.choice([*texts, None])))
    rows += [(None, 1, "user", "hi."), (None, None, None, None), (None, 1, "user", "hi."), (None, 2, "assistant", "ok.")]
    rows += [(1000, n // 2, rng.choice(roles), f"{rng.choice(texts)} {n % 40}.") for n in range(160)]
    return rows


@pytest.mark.parametrize("block", [turn_repair.BLOCK, 4])
def test_query_on_odd_conversations(spark, talks, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    frame = spark.createDataFrame([(*r, 1, "h", 5) for r in talks], TURNS).repartition(3)
    turns = turn_repair.with_damage(frame)
    check(turn_repair.repair_conversations(turns, copies_col="copies").collect(), talks)
    lines = turn_repair.repaired_turns(turns, copies_col="copies").collect()
    shown = {}
    for r in sorted(lines, key=lambda r: (r["at"], r["place"])):
        shown.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert shown == {c: list(plain_repair(own)[1]) for c, own in damaged(talks).items() if plain_repair(own)[1]}


def test_a_turn_that_repeats_very_often(spark):
    rows = [(1, 0, "user", "Hello.")] * 300 + [(1, 1, "assistant", "Hello.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = turn_repair.repair_conversations(frame).collect()
    assert [tuple(r) for r in found] == [(1, *plain_repair([r[1:] for r in rows])[0])]


def test_no_turns_and_dropped_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert turn_repair.repair_conversations(turn_repair.with_damage(none), copies_col="copies").count() == 0
    gone = spark.createDataFrame([(7, 0, "user", "a.", 0)], "conv_id long, turn long, role string, text string, copies int")
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in turn_repair.repair_conversations(gone, copies_col="copies").collect()] == [(7, 0, 0, 0, 0, 0, 0, "", empty)]


def test_registered_query(spark, sf_dir):
    from seatwise.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(QUERIES["op11_turn_repair"](spark, sf_dir).collect(), rows)
