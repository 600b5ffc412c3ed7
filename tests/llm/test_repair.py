import hashlib
import heapq
import random
import zlib

import pytest

from crawlwright.llm import repair

SPACE = " \t\n\x0b\x0c\r"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if harm == 1 else "".join(c for c in text if c not in ".!?") if harm == 2 else text
        out += [(conv, turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) by best-first search over (rows read, roles so far in short): no merging but of finished positions."""
    queue, done, n = [(0, "", 0, "e", ())], set(), 0
    while queue:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if (at, state) in done:
            continue
        if at == len(rows) and state in "ep":
            return cost, audit, lines
        done.add((at, state))
        after = {"e": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "p"}, "p": {"u": "u"}}[state]
        words = {"u": "user", "a": "assistant"}
        for initial, to in after.items():
            if initial in words:
                heapq.heappush(queue, (cost + 3, audit + "I", at, to, lines + (words[initial] + ":",)))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for initial, to in after.items():
                    if role[:1] == initial:
                        heapq.heappush(queue, (cost + more, audit + "K", at + 1, to, lines + (f"{role}:{text}",)))
                    if initial in words:
                        heapq.heappush(queue, (cost + more + 3, audit + "R", at + 1, to, lines + (f"{words[initial]}:{text}",)))
    raise AssertionError("no repair")


def slow(rows, damage=True):
    kept = {}
    for r in rows:
        kept.setdefault(r[0], [])
    for r in (harmed(rows) if damage else rows):
        kept[r[0]].append((r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    out = []
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        judged, seen = [], set()
        for _, role, text in own:
            last = text.strip(SPACE)[-1:]
            judged.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        roles = [r[:1] for r, *_ in judged]
        cost, audit, lines = cheapest(judged)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == x for *_, f in judged) for x in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(own), len(lines)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id bigint, turn int, role string, text string, cost int, k1 string")


def check(spark, rows, damage=True):
    df = frame(spark, rows)
    got = repair.repair_conversations(repair.damaged(df) if damage else df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(slow(rows, damage), key=str)


def test_whole_table(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("damage", [False, True])
def test_random_talks(spark, damage):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", None, "agent", "user", "assistant"]),
             rng.choice(["Fine.", "Fine", "", " \n", None, "Yes!", "é?  ", "　", f"row {i}."])) for i in range(400)]
    check(spark, rows + rows[:30], damage)


def test_edges(spark):
    check(spark, [])
    check(spark, [(1, 0, "user", "a" * 300_000 + "."), (1, 1, "assistant", " " * 5000), (2, None, None, None), (3, 5, "system", "Only this.")], False)
    dropped = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    check(spark, [(dropped, 0, "user", "Gone.")])
    assert repair.repair_conversations(repair.damaged(frame(spark, [(dropped, 0, "user", "Gone.")]))).first()["audit"] == ""


def test_one_conversation_holds_most_rows(spark):
    """Its audit is put aside piece by piece."""
    rng = random.Random(1)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"Answer {i}.", f"broken {i}"])) for i in range(3000)]
    check(spark, rows + [(i, 0, "user", "Hi.") for i in range(100, 160)], False)
