"""Turn repair against a shortest-path search over edit strings, with chunks of any size."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from kinweave.llm import turn_repair as R

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(turns):
    """(cost, audit, lines): Dijkstra over (turn, last initial), ordered by cost, then letters."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in ("", "a"):
            return cost, audit, list(lines)
        for x, name in (("u", "user"), ("a", "assistant")):
            if x in NEXT[state]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, x, (*lines, f"{name}:")))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if fault in ("", "truncated"):
                extra = 5 * (fault == "truncated")
                if role[:1] in NEXT[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if x in NEXT[state]:
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, x, (*lines, f"{name}:{text}")))


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        for _ in range(1 + (h == 3)):
            yield conv, turn, "user" if h == 4 else role, text


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def expected(rows):
    convs = {}
    for conv, *_ in rows:
        convs.setdefault(conv, [])
    for conv, turn, role, text in damage(rows):
        convs[conv].append((turn, role, text))
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[1], r[2])))
        turns, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, role, text in own:
            ink = text.strip(SPACE)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            turns.append((role, text, fault))
        numbers = [t for t, *_ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(turns)
        yield (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, audit string, head long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)


def report(spark, rows):
    docs = table(spark, rows)
    return sorted((tuple(r[c] for c in COLUMNS) for r in R.repair_report(docs, R.damaged(docs)).collect()), key=repr)


def conversation(rng, conv, n):
    rows = []
    for turn in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u", None]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
        text = rng.choice(["Yes.", "No", "", " \n", "What?\t", None, "é…", "a.b", "x!\x1c"]) if rng.random() < 0.4 else f"text {rng.randrange(10 ** 6)}."
        rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    return rows


@pytest.mark.parametrize("bits", [0, 2, 9])
def test_report_equals_shortest_paths(spark, monkeypatch, bits):
    monkeypatch.setattr(R, "CHUNK_BITS", bits)
    rng = random.Random(bits)
    rows = [r for c in range(40 if bits else 12) for r in conversation(rng, c, rng.randrange(1, 9))]
    rows += conversation(rng, 1000, 150 if bits else 20) + conversation(rng, None, 40 if bits else 7)
    rows += [(2000, t, "user", "only user turns.") for t in range(10)] + [(3000, None, None, None), (4000, 0, "system", "Alone.")]
    rows += [(5000, 7, "user", "same.")] * 5 + [(6000, t, ("user", "assistant")[t % 2], f"fine {t}.") for t in range(60)]
    dropped = next(c for c in range(7000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    want = sorted(expected(rows), key=repr)
    got = report(spark, rows)
    assert got == want
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_vectors_converge_and_mending_stops_early():
    rng = random.Random(5)
    for _ in range(300):
        letters = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 30)))
        old, new = (tuple(rng.randrange(8) for _ in range(4)) for _ in range(2))
        old, new = (tuple(x - min(v) for x in v) for v in (old, new))
        assert R.mend(letters, old, new, *R.backward(letters, old)) == R.backward(letters, new)
    long = "".join(rng.choice("ejeijf") for _ in range(400))
    assert R.backward(long, (0, 7, 3, 1))[0] == R.backward(long, R._END)[0]


def test_repaired_turns_are_in_order_and_well_formed(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_BITS", 2)
    rng = random.Random(9)
    rows = [r for c in range(20) for r in conversation(rng, c, rng.randrange(1, 30))]
    out = R.repaired_turns(table(spark, rows)).orderBy("conv_id", "place", "step").collect()
    roles = {}
    for r in out:
        roles[r["conv_id"]] = roles.get(r["conv_id"], "") + r["role"][0]
    assert roles and all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values())


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.repair_report(none, R.damaged(none)).collect() == []
    assert R.repaired_turns(none).collect() == []
