"""Periodic runs against a definition that tries every start and period."""

import hashlib
import random
import zlib

import pytest

from kinweave.llm import periodic_runs as P


def all_runs(words, min_words=24, min_exponent=3):
    """Every maximal stretch of smallest period q, by comparing each word with the one q later."""
    n, out = len(words), []
    for q in range(1, n):
        s = 0
        while s < n - q:
            if words[s] != words[s + q]:
                s += 1
                continue
            e = s
            while e < n - q and words[e] == words[e + q]:
                e += 1
            length = e - s + q
            if length >= max(min_words, min_exponent * q) and not any(
                    all(words[i] == words[i + d] for i in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
            s = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def spaced(words):
    return b" ".join(words).decode()


def sample(rng):
    letters = [w.encode() for w in "a b c d e".split()[:rng.choice([1, 2, 2, 3, 5])]]
    words = [rng.choice(letters) for _ in range(rng.randrange(0, 60))]
    for _ in range(rng.randrange(4)):
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 14))]
        words[rng.randrange(len(words) + 1):0] = (unit * 9)[:rng.randrange(1, 7 * len(unit))]
    return words


def test_runs_equal_the_definition():
    rng = random.Random(3)
    found = 0
    for _ in range(1500):
        words = sample(rng)
        want = all_runs(words)
        assert P.find_runs(words) == want
        found += len(want)
    assert found > 500


def test_automaton_without_narrowing_finds_short_runs_too():
    rng = random.Random(4)
    for _ in range(600):
        words = sample(rng)
        codes = [ord(w) for w in words]
        assert sorted(P.RunFinder(codes).runs(2, 2), key=lambda r: (r[0], r[2])) == all_runs(words, 2, 2)


def test_words_with_strings_of_fibonacci_and_long_texts():
    a, b = [b"x"], [b"x", b"y"]
    while len(b) < 1500:
        a, b = b, b + a
    assert P.find_runs(b) == all_runs(b)
    assert P.find_runs([b"w"] * 200_000) == [(0, 200_000, 1)]
    unit = [str(i).encode() for i in range(5000)]
    assert P.find_runs([b"before"] + unit * 4) == [(1, 20_000, 5000)]
    assert P.find_runs([str(i).encode() for i in range(200_000)]) == []


def test_collapse_keeps_what_some_run_keeps_first():
    words = b"p q a b a b a b r".split()
    assert P.collapse(words, [(2, 6, 2)]) == b"p q a b r".split()
    rng = random.Random(8)
    for _ in range(300):
        words = sample(rng)
        runs = all_runs(words)
        assert P.collapse(words, runs) == [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = looped(doc_id, (text or "").encode().split()) if doc_id is not None else (text or "").encode().split()
    runs = all_runs(words)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    odd = [(None, "a b " * 40), (None, None), (1, None), (2, ""), (3, " \t\n\v\f\r "), (4, "one"), (4, "one"), (5, "é x y\x1cz " * 30),
           (6, " ".join(str(i) for i in range(4000))), (7, "a  b\ta\nb " * 20)]
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 400))) for _ in range(250)]
    return odd + [(100 + i, t) for i, t in enumerate(texts)] + [(900 + i, spaced(sample(rng))) for i in range(150)]


def test_query_equals_the_definition(spark, rows):
    docs = spark.createDataFrame([(i, t, "runs", 1) for i, t in rows], "doc_id long, text string, n_runs string, words long")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in P.run_report(P.with_loops(docs)).collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 60


def test_empty_table_and_real_output(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.run_report(P.with_loops(none)).collect() == []
    one = P.periodic_runs(spark.createDataFrame([("k", "go " + "to be " * 12 + "end")], "id string, body string"), "id", "body").first()
    assert (one["id"], one["n_words"], one["collapsed"]) == ("k", 26, "go to be end")
    assert [tuple(r) for r in one["runs"]] == [(1, 24, 2)]
