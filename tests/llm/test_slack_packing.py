"""Minimum bin slack against exhaustive fills, whole-text tokenising and the rules of the sequences."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinweave.llm import slack_packing as S

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_closest_fill_equals_trying_all():
    rng = random.Random(1)
    for _ in range(300):
        left = {rng.randrange(1, 25): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        room = rng.randrange(0, 60)
        lengths = sorted((n for n in left if n <= room), reverse=True)
        used = S.closest_fill(lengths, left, room)
        best = max((s for s in (sum(n * k for n, k in zip(lengths, ks)) for ks in itertools.product(*(range(left[n] + 1) for n in lengths))) if s <= room), default=0)
        assert sum(n * k for n, k in used.items()) == best and all(k <= left[n] for n, k in used.items())


def laid_out(counts, capacity):
    """Sequences as lists of (offset, take), after checking that each piece is covered once."""
    plan, rows, covered = S.Plan(counts, capacity), {}, {}
    for of, low, high, skip, take, first, sequence, per, at in plan.places:
        for rank in range(low, high):
            item = first + rank - low
            rows.setdefault(sequence + item // per, []).append((at + item % per * take, take))
            covered.setdefault((of, rank), []).append((skip, take))
    assert set(covered) == {(n, r) for n, c in counts.items() for r in range(c)}
    for (of, _), spans in covered.items():
        spans.sort()
        assert [s for s, _ in spans] == list(itertools.accumulate((t for _, t in spans[:-1]), initial=0)) and sum(t for _, t in spans) == of
    assert sorted(rows) == list(range(plan.sequences))
    for items in rows.values():
        items.sort()
        assert [s for s, _ in items] == list(itertools.accumulate((t for _, t in items[:-1]), initial=0))
    return list(rows.values()), covered


def test_plans_fill_every_sequence():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([16, 64, 256])
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 40) for _ in range(rng.randrange(0, 20))}
        rows, covered = laid_out(counts, capacity)
        sizes = sorted(sum(t for _, t in items) for items in rows)
        short = [s for s in sizes if s != capacity]
        assert all(s & s - 1 == 0 for s in sizes) and len(set(short)) == len(short)


def test_cuts_are_rare_where_lengths_differ():
    rng = random.Random(3)
    counts = {n: rng.randrange(0, 30) for n in range(1, 700)}
    rows, covered = laid_out(counts, 2048)
    assert sum(len(spans) - 1 for spans in covered.values()) < 20
    rows, covered = laid_out({1500: 10_000}, 2048)  # one length that never fills a window: pieces must be cut
    assert sum(sum(t for _, t in items) == 2048 for items in rows) == 1500 * 10_000 // 2048


def test_words_give_the_ids_of_whole_texts(spark, tokenizer):
    ids = S.WordIds(PATH, True)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rng = random.Random(4)
    alphabet = "aA zé ÉßŉİΣσςǅ.,;:!?'’s'll’t 09½²<|endoftext|>\n\t\r\x0b\x0c\x1c\x85  ́é‍한中\U0001F600ẞﬁ"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["it's. I'LL, we're; 'S x.'s a.b ...! é.,É", "<|endoftext|> <|STARTOFTEXT|>.", "a" * 100_000, "x%%% É***,' don't' d'*s ''s a'... <|e|>. ≠ a≠ é̂. H̱. ẖ ", "." * 200 + "x" + "." * 200, "w" * 70 + ". " + "w" * 70 + "."]
    for text in texts:
        assert np.frombuffer(ids.of(text.encode()), "<u4").tolist() == whole(tokenizer, text)[:-1], text[:80]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(S, "KNOWN_WORDS", 3)
    few, many = S.WordIds(PATH, True), S.WordIds(PATH, True)
    monkeypatch.setattr(S, "KNOWN_BYTES", 2)
    for text in (b"one two three four", b"five one six", b"two seven one nine ten", b"one two three four"):
        got = few.of(text)
        monkeypatch.setattr(S, "KNOWN_WORDS", 10 ** 6)
        assert got == many.of(text)
        monkeypatch.setattr(S, "KNOWN_WORDS", 3)


def check(rows, texts, tokenizer, capacity=2048):
    """Every id of every document in exactly one piece, sequences without gap, padding only below a power of two."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    ids = {}
    for i, text in texts:
        ids.setdefault(i, []).append(whole(tokenizer, text))
    for i, own in docs.items():
        copies = ids[i]
        assert sum(r["length"] for r in own) == sum(map(len, copies))
        for r in own:
            assert any(r["doc_tokens"] == len(c) and r["ids_crc32"] == zlib.crc32(np.array(c[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) for c in copies)
        if len(copies) == 1:
            own = sorted(own, key=lambda r: r["start"])
            assert [r["start"] for r in own] == list(itertools.accumulate((r["length"] for r in own[:-1]), initial=0))
    assert set(docs) == set(ids)
    for items in sequences.values():
        items.sort()
        assert [s for s, _ in items] == list(itertools.accumulate((n for _, n in items[:-1]), initial=0))
        size = sum(n for _, n in items)
        assert size <= capacity and size & size - 1 == 0


def test_report_on_whole_table_and_odd_rows(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(S.slack_report(docs, PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)
    odd = [(None, None), (None, "null id"), (1, None), (2, ""), (3, "two words"), (3, "two words"), (4, "x y z " * 5000), (5, "end")]
    table = spark.createDataFrame([(i, t, 1, "clash") for i, t in odd], "doc_id long, text string, length long, ids string").repartition(3)
    check(S.slack_report(table, PATH).collect(), odd, tokenizer)
    assert S.slack_report(table.limit(0), PATH).collect() == []


def test_equal_lengths_are_cut_and_ids_come_back(spark, tokenizer):
    texts = [(i, " ".join(["word"] * 29)) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    check(S.slack_report(docs, PATH, capacity=64).collect(), texts, tokenizer, 64)
    pieces = S.token_pieces(docs, PATH, capacity=64)
    for r in S.placed_ids(S.place(pieces, 64), pieces).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == whole(tokenizer, texts[r["id"]][1])[r["start"]:r["start"] + r["length"]]


def test_other_tokenizers_read_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    r = S.token_pieces(spark.createDataFrame([("k", " a  b.")], "id string, body string"), path, "id", "body", by_word=False).first()
    assert np.frombuffer(r["ids"], "<u4").tolist() == [*t.encode(" a  b.").ids, 1]
