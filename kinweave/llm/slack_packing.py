"""Packing of tokenised documents into sequences by minimum bin slack.

Documents are tokenised once and cut into pieces of at most ``capacity`` ids, which are written out with their ids.
The plan needs only how many pieces there are of each length. It fills one kind of window at a time: the longest
length leads, a subset-sum over bit sets (one bit for each fill, lengths taken as often as they are left) finds
the multiset of remaining lengths that comes closest to the capacity, and it is traced back to a count of each
length. The window is then repeated as often as those counts allow. Where no multiset fills a window, one more
piece is cut to fill it, and its rest goes back into the plan. What remains below one window at the end fills
windows of powers of two in the same way. So no sequence is padded, whatever the lengths are.

Pieces find their place by rank among those of equal length: each task numbers its own, sums over tasks number
them all. Counters, numbers and places move, ids do not, unless asked for. The plan reads one counter for each
length, at most ``capacity`` of them, whatever the input; a length with a third of all rows is dealt by task.

Defined cases: a null or empty text is its end mark alone; a null identifier passes through; repeated rows are
packed one by one; columns other than identifier and text are left out, so none can clash; an empty table
gives an empty result. Ranks follow the order in which tasks read rows, fixed once the pieces are written.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right, insort
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.words import small_batches
from kinweave.session import stage

CAPACITY = 2048
END_ID = 1
#: Words, and stems of words, whose ids a Python worker remembers, and the longest of them in bytes.
KNOWN_WORDS = 700_000
KNOWN_BYTES = 64


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    ``by_word`` is for tokenizers that drop white space, fold case and keep runs of letters apart from all
    else, like those with word ends: then texts can be tokenised word by word and words are remembered.
    """

    def __init__(self, path: str, by_word: bool) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # strings of special tokens are ordinary text here
        self.letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.by_word = by_word
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        body = text.rstrip(punctuation)
        stem = body.lower()
        if not stem.isalpha() or max(stem) >= "ɐ":
            return _packed(self._whole(text))
        # Latin letters are one unit of the vocabulary's merges; a tail of punctuation is units of its own
        ids = self.stems.get(stem)
        if ids is None:
            unit = stem if stem.isascii() else self.letters.pre_tokenize_str(stem)[0][0]
            ids = _packed([t.id for t in self.tokenizer.model.tokenize(unit)])
            if len(stem) <= KNOWN_BYTES:
                self.stems[stem] = ids
        if len(body) == len(text):
            return ids
        tail = text[len(body):]
        if tail not in self.tails:
            found = _packed(self._whole(tail))
            if len(tail) > KNOWN_BYTES or len(self.tails) > KNOWN_WORDS:
                return ids + found
            self.tails[tail] = found
        return ids + self.tails[tail]

    def of(self, text: bytes) -> bytes:
        if not self.by_word:
            return _packed(self._whole(text.decode()))
        words = text.split()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        if len(self.stems) > KNOWN_WORDS:
            self.stems.clear()
        new = {w: self._word(w) for w in set(words).difference(self.known)}
        ids = b"".join([new[w] if w in new else self.known[w] for w in words])
        self.known.update((w, x) for w, x in new.items() if len(w) <= KNOWN_BYTES)
        return ids


@lru_cache(maxsize=1)
def _word_ids(path: str, by_word: bool) -> WordIds:
    return WordIds(path, by_word)


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, by_word: bool = True) -> DataFrame:
    """(part, n, id, start, length, rank, crc, doc_tokens, ids), written out: piece ``n`` of task ``part`` holds
    ``length`` ids from id ``start`` of its document; ``rank`` counts the pieces of its length in the task."""
    small_batches(docs.sparkSession)
    id_kind = docs.schema[id_col].dataType.simpleString()
    end = _packed([end_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, n, seen = _word_ids(tokenizer, by_word), TaskContext.get().partitionId(), 0, Counter()
        for batch in batches:
            rows: list[tuple] = []
            of_row: list[int] = []
            for k, text in enumerate(batch.column(1).cast(pa.large_binary())):
                ids = words.of(text.as_py() or b"") + end
                for start in range(0, len(ids), 4 * capacity):
                    piece = ids[start:start + 4 * capacity]
                    length = len(piece) // 4
                    rows.append((n, start // 4, length, seen[length], zlib.crc32(piece), len(ids) // 4, piece))
                    of_row.append(k)
                    seen[length] += 1
                    n += 1
            columns = list(zip(*rows)) if rows else [()] * 7
            numbers = [pa.array(c, pa.int64()) for c in columns[:6]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int32()), numbers[0], batch.column(0).take(pa.array(of_row, pa.int64())), *numbers[1:],
                 pa.array(columns[6], pa.binary())], ["part", "n", "id", "start", "length", "rank", "crc", "doc_tokens", "ids"])

    return stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"part int, n long, id {id_kind}, start long, length long, rank long, crc long, doc_tokens long, ids binary"), "token_pieces")


def closest_fill(lengths: list[int], left: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each of ``lengths`` (descending; at most ``left`` times) so that the sum comes closest to ``room`` from below."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in lengths:
        before, more, chunk = reach, min(left[length], room // length), 1
        while more > 0:
            chunk = min(chunk, more)
            reach |= reach << chunk * length & mask
            more -= chunk
            chunk *= 2
        if reach != before:
            steps.append((length, before))
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> at & 1:
            at -= length
            used[length] = used.get(length, 0) + 1
    return used


class Plan:
    """Windows over piece counts. Pieces of one length are ranks ``low`` to ``high``; a cut piece goes on as its
    rest, the same ranks less ``skip`` ids. ``places`` holds (length, low, high, skip, take, first, sequence, per, offset):
    ``take`` ids of each such piece are the items ``first`` onwards of windows from ``sequence`` on, ``per`` in each
    window, the first at ``offset``."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = {n: c for n, c in counts.items() if c}
        self.order = sorted(self.left)
        self.pool = {n: deque([(n, 0, c, 0)]) for n, c in self.left.items()}
        self.total = sum(n * c for n, c in self.left.items())
        self.sequences = 0
        self.places: list[tuple[int, ...]] = []
        while self.total:
            self._window()

    def _take(self, length: int, count: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(length, low, high, skip, first) of ``count`` items of a length; ``first`` counts those handed out before."""
        groups, first = self.pool[length], 0
        while first < count:
            of, low, high, skip = groups.popleft()
            some = min(count - first, high - low)
            if low + some < high:
                groups.appendleft((of, low + some, high, skip))
            yield of, low, low + some, skip, first
            first += some
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length], self.pool[length]
            self.order.remove(length)

    def _give(self, length: int, group: tuple[int, int, int, int]) -> None:
        if length not in self.left:
            self.left[length], self.pool[length] = 0, deque()
            insort(self.order, length)
        self.left[length] += group[2] - group[1]
        self.pool[length].append(group)

    def _window(self) -> None:
        size = self.capacity if self.total >= self.capacity else 1 << self.total.bit_length() - 1
        fit = bisect_right(self.order, size)
        used: dict[int, int] = {}
        if fit:
            lead = self.order[fit - 1]
            self.left[lead] -= 1
            room = size - lead
            used = closest_fill(self.order[:bisect_right(self.order, room)][::-1], self.left, room)
            self.left[lead] += 1
            used[lead] = used.get(lead, 0) + 1
        slack = size - sum(n * k for n, k in used.items())
        # every item left over is longer than the slack, else the fill would have been closer
        cut = next(n for n in reversed(self.order) if self.left[n] > used.get(n, 0)) if slack else 0
        times = min(self.left[n] // (used.get(n, 0) + (n == cut)) for n in {*used, *([cut] if cut else [])})
        offset = 0
        for length in sorted(used, reverse=True):
            per = used[length]
            for of, low, high, skip, first in self._take(length, per * times):
                self.places.append((of, low, high, skip, length, first, self.sequences, per, offset))
            offset += per * length
        if cut:
            for of, low, high, skip, first in list(self._take(cut, times)):
                self.places.append((of, low, high, skip, slack, first, self.sequences, 1, offset))
                self._give(cut - slack, (of, low, high, skip + slack))
        self.sequences += times
        self.total -= size * times


_PLACES = ["length", "low", "high", "skip", "take", "first", "sequence", "per", "at"]


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(part, n, id, start, length, doc_tokens, sequence_id, offset, skip, crc): every piece of ``token_pieces``, cut
    further where the plan says so; ``skip`` ids of the piece stand before, and ``crc`` is null where it was cut."""
    counts = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("here")), "length_counts")
    before = counts.select("part", "length", (F.sum("here").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")).alias("before"))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {n: c for b in batches for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        places = Plan(totals, capacity).places
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in places], pa.int64()) for k in range(len(_PLACES))], _PLACES)

    totals = counts.groupBy("length").agg(F.sum("here").alias("n"))
    places = stage(totals.repartition(1).mapInArrow(plan, ", ".join(f"{c} long" for c in _PLACES)), "window_plan")
    ranked = pieces.select("part", "n", "id", "start", "length", "rank", "crc", "doc_tokens").join(before, ["part", "length"]).withColumn(
        "rank", F.col("rank") + F.col("before"))
    item = F.col("first") + F.col("rank") - F.col("low")
    return ranked.join(places.withColumnRenamed("length", "of"), F.expr("length = of AND low <= rank AND rank < high")).select(
        "part", "n", "id", (F.col("start") + F.col("skip")).alias("start"), F.col("take").alias("length"), "doc_tokens",
        (F.col("sequence") + F.floor(item / F.col("per"))).alias("sequence_id"), (F.col("at") + item % F.col("per") * F.col("take")).alias("offset"),
        "skip", F.when(F.col("take") == F.col("length"), F.col("crc")).alias("crc"))


def placed_ids(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``placed`` with the ids of each piece, as little-endian unsigned 32-bit numbers in a binary column ``ids``."""
    own = F.expr("substring(all_ids, cast(4 * skip + 1 AS int), cast(4 * length AS int))")
    return placed.join(pieces.select("part", "n", F.col("ids").alias("all_ids")), ["part", "n"]).withColumn("ids", own).drop("all_ids")


def slack_report(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, by_word: bool = True) -> DataFrame:
    """(<id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece in its sequence."""
    pieces = token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, by_word)
    placed = stage(place(pieces, capacity), "placed")
    # ids are read again for cut pieces only; written by themselves, their size decides how they are joined
    cut = placed_ids(stage(placed.where("crc IS NULL"), "cut_pieces"), pieces).withColumn("crc", F.crc32("ids")).drop("ids")
    return placed.where("crc IS NOT NULL").unionByName(cut).select(
        F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
