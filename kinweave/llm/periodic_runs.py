"""Periodic runs of words: stretches that repeat themselves at least three times, found by a suffix automaton.

Words are appended to a suffix automaton one by one. Its suffix links form a tree, kept as preferred paths in
splay trees (a link-cut tree that only grows): all states of a path last occurred at the same word, the path's
colour. Appending word ``i`` walks from the new state to the root and recolours every path segment it passes.
A segment of colour ``e`` whose deepest state has length ``L`` says that the last ``L`` words up to ``i`` ended
before at ``e`` and not since. Where the distance ``i - e`` is at most ``L``, a square of that period ends at
``i``; it is extended to both sides once, to a run. Every run shows up: when its first square is complete, the
words of its second half occurred last exactly one period ago, as a primitive word has no other place in its
own square. By the same argument the distance is always the smallest period.

Before that, each text is narrowed to the stretches that can hold a run: a window of eight words inside a run
of 24 words and three periods stands in the text a second time, one period away. Words outside windows that
repeat are in no run; the stretches between them are worked off by themselves. Nothing is decided there: equal
hashes of different windows only lengthen a stretch.

Texts stay in the task that reads them; nothing is shuffled. The automaton takes about a hundred bytes for each
word of a stretch, besides the words.

Defined cases: null and empty texts have no words and no run; a null identifier passes through; repeated rows
are each worked off; columns other than identifier and text are left out, so none can clash; an empty table
gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.columns import let
from kinweave.llm.words import shingle_hashes, small_batches

MIN_WORDS = 24
MIN_EXPONENT = 3
_SPACE = r"[\x20\x09-\x0D]+"


class RunFinder:
    """Suffix automaton of a growing word sequence with last occurrences along its suffix links.

    State 1 is the empty word and 0 stands for no state. ``left``, ``right`` and ``up`` are the splay trees;
    ``up`` of a tree's root is the state above its path. ``colour`` counts at the root of each tree only.
    """

    def __init__(self, words: list[int]) -> None:
        room = 2 * len(words) + 2
        self.words = words
        self.length, self.link, self.left, self.right, self.up, self.colour = (array("i", bytes(4 * room)) for _ in range(6))
        # Most states go on with one word only: it stands in ``word`` and ``target``; ``more`` holds the others.
        self.word, self.target = array("i", [-1]) * room, array("i", bytes(4 * room))
        self.more: dict[int, dict[int, int]] = {}
        self.states, self.last = 1, 1
        self.colour[1] = -1

    def _next(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.target[state]
        more = self.more.get(state)
        return more.get(word, 0) if more else 0

    def _set(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.target[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _splay(self, x: int) -> None:
        """Bring ``x`` to the root of its tree, with the colour of the tree."""
        left, right, up = self.left, self.right, self.up
        while True:
            p = up[x]
            if not p:
                return
            if left[p] == x:
                on_left = True
            elif right[p] == x:
                on_left = False
            else:
                return
            g = up[p]
            g_left = g and left[g] == p
            g_right = g and not g_left and right[g] == p
            if not (g_left or g_right):
                self.colour[x] = self.colour[p]
                self._rotate(x, p, on_left)
            elif g_left == on_left:
                self._rotate(p, g, on_left)
                # the old root's colour travels with whoever takes its place
                self.colour[p] = self.colour[g]
                self.colour[x] = self.colour[p]
                self._rotate(x, p, on_left)
            else:
                self._rotate(x, p, on_left)
                self.colour[x] = self.colour[g]
                self._rotate(x, g, bool(g_left))

    def _rotate(self, x: int, p: int, on_left: bool) -> None:
        left, right, up = self.left, self.right, self.up
        g = up[p]
        if on_left:
            b = right[x]
            left[p], right[x] = b, p
        else:
            b = left[x]
            right[p], left[x] = b, p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def _extend(self, word: int) -> int:
        """Append ``word`` to the automaton and hang the new state below its suffix link."""
        self.states += 1
        new = self.states
        self.length[new] = self.length[self.last] + 1
        p = self.last
        while p and not self._next(p, word):
            self._set(p, word, new)
            p = self.link[p]
        if not p:
            above = 1
        else:
            q = self._next(p, word)
            above = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        self.link[new] = self.up[new] = above
        self.last = new
        return new

    def _split(self, p: int, q: int, word: int) -> int:
        """Shorter part of state ``q`` as a state of its own, on the path of ``q`` and right above it."""
        self.states += 1
        copy = self.states
        self.length[copy] = self.length[p] + 1
        self.word[copy], self.target[copy] = self.word[q], self.target[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[copy] = self.link[q]
        self._splay(q)
        above = self.left[q]
        self.left[copy], self.left[q], self.up[copy] = above, copy, q
        if above:
            self.up[above] = copy
        self.link[q] = copy
        while p and self._next(p, word) == q:
            self._set(p, word, copy)
            p = self.link[p]
        return copy

    def _recolour(self, new: int, at: int) -> list[tuple[int, int]]:
        """(length, previous end) of every path segment above ``new``; the whole path then ends at ``at``."""
        found = []
        left, right, up, colour = self.left, self.right, self.up, self.colour
        below = new
        while True:
            x = up[below]
            if not x:
                break
            self._splay(x)
            found.append((self.length[x], colour[x]))
            cut = right[x]
            if cut:
                colour[cut] = colour[x]
            right[x] = below
            below = x
        self._splay(new)
        colour[new] = at
        return found

    def runs(self, min_words: int, min_exponent: int) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs of at least so many words and periods, in order of discovery."""
        words, n = self.words, len(self.words)
        reach: dict[int, int] = {}
        out = []
        for i, word in enumerate(words):
            for length, end in self._recolour(self._extend(word), i):
                period = i - end
                if end < 0 or period > length or reach.get(period, -1) >= i:
                    continue
                start, stop = i - 2 * period + 1, i + 1
                while start and words[start - 1] == words[start - 1 + period]:
                    start -= 1
                while stop < n and words[stop] == words[stop - period]:
                    stop += 1
                reach[period] = stop - 1
                if stop - start >= max(min_words, min_exponent * period):
                    out.append((start, stop - start, period))
        return out


def stretches(codes: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Ranges of words covered by windows of ``width`` words that stand in the text more than once."""
    if len(codes) < 2 * width:
        return []
    hashes = shingle_hashes(codes, width)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(len(hashes), np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    steps = np.zeros(len(codes) + 1, np.int64)
    steps[:len(hashes)] += twice
    steps[width:] -= twice
    covered = np.zeros(len(codes) + 2, np.int8)
    covered[1:-1] = np.cumsum(steps)[:-1] > 0
    edges = np.diff(covered)
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))


def find_runs(words: list[bytes], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a word sequence by start, then period. ``min_exponent`` is 3 or more."""
    known: dict[bytes, int] = {}
    codes = [known.setdefault(w, len(known)) for w in words]
    if len(known) == len(codes):
        return []
    out = []
    for low, high in stretches(np.array(codes, np.uint64), max(1, min_words // 3)):
        if high - low >= min_words:
            out += [(low + s, n, p) for s, n, p in RunFinder(codes[low:high]).runs(min_words, min_exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    kept, done = [], 0
    for low, high in sorted((s + p, s + n) for s, n, p in runs):
        kept += words[done:low]
        done = max(done, high)
    return kept + words[done:]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                  min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(<id_col>, n_words, runs, collapsed): runs of each text by start and period, numbered in words; ``collapsed``
    is the text with every run cut to its first period, words joined by one space."""
    small_batches(docs.sparkSession)
    id_kind = docs.schema[id_col].dataType.simpleString()
    run_kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, kept = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                words = (text.as_py() or b"").split()
                runs = find_runs(words, min_words, min_exponent)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                kept.append(b" ".join(collapse(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, run_kind), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "runs", "collapsed"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        work, f"id {id_kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, <text_col>) with the tail of every tenth text, by a hash of its identifier, made periodic."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)

    def looped(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(
            words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split(F.col(text_col), _SPACE), lambda w: w != "")
    damaged = let(words, lambda w: F.when(F.size(w) > 0, looped(w)).otherwise(""))
    return docs.select(id_col, F.when(h % 10 == 0, damaged).otherwise(F.col(text_col)).alias(text_col))


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of ``periodic_runs``: number of runs, the one of greatest exponent, and hashes of all runs and of the collapsed text."""
    runs = F.col("runs")
    # cross-multiplied, so that exponents are compared exactly; the array is in order of start and period
    best = F.aggregate(runs, F.get(runs, F.lit(0)), lambda top, r: F.when(r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top))
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return periodic_runs(docs, id_col, text_col).select(
        id_col, F.size(runs).cast("long").alias("n_runs"), best.alias("best"),
        digest(F.concat(F.array_join(line, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256")).select(
        id_col, "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
