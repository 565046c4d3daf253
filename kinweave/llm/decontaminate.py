"""Benchmark decontamination by Wu-Manber search over words.

Test strings are windows of ten consecutive words of each benchmark item. A table of shifts, indexed by
the hash of a block of two words, says how far the search may jump; where the shift is zero, the bucket
of that block lists the windows that end so, and a direct comparison of all their words decides.

The search runs in map tasks, so documents are not moved. Benchmark windows go to the tasks in blocks of
at most ``BLOCK_WINDOWS`` windows, a size known before anything is sent; a larger benchmark takes several
blocks, each one more pass of the same kind chained to the one before.

Defined cases: null or empty text has no words and no hits; an item without words has no window; a null
item identifier counts as the text ``null``; repeated rows are each reported; an empty benchmark hits
nothing; columns of the documents pass through, and result columns are named by the caller's prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm import words as W

WINDOW = 10
#: Windows sent to the tasks at once: 80 bytes of words each and as much for tables.
BLOCK_WINDOWS = 100_000
_LANE = 256
_TABLE_BITS = 16


@dataclass
class _Group:
    """Windows of one length with their shift table and buckets."""

    length: int
    block: int
    windows: np.ndarray  # (windows, length) word hashes
    items: list[np.ndarray]  # positions of the items that hold each window
    shifts: np.ndarray
    bucket_start: np.ndarray
    bucket: np.ndarray  # windows ordered by the slot of their last block


def _slots(words: np.ndarray, block: int) -> np.ndarray:
    """Table slot of the block that ends at each word; the first words of a text have no full block of two."""
    value = words.copy()
    if block == 2:
        value[1:] += words[:-1] * np.uint64(0x9E3779B97F4A7C15)
    return (W.mix(value) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def _group(length: int, windows: np.ndarray, items: list[np.ndarray]) -> _Group:
    block = min(2, length)
    shifts = np.full(1 << _TABLE_BITS, length - block + 1, np.int64)
    slots = _slots(windows.ravel(), block).reshape(windows.shape)
    for end in range(block - 1, length):
        np.minimum.at(shifts, slots[:, end], length - 1 - end)
    last = slots[:, -1]
    order = np.argsort(last, kind="stable")
    start = np.searchsorted(last[order], np.arange((1 << _TABLE_BITS) + 1))
    return _Group(length, block, windows, items, shifts, start, order)


def _compile(rows: list[tuple[int, list[int]]]) -> list[_Group]:
    """Search tables for (item position, word hashes as signed numbers) rows, one per window length."""
    by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for item, words in rows:
        by_length.setdefault(len(words), {}).setdefault(tuple(words), set()).add(item)
    out = []
    for length, found in sorted(by_length.items()):
        windows = np.array(list(found), np.int64).view(np.uint64).reshape(-1, length)
        out.append(_group(length, windows, [np.array(sorted(x)) for x in found.values()]))
    return out


def _search(words: np.ndarray, group: _Group) -> tuple[np.ndarray, np.ndarray]:
    """(last word, window) of every occurrence in ``words``; all lanes of the text jump together."""
    n, length = len(words), group.length
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slots = _slots(words, group.block)
    at = np.arange(length - 1, n, _LANE)
    limit = np.minimum(at + _LANE, n)
    ends = []
    while len(at):
        shift = group.shifts[slots[at]]
        ends.append(at[shift == 0])
        at = at + np.maximum(shift, 1)
        going = at < limit
        at, limit = at[going], limit[going]
    end = np.concatenate(ends)
    first, last = group.bucket_start[slots[end]], group.bucket_start[slots[end] + 1]
    count = last - first
    end = np.repeat(end, count)
    offset = np.arange(len(end)) - np.repeat(np.cumsum(count) - count, count)
    window = group.bucket[np.repeat(first, count) + offset]
    for j in range(length):  # last words first: most impostors end here
        same = words[end - j] == group.windows[window, length - 1 - j]
        end, window = end[same], window[same]
    return end, window


def _scan(data: np.ndarray, offsets: np.ndarray, groups: list[_Group]) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
    """(words, hit word ranges, items) of each row, in order."""
    for low, high in W.row_groups(offsets):
        part = offsets[low:high + 1]
        starts, ends, bounds = W.find_words(data[part[0]:part[-1]], part - part[0], W.ALNUM)
        hashed = W.hash_words(data[part[0]:part[-1]], starts, ends, W.ALNUM)
        rows = np.arange(high - low)
        # A word that no text has keeps windows from crossing texts.
        at = bounds[:-1] + rows
        line = np.insert(hashed, bounds[1:], np.uint64(0)) if len(rows) else hashed
        marks = np.zeros(len(line) + 1, np.int64)
        items: list[set[int]] = [set() for _ in rows]
        for group in groups:
            end, window = _search(line, group)
            np.add.at(marks, end - group.length + 1, 1)
            np.add.at(marks, end + 1, -1)
            owner = np.searchsorted(at, end, "right") - 1
            for row, w in set(zip(owner.tolist(), window.tolist())):
                items[row].update(group.items[w].tolist())
        covered = np.cumsum(marks[:-1]) > 0
        for r in rows:
            n = int(bounds[r + 1] - bounds[r])
            ranges: list[tuple[int, int]] = []
            if items[r]:
                edge = np.diff(np.concatenate(([False], covered[at[r]:at[r] + n], [False])).astype(np.int8))
                ranges = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
            yield n, ranges, items[r]


def _windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words) rows: word hashes of every window of every item, hashed as the documents' words are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.utf8(batch.column(1))
            starts, ends, bounds = W.find_words(data, offsets, W.ALNUM)
            hashed = W.signed(W.hash_words(data, starts, ends, W.ALNUM))
            names, found = [], []
            for i, name in enumerate(batch.column(0).to_pylist()):
                own = hashed[bounds[i]:bounds[i + 1]]
                width = min(window, len(own))
                for j in range(len(own) - width + 1 if width else 0):
                    names.append(name)
                    found.append(own[j:j + width].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["item", "words"])

    chosen = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "item string, words array<long>").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", window: int = WINDOW, prefix: str = "bench_") -> DataFrame:
    """``docs`` with ``<prefix>n_words``, ``<prefix>spans`` (hit word ranges, end exclusive) and ``<prefix>items`` (sorted)."""
    spark = docs.sparkSession
    W.small_batches(spark)
    names = [f"{prefix}n_words", f"{prefix}spans", f"{prefix}items"]
    clash = [c for c in docs.columns if c.lower() in names]
    if clash:
        raise ValueError(f"the documents already have columns {clash}; choose another prefix")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], span),
                           T.StructField(names[2], T.ArrayType(T.StringType()))])
    out = docs.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.array().cast(span), names[2]: F.array().cast("array<string>")})
    text_at, n_docs = docs.columns.index(text_col), len(docs.columns)

    def scanner(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, windows = sent.value
            groups = _compile(windows)
            for batch in batches:
                n_words, spans, hits = [], [], []
                old_spans, old_items = (batch.column(n_docs + k).to_pylist() for k in (1, 2))
                for i, (n, ranges, found) in enumerate(_scan(*W.utf8(batch.column(text_at)), groups)):
                    n_words.append(n)
                    spans.append([{"start": a, "end": b} for a, b in _union(ranges + [(x["start"], x["end"]) for x in old_spans[i]])])
                    hits.append(sorted({items[k] for k in found} | set(old_items[i])))
                kind = batch.schema
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n_docs], pa.array(n_words, pa.int64()), pa.array(spans, kind.field(n_docs + 1).type),
                     pa.array(hits, kind.field(n_docs + 2).type)], schema=kind)
        return run

    # Blocks of windows stream through the driver one at a time; an empty benchmark still takes one pass for word counts.
    block: list[tuple[str, list[int]]] = []
    blocks = 0

    def passed(frame: DataFrame, rows: list[tuple[str, list[int]]]) -> DataFrame:
        items = sorted({name for name, _ in rows})
        place = {name: k for k, name in enumerate(items)}
        sent = spark.sparkContext.broadcast((items, [(place[name], words) for name, words in rows]))
        return frame.mapInArrow(scanner(sent), schema)

    for row in _windows(benchmark, item_col, item_text_col, window).toLocalIterator():
        block.append((row["item"], row["words"]))
        if len(block) == BLOCK_WINDOWS:
            out, block, blocks = passed(out, block), [], blocks + 1
    return passed(out, block) if block or not blocks else out


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items and their digest, verdict."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    spans, items = F.col("bench_spans"), F.col("bench_items")
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda t, x: t + (x["end"] - x["start"]))
    return found.select(
        "doc_id", F.col("bench_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), (F.size(items) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark window, all columns as they were."""
    return find_contamination(docs, benchmark).where(F.size("bench_items") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
