"""Removal of repeated 200-byte strings by suffix sorting.

Anchors. Of every 200-byte window the 32-byte gram of the smallest hash is its anchor, the leftmost on
ties. Equal windows have equal anchors at equal places, so windows are compared within one anchor only.
Neighbouring windows of one anchor make up a context of a few hundred bytes. A pass over all texts gives
one row of hashes per context, and an aggregate tells which anchors occur twice or more. Contexts that
are alike as wholes would stand side by side in the sort, they are merged beforehand by their digest.

Sorting. The bytes of contexts that differ under a repeated anchor are fetched and sorted in blocks by
the two-stage method: only suffixes smaller than their successors are sorted directly, the rest is
induced by scanning the buckets of first bytes in order. Common prefixes of neighbours then tell which
windows occur twice. The contexts of an anchor with very many of them are cut by the room their windows
have to the left of the anchor; the windows of one cut share a core of most of their length, equal windows
share the same, and so cuts are dealt over blocks by the digest of their core. Should very many cuts share
even that, they are dealt by chance and their windows matched by digest across blocks in one more aggregate.

Texts move only where a filter of bounded size (``idfilter``) sees a context to fetch or a byte to remove.

Defined cases: null or empty text has no bytes; texts of fewer than 200 bytes lose none; rows of equal
identifier and text occur as often as they stand there; runs of one byte are repeats of themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import idfilter
from kinweave.llm import words as W
from kinweave.session import stage

LENGTH, GRAM = 200, 32
#: Contexts in one block, and of one anchor beyond which it is dealt over blocks.
BLOCK, CROWDED = 1000, 2500
#: Cuts of a crowded anchor's contexts by the bytes a window has before the anchor.
CUTS = (0, 8, 42, LENGTH - GRAM - 41, LENGTH - GRAM - 7, LENGTH - GRAM + 1)
_PIECE = 1 << 18
_SPAN_COLUMNS = "row long, start long, end long"


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by running minima from both ends of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def contexts(body: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, digest, first window, windows, bytes from there to the anchor) of all contexts, piece by piece of a long text."""
    for low in range(0, len(body) - LENGTH + 1, _PIECE):
        part = body[low:low + _PIECE + LENGTH - 1]
        up, down = W.power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(W.BYTE_VALUES[part] * up[:len(part)], out=sums[1:])
        count = len(part) - GRAM + 1
        grams = W.mix((sums[GRAM:] - sums[:count]) * down[:count])
        places = np.uint64((1 << 20) - 1)
        least = _window_minimum((grams & ~places) | np.arange(count, dtype=np.uint64), LENGTH - GRAM + 1)
        anchor = (least & places).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        windows = np.diff(np.append(first, len(anchor)))
        at = anchor[first]
        end = first + windows + LENGTH - 1
        digest = W.mix((sums[end] - sums[first]) * down[first] + (windows * 512 + (at - first)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield grams[at], digest, first + low, windows, at - first


def two_stage_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` bytes."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    following = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    smaller = np.zeros(n, bool)  # than the successor; the last suffix is larger than the empty one
    inner = following < n
    smaller[:-1][inner] = step[following[inner]] > 0
    starts = np.flatnonzero(smaller)
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(depth, np.uint8))), depth)[starts]
    starts = starts[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]
    del rows
    bounds = np.searchsorted(text[starts], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))
    order = []

    def induce(wave: np.ndarray) -> None:
        """Predecessors larger than the suffixes of ``wave`` go to their buckets in the same order."""
        before = wave[wave > 0] - 1
        before = before[~smaller[before]]
        first = text[before]
        by = np.argsort(first, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], first[by][1:] != first[by][:-1]))) if len(by) else []
        for group in np.split(before[by], edges[1:]) if len(by) else []:
            induced[text[group[0]]].append(group)

    for byte in range(256):
        k = 0
        while k < len(induced[byte]):
            induce(induced[byte][k])
            k += 1
        own = starts[bounds[byte]:bounds[byte + 1]]
        induce(own)
        order += [*induced[byte], own]
        induced[byte] = []
    return np.concatenate(order)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the prefix each suffix of ``order`` shares with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(most, np.uint8))), most)
    for low in range(1, len(order), 4096):
        high = min(low + 4096, len(order))
        differ = rows[order[low:high]] != rows[order[low - 1:high - 1]]
        out[low:high] = np.where(differ.any(1), differ.argmax(1), most)
    return out


def _block(table: pa.Table) -> pa.Table:
    """Spans of windows repeated in one block of contexts, and digests of windows that may recur in other blocks.

    ``mode`` of a context: 0 all that can be like it are here, 1 they may be in any block.
    """
    weight, mode, row, at, windows, anchor = (table.column(c).to_numpy() for c in ("copies", "mode", "row", "at", "windows", "anchor"))
    pieces = table.column("bytes").to_pylist()
    text = np.frombuffer(b"".join(pieces), np.uint8)
    base = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))[:-1]
    owner = np.repeat(np.arange(len(pieces)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = np.full(len(text), -1)
    place[base[owner] + offset] = np.arange(len(owner))
    order = two_stage_order(text, LENGTH)
    order = order[place[order] >= 0]
    group = np.cumsum(common_prefixes(text, order, LENGTH) < LENGTH) - 1
    window = place[order]
    total = np.bincount(group, np.minimum(weight, 2)[owner[window]])
    repeated = np.zeros(len(owner), bool)
    repeated[window] = total[group] > 1
    # One window of each repeated group speaks for it in other blocks.
    speaks = np.zeros(len(owner), bool)
    speaks[window[np.concatenate(([True], group[1:] != group[:-1]))]] = True
    out: dict[str, list] = {k: [] for k in ("row", "start", "end", "anchor", "digest", "weight")}

    def put(i: int, a: int, b: int, digest: int | None, n: int | None) -> None:
        for name, value in zip(out, (int(row[i]), int(at[i]) + a, int(at[i]) + b, int(anchor[i]), digest, n)):
            out[name].append(value)

    first = np.cumsum(windows) - windows
    for i, piece in enumerate(pieces):
        here = repeated[first[i]:first[i] + windows[i]]
        if mode[i]:
            for j in np.flatnonzero(~here | speaks[first[i]:first[i] + windows[i]]).tolist():
                put(i, j, j + LENGTH, xxhash.xxh3_64_intdigest(piece[j:j + LENGTH]) - (1 << 63), 2 if here[j] else 1)
        if weight[i] == 1:
            edge = np.diff(np.concatenate(([False], here, [False])).astype(np.int8))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                put(i, a, b - 1 + LENGTH, None, None)
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def _context_rows(docs: DataFrame) -> DataFrame:
    """(row, anchor, digest, at, windows, lead) of (row, text) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.utf8(batch.column(1))
            own, parts = [], ([], [], [], [], [])
            for i in range(batch.num_rows):
                for found in contexts(data[offsets[i]:offsets[i + 1]]):
                    own.append(np.full(len(found[0]), i))
                    for column, value in zip(parts, found):
                        column.append(value)
            join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(join(own, np.int64))), pa.array(W.signed(join(parts[0], np.uint64))), pa.array(W.signed(join(parts[1], np.uint64))),
                 pa.array(join(parts[2], np.int64)), pa.array(join(parts[3], np.int32)), pa.array(join(parts[4], np.int32))],
                ["row", "anchor", "digest", "at", "windows", "lead"])

    return docs.mapInArrow(run, "row long, anchor long, digest long, at long, windows int, lead int")


def _cuts(x: dict) -> Iterator[dict]:
    """A context cut by the room before the anchor, each with the byte range all windows of its cut hold."""
    anchor = x["at"] + x["lead"]
    for k, (least, beyond) in enumerate(zip(CUTS, CUTS[1:])):
        first, end = max(0, x["lead"] - beyond + 1), min(x["windows"], x["lead"] - least + 1)
        if first < end:
            yield dict(x, at=x["at"] + first, windows=end - first, lead=x["lead"] - first, cut=k,
                       core=(anchor - least, anchor + LENGTH - beyond + 1))


def _fetch(texts: DataFrame) -> DataFrame:
    """Bytes of the contexts listed in ``wanted`` for each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.utf8(batch.column(1))
            out: dict[str, list] = {k: [] for k in ("row", "anchor", "digest", "copies", "crowded", "at", "windows", "lead", "edges", "bytes")}
            for i, (row, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                body = data[offsets[i]:offsets[i + 1]]
                for x in wanted:
                    for cut in _cuts(x) if x["crowded"] else [dict(x, core=(0, 0))]:
                        low, high = cut["core"]
                        core = b"%d|" % cut.get("cut", 0) + body[low:high].tobytes()
                        own = dict(cut, row=row, edges=xxhash.xxh3_64_intdigest(core) - (1 << 63),
                                   bytes=body[cut["at"]:cut["at"] + cut["windows"] + LENGTH - 1].tobytes())
                        for name in out:
                            out[name].append(own[name])
            narrow = ("windows", "lead")
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "bytes" else pa.int32() if k in narrow else pa.int64()) for k, v in out.items()], list(out))

    return texts.mapInArrow(run, "row long, anchor long, digest long, copies long, crowded long, at long, windows int, lead int, edges long, bytes binary")


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, spans): byte ranges (start, end) to remove; ``row`` is the hash of identifier and text. Spans may overlap."""
    W.small_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    found = _context_rows(rows)
    # Written out, so that the joins below read plain shuffles on both sides, which adaptive execution can split.
    shared = stage(found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("n > 1").select(
        "anchor", (F.col("low") != F.col("high")).alias("mixed")), "shared")
    repeats = stage(found.join(shared, "anchor"), "repeats")
    whole = lambda df: df.select("row", F.col("at").alias("start"), (F.col("at") + F.col("windows") + (LENGTH - 1)).alias("end"))
    mixed = repeats.where("mixed")
    alike = stage(mixed.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("row", "at", "windows", "lead")).alias("one")), "alike")
    # An anchor matters if some context of it stands alone; all its contexts are then compared.
    open_ = stage(alike.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("least = 1").select("anchor", "kinds"), "open")
    wanted = stage(alike.join(open_, "anchor").select(
        F.col("one.row").alias("row"), F.struct("anchor", "digest", "copies", F.when(F.col("kinds") > CROWDED, F.col("kinds")).otherwise(0).alias("crowded"),
                                                F.col("one.at").alias("at"), F.col("one.windows").alias("windows"), F.col("one.lead").alias("lead")).alias("x")), "wanted")
    _, perhaps = idfilter.split(rows, "row", wanted, "row")
    listed = wanted.groupBy("row").agg(F.collect_set("x").alias("wanted"))
    fetched = stage(_fetch(perhaps.join(listed, "row").select("row", "text", "wanted")), "contexts")
    blocks = max(1, -(-fetched.count() // BLOCK))
    # Repeated rows would be fetched twice; their copies are already counted.
    single = fetched.groupBy("row", "anchor", "digest", "at").agg(*[F.first(c).alias(c) for c in ("copies", "crowded", "windows", "lead", "edges", "bytes")])
    # A cut whose core nobody shares has nothing to be compared with.
    cores = fetched.where("crowded > 0").select("row", "at", "anchor", "edges").distinct().groupBy("anchor", "edges").agg(F.count("*").alias("alike")).where("alike > 1")
    dealt = single.where("crowded = 0").withColumn("alike", F.lit(1).cast("long")).unionByName(
        single.where("crowded > 0").join(cores, ["anchor", "edges"]).select(*single.columns, "alike"))
    dealt = dealt.withColumn("mode", (F.col("alike") > CROWDED).cast("int"))
    chance = F.when(F.col("mode") == 1, F.pmod(F.xxhash64("row", "at"), F.ceil(F.col("alike") / CROWDED))).otherwise(0)
    block = F.pmod(F.xxhash64("anchor", "edges", chance), F.lit(blocks))
    sorted_ = stage(dealt.withColumn("block", block).drop("alike", "crowded", "edges", "digest", "lead").groupBy("block").applyInArrow(
        _block, _SPAN_COLUMNS + ", anchor long, digest long, weight long"), "sorted")
    near = sorted_.where("weight IS NOT NULL")
    twice = near.groupBy("anchor", "digest").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor", "digest")
    spans = (whole(repeats.where("NOT mixed")).union(whole(mixed.join(alike.where("copies > 1").select("anchor", "digest"), ["anchor", "digest"])))
             .union(sorted_.where("weight IS NULL").select("row", "start", "end"))
             .union(near.join(twice, ["anchor", "digest"]).where("weight = 1").select("row", "start", "end")))
    return spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, n_bytes, removed, kept): maximal removed byte ranges of each text, and the bytes that stay."""
    spans = stage(repeated_bytes(docs, id_col, text_col), "spans").withColumnRenamed("row", "_row")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(id_col, text_col).alias("_key"))
    clear, perhaps = idfilter.split(rows, "_key", spans, "_row")
    removed = "array<struct<start:bigint,end:bigint>>"
    kind = rows.schema["id"].dataType.simpleString()
    untouched = clear.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast(removed).alias("removed"), F.col("text").cast("binary").alias("kept"))
    joined = perhaps.join(spans, F.col("_key") == F.col("_row"), "left").select("id", "text", F.coalesce("spans", F.array().cast(removed)).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.utf8(batch.column(1))
            gone, kept = [], []
            for i, spans_ in enumerate(batch.column(2).to_pylist()):
                body = data[offsets[i]:offsets[i + 1]]
                united: list[list[int]] = []
                for x in spans_:
                    if united and x["start"] <= united[-1][1]:
                        united[-1][1] = max(united[-1][1], x["end"])
                    else:
                        united.append([x["start"], x["end"]])
                mask = np.ones(len(body), bool)
                for a, b in united:
                    mask[a:b] = False
                gone.append([{"start": a, "end": b} for a, b in united])
                kept.append(body[mask].tobytes())
            sizes = pa.array(np.diff(offsets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                              pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])

    out = joined.mapInArrow(run, f"id {kind}, n_bytes long, removed {removed}, kept binary")
    return untouched.unionByName(out).withColumnRenamed("id", id_col)


def suffix_report(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, removed bytes and ranges, digest of what stays."""
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda t, x: t + (x["end"] - x["start"]))
    return remove_repeated_bytes(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
