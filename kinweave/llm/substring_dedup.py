"""Substring deduplication by hashing of normalised units.

Units are paragraphs, lines and sentences, since a passage set into the middle of a line is found by the
sentences inside it. A unit is compared in lower case, by its words alone; a character of a script
written without spaces is a word. Paragraphs and lines count from one word on. A sentence of fewer than
``LEAST_WORDS`` words is not a unit by itself: from it the sentences behind it, and those before it, are
taken along until there are so many words. In a repeated passage of that length each sentence thus lies
in a run that is inside the passage, so all of it is found. Digests of 128 bits are grouped over the
corpus, the occurrence of the smallest (identifier, offset) stays, and all others go, but for those that
overlap the one that stays. Offsets of what goes refer to the original text; overlapping spans are united.

A digest is reduced in each task before the shuffle, and its occurrences are joined back in a join that
splits crowded keys. Texts move only for documents in which the filter of ``idfilter`` sees something go.

Defined cases: null or empty text has no units; a null identifier ranks last, among such by text hash;
rows of equal identifier and text count as one occurrence and fare alike; repeats within one text go too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import idfilter
from kinweave.llm import words as W
from kinweave.session import stage

LEAST_WORDS = 6
_END = re.compile(r"[.!?]+\s+|[\u3002\uFF01\uFF0E\uFF1F\uFF61]+\s*|\n\s*\n+|\n")
# Thai to Myanmar, Khmer, kana and ideographs, also those beyond 16 bits.
_UNSPACED = "\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3031-\u312F\u31A0-\u31BF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\U00020000-\U0003FFFF"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")


def units(text: str) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, place of the first word, normalised words) of every unit; a unit takes the white space behind it along."""
    spans: list[tuple[int, int, int, int, bytes]] = []  # sentences with a word: where, number of words, the words
    found: dict[tuple[int, int], tuple[int, int]] = {}  # first and last sentence of a unit, and where it stands
    start = line = paragraph = 0
    line_from = paragraph_from = 0
    for end, broken in [*((m.end(), m[0].count("\n")) for m in _END.finditer(text)), (len(text), 2)]:
        words = _WORD.findall(text[start:end].lower())
        if words:
            first = _WORD.search(text, start, end)
            spans.append((start, end, first.start() if first else start, len(words), " ".join(words).encode("utf-8", "surrogatepass")))
        if broken:
            if len(spans) > line:
                found[line, len(spans)] = line_from, end
            line, line_from = len(spans), end
        if broken > 1:
            if len(spans) > paragraph:
                found[paragraph, len(spans)] = paragraph_from, end
            paragraph, paragraph_from = len(spans), end
        start = end
    for i in range(len(spans)):
        for step in (1, -1):
            at, count = i, spans[i][3]
            while count < LEAST_WORDS and 0 <= at + step < len(spans):
                at += step
                count += spans[at][3]
            if count >= LEAST_WORDS:
                low, high = min(i, at), max(i, at)
                found.setdefault((low, high + 1), (spans[low][0], spans[high][1]))
    for (low, high), (start, end) in found.items():
        yield start, end, spans[low][2], spans[low][4] if high == low + 1 else b" ".join([x[4] for x in spans[low:high]])


def _unit_rows(docs: DataFrame) -> DataFrame:
    """(rank, row, start, end, place, a, b) of (rank, row, text) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], ([], [], [], [], [])
            for i, text in enumerate(batch.column(2)):
                for start, end, place, words in units(text.as_py() or ""):
                    digest = xxhash.xxh3_128_intdigest(words)
                    at.append(i)
                    for column, value in zip(out, (start, end, place, (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63))):
                        column.append(value)
            own = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), *(pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())))],
                ["rank", "row", "start", "end", "place", "a", "b"])

    kind = docs.schema["rank"].dataType.simpleString()
    return docs.mapInArrow(run, f"rank {kind}, row long, start int, end int, place int, a long, b long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, spans) of the rows that lose something; ``row`` is the hash of identifier and text, spans are (start, end), sorted, and may overlap."""
    W.small_batches(docs.sparkSession)
    # Written out, so that texts are cut into units once for the aggregate and the join.
    found = stage(_unit_rows(docs.select(F.col(id_col).alias("rank"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))), "units")
    # By its first word, as a line and a sentence in it may differ in what stands before that.
    own = [F.col("rank").isNull().alias("last"), "rank", "row", "place"]
    spot, first = F.struct(*own), F.struct(*[F.col(f"first.{c}").alias(c) for c in ("last", "rank", "row", "place")])
    # Written out too, so that the join below reads plain shuffles on both sides, which adaptive execution can split.
    shared = stage(found.groupBy("a", "b").agg(F.min(F.struct(*own, "end")).alias("first"), F.max(spot).alias("final")).where(first != F.col("final")).select("a", "b", "first"), "shared")
    overlaps = (F.col("row") == F.col("first.row")) & (F.col("start") < F.col("first.end"))
    gone = found.join(shared, ["a", "b"]).where((spot != first) & ~overlaps)
    return gone.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that stays, and ``removed``: (start, end) of all that went, in code points of the original."""
    if "removed" in {c.lower() for c in docs.columns}:
        raise ValueError("the documents already have a column removed")
    spans = stage(repeated_spans(docs, id_col, text_col), "repeats").select(F.col("row").alias("_row"), F.col("spans").alias("removed"))
    keyed = docs.withColumn("_key", F.xxhash64(id_col, text_col))
    clear, perhaps = idfilter.split(keyed, "_key", spans, "_row")
    kind = spans.schema["removed"].dataType
    whole = clear.drop("_key").withColumn("removed", F.array().cast(kind))
    joined = perhaps.join(spans, F.col("_key") == F.col("_row"), "left").drop("_key", "_row").withColumn("removed", F.coalesce("removed", F.array().cast(kind)))
    at, of = joined.columns.index(text_col), joined.columns.index("removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(of).to_pylist()):
                united: list[dict] = []
                for x in gone:
                    if united and x["start"] < united[-1]["end"]:
                        united[-1]["end"] = max(united[-1]["end"], x["end"])
                    else:
                        united.append(dict(x))
                kept, last = [], 0
                for x in united:
                    kept.append(text[last:x["start"]])
                    last = x["end"]
                texts.append(text if not gone else "".join([*kept, text[last:]]))
                spans.append(united)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            columns[of] = pa.array(spans, batch.schema.field(of).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return whole.unionByName(joined.mapInArrow(run, joined.schema))


def substring_report(docs: DataFrame) -> DataFrame:
    """One row per document: what went, by original offsets, and a digest of what stays."""
    kept = remove_repeats(docs.select("doc_id", "text"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda t, x: t + (x["end"] - x["start"]))
    return kept.select("doc_id", F.size("removed").cast("long").alias("n_removed_units"), length.alias("n_removed_chars"),
                       F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("removed_spans"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
