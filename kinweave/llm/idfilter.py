"""Split a table by membership of a key in another table without moving the rows that are no members.

The keys set bits of a Bloom filter of bounded size, which alone reaches the driver and is sent to all
tasks. Rows whose bit is unset are certainly no members and stay where they are; only the others take
part in the exact join that follows. A filter too small for its keys lets more rows pass to that join,
results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and at most: 2**26 bits are 8 MB.
BITS_PER_KEY = 16
MOST_BITS = 1 << 26
_CHUNK = 32768


def build(keys: DataFrame, column: str) -> np.ndarray:
    """Bit array (0/1 packed little-endian) over the long column ``column``; its length is a power of two."""
    n = keys.count()
    bits = 1 << 15
    while bits < MOST_BITS and bits < n * BITS_PER_KEY:
        bits <<= 1
    slots = keys.select(F.col(column).alias("k")).where("k IS NOT NULL").select(F.pmod(F.xxhash64("k"), F.lit(bits)).alias("p"))
    chunks = slots.groupBy((F.col("p") / _CHUNK).cast("long").alias("c")).agg(
        F.bitmap_construct_agg(F.pmod(F.col("p"), F.lit(_CHUNK))).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for row in chunks.toLocalIterator():
        part = np.frombuffer(bytes(row["m"]), np.uint8)
        out[row["c"] * (_CHUNK // 8):][:len(part)] = part
    return out


def split(rows: DataFrame, column: str, keys: DataFrame, key_column: str) -> tuple[DataFrame, DataFrame]:
    """(certainly no members, perhaps members) of ``rows``; a null in ``column`` is no member."""
    spark = rows.sparkSession
    filter_ = build(keys, key_column)
    sent = spark.sparkContext.broadcast(filter_)
    bits = len(filter_) * 8
    slot = F.coalesce(F.pmod(F.xxhash64(F.col(column)), F.lit(bits)), F.lit(-1))
    marked = rows.withColumn("_slot", F.when(F.col(column).isNull(), F.lit(-1)).otherwise(slot))

    def keep(want: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sent.value
            for batch in batches:
                at = batch.schema.get_field_index("_slot")
                slots = batch.column(at).to_numpy(zero_copy_only=False)
                safe = np.maximum(slots, 0)
                hit = (slots >= 0) & ((held[safe >> 3] >> (safe & 7).astype(np.uint8)) & 1).astype(bool)
                chosen = batch.select([i for i in range(batch.num_columns) if i != at])
                yield chosen.filter(pa.array(hit if want else ~hit))
        return run

    return marked.mapInArrow(keep(False), rows.schema), marked.mapInArrow(keep(True), rows.schema)
