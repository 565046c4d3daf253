"""Resolution of capability names against a canonical index."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.functions.text import capability_id, is_abbreviation, normalize
from kinweave.session import stage

PIVOTS = 32
BLOCK_ROWS = 2048
CHUNK_ROWS = 50_000
#: Sequence numbers sorted together per name; a bound on a task, no limit of the operator.
STRETCH = 1_000_000


def alias_index(existing: DataFrame) -> DataFrame:
    """(norm, capability_id) for names and aliases of existing(ord, capability_id, name, aliases); the latest record wins."""
    spelled = existing.select("ord", "capability_id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    rows = spelled.select(normalize(F.col("form")).alias("norm"), "ord", "capability_id")
    return rows.groupBy("norm").agg(F.max_by("capability_id", "ord").alias("capability_id"))


def match_index(names: DataFrame, existing: DataFrame) -> DataFrame:
    """names(norm) plus by_id, the record of the same slug, and by_alias, that of the same alias; NULL where there is none."""
    known = existing.select(F.col("capability_id").alias("slug"), F.col("capability_id").alias("by_id")).distinct()
    aliases = alias_index(existing).select("norm", F.col("capability_id").alias("by_alias"))
    slugged = names.withColumn("slug", F.replace("norm", F.lit(" "), F.lit("_")))
    return slugged.join(known, "slug", "left").join(aliases, "norm", "left")


def last_before(asked: DataFrame, events: DataFrame) -> DataFrame:
    """asked(norm, seq) with ``value`` of the last of events(norm, seq, value) before it, NULL if there is none.

    Sorts within stretches of ``STRETCH`` numbers of a key; what a stretch ends with is handed on by a
    second window over one row per stretch. A key with a large share of all rows is thus many tasks' work.
    """
    kind = events.schema["value"].dataType
    stretch = F.floor(F.col("seq") / STRETCH).alias("stretch")
    both = asked.select("norm", "seq", stretch, F.lit(None).cast(kind).alias("value"), F.lit(True).alias("asked")).unionByName(
        events.select("norm", "seq", stretch, "value", F.lit(False).alias("asked"))
    )
    within = Window.partitionBy("norm", "stretch").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.last("value", ignorenulls=True).over(within)).where("asked")
    ends = both.groupBy("norm", "stretch").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("seq"))).alias("end"))
    earlier = Window.partitionBy("norm").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    far = ends.select("norm", "stretch", F.last("end", ignorenulls=True).over(earlier).alias("far"))
    return near.join(far, ["norm", "stretch"]).select("norm", "seq", F.coalesce("near", "far").alias("value"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``seq``, numbers that follow ``order``.

    They come from a range sort, so no task sees all rows, and are written out before use, since they
    depend on how the sort was dealt.
    """
    return stage(rows.orderBy(*order).withColumn("seq", F.monotonically_increasing_id()), "numbered")


def resolve_names(mentions: DataFrame, existing: DataFrame, nearest: DataFrame | None = None) -> DataFrame:
    """mentions(seq, name, alias) with capability_id and whether the mention creates the record.

    As if mentions were taken one by one in ``seq`` order: a name is looked up by slug, then among the
    aliases met so far, then in ``nearest`` (norm, capability_id), the records of the index that are close
    by embedding; what is found nowhere starts a record. A mention adds its alias where nobody owns it,
    and one that starts a record takes the alias over from whoever owns it.

    Whether a name starts a record follows from first appearances alone. A name that is only an alias
    leads, at any time, to the record of the last starting mention so far that gave this alias, else to
    the index, else to wherever the first mention that gave it leads. The last kind are pointers between
    names to earlier mentions; they are followed with path lengths doubled per round.
    """
    rows = mentions.withColumn("_norm", normalize(F.col("name"))).withColumn("_alias", F.nullif(normalize(F.col("alias")), F.lit("")))
    offers = rows.where(F.col("_alias") != F.col("_norm")).select(F.col("_alias").alias("norm"), F.col("seq").alias("by_seq"), F.col("_norm").alias("by_norm"))
    first = match_index(rows.groupBy(F.col("_norm").alias("norm")).agg(F.min("seq").alias("first_seq")), existing)
    offered = offers.groupBy("norm").agg(F.min(F.struct("by_seq", "by_norm")).alias("by"))
    close = first.select("norm").limit(0).withColumn("near", F.lit(None).cast("string")) if nearest is None else (
        nearest.groupBy("norm").agg(F.min("capability_id").alias("near")))
    creates = F.coalesce("by_id", "by_alias", "near").isNull() & F.coalesce(F.col("by.by_seq") >= F.col("first_seq"), F.lit(True))
    names = first.join(offered, "norm", "left").join(close, "norm", "left").withColumn("creates", creates)
    names = stage(names.withColumn("fixed", F.when(F.col("creates"), F.col("slug")).otherwise(F.col("by_id"))), "names")

    started = names.where("creates").select(F.col("norm").alias("by_norm"), F.col("first_seq").alias("by_seq"), F.col("slug").alias("value"))
    taken = offers.join(started, ["by_norm", "by_seq"]).select("norm", F.col("by_seq").alias("seq"), "value")
    floating = names.where("fixed IS NULL").select("norm").join(taken.select("norm").distinct(), "norm", "left_semi")
    asked = rows.select(F.col("_norm").alias("norm"), "seq").distinct().join(floating, "norm", "left_semi")
    owned = last_before(asked, taken.join(floating, "norm", "left_semi")).select("norm", "seq", F.col("value").alias("owner"))

    told = rows.select(F.col("_norm").alias("norm"), "seq").distinct().join(names, "norm").join(owned, ["norm", "seq"], "left")
    given = F.col("by.by_seq") < F.col("seq")
    settled = F.coalesce("fixed", "owner", "by_alias", F.when(~F.coalesce(given, F.lit(False)), F.col("near")))
    told = stage(told.select("norm", "seq", settled.alias("settled"), (F.col("creates") & (F.col("seq") == F.col("first_seq"))).alias("created")), "told")

    led = told.select(F.col("norm").alias("up"), F.col("seq").alias("by_seq"), "settled")
    pointed = names.where("fixed IS NULL AND by IS NOT NULL").select("norm", F.col("by.by_norm").alias("up"), F.col("by.by_seq").alias("by_seq"))
    pointed = stage(pointed.join(led, ["up", "by_seq"]).select(
        "norm", F.when(F.col("settled").isNull(), F.col("up")).alias("up"), F.col("settled").alias("base")), "pointed")
    while not pointed.where("up IS NOT NULL").isEmpty():
        onward = pointed.select(F.col("norm").alias("up"), F.col("up").alias("next"), F.col("base").alias("far"))
        pointed = stage(pointed.join(onward, "up", "left").select("norm", F.col("next").alias("up"), F.coalesce("base", "far").alias("base")), "pointed")

    answers = told.join(pointed.select("norm", "base"), "norm", "left").select(
        F.col("norm").alias("_norm"), "seq", F.coalesce("settled", "base").alias("capability_id"), "created")
    return rows.join(answers, ["_norm", "seq"]).select(*[rows[c] for c in mentions.columns], "capability_id", "created")


def save_summary(resolved: DataFrame) -> DataFrame:
    """One row: records created and mentions merged."""
    return resolved.agg(F.count_if("created").alias("created"), F.count_if(~F.col("created")).alias("merged"))


def similarity_threshold(norm: Column) -> Column:
    """Abbreviations must be closer before they merge."""
    return F.when(is_abbreviation(norm), settings.ABBREVIATION_THRESHOLD).otherwise(settings.EMBEDDING_THRESHOLD)


# ---------------------------------------------------------------------------
# Nearest record by embedding
# ---------------------------------------------------------------------------

def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.array(vectors.tolist(), dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * units @ pivots.T))


def nearest_records(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """Best record per mention by cosine similarity: (id, capability_id, similarity).

    mentions(id, vector, threshold), index(ord, capability_id, vector). Exact: the index is cut into
    cells around a few pivots; a mention visits a cell only if the triangle inequality leaves room
    for a record within its threshold. Cells are split into blocks and mentions into chunks of
    bounded size, so a crowded cell becomes many tasks; each task keeps one best record per mention.
    """
    seeds = index.orderBy(F.xxhash64("capability_id"), "capability_id").limit(PIVOTS).select("vector").toPandas()
    if seeds.empty:
        return mentions.select("id", F.lit(None).cast("string").alias("capability_id"), F.lit(0.0).alias("similarity")).limit(0)
    pivots = _unit(seeds["vector"])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = _distances(_unit(batch["vector"]), pivots)
                yield batch.assign(cell=far.argmin(axis=1).astype("int32"), reach=far.min(axis=1))

    kept = index.select("ord", "capability_id", "vector")
    cells = kept.mapInPandas(assign, "ord long, capability_id string, vector array<double>, cell int, reach double")
    cells = stage(cells, "cells")
    shape = {r["cell"]: (r["n"], r["radius"]) for r in cells.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")).collect()}  # one row per pivot
    blocks = {c: ceil(n / BLOCK_ROWS) for c, (n, _) in shape.items()}
    chunks = max(1, ceil(mentions.count() / CHUNK_ROWS))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            far = _distances(_unit(batch["vector"]), pivots)
            within = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * batch["threshold"].to_numpy()))
            for cell, (_, radius) in shape.items():
                rows = batch[far[:, cell] <= radius + within + 1e-9]
                for block in range(blocks[cell]):
                    yield rows.assign(cell=np.int32(cell), block=np.int32(block))

    table = F.create_map(*[F.lit(x) for c, n in blocks.items() for x in (c, n)])
    stored = cells.withColumn("block", F.pmod(F.xxhash64("capability_id"), F.element_at(table, F.col("cell"))).cast("int"))
    stored = stored.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = mentions.select(F.col("id").cast("string").alias("id"), "vector", "threshold").mapInPandas(
        visit, "id string, vector array<double>, threshold double, cell int, block int"
    ).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": [], "capability_id": [], "ord": [], "similarity": []})
        if left.empty or right.empty:
            return empty
        right = right.sort_values("ord", kind="stable").reset_index(drop=True)
        records = _unit(right["vector"]).T
        found = []
        for start in range(0, len(left), 1024):
            part = left.iloc[start:start + 1024]
            scores = _unit(part["vector"]) @ records
            top = scores.argmax(axis=1)
            value = scores[np.arange(len(part)), top]
            good = (value >= part["threshold"].to_numpy() - 1e-12) & (value > 0)
            found.append(pd.DataFrame({
                "id": part["id"].to_numpy()[good], "capability_id": right["capability_id"].to_numpy()[top[good]],
                "ord": right["ord"].to_numpy()[top[good]], "similarity": value[good],
            }))
        return pd.concat(found) if found else empty

    keys = ["cell", "block", "chunk"]
    pairs = asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(
        best, "id string, capability_id string, ord long, similarity double"
    )
    top = pairs.groupBy("id").agg(F.max_by(F.struct("capability_id", "similarity"), F.struct("similarity", -F.col("ord"))).alias("t"))
    return top.select("id", "t.capability_id", "t.similarity")
