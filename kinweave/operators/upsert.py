"""Key-based deduplication and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``.

    An aggregate rather than a ranking window: each task keeps one row per key before the
    shuffle, so a key that holds a third of the input costs no more than any other.
    """
    return _pick(rows, keys, order, F.min_by)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``."""
    return _pick(rows, keys, order, F.max_by)


def _pick(rows: DataFrame, keys: list[str], order: list[str], choose) -> DataFrame:
    payload = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(choose(F.struct(*payload), F.struct(*order)).alias("picked"))
    return picked.select(*keys, "picked.*")


def insert_only(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Existing rows stay as they are; new keys are added once."""
    fresh = first_wins(new, keys, order) if order else new.dropDuplicates(keys)
    return existing.unionByName(fresh.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def overwrite(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace existing rows of the same key."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*existing.columns))


def with_bare_endpoints(nodes: DataFrame, edges: DataFrame, key: str, endpoints: list[str]) -> DataFrame:
    """Add a row without properties for each edge endpoint that has no node row."""
    ids = None
    for column in endpoints:
        side = edges.select(F.col(column).alias(key)).where(F.col(key).isNotNull())
        ids = side if ids is None else ids.union(side)
    bare = ids.distinct().join(nodes.select(key), key, "left_anti")
    return nodes.unionByName(bare, allowMissingColumns=True)
