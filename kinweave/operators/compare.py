"""Comparison of expected tables with what a store actually holds.

Both sides are first reduced to one digest for each bucket of keys, independent of row order. Only rows of
buckets whose digests differ are joined, so a store that mostly agrees costs two scans and a narrow join.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.schemas import CANONICAL_TABLES, ENTITY_TABLES, RELATION_ENDPOINTS, TABLE_KEYS
from kinweave.session import stage, stage_all

#: Key buckets of a table; their digests are at most so many rows, whatever the table holds.
BUCKETS = 4096


def compare_entities(name: str, expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(table, id, code, field, expected, actual) findings.

    Codes: missing_node, duplicate_node, field_mismatch. Of several actual rows the smallest is compared.
    """
    shown = actual.groupBy(F.col(key).cast("string").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*fields)).alias("actual")
    )
    wanted = expected.select(F.col(key).cast("string").alias("id"), F.struct(*fields).alias("expected"))
    joined = wanted.join(shown, "id", "left")

    def finding(condition, code: str, field=None, left=None, right=None):
        none = F.lit(None).cast("string")
        return F.when(condition, F.struct(
            F.lit(code).alias("code"), (none if field is None else F.lit(field)).alias("field"),
            (none if left is None else left).alias("expected"), (none if right is None else right).alias("actual"),
        ))

    def shown_text(side: str, field: str):
        return F.to_json(F.struct(F.col(f"{side}.{field}").alias("v")))

    found = F.array(
        finding(F.col("n").isNull(), "missing_node"),
        finding(F.col("n") > 1, "duplicate_node", None, F.lit("1"), F.col("n").cast("string")),
        *[
            finding(
                F.col("n").isNotNull() & ~F.col(f"expected.{f}").eqNullSafe(F.col(f"actual.{f}")),
                "field_mismatch", f, shown_text("expected", f), shown_text("actual", f),
            )
            for f in fields
        ],
    )
    rows = joined.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
    return rows.select(F.lit(name).alias("table"), "id", "f.*")


def compare_relations(name: str, expected: DataFrame, actual: DataFrame, source: str, target: str) -> DataFrame:
    """(table, source, target, code, expected_count, actual_count): missing, duplicate or unexpected edges."""

    def counted(df: DataFrame, alias: str) -> DataFrame:
        ends = df.select(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target"))
        return ends.groupBy("source", "target").agg(F.count(F.lit(1)).alias(alias))

    joined = counted(expected, "e").join(counted(actual, "a"), ["source", "target"], "full_outer")
    e, a = F.coalesce("e", F.lit(0)), F.coalesce("a", F.lit(0))
    code = F.when(F.col("e").isNull(), "unexpected").when(a < e, "missing").when(a > e, "duplicate")
    rows = joined.select("source", "target", code.alias("code"), e.alias("expected_count"), a.alias("actual_count"))
    return rows.where(F.col("code").isNotNull()).select(F.lit(name).alias("table"), "*")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), F.lit(buckets)).cast("int")


def bucket_digests(rows: DataFrame, keys: list[str], fields: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, mixed, total): count, exclusive or and sum of row hashes; equal for equal rows in any order."""
    text = F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys], *fields), {"ignoreNullFields": "false"})
    hashed = rows.select(_bucket(keys, buckets).alias("bucket"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))
    return hashed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("mixed"), F.sum(F.col("g").cast("decimal(38,0)")).alias("total"))


def differing_buckets(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, differs, actual_n): one row for each bucket that either side fills."""
    left, right = (bucket_digests(side, keys, fields, buckets) for side in (expected, actual))
    both = left.withColumnsRenamed({"n": "n1", "mixed": "m1", "total": "t1"}).join(right, "bucket", "full_outer")
    same = (F.col("n1") == F.col("n")) & (F.col("m1") == F.col("mixed")) & (F.col("t1") == F.col("total"))
    return both.select("bucket", (~F.coalesce(same, F.lit(False))).alias("differs"), F.coalesce("n", F.lit(0)).alias("actual_n"))


def _fields(name: str) -> tuple[list[str], list[str]]:
    """Key columns and compared columns; edges are compared by their ends alone."""
    if name in RELATION_ENDPOINTS:
        return list(RELATION_ENDPOINTS[name]), []
    return TABLE_KEYS[name], [c for c in CANONICAL_TABLES[name] if c not in TABLE_KEYS[name]]


@dataclass(frozen=True)
class Comparison:
    """Findings of entities and relations, and one summary row for each table."""

    entities: DataFrame
    relations: DataFrame
    summary: DataFrame


def compare_tables(expected: dict[str, DataFrame], actual: dict[str, DataFrame], buckets: int = BUCKETS) -> Comparison:
    """All canonical tables. Edges of another corpus in the store are no findings, nor are nodes nobody expects."""
    maps = stage_all({name: differing_buckets(expected[name], actual[name], *_fields(name), buckets) for name in CANONICAL_TABLES})

    def narrowed(side: dict[str, DataFrame], name: str) -> DataFrame:
        keys, _ = _fields(name)
        # at most ``buckets`` rows on the other side
        wanted = F.broadcast(maps[name].where("differs").select("bucket"))
        return side[name].withColumn("bucket", _bucket(keys, buckets)).join(wanted, "bucket", "left_semi").drop("bucket")

    entities = reduce(DataFrame.unionByName, [
        compare_entities(name, narrowed(expected, name), narrowed(actual, name), TABLE_KEYS[name][0], _fields(name)[1]) for name in ENTITY_TABLES])
    scoped = scope_relations(expected, {name: narrowed(actual, name) for name in RELATION_ENDPOINTS})
    relations = reduce(DataFrame.unionByName, [
        compare_relations(name, narrowed(expected, name), scoped[name], *ends) for name, ends in RELATION_ENDPOINTS.items()])
    lists = stage_all({"entities": entities, "relations": relations})

    none = F.lit(0).cast("long")
    counts = [expected[name].agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("expected_count")) for name in CANONICAL_TABLES]
    held = [maps[name].agg(F.lit(name).alias("table"), F.coalesce(F.sum(F.when(~F.col("differs"), F.col("actual_n"))), none).alias("actual_count"))
            for name in RELATION_ENDPOINTS]
    held += [scoped[name].agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("actual_count")) for name in RELATION_ENDPOINTS]
    codes = lists["entities"].select("table", "id", "code").distinct().select("table", "code").unionAll(lists["relations"].select("table", "code"))
    kinds = {"missing": ["missing_node", "missing"], "duplicate": ["duplicate_node", "duplicate"], "mismatched": ["field_mismatch"], "unexpected": ["unexpected"]}
    counted = codes.groupBy("table").agg(*[F.count_if(F.col("code").isin(c)).alias(k) for k, c in kinds.items()])
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*counts, *held, counted])
    summary = parts.groupBy("table").agg(*[F.coalesce(F.sum(c), none).alias(c) for c in ("expected_count", "actual_count", *kinds)])
    nodes = F.col("table").isin(ENTITY_TABLES)
    summary = summary.select("table", "expected_count", F.when(~nodes, F.col("actual_count")).alias("actual_count"),
                             F.when(nodes, F.col("expected_count") - F.col("missing")).alias("matched_count"), *kinds)
    return Comparison(lists["entities"], lists["relations"], stage(summary, "summary"))


CAUSES = {
    "missing_node": "Nodes are absent: the load may be partial or of another snapshot.",
    "field_mismatch": "Properties differ: rows of known keys are not written again, so older values stay.",
    "duplicate_node": "Nodes share an identifier: keys were not enforced when they were written.",
    "relationship": "Relations differ: missing ones point to a partial load, unexpected ones to other records of the same publications or domains.",
    "input": "The input repeats publications; the canonical tables keep the first record of each.",
}


def comparison_report(found: Comparison, repeats: DataFrame | None = None) -> dict:
    """Counts for each table, errors and warnings, likely causes. ``repeats`` (id, n) are identifiers the input repeats.

    Finding lists stay tables, since they grow with the data.
    """
    tables = {r["table"]: {k: v for k, v in r.asDict().items() if k != "table" and v is not None} for r in found.summary.collect()}  # eleven rows
    extra = None if repeats is None else repeats.agg(F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")).first()
    entities = {n: t for n, t in tables.items() if n in ENTITY_TABLES}
    broken = [n for n, t in tables.items() if n in RELATION_ENDPOINTS and t["missing"] + t["duplicate"] + t["unexpected"]]
    counts = {code: sum(t[kind] for t in entities.values()) for code, kind in (
        ("missing_node", "missing"), ("duplicate_node", "duplicate"), ("field_mismatch", "mismatched"))}
    causes = [code for code in ("missing_node", "field_mismatch", "duplicate_node") if counts[code]]
    causes += ["relationship"] if broken else []
    causes += ["input"] if extra and extra["rows"] else []
    return {
        "summary": {
            "expected_project_count": tables["projects"]["expected_count"], "errors": sum(counts.values()) + len(broken),
            "warnings": int(bool(extra and extra["rows"])), "error_categories": {**counts, "relationship_mismatch": len(broken)},
        },
        "entities": entities, "relationships": {n: t for n, t in tables.items() if n in RELATION_ENDPOINTS},
        "source_duplicates": {} if extra is None else {"project_id_count": extra["ids"], "duplicate_project_record_count": extra["rows"]},
        "cause_hypotheses": [CAUSES[c] for c in causes],
    }


def write_comparison(report: dict, found: Comparison, output: str, findings: str | None = None) -> Path:
    """The report as one JSON file; with ``findings`` also both finding lists as tables below that folder."""
    path = Path(output)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    if findings:
        found.entities.write.mode("overwrite").parquet(f"{findings}/entities")
        found.relations.write.mode("overwrite").parquet(f"{findings}/relations")
    return path


def scope_relations(expected: dict[str, DataFrame], actual: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Actual edges that touch an expected project, organisation or domain; the rest is another corpus."""
    scoped = dict(actual)
    for name, (source, target) in RELATION_ENDPOINTS.items():
        if name.startswith("project_"):
            keys = expected["projects"].select(F.col("halId").alias(source))
            scoped[name] = actual[name].join(keys, source, "left_semi")
            continue
        entity = "organizations" if name == "organization_relationships" else "research_domains"
        keys = expected[entity].select(F.col(TABLE_KEYS[entity][0]).alias("key")).distinct()
        marked = actual[name].join(keys.withColumnRenamed("key", source), source, "left_semi")
        other = actual[name].join(keys.withColumnRenamed("key", source), source, "left_anti")
        scoped[name] = marked.unionByName(other.join(keys.withColumnRenamed("key", target), target, "left_semi"))
    return scoped
