"""Snapshots of raw records: JSON lines plus a manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.functions.text import strip

TIMESTAMP_FORMAT = "yyyyMMdd'T'HHmmss'Z'"  # fixed format of snapshot stamps


class SnapshotError(ValueError):
    """The snapshot cannot be used as asked."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their document order.

    The order is (file, split offset, row within the split): it follows the text without a
    shuffle and without numbering the whole file in one place.
    """
    return _numbered(spark, path).where(strip(F.col("value")) != "")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return spark.read.text(path).select(place.alias("doc_ord"), "value")


def parse_lines(lines: DataFrame) -> DataFrame:
    """(doc_ord, value) lines to (doc_ord, doc VARIANT); broken lines give a NULL doc."""
    return lines.select("doc_ord", F.try_parse_json("value").alias("doc"))


def is_object(doc: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False))


def check_lines(spark: SparkSession, path: str) -> int:
    """Number of records; raises at the first line that is not a JSON object, naming its number."""
    lines = read_lines(spark, path)
    state = lines.select("doc_ord", F.try_parse_json("value").alias("doc"))
    marked = state.select(
        "doc_ord",
        F.when(F.col("doc").isNull(), 1).when(~is_object(F.col("doc")), 2).otherwise(0).alias("fault"),
    )
    found = marked.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("fault") > 0, F.struct("doc_ord", "fault"))).alias("bad")
    ).first()
    if found["bad"] is not None:
        bad = found["bad"]["doc_ord"]
        at = F.struct(*[F.lit(bad[part]).alias(part) for part in ("file", "block", "row")])
        number = _numbered(spark, path).where(F.col("doc_ord") <= at).count()
        if found["bad"]["fault"] == 1:
            raise SnapshotError(f"Invalid JSON on snapshot line {number}.")
        raise SnapshotError(f"Snapshot record on line {number} must be a JSON object.")
    return found["n"]


def load_subset(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The first ``limit`` records of a snapshot, for development loads."""
    if not 1 <= limit <= settings.DEV_SNAPSHOT_LIMIT:
        raise SnapshotError(f"Snapshot ingestion limit must be between 1 and {settings.DEV_SNAPSHOT_LIMIT}.")
    if check_lines(spark, path) == 0:
        raise SnapshotError(f"Snapshot contains no records: {path}")
    return parse_lines(read_lines(spark, path).orderBy("doc_ord").limit(limit))


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The one-object manifest; reading it through Spark reaches whatever store holds the snapshot."""
    try:
        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(2).collect())
    except Exception as exc:
        raise SnapshotError(f"Complete snapshot requires its manifest: {path}") from exc
    manifest = json.loads(text)
    if not isinstance(manifest, dict):
        raise SnapshotError("Snapshot manifest must be a JSON object.")
    return manifest


def check_manifest(manifest: dict) -> int:
    """The record count a complete snapshot promises."""
    if manifest.get("query") != settings.FULL_QUERY:
        raise SnapshotError(f"Full import requires a snapshot for the '{settings.FULL_QUERY}' query.")
    found, fetched = manifest.get("numFound"), manifest.get("fetched_count")
    if not isinstance(found, int) or not isinstance(fetched, int):
        raise SnapshotError("Manifest must contain integer numFound and fetched_count values.")
    if fetched != found:
        raise SnapshotError(f"Snapshot is incomplete: fetched {fetched} of {found} records.")
    if fetched < 1:
        raise SnapshotError("Snapshot contains no records.")
    return fetched


def load_complete(spark: SparkSession, path: str, manifest_path: str) -> DataFrame:
    """All records of a snapshot that matches its manifest and has no validation error."""
    from kinweave.operators.validation import document_issues

    manifest = read_manifest(spark, manifest_path)
    promised = check_manifest(manifest)
    present = check_lines(spark, path)
    if present != promised:
        raise SnapshotError(f"Snapshot holds {present} records, manifest says {promised}.")
    records = parse_lines(read_lines(spark, path))
    errors = document_issues(records).where(F.col("severity") == "error").groupBy("code").count().collect()
    if errors:
        listed = ", ".join(f"{r['code']}={r['count']}" for r in sorted(errors, key=lambda r: r["code"]))
        raise SnapshotError(f"Snapshot has validation errors: {listed}")
    return records


def build_manifest(
    query: str, fields: list[str], sort: str | None, num_found: int, fetched: int, timestamp: str,
    rows_per_page: int | None = None,
) -> dict:
    manifest = {
        "query": query, "requested_fields": fields, "sort": sort, "numFound": num_found,
        "fetched_count": fetched, "timestamp": timestamp,
    }
    if rows_per_page is not None:
        manifest["rows_per_page"] = rows_per_page
    return manifest
