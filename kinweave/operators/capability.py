"""Capabilities: filtering of extracted ones, evidence, per-author aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.functions.scoring import decay
from kinweave.functions.text import capability_kind, evidence_in_text, is_generic, normalize, strip
from kinweave.operators.upsert import insert_only, overwrite
from kinweave.schemas import TABLE_KEYS

EXTRACTED_SCHEMA = "array<struct<name:string,normalized_name:string,kind:string,evidence:string,confidence:string>>"


def parse_extracted(raw: DataFrame) -> DataFrame:
    """Raw items (item STRUCT of strings) to typed capabilities; rows without name, evidence or number drop out."""
    item = lambda field: strip(F.coalesce(F.col(f"item.{field}"), F.lit("")))
    named = item("normalized_name")
    rows = raw.select(
        *[c for c in raw.columns if c != "item"],
        item("name").alias("name"),
        F.when(named != "", named).otherwise(item("name")).alias("normalized_name"),
        capability_kind(F.coalesce(F.col("item.kind"), F.lit("UNKNOWN"))).alias("kind"),
        item("evidence").alias("evidence"),
        F.coalesce(F.col("item.confidence"), F.lit("0.0")).try_cast("double").alias("confidence"),
    )
    return rows.where((F.col("name") != "") & (F.col("evidence") != "") & F.col("confidence").isNotNull())


def accept(
    capabilities: DataFrame,
    title: Column,
    abstract: Column,
    keywords: Column,
    min_confidence: float = settings.MIN_CONFIDENCE,
    stop_terms: list[str] | None = None,
) -> DataFrame:
    """Keep confident, specific capabilities whose evidence is quoted from the publication."""
    kept = capabilities.where(
        (F.col("confidence") >= min_confidence)
        & ~is_generic(F.col("name"), stop_terms)
        & evidence_in_text(F.col("evidence"), title, abstract, keywords)
    )
    return kept.withColumn("normalized_name", normalize(F.col("normalized_name")))


def evidence_rows(wrote: DataFrame, evidences: DataFrame, projects: DataFrame, version: str | None = None) -> DataFrame:
    """(person_id, project_id, year, capability_id, confidence) for one extraction version."""
    chosen = evidences if version is None else evidences.where(F.col("extraction_version") == version)
    return (
        chosen.select("project_id", "capability_id", "confidence")
        .join(projects.select("project_id", "year"), "project_id")
        .join(wrote.select("person_id", "project_id"), "project_id")
    )


def aggregate_capabilities(
    evidence: DataFrame,
    reference_year: int,
    half_life: float = settings.EVIDENCE_HALF_LIFE_YEARS,
    skip_prefix: str = settings.PLACEHOLDER_PREFIX,
) -> DataFrame:
    """Per (person, capability): counts, mean confidence, years, recency score. No evidence gate yet.

    Two plain aggregation levels, first per publication and then per pair, replace the distinct
    counts: both combine on the map side and neither keeps a set in memory.
    """
    pair = ["person_id", "capability_id"]
    rows = evidence.where(~F.startswith("person_id", F.lit(skip_prefix)))
    confidence = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    publications = rows.groupBy(*pair, "project_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(confidence).alias("confidence"),
        F.max("year").alias("newest"), F.min("year").alias("oldest"),
    )
    cutoff = F.lit(reference_year - half_life)
    return publications.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("publication_count"),
        F.sum("n").alias("evidence_count"),
        (F.sum("confidence") / F.sum("n")).alias("avg_confidence"),
        F.count_if(F.col("newest") >= cutoff).alias("recent_publication_count"),
        F.min("oldest").alias("first_seen_year"),
        F.max("newest").alias("last_seen_year"),
        F.least(
            F.lit(1.0), F.sum(decay(F.col("oldest"), reference_year, half_life)) / F.count(F.lit(1))
        ).alias("score"),
    )


def gate(aggregates: DataFrame, min_evidence: int = settings.MIN_EVIDENCE_COUNT) -> DataFrame:
    """Pairs with enough evidence rows."""
    return aggregates.where(F.col("evidence_count") >= min_evidence)


def gate_summary(aggregates: DataFrame, min_evidence: int = settings.MIN_EVIDENCE_COUNT) -> DataFrame:
    """(written, skipped_low_evidence, skipped_placeholder); placeholders never reach the aggregates."""
    enough = F.col("evidence_count") >= min_evidence
    return aggregates.agg(
        F.count_if(enough).alias("written"),
        F.count_if(~enough).alias("skipped_low_evidence"),
        F.lit(0).cast("long").alias("skipped_placeholder"),
    )


def has_capability_rows(
    aggregates: DataFrame,
    extraction_version: str = settings.EXTRACTION_VERSION,
    aggregation_version: str = settings.AGGREGATION_VERSION,
) -> DataFrame:
    """Gated aggregates in the column layout of the has_capability table."""
    return gate(aggregates).select(
        F.col("person_id").alias("author"), F.col("capability_id").alias("capability"),
        F.lit(extraction_version).alias("extractionVersion"), F.lit(aggregation_version).alias("aggregationVersion"),
        F.lit(True).alias("inferred"), F.col("publication_count").alias("publicationCount"),
        F.col("evidence_count").alias("evidenceCount"), F.col("avg_confidence").alias("avgExtractionConfidence"),
        F.col("recent_publication_count").alias("recentPublicationCount"),
        F.col("first_seen_year").alias("firstSeenYear"), F.col("last_seen_year").alias("lastSeenYear"), "score",
    )


def merge_has_capability(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the same author, capability and versions are replaced; other versions stay beside them."""
    return overwrite(existing, new, TABLE_KEYS["has_capability"])


def merge_evidence(existing: DataFrame, new: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Evidence is written once per (project, capability, extraction version) and never refreshed."""
    return insert_only(existing, new, TABLE_KEYS["evidences_capability"], order)


def merge_capabilities(existing: DataFrame, new: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Capability nodes are created once; later sightings change nothing."""
    return insert_only(existing, new, TABLE_KEYS["capability"], order)


def evidence_edges(
    capabilities: DataFrame, extracted_at: str, model: str,
    extraction_version: str = settings.EXTRACTION_VERSION, prompt_version: str = settings.PROMPT_VERSION,
) -> DataFrame:
    """Resolved capabilities (project_id, capability_id, confidence, evidence) as provenance-carrying edges."""
    return capabilities.select(
        F.col("project_id").alias("project"), F.col("capability_id").alias("capability"),
        F.lit(extraction_version).alias("extractionVersion"), F.lit(True).alias("inferred"),
        F.lit("llm").alias("extractionMethod"), F.lit(model).alias("model"),
        F.lit(prompt_version).alias("promptVersion"), "confidence",
        F.col("evidence").alias("evidenceText"), F.lit(extracted_at).alias("extractedAt"),
    )
