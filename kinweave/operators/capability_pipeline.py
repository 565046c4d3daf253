"""From publications to author capabilities: answers, resolution, nodes, evidence, aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.functions.text import normalize
from kinweave.operators import capability as cap
from kinweave.operators import extraction
from kinweave.operators.resolve import numbered, resolve_names
from kinweave.operators.upsert import first_wins
from kinweave.schemas import TABLE_KEYS
from kinweave.session import stage
from kinweave.sources import sinks

ANSWERS_SCHEMA = f"key string, project_id string, response string, asked_at string, {sinks.BATCH} string"
VERSIONS = ["extractionVersion", "aggregationVersion"]


@dataclass
class Saved:
    """Every accepted mention with its record, new capability nodes, evidence edges."""

    mentions: DataFrame
    nodes: DataFrame
    edges: DataFrame


def no_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "ord string, capability_id string, name string, aliases array<string>")


def save_extraction(
    accepted: DataFrame, existing: DataFrame, extracted_at: str, model: str, nearest: DataFrame | None = None,
) -> Saved:
    """Resolve accepted(project_id, pos, name, normalized_name, kind, confidence, evidence) in the order of project and place."""
    surface = F.when(F.col("name") != F.col("normalized_name"), F.col("name"))
    rows = numbered(accepted.select("project_id", "pos", F.col("normalized_name").alias("name"), surface.alias("alias"), "kind", "confidence", "evidence"),
                    "project_id", "pos")
    mentions = stage(resolve_names(rows, existing, nearest), "resolved")
    other = F.col("alias").isNotNull() & (normalize(F.col("alias")) != normalize(F.col("name")))
    nodes = mentions.where("created").select(
        F.col("capability_id").alias("id"), "name", "kind", F.when(other, F.array("alias")).otherwise(F.array().cast("array<string>")).alias("aliases"))
    firsts = first_wins(mentions.where("capability_id IS NOT NULL").select("project_id", "capability_id", "seq", "confidence", "evidence"),
                        ["project_id", "capability_id"], ["seq"])
    return Saved(mentions, nodes, cap.evidence_edges(firsts, extracted_at, model))


def save_counts(mentions: DataFrame) -> DataFrame:
    """(project_id, created, merged, skipped): records started, mentions of known ones, mentions without a record."""
    found = F.col("capability_id").isNotNull()
    return mentions.groupBy("project_id").agg(
        F.count_if(found & F.col("created")).alias("created"), F.count_if(found & ~F.col("created")).alias("merged"),
        F.count_if(~found).alias("skipped"),
    )


def author_capabilities(edges: DataFrame, wrote: DataFrame, projects: DataFrame, reference_year: int) -> DataFrame:
    """Rows of has_capability out of the evidence edges of the current extraction version."""
    current = edges.select(F.col("project").alias("project_id"), F.col("capability").alias("capability_id"), "confidence",
                           F.col("extractionVersion").alias("extraction_version"))
    evidence = cap.evidence_rows(wrote, current, projects, settings.EXTRACTION_VERSION)
    return cap.has_capability_rows(cap.aggregate_capabilities(evidence, reference_year))


def publications(spark: SparkSession, tables: str) -> DataFrame:
    """(project_id, title, abstract, keywords, domains) of the ingested tables."""
    read = lambda name: sinks.read_table(spark, f"{tables}/{name}")
    names = read("research_domains").select(F.col("id").alias("domainId"), F.coalesce("name", "id").alias("domain"))
    domains = read("project_research_domains").join(names, "domainId").groupBy(F.col("projectHalId").alias("project_id")).agg(
        F.array_sort(F.collect_set("domain")).alias("domains"))
    none = F.array().cast("array<string>")
    rows = read("projects").select(F.col("halId").alias("project_id"), F.coalesce("title", F.lit("")).alias("title"),
                                   F.coalesce("abstract", F.lit("")).alias("abstract"), F.coalesce("keywords", none).alias("keywords"))
    return rows.join(domains, "project_id", "left").withColumn("domains", F.coalesce("domains", none))


def extract_to_tables(
    spark: SparkSession, tables: str, backend: extraction.CapabilityBackend, model: str, stamp: str, reference_year: int,
    project_id: str | None = None, limit: int | None = None, offset: int = 0, resume: bool = False, dry_run: bool = False,
) -> dict[str, int]:
    """Ask for the chosen publications and bring capability, evidences_capability and has_capability up to date.

    With ``resume`` answers kept earlier are used instead of calls. New answers are kept before anything
    else is written. A dry run asks and counts but writes none of the tables. Each write may be repeated:
    nodes and evidence are added once per key, aggregates replace those of the same versions.
    """
    chosen = publications(spark, tables)
    if project_id is not None:
        chosen = chosen.where(F.col("project_id") == project_id)
    if limit is not None or offset:
        page = chosen.orderBy("project_id").offset(offset)
        chosen = page if limit is None else page.limit(limit)
    chosen = stage(chosen, "publications")
    kept = sinks.read_table(spark, f"{tables}/capability_answers", ANSWERS_SCHEMA) if resume else None
    cache = None if kept is None else kept.groupBy("key").agg(
        F.max_by(F.struct("project_id", "response"), "asked_at").alias("last")).select("key", "last.*")
    answers = stage(extraction.capability_responses(chosen, backend, model, cache), "answers")
    if not dry_run:
        fresh = answers.where("response IS NOT NULL").select("key", "project_id", "response", F.lit(stamp).alias("asked_at"))
        fresh = fresh if cache is None else fresh.join(cache.select("key"), "key", "left_anti").select(*fresh.columns)
        sinks.append_new(f"{tables}/capability_answers", fresh, ["key", "asked_at"])

    nodes = sinks.read_table(spark, f"{tables}/capability")
    existing = no_records(spark) if nodes is None else nodes.select(F.col("id").alias("ord"), F.col("id").alias("capability_id"), "name", "aliases")
    saved = save_extraction(extraction.accepted_capabilities(chosen, answers), existing, stamp, model)
    counts = save_counts(saved.mentions).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("created", "merged", "skipped")]).first().asDict()
    counts |= answers.agg(F.count("*").alias("asked"), F.count("error").alias("failed")).first().asDict()
    if dry_run:
        return counts
    sinks.append_new(f"{tables}/capability", saved.nodes, TABLE_KEYS["capability"])
    sinks.append_new(f"{tables}/evidences_capability", saved.edges, TABLE_KEYS["evidences_capability"])
    edges = sinks.read_table(spark, f"{tables}/evidences_capability")
    wrote = sinks.read_table(spark, f"{tables}/project_authors").select(F.col("authorHalId").alias("person_id"), F.col("projectHalId").alias("project_id"))
    years = sinks.read_table(spark, f"{tables}/projects").select(F.col("halId").alias("project_id"), F.col("publicationYear").alias("year"))
    sinks.replace_partitions(f"{tables}/has_capability", author_capabilities(edges, wrote, years, reference_year), VERSIONS)
    return counts
