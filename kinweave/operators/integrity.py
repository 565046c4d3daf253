"""Integrity checks of the property graph: one preventive, eight diagnostic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import is_placeholder, strip

# label -> (table, key column)
KEYED_LABELS = {
    "Project": ("projects", "halId"),
    "Author": ("authors", "halId"),
    "Conference": ("conferences", "conferenceId"),
    "ResearchDomain": ("research_domains", "id"),
    "Organization": ("organizations", "halId"),
}
# edge type -> (table, source column, target column)
EDGES = {
    "WROTE": ("project_authors", "authorHalId", "projectHalId"),
    "HAS_RESEARCH_DOMAIN": ("project_research_domains", "projectHalId", "domainId"),
    "PRESENTED_AT": ("project_conferences", "projectHalId", "conferenceId"),
    "HAS_ORGANIZATION": ("project_organizations", "projectHalId", "organizationHalId"),
    "SUBDOMAIN_OF": ("research_domain_hierarchy", "childId", "parentId"),
    "PART_OF": ("organization_relationships", "sourceId", "targetId"),
}
PREVENTIVE = ["unique_id_constraints"]

Tables = dict[str, DataFrame]


def duplicate_ids(tables: Tables) -> DataFrame:
    """(entity, id, duplicates) over all keyed labels."""
    keys = [
        tables[table].select(F.lit(label).alias("entity"), F.col(key).cast("string").alias("id"))
        for label, (table, key) in KEYED_LABELS.items()
    ]
    every = reduce(DataFrame.unionAll, keys).where(F.col("id").isNotNull())
    return every.groupBy("entity", "id").agg(F.count(F.lit(1)).alias("duplicates")).where(F.col("duplicates") > 1)


def unique_id_constraints(tables: Tables) -> DataFrame:
    """(label, property) of keys that do not hold; files cannot declare a key, so it is tested."""
    broken = duplicate_ids(tables).select("entity").distinct()
    keys = F.create_map(*[F.lit(x) for label, (_, key) in KEYED_LABELS.items() for x in (label, key)])
    return broken.select(F.col("entity").alias("label"), F.element_at(keys, F.col("entity")).alias("property"))


def _without(nodes: DataFrame, key: str, *links: tuple[DataFrame, str]) -> DataFrame:
    """Nodes that none of the link columns mention."""
    mentioned = reduce(DataFrame.union, [df.select(F.col(c).alias(key)) for df, c in links]).distinct()
    return nodes.join(mentioned, key, "left_anti")


def projects_without_authors(t: Tables) -> DataFrame:
    return _without(t["projects"], "halId", (t["project_authors"], "projectHalId")).select(F.col("halId").alias("project_id"))


def projects_without_domains(t: Tables) -> DataFrame:
    return _without(t["projects"], "halId", (t["project_research_domains"], "projectHalId")).select(F.col("halId").alias("project_id"))


def orphan_research_domains(t: Tables) -> DataFrame:
    edges = t["research_domain_hierarchy"]
    return _without(
        t["research_domains"], "id", (t["project_research_domains"], "domainId"), (edges, "childId"), (edges, "parentId")
    ).select(F.col("id").alias("domain_id"))


def orphan_organizations(t: Tables) -> DataFrame:
    edges = t["organization_relationships"]
    return _without(
        t["organizations"], "halId", (t["project_organizations"], "organizationHalId"), (edges, "sourceId"), (edges, "targetId")
    ).select(F.col("halId").alias("organization_id"))


def _blank(value: Column) -> Column:
    return F.coalesce(strip(value.cast("string")) == "", F.lit(True))


def bare_organizations(t: Tables) -> DataFrame:
    rows = t["organizations"].where(_blank(F.col("name")) | _blank(F.col("type")))
    return rows.select(F.col("halId").alias("organization_id"), "name", "type")


def relationship_multiplicity(t: Tables) -> DataFrame:
    """(relationship, source_id, target_id, multiplicity) of repeated edges."""
    pairs = [
        t[table].select(F.lit(kind).alias("relationship"), F.col(a).cast("string").alias("source_id"), F.col(b).cast("string").alias("target_id"))
        for kind, (table, a, b) in EDGES.items()
    ]
    counted = reduce(DataFrame.unionAll, pairs).groupBy("relationship", "source_id", "target_id")
    return counted.agg(F.count(F.lit(1)).alias("multiplicity")).where(F.col("multiplicity") > 1)


def unknown_authors(t: Tables) -> DataFrame:
    rows = t["authors"].where(is_placeholder(F.col("halId")))
    return rows.select(F.col("halId").alias("author_id"), F.col("fullName").alias("full_name"))


CHECKS = {
    "unique_id_constraints": unique_id_constraints,
    "duplicate_ids": duplicate_ids,
    "projects_without_authors": projects_without_authors,
    "projects_without_domains": projects_without_domains,
    "orphan_research_domains": orphan_research_domains,
    "orphan_organizations": orphan_organizations,
    "bare_organizations": bare_organizations,
    "relationship_multiplicity": relationship_multiplicity,
    "unknown_authors": unknown_authors,
}


def summary(tables: Tables) -> DataFrame:
    """(name, classification, status, finding_count) of all checks in one plan."""
    counts = [
        check(tables).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("finding_count")) for name, check in CHECKS.items()
    ]
    rows = reduce(DataFrame.unionAll, counts)
    return rows.select(
        "name",
        F.when(F.col("name").isin(PREVENTIVE), "preventive").otherwise("diagnostic").alias("classification"),
        F.when(F.col("finding_count") > 0, "findings").otherwise("pass").alias("status"),
        "finding_count",
    )


def totals(summary_rows: DataFrame) -> DataFrame:
    return summary_rows.agg(
        F.count(F.lit(1)).alias("check_count"),
        F.count_if(F.col("classification") == "preventive").alias("preventive_check_count"),
        F.count_if(F.col("classification") == "diagnostic").alias("diagnostic_check_count"),
        F.count_if(F.col("status") == "findings").alias("checks_with_findings"),
        F.sum("finding_count").alias("finding_count"),
    )
