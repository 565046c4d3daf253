"""The eleven canonical tables derived from raw records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators import authors, domains, organizations, publications
from kinweave.operators.upsert import first_wins
from kinweave.schemas import CANONICAL_TABLES, TABLE_KEYS
from kinweave.session import stage


def with_project_id(records: DataFrame) -> DataFrame:
    """Add the publication identifier every extractor keys its links by."""
    return records.withColumn("projectHalId", publications.project_id(F.col("doc")))


def _links(rows: DataFrame, source: str, target: str) -> DataFrame:
    return rows.withColumnRenamed(source, target)


EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "projects": publications.extract_projects,
    "authors": authors.extract_authors,
    "conferences": publications.extract_conferences,
    "organizations": organizations.extract_organizations,
    "research_domains": domains.extract_domains,
    "project_authors": lambda r: _links(authors.extract_authors(r), "halId", "authorHalId"),
    "project_conferences": publications.extract_conferences,
    "project_organizations": lambda r: _links(organizations.extract_organizations(r), "halId", "organizationHalId"),
    "organization_relationships": organizations.extract_part_of,
    "project_research_domains": domains.extract_domain_links,
    "research_domain_hierarchy": domains.extract_hierarchy,
}


#: Everything the tables are made of, by the name of its builder; each is worked out once for a record.
PARTS: list[Callable[[Column], Column]] = [
    publications.project_fields, publications.conference_array, authors.author_array, organizations.organization_array,
    organizations.part_of_array, domains.domain_array, domains.main_code, domains.association_codes, domains.hierarchy_array,
]


def open_records(records: DataFrame) -> DataFrame:
    """Records as plain columns and arrays, written out: a table reads its own columns and parses nothing."""
    return stage(with_project_id(records).select("doc_ord", "projectHalId", *[part(F.col("doc")).alias(part.__name__) for part in PARTS]), "opened")


def canonical_table(records: DataFrame, name: str) -> DataFrame:
    """One canonical table; of several rows with one key the first in document order wins."""
    rows = EXTRACTORS[name](records if "projectHalId" in records.columns else with_project_id(records))
    keys, columns = TABLE_KEYS[name], CANONICAL_TABLES[name]
    if keys == columns:
        return rows.select(*columns).distinct()
    return first_wins(rows.select("doc_ord", "pos", *columns), keys, ["doc_ord", "pos"]).select(*columns)


def canonical_tables(records: DataFrame) -> dict[str, DataFrame]:
    """All eleven tables, each its own lazy plan over records that are opened once."""
    records = open_records(records)
    return {name: canonical_table(records, name) for name in CANONICAL_TABLES}
