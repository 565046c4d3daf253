"""Column order and keys of the canonical and inferred tables."""

# Table and column names, and the keys below.
CANONICAL_TABLES = {
    "projects": ["halId", "title", "abstract", "keywords", "documentType", "language",
                 "publicationDate", "publicationYear", "doi", "uri"],
    "authors": ["halId", "personId", "firstName", "lastName", "fullName", "emailDomain", "orcidId",
                "googleScholarId", "researcherId", "idrefId"],
    "conferences": ["conferenceId", "title", "startDate", "endDate", "city", "country"],
    "organizations": ["halId", "name", "acronym", "type", "country", "address", "code", "status",
                      "ror", "idref", "isni", "rnsr", "wikidata"],
    "research_domains": ["id", "name", "nameFr", "source"],
    "project_authors": ["projectHalId", "authorHalId"],
    "project_conferences": ["projectHalId", "conferenceId"],
    "project_organizations": ["projectHalId", "organizationHalId"],
    "organization_relationships": ["sourceId", "targetId", "type"],
    "project_research_domains": ["projectHalId", "domainId", "primary"],
    "research_domain_hierarchy": ["childId", "parentId"],
}

TABLE_KEYS = {
    "projects": ["halId"],
    "authors": ["halId"],
    "conferences": ["conferenceId"],
    "organizations": ["halId"],
    "research_domains": ["id"],
    "project_authors": ["projectHalId", "authorHalId"],
    "project_conferences": ["projectHalId", "conferenceId"],
    "project_organizations": ["projectHalId", "organizationHalId"],
    "organization_relationships": ["sourceId", "targetId", "type"],
    "project_research_domains": ["projectHalId", "domainId"],
    "research_domain_hierarchy": ["childId", "parentId"],
    "capability": ["id"],
    "evidences_capability": ["project", "capability", "extractionVersion"],
    "has_capability": ["author", "capability", "extractionVersion", "aggregationVersion"],
}

ENTITY_TABLES = ["projects", "authors", "conferences", "organizations", "research_domains"]

RELATION_ENDPOINTS = {
    "project_authors": ("projectHalId", "authorHalId"),
    "project_conferences": ("projectHalId", "conferenceId"),
    "project_organizations": ("projectHalId", "organizationHalId"),
    "project_research_domains": ("projectHalId", "domainId"),
    "organization_relationships": ("sourceId", "targetId"),
    "research_domain_hierarchy": ("childId", "parentId"),
}

# Node tables whose rows may be known from a hierarchy alone: (edges, key).
BARE_ENDPOINTS = {
    "organizations": ("organization_relationships", "halId"),
    "research_domains": ("research_domain_hierarchy", "id"),
}
