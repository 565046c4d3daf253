"""Fixed values and run-time configuration."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

# ---------------------------------------------------------------------------
# Results depend on these being exactly what they are.
# ---------------------------------------------------------------------------

PLACEHOLDER_PREFIX = "unknown_"

RANKING_WEIGHTS = {
    "gap_match": 0.30,
    "domain_relevance": 0.15,
    "semantic": 0.15,
    "complementarity": 0.15,
    "project_similarity": 0.10,
    "graph": 0.10,
    "recency": 0.05,
}

MIN_CONFIDENCE = 0.5
MIN_EVIDENCE_COUNT = 2
EVIDENCE_HALF_LIFE_YEARS = 5.0
EXTRACTION_VERSION = "capability-v1"
PROMPT_VERSION = "prompt-v1"
AGGREGATION_VERSION = "agg-v1"
EMBEDDING_THRESHOLD = 0.92
ABBREVIATION_THRESHOLD = 0.97
ABBREVIATION_MAX_LENGTH = 6

RANKING_REFERENCE_YEAR = 2024
RANKING_HALF_LIFE_YEARS = 3.0
MAX_COAUTHOR_HOPS = 3
CANDIDATE_LIMIT = 50
TOP_K = 10

REQUIREMENT_VERSION = "req-v1"
REQUIREMENT_PROMPT_VERSION = "req-prompt-v1"
UNRESOLVED_IMPORTANCE_FACTOR = 0.7
DEFAULT_IMPORTANCE = 0.5
LOOKUP_IMPORTANCE = 0.8

MAX_DOMAIN_LEVELS = 3
DEV_SNAPSHOT_LIMIT = 2000
FULL_QUERY = "*:*"

CAPABILITY_KINDS = [
    "DOMAIN", "METHOD", "TECHNIQUE", "TECHNOLOGY", "TOOL", "TOPIC", "METHODOLOGY", "UNKNOWN",
]

GENERIC_TERMS = [
    "research", "study", "analysis", "results", "data", "method", "approach", "work", "paper",
    "article", "project", "system", "framework", "model", "technique", "experiment", "evaluation",
    "performance", "review", "survey", "application", "science", "engineering", "technology",
    "information", "computing", "software", "hardware", "algorithm", "process", "solution",
    "problem", "implementation", "development", "design",
]

QUERY_STOPWORDS = [
    # Portuguese
    "a", "o", "as", "os", "um", "uma", "uns", "umas", "de", "do", "da", "dos", "das", "em", "no",
    "na", "nos", "nas", "por", "pelo", "pela", "pelos", "pelas", "para", "com", "sem", "sobre",
    "entre", "que", "se", "ou", "e", "é", "são", "me", "te", "vos", "meu", "minha", "seu", "sua",
    "nosso", "nossa", "projeto", "pesquisa", "preciso", "busco", "procuro", "quero", "encontrar",
    # English
    "the", "an", "and", "or", "in", "on", "at", "to", "for", "with", "without", "by", "of", "from",
    "is", "are", "was", "were", "be", "been", "being", "have", "about", "has", "had", "does", "did",
    "project", "research", "study", "write", "writing", "article", "paper", "looking", "need",
    "want", "seeking", "find", "collaborator", "collaborators",
    # French
    "le", "la", "les", "un", "une", "des", "du", "dans", "en", "sur", "pour", "avec", "sans",
    "par", "et", "est", "sont", "projet", "recherche",
]
QUERY_MIN_TOKEN_LENGTH = 3
QUERY_MAX_KEYWORDS = 30

LANGUAGE_CODES = [
    "en", "fr", "de", "es", "it", "pt", "nl", "ru", "zh", "ja", "ko", "ar", "tr", "cs", "pl", "sv",
    "fi", "el", "hu", "uk", "he", "id", "da", "ro", "sl", "no", "ca", "th", "vi", "sr",
]
LANGUAGE_PATTERN = "^[A-Za-z]{2,3}(-[A-Za-z0-9]+)?$"
CITATION_PATTERN = r"\[([a-zA-Z0-9_.\-]+)\]"
DOMAIN_LABEL_SEPARATORS = ["_FacetSep_", "###", "##", "|"]

# Names of the record fields requested from the publication API, in the order the manifest states.
RECORD_FIELDS = [
    "halId_s", "docid", "title_s", "subTitle_s",
    "authFullName_s", "authIdPerson_i", "authIdHal_s", "authFirstName_s", "authLastName_s", "authEmailDomain_s",
    "authORCIDIdExt_s", "authGoogleScholarIdExt_s", "authResearcherIdIdExt_s", "authIdRefIdExt_s",
    "structId_i", "structName_s", "structAcronym_s", "structType_s", "structCountry_s", "structAddress_s",
    "structCode_s", "structValid_s", "structRorIdExt_s", "structIdrefIdExt_s", "structIsniIdExt_s",
    "structRnsrIdExt_s", "structWikidataIdExt_s", "structIsChildOf_fs",
    "conferenceTitle_s", "conferenceStartDate_s", "conferenceEndDate_s", "city_s", "country_s",
    "abstract_s", "keyword_s", "domain_s", "primaryDomain_s", "domainAllCode_s", "en_domainAllCodeLabel_fs",
    "fr_domainAllCodeLabel_fs", "level0_domain_s", "level1_domain_s", "level2_domain_s",
    "docType_s", "language_s", "publicationDate_s", "producedDate_s", "publicationDateY_i",
    "journalTitle_s", "doiId_s", "uri_s", "openAccess_bool",
]
AUTHOR_ARRAY_FIELDS = [
    "authFullName_s", "authIdHal_s", "authIdPerson_i", "authFirstName_s", "authLastName_s",
    "authEmailDomain_s", "authORCIDIdExt_s", "authGoogleScholarIdExt_s",
    "authResearcherIdIdExt_s", "authIdRefIdExt_s",
]
ORGANIZATION_ARRAY_FIELDS = [
    "structId_i", "structName_s", "structAcronym_s", "structType_s", "structCountry_s",
    "structAddress_s", "structCode_s", "structValid_s", "structRorIdExt_s", "structIdrefIdExt_s",
    "structIsniIdExt_s", "structRnsrIdExt_s", "structWikidataIdExt_s",
]
DATE_FIELDS = [
    "publicationDate_s", "producedDate_s", "conferenceStartDate_s", "conferenceEndDate_s",
]
MISSINGNESS_GROUPS = {
    "hal_id": ["halId_s", "docid"],
    "title": ["title_s"],
    "abstract": ["abstract_s"],
    "keywords": ["keyword_s"],
    "doi": ["doiId_s"],
    "authors": ["authFullName_s"],
    "domains": ["primaryDomain_s", "domainAllCode_s", "domain_s"],
}

# Physical names of the property graph: vertex labels, edge types, property names.
GRAPH_NAMES = {
    "labels": {
        "project": "Project", "author": "Author", "research_domain": "ResearchDomain",
        "organization": "Organization", "conference": "Conference", "capability": "Capability",
    },
    "relationships": {
        "wrote": "WROTE", "has_research_domain": "HAS_RESEARCH_DOMAIN",
        "subdomain_of": "SUBDOMAIN_OF", "has_organization": "HAS_ORGANIZATION",
        "part_of": "PART_OF", "presented_at": "PRESENTED_AT",
        "evidences_capability": "EVIDENCES_CAPABILITY", "has_capability": "HAS_CAPABILITY",
    },
}


# ---------------------------------------------------------------------------
# Run-time configuration
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class GraphStore:
    """Where the graph tables live; the password never shows in ``repr``."""

    uri: str
    user: str
    password: str = field(repr=False)
    database: str = "neo4j"


def graph_store_from_env(database: str | None = None, env: dict[str, str] | None = None) -> GraphStore:
    """Read the store settings; an explicit database name wins over the environment."""
    env = os.environ if env is None else env
    values = {}
    for name in ("NEO4J_URI", "NEO4J_USER", "NEO4J_PASSWORD"):
        if not env.get(name):
            raise ValueError(f"{name} must be set")
        values[name] = env[name]
    return GraphStore(
        values["NEO4J_URI"], values["NEO4J_USER"], values["NEO4J_PASSWORD"],
        database or env.get("NEO4J_DATABASE") or "neo4j",
    )


def text_backend_settings(env: dict[str, str] | None = None) -> dict[str, str]:
    """Pick a text-generation provider from the environment; none configured gives ``fake``."""
    env = os.environ if env is None else env
    provider = env.get("LLM_PROVIDER", "").lower()
    if not provider:
        provider = "gemini" if env.get("GEMINI_API_KEY") else "openai" if env.get("OPENAI_API_KEY") else "fake"
    return {"provider": provider, "model": env.get("LLM_MODEL", "unknown")}


def load_overrides(path: str | Path) -> dict:
    """Read a JSON (or, where PyYAML is installed, YAML) override file; absent file gives ``{}``."""
    path = Path(path)
    if not path.is_file():
        return {}
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("YAML overrides need PyYAML; use JSON instead") from exc
        return yaml.safe_load(text) or {}
    return json.loads(text)


def graph_names(path: str | Path | None = None) -> dict:
    """Physical graph names, with per-section overrides and the ``authorship`` alias of ``wrote``."""
    names = {section: dict(values) for section, values in GRAPH_NAMES.items()}
    for section, values in (load_overrides(path) if path else {}).items():
        names.setdefault(section, {}).update(values)
    names["nodes"] = names["labels"]
    names["relationships"].setdefault("authorship", names["relationships"]["wrote"])
    return names
