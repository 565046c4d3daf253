"""Project requirements: mapping of extracted ones to capabilities, and the fallback by domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.functions.text import strip
from kinweave.operators.resolve import numbered, resolve_names
from kinweave.session import stage


def map_requirements(raw: DataFrame, existing: DataFrame) -> DataFrame:
    """raw(target_id, seq, name, importance STRING, source) with capability_id and final importance; seq may be anything sortable.

    A name that is not known yet counts as unresolved and loses weight; mentioned again, it resolves
    to the record its first mention started.
    """
    rows = raw.select(
        "target_id", F.col("seq").alias("place"), strip(F.coalesce("name", F.lit(""))).alias("name"),
        F.coalesce(F.col("importance").try_cast("double"), F.lit(settings.DEFAULT_IMPORTANCE)).alias("importance"),
        F.coalesce("source", F.lit("extracted")).alias("source"), F.lit(None).cast("string").alias("alias"),
    ).where(F.col("name") != "")
    resolved = resolve_names(numbered(rows, "place"), existing)
    known = ~F.col("created")
    weight = F.when(known, F.col("importance")).otherwise(
        F.greatest(F.lit(0.0), F.col("importance") * settings.UNRESOLVED_IMPORTANCE_FACTOR)
    )
    out = resolved.select(
        "target_id", F.col("place").alias("seq"), "name", weight.alias("importance"), "source", F.when(known, F.col("capability_id")).alias("capability_id")
    )
    return out.where(F.col("importance") > 0)


def domain_fallback(project_domains: DataFrame) -> DataFrame:
    """One requirement per domain of project_domains(target_id, domain_id, name), none of them resolved."""
    return project_domains.select(
        "target_id", F.coalesce("name", "domain_id").alias("name"), F.lit(settings.DEFAULT_IMPORTANCE).alias("importance"),
        F.lit("extracted").alias("source"), F.lit(None).cast("string").alias("capability_id"),
    )


def requirements_or_domains(raw: DataFrame, project_domains: DataFrame, existing: DataFrame) -> DataFrame:
    """Mapped requirements of every target that stated any, the domains of the others in their place.

    raw as in ``map_requirements``, project_domains as in ``domain_fallback``. A target whose answer failed, or
    holds nothing usable, thus still ends with requirements.
    """
    columns = ["target_id", "name", "importance", "source", "capability_id"]
    mapped = stage(map_requirements(raw, existing).select(*columns), "requirements")
    left = project_domains.join(mapped.select("target_id").distinct(), "target_id", "left_anti")
    return mapped.unionByName(domain_fallback(left).select(*columns))


def structure_fault(response: str | dict) -> str | None:
    """Why a backend's answer cannot be used, None when it can."""
    if not isinstance(response, dict):
        return "answer is not an object"
    wanted, goals = response.get("requirements", []), response.get("goals", [])
    if not isinstance(wanted, list) or not isinstance(goals, list):
        return "requirements and goals must be lists"
    for item in wanted:
        if not isinstance(item, dict) or not isinstance(item.get("name"), str) or not item["name"]:
            return "a requirement has no name"
    return None
