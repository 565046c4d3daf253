"""Collaboration graph out of nested JSON: projects with their members and domains, and people's capabilities."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.operators.graph import GraphTables
from kinweave.session import stage

_DEFAULT_CONFIDENCE = 0.7


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(ord, doc) of a file or folder; a missing one holds none.

    A file is one JSON array, or with ``lines`` one document a line, which is the form for large inputs, since an
    array is read by one task. ``ord`` follows the order within each file.
    """
    try:
        text = spark.read.text(path, wholetext=not lines)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "value string")
    return documents(text, lines)


def documents(text: DataFrame, lines: bool = True) -> DataFrame:
    """(ord, doc) of text(value): documents, or arrays of documents unless ``lines``. Text that is no JSON fails."""
    numbered = text.where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("row"), F.parse_json("value").alias("v"))
    if lines:
        return numbered.select(F.struct("row", F.lit(0).alias("pos")).alias("ord"), F.col("v").alias("doc"))
    return numbered.select("row", F.posexplode(F.variant_get("v", "$", "array<variant>")).alias("pos", "doc")).select(
        F.struct("row", "pos").alias("ord"), "doc")


def _text(doc: str, name: str, default: str = "") -> Column:
    return F.coalesce(F.try_variant_get(doc, f"$.{name}", "string"), F.lit(default))


def _items(doc: str, name: str) -> Column:
    return F.coalesce(F.try_variant_get(doc, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def _last(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The last row of each key, as repeated documents replace earlier ones."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def nested_graph(projects: DataFrame, capabilities: DataFrame) -> GraphTables:
    """Tables of projects(ord, doc) and capabilities(ord, doc); of documents with one project_id the last one counts.

    People known by a capability alone get its name, as no other is given. Parents of a domain become edges. Every
    document is parsed once and written out, since all tables are read from it.
    """
    read = projects.select("ord", F.variant_get("doc", "$.project_id", "string").alias("project_id"), "doc").where("project_id IS NOT NULL")
    newest = stage(read.groupBy("project_id").agg(F.max_by("doc", "ord").alias("doc"), F.max("ord").alias("ord")), "nested-projects")
    members = newest.select("ord", "project_id", F.posexplode(_items("doc", "members")).alias("pos", "m")).select(
        F.struct("ord", "pos").alias("ord"), "project_id", "pos", F.try_variant_get("m", "$.person_id", "string").alias("person_id"),
        _text("m", "full_name").alias("full_name")).where("person_id IS NOT NULL")
    placed = newest.select("ord", "project_id", F.posexplode(_items("doc", "domains")).alias("pos", "d")).select(
        F.struct("ord", "pos").alias("ord"), "project_id", F.try_variant_get("d", "$.domain_id", "string").alias("domain_id"),
        _text("d", "name").alias("name"), _text("d", "name_fr").alias("name_fr"), F.try_variant_get("d", "$.parent_ids", "array<string>").alias("parents"),
    ).where("domain_id IS NOT NULL")
    able = stage(capabilities.select(
        "ord", F.variant_get("doc", "$.person_id", "string").alias("person_id"), F.variant_get("doc", "$.capability_id", "string").alias("capability_id"),
        _text("doc", "name").alias("name"), _text("doc", "kind", "UNKNOWN").alias("kind"),
        F.coalesce(F.try_variant_get("doc", "$.publication_count", "int"), F.lit(1)).alias("publication_count"),
        F.coalesce(F.try_variant_get("doc", "$.evidence_count", "int"), F.lit(1)).alias("evidence_count"),
        F.coalesce(F.try_variant_get("doc", "$.avg_confidence", "double"), F.lit(_DEFAULT_CONFIDENCE)).alias("avg_confidence"),
        F.try_variant_get("doc", "$.last_seen_year", "int").alias("last_seen_year"),
        _text("doc", "extraction_version", settings.EXTRACTION_VERSION).alias("extraction_version"),
    ).where("person_id IS NOT NULL AND capability_id IS NOT NULL"), "nested-able")
    named = _last(members.select("ord", "person_id", "full_name"), "person_id")
    others = able.join(named, "person_id", "left_anti").groupBy("person_id").agg(
        F.min_by(F.coalesce(F.nullif("name", F.lit("")), F.col("person_id")), "ord").alias("full_name"))
    return GraphTables(
        projects=newest.select(
            "project_id", _text("doc", "title").alias("title"), _text("doc", "abstract").alias("abstract"),
            F.coalesce(F.try_variant_get("doc", "$.keywords", "array<string>"), F.array().cast("array<string>")).alias("keywords"),
            F.try_variant_get("doc", "$.year", "int").alias("year"), _text("doc", "doc_type").alias("doc_type")),
        authors=named.unionByName(others),
        wrote=members.groupBy("person_id", "project_id").agg(F.min("pos").alias("pos")),
        project_domain=placed.select("project_id", "domain_id").distinct(),
        domains=_last(placed.select("ord", "domain_id", "name", "name_fr"), "domain_id"),
        subdomain_of=placed.select(F.col("domain_id").alias("child_id"), F.explode("parents").alias("parent_id")).distinct(),
        has_capability=able.drop("ord"),
    )
