"""Publications (projects) and conferences of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.records import as_list, first_text, is_missing, opened, raw, text
from kinweave.functions.text import parse_year, slug


def project_id(doc: Column) -> Column:
    """First of the two identifier fields that is present, else Unknown."""
    return F.when(raw(doc, "halId_s").isNotNull(), text(doc, "halId_s")).otherwise(text(doc, "docid", "Unknown"))


def _text_list(doc: Column, field: str) -> Column:
    return F.transform(as_list(doc, field), lambda x: F.coalesce(x, F.lit("None")))


def project_fields(doc: Column) -> Column:
    """What a record says of its publication, one struct."""
    year = F.when(is_missing(doc, "publicationDateY_i"), text(doc, "producedDate_s")).otherwise(text(doc, "publicationDateY_i"))
    return F.struct(
        first_text(doc, "title_s", "Untitled").alias("title"),
        first_text(doc, "abstract_s").alias("abstract"),
        _text_list(doc, "keyword_s").alias("keywords"),
        text(doc, "docType_s").alias("documentType"),
        _text_list(doc, "language_s").alias("language"),
        text(doc, "publicationDate_s").alias("publicationDate"),
        parse_year(year).alias("publicationYear"),
        text(doc, "doiId_s").alias("doi"),
        text(doc, "uri_s").alias("uri"),
    )


def extract_projects(records: DataFrame) -> DataFrame:
    rows = records.select("doc_ord", F.col("projectHalId").alias("halId"), opened(records, "project_fields", project_fields).alias("project"))
    return rows.select("doc_ord", F.lit(0).alias("pos"), "halId", "project.*")


def conference_array(doc: Column) -> Column:
    """The record's conference, or an empty array."""
    event = F.struct(
        F.get(as_list(doc, "conferenceTitle_s"), F.lit(0)).alias("title"),
        text(doc, "conferenceStartDate_s").alias("startDate"),
        text(doc, "conferenceEndDate_s").alias("endDate"),
        text(doc, "city_s").alias("city"),
        text(doc, "country_s").alias("country"),
    )
    return F.filter(F.array(event), lambda e: e["title"] != "")


def extract_conferences(records: DataFrame) -> DataFrame:
    """At most one conference per record. The end date is not part of its identifier.

    Records without one drop out by ``explode``: a filter would be moved below the parsing of the record and repeat it.
    """
    found = F.explode(opened(records, "conference_array", conference_array))
    rows = records.select("doc_ord", "projectHalId", F.lit(0).alias("pos"), found.alias("event")).select("doc_ord", "projectHalId", "pos", "event.*")
    parts = F.array(*[slug(F.col(c)) for c in ("title", "startDate", "city", "country")])
    return rows.select(
        "doc_ord", "projectHalId", "pos",
        F.array_join(F.filter(parts, lambda p: p != ""), "_").alias("conferenceId"),
        "title", "startDate", "endDate", "city", "country",
    )
