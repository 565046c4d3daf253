"""Organisations of a record and their PART_OF edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.records import as_list, let, opened, parse_digits
from kinweave.functions.text import last_segment, strip

ATTRIBUTE_FIELDS = {
    "name": "structName_s",
    "acronym": "structAcronym_s",
    "type": "structType_s",
    "country": "structCountry_s",
    "address": "structAddress_s",
    "code": "structCode_s",
    "status": "structValid_s",
    "ror": "structRorIdExt_s",
    "idref": "structIdrefIdExt_s",
    "isni": "structIsniIdExt_s",
    "rnsr": "structRnsrIdExt_s",
    "wikidata": "structWikidataIdExt_s",
}


def _entries(doc: Column) -> Column:
    """(halId, attributes) per listed structure; an attribute array of another length is ignored."""
    bound = F.struct(
        as_list(doc, "structId_i").alias("ids"),
        *[as_list(doc, field).alias(name) for name, field in ATTRIBUTE_FIELDS.items()],
    )

    def value(s: Column, name: str, i: Column) -> Column:
        given = F.get(s[name], i)
        cleaned = F.when((F.size(s[name]) == F.size(s["ids"])) & (given != ""), strip(given))
        return last_segment(cleaned) if name == "ror" else cleaned

    def rows(s: Column) -> Column:
        listed = F.transform(
            s["ids"],
            lambda raw, i: F.struct(
                parse_digits(raw).alias("halId"), *[value(s, n, i).alias(n) for n in ATTRIBUTE_FIELDS]
            ),
        )
        return F.filter(listed, lambda r: r["halId"].isNotNull())

    return let(bound, rows)


def organization_array(doc: Column) -> Column:
    """Distinct organisations of one record in first-seen order; later entries fill missing attributes."""

    def merged(rows: Column) -> Column:
        ids = F.array_distinct(F.transform(rows, lambda r: r["halId"]))
        groups = F.transform(ids, lambda x: F.filter(rows, lambda r: r["halId"] == x))

        def fill(group: Column, name: str) -> Column:
            values = F.filter(F.transform(group, lambda r: r[name]), lambda v: v != "")
            first = F.get(values, F.lit(0))
            return F.coalesce(first, F.lit("")) if name == "name" else first

        return F.transform(
            groups,
            lambda g: F.struct(F.get(g, F.lit(0))["halId"].alias("halId"), *[fill(g, n).alias(n) for n in ATTRIBUTE_FIELDS]),
        )

    return let(_entries(doc), merged)


def part_of_array(doc: Column) -> Column:
    """Distinct (sourceId, targetId, type) edges spelled out in the record."""

    def edge(value: Column) -> Column:
        halves = F.split(value, "_JoinSep_", 2)
        source = parse_digits(F.get(F.split(F.get(halves, F.lit(0)), "_", 2), F.lit(0)))
        target = parse_digits(F.get(F.split(F.get(halves, F.lit(1)), "_FacetSep_", 2), F.lit(0)))
        return F.struct(source.alias("sourceId"), target.alias("targetId"), F.lit("PART_OF").alias("type"))

    edges = F.transform(as_list(doc, "structIsChildOf_fs"), edge)
    return F.array_distinct(F.filter(edges, lambda e: e["sourceId"].isNotNull() & e["targetId"].isNotNull()))


def extract_organizations(records: DataFrame) -> DataFrame:
    rows = records.select("doc_ord", "projectHalId", F.posexplode(opened(records, "organization_array", organization_array)).alias("pos", "o"))
    return rows.select("doc_ord", "projectHalId", "pos", "o.*")


def extract_part_of(records: DataFrame) -> DataFrame:
    rows = records.select("doc_ord", F.posexplode(opened(records, "part_of_array", part_of_array)).alias("pos", "e"))
    return rows.select("doc_ord", "pos", "e.*")
