"""Quality metrics of raw records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.functions.records import as_list, has_key, list_length, unique_text
from kinweave.functions.text import is_placeholder, person_match_key, strip
from kinweave.operators.authors import author_array
from kinweave.operators.validation import is_blank, record_key


def missingness(records: DataFrame) -> DataFrame:
    """(field, missing_count, missing_percent): a logical field is missing when all its sources are blank."""
    doc = F.col("doc")
    gaps = [
        F.count_if(reduce(lambda a, b: a & b, [is_blank(doc, f) for f in sources])).alias(name)
        for name, sources in settings.MISSINGNESS_GROUPS.items()
    ]
    counted = records.agg(F.count(F.lit(1)).alias("n"), *gaps)
    rows = counted.select("n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("field"), F.col(name).alias("missing_count")) for name in settings.MISSINGNESS_GROUPS
    ])).alias("m"))
    percent = F.coalesce(F.round(F.try_divide(F.col("m.missing_count") * 100.0, F.col("n")), 2), F.lit(0.0))
    return rows.select("m.field", "m.missing_count", percent.alias("missing_percent"))


def duplicate_ids(records: DataFrame) -> DataFrame:
    """(hal_id, n) for identifiers used more than once."""
    keys = records.select(record_key(F.col("doc")).alias("hal_id")).where(F.col("hal_id").isNotNull())
    return keys.groupBy("hal_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def appearances(records: DataFrame) -> DataFrame:
    """(doc_ord, name, author_id) for each author appearance."""
    rows = records.select("doc_ord", F.explode(author_array(F.col("doc"))).alias("a"))
    return rows.select("doc_ord", strip(F.coalesce("a.givenName", F.lit(""))).alias("name"), F.col("a.halId").alias("author_id"))


def author_identity(records: DataFrame) -> DataFrame:
    """One row: distinct identifiers, placeholder appearances, share of placeholders, appearances without identifier."""
    per_id = appearances(records).groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))
    unknown = is_placeholder(F.col("author_id"))
    known = per_id.agg(
        F.count(F.lit(1)).alias("author_id_count"),
        F.coalesce(F.sum(F.when(unknown, F.col("n"))), F.lit(0)).alias("unknown_author_count"),
        F.coalesce(F.round(F.try_divide(F.count_if(unknown).cast("double"), F.count(F.lit(1))), 4), F.lit(0.0)).alias("unknown_author_share"),
    )
    return known


def authors_without_identifier(records: DataFrame) -> DataFrame:
    """One row: author appearances whose raw identifier is blank or zero."""
    names, ids = as_list(F.col("doc"), "authFullName_s"), as_list(F.col("doc"), "authIdHal_s")
    usable = F.filter(F.slice(ids, F.lit(1), F.size(names)), lambda v: (strip(v) != "") & (strip(v) != "0"))
    return records.agg(F.coalesce(F.sum(F.size(names) - F.size(usable)), F.lit(0)).alias("authors_without_hal_id"))


def homonyms(records: DataFrame, key: Callable[[Column], Column] = person_match_key) -> DataFrame:
    """(normalized_name, author_id) rows of names borne by several non-placeholder identifiers; ``key`` says which names are equal."""
    borne = appearances(records).select(key(F.col("name")).alias("normalized_name"), "author_id")
    borne = borne.where(F.col("normalized_name") != "").distinct()
    shared = borne.groupBy("normalized_name").agg(F.count_if(~is_placeholder(F.col("author_id"))).alias("n")).where(F.col("n") > 1)
    return borne.join(shared.select("normalized_name"), "normalized_name", "left_semi")


def array_mismatches(records: DataFrame) -> DataFrame:
    """(doc_ord, author_name_count, field, length) for author arrays not as long as the list of names."""
    doc = F.col("doc")
    lengths = F.array(*[
        F.when(
            has_key(doc, f) & (list_length(doc, f) != list_length(doc, "authFullName_s")),
            F.struct(F.lit(f).alias("field"), list_length(doc, f).alias("length")),
        )
        for f in settings.AUTHOR_ARRAY_FIELDS[1:]
    ])
    rows = records.select("doc_ord", list_length(doc, "authFullName_s").alias("author_name_count"),
                          F.explode(F.filter(lengths, lambda x: x.isNotNull())).alias("m"))
    return rows.select("doc_ord", "author_name_count", "m.*")


def array_alignment(records: DataFrame) -> DataFrame:
    """One row: records with a mismatched author array, and their rate."""
    doc = F.col("doc")
    off = reduce(lambda a, b: a | b, [
        has_key(doc, f) & (list_length(doc, f) != list_length(doc, "authFullName_s")) for f in settings.AUTHOR_ARRAY_FIELDS[1:]
    ])
    rate = F.coalesce(F.round(F.try_divide(F.count_if(off).cast("double"), F.count(F.lit(1))), 4), F.lit(0.0))
    return records.agg(F.count_if(off).alias("mismatched_record_count"), rate.alias("mismatch_rate"))


def entity_counts(records: DataFrame) -> DataFrame:
    """(entity, n): distinct projects, authors, domains and organisations named by the records."""
    doc = F.col("doc")
    codes = ["primaryDomain_s", "domainAllCode_s", "domain_s", "level0_domain_s", "level1_domain_s", "level2_domain_s"]
    parts = {
        "projects": records.select(record_key(doc).alias("id")).where(F.col("id").isNotNull()),
        "authors": appearances(records).select(F.col("author_id").alias("id")),
        "research_domains": records.select(F.explode(unique_text(F.concat(*[as_list(doc, c) for c in codes]))).alias("id")),
        "organizations": records.select(F.explode(unique_text(as_list(doc, "structId_i"))).alias("id")),
    }
    distinct = [rows.select(F.lit(name).alias("entity"), "id").distinct() for name, rows in parts.items()]
    return reduce(DataFrame.union, distinct).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def special_records(records: DataFrame) -> DataFrame:
    """One row: records without a usable identifier, and records with several abstracts."""
    key = record_key(F.col("doc"))
    return records.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(key.isNull() | (F.lower(key) == "unknown")).alias("missing_or_unknown_ids"),
        F.count_if(list_length(F.col("doc"), "abstract_s") > 1).alias("multi_language_abstracts"),
    )
