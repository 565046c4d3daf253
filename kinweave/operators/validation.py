"""Validation of raw records and of paged API responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.functions.records import as_list, elements, has_key, is_list, is_missing, list_length, raw, text
from kinweave.functions.text import SPACE, is_valid_date, is_valid_language, strip
from kinweave.sources.records import is_object

ISSUE = "struct<code:string,field:string,severity:string>"


def is_blank(doc: Column, field: str) -> Column:
    """Missing, empty, or holding nothing but white space."""
    return F.forall(as_list(doc, field), lambda x: F.coalesce(~x.rlike(f"(?U)[^{SPACE[1:-1]}]"), F.lit(True)))


def record_key(doc: Column) -> Column:
    """Trimmed identifier: the first of the two identifier fields that is not blank."""
    given = [F.when(~is_missing(doc, f), F.nullif(strip(text(doc, f)), F.lit(""))) for f in ("halId_s", "docid")]
    return F.coalesce(*given)


def _issue(condition: Column, code: str, field: str, severity: str) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(severity).alias("severity")))


ARRAY_FIELDS = [*settings.AUTHOR_ARRAY_FIELDS, *settings.ORGANIZATION_ARRAY_FIELDS]
TEXT_FIELDS = [
    "title_s", "abstract_s", "keyword_s", "doiId_s", "authFullName_s", "primaryDomain_s", "domainAllCode_s", "domain_s",
    "docType_s", *settings.DATE_FIELDS,
]


def _facts(records: DataFrame) -> DataFrame:
    """What the rules look at, each taken from the record once: lengths, blanks, keys."""
    doc = F.col("doc")
    return records.select(
        "doc_ord", "doc",
        record_key(doc).alias("key"),
        *[F.when(has_key(doc, f), F.size(elements(doc, f))).alias(f"n_{f}") for f in ARRAY_FIELDS],
        *[is_blank(doc, f).alias(f"blank_{f}") for f in TEXT_FIELDS],
    )


def _length_mismatches(fields: list[str]) -> list[Column]:
    """Arrays whose length is neither zero nor that of the first array present."""
    lengths = [F.col(f"n_{f}") for f in fields]
    expected = F.coalesce(*lengths)
    return [
        _issue((n != 0) & (n != expected), "parallel_array_length_mismatch", f, "warning")
        for f, n in zip(fields[1:], lengths[1:])
    ]


def record_issues(records: DataFrame) -> DataFrame:
    """(doc_ord, code, field, severity) of each record on its own."""
    doc = F.col("doc")
    blank = lambda f: F.col(f"blank_{f}")
    single = [
        _issue(F.col("key").isNull(), "missing_hal_id", "halId_s", "error"),
        _issue(blank("title_s"), "missing_title", "title_s", "error"),
        _issue(blank("abstract_s"), "missing_abstract", "abstract_s", "warning"),
        _issue(blank("keyword_s"), "missing_keywords", "keyword_s", "warning"),
        _issue(blank("doiId_s"), "missing_doi", "doiId_s", "warning"),
        _issue(blank("authFullName_s"), "missing_authors", "authFullName_s", "error"),
        _issue(blank("primaryDomain_s") & blank("domainAllCode_s") & blank("domain_s"), "missing_domains", "primaryDomain_s", "warning"),
        _issue(has_key(doc, "docType_s") & blank("docType_s"), "missing_doc_type", "docType_s", "error"),
        *[
            _issue(~blank(f) & ~F.coalesce(is_valid_date(text(doc, f)), F.lit(False)), "malformed_date", f, "warning")
            for f in settings.DATE_FIELDS
        ],
        _issue(
            ~is_missing(doc, "publicationDateY_i")
            & (F.schema_of_variant(raw(doc, "publicationDateY_i")) != "BIGINT")
            & ~text(doc, "publicationDateY_i").rlike(r"^\p{Nd}+$"),
            "malformed_publication_year", "publicationDateY_i", "warning",
        ),
        *_length_mismatches(settings.AUTHOR_ARRAY_FIELDS),
        *_length_mismatches(settings.ORGANIZATION_ARRAY_FIELDS),
        _issue(is_list(doc, "title_s") & (list_length(doc, "title_s") > 1), "multi_title_value", "title_s", "warning"),
    ]
    languages = F.transform(
        F.filter(as_list(doc, "language_s"), lambda v: (strip(v) != "") & ~is_valid_language(v)),
        lambda v: F.struct(F.lit("malformed_language").alias("code"), F.lit("language_s").alias("field"), F.lit("warning").alias("severity")),
    )
    found = F.concat(F.filter(F.array(*single), lambda i: i.isNotNull()), languages)
    odd = F.array(F.struct(F.lit("non_object_document").alias("code"), F.lit("docs").alias("field"), F.lit("error").alias("severity")))
    rows = _facts(records).select("doc_ord", F.explode(F.when(is_object(doc), found).otherwise(odd)).alias("i"))
    return rows.select("doc_ord", "i.*")


def duplicate_records(records: DataFrame) -> DataFrame:
    """(doc_ord, key) of every record whose identifier was already used by an earlier one.

    The first position per identifier is an aggregate; records are joined to it rather than ranked
    per identifier, so a widely shared identifier never has to fit one task.
    """
    keyed = records.where(is_object(F.col("doc"))).select("doc_ord", record_key(F.col("doc")).alias("key"))
    keyed = keyed.where(F.col("key").isNotNull())
    repeated = keyed.groupBy("key").agg(F.min("doc_ord").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return keyed.join(repeated, "key").where(F.col("doc_ord") > F.col("first")).select("doc_ord", "key")


def document_issues(records: DataFrame) -> DataFrame:
    """(doc_ord, code, field, severity) for all records, repeated identifiers included."""
    repeats = duplicate_records(records).select(
        "doc_ord", F.lit("duplicate_hal_id").alias("code"), F.lit("halId_s").alias("field"), F.lit("error").alias("severity")
    )
    return record_issues(records).unionByName(repeats)


def size_issues(doc_count: int, num_found: int | None = None, rows: int | None = None, start: int | None = None) -> list[dict]:
    """Issues of the number of records against what the source announced. ``start`` marks a single page."""
    found = []

    def add(code: str, field: str) -> None:
        found.append({"code": code, "field": field, "severity": "error"})

    if num_found is not None and doc_count > num_found:
        add("pagination_overflow", "numFound")
    if rows is not None and doc_count > rows:
        add("page_size_exceeded", "rows")
    if start is not None and rows is not None and num_found is not None and start + doc_count > num_found:
        add("pagination_incomplete", "start")
    return found


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def payload_issues(pages: DataFrame) -> DataFrame:
    """Envelope issues of API responses: pages(page_id, value, status_code, rows, start) -> (page_id, code, field, severity)."""
    body = F.try_parse_json("value")
    parsed = pages.withColumn("body", body).withColumn("payload", F.try_variant_get("body", "$.response", "variant"))
    docs = F.try_variant_get("payload", "$.docs", "variant")
    root = is_object(F.col("body"))
    inner = is_object(F.col("payload"))
    no_docs = docs.isNull() | F.coalesce(F.is_variant_null(docs), F.lit(True))
    listed = F.try_variant_get("payload", "$.docs", "array<variant>")
    count = F.size(listed)
    known = F.try_variant_get("payload", "$.numFound", "long")
    full = root & inner & ~no_docs & listed.isNotNull()
    issues = F.array(
        _issue(root & (F.col("status_code") >= 400), "http_error", "status_code", "error"),
        _issue(~root, "invalid_response_root", "response", "error"),
        _issue(root & ~inner, "invalid_response_payload", "response", "error"),
        _issue(root & inner & no_docs, "missing_docs", "docs", "error"),
        _issue(root & inner & ~no_docs & listed.isNull(), "invalid_docs_type", "docs", "error"),
        _issue(full & (count > known), "pagination_overflow", "numFound", "error"),
        _issue(full & (count > F.col("rows")), "page_size_exceeded", "rows", "error"),
        _issue(full & F.col("rows").isNotNull() & (F.coalesce("start", F.lit(0)) + count > known), "pagination_incomplete", "start", "error"),
    )
    found = F.filter(issues, lambda i: i.isNotNull())
    return parsed.select("page_id", F.explode(found).alias("i")).select("page_id", "i.*")


def page_records(pages: DataFrame) -> DataFrame:
    """Records of all pages in page order, ready for ``document_issues``."""
    docs = F.try_variant_get(F.try_parse_json("value"), "$.response.docs", "array<variant>")
    return pages.select("page_id", F.posexplode(docs).alias("pos", "doc")).select(
        F.struct("page_id", "pos").alias("doc_ord"), "doc"
    )
