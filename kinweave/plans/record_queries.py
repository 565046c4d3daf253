"""Queries over raw records: extraction into the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.operators import authors
from kinweave.operators.canonical import canonical_table, canonical_tables, with_project_id
from kinweave.plans import corpus
from kinweave.plans.corpus_sql import VIEWS
from kinweave.session import stage

QUERIES = {}
SQL = {}


def query(sql_body: str | None = None, *needs: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql_body is not None:
            SQL[fn.__name__] = VIEWS.query(sql_body, *needs)
        return fn

    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return canonical_table(corpus.records(spark, sf), name)


@query("""
SELECT doc_id AS doc_ord, project AS "projectHalId", CAST(pos AS INTEGER) AS pos, id AS "halId", person AS "personId",
first AS "firstName", last AS "lastName", name AS "fullName", email AS "emailDomain" FROM author_rows""", "author_rows")
def authors_extracted(spark: SparkSession, sf: str) -> DataFrame:
    rows = authors.extract_authors(with_project_id(corpus.records(spark, sf)))
    return rows.select("doc_ord", "projectHalId", "pos", "halId", "personId", "firstName", "lastName", "fullName", "emailDomain")


@query("""
SELECT count(DISTINCT doc_id) AS n_documents, count(*) AS n_authors,
count(*) FILTER (WHERE starts_with(id, 'unknown_')) AS n_unknown, count(*) FILTER (WHERE starts_with(id, 'person_')) AS n_person,
(SELECT count(*) FROM shifted) AS n_shifted FROM author_rows""", "author_rows", "shifted")
def author_shift_repair(spark: SparkSession, sf: str) -> DataFrame:
    """How the identifiers of all author appearances came about."""
    names = authors.as_list(F.col("doc"), "authFullName_s")
    given = authors.truthy_list(F.col("doc"), "authIdHal_s", promote=True)

    # Shifted: an identifier ends up at another position than the one it was given at.
    def moved(v):
        differs = F.transform(v["now"], lambda x, i: x.isNotNull() & ~x.eqNullSafe(F.get(v["given"], i)))
        return F.exists(differs, lambda d: d)

    def starting(prefix: str):
        return F.sum(F.size(F.filter("ids", lambda x: F.startswith(x, F.lit(prefix))))).alias("n_" + prefix.rstrip("_"))

    rows = corpus.records(spark, sf).select(
        authors.let(F.struct(authors.aligned_ids(names, given).alias("now"), given.alias("given")), moved).alias("moved"),
        authors.author_array(F.col("doc"))["halId"].alias("ids"),
    )
    return rows.agg(
        F.count_if(F.size("ids") > 0).alias("n_documents"), F.sum(F.size("ids")).alias("n_authors"),
        starting("unknown_"), starting("person_"), F.count_if("moved").alias("n_shifted"),
    )


@query("""
SELECT "halId", title, abstract, "documentType", language, "publicationDate", nullif(year_or_minus, -1) AS "publicationYear", doi
FROM projects""", "projects")
def projects_extracted(spark: SparkSession, sf: str) -> DataFrame:
    out = _table(spark, sf, "projects")
    return out.withColumn("language", F.array_join("language", "|")).drop("keywords", "uri")


@query(r"""
SELECT hal_id AS "halId", arg_min(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\p{L}{12,}'))), '|'), doc_id) AS keywords
FROM docs GROUP BY 1""", "docs")
def project_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "projects").select("halId", F.array_join(F.array_sort("keywords"), "|").alias("keywords"))


@query("""
SELECT id AS "halId", nullif(arg_min(p, (doc_id, pos)), -1) AS "personId", arg_min(first, (doc_id, pos)) AS "firstName",
arg_min(last, (doc_id, pos)) AS "lastName", arg_min(email, (doc_id, pos)) AS "emailDomain"
FROM (SELECT *, coalesce(person, -1) AS p FROM author_rows) GROUP BY 1""", "author_rows")
def authors_table(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "authors").select("halId", "personId", "firstName", "lastName", "emailDomain")


@query("""
SELECT id AS "conferenceId", min(title) AS title, min(start_date) AS "startDate", '' AS "endDate", min(city) AS city, '' AS country
FROM conferences GROUP BY 1""", "conferences")
def conferences_table(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "conferences")


@query("""
SELECT lab AS "halId", min(source) AS name, arg_min(CASE WHEN lang = 'de' THEN '' ELSE 'laboratory' END, doc_id) AS type,
  min(source) AS ror FROM docs GROUP BY 1 UNION ALL
SELECT country, min(upper(lang)), CASE WHEN min(lang) = 'de' THEN '' ELSE 'institution' END, '' FROM docs GROUP BY 1""", "docs")
def organizations_table(spark: SparkSession, sf: str) -> DataFrame:
    out = _table(spark, sf, "organizations")
    return out.select("halId", "name", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("ror", F.lit("")).alias("ror"))


@query("""
SELECT lang || '.' || source AS id, min(CASE WHEN lang = 'de' THEN 'Source ' || source ELSE 'Source ' || source END) AS name,
  min(CASE WHEN lang = 'fr' THEN 'Origine' ELSE '' END) AS "nameFr", 'HAL' AS source FROM docs GROUP BY 1 UNION ALL
SELECT lang, upper(lang), min(CASE WHEN lang = 'fr' THEN 'Langue' ELSE '' END), 'HAL' FROM docs GROUP BY 1, 2""", "docs")
def domains_table(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "research_domains")


@query("""SELECT DISTINCT project AS "projectHalId", id AS "authorHalId" FROM author_rows""", "author_rows")
def project_authors_table(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "project_authors")


@query("""SELECT DISTINCT project AS "projectHalId", id AS "conferenceId" FROM conferences""", "conferences")
def project_conferences_table(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "project_conferences")


@query("""
SELECT DISTINCT hal_id AS "projectHalId", lab AS "organizationHalId" FROM docs UNION
SELECT DISTINCT hal_id, country FROM docs""", "docs")
def project_organizations_table(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "project_organizations")


@query("""SELECT DISTINCT lab AS "sourceId", country AS "targetId", 'PART_OF' AS type FROM docs""", "docs")
def part_of_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "organization_relationships")


@query("""
SELECT project AS "projectHalId", code AS "domainId", arg_min(main, (doc_id, NOT main)) AS "primary" FROM codes
GROUP BY 1, 2""", "codes")
def project_domains_table(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "project_research_domains")


@query("""SELECT DISTINCT lang || '.' || source AS "childId", lang AS "parentId" FROM docs""", "docs")
def domain_hierarchy_table(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "research_domain_hierarchy")


@query("""
SELECT 'projects' AS table_name, count(DISTINCT hal_id) AS n FROM docs UNION ALL
SELECT 'authors', count(DISTINCT id) FROM author_rows UNION ALL
SELECT 'conferences', count(DISTINCT id) FROM conferences UNION ALL
SELECT 'organizations', count(DISTINCT lab) + count(DISTINCT country) FROM docs UNION ALL
SELECT 'research_domains', count(DISTINCT code) FROM codes UNION ALL
SELECT 'project_authors', count(DISTINCT (project, id)) FROM author_rows UNION ALL
SELECT 'project_conferences', count(DISTINCT (project, id)) FROM conferences UNION ALL
SELECT 'project_organizations', count(DISTINCT (hal_id, lab)) + count(DISTINCT (hal_id, country)) FROM docs UNION ALL
SELECT 'organization_relationships', count(DISTINCT (lab, country)) FROM docs UNION ALL
SELECT 'project_research_domains', count(DISTINCT (project, code)) FROM codes UNION ALL
SELECT 'research_domain_hierarchy', count(DISTINCT (lang, source)) FROM docs""", "docs", "author_rows", "conferences", "codes")
def canonical_table_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of all eleven tables."""
    out = None
    for name, rows in canonical_tables(corpus.records(spark, sf)).items():
        counted = rows.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
        out = counted if out is None else out.unionAll(counted)
    return out


@query("""
SELECT doc_id AS doc_ord, len(names) AS n_names, len(names) AS n_ids, len(names) AS n_email,
  CASE WHEN lang = 'en' THEN 0 ELSE len(names) END AS n_email_filler FROM docs""", "docs")
def pad_parallel_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Author arrays after padding: all as long as the list of names."""
    fields = ["authFullName_s", "authIdHal_s", "authEmailDomain_s"]
    rows = corpus.records(spark, sf).select("doc_ord", *authors.pad_author_arrays(F.col("doc"), fields))
    return rows.select(
        "doc_ord",
        F.size("authFullName_s").cast("long").alias("n_names"), F.size("authIdHal_s").cast("long").alias("n_ids"),
        F.size("authEmailDomain_s").cast("long").alias("n_email"),
        F.size(F.filter("authEmailDomain_s", lambda x: x == "0")).cast("long").alias("n_email_filler"),
    )
