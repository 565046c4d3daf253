"""Raw publication records spelled out of the documents table.

Every document becomes one JSON record: its whole text supplies the author names and keywords, its
language and source the domains, organisations and conference. Languages differ in how clean their
records are, so that scalars, lists, gaps, zeros, shifted identifiers and bad dates all occur.
No grouping is needed: one row in, one record out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.records import let
from kinweave.functions.text import name_key
from kinweave.plans.collab import table
from kinweave.sources.records import parse_lines

NAME_PATTERN = r"\p{Lu}\p{L}+ \p{Ll}+"
KEYWORD_PATTERN = r"\p{L}{12,}"


def _json_list(values: Column, quote: Column | None = None) -> Column:
    """JSON array text of plain words; NULL elements become the number 0."""
    items = F.transform(values, lambda v: F.coalesce(F.concat(F.lit('"'), v, F.lit('"')), F.lit("0")))
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_ord, value) with one JSON object per document."""
    docs = table(spark, sf_dir, "documents")
    lang, source = F.col("lang"), F.col("source")
    speaks = lambda *codes: lang.isin(*codes)
    lines = F.split("text", "\n")
    names = F.regexp_extract_all("text", F.lit(NAME_PATTERN), F.lit(0))
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("n_chars").cast("int"))
    lab = (F.regexp_extract(source, r"(\d+)", 1).cast("int") + 100)
    country = F.when(speaks("en"), 1).when(speaks("fr"), 2).when(speaks("de"), 3).otherwise(4)
    leaf = F.concat_ws(".", lang, source)
    strings = lambda *items: F.array(*[F.lit(i) if isinstance(i, str) else i for i in items])

    typed = F.to_json(F.struct(
        F.concat(F.lit("hal-"), F.substring(F.md5("text"), 1, 12)).alias("halId_s"),
        F.col("doc_id").alias("docid"),
        F.when(speaks("fr"), F.slice(lines, 1, 2)).otherwise(F.slice(lines, 1, 1)).alias("title_s"),
        F.array_distinct(F.regexp_extract_all("text", F.lit(KEYWORD_PATTERN), F.lit(0))).alias("keyword_s"),
        F.when(speaks("en"), F.date_format(day, "yyyy-MM-dd")).when(speaks("fr"), F.date_format(day, "yyyy"))
        .when(speaks("de"), F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy-MM-dd'Z'")).alias("publicationDate_s"),
        F.when(speaks("en"), F.year(day)).alias("publicationDateY_i"),
        F.date_format(day, "yyyy-MM-dd").alias("producedDate_s"),
        F.when(speaks("en"), F.concat(F.lit("10.1/"), F.col("doc_id"))).when(speaks("fr"), F.lit("")).alias("doiId_s"),
        F.col("names").alias("authFullName_s"),
        F.transform("names", lambda n: F.when(F.length(n) % 3 != 0, F.length(n)).otherwise(0)).alias("authIdPerson_i"),
        F.when(speaks("en"), F.transform("names", lambda n: F.concat(source, F.lit(".org")))).alias("authEmailDomain_s"),
        F.array(lab, country, lab).alias("structId_i"),
        strings("", F.upper(lang), source).alias("structName_s"),
        F.when(speaks("de"), strings("laboratory")).otherwise(strings("laboratory", "institution", "laboratory")).alias("structType_s"),
        strings(F.concat(F.lit("https://ror.org/"), source, F.lit("/")), "", "").alias("structRorIdExt_s"),
        strings(F.concat(lab.cast("string"), F.lit("_laboratory_JoinSep_"), country.cast("string"), F.lit("_FacetSep_"), lang), "broken")
        .alias("structIsChildOf_fs"),
        F.when(speaks("en", "fr"), F.date_format(F.trunc(day, "year"), "yyyy-MM-dd")).alias("conferenceStartDate_s"),
        F.when(speaks("en", "fr"), F.upper(lang)).alias("city_s"),
        leaf.alias("primaryDomain_s"),
        F.when(~speaks("de"), F.array(lang, leaf, lang)).alias("domainAllCode_s"),
        F.when(speaks("de"), lang).alias("domain_s"),
        F.array(lang).alias("level0_domain_s"),
        F.array(leaf).alias("level1_domain_s"),
        F.array(
            F.concat(lang, F.lit("_FacetSep_Languages [l]/"), F.upper(lang), F.lit(" [x]")),
            F.concat(leaf, F.lit(":Source "), source),
        ).alias("en_domainAllCodeLabel_fs"),
        F.when(speaks("fr"), strings("Langue", "Origine")).alias("fr_domainAllCodeLabel_fs"),
    ))
    text_json = F.get_json_object(F.to_json(F.struct(F.array("text").alias("t"))), "$.t")
    abstract = F.when(speaks("en", "fr"), text_json).when(speaks("es"), F.regexp_replace(text_json, r"^\[|\]$", ""))
    keys = F.transform("names", lambda n: F.when(F.length(n) % 2 == 0, name_key(n)))
    ids = let(keys, lambda k: F.when(speaks("fr"), F.concat(F.slice(k, 2, F.greatest(F.size(k), F.lit(1))), F.slice(k, 1, 1)))
              .when(speaks("es"), F.slice(k, F.lit(1), F.greatest(F.size(k) - 1, F.lit(0)))).otherwise(k))
    kind = F.when(source.endswith("1"), F.lit('""')).when(speaks("fr"), F.lit('["ART"]')).when(speaks("en"), F.lit('"COMM"'))
    language = F.when(speaks("es"), F.lit('"es"')).when(speaks("de"), F.lit('["de","xx"]')).otherwise(
        F.concat(F.lit('["'), lang, F.lit('"]')))
    event = F.when(speaks("en"), F.concat(F.lit('"Conf '), source, F.lit('"'))).when(
        speaks("fr"), F.concat(F.lit('["Conf '), source, F.lit('","x"]')))
    year = F.when(speaks("es"), F.lit('"n/a"'))
    extra = {
        "abstract_s": abstract, "authIdHal_s": _json_list(ids), "docType_s": kind, "language_s": language,
        "conferenceTitle_s": event, "publicationDateY_i": year,
    }
    parts = [F.concat(F.lit(f',"{name}":'), value) for name, value in extra.items()]
    return docs.withColumn("names", names).select(
        F.col("doc_id").alias("doc_ord"),
        F.concat_ws("", F.regexp_replace(typed, r"\}$", ""), *parts, F.lit("}")).alias("value"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(record_lines(spark, sf_dir))
