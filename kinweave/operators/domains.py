"""Research domains of a record: nodes, project associations, hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.functions.records import as_list, let, opened, text, unique_text
from kinweave.functions.text import clean_domain_label, strip


def hierarchy_array(doc: Column) -> Column:
    """(childId, parentId) pairs: the parent is the longest upper-level code that prefixes the child."""
    levels = F.struct(*[unique_text(as_list(doc, f"level{n}_domain_s")).alias(f"l{n}") for n in range(3)])

    def pairs(children: Column, upper: Column) -> Column:
        def parent(child: Column) -> Column:
            prefixes = F.filter(upper, lambda p: F.startswith(child, F.concat(p, F.lit("."))))
            longest = F.array_max(F.transform(prefixes, lambda p: F.struct(F.length(p).alias("n"), p.alias("code"))))
            return longest["code"]

        return F.transform(children, lambda c: F.struct(c.alias("childId"), parent(c).alias("parentId")))

    def edges(v: Column) -> Column:
        every = F.concat(pairs(v["l1"], v["l0"]), pairs(v["l2"], F.concat(v["l1"], v["l0"])))
        return F.array_distinct(F.filter(every, lambda e: e["parentId"].isNotNull()))

    return let(levels, edges)


def main_code(doc: Column) -> Column:
    return strip(text(doc, "primaryDomain_s"))


def association_codes(doc: Column) -> Column:
    """Codes the record is filed under; a primary code that is not listed comes first."""
    primary = main_code(doc)
    codes = as_list(doc, "domainAllCode_s")
    listed = unique_text(F.when(F.size(codes) > 0, codes).otherwise(as_list(doc, "domain_s")))
    return let(
        F.struct(listed.alias("codes"), primary.alias("primary")),
        lambda v: F.when(
            (v["primary"] != "") & ~F.array_contains(v["codes"], v["primary"]), F.array_prepend(v["codes"], v["primary"])
        ).otherwise(v["codes"]),
    )


def label_entries(labels: Column, codes: Column) -> Column:
    """(code, label) per raw label: an explicit separator, a known ``code:`` prefix, or the position."""

    def entry(label: Column, i: Column) -> Column:
        cleaned = strip(label)

        def split_at(separator: str) -> Column:
            at = F.instr(cleaned, separator)
            rest = F.substr(cleaned, at + len(separator))
            return F.struct(F.substr(cleaned, F.lit(1), at - 1).alias("code"), rest.alias("label"))

        parts = F.lit(None).cast("struct<code:string,label:string>")
        for separator in reversed(settings.DOMAIN_LABEL_SEPARATORS):
            parts = F.when(F.instr(cleaned, separator) > 0, split_at(separator)).otherwise(parts)
        explicit = F.coalesce(parts["code"], F.lit(""))
        shown = F.coalesce(parts["label"], cleaned)
        colon = split_at(":")
        prefixed = (explicit == "") & (F.instr(cleaned, ":") > 0) & F.array_contains(codes, colon["code"]) & (colon["code"] != "")
        code = F.when(explicit != "", explicit).when(prefixed, colon["code"]).otherwise(F.get(codes, i))
        return F.when(
            cleaned != "",
            F.struct(
                strip(code).alias("code"), clean_domain_label(F.when(prefixed, colon["label"]).otherwise(shown)).alias("label")
            ),
        )

    return F.filter(F.transform(labels, entry), lambda e: e["code"] != "")


def _label(entries: Column, code: Column) -> Column:
    """The last label given for a code, NULL when blank or absent."""
    found = F.filter(entries, lambda e: e["code"] == code)
    return let(F.get(F.slice(found, -1, 1), F.lit(0)), lambda e: F.when(e["label"] != "", e["label"]))


def domain_array(doc: Column) -> Column:
    """Domain nodes of one record: filed codes first, then codes met only in the hierarchy."""
    hierarchy_codes = F.flatten(F.transform(hierarchy_array(doc), lambda e: F.array(e["childId"], e["parentId"])))
    codes = F.array_distinct(F.concat(association_codes(doc), hierarchy_codes))

    def labelled(codes: Column) -> Column:
        return F.struct(
            codes.alias("codes"),
            label_entries(as_list(doc, "en_domainAllCodeLabel_fs"), codes).alias("en"),
            label_entries(as_list(doc, "fr_domainAllCodeLabel_fs"), codes).alias("fr"),
        )

    def nodes(v: Column) -> Column:
        return F.transform(
            v["codes"],
            lambda c: let(
                F.struct(_label(v["en"], c).alias("en"), _label(v["fr"], c).alias("fr")),
                lambda n: F.struct(
                    c.alias("id"),
                    F.coalesce(n["en"], n["fr"], c).alias("name"),
                    F.coalesce(n["fr"], F.lit("")).alias("nameFr"),
                    F.lit("HAL").alias("source"),
                ),
            ),
        )

    return let(let(codes, labelled), nodes)


def extract_domains(records: DataFrame) -> DataFrame:
    rows = records.select("doc_ord", F.posexplode(opened(records, "domain_array", domain_array)).alias("pos", "d"))
    return rows.select("doc_ord", "pos", "d.*")


def extract_domain_links(records: DataFrame) -> DataFrame:
    rows = records.select(
        "doc_ord", "projectHalId", opened(records, "main_code", main_code).alias("main"),
        F.posexplode(opened(records, "association_codes", association_codes)).alias("pos", "domainId"),
    )
    return rows.select(
        "doc_ord", "projectHalId", "pos", "domainId", ((F.col("main") != "") & (F.col("main") == F.col("domainId"))).alias("primary")
    )


def extract_hierarchy(records: DataFrame) -> DataFrame:
    rows = records.select("doc_ord", F.posexplode(opened(records, "hierarchy_array", hierarchy_array)).alias("pos", "e"))
    return rows.select("doc_ord", "pos", "e.*")
