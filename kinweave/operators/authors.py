"""Authors of a record: aligned identifiers, fallbacks, name parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.records import as_list, let, opened, parse_digits, truthy_list
from kinweave.functions.text import SPACE, name_key, strip

NO_TEXT = ""

ATTRIBUTE_FIELDS = {
    "firstName": "authFirstName_s",
    "lastName": "authLastName_s",
    "emailDomain": "authEmailDomain_s",
    "orcidId": "authORCIDIdExt_s",
    "googleScholarId": "authGoogleScholarIdExt_s",
    "researcherId": "authResearcherIdIdExt_s",
    "idrefId": "authIdRefIdExt_s",
}


def _singles(pairs: Column) -> Column:
    """Entries whose key occurs once, from an array of (key, value) structs, as a map.

    Sorting brings equal keys together, so one look at both neighbours decides; long author
    lists stay far from quadratic work.
    """

    def keep(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda e, i: ~F.coalesce(F.get(ordered, i - 1)["key"] == e["key"], F.lit(False))
            & ~F.coalesce(F.get(ordered, i + 1)["key"] == e["key"], F.lit(False)),
        )

    return F.map_from_entries(let(F.array_sort(pairs), keep))


def aligned_ids(names: Column, ids: Column) -> Column:
    """Identifiers by author position, repaired when a record lists them in shifted order.

    An identifier that spells exactly one author's name belongs to that author. If any such match
    crosses positions, the record counts as shifted: only unambiguous matches are kept. Otherwise
    the given positions stand.
    """

    def positions(a: Column) -> Column:
        return F.transform(
            a["names"], lambda _, i: let(F.get(a["ids"], i), lambda v: F.when(strip(v) != "0", v))
        )

    def by_name(a: Column) -> Column:
        keyed = F.transform(a["names"], lambda n, i: F.struct(name_key(F.coalesce(n, F.lit("None"))).alias("key"), i.alias("pos")))
        return _singles(F.filter(keyed, lambda e: e["key"] != ""))

    def matched(b: Column) -> Column:
        found = F.transform(
            b["given"],
            lambda v, i: F.struct(
                F.when(v.isNotNull(), F.try_element_at(b["lookup"], name_key(v))).alias("key"),
                F.struct(i.alias("source"), v.alias("id")).alias("match"),
            ),
        )
        return F.filter(found, lambda m: m["key"].isNotNull())

    def repaired(c: Column) -> Column:
        shifted = F.exists(c["matches"], lambda m: m["key"] != m["match"]["source"])
        kept = let(
            _singles(c["matches"]),
            lambda single: F.transform(c["given"], lambda _, i: F.try_element_at(single, i)["id"]),
        )
        return F.when(shifted, kept).otherwise(c["given"])

    bound = F.struct(names.alias("names"), ids.alias("ids"))
    return let(
        bound,
        lambda a: let(
            F.struct(positions(a).alias("given"), by_name(a).alias("lookup")),
            lambda b: let(F.struct(b["given"].alias("given"), matched(b).alias("matches")), repaired),
        ),
    )


def _author_id(a: Column, full: Column, i: Column) -> Column:
    person = F.get(a["personId"], i)
    fallback = F.when(person.isNotNull(), F.concat(F.lit("person_"), person.cast("string"))).otherwise(
        F.concat(F.lit("unknown_"), F.coalesce(F.when(full != "", full), i.cast("string")))
    )
    return F.coalesce(F.get(a["halId"], i), fallback)


def _author(a: Column, full: Column, i: Column) -> Column:
    first, last = F.get(a["firstName"], i), F.get(a["lastName"], i)
    unnamed = first.isNull() & last.isNull() & (full != "")
    parts = F.when(unnamed, F.split(F.regexp_replace(full, f"(?U)^{SPACE}+", ""), f"(?U){SPACE}+", 2)).otherwise(F.array(first, last))
    rest = [
        F.coalesce(F.get(a[name], i), F.lit(NO_TEXT)).alias(name)
        for name in ATTRIBUTE_FIELDS
        if name not in ("firstName", "lastName")
    ]

    def row(both: Column) -> Column:
        first_name, last_name = (F.coalesce(F.get(both, F.lit(k)), F.lit(NO_TEXT)) for k in (0, 1))
        return F.struct(
            _author_id(a, full, i).alias("halId"),
            F.get(a["personId"], i).alias("personId"),
            first_name.alias("firstName"),
            last_name.alias("lastName"),
            F.concat_ws(" ", F.when(first_name != "", first_name), F.when(last_name != "", last_name)).alias("fullName"),
            *rest,
            full.alias("givenName"),
        )

    return let(parts, row)  # the name is split once


def _bound_ids(doc: Column) -> list[Column]:
    """Names, aligned identifiers and person numbers of one record."""
    names = as_list(doc, "authFullName_s")
    person = F.transform(
        truthy_list(doc, "authIdPerson_i"), lambda v: let(parse_digits(v), lambda n: F.when(n != 0, n))
    )
    return [
        names.alias("names"),
        aligned_ids(names, truthy_list(doc, "authIdHal_s", promote=True)).alias("halId"),
        person.alias("personId"),
    ]


def author_array(doc: Column) -> Column:
    """All authors of one record as an array of structs, in record order."""
    bound = F.struct(*_bound_ids(doc), *[truthy_list(doc, field).alias(name) for name, field in ATTRIBUTE_FIELDS.items()])
    return let(bound, lambda a: F.transform(a["names"], lambda full, i: _author(a, full, i)))


def author_ids(doc: Column) -> Column:
    """The identifiers of ``author_array`` alone; names and attributes are not read."""
    return let(F.struct(*_bound_ids(doc)), lambda a: F.transform(a["names"], lambda full, i: _author_id(a, full, i)))


def extract_author_links(records: DataFrame) -> DataFrame:
    """(projectHalId, authorHalId) per author appearance, as in ``extract_authors``."""
    return records.select("projectHalId", F.explode(author_ids(F.col("doc"))).alias("authorHalId"))


def extract_authors(records: DataFrame) -> DataFrame:
    """One row per author appearance: (doc_ord, projectHalId, pos, author columns)."""
    rows = records.select("doc_ord", "projectHalId", F.posexplode(opened(records, "author_array", author_array)).alias("pos", "author"))
    return rows.select("doc_ord", "projectHalId", "pos", "author.*")


def pad_author_arrays(doc: Column, fields: list[str]) -> list[Column]:
    """Author arrays padded with 0 or cut to the number of author names (or the longest array)."""
    lists = {f: as_list(doc, f) for f in fields}
    names = F.size(as_list(doc, "authFullName_s"))
    longest = F.greatest(*[F.size(v) for v in lists.values()]) if len(lists) > 1 else F.size(*lists.values())
    length = F.when(names > 0, names).otherwise(longest)
    return [pad_list(values, length).alias(name) for name, values in lists.items()]


def pad_list(values: Column, length: Column, filler: str = "0") -> Column:
    """Exactly ``length`` elements: cut, or filled up."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(filler), length)), F.lit(1), length)
