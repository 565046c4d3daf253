"""Reading fields of a semi-structured record held in one VARIANT column.

A field may be absent, null, a scalar or a list. These builders give one typed view of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import strip


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; nested lambdas then read the bound result."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def raw(doc: Column, field: str) -> Column:
    """The field as VARIANT: SQL NULL when absent, a variant null when given as null."""
    return F.try_variant_get(doc, f"$.{field}", "variant")


def opened(records: DataFrame, name: str, build: Callable[[Column], Column]) -> Column:
    """``build(doc)``, or the column of that name where the records carry it already."""
    return F.col(name) if name in records.columns else build(F.col("doc"))


def has_key(doc: Column, field: str) -> Column:
    return raw(doc, field).isNotNull()


def is_missing(doc: Column, field: str) -> Column:
    """Absent or null."""
    return raw(doc, field).isNull() | F.coalesce(F.is_variant_null(raw(doc, field)), F.lit(True))


def is_list(doc: Column, field: str) -> Column:
    return F.try_variant_get(doc, f"$.{field}", "array<variant>").isNotNull()


def elements(doc: Column, field: str) -> Column:
    """The field as a list of variants; a scalar becomes a list of one, a missing field an empty list."""
    return F.coalesce(
        F.try_variant_get(doc, f"$.{field}", "array<variant>"),
        F.when(~is_missing(doc, field), F.array(raw(doc, field))),
        F.array().cast("array<variant>"),
    )


def scalar_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_list(doc: Column, field: str) -> Column:
    """The field as a list of strings; null elements stay null."""
    return F.coalesce(
        F.try_variant_get(doc, f"$.{field}", "array<string>"),
        F.when(~is_missing(doc, field), F.array(F.try_variant_get(doc, f"$.{field}", "string"))),
        F.array().cast("array<string>"),
    )


def list_length(doc: Column, field: str) -> Column:
    return F.size(as_list(doc, field))


def _truthy_text(value: Column) -> Column:
    """Text of a variant, NULL for null, empty text, zero and false. The text "0" counts as present."""
    text = scalar_text(value)
    zero = text.isin("0", "0.0", "false") & (F.schema_of_variant(value) != "STRING")
    return F.when((text != "") & ~zero, text)


def truthy_list(doc: Column, field: str, promote: bool = False) -> Column:
    """List of strings with falsy elements as NULL. Scalars count only when promoted."""
    values = elements(doc, field) if promote else F.try_variant_get(doc, f"$.{field}", "array<variant>")
    return F.transform(values, _truthy_text)


def text(doc: Column, field: str, default: str = "") -> Column:
    """Scalar text: the default when absent, ``None`` when null, a quoted list when it is a list."""
    items = F.try_variant_get(doc, f"$.{field}", "array<string>")
    listed = F.when(F.size(items) == 0, "[]").otherwise(F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']")))
    return (
        F.when(raw(doc, field).isNull(), F.lit(default))
        .when(F.is_variant_null(raw(doc, field)), F.lit("None"))
        .when(items.isNotNull(), listed)
        .otherwise(F.try_variant_get(doc, f"$.{field}", "string"))
    )


def first_text(doc: Column, field: str, default: str = "") -> Column:
    """First element of the list view, the default when it is falsy."""
    return F.coalesce(_truthy_text(F.get(elements(doc, field), F.lit(0))), F.lit(default))


def unique_text(values: Column) -> Column:
    """Trimmed, non-blank, distinct values in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(values, strip), lambda x: x != ""))


def parse_digits(value: Column) -> Column:
    """All-digit text as a long, anything else NULL."""
    cleaned = strip(value)
    return F.when(cleaned.rlike(r"^\p{Nd}+$"), cleaned.try_cast("long"))
