"""Writers: CSV tables, appended and partition-wise replaced tables, snapshots, reports."""

from __future__ import annotations

import datetime
import json
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave import settings
from kinweave.operators.authors import pad_list
from kinweave.operators.upsert import with_bare_endpoints
from kinweave.schemas import BARE_ENDPOINTS, CANONICAL_TABLES, RELATION_ENDPOINTS, TABLE_KEYS
from kinweave.sources.records import build_manifest


def csv_value(field: T.StructField) -> Column:
    """Text of one CSV cell: empty for NULL, JSON for lists and structs, True/False for booleans."""
    value = F.col(field.name)
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        # to_json writes no blank after a comma; list cells carry one.
        text = F.to_json(value)
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            quoted = F.transform(value, lambda v: F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", ""))
            text = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    elif isinstance(field.dataType, T.BooleanType):
        text = F.initcap(value.cast("string"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("")).alias(field.name)


def csv_rows(df: DataFrame) -> DataFrame:
    return df.select(*[csv_value(f) for f in df.schema.fields])


def write_csv_tables(tables: dict[str, DataFrame], folder: str, single_file: bool = False) -> None:
    """One CSV folder per canonical table. ``single_file`` is for small exports only: it uses one task."""
    for name in CANONICAL_TABLES:
        rows = csv_rows(tables[name])
        rows = rows.coalesce(1) if single_file else rows
        rows.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(f"{folder}/{name}")


#: Partition column of appended tables: which write brought a row.
BATCH = "added_batch"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
    """All rows written so far, with their batch where the table is an appended one; None before the first write."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new(path: str, new: DataFrame, keys: list[str], batch: str | int | None = None) -> None:
    """Append those rows of ``new`` whose key is not there yet, one row per key, as one batch.

    Rows written before are read for their keys only and never written again. A batch that is repeated
    replaces its own rows, so a retry after a failure leaves the same table.
    """
    spark = new.sparkSession
    mark = f"b{uuid.uuid4().hex if batch is None else batch}"
    rows, present = new.dropDuplicates(keys), read_table(spark, path)
    if present is not None:
        others = present.where(F.col(BATCH) != mark).select(*keys)
        rows = rows.join(others, keys, "left_anti").select(*new.columns)
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={mark}")


def replace_partitions(path: str, rows: DataFrame, partition_by: list[str]) -> None:
    """Write ``rows`` over the partitions they belong to; other partitions stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def merge_graph(folder: str, tables: dict[str, DataFrame], batch: str | int | None = None) -> None:
    """Append new rows of every canonical table below ``folder``; the first writer of a key wins.

    Part-of links may name organisations and domains without a row of their own: these get one without properties.
    """
    for name, rows in tables.items():
        if name in BARE_ENDPOINTS:
            edges, key = BARE_ENDPOINTS[name]
            rows = with_bare_endpoints(rows, tables[edges], key, list(RELATION_ENDPOINTS[edges])) if edges in tables else rows
        append_new(f"{folder}/{name}", rows, TABLE_KEYS[name], batch)


def snapshot_lines(lines: DataFrame) -> DataFrame:
    """(doc_ord, value): author arrays brought to equal length, keys sorted.

    Author arrays are the requested ones and every other field whose name starts with ``auth``. The record
    stays JSON text: only its author fields are replaced, zeros fill the gaps.
    """
    requested = F.array(*[F.lit(f) for f in settings.AUTHOR_ARRAY_FIELDS])
    parsed = lines.select("doc_ord", F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>").alias("fields"))
    is_author = lambda k: k.startswith("auth")
    keyed = parsed.withColumn("authors", F.array_sort(F.array_union(requested, F.filter(F.map_keys("fields"), is_author))))

    def items(key: Column) -> Column:
        """JSON text of the elements of a list, of a lone value, or nothing."""
        value = F.try_element_at("fields", key)
        several = F.try_variant_get(value, "$", "array<variant>")
        one = F.when(value.isNotNull() & ~F.is_variant_null(value), F.array(F.to_json(value)))
        listed = F.transform(several, lambda v: F.coalesce(F.to_json(v), F.lit("null")))
        return F.coalesce(F.when(F.schema_of_variant(value).startswith("ARRAY"), listed), one, F.array().cast("array<string>"))

    sized = keyed.withColumn("lists", F.transform("authors", items))
    names = F.size(F.element_at("lists", F.array_position("authors", F.lit("authFullName_s")).cast("int")))
    sized = sized.withColumn("n", F.when(names > 0, names).otherwise(F.array_max(F.transform("lists", F.size))))
    quoted = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    padded = F.zip_with("authors", "lists", lambda k, v: F.concat(quoted(k), F.lit(": ["), F.array_join(pad_list(v, F.col("n")), ", "), F.lit("]")))
    rest = F.to_json(F.map_filter("fields", lambda k, _: ~is_author(k)))
    body = F.regexp_replace(rest, r"^\{|\}$", "")
    value = F.concat(F.lit("{"), F.when(body != "", F.concat(body, F.lit(", "))).otherwise(""), F.array_join(padded, ", "), F.lit("}"))
    return sized.select("doc_ord", value.alias("value"))


def write_snapshot(
    lines: DataFrame, folder: str, num_found: int, query: str = settings.FULL_QUERY, sort: str | None = None,
    rows_per_page: int | None = None, timestamp: str | None = None, normalize: bool = True,
) -> str:
    """Write records and manifest below ``folder``/<UTC stamp>; returns that folder. Files follow ``doc_ord`` as a whole."""
    stamp = timestamp or datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    target = f"{folder}/{stamp}"
    rows = snapshot_lines(lines) if normalize else lines
    rows.orderBy("doc_ord").select("value").write.text(f"{target}/records")
    written = lines.sparkSession.read.text(f"{target}/records").count()
    manifest = build_manifest(query, settings.RECORD_FIELDS, sort, num_found, written, stamp, rows_per_page)
    text = json.dumps(manifest, ensure_ascii=False)
    lines.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{target}/manifest")
    return target


def write_report(report: dict, folder: str | Path) -> dict[str, Path]:
    """Date-stamped JSON and Markdown of a finished report."""
    from kinweave.operators.report import render_markdown

    day = report["report_date"]
    datetime.date.fromisoformat(day)
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    paths = {"json": folder / f"data_quality_{day}.json", "markdown": folder / f"data_quality_{day}.md"}
    paths["json"].write_text(json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")
    paths["markdown"].write_text(render_markdown(report), encoding="utf-8")
    return paths
