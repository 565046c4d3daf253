"""Offset-paged publication API as a Spark data source: one input partition per page."""

from __future__ import annotations

import argparse
import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinweave import settings
from kinweave.sources.sinks import read_table

TIMEOUT_SECONDS = 30
#: Pages written together by a harvest; what one lost job has to fetch again at most.
WAVE_PAGES = 1000


def build_query(query: str = settings.FULL_QUERY, hal_id: str = "", title: str = "", doc_type: str = "") -> str:
    """Source-side filter: an identifier beats a title, a title beats a free query; the type narrows any."""
    if hal_id:
        base = f"halId_s:{hal_id}"
    elif title:
        base = f'title_t:"{title}"'
    else:
        base = query
    return f"({base}) AND docType_s:{doc_type}" if doc_type else base


def page_starts(num_found: int, rows_per_page: int, max_rows: int | None = None) -> list[tuple[int, int]]:
    """(start, rows) of every page; the last one is cut to what is left."""
    wanted = num_found if max_rows is None else min(num_found, max_rows)
    return [(start, min(rows_per_page, wanted - start)) for start in range(0, wanted, rows_per_page)]


def http_page(base_url: str, params: dict[str, str]) -> dict:
    """One GET; a non-success status raises."""
    with urllib.request.urlopen(f"{base_url}?{urllib.parse.urlencode(params)}", timeout=TIMEOUT_SECONDS) as answer:
        return json.load(answer)


def unwrap(answer: dict) -> tuple[int, list[dict]]:
    """numFound and docs of a response envelope."""
    body = answer.get("response") if isinstance(answer, dict) else None
    if not isinstance(body, dict) or not isinstance(body.get("docs"), list) or not isinstance(body.get("numFound"), int):
        raise ValueError("Response must hold an object with integer numFound and a list of docs.")
    return body["numFound"], body["docs"]


@dataclass
class Page(InputPartition):
    start: int
    rows: int


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Callable[[str, dict[str, str]], dict]) -> None:
        self.options, self.fetch = options, fetch

    def _params(self, start: int, rows: int) -> dict[str, str]:
        params = {
            "q": self.options.get("query", settings.FULL_QUERY), "start": str(start), "rows": str(rows), "wt": "json",
            "fl": self.options.get("fields", ",".join(settings.RECORD_FIELDS)),
        }
        if self.options.get("sort"):
            params["sort"] = self.options["sort"]
        return params

    def found(self) -> int:
        """Number of records the source has for the query."""
        return unwrap(self.fetch(self.options["url"], self._params(0, 0)))[0]

    def partitions(self) -> list[InputPartition]:
        return [Page(start, rows) for start, rows in self.pages()]

    def pages(self) -> list[tuple[int, int]]:
        limit = self.options.get("maxrows")
        return page_starts(self.found(), int(self.options.get("rowsperpage", "500")), int(limit) if limit else None)

    def read(self, partition: Page) -> Iterator[tuple[int, str]]:
        _, docs = unwrap(self.fetch(self.options["url"], self._params(partition.start, partition.rows)))
        if len(docs) != partition.rows:
            raise ValueError(f"Page at {partition.start} holds {len(docs)} of {partition.rows} records.")
        for offset, doc in enumerate(docs):
            yield partition.start + offset, json.dumps(doc, ensure_ascii=False, sort_keys=True)


class PublicationApi(DataSource):
    """``spark.read.format("publication_api").option("url", ...)`` gives (doc_ord, value) lines."""

    fetch = staticmethod(http_page)

    @classmethod
    def name(cls) -> str:
        return "publication_api"

    def schema(self) -> str:
        return "doc_ord long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options), type(self).fetch)


def read_publications(spark: SparkSession, url: str, source: type[DataSource] = PublicationApi, **options: str) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(url=url, **options).load()


def count_publications(url: str, source: type[DataSource] = PublicationApi, **options: str) -> int:
    """numFound of a query, asked of the source itself."""
    return _PageReader({"url": url, **options}, source.fetch).found()


# ---------------------------------------------------------------------------
# Harvest that can be taken up again
# ---------------------------------------------------------------------------

class _HarvestReader(_PageReader):
    def partitions(self) -> list[InputPartition]:
        return [Page(*map(int, page.split(":"))) for page in self.options["pages"].split(",")]

    def read(self, partition: Page) -> Iterator[tuple[int, int | None, str | None, str | None]]:
        try:
            lines = list(super().read(partition))
        except (OSError, ValueError) as fault:  # refused, timed out, cut short or not an answer: told as a row
            yield partition.start, None, None, f"{type(fault).__name__}: {fault}"
        else:
            for ord_, value in lines:
                yield partition.start, ord_, value, None


class PublicationPages(PublicationApi):
    """Pages named by the option ``pages`` (start:rows, comma-joined); one that fails is a row with its error."""

    @classmethod
    def name(cls) -> str:
        return "publication_pages"

    def schema(self) -> str:
        return "page long, doc_ord long, value string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _HarvestReader(dict(self.options), type(self).fetch)


class HarvestIncomplete(RuntimeError):
    """Some pages could not be fetched; the others are kept."""


def _kept_pages(spark: SparkSession, folder: str) -> DataFrame | None:
    """(page, wave, n): records of each page by its last wave without an error."""
    rows = read_table(spark, f"{folder}/pages")
    if rows is None:
        return None
    counted = rows.where("error IS NULL").groupBy("page", "wave").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("page").agg(F.max_by(F.struct("wave", "n"), "wave").alias("last")).select("page", "last.wave", "last.n")


def _check_request(spark: SparkSession, folder: str, request: dict[str, str]) -> None:
    """Pages of one folder belong to one request, which the first run writes down."""
    text = json.dumps(request, sort_keys=True)
    given = read_table(spark, f"{folder}/request", "request string")
    if given is None:
        spark.createDataFrame([(text,)], "request string").coalesce(1).write.parquet(f"{folder}/request")
    elif given.first()["request"] != text:
        raise ValueError(f"{folder} holds pages of another request: {given.first()['request']}")


def harvest(spark: SparkSession, url: str, folder: str, source: type[DataSource] = PublicationPages, wave_pages: int = WAVE_PAGES, **options: str) -> DataFrame:
    """(doc_ord, value) lines of all pages, each kept below ``folder`` once it is fetched.

    Pages are fetched in waves, and each wave is written by itself. A page that fails does not fail its wave. When all
    have been tried, missing ones raise ``HarvestIncomplete``; the same call then fetches these alone, as it does
    after a lost driver. A page whose size has changed since, as the last one may, is fetched again.
    """
    spark.dataSource.register(source)
    _check_request(spark, folder, {"url": url, **options})
    pages = _PageReader({"url": url, **options}, source.fetch).pages()

    def missing() -> list[tuple[int, int]]:
        kept = _kept_pages(spark, folder)
        sizes = {} if kept is None else {r["page"]: r["n"] for r in kept.collect()}  # one row per page, as the list of pages itself
        return [page for page in pages if sizes.get(page[0]) != page[1]]

    todo, rows = missing(), read_table(spark, f"{folder}/pages")
    last = -1 if rows is None else rows.agg(F.max("wave")).first()[0]
    for number, at in enumerate(range(0, len(todo), wave_pages), last + 1):
        named = ",".join(f"{start}:{n}" for start, n in todo[at:at + wave_pages])
        fetched = spark.read.format(source.name()).options(url=url, pages=named, **options).load()
        fetched.write.mode("overwrite").parquet(f"{folder}/pages/wave={number}")
    left = missing() if todo else []
    if left:
        raise HarvestIncomplete(f"{len(left)} of {len(pages)} pages are missing, the first at {left[0][0]}; call again to fetch them.")
    if not pages:
        return spark.createDataFrame([], "doc_ord long, value string")
    wanted = _kept_pages(spark, folder).where(F.col("page") < pages[-1][0] + pages[-1][1])
    rows = read_table(spark, f"{folder}/pages").where("error IS NULL")
    return rows.join(wanted.select("page", "wave"), ["page", "wave"], "left_semi").select("doc_ord", "value")


def query_arguments(parser: argparse.ArgumentParser) -> None:
    for flag, default in (("--query", settings.FULL_QUERY), ("--hal-id", ""), ("--title", ""), ("--doc-type", "")):
        parser.add_argument(flag, default=default)
