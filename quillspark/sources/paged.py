"""Recorded pages of a provider, read along their cursors; and new pages as a stream.

A page is a JSON file named by the hash of the request that it answers, so that the folder
is also a cache: {"request": ..., "meta": {"count", "next_cursor"}, "results": [...]}. A
query's pages are a chain of cursors from "*" on; each chain is a partition, read page by
page only until the query's quota of different works is full.

spark.dataSource.register(PagedResponses) makes it the format "paged", with the options path
(a folder in any file system that Arrow knows), queries (JSON list of {id, query, filter})
and quota; report=attempts gives a row per query instead: how its reading went.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition

from quillspark.sources.recorded import opened

PER_PAGE, TRIES = 100, 3
WORKS = "query_id string, rank int, candidate_id string, title string, doi string, year int"
ATTEMPTS = "query_id string, status string, retained int, fetched int, total int, quota int, message string"
PAGE = "request struct<search:string,per_page:string,cursor:string,filter:string>, meta struct<count:int,next_cursor:string>, results array<struct<id:string,title:string,doi:string,year:int>>"


def canonical(value: object) -> str:
    """A JSON value in one form: keys sorted, no spaces, letters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def request_hash(request: dict, length: int = 24) -> str:
    return hashlib.sha256(canonical(request).encode()).hexdigest()[:length]


def request_of(query: dict, cursor: str) -> dict:
    """The request for a page; keys that a query lacks are not in it."""
    own = {"search": query["query"], "per_page": str(PER_PAGE), "cursor": cursor}
    return own | ({"filter": query["filter"]} if query.get("filter") else {})


def put_page(folder: str, page: dict) -> str:
    """Write a page under its request's hash, whole or not at all; its name."""
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    name = f"{request_hash(page['request'])}.json"
    with fs.open_output_stream(f"{path}/.{name}.tmp") as out:
        out.write(canonical(page).encode())
    fs.move(f"{path}/.{name}.tmp", f"{path}/{name}")
    return name


class Chain(InputPartition):
    def __init__(self, query: dict):
        self.query = query


class PagedReader(DataSourceReader):
    def __init__(self, source: PagedResponses):
        o = source.options
        self.fetch, self.folder, self.quota, self.report = source.fetch, o["path"], int(o.get("quota", 100)), o.get("report", "candidates")
        self.queries = json.loads(o["queries"])
        self.refresh = str(o.get("refresh", "false")).lower() == "true"
        self.since: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Queries are pruned by their id, works by their least year; all other filters are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("query_id",):
                self.queries = [q for q in self.queries if q["id"] == f.value]
            elif isinstance(f, In) and f.attribute == ("query_id",):
                self.queries = [q for q in self.queries if q["id"] in f.value]
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("year",) and self.report == "candidates":
                self.since = f.value if self.since is None else max(self.since, f.value)
            else:
                yield f

    def partitions(self) -> list[Chain]:
        return [Chain(q) for q in self.queries]

    def page(self, request: dict) -> dict:
        """The recorded page, or what fetch() gives, recorded; as often as TRIES."""
        fs, path = opened(self.folder)
        name = f"{path}/{request_hash(request)}.json"
        if not self.refresh and fs.get_file_info(name).type == pafs.FileType.File:
            with fs.open_input_stream(name) as f:
                return json.loads(f.read())
        for n in range(TRIES):
            try:
                page = {"request": request} | self.fetch(request)
                break
            except OSError:
                if n == TRIES - 1:
                    raise
        put_page(self.folder, page)
        return page

    def works(self, query: dict) -> tuple[list[tuple], int, int | None]:
        """Different works of a query in their order, up to the quota; how many were read, and how many there are by the provider."""
        found, seen, fetched, total, cursor = [], set(), 0, None, "*"
        while cursor and len(found) < self.quota:
            page = self.page(request_of(query, cursor))
            results, meta = page.get("results") or [], page.get("meta") or {}
            fetched += len(results)
            total = meta["count"] if isinstance(meta.get("count"), int) else total
            for w in results:
                if w.get("id") and w["id"] not in seen and len(found) < self.quota:
                    seen.add(w["id"])
                    year = w.get("year")
                    found.append((w["id"], w.get("title"), w.get("doi"), year if isinstance(year, int) and not isinstance(year, bool) else None))
            cursor = meta.get("next_cursor") if results else None
        return found, fetched, total

    def read(self, partition: Chain) -> Iterator[tuple]:
        query = partition.query
        try:
            found, fetched, total = self.works(query)
            status, message = "ok", None
        except (OSError, ValueError, KeyError, LookupError) as error:  # of this query alone: the others go on
            found, fetched, total, status, message = [], 0, None, "failed", f"{type(error).__name__}: {error}"
        if self.report == "attempts":
            yield (query["id"], status, len(found), fetched, total, self.quota, message)
            return
        for rank, (i, title, doi, year) in enumerate(found):
            if self.since is None or year is not None and year >= self.since:
                yield (query["id"], rank, i, title, doi, year)


class PagedResponses(DataSource):
    """Only recorded pages, unless a subclass's fetch() asks the provider for the others."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return ATTEMPTS if self.options.get("report") == "attempts" else WORKS

    def reader(self, schema) -> PagedReader:
        return PagedReader(self)

    @staticmethod
    def fetch(request: dict) -> dict:
        raise LookupError(f"page not recorded: {canonical(request)}")


def read_paged(spark: SparkSession, folder: str, queries: list[dict], quota: int, report: str = "candidates", source: type[PagedResponses] = PagedResponses) -> DataFrame:
    """Works of queries from recorded pages, or how the reading of each went. Filters are pushed while the setting is on."""
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(source.name()).options(path=folder, queries=json.dumps(queries), quota=quota, report=report).load()


def new_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the works of pages as they are recorded: search, cursor, and the works' columns."""
    pages = spark.readStream.schema(PAGE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return pages.select(F.col("request.search").alias("search"), F.col("request.cursor").alias("cursor"), F.posexplode("results").alias("at", "w")).select("search", "cursor", "at", F.col("w.id").alias("candidate_id"), "w.title", "w.doi", "w.year")


def recorded(works: DataFrame, folder: str, filter: str | None = None) -> None:
    """Write works (query_id, rank from 0, id, title, doi, year) as the pages that a provider would give for them."""
    page = F.floor(F.col("rank") / PER_PAGE).cast("int")
    by = works.groupBy("query_id", page.alias("no")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "title", "doi", "year"))).alias("w"))  # PER_PAGE works
    count = works.groupBy("query_id").agg(F.count(F.lit(1)).alias("count"))

    def run(frames):
        for df in frames:
            for r in df.itertuples():
                cursor = lambda n: "*" if n == 0 else f"c{n}"
                more = (r.no + 1) * PER_PAGE < r.count_
                results = [{k: None if w[k] is None else w[k] for k in ("id", "title", "doi", "year")} for w in r.w]
                put_page(folder, {"request": request_of({"query": r.query_id, "filter": filter}, cursor(r.no)), "meta": {"count": int(r.count_), "next_cursor": cursor(r.no + 1) if more else None}, "results": results})
            yield df[["query_id"]].iloc[:0]

    pages = by.join(F.broadcast(count.withColumnRenamed("count", "count_")), "query_id")  # a row per query
    pages.mapInPandas(run, "query_id string").write.format("noop").mode("overwrite").save()
