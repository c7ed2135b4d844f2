"""A data source over recorded provider responses: one JSON file per page of results.

spark.dataSource.register(RecordedResponses); spark.read.format("recorded").option("path", folder).load()
reads <folder>/*.json of any file system that Arrow knows, each {"query_id": ..., "results": [{"id", "title", "doi", "year"}, ...]}.
A file is a partition, so a folder of many pages is read in parallel.
"""

from __future__ import annotations

import json

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, any that Arrow knows, and its path there."""
    return pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        fs, path = opened(self.folder)
        return [Page(f.path) for f in sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda f: f.path) if f.path.endswith(".json")]

    def read(self, partition):
        with opened(self.folder)[0].open_input_stream(partition.path) as f:
            page = json.loads(f.read())
        for rank, work in enumerate(page.get("results") or []):
            year = work.get("year")
            yield (page.get("query_id"), rank, work.get("id"), work.get("title"), work.get("doi"), int(year) if isinstance(year, int) else None)


class RecordedResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return "query_id string, rank int, candidate_id string, title string, doi string, year int"

    def reader(self, schema):
        return _Reader(self.options["path"])
