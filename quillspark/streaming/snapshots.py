"""A table as versions: increments are merged into it, each committed once and whole.

A version is a manifest, a small JSON file, that names a folder of rows for each bucket of
keys. An increment rewrites the buckets its keys fall into and no others; its manifest is
written under another name and renamed, so that a version is there whole or not at all, and
readers of the version before are not disturbed. The manifest holds the stream's name and
epoch: an increment that is replayed after a crash finds its epoch committed and is passed
over. What a crash leaves behind is folders that no manifest names; swept() deletes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 32


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put_json(spark: SparkSession, path: str, value: object, replace: bool = True) -> None:
    """value as a JSON file, whole or not at all: written beside and renamed. Unless `replace`, a file of that name is an error."""
    jvm = spark._jvm
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, where = _hadoop(spark, own)
    out = fs.create(where, True)
    out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, int(replace))
    if replace:
        options[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(where, jvm.org.apache.hadoop.fs.Path(path), options)
    except Exception:
        fs.delete(where, False)
        raise


def get_json(spark: SparkSession, path: str) -> object:
    fs, where = _hadoop(spark, path)
    stream = fs.open(where)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    fs, where = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def made(spark: SparkSession, folder: str) -> None:
    fs, where = _hadoop(spark, folder)
    fs.mkdirs(where)


class Snapshots:
    """The versions of a table with a key column, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def manifest(self, version: int | None = None) -> dict | None:
        """The last manifest, or that of a version; None if there is none."""
        found = [n for n in names(self.spark, f"{self.root}/versions") if n.endswith(".json")]
        if version is not None:
            found = [n for n in found if int(n[:-5]) == version]
        return get_json(self.spark, f"{self.root}/versions/{found[-1]}") if found else None

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the last version, or of another one, of all buckets or of some."""
        held = (self.manifest(version) or {"buckets": {}})["buckets"]
        paths = [p for b, p in sorted(held.items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], stream: str, epoch: int, figures: dict | None = None) -> bool:
        """Commit fold(state, rows) as the next version; False if this epoch of the stream is committed already.

        fold sees the state of the buckets that rows' keys fall into, and returns all of it.
        """
        last = self.manifest()
        if last and last["epochs"].get(stream, -1) >= epoch:
            return False
        touched = [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]  # at most `buckets`
        held = dict(last["buckets"]) if last else {}
        path = f"{self.root}/rows/{uuid.uuid4().hex}"
        if touched:
            after = fold(self.read(last["version"] if last else -1, touched), rows).select([F.col(f.name).cast(f.dataType) for f in self.schema])
            after.withColumn("_bucket", self.bucket()).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(path)
            written = {int(n.partition("=")[2]) for n in names(self.spark, path) if n.startswith("_bucket=")}
            held = {b: p for b, p in held.items() if int(b) not in touched} | {str(b): f"{path}/_bucket={b}" for b in written}
        version = last["version"] + 1 if last else 0
        epochs = (last["epochs"] if last else {}) | {stream: epoch}
        put_json(self.spark, f"{self.root}/versions/{version:010d}.json", {"version": version, "epochs": epochs, "buckets": held, "figures": figures or {}}, replace=False)
        return True

    def swept(self, keep: int = 2) -> None:
        """Delete all but the last `keep` versions, and rows that none of these names. No merge may run meanwhile."""
        found = [n for n in names(self.spark, f"{self.root}/versions") if n.endswith(".json")]
        kept = {p.rsplit("/", 2)[1] for n in found[-keep:] for p in get_json(self.spark, f"{self.root}/versions/{n}")["buckets"].values()}
        for old in [f"{self.root}/versions/{n}" for n in found[:-keep]] + [f"{self.root}/rows/{n}" for n in names(self.spark, f"{self.root}/rows") if n not in kept]:
            fs, where = _hadoop(self.spark, old)
            fs.delete(where, True)


def run_increment(stream: DataFrame, put: Callable[[DataFrame, int], None], log: str) -> None:
    """Take all that the stream's source has now, in micro-batches given to put(rows, epoch), and go on from the log next time."""
    query = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(put).start()
    try:
        query.awaitTermination()
    except PySparkException:
        query.stop()
        raise
