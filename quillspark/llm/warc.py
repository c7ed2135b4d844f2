"""WARC archives: a writer of pages, and a reader that salvages what follows damage.

Records are gzip members of their own, or plain. The reader checks each one (member
checksum, version line, header, lengths, payload digest). After a failed check it searches
for the next valid member, or in plain archives the next version line that starts a valid
record, goes on there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import rows
from quillspark.llm.token_files import put
from quillspark.shared import new_path, observed, written

VERSION, GZIP, CRLF = b"WARC/1.1", b"\x1f\x8b\x08", b"\r\n"
DATE = "2024-01-01T00:00:00Z"


@dataclass
class Salvaged:
    """What a reader found: records (offset, headers, payload) and gaps (start, stop, why)."""

    records: list[tuple[int, dict[str, str], bytes]] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None = None, compress: bool = True) -> bytes:
    """A response record of a payload, or the revisit record of one that refers_to holds."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"Content-Length: %d\r\n\r\n" % len(payload) + payload if refers_to is None else CRLF)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A") or f"urn:page:{page_id}"
    lines = [
        VERSION.decode(),
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: {digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + CRLF * 2
    whole = head + block + CRLF * 2
    if not compress:
        return whole
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(whole) + z.flush()


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the plain record at a place; ValueError if it isn't valid. A header may have any length."""
    if data[at : at + 7] != VERSION[:7]:
        raise ValueError("no version line")
    headers, line = {}, data.find(CRLF, at) + 2
    while True:
        stop = data.find(CRLF, line)
        if line < 2 or stop < 0:
            raise ValueError("unfinished header")
        if stop == line:
            break
        name, colon, value = data[line:stop].partition(b":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "strict")
        line = stop + 2
    start = line + 2
    try:
        end = start + int(headers["content-length"])
    except KeyError:
        raise ValueError("no length") from None
    if end < start or data[end : end + 4] != CRLF * 2:
        raise ValueError("wrong length")
    block = data[start:end]
    payload = block.partition(CRLF * 2)[2] if headers.get("content-type", "").startswith("application/http") else block
    own = headers.get("warc-payload-digest")
    if own and headers.get("warc-type") != "revisit" and own != digest(payload):
        raise ValueError("wrong payload digest")
    return headers, payload, end + 4


def member(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at a place, and its end; ValueError if it is damaged. It is fed in pieces, so its cost is its own length."""
    z, out, view, size = zlib.decompressobj(31), [], memoryview(data), 4096
    try:
        while not z.eof and at < len(data):
            piece = view[at : at + size]
            out.append(z.decompress(piece))
            at, size = at + len(piece), min(2 * size, 65536)
    except zlib.error as e:
        raise ValueError(f"bad member: {e}") from None
    if not z.eof:
        raise ValueError("truncated member")
    return b"".join(out), at - len(z.unused_data)


class Starts:
    """Places where a member or a record may start, in order; each pattern is looked for once over the archive."""

    def __init__(self, data: bytes):
        self.data, self.next = data, {GZIP: -1, VERSION[:7]: -1}

    def after(self, at: int) -> int:
        """The first such place from `at` on, or the end; `at` never falls."""
        for pattern, place in self.next.items():
            if place < at:
                found = self.data.find(pattern, at)
                self.next[pattern] = len(self.data) if found < 0 else found
        return min(self.next.values())


def one(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at a place, a member or plain; ValueError if it isn't valid."""
    if data[at : at + 3] != GZIP:
        return parsed(data, at)
    plain, end = member(data, at)
    headers, payload, used = parsed(plain)
    if used != len(plain):
        raise ValueError("more than a record in a member")
    return headers, payload, end


def salvage(data: bytes) -> Salvaged:
    """All valid records of an archive, plain or of gzip members, with the gaps between them."""
    out, at, starts, gap = Salvaged(), 0, Starts(data), None
    while at < len(data):
        try:
            headers, payload, end = one(data, at)
        except ValueError as e:  # of decoding too
            gap = gap or (at, str(e))
            at = starts.after(at + 1)
            continue
        if gap:
            out.gaps.append((gap[0], at, gap[1]))
            gap = None
        out.records.append((at, headers, payload))
        at = end
    if gap:
        out.gaps.append((gap[0], len(data), gap[1]))
    return out


def decide(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with refers_to: for a payload of at least `least` bytes that several rows have, the largest page_id (null for its row and for all other payloads).

    If several rows have that page_id, one of them is the one that is not referred; the
    others refer to their own page_id. To tell them apart the pages are then written with
    numbers first. Rows without an id refer to none. Only counts of digests meet: a payload
    of many pages is a row for each task, and the winners of repeated payloads are joined
    by size, split by adaptive execution if skewed.
    """
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    long = (F.octet_length("html") >= least) & F.col("page_id").isNotNull()
    keyed = pages.select("page_id", F.when(long, sha).alias("_of")).where("_of is not null")
    each = keyed.groupBy("_of", "page_id").count().groupBy("_of")
    winners = each.agg(F.max(F.struct("page_id", "count")).alias("_first"), F.sum("count").alias("_n")).where("_n > 1")
    winners, told = observed(winners, "winners", F.count_if(F.col("_first.count") > 1).alias("ties"))
    if told["ties"]:
        pages = written(pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("_row")), "pages")
        tied = pages.withColumn("_sha", F.when(long, sha)).join(winners.where("_first.count > 1"), F.col("_sha") == F.col("_of"))
        rows = tied.where(F.col("page_id") == F.col("_first.page_id")).groupBy("_of").agg(F.max("_row").alias("_last"))
        winners = winners.join(rows, "_of", "left")
    else:
        pages, winners = pages.withColumn("_row", F.lit(None).cast("long")), winners.withColumn("_last", F.lit(None).cast("long"))
    key = F.coalesce(F.when(long, sha), F.concat(F.lit("-"), F.xxhash64("page_id", "url", "html").cast("string")))
    joined = pages.withColumn("_key", key).join(winners, F.col("_key") == F.col("_of"), "left")
    own = (F.col("page_id") == F.col("_first.page_id")) & F.coalesce(F.col("_row") == F.col("_last"), F.lit(True))
    payload = F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    return joined.select("page_id", "url", payload, F.when(F.col("_of").isNotNull() & ~own, F.col("_first.page_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 1000, compress: bool = True, file_bytes: int = 24 << 20) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) into archives; return (file, n_records).

    A null html is an empty payload. Of records with equal payloads of at least `least`
    bytes the one with the largest page_id is a response, others revisit it; smaller ones
    are all responses, as are pages without page_id. Of rows with the same page_id and payload
    one is the response and the others revisit it. Repeated rows are records each; an empty
    table gives no archive; other columns are ignored; urls and pages may be of any length.
    Archives are whole or absent; a retried task replaces its own.
    """
    suffix = ".warc.gz" if compress else ".warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, size, held = TaskContext.get().partitionId(), 0, 0, []

        def file() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{segment:05d}{suffix}"
            put(folder, name, b"".join(held))
            return pa.record_batch([[name], [len(held)]], names=["file", "n_records"])

        for columns in rows(batches, "page_id", "url", "payload", "refers_to", step=128):
            for page_id, url, payload, refers in zip(*columns, strict=True):
                held.append(record(page_id, url, payload, refers, compress))
                size += len(held[-1])
                if size >= file_bytes:
                    yield file()
                    held, size, segment = [], 0, segment + 1
        if held:
            yield file()

    made = decide(pages.select("page_id", "url", "html"), least).mapInArrow(run, "file string, n_records long")
    at = new_path(pages.sparkSession, "warc-manifest")
    made.write.parquet(at)
    return pages.sparkSession.read.schema(made.schema).parquet(at)


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Records and gaps of the archives in a folder, a row each.

    file, offset, page_id, url, record_type (`gap` for a quarantined one), refers_to,
    payload_bytes and payload_digest (lower-case hex SHA-1) of the full payload, stop and
    reason of a gap, and with_payload the payload (null but for responses). An empty folder
    gives no row, an empty archive neither; repeated records are rows each.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    names = ["file", "offset", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "stop", "reason"]
    kinds = ["string", "long", "long", "string", "string", "long", "long", "string", "long", "string"]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    if with_payload:
        names, kinds = [*names, "payload"], [*kinds, "binary"]

    def number(ref: str | None) -> int | None:
        found = (ref or "").strip("<>").rpartition(":")[2]
        return int(found) if found.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files, bodies in rows(batches, "file", "content", step=1):
            found, out = salvage(bodies[0]), []
            for offset, h, payload in found.records:
                kind, own = h.get("warc-type"), h.get("warc-payload-digest", "").rpartition(":")[2]
                size = len(payload) if kind == "response" else int(h.get("x-payload-length", 0))
                sha = hashlib.sha1(payload).hexdigest() if kind == "response" or not own else base64.b32decode(own).hex()
                out.append((files[0], offset, number(h.get("warc-record-id")), h.get("warc-target-uri"), kind, number(h.get("warc-refers-to")), size, sha, None, None, payload if kind == "response" else None))
            for a, b, why in found.gaps:
                out.append((files[0], a, None, None, "gap", None, b - a, None, b, why, None))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(11)]
            yield pa.record_batch([pa.array(columns[i], types[k]) for i, k in enumerate(kinds)], names=names)

    return files.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def whole(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """All records of the archives that a manifest names, as a written table; a ValueError with the first gaps if one is missing."""
    found = read(spark, folder)
    gap = F.col("record_type") == "gap"
    rows_, told = observed(found.select("file", "offset", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stop", "reason"), "warc-rows", F.count_if(~gap).alias("records"), F.count_if(gap).alias("gaps"))
    wanted = manifest.agg(F.sum("n_records")).first()[0] or 0
    if told["gaps"] or told["records"] != wanted:
        gaps = [f"{r.file}, {r.offset} to {r.stop}: {r.reason}" for r in rows_.where(gap).orderBy("file", "offset").limit(20).collect()]
        raise ValueError(f"{told['records']} of {wanted} records were read back; gaps: {gaps}")
    return rows_.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
