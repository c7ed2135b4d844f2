"""WARC archives and token files on awkward tables: long headers, ties, repeats, damage, retries."""

import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import token_files, warc
from quillspark.shared import new_path
from tests.llm.data import empty
from tests.llm.test_operators import whole

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("compress", [True, False])
def test_a_long_url_is_no_gap(spark, compress):
    rows = [(1, "http://a/" + "x" * 100_000, "<p>" + "a" * 2000), (2, "http://é " + "y" * 70_000, "<p>" + "a" * 2000), (3, "u", "\r\n\r\n WARC/1.1\r\n" * 200)]
    folder = new_path(spark, "w")
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), folder, compress=compress)
    got = {r.page_id: r for r in warc.read(spark, folder, with_payload=True).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None)}
    assert got[1].url == rows[0][1] and got[2].url == rows[1][1] and got[3].payload == rows[2][2].encode()


def test_rows_of_one_page_id_have_one_response(spark):
    big = "<p>" + "b" * 3000
    rows = [(5, "u", big)] * 3 + [(4, "u", big), (5, "v", big + "!"), (None, "n", big), (None, "n", big + "?"), (None, None, big + "?"), (6, "s", "short"), (6, "s", "short")]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"_row": F.lit("x"), "payload": F.lit(2)}).repartition(3)
    table = new_path(spark, "p")
    pages.write.parquet(table)
    folder = new_path(spark, "w")
    warc.write(spark.read.parquet(table), folder)
    got = warc.read(spark, folder).collect()
    sha = hashlib.sha1(big.encode()).hexdigest()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_digest == sha) == {(5, "response", None): 1, (5, "revisit", 5): 2, (4, "revisit", 5): 1, (None, "response", None): 1}
    assert Counter((r.page_id, r.record_type) for r in got if r.payload_bytes == 5) == {(6, "response"): 2}
    assert len(got) == len(rows)
    none = new_path(spark, "w")
    assert warc.write(spark.createDataFrame([], PAGES), none).count() == 0


def test_reader_is_linear_and_logs_many_gaps():
    def archive(n):
        out = []
        for i in range(n):
            r = bytearray(warc.record(i, "u", (b"page %d " % i) * 100))
            if i % 3 == 1:
                r[len(r) // 2] ^= 0xFF
            out.append(bytes(r))
        return out

    seconds = []
    for n in (2000, 8000):
        parts = archive(n)
        data, t = b"".join(parts), time.process_time()
        found = warc.salvage(data)
        seconds.append(time.process_time() - t)
        starts = np.cumsum([0, *map(len, parts)])
        assert [o for o, _, _ in found.records] == [starts[i] for i in range(n) if i % 3 != 1]
        assert [(a, b) for a, b, _ in found.gaps] == [(starts[i], starts[i + 1]) for i in range(n) if i % 3 == 1]
    assert seconds[1] < 12 * max(seconds[0], 0.05)


def test_rows_of_one_doc_id_keep_their_order(spark):
    rows = [(7, f"text {i % 50} of seven") for i in range(100)] + [(None, "b"), (None, "a c"), (1, "x " * 50_000), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("s"), "file": F.lit(1)})
    seen = []
    for parts in (1, 5):
        folder = new_path(spark, "t")
        manifest = token_files.write_files(docs.repartition(parts, F.rand(parts)), folder, file_tokens=60)
        got = token_files.read_files(spark, folder, manifest).collect()
        seen.append(sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got))
    assert seen[0] == seen[1]
    ids = [x + [2] for x in whole([t for _, t in rows])]
    assert Counter((d, n, c) for _, d, n, c in seen[0]) == Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x in zip(rows, ids))
    starts = [s for s, *_ in seen[0]]
    assert starts == np.cumsum([0, *(n for _, _, n, _ in seen[0])])[:-1].tolist()


def test_a_file_is_put_again(tmp_path):
    token_files.put(str(tmp_path), "a", b"one")
    token_files.put(str(tmp_path), "a", b"two")
    assert token_files.got(str(tmp_path), "a") == b"two" and [p.name for p in tmp_path.iterdir()] == ["a"]


def test_empty_table(spark):
    folder = new_path(spark, "t")
    manifest = token_files.write_files(empty(spark), folder)
    assert token_files.read_files(spark, folder, manifest).count() == 0


def test_a_damaged_record_is_not_passed_over(spark, tmp_path):
    """Reading whole archives fails, with the gap, where a record is damaged or an archive is gone."""
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 50) for i in range(6)], "page_id long, url string, html string").coalesce(2)
    manifest = warc.write(pages, f"file://{tmp_path}/w", compress=False)
    assert warc.whole(spark, f"file://{tmp_path}/w", manifest).count() == 6
    files = sorted((tmp_path / "w").glob("*.warc"))
    body = files[0].read_bytes()
    at = body.index(b"WARC/1", 20)
    files[0].write_bytes(body[:at] + b"XXXX/1" + body[at + 6 :])
    with pytest.raises(ValueError, match=f"5 of 6 records.*{files[0].name}, {at} to"):
        warc.whole(spark, f"file://{tmp_path}/w", manifest)
    files[0].unlink()
    with pytest.raises(ValueError, match="of 6 records"):
        warc.whole(spark, f"file://{tmp_path}/w", manifest)
