"""Decontamination, vector codes and periodic runs against brute force, on the registered queries' tables and on awkward ones."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quillspark.llm import decontaminate, periodic_runs, vector_codes
from quillspark.llm.queries import queries, table
from tests.llm.data import documents, empty, words
from tests.test_queries import DATA

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- periodic runs


def runs(x, least=6, times=4):
    """Every maximal run by trying all periods."""
    found = {}
    for p in range(1, len(x) // times + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = j + 1 if j == i else j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def runs_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None:
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None
    milli = 1000 * top[1] // top[2] if top else None
    return doc_id, len(found), *(top or (None,) * 3), milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def of_runs(docs):
    return rows_of(periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(docs))))


def test_periodic_runs_query(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text").collect()
    got = rows_of(queries()["op13_periodic_runs"](spark, DATA))
    assert got == sorted((runs_row(*r) for r in docs), key=repr)
    assert any(r[1] for r in got)


def test_periodic_runs_awkward(spark):
    docs = documents(spark, n=120)
    extra = [
        (1, "a " * 5), (1, "a " * 6), (2, "a b " * 3), (3, "a b " * 4 + "a"), (4, "x\x0b\x0cx\tx\rx\nx x"), (5, "é\xa0b " * 8), (None, "a a a a a a a"),
        (6, " ".join("a" * 6 + "b" * 6 + "ab" * 5 + "aab" * 5)), (7, " ".join("abcabcabcabcab" * 9)), (8, "a " * 3000), (9, "\x1c" * 8), (9, " \n "), (10, ""), (None, None),
    ]
    docs = docs.select("doc_id", "text", "start", "n").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    assert of_runs(docs) == sorted((runs_row(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert of_runs(empty(spark)) == []


@pytest.mark.parametrize("least,times", [(6, 4), (3, 3), (9, 5)])
def test_run_search(least, times):
    rng = random.Random(least)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 6)):
            k, size = rng.choice((1, 2, 3, 5)), rng.choice((0, 1, 5, 6, 7, 20, 60, 150))
            d = [rng.randrange(k) for _ in range(size)]
            if size and rng.random() < 0.6:
                a = rng.randrange(size)
                p = rng.randint(1, max(1, (size - a) // rng.randint(3, 9)))
                d = d[:a] + [d[a + (i - a) % p] for i in range(a, size)]
            docs.append(d)
        n = np.array([len(d) for d in docs])
        begin = np.cumsum(n + 1) - (n + 1)
        x = np.full(n.sum() + len(docs), -1)
        for b, d in zip(begin, docs, strict=True):
            x[b : b + len(d)] = d
        x[begin + n] = 100 + np.arange(len(docs))
        want = [(s + b, s + b + m, p) for b, d in zip(begin.tolist(), docs, strict=True) for s, m, p in runs(d, least, times)]
        assert sorted(map(tuple, periodic_runs.runs_of(x, begin, begin + n, least, times).tolist())) == sorted(want)


def test_z_function():
    rng = random.Random(0)
    for _ in range(200):
        x = [rng.randrange(2) for _ in range(rng.randrange(30))]
        want = [0] + [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(1, len(x))]
        assert periodic_runs.z_function(x) == want[: len(x)]


def test_one_text_of_many_words(spark):
    """n log n work: a text of one word has as many repetitions as it has periods and places."""
    docs = spark.createDataFrame([(1, "w " * 60_000), (2, "a b c " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(docs).collect()}
    assert got == {1: [(0, 60_000, 1)], 2: [(0, 60_000, 3)]}


# ---- decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def leak_rows(docs, items, window=10):
    index = {}
    for item, text in items:
        w = WORDS.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            index.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = WORDS.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in index}:
            for i in range(len(w) - n + 1):
                if (own := index.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        found = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(found)), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_query(spark):
    docs, items = (table(spark, DATA, t).select(k, "text").collect() for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = rows_of(queries()["op11_decontamination"](spark, DATA))
    assert got == leak_rows(docs, items) and any(r[5] for r in got)


@pytest.mark.parametrize("shard", [25, 200, 400_000])
def test_decontamination_awkward(spark, shard):
    rng = random.Random(3)
    texts = [words(rng, n, "ab") for n in (0, 3, 9, 10, 11, 40, 300, 300)]
    texts += ["A-b é_É 9" * 7, None, "", "...", texts[5].upper() + " x " + texts[6], texts[4] + "'" + texts[4], texts[6], "É é"]
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, i) for i, t in enumerate(texts)], "doc_id long, text string, items int").repartition(3)
    items = [(1, texts[5]), (1, texts[4]), (2, texts[5]), (10, "a"), (None, texts[3]), (3, None), (4, ""), (5, "!"), (6, texts[6][:200]), (7, "é"), (8, "b a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for some, left in ((bench, items), (bench.where("item_id <> 10 and item_id < 8"), [x for x in items if x[0] in (1, 2, 3, 4, 5, 6, 7)]), (bench.where("false"), [])):
        got = rows_of(decontaminate.digests(decontaminate.contamination(docs, some, shard=shard)))
        assert got == leak_rows([(r.doc_id, r.text) for r in docs.collect()], left)
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def test_text_without_spans(spark):
    docs = spark.createDataFrame([(1, "One, two; THREE four five. Six"), (2, "four four"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("x", "two three"), ("y", "three FOUR")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, window=2, with_text=True).collect()}
    assert got[1].clean_text == "One,  five. Six" and [tuple(s) for s in got[1].spans] == [(1, 3)] and got[1]["items"] == ["x", "y"]
    assert got[2].clean_text == "four four" and got[3].clean_text is None and got[3].n_words == 0


def test_suffixes_and_ranks():
    rng = random.Random(5)
    for _ in range(150):
        x = np.array([rng.randrange(rng.choice((1, 2, 9))) for _ in range(rng.randrange(60))] + [9])
        order = decontaminate.suffix_order(x)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        tree, c, at = decontaminate.Wavelet(x), rng.randrange(10), rng.randrange(len(x) + 1)
        assert tree.rank(np.array([c]), np.array([at])) == (x[:at] == c).sum()
        index = decontaminate.FMIndex(x)
        assert index.located(np.arange(len(x))).tolist() == order.tolist()


# ---- vector codes


def code_rows(vectors, entries=256, rounds=4):
    fine = [(i, v, lab) for i, v, lab in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in fine), default=0) // 4)
    ints = np.array([[math.floor(x * 1024) for x in v] + [0] * (4 * width - len(v)) for _, v, _ in fine], dtype=np.int64).reshape(len(fine), 4, width)
    order = sorted(range(len(fine)), key=lambda i: (fine[i][0] is None, fine[i][0] or 0, ints[i].reshape(-1).tolist()))
    books = ints[order[:entries]].transpose(1, 0, 2).copy()

    def assigned():
        d = ((ints[:, :, None, :] - books[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        own, _ = assigned()
        for k in range(4):
            for a in np.unique(own[:, k]):
                some = ints[own[:, k] == a, k]
                books[k, a] = some.sum(0) // len(some)
    own, d = assigned()
    whole, label = sha(",".join(map(str, books.reshape(-1).tolist()))), {}
    for (_, _, lab), e in zip(fine, d.sum(1).tolist(), strict=True):
        label[lab] = label.get(lab, 0) + e
    return sorted(((i, bytes(c.tolist()).hex(), int(e), label[lab], whole) for (i, _, lab), c, e in zip(fine, own, d.sum(1).tolist(), strict=True)), key=repr)


def test_vector_codes_query(spark):
    vectors = table(spark, DATA, "embeddings").select("vec_id", "embedding", "label").collect()
    assert rows_of(queries()["op12_vector_codes"](spark, DATA)) == code_rows(vectors)


@pytest.mark.parametrize("entries,block,spread", [(256, 16384, 1), (7, 50, 1), (3, 7, 0.004), (1, 20, 1), (16, 30, 3e4)])
def test_vector_codes_awkward(spark, entries, block, spread):
    rng = random.Random(entries)
    rows = [(rng.choice((None, i, i // 2)), [rng.gauss(0, spread) for _ in range(12)], rng.choice((None, 1, 2))) for i in range(260)]
    rows += [(900, None, 1), (901, [1.0, None, 2.0], 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] + [0.0] * 11, None), (904, [0.5], 3), (905, [], 3)]
    rows += [(950 + i, rows[0][1], 1) for i in range(40)]  # copies
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    codes, books = vector_codes.coded(vectors, entries=entries, block=block)
    got = vector_codes.with_label_errors(codes, broadcast_rows=1).select("vec_id", "code", "error", "label_error")
    want = code_rows(rows, entries)
    assert rows_of(got) == [r[:4] for r in want]
    assert sha(vector_codes.listing(books)) == want[0][4]


def test_vector_codes_empty(spark):
    none = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    codes, books = vector_codes.coded(none)
    assert vector_codes.with_label_errors(codes).count() == 0 and vector_codes.listing(books) == ""
    huge = spark.createDataFrame([(1, [3e38, -3e38, 1.0, 2.0], 2), (2, [0.0] * 4, 2)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.coded(huge)[0].count() == 2  # components are cut off


def test_few_parts_are_popped(spark):
    """Rounds measure again only what the drift has reached, fewer as entries come to rest."""
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(3000, 4)) + 20 * rng.integers(0, 4, (3000, 1))).round(3)
    heaps = vector_codes.Heaps.made(*vector_codes.nearest((v * 1024).astype(np.int64), np.array([[0] * 4, [20480] * 4, [40960] * 4, [61440] * 4])), 4)
    assert heaps.popped(np.full(4, 100.0)) == [] and len(heaps.popped(np.full(4, 1e9))) == 3000
