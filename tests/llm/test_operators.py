"""The operators against brute force, exact round trips and held-out accuracy, on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import fingerprint, langid, mixing, ngram_join, packing, token_files, topk, toxicity, warc
from quillspark.operators.components import connected as components
from quillspark.shared import new_path, shared_dir
from quillspark.llm.tokens import encoder, word_bpe
from tests.llm.data import documents, empty, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return sorted(docs.collect(), key=lambda r: r.doc_id)


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encoder_matches_library_on_odd_texts():
    rng = random.Random(3)
    texts = ["", " ", "it's I'LL don't", "<|endoftext|> a<|startoftext|>b", "éa ́x", "A\tB\r\nC\x0bD\x0cE\x1cF\x85G\xa0H I", "ÀÉß İstanbul ΣΑΣ ﬁ", "1234 x9y 汉字 🙂🙂", "a" * 500, "…—–“q”"]
    alphabet = "aBé'ß1 \n\t.,!<|>́\xa0 x"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    enc = encoder(word_bpe())
    assert [np.frombuffer(enc.encode(x), enc.dtype).tolist() for x in texts] == whole(texts)


def check_packing(got, expected, window=2048):
    """expected: Counter of doc id -> list of ids (a list for each repeated row)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(expected)
    for d, pieces in by_doc.items():
        copies = expected[d]
        assert sum(p.length for p in pieces) == sum(map(len, copies))
        for p in pieces:
            assert p.length > 0
            assert any(p.doc_tokens == len(c) and zlib.crc32(np.array(c[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for c in copies)
        if len(copies) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(1, total)


def test_packing_places_each_id_once(spark, docs, rows):
    ids = [x + [1] for x in whole([r.text for r in rows])]
    expected = defaultdict(list)
    for r, x in zip(rows, ids):
        expected[r.doc_id].append(x)
    got = packing.pack(docs, with_ids=True).collect()
    assert check_packing(got, expected) < 0.03
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    twice = defaultdict(list, {k: v * 2 for k, v in expected.items()})
    check_packing(packing.pack(docs.union(docs), block_tokens=5000).collect(), twice)
    assert packing.pack(empty(spark)).count() == 0


def test_nnls_is_optimal_and_repeats_fit():
    rng = np.random.default_rng(0)
    for _ in range(5):
        a, b = rng.random((30, 12)), rng.random(30)
        x = packing.nnls(a.T @ a, a.T @ b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and abs(slope * x).max() < 1e-6
    h = np.random.default_rng(1).integers(0, 60, 128).astype(float)
    assert (packing.combinations(128)[1] @ packing.repeats(h) <= h).all()


def test_mixing_is_sainte_lague_on_capped_targets(spark, docs, rows):
    got = mixing.mix(docs, shard_words=3000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7), shard_words=3000).collect()))
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    assert {r.doc_id: r.size for r in got} == size
    held = defaultdict(int)
    for r in rows:
        held[r.source] += size[r.doc_id]
    order = sorted((s for s in held if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(held.values()), {}, set(order)
    while free:  # share by weight; fix what is above its cap; share again
        rest = total - sum(target.values())
        unit = rest / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 3 * held[s] + 1e-9}
        if not over:
            target |= {s: unit * weight[s] for s in free}
            break
        target |= {s: 3.0 * held[s] for s in over}
        free -= over
    source = {r.doc_id: r.source for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == held[s] and abs(r.target - target[s]) < 1e-6 * total and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 3 for s in order)
    assert mixing.mix(empty(spark)).count() == 0


def test_apportionment_matches_highest_quotients(spark):
    rng = random.Random(4)
    for seats in (0, 1, 7, 40):
        votes = [(i, float(rng.choice((0, 1, 5, 5, 100, 1000)))) for i in range(9)]
        df = spark.createDataFrame(votes, "p long, v double")
        got = {r.p: r.q for r in mixing.apportioned(df, "v", F.lit(seats), [], [F.col("p")], "q").collect()}
        won = Counter()
        for _ in range(seats):
            won[min((i for i, v in votes), key=lambda i: (-votes[i][1] / (2 * won[i] + 1), i))] += 1
        assert got == {i: won[i] for i, _ in votes}


def test_token_files_round_trip(spark, docs, rows):
    folder = new_path(spark, "t")
    manifest = token_files.write_files(docs, folder, file_tokens=4000)
    got = {r.doc_id: r for r in token_files.read_files(spark, folder, manifest, with_ids=True).collect()}
    start = 0
    for r, ids in zip(rows, whole([r.text for r in rows])):
        ids = ids + [2]
        x = got[r.doc_id]
        assert (x.start, x.n_tokens) == (start, len(ids)) and np.frombuffer(x.ids, "<u4").tolist() == ids
        assert x.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    none = new_path(spark, "t")
    assert token_files.write_files(empty(spark), none).count() == 0


def test_token_file_codec_and_damage():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0, np.int64), rng.integers(0, 70_000, 100_000), rng.zipf(1.3, 5000) % 300):
        body = token_files.encoded([1], [len(ids)], ids)
        assert token_files.decoded(body)[2].tolist() == ids.tolist()
        with pytest.raises(ValueError):
            token_files.decoded(body[:-5] + b"x" + body[-4:])


def test_fingerprints_match_brute_force(spark, docs, rows):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs, parts=4).collect()}
    texts = [r.text or "" for r in rows]
    near = []
    for i, r in enumerate(rows):
        t, after = texts[i], texts[(i + 1) % len(rows)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        x = got[r.doc_id]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        if edited == t:
            assert x.near_edited == 1 and x.fingerprint == x.edited_fingerprint
        if len(t) > 200:
            near.append(x.near_edited - x.near_next)
    assert np.mean(near) > 0.4
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text or ""].add(got[r.doc_id].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({v for s in by_text.values() for v in s}) == len(by_text)
    assert fingerprint.fingerprints(empty(spark)).count() == 0


def test_fingerprint_is_homomorphic(spark):
    t = spark.createDataFrame([(1, "a b c d\ne f g\nh"), (2, "h\na b c d\ne f g"), (3, "a b c d\nh"), (4, "e f g")], "k long, text string")
    v = {r.k: r.lanes for r in fingerprint.vectors(t, ["k"]).collect()}
    assert v[1] == v[2] != v[3]
    both = spark.createDataFrame([(v[3], v[4], v[1])], "a array<long>, b array<long>, c array<long>")
    r = both.select(fingerprint.added(F.col("a"), F.col("b")).alias("p"), fingerprint.removed(F.col("c"), F.col("b")).alias("m")).first()
    assert r.p == v[1] and r.m == v[3]


def test_fingerprint_has_64_sign_and_8_paragraph_lanes(spark):
    rng = random.Random(5)
    texts = ["a", words(rng, 2000), "\n".join(words(rng, rng.randint(1, 4)) for _ in range(400)), "x x " * 300 + "\n\n" + words(rng, 256), "z " * 40_000]
    t = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r.lanes for r in fingerprint.vectors(t, ["k"]).collect()}
    three, whole = [], []
    for k, x in enumerate(texts):
        for p in filter(None, x.split("\n")):
            w = p.split(" ")
            three += [(k, *(w[i : i + 3] + [None] * 2)[:3]) for i in range(len(w))]
            whole.append((k, p))
    want = {k: [0] * 73 for k in range(len(texts))}
    for k, h in spark.createDataFrame(three, "k long, a string, b string, c string").select("k", F.xxhash64("a", "b", "c")).collect():
        want[k][0] += 1
        for i in range(64):
            want[k][1 + i] += h >> i & 1
    for k, *hs in spark.createDataFrame(whole, "k long, p string").select("k", *[F.xxhash64("p", F.lit(i)) for i in range(4)]).collect():
        for i, h in enumerate(hs):
            want[k][65 + 2 * i] += h & 0xFFFFFFFF
            want[k][66 + 2 * i] += h >> 32 & 0xFFFFFFFF
    assert got == {k: [x % 2**32 for x in v] for k, v in want.items()}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    label = {d: d for d, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: find(d) for d, _ in sets}, {d: len(s) for d, s in sets}


def test_ngram_join_matches_brute_force(spark):
    rng = random.Random(8)
    base = [words(rng, n).split() for n in (4, 5, 30, 60, 200, 200)]
    texts = [(1000, None), (1001, ""), (1002, " \t ")]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4, 8))):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append((i, (" \n".join(w) if i % 2 else " ".join(w).upper())))
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"n": F.lit(1), "token": F.lit("x"), "a": F.lit(2)}).repartition(5)
    label, sizes = brute_components(docs.collect())
    for most in (0, 250_000):
        got = ngram_join.join(docs, frequent_most=most).collect()
        assert {r.doc_id: r.component_id for r in got} == label and {r.doc_id: r.n_shingles for r in got} == sizes
    assert len(ngram_join.join(docs.union(docs)).collect()) == 2 * len(texts)
    assert ngram_join.join(empty(spark)).count() == 0


def test_ngram_join_of_hot_lists(spark):
    """A line that many unlike texts share, large groups of exact and near copies, a long text, chains of links."""
    rng = random.Random(21)
    common, base, long = words(rng, 24), words(rng, 60).split(), words(rng, 12_000)
    texts = [(i, f"{common} {words(rng, rng.randint(0, 4))}".strip()) for i in range(120)]  # mostly the common line
    texts += [(1000 + i, " ".join(base)) for i in range(60)]
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append((2000 + i, " ".join(w)))
    texts += [(3000, long), (3001, long + " more"), (3002, long.upper())]
    chain = words(rng, 40).split()
    for i in range(12):  # each links with its neighbours alone
        chain = [*chain[3:], *words(rng, 3).split()]
        texts.append((4000 + i, " ".join(chain)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    label, sizes = brute_components(docs.collect())
    for bucket in (2, 8, 10_000):
        got = ngram_join.join(docs, bucket=bucket).collect()
        assert {r.doc_id: r.component_id for r in got} == label and {r.doc_id: r.n_shingles for r in got} == sizes


def test_ngram_join_of_null_and_repeated_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(None, a), (3, a), (3, b), (7, b), (9, a + " x"), (9, a + " x"), (11, None), (None, None)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == {(None, None): 2, (3, 3): 2, (7, 3): 1, (9, 3): 2, (11, 11): 1}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900 + i) for i in range(1, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 2 or i % 7 == 3
        w = words(rng, rng.randint(5, 80)).split()
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(("zzfoo", "zzbar", "zzbaz")) + rng.choice("abcde"))
        rows.append((i, " ".join(w), 0.5))
        labels.append((i, int(toxic)))
    rows += [(1000, None, 0.1), (1001, "", 0.1), (1002, "!!! 12", 0.1), (1003, "zzfooa " * 30_000, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(500))
    right = [got[i].predicted == (i % 5 == 2 or i % 7 == 3) for i in held]
    assert np.mean(right) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[1003].predicted == 1 and got[1001].score == got[1000].score
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("score is null").count() == 0


def test_langid_held_out_and_marginals(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randint(5, 60), "abcde" if i % 2 else "vwxyz"), "l1" if i % 2 else "l2") for i in range(300)]
    rows += [(400, None, None), (401, "12 !", "l1"), (402, words(rng, 20_000, "abcde"), None), (403, "", "l1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("s"))
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].lang_pred == ("l1" if i % 2 else "l2") for i in held]) > 0.95
    assert got[400].lang_pred == got[401].lang_pred == got[403].lang_pred == "und" and got[402].lang_pred == "l1"
    # code-switched words, and posteriors by enumeration
    said = langid.label(model, "abcde badce cabde wvxyz zyxwv vwxyy")
    assert [x[1] for x in said] == ["l1"] * 3 + ["l2"] * 3
    e = model.emissions(["abc", "xyz", "abx", "yzz"])[0]
    moves, start = np.exp(model.moves), np.exp(model.start)
    exact = np.zeros((4, 2))
    for path in np.ndindex(2, 2, 2, 2):
        p = start[path[0]] * np.prod([e[t, path[t]] for t in range(4)]) * np.prod([moves[path[t], path[t + 1]] for t in range(3)])
        for t in range(4):
            exact[t, path[t]] += p
    exact /= exact.sum(1, keepdims=True)
    for block in (1, 2, 3, 96):
        assert abs(langid.posteriors(model, e, np.array([4]), block) - exact).max() < 1e-9
    assert set(r.lang_pred for r in langid.identify(docs, langid.fit([], [])).collect()) == {"und"}


def page_table(spark):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://a", big), (2, None, big), (9, "http://b\r\nX: y", big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 500), (8, "u", "é" * 500)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "file": F.lit("f")}), rows


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip_and_revisits(spark, compress):
    pages, rows = page_table(spark)
    folder = new_path(spark, "w")
    warc.write(pages.repartition(2), folder, compress=compress, file_bytes=1500)
    got = {r.page_id: r for r in warc.read(spark, folder, with_payload=True).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        body = (html or "").encode()
        r = got[i]
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha1(body).hexdigest()
        first = max(j for j, _, h in rows if (h or "") == (html or "")) if len(body) >= 1000 else i
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert r.payload == (body if first == i else None)


@pytest.mark.parametrize("compress", [True, False])
def test_warc_salvage(compress):
    records = [warc.record(i, "u", b"payload %d " % i * 50, compress=compress) for i in range(6)]
    starts = np.cumsum([0] + list(map(len, records)))
    data = bytearray(b"".join(records))
    data[starts[1] + len(records[1]) // 2] ^= 0xFF
    data[starts[4] : starts[4] + 6] = b"broken"
    data = bytes(data[:-7])
    found = warc.salvage(data)
    assert [o for o, _, _ in found.records] == [starts[0], starts[2], starts[3]]
    assert [(a, b) for a, b, _ in found.gaps] == [(starts[1], starts[2]), (starts[4], len(data))] or [(a, b) for a, b, _ in found.gaps] == [(starts[1], starts[2]), (starts[4], starts[5]), (starts[5], len(data))]
    assert warc.salvage(b"").records == [] and warc.salvage(b"junk").gaps[0][:2] == (0, 4)


def test_shared_dir_is_the_clusters():
    class Named:
        conf = {"spark.checkpoint.dir": "hdfs://shared/"}

    assert shared_dir(Named()) == "hdfs://shared"


def test_null_ids_and_empty_tables_do_not_crash(spark):
    rows = [(None, "a b c d e f", "en", "s", 1), (None, None, None, None, None), (5, "a b c d e f", "fr", None, 1), (5, "a b c d e f", "fr", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(5, 1)], "doc_id long, toxic int")
    assert sum(r.length for r in packing.pack(docs).collect()) == 3 * 7 + 1
    folder = new_path(spark, "t")
    manifest = token_files.write_files(docs, folder)
    assert sorted((r.doc_id is None, r.n_tokens) for r in token_files.read_files(spark, folder, manifest).collect()) == [(False, 7), (False, 7), (True, 1), (True, 7)]
    for made in (mixing.mix(docs), ngram_join.join(docs), fingerprint.fingerprints(docs, parts=2), toxicity.score(docs, toxicity.train(docs, labels)), langid.identify(docs, langid.train(docs))):
        assert made.count() == 4
    found = topk.search(docs, docs.select(F.lit(1).alias("query_id"), "text")).collect()
    assert sorted((r.rank, r.doc_id) for r in found) == [(1, None), (2, 5), (3, 5)]
    none = empty(spark)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == langid.identify(none, langid.train(none)).count() == 0
    pages = spark.createDataFrame([(None, None, "<p>x</p>" * 200), (None, None, None), (3, "u", "<p>x</p>" * 200)], "page_id long, url string, html string")
    folder = new_path(spark, "w")
    warc.write(pages, folder)
    assert sorted((str(r.page_id), r.record_type, r.payload_bytes) for r in warc.read(spark, folder).collect()) == [("3", "response", 1600), ("None", "response", 0), ("None", "response", 1600)]
