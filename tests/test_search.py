"""Search against the rule on every name and window, in Latin and Han script, and very long words."""

import random
import re
import unicodedata

from quillspark.operators import lexicon, search


def norm(s):
    return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", s or "").lower()).strip()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def like(field, token):
    if token in field:
        return True
    k = 2 if len(token) >= 8 else 1 if len(token) >= 4 else 0
    if not k:
        return False
    if any(abs(len(w) - len(token)) <= k and edits(w, token) <= k for w in field.split()):
        return True
    if not re.search("[一-鿿]", token):
        return False
    flat = field.replace(" ", "")
    return any(edits(flat[i : i + n], token) <= k for n in range(max(1, len(token) - k), min(len(flat), len(token) + k) + 1) for i in range(len(flat) - n + 1))


def found(items, query):
    q = norm(query)
    out = set()
    for i, fields in items.items():
        fields = [norm(f) for f in fields]
        if not q or any(q in f for f in fields) or all(any(f and like(f, t) for f in fields) for t in q.split(" ")):
            out.add(i)
    return out


def test_search(spark):
    rng = random.Random(11)
    han, latin = "机器学习方法图核网络深度", "abcde"
    word = lambda: "".join(rng.choice(han if rng.random() < 0.5 else latin) for _ in range(rng.randint(1, 12)))
    pure = lambda: "".join(rng.choice(han) for _ in range(rng.randint(2, 12)))
    items = {i: [" ".join(rng.choice((word, pure))() for _ in range(rng.randint(0, 4))) for _ in range(2)] for i in range(60)}
    items |= {60: ["Deep Learning", None], 61: ["ＦＵＬＬ－ｗｉｄｔｈ ①", ""], 62: ["", None], 63: ["机器 学习 方法 研究", "x"]}
    queries = {"", " - ", "deep lerning", "full width 1", "机器学习方法研究", "机器学刁方法研究", "机学习", "learning", "learnings", "deep", "xyz", "方法x研究", "a b"}
    for _ in range(40):
        own = norm(rng.choice([f for fs in items.values() for f in fs if f])).replace(" ", rng.choice((" ", "")))
        at = rng.randrange(max(1, len(own)))
        cut = list(own[at : at + rng.randint(1, 12)])
        for _ in range(rng.randint(0, 2)):
            if cut:
                cut[rng.randrange(len(cut))] = rng.choice(("", "机", "a", "网网"))
        queries.add("".join(cut))
    fields = spark.createDataFrame([(i, f) for i, fs in items.items() for f in fs], "id long, text string")
    got = {}
    for r in search.search(fields, spark.createDataFrame([(q,) for q in queries], "query string")).collect():
        got.setdefault(r.query, set()).add(r.id)
    for q in queries:
        assert got.get(q, set()) == found(items, q), q


def test_library(spark):
    items = spark.createDataFrame([(1, "learning", ["Graph kernel", "x"]), (2, "mastered", ["Graph kernels"]), (3, "learning", ["tree"])], "id long, status string, fields array<string>")
    asked = spark.createDataFrame([("graph kernel",)], "query string")
    assert {r.id for r in search.library(items, asked, "learning").collect()} == {1} and {r.id for r in search.library(items, asked).collect()} == {1, 2}


def test_long_words(spark):
    """Words of thousands of letters meet by pieces; they are not spread out."""
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    lex = spark.createDataFrame([("neural", 5), ("net", 3), (long, 1)], "term string, frequency long")
    lemmas = ["neurla", "x" * 10_000, long[:-1], long[:1500] + "zz" + long[1500:], "q" + long + "qq"]
    got = {(r.lemma[:6], r.term[:6], r.edit_distance) for r in lexicon.spelling_suggestions(spark.createDataFrame([(w,) for w in lemmas], "lemma string"), lex).collect()}
    assert got == {("neurla", "neural", 2), (long[:6], long[:6], 1), (long[:6], long[:6], 2)}
