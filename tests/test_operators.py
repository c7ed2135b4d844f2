"""Behaviour of operators on literal rows."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.functions import model, text
from quillspark.operators import annotation, calibration, cards, cleaning, discovery, learning, lexicon, merging, scheduling, selection, validation
from quillspark.operators.components import connected
from quillspark.sources import files
from quillspark.sources.recorded import RecordedResponses
from quillspark.streaming import reviews


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def word_rows(spark):
    rows = [(f"word{i}", ("NOUN", "VERB")[i % 2], 20 + i, 2 + i % 10, (2 + i % 10) / 70, 3.5, "B2" if i < 3 else None, ["cet6"] if i < 5 else [], i) for i in range(32)]
    ddl = "lemma string, part_of_speech string, total_count long, document_count long, document_share double, zipf double, cefr_level string, exam_tags array<string>, input_pos long"
    return calibration.enriched(spark.createDataFrame(rows, ddl))


def test_calibration_without_answers(spark):
    words = word_rows(spark)
    none = spark.createDataFrame([], "lemma string, response string")
    rows = calibration.calibrated(words, none, 0.9)
    tiers = {r.importance_tier: r["count"] for r in rows.groupBy("importance_tier").count().collect()}
    assert tiers == {"A": 6, "B": 15, "C": 7, "D": 4}
    assert calibration.next_question(words, none, 0).first().lemma == "word2"
    assert calibration.next_question(words, none, 30).count() == 0


def test_answers_override_and_move_ability(spark):
    words = word_rows(spark)
    known = spark.createDataFrame([(f"word{i}", "known") for i in range(8)] + [("word9", "unsure")], "lemma string, response string")
    m = calibration.moments(calibration.posterior(words, known)).first()
    assert m.theta_mean > 0.5
    assert {r.probability_known for r in calibration.calibrated(words, known).where("lemma < 'word1' or lemma = 'word7'").collect()} == {1.0}


def test_rounding_and_percent(spark):
    assert value(spark, model.half_up(F.lit(2.5))) == 3 and value(spark, model.half_up(F.lit(0.125), 2)) == 0.13
    assert value(spark, model.percent(F.lit(0.0625))) == "6.3%"
    assert value(spark, learning.estimated_minutes(F.lit(10))) == 1


def test_identifiers_and_titles(spark):
    assert value(spark, text.identifier_norm(F.lit(" https://doi.org/10.1/ABCv2"))) == "10.1/abc"
    assert value(spark, text.title_norm(F.lit("A  Preprint: of-X!"))) == "a of x"
    assert value(spark, text.line_key(F.lit("— Page 12 of 300 |"))) == "page # of #"
    assert value(spark, text.dehyphenated(F.lit("infor-\nmation ﬁne"))) == "information fine"
    assert value(spark, text.pos_matches(F.lit("adj"), F.lit("adv"))) is True  # containment, as intended
    assert value(spark, text.compact_gloss(F.lit("[x]\\none;\\n two"))) == "one；two"
    assert value(spark, text.stable_id(F.lit("a"), F.lit(None), length=8)) == __import__("hashlib").sha256(b"a\x1f").hexdigest()[:8]


def test_cleaning(spark):
    lines = ["Running title", "Abstract: starts here", "Figure 1. A caption", "body of text", "Figure 2. A caption", "Acknowledgments", "thanks to all.", "CONCLUSION", "12.5 ± 33.1 (9) 4", "the end", "7. References", "gone"]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    kept = [r.line for r in cleaning.clean(cleaning.lines(df)).orderBy("no").collect()]
    assert kept == ["starts here", "Figure 1. A caption", "body of text", "CONCLUSION", "the end"]


def test_cleaning_of_pages(spark):
    pages = [
        "Journal of Small Things 2021\nA Title\nAuthor One a@b.org\n1\n\nAbstract — We show infor-\nmation.\nFigure 1. The same caption",
        "Journal of Small Things 2022\nMore of  the text.\nFigure 2: The same caption\nPage 2 of 3",
        "Journal of Small Things 2023\nThe end.\n\n\n\nREFERENCES\nJournal of Small Things 2023\n[1] x",
    ]
    df = spark.createDataFrame([(1, "\f".join(pages)), (2, "no abstract\nmail me at x@y.org\ntext"), (3, None)], "doc_id long, text string")
    lines = cleaning.lines(df)
    body = {r.doc_id: r.clean_text for r in cleaning.body(cleaning.clean(lines)).collect()}
    assert body[1] == "We show information.\nFigure 1. The same caption\nMore of the text.\nThe end." and body[2] == "no abstract\ntext"
    told = {r.doc_id: r for r in cleaning.diagnostics(lines).collect()}
    one = told[1]
    assert (one.page_count, one.abstract_heading_found, one.stopped_at_references, one.removed_repeated_margin_lines, one.removed_duplicate_captions) == (3, True, True, 6, 1)
    assert told[3].page_count == 1 and not told[2].abstract_heading_found


def test_abstract_is_looked_for_among_the_lines_that_are_left(spark):
    lines = ["1 2 3 4 5 6 7 8"] * 100 + [f"line {x}" for x in "abcdefghij" * 8] + ["Abstract", "body"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["x y"] * 180 + lines[-2:]))], "doc_id long, text string")
    kept = cleaning.clean(cleaning.lines(df))
    assert [r.line for r in kept.where("doc_id = 1").collect()] == ["body"] and kept.where("doc_id = 2").count() == 182


def test_exact_duplicates_keep_the_longest(spark):
    df = spark.createDataFrame([(1, "t", 500), (2, "t", 800), (3, "", 1), (4, "", 1)], "doc_id long, title_key string, words int")
    got = {r.doc_id: (r.decision, r.duplicate_of) for r in selection.exact_duplicates(df).collect()}
    assert got == {1: ("duplicate", 2), 2: ("include", None), 3: ("include", None), 4: ("include", None)}


def test_dispersion(spark):
    d = lambda counts: value(spark, model.dispersion(F.lit(float(sum(counts))), F.lit(float(sum(c * c for c in counts))), F.lit(len(counts))))
    assert abs(d([2, 2, 2]) - 1) < 1e-9 and abs(d([6, 0, 0])) < 1e-9 and d([3]) == 1.0


def test_acronym_expansions_collapse_plurals(spark):
    counts = spark.createDataFrame([("LLM", "large language model", 3), ("LLM", "large language models", 9)], "acronym string, expansion string, n long")
    assert lexicon.acronym_expansions(counts).first().expansions == "large language model"


def test_foundation_quota_matches_a_loop(spark):
    rng = random.Random(2)
    for limit in (0, 1, 3):
        hits = [(f"q{q}", r, f"i{rng.randrange(12)}", rng.choice(("foundation", "recent"))) for q in range(4) for r in range(6)]
        seen, used, want = set(), 0, set()
        for q, r, i, lane in sorted(hits, key=lambda h: (h[1], h[0])):
            if lane == "foundation" and used >= limit:
                continue
            want.add((q, r))
            if i not in seen:
                seen.add(i)
                used += lane == "foundation"
        df = spark.createDataFrame(hits, "query string, rank int, identity string, lane string")
        assert {(x.query, x.rank) for x in discovery.foundation_quota(df, limit).collect()} == want


def test_merge_groups(spark):
    rows = [(1, "10.1/a", None, None, "T one"), (2, None, "24.1", None, "T one"), (3, "10.1/b", None, None, "T one"), (4, None, "24.1", None, "other"), (5, None, None, None, "OTHER!"), (6, None, None, None, None), (7, None, None, "x", None), (8, None, None, "x", "new")]
    ddl = "order long, doi string, arxiv_id string, semantic_scholar_id string, title string"
    got = {r.order: r.merged_into for r in merging.merge_groups(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 6, 7: 7, 8: 7}
    assert merging.merge_groups(spark.createDataFrame([], ddl)).count() == 0


def test_merge_groups_follow_the_rule_in_order(spark):
    rng = random.Random(11)
    pick = lambda prefix, n, p: f"{prefix}{rng.randrange(n)}" if rng.random() < p else None
    rows = [(i, pick("10.1/", 12, 0.3), pick("24.", 12, 0.3), pick("s", 14, 0.15), pick("title ", 10, 0.8)) for i in range(120)]
    records, known = {}, {}
    for order, doi, arxiv, third, title in rows:
        strong = [known[k] for k in (("d", doi), ("a", arxiv), ("s", third)) if k[1] and k in known]
        into = strong[0] if strong else None
        if into is None and title and ("t", title) in known:
            r = known["t", title]
            if not any(mine and own and mine != own for mine, own in zip((doi, arxiv), records[r])):
                into = r
        into = order if into is None else into
        old = records.get(into, (None, None))
        records[into] = (old[0] or doi, old[1] or arxiv)
        known |= {k: into for k in (("d", doi), ("a", arxiv), ("s", third), ("t", title)) if k[1]}
        rows[order] = (*rows[order][:5], into)
    got = merging.merge_groups(spark.createDataFrame([r[:5] for r in rows], "order long, doi string, arxiv_id string, semantic_scholar_id string, title string"))
    assert {r.order: r.merged_into for r in got.collect()} == {r[0]: r[5] for r in rows}


def test_greedy_exact_duplicates(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(5), [f"k{rng.randrange(25)}" for _ in range(rng.randrange(4))]) for i in range(80)]
    owners, want = {}, {}
    for i, words, keys in sorted(rows, key=lambda r: (-r[1], r[0])):
        own = [owners[k] for k in keys if k in owners]
        want[i] = own[0] if own else None
        owners |= {} if own else dict.fromkeys(keys, i)
    got = merging.greedy_exact(spark.createDataFrame(rows, "doc_id long, words int, ks array<string>"), F.col("ks"))
    assert {r.doc_id: r.duplicate_of for r in got.collect()} == want


def test_review_packets(spark):
    rows = [(1, ["openalex:q1:all"]), (2, ["openalex:q1:all"]), (3, ["arxiv:q2:recent"])]
    packet = lambda rows, target, limit=None: [r.order for r in merging.review_packet(spark.createDataFrame(rows, "order long, buckets array<string>"), target, limit).orderBy("packet_rank").collect()]
    assert packet(rows, 2, 3) == [1, 3, 2] and packet([], 2) == []
    several = [(1, ["a", "b"]), (2, ["b"]), (3, ["c", "a"]), (4, ["c"]), (5, ["a"]), (6, ["b"])]
    assert packet(several, 1) == [1, 3, 5, 2, 4, 6]  # b is covered by 1; then a gives 5, b 2, c 4, b 6
    assert packet(several, 1, 3) == [1, 3, 5]
    with pytest.raises(Exception, match="too small"):
        packet(several, 1, 1)
    assert merging.default_review_limit(70) == 100 and merging.default_review_limit(3) == 13


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_download_prefix_and_due_queue(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "order long, ok boolean")
    assert discovery.admitted(df, 3).count() == 5
    items = spark.createDataFrame([(1, "learning", None, 5), (2, "learning", 9, 4), (3, "mastered", None, 1), (4, "learning", 3, 2)], "item_id long, status string, due long, updated_at long")
    sources = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y"), (4, 1, "c", "z")], "item_id long, added_at long, source_key string, context string")
    assert [(r.item_id, r.context) for r in learning.due_queue(items, sources, F.lit(5)).collect()] == [(4, "z"), (1, "y")]


def test_guarded_merge(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "brief")], "k long, v string, brief string")
    new = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "k long, v string")
    got = {r.k: (r.v, r._changed) for r in learning.merged(old, new, "k", F.col("brief").isNull(), ["v"]).collect()}
    assert got == {1: ("A", True), 2: ("b", False), 3: ("C", True)}


def test_spelling_suggestions(spark):
    words, lex = spark.createDataFrame([("recieve",), ("zzzz",)], "lemma string"), spark.createDataFrame([("receive", 5), ("relieve", 9), ("deceive", 1)], "term string, frequency long")
    assert [(r.term, r.edit_distance) for r in lexicon.spelling_suggestions(words, lex).orderBy("rank").collect()] == [("relieve", 1), ("receive", 2)]


def test_review_scheduler_has_the_published_histories():
    scheduler, card, at, days = scheduling.Scheduler(), scheduling.Card(), datetime(2022, 11, 29, 12, 30), []
    for rating in "good good good good good good again again good good good good good".split():
        card = scheduler.review(card, rating, at)
        days.append((card.due - card.last).days)
        at = card.due
    assert days == [0, 2, 11, 46, 163, 498, 0, 0, 2, 4, 7, 12, 21]
    card, at = scheduling.Card(), datetime(2022, 11, 29, 12, 30)
    for rating, wait in zip("again good good good good good".split(), (0, 0, 1, 3, 8, 21)):
        at += timedelta(days=wait)
        card = scheduler.review(card, rating, at)
    assert abs(card.stability - 53.62691) < 1e-4 and abs(card.difficulty - 6.3574867) < 1e-4


def test_learning_steps():
    scheduler, at = scheduling.Scheduler(), datetime(2024, 1, 1)
    first = {r: scheduler.review(scheduling.Card(), r, at) for r in ("again", "hard", "good")}
    assert {r: (c.state, c.step, (c.due - at).total_seconds() / 60) for r, c in first.items()} == {"again": (1, 0, 1), "hard": (1, 0, 5.5), "good": (1, 1, 10)}
    card = scheduler.review(first["good"], "good", at + timedelta(minutes=10))
    assert card.state == scheduling.REVIEW and card.step is None and (card.due - card.last).days >= 1
    lapsed = scheduler.review(card, "again", card.due)
    assert (lapsed.state, lapsed.step, lapsed.due - lapsed.last) == (scheduling.RELEARNING, 0, timedelta(minutes=10))
    assert (scheduler.review(lapsed, "hard", lapsed.due).due - lapsed.due) == timedelta(minutes=15)


def test_review_stream_continues_cards(spark, tmp_path):
    t = [datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 10), datetime(2024, 1, 4), datetime(2024, 2, 1)]
    rows = [(1, i, "good" if i != 2 else "again", x) for i, x in enumerate(t)] + [(2, 9, "hard", t[0])]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "item_id long, seq long, rating string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "log" / f"part={i}"))
    log = spark.readStream.schema("item_id long, seq long, rating string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "log"))
    got = {r.item_id: r for r in reviews.latest(reviews.drained(reviews.review_states(log), "test-reviews", "update")).collect()}
    scheduler, card = scheduling.Scheduler(), scheduling.Card()
    for _, _, rating, at in rows[:4]:
        card = scheduler.review(card, rating, at)
    assert (got[1].reviews, got[1].lapses, got[1].state) == (4, 1, card.state) and abs(got[1].stability - card.stability) < 1e-9 and got[2].reviews == 1


def test_sources(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("lemma\tpart_of_speech\tmeaning_en\tmeaning_zh\nRun\tv\tgo\t跑\nrun\tn\t\t\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_dictionary(spark, str(tmp_path / "d.tsv")).collect()] == [("run", "v", "go", "跑")]
    (tmp_path / "c.tsv").write_text("headword\tcefr\nA\tB1\na\tA2\nb\tC1\n")
    assert [tuple(r) for r in files.read_levels(spark, str(tmp_path / "c.tsv")).collect()] == [("a", "A2")]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.json").write_text(json.dumps({"query_id": "q", "results": [{"id": "x", "title": "t", "year": 2020}, {"id": "y"}]}))
    spark.dataSource.register(RecordedResponses)
    got = spark.read.format("recorded").option("path", str(tmp_path / "r")).load().orderBy("rank").collect()
    assert [(r.candidate_id, r.year) for r in got] == [("x", 2020), ("y", None)]
    assert files.readable("<nav>x</nav><p>a <b>b</b><br>c</p><script>y</script>") == "a bc"
    files.write_tsv(spark.createDataFrame([(1, ["a"])], "k long, v array<string>"), str(tmp_path / "o"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "o")).first().v.count("a") == 1


def test_decision_violations(spark):
    c = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    d = spark.createDataFrame([(1, "keep"), (2, "keep"), (2, "drop"), (3, "x"), (9, "keep")], "id long, action string")
    assert {r.id: r.violation for r in learning.violations(c, d).collect()} == {2: "several decisions", 3: "no such action", 4: "no decision", 9: "unknown candidate"}


def walked(docs):
    """The reference's walk: doc_id -> duplicate_of of documents (doc_id, title, words, vector)."""
    out, kept = {}, []
    for d in sorted(docs, key=lambda d: (-d[2], d[0])):
        same = [k for k in kept if d[1] and k[1] == d[1]]
        out[d[0]] = same[0][0] if same else None
        kept += [] if same else [d]
    near = []
    for d in kept:
        a = set(d[1].split())
        for k in near:
            b = set(k[1].split())
            cos = sum(x * y for x, y in zip(d[3], k[3])) / (sum(x * x for x in d[3]) * sum(x * x for x in k[3])) ** 0.5
            if a and b and len(a & b) / len(a | b) >= 0.85 and cos >= 0.97:
                out[d[0]] = k[0]
                break
        else:
            near.append(d)
    return out


def test_near_duplicates_are_resolved_against_kept_documents(spark):
    long = [f"w{i}" for i in range(13)]
    # a chain: 1 ~ 2 ~ 3, 1 and 3 differ in two words each; 4 is an exact copy of 2
    chain = [(1, " ".join(long), 90, [1.0, 0.0]), (2, " ".join(long + ["x"]), 80, [1.0, 0.0]), (3, " ".join(long[1:] + ["x", "y"]), 70, [1.0, 0.0]), (4, " ".join(long + ["x"]), 60, [1.0, 0.0]), (5, "", 5, [1.0, 0.0]), (6, "", 5, [1.0, 0.0])]
    rng, more = random.Random(4), []
    for i in range(120):
        title = [w for w in long if rng.random() > 0.05] + rng.sample(["x", "y", "z"], rng.choice((0, 0, 1)))
        more.append((100 + i, " ".join(title), rng.randint(1, 9), [1.0, rng.choice((0.0, 0.1, 0.3, 0.6))]))
    for docs in (chain, more, chain[:1]):
        df = spark.createDataFrame(docs, "doc_id long, title string, words int, vector array<float>")
        got = selection.resolved(df).collect()
        assert {r.doc_id: r.duplicate_of for r in got} == walked(docs)
        assert all((r.decision == "duplicate") == (r.duplicate_of is not None) for r in got)


def test_near_duplicates_resolved_takes_each_document_its_own_vector(spark, tmp_path):
    from quillspark.plans import QUERIES

    title = "one two three four five six seven eight nine ten"
    docs = [(i, f"{title} {w}\n" + "a " * (9 - i), "s", "en") for i, w in ((0, "x"), (1, "y"), (2, "x"), (3, "z"))] + [(57, f"{title}", "s", "en"), (64, f"{title} v", "s", "en")]
    docs = [(k, t.replace(title, title + " eleven twelve thirteen fourteen"), s, g) for k, t, s, g in docs]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [float(i == 57), float(i != 57)]) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.doc_id: r.duplicate_of for r in QUERIES["near_duplicates_resolved"](spark, str(tmp_path)).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 0, 57: None, 64: 0}


def test_decision_violations_takes_all_documents(spark, tmp_path):
    from quillspark.plans import QUERIES

    spark.range(1000).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(1, 1000) if i not in (500, 900)] + [(2000, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.id: r.violation for r in QUERIES["decision_violations"](spark, str(tmp_path)).collect()}
    several = {i: "several decisions" for i in range(11, 1000, 11)}
    assert got == several | {0: "no decision", 500: "no decision", 900: "no decision", 2000: "unknown candidate"}


def test_new_word_candidates_gives_all_words_a_status(spark, tmp_path):
    from quillspark.plans import QUERIES

    # in input order: 3,100 words of 17 letters, all likely known, then 30 of six letters, likely unknown
    letters = "abcdefghijklmnopqrstuvwxyz"
    number = lambda i: letters[i // 676] + letters[i // 26 % 26] + letters[i % 26]
    names = ["a" + number(i) + "q" * 13 for i in range(3100)] + ["zzz" + number(i) for i in range(30)]
    text = " ".join(names)
    spark.createDataFrame([(1, text), (2, text + " " + text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.lemma for r in QUERIES["new_word_candidates"](spark, str(tmp_path)).collect()]
    assert got == [x for i, x in enumerate(names, 1) if i > 3100 and i % 3 == 2]


def test_terms_and_c_values_take_up_to_six_words(spark):
    import math
    from collections import Counter

    rng = random.Random(6)
    phrases = ["alpha beta gamma delta epsilon zeta eta", "beta gamma delta epsilon zeta", "gamma delta epsilon"]
    lines = [" ".join([rng.choice(phrases), rng.choice(("theta", "iota", "kappa")), rng.choice(phrases)]) for _ in range(12)]
    docs = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(4)]
    total, held = Counter(), {}
    for i, text_ in docs:
        for w in map(str.split, text_.split("\n")):
            for t in [" ".join(w[j : j + k]) for k in range(2, 7) for j in range(len(w) - k + 1)]:
                total[t] += 1
                held.setdefault(t, set()).add(i)
    want = {t: n for t, n in total.items() if n >= 2 and len(held[t]) >= 2}
    around = {}
    for t, n in want.items():
        w = t.split()
        for part in [" ".join(w[j : j + k]) for k in range(2, len(w)) for j in range(len(w) - k + 1)]:
            around.setdefault(part, []).append(n)
    terms = lexicon.term_counts(lexicon.ngrams(spark.createDataFrame(docs, "doc_id long, text string")), len(docs))
    got = {r.term: (r.total_count, r.c_value) for r in lexicon.c_values(terms).collect()}
    assert {len(t.split()) for t in got} == {2, 3, 4, 5, 6}
    assert got == {t: (n, round(max(0.0, math.log2(len(t.split())) * (n - (sum(around[t]) / len(around[t]) if t in around else 0.0))), 6)) for t, n in want.items()}


def test_terms_of_annotated_phrases(spark):
    def token(t, pos="NOUN", lemma=None, stop=False):
        return (t, lemma or t.lower(), pos, stop, t.isalpha(), t.isdigit(), not any(c.isalnum() for c in t))

    phrases = {
        "robust analysis": [token("the", "DET", stop=True), token("Robust", "ADJ"), token("analyses", lemma="analysis"), token(",", "PUNCT")],
        "state of art": [token("State"), token("of", "ADP", stop=True), token("art")],
        "well-known Model".lower(): [token("well", "ADJ"), token("-", "PUNCT"), token("known", "ADJ"), token("Model", "PROPN", "modell")],
        None: [token("model")],
    }
    phrases_out = [None, None, None]
    more = [[token("models"), token("run", "VERB")], [token("a", "DET", stop=True)], [token(w) for w in "one two three four five six seven".split()]]
    ddl = f"k int, tokens array<{annotation.TOKEN}>"
    rows = [(i, t) for i, t in enumerate([*phrases.values(), *more])]
    got = {r.k: r.t for r in spark.createDataFrame(rows, ddl).select("k", annotation.canonical_term(F.col("tokens")).alias("t")).collect()}
    assert [got[i] for i in range(len(rows))] == [*phrases, *phrases_out]


def test_gate_refuses_a_batch(spark):
    bad = spark.createDataFrame([("c1", "unknown")], "candidate_id string, violation string")
    validation.gate(bad.limit(0), "selection")
    with pytest.raises(validation.Refused, match="c1"):
        validation.gate(bad, "selection")


def test_display_forms_and_expansions(spark):
    ddl = "lemma string, surface_forms array<struct<form:string,count:bigint>>, expanded boolean"
    rows = [("llm", [("LLMs", 12), ("LLM", 5)], True), ("results", [("RESULTS", 1), ("results", 40)], False), ("gpu", [("GPUs", 4), ("GPUS", 9)], True), ("word", [("word", 3)], True), ("x", [], False)]
    got = {r.lemma: r.d for r in spark.createDataFrame(rows, ddl).select("lemma", cards.display_form(F.col("lemma"), F.col("surface_forms"), F.col("expanded")).alias("d")).collect()}
    assert got == {"llm": "LLM", "results": "results", "gpu": "GPU", "word": "word", "x": "x"}
    pairs = spark.createDataFrame([("LLM", "large language model"), ("LLM", "Large language models"), ("CA", "case studies"), ("CA", "case study"), ("CB", "boxes")], "acronym string, expansion string")
    assert {r.acronym: r.expansions for r in cards.expansions(pairs).collect()} == {"llm": ["large language model"], "ca": ["case study"], "cb": ["boxes"]}
    assert value(spark, cards.means(F.lit("a big language model"), F.lit("Language models"))) is True and value(spark, cards.suggested_sense(F.array(F.lit("Large Language-Model")))) == "large-language-model"


def test_json_tags_and_lanes(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "a": 1,\n "b": "x"\n}')
    assert files.read_json(spark, str(tmp_path / "one.json"), "a int, b string").first().b == "x"
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int", strict=True).collect()) == [1, 2]
    (tmp_path / "t.tsv").write_text("headword\ttags\nRun\tgk x\nrun\tcet4 gk\nb\tzz\n")
    assert [(r.lemma, r.exam_tags) for r in files.read_exam_tags(spark, str(tmp_path / "t.tsv")).collect()] == [("run", ["cet4", "gk"])]
    files.write_jsonl(spark.createDataFrame([(2, 1)], "b int, a int"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("*.json")).strip() == '{"a":1,"b":2}'
    one, two = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(2, "y")], "id int, more string")
    assert [(r.id, r.more, r.lane) for r in files.lanes(one, two).orderBy("lane").collect()] == [(1, None, 0), (2, "y", 1)]
    pdf = spark.createDataFrame([(bytearray(b"%PDF-1.7"),), (bytearray(b"<html>"),)], "c binary")
    assert [r.ok for r in pdf.select(files.is_pdf(F.col("c")).alias("ok")).collect()] == [True, False]


def test_signs_are_normalised_before_lines_are_judged(spark):
    body = ["Abstract: of it", "Conﬁdence Intervals", "plain text line.", "ﬁgure 1. same", "more text.", "ﬁgure 2. same", "tail­end", "Acknowl­edgments", "thanks.", "Results", "last.", "References", "gone"]
    for end in ("\n", "\r\n", "\r"):
        docs = spark.createDataFrame([(1, end.join(body))], "doc_id long, text string")
        got = [r.line for r in cleaning.clean(cleaning.lines(docs)).orderBy("no").collect()]
        assert got == ["of it", "Confidence Intervals", "plain text line.", "figure 1. same", "more text.", "tailend", "Results", "last."]


def test_readable_page():
    page = "<p>One <b>two</b></p><nav>no<p>no</nav></footer>three<li>four<script>if (a < b) no</script> &amp; five<form><form>no</form>no</form>six<h2> </h2>"
    assert files.readable(page) == "One two\n\nthree\n\nfour & five six".replace(" six", "six") and files.readable(None) == files.readable("<svg>x") == ""
