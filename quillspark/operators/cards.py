"""Vocabulary cards and terms: how a word is shown, what needs review, which sentence bears it out, what joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.ordering import numbered
from quillspark.operators.store import plain

# Surfaces of acronyms, lines that are no sentence, sizes of a card's texts.
ACRONYM_SURFACE = r"^[A-Z][A-Z0-9-]{1,11}s?$"
KEYWORD_LINE = r"^(?i)(index terms|keywords|key words|abstract)\b"
SENTENCE_WORDS, GLOSS_LENGTH, EXAMPLE_LENGTH = 6, 140, 240


def card_id(lemma: Column, part_of_speech: Column) -> Column:
    pos = F.coalesce(F.nullif(plain(part_of_speech), F.lit("")), F.lit("unknown"))
    return F.concat(F.lit("word:"), plain(lemma), F.lit(":"), pos)


def source_url(direct: Column, doi: Column, arxiv: Column, work: Column) -> Column:
    """The first there is of a direct URL and those of a DOI, an arXiv id and a work id."""
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(t(doi), r"^(?i)https?://(?:dx\.)?doi\.org/", "")
    return (
        F.when(t(direct).rlike("^https?://"), t(direct))
        .when(bare != "", F.concat(F.lit("https://doi.org/"), bare))
        .when(t(arxiv) != "", F.concat(F.lit("https://arxiv.org/abs/"), t(arxiv)))
        .when(t(work).startswith("OpenAlex:"), F.concat(F.lit("https://openalex.org/"), F.regexp_replace(t(work), "^OpenAlex:", "")))
        .when(t(work).rlike(r"^W\d+$"), F.concat(F.lit("https://openalex.org/"), t(work)))
        .otherwise("")
    )


def is_acronym(forms: Column) -> Column:
    """Whether a word's surface forms (form, count) are capitals twice or more and in half of its occurrences."""
    total = lambda keep: F.aggregate(F.filter(forms, keep), F.lit(0).cast("long"), lambda s, f: s + f["count"])
    upper = total(lambda f: (f["count"] > 0) & f["form"].rlike(ACRONYM_SURFACE))
    seen = total(lambda f: f["count"] > 0)
    return (upper >= 2) & (upper * 2 >= seen)


def display_form(lemma: Column, forms: Column, expanded: Column) -> Column:
    """How a word is shown: the most frequent acronym form of its lemma, if its forms or expansions make it one; a plural's without its s."""
    own = F.filter(forms, lambda f: (f["count"] > 0) & f["form"].rlike(ACRONYM_SURFACE))
    exact = F.filter(own, lambda f: F.lower(f["form"]) == plain(lemma))
    plural = F.filter(own, lambda f: f["form"].endswith("s") & (F.lower(F.regexp_replace(f["form"], "s$", "")) == plain(lemma)))
    pick = lambda a, cut: F.array_max(F.transform(a, lambda f: F.struct(f["count"].alias("n"), cut(f["form"]).alias("form"))))["form"]
    best = F.coalesce(pick(exact, lambda x: x), F.when(F.size(exact) == 0, pick(plural, lambda x: F.regexp_replace(x, "s$", ""))))
    return F.when(is_acronym(forms) | expanded, F.coalesce(best, plain(lemma))).otherwise(plain(lemma))


def expansions(pairs: DataFrame) -> DataFrame:
    """Sorted expansions of each acronym from pairs (acronym, expansion): one whose singular stands too goes."""
    own = pairs.select(plain("acronym").alias("acronym"), plain("expansion").alias("expansion")).where("acronym <> '' and expansion <> ''").distinct()
    last = F.regexp_extract("expansion", r"([^ ]+)$", 1)
    head = F.regexp_replace("expansion", r"[^ ]+$", "")
    stems = F.array_compact(F.array(
        F.when(last.endswith("ies") & (F.length(last) > 3), F.concat(F.regexp_replace(last, "ies$", ""), F.lit("y"))),
        F.when(last.endswith("es") & (F.length(last) > 2), F.regexp_replace(last, "es$", "")),
        F.when(last.endswith("s") & (F.length(last) > 1), F.regexp_replace(last, "s$", "")),
    ))
    singular = own.withColumn("_stem", F.explode(stems)).select("acronym", "expansion", F.concat(head, "_stem").alias("_s"))
    plural = singular.join(own.select(F.col("acronym").alias("_a"), F.col("expansion").alias("_e")), (F.col("acronym") == F.col("_a")) & (F.col("_s") == F.col("_e"))).select("acronym", "expansion").distinct()
    return own.join(plural, ["acronym", "expansion"], "left_anti").groupBy("acronym").agg(F.array_sort(F.collect_set("expansion")).alias("expansions"))


def suggested_sense(expanded: Column) -> Column:
    """A key of the one expansion there is, else nothing."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.try_element_at(expanded, F.lit(1))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(F.size(expanded) == 1, slug).otherwise("")


def semantic_phrase(value: Column) -> Column:
    """The words of a phrase, lower case, the last without its s."""
    found = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), " ")
    return F.regexp_replace(found, r"(?<=[a-z0-9])s$", "")


def means(gloss: Column, expansion: Column) -> Column:
    """Whether a gloss has all words of an expansion."""
    wanted = F.filter(F.split(semantic_phrase(expansion), " "), lambda w: w != "")
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, F.split(semantic_phrase(gloss), " "))) == 0)


def review_reasons(words: DataFrame, dictionary: DataFrame, acronyms: DataFrame) -> DataFrame:
    """words (lemma, part_of_speech, surface_forms) with what speaks for a review (reasons) and their expansions.

    dictionary: lemma, part_of_speech, meaning_en, meaning_zh; acronyms: acronym, expansions.
    """
    entry = dictionary.select(plain("lemma").alias("_l"), F.col("part_of_speech").alias("_p"), "meaning_en", "meaning_zh")
    own = words.withColumn("_lemma", plain("lemma")).join(entry, F.col("_lemma") == F.col("_l"), "left")
    fits = F.col("_l").isNotNull() & text.pos_matches(F.col("part_of_speech"), F.col("_p"))
    short = F.concat_ws(" ", "meaning_en", "meaning_zh").rlike(r"(?i)\babbr\.?") | F.contains(F.coalesce("meaning_zh", F.lit("")), F.lit("缩写"))
    by = own.groupBy("lemma", "part_of_speech").agg(F.first("surface_forms").alias("surface_forms"), F.first("_lemma").alias("_lemma"), F.count_if(fits).alias("_fit"), F.count("_l").alias("_entries"), F.max(F.col("_l").isNotNull() & short).alias("_short"))
    by = by.join(acronyms.select(F.col("acronym").alias("_a"), "expansions"), F.col("_lemma") == F.col("_a"), "left")
    expanded = F.coalesce("expansions", F.array().cast("array<string>"))
    reasons = F.array_compact(F.array(
        F.when((F.col("_fit") != 1) & (F.col("_entries") != 1), "no_unambiguous_dictionary_gloss"),
        F.when(F.col("_entries") > 1, "multiple_dictionary_entries"),
        F.when(is_acronym(F.col("surface_forms")), "acronym_surface_form"),
        F.when(F.size(expanded) > 0, "corpus_acronym_expansion"),
        F.when(F.col("_short"), "dictionary_abbreviation"),
    ))
    return by.select("lemma", "part_of_speech", "surface_forms", reasons.alias("reasons"), expanded.alias("expansions"), suggested_sense(expanded).alias("suggested_sense_key"))


def first_sentences(sentences: DataFrame) -> DataFrame:
    """The first two sentences (lemma, no, paper_id, sentence) of each word (_l), of 700 characters. Spark prunes by such a limit before it deals rows out."""
    said = sentences.where("trim(coalesce(sentence, '')) <> ''").select(plain("lemma").alias("_l"), "no", "paper_id", F.substring(F.trim("sentence"), 1, 700).alias("sentence"))
    rank = F.row_number().over(Window.partitionBy("_l").orderBy("no", "paper_id", "sentence"))
    said = said.withColumn("_r", rank).where("_r <= 2")
    return said.groupBy("_l").agg(F.array_sort(F.collect_list(F.struct("no", "paper_id", "sentence"))).alias("sentences"))


def review_batches(reviewed: DataFrame, sentences: DataFrame, size: int = 40) -> DataFrame:
    """What reviewers get: words with reasons, at most four forms, two sentences (lemma, no, paper_id, sentence) of 700 characters, and a batch.

    Words are in their order; a batch has `size` of them. Offsets of ranges of words give
    each its number, so that no task orders all.
    """
    said = first_sentences(sentences)
    own = reviewed.where("size(reasons) > 0").join(said, plain("lemma") == F.col("_l"), "left").drop("_l")
    own = own.withColumns({"surface_forms": F.slice("surface_forms", 1, 4), "sentences": F.coalesce("sentences", F.array().cast("array<struct<no:int,paper_id:string,sentence:string>>"))})
    return numbered(own, ["lemma", "part_of_speech"]).withColumn("batch", F.ceil(F.col("number") / size)).drop("number")


def first_source(examples: DataFrame, papers: DataFrame) -> DataFrame:
    """Of each key's examples (key, no, paper_id, sentence) the first whose paper (paper_id, title, file, url) is there, with its title or file name."""
    own = examples.where("trim(coalesce(sentence, '')) <> ''").join(papers, "paper_id")
    stem = F.regexp_replace(F.regexp_extract(F.coalesce("file", F.lit("")), r"([^/]*)$", 1), r"\.[^.]*$", "")
    title = F.coalesce(F.nullif(F.trim(F.coalesce("title", F.lit(""))), F.lit("")), F.nullif(stem, F.lit("")), F.lit("Local paper"))
    first = own.groupBy("key").agg(F.min_by(F.struct("paper_id", title.alias("source_title"), F.col("url").alias("source_url"), F.trim("sentence").alias("context")), "no").alias("f"))
    return first.select("key", "f.*")


def evidence_id(paper_id: Column, context: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", F.coalesce(paper_id, F.lit("")), F.coalesce(context, F.lit(""))), 256), 1, 24)


def compact(value: Column, most: int) -> Column:
    """One short line, with … if it is cut."""
    line = text.squeezed(F.coalesce(value, F.lit("")))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…")))


def reads_whole(sentence: Column) -> Column:
    """Whether a sentence has six words, starts in a capital or another script, and is no list of keywords."""
    first = F.substring(F.trim(sentence), 1, 1)
    start = ((F.upper(first) == first) & (F.lower(first) != first)) | (F.ascii(first) > 127)
    return (F.size(F.split(F.trim(sentence), r"\s+")) >= SENTENCE_WORDS) & ~F.trim(sentence).rlike(KEYWORD_LINE) & start


def example_sentence(context: Column, surface: Column, lemma: Column, most: int = EXAMPLE_LENGTH) -> Column:
    """The first whole sentence of a context that has a form, else the first that has one, else the context, cut."""
    line = text.squeezed(F.coalesce(context, F.lit("")))
    quoted = lambda c: F.concat(F.lit("(?<![a-z0-9])\\Q"), F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("\\E[a-z]*(?![a-z0-9])"))
    has = lambda s, c: (F.trim(F.coalesce(c, F.lit(""))) != "") & F.regexp(F.lower(s), quoted(c))
    hits = F.filter(F.split(line, r"(?<=[.!?。？！])\s+"), lambda s: has(s, surface) | has(s, lemma))
    whole = F.try_element_at(F.filter(hits, reads_whole), F.lit(1))
    return compact(F.coalesce(whole, F.try_element_at(hits, F.lit(1)), line), most)


def question_detail(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """questions (lemma, part_of_speech) with what their card shows: form, short meanings, an example; null without a card."""
    c = cards.select(F.col("lemma").alias("_l"), F.col("part_of_speech").alias("_p"), "display_form", "meaning_en", "meaning_zh", "context")
    both = questions.join(c, (F.col("lemma") == F.col("_l")) & (F.col("part_of_speech") == F.col("_p")), "left")
    held = F.col("_l").isNotNull()
    out = {"meaning_en": F.when(held, compact(F.col("meaning_en"), GLOSS_LENGTH)), "meaning_zh": F.when(held, compact(F.col("meaning_zh"), GLOSS_LENGTH)), "example": F.when(held, example_sentence(F.col("context"), F.col("display_form"), F.col("lemma")))}
    return both.withColumns(out).drop("_l", "_p", "context")


def carded(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """rows (lemma, part_of_speech, ...) with the card (_card) of both, else of the lemma alone if it has one card; _cards tells how many the lemma has."""
    exact = cards.select(F.struct("*").alias("_exact"), plain("lemma").alias("_l"), plain("part_of_speech").alias("_p"))
    alone = cards.groupBy(plain("lemma").alias("_m")).agg(F.count(F.lit(1)).alias("_cards"), F.first(F.struct(*cards.columns)).alias("_only"))
    out = rows.join(exact, (plain("lemma") == F.col("_l")) & (plain("part_of_speech") == F.col("_p")), "left").join(alone, plain("lemma") == F.col("_m"), "left")
    card = F.coalesce("_exact", F.when(F.col("_cards") == 1, F.col("_only")))
    return out.withColumns({"_card": card, "_cards": F.coalesce("_cards", F.lit(0))}).drop("_exact", "_l", "_p", "_only", "_m")


def canonical_vocabulary(briefs: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Brief items (brief_id, item_id, vocabulary of lemma, part_of_speech, meaning, context) with their cards' meanings and this brief's contexts, and the words that have no card or several."""
    flat = briefs.select("brief_id", "item_id", F.posexplode_outer("vocabulary").alias("no", "w")).select("brief_id", "item_id", "no", F.col("w.lemma").alias("lemma"), F.col("w.part_of_speech").alias("part_of_speech"), F.col("w.context").alias("context"))
    found = carded(flat, cards)
    c = lambda name: F.col(f"_card.{name}").alias(name)
    word = F.struct("no", c("lemma"), c("display_form"), c("part_of_speech"), c("meaning_zh"), c("meaning_en"), c("sense_key"), "context")
    made = F.array_sort(F.collect_list(F.when(F.col("_card").isNotNull(), word)))
    out = found.groupBy("brief_id", "item_id").agg(made.alias("vocabulary")).withColumn("estimated_unfamiliar_words", F.size("vocabulary"))
    bad = found.where("lemma is not null and _card is null")
    return out, bad.select("brief_id", "item_id", "lemma", F.when(F.col("_cards") == 0, "no such card").otherwise("several cards").alias("violation"))


def hydrated(words: DataFrame, glosses: DataFrame) -> DataFrame:
    """Words (paper_id, lemma, meaning_en, meaning_zh) whose empty meaning_en takes the gloss (paper_id, lemma, meaning_en, meaning_zh) of their paper."""
    g = glosses.select(F.col("paper_id").alias("_q"), plain("lemma").alias("_l"), F.col("meaning_en").alias("_en"), F.col("meaning_zh").alias("_zh"))
    both = words.join(g, (F.col("paper_id") == F.col("_q")) & (plain("lemma") == F.col("_l")), "left")
    empty = (F.trim(F.coalesce("meaning_en", F.lit(""))) == "") & F.col("_q").isNotNull()
    both = both.withColumn("_empty", empty)
    return both.withColumns({"meaning_en": F.when(F.col("_empty"), F.col("_en")).otherwise(F.col("meaning_en")), "meaning_zh": F.when(F.col("_empty"), F.col("_zh")).otherwise(F.col("meaning_zh"))}).drop("_q", "_l", "_en", "_zh", "_empty")


def paper_details(papers: DataFrame, vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """Papers (paper_id, ...) with the counts of their words (paper_id, lemma) and of the terms (term, source_papers) that name them."""
    words = vocabulary.groupBy(F.col("paper_id").alias("_p")).agg(F.count(F.lit(1)).alias("estimated_unfamiliar_words"))
    named = terms.select("term", F.explode(F.array_distinct("source_papers")).alias("_q")).groupBy("_q").agg(F.count(F.lit(1)).alias("estimated_terms"))
    out = papers.join(words, F.col("paper_id") == F.col("_p"), "left").join(named, F.col("paper_id") == F.col("_q"), "left").drop("_p", "_q")
    return out.fillna(0, ["estimated_unfamiliar_words", "estimated_terms"])


def exported(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """Export rows with their card's fields, which win over the row's own; without a card the lemma is what is shown."""
    out = carded(rows, cards)
    for name in ("meaning_en", "meaning_zh", "context", "source_title"):
        own = F.col(name) if name in rows.columns else F.lit(None).cast("string")
        out = out.withColumn(name, F.coalesce(F.col(f"_card.{name}"), own))
    shown = F.coalesce(F.nullif(F.trim(F.col("_card.display_form")), F.lit("")), F.col("lemma"))
    return out.withColumn("display_form", shown).drop("_card", "_cards")


def catalogue_violations(cards: DataFrame) -> DataFrame:
    """Cards (card_id, lemma, display_form, ...) that a catalogue may not have, and why."""
    required = ("card_id", "sense_key", "lemma", "display_form", "meaning_zh", "context", "source_title")
    blank = F.lit(False)
    for c in required:
        blank = blank | (F.trim(F.coalesce(c, F.lit(""))) == "")
    again = cards.groupBy(F.col("card_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    own = cards.join(again, F.col("card_id").eqNullSafe(F.col("_id")))
    why = F.when(blank, "incomplete").when(F.col("_n") > 1, "repeated id").when(plain("display_form") != plain("lemma"), "shown form of another lemma")
    return own.withColumn("violation", why).where("violation is not null").select("card_id", "lemma", "violation")


def words_with_dimensions(words: DataFrame, levels: DataFrame, tags: DataFrame, frequencies: DataFrame, profile: str = "none") -> DataFrame:
    """Words (lemma, ...) with their level, exam tags of a profile and general frequency (zipf, 0 if unknown)."""
    allowed = {"none": [], "gaokao": ["gk"], "cet4": ["gk", "cet4"], "cet6": ["gk", "cet4", "cet6"]}[profile]  # fixed values
    own = words.withColumn("lemma", F.lower(F.trim("lemma"))).where("lemma <> ''")
    out = own.join(levels.select("lemma", "cefr_level"), "lemma", "left").join(tags.select("lemma", F.col("exam_tags").alias("_t")), "lemma", "left").join(frequencies.select("lemma", F.col("zipf").alias("_z")), "lemma", "left")
    kept = F.filter(F.coalesce("_t", F.array().cast("array<string>")), lambda t: t.isin(allowed) if allowed else F.lit(False))
    return out.withColumns({"exam_tags": kept, "zipf": F.coalesce("_z", F.lit(0.0))}).drop("_t", "_z")
