"""Homomorphic multiset hashes of documents, in DataFrame operations only.

A paragraph (line) hashes to a wide vector: 64 lanes that sum, over the three-word
shingles that start at its words, the bits of a 64-bit hash, and 8 lanes of 32 bits of
hashes of the whole paragraph. A document's fingerprint is the sum of its paragraphs'
vectors modulo 2^32 in each lane, with their count of shingles. So it does not depend on
the order of paragraphs, and inserting or deleting one adds or subtracts its vector.
Read as signs, the 64 lanes are a random projection of the multiset of shingles: the
inner product of two fingerprints estimates that of the multisets (Alon, Matias and
Szegedy 1996), which gives a likeness from the fingerprints alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.shared import written

SIGNS, WIDE = 64, 8  # sign lanes, lanes of whole paragraphs
LINES, RUN = 128, 255  # a part of a document: their product is below 2^15, so a long holds counts of four lanes
MOD = 1 << 32


def vectors(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and the array of lane sums, count of shingles first, of each text; texts without a word are absent."""
    paragraph = texts.select(*keys, F.posexplode(F.split(text, "\n")).alias("_line", "_p")).where("_p <> ''")
    hashes = [f"_k{k}" for k in range(WIDE // 2)]
    wide = [F.xxhash64("_p", F.lit(k)).alias(x) for k, x in enumerate(hashes)]
    paragraph = paragraph.select(*keys, F.floor(F.col("_line") / LINES).alias("_lines"), F.split("_p", " ").alias("_w"), *wide)
    at = F.posexplode(F.arrays_zip("_w", F.slice("_w", 2, F.size("_w")), F.slice("_w", 3, F.size("_w"))))
    shingle = paragraph.select(*keys, "_lines", *hashes, at.alias("_at", "_s"))
    shingle = shingle.select(*keys, "_lines", F.floor(F.col("_at") / RUN).alias("_run"), "_at", *hashes, F.xxhash64("_s.*").alias("_h"))
    four, low, step = F.lit(0x0001_0001_0001_0001), F.lit(MOD - 1).cast("long"), SIGNS // 4
    sums = [F.count(F.lit(1)).alias("_n")]
    sums += [F.sum(F.shiftright("_h", i).bitwiseAND(four)).alias(f"_s{i}") for i in range(step)]
    for k, x in enumerate(hashes):
        for i, part in enumerate((F.col(x).bitwiseAND(low), F.shiftrightunsigned(x, 32))):
            sums.append(F.sum(F.when(F.col("_at") == 0, part).otherwise(0)).alias(f"_w{2 * k + i}"))
    made = shingle.groupBy(*keys, "_lines", "_run").agg(*sums)
    lanes = [F.col("_n")]
    lanes += [F.shiftrightunsigned(f"_s{i}", 16 * j).bitwiseAND(F.lit(0xFFFF).cast("long")) for j in range(4) for i in range(step)]
    lanes += [F.col(f"_w{i}") % MOD for i in range(WIDE)]
    parts = made.select(*keys, F.array(*lanes).alias("_lanes")).groupBy(*keys).agg(F.collect_list("_lanes").alias("_parts"))
    rest = F.slice("_parts", 2, F.size("_parts"))
    return parts.select(*keys, F.aggregate(rest, F.element_at("_parts", 1), added).alias("lanes"))


def none() -> Column:
    """The lanes of a text without words."""
    return F.array(*[F.lit(0).cast("long")] * (1 + SIGNS + WIDE))


def shown(lanes: Column) -> Column:
    """A fingerprint as text: each lane's eight hexadecimal digits."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x % MOD), 8, "0")), ""))


def added(a: Column, b: Column) -> Column:
    """The lanes of two parts' union."""
    return F.zip_with(a, b, lambda x, y: (x + y) % MOD)


def removed(a: Column, b: Column) -> Column:
    """The lanes of a without its part b."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(MOD)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints' lanes: the estimated inner product over the larger square norm; 1 if equal."""

    def signs(x: Column) -> Column:
        n = F.element_at(x, 1)
        return F.transform(F.slice(x, 2, SIGNS), lambda v: (2 * v - n).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.greatest(dot(signs(a), signs(a)), dot(signs(b), signs(b)))
    return F.when(a == b, 1.0).when(norm <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(signs(a), signs(b)) / norm)))


def slot(key: str, bounds: list[int]) -> Column:
    """How many sorted bounds are at most the key, by a search in two steps; a null key: 0."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    whole, coarse = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, bounds[::step]))
    lower = F.greatest(F.size(F.filter(coarse, lambda x: x <= F.col(key))) - 1, F.lit(0)) * step
    return (lower + F.size(F.filter(F.slice(whole, lower + 1, step), lambda x: x <= F.col(key)))).cast("int")


def neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text (null: empty), next_text (of the next document; of the first after the last), _part and _row.

    Documents are dealt by ranges of doc_id, whose bounds are quantiles; only the first
    document of each range is handed over to the range before it.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, cuts)), max(10_000, 10 * parts))).first()[0] if cuts else None
    dealt = docs.withColumn("_part", slot("doc_id", sorted(set(found or []))))
    order = Window.partitionBy("_part").orderBy("doc_id", "text")
    firsts = dealt.groupBy("_part").agg(F.min("doc_id").alias("_first"))
    ring = Window.orderBy("_part")  # a row per range
    after = F.coalesce(F.lead("_first").over(ring), F.first("_first").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    after = firsts.select("_part", after.alias("_after"))
    heads = docs.join(F.broadcast(after.select(F.col("_after").alias("_id")).distinct()), F.col("doc_id").eqNullSafe(F.col("_id")))
    heads = heads.groupBy("_id").agg(F.min("text").alias("_head"))
    after = after.join(heads, F.col("_after").eqNullSafe(F.col("_id"))).select("_part", "_head")
    rows = dealt.withColumns({"_row": F.row_number().over(order), "_next": F.lead("text").over(order)})
    return rows.join(after, "_part").select("doc_id", "text", F.coalesce("_next", "_head").alias("next_text"), "_part", "_row")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of all documents (doc_id, text) and of their edited texts.

    The edited text ends in the first floor(n_chars / 4) code points of the next document
    (ascending doc_id, after the last the first) instead of its own last ones. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts are empty ones; texts without a word have the zero fingerprint, like each
    other and nothing else. Rows of equal doc_id stand in order of their text. Other
    columns are ignored; an empty table gives no row.
    """
    base = neighbours(docs, parts)
    n, cut = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", 1, n - cut), F.substring("next_text", 1, cut))
    base = base.select("doc_id", "_part", "_row", "text", edited.alias("edited"), n.cast("long").alias("n_chars"))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("edited").alias("t"))))
    texts = base.select("_part", "_row", kinds.alias("_x")).select("_part", "_row", F.col("_x.k").alias("_kind"), F.col("_x.t").alias("text"))
    made = vectors(texts, ["_part", "_row", "_kind"]).groupBy("_part", "_row").agg(
        F.max(F.when(F.col("_kind") == 0, F.col("lanes"))).alias("_own"), F.max(F.when(F.col("_kind") == 1, F.col("lanes"))).alias("_edited")
    )
    facts = base.select("doc_id", "_part", "_row", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    made = facts.join(made, ["_part", "_row"], "left").withColumns({"_own": F.coalesce("_own", none()), "_edited": F.coalesce("_edited", none())})
    made = written(made, "fingerprints")
    ring = Window.orderBy("_part")  # a row per range
    firsts = made.where("_row = 1").select("_part", F.col("_own").alias("_first"))
    last = F.first("_first").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.select("_part", F.coalesce(F.lead("_first").over(ring), last).alias("_after"))
    made = made.withColumn("_next", F.lead("_own").over(Window.partitionBy("_part").orderBy("_row"))).join(after, "_part")
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("_own")).alias("fingerprint"),
        shown(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_own"), F.coalesce("_next", "_after")).alias("near_next"),
    )
