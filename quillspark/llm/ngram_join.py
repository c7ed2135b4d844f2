"""N-gram Jaccard join of documents by grouped prefixes, to linked components.

Documents become sets of word shingles, as 64-bit hashes, and documents of equal sets one
class. Shingles are ordered globally, those of no great frequency first, by hash, then the
frequent ones by count. Two sets of Jaccard similarity t or more share a shingle of their
prefixes, the first n - ceil(t n) + 1. Classes with identical prefixes and set size are
collapsed into one group, which stands for them in the lists of each prefix shingle.

Members of a group that link with its lead stay with it; the others become groups of
their own. Pairs of groups then come from the lists in rounds. A round deals each list to
buckets of a bounded size, at random, anew for each token, and pairs the groups of a
bucket that lie in different components and pass the size and position filters; their
leads are verified on the texts, and the links merge components. The bound grows from
round to round, so that each list ends as one bucket, with all its pairs; by then a list
of many near copies is nearly all one component, whose inner pairs need no look. Last, the
pairs of groups whose leads did not link and that still lie apart are expanded to their
members, which are verified. No link between components is lost, and a list of many near
copies costs about its length.

Prefixes, bins and texts are wide and stay where they are: classes, groups and pairs are
made of row numbers, and the few rows that they need are told by a sieve before they are
dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import sieve
from quillspark.llm.common import released, rows, small_batches
from quillspark.operators.components import connected
from quillspark.shared import dropped, observed, swept, written

WORD_MULTIPLIER, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = out
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX_A
    x = (x ^ (x >> np.uint64(33))) * MIX_B
    return x ^ (x >> np.uint64(33))


@dataclass
class Shingler:
    """Sorted distinct hashes of a text's word shingles; words are runs without ASCII white space, A-Z lower-cased."""

    size: int = 5

    def __post_init__(self):
        self.known = WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > 150_000:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        with np.errstate(over="ignore"):
            out = np.full(len(words) - size + 1, size, np.uint64)
            for k in range(size):
                out = out * WORD_MULTIPLIER + h[k : len(words) - size + 1 + k]
            return np.unique(mixed(out))


@dataclass(frozen=True)
class Similarity:
    """At least num / den, in whole numbers."""

    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        if min(len(a), len(b)) * self.den < self.num * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)

    def may_link(self, n: Column, pos: Column, m: Column, at: Column) -> Column:
        """Size and position filters for places pos of n and at of m, from 0: the first shared shingle of two sets that
        link leaves room behind it, in both, for all that they must share."""
        sizes = F.least(n, m) * self.den >= F.greatest(n, m) * self.num
        return sizes & self._room(n - pos, n + m) & self._room(m - at, n + m)

    def _room(self, rest: Column, sizes: Column) -> Column:
        return rest * (self.den + self.num) >= sizes * self.num

    def least_shared(self, n: int, m: int) -> int:
        return -(-self.num * (n + m) // (self.den + self.num))


def frequent(docs: DataFrame, shingler: Shingler, most: int, local: int = 3, held: int = 2_500_000) -> np.ndarray:
    """Shingles of many documents by rising count, `most` at most; only the order of shingles depends on it.

    Each task counts its documents' shingles, `held` together, and hands on those it has met `local` times there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = [], 0

        def counted() -> pa.RecordBatch:
            tokens = np.concatenate(sets)
            sets.clear()
            tokens.sort()
            first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
            counts = np.diff(first, append=len(tokens))
            some = counts >= local
            return pa.record_batch([pa.array(tokens[first[some]].view(np.int64)), pa.array(counts[some].astype(np.int64))], names=["token", "n"])

        for (texts,) in rows(batches, "text"):
            for text in texts:
                sets.append(shingler(text))
                size += len(sets[-1])
                if size >= held:
                    yield counted()
                    size = 0
        if sets:
            yield counted()
        shingler.known.clear()
        released()

    found = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = written(found, "counts")
    step = F.floor(F.log2("n") * 8)
    held, least = 0, None
    for r in found.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():  # eight rows for each doubling
        held += r["count"]
        if held > most:
            break
        least = r["s"]
    if least is None:
        dropped(found)
        return np.zeros(0, np.uint64)
    top = found.where(step >= least).toArrow().sort_by([("n", "ascending"), ("token", "ascending")])
    dropped(found)
    return top.column("token").to_numpy().view(np.uint64)


BINS = 512


def binned(tokens: np.ndarray) -> bytes:
    """Counts of a set's hashes over bins; empty where a count does not fit its byte."""
    counts = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS)
    return counts.astype(np.uint8).tobytes() if len(tokens) and counts.max() < 256 else b""


def prefixes(docs: DataFrame, shingler: Shingler, similarity: Similarity, heavy: np.ndarray) -> DataFrame:
    """doc_id, n, the set's two check sums (s, t), its bins, its prefix in the global order, how many there are not frequent, a hash of it (_key), and a number of the row.

    The number holds once the table is written.
    """
    by_value = np.argsort(heavy, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((heavy[by_value], by_value.astype(np.int64)))  # bounded by frequent(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rank = sent.value
        for ids, texts in rows(batches, "doc_id", "text"):
            sizes, sums, bins, prefix, few = [], [], [], [], []
            for text in texts:
                own = shingler(text)
                sizes.append(len(own))
                bins.append(binned(own))
                with np.errstate(over="ignore"):
                    sums.append((int(mixed(own).sum().view(np.int64)), int((mixed(own ^ MIX_A) * (own | np.uint64(1))).sum().view(np.int64))) if len(own) else (0, 0))
                take = similarity.prefix(len(own)) if len(own) else 0
                rare = own[:take]
                if len(tokens) and take:
                    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                    common = tokens[at] == own
                    rare = own[~common][:take]
                    often = own[common][np.argsort(rank[at[common]], kind="stable")][: take - len(rare)]
                    own = np.concatenate([rare, often])
                few.append(len(rare))
                prefix.append(own[:take].view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefix)))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64()), pa.array(bins, pa.binary()), lists, pa.array(few, pa.int64())],
                names=["doc_id", "n", "s", "t", "bins", "prefix", "rare"],
            )
        shingler.known.clear()
        released()

    made = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s long, t long, bins binary, prefix array<long>, rare long")
    return made.withColumns({"_key": F.xxhash64("prefix"), "row": F.monotonically_increasing_id()})


def ends(pairs: DataFrame, name: str) -> DataFrame:
    """The ids that pairs (a, b) name, once each."""
    return pairs.select(F.col("a").alias(name)).union(pairs.select(F.col("b").alias(name))).distinct()


def likely(pairs: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs (a, b) whose bins leave room for a link: sets share at most the sum of the lesser counts of each bin.

    Exact: no pair that links is lost, and most others need no look at their texts.
    """
    own = sieve.maybe(sets.select("rep", "n", "bins"), "rep", ends(pairs, "rep"))
    both = pairs.join(own.toDF("a", "n", "x"), "a").join(own.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for columns in rows(iter([batch]), "n", "m", "x", "y"):
                for n, m, x, y in zip(*columns, strict=True):
                    most = int(np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).sum(dtype=np.int64)) if x and y else min(n, m)
                    keep.append(most >= similarity.least_shared(n, m))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        released()

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, shingler: Shingler, similarity: Similarity, chunk: int = 32) -> DataFrame:
    """Those of the pairs (a, b) of doc ids whose texts link. One text of a travels for up to about `chunk` partners."""
    fan = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / chunk).alias("_parts"))
    dealt = written(pairs.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_parts")).alias("_chunk")), "dealt")
    ids = ends(dealt, "doc_id")
    texts = written(sieve.maybe(docs, "doc_id", ids).join(ids, "doc_id"), "texts")
    heads = dealt.select("a", "_chunk").distinct().join(texts, F.col("a") == F.col("doc_id"))
    heads = heads.select("a", "_chunk", F.lit(None).cast("long").alias("b"), "text")
    partners = dealt.join(texts, F.col("b") == F.col("doc_id")).select("a", "_chunk", "b", "text")
    stream = heads.union(partners).repartition("a", "_chunk").sortWithinPartitions("a", "_chunk", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, before = None, [], False
        for left, right, texts in rows(batches, "a", "b", "text", step=256):
            out = []
            for a, b, text in zip(left, right, texts, strict=True):
                if b is None:  # a head; one id may have several texts
                    now, own = a, [*(own if before and a == now else []), shingler(text)]
                elif a == now:
                    other = shingler(text)
                    if any(similarity.links(x, other) for x in own):
                        out.append((a, b))
                before = b is None
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
        shingler.known.clear()
        released()

    links = written(stream.mapInArrow(run, "a long, b long"), "links")
    dropped(dealt, texts)
    return links


@dataclass
class Labels:
    """Component of each id, as links come in: a table (node, c) of the ids that have one."""

    table: DataFrame | None = None

    def of(self, df: DataFrame, node: str, name: str = "c") -> DataFrame:
        """df with the component of its column `node`."""
        if self.table is None:
            return df.withColumn(name, F.col(node))
        own = self.table.select(F.col("node").alias("_label_of"), F.col("c").alias("_label"))
        return df.join(own, F.col(node) == F.col("_label_of"), "left").withColumn(name, F.coalesce("_label", node)).drop("_label_of", "_label")

    def merge(self, links: DataFrame) -> None:
        """Take in links (a, b): the components that they touch are joined, as far as those go."""
        between = self.of(self.of(links, "a", "_a"), "b", "_b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        found = connected(between)
        moved = found.select(F.col("node").alias("_from"), F.col("component").alias("_to"))
        new = found.select("node", F.col("component").alias("c"))
        if self.table is not None:
            old = self.table.join(moved, F.col("c") == F.col("_from"), "left").select("node", F.coalesce("_to", "c").alias("c"))
            new = old.union(new.join(self.table.select("node"), "node", "left_anti"))
        then = written(new, "labels")
        dropped(found, self.table)
        self.table = then


def lists_of(leads: DataFrame) -> DataFrame:
    """token, g, n, pos and the list's length of all lists of two groups or more, of their leads (g, n, prefix, rare).

    Tokens that may have long lists are the frequent ones. They are counted by partial
    aggregates and joined, so that no list meets in one task; the others' lists are short.
    """
    few = leads.select("g", "n", F.posexplode(F.slice("prefix", F.lit(1), F.col("rare").cast("int"))).alias("pos", "token"))
    few = few.withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("length > 1")
    often = leads.where(F.size("prefix") > F.col("rare")).select("g", "n", "rare", F.posexplode(F.slice("prefix", F.col("rare").cast("int") + 1, F.size("prefix"))).alias("_at", "token"))
    often = often.select("g", "n", (F.col("_at") + F.col("rare")).cast("int").alias("pos"), "token")
    lengths = often.groupBy("token").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    return few.select("token", "g", "n", "pos", "length").union(often.join(lengths, "token").select("token", "g", "n", "pos", "length"))


def met(lists: DataFrame, label: Labels, similarity: Similarity, k: int, bucket: int) -> DataFrame:
    """Pairs of groups that share a bucket of `bucket` entries or so, lie in different components and pass the filters.

    After the first round the entries of a list's main component meet the others only, by
    bands of size: most of a list is of that component by then.
    """
    own = label.of(lists, "g").withColumn("_d", F.pmod(F.xxhash64("g", "token", F.lit(k)), F.ceil(F.col("length") / bucket)))
    columns = [F.col(c) for c in ("token", "_d", "g", "n", "pos", "c")]
    key = ["token", "_d"]
    if k:
        each = own.groupBy("token", "c").agg(F.count(F.lit(1)).alias("_size")).groupBy("token")
        main = each.agg(F.max(F.struct("_size", "c"))["c"].alias("_main"), F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1")
        own = own.join(main.select("token", "_main"), "token")
        band = F.floor(F.log(F.col("n").cast("double")) / np.log(similarity.den / similarity.num)).cast("int")
        others = own.select(*columns, (F.col("c") == F.col("_main")).alias("_in"), band.alias("_band"))
        own = own.where("c <> _main").select(*columns, F.explode(F.array(band - 1, band, band + 1)).alias("_band"))
        key = [*key, "_band"]
    else:
        own = others = own.select(*columns, F.lit(False).alias("_in"))
    x, y = own.alias("x"), others.alias("y")
    apart = F.when(F.col("y._in"), F.col("x.c") != F.col("y.c")).otherwise(F.col("x.c") < F.col("y.c"))
    cond = apart & similarity.may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    for c in key:
        cond = cond & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    return x.join(y, cond).select(F.least("x.g", "y.g").alias("a"), F.greatest("x.g", "y.g").alias("b")).distinct()


def join(docs: DataFrame, size: int = 5, similarity: Similarity | None = None, frequent_most: int = 250_000, bucket: int = 8) -> DataFrame:
    """Linked components of documents (doc_id, text): doc_id, n_shingles, component_id, by whole texts.

    A document's set is its distinct shingles of `size` words, or its whole sequence if it
    has fewer; two link at a Jaccard similarity of at least `similarity`. component_id is
    the smallest doc_id reachable by links. Null texts and texts without words have the
    empty set, which links with nothing; very long texts are taken whole. Repeated rows are
    one document, returned as often; rows of one id with unlike texts are one document that
    links where any of them does. Rows without an id link with nothing and have a null
    component_id. Other columns are ignored; an empty table gives no row.

    bucket: entries of a list that meet in the first round; sixteen times as many in each
    further one, until all of the longest list do.
    """
    similarity, shingler = similarity or Similarity(), Shingler(size)
    with small_batches(docs.sparkSession):
        return _joined(docs.select("doc_id", "text"), shingler, similarity, frequent_most, bucket)


def _joined(docs: DataFrame, shingler: Shingler, similarity: Similarity, frequent_most: int, bucket: int) -> DataFrame:
    known = docs.where("doc_id is not null")
    sets = written(prefixes(docs, shingler, similarity, frequent(docs, shingler, frequent_most)), "sets")
    own = ["n", "s", "t"]
    narrow = written(sets.select("row", "doc_id", *own, "_key"), "narrow")
    classes = narrow.where("n > 0 and doc_id is not null").groupBy(*own)
    classes = written(classes.agg(F.min("doc_id").alias("rep"), F.min_by("row", "doc_id").alias("row"), F.first("_key").alias("_key")), "classes")
    copies = written(narrow.select("row").join(classes.select("row"), "row", "left_anti"), "copies")
    bins = sieve.without(sets.select("row", F.col("doc_id").alias("rep"), "n", "bins"), "row", copies).drop("row")
    lead = classes.groupBy("n", "_key").agg(F.min("rep").alias("g"))
    members, told = observed(classes.join(lead, ["n", "_key"]).select("rep", "row", "g", "n"), "members", F.count_if(F.col("rep") != F.col("g")).alias("more"))
    label, many = Labels(), F.count(F.lit(1)).alias("rows")

    def tried(asked: DataFrame, figures: dict) -> DataFrame | None:
        """Links of the pairs of a written table, if any, merged into the labels."""
        if not figures["rows"]:
            return None
        pairs, found = observed(likely(asked, bins, similarity), "pairs", many)
        if not found["rows"]:
            dropped(pairs)
            return None
        links = verified(pairs, known, shingler, similarity)
        label.merge(links)
        dropped(pairs)
        return links

    if told["more"]:  # groups of several: those that do not link with their lead leave it
        asked, figures = observed(members.where("rep <> g").select(F.col("g").alias("a"), F.col("rep").alias("b")), "met", many)
        linked = tried(asked, figures)
        stay = members.limit(0).select("g", "rep") if linked is None else linked.select(F.col("a").alias("g"), F.col("b").alias("rep")).distinct()
        stay = stay.withColumn("_stays", F.lit(True))
        then = written(members.join(stay, ["g", "rep"], "left").withColumn("g", F.when(F.col("_stays"), F.col("g")).otherwise(F.col("rep"))).drop("_stays"), "members")
        dropped(members, linked, asked)
        members = then
    others = written(narrow.select("row").join(members.where("rep = g").select("row"), "row", "left_anti"), "others")
    leads = sieve.without(sets.select("row", F.col("doc_id").alias("g"), "n", "prefix", "rare"), "row", others)
    lists, told_lists = observed(lists_of(leads), "lists", F.coalesce(F.max("length"), F.lit(0)).alias("longest"))
    swept(docs.sparkSession)
    bins = written(bins, "bins")
    dropped(sets, copies, others)
    crowds = written(members.where("rep <> g").select("g").distinct(), "crowds") if told["more"] else None
    k, done, waiting = 0, 1, None
    while done < told_lists["longest"]:
        pairs, figures = observed(met(lists.where(F.col("length") > done), label, similarity, k, bucket), "met", many)
        if crowds is not None:  # pairs to look at again, member by member
            some = crowds.select(F.col("g").alias("_g"))
            held = pairs.join(some, F.col("a") == F.col("_g"), "left_semi").union(pairs.join(some, F.col("b") == F.col("_g"), "left_semi"))
            held = written(held.distinct(), "waiting")
            waiting = [*(waiting or []), held]
        dropped(tried(pairs, figures), pairs)
        k, done, bucket = k + 1, bucket, bucket * 16
        swept(docs.sparkSession)
    if waiting:
        all_waiting = waiting[0]
        for held in waiting[1:]:
            all_waiting = all_waiting.union(held)
        apart = label.of(label.of(all_waiting.distinct(), "a", "_c"), "b", "_d").where("_c <> _d")
        one, other = (members.select(F.col("g").alias(g), F.col("rep").alias(r)) for g, r in (("a", "_x"), ("b", "_y")))
        whole = apart.join(one, "a").join(other, "b").where("a <> _x or b <> _y").select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))
        asked, figures = observed(whole.distinct(), "met", many)
        dropped(tried(asked, figures), asked, *waiting)
    of_class = label.of(classes.select(*own, "rep"), "rep").drop("rep")
    found = narrow.select("doc_id", *own).join(of_class, own, "left")
    result = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    out = written(found.select("doc_id", F.col("n").alias("n_shingles"), result.alias("component_id")), "components")
    dropped(narrow, classes, bins, members, lists, crowds, label.table)
    swept(docs.sparkSession)
    return out
