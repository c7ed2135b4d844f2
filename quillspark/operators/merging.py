"""Candidates that are one: merged records over several identity keys, greedy exact duplicates, packets for review.

The rules are sequential (each candidate meets what earlier ones have left). They are
computed in rounds over whole tables: a decision depends on earlier rows alone, so every
round settles at least the earliest open ones, and a round that changes nothing is the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.shared import dropped, observed, written


def filled(c: str) -> Column:
    """A lower-case id, null if it is empty."""
    return F.nullif(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(""))


def _roots(parents: DataFrame) -> DataFrame:
    """parents (order, parent) with root: the row without a parent at the end of each chain, by pointer jumping.

    Here and in merge_groups() tables as long as the input meet by shuffles at every size: broadcast in
    each of the rounds, those that are small enough for it would add up at the driver.
    """
    now = written(parents.select("order", F.coalesce("parent", "order").alias("root")), "roots")
    while True:
        up = now.select(F.col("order").alias("_o"), F.col("root").alias("_up"))
        moved = F.count_if(F.col("_up") != F.col("root")).alias("moved")
        joined = now.join(up.hint("merge"), F.col("root") == F.col("_o")).select("order", "root", "_up")
        then, told = observed(joined, "roots", moved)
        dropped(now)
        now = then.select("order", F.col("_up").alias("root"))
        now.written_to = then.written_to
        if not told["moved"]:
            return now


def merge_groups(candidates: DataFrame) -> DataFrame:
    """order, merged_into of candidates (order, doi, arxiv_id, semantic_scholar_id, title).

    A candidate joins the record of the latest earlier one with its DOI, or else arXiv id, or
    else third id; or else of the latest earlier one with its title, unless that record's DOI
    or arXiv id, as far as it has one by then, contradicts its own. A record has the first
    DOI and arXiv id that any of its candidates has. Else it is a record of its own.
    """
    own = candidates.select("order", filled("doi").alias("doi"), filled("arxiv_id").alias("arxiv"), filled("semantic_scholar_id").alias("third"), F.nullif(text.title_key(F.col("title")), F.lit("")).alias("title"))
    own = written(own, "candidates")
    before = own
    for key in ("doi", "arxiv", "third", "title"):
        held = own.where(F.col(key).isNotNull()).select(F.col("order").alias("_o"), F.lag("order").over(Window.partitionBy(key).orderBy("order")).alias(f"_by_{key}"))
        before = before.join(held.where(f"_by_{key} is not null").hint("merge"), F.col("order") == F.col("_o"), "left").drop("_o")
    before = written(before.select("order", "doi", "arxiv", F.coalesce("_by_doi", "_by_arxiv", "_by_third").alias("strong"), F.col("_by_title").alias("near")), "links")
    vetoed = written(before.select("order", F.lit(False).alias("veto")), "vetoes")
    while True:
        linked = before.join(vetoed.hint("merge"), "order")
        roots = _roots(linked.select("order", F.coalesce("strong", F.when(~F.col("veto"), F.col("near"))).alias("parent")))
        member = own.join(roots.hint("merge"), "order")
        first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("order").alias("o"), F.col(c).alias("id"))))
        records = member.groupBy("root").agg(first("doi").alias("_doi"), first("arxiv").alias("_arxiv"))
        target = before.where("strong is null and near is not null").join(roots.select(F.col("order").alias("near"), F.col("root").alias("_r")).hint("merge"), "near")
        target = target.join(records.hint("merge"), F.col("_r") == F.col("root"))
        against = lambda c, r: F.coalesce((F.col(f"{r}.o") < F.col("order")) & (F.col(f"{r}.id") != F.col(c)), F.lit(False))
        target = target.select("order", (against("doi", "_doi") | against("arxiv", "_arxiv")).alias("_new"))
        then = vetoed.join(target.hint("merge"), "order", "left").select("order", F.coalesce("_new", F.lit(False)).alias("veto"), "veto")
        then = then.toDF("order", "veto", "was")
        then, told = observed(then, "vetoes", F.count_if(F.col("veto") != F.col("was")).alias("changed"))
        dropped(vetoed)
        vetoed = then.select("order", "veto")
        vetoed.written_to = then.written_to
        if not told["changed"]:
            return roots.select("order", F.col("root").alias("merged_into"))
        dropped(roots)


def merged_hits(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """Query hits (order, provider, query_id, label) of merged records: the first of each provider and query, with its place."""
    own = hits.join(groups.hint("merge"), "order")
    by = own.groupBy("merged_into", "provider", "query_id").agg(F.min(F.struct("order", "label")).alias("_f"))
    place = F.row_number().over(Window.partitionBy("merged_into").orderBy("_f.order", "provider", "query_id"))
    return by.select("merged_into", place.alias("place"), "provider", "query_id", F.col("_f.label").alias("label"))


def merged_routes(routes: DataFrame, groups: DataFrame) -> DataFrame:
    """Alternate download routes (order, no, provider, url) of merged records: each URL once, without the record's own first one."""
    own = routes.where("coalesce(url, '') <> ''").join(groups.hint("merge"), "order")
    main = own.where("order = merged_into and no = 0").select(F.col("merged_into").alias("_m"), F.col("url").alias("_u"))
    rest = own.where("order <> merged_into or no <> 0").join(main.hint("merge"), (F.col("merged_into") == F.col("_m")) & (F.col("url") == F.col("_u")), "left_anti")
    by = rest.groupBy("merged_into", "url").agg(F.min(F.struct("order", "no", "provider")).alias("_f"))
    place = F.row_number().over(Window.partitionBy("merged_into").orderBy("_f.order", "_f.no"))
    return by.select("merged_into", place.alias("route_no"), F.col("_f.provider").alias("provider"), "url")


def greedy_exact(docs: DataFrame, keys: Column) -> DataFrame:
    """doc_id, decision, duplicate_of: walking documents (doc_id, words, and what `keys` needs) by most words, then doc_id,
    one that shares a key with an earlier kept one is its duplicate and registers none of its keys.

    keys: the identity keys of a document, the most telling first; duplicate_of is the owner
    of its first owned key. Only minima by key are computed, so a key of many documents is
    a row for each task.
    """
    own = docs.select("doc_id", F.struct((-F.col("words")).alias("w"), F.col("doc_id").alias("d")).alias("rank"), F.array_compact(keys).alias("keys"))
    own = written(own, "keyed")
    flat = written(own.select("doc_id", "rank", F.posexplode("keys").alias("no", "key")), "keys")
    open_rows, kept = flat, []
    while True:
        first = open_rows.groupBy("key").agg(F.min("rank").alias("_first"))
        leads = F.min((F.col("rank") == F.col("_first")).cast("int")).alias("leads")
        won = written(open_rows.join(first, "key").groupBy("doc_id").agg(leads).where("leads = 1").select("doc_id"), "kept")
        kept.append(won)
        taken = open_rows.join(won, "doc_id", "left_semi").select("key").distinct()
        gone = open_rows.join(taken, "key", "left_semi").select("doc_id").distinct()  # the winners and their duplicates
        rest, told = observed(open_rows.join(gone, "doc_id", "left_anti"), "open", F.count(F.lit(1)).alias("rows"))
        if open_rows is not flat:
            dropped(open_rows)
        open_rows = rest
        if not told["rows"]:
            break
    winners = kept[0]
    for df in kept[1:]:
        winners = winners.union(df)
    owners = flat.join(winners, "doc_id", "left_semi").select("key", F.col("doc_id").alias("_owner"), F.col("rank").alias("_rank"))
    met = flat.join(winners, "doc_id", "left_anti").join(owners, "key").where("_rank < rank")
    duplicates = met.groupBy("doc_id").agg(F.min(F.struct("no", "_owner"))["_owner"].alias("duplicate_of"))
    return own.select("doc_id").join(duplicates, "doc_id", "left").select("doc_id", F.when(F.col("duplicate_of").isNull(), "include").otherwise("duplicate").alias("decision"), "duplicate_of")


def default_review_limit(target: int) -> int:
    return min(100, max(2 * target, target + 10))


def review_packet(candidates: DataFrame, target: int, limit: int | None = None) -> DataFrame:
    """The packet of candidates (order, buckets) for review: order, packet_rank.

    Each bucket, by first encounter, that has no candidate yet gives its first; then in turn
    each gives its next that is not picked. limit must reach the buckets' first picks and
    the target. A bucket needs `limit` candidates and one at most, so what is walked in one
    task is bounded by the number of buckets, which are a profile's queries.
    """
    wanted = default_review_limit(target) if limit is None else limit
    if wanted < target:
        raise ValueError("the limit is smaller than the target")
    flat = candidates.select("order", F.posexplode("buckets").alias("no", "bucket"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("order"))
    some = flat.withColumn("nth", nth).where((F.col("nth") <= wanted + 1))
    first = flat.groupBy("bucket").agg(F.min(F.struct("order", "no")).alias("_first"))
    some = some.join(first, "bucket").select("order", "bucket", F.col("_first.order").alias("f"), F.col("_first.no").alias("g"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"order": [], "bucket": [], "f": [], "g": []}), *batches])
        lists = [list(g["order"].sort_values()) for _, g in rows.groupby(["f", "g", "bucket"], sort=True)]
        picked: dict[int, int] = {}
        for own in lists:
            if not any(o in picked for o in own):
                picked[own[0]] = len(picked) + 1
        if limit is not None and limit < len(picked):
            raise ValueError(f"the limit is too small: {len(picked)} candidates keep every bucket")
        most, left = max(wanted, len(picked)), [iter(own) for own in lists]
        while left and len(picked) < most:
            for own in list(left):
                nxt = next((o for o in own if o not in picked), None)
                if nxt is None:
                    left.remove(own)
                elif len(picked) < most:
                    picked[nxt] = len(picked) + 1
        yield pd.DataFrame({"order": list(picked), "packet_rank": list(picked.values())})

    return some.repartition(1).mapInPandas(walk, "order long, packet_rank long")
