"""Retrieval in up to three attempts: strategies with fingerprints, and candidates that accumulate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.streaming.snapshots import Snapshots

#: Attempts of a retrieval, candidates of a query where none are said, providers.
ATTEMPTS, LIMIT, PROVIDERS = 3, 100, ("openalex", "arxiv")
QUERY = "struct<id:string,label:string,query:string,candidate_limit:int>"
FEED = "struct<id:string,label:string,phrases:array<string>,categories:array<string>,date_lane:string>"
STRATEGY = f"seq long, strategy_id string, providers array<string>, search_queries array<{QUERY}>, arxiv_search_queries array<{FEED}>, primary_filter string, arxiv_categories array<string>, from_date string, to_date string"
FOUND = "identity string, attempt int, at int, title string, hits array<int>"


def canonical_json(c: Column) -> Column:
    """A struct as JSON in one form: no spaces, nulls said. Its fields must stand in the order of their names."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def fingerprint() -> Column:
    """24 hexadecimal digits for what a strategy (STRATEGY) asks, whatever the order and the names of its queries."""
    none = F.array()
    asked = F.transform(F.coalesce("search_queries", none.cast(f"array<{QUERY}>")), lambda q: F.struct(F.coalesce(q["candidate_limit"], F.lit(LIMIT)).alias("candidate_limit"), F.trim(F.coalesce(q["query"], F.lit(""))).alias("query")))
    asked = F.transform(F.array_sort(F.transform(asked, lambda q: F.struct(q["query"].alias("k"), q.alias("q")))), lambda x: x["q"])
    words = lambda c: F.coalesce(c, none.cast("array<string>"))
    feeds = F.transform(F.coalesce("arxiv_search_queries", none.cast(f"array<{FEED}>")), lambda q: F.struct(words(q["categories"]).alias("categories"), F.coalesce(q["date_lane"], F.lit("recent")).alias("date_lane"), words(q["phrases"]).alias("phrases")))
    feeds = F.transform(F.array_sort(F.transform(feeds, lambda q: F.struct(canonical_json(q).alias("k"), q.alias("q")))), lambda x: x["q"])
    said = F.struct(
        F.col("arxiv_categories"), feeds.alias("arxiv_search_queries"), F.col("primary_filter").alias("openalex_primary_filter"), F.array_sort(words(F.col("providers"))).alias("providers"), F.col("from_date").alias("publication_from_date"), F.col("to_date").alias("publication_to_date"), asked.alias("search_queries")
    )
    return F.substring(F.sha2(canonical_json(said), 256), 1, 24)


def strategy_violations(strategies: DataFrame) -> DataFrame:
    """seq, violation of strategies (STRATEGY) whose shape is wrong: the first rule that each breaks."""
    bare = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    has = lambda p: F.array_contains("providers", p)
    own = F.col("providers")
    why = F.when(bare(F.col("strategy_id")), "no id").when(empty(own) | (F.size(F.array_distinct(own)) != F.size(own)) | F.exists(own, lambda p: ~F.coalesce(p.isin(*PROVIDERS), F.lit(False))), "providers")
    why = why.when(has("openalex") & empty(F.col("search_queries")), "no queries").when(has("openalex") & F.exists("search_queries", lambda q: bare(q["id"]) | bare(q["label"]) | bare(q["query"])), "a query without id, label or text")
    why = why.when(has("openalex") & bare(F.col("primary_filter")), "no primary filter").when(has("arxiv") & empty(F.col("arxiv_search_queries")), "no feed queries")
    why = why.when(has("arxiv") & F.exists("arxiv_search_queries", lambda q: bare(q["id"]) | bare(q["label"])), "a feed query without id or label")
    why = why.when(has("arxiv") & F.exists("arxiv_search_queries", lambda q: empty(q["phrases"]) | (empty(q["categories"]) & empty(F.col("arxiv_categories")))), "a feed query without phrases or categories")
    return strategies.select("seq", why.alias("violation")).where("violation is not null")


def attempts(strategies: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """seq, fingerprint, number, outcome of strategies (seq, fingerprint) in the order of seq.

    The first `most` different ones are taken and numbered; what asks the same as one taken
    before is a duplicate; after the last number there are too many.
    """
    first = strategies.groupBy("fingerprint").agg(F.min("seq").alias("_seq")).orderBy("_seq").limit(most)
    numbers = first.select(F.col("_seq"), F.row_number().over(Window.orderBy("_seq")).alias("number"))  # `most` rows
    last = numbers.agg(F.when(F.count(F.lit(1)) == most, F.max("_seq")).alias("_last"))
    out = strategies.join(F.broadcast(numbers), F.col("seq") == F.col("_seq"), "left").crossJoin(F.broadcast(last))  # rows of the attempts; one row
    outcome = F.when(F.col("number").isNotNull(), "taken").when(F.col("seq") > F.col("_last"), "too many").otherwise("duplicate")
    return out.select("seq", "fingerprint", "number", outcome.alias("outcome"))


def folded(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Accumulated candidates (FOUND) after rows of that shape: a known identity keeps its record and adds its hits."""
    both = state.unionByName(rows.select(*state.columns)).where("coalesce(identity, '') <> ''")
    flat = both.groupBy("identity").agg(F.min(F.struct("attempt", "at", "title")).alias("_f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))  # hits: numbers of attempts
    return flat.select("identity", "_f.attempt", "_f.at", "_f.title", "hits")


def accumulate(store: Snapshots, candidates: DataFrame, number: int) -> dict:
    """Merge the candidates (identity, at, title) of an attempt into the store, once; how many there were before, are new and are there in all."""
    rows = candidates.select("identity", F.lit(number).alias("attempt"), "at", "title", F.array(F.lit(number)).alias("hits"))
    rows = rows.groupBy("identity").agg(F.min(F.struct("attempt", "at", "title", "hits")).alias("_f")).select("identity", "_f.*")
    store.merge(rows, folded, "retrieval", number)
    told = store.read().agg(F.count_if(F.col("attempt") < number).alias("before"), F.count_if(F.col("attempt") == number).alias("new"), F.count_if(F.col("attempt") <= number).alias("total")).first()
    return {"number": number, "candidate_count_before": told["before"], "new_candidate_count": told["new"], "total_candidate_count": told["total"]}
