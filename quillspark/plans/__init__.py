"""Registered queries, each with the SQL that checks it."""

from quillspark.plans import briefs, cards, chunks, contexts, glosses, learner, lexicon, merged, paged, providers, reports, retrieval, selection, sources, store, streams, validation
from quillspark.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "briefs", "cards", "chunks", "contexts", "glosses", "learner", "lexicon", "merged", "paged", "providers", "reports", "retrieval", "selection", "sources", "store", "streams", "validation"]
