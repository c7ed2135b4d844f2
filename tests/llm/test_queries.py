"""The registered queries of the operators: rows on the smallest tables, against SQL where it can say them."""

import pytest

from quillspark.llm.queries import oracle_sql, queries
from tests.test_queries import DATA, duck, multiset  # noqa: F401

COLUMNS = {
    "op1_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op2_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op4_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op5_html": ["page_id", "url", "text", "n_chars"],
    "op6_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8_topk": ["query_id", "rank", "doc_id", "score"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op12_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op13_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op10_fingerprint": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, duck, name):  # noqa: F811
    got = queries()[name](spark, DATA).toPandas()
    assert list(got.columns) == COLUMNS[name] and len(got)
    docs = duck.execute("SELECT doc_id FROM documents").df()["doc_id"]
    pages = duck.execute("SELECT page_id FROM pages").df()["page_id"]
    vectors = duck.execute("SELECT vec_id FROM embeddings").df()["vec_id"]
    if name in oracle_sql():
        assert multiset(got) == multiset(duck.execute(oracle_sql()[name]).df())
    if name == "op8_topk":
        assert set(got["query_id"]) <= {d for d in docs if d % 50 == 0}
    elif name == "op1_packing":
        assert set(got["doc_id"]) == set(docs)
    else:
        assert sorted(got[COLUMNS[name][0]]) == sorted(pages if "page_id" in COLUMNS[name] else vectors if "vec_id" in COLUMNS[name] else docs)


def test_registered():
    assert sorted(queries()) == sorted(COLUMNS) and set(oracle_sql()) <= set(COLUMNS)
