"""Registered corpus queries: SQL where there is one, and the columns they promise."""

import pytest
from compare import connect, differences
from conftest import SF_DIR

from marquee.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "op1_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op2_projection_forest": ["query_id", "rank", "vec_id", "score"],
    "op4_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op7_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op8_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_bpe_automaton": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_near_vectors": ["vec_id", "n_links", "component_id", "kept"],
    "op11_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op12_whitening": [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
    ],
}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF_DIR), duck, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(ORACLE)))
def test_columns(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    assert found.columns == COLUMNS[name]
    assert found.count() > 0


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in names}
    assert "pipeline" in names
