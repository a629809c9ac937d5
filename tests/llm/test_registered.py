import importlib

import __spark_entry__ as contract

NAMES = [
    "op1_mixing", "op2_packing", "op3_ngram_join", "op4_quality_rules", "op5_imatch", "op6_chat_format",
    "op7_lm_scoring", "op8_bit_planes", "op9_sharding", "op10_quality_classifier", "pipeline",
]


def test_all_corpus_queries_are_registered():
    assert set(NAMES) <= set(contract.queries())
    assert "op1_mixing" in contract.oracle_sql() and "pipeline" not in contract.oracle_sql()


def test_entry_without_the_subpackage(monkeypatch):
    real = importlib.util.find_spec
    gone = {"tidemark.llm", "tidemark.llm.queries", "corpus_pipeline"}
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in gone else real(name, *a))
    left = contract.queries()
    assert left and not set(NAMES) & set(left)
