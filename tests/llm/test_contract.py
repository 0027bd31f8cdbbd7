"""Document queries: names, SQL where it can express them, and what the others are compared with."""

from barloom.llm import queries

#: Compared with brute force, round trips or held-out accuracy in this folder.
WITHOUT_SQL = {"op2_toxicity", "op3_mix_sources", "op4_pseudonyms", "op5_ngram_jaccard", "op6_packing", "op7_token_counts", "op8_id_files", "op9_language", "pipeline"}


def test_every_query_has_sql_or_a_test():
    assert set(queries.QUERIES) - set(queries.SQL) == WITHOUT_SQL and set(queries.SQL) <= set(queries.QUERIES)
    assert [n for n in queries.QUERIES if n.startswith("op")] == sorted(queries.QUERIES.keys() - {"pipeline"}, key=lambda n: int(n[2:].split("_")[0]))


def test_entry_registers_the_document_queries():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())
