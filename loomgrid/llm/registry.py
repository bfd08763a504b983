"""All queries of this subpackage, and their SQL where SQL can express them."""

from . import embeddings, hard_negatives, html_text, licences, line_dedup, mixing, packing, quality, simhash, surrogates, token_counts, vector_codes, vector_graph

_MODULES = (packing, token_counts, html_text, surrogates, line_dedup, simhash, mixing, embeddings, licences, quality, vector_codes, vector_graph, hard_negatives)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
