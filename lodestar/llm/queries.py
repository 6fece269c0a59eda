"""The queries of this subpackage and, where SQL can express them, the SQL they are compared with."""

from . import centroids, exact_dedup, fill_middle, kneser_ney, mixing, packing, page_text, pii, simhash_dedup, span_hash, substring_dedup, tokens, toxicity

_MODULES = (pii, span_hash, mixing, simhash_dedup, toxicity, kneser_ney, packing, tokens, exact_dedup, page_text, substring_dedup, fill_middle, centroids)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
