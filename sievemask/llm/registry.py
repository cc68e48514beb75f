"""All queries of this package."""

from sievemask.llm import collocations, ctw, exact_dedup, hard_negatives, html_text, langid, mixing, near_dedup, packing, suffix_dedup, token_counts, topk, warc

MODULES = (collocations, ctw, exact_dedup, hard_negatives, html_text, langid, mixing, near_dedup, packing, suffix_dedup, token_counts, topk, warc)
QUERIES = {name: entry for module in MODULES for name, entry in module.QUERIES.items()}
