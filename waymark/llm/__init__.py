"""Training-data operators: near-dedup, decontamination, tokenization, filters, PII, packing, WARC.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame plus column names and returns a DataFrame; ``queries`` holds the thin
contract queries that derive digest columns from the operators' real outputs.
"""
