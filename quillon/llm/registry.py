"""The queries of the training-data operators, with their DuckDB twins where SQL can say them."""

from importlib import import_module

MODULES = ("quality_rules", "token_counts", "packing", "token_output", "decontamination", "near_duplicates", "repeats", "quality_classifier", "language_id", "html_extraction", "exact_dedup", "token_alignment", "hard_negatives")
QUERIES = {name: query for module in MODULES for name, query in import_module(f"{__package__}.{module}").QUERIES.items()}
