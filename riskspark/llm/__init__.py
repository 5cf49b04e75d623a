"""Operators for large-scale training-data pipelines (deduplication, archives,
tokenization, quality, toxicity, language, packing). Nothing outside this
subpackage imports it."""
