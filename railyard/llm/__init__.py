"""Operators of a training-data pipeline (token counts, decontamination,
substring dedup, chat formatting, language id, quality rules, packing,
near-dedup, HTML extraction, quality classifier, line dedup, conversation
prefix trie, importance resampling). Nothing else in the library
imports this subpackage."""
