"""Operators for preparing large text corpora for language-model training.

Each module holds one operator with a general interface plus the thin ``opN_<name>`` query that applies it, with
production parameters, to its whole table. Nothing outside this subpackage imports it, apart from ``corpus_pipeline``.
"""
