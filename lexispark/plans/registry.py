"""All queries of the core, gathered from the modules of this folder."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ("text", "morphology", "language_models", "vector_space", "classification", "subwords", "files")


def query(sql: str | None = None):
    """Register a function as a query under its own name, with the SQL that must agree with it."""

    def wrap(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return wrap


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lexispark.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


#: Columns that are 32-bit in Spark (array sizes, positions, ranks) and 64-bit in the SQL.
_INT_COLUMNS = {
    "sent_idx": "sentence_split io_token_documents io_sentence_documents", "tok_idx": "io_token_documents message_tokens subword_pretokens", "tokens": "blank_tokens", "types": "blank_tokens", "pairs": "distinct_pairs", "pos": "pmi io_tagged_corpus io_tagged_columns",
    "place": "tfidf_top_terms cosine_knn_aligned cosine_knn_full cosine_knn_self",
    "n": "io_ngram_tables io_smoothing_tables ngram_vocab ngram_mle ngram_top freq_of_freq context_sums add_one add_k token_type smoothing_comparison select_model smoothing_summary sentence_score_matrix extreme_sentences sentence_probability_smoothed katz_textbook_weights good_turing_table good_turing_prob katz_discount katz_prob katz_backoff_weights kn_discount kn_prob",
}


def oracle_sql() -> dict[str, str]:
    """The SQL of every query that has one, with integer widths as in Spark."""
    _load()
    out = dict(_SQL)
    for name, sql in _SQL.items():
        narrow = [c for c, queries_ in _INT_COLUMNS.items() if name in queries_.split()]
        if narrow:
            out[name] = f"SELECT * REPLACE ({', '.join(f'{c}::INTEGER AS {c}' for c in narrow)}) FROM ({sql})"
    return out
