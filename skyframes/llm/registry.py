"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import context_mixing, html_extraction, ngram_join, piece_lattice, quality_rules, source_mixing, token_store, url_filters, vector_graphs, warc_bundles


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_context_mixing": context_mixing.op3_context_mixing,
        "op4_vector_graphs": vector_graphs.op4_vector_graphs,
        "op5_warc": warc_bundles.op5_warc,
        "op6_token_store": token_store.op6_token_store,
        "op7_url_filters": url_filters.op7_url_filters,
        "op8_source_mixing": source_mixing.op8_source_mixing,
        "op9_html_extraction": html_extraction.op9_html_extraction,
        "op10_piece_lattice": piece_lattice.op10_piece_lattice,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.OP1_SQL,
        "op2_ngram_join": ngram_join.OP2_SQL,
        "op5_warc": warc_bundles.OP5_SQL,
        "op7_url_filters": url_filters.OP7_SQL,
        "op8_source_mixing": source_mixing.OP8_SQL,
        "op9_html_extraction": html_extraction.OP9_SQL,
    }
