"""The training-data queries and their SQL; __spark_entry__ adds them when this subpackage is there."""

from __future__ import annotations

from importlib import import_module

#: query name, module, module and name of its SQL (None: not expressible in SQL, tested by brute force)
_QUERIES = [
    ("op1_seeded_alignment", "op1_decontamination", None),
    ("op2_randomness_battery", "op2_secrets", None),
    ("op3_feistel_sharding", "op3_sharding", "sql.OP3_SQL"),
    ("op4_anchor_expansion", "op4_pii", None),
    ("op5_conditional_compression", "op5_licenses", None),
    ("op6_best_fit_packing", "op6_packing", None),
    ("op8_robust_outliers", "op8_quality", None),
    ("op9_signature_trees", "op9_jaccard", "sql.OP9_SQL"),
    ("op7_content_addressed_warc", "op7_warc", "op7_warc.OP7_SQL"),
    ("op10_language_mixture", "op10_language", None),
    ("op11_perfect_hash_alignment", "op11_alignment", None),
    ("op12_pair_maxscore", "op12_search", "sql.OP12_SQL"),
    ("op13_order_minhash", "op13_fingerprints", None),
]


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module, _ in _QUERIES}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, _, sql in _QUERIES:
        if sql:
            module, _, constant = sql.partition(".")
            out[name] = getattr(import_module(f".{module}", __package__), constant)
    return out
