"""The subpackage's registered queries, and the SQL for those that SQL can state."""

from __future__ import annotations

import importlib

#: Module, and the function that is the query of the same name.
NAMES = {
    "op1_ngram_jaccard": "jaccard_join",
    "op2_token_ids": "wavelet",
    "op3_best_fit_packing": "packing",
    "op4_quality_rules": "quality_rules",
    "op5_sentence_pieces": "sentence_pieces",
    "op6_nearest_neighbours": "neighbours",
    "op7_license_scan": "licenses",
    "op8_warc": "warc",
    "op9_quality_classifier": "quality_classifier",
    "op10_toxicity": "toxicity",
}


def queries():
    return {name: getattr(importlib.import_module(f"cladeflow.llm.{module}"), name) for name, module in NAMES.items()}


def oracle_sql():
    from cladeflow.llm import jaccard_join, licenses, quality_rules, warc

    return {"op1_ngram_jaccard": jaccard_join.ORACLE, "op4_quality_rules": quality_rules.ORACLE, "op7_license_scan": licenses.ORACLE, "op8_warc": warc.ORACLE}
