"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op1_packing": "packing",
    "op2_chat_format": "chat_format",
    "op3_substring_dedup": "substring_dedup",
    "op4_quality_rules": "quality_rules",
    "op5_bpe_codec": "bpe_codec",
    "op6_license_scan": "license_scan",
    "op7_pii": "pii",
    "op8_ngram_join": "ngram_join",
    "op9_telephony": "telephony",
    "op10_toxicity": "toxicity",
    "op11_quality_classifier": "quality_classifier",
    "op12_source_divergence": "divergence",
    "op13_whitening": "whitening",
}


def _query(name: str):
    return getattr(import_module(f"{__package__}.{MODULES[name]}"), name)


def queries() -> dict:
    return {name: _query(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", {})
        if name in sql:
            found[name] = sql[name]
    return found
