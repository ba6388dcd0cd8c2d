"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import importlib

#: query: (module, its function, its SQL)
_PLACES = {
    "op1_ngram_join": ("ngram_join", "op1_ngram_join", "OP1_SQL"),
    "op2_licenses": ("licenses", "op2_licenses", None),
    "op3_langid": ("langid", "op3_langid", None),
    "op4_packing": ("packing", "op4_packing", None),
    "op5_audio": ("audio", "op5_audio", None),
    "op6_byte_bpe": ("byte_bpe", "op6_byte_bpe", None),
    "op7_chat": ("chat", "op7_chat", "OP7_SQL"),
    "op8_warc": ("warc", "op8_warc", "OP8_SQL"),
    "op9_quality": ("quality", "op9_quality", None),
    "op10_ann": ("ann", "op10_ann", None),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"packframe.llm.{module}"), function) for name, (module, function, _) in _PLACES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"packframe.llm.{module}"), sql) for name, (module, _, sql) in _PLACES.items() if sql}
