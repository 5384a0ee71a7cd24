"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from . import brown, decontaminate, licenses, mixing, neardup_vectors, simhash, substrings, suffixes, tokens, toxicity

QUERIES = {
    "op1_near_vectors": neardup_vectors.op1_near_vectors,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_tokens": tokens.op3_tokens,
    "op4_brown": brown.op4_brown,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_substrings": substrings.op6_substrings,
    "op7_licenses": licenses.op7_licenses,
    "op8_mixing": mixing.op8_mixing,
    "op9_suffixes": suffixes.op9_suffixes,
    "op10_simhash": simhash.op10_simhash,
}
ORACLE_SQL = {
    "op9_suffixes": suffixes.ORACLE_SQL,
    "op1_near_vectors": neardup_vectors.ORACLE_SQL,
    "op6_substrings": substrings.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
}
