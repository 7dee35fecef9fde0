"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trellis.llm.bpe import op9_bpe_codec
from trellis.llm.conversations import op13_conversation_repair
from trellis.llm.decontaminate import OP12_SQL, op12_decontamination
from trellis.llm.filter_audit import OP11_SQL, op11_filter_audit
from trellis.llm.fingerprint import op7_document_fingerprints
from trellis.llm.knn import OP1_SQL, op1_exact_knn
from trellis.llm.language_id import op3_language_id
from trellis.llm.line_dedup import op6_line_dedup
from trellis.llm.near_dup import op5_minhash_near_dup
from trellis.llm.packing import op8_best_fit_packing
from trellis.llm.repeats import op4_suffix_array_dedup
from trellis.llm.toxicity import op10_toxicity
from trellis.llm.url_filter import OP2_SQL, op2_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_knn": op1_exact_knn,
    "op2_url_filter": op2_url_filter,
    "op3_language_id": op3_language_id,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_minhash_near_dup": op5_minhash_near_dup,
    "op6_line_dedup": op6_line_dedup,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_decontamination": op12_decontamination,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_knn": OP1_SQL,
    "op2_url_filter": OP2_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_decontamination": OP12_SQL,
}
