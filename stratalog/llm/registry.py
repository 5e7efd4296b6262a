"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP5_SQL, op5_format_chat
from .html import op6_html_main_text
from .langid import op2_language_id
from .mixing import op1_mix_sources
from .neardup import op9_minhash_near_dedup
from .packing import op8_mixture_packing
from .sharding import op7_shard_documents
from .sql import MINHASH_NEAR_DEDUP, NEAR_DUPLICATE_VECTORS
from .toxicity import op3_toxicity
from .vectors import OP10_SQL, op4_near_duplicate_vectors, op10_exact_top_k


def queries() -> dict:
    found = [op1_mix_sources, op2_language_id, op3_toxicity, op4_near_duplicate_vectors, op5_format_chat, op6_html_main_text, op7_shard_documents, op8_mixture_packing, op9_minhash_near_dedup, op10_exact_top_k]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_near_duplicate_vectors": NEAR_DUPLICATE_VECTORS, "op5_format_chat": OP5_SQL, "op9_minhash_near_dedup": MINHASH_NEAR_DEDUP, "op10_exact_top_k": OP10_SQL}
