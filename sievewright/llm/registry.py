"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .fingerprints import op3_i_match
from .line_dedup import op7_edit_join
from .mixing import op1_raking
from .nn_descent import op8_nn_descent
from .oracles import oracle_sql
from .order_minhash import op6_order_minhash
from .packing import op10_karmarkar_karp
from .seed_extend import op4_seed_extend
from .sharding import op9_interleave
from .suffix_dedup import op2_suffix_merge
from .toxicity import op5_deobfuscate

__all__ = ["oracle_sql", "queries"]


def queries() -> dict:
    return {
        "op1_raking": op1_raking,
        "op2_suffix_merge": op2_suffix_merge,
        "op3_i_match": op3_i_match,
        "op4_seed_extend": op4_seed_extend,
        "op5_deobfuscate": op5_deobfuscate,
        "op6_order_minhash": op6_order_minhash,
        "op7_edit_join": op7_edit_join,
        "op8_nn_descent": op8_nn_descent,
        "op9_interleave": op9_interleave,
        "op10_karmarkar_karp": op10_karmarkar_karp,
    }
