"""The subpackage's queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from loculus.llm.binary import op9_token_ids
from loculus.llm.fingerprints import op3_fingerprints
from loculus.llm.hard_negatives import op12_hard_negatives, op12_sql
from loculus.llm.hnsw import op8_hnsw, op8_sql
from loculus.llm.lm_scoring import op1_lm_scoring
from loculus.llm.mixing import op5_mixing, op5_sql
from loculus.llm.packing import op2_packing
from loculus.llm.quality import op4_quality
from loculus.llm.sharding import op10_sharding, op10_sql
from loculus.llm.shingle_join import op6_shingle_join, op6_sql
from loculus.llm.token_counts import op13_token_counts
from loculus.llm.toxicity import op7_toxicity
from loculus.llm.vector_codes import op11_sql, op11_vector_codes

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_packing": op2_packing,
    "op3_fingerprints": op3_fingerprints,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_shingle_join": op6_shingle_join,
    "op7_toxicity": op7_toxicity,
    "op8_hnsw": op8_hnsw,
    "op9_token_ids": op9_token_ids,
    "op10_sharding": op10_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_counts": op13_token_counts,
}
SQL = {"op5_mixing": op5_sql(), "op6_shingle_join": op6_sql(), "op8_hnsw": op8_sql(), "op10_sharding": op10_sql(), "op11_vector_codes": op11_sql(), "op12_hard_negatives": op12_sql()}
