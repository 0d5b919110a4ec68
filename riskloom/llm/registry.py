"""The operators' queries and their SQL."""

from __future__ import annotations

from riskloom.llm import ann, huffman, jaccard, kneser, mixing, packing, quality, topk, toxicity, wordpiece

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_topk": topk.op2_topk,
    "op3_packing": packing.op3_packing,
    "op4_quality": quality.op4_quality,
    "op5_token_counts": wordpiece.op5_token_counts,
    "op6_lm_score": kneser.op6_lm_score,
    "op7_token_files": huffman.op7_token_files,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_ann": ann.op9_ann,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {
    "op2_topk": topk.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
