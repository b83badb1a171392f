"""The corpus queries and their SQL."""

from __future__ import annotations

from . import bpe, jaccard, language_model, neighbours, packing, paragraphs, quality, token_counts, toxicity, urls

QUERIES = {
    "op1_nearest_neighbours": neighbours.op1_nearest_neighbours,
    "op2_lm_scores": language_model.op2_lm_scores,
    "op3_substring_dedup": paragraphs.op3_substring_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_url_filter": urls.op7_url_filter,
    "op8_bpe_codec": bpe.op8_bpe_codec,
    "op9_packing": packing.op9_packing,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "quality_ablation": quality.quality_ablation,
}
ORACLES = {"op5_quality_rules": quality.OP5_SQL, "quality_ablation": quality.ABLATION_SQL, "op10_jaccard_join": jaccard.OP10_SQL}
