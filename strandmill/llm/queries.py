"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from strandmill.llm import bpe, byte_ranks, divergence, exact_dedup, jaccard, language, media, mixing, sharding, token_counts, toxicity, url_filter, whitening

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_media": media.op2_media,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_language": language.op4_language,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_shard": sharding.op10_shard,
    "op11_byte_ranks": byte_ranks.op11_byte_ranks,
    "op12_divergence": divergence.op12_divergence,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {"op3_exact_dedup": exact_dedup.SQL, "op7_url_filter": url_filter.SQL, "op12_divergence": divergence.SQL}
