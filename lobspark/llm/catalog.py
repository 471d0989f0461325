"""The registered queries of the training-data operators, and SQL with the same results where SQL can express them."""

from . import chunk_reuse, clustering, divergence, exact_dedup, html_text, knn_join, mixing, near_dedup, packing, substring_dedup, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_mixing": mixing.op8_mixing,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_exact_topk": knn_join.op10_exact_topk,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_chunk_reuse": chunk_reuse.op12_chunk_reuse,
    "op13_centroid_clustering": clustering.op13_centroid_clustering,
}
SQL = {
    "op1_near_dedup": near_dedup.SQL,
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_exact_topk": knn_join.SQL,
    "op11_source_divergence": divergence.SQL,
    "op13_centroid_clustering": clustering.SQL,
}
