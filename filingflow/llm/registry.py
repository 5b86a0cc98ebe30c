"""The queries of this package, one per operator, with SQL where SQL can say the same."""

from filingflow.llm import bpe_rank_queue, gnat_negatives, language_id, latent_decontamination, license_diagonals, multiprobe_lsh, near_duplicates, quality_bayes, rank_index, suffix_dedup, token_counts, toxicity_chain, url_language_model

QUERIES = {
    "op1_url_language_model": url_language_model.op1_url_language_model,
    "op2_multiprobe_lsh": multiprobe_lsh.op2_multiprobe_lsh,
    "op3_language_id": language_id.op3_language_id,
    "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
    "op5_latent_decontamination": latent_decontamination.op5_latent_decontamination,
    "op6_toxicity_chain": toxicity_chain.op6_toxicity_chain,
    "op7_quality_bayes": quality_bayes.op7_quality_bayes,
    "op8_similarity_sketching": near_duplicates.op8_similarity_sketching,
    "op9_bpe_rank_queue": bpe_rank_queue.op9_bpe_rank_queue,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_license_diagonals": license_diagonals.op11_license_diagonals,
    "op12_fim_rank_index": rank_index.op12_fim_rank_index,
    "op13_gnat_negatives": gnat_negatives.op13_gnat_negatives,
}

ORACLES: dict[str, str] = {
    "op11_license_diagonals": license_diagonals.OP11_SQL,
    "op12_fim_rank_index": rank_index.OP12_SQL,
    "op13_gnat_negatives": gnat_negatives.OP13_SQL,
}
